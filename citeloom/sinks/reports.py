"""Reports as text: a block for each row, and heads from aggregates of a few rows.

Blocks are columns, so a report of any length is made where its rows lie and written by
Spark's text writer; only counts by state come to one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions import identifiers as I
from citeloom.functions.markup import SAFE_SCHEMES, html_of
from citeloom.model import dims

#: A state's sign and name in reports.
LABELS = {
    "VERIFIED": "✅ 已核实", "METADATA_MISMATCH": "⚠️ 元数据不符", "RETRACTED": "🚫 已撤稿", "NOT_FOUND": "❓ 未找到（疑似不存在）",
    "UNVERIFIED": "⏳ 无法核实", "PENDING_MANUAL": "🔍 待人工核对",
}


def payload(rows: DataFrame, out: str = "json") -> DataFrame:
    """Each row as JSON, nulls told as nulls."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(out))


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path, ignoreNullFields=False)


def _label(status: Column) -> Column:
    return I.lookup(status, LABELS, "•")


def item_blocks(judged: DataFrame) -> DataFrame:
    """(ref_id, status, block): a markdown block for each reference (raw_text, mismatches,
    told_by, where they are there), with what to do by hand where that is left."""
    given = lambda c: F.when(I.blank_to_null(F.col(c)).isNotNull(), F.col(c)) if c in judged.columns else F.lit(None).cast("string")
    steps = F.when(F.col("status") == "PENDING_MANUAL", "**人工核对包**：以标题、作者与年份检索中文库，核对后在 `manual_result` 回填")
    lines = [
        F.concat(F.lit("### "), F.col("ref_id").cast("string"), F.lit(" · "), _label(F.col("status"))), F.concat(F.lit("> "), given("raw_text")),
        F.concat(F.lit("- 不符字段："), F.replace(given("mismatches"), F.lit(","), F.lit("、"))), F.concat(F.lit("- 依据："), given("told_by")), steps,
    ]
    return judged.select("ref_id", "status", F.concat_ws("\n", *lines).alias("block"))


def priority_lines(judged: DataFrame) -> DataFrame:
    """(ref_id, line) of the references that must be looked at first."""
    rows = judged.filter(F.col("status").isin(*dims.PRIORITY))
    return rows.select("ref_id", F.concat(F.lit("- "), _label(F.col("status")), F.lit(" **"), F.col("ref_id").cast("string"), F.lit("**")).alias("line"))


def report_head(judged: DataFrame, network: str = "ok", sources: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row, `head`: the network's state first where it is not ok, then the states that occur
    with their shares, then the sources that were asked or must be asked by hand."""
    place = I.lookup(F.col("status"), {s: i for i, s in enumerate(dims.STATUSES)})
    counts = judged.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    g = counts.agg(F.array_sort(F.collect_list(F.struct(place.alias("p"), "status", "n"))).alias("s"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    line = lambda x: F.concat(F.lit("| "), _label(x["status"]), F.lit(" | "), x["n"].cast("string"), F.lit(" | "), F.round(x["n"] * 100 / F.col("total"), 0).cast("int").cast("string"), F.lit("% |"))
    table = F.concat_ws("\n", F.lit("## 六态分布"), F.lit("| 态 | 数量 | 占比 |"), F.lit("|---|---|---|"), F.array_join(F.transform("s", line), "\n"))
    banner = F.lit(None).cast("string") if network == "ok" else F.lit(f"> **⚠️ 降级声明（network_status={network}）**")
    named = "；".join(f"{'、'.join(n for n, c in sources or [] if c == kind)}（{kind}）" for kind in ("自动核验", "待人工核对") if any(c == kind for _, c in sources or []))
    return g.select(F.concat_ws("\n\n", F.lit("# 引用核验报告"), banner, table, F.lit(f"## 已查源清单\n{named or '（无）'}")).alias("head"))


def sources_checked() -> list[tuple[str, str]]:
    """Core sources, which are asked, and guided ones, which are looked at by hand."""
    return [(s, "自动核验") for s, kind, role, _, _ in dims.SOURCES if kind == "api" and role == "core"] + [(s, "待人工核对") for s, kind, *_ in dims.SOURCES if kind == "guided"]


def write_report(judged: DataFrame, path: str, network: str = "ok") -> None:
    """`path`/head, /priority and /items as text, items in the order of ref_id."""
    report_head(judged, network, sources_checked()).write.mode("overwrite").text(f"{path}/head")
    priority_lines(judged).orderBy("ref_id").select("line").write.mode("overwrite").text(f"{path}/priority")
    item_blocks(judged).orderBy("ref_id").select("block").write.mode("overwrite").text(f"{path}/items")


def escaped(c: Column) -> Column:
    for sign, to in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(sign), F.lit(to))
    return c


def inline_html(c: Column) -> Column:
    """A markdown line as HTML: escaped first; code, bold and links with a safe scheme; any
    other link gives its text."""
    c = F.regexp_replace(escaped(c), r"`([^`]+)`", "<code>$1</code>")
    c = F.regexp_replace(c, r"\*\*([^*]+)\*\*", "<strong>$1</strong>")
    c = F.regexp_replace(c, rf"\[([^\]]*)\]\(((?i:{'|'.join(SAFE_SCHEMES)}):[^)\s]*|[#./][^)\s]*)\)", '<a href="$2">$1</a>')
    return F.regexp_replace(c, r"\[([^\]]*)\]\([^)]*\)", "$1")


def html_report(judged: DataFrame) -> DataFrame:
    """(ref_id, html): each reference's block as HTML, for states that occur."""
    return item_blocks(judged).select("ref_id", html_of("block").alias("html"))


_STEPS = (("识别：记录总数", "identified", "去重删除", "duplicates_removed"), ("标题摘要筛选", "after_dedup", "标题摘要阶段排除", "ta_excluded"), ("寻求全文", "sought", "全文不可得", "not_retrieved"), ("全文评估合格性", "ft_assessed", "全文阶段排除", "ft_excluded"), ("纳入综述", "included", None, None))


def _reasons(reasons: DataFrame) -> DataFrame:
    """One row: how often each reason was given, in their order; quotes become full-width."""
    part = lambda x: F.concat(F.replace(x["exclude_code"], F.lit('"'), F.lit("＂")), F.lit(" × "), x["n"].cast("string"))
    return reasons.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("exclude_code", "n"))), part), "；").alias("_r"), F.lit(1).alias("_k"))


def flow_pictures(counts: DataFrame, reasons: DataFrame) -> DataFrame:
    """One row: the flow of a screening as Mermaid text and as a picture of its own (SVG)."""
    c = counts.withColumn("_k", F.lit(1)).join(_reasons(reasons), "_k")
    why = F.when(F.col("_r") == "", "未填理由码").otherwise(F.col("_r"))
    n = lambda f: F.concat(F.lit("n = "), F.col(f).cast("string"))
    rows, boxes = [F.lit("flowchart TB")], []
    for k, (name, field, side, gone) in enumerate(_STEPS):
        rows.append(F.concat(F.lit(f'    S{k}["{name}<br/>'), n(field), F.lit('"]')))
        boxes.append(_box(40, 320, k, [F.lit(name), n(field)]))
        if k + 1 < len(_STEPS):
            rows.append(F.lit(f"    S{k} --> S{k + 1}"))
            boxes.append(F.lit(f'<line x1="200" y1="{100 + 116 * k}" x2="200" y2="{138 + 116 * k}" stroke="#8a827a"/>'))
        if side:
            told = [F.lit(side), n(gone), *([why] if gone == "ft_excluded" else [])]
            rows.append(F.concat(F.lit(f'    S{k} --> G{k}["'), F.concat_ws("<br/>", *told), F.lit('"]')))
            boxes += [_box(450, 290, k, told), F.lit(f'<line x1="360" y1="{62 + 116 * k}" x2="448" y2="{62 + 116 * k}" stroke="#8a827a"/>')]
    svg = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 780 600" role="img">'), *boxes, F.lit("</svg>"))
    return c.select(F.concat_ws("\n", *rows).alias("mermaid"), svg.alias("svg"))


def _box(x: int, w: int, k: int, lines: list[Column]) -> Column:
    top = 24 + 116 * k
    texts = [F.concat(F.lit(f'<text x="{x + w // 2}" y="{top + 43 - 9 * (len(lines) - 1) + 18 * i}" text-anchor="middle" font-size="13">'), escaped(t), F.lit("</text>")) for i, t in enumerate(lines)]
    return F.concat(F.lit(f'<rect x="{x}" y="{top}" width="{w}" height="76" rx="6" fill="#f7f5f2" stroke="#8a827a"/>'), *texts)
