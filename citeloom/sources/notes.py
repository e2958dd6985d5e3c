"""Small markdown sources: audit trails, release notes, report heads, project folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions import identifiers as I
from citeloom.functions import text as X
from citeloom.model import dims

_HEAD = r"##\s+(\d{4}-\d{2}-\d{2})[^\n]*?·[ \t]*(paper-[\w-]+)([^\n]*)"

def trace_entries(texts: DataFrame, text: str = "text") -> DataFrame:
    """(…, place, day, command, description, product) of the entries of audit trails.

    An entry begins at a heading with a date and a command and reaches to the next;
    headings that name no command are none. Other columns are kept.
    """
    kept = [c for c in texts.columns if c != text]
    blocks = F.filter(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), rf"(?m)^(?={_HEAD}$)"), lambda b: b.rlike(rf"^{_HEAD}"))
    e = texts.select(*kept, F.posexplode(blocks).alias("place", "b"))
    part = lambda k: F.regexp_extract("b", rf"^{_HEAD}", k)
    product = I.blank_to_null(F.regexp_extract("b", r"(?m)^-\s*产物[：:]\s*(\S+)", 1))
    return e.select(*kept, "place", part(1).alias("day"), part(2).alias("command"), F.trim(part(3)).alias("description"), product.alias("product"))


def release_section(c: Column, version: str) -> Column:
    """The body of a version's section, without the rule at its end; null if there is none."""
    head = rf"(?m)^## \[\Q{version}\E\][^\n]*$"
    body = F.regexp_extract(c, rf"(?s){head}(.*?)(?=^## \[|\z)", 1)
    trimmed = F.regexp_replace(body, r"^\s+|[\s-]+$", "")
    return F.when(c.rlike(head), trimmed)


def release_blockers(section: Column, sentinel: str) -> Column:
    """What keeps a section from being published: a sentinel within a comment, any comment."""
    comments = F.regexp_extract_all(section, F.lit(r"(?s)(<!--.*?(?:-->|\z))"), 1)
    held = F.exists(comments, lambda x: F.contains(x, F.lit(sentinel)))
    return F.array_compact(F.array(F.when(held, "sentinel"), F.when(F.contains(section, F.lit("<!--")), "comment")))


def report_head(c: Column) -> Column:
    """{title, meta [{key, value}]} of a report: its first heading and the table of two columns
    that may follow it."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n?", "\n")
    title = F.trim(F.regexp_extract(t, r"\A\s*# ([^\n]*)", 1))
    below = F.regexp_replace(t, r"\A\s*# [^\n]*\n?", "")
    lines = F.split(F.regexp_replace(below, r"\A\s*", ""), "\n")
    leave = lambda ls: F.array_position(F.transform(ls, lambda r: ~r.rlike(r"\A[ \t]*\|.*\|[ \t]*\z")), F.lit(True))  # noqa: E731  the first line that is none of the table
    rows = X.bound(lines, lambda ls: X.bound(leave(ls), lambda k: F.slice(ls, F.lit(1), F.when(k > 0, k - 1).otherwise(F.size(ls)).cast("int"))))
    cells = F.transform(rows, lambda r: F.transform(F.split(F.regexp_replace(F.trim(r), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x)))
    body = F.filter(cells, lambda x: ~F.array_join(x, "").rlike(r"^[-: ]+$"))
    meta = F.transform(F.slice(body, F.lit(2), F.size(body)), lambda x: F.struct(F.get(x, 0).alias("key"), F.get(x, 1).alias("value")))
    none = F.array().cast("array<struct<key:string,value:string>>")
    return F.struct(title.alias("title"), F.when(F.forall(body, lambda x: F.size(x) == 2) & (F.size(body) > 1), meta).otherwise(none).alias("meta"))


def skeleton_faults(listing: DataFrame) -> DataFrame:
    """(project, fault) of fresh project folders by their listing (project, path, is_dir, text).

    A fresh project has its folders and nothing in them, no audit trail, an ignore file that
    leaves out what must be kept, a named maker, and no placeholder left.
    """
    f = listing.filter(~F.col("path").rlike(r"(^|/)\.git(/|$)"))
    of = lambda name: F.max(F.when((F.col("path") == name) & ~F.col("is_dir"), F.coalesce("text", F.lit(""))))
    extra = ~F.col("is_dir") & ~F.col("path").isin(*dims.PROJECT_FILES)
    g = f.groupBy("project").agg(
        F.collect_set(F.when(F.col("is_dir") & ~F.contains("path", F.lit("/")), F.col("path"))).alias("dirs"),
        F.bool_or(F.col("path").rlike(r"^\.paper(/|$)")).alias("trail"), F.array_sort(F.collect_set(F.when(extra, F.col("path")))).alias("extra"),
        of(".gitignore").alias("ignore"), of("project.paper.yaml").alias("yaml"), of("README.md").alias("readme"),
    )
    ignored = F.transform(F.split(F.coalesce("ignore", F.lit("")), r"\r?\n"), lambda l: F.regexp_replace(F.trim(l), "/+$", ""))  # noqa: E741
    unnamed = F.filter(F.array(*map(F.lit, dims.PROJECT_FIELDS)), lambda k: ~F.rlike(F.col("yaml"), F.concat(F.lit(r"(?m)^\s*"), k, F.lit(r"\s*:"))))
    faults = F.concat(
        F.coalesce(F.transform(unnamed, lambda k: F.concat(F.lit("no field "), k)), F.array().cast("array<string>")),
        F.transform(F.array_except(F.array(*map(F.lit, dims.PROJECT_FOLDERS)), "dirs"), lambda d: F.concat(F.lit("no folder "), d)),
        F.transform("extra", lambda p: F.concat(F.lit("file "), p)),
        F.transform(F.filter(ignored, lambda l: l.isin(*dims.NEVER_IGNORED)), lambda l: F.concat(F.lit("ignores "), l)),  # noqa: E741
        F.array_compact(F.array(
            F.when(F.col("trail"), "trail made"), F.when(F.col("ignore").isNull(), "no .gitignore"),
            F.when(F.col("ignore").isNotNull() & ~F.contains("ignore", F.lit("literature/pdfs/")), "pdfs not ignored"),
            F.when(F.col("yaml").isNull(), "no project.paper.yaml"), F.when(~F.col("yaml").rlike(r'created_by:\s*"?paper-init"?'), "no maker"),
            F.when(F.col("yaml").rlike("[<>]"), "placeholder in project.paper.yaml"), F.when(F.col("readme").isNull(), "no README.md"), F.when(F.col("readme").rlike("[<>]"), "placeholder in README.md"),
        )),
    )
    return g.select("project", F.explode(faults).alias("fault"))


def tex_check(source: Column, made: Column, with_bibliography: Column) -> Column:
    """{ok, mode, at}: whether a typeset text still has its source's CJK signs, all of them in
    order, or as a part where a bibliography was added; `at` is the first that differs, from 1."""
    a, b = X.cjk_sequence(F.regexp_replace(F.coalesce(source, F.lit("")), r"(?s)<!--.*?-->", "")), X.cjk_sequence(F.coalesce(made, F.lit("")))
    mode = F.when(a == "", "skipped").when(with_bibliography, "substring").otherwise("exact")
    ok = F.when(mode == "skipped", True).when(mode == "substring", F.contains(b, a)).otherwise(a == b)
    least = F.least(F.length(a), F.length(b))
    # the longest equal beginning, found by halving
    step = lambda s, _: F.when(s["hi"] - s["lo"] <= 1, s).otherwise(F.when(F.substring(a, F.lit(1), ((s["lo"] + s["hi"]) / 2).cast("int")) == F.substring(b, F.lit(1), ((s["lo"] + s["hi"]) / 2).cast("int")), F.struct(((s["lo"] + s["hi"]) / 2).cast("int").alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), ((s["lo"] + s["hi"]) / 2).cast("int").alias("hi"))))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(32)), F.struct(F.lit(0).alias("lo"), (least + 1).alias("hi")), step)
    return F.struct(ok.alias("ok"), mode.alias("mode"), F.when(~ok & (mode == "exact"), found["lo"] + 1).alias("at"))
