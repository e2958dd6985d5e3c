import duckdb
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import citeloom.plans  # noqa: F401
from citeloom import registry
from citeloom.functions import identifiers as I
from citeloom.functions import text as X
from citeloom.operators import batch as B
from citeloom.operators import screening as S
from citeloom.operators import verify as V
from citeloom.operators import works as W
from citeloom.functions.jats import clean_abstract
from citeloom.functions.references import doi_of
from citeloom.sinks import reports as K
from citeloom.sources import exports as E
from citeloom.functions.markup import html_of, to_html
from citeloom.sources import http as H

SF = "/root/testdata/sf0.001"


def one(spark, make, *values, kind="string"):
    rows = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [r[0] for r in rows.select(make(F.col("v"))).collect()]


def test_identifiers(spark):
    assert one(spark, I.normalize_doi, " https://DOI.org/10.1/A ", "doi:10.2/b", "https://dx.doi.org/10.3/c", None, "") == ["10.1/a", "10.2/b", "https://dx.doi.org/10.3/c", None, ""]
    assert one(spark, I.normalize_orcid, "https://orcid.org/0000-0001-2345-678x", "no") == ["0000-0001-2345-678X", None]
    assert one(spark, I.canonical_type, " Journal-Article", "dataset") == ["journal-article", None]
    assert one(spark, doi_of, "see (doi 10.1000/ab(c)d).", "10.1000/x.", "none", "[a](10.1/b)", "[a](10.1234/b).", "(10.1234/b);") == ["10.1000/ab(c)d", "10.1000/x", None, None, "10.1234/b", "10.1234/b"]
    assert one(spark, I.date_parts_text, [2020, 3], [1999], kind="array<int>") == ["2020-03", "1999"]
    assert one(spark, I.valid_iso_date, "2024-02-29", "2023-02-29", "2024-2-1", None) == [True, False, False, False]


def test_titles_and_names(spark):
    assert one(spark, X.norm_title, "AI-based  Search!") == ["aibased search"]
    assert [sorted(x) for x in one(spark, X.title_tokens, "The AI-based search of search")] == [["ai", "based", "search"]]
    assert one(spark, X.surname_candidates, "Smith, J. A.", "J. A. Smith", "A. B.") == [["smith"], ["smith"], ["a", "b"]]
    assert one(spark, X.restore_abstract, {"b": [1], "a": [0, 3], "x": [-1]}, {}, kind="map<string,array<int>>") == ["a b a", None]


def test_fusion_keeps_unknown_apart_from_zero(spark):
    cols = "ord string, source string, doi string, title string, year int, venue string, type string, cited_by_count long, abstract string, oa_status string, oa_url string, oa_version string"
    rows = [
        ("1", "arxiv", "10.1/A", "T", None, None, "preprint", None, " ", None, None, None),
        ("2", "crossref", "doi:10.1/a", "T!", 2020, "V", "article", 0, "words", "gold", None, "publishedVersion"),
        ("3", "openalex", None, "T", 2021, None, None, 5, None, None, None, None),
        ("4", "openalex", None, None, None, None, None, None, None, None, None, None),
        ("5", "openalex", "", "", None, None, None, None, None, None, None, None),
    ]
    got = {r.key: r for r in W.fuse(spark.createDataFrame(rows, cols)).collect()}
    assert set(got) == {"doi:10.1/a", "title:t", "uniq:4", "uniq:5"}
    a = got["doi:10.1/a"]
    assert (a.primary_source, a.cited_by_count, a.abstract, a.oa_source, a.sources) == ("crossref", 0, "words", "crossref", "crossref,arxiv")
    assert got["uniq:4"].cited_by_count is None and got["uniq:4"].oa_status is None
    assert W.fuse(spark.createDataFrame([], cols)).count() == 0


def test_abstracts():
    cases = {
        "<jats:p>Abstract A &lt; B</jats:p>": "A < B", "<p>1</p>": None, "<jats:p>.</jats:p>": None, None: None, "  ": None,
        "<title>Abstract</title><sec><title>Aim</title><p>To <b>see</b>.</p></sec><sec><title>Abstract</title><p>It.</p></sec>": "Aim: To see. It.",
        "p < 0.05 with unclosed <jats:bold>": "p < 0.05 with unclosed", "plain &amp;amp; simple": "plain & simple", "a &mdash; b <sup>2</sup>": "a — b 2",
        "&lt;p&gt;twice&lt;/p&gt;": "twice", "loose <p>one</p> between <p>two</p> end": "loose one between two end", "摘要：内容": "摘要：内容", "摘要： 内容": "内容",
        "<sec><title>T</title> tail <p>body</p></sec>": "T: body", "<sec><p>a</p><sec><title>In</title><p>b</p></sec></sec>": "aInb",
    }
    assert {k: clean_abstract(k) for k in cases} == cases
    assert clean_abstract("<p>" + "word " * 200_000 + "</p>").count("word") == 200_000


def test_live_answers_are_tried_again_and_misses_are_no_errors(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            code = 404 if "gone" in self.path else 429 if self.path == "/busy" and asked.count("/busy") < 3 else 500 if "down" in self.path else 200
            self.send_response(code)
            if code == 429:
                self.send_header("Retry-After", "0")
            self.end_headers()
            self.wfile.write("漢 ok".encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    rows = [("crossref", k, f"{base}/{k}") for k in ("fine", "gone", "busy", "down")] + [("crossref", "fine", f"{base}/fine")] + [("openalex", "away", "http://127.0.0.1:9/x")]
    requests = spark.createDataFrame(rows, "source string, key string, url string")
    cache = spark.createDataFrame([], "source string, key string, payload string")
    got = {r.key: (r.payload, r.error) for r in H.fetch(H.missing(requests, cache), sleep=_no_wait).collect()}
    assert got == {"fine": ("漢 ok", None), "gone": (None, None), "busy": ("漢 ok", None), "down": (None, "SERVER_ERROR"), "away": (None, "CONN_FAILED")}
    assert asked.count("/fine") == 1 and asked.count("/gone") == 1 and asked.count("/busy") == 3 and asked.count("/down") == 5
    held = spark.createDataFrame([("crossref", "fine", "x")], "source string, key string, payload string")
    assert {r.key for r in H.missing(requests, held).collect()} == {"gone", "busy", "down", "away"}
    server.shutdown()


def _no_wait(_):
    pass


def test_files_of_two_encodings(spark, tmp_path):
    (tmp_path / "a.md").write_bytes("\ufeff你好\n".encode())
    (tmp_path / "b.md").write_bytes("你好".encode("gbk"))
    (tmp_path / "c.md").write_bytes(b"\xff\xff\xff")
    got = {r.doc_id: r.text for r in E.manuscripts(spark, str(tmp_path)).collect()}
    assert got == {"a.md": "你好\n", "b.md": "你好", "c.md": None}


def test_batches(spark, tmp_path):
    refs = spark.createDataFrame([(1, "10.1/a", "t"), (2, None, "u"), (3, None, None)], "ref_id int, doi string, title string")
    B.save_state(refs, refs.filter("ref_id = 1"), str(tmp_path / "s"))
    B.save_state(refs.orderBy(F.desc("ref_id")), refs.filter("ref_id = 2"), str(tmp_path / "s"))
    assert [r.ref_id for r in B.left_over(refs, B.load_state(refs, str(tmp_path / "s"))).collect()] == [3]
    with pytest.raises(ValueError):
        B.load_state(refs.filter("ref_id < 3"), str(tmp_path / "s"))
    known = B.known_sources(spark)
    assert B.registry_faults(known).count() == 0 and {r.source for r in B.clients(known, ["arxiv", "cnki"]).collect()} == {"arxiv"}
    assert {r.id for r in B.searched_by_default(known).collect()} == {"crossref", "openalex", "semantic_scholar", "arxiv"}
    (tmp_path / "r.json").write_text('{"id": "x", "kind": "api", "role": "core", "capabilities": ["fly"]}')
    assert {r.fault for r in B.registry_faults(B.load_registry(spark, str(tmp_path / "r.json"))).collect()} == {"no base_url", "capability fly"}
    assert one(spark, lambda c: B.trimmed(c, "a int"), '{"a": 1, "b": [2]}') == ['{"a":1}']


def test_reports(spark, tmp_path):
    rows = [(1, "VERIFIED", "a", "", "crossref"), (2, "NOT_FOUND", None, "", ""), (3, "PENDING_MANUAL", "c", "", ""), (4, "METADATA_MISMATCH", "d", "year,title", "x")]
    j = spark.createDataFrame(rows, "ref_id int, status string, raw_text string, mismatches string, told_by string")
    head = K.report_head(j, "offline", K.sources_checked()).first().head
    assert head.index("offline") < head.index("六态分布") and "| ✅ 已核实 | 1 | 25% |" in head and "UNVERIFIED" not in head and "crossref、openalex" in head
    assert [r.ref_id for r in K.priority_lines(j).orderBy("ref_id").collect()] == [2, 4]
    blocks = {r.ref_id: r.block for r in K.item_blocks(j).collect()}
    assert "- 不符字段：year、title" in blocks[4] and "manual_result" in blocks[3] and "\n> " not in blocks[2]
    K.write_report(j, str(tmp_path / "r"), "degraded")
    assert "### 1" in "".join(r.value for r in spark.read.text(str(tmp_path / "r" / "items")).collect())
    K.write_json(j, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 4
    assert one(spark, K.inline_html, "<b> **x** `c` [a](https://u) [z](javascript:y)") == ["&lt;b&gt; <strong>x</strong> <code>c</code> <a href=\"https://u\">a</a> z"]
    whole = "<h1>T</h1><ul><li>i</li></ul><blockquote><p>q</p></blockquote><table><thead><tr><th>a</th><th>b</th></tr></thead><tbody></tbody></table><p>text</p>"
    assert one(spark, html_of, "# T\n- i\n> q\n| a | b |\n|---|---|\ntext", None) == [whole, ""]
    assert K.html_report(j).count() == 4


@pytest.mark.parametrize(
    ("markdown", "html"),
    [
        ("- a\n  1. b\n  2) c\n    - d\n- e\n\nf", "<ul><li>a<ol><li>b</li><li>c<ul><li>d</li></ul></li></ol></li><li>e</li></ul><p>f</p>"),
        ("- a\n1. b", "<ul><li>a</li></ul><ol><li>b</li></ol>"),
        ("  - a\n- b", "<ul><li>a</li></ul><ul><li>b</li></ul>"),
        ("```py\n<b>\n- x\n```\n~~~\nopen", "<pre><code>&lt;b&gt;\n- x\n</code></pre><pre><code>open\n</code></pre>"),
        ("> a\n> > b\n> - c\nd", "<blockquote><p>a</p><blockquote><p>b</p></blockquote><ul><li>c</li></ul></blockquote><p>d</p>"),
        ("| a | b |\n|:-|-:|\n| `x` | **y** |\n- i", "<table><thead><tr><th>a</th><th>b</th></tr></thead><tbody><tr><td><code>x</code></td><td><strong>y</strong></td></tr></tbody></table><ul><li>i</li></ul>"),
        ("⚠️ mind\nmissing 不等于 none\n*made by*\n---\n**b**", '<div class="notice">⚠️ mind</div><div class="notice">missing 不等于 none</div><footer>made by</footer><p><strong>b</strong></p>'),
        ("[a](https://u?x=1&y) [z](javascript:y) it's", '<p><a href="https://u?x=1&amp;y">a</a> z it\'s</p>'),
        ("", ""),
    ],
)
def test_markdown_as_html(markdown, html):
    assert to_html(markdown) == html


def test_deep_quotes_and_long_texts_end():
    assert to_html(">" * 5000 + " x").count("<p>") == 1
    assert to_html("- a\n" * 50_000).count("<li>") == 50_000


def test_conservation_names_a_misspelt_value(spark):
    rows = [(1, "保留", "进入全文", "纳入", ""), (2, "保 留", "", "", ""), (3, "重复#1", "", "", "")]
    led = spark.createDataFrame(rows, "seq int, dedup string, ta_screen string, ft_screen string, exclude_code string")
    assert {r.law: r.difference for r in S.conservation(S.stage_counts(led)).collect()} == {"dedup": 1, "screen": 0, "full_text": 0}
    assert S.gate(led).first().exit_code == 1


def test_exports(spark):
    bib = "@article{a, title={A {B} C}, author={X, Y and Z, W}, year=2020, doi={10.1/Q}}\n@book{b, year=1999}\n@misc{c, title={open"
    ris = "TY  - JOUR\nTI  - First\n  line\nAU  - A\nAU  - B\nPY  - 2019\nSP  - 1\nEP  - 9\nER  - \nTY  - BOOK\nPY  - 2000\n"
    f = spark.createDataFrame([("f", bib)], "file string, text string")
    assert [r.problem for r in E.parse_bibtex(f).orderBy("seq").collect()] == [None, None, "unclosed"]
    b, without = E.to_export(E.parse_bibtex(f)).orderBy("seq").collect()
    assert (without.title, without.year, without.type) == (None, 1999, "book")
    assert (b.title, b.authors, b.year, b.doi, b.type) == ("A B C", ["X, Y", "Z, W"], 2020, "10.1/q", "journal-article")
    r = E.to_export(E.parse_ris(spark.createDataFrame([("f", ris)], "file string, text string"))).collect()
    assert [(x.title, x.authors, x.pages) for x in r] == [("First line", ["A", "B"], "1-9")]
    led = E.parse_ledger(spark.createDataFrame([("f", "|1|a|b|保留|x|y|z|n|\n|2|a|\n|head|\n3|a|b")], "file string, text string")).orderBy("line").collect()
    assert [(x.seq, x.malformed) for x in led] == [(1, False), (2, True)]


def test_bibtex_entries_come_back_many_at_once(spark):
    entry = "@article{a, title={A {B} C}, year=2020}\n"
    for files in ([(str(k), entry) for k in range(2 * E.ENTRIES + 1)], [("one", entry * (2 * E.ENTRIES + 1))], [("x", None), ("y", entry * E.ENTRIES)], []):
        got = list(E.entry_batches(iter([pa.RecordBatch.from_pylist([{"file": f, "text": t} for f, t in files[k : k + 1000]], pa.schema([("file", pa.string()), ("text", pa.string())])) for k in range(0, len(files), 1000)])))
        assert [b.num_rows for b in got] == ([E.ENTRIES, E.ENTRIES, 1] if len(files) > 2 or len(files) == 1 else [E.ENTRIES] if files else [])
    # and a small table of many files is read by all tasks
    assert registry.QUERIES["import_bibtex"](spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if v is None or v is pd.NA or v is pd.NaT or v != v:
        return "~"
    return f"{v:.6g}" if isinstance(v, float) else str(v)


def rows_of(d):
    return sorted(tuple(plain(float(v) if isinstance(v, int) and not isinstance(v, bool) else v) for v in r) for r in d[sorted(d.columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in "part lineitem orders customer supplier events documents pages nation".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    a, b = registry.QUERIES[name](spark, SF).toPandas(), con.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns) and rows_of(a) == rows_of(b)
