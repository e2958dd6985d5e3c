"""Manuscript text against its rules, case by case."""

import random

import pytest
from pyspark.sql import functions as F

import citeloom.plans  # noqa: F401
from citeloom import registry
from citeloom.functions import markdown as M
from citeloom.functions import spans
from citeloom.operators import manuscripts as O


@pytest.fixture(scope="module")
def on(spark):
    def run(column, *texts):
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
        found = [r.v for r in rows.select("i", column(F.col("t")).alias("v")).orderBy("i").collect()]
        return found[0] if len(texts) == 1 else found

    return run


def test_strip_markdown(on):
    text = "---\ntitle: x\n---\n# Head\n\nSome **bold** and `code` with [a link](u) ![p](q) and a note[^1].\n<!-- hidden\nstill hidden -->\nkept <b>tag</b> 👤 end\n```py\nnot me\n```\n| a | b |\n[^1]: a source. 2020.\n> quoted\n>\n---\n===\n- item one\n2) item two_\n~~~\nalso not\n"
    want = "Some bold and with a link and a note.\nkept tag end\n{}item one\nitem two"
    assert on(M.strip_markdown, text) == want.format("")
    assert on(lambda c: M.strip_markdown(c, keep_quotes=True), text) == want.format("quoted\n")
    assert on(M.strip_markdown, "---\nnever closed\nno prose") == ""
    assert on(M.strip_markdown, "a\n<!-- one line -->\nb\n<!-- never closed\nc") == "a\nb"
    assert on(M.strip_markdown, None, "", "x\r\ny") == ["", "", "x\ny"]


def test_paragraphs_and_quotes(on):
    text = "---\na: b\n---\none\ntwo\n\n \n```\nin\n\nside\n```\nafter\n\n\n> q\n\nlast\n"
    assert on(M.paragraphs, text) == ["one\ntwo", "```\nin\n\nside\n```\nafter", "> q", "last"]
    assert on(M.quote_lines, "> a\n```\n> b\n```\n  > c\n~~~\n> d") == 2
    assert on(M.paragraphs, "\n\n") == []


def test_sections(on):
    pick = lambda s: [(x["name"], x["body"]) for x in s]
    one = pick(on(M.sections, "# Title\nlead words\n## A\na\n```\n## no\n```\n## B\nb\n### deep\nc"))
    assert [n for n, _ in one] == ["（篇首）", "A", "B"] and one[1][1] == "## A\na\n```\n## no\n```" and one[2][1].endswith("### deep\nc")
    assert pick(on(M.sections, "no heads\nat all")) == [("全文", "no heads\nat all")]
    assert [n for n, _ in pick(on(M.sections, "# Only\ntext"))] == ["Only"]
    assert [n for n, _ in pick(on(M.sections, "---\nx: y\n---\n\n# A\n1\n# B\n2"))] == ["A", "B"]


def test_sentences():
    assert M.sentences_of("他说：「这是对的。」然后走了。真的？！") == ["他说：「这是对的。」然后走了。", "真的？！"]
    assert M.sentences_of("Pi is 3.14 here. See Smith et al. 2020 for more... Done") == ["Pi is 3.14 here.", "See Smith et al. 2020 for more...", "Done"]
    assert M.sentences_of('He said "no. never." and left; so it is') == ['He said "no. never." and left;', "so it is"]
    assert M.sentences_of("（甲。乙）丙。」丁") == ["（甲。乙）丙。」", "丁"]
    assert M.sentences_of("等等……然后") == ["等等……", "然后"] and M.sentences_of("") == []
    long = "One sentence here. " * 20_000
    assert len(M.sentences_of(long)) == 20_000


def test_citations(on):
    assert M.cited_at("[1] starts here and goes on for a while") == (1, 0, 0)
    assert M.cited_at("This claim has its source at the end (Smith, 2020).") == (0, 0, 1)
    assert M.cited_at("Long words before it, then [2,3] stands inside this sentence.") == (0, 1, 0)
    text = "a (Smith, 2020) b（张三，2019）c [1] [2, 3] [4-6] (no year) [x]"
    assert on(lambda c: F.array(*M.citation_counts(c)), text) == [2, 3]
    assert on(M.anchor_links, "[S](literature/n.md#s) [T](../literature/x) [U](./../literature/y) [V](manuscript/z)") == 3


def test_gap_marks(on):
    assert on(M.gap_lines, "⚠️ alone\n未经文献支撑 alone\n - ⚠ 某点 · 纯结构占位（无文献支撑） ") == ["- ⚠ 某点 · 纯结构占位（无文献支撑）"]
    assert on(M.without_gap_words, "x ⚠️ 未经文献支撑（锚点 Lee 2024 未在 literature/）y") == "x ⚠️ y"
    assert len(on(M.gap_lines, "⚠ 未经文献支撑" + "长" * 300)[0]) == 121


def test_words_and_terms(spark, on):
    count = spans.counter({"a": (("本文", "值得注意的是", "是"), ("本文献",)), "b": (("本文献",), ())})
    words = on(lambda c: count(c), "值得注意的是，本文献与本文都是好的")
    assert [(w.word, w.n) for w in words.a] == [("值得注意的是", 1), ("本文", 1), ("是", 1)] and [(w.word, w.n) for w in words.b] == [("本文献", 1)]
    text = "卷积神经网络很好。卷积神经网络很强。卷积神经网络的用处。研究研究研究。神经，神经。"
    texts = spark.createDataFrame([(1, text), (2, "AB BCD ABC")], "doc_id int, text string")
    rows = O.listed_terms(O.likely_terms(texts, ["doc_id"]), ["doc_id"]).orderBy("place").collect()
    assert [(r.term, r.n) for r in rows] == [("卷积神经网络", 3), ("神经", 5)]
    glossary = spark.createDataFrame([(2, "AB"), (2, "BCD"), (2, "ABC"), (2, ""), (3, "x")], "doc_id int, term string")
    exact = O.listed_terms(O.glossary_terms(texts, glossary, ["doc_id"]), ["doc_id"]).collect()
    assert [(r.doc_id, r.term, r.n) for r in exact] == [(2, "ABC", 1), (2, "BCD", 1), (2, "AB", 1)]


def chained(text, words, mask):
    """The longest word first, each place blanked before the next word is counted."""
    for m in sorted(mask, key=len, reverse=True):
        text = text.replace(m, "\0" * len(m))
    out = {}
    for w in sorted(words, key=len, reverse=True):
        if n := text.count(w):
            out[w] = n
            text = text.replace(w, "\0" * len(w))
    return out


def test_one_pass_counts_as_a_chain_of_replacements_does():
    rnd = random.Random(2)
    for _ in range(400):
        words = tuple({"".join(rnd.choices("abc", k=rnd.randint(1, 5))) for _ in range(rnd.randint(1, 8))})
        mask = tuple({"".join(rnd.choices("abc", k=rnd.randint(2, 4))) for _ in range(rnd.randint(0, 2))} - set(words))
        text = "".join(rnd.choices("abc ", k=60))
        assert {x["word"]: x["n"] for x in spans.Lists({"w": (words, mask)}).count(text)["w"]} == chained(text, words, mask)


def test_anchor_scan(spark):
    text = "# Head\n\nA claim without support.\n\n\n> a quote\n\nA claim [S](literature/n.md) here (Lee, 2020).\n\n⚠️ 未经文献支撑（锚点 Lee 2024）还有话。\n\n| t |\n\n⚠️ bare warning sign."
    scan = O.anchor_scan(spark.createDataFrame([(1, text)], "doc_id int, text string"), with_sentence=True)
    rows = scan.orderBy("position").collect()
    assert [(r.position, r.support, r.quotes, r.unsupported, r.quote_only, r.next_is_quote) for r in rows] == [
        (1, 0, 0, True, False, True), (2, 0, 1, False, True, False), (3, 2, 0, False, False, False), (4, 0, 0, True, False, False), (5, 0, 0, True, False, False),
    ]
    assert rows[0].first_sentence == "A claim without support." and rows[3].gaps == ["⚠️ 未经文献支撑（锚点 Lee 2024）还有话。"]
    d = O.density(scan).first()
    assert (d.n_paragraphs, d.n_unsupported, d.n_quote_only, d.n_gaps, d.support, d.forms) == (5, 3, 1, 1, 2, "anchor,author_year,quote")
    assert O.gap_marks(scan).count() == 1


def test_style(spark):
    text = "# A\n我们认为，因此很好。第二句（Smith, 2020）。\n# B\n" + "短句。" * 6
    m = {r.section: r for r in O.measure_sections(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()}
    assert (m["A"].n_sentences, m["A"].function_words, m["A"].persons, m["A"].at_end) == (2, 1, 1, 1) and not m["A"].reliable
    assert (m["B"].n_sentences, m["B"].len_mean, m["B"].len_std) == (6, 2.0, 0.0) and m["B"].reliable
    c = O.compare_sections(O.measure_sections(spark.createDataFrame([(1, text)], "doc_id int, text string")), ["doc_id"], "section", "position").collect()
    assert {r.feature: (r.least_in, r.most_in) for r in c}["len_mean"] == ("B", "A") and len(c) == len(O.FEATURES)


def test_sections_are_measured_where_they_lie(spark):
    """No string of a text is shuffled, a document's sections meet once, and a small table of long texts is dealt over all tasks."""
    plan = registry.QUERIES["feature_order"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Exchange RoundRobinPartitioning") == 1
    texts = spark.createDataFrame([(1, "研究深度研究深度研究深度"), (2, None), (3, "深度。深度，深度")], "doc_id int, text string")
    assert {r.doc_id: [(t.term, t.n) for t in r.terms] for r in O.likely_terms(texts, ["doc_id"]).collect()} == {i: [(t["term"], t["n"]) for t in O.terms_of(x)] for i, x in [(1, "研究深度研究深度研究深度"), (2, ""), (3, "深度。深度，深度")]}
    assert [(t["term"], t["n"]) for t in O.terms_of("深度。深度，深度")] == [("深度", 3)]
