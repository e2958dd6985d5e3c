"""Live sources against a server of this machine: pushed conditions, pages, placement."""

import json
import threading
from contextlib import contextmanager
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from citeloom.model import dims
from citeloom.sources import http as H
from citeloom.sources import live

ATOM = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>x</id><title> A </title><published>{}-01-01T00:00:00Z</published></entry></feed>'


@contextmanager
def serving(answer):
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            text = answer(urlparse(self.path))
            self.send_response(404 if text is None else 200)
            self.end_headers()
            self.wfile.write((text or "").encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        yield f"http://127.0.0.1:{server.server_port}", asked
    finally:
        server.shutdown()


def answer(url):
    q = parse_qs(url.query)
    if url.path == "/crossref/works":
        start, rows = int(q["offset"][0]), int(q["rows"][0])
        years = range(2000 + start, 2000 + min(start + rows, 5))
        return json.dumps({"message": {"items": [{"title": [f"C{y}"], "DOI": f"10.1/C{y}", "issued": {"date-parts": [[y]]}, "type": "journal-article"} for y in years]}})
    if url.path == "/openalex/works":
        return json.dumps({"results": [{"display_name": "O1", "doi": "https://doi.org/10.1/O1", "publication_year": 2003, "type": "article"}, {"display_name": "O2", "publication_year": None, "type": "dataset"}]})
    if url.path == "/arxiv/query":
        return ATOM.format(2002)
    if url.path == "/pubmed/esearch.fcgi":
        return json.dumps({"esearchresult": {"idlist": ["7", "8"]}})
    if url.path == "/pubmed/esummary.fcgi":
        return json.dumps({"result": {"uids": ["7", "8"], "7": {"title": "P7", "pubdate": "2001 Jul", "pubtype": ["Journal Article"], "articleids": [{"idtype": "doi", "value": "10.1/P7"}]}, "8": {"title": "P8", "pubdate": "Spring"}}})
    return None


def search(spark, base, sources, **options):
    live.register(spark)
    read = spark.read.format("citeloom").option("query", "deep learning").option("sources", ",".join(sources)).option("patience", "0.001")
    for s in sources:
        read = read.option(f"base.{s}", f"{base}/{s}")
    return read.options(**options).load()


def test_conditions_are_pushed(spark, capsys):
    with serving(answer) as (base, asked):
        df = search(spark, base, ["crossref", "openalex", "arxiv", "pubmed"]).filter("year >= 2001 AND year < 2004 AND type = 'journal-article' AND title LIKE 'C%1'")
        assert {(r.source, r.title, r.year, r.doi) for r in df.collect()} == {("crossref", "C2001", 2001, "10.1/c2001")}
        first = next(p for p in asked if p.startswith("/crossref"))
        assert "from-pub-date:2001-01-01,until-pub-date:2003-12-31,type:journal-article" in first
        df.explain("formatted")
        plan = capsys.readouterr().out
        rest = next(x for x in plan.splitlines() if x.startswith("Condition"))
        assert "title" in rest and "2001" not in rest and "journal-article" not in rest
        assert "GreaterThanOrEqual(year,2001)" in plan and "EqualTo(type,journal-article)" in plan


def test_sources_and_pages_that_are_not_wanted_are_not_asked(spark):
    with serving(answer) as (base, asked):
        df = search(spark, base, ["crossref", "openalex", "arxiv", "pubmed"], rows="2", pages="6", pagesPerTask="3")
        rows = df.filter("source IN ('crossref', 'pubmed')").collect()
        assert sorted(r.title for r in rows if r.source == "crossref") == [f"C{y}" for y in range(2000, 2005)]
        assert {(r.title, r.year, r.doi) for r in rows if r.source == "pubmed" and r.page == 0} == {("P7", 2001, "10.1/p7"), ("P8", None, None)}
        assert not any(p.startswith(("/openalex", "/arxiv")) for p in asked)
        # the third page is short, so the fourth to sixth are asked by their own task only, which ends at once
        assert sorted(int(parse_qs(urlparse(p).query)["offset"][0]) for p in asked if p.startswith("/crossref")) == [0, 2, 4, 6]
        assert search(spark, base, ["arxiv"]).filter("year = 2002").first().title == "A"
        assert search(spark, base, ["eric"]).count() == 0
        search(spark, base, ["pubmed"], **{"key.pubmed": "k1"}).collect()
        assert asked[-1].endswith("&retmode=json&api_key=k1")


def test_a_search_needs_a_query_and_sources_that_can(spark):
    live.register(spark)
    with pytest.raises(Exception, match="needs a query"):
        spark.read.format("citeloom").load().collect()
    with pytest.raises(Exception, match="cannot search"):
        search(spark, "http://x", ["cnki"]).collect()


def test_every_source_has_a_task_of_its_own(spark):
    sources = [s for s, kind, *_ in dims.SOURCES if kind == "api"][:7]
    rows = spark.createDataFrame([(s, f"{s}{k}", "u") for s in sources for k in range(5)], "source string, key string, url string")
    dealt = rows.repartitionById(len(dims.SOURCES) + H.OTHERS, H.task_of(F.col("source"))).withColumn("task", F.spark_partition_id())
    tasks = {r.source: {x.task for x in dealt.collect() if x.source == r.source} for r in rows.select("source").distinct().collect()}
    assert len(tasks) == 7 and all(len(t) == 1 for t in tasks.values()) and len(set.union(*tasks.values())) == 7
    assert 0 <= spark.range(1).select(H.task_of(F.lit("of no registry"))).first()[0] - len(dims.SOURCES) < H.OTHERS


def test_keys_come_from_the_environment_and_go_where_they_are_read(spark):
    env = {"NCBI_API_KEY": "k 1", "SEMANTIC_SCHOLAR_API_KEY": " s2 ", "CITELOOM_MAILTO": "a@b.org"}
    held = H.credentials(env)
    assert held == {"pubmed": "k 1", "semantic_scholar": "s2"} and H.credentials({"NCBI_API_KEY": " "}) == {}
    assert H.agent_name(environ=env) == "citeloom/1 (mailto:a@b.org)" and H.agent_name(environ={}) == "citeloom/1"
    assert H.signed("pubmed", "http://x/e?db=p", "k 1") == ("http://x/e?db=p&api_key=k%201", {}) and H.signed("crossref", "u", None) == ("u", {})

    def opener(url, agent, accept, headers=None):
        return f"{url}|{(headers or {}).get('x-api-key')}"

    rows = spark.createDataFrame([(s, s, f"http://{s}?q=1") for s in ("pubmed", "semantic_scholar", "crossref")], "source string, key string, url string")
    got = {r.key: r.payload for r in H.fetch(rows, credentials=held, opener=opener, sleep=_no_wait).collect()}
    assert got == {"pubmed": "http://pubmed?q=1&api_key=k%201|None", "semantic_scholar": "http://semantic_scholar?q=1|s2", "crossref": "http://crossref?q=1|None"}


def _no_wait(_):
    pass
