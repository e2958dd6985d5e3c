"""Looking up and verifying a list of references: routes, requests, cached and live answers, evidence, verdicts.

`ask` takes requests (source, key, url) and gives answers (source, key, payload, error):
`sources.http.fetch` on the net, a table in tests. Without it only the cache answers. What
is asked is asked once, whatever the number of references that want it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions import identifiers as I
from citeloom.functions import requests as R
from citeloom.model import dims
from citeloom.operators import providers as P
from citeloom.operators import screening as S
from citeloom.operators import verify as V
from citeloom.session import settled

Ask = Callable[[DataFrame], DataFrame]
#: Ids that one request fetches.
BATCH = 50
#: Where each source's list of works lies in an answer to a title.
LISTS = {"crossref": "message.items", "openalex": "results", "semantic_scholar": "data", "eric": "response.docs"}
READ = {"crossref": P.crossref, "openalex": P.openalex, "semantic_scholar": P.semantic_scholar, "eric": P.eric, "doi_meta": P.doi_meta, "arxiv": P.arxiv}


def task_requests(tasks: DataFrame, bases: dict[str, str], limit: int = 5) -> DataFrame:
    """`tasks` (ref_id, doi, title, place, source) with what each asks: kind, key and url.

    A source that looks DOIs up is asked for the DOI if there is one, any other for the title;
    a task with neither, or whose source cannot answer it, asks nothing (null key).
    """
    lookers = [s for s, _, _, can, _ in dims.SOURCES if "lookup_doi" in can]
    source, base = F.col("source"), I.lookup(F.col("source"), bases)
    doi = F.when(source.isin(*lookers), I.blank_to_null(I.normalize_doi(F.col("doi"))))
    title = I.blank_to_null(F.trim("title"))
    t = tasks.withColumns({"_doi": doi, "_title": title})
    kind = F.when(F.col("_doi").isNotNull(), "doi").when(F.col("_title").isNotNull(), "title_match")
    key = F.when(F.col("_doi").isNotNull(), R.doi_key(source, F.col("_doi"))).otherwise(R.match_key(source, F.col("_title"), limit))
    url = F.when(F.col("_doi").isNotNull(), R.doi_url(source, base, F.col("_doi"))).otherwise(R.match_url(source, base, F.col("_title"), limit))
    return t.select("ref_id", "place", "source", kind.alias("kind"), key.alias("key"), url.alias("url"))


def answered(requests: DataFrame, cache: DataFrame, ask: Ask | None = None) -> DataFrame:
    """(source, key, payload, error, from_cache) for requests: what the cache holds, else what `ask` says.

    `cache` is what still holds of it (`screening.cache_latest`). Without an answer there is no row.
    """
    wanted = requests.filter("key IS NOT NULL").dropDuplicates(["source", "key"])
    held = wanted.join(cache.select("source", "key", "payload"), ["source", "key"])
    held = held.select("source", "key", "payload", F.lit(None).cast("string").alias("error"), F.lit(True).alias("from_cache"))
    if ask is None:
        return held
    asked = wanted.join(cache.select("source", "key"), ["source", "key"], "left_anti").select("source", "key", "url")
    told = ask(asked).select("source", "key", "payload", "error", F.lit(False).alias("from_cache"))
    return held.unionByName(told)


def _first_work(source: Column, kind: Column, payload: Column) -> Column:
    """The first work of an answer, as JSON; Atom is left as it is."""

    def first(path: str) -> Column:
        names = path.split(".")
        ddl = "array<string>"
        for n in reversed(names):
            ddl = f"struct<{n}:{ddl}>"
        listed = F.from_json(payload, ddl)
        for n in names:
            listed = listed[n]
        return F.get(listed, 0)

    by_doi = F.when(source == "crossref", F.get_json_object(payload, "$.message")).otherwise(payload)
    by_title = reduce(lambda c, s: c.when(source == s, first(LISTS[s])), LISTS, F.when(F.lit(False), payload)).otherwise(payload)
    return F.when(payload.isNotNull(), F.when(kind == "doi", by_doi).otherwise(by_title))


def hits(answers: DataFrame) -> DataFrame:
    """The first work of each answer (source, kind, key, payload) in the providers' one shape (`providers.HIT`)."""
    works = answers.withColumn("work", _first_work(F.col("source"), F.col("kind"), F.col("payload"))).filter("work IS NOT NULL")
    out = []
    for source, read in READ.items():
        found = read(works.filter(F.col("source") == source).select("source", "key", "work"), "work")
        found = found.filter("place = 0") if "place" in found.columns else found
        out.append(found.select("source", "key", *P.HIT))
    return reduce(DataFrame.unionByName, out)


class Evidence(NamedTuple):
    """References with their agency, what came of each call, and the hits."""

    refs: DataFrame
    queries: DataFrame
    hits: DataFrame


def fetch_batch(refs: DataFrame, agencies: DataFrame, cache: DataFrame, ask: Ask | None = None, bases: dict[str, str] | None = None) -> Evidence:
    """Evidence for references (ref_id, doi, title): each goes to the sources of its DOI's agency.

    A missing answer is a miss, a failed call an error, and those differ; an answer without a
    work is a miss.
    """
    known = V.with_agency(refs.drop("doi_ra"), agencies)
    asked = settled(task_requests(V.tasks(V.route(known)), bases or {s: f"https://{s}" for s in READ}))
    answers = settled(answered(asked, cache, ask))
    kinds = asked.select("source", "key", "kind").distinct()
    found = hits(answers.filter("payload IS NOT NULL").join(kinds, ["source", "key"]))
    found = settled(found)
    said = asked.join(answers.select("source", "key", "error", "from_cache"), ["source", "key"], "left")
    said = said.join(found.select("source", "key", F.lit(True).alias("found")), ["source", "key"], "left")
    outcome = F.when(F.col("error").isNotNull(), "error").when(F.col("found"), "hit").otherwise("miss")
    queries = said.select("ref_id", "place", "source", F.col("kind").alias("query_kind"), outcome.alias("outcome"), "error", F.coalesce("from_cache", F.lit(False)).alias("from_cache"))
    met = asked.select("ref_id", F.col("place").alias("ord"), "source", "key").join(found, ["source", "key"])
    dated = F.coalesce(F.size("retraction.date_parts") > 0, F.lit(False))
    return Evidence(known, queries, met.withColumns({"retracted": F.col("retraction").isNotNull(), "retraction_dated": dated}))


def lookup(spark, agencies: DataFrame, cache: DataFrame, ask: Ask | None = None, doi: str | None = None, title: str | None = None, authors: list[str] | None = None, year: int | None = None) -> Evidence:
    """Evidence for one reference, known by its DOI or title."""
    if not doi and not title:
        raise ValueError("a lookup needs a DOI or a title")
    one = spark.createDataFrame([("single", doi, title, authors, year)], "ref_id string, doi string, title string, authors array<string>, year int")
    return fetch_batch(one, agencies, cache, ask)


def verify_batch(refs: DataFrame, agencies: DataFrame, cache: DataFrame, ask: Ask | None = None) -> DataFrame:
    """The verdict on each reference, from the routes to the last rule, and what it took: calls,
    those that the cache served, errors."""
    e = fetch_batch(refs, agencies, cache, ask)
    counted = e.queries.groupBy("ref_id").agg(F.count(F.lit(1)).alias("calls"), F.count_if("from_cache").alias("cached"), F.count_if(F.col("outcome") == "error").alias("errors"))
    judged = V.judge(e.refs, e.hits, e.queries).join(counted, "ref_id", "left")
    return judged.select("ref_id", "status", "mismatches", "told_by", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("calls", "cached", "errors")])


# -- fetches that hang on earlier answers ---------------------------------------------------
def or_batches(ids: DataFrame, size: int = BATCH) -> DataFrame:
    """Distinct `id`s in lists of at most `size`, in order; settled, as requests and answers both read them."""
    place = F.monotonically_increasing_id()
    dealt = ids.select("id").distinct().repartitionByRange("id").sortWithinPartitions("id").withColumn("at", place)
    by = (F.shiftright("at", 33), F.floor(F.col("at").bitwiseAND((1 << 33) - 1) / size))
    return settled(dealt.groupBy(by[0].alias("part"), by[1].alias("batch")).agg(F.array_sort(F.collect_list("id")).alias("ids")).select("ids"))


def by_ids(batches: DataFrame, source: str, what: str, base: str = "") -> DataFrame:
    """Requests (source, key, url, ids) for batches of ids."""
    ids = F.col("ids")
    key = F.concat(F.lit({"works": "refs:", "summary": "esummary:batch:", "article": "efetch:abs:"}[what]), F.array_join(ids, ","))
    url = R.ids_url(F.lit(source), F.lit(base), ids, F.lit(what))
    return batches.select(F.lit(source).alias("source"), key.alias("key"), url.alias("url"), "ids")


def reference_records(works: DataFrame, cache: DataFrame, ask: Ask | None = None, most: int = BATCH, base: str = "https://openalex") -> DataFrame:
    """(seed_id, place, work_id, hit fields) of the works that OpenAlex works (seed_id, payload) cite.

    The work tells ids only. Those of all seeds are fetched in lists of `BATCH`, each once, and
    the records go back to the seeds by id; a record that does not come leaves its place out.
    """
    cited = settled(P.referenced(works, most))
    asked = by_ids(or_batches(cited.select(F.col("work_id").alias("id"))), "openalex", "works", base)
    answers = answered(asked, cache, ask).filter("payload IS NOT NULL").select("payload")
    listed = P.items(answers, "results").drop("place").withColumn("work_id", I.short_id(F.get_json_object("payload", "$.id")))
    records = P.openalex(listed).select("work_id", *P.HIT)
    return cited.join(records, "work_id")


def pubmed_records(asked: DataFrame, cache: DataFrame, ask: Ask | None = None, base: str = "https://pubmed") -> DataFrame:
    """PubMed's records for references (ref_id, doi, title): an id search for each, then summaries and
    articles of all ids found, fetched in lists and matched back by id.

    Articles add abstracts and notices; those that fail leave their fields null.
    """
    searches = settled(task_requests(asked.select("ref_id", "doi", "title", F.lit(0).alias("place"), F.lit("pubmed").alias("source")), {"pubmed": base}))
    found = answered(searches, cache, ask).filter("payload IS NOT NULL")
    ids = F.from_json("payload", "esearchresult struct<idlist:array<string>>")["esearchresult"]["idlist"]
    # a DOI has one article; a title has those that the search gives
    uids = settled(searches.join(found.select("source", "key", ids.alias("ids")), ["source", "key"]).select("ref_id", F.posexplode(F.when(F.col("kind") == "doi", F.slice("ids", 1, 1)).otherwise(F.col("ids"))).alias("place", "uid")))
    batches = or_batches(uids.select(F.col("uid").alias("id")))
    summaries = answered(by_ids(batches, "pubmed", "summary", base), cache, ask).filter("payload IS NOT NULL").select("payload")
    articles = answered(by_ids(batches, "pubmed", "article", base), cache, ask).filter("payload IS NOT NULL").select("payload")
    records = P.pubmed(summaries, P.pubmed_details(articles)).select("uid", *P.HIT)
    return uids.join(records, "uid")
