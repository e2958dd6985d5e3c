"""Queries of whole lookups: a list of references verified, and fetches that hang on earlier answers.

The providers are tables here: what they would answer to a request is made from the plain
tables when it is asked for.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.functions import requests as R
from citeloom.operators import lookups as L
from citeloom.plans.verification import judged_sql
from citeloom.plans.views import _FIRST, _LAST, duck, view
from citeloom.registry import query
from citeloom.session import ship


def _part(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet")


def _empty_cache(spark):
    return spark.createDataFrame([], "source string, key string, payload string")


def _doi(c):
    return F.concat(F.lit("doi:10.5555/p"), c.cast("string"))


def _held(spark, sf_dir):
    """A cache of works by DOI and of Crossref's answers to titles."""
    sizes = _part(spark, sf_dir).select(F.col("p_partkey").alias("id"), "p_size")
    crossref = view(spark, sf_dir, "v_crossref").join(sizes, "id")
    by_doi = crossref.filter("p_size % 7 > 1").select(F.lit("crossref").alias("source"), _doi(F.col("id")).alias("key"), F.concat(F.lit('{"message":'), "payload", F.lit("}")).alias("payload"))
    openalex = view(spark, sf_dir, "v_openalex").join(sizes, "id").filter("p_size % 2 = 0").select(F.lit("openalex").alias("source"), _doi(F.col("id")).alias("key"), "payload")
    refs = view(spark, sf_dir, "v_refs").select(F.col("ref_id").alias("id"), "title")
    # of two references with one title, one answer
    titled = crossref.filter("p_size % 3 = 0").join(refs, "id").groupBy("title").agg(F.min_by("payload", "id").alias("w"))
    by_title = titled.select(F.lit("crossref").alias("source"), R.match_key(F.lit("crossref"), F.col("title")).alias("key"), F.concat(F.lit('{"message":{"items":['), "w", F.lit(',{"title":["another"]}]}}')).alias("payload"))
    return by_doi.unionByName(openalex).unionByName(by_title)


def _failing(spark, sf_dir):
    """Crossref does not answer for some works, and has nothing for the rest."""
    away = _part(spark, sf_dir).filter("p_size % 7 = 0").select(F.lit("crossref").alias("source"), _doi(F.col("p_partkey")).alias("key"), F.lit("TIMEOUT").alias("error"))
    return lambda asked: asked.join(away, ["source", "key"], "left").select("source", "key", F.lit(None).cast("string").alias("payload"), "error")


_WORK = f"p_partkey AS id, p_size AS k, p_name AS title, concat('10.5555/p', p_partkey) AS doi, (1990 + p_size % 30)::INT AS year, CASE WHEN p_size % 3 <> 0 THEN p_type END AS venue, concat({_FIRST}, ' ', {_LAST}) AS author"
_BATCH = f"""{duck('v_refs').replace('v_refs AS MATERIALIZED', 'plain_refs AS MATERIALIZED')},
    v_refs AS MATERIALIZED (SELECT * REPLACE (CASE WHEN doi LIKE '10.9999%' THEN 'not_registered' WHEN doi IS NOT NULL THEN 'Crossref' END AS doi_ra) FROM plain_refs), works AS MATERIALIZED (SELECT {_WORK} FROM part),
    titled AS (SELECT r.title, min(r.ref_id) AS id FROM plain_refs r JOIN works w ON w.id = r.ref_id WHERE k % 3 = 0 GROUP BY r.title),
    v_evidence AS MATERIALIZED (SELECT ref_id, w.title, w.doi, w.year, w.venue, 0 AS ord, k % 6 = 0 AS retracted, k % 6 = 0 AS retraction_dated, 'crossref' AS source, w.author FROM v_refs r JOIN works w ON w.id = r.ref_id WHERE r.doi_ra = 'Crossref' AND k % 7 > 1
        UNION ALL SELECT ref_id, w.title, w.doi, w.year, w.venue, 1, k % 6 = 0, false, 'openalex', w.author FROM v_refs r JOIN works w ON w.id = r.ref_id WHERE r.doi_ra = 'Crossref' AND k % 2 = 0
        UNION ALL SELECT ref_id, w.title, w.doi, w.year, w.venue, 0, k % 6 = 0, k % 6 = 0, 'crossref', w.author FROM plain_refs r JOIN titled USING (title) JOIN works w ON w.id = titled.id WHERE r.doi IS NULL),
    called AS (SELECT ref_id, unnest(['crossref', 'openalex']) AS source FROM v_refs WHERE doi_ra IS DISTINCT FROM 'not_registered'),
    v_queries AS MATERIALIZED (SELECT c.ref_id, c.source, CASE WHEN e.source IS NOT NULL THEN 'hit' WHEN c.source = 'crossref' AND r.doi IS NOT NULL AND w.k % 7 = 0 THEN 'error' ELSE 'miss' END AS outcome, e.source IS NOT NULL AS from_cache
        FROM called c JOIN v_refs r USING (ref_id) JOIN works w ON w.id = c.ref_id LEFT JOIN v_evidence e ON e.ref_id = c.ref_id AND e.source = c.source)"""


@query("verify_batch", f"""{judged_sql(_BATCH)}, counted AS (SELECT ref_id, count(*) AS calls, count(*) FILTER (from_cache) AS cached, count(*) FILTER (outcome = 'error') AS errors FROM v_queries GROUP BY ref_id)
    SELECT ref_id, status, CASE WHEN status = 'METADATA_MISMATCH' THEN concat_ws(',', CASE WHEN doi_differs THEN 'doi' END, CASE WHEN year_differs THEN 'year' END, CASE WHEN title_differs THEN 'title' END, CASE WHEN first_author_differs THEN 'first_author' END) ELSE '' END AS mismatches,
           CASE WHEN status = 'RETRACTED' THEN retraction_by WHEN status IN ('VERIFIED', 'METADATA_MISMATCH') THEN coalesce(found_in, '') ELSE '' END AS told_by, coalesce(calls, 0) AS calls, coalesce(cached, 0) AS cached, coalesce(errors, 0) AS errors
    FROM judged LEFT JOIN counted USING (ref_id)""")  # fmt: skip
def verify_batch(spark, sf_dir):
    """A whole list of references, from their agencies to the verdicts."""
    ship(spark)
    refs = view(spark, sf_dir, "v_refs").withColumn("authors", F.array("author"))
    agencies = spark.createDataFrame([("10.5555", "Crossref", None)], "prefix string, agency string, error string")
    return L.verify_batch(refs, agencies, _held(spark, sf_dir), _failing(spark, sf_dir))


def _ids_of(asked, prefix):
    ids = F.split(F.substring_index("key", prefix, -1), ",")
    return asked.filter(F.col("key").startswith(prefix)).select("source", "key", F.posexplode(ids).alias("at", "id"))


@query("reference_records", """SELECT l_orderkey AS seed_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1)::INT AS place, 'W' || l_partkey AS work_id, p_name AS title, (1990 + p_size % 30)::INT AS year
    FROM lineitem JOIN part ON p_partkey = l_partkey""")  # fmt: skip
def reference_records(spark, sf_dir):
    """The records of the works that every order cites, its lines being citations."""
    ship(spark)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("x"))
    urls = F.transform("x", lambda x: F.concat(F.lit("https://openalex.org/W"), x["l_partkey"].cast("string")))
    works = lines.select(F.col("l_orderkey").alias("seed_id"), F.to_json(F.struct(urls.alias("referenced_works"))).alias("payload"))
    held = view(spark, sf_dir, "v_openalex").select(F.concat(F.lit("W"), F.col("id").cast("string")).alias("id"), F.col("payload").alias("work"))

    def ask(asked):
        found = _ids_of(asked, "refs:").join(held, "id").groupBy("source", "key").agg(F.array_join(F.collect_list("work"), ",").alias("w"))
        return found.select("source", "key", F.concat(F.lit('{"results":['), "w", F.lit("]}")).alias("payload"), F.lit(None).cast("string").alias("error"))

    return L.reference_records(works, _empty_cache(spark), ask).select("seed_id", "place", "work_id", "title", "year")


@query("pubmed_chain", """SELECT p_partkey AS ref_id, p_partkey::VARCHAR AS uid, p_name AS title, CASE WHEN p_size % 4 <> 0 THEN (1990 + p_size % 30)::INT END AS year,
        CASE WHEN p_size % 11 = 0 THEN NULL WHEN p_size % 3 = 1 THEN 'Of ' || p_name || ' < all' WHEN p_size % 3 = 2 THEN 'METHODS: We did. RESULTS: It was.' END AS abstract,
        p_size % 7 = 0 OR (p_size % 5 = 0 AND p_size % 11 <> 0) AS retracted
    FROM part WHERE p_size % 9 <> 0""")  # fmt: skip
def pubmed_chain(spark, sf_dir):
    """PubMed's records of all works: id searches by DOI or title, then summaries and articles in lists."""
    ship(spark)
    part = _part(spark, sf_dir)
    doi = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("10.5555/P"), F.col("p_partkey").cast("string")))
    asked = part.select(F.col("p_partkey").alias("ref_id"), doi.alias("doi"), F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("title"))
    own = F.when(F.col("doi").isNotNull(), R.doi_key(F.lit("pubmed"), F.col("doi"))).otherwise(R.match_key(F.lit("pubmed"), F.col("title")))
    known = asked.join(part.filter("p_size % 9 <> 0").select(F.col("p_partkey").alias("ref_id")), "ref_id").select(own.alias("key"), F.concat(F.lit('{"esearchresult":{"idlist":["'), F.col("ref_id").cast("string"), F.lit('"]}}')).alias("payload"))
    text = F.col("id").cast("string")
    docs = view(spark, sf_dir, "v_pubmed").select(text.alias("id"), F.concat(F.lit('"'), text, F.lit('":'), F.map_values(F.from_json("payload", "result map<string,string>")["result"])[1]).alias("doc"))
    articles = view(spark, sf_dir, "v_pubmed_xml").filter("payload NOT LIKE '%<broken'").select(text.alias("id"), F.regexp_extract("payload", r"(?s)(<PubmedArticle>.*</PubmedArticle>)", 1).alias("xml"))

    def ask(requests):
        error = F.lit(None).cast("string").alias("error")
        searched = requests.join(known, "key", "left").filter(~F.col("key").startswith("esummary:") & ~F.col("key").startswith("efetch:")).select("source", "key", "payload", error)
        summed = _ids_of(requests, "esummary:batch:").join(docs, "id").groupBy("source", "key").agg(F.concat_ws(",", F.collect_list("doc")).alias("d"))
        fetched = _ids_of(requests, "efetch:abs:").join(articles, "id").groupBy("source", "key").agg(F.concat_ws("", F.collect_list("xml")).alias("x"))
        return searched.unionByName(summed.select("source", "key", F.concat(F.lit('{"result":{'), "d", F.lit("}}")).alias("payload"), error)).unionByName(
            fetched.select("source", "key", F.concat(F.lit("<PubmedArticleSet>"), "x", F.lit("</PubmedArticleSet>")).alias("payload"), error)
        )

    found = L.pubmed_records(asked, _empty_cache(spark), ask)
    return found.select("ref_id", "uid", "title", "year", "abstract", F.col("retraction").isNotNull().alias("retracted"))
