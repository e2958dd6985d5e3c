"""Queries of federated search."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.functions import identifiers as I
from citeloom.functions import text as X
from citeloom.model import dims
from citeloom.operators import batch as B
from citeloom.operators import works as W
from citeloom.plans.views import duck, view
from citeloom.registry import query
from citeloom.sinks import payloads

_DOI = r"lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(doi), '(?i)^https://doi[.]org/', ''), '(?i)^http://doi[.]org/', ''), '(?i)^doi[.]org/', ''), '(?i)^doi:', '')))"
_NORM = r"trim(regexp_replace(regexp_replace(lower(title), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g'))"
_RANK = "CASE source " + " ".join(f"WHEN '{s}' THEN {r}" for s, r in dims.SOURCE_RANK.items()) + f" ELSE {dims.OTHER_RANK} END"
_TYPE = "CASE lower(trim(type)) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in dims.CANONICAL_TYPE.items()) + " END"
_VERSION = "CASE oa_version " + " ".join(f"WHEN '{a}' THEN {b}" for a, b in dims.OA_VERSION_RANK.items()) + " ELSE 0 END"
_KEY = f"coalesce('doi:' || nullif({_DOI}, ''), 'title:' || nullif({_NORM}, ''), 'uniq:' || ord)"


def _fused(source: str = "v_hits") -> str:
    return f"""
        k AS MATERIALIZED (SELECT *, {_KEY} AS key, {_RANK} AS rk FROM {source}),
        prim AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY rk, ord) AS rn FROM k) WHERE rn = 1),
        cit AS (SELECT * FROM (SELECT key, source, cited_by_count, row_number() OVER (PARTITION BY key ORDER BY cited_by_count DESC, ord) AS rn FROM k WHERE cited_by_count IS NOT NULL) WHERE rn = 1),
        oa AS (SELECT * FROM (SELECT key, source, oa_status, oa_url, oa_version, row_number() OVER (PARTITION BY key ORDER BY oa_url IS NULL, {_VERSION} DESC, rk, ord) AS rn FROM k WHERE oa_status IS NOT NULL) WHERE rn = 1),
        ab AS (SELECT * FROM (SELECT key, source AS abstract_source, trim(abstract) AS abstract, row_number() OVER (PARTITION BY key ORDER BY rk, ord) AS rn FROM k WHERE trim(abstract) <> '') WHERE rn = 1),
        grp AS (SELECT key, count(*) AS n_hits, min(ord) AS first_ord FROM k GROUP BY key),
        src AS (SELECT key, string_agg(source, ',' ORDER BY rk) AS sources, cast(count(*) AS int) AS n_sources FROM (SELECT DISTINCT key, source, rk FROM k) GROUP BY key),
        fused AS MATERIALIZED (SELECT g.key, g.n_hits, g.first_ord, p.title, (SELECT {_DOI} FROM (SELECT p.doi AS doi)) AS doi, p.year, p.venue,
            (SELECT coalesce({_TYPE}, type) FROM (SELECT p.type AS type)) AS type, p.source AS primary_source, cit.cited_by_count, cit.source AS cited_by_source,
            oa.oa_status, oa.oa_url, oa.oa_version, oa.source AS oa_source, ab.abstract, ab.abstract_source, src.sources, src.n_sources, p.date::VARCHAR AS date,
            'https://doi.org/' || nullif((SELECT {_DOI} FROM (SELECT p.doi AS doi)), '') AS url
            FROM grp g JOIN prim p USING (key) JOIN src USING (key) LEFT JOIN cit USING (key) LEFT JOIN oa USING (key) LEFT JOIN ab USING (key))"""


def _hits(spark, sf_dir):
    return view(spark, sf_dir, "v_hits").drop("n_people", "n_orcids", "direction").withColumn("date", F.col("date").cast("string"))


def _works(spark, sf_dir):
    return W.fuse(_hits(spark, sf_dir))


@query("dedup_works", f"{duck('v_hits')}, {_fused()} SELECT * FROM fused")
def dedup_works(spark, sf_dir):
    """All hits fused into works."""
    return _works(spark, sf_dir)


@query(
    "federated_search",
    f"""{duck('v_hits')}, f AS (SELECT * FROM v_hits WHERE contains(lower(title), 'brand') AND source IN ('crossref', 'openalex', 'semantic_scholar') AND year BETWEEN 1996 AND 2000),
        {_fused('f')} SELECT *, row_number() OVER (ORDER BY coalesce(year, 0) DESC, first_ord)::INT AS rank FROM fused ORDER BY rank LIMIT 20""",
)
def federated_search(spark, sf_dir):
    """Filter, unite, fuse, rank: the first twenty works."""
    hits = W.search(_hits(spark, sf_dir), ["brand"], ["crossref", "openalex", "semantic_scholar"], year_from=1996, year_to=2000)
    return W.rank_works(W.fuse(hits), limit=20)


@query("fuse_people", f"""{duck('v_hits')}, k AS (SELECT *, {_KEY} AS key, {_RANK} AS rk FROM v_hits),
        w AS (SELECT key, n_people, least(n_orcids, n_people) AS n, source, row_number() OVER (PARTITION BY key ORDER BY least(n_orcids, n_people) DESC, rk, ord) AS rn FROM k WHERE n_people > 0),
        f AS (SELECT key, direction, min(ord) AS f FROM k WHERE direction IS NOT NULL GROUP BY ALL), d AS (SELECT key, string_agg(direction, ',' ORDER BY f) AS directions FROM f GROUP BY key)
        SELECT DISTINCT k.key, w.n_people, w.n AS n_orcids, w.source AS people_source, coalesce(d.directions, '') AS directions FROM k LEFT JOIN (SELECT * FROM w WHERE rn = 1) w USING (key) LEFT JOIN d USING (key)""")  # fmt: skip
def fuse_people(spark, sf_dir):
    """Whose marks of identity a work shows, and in which directions it was met."""
    person = lambda i: F.struct(i.cast("string").alias("name"), F.when(i <= F.col("n_orcids"), i.cast("string")).alias("orcid"))
    people = F.when(F.col("n_people") > 0, F.transform(F.sequence(F.lit(1), F.col("n_people")), person))
    w = W.fuse(view(spark, sf_dir, "v_hits").withColumn("author_details", people))
    held = F.size(F.filter("author_details", lambda d: d["orcid"].isNotNull()))
    known = F.col("author_details").isNotNull()
    return w.select("key", F.when(known, F.size("author_details")).alias("n_people"), F.when(known, held).alias("n_orcids"), F.col("author_details_source").alias("people_source"), F.array_join("directions", ",").alias("directions"))


@query("normalize_identifiers", f"{duck('v_hits')} SELECT ord, {_DOI} AS doi, split_part({_DOI}, '/', 1) AS prefix, {_TYPE} AS type, {_NORM} AS norm_title, "
       "(floor(year / 5) * 5)::INT::VARCHAR || '–' || ((floor(year / 5) * 5)::INT + 4)::VARCHAR AS bucket FROM v_hits")  # fmt: skip
def normalize_identifiers(spark, sf_dir):
    """DOI, prefix, type, title key and year bucket of all hits."""
    return view(spark, sf_dir, "v_hits").select(
        "ord", I.normalize_doi(F.col("doi")).alias("doi"), I.doi_prefix(F.col("doi")).alias("prefix"), I.canonical_type(F.col("type")).alias("type"),
        X.norm_title(F.col("title")).alias("norm_title"), I.year_bucket(F.col("year")).alias("bucket"),
    )


@query("postfilter", f"{duck('v_hits')} SELECT ord, year, type FROM v_hits WHERE year >= 1997 AND year <= 1999 AND coalesce({_TYPE}, 'journal-article') = 'journal-article'")
def postfilter(spark, sf_dir):
    """Year bounds and a type; unknown types stay."""
    return W.postfilter(view(spark, sf_dir, "v_hits"), year_from=1997, year_to=1999, type="journal-article").select("ord", "year", "type")


@query("postfilter_dates", f"{duck('v_hits')} SELECT ord, date::VARCHAR AS date FROM v_hits WHERE date >= DATE '1997-03-01' AND date <= DATE '1998-02-01'")
def postfilter_dates(spark, sf_dir):
    """Date bounds; rows without a date go."""
    return W.postfilter(view(spark, sf_dir, "v_hits"), date_from="1997-03-01", date_to="1998-02-01").select("ord", F.col("date").cast("string").alias("date"))


@query("rank_source_count", f"{duck('v_hits')}, {_fused()} SELECT key, n_sources, year, row_number() OVER (ORDER BY n_sources DESC, coalesce(year, 0) DESC, first_ord)::INT AS rank FROM fused ORDER BY rank LIMIT 100")
def rank_source_count(spark, sf_dir):
    """The hundred works that most sources know (a top-k report)."""
    return W.rank_works(_works(spark, sf_dir), "source_count", 100).select("key", "n_sources", "year", "rank")


@query("per_source_topn", f"{duck('v_hits')} SELECT source, ord, year FROM v_hits QUALIFY row_number() OVER (PARTITION BY source ORDER BY coalesce(year, 0) DESC, ord) <= 20")
def per_source_topn(spark, sf_dir):
    """The twenty latest hits of each source (a top-k report)."""
    return W.per_source_top(view(spark, sf_dir, "v_hits"), 20).select("source", "ord", "year")


_BUCKET = "(floor(year / 5) * 5)::INT::VARCHAR || '–' || ((floor(year / 5) * 5)::INT + 4)::VARCHAR"


@query(
    "distribution_advisories",
    f"""{duck('v_hits')}, {_fused()},
        l AS (SELECT 'year' AS dim, {_BUCKET} AS value FROM fused UNION ALL SELECT 'venue', venue FROM fused UNION ALL SELECT 'type', type FROM fused UNION ALL SELECT 'source', primary_source FROM fused),
        c AS (SELECT dim, value, count(*) AS n FROM l WHERE value <> '' GROUP BY ALL),
        t AS (SELECT dim, value, n, sum(n) OVER (PARTITION BY dim)::BIGINT AS known, row_number() OVER (PARTITION BY dim ORDER BY n DESC, value DESC) AS rn FROM c)
        SELECT dim, known, value AS top_value, n AS top_n, known >= 5 AND n >= 0.7 * known AS advised FROM t WHERE rn = 1""",
)
def distribution_advisories(spark, sf_dir):
    """Values that most works share."""
    return W.advisories(_works(spark, sf_dir))


@query("search_stats", f"{duck('v_hits')}, {_fused()} SELECT sum(n_hits)::BIGINT AS raw_hits, count(*) AS after_dedup, least(count(*), 30) AS shown, count(*) > 30 AS truncated FROM fused")
def search_stats(spark, sf_dir):
    """How many hits made how many works."""
    return W.search_stats(_works(spark, sf_dir), 30)


_KNOWN = "known(source, kind, role) AS (VALUES " + ", ".join(f"('{s}', '{k}', '{r}')" for s, k, r, _, _ in dims.SOURCES) + ")"
_COVER = f"""{duck('v_queries')}, {_KNOWN},
        s AS (SELECT source, count(*) FILTER (outcome = 'hit') AS hit_count, count(*) FILTER (outcome = 'error') AS errors, count(*) AS calls FROM v_queries GROUP BY source),
        cov AS (SELECT known.*, hit_count, errors, calls, CASE WHEN calls IS NULL THEN 'n/a' WHEN errors = calls THEN 'error' WHEN hit_count = 0 THEN 'empty' WHEN source = 'semantic_scholar' THEN 'degraded' ELSE 'ok' END AS outcome
                FROM known LEFT JOIN s USING (source))"""


@query("coverage_report", f"{_COVER} SELECT * FROM cov")
def coverage_report(spark, sf_dir):
    """What came of each source."""
    return W.coverage(view(spark, sf_dir, "v_queries"))


@query("network_status", f"""{_COVER} SELECT CASE WHEN coalesce(bool_and(outcome = 'error') FILTER (calls IS NOT NULL AND role = 'core'), false) THEN 'offline'
        WHEN bool_or(outcome IN ('error', 'degraded')) THEN 'degraded' ELSE 'ok' END AS network_status FROM cov""")  # fmt: skip
def network_status(spark, sf_dir):
    """The state of the network that the calls tell of."""
    return W.network_status(W.coverage(view(spark, sf_dir, "v_queries")))


def _snowball(direction, limit=None):
    def run(spark, sf_dir):
        """One step along citation edges from every part."""
        seeds = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("seed_id"))
        return W.related(seeds, view(spark, sf_dir, "v_edges"), direction, limit)

    return run


_BACK = "SELECT src_id AS seed_id, dst_id AS work_id, source, 'backward' AS direction FROM v_edges WHERE trim(title) <> '' AND src_id IN (SELECT p_partkey FROM part)"
_AHEAD = "SELECT dst_id AS seed_id, src_id AS work_id, source, 'forward' AS direction FROM v_edges WHERE trim(title) <> '' AND dst_id IN (SELECT p_partkey FROM part)"
query("snowball_backward", f"{duck('v_edges')} {_BACK}")(_snowball("backward"))
query("snowball_forward", f"{duck('v_edges')} {_AHEAD}")(_snowball("forward"))
query("snowball_both", f"{duck('v_edges')} {_BACK} UNION ALL {_AHEAD}")(_snowball("both"))
query("snowball_limited", f"{duck('v_edges')} SELECT * FROM ({_BACK} UNION ALL {_AHEAD}) QUALIFY row_number() OVER (PARTITION BY seed_id, source, direction ORDER BY work_id) <= 3")(_snowball("both", 3))

_ORCID = r"nullif(upper(regexp_extract(trim(orcid), '(?i)(\d{4}-\d{4}-\d{4}-\d{3}[\dX])\s*$', 1)), '')"
_SEEN = "(SELECT string_agg(x, ',' ORDER BY f) FROM (SELECT x, min(o) AS f FROM (SELECT unnest({0}) AS x, unnest(ords) AS o) GROUP BY x))"
_PEOPLE = f"""{duck('v_authors')}, a AS (SELECT *, {_ORCID} AS o FROM v_authors),
        g AS MATERIALIZED (SELECT coalesce('orcid:' || o, 'entity:' || source || ':' || entity_id) AS author_key, arg_min(name, ord) AS name, min(o) AS orcid, sum(works_count)::BIGINT AS works_count, list(ord ORDER BY ord) AS ords,
               list(entity_id ORDER BY ord) AS es, list(affiliation ORDER BY ord) AS fs, list(name ORDER BY ord) AS ns, list(topic ORDER BY ord) AS ts, bool_or(exact_name_match) AS exact_name_match,
               count(*) AS n_candidates, count(DISTINCT entity_id) AS n_entities FROM a GROUP BY 1),
        m AS MATERIALIZED (SELECT author_key, name, orcid, works_count, {_SEEN.format('es')} AS entity_ids, {_SEEN.format('fs')} AS affiliations, {_SEEN.format('ns')} AS name_variants, {_SEEN.format('ts')} AS topics,
               exact_name_match, n_candidates, n_entities, coalesce('orcid:' || orcid, 'entity:' || es[1]) AS works_key FROM g)"""


@query("merge_authors", f"{_PEOPLE} SELECT * FROM m")
def merge_authors(spark, sf_dir):
    """Author candidates as people."""
    return W.merge_authors(view(spark, sf_dir, "v_authors"))


@query("rank_authors", f"{_PEOPLE} SELECT author_key, works_count, name, row_number() OVER (ORDER BY works_count DESC, name DESC, author_key)::INT AS rank FROM m")
def rank_authors(spark, sf_dir):
    """People by their number of works."""
    return W.rank_authors(W.merge_authors(view(spark, sf_dir, "v_authors"))).select("author_key", "works_count", "name", "rank")


@query("author_warnings", f"""{_PEOPLE} SELECT count(*) AS authors, count(*) FILTER (NOT exact_name_match) AS approximate,
        array_to_string(list_sort(list(DISTINCT name) FILTER (NOT exact_name_match))[1:5], ',') AS approximate_names,
        count(*) FILTER (orcid IS NULL) AS no_orcid, count(*) FILTER (n_entities > 1) AS multi_entity, 5000 > count(*) AS cut FROM m""")  # fmt: skip
def author_warnings(spark, sf_dir):
    """Counts that go with merged authors."""
    return W.author_warnings(W.merge_authors(view(spark, sf_dir, "v_authors")), 5000)


@query("works_by_author", f"""{duck('v_authors')}, w AS (SELECT o_orderkey AS work_id, entity_id, {_ORCID} AS o FROM orders JOIN v_authors ON o_custkey = ord),
        k AS (SELECT DISTINCT {_ORCID} AS o, CASE WHEN {_ORCID} IS NULL THEN entity_id END AS e FROM v_authors)
        SELECT DISTINCT 'orcid:' || o AS author_key, work_id, false AS partial FROM k JOIN w USING (o) UNION ALL SELECT DISTINCT 'entity:' || e, work_id, true FROM k JOIN w ON e = entity_id""")  # fmt: skip
def works_by_author(spark, sf_dir):
    """The works of everyone, by ORCID where there is one, else by entity."""
    a = view(spark, sf_dir, "v_authors")
    works = spark.read.parquet(f"{sf_dir}/orders.parquet").join(a, F.col("o_custkey") == F.col("ord")).select(F.col("o_orderkey").alias("work_id"), "entity_id", "orcid")
    keys = W.merge_authors(a).select(F.col("works_key").alias("author_key"))
    return W.works_by_author(works, keys)


@query("rank_works_all", f"{duck('v_hits')}, {_fused()} SELECT key, row_number() OVER (ORDER BY coalesce(year, 0) DESC, first_ord)::INT AS rank FROM fused")
def rank_works_all(spark, sf_dir):
    """All works in their order."""
    return W.rank_works(_works(spark, sf_dir)).select("key", "rank")


@query("search_payload", f"""{_COVER.replace(duck('v_queries'), duck('v_hits', 'v_queries'))}, {_fused()}
    SELECT row_number() OVER (ORDER BY coalesce(year, 0) DESC, first_ord)::INT AS place, key, n_hits FROM fused
    UNION ALL SELECT 0, (SELECT CASE WHEN bool_and(outcome = 'error') FILTER (calls IS NOT NULL AND role = 'core') THEN 'offline' WHEN bool_or(calls IS NOT NULL AND outcome IN ('error', 'degraded')) THEN 'degraded' ELSE 'ok' END FROM cov), count(*) FROM fused""")  # fmt: skip
def search_payload(spark, sf_dir):
    """A search's document over all works, read back from its lines."""
    lines = payloads.search_payload("all", _works(spark, sf_dir), view(spark, sf_dir, "v_queries")).filter(F.col("part") < payloads.TAIL)
    head = F.from_json(F.concat(F.col("line"), F.lit("]}")), "network_status string, stats struct<after_dedup:bigint>")
    row = F.from_json(F.regexp_replace("line", r"\A,", ""), "key string, n_hits bigint")
    read = lines.select(F.col("place").cast("int").alias("place"), F.when(F.col("part") == payloads.HEAD, F.struct(head["network_status"].alias("key"), head["stats"]["after_dedup"].alias("n_hits"))).otherwise(row).alias("r"))
    return read.select("place", "r.*")


_SUPPLIED = "SELECT s_suppkey::VARCHAR AS id, CASE s_nationkey % 4 WHEN 0 THEN 'api' WHEN 1 THEN 'guided' WHEN 2 THEN 'web' END AS kind, CASE s_suppkey % 3 WHEN 0 THEN 'core' WHEN 1 THEN 'supplementary' ELSE 'extra' END AS role, CASE WHEN s_acctbal > 0 THEN 'http://x' END AS base_url, CASE WHEN s_suppkey % 2 = 0 THEN 'search' ELSE 'guess' END AS can FROM supplier"


def _supplied(spark, sf_dir):
    s, k, n = spark.read.parquet(f"{sf_dir}/supplier.parquet"), F.col("s_suppkey"), F.col("s_nationkey")
    return s.select(
        k.cast("string").alias("id"), F.when(n % 4 == 0, "api").when(n % 4 == 1, "guided").when(n % 4 == 2, "web").alias("kind"), F.when(k % 3 == 0, "core").when(k % 3 == 1, "supplementary").otherwise("extra").alias("role"),
        F.when(F.col("s_acctbal") > 0, "http://x").alias("base_url"), F.array(F.when(k % 2 == 0, "search").otherwise("guess")).alias("capabilities"),
    )


@query("registry_faults", f"""WITH s AS ({_SUPPLIED}) SELECT id, 'no kind' AS fault FROM s WHERE kind IS NULL UNION ALL SELECT id, 'kind' FROM s WHERE kind = 'web' UNION ALL SELECT id, 'role' FROM s WHERE role = 'extra'
    UNION ALL SELECT id, 'no base_url' FROM s WHERE kind = 'api' AND base_url IS NULL UNION ALL SELECT id, 'capability guess' FROM s WHERE can = 'guess'""")  # fmt: skip
def registry_faults(spark, sf_dir):
    """What a made-up registry's sources lack."""
    return B.registry_faults(_supplied(spark, sf_dir))


@query("default_sources", f"WITH s AS ({_SUPPLIED}) SELECT id, kind FROM s WHERE role = 'core' AND can = 'search'")
def default_sources(spark, sf_dir):
    """The sources of a made-up registry that are searched if none is named."""
    return B.searched_by_default(_supplied(spark, sf_dir)).select("id", "kind")


@query("batch_left_over", "SELECT p_partkey AS ref_id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity < 3)")
def batch_left_over(spark, sf_dir):
    """References that a batch still has to ask for."""
    return B.left_over(view(spark, sf_dir, "v_refs"), view(spark, sf_dir, "v_evidence")).select("ref_id")


@query("exit_states", "SELECT o_custkey AS run, (CASE WHEN bool_or(o_totalprice > 200000) OR bool_or(o_orderpriority = '1-URGENT') THEN 3 WHEN bool_or(o_orderpriority = '2-HIGH') THEN 1 WHEN bool_or(o_orderpriority = '3-MEDIUM') THEN 2 ELSE 0 END)::INT AS exit_code FROM orders GROUP BY o_custkey")
def exit_states(spark, sf_dir):
    """The worst that happened in each run."""
    o, p = spark.read.parquet(f"{sf_dir}/orders.parquet"), F.col("o_orderpriority")
    status = F.when(p == "1-URGENT", "verify_failed").when(p == "2-HIGH", "failed").when(p == "3-MEDIUM", "skipped").otherwise("ok")
    return B.exit_states(o.select(F.col("o_custkey").alias("run"), status.alias("status"), (F.col("o_totalprice") > 200000).alias("source_changed")))


@query("source_changes", "SELECT source AS run, doc_id AS item, coalesce(text <> replace(text, 'token', 'key'), false) AS source_changed FROM documents")
def source_changes(spark, sf_dir):
    """Documents whose text a step changed, by digests before and after it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("source").alias("run"), F.col("doc_id").alias("item"), "text")
    return B.source_changes(docs, docs.withColumn("text", F.replace("text", F.lit("token"), F.lit("key"))))


@query("changed_runs", "SELECT source AS run, CASE WHEN bool_or(text LIKE '%token%') THEN 3 ELSE 0 END AS exit_code FROM documents GROUP BY source")
def changed_runs(spark, sf_dir):
    """The exit codes of runs by what the digests say."""
    return B.exit_states(source_changes(spark, sf_dir).withColumn("status", F.lit("ok")))


@query("concept_overlap", f"""{duck('v_hits')}, c AS (SELECT ord, contains(lower(title), 'widget') OR contains(lower(title), 'bolt') AS a, contains(lower(title), 'brand#1') AS b FROM v_hits) SELECT ord, a AS has_thing, b AS has_maker, a::INT + b::INT AS overlap FROM c""")
def concept_overlap(spark, sf_dir):
    """Which of two concepts each title names."""
    return B.concept_overlap(view(spark, sf_dir, "v_hits").select("ord", "title"), {"thing": ["widget", "bolt"], "maker": ["Brand#1"]}).drop("title")
