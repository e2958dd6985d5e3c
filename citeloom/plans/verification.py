"""Queries of citation verification."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.functions import text as X
from citeloom.model import dims
from citeloom.operators import matching as M
from citeloom.operators import verify as V
from citeloom.plans.views import duck, view
from citeloom.registry import query

_STOP = "[" + ", ".join(f"'{w}'" for w in dims.TITLE_STOPWORDS) + "]"


def _tokens(c: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}_]', ' ', 'g'), '\\s+'), lambda w: w <> '' AND NOT list_contains({_STOP}, w)))"


_VENUE = r"nullif(lower(regexp_replace({}, '[^\p{{L}}\p{{N}}]+', '', 'g')), '')"


def _names(c: str) -> str:
    """Family-name candidates: the words before a comma, or all but initials (all, if there is nothing else)."""
    split = f"list_filter(string_split(regexp_replace(trim(split_part({c}, ',', 1)), '\\s+', ' ', 'g'), ' '), lambda w: w <> '')"
    initials = r"length(replace(w, '.', '')) BETWEEN 1 AND 3 AND replace(w, '.', '') = upper(replace(w, '.', '')) AND regexp_matches(w, '\p{Lu}')"
    full = f"list_filter({split}, lambda w: NOT ({initials}))"
    chosen = f"CASE WHEN contains({c}, ',') OR len({full}) = 0 THEN {split} ELSE {full} END"
    plain = r"lower(regexp_replace(w, '[^\p{L}\p{N}]+', '', 'g'))"
    return f"list_distinct(list_filter(list_transform({chosen}, lambda w: {plain}), lambda w: w <> ''))"


_JUDGED = f"""
    t AS (SELECT r.ref_id, r.doi AS rd, h.doi AS hd, r.year AS ry, h.year AS hy, {_VENUE.format('r.venue')} AS rv, {_VENUE.format('h.venue')} AS hv, r.title <> '' AND h.title <> '' AS both_t,
                 h.ord, h.retracted, h.retraction_dated, h.source, {_names('r.author')} AS ra, {_names('h.author')} AS ha, {_tokens('r.title')} AS x, {_tokens('h.title')} AS y FROM v_refs r JOIN v_evidence h USING (ref_id)),
    o AS (SELECT *, CASE WHEN least(len(x), len(y)) > 0 THEN len(list_intersect(x, y)) / least(len(x), len(y)) ELSE 0.0 END::DOUBLE AS overlap FROM t),
    p AS MATERIALIZED (SELECT ref_id, ord, retracted, retraction_dated, source, overlap, coalesce(rd = hd, false) AS doi_equal, coalesce(rd <> hd, false) AS doi_differs, coalesce(abs(ry - hy) >= 2, false) AS year_differs,
                 coalesce(both_t AND overlap < 0.8, false) AS title_differs, len(ra) > 0 AND len(ha) > 0 AND len(list_intersect(ra, ha)) = 0 AS first_author_differs,
                 coalesce(NOT (contains(rv, hv) OR contains(hv, rv)), false) AS venue_hint FROM o),
    best AS MATERIALIZED (SELECT * FROM (SELECT *, bool_or(retracted) OVER w AS any_retracted, count(*) OVER w AS n_hits,
                 row_number() OVER (PARTITION BY ref_id ORDER BY doi_equal DESC, CASE WHEN doi_equal THEN 0 ELSE overlap END DESC, ord) AS rn FROM p WINDOW w AS (PARTITION BY ref_id)) WHERE rn = 1),
    gone AS (SELECT ref_id, arg_min(source, (NOT retraction_dated, ord)) AS retraction_by FROM p WHERE retracted GROUP BY ref_id),
    held AS (SELECT ref_id, string_agg(DISTINCT source, ',' ORDER BY source) AS found_in FROM p GROUP BY ref_id),
    err AS (SELECT ref_id, bool_or(outcome = 'error') AS any_error FROM v_queries GROUP BY ref_id),
    judged AS MATERIALIZED (SELECT r.ref_id, CASE WHEN manual_verified THEN 'VERIFIED' WHEN parse_status = 'unparsed' THEN 'PENDING_MANUAL'
        WHEN doi_ra IN ('ISTIC', 'CNKI') AND n_hits IS NULL THEN 'PENDING_MANUAL' WHEN coalesce(doi, '') = '' AND regexp_matches(title, '[一-鿿]') THEN 'PENDING_MANUAL'
        WHEN doi_ra = 'not_registered' THEN 'NOT_FOUND' WHEN any_retracted THEN 'RETRACTED' WHEN n_hits > 0 AND (doi_differs OR year_differs OR title_differs OR first_author_differs) THEN 'METADATA_MISMATCH'
        WHEN n_hits > 0 THEN 'VERIFIED' WHEN any_error THEN 'UNVERIFIED' WHEN coalesce(doi, '') <> '' AND doi_ra IN ('Crossref', 'DataCite') THEN 'NOT_FOUND' ELSE 'PENDING_MANUAL' END AS status,
        doi_differs, year_differs, title_differs, first_author_differs, retraction_by, found_in, n_hits, doi_ra, coalesce(title, '') <> '' AS titled
        FROM v_refs r LEFT JOIN best USING (ref_id) LEFT JOIN err USING (ref_id) LEFT JOIN gone USING (ref_id) LEFT JOIN held USING (ref_id))"""


def judged_sql(views: str) -> str:
    """The rules over `views`, which name v_refs, v_evidence and v_queries."""
    return f"{views},{_JUDGED}"


_PAIRS = judged_sql(duck("v_refs", "v_evidence", "v_queries"))


def _refs(spark, sf_dir):
    return view(spark, sf_dir, "v_refs").withColumn("authors", F.array("author"))


def _evidence(spark, sf_dir):
    return view(spark, sf_dir, "v_evidence").withColumn("authors", F.array("author"))


def _judged(spark, sf_dir):
    return V.judge(_refs(spark, sf_dir), _evidence(spark, sf_dir), view(spark, sf_dir, "v_queries"))


@query("title_overlap", f"{_PAIRS} SELECT ref_id, ord, overlap, doi_equal FROM p")
def title_overlap(spark, sf_dir):
    """Overlap of the titles of references and their hits."""
    return V.compared(_refs(spark, sf_dir), _evidence(spark, sf_dir)).select("ref_id", "ord", "overlap", "doi_equal")


@query("compare_fields", f"{_PAIRS} SELECT ref_id, ord, doi_differs, year_differs, title_differs, first_author_differs, venue_hint FROM p")
def compare_fields(spark, sf_dir):
    """Fields in which references and hits differ."""
    return V.compared(_refs(spark, sf_dir), _evidence(spark, sf_dir)).select("ref_id", "ord", "doi_differs", "year_differs", "title_differs", "first_author_differs", "venue_hint")


@query("best_hit", f"{_PAIRS} SELECT ref_id, ord, overlap, doi_equal, n_hits, any_retracted FROM best")
def best_hit(spark, sf_dir):
    """The hit that each reference is judged by."""
    return V.best_hits(V.compared(_refs(spark, sf_dir), _evidence(spark, sf_dir))).select("ref_id", "ord", "overlap", "doi_equal", "n_hits", "any_retracted")


@query("route_refs", f"""{duck('v_refs')} SELECT ref_id, CASE WHEN doi IS NULL THEN 'crossref,openalex' WHEN doi_ra = 'not_registered' THEN '' WHEN doi_ra = 'DataCite' THEN 'openalex,arxiv'
        WHEN doi_ra IN ('ISTIC', 'CNKI') THEN 'doi_meta' ELSE 'crossref,openalex' END AS sources FROM v_refs""")  # fmt: skip
def route_refs(spark, sf_dir):
    """The sources that each reference is asked of."""
    return V.route(view(spark, sf_dir, "v_refs")).select("ref_id", F.array_join("sources", ",").alias("sources"))


@query("judge_status", f"""{_PAIRS} SELECT ref_id, status, CASE WHEN status = 'METADATA_MISMATCH' THEN concat_ws(',', CASE WHEN doi_differs THEN 'doi' END, CASE WHEN year_differs THEN 'year' END, CASE WHEN title_differs THEN 'title' END, CASE WHEN first_author_differs THEN 'first_author' END) ELSE '' END AS mismatches, CASE WHEN status = 'RETRACTED' THEN retraction_by WHEN status IN ('VERIFIED', 'METADATA_MISMATCH') THEN coalesce(found_in, '') ELSE '' END AS told_by FROM judged""")
def judge_status(spark, sf_dir):
    """The state of each reference."""
    return _judged(spark, sf_dir)


@query("status_distribution", f"""{_PAIRS} SELECT status, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS share,
        (list_position({list(dims.STATUSES)}, status) - 1)::INT AS position, status IN ('NOT_FOUND', 'RETRACTED', 'METADATA_MISMATCH') AS priority FROM judged GROUP BY status""")  # fmt: skip
def status_distribution(spark, sf_dir):
    """States with counts and shares."""
    return V.distribution(_judged(spark, sf_dir))


@query("batch_stats", f"""{duck('v_queries')}, s AS (SELECT count(*) AS calls, count(*) FILTER (from_cache) AS cache_hits, count(*) FILTER (outcome = 'error') AS errors,
        count(*) FILTER (outcome = 'error' AND coalesce(error NOT IN ('TIMEOUT', 'CONN_FAILED', 'DNS_FAIL'), true)) AS other_errors, count(DISTINCT source) AS sources FROM v_queries)
        SELECT *, round(cache_hits / calls, 3) AS cache_hit_rate, CASE WHEN errors = 0 THEN 'ok' WHEN other_errors = 0 AND errors > 5 THEN 'offline' ELSE 'degraded' END AS network_status FROM s""")  # fmt: skip
def batch_stats(spark, sf_dir):
    """Calls, cache hits and errors of the batch."""
    return V.batch_stats(view(spark, sf_dir, "v_queries"))


@query("evidence_rollup", f"{duck('v_queries')} SELECT ref_id, count(*) FILTER (outcome = 'hit') AS hits, count(*) FILTER (outcome = 'error') AS errors, count(*) FILTER (outcome NOT IN ('hit', 'error')) AS misses FROM v_queries GROUP BY ref_id")
def evidence_rollup(spark, sf_dir):
    """Hits, errors and misses of each reference."""
    o = F.col("outcome")
    return view(spark, sf_dir, "v_queries").groupBy("ref_id").agg(F.count_if(o == "hit").alias("hits"), F.count_if(o == "error").alias("errors"), F.count_if(~o.isin("hit", "error")).alias("misses"))


@query("import_consistency", f"""{duck('v_cited', 'v_imported')} SELECT key, CASE WHEN i.year IS NULL THEN 'missing_record' WHEN c.year IS NULL THEN 'uncited' WHEN abs(c.year - i.year) >= 2 THEN 'differs' ELSE 'ok' END AS state
        FROM v_cited c FULL JOIN v_imported i USING (key)""")  # fmt: skip
def import_consistency(spark, sf_dir):
    """Draft citations against imported records."""
    return V.reconcile(view(spark, sf_dir, "v_cited"), view(spark, sf_dir, "v_imported"))


@query("surname_sets", f"{duck('v_names')} SELECT id, array_to_string(list_sort({_names('name')}), '|') AS surnames FROM v_names")
def surname_sets(spark, sf_dir):
    """Family-name candidates of names in four forms."""
    return view(spark, sf_dir, "v_names").select("id", F.array_join(F.array_sort(X.surname_candidates(F.col("name"))), "|").alias("surnames"))


@query("lookup_notes", f"""{_PAIRS} SELECT ref_id, n_hits IS NOT NULL AS found, CASE WHEN n_hits > 0 AND titled THEN NOT (doi_differs OR year_differs OR title_differs OR first_author_differs) END AS metadata_consistent,
        CASE WHEN doi_ra = 'not_registered' THEN 'prefix_not_registered' WHEN n_hits IS NULL AND doi_ra IN ('ISTIC', 'CNKI') THEN 'prefix_registered_record_missing' WHEN n_hits IS NULL THEN 'not_in_open_sources'
             WHEN titled AND (doi_differs OR year_differs OR title_differs OR first_author_differs) THEN 'record_disagrees' ELSE '' END AS note FROM judged""")  # fmt: skip
def lookup_notes(spark, sf_dir):
    """What a lookup can say of each reference."""
    return V.lookup_notes(_refs(spark, sf_dir), _evidence(spark, sf_dir))


_EXPECTED = "CASE WHEN n_hits IS NULL THEN 'NOT_FOUND' ELSE 'VERIFIED' END"


@query("acceptance_rates", f"""{_PAIRS} SELECT coalesce(doi_ra, 'none') AS category, count(*) AS n, round(count(*) FILTER (status = {_EXPECTED}) / count(*), 4) AS rate,
        round(count(*) FILTER (status = 'NOT_FOUND' AND n_hits > 0) / count(*), 4) AS accused_rate FROM judged GROUP BY 1""")  # fmt: skip
def acceptance_rates(spark, sf_dir):
    """How often references with hits are verified and those without are not found, by agency."""
    refs = _refs(spark, sf_dir)
    hit = _evidence(spark, sf_dir).select("ref_id").distinct().withColumn("h", F.lit(True))
    labelled = refs.select("ref_id", F.coalesce("doi_ra", F.lit("none")).alias("category")).join(hit, "ref_id", "left").withColumn("expected", F.when(F.col("h"), "VERIFIED").otherwise("NOT_FOUND"))
    return V.acceptance(_judged(spark, sf_dir).select("ref_id", "status").join(labelled, "ref_id"))


@query("prefix_agencies", f"""{duck('v_prefixes')}, d AS (SELECT p_partkey AS ref_id, '10.' || (5000 + p_size)::VARCHAR AS prefix FROM part)
        SELECT ref_id, CASE WHEN agency IN ('Crossref', 'DataCite', 'ISTIC', 'CNKI') THEN agency WHEN agency IS NOT NULL THEN 'unknown' WHEN error IS NOT NULL THEN 'ra_unreachable' ELSE 'not_registered' END AS doi_ra
        FROM d LEFT JOIN v_prefixes USING (prefix)""")  # fmt: skip
def prefix_agencies(spark, sf_dir):
    """The agency of every DOI's prefix, looked up once for a prefix."""
    refs = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("ref_id"), F.concat(F.lit("https://doi.org/10."), (F.col("p_size") + 5000).cast("string"), F.lit("/X")).alias("doi"))
    return V.with_agency(refs, view(spark, sf_dir, "v_prefixes")).select("ref_id", "doi_ra")


@query("query_outcomes", f"""{duck('v_refs', 'v_evidence')}, way AS (SELECT *, CASE WHEN doi IS NULL THEN ['crossref', 'openalex'] WHEN doi_ra = 'not_registered' THEN [] WHEN doi_ra = 'DataCite' THEN ['openalex', 'arxiv']
            WHEN doi_ra IN ('ISTIC', 'CNKI') THEN ['doi_meta'] ELSE ['crossref', 'openalex'] END AS ways FROM v_refs),
        t AS (SELECT ref_id, doi, title, unnest(ways) AS source, unnest(range(len(ways)))::INT AS place FROM way),
        d AS (SELECT source, lower(doi) AS doi, min(ord) AS hit FROM v_evidence GROUP BY ALL), m AS (SELECT source, lower(title) AS title, min(ord) AS hit FROM v_evidence GROUP BY ALL),
        j AS (SELECT t.*, CASE WHEN t.doi IS NOT NULL THEN d.hit ELSE m.hit END AS hit FROM t LEFT JOIN d ON d.source = t.source AND d.doi = lower(t.doi) LEFT JOIN m ON m.source = t.source AND m.title = lower(t.title))
        SELECT ref_id, place, source, CASE WHEN doi IS NULL THEN 'title_match' ELSE 'doi' END AS query_kind, CASE WHEN hit IS NULL THEN 'miss' ELSE 'hit' END AS outcome, hit FROM j""")  # fmt: skip
def query_outcomes(spark, sf_dir):
    """What came of asking each reference's sources, by DOI or by title."""
    e = view(spark, sf_dir, "v_evidence")
    none = F.lit(None).cast("string").alias("error")
    by_doi = e.groupBy("source", "doi").agg(F.min("ord").alias("hit")).select("source", "doi", "hit", none)
    by_title = e.select("source", "title", F.col("ord").alias("place"), F.col("ord").alias("hit"), none)
    return V.outcomes(V.tasks(V.route(view(spark, sf_dir, "v_refs"))), by_doi, by_title).drop("error")


def _title_key(c: str) -> str:
    return f"array_to_string(list_sort({_tokens(c)}), ' ')"


_MATCHED = f"""rk AS MATERIALIZED (SELECT ref_id, {_title_key('title')} AS l FROM v_refs), hk AS MATERIALIZED (SELECT source, ord, {_title_key('title')} AS r FROM v_hits),
    h5 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r, source ORDER BY ord) AS k FROM hk WHERE r <> '') WHERE k <= 5),
    lt AS (SELECT l, unnest(string_split(l, ' ')) AS t FROM (SELECT DISTINCT l FROM rk WHERE l <> '')), rt AS (SELECT r, unnest(string_split(r, ' ')) AS t FROM (SELECT DISTINCT r FROM h5)),
    both_k AS (SELECT l, r, count(*) AS c FROM lt JOIN rt USING (t) GROUP BY l, r),
    alike AS (SELECT l, r, c / least(len(string_split(l, ' ')), len(string_split(r, ' '))) AS overlap FROM both_k WHERE c / least(len(string_split(l, ' ')), len(string_split(r, ' '))) >= 0.8),
    placed AS (SELECT *, row_number() OVER (PARTITION BY l, source ORDER BY overlap DESC, ord) AS place FROM alike JOIN h5 USING (r)),
    matched AS (SELECT ref_id, source, place::INT AS place, ord, overlap FROM placed JOIN rk USING (l) WHERE place <= 5)"""


@query("title_matches", f"{duck('v_refs', 'v_hits')}, {_MATCHED} SELECT * FROM matched")
def title_matches(spark, sf_dir):
    """For every reference the five hits of each source whose titles are most like its own."""
    return M.title_matches(view(spark, sf_dir, "v_refs"), view(spark, sf_dir, "v_hits"))
