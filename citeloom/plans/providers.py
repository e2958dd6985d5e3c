"""Queries of provider answers, requests, imports and reference lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.functions import identifiers as I
from citeloom.functions import requests as R
from citeloom.operators import providers as P
from citeloom.operators import screening as S
from citeloom.operators import verify as V
from citeloom.operators import works as W
from citeloom.plans.views import _FIRST, _LAST, duck, view
from citeloom.registry import query
from citeloom.session import ship
from citeloom.sinks import reports
from citeloom.sources import exports as E
from citeloom.sources import notes

_PART = f"SELECT p_partkey AS id, {_FIRST} AS f, {_LAST} AS l, p_name AS n, p_type AS t, p_size AS k, (1990 + p_size % 30)::INT AS y FROM part"


def _flat(hits, *more):
    """A hit's lists and records as texts, so that both engines' results compare."""
    person = lambda d: F.concat_ws("|", "d.name") if d is None else F.concat(d["name"], F.lit("|"), F.coalesce(d["orcid"], F.lit("-")), F.lit("|"), F.array_join(d["affiliations"], "+"), F.lit("|"), F.coalesce(d["orcid_verified"].cast("string"), F.lit("-")))
    return hits.select(
        "id", *more, "title", F.array_join("authors", ";").alias("authors"), "year", "date", "venue", "doi", "type", "cited_by_count", "abstract", F.array_join(F.transform(F.coalesce("author_details", F.array()), person), ";").alias("details"),
        F.col("oa.status").alias("oa_status"), F.col("oa.url").alias("oa_url"), F.col("oa.url_kind").alias("url_kind"), F.col("oa.version").alias("oa_version"), F.col("oa.host").alias("oa_host"), F.col("oa.license").alias("oa_license"),
        F.col("retraction.label").alias("retraction"), F.col("retraction.source").alias("retraction_source"), F.col("retraction.doi").alias("retraction_doi"), F.to_json("retraction.date_parts").alias("retraction_date"),
    )


def _said(**given: str) -> str:
    """The columns of `_flat`, null where nothing is given."""
    names = "title authors year date venue doi type cited_by_count abstract details oa_status oa_url url_kind oa_version oa_host oa_license retraction retraction_source retraction_doi retraction_date"
    return ", ".join(f"{given.get(n, 'NULL')} AS {n}" for n in names.split())


_DOI = "'10.5555/p' || id"
_ORCID = "'0000-0001-2345-' || lpad(k::VARCHAR, 3, '0') || 'X'"


@query("crossref_hits", f"""WITH p AS ({_PART}) SELECT id, {_said(title='n', authors="f || ' ' || l || ';'", year='y', venue='CASE WHEN k % 3 <> 0 THEN t END', doi=_DOI, type="'journal-article'", cited_by_count='CASE WHEN k % 4 <> 0 THEN k END::BIGINT',
    abstract="'About ' || n", details=f"CASE WHEN k % 2 = 0 OR k % 5 = 0 THEN f || ' ' || l || '|' || CASE WHEN k % 2 = 0 THEN {_ORCID} ELSE '-' END || '|' || CASE WHEN k % 5 = 0 THEN 'Univ' ELSE '' END || '|' || CASE WHEN k % 2 = 0 THEN 'true' ELSE '-' END ELSE '' END",
    retraction="CASE WHEN k % 6 = 0 THEN 'Retraction' END", retraction_source="CASE WHEN k % 6 = 0 THEN 'retraction-watch' END", retraction_doi="CASE WHEN k % 6 = 0 THEN '10.1/n' END", retraction_date="CASE WHEN k % 6 = 0 THEN '[[2010,2,6]]' END")} FROM p""")  # fmt: skip
def crossref_hits(spark, sf_dir):
    """What Crossref's answers say."""
    ship(spark)
    return _flat(P.crossref(view(spark, sf_dir, "v_crossref")))


@query("openalex_hits", f"""WITH p AS ({_PART}) SELECT id, {_said(title='n', authors="f || ' ' || l", year='y', venue='CASE WHEN k % 3 <> 0 THEN t END', doi=_DOI, type="'article'", cited_by_count='k::BIGINT', abstract="'All about it and it'",
    details=f"CASE WHEN k % 2 = 0 THEN f || ' ' || l || '|' || {_ORCID} || '||-' ELSE '' END", oa_status="CASE k % 5 WHEN 1 THEN 'closed' WHEN 2 THEN 'gold' WHEN 3 THEN 'green' WHEN 4 THEN 'bronze' END", oa_url="CASE k % 5 WHEN 2 THEN 'http://p' WHEN 3 THEN 'http://l' WHEN 4 THEN 'http://o' END",
    url_kind="CASE k % 5 WHEN 2 THEN 'pdf' WHEN 3 THEN 'landing' END", oa_version="CASE k % 5 WHEN 2 THEN 'publishedVersion' WHEN 3 THEN 'submittedVersion' END", oa_host="CASE k % 5 WHEN 2 THEN 'publisher' WHEN 3 THEN 'repository' END", oa_license="CASE k % 5 WHEN 2 THEN 'cc-by' END",
    retraction="CASE WHEN k % 6 = 0 THEN 'Retraction' END", retraction_source="CASE WHEN k % 6 = 0 THEN 'openalex' END")} FROM p""")  # fmt: skip
def openalex_hits(spark, sf_dir):
    """What OpenAlex's answers say."""
    return _flat(P.openalex(view(spark, sf_dir, "v_openalex")))


@query("scholar_hits", f"""WITH p AS ({_PART}) SELECT id, {_said(title='n', authors="f || ' ' || l", year='y', venue='CASE WHEN k % 3 <> 0 THEN t END', doi=f'CASE WHEN k % 2 = 0 THEN {_DOI} END', type="CASE WHEN k % 4 <> 0 THEN 'JournalArticle' END", cited_by_count='CASE WHEN k % 5 <> 0 THEN k END::BIGINT', details="''")} FROM p""")
def scholar_hits(spark, sf_dir):
    """What Semantic Scholar's answers say."""
    return _flat(P.semantic_scholar(view(spark, sf_dir, "v_scholar")))


@query("eric_hits", f"""WITH p AS ({_PART}) SELECT id, {_said(title='n', authors="l || ', ' || f", year='y', venue='t', type="CASE WHEN k % 2 = 0 THEN 'Journal Articles' END", details="''")} FROM p""")
def eric_hits(spark, sf_dir):
    """What ERIC's answers say."""
    return _flat(P.eric(view(spark, sf_dir, "v_eric")))


@query("doi_meta_hits", f"""WITH p AS ({_PART}) SELECT id, {_said(title="CASE WHEN k % 2 = 0 THEN '“' || n || '”' ELSE n END", authors="'宋长青;A Group;' || f || ' ' || l", year='CASE k % 3 WHEN 0 THEN 2015 WHEN 1 THEN 2016 END', venue="'A & B'", doi=_DOI, type="'article-journal'", abstract="'x < ' || n", details="''")} FROM p""")
def doi_meta_hits(spark, sf_dir):
    """What content negotiation says."""
    ship(spark)
    return _flat(P.doi_meta(view(spark, sf_dir, "v_csl")))


@query("arxiv_hits", f"""WITH p AS (SELECT p_partkey AS id, p_size AS k FROM part), e AS (SELECT *, 0 AS place FROM p UNION ALL SELECT *, 1 FROM p)
    SELECT id, place::INT AS place, CASE WHEN place = 1 THEN '2001.1' ELSE '1706.0' || k END AS arxiv_id, CASE WHEN place = 0 THEN 'cs.CL' END AS category, {_said(title="CASE WHEN place = 1 THEN 'Second' ELSE 'Size ' || k END", authors="CASE WHEN place = 0 THEN 'Ann Lee;Bo' ELSE '' END",
    year="CASE WHEN place = 0 THEN CASE WHEN k % 4 = 0 THEN 2017 ELSE 2000 + k END END::INT", date="CASE WHEN place = 0 AND k % 4 <> 0 THEN '20' || lpad(k::VARCHAR, 2, '0') || '-06-12' END", doi="CASE WHEN place = 0 AND k % 2 = 0 THEN '10.5555/arx' END", type="'preprint'",
    abstract="CASE WHEN place = 0 THEN 'Two lines' END", details="''", oa_status="'green'", oa_host="'preprint'", oa_version="'submittedVersion'", oa_url="CASE WHEN place = 1 THEN 'http://arxiv.org/abs/2001.1v1' WHEN k % 3 = 0 THEN 'http://arxiv.org/pdf/x' ELSE 'http://arxiv.org/abs/1706.0' || k || 'v5' END",
    url_kind="CASE WHEN place = 0 AND k % 3 = 0 THEN 'pdf' ELSE 'landing' END")} FROM e""")  # fmt: skip
def arxiv_hits(spark, sf_dir):
    """What arXiv's feeds say."""
    return _flat(P.arxiv(view(spark, sf_dir, "v_atom")), "place", "arxiv_id", "category")


_LABEL = "'Vet. 2026;50(5):485. doi: 10.1007/S112.'"


@query("pubmed_hits", f"""WITH p AS (SELECT *, k % 11 <> 0 AND k % 5 = 0 AS noted FROM ({_PART}))
    SELECT id, CASE WHEN k % 11 <> 0 AND k % 5 = 1 THEN 'Doubt.' END AS concern, 'Clinical Trial' || CASE WHEN k % 7 = 0 THEN ';Retracted Publication' ELSE '' END AS pubtypes, {_said(title='n', authors="l || ' AJ'", year='CASE WHEN k % 4 <> 0 THEN y END', venue='t', doi=f'CASE WHEN k % 2 = 0 THEN {_DOI} END', type="'Clinical Trial'",
    abstract="CASE WHEN k % 11 = 0 THEN NULL WHEN k % 3 = 1 THEN 'Of ' || n || ' < all' WHEN k % 3 = 2 THEN 'METHODS: We did. RESULTS: It was.' END", details="''", oa_status="CASE WHEN k % 3 = 0 THEN 'green' END", oa_host="CASE WHEN k % 3 = 0 THEN 'pmc' END", url_kind="CASE WHEN k % 3 = 0 THEN 'landing' END",
    oa_url="CASE WHEN k % 3 = 0 THEN 'https://pmc.ncbi.nlm.nih.gov/articles/PMC77/' END", retraction=f"CASE WHEN noted THEN {_LABEL} WHEN k % 7 = 0 THEN 'Retracted Publication' END", retraction_source="CASE WHEN noted OR k % 7 = 0 THEN 'pubmed' END", retraction_doi="CASE WHEN noted THEN '10.1007/s112' END")} FROM p""")  # fmt: skip
def pubmed_hits(spark, sf_dir):
    """What PubMed's summaries and fetched articles say together."""
    hits = P.pubmed(view(spark, sf_dir, "v_pubmed"), P.pubmed_details(view(spark, sf_dir, "v_pubmed_xml")))
    return _flat(hits.withColumns({"concern": F.col("expression_of_concern.label"), "pubtypes": F.array_join("pubtypes", ";")}), "concern", "pubtypes")


@query("referenced_works", "SELECT p_partkey AS id, place::INT AS place, CASE WHEN place = 0 THEN 'W1' ELSE 'W' || p_size END AS work_id FROM part, range(2) r(place)")
def referenced_works(spark, sf_dir):
    """Works that OpenAlex works cite."""
    return P.referenced(view(spark, sf_dir, "v_openalex"))


@query("edge_papers", "SELECT p_partkey AS id, place::INT AS place, CASE WHEN place = 1 THEN 'T' || p_size ELSE 'U' END AS title FROM part, (VALUES (1), (3)) r(place)")
def edge_papers(spark, sf_dir):
    """Papers at the ends of edges; stubs go."""
    ends = P.edge_papers(view(spark, sf_dir, "v_edges_page"), "citedPaper")
    return P.semantic_scholar(ends).select("id", "place", "title")


@query("author_candidates", """SELECT p_partkey AS id, p_name AS name, 'A' || p_partkey AS entity_ids, CASE WHEN p_size % 2 = 0 THEN '0000-0001-2345-6789' END AS orcid, p_size::BIGINT AS works_count, 'Univ:2' AS affiliations, 'T1' AS topics, 'X,Y' AS name_variants,
    lower(p_name) = lower(CASE WHEN p_size % 3 = 0 THEN upper(p_name) ELSE p_type END) AS exact_name_match FROM part""")  # fmt: skip
def author_candidates(spark, sf_dir):
    """OpenAlex authors as candidates."""
    a = P.author_candidates(view(spark, sf_dir, "v_people"), F.col("asked"))
    places = F.array_join(F.transform("affiliations", lambda x: F.concat(x["name"], F.lit(":"), F.size(x["years"]).cast("string"))), ",")
    return a.select("id", "name", F.array_join("entity_ids", ",").alias("entity_ids"), "orcid", "works_count", places.alias("affiliations"), F.array_join("topics", ",").alias("topics"), F.array_join("name_variants", ",").alias("name_variants"), "exact_name_match")


_Q = "replace(replace(replace(query, ' ', '%20'), '\"', '%22'), ':', '%3A')"
_YEARS = "year_from IS NOT NULL OR year_to IS NOT NULL"


def _natively(pairs: str) -> str:
    return f"CASE type {pairs} END"


def _list_filter(first: str, last: str, kind: str) -> str:
    parts = f"concat_ws(',', '{first}:' || year_from || '-01-01', '{last}:' || year_to || '-12-31', 'type:' || {kind})"
    return f"CASE WHEN {parts} <> '' THEN '&filter=' || {parts} ELSE '' END"


@query("request_filters", f"""{duck('v_requests')} SELECT id, {_list_filter('from-pub-date', 'until-pub-date', _natively("WHEN 'journal-article' THEN 'journal-article' WHEN 'thesis' THEN 'dissertation'"))} AS crossref,
    {_list_filter('from_publication_date', 'to_publication_date', _natively("WHEN 'journal-article' THEN 'article' WHEN 'thesis' THEN 'dissertation' WHEN 'review' THEN 'review'"))} AS openalex,
    CASE WHEN {_YEARS} THEN '&year=' || coalesce(year_from::VARCHAR, '') || '-' || coalesce(year_to::VARCHAR, '') ELSE '' END || CASE type WHEN 'journal-article' THEN '&publicationTypes=JournalArticle' WHEN 'review' THEN '&publicationTypes=Review' ELSE '' END AS scholar,
    CASE WHEN year_from IS NULL AND year_to IS NULL AND type IS NULL THEN 'none' WHEN source IN ('crossref', 'openalex', 'semantic_scholar') THEN 'native' ELSE 'client_side' END AS applied FROM v_requests""")  # fmt: skip
def request_filters(spark, sf_dir):
    """The filters that each provider applies itself, and who applies them."""
    y, z, t = F.col("year_from"), F.col("year_to"), F.col("type")
    filtered = y.isNotNull() | z.isNotNull() | t.isNotNull()
    return view(spark, sf_dir, "v_requests").select("id", R.crossref_filters(y, z, t).alias("crossref"), R.openalex_filters(y, z, t).alias("openalex"), R.scholar_filters(y, z, t).alias("scholar"), R.applied_filters(F.col("source"), filtered).alias("applied"))


_WINDOW = "'[' || coalesce(replace(date_from, '-', ''), '19900101') || '0000 TO ' || coalesce(replace(date_to, '-', ''), '20991231') || '2359]'"
_DATED = "date_from IS NOT NULL OR date_to IS NOT NULL"
_TERMS = "'(all:Deep AND all:learning AND all:part AND all:' || split_part(query, ' ', 4) || ') AND submittedDate:'"
_QUOTED = "replace(replace(replace(replace(replace({}, ' ', '%20'), ':', '%3A'), '(', '%28'), ')', '%29'), '[', '%5B')"


@query("request_urls", f"""{duck('v_requests')}, d AS (SELECT *, lower(replace(doi, 'https://doi.org/', '')) AS d FROM v_requests)
    SELECT id, CASE WHEN {_DATED} THEN 'search_query=' || replace({_QUOTED.format(f"{_TERMS} || {_WINDOW}")}, ']', '%5D') || '&max_results=20&sortBy=submittedDate&sortOrder=descending' ELSE 'search_query=all:' || {_Q} || '&max_results=20' END AS arxiv,
    'search:' || lower(query) || ':20' || CASE WHEN {_YEARS} OR type IS NOT NULL OR {_DATED} THEN ':f=' || coalesce(year_from::VARCHAR, 'None') || '-' || coalesce(year_to::VARCHAR, 'None') || '-' || coalesce(type, 'None') ELSE '' END
        || CASE WHEN {_DATED} THEN ':d=' || coalesce(date_from, 'None') || '-' || coalesce(date_to, 'None') ELSE '' END AS search_key,
    CASE source WHEN 'semantic_scholar' THEN 'doi:' || d || ':f2' WHEN 'arxiv' THEN CASE WHEN starts_with(d, '10.48550/') THEN 'arxiv_id:' || replace(replace(d, '10.48550/', ''), 'arxiv.', '') END WHEN 'pubmed' THEN 'esearch:' || d ELSE 'doi:' || d END AS doi_key,
    CASE source WHEN 'crossref' THEN 'B/works/' || replace(replace(replace(d, '/', '%2F'), '(', '%28'), ')', '%29') WHEN 'openalex' THEN 'B/works/doi:' || replace(replace(d, '(', '%28'), ')', '%29') WHEN 'semantic_scholar' THEN 'B/graph/v1/paper/DOI:' || replace(replace(d, '(', '%28'), ')', '%29')
        WHEN 'arxiv' THEN CASE WHEN starts_with(d, '10.48550/') THEN 'B/query?id_list=' || replace(replace(d, '10.48550/', ''), 'arxiv.', '') || '&max_results=1' END WHEN 'pubmed' THEN 'B/esearch.fcgi?db=pubmed&term=' || d || '[doi]&retmode=json&retmax=1' END AS doi_url FROM d""")  # fmt: skip
def request_urls(spark, sf_dir):
    """URLs and cache keys of searches and lookups."""
    c = {n: F.col(n) for n in ("query", "year_from", "year_to", "type", "date_from", "date_to", "source", "doi")}
    n = F.lit(20)
    return view(spark, sf_dir, "v_requests").select(
        "id", R.arxiv_query(c["query"], c["date_from"], c["date_to"], n).alias("arxiv"), R.search_key(c["query"], n, c["year_from"], c["year_to"], c["type"], c["date_from"], c["date_to"]).alias("search_key"),
        R.doi_key(c["source"], c["doi"]).alias("doi_key"), R.doi_url(c["source"], F.lit("B"), c["doi"]).alias("doi_url"),
    )


_FIELDS_ASKED = "'&fields=title,authors,year,venue,externalIds,publicationTypes,citationCount,abstract'"


@query("search_urls", f"""{duck('v_requests')}, u AS (SELECT *, {_Q} AS q,
        {_list_filter('from-pub-date', 'until-pub-date', _natively("WHEN 'journal-article' THEN 'journal-article' WHEN 'thesis' THEN 'dissertation'"))} AS cf,
        {_list_filter('from_publication_date', 'to_publication_date', _natively("WHEN 'journal-article' THEN 'article' WHEN 'thesis' THEN 'dissertation' WHEN 'review' THEN 'review'"))} AS of,
        CASE WHEN {_YEARS} THEN '&year=' || coalesce(year_from::VARCHAR, '') || '-' || coalesce(year_to::VARCHAR, '') ELSE '' END || CASE type WHEN 'journal-article' THEN '&publicationTypes=JournalArticle' WHEN 'review' THEN '&publicationTypes=Review' ELSE '' END AS sf FROM v_requests)
    SELECT id, CASE source WHEN 'crossref' THEN 'B/works?query=' || q || '&rows=20' || cf WHEN 'openalex' THEN 'B/works?search=' || q || '&per-page=20' || of WHEN 'semantic_scholar' THEN 'B/graph/v1/paper/search?query=' || q || '&limit=20' || {_FIELDS_ASKED} || sf
        WHEN 'pubmed' THEN 'B/esearch.fcgi?db=pubmed&term=' || q || '&retmode=json&retmax=20' WHEN 'eric' THEN 'B/?search=' || q || '&format=json&rows=20'
        ELSE CASE WHEN {_DATED} THEN 'B/query?search_query=' || replace({_QUOTED.format(f"{_TERMS} || {_WINDOW}")}, ']', '%5D') || '&max_results=20&sortBy=submittedDate&sortOrder=descending' ELSE 'B/query?search_query=all:' || q || '&max_results=20' END END AS search_url,
    CASE source WHEN 'crossref' THEN 'B/works?query.bibliographic=' || q || '&rows=5' WHEN 'openalex' THEN 'B/works?filter=title.search:' || q || '&per-page=5' WHEN 'semantic_scholar' THEN 'B/graph/v1/paper/search?query=' || q || '&limit=5' || {_FIELDS_ASKED}
        WHEN 'pubmed' THEN 'B/esearch.fcgi?db=pubmed&term=' || q || '&retmode=json&retmax=5' WHEN 'eric' THEN 'B/?search=' || q || '&format=json&rows=5' ELSE 'B/query?search_query=ti:' || q || '&max_results=5' END AS match_url FROM u""")  # fmt: skip
def search_urls(spark, sf_dir):
    """Where keyword searches and title matches are sent."""
    c = [F.col(n) for n in ("year_from", "year_to", "type", "date_from", "date_to")]
    base, source = F.lit("B"), F.col("source")
    return view(spark, sf_dir, "v_requests").select("id", R.search_url(source, base, F.col("query"), F.lit(20), *c).alias("search_url"), R.match_url(source, base, F.col("query")).alias("match_url"))


@query("cached_lookups", f"""WITH p AS ({_PART}) SELECT id, CASE WHEN k > 25 THEN 'hit' ELSE 'miss' END AS outcome, CASE WHEN k > 25 THEN n END AS title FROM p""")
def cached_lookups(spark, sf_dir):
    """Lookups by DOI that a cache of answers can serve: keys joined with the answers that still hold."""
    ship(spark)
    sizes = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), "p_size")
    held = view(spark, sf_dir, "v_crossref").join(sizes, "id")
    day = F.when(F.col("p_size") > 25, F.lit("2024-01-30 00:00:00")).otherwise("2024-01-01 00:00:00").cast("timestamp")
    cache = held.select(F.lit("crossref").alias("source"), F.concat(F.lit("doi:10.5555/p"), F.col("id").cast("string")).alias("key"), "payload", day.alias("fetched_at"))
    asked = sizes.select("id", F.lit("crossref").alias("source"), R.doi_key(F.lit("crossref"), F.concat(F.lit("DOI:10.5555/P"), F.col("id").cast("string"))).alias("key"))
    answers = asked.join(S.cache_latest(cache, "2024-01-31 00:00:00"), ["source", "key"], "left")
    return P.crossref(answers).select("id", F.when(F.col("payload").isNotNull(), "hit").otherwise("miss").alias("outcome"), "title")


@query("window_warnings", f"""{duck('v_requests')}, w AS (SELECT id AS search_id, query, source, date_from, date_to FROM v_requests WHERE {_DATED})
    SELECT search_id, 'no_days:' || source AS warning FROM w WHERE source <> 'arxiv'""")  # fmt: skip
def window_warnings(spark, sf_dir):
    """What a day window means for each search."""
    return W.window_warnings(view(spark, sf_dir, "v_requests").select(F.col("id").alias("search_id"), "query", F.array("source").alias("sources"), "date_from", "date_to"))


@query("import_bibtex", f"""WITH p AS ({_PART}) SELECT id, CASE k % 4 WHEN 0 THEN 'journal-article' WHEN 1 THEN 'thesis' WHEN 3 THEN 'conference-paper' END AS type, 'A ' || n || ' Study' AS title, l || ', ' || f || ';Li, Wei' AS authors, CASE WHEN k < 110 THEN 1990 + k END::INT AS year, 'J. & ' || t AS venue,
    CASE WHEN k % 2 = 0 THEN {_DOI} END AS doi, '1--9' AS pages FROM p UNION ALL SELECT id, 'book', NULL, '', NULL, NULL, NULL, NULL FROM p WHERE k % 3 <> 0""")  # fmt: skip
def import_bibtex(spark, sf_dir):
    """Entries of BibTeX exports."""
    ship(spark)
    x = E.to_export(E.parse_bibtex(view(spark, sf_dir, "v_bibtex", spread=True).select(F.col("id").cast("string").alias("file"), "text")))
    return x.select(F.col("file").cast("long").alias("id"), "type", "title", F.array_join("authors", ";").alias("authors"), "year", "venue", "doi", "pages")


def _ris(spark, sf_dir):
    return E.to_export(E.parse_ris(view(spark, sf_dir, "v_ris").select(F.col("id").cast("string").alias("file"), "text")))


@query("import_ris", f"""WITH p AS (SELECT *, p_brand AS b FROM ({_PART}) JOIN (SELECT p_partkey AS id, p_brand FROM part) USING (id))
    SELECT id, CASE WHEN k % 2 = 0 THEN 'journal-article' ELSE 'thesis' END AS type, n || ' continued' AS title, l || ';Li' AS authors, (1990 + k)::INT AS year, '深度学习' AS venue, CASE WHEN k % 3 = 0 THEN '1-9' ELSE '1' END AS pages FROM p
    UNION ALL SELECT id, 'book-chapter', '知网 ' || b, '', NULL, NULL, NULL FROM p""")  # fmt: skip
def import_ris(spark, sf_dir):
    """Entries of RIS exports."""
    return _ris(spark, sf_dir).select(F.col("file").cast("long").alias("id"), "type", "title", F.array_join("authors", ";").alias("authors"), "year", "venue", "pages")


@query("import_warnings", "SELECT 2 * count(*) AS parsed, count(*) AS marked, (SELECT '知网 ' || p_brand FROM part ORDER BY p_partkey::VARCHAR LIMIT 1) AS first_marked, 2 * count(*) AS without_doi FROM part")
def import_warnings(spark, sf_dir):
    """What a reader of imported rows must see."""
    return E.import_warnings(_ris(spark, sf_dir))


@query("import_union", f"""{duck('v_hits')}, h AS (SELECT DISTINCT lower(trim(regexp_replace(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g'))) AS t FROM v_hits)
    SELECT 'title:' || lower(p_name) || ' continued' AS key, count(*) AS n_hits, 'cnki' AS primary_source FROM part GROUP BY lower(p_name)
    UNION ALL SELECT 'title:知网 ' || lower(replace(p_brand, '#', '')), count(*), 'cnki' FROM part GROUP BY 1""")  # fmt: skip
def import_union(spark, sf_dir):
    """Imported rows united with hits and fused: the works that only the import knows."""
    # a row's place in its file is its arrival, the same whenever it is worked out
    rows = E.to_results(_ris(spark, sf_dir), "cnki").withColumn("ord", F.concat_ws(":", "file", F.lpad(F.col("seq").cast("string"), 10, "0")))
    hits = view(spark, sf_dir, "v_hits").select("ord", "source", "doi", "title", "year", "venue", "type", "cited_by_count", "abstract", "oa_status", "oa_url", "oa_version")
    both = rows.select(*hits.columns).unionByName(hits)
    return W.fuse(both).filter("primary_source = 'cnki'").select("key", "n_hits", "primary_source")


@query("import_ledger", """SELECT o_orderkey AS id, o_orderkey::INT AS seq, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE '纳入' END AS ft_screen, o_orderkey % 3 = 0 AS malformed FROM orders""")
def import_ledger(spark, sf_dir):
    """Ledger rows of markdown tables, a third of which lack cells."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    n = F.col("o_orderkey").cast("string")
    row = F.concat(F.lit("| "), n, F.when(F.col("o_orderkey") % 3 == 0, "| a | b |").otherwise("| a | b | 保留 | 进入全文 | 纳入 | | |"))
    text = F.concat(F.lit("| 序号 | 题录 |\n|---|---|\n"), row, F.lit("\n1 | not a row"))
    return E.parse_ledger(o.select(n.alias("file"), text.alias("text"))).select(F.col("file").cast("long").alias("id"), "seq", "ft_screen", "malformed")


_REFS = f"""WITH p AS ({_PART}), r AS (
    SELECT id, 'r1' AS ref_id, NULL AS doi, 'A study of ' || n AS title, l || ', ' || f AS authors, 1990 + k AS year, NULL AS venue, '[J]' AS type, 'ok' AS parse_status FROM p WHERE k % 4 = 0
    UNION ALL SELECT id, 'r2', NULL, 'The ' || t || ' book', l || ' A, B, C, D', 2019, NULL, NULL, 'ok' FROM p WHERE k % 4 = 0
    UNION ALL SELECT id, 'r3', NULL, 'On ' || n, l, 2018, NULL, '[J/OL]', 'ok' FROM p WHERE k % 4 = 0 UNION ALL SELECT id, 'r4', NULL, 'Of ' || n, l, 2017, NULL, '[J]', 'ok' FROM p WHERE k % 4 = 0
    UNION ALL SELECT id, 'r1', '10.5555/S(' || id || ')9-0', 'About ' || n, l || ', A. J., & Murch, S', 1950 + k, NULL, NULL, 'ok' FROM p WHERE k % 4 = 1
    UNION ALL SELECT id, 'r2', NULL, NULL, '', NULL, NULL, NULL, 'unparsed' FROM p WHERE k % 4 = 1
    UNION ALL SELECT id, 'r1', '10.5555/p' || id, NULL, '', NULL, NULL, NULL, 'ok' FROM p WHERE k % 4 = 2
    UNION ALL SELECT id, 'r1', '10.5555/b' || id, 'On ' || n, l || ';Li Wei', 1990 + k, t, NULL, 'ok' FROM p WHERE k % 4 = 3
    UNION ALL SELECT id, 'r2', NULL, NULL, '', NULL, NULL, NULL, 'unparsed' FROM p WHERE k % 4 = 3)"""


@query("parse_references", f"{_REFS} SELECT id AS doc_id, ref_id, doi, title, authors, year::INT AS year, venue, type, parse_status FROM r")
def parse_references(spark, sf_dir):
    """The references of all lists: numbered and author-year lines, bare DOIs, BibTeX."""
    r = V.parse_references(view(spark, sf_dir, "v_reflists"))
    return r.select("doc_id", "ref_id", "doi", "title", F.array_join("authors", ";").alias("authors"), "year", "venue", "type", "parse_status")


@query("format_issues", f"""{_REFS} SELECT id AS doc_id, ref_id, 'type_tag' AS category, '' AS signs FROM r WHERE type IS NULL UNION ALL SELECT id, ref_id, 'punctuation', '。' FROM r JOIN p USING (id) WHERE k % 4 = 1 AND ref_id = 'r1'
    UNION ALL SELECT id, ref_id, 'authors', '' FROM r WHERE len(string_split(authors, ',')) >= 4
    UNION ALL SELECT id, ref_id, 'eb_ol', '' FROM r WHERE type = '[J/OL]' UNION ALL SELECT id, ref_id, 'pages', '' FROM r WHERE type = '[J]' AND ref_id = 'r4'""")  # fmt: skip
def format_issues(spark, sf_dir):
    """Format rules that the references of all lists break."""
    return V.check_format(V.parse_references(view(spark, sf_dir, "v_reflists")), ["doc_id", "ref_id"])


@query("trace_entries", """SELECT o_orderkey AS id, 0 AS place, '2024-01-0' || (1 + o_custkey % 9) AS day, 'paper-topic' AS command, '选题 ' || o_custkey AS description, 'topic/' || o_orderkey || '.html' AS product FROM orders
    UNION ALL SELECT o_orderkey, 1, '2024-02-02', 'paper-draft', '', NULL FROM orders""")  # fmt: skip
def trace_entries(spark, sf_dir):
    """Entries of audit trails."""
    return notes.trace_entries(view(spark, sf_dir, "v_trails"))


@query("release_notes", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'Summary ' || o_custkey || CASE WHEN o_orderkey % 4 = 0 THEN chr(10) || '<!-- SKELETON x -->' ELSE '' END END AS section, CASE WHEN o_orderkey % 4 = 0 THEN 'sentinel,comment' WHEN o_orderkey % 2 = 0 THEN '' END AS blockers FROM orders""")
def release_notes(spark, sf_dir):
    """A version's section of change logs, and what keeps it back."""
    o, nl = spark.read.parquet(f"{sf_dir}/orders.parquet"), F.lit("\n")
    head = F.when(F.col("o_orderkey") % 2 == 0, "## [1.2.0] - 2024").otherwise("## [1.3.0] - 2024")
    body = F.concat(F.lit("Summary "), F.col("o_custkey").cast("string"), F.when(F.col("o_orderkey") % 4 == 0, "\n<!-- SKELETON x -->").otherwise(""))
    log = F.concat(F.lit("# Log\n\n## [2.0.0]\nnew\n"), head, nl, body, F.lit("\n\n---\n\n## [1.1.0]\nold"))
    s = o.select(F.col("o_orderkey").alias("id"), notes.release_section(log, "1.2.0").alias("section"))
    return s.withColumn("blockers", F.when(F.col("section").isNotNull(), F.array_join(notes.release_blockers(F.col("section"), "SKELETON"), ",")))


@query("report_heads", "SELECT c_custkey AS id, 'Report ' || c_custkey AS title, CASE WHEN c_custkey % 3 <> 0 THEN '时间=' || c_mktsegment || ';源=x' ELSE '' END AS meta FROM customer")
def report_heads(spark, sf_dir):
    """Titles and tables at the head of reports."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    wide = F.when(F.col("c_custkey") % 3 == 0, "| y |").otherwise("")
    text = F.concat(F.lit("# Report "), F.col("c_custkey").cast("string"), F.lit("\n\n| 项 | 内容 |\n|---|---|\n| 时间 | "), F.col("c_mktsegment"), F.lit(" |"), wide, F.lit("\n| 源 | x |\n\nbody | no row"))
    h = notes.report_head(text)
    return c.select(F.col("c_custkey").alias("id"), h["title"].alias("title"), F.array_join(F.transform(h["meta"], lambda m: F.concat_ws("=", m["key"], m["value"])), ";").alias("meta"))


@query("skeleton_faults", """WITH f(fault, m, r) AS (VALUES ('no folder review', 2, 0), ('file topic/x.md', 3, 0), ('ignores data', 4, 0), ('trail made', 5, 0), ('placeholder in README.md', 3, 1), ('no field discipline', 4, 1))
    SELECT c_custkey AS project, fault FROM customer, f WHERE c_custkey % m = r""")  # fmt: skip
def skeleton_faults(spark, sf_dir):
    """Faults of project folders, six kinds of which are made."""
    k = F.col("c_custkey")
    folder = lambda p, keep=None: F.when(F.lit(True) if keep is None else keep, F.struct(F.lit(p).alias("path"), F.lit(True).alias("is_dir"), F.lit(None).cast("string").alias("text")))
    file = lambda p, text, keep=None: F.when(F.lit(True) if keep is None else keep, F.struct(F.lit(p).alias("path"), F.lit(False).alias("is_dir"), text.cast("string").alias("text")))
    yaml = F.concat(F.lit('created_by: "paper-init"\nuser_role: a\ncurrent_stage: c\ncitation_style: d\nlanguage_pref: e\n'), F.when(k % 4 == 1, "").otherwise("discipline: b\n"))
    made = F.array_compact(F.array(
        *[folder(p) for p in ("topic", "literature", "data", "analysis", "manuscript", "submission")], folder("review", k % 2 != 0), file("topic/x.md", F.lit("x"), k % 3 == 0), folder(".paper", k % 5 == 0), file(".git/config", F.lit("x")),
        file(".gitignore", F.concat(F.lit("literature/pdfs/\n"), F.when(k % 4 == 0, "data/\n").otherwise("# data\n"))), file("project.paper.yaml", yaml), file("README.md", F.when(k % 3 == 1, "<name>").otherwise("name")),
    ))
    listing = spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("project"), F.explode(made).alias("e")).select("project", "e.*")
    return notes.skeleton_faults(listing)


@query("flow_pictures", f"""{duck('v_ledger')}, c AS (SELECT count(*) FILTER (dedup = '保留' AND ta_screen = '进入全文' AND ft_screen = '纳入') AS n FROM v_ledger)
    SELECT 'n = ' || n AS included, 4 AS side_boxes, 9 AS boxes FROM c""")  # fmt: skip
def flow_pictures(spark, sf_dir):
    """The flow of the screening as pictures: what the last box says, and how many boxes there are."""
    led = view(spark, sf_dir, "v_ledger")
    p = reports.flow_pictures(S.stage_counts(led), S.exclusion_reasons(led))
    return p.select(F.regexp_extract("mermaid", r"纳入综述<br/>(n = \d+)", 1).alias("included"), F.regexp_count("mermaid", F.lit(r"--> G\d")).alias("side_boxes"), F.regexp_count("svg", F.lit("<rect")).alias("boxes"))


@query("report_blocks", f"""WITH p AS ({_PART}) SELECT id AS ref_id, '### ' || id || ' · ' || CASE k % 2 WHEN 0 THEN '✅ 已核实' ELSE '🔍 待人工核对' END AS head, k % 2 = 1 AS by_hand FROM p""")
def report_blocks(spark, sf_dir):
    """The heads of report blocks, and whether they say what to do by hand."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("ref_id"), F.when(F.col("p_size") % 2 == 0, "VERIFIED").otherwise("PENDING_MANUAL").alias("status"))
    b = reports.item_blocks(p)
    return b.select("ref_id", F.substring_index("block", "\n", 1).alias("head"), F.contains("block", F.lit("manual_result")).alias("by_hand"))


@query("payload_json", "SELECT n_nationkey AS n_nationkey, '{\"n_nationkey\":' || n_nationkey || ',\"gap\":null}' AS json FROM nation")
def payload_json(spark, sf_dir):
    """Rows as JSON, nulls told."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", F.lit(None).cast("string").alias("gap"))
    return reports.payload(n).select(F.get_json_object("json", "$.n_nationkey").cast("int").alias("n_nationkey"), "json")


@query("exact_ids", f"{duck('v_requests')} SELECT id, lower(replace(doi, 'https://doi.org/', '')) AS doi, CASE WHEN starts_with(lower(doi), '10.48550/') THEN replace(replace(lower(doi), '10.48550/', ''), 'arxiv.', '') END AS arxiv_id FROM v_requests")
def exact_ids(spark, sf_dir):
    """DOIs and the arXiv ids in them."""
    return view(spark, sf_dir, "v_requests").select("id", I.normalize_doi(F.col("doi")).alias("doi"), R.doi_to_arxiv_id(F.col("doi")).alias("arxiv_id"))


@query("scalar_rules", """SELECT o_orderkey AS id, CASE WHEN o_custkey % 3 = 0 THEN NULL WHEN o_custkey % 3 = 1 THEN '1998' ELSE '1998-0' || (1 + o_custkey % 9) || '-05' END AS day, o_custkey % 3 = 2 AS valid,
    CASE o_custkey % 3 WHEN 0 THEN 'ris' WHEN 1 THEN 'bibtex' END AS format FROM orders""")  # fmt: skip
def scalar_rules(spark, sf_dir):
    """Dates at the precision given, whether they are whole, and the format of a text."""
    k = F.col("o_custkey")
    parts = F.when(k % 3 == 1, F.array(F.lit(1998))).when(k % 3 == 2, F.array(F.lit(1998), (1 + k % 9).cast("int"), F.lit(5)))
    text = F.when(k % 3 == 0, "x\nTY  - JOUR").when(k % 3 == 1, "see @book {a").otherwise("张三. 标题[J].")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), I.date_parts_text(parts).alias("day"), E.detect_format(text).alias("format"))
    return o.withColumn("valid", I.valid_iso_date(F.col("day")))
