"""What is asked of the providers: URLs, filter parameters and cache keys, as column expressions.

A request is a row (query, doi, title, year_from, year_to, type, date_from, date_to, per_source);
the predicates that a provider can apply itself go into its URL, the others are applied to
what it answers (`operators.works.postfilter`).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeloom.functions import identifiers as I
from citeloom.model import dims

#: Schema version of cached Semantic Scholar answers: another field list is another key.
SCHOLAR_VERSION = "f2"
#: Ends of a day window that is open at one side.
FLOOR, CEILING = "19900101", "20991231"


def quoted(c: Column, keep: str = "/") -> Column:
    """Percent-encoded; signs in `keep` stay."""
    out = F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    for sign in keep:
        out = F.replace(out, F.lit(f"%{ord(sign):02X}"), F.lit(sign))
    return out


def _native_type(source: str, kind: Column) -> Column:
    return I.lookup(kind, dims.NATIVE_TYPE.get(source, {"": ""}))


def _joined(parts: list[Column], head: str, keep: str) -> Column:
    text = F.concat_ws(",", *parts)
    return F.when(text != "", F.concat(F.lit(head), quoted(text, keep))).otherwise("")


def crossref_filters(year_from: Column, year_to: Column, kind: Column) -> Column:
    parts = [F.concat(F.lit("from-pub-date:"), year_from.cast("string"), F.lit("-01-01")), F.concat(F.lit("until-pub-date:"), year_to.cast("string"), F.lit("-12-31")), F.concat(F.lit("type:"), _native_type("crossref", kind))]
    return _joined(parts, "&filter=", ":,-")


def openalex_filters(year_from: Column, year_to: Column, kind: Column) -> Column:
    parts = [F.concat(F.lit("from_publication_date:"), year_from.cast("string"), F.lit("-01-01")), F.concat(F.lit("to_publication_date:"), year_to.cast("string"), F.lit("-12-31")), F.concat(F.lit("type:"), _native_type("openalex", kind))]
    return _joined(parts, "&filter=", ":,-_")


def scholar_filters(year_from: Column, year_to: Column, kind: Column) -> Column:
    years = F.when(year_from.isNotNull() | year_to.isNotNull(), F.concat(F.lit("&year="), F.coalesce(year_from.cast("string"), F.lit("")), F.lit("-"), F.coalesce(year_to.cast("string"), F.lit(""))))
    return F.concat_ws("", years, F.concat(F.lit("&publicationTypes="), _native_type("semantic_scholar", kind)))


def usable_terms(query: Column) -> Column:
    """Words of a query, less the signs that would break an expression."""
    words = F.transform(F.split(F.trim(F.regexp_replace(query, r"\s+", " ")), " "), lambda w: F.regexp_replace(w, r'[:()"]', ""))
    return F.filter(words, lambda w: w != "")


def all_words(query: Column) -> Column:
    """`(all:a AND all:b)`: every word must occur; without a word, the phrase."""
    terms = F.transform(usable_terms(query), lambda w: F.concat(F.lit("all:"), w))
    phrase = F.concat(F.lit('all:"'), F.trim(F.regexp_replace(query, r'[:()"]', "")), F.lit('"'))
    return F.when(F.size(terms) > 0, F.concat(F.lit("("), F.array_join(terms, " AND "), F.lit(")"))).otherwise(phrase)


def day_window(date_from: Column, date_to: Column) -> Column:
    """`[YYYYMMDD0000 TO YYYYMMDD2359]`, or null without a bound."""
    day = lambda c, other: F.coalesce(F.replace(c, F.lit("-"), F.lit("")), F.lit(other))
    made = F.concat(F.lit("["), day(date_from, FLOOR), F.lit("0000 TO "), day(date_to, CEILING), F.lit("2359]"))
    return F.when(date_from.isNotNull() | date_to.isNotNull(), made)


def arxiv_query(query: Column, date_from: Column, date_to: Column, limit: Column) -> Column:
    """Without a window by relevance; with one every word, within it, the latest first."""
    window = day_window(date_from, date_to)
    plain = F.concat(F.lit("search_query=all:"), quoted(query), F.lit("&max_results="), limit.cast("string"))
    dated = F.concat(F.lit("search_query="), quoted(F.concat(all_words(query), F.lit(" AND submittedDate:"), window)), F.lit("&max_results="), limit.cast("string"), F.lit("&sortBy=submittedDate&sortOrder=descending"))
    return F.when(window.isNull(), plain).otherwise(dated)


def search_key(query: Column, limit: Column, year_from: Column, year_to: Column, kind: Column, date_from: Column, date_to: Column) -> Column:
    """The cache key of a search; filters are in it if there are any, a window only if there is one."""
    told = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    base = F.concat(F.lit("search:"), F.lower(query), F.lit(":"), limit.cast("string"))
    window = F.when(date_from.isNotNull() | date_to.isNotNull(), F.concat(F.lit(":d="), told(date_from), F.lit("-"), told(date_to)))
    filtered = F.coalesce(year_from.cast("string"), year_to.cast("string"), kind, date_from, date_to).isNotNull()
    return F.when(filtered, F.concat_ws("", F.concat(base, F.lit(":f="), told(year_from), F.lit("-"), told(year_to), F.lit("-"), told(kind)), window)).otherwise(base)


def doi_key(source: Column, doi: Column) -> Column:
    """The cache key of a lookup by DOI; arXiv is asked for its own id."""
    d = I.normalize_doi(doi)
    plain = F.concat(F.lit("doi:"), d)
    return F.when(source == "semantic_scholar", F.concat(plain, F.lit(f":{SCHOLAR_VERSION}"))).when(source == "arxiv", F.concat(F.lit("arxiv_id:"), doi_to_arxiv_id(d))).when(source == "pubmed", F.concat(F.lit("esearch:"), d)).otherwise(plain)


def match_key(source: Column, title: Column, limit: int = 5) -> Column:
    """The cache key of a match by title."""
    plain = F.concat(F.lit("match:"), F.lower(title), F.lit(f":{limit}"))
    return F.when(source == "semantic_scholar", F.concat(plain, F.lit(f":{SCHOLAR_VERSION}"))).when(source == "eric", F.concat(F.lit("search:"), F.lower(title), F.lit(f":{limit}"))).otherwise(plain)


def doi_to_arxiv_id(doi: Column) -> Column:
    """What a DataCite DOI of arXiv says behind `arxiv.` or `arxiv:`; null for other prefixes."""
    rest = F.regexp_extract(I.normalize_doi(doi), r"^10\.48550/(.*)$", 1)
    return I.blank_to_null(F.regexp_replace(rest, r"^.*?arxiv[.:]", ""))


def doi_url(source: Column, base: Column, doi: Column) -> Column:
    """Where a DOI is looked up."""
    d = I.normalize_doi(doi)
    return (
        F.when(source == "crossref", F.concat(base, F.lit("/works/"), quoted(d, "")))
        .when(source == "openalex", F.concat(base, F.lit("/works/doi:"), quoted(d)))
        .when(source == "semantic_scholar", F.concat(base, F.lit("/graph/v1/paper/DOI:"), quoted(d)))
        .when(source == "arxiv", F.concat(base, F.lit("/query?id_list="), quoted(doi_to_arxiv_id(d)), F.lit("&max_results=1")))
        .when(source == "pubmed", F.concat(base, F.lit("/esearch.fcgi?db=pubmed&term="), d, F.lit("[doi]&retmode=json&retmax=1")))
        .when(source == "doi_meta", F.concat(base, F.lit("/"), quoted(d)))
    )


#: What Semantic Scholar is asked to say of a paper (fixed values; another list is another SCHOLAR_VERSION).
SCHOLAR_FIELDS = "title,authors,year,venue,externalIds,publicationTypes,citationCount,abstract"


def match_url(source: Column, base: Column, title: Column, limit: int = 5) -> Column:
    """Where a title is matched; the provider ranks, and at most `limit` answers come."""
    q, n = quoted(title), str(limit)
    tail = lambda head, *rest: F.concat(base, F.lit(head), q, *map(F.lit, rest))
    return (
        F.when(source == "crossref", tail("/works?query.bibliographic=", "&rows=", n))
        .when(source == "openalex", tail("/works?filter=title.search:", "&per-page=", n))
        .when(source == "semantic_scholar", tail("/graph/v1/paper/search?query=", "&limit=", n, "&fields=", SCHOLAR_FIELDS))
        .when(source == "arxiv", tail("/query?search_query=ti:", "&max_results=", n))
        .when(source == "pubmed", tail("/esearch.fcgi?db=pubmed&term=", "&retmode=json&retmax=", n))
        .when(source == "eric", tail("/?search=", "&format=json&rows=", n))
    )


def search_url(source: Column, base: Column, query: Column, limit: Column, year_from: Column, year_to: Column, kind: Column, date_from: Column, date_to: Column) -> Column:
    """Where a keyword search is sent, with the filters that its provider applies itself."""
    q, n = quoted(query), limit.cast("string")
    years = (year_from, year_to, kind)
    return (
        F.when(source == "crossref", F.concat(base, F.lit("/works?query="), q, F.lit("&rows="), n, crossref_filters(*years)))
        .when(source == "openalex", F.concat(base, F.lit("/works?search="), q, F.lit("&per-page="), n, openalex_filters(*years)))
        .when(source == "semantic_scholar", F.concat(base, F.lit("/graph/v1/paper/search?query="), q, F.lit("&limit="), n, F.lit(f"&fields={SCHOLAR_FIELDS}"), scholar_filters(*years)))
        .when(source == "arxiv", F.concat(base, F.lit("/query?"), arxiv_query(query, date_from, date_to, limit)))
        .when(source == "pubmed", F.concat(base, F.lit("/esearch.fcgi?db=pubmed&term="), q, F.lit("&retmode=json&retmax="), n))
        .when(source == "eric", F.concat(base, F.lit("/?search="), q, F.lit("&format=json&rows="), n))
    )


def ids_url(source: Column, base: Column, ids: Column, what: Column) -> Column:
    """Where many records are fetched at once: OpenAlex works, PubMed summaries or articles (`what`)."""
    return (
        F.when(source == "openalex", F.concat(base, F.lit("/works?filter=openalex_id:"), F.array_join(ids, "|"), F.lit("&per-page="), F.size(ids).cast("string")))
        .when(what == "summary", F.concat(base, F.lit("/esummary.fcgi?db=pubmed&id="), F.array_join(ids, ","), F.lit("&retmode=json")))
        .when(what == "article", F.concat(base, F.lit("/efetch.fcgi?db=pubmed&id="), F.array_join(ids, ","), F.lit("&retmode=xml")))
    )


def applied_filters(source: Column, filtered: Column) -> Column:
    """Who applied the filters: no one, the provider, or we."""
    return F.when(~filtered, "none").when(source.isin(*dims.NATIVE_YEAR), "native").otherwise("client_side")
