"""What each provider's answer says of a work, in one shape (HIT).

JSON is read by `from_json` and Atom by `from_xml`, with the fields that are used and no
others, so nothing else is decoded. Null means that the provider did not say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions import identifiers as I
from citeloom.functions import text as X
from citeloom.functions.jats import clean_jats, unescape

AUTHOR = "struct<name:string,orcid:string,affiliations:array<string>,orcid_verified:boolean>"
OA = "struct<status:string,url:string,url_kind:string,version:string,host:string,license:string>"
RETRACTION = "struct<type:string,label:string,date_parts:array<array<int>>,source:string,doi:string,notice_pmid:string>"
NOTICE = "struct<label:string,doi:string,pmid:string>"
#: A hit's fields and their types, in order.
HIT = {
    "title": "string", "authors": "array<string>", "year": "int", "date": "string", "venue": "string", "doi": "string", "type": "string",
    "cited_by_count": "bigint", "abstract": "string", "author_details": f"array<{AUTHOR}>", "oa": OA, "pubtypes": "array<string>",
    "expression_of_concern": NOTICE, "retraction": RETRACTION,
}

_CROSSREF = (
    "title array<string>, author array<struct<given:string,family:string,ORCID:string,`authenticated-orcid`:boolean,affiliation:array<struct<name:string>>>>, "
    "issued struct<`date-parts`:array<array<int>>>, `container-title` array<string>, DOI string, type string, `is-referenced-by-count` bigint, abstract string, "
    "`updated-by` array<struct<type:string,label:string,updated:struct<`date-parts`:array<array<int>>>,source:string,DOI:string>>"
)
_OPENALEX = (
    "id string, doi string, display_name string, publication_year int, type string, cited_by_count bigint, is_retracted boolean, abstract_inverted_index map<string,array<int>>, "
    "authorships array<struct<author:struct<display_name:string,orcid:string>,institutions:array<struct<display_name:string>>>>, "
    "primary_location struct<source:struct<display_name:string>>, open_access struct<oa_status:string,oa_url:string>, referenced_works array<string>, "
    "best_oa_location struct<pdf_url:string,landing_page_url:string,version:string,license:string,raw_type:string,source:struct<type:string>>"
)
_SCHOLAR = (
    "paperId string, title string, year int, venue string, externalIds struct<DOI:string>, authors array<struct<name:string>>, "
    "publicationTypes array<string>, citationCount bigint, abstract string"
)
_ERIC = "title string, author array<string>, publicationdateyear int, publication string, doi string, publicationtype array<string>"
_CSL = (
    "title string, author array<struct<given:string,family:string,literal:string>>, issued struct<`date-parts`:array<array<string>>>, "
    "`container-title` string, DOI string, type string, abstract string"
)
_SUMMARY = (
    "title string, authors array<struct<name:string>>, pubdate string, fulljournalname string, "
    "articleids array<struct<idtype:string,value:string>>, pubtype array<string>"
)
_ATOM = (
    "entry array<struct<id:string,title:string,summary:string,published:string,author:array<struct<name:string>>,doi:string,"
    "primary_category:struct<_term:string>,link:array<struct<_title:string,_href:string>>>>"
)
#: What a location's kind says of who holds the text.
HOSTS = {"repository": "repository", "journal": "publisher", "conference": "publisher", "book series": "publisher", "ebook platform": "publisher"}


def _shape(**given: Column) -> list[Column]:
    """HIT's columns, null where nothing is given."""
    unknown = set(given) - set(HIT)
    if unknown:
        raise ValueError(f"no fields of a hit: {sorted(unknown)}")
    return [given.get(n, F.lit(None)).cast(t).alias(n) for n, t in HIT.items()]


def oa_record(**given: Column | str | None) -> Column:
    """An open-access record with its six fields, null where nothing is given."""
    names = [f.split(":")[0] for f in OA[7:-1].split(",")]
    unknown = set(given) - set(names)
    if unknown:
        raise ValueError(f"no fields of an open-access record: {sorted(unknown)}")
    return F.struct(*[(x if isinstance(x := given.get(n), Column) else F.lit(x)).cast("string").alias(n) for n in names])


def _some(c: Column) -> Column:
    return I.blank_to_null(c)


def _doi(c: Column) -> Column:
    return _some(I.normalize_doi(c))


def _named(people: Column, name) -> Column:
    """Names of people, less the nameless."""
    return F.filter(F.transform(F.coalesce(people, F.array()), name), lambda n: n.isNotNull() & (n != ""))


def _details(people: Column, make, name) -> Column:
    """Marks of identity of the named people; an empty list if no one has any."""
    told = F.transform(F.filter(F.coalesce(people, F.array()), lambda p: name(p).isNotNull() & (name(p) != "")), make)
    held = F.exists(told, lambda d: d["orcid"].isNotNull() | (F.size(d["affiliations"]) > 0))
    return F.when(held, told).otherwise(F.array().cast(f"array<{AUTHOR}>"))


def _person(name: Column, orcid: Column, places: Column, verified: Column) -> Column:
    known = F.filter(F.coalesce(places, F.array().cast("array<string>")), lambda p: p.isNotNull() & (p != ""))
    return F.struct(name.alias("name"), I.normalize_orcid(orcid).alias("orcid"), known.alias("affiliations"), verified.cast("boolean").alias("orcid_verified"))


def _retracted(label: Column, source: Column, parts: Column | None = None, doi: Column | None = None, pmid: Column | None = None) -> Column:
    null = F.lit(None)
    fields = {"type": F.lit("retraction"), "label": label, "date_parts": parts, "source": source, "doi": doi, "notice_pmid": pmid}
    return F.struct(*[(null if c is None else c).alias(n) for n, c in fields.items()]).cast(RETRACTION)


def crossref(answers: DataFrame, payload: str = "payload") -> DataFrame:
    """Crossref works (the `message`, or an item of a list). A paper is retracted if it was
    updated *by* a retraction, not if it is one itself."""
    m = answers.withColumn("_m", F.from_json(payload, _CROSSREF))
    name = lambda a: F.concat_ws(" ", _some(a["given"]), _some(a["family"]))
    person = lambda a: _person(name(a), a["ORCID"], a["affiliation"]["name"], a["authenticated-orcid"])
    said = lambda u: F.lower(F.concat_ws(" ", F.coalesce(u["type"], F.lit("")), F.coalesce(u["label"], F.lit(""))))
    notice = F.get(F.filter("_m.updated-by", lambda u: F.contains(said(u), F.lit("retract"))), 0)
    hit = _shape(
        title=F.get("_m.title", 0), authors=F.transform(F.coalesce("_m.author", F.array()), name), year=F.get(F.get("_m.issued.date-parts", 0), 0),
        venue=F.get("_m.container-title", 0), doi=_doi(F.col("_m.DOI")), type=F.col("_m.type"), cited_by_count=F.col("_m.is-referenced-by-count"),
        abstract=clean_jats("_m.abstract"), author_details=_details(F.col("_m.author"), person, name),
        retraction=F.when(notice.isNotNull(), _retracted(notice["label"], notice["source"], notice["updated"]["date-parts"], notice["DOI"])),
    )
    return m.select(*answers.columns, *hit)


def openalex(answers: DataFrame, payload: str = "payload") -> DataFrame:
    """OpenAlex works. A link is the PDF, else the landing page, else one of unknown kind."""
    w = answers.withColumn("_w", F.from_json(payload, _OPENALEX))
    name = lambda a: a["author"]["display_name"]
    person = lambda a: _person(name(a), a["author"]["orcid"], a["institutions"]["display_name"], F.lit(None))
    pdf, landing, other = _some(F.col("_w.best_oa_location.pdf_url")), _some(F.col("_w.best_oa_location.landing_page_url")), _some(F.col("_w.open_access.oa_url"))
    host = I.lookup(F.lower(F.trim(F.coalesce("_w.best_oa_location.source.type", "_w.best_oa_location.raw_type"))), HOSTS)
    oa = oa_record(
        status=F.col("_w.open_access.oa_status"), url=F.coalesce(pdf, landing, other), version=F.col("_w.best_oa_location.version"), host=host,
        license=F.col("_w.best_oa_location.license"), url_kind=F.when(pdf.isNotNull(), "pdf").when(landing.isNotNull(), "landing"),
    )
    hit = _shape(
        title=F.col("_w.display_name"), authors=_named(F.col("_w.authorships"), name), year=F.col("_w.publication_year"),
        venue=F.col("_w.primary_location.source.display_name"), doi=_doi(F.col("_w.doi")), type=F.col("_w.type"), cited_by_count=F.col("_w.cited_by_count"),
        abstract=X.restore_abstract(F.col("_w.abstract_inverted_index")), author_details=_details(F.col("_w.authorships"), person, name),
        oa=F.when(F.col("_w.open_access").isNotNull() | F.col("_w.best_oa_location").isNotNull(), oa),
        retraction=F.when(F.col("_w.is_retracted"), _retracted(F.lit("Retraction"), F.lit("openalex"))),
    )
    return w.select(*answers.columns, *hit)


def semantic_scholar(answers: DataFrame, payload: str = "payload") -> DataFrame:
    """Semantic Scholar papers."""
    p = answers.withColumn("_p", F.from_json(payload, _SCHOLAR))
    hit = _shape(
        title=F.col("_p.title"), authors=_named(F.col("_p.authors"), lambda a: a["name"]), year=F.col("_p.year"), venue=_some(F.col("_p.venue")),
        doi=_doi(F.col("_p.externalIds.DOI")), type=F.get("_p.publicationTypes", 0), cited_by_count=F.col("_p.citationCount"), abstract=_some(F.col("_p.abstract")),
    )
    return p.select(*answers.columns, *hit)


def eric(answers: DataFrame, payload: str = "payload") -> DataFrame:
    """ERIC records."""
    d = answers.withColumn("_d", F.from_json(payload, _ERIC))
    hit = _shape(
        title=F.col("_d.title"), authors=F.coalesce("_d.author", F.array()), year=F.col("_d.publicationdateyear"), venue=F.col("_d.publication"),
        doi=_doi(F.col("_d.doi")), type=F.get("_d.publicationtype", 0),
    )
    return d.select(*answers.columns, *hit)


def _first_text(c: Column) -> Column:
    """A text, or the first of a list of texts, as JSON gives it."""
    return F.when(c.startswith("["), F.get(F.from_json(c, "array<string>"), 0)).otherwise(c)


def doi_meta(answers: DataFrame, payload: str = "payload") -> DataFrame:
    """Records of content negotiation (CSL): names may be whole in one field, a year may be a text."""
    d = answers.withColumn("_d", F.from_json(payload, _CSL))
    name = lambda a: F.coalesce(_some(F.trim(a["literal"])), _some(F.concat_ws(" ", _some(F.trim(a["given"])), _some(F.trim(a["family"])))))
    year = F.trim(F.get(F.get("_d.issued.date-parts", 0), 0))
    # escapes are read in the joined names, one call for a record
    names = F.split(unescape(F.array_join(_named(F.col("_d.author"), name), "\u0001")), "\u0001")
    hit = _shape(
        title=unescape(_first_text(F.col("_d.title"))), authors=F.coalesce(names, F.array()), year=F.when(year.rlike("^[0-9]+$"), year.try_cast("int")),
        venue=unescape(_first_text(F.col("_d.container-title"))), doi=_doi(F.col("_d.DOI")), type=F.col("_d.type"), abstract=clean_jats("_d.abstract"),
        author_details=F.array(),
    )
    return d.select(*answers.columns, *hit)


def atom_entries(answers: DataFrame, payload: str = "payload") -> DataFrame:
    """The entries of Atom feeds, a row each (`e`), in order (`place`)."""
    feed = F.from_xml(F.col(payload), F.lit(_ATOM), {"ignoreNamespace": "true", "mode": "PERMISSIVE"})
    return answers.select("*", F.posexplode(feed["entry"]).alias("place", "e"))


def arxiv_id(url: Column) -> Column:
    """`…/abs/1706.03762v5` to `1706.03762`."""
    bare = F.element_at(F.split(F.regexp_replace(F.trim(url), "/+$", ""), "/abs/"), -1)
    return F.substring_index(bare, "v", 1)


def arxiv(answers: DataFrame, payload: str = "payload") -> DataFrame:
    """arXiv entries: preprints, always open, of a version that no one has reviewed."""
    e = atom_entries(answers, payload)
    day = F.substring(F.trim("e.published"), 1, 10)
    pdf = F.get(F.filter("e.link", lambda x: (F.lower(F.trim(x["_title"])) == "pdf") & x["_href"].isNotNull()), 0)["_href"]
    page = _some(F.trim("e.id"))
    oa = oa_record(status="green", host="preprint", version="submittedVersion", url=F.coalesce(pdf, page), url_kind=F.when(pdf.isNotNull(), "pdf").when(page.isNotNull(), "landing"))
    hit = _shape(
        title=F.trim("e.title"), authors=_named(F.col("e.author"), lambda a: F.trim(a["name"])), year=F.when(day.rlike("^[0-9]{4}"), F.substring(day, 1, 4)),
        date=F.when(day.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), day), doi=_doi(F.trim("e.doi")), type=F.lit("preprint"),
        abstract=_some(X.folded(F.col("e.summary"))), oa=oa,
    )
    return e.select(*answers.columns, "place", arxiv_id(F.col("e.id")).alias("arxiv_id"), F.col("e.primary_category._term").alias("category"), *hit)


# -- PubMed: summaries are JSON, abstracts and notices are in another answer's XML -------
def _entities(c: Column) -> Column:
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(sign))
    return c


def _flat(c: Column) -> Column:
    return X.folded(_entities(F.regexp_replace(c, "<[^>]*>", "")))


def _notice(c: Column) -> Column:
    """A notice's source as it stands, its DOI and its own id."""
    label = _some(_flat(F.regexp_extract(c, r"(?s)<RefSource[^>]*>(.*?)</RefSource>", 1)))
    doi = F.regexp_replace(_some(F.regexp_extract(label, r"(?i)\bdoi:\s*(10\.[^\s;]+)", 1)), "[.,;:)]+$", "")
    return F.struct(label.alias("label"), _doi(doi).alias("doi"), _some(F.trim(F.regexp_extract(c, r"(?s)<PMID[^>]*>(.*?)</PMID>", 1))).alias("pmid"))


def pubmed_details(answers: DataFrame, payload: str = "payload") -> DataFrame:
    """(uid, abstract, retraction_in, concern_in) of each article of fetched XML.

    Only notices *in* which the article was retracted or doubted count, the first of each;
    not those that it is itself. What is no XML gives no rows.
    """
    broken = F.from_xml(F.col(payload), F.lit("_none string, _broken string"), {"columnNameOfCorruptRecord": "_broken", "mode": "PERMISSIVE"})["_broken"]
    whole = answers.filter(broken.isNull() & F.col(payload).rlike(r"</[\w:.-]+>\s*\z"))
    a = whole.select(F.explode(F.regexp_extract_all(F.col(payload), F.lit(r"(?s)(<PubmedArticle[ >].*?</PubmedArticle>)"), 1)).alias("a"))
    cited = F.regexp_extract("a", r"(?s)(<MedlineCitation[ >].*?</MedlineCitation>)", 1)
    uid = _some(F.trim(F.regexp_extract(F.regexp_replace(cited, r"(?s)<CommentsCorrections[ >].*?</CommentsCorrections>", ""), r"(?s)<PMID[^>]*>(.*?)</PMID>", 1)))
    heads = F.regexp_extract_all(cited, F.lit(r"(?s)<AbstractText((?:\s[^>]*)?)>(.*?)</AbstractText>"), 1)
    bodies = F.regexp_extract_all(cited, F.lit(r"(?s)<AbstractText((?:\s[^>]*)?)>(.*?)</AbstractText>"), 2)
    label = lambda h: F.trim(F.coalesce(_some(F.regexp_extract(h, r'\sLabel="([^"]*)"', 1)), F.regexp_extract(h, r'\sNlmCategory="([^"]*)"', 1)))
    parts = F.zip_with(heads, bodies, lambda h, b: F.when(_flat(b) != "", F.concat(F.when(label(h) != "", F.concat(_entities(label(h)), F.lit(": "))).otherwise(""), _flat(b))))
    notice = lambda kind: F.get(F.regexp_extract_all(cited, F.lit(rf'(?s)(<CommentsCorrections\s[^>]*RefType="{kind}"[^>]*>.*?</CommentsCorrections>)'), 1), 0)
    found = {n: F.when(notice(k).isNotNull(), _notice(notice(k))) for n, k in (("retraction_in", "RetractionIn"), ("concern_in", "ExpressionOfConcernIn"))}
    return a.select(uid.alias("uid"), _some(F.array_join(F.array_compact(parts), " ")).alias("abstract"), *[c.alias(n) for n, c in found.items()]).filter("uid IS NOT NULL")


def pubmed(summaries: DataFrame, details: DataFrame, payload: str = "payload") -> DataFrame:
    """PubMed summaries, one for each uid of an answer, with what `details` says of them.

    A paper is retracted if its types or a notice say so. A doubt is kept apart: it is no
    retraction. `details` may be empty: the types alone are told by the summary.
    """
    docs = F.map_entries(F.map_filter(F.from_json(payload, "result map<string,string>")["result"], lambda k, _: k != "uids"))
    d = summaries.withColumn("_e", F.explode(docs)).withColumns({"uid": F.col("_e.key"), "_d": F.from_json("_e.value", _SUMMARY)})
    d = d.join(details.select("uid", F.struct("abstract", "retraction_in", "concern_in").alias("_x")), "uid", "left")
    ids = lambda kind: F.get(F.transform(F.filter("_d.articleids", lambda a: (a["idtype"] == kind) & (F.trim(a["value"]) != "")), lambda a: F.trim(a["value"])), 0)
    flagged = F.exists(F.coalesce("_d.pubtype", F.array()), lambda t: F.lower(F.trim(t)) == "retracted publication")
    notice = F.col("_x.retraction_in")
    pmc = ids("pmc")
    year = F.regexp_extract(F.col("_d.pubdate"), "^[0-9]{4}", 0)
    hit = _shape(
        title=F.col("_d.title"), authors=_named(F.col("_d.authors"), lambda a: a["name"]), year=_some(year), venue=F.col("_d.fulljournalname"), doi=_doi(ids("doi")),
        type=F.get("_d.pubtype", 0), pubtypes=F.coalesce("_d.pubtype", F.array()), abstract=F.col("_x.abstract"), expression_of_concern=F.col("_x.concern_in"),
        oa=F.when(pmc.isNotNull(), oa_record(status="green", host="pmc", url_kind="landing", url=F.concat(F.lit("https://pmc.ncbi.nlm.nih.gov/articles/"), pmc, F.lit("/")))),
        retraction=F.when(flagged | notice.isNotNull(), _retracted(F.coalesce(notice["label"], F.lit("Retracted Publication")), F.lit("pubmed"), doi=notice["doi"], pmid=notice["pmid"])),
    )
    return d.select(*summaries.columns, "uid", *hit)


# -- pages of several works, edges and people -----------------------------------------------
def items(answers: DataFrame, path: str, payload: str = "payload") -> DataFrame:
    """The works of an answer's list, a row each: `path` names the list (as message.items)."""
    fields = path.split(".")
    ddl = "array<string>"
    for f in reversed(fields):
        ddl = f"struct<{f}:{ddl}>"
    listed = F.from_json(payload, ddl)
    for f in fields:
        listed = listed[f]
    kept = [c for c in answers.columns if c != payload]
    return answers.select(*kept, F.posexplode(listed).alias("place", payload))


def referenced(answers: DataFrame, most: int = 50, payload: str = "payload") -> DataFrame:
    """(place, work_id) of the works that an OpenAlex work cites, the first `most`."""
    ids = F.filter(F.transform(F.from_json(payload, _OPENALEX)["referenced_works"], I.short_id), lambda i: i != "")
    kept = [c for c in answers.columns if c != payload]
    return answers.select(*kept, F.posexplode(F.slice(ids, 1, max(1, most))).alias("place", "work_id"))


def edge_papers(answers: DataFrame, field: str, payload: str = "payload") -> DataFrame:
    """The papers at the other end of Semantic Scholar edges (`citedPaper`, `citingPaper`); ends without a title go."""
    edges = items(answers, "data", payload)
    paper = F.get_json_object(payload, f"$.{field}")
    return edges.withColumn(payload, paper).filter(_some(F.get_json_object(payload, "$.title")).isNotNull())


def author_candidates(answers: DataFrame, queried: Column, payload: str = "payload") -> DataFrame:
    """OpenAlex authors as candidates: no one is merged, and whether the name is the one asked for is told."""
    ddl = (
        "struct<id:string,display_name:string,orcid:string,works_count:bigint,display_name_alternatives:array<string>,topics:array<struct<display_name:string>>,"
        "affiliations:array<struct<institution:struct<display_name:string>,years:array<int>>>>"
    )
    a = answers.withColumn("_a", F.from_json(payload, ddl))
    held = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
    places = F.transform(F.filter(F.coalesce("_a.affiliations", F.array()), lambda x: F.coalesce(x["institution"]["display_name"], F.lit("")) != ""), lambda x: F.struct(x["institution"]["display_name"].alias("name"), F.coalesce(x["years"], F.array().cast("array<int>")).alias("years")))
    name = F.coalesce("_a.display_name", F.lit(""))
    return a.select(
        *[c for c in answers.columns if c != payload], F.lit("openalex").alias("source"), name.alias("name"), F.filter(F.array(I.short_id(F.col("_a.id"))), lambda i: i.isNotNull() & (i != "")).alias("entity_ids"),
        I.normalize_orcid(F.col("_a.orcid")).alias("orcid"), F.coalesce("_a.works_count", F.lit(0)).alias("works_count"), places.alias("affiliations"),
        held(F.col("_a.topics")["display_name"]).alias("topics"), held(F.col("_a.display_name_alternatives")).alias("name_variants"),
        (F.lower(F.trim(name)) == F.lower(F.trim(queried))).alias("exact_name_match"),
    )
