"""Citation verification: routes, best hits, field notes, the rule cascade and its roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions import identifiers as I
from citeloom.functions import references as R
from citeloom.functions import text as X
from citeloom.model import dims

NETWORK_ERRORS = ("TIMEOUT", "CONN_FAILED", "DNS_FAIL")


def agencies(prefixes: DataFrame, answers: DataFrame) -> DataFrame:
    """(prefix, doi_ra) of DOI prefixes by the registry's answers (prefix, agency, error).

    No answer, or one without an agency, is an unregistered prefix; a failed call is
    `ra_unreachable`, which says nothing of the prefix; agencies without a route of
    their own are `unknown`.
    """
    told = answers.groupBy("prefix").agg(F.max("agency").alias("agency"), F.max("error").alias("error"))
    known = F.col("agency").isin(*dims.AGENCY_ROUTES)
    ra = F.when(F.col("agency").isNotNull(), F.when(known, F.col("agency")).otherwise("unknown")).when(F.col("error").isNotNull(), "ra_unreachable").otherwise("not_registered")
    return prefixes.select("prefix").distinct().join(told, "prefix", "left").select("prefix", ra.alias("doi_ra"))


def with_agency(refs: DataFrame, answers: DataFrame) -> DataFrame:
    """References with the agency of their DOI's prefix, looked up once for a prefix."""
    keyed = refs.withColumn("prefix", I.blank_to_null(I.doi_prefix(F.col("doi"))))
    return keyed.join(agencies(keyed.filter("prefix IS NOT NULL"), answers), "prefix", "left")


def route(refs: DataFrame) -> DataFrame:
    """Each reference to the sources that can hold it; an unregistered prefix to none."""
    routes = F.create_map(*[x for k, v in dims.AGENCY_ROUTES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    fallback = F.array(*map(F.lit, dims.FALLBACK_ROUTE))
    has_doi = I.blank_to_null(I.normalize_doi(F.col("doi"))).isNotNull()
    way = F.when(has_doi & (F.col("doi_ra") == "not_registered"), F.array().cast("array<string>"))
    way = way.when(has_doi, F.coalesce(F.try_element_at(routes, F.col("doi_ra")), fallback)).otherwise(fallback)
    return refs.withColumn("sources", way)


def tasks(routed: DataFrame) -> DataFrame:
    """A row for each reference and source it is sent to, in the order of its route."""
    return routed.select("ref_id", "doi", "title", F.posexplode("sources").alias("place", "source"))


def outcomes(asked: DataFrame, by_doi: DataFrame, by_title: DataFrame) -> DataFrame:
    """What came of each task: a source that looks DOIs up is asked for a DOI if there is one,
    any other for the title, whose first answer counts.

    `by_doi` (source, doi, hit, error) and `by_title` (source, title, place, hit, error) are
    answers; a missing answer is a miss, a failed call an error, and those differ.
    """
    lookers = [s for s, _, _, can, _ in dims.SOURCES if "lookup_doi" in can]
    doi, title = I.blank_to_null(I.normalize_doi(F.col("doi"))), I.blank_to_null(F.col("title"))
    t = asked.withColumns({"_doi": F.when(F.col("source").isin(*lookers), doi), "_title": F.lower(title)})
    d = by_doi.select("source", I.normalize_doi(F.col("doi")).alias("_doi"), F.struct("hit", "error").alias("d"))
    first = by_title.groupBy("source", F.lower("title").alias("_title")).agg(F.min_by(F.struct("hit", "error"), "place").alias("t"))
    j = t.join(d, ["source", "_doi"], "left").join(first, ["source", "_title"], "left")
    answer = F.when(F.col("_doi").isNotNull(), F.col("d")).otherwise(F.col("t"))
    said = F.when(answer["error"].isNotNull(), "error").when(answer["hit"].isNotNull(), "hit").otherwise("miss")
    kind = F.when(doi.isNotNull(), "doi").otherwise("title_match")
    return j.select("ref_id", "place", "source", kind.alias("query_kind"), said.alias("outcome"), answer["error"].alias("error"), F.when(said == "hit", answer["hit"]).alias("hit"))


#: Notes that make a mismatch, in their order; a venue that differs is a hint only.
MISMATCH = ("doi", "year", "title", "first_author")


def compared(refs: DataFrame, hits: DataFrame) -> DataFrame:
    """References joined with their hits, and how well each agrees, field by field where both
    sides have it. The first authors' family names differ only if no reading of them is shared."""
    r = refs.select("ref_id", *[F.col(c).alias(f"r_{c}") for c in ("doi", "title", "year", "venue", "authors")])
    j = r.join(hits, "ref_id")
    rd, hd = I.blank_to_null(I.normalize_doi(F.col("r_doi"))), I.blank_to_null(I.normalize_doi(F.col("doi")))
    rv, hv = I.blank_to_null(X.normalize_str(F.col("r_venue"))), I.blank_to_null(X.normalize_str(F.col("venue")))
    both = I.blank_to_null(F.col("r_title")).isNotNull() & I.blank_to_null(F.col("title")).isNotNull()
    j = j.withColumns({"doi_equal": F.coalesce(rd == hd, F.lit(False)), "overlap": X.title_overlap(F.col("r_title"), F.col("title"))})
    flag = lambda c: F.coalesce(c, F.lit(False))
    return j.withColumns({
        "doi_differs": flag(rd != hd),
        "year_differs": flag((F.abs(F.col("r_year") - F.col("year")) >= 2) & (F.col("r_year") != 0) & (F.col("year") != 0)),
        "title_differs": flag(both & (F.col("overlap") < 0.8)),
        "first_author_differs": first_author_differs(F.col("r_authors"), F.col("authors")),
        "venue_hint": flag(~(F.contains(rv, hv) | F.contains(hv, rv))),
    })


def first_author_differs(ref_authors: Column, hit_authors: Column) -> Column:
    """True if both sides name a first author and no family name of theirs is shared."""
    a, b = (X.surname_candidates(F.get(c, 0)) for c in (ref_authors, hit_authors))
    return F.coalesce((F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b), F.lit(False))


def best_hits(pairs: DataFrame) -> DataFrame:
    """Of a reference's hits: the first of an equal DOI, else the first of the most overlap.

    An aggregate, not a window: it combines before the shuffle, so a reference
    with very many hits costs one row a task.
    """
    order = F.struct((~F.col("doi_equal")).cast("int"), F.when(F.col("doi_equal") | F.col("r_title").isNull(), 0.0).otherwise(-F.col("overlap")), F.col("ord"))
    dated = F.struct((~F.col("retraction_dated")).cast("int"), F.col("ord"))
    return pairs.groupBy("ref_id").agg(
        F.min_by(F.struct(*[c for c in pairs.columns if c != "ref_id"]), order).alias("b"),
        F.bool_or("retracted").alias("any_retracted"), F.count(F.lit(1)).alias("n_hits"),
        F.min_by(F.when(F.col("retracted"), F.col("source")), F.when(F.col("retracted"), dated)).alias("retraction_by"),
        F.array_sort(F.collect_set(F.when(F.col("retracted"), F.col("source")))).alias("retracted_in"),
        F.array_sort(F.collect_set("source")).alias("found_in"),
    ).select("ref_id", "any_retracted", "n_hits", "retraction_by", "retracted_in", "found_in", "b.*")


def mismatches(differs: list[Column]) -> Column:
    """The fields that do not agree, in the order of MISMATCH."""
    return F.array_join(F.array_compact(F.array(*[F.when(c, n) for n, c in zip(MISMATCH, differs)])), ",")


def judge(refs: DataFrame, hits: DataFrame, queries: DataFrame) -> DataFrame:
    """The state of each reference by the first rule that holds; a miss is no error.

    `hits` may lack `authors` and `retraction_dated`. `told_by` names what the state rests
    on: the sources it was found in, or the source whose notice of retraction has a date.
    """
    for name, kind in (("authors", "array<string>"), ("retraction_dated", "boolean")):
        if name not in hits.columns:
            hits = hits.withColumn(name, F.lit(None).cast(kind) if name == "authors" else F.lit(False))
    refs_ = refs if "authors" in refs.columns else refs.withColumn("authors", F.lit(None).cast("array<string>"))
    best = best_hits(compared(refs_, hits)).select("ref_id", "any_retracted", "n_hits", "retraction_by", "retracted_in", "found_in", *[f"{n}_differs" for n in MISMATCH], "venue_hint")
    failed = queries.groupBy("ref_id").agg(F.bool_or(F.col("outcome") == "error").alias("any_error"))
    j = refs_.join(best, "ref_id", "left").join(failed, "ref_id", "left")
    no_doi, no_hits = F.col("doi").isNull() | (F.col("doi") == ""), F.col("n_hits").isNull()
    mismatch = F.greatest(*[F.col(f"{n}_differs") for n in MISMATCH])
    status = (
        F.when(F.col("manual_verified"), "VERIFIED")
        .when(F.col("parse_status") == "unparsed", "PENDING_MANUAL")
        .when(F.col("doi_ra").isin(*dims.CHINESE_AGENCIES) & no_hits, "PENDING_MANUAL")
        .when(no_doi & F.col("title").rlike("[一-鿿]"), "PENDING_MANUAL")
        .when(F.col("doi_ra") == "not_registered", "NOT_FOUND")
        .when(F.col("any_retracted"), "RETRACTED")
        .when(~no_hits & mismatch, "METADATA_MISMATCH")
        .when(~no_hits, "VERIFIED")
        .when(F.col("any_error"), "UNVERIFIED")
        .when(~no_doi & F.col("doi_ra").isin("Crossref", "DataCite"), "NOT_FOUND")
        .otherwise("PENDING_MANUAL")
    )
    told = F.when(status == "RETRACTED", F.col("retraction_by")).when(status.isin("VERIFIED", "METADATA_MISMATCH"), F.array_join("found_in", ","))
    notes = F.when(status == "METADATA_MISMATCH", mismatches([F.col(f"{n}_differs") for n in MISMATCH])).otherwise("")
    return j.select("ref_id", status.alias("status"), notes.alias("mismatches"), F.coalesce(told, F.lit("")).alias("told_by"))


def lookup_notes(refs: DataFrame, hits: DataFrame) -> DataFrame:
    """What a lookup by DOI can say of each reference: found or not, whether what is at hand
    agrees (null where nothing is compared), and how strong the evidence is.

    No state is judged here: a miss is never "not found".
    """
    refs_ = refs if "authors" in refs.columns else refs.withColumn("authors", F.lit(None).cast("array<string>"))
    hits_ = hits if "authors" in hits.columns else hits.withColumn("authors", F.lit(None).cast("array<string>"))
    hits_ = hits_ if "retraction_dated" in hits_.columns else hits_.withColumn("retraction_dated", F.lit(False))
    j = refs_.join(best_hits(compared(refs_, hits_)).select("ref_id", "n_hits", *[f"{n}_differs" for n in MISMATCH]), "ref_id", "left")
    found = F.col("n_hits").isNotNull()
    agrees = F.when(found & I.blank_to_null(F.col("title")).isNotNull(), ~F.greatest(*[F.col(f"{n}_differs") for n in MISMATCH]))
    note = (
        F.when(F.col("doi_ra") == "not_registered", "prefix_not_registered")
        .when(~found & F.col("doi_ra").isin(*dims.CHINESE_AGENCIES), "prefix_registered_record_missing")
        .when(~found, "not_in_open_sources").when(~agrees, "record_disagrees").otherwise("")
    )
    return j.select("ref_id", found.alias("found"), agrees.alias("metadata_consistent"), note.alias("note"))


def acceptance(judged: DataFrame) -> DataFrame:
    """Over labelled references (status, expected, category): how many of each category are
    judged as expected, and how many are wrongly said not to exist."""
    g = judged.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == F.col("expected")).alias("right"),
        F.count_if((F.col("status") == "NOT_FOUND") & (F.col("expected") != "NOT_FOUND")).alias("accused"),
    )
    return g.select("category", "n", F.round(F.col("right") / F.col("n"), 4).alias("rate"), F.round(F.col("accused") / F.col("n"), 4).alias("accused_rate"))


def distribution(judged: DataFrame) -> DataFrame:
    """States that occur, in their fixed order, with counts and shares."""
    place = I.lookup(F.col("status"), {s: i for i, s in enumerate(dims.STATUSES)})
    counts = judged.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    share = F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 4)
    return counts.select("status", "n", share.alias("share"), place.alias("position"), F.col("status").isin(*dims.PRIORITY).alias("priority"))


def batch_stats(queries: DataFrame) -> DataFrame:
    """Calls, cache hits and errors of a batch, and the state of the network they tell of."""
    error, away = F.col("outcome") == "error", F.col("error").isin(*NETWORK_ERRORS)
    s = queries.agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(F.col("from_cache")).alias("cache_hits"), F.count_if(error).alias("errors"),
        F.count_if(error & ~F.coalesce(away, F.lit(False))).alias("other_errors"), F.count_distinct("source").alias("sources"),
    )
    status = F.when(F.col("errors") == 0, "ok").when((F.col("other_errors") == 0) & (F.col("errors") > 5), "offline").otherwise("degraded")
    return s.withColumn("cache_hit_rate", F.round(F.try_divide("cache_hits", "calls"), 3)).withColumn("network_status", status)


def parse_references(texts: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The references of each text, numbered from r1, in the order they stand."""
    rows = texts.select(key, F.posexplode(R.units(F.col(text))).alias("at", "u"))
    return R.parsed(rows.select(key, F.concat(F.lit("r"), (F.col("at") + 1).cast("string")).alias("ref_id"), "u.*"))


def check_format(refs: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Format rules that parsed references (raw_text, authors) break: one row for each."""
    issues = R.format_issues(F.col("raw_text"), F.col("authors"))
    found = F.when(F.col("category") == "punctuation", R.full_width_found(F.col("raw_text"))).otherwise("")
    return refs.select(*(key or ["ref_id"]), "raw_text", F.explode(issues).alias("category")).select(*(key or ["ref_id"]), "category", found.alias("signs"))


def reconcile(cited: DataFrame, imported: DataFrame) -> DataFrame:
    """Draft citations against imported records, both by `key`: on one side, or both and alike or not."""
    j = cited.select("key", F.col("year").alias("cited_year"), F.lit(True).alias("c")).join(imported.select("key", F.col("year").alias("held_year"), F.lit(True).alias("h")), "key", "full_outer")
    state = F.when(F.col("h").isNull(), "missing_record").when(F.col("c").isNull(), "uncited").when(F.abs(F.col("cited_year") - F.col("held_year")) >= 2, "differs").otherwise("ok")
    return j.select("key", state.alias("state"))
