"""Federated search: filters, fusion of hits into works, ranking, advisories, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions import identifiers as I
from citeloom.functions import text as X
from citeloom.model import dims
from citeloom.session import settled


def postfilter(hits: DataFrame, year_from: int | None = None, year_to: int | None = None, date_from: str | None = None, date_to: str | None = None, type: str | None = None) -> DataFrame:
    """Inclusive bounds drop rows without a year or date; types that cannot be mapped stay."""
    for low, high, col in ((year_from, year_to, "year"), (date_from, date_to, "date")):
        hits = hits.filter(F.col(col) >= F.lit(low).cast(hits.schema[col].dataType)) if low is not None else hits
        hits = hits.filter(F.col(col) <= F.lit(high).cast(hits.schema[col].dataType)) if high is not None else hits
    if type is not None:
        canon = I.canonical_type(F.col("type"))
        hits = hits.filter(canon.isNull() | (canon == type))
    return hits


def search(hits: DataFrame, terms: list[str], sources: list[str] | None = None, per_source: int | None = None, **bounds) -> DataFrame:
    """Keyword search over chosen sources: predicates first, so they reach the scan."""
    found = hits.filter(F.col("source").isin(sources)) if sources else hits
    found = postfilter(found.filter(X.all_terms(F.col("title"), terms)), **bounds)
    return per_source_top(found, per_source) if per_source else found


def per_source_top(hits: DataFrame, n: int) -> DataFrame:
    """The first n rows of each source, latest years first.

    Hash buckets within a source keep their first n, then the source does, so no
    task sorts a whole source.
    """
    order = [F.coalesce("year", F.lit(0)).desc(), F.col("ord")]
    dealt = hits.withColumn("_b", F.pmod(F.xxhash64("ord"), F.lit(64)))
    near = dealt.withColumn("_n", F.row_number().over(Window.partitionBy("source", "_b").orderBy(*order))).filter(F.col("_n") <= n)
    last = near.withColumn("_n", F.row_number().over(Window.partitionBy("source").orderBy(*order))).filter(F.col("_n") <= n)
    return last.drop("_b", "_n")


def dedup_key(doi: Column, title: Column, ord: Column) -> Column:
    """DOI, else title, else the row itself; kinds never meet."""
    by_doi = F.concat(F.lit("doi:"), I.blank_to_null(I.normalize_doi(doi)))
    by_title = F.concat(F.lit("title:"), I.blank_to_null(X.norm_title(title)))
    return F.coalesce(by_doi, by_title, F.concat(F.lit("uniq:"), ord.cast("string")))


#: Ways along citation edges, by what a hit may be marked with.
DIRECTIONS = ("references", "cited_by", "backward", "forward")
#: Fields of a hit that a work takes from its primary record as they are.
_PRIMARY = ("title", "authors", "doi", "year", "date", "venue", "type", "source", "from_cache", "retraction")


def fuse(hits: DataFrame) -> DataFrame:
    """One work for each key, each field by its own rule; one shuffle, combined before it.

    The primary record has the highest authority, then the earliest arrival. All
    orders are total (they end in `ord`), so results do not hang on row order.
    Null means that a source did not say; it never competes and is never zero.
    Authors, date, retraction, cache mark, author details and directions are taken
    along where the hits have them.
    """
    rank = I.source_rank(F.col("source"))
    r = hits.withColumns({"key": dedup_key(F.col("doi"), F.col("title"), F.col("ord")), "rank": rank})
    best = lambda value, *by, where: F.min_by(F.when(where, value), F.when(where, F.struct(*by)))
    arrival = [F.col("rank"), F.col("ord")]
    cited, oa, told = F.col("cited_by_count").isNotNull(), F.col("oa_status").isNotNull(), F.coalesce(F.trim("abstract") != "", F.lit(False))
    openness = [-(F.col("oa_url").isNotNull().cast("int")), -I.oa_version_rank(F.col("oa_version")), *arrival]
    own = [c for c in _PRIMARY if c in hits.columns]
    more, shown = [], []
    if "author_details" in hits.columns:
        d = F.col("author_details")
        marked = -F.size(F.filter(d, lambda x: x["orcid"].isNotNull()))
        more.append(best(F.struct(d.alias("people"), "source"), marked, *arrival, where=F.coalesce(F.size(d) > 0, F.lit(False))).alias("who"))
        shown += [F.col("who.people").alias("author_details"), F.col("who.source").alias("author_details_source")]
    if "direction" in hits.columns:
        more += [F.min(F.when(F.col("direction") == w, F.col("ord"))).alias(f"_{w}") for w in DIRECTIONS]
        ways = F.array(*[F.when(F.col(f"_{w}").isNotNull(), F.struct(F.col(f"_{w}").alias("ord"), F.lit(w).alias("way"))) for w in DIRECTIONS])
        shown.append(F.transform(F.array_sort(F.array_compact(ways)), lambda x: x["way"]).alias("directions"))
    g = r.groupBy("key").agg(
        F.count(F.lit(1)).alias("n_hits"),
        F.min("ord").alias("first_ord"),
        F.min_by(F.struct(*own), F.struct(*arrival)).alias("p"),
        F.max("cited_by_count").alias("cited_by_count"),
        best(F.col("source"), -F.col("cited_by_count"), F.col("ord"), where=cited).alias("cited_by_source"),
        best(F.struct("oa_status", "oa_url", "oa_version", "source"), *openness, where=oa).alias("oa"),
        best(F.struct(F.trim("abstract").alias("text"), "source"), *arrival, where=told).alias("about"),
        F.collect_set(F.struct("rank", "source")).alias("_sources"), *more,
    )
    extra = [F.col(f"p.{c}").alias(c) for c in own if c in ("authors", "date", "from_cache", "retraction")]
    return g.select(
        "key", "n_hits", "first_ord", "p.title", I.normalize_doi(F.col("p.doi")).alias("doi"), "p.year", "p.venue",
        F.coalesce(I.canonical_type(F.col("p.type")), F.col("p.type")).alias("type"), F.col("p.source").alias("primary_source"),
        I.doi_url(I.blank_to_null(I.normalize_doi(F.col("p.doi")))).alias("url"),
        "cited_by_count", "cited_by_source", "oa.oa_status", "oa.oa_url", "oa.oa_version", F.col("oa.source").alias("oa_source"),
        F.col("about.text").alias("abstract"), F.col("about.source").alias("abstract_source"), F.array_join(F.transform(F.array_sort("_sources"), lambda s: s["source"]), ",").alias("sources"),
        F.size("_sources").alias("n_sources"), *extra, *shown,
    )


def rank_works(works: DataFrame, by: str = "year_desc", limit: int | None = None) -> DataFrame:
    """Works in order, numbered from 1; citation counts are no order on purpose.

    With a limit, the top rows are taken from each partition before they are
    numbered. Without one, rows are dealt by their place in the order and numbered
    within each part, beyond what the parts before it hold: no task sees all rows.
    """
    year = F.coalesce("year", F.lit(0))
    orders = {"year_desc": [year.desc(), F.col("first_ord")], "source_count": [F.col("n_sources").desc(), year.desc(), F.col("first_ord")]}
    if by not in orders:
        raise ValueError(f"works are ordered by {' or '.join(orders)}, not by {by}")
    order = orders[by]
    if limit and limit > 0:
        top = works.orderBy(*order).limit(limit)
        return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return numbered(works, order, "rank")


def numbered(rows: DataFrame, order: list[Column], out: str) -> DataFrame:
    """`rows` with their 1-based place in a total order, without a task that holds them all.

    Rows are settled with the part they were dealt to: dealt twice, they could part elsewhere.
    """
    dealt = settled(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    starts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_part").orderBy(*order)
    placed = dealt.withColumn("_at", F.row_number().over(within)).join(F.broadcast(starts), "_part")
    return placed.withColumn(out, (F.col("_at") + F.col("_start")).cast("int")).drop("_part", "_at", "_start")


def advisories(works: DataFrame, least: int = 5, share: float = 0.7) -> DataFrame:
    """Dimensions in which one value holds most of the known rows; before any limit."""
    dimensions = {"year": I.year_bucket(F.col("year")), "venue": F.col("venue"), "type": F.col("type"), "source": F.col("primary_source")}
    long = works.select(F.explode(F.array(*[F.struct(F.lit(k).alias("dim"), v.cast("string").alias("value")) for k, v in dimensions.items()])).alias("d")).select("d.*")
    counts = long.filter("value IS NOT NULL AND trim(value) <> ''").groupBy("dim", "value").agg(F.count(F.lit(1)).alias("n"))
    tops = counts.groupBy("dim").agg(F.sum("n").alias("known"), F.max_by(F.struct("value", "n"), F.struct("n", "value")).alias("t"))
    tops = tops.select("dim", "known", F.col("t.value").alias("top_value"), F.col("t.n").alias("top_n"))
    return tops.withColumn("advised", (F.col("known") >= least) & (F.col("top_n") >= share * F.col("known")))


def search_stats(works: DataFrame, limit: int = 0) -> DataFrame:
    """Hits before fusion, works after it, works shown, and whether the list is cut."""
    shown = F.least(F.col("after_dedup"), F.lit(limit)) if limit > 0 else F.col("after_dedup")
    s = works.agg(F.coalesce(F.sum("n_hits"), F.lit(0)).alias("raw_hits"), F.count(F.lit(1)).alias("after_dedup"))
    return s.withColumn("shown", shown.cast("long")).withColumn("truncated", F.col("shown") < F.col("after_dedup"))


def coverage(attempts: DataFrame, scholar_key: bool = False) -> DataFrame:
    """A row for each known source: what it was asked, what came of it; guided sources are listed too.

    `attempts` has source, outcome (hit, miss, error) and error. A source whose calls all
    failed is an error, one without hits empty; Semantic Scholar with hits but without a
    key is degraded (slow), any other ok. Sources that were not asked have outcome n/a.
    """
    spark = attempts.sparkSession
    known = spark.createDataFrame([(s, kind, role) for s, kind, role, _, _ in dims.SOURCES], "source string, kind string, role string")
    seen = attempts.groupBy("source").agg(
        F.count_if(F.col("outcome") == "hit").alias("hit_count"),
        F.count_if(F.col("outcome") == "error").alias("errors"),
        F.count(F.lit(1)).alias("calls"),
    )
    outcome = F.when(F.col("calls").isNull(), "n/a").when(F.col("errors") == F.col("calls"), "error").when(F.col("hit_count") == 0, "empty")
    outcome = outcome.when((F.col("source") == "semantic_scholar") & F.lit(not scholar_key), "degraded").otherwise("ok")
    return known.join(seen, "source", "left").withColumn("outcome", outcome)


def network_status(covered: DataFrame, core_only: bool = True) -> DataFrame:
    """Offline if every source that was asked failed (every core one, for a search), degraded
    if any failed or, for a search, is degraded."""
    asked = F.col("calls").isNotNull()
    failed = F.col("outcome") == "error"
    counted = asked & (F.col("role") == "core") if core_only else asked
    hurt = F.col("outcome").isin("error", "degraded") if core_only else failed
    s = covered.agg(
        F.coalesce(F.bool_and(F.when(counted, failed)), F.lit(False)).alias("dead"),
        F.coalesce(F.bool_or(asked & hurt), F.lit(False)).alias("hurt"),
    )
    return s.select(F.when(F.col("dead"), "offline").when(F.col("hurt"), "degraded").otherwise("ok").alias("network_status"))


def window_warnings(searches: DataFrame) -> DataFrame:
    """What a day window means for each search (search_id, query, sources, date_from, date_to):
    sources without days will find nothing, and many words seldom stand together."""
    windowed = F.col("date_from").isNotNull() | F.col("date_to").isNotNull()
    others = F.when(F.col("sources").isNull(), F.array(F.lit("core"))).otherwise(F.array_except("sources", F.array(*map(F.lit, dims.NATIVE_DATE))))
    words = F.size(F.filter(F.split(F.trim("query"), r"\s+"), lambda w: w != ""))
    made = F.array_compact(F.array(F.when(F.size(others) > 0, F.concat(F.lit("no_days:"), F.array_join(others, "/"))), F.when(words > 5, F.concat(F.lit("many_words:"), words.cast("string")))))
    return searches.filter(windowed).select("search_id", F.explode(made).alias("warning"))


def related(seeds: DataFrame, edges: DataFrame, direction: str = "both", limit: int | None = None) -> DataFrame:
    """Works one step along citation edges: references (backward) and cited-by (forward).

    `seeds` has seed_id; `edges` has src_id (citing), dst_id (cited), source and, where it
    is known, title: an edge whose title is known to be missing is a stub and goes. With
    `limit`, a seed keeps so many of each source and direction, by work_id.
    """
    if direction not in ("backward", "forward", "both"):
        raise ValueError(f"direction is backward, forward or both, not {direction}")
    if "title" in edges.columns:
        edges = edges.filter(F.coalesce(F.trim("title"), F.lit("")) != "")
    back = edges.join(seeds, F.col("src_id") == F.col("seed_id"), "left_semi").select(F.col("src_id").alias("seed_id"), F.col("dst_id").alias("work_id"), "source", F.lit("backward").alias("direction"))
    ahead = edges.join(seeds, F.col("dst_id") == F.col("seed_id"), "left_semi").select(F.col("dst_id").alias("seed_id"), F.col("src_id").alias("work_id"), "source", F.lit("forward").alias("direction"))
    found = {"backward": back, "forward": ahead, "both": back.unionByName(ahead)}[direction]
    if limit is None:
        return found
    first = Window.partitionBy("seed_id", "source", "direction").orderBy("work_id")
    return found.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= max(1, limit)).drop("_n")


def merge_authors(candidates: DataFrame) -> DataFrame:
    """People by ORCID only; candidates without one stay apart by their own id.

    Lists are joined in the order their members were first seen; `topic` is taken along
    where the candidates have one.
    """
    orcid = I.normalize_orcid(F.col("orcid"))
    c = candidates.withColumn("_orcid", orcid).withColumn("author_key", F.coalesce(F.concat(F.lit("orcid:"), "_orcid"), F.concat_ws(":", F.lit("entity"), "source", "entity_id")))
    seen = lambda name: F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ord", name))), lambda x: x[name])), ",")
    more = [seen("topic").alias("topics")] if "topic" in candidates.columns else []
    # lists are made of distinct rows only, however many candidates say the same
    same = [n for n in ("author_key", "_orcid", "name", "entity_id", "affiliation", "topic") if n in c.columns]
    c = c.groupBy(*same).agg(F.min("ord").alias("ord"), F.sum("works_count").alias("works_count"), F.bool_or("exact_name_match").alias("exact_name_match"), F.count(F.lit(1)).alias("_n"))
    g = c.groupBy("author_key").agg(
        F.min_by("name", "ord").alias("name"), F.first("_orcid").alias("orcid"), F.sum("works_count").alias("works_count"),
        F.min_by("entity_id", "ord").alias("_first"), seen("entity_id").alias("entity_ids"), seen("affiliation").alias("affiliations"),
        seen("name").alias("name_variants"), *more, F.bool_or("exact_name_match").alias("exact_name_match"),
        F.sum("_n").alias("n_candidates"), F.count_distinct("entity_id").alias("n_entities"),
    )
    key = F.coalesce(F.concat(F.lit("orcid:"), "orcid"), F.concat(F.lit("entity:"), "_first"))
    return g.withColumn("works_key", key).drop("_first")


def rank_authors(authors: DataFrame, limit: int | None = None) -> DataFrame:
    """Authors by their number of works, then name, both falling, numbered from 1: an order to find
    someone in, not one of worth."""
    order = [F.col("works_count").desc(), F.col("name").desc(), F.col("author_key")]
    if limit and limit > 0:
        return authors.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return numbered(authors, order, "rank")


def author_warnings(authors: DataFrame, reported: int | None = None) -> DataFrame:
    """Counts that a reader of merged authors must see, and the first names that are not the
    one asked for; `reported` is how many the source says there are."""
    n = F.count(F.lit(1))
    approximate = F.collect_set(F.when(~F.col("exact_name_match"), F.col("name")))
    return authors.agg(
        n.alias("authors"), F.count_if(~F.col("exact_name_match")).alias("approximate"),
        F.array_join(F.slice(F.array_sort(approximate), 1, 5), ",").alias("approximate_names"),
        F.count_if(F.col("orcid").isNull()).alias("no_orcid"), F.count_if(F.col("n_entities") > 1).alias("multi_entity"),
        *([(F.lit(reported) > n).alias("cut")] if reported is not None else []),
    )


def works_by_author(authorships: DataFrame, keys: DataFrame) -> DataFrame:
    """Works of authors by key: an ORCID finds all of a person's entities, an entity id only one.

    `authorships` has work_id, entity_id, orcid; `keys` has author_key (`orcid:…`, `entity:…`
    or bare). `partial` tells that the key may have missed other entities of the person.
    """
    orcid, entity = I.author_key(F.col("author_key"))
    asked = keys.select("author_key", orcid.alias("k_orcid"), entity.alias("k_entity")).distinct()
    a = authorships.withColumn("a_orcid", I.normalize_orcid(F.col("orcid")))
    by_orcid = a.join(asked.filter("k_orcid IS NOT NULL"), F.col("a_orcid") == F.col("k_orcid")).select("author_key", "work_id", F.lit(False).alias("partial"))
    by_entity = a.join(asked.filter("k_orcid IS NULL AND k_entity IS NOT NULL"), F.col("entity_id") == F.col("k_entity")).select("author_key", "work_id", F.lit(True).alias("partial"))
    return by_orcid.unionByName(by_entity).distinct()
