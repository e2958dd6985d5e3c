"""The source registry, batches that can be taken up again, and small roll-ups."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions import identifiers as I
from citeloom.model import dims

REGISTRY = "id STRING, kind STRING, role STRING, base_url STRING, capabilities ARRAY<STRING>, cache_ttl_days INT"


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    """Sources from JSON lines; `registry_faults` says whether they can be used."""
    return spark.read.schema(REGISTRY).json(path)


def known_sources(spark: SparkSession) -> DataFrame:
    """The sources that the engine knows."""
    rows = [(s, kind, role, None if kind == "guided" else f"https://{s}", can, days) for s, kind, role, can, days in dims.SOURCES]
    return spark.createDataFrame(rows, REGISTRY)


def registry_faults(sources: DataFrame) -> DataFrame:
    """(id, fault): what a source lacks, and values that no source has."""
    blank = lambda c: I.blank_to_null(F.trim(c)).isNull()
    strange = F.array_except(F.coalesce("capabilities", F.array().cast("array<string>")), F.array(*map(F.lit, dims.CAPABILITIES)))
    faults = F.concat(
        F.array_compact(F.array(
            *[F.when(blank(c), f"no {c}") for c in ("id", "kind", "role")], F.when(~blank("kind") & ~F.col("kind").isin("api", "guided"), "kind"),
            F.when(~blank("role") & ~F.col("role").isin("core", "supplementary"), "role"), F.when((F.col("kind") == "api") & blank("base_url"), "no base_url"),
        )),
        F.transform(strange, lambda c: F.concat(F.lit("capability "), c)),
    )
    return sources.select("id", F.explode(faults).alias("fault"))


def able(sources: DataFrame, capability: str) -> DataFrame:
    return sources.filter(F.array_contains("capabilities", capability))


def of_kind(sources: DataFrame, kind: str) -> DataFrame:
    return sources.filter(F.col("kind") == kind)


def searched_by_default(sources: DataFrame) -> DataFrame:
    """Core sources that can search."""
    return able(sources, "search").filter("role = 'core'")


def clients(sources: DataFrame, only: list[str] | None = None) -> DataFrame:
    """(source, connector) of the sources that have a connector here, all or some."""
    made = of_kind(sources, "api").filter(F.col("id").isin(*dims.SOURCE_RANK))
    made = made.filter(F.col("id").isin(*only)) if only is not None else made
    return made.select(F.col("id").alias("source"), F.concat(F.lit("citeloom.operators.providers."), "id").alias("connector"))


def fingerprint(refs: DataFrame) -> DataFrame:
    """One row, `fingerprint`: a number for a set of references (ref_id, doi, title) in any order."""
    h = F.xxhash64("ref_id", F.coalesce("doi", F.lit("")), F.coalesce("title", F.lit(""))).cast("decimal(38,0)")
    s = refs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(h), F.lit(0)).alias("s"))
    return s.select(F.sha2(F.concat_ws("|", F.col("n").cast("string"), F.col("s").cast("string")), 256).alias("fingerprint"))


def _read(spark: SparkSession, path: str, ddl: str | None = None) -> DataFrame | None:
    """A written table, or None where nothing has been written yet."""
    try:
        return spark.read.schema(ddl).parquet(path) if ddl else spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


#: A commit names an attempt whose rows are whole, and the batch that they are of.
COMMIT = "attempt STRING, fingerprint STRING"


def save_state(refs: DataFrame, done: DataFrame, path: str) -> None:
    """Adds what is done of a batch (ref_id and whatever goes with it) to its state.

    Rows go to a folder of their own and count once a commit names it, so a save that breaks off
    adds nothing, and one that is made again adds nothing twice: references that are in the
    state already are left out, and one row of each stays. Another batch's state is an error.
    """
    spark = refs.sparkSession
    own, held = fingerprint(refs).first().fingerprint, load_state(refs, path)
    new = (left_over(done, held) if held is not None else done).dropDuplicates(["ref_id"])
    attempt = uuid.uuid4().hex
    new.write.parquet(f"{path}/attempts/{attempt}")
    spark.createDataFrame([(attempt, own)], COMMIT).coalesce(1).write.mode("append").parquet(f"{path}/commits")


def load_state(refs: DataFrame, path: str) -> DataFrame | None:
    """What is done of the batch, None if nothing has been saved; another batch's state is an error.

    Of two savers at a time, both may have done a reference; it is in the state once.
    """
    commits = _read(refs.sparkSession, f"{path}/commits", COMMIT)
    if commits is None:
        return None
    own = fingerprint(refs).first().fingerprint
    attempts = commits.collect()  # a row a save
    if any(c.fingerprint != own for c in attempts):
        raise ValueError(f"{path} is the state of other references")
    if not attempts:
        return None
    return refs.sparkSession.read.parquet(*[f"{path}/attempts/{c.attempt}" for c in attempts]).dropDuplicates(["ref_id"])


def left_over(refs: DataFrame, done: DataFrame) -> DataFrame:
    """References that are not done, the others not asked again."""
    return refs.join(done.select("ref_id").distinct(), "ref_id", "left_anti")


def resumed(refs: DataFrame, path: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The whole batch's results: what its state holds, and `work` done on the references left over,
    saved before it is returned."""
    held = load_state(refs, path)
    left = refs if held is None else left_over(refs, held)
    if not left.isEmpty():
        save_state(refs, work(left), path)
    return load_state(refs, path)


def source_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(run, item, source_changed): whether an item's text is another after a step than before it, or
    there on one side only. Both have run, item and text; null texts are equal to each other only."""
    told = lambda df, name: df.select("run", "item", F.md5(F.col("text").cast("binary")).alias(name), F.lit(True).alias(f"{name}_there"))
    both = told(before, "b").join(told(after, "a"), ["run", "item"], "full_outer")
    same = F.coalesce("b_there", F.lit(False)) & F.coalesce("a_there", F.lit(False)) & F.col("b").eqNullSafe(F.col("a"))
    return both.select("run", "item", (~same).alias("source_changed"))


def trimmed(payload: Column, ddl: str) -> Column:
    """A payload with some of its fields only, as evidence to be kept."""
    return F.to_json(F.from_json(payload, ddl))


def exit_states(items: DataFrame) -> DataFrame:
    """(run, exit_code) of conversions (run, status, source_changed): a text that changed or was
    not verified (3), a failed step (1), a skipped one (2), or nothing (0)."""
    g = items.groupBy("run").agg(F.collect_set("status").alias("s"), F.bool_or("source_changed").alias("changed"))
    held = lambda x: F.array_contains("s", x)
    return g.select("run", F.when(F.col("changed") | held("verify_failed"), 3).when(held("failed"), 1).when(held("skipped"), 2).otherwise(0).alias("exit_code"))


def concept_overlap(works: DataFrame, concepts: dict[str, list[str]], text: str = "title") -> DataFrame:
    """Whether each work names each concept, and how many it names: facts, and no score."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = {n: F.coalesce(F.greatest(F.lit(False), *[F.contains(low, F.lit(w.lower())) for w in words]), F.lit(False)) for n, words in concepts.items()}
    w = works.withColumns({f"has_{n}": c for n, c in found.items()})
    return w.withColumn("overlap", sum((F.col(f"has_{n}").cast("int") for n in concepts), F.lit(0)))
