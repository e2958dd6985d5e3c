"""What the operators of this package share: null rules, lineage cuts, skew-safe ranks."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def whole_text(name: str = "text") -> Column:
    """The text of a row; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "binary": T.BinaryType()}


def fields(ddl: str) -> list[T.StructField]:
    """Fields of plain kinds from "name kind, ..."; needs no session, so modules can use it."""
    return [T.StructField(n, _KINDS[k]) for n, k in (x.split() for x in ddl.split(","))]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame) -> DataFrame:
    """Cut lineage into the folder all executors share (spark.checkpoint.dir).

    A folder of our own is set only where the session names none and runs in one
    process, as in tests; a cluster without a shared folder is an error.
    """
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def turned(df: DataFrame) -> DataFrame:
    """`settle` at the end of a loop's turn, as a written table.

    A checkpoint keeps what the planner estimates of it, and its estimate of a join is a
    product: over the turns of a loop its digits double until planning never ends.
    """
    return stored(df, "snappy")


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Cut lineage as `settle` does, for rows that hold texts: compressed, read by column.

    The folder is under the shared one; it goes when the driver's Python ends.
    """
    spark = df.sparkSession
    folder = f"{_shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(folder)
    atexit.register(_remove, spark, folder)
    return spark.read.schema(df.schema).parquet(folder)


def _remove(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Exception):  # at exit; the JVM may be gone
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _shared_folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="citeloom-")
            atexit.register(shutil.rmtree, named, True)
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def fresh(name: str, taken: list[str]) -> str:
    """`name`, with underscores before it until no column in `taken` has it (in any case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def partitions(spark: SparkSession) -> int:
    """The session's shuffle width, which a cluster sets by its input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Adds `out`: gapless 0-based ranks within `keys`, though one key may hold most rows.

    Rows of a key are dealt into hash buckets of `order`; ranks run bucket by
    bucket. Only counts, one per key and bucket, are ordered within a key, so
    no task sorts a whole key. Keys are never null, so the join is a plain one,
    whose deal by key and bucket serves the ranks too. `df` is evaluated twice:
    settle it first.
    """
    b, start = fresh("_b", df.columns), fresh("_start", df.columns)
    buckets = 8 * partitions(df.sparkSession)
    dealt = df.withColumn(b, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy(*keys, b).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, b, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(start))
    joined = dealt.join(starts, [*keys, b])
    within = Window.partitionBy(*keys, b).orderBy(*order)
    return joined.withColumn(out, F.col(start) + F.row_number().over(within) - 1).drop(b, start)


def matched(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """`left` joined with `right` on `names`, where null equals null; the names come once."""
    apart = right.select(
        *[F.col(n).alias(f"_r_{n}") for n in names], *[F.col(c) for c in right.columns if c not in names]
    )
    held = [F.col(n).eqNullSafe(F.col(f"_r_{n}")) for n in names]
    return left.join(apart, reduce(Column.__and__, held), how).drop(*[f"_r_{n}" for n in names])


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """A batch cut into runs of rows with about `limit` bytes of text, a row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at = np.cumsum(sizes, dtype=np.int64) // limit
    edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(sizes)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


Batches = Iterator[pa.RecordBatch]


def give_back() -> None:
    """Returns memory that the worker's allocators hold but do not use to the machine."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """`run`, after which the worker gives its free memory back.

    A worker is used again by the next stages; what it keeps would count against
    the executor there.
    """

    def out(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            give_back()

    return out


def crc_mod(column: str, n: int) -> Column:
    """crc32 of an id as text, modulo n; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def bounded_keys(keys: DataFrame, n: int, strata: list[str] | None = None) -> DataFrame:
    """At most n distinct rows of `keys` (doc_id, h: a text's hash, strata), in the order of a hash.

    Null ids are never chosen. With strata, each gives its first row before any gives its second,
    so a rare one is not missed; a stratum is cut to n before its rows meet.
    """
    known = keys.filter("doc_id IS NOT NULL").distinct()
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("h")]
    if strata:
        turn = F.row_number().over(Window.partitionBy(*strata).orderBy(*order))
        known = known.withColumn("_turn", turn).filter(F.col("_turn") <= n)
        order = [F.col("_turn"), *order]
    chosen = known.orderBy(*order).limit(n).select(*keys.columns)
    return keys.sparkSession.createDataFrame(chosen.collect(), keys.schema)


def rows_of(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows (doc_id, text and the keys' strata) that `keys` (see `bounded_keys`) names, once each.

    Keys are broadcast, so texts that are not chosen never leave their tasks.
    """
    hashed = rows.withColumn("h", F.xxhash64("text"))
    return matched(hashed, F.broadcast(keys), keys.columns, "left_semi").dropDuplicates(keys.columns).drop("h")


def with_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """`rows` with what `groups` (a row for each key, `size` the rows it has) says of their key.

    Groups with a thousandth of the rows or more, a thousand at most, are
    broadcast, so their rows stay where they are; the others are joined by key.
    Settle both first.
    """
    total = groups.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first().n
    hot = F.broadcast(groups.filter(F.col(size) * 1000 >= total))
    cold = groups.filter(F.col(size) * 1000 < total)
    return matched(rows, hot, keys).unionByName(
        matched(matched(rows, hot.select(*keys), keys, "left_anti"), cold, keys)
    )


#: Rows of an edge table that a task holds; tasks that even a small one has.
EDGES, LEAST_TASKS = 50_000, 8


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of `edges` (a, b); the root is the component's least node.

    Stars are contracted in turns: each node sends its larger neighbours, then
    its smaller ones, to the least node it knows. The number of turns grows with
    the logarithm of a component's size; what is kept is one table of edges, in as
    many parts as its rows ask for.
    """
    now = settle(edges.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    parts = min(partitions(now.sparkSession), max(LEAST_TASKS, -(-now.count() // EDGES)))
    before = None
    while True:
        both = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        now = _star(settle(both.coalesce(parts)), F.col("u") > F.col("v"), parts)
        now = _star(now, F.lit(True), parts)
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    found = now.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())


def _star(pairs: DataFrame, moved: Column, parts: int) -> DataFrame:
    """One turn: neighbours u of v that are `moved` go to the least node that v knows."""
    least = settle(pairs.groupBy("v").agg(F.min("u").alias("least"), F.count(F.lit(1)).alias("n")).coalesce(parts))
    least = least.withColumn("m", F.least("v", "least"))
    told = with_groups(pairs, least.select("v", "m", "n"), ["v"], "n")
    sent = told.filter(moved & (F.col("u") != F.col("m"))).select(F.greatest("u", "m").alias("v"), F.least("u", "m").alias("u"))
    own = least.filter("v <> m").select("v", F.col("m").alias("u"))
    return turned(sent.unionByName(own).distinct().coalesce(parts))


def one_of_each(docs: DataFrame, kept: DataFrame, row: Column, by_row: bool = True) -> DataFrame:
    """The rows of `docs` that `kept` names by doc_id (and `row`), one for each doc_id and `row`.

    Texts are shuffled once: one hash of the key serves the join and the choice.
    Columns of `docs` may have any names beside doc_id.
    """
    own, key, copy = (fresh(n, docs.columns) for n in ("_row", "_key", "_copy"))
    by = ["doc_id", own] if by_row else ["doc_id"]
    keyed = docs.withColumn(own, row).withColumn(key, F.xxhash64(*by))
    named = kept.withColumnRenamed("row", own).withColumn(key, F.xxhash64(*by))
    told = {c: fresh(f"_r{k}", docs.columns) for k, c in enumerate([key, *by])}
    named = named.select(*[F.col(c).alias(n) for c, n in told.items()])
    held = [F.col(key) == F.col(told[key]), *[F.col(c).eqNullSafe(F.col(told[c])) for c in by]]
    first = Window.partitionBy(key, "doc_id", own).orderBy(F.lit(1))
    return (
        keyed.join(named, reduce(Column.__and__, held), "left_semi")
        .withColumn(copy, F.row_number().over(first))
        .filter(F.col(copy) == 1)
        .select(*docs.columns)
    )
