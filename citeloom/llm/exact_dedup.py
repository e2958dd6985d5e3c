"""Exact duplicates by deterministic block naming, in DataFrame operations only.

A text is cut into blocks of fixed size. The distinct blocks are dealt by value,
sorted, and numbered: a block's name is its partition's number and its place in
that order. Adjacent names are then named as pairs in the same way, level by
level, until a document is left with one name. Names are given to values, not
to hashes of them, so (level, name) is the same for two texts exactly if the
texts are the same. A 64-bit hash only carries names back to the blocks; blocks
that share one are found and named by a join on their bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm.common import matched, one_of_each, settle, turned, whole_text, with_groups

#: Bytes of a block. Most documents are one or two blocks; a level halves the rest.
BLOCK = 2048


def _occurrences(docs: DataFrame, block: int, hash_sql: str) -> DataFrame:
    cut = f"transform(sequence(0, n - 1), i -> substring(b, i * {block} + 1, {block}))"
    return (
        docs.select("doc_id", whole_text().alias("t"))
        .select("doc_id", F.xxhash64("t").alias("row"), F.col("t").cast("binary").alias("b"))
        .withColumn("n", F.greatest(F.lit(1), F.ceil(F.length("b") / block).cast("int")))
        .select("doc_id", "row", "n", F.posexplode(F.expr(cut)).alias("pos", "block"))
        .withColumn("h", F.expr(hash_sql))
    )


def _numbered(values: DataFrame, by: list[str]) -> DataFrame:
    """Distinct values with how many rows have them (k), sorted within the partition their
    value deals them to, and numbered."""
    counted = values.groupBy(*by).agg(F.count(F.lit(1)).alias("k"))
    return counted.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def _first_names(docs: DataFrame, block: int, hash_sql: str) -> DataFrame:
    """Each block's name. Blocks are read by their hash; a hash that many blocks have is no
    hot key, as its name is broadcast."""
    found = _occurrences(docs, block, hash_sql)
    named = settle(_numbered(found.select("block"), ["block"]).select(F.expr(hash_sql).alias("h"), "k", "name"))
    shared = settle(named.groupBy("h").count().filter("count > 1").select("h"))
    at = ["doc_id", "row", "n", "pos"]
    light = settle(found.select(*at, "h"))
    if shared.isEmpty():
        return with_groups(light, named, ["h"], "k").select(*at, "name")
    alone = settle(named.join(shared, "h", "left_anti"))
    doubtful = found.join(shared, "h", "left_semi").select(*at, "block")
    apart = settle(_numbered(doubtful.select("block"), ["block"]).withColumn("name", -1 - F.col("name")))
    return (
        with_groups(light, alone, ["h"], "k").select(*at, "name")
        .unionByName(doubtful.join(apart.drop("k"), "block").select(*at, "name"))
    )


def identities(docs: DataFrame, block: int = BLOCK, hash_sql: str = "xxhash64(block)") -> DataFrame:
    """(doc_id, row, level, name) of each document; `row` tells rows of one doc_id apart.

    Rows that repeat both doc_id and text are one row here. `row` is a 64-bit hash,
    which only has to part the texts of one doc_id; names stand for values.
    """
    live = settle(_first_names(docs, block, hash_sql))
    done: DataFrame | None = None
    level = 0
    while True:
        over = live.filter("n <= 1").groupBy("doc_id", "row").agg(F.max("name").alias("name"))
        over = over.select("doc_id", "row", F.lit(level).alias("level"), "name")
        done = over if done is None else done.unionByName(over)
        live = live.filter("n > 1")
        if live.isEmpty():
            return done
        pairs = (
            live.groupBy("doc_id", "row", "n", F.expr("pos div 2").cast("int").alias("pos"))
            .agg(
                F.max(F.expr("if(pos % 2 = 0, name, null)")).alias("a"),
                F.max(F.expr("if(pos % 2 = 1, name, null)")).alias("b"),
            )
        )
        pairs = settle(pairs)
        names = settle(_numbered(pairs.select("a", "b"), ["a", "b"]))
        live = turned(
            with_groups(pairs, names, ["a", "b"], "k")
            .select("doc_id", "row", F.expr("(n + 1) div 2").cast("int").alias("n"), "pos", "name")
        )
        level += 1


def exact_groups(docs: DataFrame, block: int = BLOCK, hash_sql: str = "xxhash64(block)") -> DataFrame:
    """Each row of `docs` with its group of equal texts.

    Returns doc_id, row, keep_id (the largest doc_id of the group), group_size
    (rows), kept and text_sha256. Null text counts as empty; empty texts are a
    group. Of rows that repeat doc_id and text one is kept. A null doc_id is
    kept only where its group has no other. Columns beside doc_id and text are
    not read.
    """
    ids = identities(docs, block, hash_sql)
    rows = docs.select("doc_id", F.xxhash64(whole_text()).alias("row"), F.sha2(whole_text(), 256).alias("text_sha256"))
    rows = settle(
        matched(rows, ids, ["doc_id", "row"])
        .withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "row").orderBy("name")))
    )
    groups = settle(rows.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    return with_groups(rows, groups, ["level", "name"], "group_size").select(
        "doc_id", "row", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        "text_sha256",
    )


def drop_exact(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of `docs` that stay, with all their columns, whatever their names."""
    kept = exact_groups(docs, block).filter("kept").select("doc_id", "row")
    return one_of_each(docs, kept, F.xxhash64(whole_text()))
