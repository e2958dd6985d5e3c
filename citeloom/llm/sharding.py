"""Shards of near-equal bytes by longest-processing-time scheduling.

Rows of equal text are one job, its size the bytes of all its rows. The driver
sees only how many jobs there are of each size: sizes from `EXACT` up share a
bin with others that agree in their ten leading bits, so at most about 110,000
bins exist whatever the input. From the largest bin down, jobs go to the
least-loaded shard through a heap; a run of equal jobs is dealt at once to the
level that the heap would fill. Jobs take their places by their rank in a bin.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.llm.common import ranked, settle, whole_text, with_groups

#: Sizes below this have a bin of their own.
EXACT = 65_536


def deal(loads: list[float], size: float, count: int) -> list[int]:
    """How many of `count` equal jobs each shard gets; adds them to `loads`."""
    given = [0] * len(loads)
    if count > 4 * len(loads):
        low, high = 0.0, max(loads) + size * count
        for _ in range(80):
            level = (low + high) / 2
            fits = sum(max(0, int((level - x) // size)) for x in loads)
            low, high = (level, high) if fits <= count else (low, level)
        given = [max(0, int((low - x) // size)) for x in loads]
        for k, n in enumerate(given):
            loads[k] += n * size
    heap = [(x, k) for k, x in enumerate(loads)]
    heapq.heapify(heap)
    for _ in range(count - sum(given)):
        x, k = heapq.heappop(heap)
        given[k] += 1
        loads[k] += size
        heapq.heappush(heap, (loads[k], k))
    return given


def schedule(bins: list[tuple[int, int, int]], shards: int) -> list[tuple[int, list[int]]]:
    """(bin, jobs, bytes) to (bin, ranks at which each shard's jobs end), largest bin first."""
    loads, plan = [0.0] * shards, []
    for size, count, total in sorted(bins, reverse=True):
        ends, at = [], 0
        for n in deal(loads, total / count, count):
            at += n
            ends.append(at)
        plan.append((size, ends))
    return plan


def shards_by_bytes(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Each row with its size, shard and slot; rows of equal text share a shard.

    Returns doc_id, size (UTF-8 bytes and 1), text_crc32, shard, slot (gapless
    from 0 in a shard). Null text has no bytes and is of one group with the empty
    text. Repeated rows are rows of their own; rows alike in all that is returned
    may have their slots in any order. An empty table gives no rows. A group
    larger than a fair share is a shard's only load; no law can split it. Columns
    beside doc_id and text are not read, whatever their names.
    """
    spark = docs.sparkSession
    rows = settle(
        docs.select(
            "doc_id",
            (F.octet_length(whole_text()) + 1).cast("long").alias("size"),
            F.crc32(whole_text().cast("binary")).alias("text_crc32"),
            F.unhex(F.sha2(whole_text(), 256)).alias("text_id"),
        )
    )
    jobs = rows.groupBy("text_id").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("k"))
    lead = F.expr("greatest(0, cast(floor(log2(bytes)) as int) - 10)")
    jobs = jobs.withColumn("lead", lead).withColumn(
        "bin", F.expr(f"if(bytes < {EXACT}, bytes, shiftleft(shiftright(bytes, lead), lead))")
    )
    jobs = settle(jobs.drop("lead"))
    bins = jobs.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    plan = schedule([(r.bin, r.n, r.bytes) for r in bins.collect()], shards)
    schema = T.StructType([T.StructField("bin", T.LongType()), T.StructField("ends", T.ArrayType(T.LongType()))])
    ends = F.broadcast(spark.createDataFrame(plan, schema))  # a row for each bin
    placed = (
        ranked(jobs, ["bin"], ["text_id"], "place")
        .join(ends, "bin")
        .select("text_id", "k", F.expr("cast(size(filter(ends, e -> e <= place)) as int)").alias("shard"))
    )
    told = with_groups(rows, settle(placed), ["text_id"], "k")  # copies of one text stay where they are
    dealt = settle(told.select("doc_id", "size", "text_crc32", "shard"))
    return ranked(dealt, ["shard"], ["doc_id", "size", "text_crc32"], "slot")
