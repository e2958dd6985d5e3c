"""Payloads of any length as one JSON document: a head, a list in its order, and the end.

A document is rows (part, place, line). They are sorted by ranges and written as text, so no
task and no row holds the document; the files in the order of their names, one behind the
other, are it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.operators import verify as V
from citeloom.operators import works as W

HEAD, BODY, TAIL = 0, 1, 2


def _json(columns: list[str]) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def document(head: DataFrame, body: DataFrame, name: str, place: str = "rank") -> DataFrame:
    """(part, place, line): `head`, one row, with the rows of `body` as its list `name`.

    `place` numbers the rows of `body` from 1 without a gap; it is a field of theirs too.
    Nulls are told as nulls. Without rows the list is empty.
    """
    if not head.columns:
        raise ValueError("a document's head has a field at least")
    opened = head.select(F.lit(HEAD).alias("part"), F.lit(0).cast("long").alias("place"), F.concat(F.regexp_replace(_json(head.columns), r"\}\z", ""), F.lit(f',"{name}":[')).alias("line"))
    listed = body.select(F.lit(BODY).alias("part"), F.col(place).cast("long").alias("place"), F.concat(F.when(F.col(place) > 1, ",").otherwise(""), _json(body.columns)).alias("line"))
    closed = head.select(F.lit(TAIL).alias("part"), F.lit(0).cast("long").alias("place"), F.lit("]}").alias("line"))
    return opened.unionByName(listed).unionByName(closed)


def write_document(rows: DataFrame, path: str) -> None:
    """Writes a document's lines in order."""
    rows.orderBy("part", "place").select("line").write.mode("overwrite").text(path)


def _one_list(rows: DataFrame, order: str, name: str) -> DataFrame:
    """A few rows (sources, warnings) as one row with a list."""
    return rows.agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in rows.columns if c != order]))).alias(name))


def _beside(*rows: DataFrame) -> DataFrame:
    """One-row tables as one row with the columns of all."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    return stacked.agg(*[F.first(c, ignorenulls=True).alias(c) for c in stacked.columns])


def search_payload(query: str, works: DataFrame, attempts: DataFrame, limit: int | None = None) -> DataFrame:
    """A search's document: the query, what came of each source, the network, counts, what one value
    dominates, and the works in order."""
    ranked = W.rank_works(works, limit=limit)
    covered = W.coverage(attempts)
    head = W.search_stats(works, limit or 0).select(F.lit("search").alias("mode"), F.lit(query).alias("query"), F.struct("raw_hits", "after_dedup", "shown", "truncated").alias("stats"))
    head = _beside(head, W.network_status(covered), _one_list(covered, "source", "coverage"), _one_list(W.advisories(works).filter("advised"), "dim", "advisories"))
    return document(head, ranked, "works")


def author_payload(query: str, candidates: DataFrame, reported: int | None = None, limit: int | None = None) -> DataFrame:
    """An author search's document: candidates and what a reader must see of them; no one is chosen."""
    merged = W.merge_authors(candidates)
    head = W.author_warnings(merged, reported).select(F.lit("find_author").alias("mode"), F.lit(query).alias("query"), F.lit(reported).cast("long").alias("total_found"), F.struct("*").alias("warnings"))
    return document(head, W.rank_authors(merged, limit), "candidates")


def verify_payload(judged: DataFrame, queries: DataFrame) -> DataFrame:
    """A verified list's document: states with counts, calls and the network, and the references in
    the order of their ids."""
    numbered = W.numbered(judged, [F.col("ref_id")], "rank")
    head = _beside(V.batch_stats(queries).select(F.lit("verify").alias("mode"), F.struct("*").alias("stats")), _one_list(V.distribution(judged), "position", "by_status"))
    return document(head, numbered, "items")
