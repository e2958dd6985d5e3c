"""Fixed-length sequences by shortest-pack-first over the histogram of lengths.

Documents become token ids and end with id 0; a document longer than a sequence
is cut at multiples of its length. The driver sees the number of pieces of each
length only. From the longest length down, pieces join the shortest packs they
fit, run by run: a run is a number of packs filled alike, so the rows of the plan
hang on the number of lengths and not of documents. Where no pack fits, only as
many are opened as the pieces of that length need if they share. Pieces find
their places by their rank within their length.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from citeloom.llm.common import lean, pieces, ranked, settle
from citeloom.llm.token_counts import byte_signs, unsettled

#: Tokens of a sequence; the id that ends a document.
LENGTH, END = 1024, 0

#: How the byte-level tokenizer splits a text (the published pattern of its kind).
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PROBES = ["", "a", "It's 12 o'clock,\n\n  isn't it? ", "é中\U0001f600 <|endoftext|>x <|endoftext|> ", "  \t\r\n x" + "ab" * 80]


class Encoder:
    """Token ids as a byte-level tokenizers file gives them.

    A faster library runs the same merges; it is used only if it agrees with the
    file's own on probes that cover splitting, bytes and special strings. Texts
    that it can't split, and those with letters on which Unicode tables of
    different years may disagree, go to the file's own.
    """

    def __init__(self, path: str) -> None:
        self.own = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        signs = byte_signs()
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(signs[c] for c in v): i for v, i in spec["model"]["vocab"].items() if v not in special}
        fast = tiktoken.Encoding("own", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens=special)
        self.fast = fast if all(fast.encode(p, allowed_special="all") == self.slow(p) for p in _PROBES) else None

    def slow(self, text: str) -> list[int]:
        return self.own.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> np.ndarray:
        """The ids of a text, little-endian and unsigned."""
        if self.fast is not None and (text.isascii() or not unsettled().search(text)):
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)
            except ValueError:  # its pattern gave up on a very long run of blanks
                pass
        return np.array(self.slow(text), "<u4")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


@dataclass
class Run:
    """`count` packs filled alike: (length, first rank, offset) of what each holds."""

    count: int
    fill: int
    slots: list[tuple[int, int, int]]

    def split(self, n: int) -> tuple[Run, Run | None]:
        """The first n packs, and the others if there are any."""
        if n == self.count:
            return self, None
        rest = [(length, rank + n, at) for length, rank, at in self.slots]
        return Run(n, self.fill, self.slots), Run(self.count - n, self.fill, rest)


def plan(histogram: dict[int, int], length: int = LENGTH) -> list[Run]:
    """Packs for the pieces of a histogram, shortest pack first, longest piece first."""
    by_fill: dict[int, list[Run]] = {}
    for size in sorted(histogram, reverse=True):
        left, rank = histogram[size], 0
        placed: list[Run] = []
        while left:
            fill = min(by_fill, default=length)
            if fill + size > length:
                run, fill = Run(-(-left // (length // size)), 0, []), 0
            else:
                run = by_fill[fill].pop()
                if not by_fill[fill]:
                    del by_fill[fill]
                run, rest = run.split(min(left, run.count))
                if rest:
                    by_fill.setdefault(fill, []).append(rest)
            left -= run.count
            placed.append(Run(run.count, fill + size, [*run.slots, (size, rank, fill)]))
            rank += run.count
            if placed[-1].fill + size <= length:
                by_fill.setdefault(placed[-1].fill, []).append(placed.pop())
        for run in placed:
            by_fill.setdefault(run.fill, []).append(run)
    return [run for fill in sorted(by_fill, reverse=True) for run in by_fill[fill]]


PIECE = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens")])


def token_pieces(docs: DataFrame, path: str, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and ids) of each piece of each document."""
    fields = [docs.schema["doc_id"], *PIECE.fields] + [T.StructField("ids", T.BinaryType())] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for whole in batches:
            for batch in pieces(whole):
                rows: list[list] = [[], [], [], [], [], []]
                for k, text in enumerate(batch.column("text").to_pylist()):
                    ids = np.append(e.ids(text or ""), np.uint32(END)).astype("<u4", copy=False)
                    for at in range(0, len(ids), length):
                        part = ids[at : at + length].tobytes()
                        for column, v in zip(rows, (k, at, len(part) // 4, zlib.crc32(part), len(ids), part)):
                            column.append(v)
                columns = [batch.column("doc_id").take(pa.array(rows[0], pa.int64())), *(pa.array(c, pa.int64()) for c in rows[1:5])]
                names = ["doc_id", *PIECE.names]
                if with_ids:
                    columns, names = [*columns, pa.array(rows[5], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select("doc_id", "text").mapInArrow(lean(cut), T.StructType(fields))


def pack(docs: DataFrame, path: str, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents with the sequence and offset of each.

    Null text counts as empty: id 0 alone. Each row is a document of its own,
    though rows repeat; a null doc_id is carried. An empty table gives no rows.
    Columns beside doc_id and text are not read, whatever their names.
    Sequence ids are gapless from 0, offsets gapless in a sequence. `with_ids`
    adds the ids (little-endian unsigned 32-bit), for `sequences`.
    """
    cut = settle(token_pieces(docs, path, length, with_ids))
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows, base = [], 0
    for run in plan(counts, length):
        rows += [(size, rank, rank + run.count, base - rank, at) for size, rank, at in run.slots]
        base += run.count
    # for each of `length` lengths a row for each run and each time it was filled
    shape = "p_length long, p_from long, p_to long, p_base long, offset long"
    places = F.broadcast(docs.sparkSession.createDataFrame(rows, shape))
    by_rank = ranked(cut, ["length"], ["doc_id", "start", "ids_crc32"], "_rank")
    held = (F.col("length") == F.col("p_length")) & (F.col("_rank") >= F.col("p_from")) & (F.col("_rank") < F.col("p_to"))
    return by_rank.join(places, held).select(
        *cut.columns, (F.col("p_base") + F.col("_rank")).alias("sequence_id"), "offset"
    )


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and the ids of each sequence, from pieces packed with their ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most a sequence's tokens
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids")
    )
