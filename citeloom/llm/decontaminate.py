"""Benchmark passages in documents, found with one Aho-Corasick automaton.

Items are cut into windows of ten words (a shorter item is one window). Each
distinct window is a pattern between two spaces; a document is normalised to its
words with single spaces around them and scanned once, so matches are whole
words. Word numbers map back to offsets in the original text, which are worked
out for documents with a hit only.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.llm.common import fresh, lean, pieces

#: Words of a window.
WINDOW = 10
#: Bytes of item text that one automaton may hold; more items make more automata.
ITEM_BYTES = 8 << 20

#: A-Z to lower case; every other ASCII sign but 0-9 and a-z parts words.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    """The normalised words of a text, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def windows(text: str | None, size: int = WINDOW) -> Iterator[bytes]:
    """The windows of an item."""
    w = words(text)
    for k in range(max(1, len(w) - size + 1) if w else 0):
        yield b" ".join(w[k : k + size])


class Found(NamedTuple):
    """What one document holds of the items: its words, the hit ones, the items."""

    n_words: int
    hit: list[int]
    items: set[str]


class Matcher:
    """The automaton over the windows of some items."""

    def __init__(self, items: list[tuple[str, str | None]], size: int = WINDOW) -> None:
        held: dict[bytes, set[str]] = {}
        for item, text in items:
            for w in windows(text, size):
                held.setdefault(w, set()).add(item)
        self.automaton = ahocorasick.Automaton()
        for w, owners in held.items():
            self.automaton.add_word(f" {w.decode('utf-8', 'surrogatepass')} ", (w.count(b" ") + 1, sorted(owners)))
        self.empty = not held
        if held:
            self.automaton.make_automaton()

    def find(self, w: list[bytes]) -> Found:
        """Scans the words of a document once."""
        if self.empty or not w:
            return Found(len(w), [], set())
        joined = f" {b' '.join(w).decode('utf-8', 'surrogatepass')} "
        ends = list(self.automaton.iter(joined))
        if not ends:
            return Found(len(w), [], set())
        hit: set[int] = set()
        items: set[str] = set()
        at, number = 0, 0
        for end, (n, owners) in ends:
            number += joined.count(" ", at, end)
            at = end
            hit.update(range(number - n, number))
            items.update(owners)
        return Found(len(w), sorted(hit), items)


def spans(text: str, hit: list[int]) -> list[tuple[int, int]]:
    """Code-point offsets in the original text of maximal runs of hit words."""
    wanted, runs = set(hit), []
    last = -2
    for k, m in enumerate(_WORD.finditer(text)):
        if k in wanted:
            if last == k - 1:
                runs[-1] = (runs[-1][0], m.end())
            else:
                runs.append(m.span())
            last = k
    return runs


_built: dict[tuple, Matcher] = {}


def _matchers(blocks: list[tuple[str, Broadcast]], size: int) -> list[Matcher]:
    """The automata of a benchmark's blocks, built once in a worker and kept until another is asked for.

    A block's name is a digest of what it holds. Its Broadcast's address would not
    do: a worker that is used again may have another block there.
    """
    keys = [(name, size) for name, _ in blocks]
    for key in set(_built) - set(keys):
        del _built[key]
    for key, (_, block) in zip(keys, blocks):
        if key not in _built:
            _built[key] = Matcher(block.value, size)
    return [_built[key] for key in keys]


#: What a document is given beside its own columns.
COLUMNS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("n_items", T.LongType()),
    T.StructField("items_sha256", T.StringType()),
    T.StructField("item_ids", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
]


def _blocks(items: DataFrame, limit: int) -> list[tuple[str, Broadcast]]:
    """The items, in blocks of a bounded size, each named by what it holds."""
    spark = items.sparkSession
    kept = items.select(F.col("item_id").cast("string").alias("i"), F.coalesce("text", F.lit("")).alias("t")).distinct()
    total = kept.agg(F.coalesce(F.sum(F.octet_length("t") + 16), F.lit(0)).alias("b")).first().b
    n = max(1, -(-2 * total // limit)) if total > limit else 1
    out = []
    for k in range(n):
        part = kept if n == 1 else kept.filter(F.pmod(F.xxhash64("i"), F.lit(n)) == k)
        held = sorted((r.i or "", r.t) for r in part.collect())
        name = hashlib.sha256(repr(held).encode("utf-8", "surrogatepass")).hexdigest()
        out.append((name, spark.sparkContext.broadcast(held)))
    return out


def find_items(docs: DataFrame, items: DataFrame, size: int = WINDOW, limit: int = ITEM_BYTES, keep: list[str] | None = None) -> DataFrame:
    """`docs`' columns in `keep` (default doc_id) with COLUMNS.

    Null text has no words, in documents and items alike; an item without words
    has no window. Items of equal id are one. Without items nothing is hit.
    Columns of `docs` that are not in `keep` are not returned, so no name clashes
    but those of COLUMNS, which replace them.
    """
    keep = [c for c in (keep or ["doc_id"]) if c not in {f.name for f in COLUMNS}]
    blocks = _blocks(items, limit)
    read = [*dict.fromkeys([*keep, "text"])]
    schema = T.StructType([docs.schema[c] for c in keep] + COLUMNS)
    kinds = pa.schema([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("item_ids", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = _matchers(blocks, size)
        for batch in (x for whole in batches for x in pieces(whole)):
            texts = batch.column("text").to_pylist()
            split = [words(t) for t in texts]
            hits: list[set[int]] = [set() for _ in texts]
            owners: list[set[str]] = [set() for _ in texts]
            for m in automata:
                for k, w in enumerate(split):
                    _, hit, found = m.find(w)
                    hits[k].update(hit)
                    owners[k].update(found)
            ids = [sorted(o) for o in owners]
            places = [[{"start": a, "end": b} for a, b in spans(t, h)] if h else [] for t, h in zip(texts, map(sorted, hits))]
            made = [
                pa.array([len(w) for w in split], pa.int64()),
                pa.array([len(h) for h in hits], pa.int64()),
                pa.array([len(o) for o in ids], pa.int64()),
                pa.array([hashlib.sha256(",".join(o).encode()).hexdigest() for o in ids], pa.string()),
                pa.array(ids, kinds.field("item_ids").type),
                pa.array(places, kinds.field("spans").type),
            ]
            held = batch.select(keep)
            yield pa.RecordBatch.from_arrays([*held.columns, *made], schema=pa.schema([*held.schema, *kinds]))

    return docs.select(*read).mapInArrow(lean(scan), schema)


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """The documents without any item's window, with all their columns, whatever their names."""
    own = {c: fresh(f"own_{c}", docs.columns) for c in docs.columns if c in {f.name for f in COLUMNS}}
    safe = docs.select(*[F.col(c).alias(own.get(c, c)) for c in docs.columns])
    found = find_items(safe, items, size, keep=safe.columns).filter("n_hit = 0")
    return found.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])
