"""Removal of every byte of a passage that stood earlier, by suffix arrays.

A passage is any `LENGTH`-byte string. Each has an anchor: of the `GRAM`-byte
strings in it the one with the least hash, so equal passages have equal anchors
in equal places. Passages whose anchor occurs once in the corpus occur once.

1. Anchors of all documents, a document per distinct text, are counted in
   `exchange`. A run of passages with one shared anchor makes a segment of text.
2. Documents are numbered in their order. A task settles the copies of a segment
   that it holds, keeps the earliest, and sends those it keeps to buckets by
   anchor, so equal passages meet; what moves are blobs of many segments.
   Segments of a frequent anchor are cut short and dealt by their common middle.
3. A bucket's segments are cut by anchor into shards, a shard's are one text; its
   suffix array is induced, and permuted common prefixes of `LENGTH` or more make
   the classes of equal passages. The earliest of a class stays.
4. Documents drop the union of what is found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.llm.common import fields, lean, matched, partitions, pieces, stored, whole_text, with_groups
from citeloom.llm.exchange import Answer, Chunk, shared_tokens
from citeloom.llm.suffixes import common_prefixes, suffix_array

#: Bytes of a passage and of an anchor.
LENGTH, GRAM = 100, 32
#: Bits of a place: of hashes the others are compared, however long the text is, and of equals the
#: first counts. A text has less than 2 GB.
PLACE = np.uint64(32)
#: Anchors of a chunk; count from which an anchor is frequent; passages of its short segments.
CHUNK, FREQUENT, SHORT = 500_000, 500, 8
#: Bytes of text in one suffix array, and of the segments of one bucket.
SHARD, BUCKET = 2 << 20, 8 << 20
#: Bytes of documents handled at once; segments that a task remembers.
SLICE, REMEMBERED = 2 << 20, 1 << 18

_BYTE = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)]


def _gram_hashes(b: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place."""
    h, size, k = _BYTE[b], 1, 0
    while size < GRAM:
        h = h[:-size] * _ODD[k] + h[size:]
        size, k = size * 2, k + 1
    h ^= h >> np.uint64(31)
    h *= _ODD[3]
    h ^= h >> np.uint64(29)
    return h


def anchors(b: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that stand one behind the other in `b`: runs of passages with one anchor.

    Returns each run's first passage, one past its last, and the anchor's place and
    hash. A run is of one text; texts shorter than LENGTH have none.
    """
    none = np.zeros(0, np.int64)
    if len(b) < LENGTH:
        return none, none, none, np.zeros(0, np.uint64)
    h = _gram_hashes(b)
    low = (h >> PLACE << PLACE) | np.arange(len(h), dtype=np.uint64)
    size, width = 1, LENGTH - GRAM + 1
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < width:
        low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
    at = (low & ((np.uint64(1) << PLACE) - np.uint64(1))).astype(np.int64)
    ends = np.r_[starts[1:], len(b)]
    valid = np.zeros(len(at) + 1, np.int64)
    long = ends - starts >= LENGTH
    np.add.at(valid, starts[long], 1)
    np.add.at(valid, ends[long] - LENGTH + 1, -1)
    valid = np.cumsum(valid[:-1]) > 0
    fresh = np.r_[True, at[1:] != at[:-1]]
    fresh |= np.r_[True, ~valid[:-1]]
    edge = np.zeros(len(at) + 1, bool)
    edge[starts[long]] = True
    begin = np.flatnonzero((fresh | edge[:-1]) & valid)
    stop = np.r_[begin[1:], len(at)]
    # a run also ends where its text's last passage does
    owner = np.searchsorted(starts, begin, side="right") - 1
    stop = np.minimum(stop, ends[owner] - LENGTH + 1)
    return begin, stop, at[begin], h[at[begin]]


def _bytes_of(texts: pa.Array) -> list[bytes]:
    return [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in texts]


class _Chunks:
    """Rows of documents to chunks of anchors."""

    def __init__(self, id_kind: pa.DataType) -> None:
        self.id_kind = id_kind

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
        self._clear()
        for batch in (x for whole in batches for x in pieces(whole, limit=SLICE)):
            texts = _bytes_of(batch.column("text"))
            ids, rows = batch.column("doc_id").to_pylist(), batch.column("row").to_pylist()
            order = sorted(range(len(ids)), key=lambda k: _rank(ids[k], rows[k]))
            held: list[tuple[int, bytes]] = []
            for k in order:
                t = texts[k]
                digest = hashlib.blake2b(t, digest_size=16).digest()
                fresh = digest not in self.seen
                self.seen.add(digest)
                self.docs.append((ids[k], rows[k], len(t), digest))
                if fresh and len(t) >= LENGTH:
                    held.append((len(self.docs) - 1, t))
            self._scan(held)
            if self.count > CHUNK:
                yield self._close()
        if self.docs:
            yield self._close()

    def _clear(self) -> None:
        self.seen: set[bytes] = set()
        self.docs: list[tuple] = []
        self.found: list[tuple[np.ndarray, ...]] = []
        self.count = 0

    def _scan(self, held: list[tuple[int, bytes]]) -> None:
        if not held:
            return
        starts = np.cumsum([0, *(len(t) for _, t in held[:-1])])
        begin, stop, anchor, h = anchors(np.frombuffer(b"".join(t for _, t in held), np.uint8), starts)
        which = np.searchsorted(starts, begin, side="right") - 1
        doc = np.array([k for k, _ in held], np.int64)[which]
        self.found.append((doc, begin - starts[which], stop - starts[which], anchor - starts[which], h))
        self.count += len(h)

    def _close(self) -> Chunk:
        parts = list(zip(*self.found)) or [[np.zeros(0, np.int64)]] * 4 + [[np.zeros(0, np.uint64)]]
        doc, begin, stop, anchor, h = (np.concatenate(p) for p in parts)
        first = np.array([int.from_bytes(d[3][:4], "little") for d in self.docs], np.uint32)
        owner = first[doc] if len(doc) else np.zeros(0, np.uint32)
        # an anchor's later places in one document count as another owner's
        order = np.lexsort((begin, doc, h))
        again = np.r_[False, (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])] if len(h) else np.zeros(0, bool)
        run = np.arange(len(h)) - np.maximum.accumulate(np.where(again, 0, np.arange(len(h)))) if len(h) else np.zeros(0, np.int64)
        owner[order] += run.astype(np.uint32)
        docs = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*self.docs), (self.id_kind, pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "row", "n_bytes", "digest"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, docs.schema) as w:
            w.write_batch(docs)
        kept = np.array([len(doc)], "<u4").tobytes() + doc.astype("<u4").tobytes() + begin.astype("<u4").tobytes() + stop.astype("<u4").tobytes() + anchor.astype("<u4").tobytes() + sink.getvalue().to_pybytes()
        out = Chunk(h, np.arange(len(h)), kept, owner)
        self._clear()
        return out


def _rank(doc_id: object, row: int) -> tuple:
    """Order of documents: by id, null last, then by a hash of the text."""
    return (doc_id is None, doc_id if doc_id is not None else 0, row)


_SEGMENT = np.dtype([("hash", "<u8"), ("from", "<u4"), ("to", "<u4"), ("anchor", "<u4"), ("often", "<u4")])


def _finish(answer: Answer, number: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """A chunk's documents, each distinct text's first with its segments."""
    raw = answer.kept
    n = int(np.frombuffer(raw[:4], "<u4")[0])
    doc, begin, stop, anchor = (np.frombuffer(raw[4 + 4 * n * k : 4 + 4 * n * (k + 1)], "<u4") for k in range(4))
    docs = pa.ipc.open_stream(raw[4 + 16 * n :]).read_next_batch()
    order = np.argsort(answer.holders)
    held = answer.holders[order]
    seg = np.zeros(len(held), _SEGMENT)
    seg["hash"], seg["from"], seg["to"], seg["anchor"], seg["often"] = answer.tokens[order], begin[held], stop[held], anchor[held], answer.counts[order]
    by_doc = np.argsort(doc[held], kind="stable")
    seg, owner = seg[by_doc], doc[held][by_doc]
    at = np.searchsorted(owner, np.arange(docs.num_rows + 1))
    carried = [seg[at[k] : at[k + 1]].tobytes() if at[k + 1] > at[k] else None for k in range(docs.num_rows)]
    yield pa.RecordBatch.from_arrays([*docs.columns, pa.array(carried, pa.binary())], names=names)


_SENT = T.StructType(fields("kind int, deal long, ord long, at long, stop long, blob binary"))
_SENT_ARROW = pa.schema([("kind", pa.int32()), ("deal", pa.int64()), ("ord", pa.int64()), ("at", pa.int64()), ("stop", pa.int64()), ("blob", pa.binary())])
_RUNS = T.StructType(fields("ord long, at long, stop long"))


@dataclass
class Segments:
    """Runs of passages [at, stop) of documents `ord`, each with where it is dealt and its bytes."""

    ord: np.ndarray
    route: np.ndarray
    at: np.ndarray
    stop: np.ndarray
    data: bytes | np.ndarray

    @classmethod
    def read(cls, blobs: list[bytes]) -> Segments:
        """What `blob` wrote, several together."""
        parts: list[list[np.ndarray]] = [[], [], [], [], []]
        for raw in blobs:
            n = int(np.frombuffer(raw[:4], "<u4")[0])
            edges = np.cumsum([4, 8 * n, 8 * n, 4 * n, 4 * n]).tolist()
            for k, kind in enumerate(("<i8", "<u8", "<u4", "<u4")):
                parts[k].append(np.frombuffer(raw[edges[k] : edges[k + 1]], kind))
            parts[4].append(np.frombuffer(raw[edges[4] :], np.uint8))
        ord_, route, at, stop, data = (np.concatenate(p) for p in parts)
        return cls(ord_, route, at.astype(np.int64), stop.astype(np.int64), data)

    @property
    def sizes(self) -> np.ndarray:
        return self.stop - self.at + LENGTH - 1

    def blob(self) -> bytes:
        parts = (self.ord.astype("<i8"), self.route.astype("<u8"), self.at.astype("<u4"), self.stop.astype("<u4"), self.data)
        return np.uint32(len(self.ord)).tobytes() + b"".join(p.tobytes() for p in parts)

    def take(self, which: np.ndarray) -> Segments:
        sizes = self.sizes
        starts = np.cumsum(sizes) - sizes
        return Segments(self.ord[which], self.route[which], self.at[which], self.stop[which], _gathered(self.data, starts[which], sizes[which]))


def _gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of ranges, one behind the other."""
    ends = np.cumsum(sizes)
    return data[np.repeat(starts - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a text or binary column without nulls."""
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return at - at[0], np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)


def _joined(ord_: np.ndarray, at: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs that touch, as one; they do not overlap."""
    order = np.lexsort((at, ord_))
    ord_, at, stop = ord_[order], at[order], stop[order]
    fresh = np.r_[True, (ord_[1:] != ord_[:-1]) | (at[1:] != stop[:-1])][: len(ord_)]
    heads = np.flatnonzero(fresh)
    return ord_[heads], at[heads], stop[np.r_[heads[1:], len(ord_)] - 1] if len(heads) else stop


def _short(text: memoryview, h: int, a: int, b: int, anchor: int) -> Iterator[tuple[int, int, int]]:
    """A run cut at the same distances from its anchor everywhere: from, to, and a hash of
    the bytes that all passages of that distance have in common."""
    p = a
    while p < b:
        block = (anchor - p) // SHORT
        q = min(b, anchor - block * SHORT + 1)
        middle = text[anchor - block * SHORT : anchor - block * SHORT + LENGTH - SHORT + 1]
        key = hashlib.blake2b(middle, digest_size=8, salt=block.to_bytes(2, "little"), key=h.to_bytes(8, "little"))
        yield p, q, int.from_bytes(key.digest(), "little")
        p = q


class _Cutter:
    """Documents with their segments to those that a task keeps (kind 0, blobs by bucket)
    and to runs of passages that stood earlier (kind 1)."""

    def __init__(self, buckets: int, frequent: int) -> None:
        self.buckets, self.frequent = buckets, frequent

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        #: digest of a segment -> the earliest document that held it
        self.seen: dict[bytes, int] = {}
        for whole in batches:
            for batch in pieces(whole, limit=SLICE):
                yield from self.slice(batch)

    def slice(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ords = batch.column("ord").to_numpy()
        base, text = _flat(batch.column("text"))
        seg_at, raw = _flat(batch.column("segs"))
        seg = np.frombuffer(raw.tobytes(), _SEGMENT)
        doc = np.repeat(np.arange(len(ords)), np.diff(seg_at) // _SEGMENT.itemsize)
        order = np.lexsort((seg["from"], ords[doc]))
        seg, doc = seg[order], doc[order]
        ord_, begin = ords[doc], base[doc]
        at, stop = seg["from"].astype(np.int64), seg["to"].astype(np.int64)
        fresh = np.zeros(len(seg), bool)
        view, seen = memoryview(text), self.seen
        for k, (a, b, o) in enumerate(zip((begin + at).tolist(), (begin + stop + LENGTH - 1).tolist(), ord_.tolist())):
            key = hashlib.blake2b(view[a:b], digest_size=16).digest()
            if seen.setdefault(key, o + 1) > o:  # not met, or met in a later document only
                seen[key] = o
                fresh[k] = True
        if len(seen) > REMEMBERED:
            seen.clear()
        lost = _joined(ord_[~fresh], at[~fresh], stop[~fresh])
        if len(lost[0]):
            yield _sent(1, lost[0], *lost)
        often = fresh & (seg["often"] >= self.frequent)
        rare = np.flatnonzero(fresh & ~often)
        made = [(ord_[rare], seg["hash"][rare], at[rare], stop[rare], begin[rare])]
        cut = []
        for k in np.flatnonzero(often).tolist():
            start = int(begin[k])
            here = view[start : start + int(base[doc[k] + 1] - base[doc[k]])]
            cut += [(ord_[k], route, p, q, start) for p, q, route in _short(here, int(seg["hash"][k]), int(at[k]), int(stop[k]), int(seg["anchor"][k]))]
        if cut:
            made.append(tuple(np.array(c, kind) for c, kind in zip(zip(*cut), (np.int64, np.uint64, np.int64, np.int64, np.int64))))
        ord_, route, at, stop, begin = (np.concatenate(c) for c in zip(*made))
        if not len(ord_):
            return
        bucket = (_spread(route) % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.flatnonzero(np.diff(bucket[order])) + 1
        blobs, deals = [], []
        for which in np.split(order, edges):
            starts = begin[which] + at[which]
            blobs.append(Segments(ord_[which], route[which], at[which], stop[which], _gathered(text, starts, stop[which] - at[which] + LENGTH - 1)).blob())
            deals.append(int(bucket[which[0]]))
        zero = np.zeros(len(deals), np.int64)
        yield _sent(0, np.array(deals), zero, zero, zero, blobs)


def _spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _ODD[3]
    return h ^ (h >> np.uint64(29))


def _sent(kind: int, deal: np.ndarray, ord_: np.ndarray, at: np.ndarray, stop: np.ndarray, blobs: list[bytes] | None = None) -> pa.RecordBatch:
    n = len(deal)
    columns = [np.full(n, kind), deal, ord_, at, stop]
    return pa.RecordBatch.from_arrays([*(pa.array(c, t.type) for c, t in zip(columns, _SENT_ARROW)), pa.array(blobs or [None] * n, pa.binary())], schema=_SENT_ARROW)


def _settled(found: Segments) -> tuple[Segments, list[tuple[np.ndarray, ...]]]:
    """Of equal segments the earliest, and the runs of the others."""
    view, sizes = memoryview(found.data), found.sizes
    ends = np.cumsum(sizes)
    index: dict[bytes, int] = {}
    group = np.array([index.setdefault(hashlib.blake2b(view[a:b], digest_size=16).digest(), len(index)) for a, b in zip((ends - sizes).tolist(), ends.tolist())], np.int64)
    order = np.lexsort((found.at, found.ord, group))
    first = np.r_[True, group[order][1:] != group[order][:-1]]
    lost = order[~first]
    return found.take(order[first]), [(found.ord[lost], found.at[lost], found.stop[lost])]


def _numbers(n: int) -> np.ndarray:
    """What parts the texts of n segments: a sign that no text has, and the segment's number,
    so that no common prefix goes beyond a segment."""
    digits = [np.ones(n, np.int16)]
    left = np.arange(n)
    while not digits[1:] or left.any():
        digits.append((left % 256 + 2).astype(np.int16))
        left = left // 256
    return np.stack(digits, 1)


def _classes(kept: Segments) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of passages of a shard's segments, all different, that stood earlier."""
    sizes = kept.sizes
    number = _numbers(len(sizes))
    starts = np.cumsum(sizes + number.shape[1]) - sizes - number.shape[1]
    ends = np.cumsum(sizes)
    t = np.zeros(int(ends[-1]) + number.size + 1, np.int16)
    t[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1])] = kept.data.astype(np.int16) + 2
    t[(starts + sizes)[:, None] + np.arange(number.shape[1])] = number
    order = suffix_array(t)
    share = common_prefixes(t, order)
    owner = np.zeros(len(t), np.int64)
    owner[starts[1:]] = 1
    owner = np.cumsum(owner)
    passage = np.arange(len(t)) - starts[owner] < (kept.stop - kept.at)[owner]
    # suffixes that are no passage share less than LENGTH with one that is
    group = np.cumsum(share[order] < LENGTH)[passage[order]]
    where = order[passage[order]]
    doc = np.unique(kept.ord, return_inverse=True)[1]
    key = doc[owner[where]] << 32 | kept.at[owner[where]] + where - starts[owner[where]]
    heads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    late = np.zeros(len(t), bool)
    late[where] = key != np.repeat(np.minimum.reduceat(key, heads), np.diff(np.r_[heads, len(key)]))
    a = np.flatnonzero(late & ~np.r_[False, late[:-1]])
    b = np.flatnonzero(late & ~np.r_[late[1:], False]) + 1
    at = kept.at[owner[a]] + a - starts[owner[a]]
    return kept.ord[owner[a]], at, at + b - a


def _bucket(blobs: list[bytes], shard: int) -> pa.RecordBatch:
    """All segments of one bucket to runs of passages that stood earlier."""
    kept, lost = _settled(Segments.read(blobs))
    order = np.argsort(kept.route, kind="stable")
    kept = kept.take(order)
    edge = np.flatnonzero(np.r_[True, kept.route[1:] != kept.route[:-1]])
    done = np.cumsum(np.add.reduceat(kept.sizes, edge)) // shard
    cuts = edge[np.flatnonzero(np.diff(done)) + 1].tolist()
    for a, b in zip([0, *cuts], [*cuts, len(order)]):
        lost.append(_classes(kept.take(np.arange(a, b))))
    ord_, at, stop = _joined(*(np.concatenate(c) for c in zip(*lost)))
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (ord_, at, stop)], names=["ord", "at", "stop"])


def _shard(batches: Iterator[pa.RecordBatch], shard: int) -> Iterator[pa.RecordBatch]:
    """Blobs sorted by bucket to runs of passages that stood earlier; settled runs pass."""
    now, blobs = None, []
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        settled = batch.filter(pa.array(kind == 1)).select(["ord", "at", "stop"])
        if settled.num_rows:
            yield settled
        deal, column = batch.column("deal").to_numpy(), batch.column("blob")
        for k in np.flatnonzero(kind == 0).tolist():
            if deal[k] != now:
                if blobs:
                    yield _bucket(blobs, shard)
                now, blobs = deal[k], []
            blobs.append(column[k].as_buffer().to_pybytes())
    if blobs:
        yield _bucket(blobs, shard)


def _remove(text: bytes, a: np.ndarray, b: np.ndarray) -> tuple[bytes, int, int]:
    """Text without the passages that start in the runs [a, b), bytes and spans removed."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order] - 1 + LENGTH
    far = np.maximum.accumulate(b)
    fresh = np.r_[True, a[1:] > far[:-1]]
    start, end = a[fresh], far[np.r_[np.flatnonzero(fresh)[1:] - 1, len(a) - 1]]
    parts, at = [], 0
    for s, e in zip(start.tolist(), end.tolist()):
        parts.append(text[at:s])
        at = e
    parts.append(text[at:])
    return b"".join(parts), int((end - start).sum()), len(start)


def _dropped(batches: Iterator[pa.RecordBatch], names: list[str], with_text: bool) -> Iterator[pa.RecordBatch]:
    """Documents with their runs to what is left of them."""
    for batch in (x for whole in batches for x in pieces(whole, limit=SLICE)):
        runs = batch.column("runs")
        edges = np.asarray(runs.offsets)
        edges, flat = (edges - edges[0]).tolist(), runs.flatten()
        at, stop = (np.asarray(flat.field(c)) for c in (0, 1))
        rows = []
        for text, a, b in zip(_bytes_of(batch.column("text")), edges, edges[1:]):
            kept, gone, spans = _remove(text, at[a:b], stop[a:b])
            rows.append((gone, spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
        made = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.binary()))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), *made], names=names)


def removed(docs: DataFrame, with_text: bool = True, frequent: int = FREQUENT, bucket: int = BUCKET, shard: int = SHARD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept_text (where bytes went) of each row.

    A byte goes if a LENGTH-byte string over it also starts earlier: in a document
    of smaller id, or earlier in the same. Texts are UTF-8 bytes; null counts as
    empty. Rows that repeat doc_id and text are one document, and each gets its
    result; texts that share a doc_id are ordered by a hash. A null doc_id comes
    after all others. Other columns are not read. kept_text is binary, as a cut
    may fall inside a letter; it is null without `with_text`. doc_id is an
    integer, a long or a string.
    """
    id_field = docs.schema["doc_id"]
    id_kind = pa.int32() if isinstance(id_field.dataType, T.IntegerType) else pa.int64() if isinstance(id_field.dataType, T.LongType) else pa.string()
    width = partitions(docs.sparkSession)
    keyed = docs.select("doc_id", F.xxhash64(whole_text()).alias("row"), whole_text().alias("text"))
    names = ["doc_id", "row", "n_bytes", "digest", "segs"]
    schema = T.StructType([id_field, *fields("row long, n_bytes long, digest binary, segs binary")])
    chunks = _Chunks(id_kind)
    found = stored(shared_tokens(keyed, lambda b: chunks(b), lambda a, k: _finish(a, k, names), schema, owned=True))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    groups = found.groupBy("digest").agg(F.min(order).alias("first"), F.first("segs", ignorenulls=True).alias("segs"), F.count(F.lit(1)).alias("k"))
    groups = stored(groups.select("digest", "k", F.col("first.doc_id").alias("doc_id"), F.col("first.row").alias("row"), "segs"))
    by = [F.col("doc_id").isNull(), F.col("doc_id"), F.col("row")]
    numbered = groups.filter(F.col("segs").isNotNull()).select("doc_id", "row", "segs").repartitionByRange(width, *by).sortWithinPartitions(*by)
    numbered = stored(numbered.withColumn("ord", F.monotonically_increasing_id()))
    texts = stored(_first_rows(keyed, numbered))
    # bytes of all segments: a run of passages and what its last one reaches beyond its start
    total = numbered.agg(F.coalesce(F.sum(F.octet_length("segs")), F.lit(0)).alias("b")).first().b * LENGTH // _SEGMENT.itemsize
    buckets = max(width, -(-total // bucket))
    cutter = _Cutter(buckets, frequent)
    cut = texts.select("ord", "text", "segs").mapInArrow(lean(lambda b: cutter(b)), _SENT)
    dealt = cut.repartition(min(buckets, 8 * width), "kind", "deal").sortWithinPartitions("kind", "deal")
    runs = dealt.mapInArrow(lean(lambda b: _shard(b, shard)), _RUNS)
    per_doc = runs.groupBy("ord").agg(F.collect_list(F.struct("at", "stop")).alias("runs"))  # runs of one document
    left = ["doc_id", "row", "n_removed", "n_spans", "kept_sha256", "kept_text"]
    schema = T.StructType([id_field, *fields("row long, n_removed long, n_spans long, kept_sha256 string, kept_text binary")])
    partly = texts.select("ord", "doc_id", "row", "text").join(per_doc, "ord").select("doc_id", "row", "text", "runs")
    partly = partly.mapInArrow(lean(lambda b: _dropped(b, left, with_text)), schema)
    copies = with_groups(found.select("doc_id", "row", "n_bytes", "digest"), groups.select("digest", "k", F.col("doc_id").alias("f_doc"), F.col("row").alias("f_row")), ["digest"], "k")
    copies = copies.filter((F.col("n_bytes") >= LENGTH) & ~(F.col("doc_id").eqNullSafe(F.col("f_doc")) & (F.col("row") == F.col("f_row"))))
    empty = F.sha2(F.lit(""), 256)
    whole = copies.select("doc_id", "row", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), empty.alias("kept_sha256"), F.lit(b"" if with_text else None).cast("binary").alias("kept_text"))
    gone = partly.unionByName(whole.distinct())
    plain = keyed.select("doc_id", "row", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("own"))
    return matched(plain, gone, ["doc_id", "row"], "left").select(
        "doc_id", "n_bytes",
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("kept_sha256", "own").alias("kept_sha256"), "kept_text",
    )


def _first_rows(keyed: DataFrame, numbered: DataFrame) -> DataFrame:
    """The rows of `keyed` that `numbered` names by doc_id and row, one of each, with its columns."""
    at = F.xxhash64("doc_id", "row")
    named = numbered.select(at.alias("_n"), F.col("doc_id").alias("_doc"), F.col("row").alias("_own"), "ord", "segs")
    rows = keyed.withColumn("_k", at)
    joined = rows.join(named, (F.col("_k") == F.col("_n")) & F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("row") == F.col("_own")))
    copy = F.row_number().over(Window.partitionBy("_k", "ord").orderBy(F.lit(1)))
    return joined.withColumn("_copy", copy).filter("_copy = 1").select("ord", "doc_id", "row", "text", "segs")
