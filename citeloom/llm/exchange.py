"""Which hashed tokens of a corpus occur more than once, found without a row per token.

A task hashes its rows' tokens in chunks. A chunk's tokens are sorted and cut by
their leading bits into one blob for each bucket; a bucket counts its tokens over
all chunks and answers each chunk with those that are shared and how often they
occur; chunk by chunk the answers meet what the chunk kept for itself. So the
rows that move are blobs of thousands of tokens. A token that a chunk holds many
times is sent to its bucket once, with its count, and its holders stay with the
chunk: no bucket grows with a frequent token.

Buckets see 48 bits of a token beside its leading bits. Two tokens that agree in
all of these count as one, which can only make a token look shared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from citeloom.llm.common import fields, give_back, lean, partitions

#: Tokens of a chunk; holders in one chunk from which a token is sent once.
CHUNK, FREQUENT = 500_000, 8
#: Counts are told exactly up to this; beyond it they only order tokens, which any order does.
MOST = 65_535

_MOVED = fields("kind int, key long, chunk long, blob binary")
_ARROW = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("chunk", pa.int64()), ("blob", pa.binary())])


def _planes(values: np.ndarray, width: int) -> bytes:
    """Little-endian byte planes, which compress where sorted values share bytes."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _values(raw: memoryview, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


@dataclass
class Chunk:
    """Tokens with the number of their holder, and what the chunk keeps for itself.

    `owners`, if given, tells of each holder who owns it: holders of one owner
    count once, unless `twice` is set for the token.
    """

    tokens: np.ndarray
    holders: np.ndarray
    kept: bytes
    owners: np.ndarray | None = None


@dataclass
class Answer:
    """What a chunk gets back: its shared tokens, their holders, and their counts."""

    tokens: np.ndarray
    holders: np.ndarray
    counts: np.ndarray
    kept: bytes


def _bits(buckets: int) -> int:
    return max(1, (buckets - 1).bit_length())


def _send(chunk: Chunk, number: int, bits: int) -> Iterator[tuple]:
    order = np.argsort(chunk.tokens)
    tok, holder = chunk.tokens[order], chunk.holders[order].astype(np.uint32)
    owner = np.zeros(len(tok), np.uint32) if chunk.owners is None else chunk.owners[order].astype(np.uint32)
    keys = tok >> np.uint64(64 - bits)
    low = (tok << np.uint64(bits)) >> np.uint64(16)  # 48 bits
    first = np.r_[True, (keys[1:] != keys[:-1]) | (low[1:] != low[:-1])] if len(tok) else np.zeros(0, bool)
    start = np.flatnonzero(first)
    count = np.diff(np.r_[start, len(tok)])
    often = np.repeat(count > FREQUENT, count)
    held = order[:0] if not len(tok) else np.flatnonzero(often)
    # what stays: (key, low, holder) of frequent tokens
    mine = np.uint32(len(held)).tobytes() + keys[held].astype("<u8").tobytes() + low[held].astype("<u8").tobytes() + holder[held].astype("<u4").tobytes() + chunk.kept
    yield 1, number, number, mine
    lone = np.flatnonzero(~often)
    big = start[count > FREQUENT]
    big_count = count[count > FREQUENT]
    edges = np.arange((1 << bits) + 1, dtype=np.uint64)
    lone_at = np.searchsorted(keys[lone], edges)
    big_at = np.searchsorted(keys[big], edges)
    for k in range(1 << bits):
        a, b = lone[lone_at[k] : lone_at[k + 1]], slice(big_at[k], big_at[k + 1])
        if len(a) or b.stop > b.start:
            blob = b"".join((
                np.array([len(a), b.stop - b.start], "<u4").tobytes(), _planes(low[a], 6), _planes(holder[a], 4),
                b"" if chunk.owners is None else owner[a].astype("<u4").tobytes(),
                _planes(low[big[b]], 6), np.minimum(big_count[b], MOST).astype("<u4").tobytes(),
            ))
            yield 0, k, number, blob


def _out(rows: Iterator[tuple], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[3])
        if size > limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), _ARROW)], schema=_ARROW)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), _ARROW)], schema=_ARROW)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, memoryview]]:
    for b in batches:
        kind, key, chunk = (b.column(c).to_numpy() for c in ("kind", "key", "chunk"))
        blobs = b.column("blob")
        for k in range(b.num_rows):
            yield int(kind[k]), int(key[k]), int(chunk[k]), memoryview(blobs[k].as_buffer())


def _answer(key: int, blobs: list[tuple[int, memoryview]], owned: bool) -> Iterator[tuple]:
    """One bucket: which of its tokens are shared, told to the chunks that hold them."""
    low, holder, owner, weight, where, lone = [], [], [], [], [], []
    for at, (_, raw) in enumerate(blobs):
        n, m = np.frombuffer(raw[:8], "<u4").tolist()
        p = 8
        low.append(_values(raw[p : p + 6 * n], n, 6))
        p += 6 * n
        holder.append(_values(raw[p : p + 4 * n], n, 4).astype(np.uint32))
        p += 4 * n
        if owned:
            owner.append(np.frombuffer(raw[p : p + 4 * n], "<u4"))
            p += 4 * n
        low.append(_values(raw[p : p + 6 * m], m, 6))
        p += 6 * m
        holder.append(np.zeros(m, np.uint32))
        owner.append(np.zeros(m if owned else n + m, np.uint32))
        weight += [np.ones(n, np.int64), np.frombuffer(raw[p : p + 4 * m], "<u4").astype(np.int64)]
        lone += [np.ones(n, bool), np.zeros(m, bool)]
        where.append(np.full(n + m, at, np.int64))
    t, h, o, w, c, a = (np.concatenate(x) for x in (low, holder, owner, weight, where, lone))
    order = np.argsort(t, kind="stable")
    t, h, o, w, c, a = t[order], h[order], o[order], w[order], c[order], a[order]
    start = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
    size = np.diff(np.r_[start, len(t)])
    total = np.add.reduceat(w, start)
    shared = total > 1
    if owned:
        mixed = np.maximum.reduceat(o, start) != np.minimum.reduceat(o, start)
        shared &= mixed | (np.add.reduceat((~a).astype(np.int64), start) > 0)
    pick = np.repeat(shared, size)
    total = np.minimum(np.repeat(total, size), MOST)[pick]
    t, h, c, a = t[pick], h[pick], c[pick], a[pick]
    order = np.argsort(c, kind="stable")
    t, h, c, a, total = t[order], h[order], c[order], a[order], total[order]
    at = np.searchsorted(c, np.arange(len(blobs) + 1))
    for k, (chunk, _) in enumerate(blobs):
        s = slice(at[k], at[k + 1])
        if s.stop > s.start:
            yield 0, key, chunk, np.uint32(s.stop - s.start).tobytes() + _planes(t[s], 6) + _planes(h[s], 4) + a[s].tobytes() + _planes(total[s], 2)


def _gather(replies: list[tuple[int, bytes]], mine: bytes, bits: int) -> Answer:
    n = int(np.frombuffer(mine[:4], "<u4")[0])
    f_key = np.frombuffer(mine[4 : 4 + 8 * n], "<u8")
    f_low = np.frombuffer(mine[4 + 8 * n : 4 + 16 * n], "<u8")
    f_holder = np.frombuffer(mine[4 + 16 * n : 4 + 20 * n], "<u4")
    kept = mine[4 + 20 * n :]
    toks, holders, counts, told, told_count = [], [], [], [], []
    join = lambda key, low: (np.uint64(key) << np.uint64(64 - bits)) | (low << np.uint64(16) >> np.uint64(bits))
    for key, raw in replies:
        n = int(np.frombuffer(raw[:4], "<u4")[0])
        low = _values(raw[4 : 4 + 6 * n], n, 6)
        holder = _values(raw[4 + 6 * n : 4 + 10 * n], n, 4).astype(np.int64)
        lone = np.frombuffer(raw[4 + 10 * n : 4 + 11 * n], bool)
        count = _values(raw[4 + 11 * n :], n, 2).astype(np.int64)
        tok = join(key, low)
        toks.append(tok[lone])
        holders.append(holder[lone])
        counts.append(count[lone])
        told.append(tok[~lone])
        told_count.append(count[~lone])
    empty = np.zeros(0, np.int64)
    told_all = np.concatenate(told) if told else np.zeros(0, np.uint64)
    told_n = np.concatenate(told_count) if told_count else empty
    if len(f_key):
        order = np.argsort(told_all)
        mine_tok = (f_key << np.uint64(64 - bits)) | (f_low << np.uint64(16) >> np.uint64(bits))
        at = order[np.searchsorted(told_all[order], mine_tok)]
        toks.append(mine_tok)
        holders.append(f_holder.astype(np.int64))
        counts.append(told_n[at])
    if not toks:
        return Answer(np.zeros(0, np.uint64), empty, empty, kept)
    return Answer(np.concatenate(toks), np.concatenate(holders), np.concatenate(counts), kept)


def shared_tokens(
    docs: DataFrame,
    chunks: Callable[[Iterator[pa.RecordBatch]], Iterator[Chunk]],
    finish: Callable[[Answer, int], Iterator[pa.RecordBatch]],
    schema: T.StructType,
    owned: bool = False,
) -> DataFrame:
    """Runs `chunks` over the rows of `docs`, and `finish` over each chunk's answer.

    `finish` also gets the chunk's number, which no other chunk has. An answer's
    tokens are the chunk's own with some trailing bits at zero, alike everywhere.
    """
    width = partitions(docs.sparkSession)
    bits = _bits(4 * width)
    plain = T.StructType(_MOVED)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        return _out(r for k, c in enumerate(chunks(batches)) for r in rows(c, (task << 24) | k))

    def rows(chunk: Chunk, number: int) -> Iterator[tuple]:
        yield from _send(chunk, number, bits)
        give_back()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            now, blobs = None, []
            for kind, key, chunk, raw in _rows(batches):
                if kind == 1:
                    yield 1, key, chunk, bytes(raw)
                    continue
                if key != now:
                    if blobs:
                        yield from _answer(now, blobs, owned)
                    now, blobs = key, []
                blobs.append((chunk, bytes(raw)))
            if blobs:
                yield from _answer(now, blobs, owned)

        return _out(rows())

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, replies, mine = None, [], None
        for kind, key, chunk, raw in _rows(batches):
            if chunk != now:
                if mine is not None:
                    yield from finish(_gather(replies, mine, bits), now)
                now, replies, mine = chunk, [], None
            if kind == 1:
                mine = bytes(raw)
            else:
                replies.append((key, bytes(raw)))
        if mine is not None:
            yield from finish(_gather(replies, mine, bits), now)

    sent = docs.mapInArrow(lean(send), plain).repartition(width, "kind", "key").sortWithinPartitions("kind", "key", "chunk")
    told = sent.mapInArrow(lean(answer), plain).repartition(width, "chunk").sortWithinPartitions("chunk", "kind", "key")
    return told.mapInArrow(lean(gather), schema)
