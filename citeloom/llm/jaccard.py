"""Documents whose sets of word shingles are alike, by Jaccard, without missing a pair.

1. Shingles are hashed and the shared ones found (`exchange`). With rare shingles
   first, two sets alike enough meet in the beginning of both (the prefix
   filter), so a set whose beginning is all its own is alike to none.
2. Sets that are left and whose beginnings meet are candidates of one another;
   connected ones are one candidate group, and no pair crosses groups.
3. A group is cut into blocks if it is large (`linked_sets`). A signature tree is
   built over a block: leaves are sets, nodes hold the union (and the
   intersection) of their token bitmaps and ranges of size. A dual traversal of
   one tree, or of two, drops pairs of nodes whose largest possible overlap is too
   small, or whose sets are linked already, and counts the overlap of what is left.
4. Links are contracted to components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.llm.common import components, fields, lean, matched, one_of_each, partitions, pieces, settle, stored, with_groups
from citeloom.llm.exchange import CHUNK, Answer, Chunk, shared_tokens

#: Words of a shingle; the least similarity in hundredths.
SHINGLE, PERCENT = 5, 75
#: Sets of a block at most; sets of a leaf; bits of a signature.
BLOCK, LEAF, SIGNATURE = 1500, 16, 1024
#: Distinct words that a task remembers.
REMEMBERED = 1 << 17

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)


class WordHashes(dict):
    """word -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(_MIX[2])
    x = (x ^ (x >> np.uint64(29))) * np.uint64(_MIX[1])
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, words: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """The sorted set of a text's shingle hashes; a short text is one shingle, none has none."""
    w = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, w), np.uint64, len(w))
    n = max(1, len(h) - size + 1)
    out = np.full(n, min(len(h), size), np.uint64)
    for k in range(min(len(h), size)):
        out = mixed(out * np.uint64(_MIX[0]) + h[k : k + n])
    return np.unique(out)


def _least_overlap(a: int, b: int, percent: int) -> int:
    """Fewest common members with which sets of these sizes are alike."""
    return -(-percent * (a + b) // (100 + percent))


def _prefix(n: int, percent: int) -> int:
    """Members in the beginning of a set of n: one of them is common with any set alike."""
    return n - -(-percent * n // 100) + 1


class _Chunks:
    """Rows of documents to chunks of their distinct sets."""

    def __init__(self, ids: dict[str, pa.DataType]) -> None:
        self.ids = ids

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
        words = WordHashes()
        self._clear()
        for whole in batches:
            for batch in pieces(whole):
                for *doc, text in zip(*(batch.column(c).to_pylist() for c in (*self.ids, "text"))):
                    s = shingles(text, words)
                    key = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    if key not in self.number:
                        self.number[key] = len(self.number)
                        self.sets.append(s)
                        self.size += len(s)
                    self.docs.append((*doc, self.number[key]))
                    if self.size > CHUNK:
                        yield self._close()
        if self.docs:
            yield self._close()

    def _clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.sets: list[np.ndarray] = []
        self.docs: list[tuple] = []
        self.size = 0

    def _close(self) -> Chunk:
        counts = np.array([len(s) for s in self.sets], np.int64)
        kinds = {**self.ids, "set": pa.int32()}
        doc = pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*self.docs), kinds.values())], names=list(kinds))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, doc.schema) as w:
            w.write_batch(doc)
        kept = np.uint32(len(counts)).tobytes() + counts.astype("<u4").tobytes() + b"".join(self.number) + sink.getvalue().to_pybytes()
        out = Chunk(np.concatenate(self.sets), np.repeat(np.arange(len(counts)), counts), kept)
        self._clear()
        return out


def _finish(answer: Answer, number: int, percent: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """A chunk's documents; the first of each set that may be alike to another carries it."""
    raw = answer.kept
    n = int(np.frombuffer(raw[:4], "<u4")[0])
    sizes = np.frombuffer(raw[4 : 4 + 4 * n], "<u4").astype(np.int64)
    keys = [raw[4 + 4 * n + 16 * k : 20 + 4 * n + 16 * k] for k in range(n)]
    docs = pa.ipc.open_stream(raw[4 + 20 * n :]).read_next_batch()
    order = np.lexsort((answer.tokens, answer.counts, answer.holders))
    tok, holder = answer.tokens[order], answer.holders[order]
    at = np.searchsorted(holder, np.arange(n + 1))
    which = docs.column("set").to_numpy()
    carried: list[bytes | None] = [None] * len(which)
    begins: list[list[int] | None] = [None] * len(which)
    seen: set[int] = set()
    for row, k in enumerate(which.tolist()):
        if k in seen:
            continue
        seen.add(k)
        shared = tok[at[k] : at[k + 1]]
        meet = _prefix(int(sizes[k]), percent) - (int(sizes[k]) - len(shared))
        if sizes[k] and meet > 0:
            carried[row] = np.sort(shared).astype("<u8").tobytes()
            begins[row] = shared[:meet].view(np.int64).tolist()
    yield pa.RecordBatch.from_arrays(
        [*docs.columns[:-1], pa.array(sizes[which], pa.int64()), pa.array([keys[k] for k in which.tolist()], pa.binary()), pa.array(carried, pa.binary()), pa.array(begins, pa.list_(pa.int64()))],
        names=names,
    )


class Tree:
    """A signature tree over sets (sorted arrays), their whole sizes beside them."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray) -> None:
        words = SIGNATURE // 64
        self.sets, self.sizes = sets, sizes
        self.held = np.array([len(s) for s in sets], np.int64)
        bits = np.zeros((len(sets), SIGNATURE), bool)
        for k, s in enumerate(sets):
            bits[k, (mixed(s) % np.uint64(SIGNATURE)).astype(np.int64)] = True
        self.signs = np.packbits(bits, axis=1).view(np.uint64).reshape(len(sets), words)
        least = np.array([int(mixed(s).min()) if len(s) else 0 for s in sets], np.uint64)
        self.order = np.lexsort((sizes, least))
        #: Levels from the leaves up: (first member, end, any, all, least size, most held)
        level = []
        for a in range(0, len(sets), LEAF):
            m = self.order[a : a + LEAF]
            level.append((a, a + len(m), np.bitwise_or.reduce(self.signs[m]), np.bitwise_and.reduce(self.signs[m]), int(sizes[m].min()), int(self.held[m].max()), ()))
        while len(level) > 1:
            up = []
            for a in range(0, len(level), 4):
                c = level[a : a + 4]
                up.append((c[0][0], c[-1][1], np.bitwise_or.reduce([x[2] for x in c]), np.bitwise_and.reduce([x[3] for x in c]), min(x[4] for x in c), max(x[5] for x in c), tuple(c)))
            level = up
        self.root = level[0]


class Linker:
    """Links among the sets of one tree, or between two trees, as components."""

    def __init__(self, left: Tree, right: Tree | None, percent: int) -> None:
        self.a, self.b, self.self_join, self.percent = left, right or left, right is None, percent
        n = len(left.sets)
        self.shift = 0 if right is None else n
        self.label = np.arange(n if right is None else n + len(right.sets))
        self.visit(self.a.root, self.b.root)

    def one(self, x: tuple, y: tuple) -> bool:
        """Whether all sets below both nodes are linked already."""
        la = self.label[self.a.order[x[0] : x[1]]]
        lb = self.label[self.b.order[y[0] : y[1]] + self.shift]
        return bool((la == la[0]).all() and (lb == la[0]).all())

    def hopeless(self, x: tuple, y: tuple) -> bool:
        """Whether no set below x can have enough in common with one below y."""
        need = _least_overlap(x[4], y[4], self.percent)
        if min(x[5] - int(np.bitwise_count(x[3] & ~y[2]).sum()), y[5] - int(np.bitwise_count(y[3] & ~x[2]).sum())) < need:
            return True
        return False

    def visit(self, x: tuple, y: tuple) -> None:
        if self.one(x, y):
            return
        if self.hopeless(x, y):
            return
        if not x[6] and not y[6]:
            self.leaves(x, y)
        elif self.self_join and x is y:
            for c in x[6]:
                self.visit(c, c)
            for i, c in enumerate(x[6]):
                for d in x[6][i + 1 :]:
                    self.visit(c, d)
        elif x[6] and (not y[6] or x[1] - x[0] >= y[1] - y[0]):
            for c in x[6]:
                self.visit(c, y)
        else:
            for d in y[6]:
                self.visit(x, d)

    def leaves(self, x: tuple, y: tuple) -> None:
        a, b = self.a, self.b
        m, k = a.order[x[0] : x[1]], b.order[y[0] : y[1]]
        apart_a = np.bitwise_count(a.signs[m][:, None] & ~b.signs[k][None]).sum(2)
        apart_b = np.bitwise_count(b.signs[k][None] & ~a.signs[m][:, None]).sum(2)
        most = np.minimum(a.held[m][:, None] - apart_a, b.held[k][None] - apart_b)
        need = -(-self.percent * (a.sizes[m][:, None] + b.sizes[k][None]) // (100 + self.percent))
        ok = most >= need
        if self.self_join and x is y:
            ok = np.triu(ok, 1)
        for i, j in zip(*np.nonzero(ok)):
            p, q = m[i], k[j]
            if self.label[p] != self.label[q + self.shift]:
                s, t = a.sets[p], b.sets[q]
                if len(s) > len(t):
                    s, t = t, s
                where = np.searchsorted(t, s)
                where[where == len(t)] = 0
                if int((t[where] == s).sum()) >= need[i, j]:
                    old, new = self.label[p], self.label[q + self.shift]
                    self.label[self.label == max(old, new)] = min(old, new)


def _linked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by task and side to the links of each task, as stars."""

    def close(rows: list[tuple]) -> pa.RecordBatch:
        sides = [[r for r in rows if r[1] == s] for s in (0, 1)]
        trees = [Tree([np.frombuffer(r[4], "<u8") for r in side], np.array([r[3] for r in side], np.int64)) if side else None for side in sides]
        keys = [r[2] for r in sides[0]] + [r[2] for r in sides[1]]
        found: list[tuple[bytes, bytes]] = []
        if trees[0] is not None:
            label = Linker(trees[0], trees[1], percent).label
            found = [(keys[k], keys[int(root)]) for k, root in enumerate(label) if k != root]
        return pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.binary()) for c in (0, 1)], names=["a", "b"])

    now, rows = None, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("task", "side", "set_id", "n", "tokens")]
        for r in zip(*columns):
            if r[0] != now:
                if rows:
                    yield close(rows)
                now, rows = r[0], []
            rows.append(r)
    if rows:
        yield close(rows)


def _candidates(begun: DataFrame) -> DataFrame:
    """(set_id, grp, k) of sets whose beginnings meet another's; k sets are in a group."""
    tokens = settle(begun.select("set_id", F.explode("begin").alias("tok")))
    hubs = tokens.groupBy("tok").agg(F.min("set_id").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    edges = with_groups(tokens, settle(hubs), ["tok"], "n").select(F.col("set_id").alias("a"), "b").distinct()
    found = settle(components(edges).select(F.col("node").alias("set_id"), F.col("root").alias("grp")))
    return with_groups(found, settle(found.groupBy("grp").agg(F.count(F.lit(1)).alias("k"))), ["grp"], "k")


def _run_tasks(tasks: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of tasks (task, side, set_id, n, tokens)."""
    dealt = tasks.repartition(partitions(tasks.sparkSession), "task").sortWithinPartitions("task", "side", "set_id")
    return settle(dealt.mapInArrow(lean(lambda b: _linked(b, percent)), T.StructType(fields("a binary, b binary"))))


def linked_sets(sets: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """(node, root) of sets that have a link; `sets` has set_id, n, tokens and begin, and may hold a set twice.

    A group of up to `block` candidates is one task. A larger one is dealt into
    blocks, with one set of it, the guide, in every block. Sets linked to the guide
    by their block are linked to one another, so no two of them are compared again;
    only the others meet all blocks. A group of near copies thus costs its size, and
    only sets that are candidates of many but linked to few cost more.
    """
    begun = settle(sets.groupBy("set_id").agg(F.first("begin").alias("begin")))
    found = settle(
        _candidates(begun).withColumn("blocks", F.ceil(F.col("k") / block).cast("int"))
        .withColumn("at", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    )
    held = sets.select("set_id", "n", "tokens").join(found, "set_id").groupBy("set_id").agg(*[F.first(c).alias(c) for c in ("grp", "blocks", "at", "n", "tokens")])
    groups = stored(held)
    own = ["set_id", "n", "tokens"]
    guide = F.col("set_id") == F.col("grp")  # a group is named after its least set
    homes = F.when(guide, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("at"))
    first = groups.select("grp", *own, F.explode(homes).alias("home")).select(F.xxhash64("grp", "home").alias("task"), F.lit(0).alias("side"), *own)
    links = _run_tasks(first, percent)
    large = found.filter("blocks > 1")
    if large.isEmpty():
        return components(links)
    roots = components(links)
    rooted = large.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    rooted = settle(rooted.select("set_id", "grp", "blocks", "root"))
    guides = settle(rooted.filter("set_id = grp").select("grp", F.col("root").alias("g_root"), F.lit(1).alias("n")))
    loose = settle(rooted.join(guides.drop("n"), "grp").filter("root <> g_root").select("set_id", "grp"))
    parts = settle(loose.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts")))
    if parts.isEmpty():
        return roots
    marked = settle(large.join(parts, "grp").join(loose.select("set_id", F.lit(True).alias("loose")), "set_id", "left").select("set_id", "parts", "loose"))
    again = groups.join(marked, "set_id").withColumn("part", F.pmod(F.xxhash64("set_id", F.lit(1)), F.col("parts")).cast("int"))
    everyone = again.select("grp", *own, F.lit(1).alias("side"), "at", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    apart = again.filter("loose").select("grp", *own, F.lit(0).alias("side"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("at"), "part")
    tasks = everyone.unionByName(apart).select(F.xxhash64("grp", "at", "part").alias("task"), "side", *own)
    return components(links.unionByName(_run_tasks(tasks, percent)))


def alike(docs: DataFrame, percent: int = PERCENT, block: int = BLOCK, by_text: bool = False) -> DataFrame:
    """doc_id, n_shingles and component_id of each row.

    Rows whose sets' Jaccard is `percent` hundredths or more are linked; a
    component's id is the least doc_id that links reach. Null and blank texts
    have no shingle and are linked with nothing, not even one another. Rows that
    repeat are linked (their sets are equal). Columns beside doc_id and text are
    not read. `by_text` adds `row`, a hash of the text that tells rows of one
    doc_id apart, and makes the component's id that of its first row: (no doc_id,
    doc_id, row). doc_id is an integer, a long or a string.
    """
    id_field = docs.schema["doc_id"]
    ids = ["doc_id", "row"] if by_text else ["doc_id"]
    names = [*ids, "n", "set_id", "tokens", "begin"]
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row") if by_text else F.col("doc_id")
    read = docs.select("doc_id", "text", *[F.xxhash64("text").alias("row")] * by_text)
    schema = T.StructType([id_field, *fields("row long") * by_text, *fields("n long, set_id binary, tokens binary"), T.StructField("begin", T.ArrayType(T.LongType()))])
    kind = pa.int64() if isinstance(id_field.dataType, T.LongType) else pa.int32() if isinstance(id_field.dataType, T.IntegerType) else pa.string()
    chunks = _Chunks(dict(zip(ids, (kind, pa.int64()))))
    rows = stored(shared_tokens(read, lambda b: chunks(b), lambda a, k: _finish(a, k, percent, names), schema))
    roots = linked_sets(rows.filter(F.col("tokens").isNotNull()), percent, block).withColumnRenamed("node", "set_id")
    own = rows.select(*ids, "n", "set_id")
    rooted = settle(own.filter("n > 0").select("set_id").distinct().join(roots, "set_id", "left").withColumn("root", F.coalesce("root", "set_id")))
    sized = own.filter("n > 0").groupBy("set_id").agg(F.count(F.lit(1)).alias("k"), F.min(first).alias("least"))
    classes = settle(matched(sized, rooted, ["set_id"]))
    least = settle(classes.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("k2")))
    told = settle(with_groups(classes, least, ["root"], "k2").select("set_id", "k", "component_id"))
    linked = with_groups(own.filter("n > 0"), told, ["set_id"], "k")
    return linked.select(*ids, F.col("n").alias("n_shingles"), "component_id").unionByName(
        own.filter("n = 0").select(*ids, F.col("n").alias("n_shingles"), first.alias("component_id"))
    )


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The first row of each component by doc_id and text hash, with all columns.

    Rows without a doc_id come last in their component. Rows that share a doc_id
    but are not linked stay each; of rows that repeat doc_id and text one stays.
    """
    found = alike(docs, percent, by_text=True)
    own, first = ("doc_id", "row"), "component_id"
    stay = found.filter(" and ".join(f"{c} <=> {first}.{c}" for c in own)).select(*own).distinct()
    return one_of_each(docs, stay, F.xxhash64("text"))
