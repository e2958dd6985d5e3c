"""A trie of conversations: a node for each sequence of turns that conversations begin with.

Conversations are sorted by their turns, and the longest common prefix (LCP) of
each with the one before it makes an array. The Cartesian tree of that array is the
trie without its unary paths: an entry's node spans the conversations between the
nearest smaller entries on both sides, entries of one span and LCP are one node,
and the depths between a node and its parent are filled in afterwards. Sizes of
spans are differences of running sums, and so are sums over subtrees, as a subtree
is one stretch of the nodes in preorder.

Everything runs over turns, not over conversations as rows, so one conversation may
hold any share of all turns:

- turns get their places from a sort by ranges, and names from a digest;
- blocks of `WIDE` names get names in turn that keep the order, level by level, until
  a conversation has one; equal conversations share it and are one entry;
- nearest smaller entries are found by a stack within a block of the array. What ends
  beyond a block is sought by the blocks' minima (`MOST_BLOCKS` at most, whatever the
  size of the array) and then among the other block's records.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.llm.common import fields, fresh, lean, settle, stored, whole_text, with_groups

#: Names in a block that is named in turn.
WIDE = 64
#: Entries of a block of the LCP array, and how many blocks there are at most (then they grow).
BLOCK, MOST_BLOCKS = 256, 65_536
#: Depths of a node's unary path that are joined at once.
DEPTHS = 64
#: Ids that are written as one string before a digest reads them.
IDS = 1 << 14
#: Characters of texts that decide which range a turn falls into; within a range whole texts do.
SAMPLED = 64

_EMPTY = hashlib.sha256(b"").hexdigest()
RESULT = fields("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")


def running(df: DataFrame, order: list[str], index: str, sums: dict[str, str]) -> DataFrame:
    """Adds `index` (places in `order`, gapless from 0) and, for each (out, column) of `sums`, the
    sum of the column over the rows before. Each task sums its range; the driver sums a row a task."""
    row, part = fresh("_id", df.columns), fresh("_part", df.columns)
    dealt = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(row, F.monotonically_increasing_id()))
    dealt = dealt.withColumn(part, F.shiftright(row, 33))
    totals = dealt.groupBy(part).agg(F.count(F.lit(1)), *[F.sum(c) for c in sums.values()]).orderBy(part).collect()
    names = [f"_start{k}" for k in range(len(sums) + 1)]
    starts, at = [], [0] * len(names)
    for t in totals:
        starts.append((t[0], *at))
        at = [a + x for a, x in zip(at, t[1:])]
    kind = T.StructType(fields(", ".join(f"{n} long" for n in (part, *names))))
    told = dealt.join(F.broadcast(df.sparkSession.createDataFrame(starts, kind)), part)
    before = Window.partitionBy(part).orderBy(row).rowsBetween(Window.unboundedPreceding, -1)
    own = [(F.col(n) + F.coalesce(F.sum(c).over(before), F.lit(0))).alias(out) for n, (out, c) in zip(names[1:], sums.items())]
    return told.select(*df.columns, (F.col(names[0]) + F.col(row).bitwiseAND((1 << 33) - 1)).alias(index), *own)


def places(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 1, by turn with null first, then role and text), name and words of each turn."""
    read = turns.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), whole_text().alias("text"))
    dealt = read.repartitionByRange("conv_id", "turn", F.substring("role", 1, SAMPLED), F.substring("text", 1, SAMPLED))
    name = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    named = stored(
        dealt.sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", name.alias("name"), words.alias("words"), F.monotonically_increasing_id().alias("id"))
    ).withColumn("part", F.shiftright("id", 33))
    counts = named.groupBy("conv_id", "part").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("conv_id", "part", (F.coalesce(F.sum("c").over(before), F.lit(0)) - F.col("first") + 1).alias("start"))
    return named.join(starts, ["conv_id", "part"]).select("conv_id", (F.col("id") + F.col("start")).alias("pos"), "name", "words")


def rebuilt(turns: DataFrame, family: int = 20, shared: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, length) and their turns (conv_id, pos, name, words), with the first h
    turns of conversation conv_id - conv_id % `family` before those after its own first h; h is
    crc32 of the id's decimal digits modulo `shared`."""
    own = stored(places(turns))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared
    convs = own.groupBy("conv_id").agg(F.max("pos").alias("n")).select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = settle(convs.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    heads = own.filter(F.col("pos") < shared).withColumnRenamed("conv_id", "base")
    first = convs.join(heads, "base").filter("pos <= taken").select("conv_id", "pos", "name", "words")
    told = with_groups(own.filter(F.col("pos") > h), convs.select("conv_id", "n", (F.col("taken") - F.col("h")).alias("shift")), ["conv_id"], "n")
    rest = told.select("conv_id", (F.col("pos") + F.col("shift")).alias("pos"), "name", "words")
    return convs.select("conv_id", "length"), stored(first.unionByName(rest))


def ordered_names(rows: DataFrame, wide: int = WIDE) -> DataFrame:
    """(conv_id, item) of `rows` (conv_id, pos, item): a number that keeps the order of the sequences
    of items and is equal for equal ones."""
    now = rows
    while True:
        block = F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"])
        cut = stored(now.groupBy("conv_id", F.floor((F.col("pos") - 1) / wide).alias("b")).agg(block.alias("block")))
        values = cut.groupBy("block").agg(F.count(F.lit(1)).alias("k"))
        values = stored(values.repartitionByRange("block").sortWithinPartitions("block").withColumn("item", F.monotonically_increasing_id()))
        now = stored(with_groups(cut, values, ["block"], "k").select("conv_id", (F.col("b") + 1).alias("pos"), "item"))
        if (now.agg(F.max("pos").alias("most")).first().most or 1) == 1:
            return now.select("conv_id", "item")


def _lcps(turns: DataFrame) -> DataFrame:
    """(r, lcp): leading turns that an entry has in common with the one before it."""
    before = turns.select((F.col("r") + 1).alias("r"), "pos", F.col("name").alias("other"))
    differs = F.when(~F.col("name").eqNullSafe(F.col("other")), F.col("pos"))
    return turns.select("r", "pos", "name").join(before, ["r", "pos"], "left").groupBy("r").agg((F.min(differs) - 1).alias("lcp"))


_SWEPT = fields("kind string, block long, i long, v long, hi long, l long, pl long, ln long, ll long, lb long, j long, pj long, jn long, jl long, jb long, best long")
_FAR = 1 << 62


class Sweep:
    """Nearest smaller entries of one block of the LCP array (r, lcp, rep, n, leaf).

    Rows of kind `node`: a node's LCP (v), the smaller entries at its ends (l, j), their LCPs and the
    sums before them, and its least conversation; an end beyond the block is named by its block
    (lb, jb). Kind `entry`: an entry and its left end. Kinds `left` and `right`: the block's
    records for others that look into it from the right and the left: for LCPs above v and up to
    hi the end is i.
    """

    def __init__(self, size: int, total: int, minima: list[int], reps: list[int], counts: list[int], leaves: list[int]) -> None:
        self.size, self.total = size, total
        self.minima, self.reps = np.array(minima, np.int64), np.array(reps, np.int64)
        self.counts, self.leaves = np.r_[0, np.cumsum(counts)].tolist(), np.r_[0, np.cumsum(leaves)].tolist()

    def __call__(self, table: pa.Table) -> pa.Table:
        d = table.sort_by("r").to_pydict()
        lcp, rep, r = d["lcp"], d["rep"], d["r"]
        block, size, start = r[0] // self.size, len(r), r[0]
        n = np.r_[0, np.cumsum(d["n"])] + self.counts[block]
        leaves = np.r_[0, np.cumsum(d["leaf"])] + self.leaves[block]
        left, left_best = self._nearest(lcp, [_FAR, *rep[:-1]])
        mirrored, right_best = (way[::-1] for way in self._nearest(lcp[::-1], rep[::-1]))
        right = [size - 1 - x if x >= 0 else -1 for x in mirrored]
        out: list[dict[str, Any]] = []
        seen: set[tuple[int, int]] = set()
        for i in range(start == 0, size):
            v, a, b = lcp[i], left[i], right[i]
            out.append({"kind": "entry", "i": r[i], "v": v, "l": r[a] if a >= 0 else None})
            if (a, v) in seen:
                continue
            seen.add((a, v))
            node = {"kind": "node", "i": r[i], "v": v}
            best = min(left_best[i], right_best[i])
            if a >= 0:
                node |= {"l": r[a], "pl": lcp[a], "ln": n[a], "ll": leaves[a]}
            else:
                node["lb"] = lb = int(np.flatnonzero(self.minima[:block] < v)[-1])
                best = min(best, self.reps[lb + 1 : block].min(initial=_FAR))
            if b >= 0:
                node |= {"j": r[b], "pj": lcp[b], "jn": n[b], "jl": leaves[b]}
            else:
                after = np.flatnonzero(self.minima[block + 1 :] < v)
                if len(after):
                    node["jb"] = jb = block + 1 + int(after[0])
                    best = min(best, self.reps[block + 1 : jb].min(initial=_FAR))
                else:
                    node |= {"j": self.total, "pj": -1, "jn": self.counts[-1], "jl": self.leaves[-1]}
                    best = min(best, self.reps[block + 1 :].min(initial=_FAR))
            out.append(node | {"best": best})
        for kind, way in (("left", range(size - 1, -1, -1)), ("right", range(size))):
            low, best = _FAR, _FAR
            for k in way:
                best = min(best, rep[k]) if kind == "left" else best
                if lcp[k] < low:
                    out.append({"kind": kind, "i": r[k], "v": lcp[k], "hi": low, "jn": n[k], "jl": leaves[k], "best": best})
                    low = lcp[k]
                best = min(best, rep[k])
        kinds = [pa.string(), *[pa.int64()] * (len(_SWEPT) - 1)]
        return pa.table({f.name: pa.array([x.get(f.name) if f.name != "block" else block for x in out], k) for f, k in zip(_SWEPT, kinds)})

    @staticmethod
    def _nearest(lcp: list[int], rep: list[int]) -> tuple[list[int], list[int]]:
        """The nearest smaller entry before each (-1: none), and the least of `rep` after it up to each."""
        stack: list[int] = []
        found, least = [], []
        for i, v in enumerate(lcp):
            best = rep[i]
            while stack and lcp[stack[-1]] >= v:
                best = min(best, least[stack.pop()])
            found.append(stack[-1] if stack else -1)
            least.append(best)
            stack.append(i)
        return found, least


def _looked_up(nodes: DataFrame, swept: DataFrame, kind: str, block: str, ends: dict[str, str]) -> DataFrame:
    """`nodes` with the ends that lie in other blocks, from those blocks' records."""
    told = {"block": "_b", "i": "_i", "v": "_v", "hi": "_hi", "jn": "_n", "jl": "_l", "best": "_best"}
    records = swept.filter(F.col("kind") == kind).select(*[F.col(c).alias(x) for c, x in told.items()])
    known = nodes.filter(F.col(block).isNull())
    met = nodes.filter(F.col(block).isNotNull()).join(records, (F.col(block) == F.col("_b")) & (F.col("v") > F.col("_v")) & (F.col("v") <= F.col("_hi")))
    return known.unionByName(met.withColumns({c: F.col(x) for c, x in ends.items()}).withColumn("best", F.least("best", "_best")).select(*nodes.columns))


def compressed(entries: DataFrame, block: int = BLOCK) -> DataFrame:
    """The trie without unary paths, from `entries` (r, rep, n, length, lcp, next; settled).

    l, v: a node is known by its first entry and depth; j: the entry after its last; p: the parent's
    depth (-1: none); conv_id, n_convs, n_leaves; up: the parent's first entry.
    """
    total = entries.count()
    size = max(block, -(-total // MOST_BLOCKS))
    dealt = entries.withColumn("block", F.floor(F.col("r") / size)).withColumn("leaf", (F.col("length") > F.greatest("lcp", "next")).cast("long"))
    sums = dealt.groupBy("block").agg(F.min("lcp").alias("lcp"), F.min("rep").alias("rep"), F.sum("n").alias("n"), F.sum("leaf").alias("leaf")).orderBy("block").collect()
    sweep = Sweep(size, total, *([s[c] for s in sums] for c in ("lcp", "rep", "n", "leaf")))
    swept = stored(dealt.select("block", "r", "lcp", "rep", "n", "leaf").groupBy("block").applyInArrow(lambda table: sweep(table), T.StructType(_SWEPT)))
    nodes = _looked_up(swept.filter("kind = 'node'"), swept, "left", "lb", {"l": "_i", "pl": "_v", "ln": "_n", "ll": "_l"})
    nodes = settle(_looked_up(nodes, swept, "right", "jb", {"j": "_i", "pj": "_v", "jn": "_n", "jl": "_l"}))
    whole = ("j", "pl", "pj", "ln", "ll", "jn", "jl", "best")
    inner = nodes.groupBy("l", "v").agg(*[F.min(c).alias(c) for c in whole]).select(
        "l", "v", "j", "pl", "pj", F.col("best").alias("conv_id"), (F.col("jn") - F.col("ln")).alias("n_convs"), (F.col("jl") - F.col("ll")).alias("n_leaves")
    )
    outer = dealt.filter("leaf = 1").select(
        F.col("r").alias("l"), F.col("length").alias("v"), (F.col("r") + 1).alias("j"), F.col("lcp").alias("pl"), F.col("next").alias("pj"),
        F.col("rep").alias("conv_id"), F.col("n").alias("n_convs"), F.lit(1).cast("long").alias("n_leaves"),
    )
    both = settle(inner.unionByName(outer).withColumn("p", F.greatest("pl", "pj")))
    # the parent begins where the node does if the end behind it is higher, else where its first entry's node begins
    found = swept.filter("kind = 'entry'")
    open_left = nodes.filter("lb IS NOT NULL").select("block", "v", F.col("l").alias("up"))
    left = found.filter("l IS NOT NULL").select("i", F.col("l").alias("up")).unionByName(found.filter("l IS NULL").join(open_left, ["block", "v"]).select("i", "up"))
    same = both.filter("pj > pl").withColumn("up", F.col("l"))
    moved = both.filter("pj <= pl AND p >= 0").join(left, F.col("l") == F.col("i")).drop("i")
    top = both.filter("p < 0").withColumn("up", F.lit(None).cast("long"))
    return same.unionByName(moved).unionByName(top).drop("pl", "pj")


def _with_parents(nodes: DataFrame) -> DataFrame:
    """Adds parent_conv_id and n_children of the node's last depth. Settle `nodes` first."""
    kids = settle(nodes.filter("up IS NOT NULL").groupBy("up", "p").agg(F.count(F.lit(1)).alias("n_children")))
    own = nodes.join(kids.select(F.col("up").alias("l"), F.col("p").alias("v"), "n_children"), ["l", "v"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    own = settle(own)
    parents = own.filter("n_children > 0").select(F.col("l").alias("up"), F.col("v").alias("p"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("_kids"))
    below = with_groups(own.filter("up IS NOT NULL"), parents, ["up", "p"], "_kids").drop("_kids")
    return below.unionByName(own.filter("up IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long")))


def _spread(nodes: DataFrame) -> DataFrame:
    """`nodes` once for each stretch of `DEPTHS` depths that their unary paths touch."""
    return nodes.withColumn("stretch", F.explode(F.sequence(F.floor((F.col("p") + 1) / DEPTHS), F.floor(F.col("v") / DEPTHS))))


def _digests(members: DataFrame) -> DataFrame:
    """(r, ends): SHA-256 of the ascending ids of an entry's members (r, conv_id). Ids are written as
    strings of many before the task that reads an entry's strings one after another."""
    dealt = stored(members.repartitionByRange("r", "conv_id").sortWithinPartitions("r", "conv_id").withColumn("id", F.monotonically_increasing_id()))
    text = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    strings = dealt.groupBy("r", F.floor(F.col("id") / IDS).alias("k")).agg(text.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, hashlib.sha256()
        for batch in batches:
            done: list[tuple[int, str]] = []
            for r, ids in zip(batch.column("r").to_pylist(), batch.column("ids").to_pylist()):
                if r == now:
                    digest.update(b",")
                else:
                    if now is not None:
                        done.append((now, digest.hexdigest()))
                    now, digest = r, hashlib.sha256()
                digest.update(ids.encode())
            yield _pairs(done)
        if now is not None:
            yield _pairs([(now, digest.hexdigest())])

    return strings.repartition("r").sortWithinPartitions("r", "k").select("r", "ids").mapInArrow(lean(run), T.StructType(fields("r long, ends string")))


def _pairs(done: list[tuple[int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.string())], names=["r", "ends"])


def trie(turns: DataFrame, family: int = 20, shared: int = 4, block: int = BLOCK, wide: int = WIDE) -> DataFrame:
    """RESULT's columns for each node of the trie of rebuilt conversations.

    `turns` has conv_id, turn, role and text; other columns are not read. Null role
    or text counts as empty, null turns come first, and turns that tie are ordered by role and
    text. Rows without a conv_id belong to no conversation and are left out; repeated rows are
    turns of their own. No conversation, no node.
    """
    convs, rows = rebuilt(turns, family, shared)
    named = ordered_names(rows.select("conv_id", "pos", F.col("name").alias("item")), wide)
    all_named = settle(convs.join(named, "conv_id", "left").select("conv_id", F.coalesce("item", F.lit(-1)).alias("item"), "length"))
    groups = all_named.groupBy("item").agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.max("length").alias("length"))
    entries = settle(running(groups, ["item"], "r", {}))
    own = rows.withColumnRenamed("conv_id", "rep")
    paths = stored(with_groups(own, entries.select("rep", "r", "length"), ["rep"], "length").select("r", "pos", "name", "words"))
    lcp = settle(entries.join(_lcps(paths), "r", "left").withColumn("lcp", F.when(F.col("r") == 0, -1).otherwise(F.col("lcp"))))
    following = lcp.select((F.col("r") - 1).alias("r"), F.col("lcp").alias("next"))
    lcp = settle(lcp.join(following, "r", "left").withColumn("next", F.coalesce("next", F.lit(-1))))
    nodes = settle(_with_parents(settle(compressed(lcp, block))))

    # a node's first entry is the one at whose LCP its path parts from the entry before
    root = lcp.filter("r = 0").select("r", F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("words"))
    depths = with_groups(paths.select("r", "pos", "words"), lcp.select("r", "lcp", F.col("length")), ["r"], "length").filter("pos > lcp").select("r", "pos", "words").unionByName(root)
    depths = depths.withColumnsRenamed({"r": "l", "pos": "depth"}).withColumn("stretch", F.floor(F.col("depth") / DEPTHS))
    at = (F.col("depth") > F.col("p")) & (F.col("depth") <= F.col("v"))
    every = depths.join(_spread(nodes), ["l", "stretch"]).filter(at).withColumn("saved", (F.col("n_convs") - 1) * F.col("words"))
    every = stored(running(every, ["l", "depth"], "place", {"before": "saved"}))
    # a subtree ends where the entry after its last begins, at the depth below its LCP
    ends_at = every.join(lcp.select(F.col("r").alias("l"), (F.col("lcp") + 1).alias("depth")), ["l", "depth"]).select(F.col("l").alias("j"), F.col("before").alias("until"))
    total = every.agg(F.coalesce(F.sum("saved"), F.lit(0)).alias("s")).first().s
    until = _spread(nodes.join(ends_at, "j", "left").select("l", "v", "p", F.coalesce("until", F.lit(total)).alias("until")))
    every = every.join(until.drop("p"), ["l", "v", "stretch"])
    members = with_groups(all_named.select("conv_id", "item"), entries.select("item", "r", "n"), ["item"], "n").select("r", "conv_id")
    ends = _digests(members).join(entries.select("r", "length"), "r").select(F.col("r").alias("l"), F.col("length").alias("depth"), "ends")
    last, first = F.col("depth") == F.col("v"), F.col("depth") == F.col("p") + 1
    return every.join(ends, ["l", "depth"], "left").select(
        "conv_id", "depth", F.when(first, F.col("parent_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        F.when(last, F.col("n_children")).otherwise(F.lit(1)).cast("long").alias("n_children"), "n_leaves",
        (F.col("until") - F.col("before")).alias("saved_tokens"), F.coalesce("ends", F.lit(_EMPTY)).alias("ends_sha256"),
    )


def oracle() -> str:
    """DuckDB SQL for `trie`: nodes as groups of equal prefixes."""
    return r"""
        WITH tab AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) t(i))),
             o AS MATERIALIZED (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS name,
                          len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
             c AS MATERIALIZED (SELECT conv_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x))), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 4 AS h
                   FROM (SELECT DISTINCT conv_id FROM o), tab),
             t AS (SELECT c.conv_id, 0 AS half, o.pos, name, words FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 20 AND o.pos <= h
                   UNION ALL SELECT c.conv_id, 1, o.pos, name, words FROM c JOIN o ON o.conv_id = c.conv_id AND o.pos > h),
             n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY half, pos) AS depth FROM t),
             p AS MATERIALIZED (SELECT conv_id, depth, words, sha256(string_agg(name, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS k FROM n),
             q AS MATERIALIZED (SELECT conv_id, depth, words, k, lag(k, 1, '') OVER (PARTITION BY conv_id ORDER BY depth) AS up FROM p UNION ALL SELECT conv_id, 0, 0, '', NULL FROM c),
             l AS (SELECT conv_id, max(depth) AS length FROM q GROUP BY conv_id),
             m AS MATERIALIZED (SELECT k, depth, min(q.conv_id) AS conv_id, any_value(up) AS up, count(*) AS n_convs, any_value(words) AS words,
                          sha256(coalesce(string_agg(q.conv_id::VARCHAR, ',' ORDER BY q.conv_id) FILTER (depth = length), '')) AS ends_sha256
                   FROM q JOIN l USING (conv_id) GROUP BY k, depth),
             ch AS (SELECT up, count(*) AS n_children FROM m WHERE up IS NOT NULL GROUP BY up),
             s AS MATERIALIZED (SELECT m.*, coalesce(n_children, 0) AS n_children FROM m LEFT JOIN ch ON ch.up = m.k),
             a AS MATERIALIZED (SELECT DISTINCT x.k AS above, y.k AS k FROM q y JOIN q x ON x.conv_id = y.conv_id AND x.depth <= y.depth),
             g AS (SELECT above, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * words)::BIGINT AS saved_tokens FROM a JOIN s USING (k) GROUP BY above)
        SELECT s.conv_id, s.depth, u.conv_id AS parent_conv_id, s.n_convs, s.n_children, g.n_leaves, g.saved_tokens, s.ends_sha256
        FROM s JOIN g ON g.above = s.k LEFT JOIN m u ON u.k = s.up
    """
