"""Spelling variants: words one edit apart, found by bands of a letter-parity mask.

A word's mask has a bit for each letter: whether it stands in the word an odd
number of times. An inserted or deleted letter flips one bit, a replaced one two.
So of three bands of the mask at least one is equal in two words an edit apart,
and the words are joined on it.

A band of ten letters has few values, and the groups of equal bands would grow with
the square of the vocabulary. What else an edit must leave is therefore part of
the key: the length of the shorter word, and the half of it that the edit is not
in. Where more than `GROUP` words still share a key, its words are dealt again by what
is left of them without one letter. Every near pair has exactly one key at which
it counts, so no pair is made twice.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.llm.common import fields, lean, pieces, settle, stored, turned, whole_text

#: Letters of words: a to z (A to Z are lower-cased), then U+00C0 to U+00FF as they are.
LETTERS = "a-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A word's form has at least so many times its occurrences.
TIMES = 5
#: One document and run in so many has a letter deleted.
ODDS = 199
BANDS = 3
#: Words that may share a key before they are dealt again.
GROUP = 64
#: Keys (numbers) that are broadcast; more are joined by a shuffle.
BROADCAST = 500_000
#: Distinct words that a task gathers before it hands on their counts.
GATHERED = 1 << 17


def occurrences(docs: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """(word, n) of whole texts, partly summed: runs of letters, A to Z lower-cased.

    Where `ODDS` divides crc32 of `<doc_id>:<run>`, the run's letter at crc32 modulo
    its length is deleted. Words shorter than `least` are left out.
    """
    pattern = regex.compile(f"(?<![{LETTERS}])[{LETTERS}]{{{least},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(gathered.keys(), pa.string()), pa.array(gathered.values(), pa.int64())], names=["word", "n"])
            gathered.clear()
            return made

        for batch in (x for whole in batches for x in pieces(whole)):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), pc.ascii_lower(batch.column("text")).to_pylist()):
                start = zlib.crc32(f"{doc_id}:".encode())
                for run, n in Counter(pattern.findall(text)).items():
                    h = zlib.crc32(run.encode(), start)
                    if h % ODDS == 0:
                        k = h % len(run)
                        run = run[:k] + run[k + 1 :]
                        if len(run) < least:
                            continue
                    gathered[run] += n
                if len(gathered) > GATHERED:
                    yield out()
        if gathered:
            yield out()

    read = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), whole_text().alias("text"))
    return read.mapInArrow(lean(count), T.StructType(fields("word string, n long")))


def vocabulary(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of words with at least `least` occurrences in all documents."""
    return occurrences(docs).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _band(word: Column, k: int) -> Column:
    """Band k of a word's mask: the parities of every third letter."""
    code = lambda c: F.ascii(c)  # noqa: E731  the code point
    place = lambda c: F.when(code(c) < 128, code(c) - 97).otherwise(code(c) - 192 + 26)

    def flipped(mask: Column, c: Column) -> Column:
        return F.when(place(c) % BANDS == k, mask.bitwiseXOR(F.call_function("shiftleft", F.lit(1), F.floor(place(c) / BANDS).cast("int")))).otherwise(mask)

    return F.aggregate(F.split(word, ""), F.lit(0), flipped)


def keyed(words: DataFrame) -> DataFrame:
    """A row (key, word, n, slot) for each word, length of a shorter word (its own, or one less), half
    and band. The slot is four times the band, two for the front half, one for the longer word."""
    by_length = words.select("word", "n", F.length("word").alias("len"), F.explode(F.array(F.lit(0), F.lit(1))).alias("long"), F.array(*[_band(F.col("word"), k) for k in range(BANDS)]).alias("bands"))
    cut = by_length.withColumn("m", F.col("len") - F.col("long")).withColumn("half", F.floor(F.col("m") / 2).cast("int"))
    front = F.struct(F.lit(2).alias("front"), F.expr("left(word, half)").alias("kept"))
    back = F.struct(F.lit(0).alias("front"), F.expr("right(word, m - half)").alias("kept"))
    spread = cut.select("word", "n", "long", "m", "bands", F.explode(F.array(front, back)).alias("h")).select("word", "n", "long", "m", "h.*", F.posexplode("bands").alias("k", "band"))
    return spread.select(F.xxhash64("m", "front", "kept", "k", "band").alias("key"), "word", "n", (F.col("k") * 4 + F.col("front") + F.col("long")).alias("slot"))


def _dealt(rows: DataFrame) -> DataFrame:
    """`rows` by what an edit in the rest of the word leaves of it: the rest without one letter,
    and its place if the letter is replaced."""
    longer = F.col("slot") % 2 == 1
    m = F.length("word") - F.col("slot") % 2
    half = F.floor(m / 2).cast("int")
    rest = F.when(F.floor(F.col("slot") / 2) % 2 == 1, F.substring("word", half + 1, F.length("word"))).otherwise(F.left("word", F.length("word") - m + half))
    without = "concat(left(rest, i), substring(rest, i + 2))"
    spots = "CASE WHEN length(rest) = 0 THEN array() ELSE sequence(0, length(rest) - 1) END"
    replaced = F.expr(f"transform({spots}, i -> struct(i AS spot, {without} AS left_over))")
    deleted = F.expr(f"array_distinct(transform({spots}, i -> struct(-1 AS spot, {without} AS left_over)))")
    own = F.expr("array(struct(-1 AS spot, rest AS left_over))")
    ways = F.when(longer, deleted).otherwise(F.concat(replaced, own))
    return rows.withColumn("rest", rest).select(*rows.columns, F.explode(ways).alias("way")).select(*rows.columns, F.xxhash64("key", "way.spot", "way.left_over").alias("way"))


def _met(rows: DataFrame, by: str) -> DataFrame:
    """Near pairs of a word (a) and one as long or longer by one letter (b) among rows that share `by`,
    once each: at the first band that they share, and at the front half if they share it.

    `by` has few rows: `GROUP`, or what one letter can make of a word.
    """
    groups = rows.groupBy(by).agg(F.collect_list(F.struct("word", "n", "slot")).alias("g")).filter(F.size("g") > 1)
    pairs = groups.select(F.explode(F.filter("g", lambda x: x["slot"] % 2 == 0)).alias("a"), "g").select("a", F.explode("g").alias("b"))
    named = pairs.select(*[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in ("word", "n", "slot")])
    longer = F.col("b_slot") % 2 == 1
    apart = F.when(longer, F.length("b_word") == F.length("a_word") + 1).otherwise((F.length("b_word") == F.length("a_word")) & (F.col("a_word") < F.col("b_word")))
    same = F.floor(F.col("a_slot") / 2) == F.floor(F.col("b_slot") / 2)
    half = "cast(floor(length(a_word) / 2) AS int)"
    at_front = F.expr(f"(floor(a_slot / 2) % 2 = 1) = (left(a_word, {half}) = left(b_word, {half}))")
    near = named.filter(apart & same).filter("levenshtein(a_word, b_word, 1) = 1").filter(at_front)
    for j in range(BANDS - 1):
        near = near.filter((F.col("a_slot") < 4 * (j + 1)) | (_band(F.col("a_word"), j) != _band(F.col("b_word"), j)))
    return near.select("a_word", "a_n", "b_word", "b_n")


def near_pairs(words: DataFrame, group: int = GROUP) -> DataFrame:
    """(a_word, a_n, b_word, b_n): each two words that an edit parts, once. Settle `words` first."""
    rows = keyed(words)
    full = settle(rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > group).select("key"))
    if full.count() <= BROADCAST:
        full = F.broadcast(full)
    few = _met(rows.join(full, "key", "left_anti"), "key")
    many = _met(_dealt(rows.join(full, "key", "left_semi")), "way")
    return few.unionByName(many)


def with_forms(words: DataFrame, group: int = GROUP, times: int = TIMES) -> DataFrame:
    """word, n, n_near, form, form_n: near words of each, and the one with most occurrences (of
    equals the first in code-point order) if it has `times` the word's or more."""
    pairs = near_pairs(words, group)
    ways = F.array(
        F.struct(F.col("a_word").alias("word"), F.col("b_word").alias("other"), F.col("b_n").alias("other_n")),
        F.struct(F.col("b_word").alias("word"), F.col("a_word").alias("other"), F.col("a_n").alias("other_n")),
    )
    best = F.min(F.struct(-F.col("other_n"), F.col("other")))
    near = pairs.select(F.explode(ways).alias("p")).select("p.*").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    joined = words.join(near, "word", "left")
    form_n = -F.col("best.col1")
    held = form_n >= times * F.col("n")
    return joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(held, F.col("best.other")).alias("form"), F.when(held, form_n).alias("form_n"),
    )


def _roots(links: DataFrame) -> DataFrame:
    """(word, root): where the chain of (word, form) ends. Each turn doubles the way; occurrences
    grow along a chain, so it has an end after a few."""
    now = links.select("word", F.col("form").alias("root"))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = turned(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if now.filter("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def variants(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """word, form, root, n, n_near and form_n of each word of all documents.

    Null text has no words, and a null doc_id counts as an empty one in the rule
    that deletes letters. Repeated rows count each; no word, no rows. Other columns
    are not read. What stays on the driver are numbers of turns only.
    """
    formed = stored(with_forms(stored(vocabulary(docs)), group))
    roots = _roots(formed.filter("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def oracle() -> str:
    """DuckDB SQL for `variants`: words an edit apart share what one of them is without a letter."""
    return rf"""
        WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) t(i))),
             runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[{LETTERS}]+')) AS run FROM documents),
             counted AS MATERIALIZED (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= {LEAST_LENGTH} GROUP BY ALL),
             hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)] ELSE [195, ord(x) - 64] END))),
                                       lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS h FROM counted, tab),
             w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % {ODDS} = 0 THEN left(run, (h % length(run))::INT) || substring(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed)
                                WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
             cut AS MATERIALIZED (SELECT word, i, left(word, i) || substring(word, i + 2) AS s FROM (SELECT word, unnest(range(length(word))) AS i FROM w)),
             pairs AS (SELECT x.word AS a, y.word AS b FROM cut x JOIN cut y ON x.s = y.s AND x.i = y.i AND x.word <> y.word
                       UNION SELECT w.word, cut.word FROM cut JOIN w ON w.word = cut.s UNION SELECT cut.word, w.word FROM cut JOIN w ON w.word = cut.s),
             near AS (SELECT a AS word, count(*) AS n_near, first(b ORDER BY w.n DESC, b) AS best, max(w.n) AS best_n FROM pairs JOIN w ON w.word = b GROUP BY a),
             f AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= {TIMES} * n THEN best END AS form, CASE WHEN best_n >= {TIMES} * n THEN best_n END AS form_n FROM w LEFT JOIN near USING (word)),
             r AS (SELECT word, word AS root FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL)
        SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM f JOIN r ON r.word = f.word JOIN f e ON e.word = r.root WHERE e.form IS NULL
    """
