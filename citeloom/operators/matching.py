"""Inexact title matches: an overlap join over an inverted index, and the best few of each source.

Two titles are as alike as their shared words over the words of the shorter one. If at
least a share s of a title of n words is in the other, one of its n - ceil(s * n) + 1
rarest words is. So only those are looked up in the index of the other side's words.

Pairs that share a rare word are looked at one by one; there are no more than the words
times `RARE`. What the others share are frequent words only, so all titles with the same
frequent words and the same size are one class, and as only the best few of a source are
asked for, a class needs its first few hits and no pairs of titles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions import text as X
from citeloom.functions.text import bound
from citeloom.session import settled

#: Titles of one word that are looked through at once; a word with more is dealt over several tasks.
POSTINGS = 4096
#: Titles, of both sides together, that hold a word which is still rare.
RARE = 256


def title_key(title: Column) -> Column:
    """A title's distinct words in alphabetical order, blanks between: equal for equal sets."""
    return F.array_join(F.sort_array(X.title_tokens(title)), " ")


def _told(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """`rows` (by token) with `titles`, how many titles hold the token. Words of a thousandth of all
    rows or more, a thousand at most, are broadcast, so their rows stay where they are."""
    total = counts.agg(F.coalesce(F.sum("titles"), F.lit(0)).alias("n")).first().n
    hot = F.broadcast(counts.filter(F.col("titles") * 1000 >= total))
    cold = counts.filter(F.col("titles") * 1000 < total)
    return rows.join(hot, "token").unionByName(rows.join(hot.select("token"), "token", "left_anti").join(cold, "token"))


def _probed(titles: DataFrame, least: float) -> DataFrame:
    """Each title's rarest words, as many as it takes, with those before each; `o` is a title's
    words that count, the rarest first, and `n` the size of all."""
    prefix = (F.size("o") - F.ceil(F.col("n") * least - 1e-9) + 1).cast("int")
    held = titles.withColumn("p", F.slice("o", F.lit(1), F.greatest(F.lit(0), prefix)))
    spread = held.select("key", "n", "words", F.col("p.token").alias("first"), F.posexplode("p").alias("at", "w"))
    return spread.select(F.col("w.token").alias("token"), F.col("w.titles").alias("titles"), F.col("key").alias("a"), F.col("n").alias("a_n"), F.col("words").alias("a_words"), F.slice("first", F.lit(1), F.col("at")).alias("before"))


def _indexed(titles: DataFrame) -> DataFrame:
    spread = titles.select("key", "n", "words", F.explode("o").alias("w"))
    return spread.select(F.col("w.token").alias("token"), F.col("w.titles").alias("titles"), F.col("key").alias("b"), F.col("n").alias("b_n"), F.col("words").alias("b_words"))


def _counted(sides: list[DataFrame]) -> list[DataFrame]:
    """(key, words, n) of both sides with `o`, each title's words with the titles of both sides that
    hold them, the rarest first."""
    exploded = [s.select("key", "n", F.explode("words").alias("token")) for s in sides]
    counts = settled(exploded[0].unionByName(exploded[1]).groupBy("token").agg(F.count(F.lit(1)).alias("titles")))
    ordered = F.sort_array(F.collect_list(F.struct("titles", "token")))
    told = [_told(s.select("key", "n", "words", F.explode("words").alias("token")), counts) for s in sides]
    return [settled(t.groupBy("key", "n", "words").agg(ordered.alias("o"))) for t in told]


def _met(asked: DataFrame, listed: DataFrame, on: list[str], from_left: bool, least: float) -> DataFrame:
    """Pairs that share a word asked for: equal sizes are met from the left only, and a pair at
    its first shared word only."""
    sized = F.col("a_n") <= F.col("b_n") if from_left else F.col("a_n") < F.col("b_n")
    met = asked.drop("titles").join(listed.drop("titles"), on).filter(sized & ~F.arrays_overlap("before", "b_words"))
    overlap = F.size(F.array_intersect("a_words", "b_words")) / F.col("a_n")
    named = ("a", "b") if from_left else ("b", "a")
    return met.select(F.col(named[0]).alias("l"), F.col(named[1]).alias("r"), overlap.alias("overlap")).filter(F.col("overlap") >= least)


def similar(left: DataFrame, right: DataFrame, least: float = 0.8, postings: int = POSTINGS) -> DataFrame:
    """(l, r, overlap): keys of `left` and `right` (key: `title_key`, distinct) that share at least
    `least` of the shorter one's words. Titles without a word are like none.

    Sides with `words` and `n` of their own are compared by those: `n` words, of which only
    `words` can be shared."""
    sides = [df if "words" in df.columns else df.filter("key <> ''").select("key", F.split("key", " ").alias("words")).withColumn("n", F.size("words")) for df in (left, right)]
    counted = _counted(sides)
    salts = F.ceil(F.col("titles") / postings).cast("int")
    out = []
    for probe, index in ((0, 1), (1, 0)):
        asked = _probed(counted[probe], least).withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        listed = _indexed(counted[index]).withColumn("salt", F.pmod(F.xxhash64("b"), salts).cast("int"))
        out.append(_met(asked, listed, ["token", "salt"], probe == 0, least))
    return reduce(DataFrame.unionByName, out)


def _first(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group as `place`; tasks keep no more before their rows meet."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("place") <= n)


def _held(hits: DataFrame, top: int) -> DataFrame:
    """(r, hits [{source, ords}]): of each source the `top` first hits with the words r."""
    w = Window.partitionBy("r", "source").orderBy("ord")
    few = _first(hits, ["r", "source"], [F.col("ord")], top)
    ords = F.array_compact(F.array(*[F.lead(F.struct("ord"), i).over(w) for i in range(top)]))
    lists = few.withColumn("ords", ords).filter("place = 1").select("r", F.struct("source", "ords").alias("h"))
    return lists.groupBy("r").agg(F.collect_list("h").alias("hits"))


def _frequent(rare: int) -> Column:
    return F.sort_array(F.filter("o", lambda w: w["titles"] > rare)["token"])


def _class_of(rare: int) -> Column:
    """Titles with the same frequent words and the same size are one class; null without such words."""
    return bound(_frequent(rare), lambda w: F.when(F.size(w) > 0, F.concat_ws(" ", F.col("n").cast("string"), w)))


def _by_class(counted: list[DataFrame], held: DataFrame, top: int, least: float, rare: int) -> DataFrame:
    """(class, others [{source, overlap, ord, r}]): for each class of the left side the `top` first
    hits of each source by what frequent words alone make them alike."""
    left, right = (c.select("key", _class_of(rare).alias("class"), "n", _frequent(rare).alias("words")).filter(F.size("words") > 0) for c in counted)
    classes = [c.select(F.col("class").alias("key"), "words", "n").distinct() for c in (left, right)]
    pairs = similar(*map(settled, classes), least)
    # the first few hits of a class are among the titles with its first few first hits
    rows = held.join(right.select(F.col("key").alias("r"), F.col("class").alias("c")), "r").select("c", "r", F.explode("hits").alias("h")).select("c", "r", "h.*")
    rows = _first(rows, ["c", "source"], [F.col("ords")[0]["ord"]], top).select("c", "r", "source", F.explode("ords.ord").alias("ord"))
    rows = settled(_first(rows, ["c", "source"], [F.col("ord")], top).drop("place"))
    best = _first(pairs.select("l", F.col("r").alias("c"), "overlap").join(rows, "c"), ["l", "source"], [F.col("overlap").desc(), F.col("ord")], top)
    return best.groupBy(F.col("l").alias("class")).agg(F.collect_list(F.struct("source", "overlap", "ord", "r")).alias("others"))


def title_matches(refs: DataFrame, hits: DataFrame, top: int = 5, least: float = 0.8, rare: int = RARE) -> DataFrame:
    """(ref_id, source, place, ord, overlap): of each source's hits (source, ord, title) the `top` most
    like a reference's title, the first by `ord` among equals. Less alike than `least` is no match.

    Equal sets of words are one on both sides until the end; null titles have no words.
    What a title finds over rare words is exact; of what its class finds over frequent ones,
    titles that were found already are left out, and of both the first are taken: whatever
    is behind the first `top` of a class is behind them for each of its titles, as sharing a
    rare word too only makes those more alike.
    """
    asked = settled(refs.select("ref_id", title_key(F.coalesce("title", F.lit(""))).alias("l"))).filter("l <> ''")
    held = settled(_held(hits.select("source", "ord", title_key(F.coalesce("title", F.lit(""))).alias("r")), top)).filter("r <> ''")
    sides = [k.select("key", F.split("key", " ").alias("words")).withColumn("n", F.size("words")) for k in (asked.select(F.col("l").alias("key")).distinct(), held.select(F.col("r").alias("key")))]
    counted = _counted(sides)

    few = F.col("titles") <= rare
    near = reduce(DataFrame.unionByName, [_met(_probed(counted[a], least).filter(few), _indexed(counted[b]).filter(few), ["token"], a == 0, least) for a, b in ((0, 1), (1, 0))])
    found = near.join(held, "r").groupBy("l").agg(F.collect_list(F.struct("r", "overlap", "hits")).alias("found"))
    # a title without a frequent word is a class that no other is like
    classes = counted[0].select(F.col("key").alias("l"), F.coalesce(_class_of(rare), F.concat(F.lit(" "), "key")).alias("class"))
    both = classes.join(found, "l", "left").join(_by_class(counted, held, top, least, rare), "class", "left")
    placed = both.select("l", _placed(F.col("found"), F.col("others"), top).alias("best"))
    return asked.join(placed, "l").select("ref_id", F.explode("best").alias("b")).select("ref_id", "b.*")


def _placed(found: Column, others: Column, top: int) -> Column:
    """[{source, place, ord, overlap}], the `top` first of each source: of the hits of titles that were
    found, and of the class's, but for those of the same titles."""
    entry = lambda source, overlap, ord: F.struct(source.alias("source"), (-overlap).alias("less"), ord.alias("ord"))
    own = F.flatten(F.transform(found, lambda f: F.flatten(F.transform(f["hits"], lambda h: F.transform(h["ords"], lambda o: entry(h["source"], f["overlap"], o["ord"]))))))
    known = F.coalesce(found["r"], F.array().cast("array<string>"))
    rest = bound(known, lambda k: F.transform(F.filter(others, lambda x: ~F.array_contains(k, x["r"])), lambda x: entry(x["source"], x["overlap"], x["ord"])))
    # in order of sources, so that an entry is among the first of its own if the one `top` places before it is another's
    ordered = F.sort_array(F.concat(F.coalesce(own, F.array()), F.coalesce(rest, F.array())))
    same = lambda a, i, x: (i >= 0) & F.get(a, i)["source"].eqNullSafe(x["source"])
    kept = bound(ordered, lambda a: F.filter(a, lambda x, i: ~same(a, i - top, x)))
    place = lambda a, x, i: reduce(lambda n, j: n + F.when(same(a, i - j, x), 1).otherwise(0), range(1, top), F.lit(1))
    return bound(kept, lambda a: F.transform(a, lambda x, i: F.struct(x["source"].alias("source"), place(a, x, i).alias("place"), x["ord"].alias("ord"), (-x["less"]).alias("overlap"))))


def title_answers(refs: DataFrame, hits: DataFrame, top: int = 5, least: float = 0.8) -> DataFrame:
    """Matches as what a source answers to a title (source, title, place, hit, error), for `verify.outcomes`."""
    found = title_matches(refs.select("ref_id", "title"), hits, top, least)
    titled = refs.select("ref_id", F.lower("title").alias("title"))
    rows = found.join(titled, "ref_id").select("source", "title", "place", F.col("ord").alias("hit")).distinct()
    return rows.withColumn("error", F.lit(None).cast("string"))
