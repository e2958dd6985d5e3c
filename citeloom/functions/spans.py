"""Counts of listed words in one pass over a text: an automaton finds every place, and of places
that overlap the longest word's is chosen.

What a longer word or a mask holds is no hit of a shorter one; of one length the earlier in
the list comes first, and of one word the earlier place. That choice needs all places of a
text at once, so it is Python on Arrow batches; a list of any length is read in one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

COUNTS = T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())]))
#: Words to count, and words whose places are taken first and not counted.
Listed = tuple[tuple[str, ...], tuple[str, ...]]


class Lists:
    """Several lists over one automaton; each chooses among its own words only."""

    def __init__(self, lists: dict[str, Listed]) -> None:
        self.automaton = ahocorasick.Automaton()
        self.order: dict[str, dict[str, int]] = {}
        self.counted: dict[str, list[str]] = {}
        for name, (words, mask) in lists.items():
            masked, counted = (sorted(dict.fromkeys(w for w in ws if w), key=len, reverse=True) for ws in (mask, words))
            self.order[name] = {w: k for k, w in enumerate(dict.fromkeys([*masked, *counted]))}
            self.counted[name] = [w for w in counted if w not in masked]
            for w in (*masked, *counted):
                self.automaton.add_word(w, w)
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()

    def count(self, text: str) -> dict[str, list[dict]]:
        """{list: [{word, n}]} with words in the order of length, those without a place left out."""
        places = [] if self.empty else [(end - len(w) + 1, w) for end, w in self.automaton.iter(text)]
        return {name: self._chosen(name, places) for name in self.order}

    def _chosen(self, name: str, places: list[tuple[int, str]]) -> list[dict]:
        order = self.order[name]
        own = sorted((order[w], at, w) for at, w in places if w in order)
        taken: set[int] = set()
        n: dict[str, int] = {}
        for _, at, w in own:
            span = range(at, at + len(w))
            if taken.isdisjoint(span):
                taken.update(span)
                n[w] = n.get(w, 0) + 1
        return [{"word": w, "n": n[w]} for w in self.counted[name] if w in n]


def counter(lists: dict[str, Listed]) -> Callable[[Column], Column]:
    """A function of a text column that gives a struct: for each list its counts (COUNTS)."""
    schema = T.StructType([T.StructField(name, COUNTS) for name in lists])

    @F.pandas_udf(schema)
    def counts(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        held = Lists(lists)
        for s in parts:
            made = [held.count(t or "") for t in s]
            yield pd.DataFrame({name: pd.Series([m[name] for m in made], dtype=object) for name in lists})

    return counts


@lru_cache(maxsize=64)
def _glossary(words: tuple[str, ...]) -> Lists:
    return Lists({"terms": (words, ())})


@F.pandas_udf(COUNTS)
def glossary_counts(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Counts of each row's own words; rows of one list share its automaton."""
    for texts, words in parts:
        yield pd.Series([_glossary(tuple(w) if w is not None else ()).count(t or "")["terms"] for t, w in zip(texts, words)], dtype=object)


def total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x["n"])


def top(counts: Column, most: int) -> Column:
    """The `most` frequent of a list of counts; of equals those that come first in it."""
    ranked = F.array_sort(F.transform(counts, lambda x, i: F.struct((-x["n"]).alias("less"), i.alias("i"), x["word"].alias("word"))))
    return F.transform(F.slice(ranked, 1, most), lambda x: F.struct(x["word"].alias("word"), (-x["less"]).alias("n")))
