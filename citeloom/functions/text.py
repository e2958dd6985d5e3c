"""Titles, names and manuscript text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeloom.model import dims

CJK = r"[㐀-䶿一-鿿豈-﫿]"


def bound(c: Column, use) -> Column:
    """`use` of a value that is worked out once, however often `use` names it."""
    return F.get(F.transform(F.array(c), use), 0)


def folded(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def norm_title(c: Column) -> Column:
    """The title as a key: punctuation is deleted, not replaced."""
    return folded(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", ""))


def normalize_str(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""))


def title_tokens(c: Column) -> Column:
    """Distinct words but stop words; punctuation parts words here."""
    stop = F.array(*[F.lit(w) for w in ("", *dims.TITLE_STOPWORDS)])
    return F.array_except(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), stop)


def title_overlap(a: Column, b: Column) -> Column:
    """Shared words over the words of the shorter title; 0 where one has none."""
    x, y = title_tokens(a), title_tokens(b)
    least = F.least(F.size(x), F.size(y))
    share = F.size(F.array_intersect(x, y)) / F.when(least > 0, least)
    return F.coalesce(share, F.lit(0.0))


def is_initials(c: Column) -> Column:
    bare = F.trim(F.replace(c, F.lit("."), F.lit("")))
    return (F.length(bare).between(1, 3)) & (bare == F.upper(bare)) & bare.rlike(r"\p{Lu}")


def surname_candidates(c: Column) -> Column:
    """What may be the family name: the words before a comma, or every word but initials."""
    split = lambda x: F.filter(F.split(F.trim(x), r"\s+"), lambda w: w != "")
    words = split(c)
    full = F.filter(words, lambda w: ~is_initials(w))
    loose = F.when(F.size(full) > 0, full).otherwise(words)
    names = F.when(c.rlike("[,，]"), split(F.element_at(F.split(c, "[,，]"), 1))).otherwise(loose)
    return F.array_distinct(F.filter(F.transform(names, normalize_str), lambda w: w != ""))


def strip_invisible(c: Column) -> Column:
    """Format and control characters go first (line ends too), then space folds."""
    return folded(F.regexp_replace(c, r"[\p{Cf}\p{Cc}]", ""))


def split_authors(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"\s+\band\b\s+"), lambda a: F.trim(a)), lambda a: a != "")


def meaningful(c: Column) -> Column:
    return c.rlike(r"\p{L}")


def valid_title(c: Column) -> Column:
    return (F.length(c) >= 3) & meaningful(c)


def cjk_sequence(c: Column) -> Column:
    return F.array_join(F.regexp_extract_all(c, F.lit(f"({CJK})"), 1), "")


def effective_chars(c: Column) -> Column:
    """Code points but punctuation, separators and control characters."""
    return F.length(F.regexp_replace(c, r"[\p{P}\p{Z}\p{C}]", ""))


def all_terms(c: Column, terms: list[str]) -> Column:
    """Every usable term occurs, in any case."""
    usable = [t for t in ("".join(ch for ch in t if ch not in ':()"').strip().lower() for t in terms) if t]
    held = F.lit(True)
    for t in usable:
        held = held & F.contains(F.lower(c), F.lit(t))
    return held


def restore_abstract(index: Column) -> Column:
    """Text from a map of word to positions; of words at one position the last wins."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(F.filter(e["value"], lambda p: p >= 0), lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    numbered = F.transform(pairs, lambda x, i: F.struct(x["p"].alias("p"), i.alias("i"), x["w"].alias("w")))
    # bound as a variable, so that the order is worked out once and not for each word
    last = lambda o: F.filter(o, lambda x, i: F.coalesce(F.get(o, i + 1)["p"] != x["p"], F.lit(True)))
    joined = F.transform(F.array(F.array_sort(numbered)), lambda o: F.array_join(F.transform(last(o), lambda x: x["w"]), " "))
    return F.nullif(F.get(joined, 0), F.lit(""))
