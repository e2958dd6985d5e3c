"""Markdown manuscripts as column expressions, and the sentence scan.

A text is cut at what encloses other text (front matter, comments, fences) with one
regular expression each, so every expression is linear in the text; then lines are
looked at by themselves.
"""

from __future__ import annotations

import re
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.functions.text import bound
from citeloom.model import dims

#: Blanks within a line, as a class's inside.
W = r" \t\p{Z}"
#: Signs that part what a text is cut into; taken out of texts first.
CUT, MARK = "\u0002", "\u0001"

_FENCE = rf"(?m)^[{W}]*(?:```|~~~)[^\n]*$"
_BREAKS = "\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029"


def plain_lines(c: Column) -> Column:
    """The text with one kind of line end and without the signs used here; most texts are so
    already, and one look tells."""
    plain = lambda t: F.regexp_replace(F.regexp_replace(t, f"\r\n|[{_BREAKS}]", "\n"), f"[{MARK}{CUT}]", "")
    return bound(F.coalesce(c, F.lit("")), lambda t: F.when(t.rlike(f"[{_BREAKS}{MARK}{CUT}]"), plain(t)).otherwise(t))


def without_front_matter(c: Column) -> Column:
    """A block between two lines of three dashes at the very start goes; without an end all goes."""
    dashes = rf"[{W}]*---[{W}]*"
    return F.regexp_replace(c, rf"\A{dashes}\n(?:[\s\S]*?\n)??{dashes}(?:\n|\z)|\A{dashes}(?:\n[\s\S]*|\z)", "")


def without_comments(c: Column) -> Column:
    """Lines from one that begins a comment to the one that ends it go, or to the end."""
    return F.regexp_replace(c, rf"(?m)^[{W}]*<!-(?=-)[\s\S]*?(?:-->[^\n]*(?:\n|\z)|\z)", "")


def parted(c: Column) -> Column:
    """A text cut at its fence lines: outside, fence, inside, fence, outside, ..."""
    return F.split(F.regexp_replace(c, f"({_FENCE})", f"{MARK}$1{MARK}"), MARK)


def outside(pieces: Column) -> Column:
    """What of a parted text is outside fences."""
    return F.array_join(F.filter(pieces, lambda _, i: i % 4 == 0), "")


def on_outside(pieces: Column, change) -> Column:
    """A parted text put together again, with `change` done to what is outside fences."""
    return F.array_join(F.transform(pieces, lambda p, i: F.when(i % 4 == 0, change(p)).otherwise(p)), "")


def strip_inline(c: Column) -> Column:
    """A line's words: links give their text; pictures, notes, code, tags, emphasis and layer marks go."""
    unlinked = F.regexp_replace(F.regexp_replace(c, r"!\[[^\]]*\]\([^)]*\)", ""), r"\[([^\]]*)\]\([^)]*\)", "$1")
    marks = "".join(sorted({m for m in dims.LAYER_MARKS} | {"\ufe0f"}))
    bare = F.regexp_replace(unlinked, rf"\[\^[^\]]*\]|`[^`]*`|<[^>]+>|[*_]|~~|[{marks}]", "")
    return F.trim(F.regexp_replace(bare, r"[ \t]{2,}", " "))


def strip_markdown(c: Column, keep_quotes: bool = False) -> Column:
    """Prose of a markdown text; quoted lines are kept, without their sign, on request."""
    body = outside(parted(without_comments(without_front_matter(plain_lines(c)))))
    lines = F.transform(F.split(body, "\n"), lambda l: F.regexp_replace(l, rf"^[{W}]+|[{W}]+$", ""))  # noqa: E741
    drop = r"^$|^\||^#|^\[\^[^\]]*\]:|^(?:-{3,}|\*{3,}|_{3,}|={3,})$"
    if keep_quotes:
        lines = F.transform(lines, lambda l: F.when(l.rlike(drop), "").otherwise(F.regexp_replace(l, rf"^>+[{W}]*", "")))  # noqa: E741
        lines = F.filter(lines, lambda l: ~l.rlike(r"^(?:-{3,}|\*{3,}|_{3,}|={3,})?$"))  # noqa: E741
    else:
        lines = F.filter(lines, lambda l: ~l.rlike(drop + "|^>"))  # noqa: E741
    bare = F.transform(lines, lambda l: strip_inline(F.regexp_replace(l, rf"^(?:[-*+]|[0-9]+[.)])[{W}]+", "")))  # noqa: E741
    return F.array_join(F.filter(bare, lambda l: l != ""), "\n")  # noqa: E741


def quote_lines(c: Column) -> Column:
    """Lines outside fences that begin with the quote sign."""
    return F.regexp_count(outside(parted(plain_lines(c))), F.lit(rf"(?m)^[{W}]*>"))


def gap_lines(c: Column) -> Column:
    """Lines with the warning sign and one of the gap words, at most GAP_LINE long."""
    lines = F.transform(F.split(plain_lines(c), "\n"), lambda l: F.regexp_replace(l, rf"^[{W}]+|[{W}]+$", ""))  # noqa: E741
    held = F.filter(lines, lambda l: F.contains(l, F.lit("⚠")) & l.rlike("|".join(dims.GAP_WORDS)))  # noqa: E741
    return F.transform(held, lambda l: F.when(F.length(l) > dims.GAP_LINE, F.concat(F.substring(l, 1, dims.GAP_LINE), F.lit("…"))).otherwise(l))  # noqa: E741


def without_gap_words(c: Column) -> Column:
    """Gap words go, with a bracket behind them; the line's own text stays."""
    return F.regexp_replace(c, rf"(?:{'|'.join(dims.GAP_WORDS)})[{W}\n]*(?:[(（][^)）]*[)）])?", "")


def citation_counts(c: Column) -> tuple[Column, Column]:
    """Author-year and numeric citations of a stripped text."""
    return F.regexp_count(c, F.lit(dims.CITED_BY_YEAR)), F.regexp_count(c, F.lit(dims.CITED_BY_NUMBER))


def anchor_links(c: Column) -> Column:
    """Links into the literature folder, of a text that is not stripped."""
    return F.regexp_count(c, F.lit(dims.LITERATURE_LINK))


def paragraphs(c: Column) -> Column:
    """Blank lines part paragraphs, but not inside fences; front matter goes."""
    pieces = parted(without_front_matter(plain_lines(c)))
    cut = on_outside(pieces, lambda p: F.regexp_replace(p, rf"\n[{W}\n]*\n", CUT))
    trimmed = F.transform(F.split(F.regexp_replace(cut, rf"\A[{W}\n]*\n", ""), CUT), lambda p: F.regexp_replace(p, r"^\n+|\n+$", ""))
    return F.filter(trimmed, lambda p: p.rlike(rf"[^{W}\n]"))


def sections(c: Column) -> Column:
    """[{name, body}] cut at the shallowest level of headings that is used twice, else the
    shallowest; what is before the first cut counts if it has prose."""
    return bound(without_front_matter(plain_lines(c)), lambda body: bound(parted(body), lambda pieces: bound(_cut_level(pieces), lambda level: _sections(body, pieces, level))))


def _cut_level(pieces: Column) -> Column:
    heads = F.regexp_extract_all(outside(pieces), F.lit(rf"(?m)^[{W}]*(#{{1,6}})[{W}]+[^\n]*[^\n{W}]"), 1)
    counts = bound(F.transform(heads, F.length), lambda sizes: F.transform(F.sequence(F.lit(1), F.lit(6)), lambda n: F.size(F.filter(sizes, lambda h: h == n))))
    # the least level with so many headings; array_position is 0 without one
    return bound(counts, lambda k: F.coalesce(*[F.nullif(F.array_position(F.transform(k, lambda x: x >= least), F.lit(True)), F.lit(0)) for least in (2, 1)]))


def _sections(body: Column, pieces: Column, level: Column) -> Column:
    cut_at = F.concat(F.lit(rf"(?m)^([{W}]*#{{"), level.cast("string"), F.lit(rf"}}[{W}]+[^\n]*[^\n{W}])"))
    cut = on_outside(pieces, lambda p: F.regexp_replace(p, cut_at, F.lit(f"{CUT}$1")))
    made = F.transform(F.split(cut, CUT), lambda s, i: F.struct(
        F.when(i == 0, "（篇首）").otherwise(F.regexp_extract(s, rf"\A[{W}]*#{{1,6}}[{W}]+([^\n]*[^\n{W}])", 1)).alias("name"),
        F.regexp_replace(s, r"\n\z", "").alias("body"),
    ))
    kept = F.filter(made, lambda s, i: (i > 0) | (strip_markdown(s["body"]) != ""))
    return F.when(level.isNull(), F.array(F.struct(F.lit("全文").alias("name"), F.regexp_replace(body, r"\n\z", "").alias("body")))).otherwise(kept)


# -- sentences ---------------------------------------------------------------------------
_OPEN, _CLOSE, _END = (re.escape(s) for s in (dims.OPENERS, dims.CLOSERS, dims.SENTENCE_END + "."))
#: All that decides where a sentence ends: a run of end marks with what closes behind it,
#: an opening or a closing sign, a straight quote.
_SIGNS = re.compile(rf"(?P<end>[{_END}]+)(?P<after>[{_CLOSE}]*)|(?P<open>[{_OPEN}]+)|(?P<close>[{_CLOSE}]+)|\"")
_LETTERS = re.compile(r"[A-Za-z]{1,12}\Z")
_DIGIT = re.compile(r"\d")
_CITED = [re.compile(p) for p in (dims.CITED_BY_YEAR, dims.CITED_BY_NUMBER)]


def _stops(text: str, at: int) -> bool:
    """Whether a single dot ends a sentence: not within a number, not behind an abbreviation."""
    if text[at - 1 : at].isdigit() and text[at + 1 : at + 2].isdigit():
        return False
    word = _LETTERS.search(text, max(0, at - 12), at)
    return word is None or word[0].lower() not in dims.ABBREVIATIONS


def sentences_of(text: str) -> list[str]:
    """Sentences of a text; none ends inside brackets or quotes."""
    cuts, depth, quoted = [0], 0, False
    for m in _SIGNS.finditer(text):
        if m["open"]:
            depth += len(m["open"])
        elif m["close"]:
            depth = max(0, depth - len(m["close"]))
        elif not m["end"]:
            quoted = not quoted
        elif depth or quoted or (m["end"] == "." and not _stops(text, m.start())):
            depth = max(0, depth - len(m["after"]))
        else:
            cuts.append(m.end())
    parts = (text[a:b].strip() for a, b in zip(cuts, [*cuts[1:], len(text)]))
    return [p for p in parts if p]


def cited_at(sentence: str) -> tuple[int, int, int]:
    """Citations at the beginning, in the middle and at the end of a sentence."""
    found = [0, 0, 0]
    if not _DIGIT.search(sentence):  # both patterns hold one
        return tuple(found)
    size = len(sentence.rstrip(dims.SENTENCE_END + "." + dims.CLOSERS))
    for pattern in _CITED:
        for m in pattern.finditer(sentence):
            found[2 if size - m.end() <= 2 else 0 if m.start() <= 8 or m.start() <= 0.15 * max(1, size) else 1] += 1
    return tuple(found)


_PLACES = ("at_head", "inside", "at_end")
_SENTENCE = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), *[T.StructField(n, T.IntegerType()) for n in _PLACES]]))


@F.arrow_udf(_SENTENCE)
def sentences(texts: pa.Array) -> pa.Array:
    """Sentences with their citations' places. Needs open brackets counted, which no
    regular expression does; it looks at signs only, not at letters."""
    found = [sentences_of(t or "") for t in texts.to_pylist()]
    flat = [x for s in found for x in s]
    places = zip(*map(cited_at, flat)) if flat else ((), (), ())
    rows = pa.StructArray.from_arrays([pa.array(flat, pa.string()), *[pa.array(p, pa.int32()) for p in places]], names=["text", *_PLACES])
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, found))], pa.int32()), rows)
