"""References as people write them: parsing, a step at a time, and format rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions import identifiers as I
from citeloom.functions import text as X

_YEARS = r"(?:1[89][0-9]{2}|20[0-9]{2})"
_TAG = r"(?i)\[(?:[JMDCNRSPG]|EB/OL|J/OL)\]"
_DOI = r"(?i)10\.[0-9]{4,}/[^\s,;\]]+"
_ENTRY = r"@\w+\s*\{"
_TITLE_ENDS = " .,，"
#: Full-width marks that a reference writes half-width.
FULL_WIDTH = "。，；：！？（）、"

#: Fields of a parsed reference.
PARSED = ("doi", "title", "authors", "year", "venue", "type", "raw_text", "parse_status")


def _strip(c: Column, signs: str) -> Column:
    inside = signs.replace("\\", "\\\\")
    return F.regexp_replace(c, rf"^[{inside}]+|[{inside}]+$", "")


def _cut(c: Column, pattern: str) -> Column:
    """The place of a pattern's first match, or null."""
    at = F.regexp_instr(c, F.lit(pattern))
    return F.when(at > 0, at)


def is_bib(c: Column) -> Column:
    return c.rlike(_ENTRY)


def doi_of(c: Column) -> Column:
    """The first DOI of a text; marks behind it and brackets that it did not open go."""
    raw = F.regexp_replace(F.regexp_extract(c, _DOI, 0), "[.,;:]+$", "")
    more = lambda x: F.regexp_count(x, F.lit(r"\)")) - F.regexp_count(x, F.lit(r"\("))
    shorter = lambda x: F.when(x.endswith(")") & (more(x) > 0), F.regexp_replace(x, r"\)[.,;:]*$|[.,;:]+$", "")).otherwise(x)
    closed = lambda r: F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), more(r))), r, lambda x, _: F.regexp_replace(shorter(x), "[.,;:]+$", ""))
    return I.blank_to_null(X.bound(raw, closed))


def _with_line(rows: DataFrame) -> DataFrame:
    """Adds what a line (`_line`) in a numbered or author-year style says, a step at a time.

    Authors stand before a bracketed year if there is one, else before the first dot that
    ends a word; the title comes next, up to a type tag or a dot.
    """
    line, body, head, rest, marked, dot = (F.col(f"_{n}") for n in ("line", "body", "head", "rest", "marked", "dot"))
    year_mark, word_end = rf"[（(]\s*{_YEARS}[a-z]?\s*[）)]\s*\.?\s*", r"\.(?=[ \n]|\z)"
    by_year, by_dot = F.coalesce(marked > 1, F.lit(False)), F.coalesce(dot > 1, F.lit(False))
    behind = F.when(by_year, F.trim(F.substring(body, marked + F.length(F.regexp_extract(body, year_mark, 0)), F.length(body))))
    behind = behind.when(by_dot, F.trim(F.substring(body, dot + 1, F.length(body)))).otherwise(body)
    named = F.when((head != "") & ~head.rlike(r"^[0-9]") & (F.length(head) < F.when(by_year, 300).otherwise(80)), F.array(head))
    tag, stop = F.col("_tag"), F.col("_stop")
    upto = F.when(tag.isNotNull(), tag).when(stop > 1, stop).otherwise(F.length(rest) + 1)
    steps = [
        {"_body": F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.trim(line), r"^\s*\[[0-9]+\]\s*", "")), _DOI, ""))},
        {"_marked": _cut(body, year_mark), "_dot": _cut(body, word_end)},
        {"_head": F.when(by_year, _strip(F.substring(body, F.lit(1), marked - 1), _TITLE_ENDS)).when(by_dot, _strip(F.substring(body, F.lit(1), dot - 1), " ,，")), "_behind": behind},
        {"_authors": named, "_rest": _strip(F.regexp_replace("_behind", rf"(?<![0-9]){_YEARS}(?![0-9])", ""), " .,，()")},
        {"_tag": _cut(rest, _TAG), "_stop": _cut(rest, word_end)},
        {"_title": _strip(F.substring(rest, F.lit(1), upto - 1), _TITLE_ENDS)},
        {"_title": F.when(X.valid_title(F.col("_title")), F.col("_title")), "_type": I.blank_to_null(F.regexp_extract(line, _TAG, 0))},
    ]
    for s in steps:
        rows = rows.withColumns(s)
    return rows


def bib_entries(c: Column) -> Column:
    """The entries of a BibTeX text that have a field."""
    found = F.transform(F.split(c, rf"(?={_ENTRY})"), lambda e: F.trim(F.regexp_replace(e, r"^\s+|\s+$", "")))
    return F.filter(found, lambda e: e.startswith("@") & e.rlike(_FIELD))


_FIELD = r"(?s)(\w+)\s*=\s*(?:\{(.*?)\}|\"(.*?)\")"


def _with_entry(rows: DataFrame) -> DataFrame:
    """Adds the fields of a BibTeX entry (`_entry`) as columns; of fields that repeat the first counts."""
    entry, names = F.col("_entry"), F.col("_names")
    rows = rows.withColumns({"_names": F.transform(F.regexp_extract_all(entry, F.lit(_FIELD), 1), F.lower), **{f"_value{k}": F.regexp_extract_all(entry, F.lit(_FIELD), k) for k in (2, 3)}})
    at = lambda n: (F.array_position(names, n) - 1).cast("int")
    value = lambda n: F.trim(F.concat(F.get("_value2", at(n)), F.get("_value3", at(n))))
    wanted = ("doi", "title", "author", "year", "journal", "booktitle")
    return rows.withColumns({f"_b_{n}": I.blank_to_null(F.when(F.array_contains(names, n), value(n))) for n in wanted})


def units(c: Column) -> Column:
    """What a text is parsed as, [{kind, token}]: BibTeX entries (bib) if it has some, a line each
    (line) if it has several, else the whole (single)."""
    each = lambda tokens, kind: F.transform(tokens, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("token")))

    def cut(t: Column) -> Column:
        lines = F.filter(F.transform(F.split(t, r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x != "")
        by_line = X.bound(lines, lambda ls: F.when(F.size(ls) > 1, each(ls, "line")).otherwise(each(F.array(t), "single")))
        whole = X.bound(bib_entries(t), lambda e: F.when(is_bib(t) & (F.size(e) > 0), each(e, "bib")).otherwise(by_line))
        return F.when(t != "", whole)

    return X.bound(F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", ""), cut)


def parsed(rows: DataFrame) -> DataFrame:
    """`rows` (kind and token, see `units`) with the fields of PARSED in their place.

    A step adds a few columns and the next reads them, so no expression holds another twice.
    """
    own = [c for c in rows.columns if c not in ("kind", "token")]
    t, doi, kind, entry = F.col("_t"), F.col("_doi"), F.col("_kind"), F.col("_entry")
    single = F.col("kind") == "single"
    r = rows.withColumn("_t", F.when(single, F.trim(F.regexp_replace("token", r"^\s+|\s+$", ""))).otherwise(F.col("token")))
    r = r.withColumn("_doi", F.when(F.col("kind") != "bib", doi_of(t)))
    bare = doi.isNotNull() & (F.lower(_strip(t, ".,;) ")) == F.lower(doi))
    r = r.withColumn("_kind", F.when(single, F.when(t == "", "none").when(bare, "doi").when(t.rlike("^" + _ENTRY), "bib").otherwise("line")).otherwise(F.col("kind")))
    r = r.withColumns({"_entry": F.when(kind == "bib", F.when(single, F.get(bib_entries(t), 0)).otherwise(t)), "_line": F.when(kind == "line", t)})
    r = _with_entry(_with_line(r))
    year = F.when(F.col("_b_year").rlike(r"^[0-9]+$"), F.col("_b_year").try_cast("int")).otherwise(I.reference_year(F.col("_b_year")))
    authors = F.filter(F.transform(F.split("_b_author", r"\s+and\s+"), lambda x: F.trim(x)), lambda a: a != "")
    pick = lambda bib, line: F.when(kind == "bib", bib).when(kind == "line", line)
    r = r.select(
        *own, F.when(kind == "bib", F.col("_b_doi")).when(kind != "none", doi).alias("doi"), pick(F.col("_b_title"), F.col("_title")).alias("title"),
        F.coalesce(pick(authors, F.col("_authors")), F.array().cast("array<string>")).alias("authors"), pick(year, I.reference_year(F.col("_line"))).cast("int").alias("year"),
        F.when(kind == "bib", F.coalesce("_b_journal", "_b_booktitle")).alias("venue"), F.col("_type").alias("type"), F.coalesce(entry, t).alias("raw_text"),
    )
    return r.withColumn("parse_status", F.when(F.col("doi").isNotNull() | F.col("title").isNotNull(), "ok").otherwise("unparsed"))


def format_issues(raw: Column, authors: Column) -> Column:
    """Categories of the format rules that a raw reference breaks, in the order of the rules.

    `authors` are the parsed ones: the first holds a line's whole list.
    """
    t = F.coalesce(raw, F.lit(""))
    upper, first = F.upper(t), F.get(authors, 0)
    names = F.filter(F.transform(F.split(first, "[,，]"), lambda x: F.trim(x)), lambda n: n != "")
    rules = {
        "type_tag": ~t.rlike(_TAG),
        "punctuation": t.rlike(f"[{FULL_WIDTH}]"),
        "eb_ol": (F.contains(upper, F.lit("[EB/OL]")) | F.contains(upper, F.lit("[J/OL]"))) & ~t.rlike(r"\[[0-9]{4}-[0-9]{2}-[0-9]{2}\]"),
        "authors": (F.size(names) >= 4) & ~F.contains(first, F.lit("等")) & ~F.contains(F.lower(first), F.lit("et al")),
        "pages": F.contains(upper, F.lit("[J]")) & t.rlike("(?:19|20)[0-9]{2}") & ~t.rlike(r"[0-9]+\s*[-–—]\s*[0-9]+"),
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in rules.items()]))


def full_width_found(raw: Column) -> Column:
    """The full-width marks of a reference, each once, in the order of FULL_WIDTH."""
    return F.concat(*[F.when(F.contains(raw, F.lit(s)), s).otherwise("") for s in FULL_WIDTH])
