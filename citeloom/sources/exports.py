"""Citation exports (BibTeX, RIS) and screening ledgers as tables.

Files are read whole by Spark's reader, one row a file, so any store that Spark reads
will do. Braces nest, which no regular expression can follow: the BibTeX reader is a
generator over Arrow batches; the others are built-in columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.functions import identifiers as I
from citeloom.functions import text as X
from citeloom.model import dims

ENTRY = "file STRING, seq INT, kind STRING, fields MAP<STRING,STRING>, problem STRING"
#: The same for Arrow, and how many entries are sent back at once.
_ENTRY = pa.schema([("file", pa.string()), ("seq", pa.int32()), ("kind", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("problem", pa.string())])
ENTRIES = 1000
_CJK_SIGN = "[一-鿿㐀-䶿　-〿]"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of whole files: UTF-8, else GBK; a byte-order mark goes. A file that is
    neither has a null text and is not lost."""
    rows = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    plain = F.col("content").cast("string")
    utf8 = F.when(F.is_valid_utf8(plain), plain)
    text = F.coalesce(utf8, _gbk("content"))
    return rows.select("file", F.regexp_replace(text, "^﻿", "").alias("text"))


@F.pandas_udf(T.StringType())
def _gbk(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Bytes as GBK, which Spark's own decoder does not take."""

    def read(raw: bytes | None) -> str | None:
        try:
            return raw.decode("gbk") if raw is not None else None
        except UnicodeDecodeError:
            return None

    for s in parts:
        yield s.map(read).astype(object)


def manuscripts(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, text) of the markdown files of a folder; the name is the id."""
    return read_files(spark, f"{folder}/*.md").withColumnRenamed("file", "doc_id")


def detect_format(c: Column) -> Column:
    """`ris` or `bibtex` by what a text holds; null, and no guess, where it is neither."""
    return F.when(c.rlike(r"(?m)^\s*TY\s\s?-\s"), "ris").when(c.rlike(r"@\w+\s*\{"), "bibtex")


def bibtex_entries(text: str) -> Iterator[tuple[str, dict[str, str], str | None]]:
    """(kind, fields, problem) of each entry; values keep what their braces hold, and of
    fields that repeat the last counts."""
    for head in re.finditer(r"@(\w+)\s*\{", text):
        kind = head[1].lower()
        end = _closing(text, head.end())
        if end < 0:
            yield kind, {}, "unclosed"
            continue
        fields, problem = _fields(text[head.end() : end])
        yield kind, fields, problem if fields else problem or "no fields"


def _fields(body: str) -> tuple[dict[str, str], str | None]:
    found: dict[str, str] = {}
    name = re.compile(r"(\w+)\s*=\s*")
    at = 0
    while m := name.search(body, at):
        start = m.end()
        opened = body[start : start + 1]
        if opened == "{":
            stop = _closing(body, start + 1)
            stop = len(body) if stop < 0 else stop
            start += 1
        elif opened == '"':
            start += 1
            stop = body.find('"', start)
            if stop < 0:
                return found, "unclosed quote"
        else:
            stop = re.compile(r"[^,\n]*").match(body, start).end()
        found[m[1].lower()] = body[start:stop]
        comma = body.find(",", stop)
        at = comma + 1 if comma >= 0 else len(body)
    return found, None


def _closing(text: str, at: int) -> int:
    """Where the brace that is open at `at` closes, or -1; looks at braces only."""
    depth = 1
    for m in re.compile(r"[{}]").finditer(text, at):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.start()
    return -1


def entry_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, text) as entries, `ENTRIES` at once, of many small files or of one large one."""
    found: list[dict] = []
    for b in batches:
        for file, text in zip(*(c.to_pylist() for c in b.columns)):
            for seq, (kind, fields, problem) in enumerate(bibtex_entries(text or "")):
                found.append({"file": file, "seq": seq, "kind": kind, "fields": list(fields.items()), "problem": problem})
                if len(found) == ENTRIES:
                    yield pa.RecordBatch.from_pylist(found, _ENTRY)
                    found = []
    if found:
        yield pa.RecordBatch.from_pylist(found, _ENTRY)


def parse_bibtex(files: DataFrame) -> DataFrame:
    """Entries of (file, text) rows, with those that cannot be used and why."""
    return files.select("file", "text").mapInArrow(entry_batches, ENTRY)


def _ris_text(c: Column) -> Column:
    """One line a field: lines without a tag are joined to the one before, with a blank
    unless both sides are CJK."""
    tagged = r"[A-Z][A-Z0-9]  ?-"
    lines = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n?", "\n"), r"\n[ \t]*(?=\n|\z)", "")
    tight = F.regexp_replace(lines, rf"(?<={_CJK_SIGN})[ \t]*\n[ \t]*(?!{tagged})(?={_CJK_SIGN})", "")
    return F.regexp_replace(tight, rf"[ \t]*\n[ \t]*(?!{tagged})(?=\S)", " ")


def parse_ris(files: DataFrame) -> DataFrame:
    """Entries of RIS text: a record ends at ER, at the next TY or with the file; authors and
    keywords repeat, of other fields the last counts. Records without a title are told."""
    field = r"(?m)^([A-Z][A-Z0-9])  ?-[ \t]?(.*)$"
    records = F.split(_ris_text(F.col("text")), r"(?m)^(?=TY  ?-)|^ER  ?-.*$")
    rec = files.select("file", F.posexplode(F.filter(records, lambda r: r.rlike(field))).alias("seq", "rec"))
    pair = lambda g: F.regexp_extract_all("rec", F.lit(field), g)
    named = F.zip_with(pair(1), pair(2), lambda t, v: F.struct(I.lookup(t, dims.RIS_FIELD, "").alias("k"), F.trim(v).alias("v"), t.alias("t")))
    out = rec.withColumn("_p", named)
    names = F.filter(F.array_distinct(F.transform("_p", lambda p: p["k"])), lambda k: k != "")
    of = lambda k: F.transform(F.filter("_p", lambda p: p["k"] == k), lambda p: p["v"])
    joined = F.transform(names, lambda k: F.struct(k.alias("key"), F.when(k.isin("author", "keyword"), F.array_join(of(k), " and ")).otherwise(F.element_at(of(k), -1)).alias("value")))
    kind = F.coalesce(F.upper(F.get(F.filter("_p", lambda p: p["t"] == "TY"), 0)["v"]), F.lit(""))
    out = out.select("file", "seq", kind.alias("kind"), F.map_from_entries(joined).alias("fields")).filter(F.size("fields") > 0)
    return out.withColumn("problem", F.when(F.coalesce(F.try_element_at("fields", F.lit("title")), F.lit("")) == "", "no title"))


def to_export(entries: DataFrame) -> DataFrame:
    """Usable entries in the shape of an export row; names keep their order."""
    get = lambda k: I.blank_to_null(F.try_element_at("fields", F.lit(k)))
    plain = lambda c: I.blank_to_null(X.strip_invisible(F.translate(F.regexp_replace(F.trim(c), r"\\([&_%$#])", "$1"), "{}", "")))
    bib = I.lookup(F.lower("kind"), dims.BIBTEX_TYPE)
    kind = F.coalesce(bib, I.lookup(F.upper("kind"), dims.RIS_TYPE))
    pages = F.coalesce(plain(get("pages")), I.blank_to_null(F.concat_ws("-", get("start_page"), get("end_page"))))
    keys = [c for c in ("file", "seq") if c in entries.columns]
    return entries.filter("problem IS NULL OR problem = 'unclosed quote'").select(
        *keys, kind.alias("type"), plain(get("title")).alias("title"), F.coalesce(X.split_authors(plain(get("author"))), F.array().cast("array<string>")).alias("authors"),
        I.first_year(F.coalesce(get("year"), get("date"))).alias("year"), F.coalesce(plain(get("venue")), plain(get("journal")), plain(get("booktitle")), plain(get("publisher"))).alias("venue"),
        I.blank_to_null(I.normalize_doi(get("doi"))).alias("doi"), plain(get("url")).alias("url"), plain(get("volume")).alias("volume"), F.coalesce(plain(get("issue")), plain(get("number"))).alias("issue"), pages.alias("pages"),
    )


def to_results(exported: DataFrame, source: str) -> DataFrame:
    """Export rows in the shape of hits, so that they can be united with them and fused. An
    export tells no day, retraction or openness: these are null, which is not "none"."""
    null = F.lit(None)
    keys = [c for c in ("file", "seq") if c in exported.columns]
    return exported.select(
        *keys, "title", "authors", "year", null.cast("date").alias("date"), "venue", "doi", "type", F.coalesce("url", I.doi_url(F.col("doi"))).alias("url"), "volume", "issue", "pages",
        F.lit(source).alias("source"), F.lit(False).alias("from_cache"), null.cast("string").alias("retraction"), null.cast("string").alias("oa_status"), null.cast("string").alias("oa_url"),
        null.cast("string").alias("oa_version"), null.cast("bigint").alias("cited_by_count"), null.cast("string").alias("abstract"), F.lit("user_export").alias("coverage_mode"),
    )


def import_warnings(exported: DataFrame) -> DataFrame:
    """Titles with a sign of the site they come from (counted, and the first, not mended), and
    rows without a DOI."""
    marked = F.col("title").rlike("|".join(dims.WATERMARK_WORDS))
    first = F.min_by(F.when(marked, F.substring("title", 1, 60)), F.when(marked, F.struct("file", "seq") if "seq" in exported.columns else F.col("title")))
    return exported.agg(F.count(F.lit(1)).alias("parsed"), F.count_if(marked).alias("marked"), first.alias("first_marked"), F.count_if(F.col("doi").isNull()).alias("without_doi"))


def parse_ledger(files: DataFrame) -> DataFrame:
    """Ledger rows of markdown tables; rows that start with a number but lack cells are marked malformed."""
    line = files.select("file", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r?\n")).alias("line", "l")).filter(F.trim("l").startswith("|"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("l"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    rows = line.select("file", "line", cells.alias("c")).filter(F.get("c", F.lit(0)).rlike(r"^\d+$"))
    names = ("anchor", "source_db", "dedup", "ta_screen", "ft_screen", "exclude_code", "note")
    return rows.select("file", "line", F.get("c", F.lit(0)).cast("int").alias("seq"), *[F.get("c", F.lit(i + 1)).alias(n) for i, n in enumerate(names)], (F.size("c") < 8).alias("malformed"))
