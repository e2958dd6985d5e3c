"""Keyword searches as a data source: `spark.read.format("citeloom").option("query", …).load()`.

A row is a work that a source found. Conditions on source, year and type are pushed down:
sources that are not wanted are not asked, years and types go into the URLs of those that
can filter, and the rest is filtered where it is read, so Spark has nothing left to do for
them. Conditions on other columns stay with Spark. A partition is a source and a range of
its pages; partitions of one source wait the longer, so that its rate holds for all together.
"""

from __future__ import annotations

import json
import random
import time
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any
from urllib.parse import quote

from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual,
)

from citeloom.functions.requests import SCHOLAR_FIELDS
from citeloom.model import dims
from citeloom.sources.http import OTHER, PAUSE, Failed, open_url, signed, tried

SCHEMA = "source STRING, page INT, place INT, title STRING, doi STRING, year INT, type STRING, payload STRING"
SEARCHED = ("crossref", "openalex", "semantic_scholar", "arxiv", "pubmed", "eric")
#: Bounds that are pushed, as steps from the value to the least or most year.
_LOW, _HIGH = {GreaterThan: 1, GreaterThanOrEqual: 0, EqualTo: 0}, {LessThan: -1, LessThanOrEqual: 0, EqualTo: 0}


@dataclass(frozen=True)
class Wanted:
    """What is asked of every source."""

    query: str
    sources: tuple[str, ...]
    low: int | None = None
    high: int | None = None
    types: frozenset[str] | None = None

    def holds(self, row: tuple) -> bool:
        year, kind = row[5], row[6]
        if (self.low is not None and (year is None or year < self.low)) or (self.high is not None and (year is None or year > self.high)):
            return False
        return self.types is None or kind in self.types


def _native_types(source: str, wanted: Wanted) -> list[str]:
    """The source's own words for the types, none if one of them has none."""
    own = dims.NATIVE_TYPE.get(source, {})
    return [own[t] for t in sorted(wanted.types)] if wanted.types and all(t in own for t in wanted.types) else []


def _url(source: str, base: str, w: Wanted, start: int, rows: int) -> str:
    q, kinds = quote(w.query), _native_types(source, w)
    if source == "crossref":
        parts = [f"from-pub-date:{w.low}-01-01"] * (w.low is not None) + [f"until-pub-date:{w.high}-12-31"] * (w.high is not None) + [f"type:{k}" for k in kinds]
        return f"{base}/works?query={q}&rows={rows}&offset={start}" + (f"&filter={','.join(parts)}" if parts else "")
    if source == "openalex":
        parts = [f"from_publication_date:{w.low}-01-01"] * (w.low is not None) + [f"to_publication_date:{w.high}-12-31"] * (w.high is not None) + ([f"type:{'|'.join(kinds)}"] if kinds else [])
        return f"{base}/works?search={q}&per-page={rows}&page={start // rows + 1}" + (f"&filter={','.join(parts)}" if parts else "")
    if source == "semantic_scholar":
        years = f"&year={w.low if w.low is not None else ''}-{w.high if w.high is not None else ''}" if w.low is not None or w.high is not None else ""
        return f"{base}/graph/v1/paper/search?query={q}&offset={start}&limit={rows}&fields={SCHOLAR_FIELDS}{years}" + (f"&publicationTypes={','.join(kinds)}" if kinds else "")
    if source == "arxiv":
        return f"{base}/query?search_query=all:{q}&start={start}&max_results={rows}"
    if source == "pubmed":
        return f"{base}/esearch.fcgi?db=pubmed&term={q}&retmode=json&retstart={start}&retmax={rows}"
    return f"{base}/?search={q}&format=json&start={start}&rows={rows}"


def _at(record: Any, *path: str | int) -> Any:
    """What lies at a path of keys and places, None where it ends."""
    for step in path:
        try:
            record = record[step]
        except (KeyError, IndexError, TypeError):
            return None
    return record


#: Where each source's answer holds its works, and in a work the title, DOI, year and type.
_FIELDS = {
    "crossref": (("message", "items"), ("title", 0), ("DOI",), ("issued", "date-parts", 0, 0), ("type",)),
    "openalex": (("results",), ("display_name",), ("doi",), ("publication_year",), ("type",)),
    "semantic_scholar": (("data",), ("title",), ("externalIds", "DOI"), ("year",), ("publicationTypes", 0)),
    "eric": (("response", "docs"), ("title",), ("doi",), ("publicationdateyear",), ("publicationtype", 0)),
    "pubmed": ((), ("title",), (), ("pubdate",), ("pubtype", 0)),
}
_ATOM = "{http://www.w3.org/2005/Atom}"


def _year(value: Any) -> int | None:
    head = str(value)[:4] if value is not None else ""
    return int(head) if len(head) == 4 and head.isdigit() else None


def _canonical(kind: str | None) -> str | None:
    return dims.CANONICAL_TYPE.get(kind.lower(), kind) if kind else None


def _doi(value: str | None) -> str | None:
    return value.lower().removeprefix("https://doi.org/") if value else None


def _works(source: str, text: str) -> Iterator[tuple]:
    """(title, doi, year, type, payload) of an answer's works."""
    if source == "arxiv":
        for e in ET.fromstring(text).iter(f"{_ATOM}entry"):
            doi = e.findtext("{http://arxiv.org/schemas/atom}doi")
            yield (e.findtext(f"{_ATOM}title") or "").strip() or None, _doi(doi), _year(e.findtext(f"{_ATOM}published")), "preprint", ET.tostring(e, encoding="unicode")
        return
    listed, title, doi, year, kind = _FIELDS[source]
    answer = json.loads(text)
    works = [w for k, w in (answer.get("result") or {}).items() if k != "uids"] if source == "pubmed" else _at(answer, *listed)
    for w in works or []:
        own = next((a.get("value") for a in w.get("articleids") or [] if a.get("idtype") == "doi"), None) if source == "pubmed" else _at(w, *doi)
        yield _at(w, *title), _doi(own), _year(_at(w, *year)), _canonical(_at(w, *kind)), json.dumps(w, ensure_ascii=False)


@dataclass
class Pages(InputPartition):
    """A source's pages from `first` up to `last`; `shared` partitions ask the source at a time."""

    source: str
    first: int
    last: int
    shared: int


class SearchReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options
        if not options.get("query", "").strip():
            raise ValueError("a search needs a query")
        sources = tuple(s.strip() for s in options.get("sources", ",".join(SEARCHED[:4])).split(","))
        if strange := [s for s in sources if s not in SEARCHED]:
            raise ValueError(f"these sources cannot search: {', '.join(strange)}")
        self.wanted = Wanted(options["query"], sources)
        self.rows, self.pages, self.step = (int(options.get(k, d)) for k, d in (("rows", "20"), ("pages", "1"), ("pagespertask", "1")))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if not self._take(f):
                yield f

    def _take(self, f: Filter) -> bool:
        w, column = self.wanted, f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        if isinstance(f, IsNotNull):
            return column == "source"
        values = f.value if isinstance(f, In) else (f.value,) if isinstance(f, (EqualTo, *_LOW, *_HIGH)) else None
        if values is None:
            return False
        if column == "source" and isinstance(f, (EqualTo, In)):
            self.wanted = Wanted(w.query, tuple(s for s in w.sources if s in values), w.low, w.high, w.types)
            return True
        if column == "type" and isinstance(f, (EqualTo, In)):
            kinds = frozenset(values) if w.types is None else w.types & frozenset(values)
            self.wanted = Wanted(w.query, w.sources, w.low, w.high, kinds)
            return True
        if column == "year" and not isinstance(f, In) and type(f) in {**_LOW, **_HIGH}:
            low, high = w.low, w.high
            if type(f) in _LOW:
                low = max(x for x in (low, f.value + _LOW[type(f)]) if x is not None)
            if type(f) in _HIGH:
                high = min(x for x in (high, f.value + _HIGH[type(f)]) if x is not None)
            self.wanted = Wanted(w.query, w.sources, low, high, w.types)
            return True
        return False

    def partitions(self) -> list[Pages]:
        starts = range(0, self.pages, self.step)
        return [Pages(s, a, min(a + self.step, self.pages), len(starts)) for s in self.wanted.sources for a in starts]

    def read(self, partition: Pages) -> Iterator[tuple]:
        source, w = partition.source, self.wanted
        base = self.options.get(f"base.{source}", f"https://{source}")
        key = self.options.get(f"key.{source}")
        pause = PAUSE.get(source, (OTHER, OTHER))[key is not None] * partition.shared * float(self.options.get("patience", "1"))
        ask = _asking(source, key, pause, self.options.get("agent", "citeloom/1"))
        for page in range(partition.first, partition.last):
            text = ask(_url(source, base, w, page * self.rows, self.rows))
            if source == "pubmed" and text is not None:
                ids = _at(json.loads(text), "esearchresult", "idlist") or []
                text = ask(f"{base}/esummary.fcgi?db=pubmed&id={','.join(ids)}&retmode=json") if ids else None
            if text is None:
                return
            n = 0
            for place, work in enumerate(_works(source, text)):
                n += 1
                row = (source, page, place, *work)
                if w.holds(row):
                    yield row
            if n < self.rows:  # no further page
                return


def _asking(source: str, key: str | None, pause: float, agent: str) -> Callable[[str], str | None]:
    """A call that waits between requests and tries again; an error that stays ends the task."""
    last = float("-inf")

    def ask(url: str) -> str | None:
        url, headers = signed(source, url, key)

        def once() -> str | None:
            nonlocal last
            wait = last + pause - time.monotonic()
            if wait > 0:
                time.sleep(wait)
            last = time.monotonic()
            return open_url(url, agent, "application/json, application/atom+xml;q=0.9, */*;q=0.8", headers)

        text, error = tried(once, lambda s: time.sleep(s * min(1.0, pause)), random.random)
        if error:
            raise Failed(error)
        return text

    return ask


class SearchSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "citeloom"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> SearchReader:
        return SearchReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with its filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SearchSource)
