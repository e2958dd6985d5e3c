"""Live answers: requests in, answers out, one task a source.

A source is asked by one task at a time, which waits between its requests; failures are
tried again with growing random pauses. An answer of "not found" is a miss and no failure.
What comes back has the shape of the cache (`operators.screening`), so it can be appended
to it, and a request that the cache can answer is never sent.
"""

from __future__ import annotations

import os
import random
import socket
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Mapping
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.model import dims

ANSWER = "source STRING, key STRING, payload STRING, error STRING, fetched_at TIMESTAMP"
#: Seconds between requests of a source, without and with a credential; others wait OTHER.
PAUSE = {"crossref": (1.0, 0.5), "openalex": (1.0, 0.5), "semantic_scholar": (1.0, 0.1), "arxiv": (3.0, 3.0), "pubmed": (0.34, 0.1)}
OTHER = 1.0
ATTEMPTS, FIRST, FACTOR, LONGEST, TIMEOUT = 5, 1.0, 2.0, 60.0, 30.0


class Failed(Exception):
    """A call that failed, with its code and the pause that the source asks for."""

    def __init__(self, code: str, after: float | None = None) -> None:
        super().__init__(code)
        self.code, self.after = code, after


#: Environment variables that hold a source's key, and the one with an address to be told.
KEYS = {"semantic_scholar": "SEMANTIC_SCHOLAR_API_KEY", "pubmed": "NCBI_API_KEY"}
MAILTO = "CITELOOM_MAILTO"


def credentials(environ: Mapping[str, str] = os.environ) -> dict[str, str]:
    """Keys of the sources that have one in the environment; read on the driver, blank is none."""
    return {s: environ[name].strip() for s, name in KEYS.items() if environ.get(name, "").strip()}


def agent_name(name: str = "citeloom/1", environ: Mapping[str, str] = os.environ) -> str:
    """How requests name themselves, with an address where the environment has one."""
    mail = environ.get(MAILTO, "").strip()
    return f"{name} (mailto:{mail})" if mail else name


def signed(source: str, url: str, key: str | None) -> tuple[str, dict[str, str]]:
    """A request's URL and headers with the source's key in the place where it is read."""
    if key and source == "pubmed":
        return f"{url}{'&' if '?' in url else '?'}api_key={quote(key)}", {}
    return url, {"x-api-key": key} if key and source == "semantic_scholar" else {}


def open_url(url: str, agent: str, accept: str, headers: dict[str, str] | None = None) -> str | None:
    """The text at a URL, or None where there is nothing."""
    request = urllib.request.Request(url, headers={"User-Agent": agent, "Accept": accept, **(headers or {})})
    try:
        with urllib.request.urlopen(request, timeout=TIMEOUT) as answer:
            return answer.read().decode("utf-8")
    except urllib.error.HTTPError as e:
        if e.code == 404:
            return None
        if e.code == 429:
            told = (e.headers or {}).get("Retry-After", "")
            raise Failed("RATE_LIMITED", float(told) if told.replace(".", "", 1).isdigit() else None) from e
        raise Failed("SERVER_ERROR") from e
    except TimeoutError as e:
        raise Failed("TIMEOUT") from e
    except urllib.error.URLError as e:
        kinds = ((TimeoutError, "TIMEOUT"), (socket.gaierror, "DNS_FAIL"))
        raise Failed(next((code for kind, code in kinds if isinstance(e.reason, kind)), "CONN_FAILED")) from e
    except OSError as e:
        raise Failed("CONN_FAILED") from e


def tried(call: Callable[[], str | None], sleep: Callable[[float], None], chance: Callable[[], float]) -> tuple[str | None, str | None]:
    """(text, error) of a call, made again while it fails and attempts are left."""
    for attempt in range(ATTEMPTS):
        try:
            return call(), None
        except Failed as e:
            failed = e
        if attempt < ATTEMPTS - 1:
            sleep(failed.after if failed.after is not None else min(LONGEST, FIRST * FACTOR**attempt) * chance())
    return None, failed.code


def missing(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests (source, key, url) that no answer of the cache serves, each once."""
    return requests.dropDuplicates(["source", "key"]).join(cache.select("source", "key"), ["source", "key"], "left_anti")


#: Tasks for sources that the engine does not know.
OTHERS = 8


def task_of(source: Column) -> Column:
    """A task for each known source, so that one that waits keeps no other waiting; `OTHERS` for the rest."""
    known = F.create_map(*[F.lit(x) for k, s in enumerate(s for s, *_ in dims.SOURCES) for x in (s, k)])
    return F.coalesce(F.try_element_at(known, source), F.pmod(F.xxhash64(source), F.lit(OTHERS)).cast("int") + len(dims.SOURCES))


def fetch(requests: DataFrame, agent: str = "citeloom/1", credentials: dict[str, str] | None = None, opener: Callable | None = None, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Answers to requests (source, key, url, and accept where it matters); a miss has neither
    payload nor error. A key goes into the request itself, never into what is kept of it."""
    held = dict(credentials or {})
    asked = requests if "accept" in requests.columns else requests.withColumn("accept", F.lit("application/json, application/atom+xml;q=0.9, */*;q=0.8"))
    call = opener or open_url

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict[str, float] = {}
        for b in batches:
            rows = []
            for source, key, url, accept in zip(b["source"], b["key"], b["url"], b["accept"]):
                pause = PAUSE.get(source, (OTHER, OTHER))[source in held]

                url, headers = signed(source, url, held.get(source))

                def once(source=source, url=url, accept=accept, pause=pause, headers=headers) -> str | None:
                    wait = last.get(source, float("-inf")) + pause - time.monotonic()
                    if wait > 0:
                        sleep(wait)
                    last[source] = time.monotonic()
                    return call(url, agent, accept, headers) if headers else call(url, agent, accept)

                payload, error = tried(once, sleep, random.random)
                rows.append((source, key, payload, error, pd.Timestamp.now(tz="UTC").tz_localize(None)))
            yield pd.DataFrame(rows, columns=["source", "key", "payload", "error", "fetched_at"])

    dealt = asked.select("source", "key", "url", "accept").repartitionById(len(dims.SOURCES) + OTHERS, task_of(F.col("source")))
    return dealt.mapInPandas(run, ANSWER)
