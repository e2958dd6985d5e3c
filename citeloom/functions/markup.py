"""Markdown as HTML: a fold over lines that keeps the blocks that are open.

Lists may hold lists, and what closes a block is the next line that is none of it; so
a line alone does not say its tags, and this is Python on Arrow batches: one pass, and what
is held is the stack of open blocks.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Schemes that a link may have; others give their text only.
SAFE_SCHEMES = ("https", "http", "mailto")
_CODE, _BOLD = re.compile(r"`([^`]+)`"), re.compile(r"\*\*([^*]+)\*\*")
_LINK = re.compile(r"\[([^\]]*)\]\(([^)]*)\)")
_SAFE = re.compile(rf"(?:(?i:{'|'.join(SAFE_SCHEMES)}):|[#./])\S*\Z")
_ITEM = re.compile(r"(?:([-*+])|[0-9]{1,9}[.)])\s+(.*)\Z")
_HEAD = re.compile(r"(#{1,6})\s+(.*)\Z")
#: A line that says what coverage does not mean is shown apart.
NOTICE = "不等于"


def inline(text: str) -> str:
    """A line's signs as HTML: escaped first, then code, bold, and links whose address is safe."""
    t = html.escape(text).replace("&#x27;", "'")
    t = _BOLD.sub(r"<strong>\1</strong>", _CODE.sub(r"<code>\1</code>", t))
    return _LINK.sub(lambda m: f'<a href="{m[2]}">{m[1]}</a>' if _SAFE.match(m[2]) else m[1], t)


def _cells(row: str, tag: str) -> str:
    return "".join(f"<{tag}>{inline(c.strip())}</{tag}>" for c in row.strip("|").split("|"))


class Fold:
    """The HTML so far, and what is open: a fence, a table, a quote's lines, lists by their indent."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.fence: str | None = None
        self.table = False
        self.quote: list[str] | None = None
        self.lists: list[tuple[int, str]] = []

    def line(self, raw: str) -> None:
        s = raw.strip()
        if self.fence:
            if s.startswith(self.fence):
                self.out.append("</code></pre>")
                self.fence = None
            else:
                self.out.append(html.escape(raw) + "\n")
        elif s.startswith(("```", "~~~")):
            self.close()
            self.fence = s[:3]
            self.out.append("<pre><code>")
        elif s.startswith(">"):
            if self.quote is None:
                self.close()
                self.quote = []
            self.quote.append(s[1:].removeprefix(" "))
        elif len(s) > 1 and s[0] == s[-1] == "|":
            self._row(s)
        elif (item := _ITEM.match(s)) and not set(s) <= set("-* "):
            self._item(len(raw) - len(raw.lstrip()), "ul" if item[1] else "ol", item[2])
        else:
            self.close()
            self._alone(s)

    def _row(self, s: str) -> None:
        if self.table:
            if not set(s) <= set("|-: "):
                self.out.append(f"<tr>{_cells(s, 'td')}</tr>")
            return
        self.close()
        self.table = True
        self.out.append(f"<table><thead><tr>{_cells(s, 'th')}</tr></thead><tbody>")

    def _item(self, indent: int, tag: str, text: str) -> None:
        if self.table or self.quote is not None:
            self.close()
        while self.lists and indent < self.lists[-1][0]:
            self._leave()
        if self.lists and indent == self.lists[-1][0]:
            if self.lists[-1][1] == tag:
                self.out.append("</li>")
            else:
                self._leave()
                self._enter(indent, tag)
        else:
            self._enter(indent, tag)
        self.out.append(f"<li>{inline(text)}")

    def _enter(self, indent: int, tag: str) -> None:
        self.lists.append((indent, tag))
        self.out.append(f"<{tag}>")

    def _leave(self) -> None:
        self.out.append(f"</li></{self.lists.pop()[1]}>")

    def _alone(self, s: str) -> None:
        head = _HEAD.match(s)
        if head:
            level = len(head[1])
            self.out.append(f"<h{level}>{inline(head[2])}</h{level}>")
        elif s.startswith("⚠") or NOTICE in s:
            self.out.append(f'<div class="notice">{inline(s)}</div>')
        elif len(s) > 2 and s[0] == s[-1] == "*" and not s.startswith("**"):
            self.out.append(f"<footer>{inline(s.strip('*'))}</footer>")
        elif s and not s.startswith("---"):
            self.out.append(f"<p>{inline(s)}</p>")

    def close(self) -> None:
        """Ends every open block but a fence."""
        if self.table:
            self.out.append("</tbody></table>")
            self.table = False
        if self.quote is not None:
            inner, self.quote = self.quote, None
            self.out.append(f"<blockquote>{to_html(chr(10).join(inner))}</blockquote>")
        while self.lists:
            self._leave()


#: Quotes within quotes that are still read as such.
_DEEPEST = 50


def to_html(text: str) -> str:
    """The blocks of a markdown text as HTML; a fence that does not end runs to the end."""
    deep = re.match(rf"\s*(?:>\s*){{{_DEEPEST},}}", text)
    fold = Fold()
    for raw in re.split(r"\r\n?|\n", text[deep.end() :] if deep else text):
        fold.line(raw)
    if fold.fence:
        fold.out.append("</code></pre>")
    fold.close()
    return "".join(fold.out)


@F.pandas_udf(T.StringType())
def html_of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(lambda t: to_html(t or ""))
