"""The manuscript rules as SQL over lines and windows, independent of the column expressions."""

from __future__ import annotations

from citeloom.model import dims

_W = r"[ \t\p{Z}]"
_MARKS = "".join(sorted(set(dims.LAYER_MARKS) | {"\ufe0f"}))
_INNER = "[^()（）]"
BY_YEAR = rf"[(（]{_INNER}{{0,60}}?(?:19|20)[0-9]{{2}}{_INNER}{{0,20}}[)）]"
BY_NUMBER = r"\[[0-9]+(?:[ \t]*[-,–，][ \t]*[0-9]+)*\]"
CHARS = r"length(regexp_replace({}, '[\p{{P}}\p{{Z}}\p{{C}}]', '', 'g'))"


def count(c: str, pattern: str) -> str:
    return f"len(regexp_extract_all({c}, '{pattern}'))"


def lines(name: str, source: str, keys: str, text: str = "text") -> str:
    """Lines i (raw, s) of each text, with what encloses them: front matter, comment, fence."""
    return f"""
        {name}0 AS (SELECT {keys}, unnest(string_split({text}, chr(10))) AS raw, unnest(range(len(string_split({text}, chr(10))))) AS i FROM {source}),
        {name}1 AS (SELECT *, regexp_replace(raw, '^{_W}+|{_W}+$', '', 'g') AS s FROM {name}0),
        {name}2 AS (SELECT *, first_value(s) OVER (PARTITION BY {keys} ORDER BY i) = '---' AND i <= coalesce(min(i) FILTER (s = '---' AND i > 0) OVER (PARTITION BY {keys}), 1000000000) AS front FROM {name}1),
        {name}3 AS (SELECT *, CASE WHEN starts_with(s, '<!--') AND NOT contains(s, '-->') THEN 1 WHEN contains(s, '-->') THEN 0 END AS event FROM {name}2 WHERE NOT front),
        {name}4 AS (SELECT *, coalesce(last_value(event IGNORE NULLS) OVER (PARTITION BY {keys} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 OR starts_with(s, '<!--') AS hidden,
                          starts_with(s, '```') OR starts_with(s, '~~~') AS fence FROM {name}3),
        {name} AS MATERIALIZED (SELECT *, sum(fence::INT) OVER w % 2 = 1 OR fence AS fenced, sum((fence AND NOT hidden)::INT) OVER w % 2 = 1 OR fence AS prose_fenced FROM {name}4
                          WINDOW w AS (PARTITION BY {keys} ORDER BY i))"""


def _inline(c: str) -> str:
    for pattern, to in ((r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]*)\]\([^)]*\)", r"\1"), (r"\[\^[^\]]*\]", ""), ("`[^`]*`", ""), ("<[^>]+>", ""), (r"\*\*|__|~~|\*|_", ""), (f"[{_MARKS}]", ""), (r"[ \t]{2,}", " ")):
        c = f"regexp_replace({c}, '{pattern}', '{to}', 'g')"
    return f"trim({c})"


def stripped(name: str, lined: str, keys: str, keep_quotes: bool = False) -> str:
    """({keys}, plain): the prose of lined texts; texts without any are left out."""
    unquoted = f"CASE WHEN starts_with(s, '>') THEN regexp_replace(s, '^>+{_W}*', '') ELSE s END" if keep_quotes else "s"
    quotes = "" if keep_quotes else "AND NOT starts_with(s, '>')"
    rule = "(?:-{3,}|\\*{3,}|_{3,}|={3,})"
    bare = _inline(f"regexp_replace(u, '^(?:[-*+]|[0-9]+[.)]){_W}+', '')")
    return f"""
        {name}0 AS (SELECT *, {unquoted} AS u FROM {lined} WHERE NOT hidden AND NOT prose_fenced AND s <> '' AND NOT starts_with(s, '|') AND NOT starts_with(s, '#') AND NOT regexp_matches(s, '^\\[\\^[^\\]]*\\]:') {quotes}),
        {name}1 AS (SELECT {keys}, i, {bare} AS b FROM {name}0 WHERE u <> '' AND NOT regexp_full_match(u, '{rule}')),
        {name} AS MATERIALIZED (SELECT {keys}, string_agg(b, chr(10) ORDER BY i) AS plain FROM {name}1 WHERE b <> '' GROUP BY {keys})"""


def paragraphs(name: str, lined: str) -> str:
    """(doc_id, position, paragraph): runs of lines without a blank one outside fences."""
    return f"""
        {name}0 AS (SELECT *, s = '' AND NOT fenced AS blank FROM {lined}),
        {name}1 AS (SELECT *, sum(blank::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM {name}0),
        {name}2 AS (SELECT doc_id, run, string_agg(raw, chr(10) ORDER BY i) AS paragraph FROM {name}1 WHERE NOT blank GROUP BY ALL),
        {name} AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY run) - 1 AS position, paragraph FROM {name}2 WHERE regexp_matches(paragraph, '[^ \\n\\t\\p{{Z}}]'))"""


def sections(name: str, lined: str, prose: str) -> str:
    """(doc_id, position, section, body); `prose` has the prose of a text, for the lead."""
    return f"""
        {name}0 AS (SELECT *, CASE WHEN NOT fenced THEN length(nullif(regexp_extract(s, '^(#{{1,6}})[ \t]+.+$', 1), '')) END AS depth FROM {lined}),
        {name}1 AS (SELECT doc_id, depth, count(*) AS k FROM {name}0 WHERE depth IS NOT NULL GROUP BY ALL),
        {name}2 AS (SELECT doc_id, coalesce(min(depth) FILTER (k >= 2), min(depth)) AS cut FROM {name}1 GROUP BY doc_id),
        {name}3 AS (SELECT l.*, cut, sum((depth IS NOT DISTINCT FROM cut AND cut IS NOT NULL)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM {name}0 l LEFT JOIN {name}2 USING (doc_id)),
        {name}4 AS (SELECT doc_id, part, any_value(cut) AS cut, arg_min(s, i) AS head, string_agg(raw, chr(10) ORDER BY i) AS body,
                    count(*) FILTER (s <> '' AND NOT hidden AND NOT prose_fenced AND NOT starts_with(s, '|') AND NOT starts_with(s, '#') AND NOT starts_with(s, '>')) AS prose FROM {name}3 GROUP BY doc_id, part),
        {name}5 AS (SELECT doc_id, part, CASE WHEN cut IS NULL THEN '全文' WHEN part = 0 THEN '（篇首）' ELSE trim(regexp_replace(head, '^#+', '')) END AS section, body FROM {name}4 WHERE part > 0 OR cut IS NULL OR prose > 0),
        {name} AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1 AS position, section, body FROM {name}5)"""


def words(source: str, keys: str, text: str, out: str, listed: tuple[str, ...], mask: tuple[str, ...] = ()) -> str:
    """A query of how often listed words stand in texts, the longest first, each sign used once."""
    sql = f"SELECT {keys}, {text} AS t, 0 AS n FROM {source}"
    for w in sorted(mask, key=len, reverse=True):
        sql = f"SELECT {keys}, replace(t, '{w}', repeat(chr(1), {len(w)})) AS t, n FROM ({sql})"
    for w in sorted(listed, key=len, reverse=True):
        sql = f"SELECT {keys}, replace(t, '{w}', repeat(chr(1), {len(w)})) AS t, n + (length(t) - length(replace(t, '{w}', ''))) // {len(w)} AS n FROM ({sql})"
    return f"SELECT {keys}, n AS {out} FROM ({sql})"
