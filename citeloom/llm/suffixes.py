"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

Suffixes are S (smaller than the next) or L. Leftmost S suffixes (LMS) are put
into the buckets of their first symbols; a pass over the buckets upwards induces
the order of L suffixes, one downwards that of S suffixes, and so sorts the
substrings between LMS positions. Equal substrings get equal names, the string of
names (less what names that occur once decide) is sorted in turn by the same
function, and with its order the same two passes give the array.

A bucket is handled at once, not a suffix at a time: what stands in it by then is
a slice of the array, suffixes that it induces into itself follow in waves, and
those that it induces elsewhere are put at their buckets' edges in one step. That
pays while buckets are few, so a string of many names is written with two digits
a name: twice as long, over the square root of the symbols. Its suffixes that
begin with a name stand in the order of the names' suffixes.
"""

from __future__ import annotations

import numpy as np

#: Symbols from which a string is written in digits.
BUCKETS = 512


def _s_types(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next; the last is."""
    n = len(t)
    differs = np.r_[t[1:] != t[:-1], True]
    # of a run of equal symbols the last decides
    decides = np.where(differs, np.arange(n), n)
    decides = np.minimum.accumulate(decides[::-1])[::-1]
    rises = np.r_[t[:-1] < t[1:], True]
    return rises[decides]


def _induce(t: np.ndarray, lms: np.ndarray, symbols: int) -> np.ndarray:
    """All suffixes in order, given LMS positions in an order."""
    sizes = np.bincount(t, minlength=symbols)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    used = np.flatnonzero(sizes).tolist()
    first, last = starts.tolist(), ends.tolist()
    array, ramp = np.empty(len(t), np.int64), np.arange(len(t))
    lms = lms[np.argsort(t[lms], kind="stable")]
    lms_ends = [0, *np.cumsum(np.bincount(t[lms], minlength=symbols)).tolist()]
    head = starts.copy()
    for c in used:
        a, b = first[c], int(head[c])
        now = array[a:b]
        while len(now):  # L suffixes before L suffixes of the same symbol
            now = now[now > 0] - 1
            now = now[t[now] == c]
            array[b : b + len(now)] = now
            b += len(now)
        # the last symbol, which stands for what is before the first, is not larger
        before = np.concatenate((array[a:b], lms[lms_ends[c] : lms_ends[c + 1]])) - 1
        s = t[before]
        larger = s > c
        before, s = before[larger], s[larger]
        if len(s):
            order = s.argsort(kind="stable")
            s = s[order]
            counts = np.bincount(s, minlength=symbols)
            array[(head - counts.cumsum() + counts)[s] + ramp[: len(s)]] = before[order]
            head += counts
    tail = ends - 1
    array[tail[t[-1]]] = len(t) - 1
    tail[t[-1]] -= 1
    for c in reversed(used):
        b, a = last[c], int(tail[c])
        now = array[a + 1 : b][::-1]
        while len(now):  # S suffixes before S suffixes of the same symbol
            now = now[now > 0] - 1
            now = now[t[now] == c]
            array[a + 1 - len(now) : a + 1] = now[::-1]
            a -= len(now)
        seen = array[first[c] : b][::-1]
        before = seen[seen > 0] - 1
        s = t[before]
        smaller = s < c
        before, s = before[smaller], s[smaller]
        if len(s):
            order = s.argsort(kind="stable")
            s = s[order]
            counts = np.bincount(s, minlength=symbols)
            array[(tail + counts.cumsum() - counts)[s] - ramp[: len(s)]] = before[order]
            tail -= counts
    return array


def _names(t: np.ndarray, order: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Names of LMS substrings in `order`, which is sorted: equal ones are equal."""
    a, b = order[:-1], order[1:]
    size = ends[b] - b
    same = ends[a] - a == size
    live = np.flatnonzero(same)
    k = 0
    while len(live):
        differs = t[a[live] + k] != t[b[live] + k]
        same[live[differs]] = False
        live = live[~differs]
        k += 1
        live = live[size[live] >= k]
    return np.cumsum(np.r_[False, ~same])


def _digits(t: np.ndarray, symbols: int) -> tuple[np.ndarray, int]:
    """A string in two digits a symbol, with an end below all digits; and its symbols."""
    base = int(np.ceil(np.sqrt(symbols)))
    out = np.zeros(2 * len(t) + 1, np.int16 if base < 32_000 else np.int32)
    out[:-1:2] = t // base + 1
    out[1::2] = t % base + 1
    return out, base + 1


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Order of the suffixes of `t`, whose last symbol is its least and stands there only."""
    n = len(t)
    if n < 3:
        return np.argsort(t, kind="stable")
    symbols = int(t.max()) + 1
    if symbols > BUCKETS:
        found = suffix_array(_digits(t, symbols)[0])
        return found[(found % 2 == 0) & (found < 2 * n)] // 2
    small = _s_types(t)
    is_lms = np.zeros(n, bool)
    is_lms[1:] = small[1:] & ~small[:-1]
    lms = np.flatnonzero(is_lms)
    order = _induce(t, lms, symbols)
    order = order[is_lms[order]]
    ends = np.zeros(n, np.int64)
    ends[lms] = np.r_[lms[1:], n - 1]
    name = np.zeros(n, np.int64)
    name[order] = _names(t, order, ends)
    return _induce(t, lms[_sorted_names(name[lms])], symbols)


def _sorted_names(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names.

    A name that occurs once decides every comparison that reaches it, so of names
    like it that stand together the first is enough: the others are left out of
    the string that is sorted in turn.
    """
    counts = np.bincount(names)
    out = np.empty(len(names), np.int64)
    once = counts[names] == 1
    slot = (np.cumsum(counts) - counts)[names]
    out[slot[once]] = np.flatnonzero(once)
    if once.all():
        return out
    kept = ~once
    kept[1:] |= ~once[:-1]
    kept[-1] = True  # the end, which is least
    at = np.flatnonzero(kept)
    dense = np.cumsum(np.bincount(names[at], minlength=len(counts)) > 0) - 1
    order = at[suffix_array(dense[names[at]])]
    free = np.ones(len(names), bool)
    free[slot[once]] = False
    out[free] = order[~once[order]]
    return out


def common_prefixes(t: np.ndarray, order: np.ndarray) -> np.ndarray:
    """PLCP: of each suffix, the symbols it shares with the one before it in `order`.

    Where the suffix before is that of the last position moved by one, and the
    symbol left out is shared, the value is the last one less one; only the others
    are compared.
    """
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    follows = np.r_[False, (before[1:] == before[:-1] + 1) & (before[:-1] >= 0)]
    follows[1:] &= t[:-1] == t[before[1:] - 1]
    heads = np.flatnonzero(~follows)
    value = np.zeros(n, np.int64)
    # four symbols at a time; beyond the end stand symbols that are in no text, each its own
    wide = np.zeros(n + 8, np.uint64)
    wide[:n] = t
    pack = wide[:-3] | wide[1:-2] << np.uint64(16) | wide[2:-1] << np.uint64(32) | wide[3:] << np.uint64(48)
    live = heads[before[heads] >= 0]
    while len(live):
        a, b = live + value[live], before[live] + value[live]
        inside = np.maximum(a, b) < n
        live, a, b = live[inside], a[inside], b[inside]
        other = pack[a] ^ pack[b]
        whole = other == 0
        part = other[~whole]
        got = np.where(part & np.uint64(0xFFFF), 0, np.where(part & np.uint64(0xFFFFFFFF), 1, np.where(part & np.uint64(0xFFFFFFFFFFFF), 2, 3)))
        value[live[~whole]] += got
        value[live[whole]] += 4
        live = live[whole]
    head = np.maximum.accumulate(np.where(follows, 0, np.arange(n)))
    return np.maximum(value[head] - (np.arange(n) - head), 0)
