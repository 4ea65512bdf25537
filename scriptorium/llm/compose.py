"""Canonical order and composition of marks for whole batches of code points, as Unicode's NFC defines them.

Nothing here depends on which texts share a batch: every rule looks at one cluster (a starter and
its marks) or at two neighbours inside one text, for all clusters at once.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

# The arithmetic of Hangul syllables (first code points and numbers of letters).
_L, _V, _T, _S = 0x1100, 0x1161, 0x11A7, 0xAC00
_NL, _NV, _NT = 19, 21, 28


@cache
def mark_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Combining class by code point; sorted pairs (first << 32 | second), what they compose to; seconds of class 0."""
    classes = np.zeros(0x110000, np.uint8)
    pairs: dict[int, int] = {}
    starters = np.zeros(0x110000, bool)
    for cp in range(0x20000):
        c = chr(cp)
        classes[cp] = unicodedata.combining(c)
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and parts[0][0] != "<" and unicodedata.normalize("NFC", c) == c:
            first, second = (int(x, 16) for x in parts)
            pairs[first << 32 | second] = cp
            starters[second] = unicodedata.combining(chr(second)) == 0
    starters[_V : _V + _NV] = True
    starters[_T + 1 : _T + _NT] = True
    left = np.array(sorted(pairs), np.uint64)
    return classes, left, np.array([pairs[int(x)] for x in left], np.uint32), starters


def _joined(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """What pairs of code points compose to, 0 where they don't."""
    _, left, composed, _ = mark_tables()
    key = first.astype(np.uint64) << np.uint64(32) | second.astype(np.uint64)
    at = np.minimum(np.searchsorted(left, key), len(left) - 1)
    out = np.where(left[at] == key, composed[at], 0).astype(np.uint32)
    a, b = first.astype(np.int64), second.astype(np.int64)
    lv = (a >= _L) & (a < _L + _NL) & (b >= _V) & (b < _V + _NV)
    out[lv] = _S + ((a[lv] - _L) * _NV + b[lv] - _V) * _NT
    lvt = (a >= _S) & (a < _S + _NL * _NV * _NT) & ((a - _S) % _NT == 0) & (b > _T) & (b < _T + _NT)
    out[lvt] = a[lvt] + b[lvt] - _T
    return out


def _drop(points: np.ndarray, bounds: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return points[alive], np.concatenate([np.zeros(1, np.int64), np.cumsum(alive)])[bounds]


def _compose_starters(out: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbouring starters joined (letters of Hangul and a few others), from left to right."""
    starters = mark_tables()[3]
    while len(out):
        second = starters[out]
        second[bounds[:-1][bounds[:-1] < len(out)]] = False
        at = np.flatnonzero(second)
        made = _joined(out[at - 1], out[at])
        at, made = at[made > 0], made[made > 0]
        if not len(at):
            break
        chained = np.zeros(len(at), bool)
        chained[1:] = at[1:] - 1 == at[:-1]  # its first half is a second half itself: next round
        at, made = at[~chained], made[~chained]
        out = out.copy()
        out[at - 1] = made
        alive = np.ones(len(out), bool)
        alive[at] = False
        out, bounds = _drop(out, bounds, alive)
    return out, bounds


def compose(out: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Canonically ordered and composed code points of texts that lie one after another, with their offsets.

    The input is decomposed, or composed already where a composition can't change (a syllable). A
    mark joins its letter only if no mark of its class or a higher one stands between them.
    """
    classes, _, _, starters = mark_tables()
    if starters[out].any():
        out, bounds = _compose_starters(out, bounds)
    marks = classes[out]
    if not marks.any():
        return out, bounds
    total = len(out)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    start = (marks == 0) | np.diff(row, prepend=-1).astype(bool)
    cluster = np.cumsum(start)
    order = np.lexsort((np.arange(total), marks, cluster))
    out, marks = out[order], marks[order]
    base = np.flatnonzero(start)
    base = base[marks[base] == 0]  # a text may begin with a mark, which joins nothing
    last = np.zeros(len(base), np.uint8)
    alive = np.ones(total, bool)
    step = 1
    while len(base):  # the step-th mark of every cluster, all clusters at once
        at = base + step
        ok = at < total
        ok[ok] = ~start[at[ok]]
        base, at, last = base[ok], at[ok], last[ok]
        made = _joined(out[base], out[at])
        joins = (made > 0) & ((last == 0) | (last < marks[at]))
        out[base[joins]] = made[joins]
        alive[at[joins]] = False
        last = np.where(joins, last, marks[at])
        step += 1
    return _drop(out, bounds, alive)


def expand(points: np.ndarray, offsets: np.ndarray, edges: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each code point replaced by its expansion flat[edges[cp]:edges[cp + 1]], and the new offsets of the texts."""
    width = edges[points.astype(np.int64) + 1] - edges[points]
    ends = np.cumsum(width)
    total = int(ends[-1]) if len(ends) else 0
    source = np.repeat(np.arange(len(points)), width)
    out = flat[np.arange(total) - (ends - width)[source] + edges[points[source]]]
    return out, np.concatenate([np.zeros(1, np.int64), ends])[offsets]


def table_of(special: dict[int, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Expansions of all code points as offsets and flat values, from those that do not stand for themselves."""
    width = np.ones(0x110000, np.int64)
    keys = np.array(sorted(special), np.int64)
    width[keys] = [len(special[k]) for k in keys]
    edges = np.concatenate([np.zeros(1, np.int64), np.cumsum(width)])
    flat = np.repeat(np.arange(0x110000, dtype=np.uint32), width)
    for k in keys:
        flat[edges[k] : edges[k + 1]] = special[k]
    return edges, flat
