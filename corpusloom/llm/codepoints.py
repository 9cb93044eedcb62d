"""Arrow strings as numpy code-point arrays, with table lookups in place of per-row string calls."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Code points from here on are kept as they are by every table below (private use and tags aside, none is a letter).
TOP = 0x30000


def decode(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all rows, and the offset of each row; nulls count as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if data is None or not len(column):
        return np.zeros(0, np.int32), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    b = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    first = (b & 0xC0) != 0x80
    at = np.flatnonzero(first)
    lead = b[at].astype(np.int32)
    cps = lead.copy()
    padded = np.concatenate([b, np.zeros(4, np.uint8)]).astype(np.int32)
    for low, high, mask, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0x100, 0x07, 3)):
        k = np.flatnonzero((lead >= low) & (lead < high))
        value = lead[k] & mask
        for j in range(1, more + 1):
            value = value << 6 | padded[at[k] + j] & 0x3F
        cps[k] = value
    count = np.concatenate([[0], np.cumsum(first)])
    return cps, count[offsets - offsets[0]].astype(np.int64)


def encode(cps: np.ndarray, offsets: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """An Arrow string array of the rows; null marks rows without a value."""
    size = 1 + (cps > 0x7F) + (cps > 0x7FF) + (cps > 0xFFFF)
    ends = np.concatenate([[0], np.cumsum(size)])
    at, out = ends[:-1], np.zeros(ends[-1], np.uint8)
    for n, lead in ((1, 0), (2, 0xC0), (3, 0xE0), (4, 0xF0)):
        k = np.flatnonzero(size == n)
        for j in range(n):
            part = cps[k] >> 6 * (n - 1 - j)
            out[at[k] + j] = part | lead if j == 0 else part & 0x3F | 0x80
    places = ends[offsets].astype(np.int64)
    valid = None
    if null is not None and null.any():
        valid = pa.py_buffer(np.packbits(~null, bitorder="little").tobytes())
    made = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [valid, pa.py_buffer(places), pa.py_buffer(out)])
    return made.cast(pa.string())


def rows_of(offsets: np.ndarray) -> np.ndarray:
    """The row of each code point."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums by row; unsigned sums wrap around."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)])
    return total[offsets[1:]] - total[offsets[:-1]]


def keep(cps: np.ndarray, offsets: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    count = np.concatenate([[0], np.cumsum(mask)])
    return cps[mask], count[offsets]


def clip(cps: np.ndarray) -> np.ndarray:
    return np.minimum(cps, TOP - 1)


@lru_cache
def categories() -> np.ndarray:
    """First letter of the general category of each code point, as a byte; digits (Nd) as D."""
    names = (unicodedata.category(chr(c)) for c in range(TOP))
    return np.frombuffer("".join("D" if x == "Nd" else x[0] for x in names).encode(), np.uint8)


@lru_cache
def classes() -> np.ndarray:
    """Canonical combining classes."""
    return np.fromiter((unicodedata.combining(chr(c)) for c in range(TOP)), np.uint8, TOP)


@lru_cache
def invisible() -> np.ndarray:
    """Format characters without a look of their own, and marks and fillers that show nothing."""
    # fixed values: format characters that do show (signs for numbers and verses)
    shown = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
    # fixed values: grapheme joiner, fillers, vowels without a look, variation selectors
    extra = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10)}
    out = np.fromiter((unicodedata.category(chr(c)) == "Cf" for c in range(TOP)), bool, TOP)
    out[list(shown)] = False
    out[list(extra)] = True
    return out


def expansion(rule) -> tuple[np.ndarray, np.ndarray]:
    """Starts and flat values of the table in which row c holds rule(c), a string; rule gives None for c itself."""
    size, flat = np.ones(TOP, np.int64), []
    changed = []
    for c in range(TOP):
        if 0xD800 <= c < 0xE000:
            continue
        made = rule(c)
        if made is not None:
            size[c] = len(made)
            changed.append((c, made))
    starts = np.concatenate([[0], np.cumsum(size)])
    flat = np.zeros(starts[-1], np.int32)
    flat[starts[:-1][size == 1]] = np.flatnonzero(size == 1)
    for c, made in changed:
        flat[starts[c] : starts[c + 1]] = [ord(x) for x in made]
    return starts, flat


def expand(cps: np.ndarray, offsets: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Replace each code point by its row of the table: a gather with expansion offsets."""
    starts, flat = table
    c = clip(cps)
    low = starts[c]
    size = starts[c + 1] - low
    ends = np.concatenate([[0], np.cumsum(size)])
    inside = np.arange(ends[-1]) - np.repeat(ends[:-1], size)
    out = flat[np.repeat(low, size) + inside]
    high = np.repeat(cps, size)
    return np.where(high >= TOP, high, out).astype(np.int32), ends[offsets]


def reorder(cps: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Canonical order of marks: a stable sort by class inside each run after a starter; rows never mix."""
    ccc = classes()[clip(cps)]
    if not ((ccc[1:] < ccc[:-1]) & (ccc[1:] > 0)).any():
        return cps
    start = ccc == 0
    start[offsets[:-1][offsets[:-1] < len(cps)]] = True
    return cps[np.argsort(np.cumsum(start) * 256 + ccc, kind="stable")]


@lru_cache
def compositions() -> tuple[np.ndarray, np.ndarray]:
    """Sorted pair keys and the composed code point of each, without the excluded ones; Hangul is done by arithmetic."""
    pairs = {}
    for c in range(TOP):
        parts = unicodedata.decomposition(chr(c))
        if parts and "<" not in parts and " " in parts and unicodedata.normalize("NFC", chr(c)) == chr(c):
            a, b = (int(x, 16) for x in parts.split())
            pairs[a << 21 | b] = c
    keys = np.array(sorted(pairs), np.int64)
    return keys, np.array([pairs[k] for k in keys.tolist()], np.int32)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Composed code points of the pairs, 0 where there is none."""
    keys, values = compositions()
    k = a.astype(np.int64) << 21 | b
    at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
    out = np.where(keys[at] == k, values[at], 0)
    lv = (a >= 0x1100) & (a < 0x1113) & (b >= 0x1161) & (b < 0x1176)
    lvt = (a >= 0xAC00) & (a < 0xD7A4) & ((a - 0xAC00) % 28 == 0) & (b > 0x11A7) & (b < 0x11C3)
    out = np.where(lv, 0xAC00 + ((a - 0x1100) * 21 + b - 0x1161) * 28, out)
    return np.where(lvt, a + b - 0x11A7, out)


def compose(cps: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Canonical composition of ordered text: in each round every starter takes in its next free mark."""
    while len(cps):
        ccc = classes()[clip(cps)]
        begin = np.zeros(len(cps), bool)
        begin[offsets[:-1][offsets[:-1] < len(cps)]] = True
        starter = (ccc == 0) | begin
        base = np.maximum.accumulate(np.where(starter, np.arange(len(cps)), 0))
        i = np.arange(len(cps))
        # the starter that a starter of its own may join is the one just before it
        before = np.where(starter, i - 1, base)
        previous = np.concatenate([[0], ccc[:-1]])
        free = ~begin & np.where(starter, previous == 0, (previous < ccc) | (i - 1 == base))
        made = np.zeros(len(cps), np.int64)
        k = np.flatnonzero(free & ((ccc > 0) | starter))
        made[k] = _pair(cps[before[k]], cps[k])
        k = np.flatnonzero(made)
        if not len(k):
            break
        # one mark for each starter, the first; no starter that is itself taken in
        _, one = np.unique(before[k], return_index=True)
        k = k[one]
        taken = np.zeros(len(cps), bool)
        taken[k] = True
        chained = taken[before[k]]
        k = k[~chained] if (~chained).any() else k[:1]
        cps = cps.copy()
        cps[before[k]] = made[k]
        mask = np.ones(len(cps), bool)
        mask[k] = False
        cps, offsets = keep(cps, offsets, mask)
    return cps, offsets


@lru_cache
def decomposed() -> tuple[np.ndarray, np.ndarray]:
    """Full canonical decomposition."""

    def rule(c: int) -> str | None:
        x = chr(c)
        made = unicodedata.normalize("NFD", x)
        return made if made != x else None

    return expansion(rule)


def fold(c: str) -> str:
    """Lower case of one character by itself, with the case pairs that lower() leaves apart brought together."""
    up = c.upper()
    low = up.lower() if len(up) == 1 else c.lower()
    return low if len(low) == 1 else c.lower()


sys.setswitchinterval(0.05)
