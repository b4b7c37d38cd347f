"""Words of texts: as SQL columns, and as hashes computed over Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java pattern of the white space that separates words.
SPACE = r"[\x20\x09-\x0D]+"

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
_INV = pow(_BASE, -1, 1 << 64)
_TABLES: dict[str, np.ndarray] = {}


def words(text: str | Column) -> Column:
    """Array of the maximal runs without white space; a null text has none."""
    return F.array_remove(F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), SPACE), "")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse."""
    have = _TABLES.get("up")
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", _BASE), ("down", _INV)):
            t = np.full(size, base, dtype=np.uint64)
            t[0] = 1
            _TABLES[name] = np.cumprod(t, dtype=np.uint64)
    return _TABLES["up"], _TABLES["down"]


def byte_table(space: bytes, fold: bool = True) -> np.ndarray:
    """A random value for each byte; 0 for those that separate words; A-Z as a-z if ``fold``."""
    t = mix(np.arange(1, 257, dtype=np.uint64) * _ODD) | np.uint64(1)
    if fold:
        t[65:91] = t[97:123]
    t[list(space)] = 0
    return t


#: Words are runs without ASCII white space; letters A-Z count as a-z.
WORDS = byte_table(bytes([0x20, *range(0x09, 0x0E)]))
#: Words are runs of ASCII letters and digits and of anything beyond ASCII.
TERMS = byte_table(bytes(b for b in range(128) if not chr(b).isalnum()))


def slices(column: pa.Array, limit: int = 2 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of rows of a string column of about ``limit`` bytes: first row, offsets from 0, bytes.

    Null is an empty text. A longer text comes alone and whole.
    """
    column = column.cast(pa.large_string()).fill_null("") if column.null_count else column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, at, data = column.buffers()
    off = np.frombuffer(at, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield i, off[i : j + 1] - off[i], raw[off[i] : off[j]]
        i = j


def hashed_words(off: np.ndarray, raw: np.ndarray, table: np.ndarray = WORDS, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of some rows, and the number of the first word of each row (and the total).

    With ``prefixes``, in bytes, the hashes are a table with a column for each as well, which holds 0
    for words that are not longer.
    """
    value = table[raw]
    inside = value != 0
    before = np.empty(len(raw), dtype=bool)
    if len(raw):
        before[0] = False
        before[1:] = inside[:-1]
        cuts = off[1:-1]
        before[cuts[cuts < len(raw)]] = False
    start = np.flatnonzero(inside & ~before)
    last = np.empty(len(raw), dtype=bool)
    if len(raw):
        last[-1] = True
        last[:-1] = ~inside[1:] | ~before[1:]
    end = np.flatnonzero(inside & last) + 1
    up, down = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(value * up[: len(raw)], out=total[1:])
    h = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _ODD)
    if prefixes:
        columns = [h]
        for k in prefixes:
            stop = np.minimum(start + k, end)
            part = mix((total[stop] - total[start]) * down[start] + np.uint64(k * int(_ODD) + 1 & (1 << 64) - 1))
            columns.append(np.where(end - start > k, part, np.uint64(0)))
        h = np.stack(columns, axis=1)
    return h, np.searchsorted(start, off)


def word_spans(off: np.ndarray, raw: np.ndarray, table: np.ndarray = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begins and ends of all words of some rows, and the number of the first word of each row (and the total)."""
    inside = np.append(table[raw] != 0, False)
    cut = np.zeros(len(raw) + 1, dtype=bool)
    cut[off] = True
    before = np.concatenate([[False], inside[:-1]])
    start = np.flatnonzero(inside & (~before | cut))
    end = np.flatnonzero(before & (~inside | cut))
    return start, end, np.searchsorted(start, off)


def shingle_hashes(h: np.ndarray, first: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each row's ``k``-word shingles.

    A row with fewer words has its whole sequence as its only shingle, and none if it has no word.
    """
    joined = np.zeros(0, np.uint64)
    if len(h) >= k:
        joined = h[: len(h) - k + 1] * np.uint64(3)
        for d in range(1, k):
            joined = mix(joined + np.uint64(d)) + h[d : len(h) - k + 1 + d]
        joined = mix(joined)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(joined[a : b - k + 1])
        elif b > a:
            few = h[a : a + 1] * np.uint64(5)
            for d in range(1, b - a):
                few = mix(few + np.uint64(d)) + h[a + d : a + d + 1]
            yield mix(few + np.uint64(b - a))
        else:
            yield joined[:0]
