"""Words, as native expressions and as vectorised hashes over Arrow buffers.

A word is a maximal run of characters other than space and U+0009 to U+000D; all operators of this subpackage share it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """The words of ``text`` as an array; empty for null."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP))


def word_count(text: Column) -> Column:
    """The number of words as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


# --- vectorised hashing -------------------------------------------------------------------------------------------

PIECE = 1 << 18  # bytes hashed at once; bounds the working memory, not what is processed
_rng = np.random.default_rng(7)
_PLAIN = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_FOLDED = _PLAIN.copy()
_FOLDED[65:91] = _FOLDED[97:123]
_IS_GAP = np.zeros(256, bool)
_IS_GAP[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_STEP = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX1
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX2
    return h ^ (h >> np.uint64(33))


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("p", ())) < n:
        n = max(n, 2 * PIECE)
        inverse = pow(_BASE, -1, 1 << 64)
        for key, base in (("p", _BASE), ("i", inverse)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _powers[key] = np.cumprod(x, dtype=np.uint64)
    return _powers["p"], _powers["i"]


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and its n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n, at = len(column), column.offset
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, n + 1, at * 8) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def _hash_piece(buf: np.ndarray, breaks: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start positions of the words of one buffer; ``breaks`` are positions at which a text begins."""
    n = len(buf)
    solid = ~_IS_GAP[buf]
    first = np.empty(n, bool)
    first[0] = True
    first[1:] = ~solid[:-1]
    first[breaks[breaks < n]] = True
    last = np.empty(n, bool)
    last[-1] = True
    last[:-1] = first[1:] | ~solid[1:]
    starts, ends = np.flatnonzero(solid & first), np.flatnonzero(solid & last) + 1
    p, inv = _pow(n)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum((_FOLDED if fold else _PLAIN)[buf] * p[:n], dtype=np.uint64, out=sums[1:])
    h = (sums[ends] - sums[starts]) * inv[starts]
    return mix(h + (ends - starts).astype(np.uint64) * _MIX2), starts


def hashed_words(column: pa.Array, fold: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of consecutive texts: (first row, end row, word hashes, row of each word minus the first row).

    Texts are taken whole. Short ones are hashed together, long ones in pieces that end at a gap.
    """
    buf, off = column_bytes(column)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + PIECE, "right")) - 1)
        lo, hi = int(off[i]), int(off[j])
        if hi == lo:
            yield i, j, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        elif hi - lo <= 2 * PIECE:
            h, starts = _hash_piece(buf[lo:hi], off[i:j] - lo, fold)
            yield i, j, h, np.searchsorted(off[i : j + 1] - lo, starts, "right") - 1
        else:
            parts, at = [], lo
            while at < hi:
                end = min(hi, at + PIECE)
                while end < hi and not _IS_GAP[buf[end]]:
                    end += 1  # a word is never cut
                parts.append(_hash_piece(buf[at:end], np.zeros(1, np.int64), fold)[0])
                at = end
            h = np.concatenate(parts)
            yield i, j, h, np.zeros(len(h), np.int64)
        i = j


def shingles(h: np.ndarray, row: np.ndarray, size: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of ``size`` words as (hash, row), sorted by row and hash. A text with fewer words has its whole
    sequence as its one shingle; a text without words has none."""
    n = len(h)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k = max(0, n - size + 1)
    s = np.zeros(k, np.uint64)
    for i in range(size):
        s += h[i : i + k] * _STEP[i]
    whole = row[:k] == row[size - 1 : size - 1 + k] if k else np.zeros(0, bool)
    s, r = mix(s[whole]), row[:k][whole]
    counts = np.bincount(row, minlength=rows)
    if (short := (counts > 0) & (counts < size)).any():
        begin = np.concatenate([[0], np.cumsum(counts)[:-1]])
        extra = np.zeros(int(short.sum()), np.uint64)
        at, length = begin[short], counts[short]
        for i in range(size - 1):
            ok = length > i
            extra[ok] += h[at[ok] + i] * _STEP[i]
        s = np.concatenate([s, mix(extra + length.astype(np.uint64) * _STEP[63])])
        r = np.concatenate([r, np.flatnonzero(short)])
    order = np.lexsort((s, r))
    s, r = s[order], r[order]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != s[:-1]) | (r[1:] != r[:-1])
    return s[keep], r[keep]
