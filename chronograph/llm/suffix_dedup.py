"""Exact removal of repeated byte strings, with suffix arrays built by linear grouping.

A byte is removed if a LENGTH-byte string that covers it also starts anywhere else in the corpus. Strings never cross
documents. The corpus is too large for one suffix array, so hashes select what is put in order together, and the order
says what is repeated:

1. Candidates. Every LENGTH-byte window selects an anchor: its KGRAM-byte gram of least hash (the last of equal ones).
   Equal windows select equal grams at equal offsets. The windows that select one anchor are neighbours; the bytes they
   cover are its context. Anchors travel as hashes to buckets, where grams that occur once drop out.
2. Orders. Of every context that is left, its first two copies in the corpus (or its only one) are sent to the bucket of
   its gram, whichever chunks of documents they come from. The contexts of a gram are cut into SYMBOL-byte symbols counted
   from the anchor and get a suffix array: suffixes are grouped by Lyndon prefix, groups are processed in descending order with
   previous-smaller pointers, and each group's order is emitted from the order of what follows it (no recursion, no
   renaming). Runs of neighbours that share the symbols that every window holds whole, and the bytes on either side, are
   equal windows.
3. Removal. Each chunk learns which windows of its contexts are repeated and drops the bytes that they cover.

Copies beyond the second of a context take its verdict, so text that a third of all documents share is put in order
twice, not as often as it occurs. The contexts of a gram with more than ``hot`` different ones (a common line in ever new
surroundings) are parted: windows whose offsets from the anchor are alike but for STEPS[1] bytes share more than the gram,
are selected anew by that longer gram, and where it is as common still, each window is selected by its own hash, so that
at most two copies of it meet.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronograph.llm.storage import drop, materialize, settings
from chronograph.llm.text import _PLAIN, _pow, column_bytes, mix

LENGTH = 200
KGRAM = 64  # longer grams select fewer candidates, shorter ones need fewer anchors
SPAN = LENGTH - KGRAM + 1  # grams in a window
PIECE = 250_000  # bytes hashed at once
CHUNK = 2_000_000  # bytes of text in one chunk, or one longer document
PER_BUCKET = 300_000  # anchors judged together
SYMBOL = 40  # bytes; divides LENGTH, so that what a window holds besides whole symbols lies in one symbol on either side
SYMBOLS = 15_000  # in one suffix array, or one gram's contexts
HOT = 4000  # contexts of one gram in one suffix array, about 70,000 symbols
BATCH = "4m"  # bytes of text sent to Python at once, or one longer document
LEVEL = 6  # of zstd, for the texts between steps
WORDS = LENGTH // SYMBOL - 1  # full symbols in every window
STEPS = (SPAN, 16, 1)  # windows in a context, and in the parts of contexts of common grams
PARTED = 1 << 40  # times the step's number, added to the buckets of parts
NONE, KNOWN, SHIP, SHIP_TWO, PART = range(5)  # what is to be done with a context
_LOW = np.uint64((1 << 20) - 1)
_A, _B = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)
_OTHER = np.random.default_rng(13).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_WIDTH = -(-SPAN // 8)  # bytes of a bit per window of a context


def suffix_array(symbols: list[int]) -> list[int]:
    """The suffix array of a sequence of small non-negative integers that ends with its only, least symbol.

    Groups are intervals of the array, named by their starts. Initially a group holds the suffixes of one first symbol.
    From the highest group down, each member finds its previous suffix of a lower group; a suffix that is named k times
    continues with k copies of the group's common prefix, so those named more often are greater: they move to the end of
    their group and form a higher one. In the end a group's members share their Lyndon prefix, whatever follows it is
    smaller, and the order of what follows gives the order of the members.
    """
    n = len(symbols)
    size = max(symbols) + 1
    start = [0] * (size + 1)
    for c in symbols:
        start[c + 1] += 1
    for c in range(size):
        start[c + 1] += start[c]
    free = start[:-1]
    order, where, group = [0] * n, [0] * n, [0] * n
    for i, c in enumerate(symbols):
        at = free[c]
        free[c] = at + 1
        order[at], where[i], group[i] = i, at, start[c]
    last, length, prev = [0] * n, [1] * n, [-1] * n
    for c in range(size):
        if start[c + 1] > start[c]:
            last[start[c]] = start[c + 1] - 1
    end = n - 1
    while end >= 0:
        g = group[order[end]]
        members = sorted(order[g : end + 1]) if end > g else [order[g]]
        own = length[g]
        named: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                named[j] = named.get(j, 0) + 1
        level = list(named)
        times = 1
        while level:
            moved: dict[int, int] = {}
            for j in level:  # to the end of its group
                h = group[j]
                to = last[h] - moved.get(h, 0)
                moved[h] = moved.get(h, 0) + 1
                at = where[j]
                other = order[to]
                order[at], order[to], where[other], where[j] = other, j, at, to
            renamed = {}
            for h, k in moved.items():
                new = last[h] - k + 1
                last[new] = last[h]
                if new > h:
                    last[h] = new - 1
                length[new] = length[h] + own
                renamed[h] = new
            for j in level:
                group[j] = renamed[group[j]]
            times += 1
            level = [j for j in level if named[j] >= times]
        end = g - 1
    free = list(range(n))
    out = [0] * n
    out[0] = n - 1
    free[group[n - 1]] += 1
    for r in range(n):
        s = out[r]
        j = s - 1
        while j >= 0:
            g = group[j]
            if j + length[g] != s:
                break
            out[free[g]] = j
            free[g] += 1
            j = prev[j]
    return out


def _sums(buf: np.ndarray, p: np.ndarray) -> np.ndarray:
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_PLAIN[buf] * p[: len(buf)], dtype=np.uint64, out=out[1:])
    return out


def anchors(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the texts buf[off[i]:off[i+1]] (at most PIECE + LENGTH bytes): each anchor's position, the first and last start
    of the windows that select it, the hash of its gram and the hash of its context."""
    n = len(buf)
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    if n < LENGTH:
        return none
    p, inv = _pow(n + 1)
    sums = _sums(buf, p)
    grams = mix((sums[KGRAM:] - sums[:-KGRAM]) * inv[: n - KGRAM + 1])
    keys = (grams & ~_LOW) | (_LOW - np.arange(len(grams), dtype=np.uint64))
    pad = -len(keys) % SPAN
    padded = np.concatenate([keys, np.full(pad, ~np.uint64(0))]).reshape(-1, SPAN)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - LENGTH + 1
    least = np.minimum(behind[:windows], ahead[SPAN - 1 : SPAN - 1 + windows])
    ok = np.zeros(windows + 1, np.int32)
    ends = np.minimum(windows, np.maximum(off[1:] - LENGTH + 1, off[:-1]))
    begins = np.minimum(windows, off[:-1])
    np.add.at(ok, begins, 1)
    np.add.at(ok, ends, -1)
    starts = np.flatnonzero(np.cumsum(ok)[:-1] > 0)
    if not len(starts):
        return none
    at = (_LOW - (least[starts] & _LOW)).astype(np.int64)
    cut = np.concatenate([[True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)])
    lo = starts[cut]
    hi = starts[np.append(np.flatnonzero(cut)[1:] - 1, len(starts) - 1)]
    x = at[cut]
    context = mix((sums[hi + LENGTH] - sums[lo]) * inv[lo] + (x - lo).astype(np.uint64) * _A + (hi - lo).astype(np.uint64) * _B)
    return x, lo, hi, mix(grams[x] * _A), context  # anew, as least hashes would crowd the first buckets


def _pieces(buf: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(offset in buf, bytes, text boundaries): runs of short texts, and overlapping stretches of long ones."""
    i, n = 0, len(off) - 1
    while i < n:
        if off[i + 1] - off[i] > PIECE:
            for a in range(int(off[i]), int(off[i + 1]), PIECE - LENGTH):
                b = min(int(off[i + 1]), a + PIECE - 1)
                if b - a >= LENGTH:
                    yield a, buf[a:b], np.array([0, b - a])
                if b == off[i + 1]:
                    break
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(off, off[i] + PIECE, "right")) - 1)
        yield int(off[i]), buf[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def _found(buf: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """anchors() of a chunk of any size, with positions in the chunk."""
    parts = []
    for a, piece, cuts in _pieces(buf, off):
        x, lo, hi, g, c = anchors(piece, cuts)
        parts.append((x + a, lo + a, hi + a, g, c))
    return [np.concatenate(k) for k in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2


def _distinct(g: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (gram, context) pairs in order, whether each occurs twice, and each input's index among them."""
    order = np.lexsort((c, g))
    a, b = g[order], c[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    index = np.empty(len(a), np.int64)
    index[order] = np.cumsum(new) - 1
    return a[new], b[new], np.bincount(index, minlength=int(new.sum())) > 1, index


def _bucket(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


def _split(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, first, end) of the stretches of hashes, ordered by bucket, that share one."""
    bucket = _bucket(keys, bits)
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    for a, b in zip(cut, np.append(cut[1:], len(bucket))[: len(cut)], strict=True):
        yield int(bucket[a]), int(a), int(b)


def _read_entries(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    parts, sizes = [], []
    for blob in table.column("blob"):
        raw = blob.as_buffer()
        k = len(raw) // 17
        parts.append((np.frombuffer(raw, np.uint64, k), np.frombuffer(raw, np.uint64, k, 8 * k), np.frombuffer(raw, np.uint8, k, 16 * k)))
        sizes.append(k)
    return *(np.concatenate(x) for x in zip(*parts, strict=True)), sizes


def judge(table: pa.Table, hot: int) -> pa.Table:
    """What is to be done with each entry (gram, context, whether twice in its chunk) of a bucket, and for those that are
    candidates the numbers of their context and of their gram's first context."""
    g, c, twice, sizes = _read_entries(table)
    order = np.lexsort((c, g))
    a, b, more = g[order], c[order], twice[order].astype(np.int64)
    n = len(a)
    new_gram, new = np.ones(n, bool), np.ones(n, bool)
    new_gram[1:] = a[1:] != a[:-1]
    new[1:] = new_gram[1:] | (b[1:] != b[:-1])
    context, gram = np.cumsum(new) - 1, np.cumsum(new_gram) - 1
    several = np.bincount(gram, 1 + more) > 1
    crowded = np.bincount(gram[new]) > hot
    first = np.flatnonzero(new)
    nth = np.arange(n) - first[context]
    code = np.full(n, KNOWN, np.uint8)
    code[nth == 0] = np.where(more[nth == 0] > 0, SHIP_TWO, SHIP)
    code[(nth == 1) & (more[first[context]] == 0)] = SHIP
    code[crowded[gram]] = PART
    code[~several[gram]] = NONE
    group = (np.cumsum(new)[np.flatnonzero(new_gram)] - 1)[gram]
    out = np.empty((3, n), np.uint32)
    out[:, order] = np.stack([code, context, group])
    ends = np.cumsum(sizes)
    blobs, hots = [], []
    for e, k in zip(ends, sizes, strict=True):
        code, context, group = out[:, e - k : e]
        some = (code > NONE) & (code < PART)
        blobs.append(code.astype(np.uint8).tobytes() + context[some].tobytes() + group[some].tobytes())
        hots.append(int((code == PART).sum()))
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "blob": pa.array(blobs, pa.binary()), "entries": pa.array(sizes, pa.int64()), "hot": pa.array(hots, pa.int64())})


def _read_codes(blob: pa.Buffer, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    code = np.frombuffer(blob, np.uint8, n)
    k = (len(blob) - n) // 8
    return code, np.frombuffer(blob[n : n + 4 * k], np.uint32), np.frombuffer(blob[n + 4 * k :], np.uint32)


def _ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo, lo + 1, ... of n numbers each."""
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _squeeze(raw: bytes, level: int = LEVEL) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=level).compress(raw, asbytes=True)


def _unsqueeze(blob: pa.BinaryScalar) -> bytes:
    raw = memoryview(blob.as_buffer())
    return pa.Codec("zstd").decompress(raw[8:], int.from_bytes(raw[:8], "little"), asbytes=True)


def _edge_classes(rows: np.ndarray) -> np.ndarray:
    """A number for the first k bytes of each row, for k from 0 to the rows' length; equal ones have equal numbers."""
    big = rows.reshape(len(rows), -1, 8)[:, :, ::-1].copy().view("<u8")[:, :, 0]
    order = np.lexsort(big.T[::-1])
    a = rows[order]
    alike = np.zeros(len(rows), np.int64)
    same = a[1:] == a[:-1]
    alike[1:] = np.where(same.all(axis=1), rows.shape[1], same.argmin(axis=1))
    out = np.empty((rows.shape[1] + 1, len(rows)), np.uint64)
    for k in range(rows.shape[1] + 1):
        out[k, order] = np.cumsum(alike < k)
    return out


def repeated_windows(buf: np.ndarray, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Of the windows that start at lo, lo + 1, ... hi of each context, one context after another: whether an equal one is
    among them, as the suffix array of the contexts' symbols says. Contexts are laid out from their anchors x, so windows
    of one gram that are equal fall on symbols alike."""
    grid = x + SYMBOL * ((lo - x) // SYMBOL)  # the first symbol is padded in front
    count = -(-(hi + LENGTH - grid) // SYMBOL)
    at = np.concatenate([[0], np.cumsum(count + 1)])  # each context is followed by a separator
    total = int(at[-1])
    raw = np.zeros(SYMBOL * total, np.uint8)
    size = hi + LENGTH - lo
    raw[_ranges(at[:-1] * SYMBOL + (lo - grid), size)] = buf[_ranges(lo, size)]
    rows = raw.reshape(-1, SYMBOL)
    ahead, back = _edge_classes(rows), _edge_classes(np.ascontiguousarray(rows[:, ::-1]))
    symbol = ahead[SYMBOL].astype(np.int64) + 2
    symbol[at[1:] - 1] = 1
    _, symbol = np.unique(symbol, return_inverse=True)
    symbol = symbol.reshape(-1) + 1
    order = np.array(suffix_array([*symbol.tolist(), 0])[1:])
    room = np.repeat(at[1:] - 1, count + 1) - np.arange(total)  # symbols up to the separator
    a, b = order[:-1], order[1:]
    same = (room[a] >= WORDS) & (room[b] >= WORDS)
    for k in range(WORDS):
        live = np.flatnonzero(same)
        same[live] = symbol[a[live] + k] == symbol[b[live] + k]
    run = np.empty(total, np.uint64)
    run[order] = np.concatenate([[0], np.cumsum(~same)])
    n = hi - lo + 1
    g = _ranges(lo, n) - np.repeat(grid, n)
    first = np.repeat(at[:-1], n) + -(-g // SYMBOL)
    lead = (-g) % SYMBOL
    before = back[lead, np.maximum(first - 1, 0)]
    after = ahead[SYMBOL - lead, np.minimum(first + WORDS, total - 1)]
    bits = np.uint64(total.bit_length())
    if 3 * int(bits) + 6 <= 64:
        key = (((run[first] << np.uint64(6) | lead.astype(np.uint64)) << bits | before) << bits) | after
    else:  # a gram with long contexts; numbers do not fit one word
        _, key = np.unique(np.stack([run[first] << np.uint64(6) | lead.astype(np.uint64), before, after], axis=1), axis=0, return_inverse=True)
        key = key.reshape(-1)
    sort = np.argsort(key, kind="stable")
    same = key[sort][1:] == key[sort][:-1]
    out = np.zeros(len(key), bool)
    out[sort[1:][same]] = out[sort[:-1][same]] = True
    return out


def _send(buf: np.ndarray, x: np.ndarray, lo: np.ndarray, hi: np.ndarray, context: np.ndarray, group: np.ndarray) -> bytes:
    """Contexts with their text: number, gram's number, bytes before the anchor, windows."""
    text = buf[_ranges(lo, hi + LENGTH - lo)]
    return _squeeze(b"".join([len(x).to_bytes(8, "little"), context.astype(np.uint32).tobytes(), group.astype(np.uint32).tobytes(), (x - lo).astype(np.uint8).tobytes(), (hi - lo + 1).astype(np.uint8).tobytes(), text.tobytes()]), 3)


def order_bucket(texts: pa.Table) -> np.ndarray:
    """A row for each context of a bucket, by number: a bit for each of its windows, set if the window is repeated."""
    parts = []
    for blob in texts.column("blob"):
        raw = _unsqueeze(blob)
        k = int.from_bytes(raw[:8], "little")
        cut = 8 + np.cumsum([0, 4 * k, 4 * k, k, k])
        parts.append((*(np.frombuffer(raw, t, k, int(o)) for t, o in zip((np.uint32, np.uint32, np.uint8, np.uint8), cut[:4], strict=True)), np.frombuffer(raw, np.uint8, -1, int(cut[4]))))
    if not parts:
        return np.zeros((0, _WIDTH), np.uint8)
    context, group, front, windows, buf = (np.concatenate(p) for p in zip(*parts, strict=True))
    windows = windows.astype(np.int64)
    size = windows + LENGTH - 1
    start = np.cumsum(size) - size
    by = np.argsort(group, kind="stable")
    symbols = np.cumsum(size[by] // SYMBOL + 2)
    ends = np.flatnonzero(np.append(group[by][1:] != group[by][:-1], True)) + 1
    bits = np.zeros((int(context.max()) + 1, 8 * _WIDTH), bool)
    i = 0
    while i < len(by):
        done = symbols[i - 1] if i else 0
        j = max(int(ends[np.searchsorted(ends, i, "right")]), int(ends[max(0, np.searchsorted(symbols[ends - 1], done + SYMBOLS, "right") - 1)]))
        at = by[i:j]
        if len(at) > 1:
            hit = repeated_windows(buf, start[at] + front[at], start[at], start[at] + windows[at] - 1)
            bits[np.repeat(context[at], windows[at])[hit], _ranges(np.zeros(len(at), np.int64), windows[at])[hit]] = True
        i = j
    return np.packbits(bits, axis=1)


def answer(codes: pa.Table, texts: pa.Table) -> pa.Table:
    """For each chunk that asked a bucket: its codes, and the bits of its candidates."""
    bits = order_bucket(texts)
    rows = []
    for chunk, bucket, n, blob in zip(*(codes.column(c).to_pylist() for c in ("chunk", "bucket", "entries")), codes.column("blob"), strict=True):
        code, context, _ = _read_codes(blob.as_buffer(), n)
        if (code > NONE).any():
            rows.append((chunk, bucket, n, _squeeze(code.tobytes() + bits[context].tobytes(), 3)))
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["chunk", "bucket", "entries", "blob"])


def _marked(n: int, starts: np.ndarray) -> np.ndarray:
    """Bytes of n that windows at ``starts`` cover."""
    if not len(starts):
        return np.zeros(n, bool)
    edge = np.bincount(starts, minlength=n + 1)[: n + 1] > 0
    step = edge.astype(np.int32)
    step[LENGTH:] -= edge[: n + 1 - LENGTH]
    return np.cumsum(step[:n]) > 0


_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _result(ids: pa.Array, buf: np.ndarray, off: np.ndarray, gone: np.ndarray, with_kept: bool) -> pa.Table:
    rows = []
    for k in range(len(off) - 1):
        g = gone[off[k] : off[k + 1]]
        kept = buf[off[k] : off[k + 1]][~g].tobytes()
        spans = int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if len(g) else 0
        rows.append((len(g), int(g.sum()), spans, hashlib.sha256(kept).hexdigest(), kept if with_kept else None))
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
    return pa.table([ids, *(pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string(), pa.binary()], strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def _text_of(chunk: pa.Table) -> tuple[list, np.ndarray, np.ndarray]:
    ids, text, off = pickle.loads(_unsqueeze(chunk.column("blob")[0]))
    return ids, np.frombuffer(text, np.uint8), off


def _as_table(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["chunk", "bucket", "blob"])


class _Contexts:
    """A chunk's contexts, or parts of them, with the order of their distinct hashes."""

    def __init__(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray, g: np.ndarray, c: np.ndarray, bits: int, step: int = 0):
        self.x, self.lo, self.hi, self.bits, self.step = x, lo, hi, bits, step
        self.g, self.c, self.twice, self.index = _distinct(g, c)

    def rows(self, chunk: int) -> list[tuple[int, int, bytes]]:
        return [(chunk, k, self.g[a:b].tobytes() + self.c[a:b].tobytes() + self.twice[a:b].tobytes()) for k, a, b in self.places()]

    def places(self) -> Iterator[tuple[int, int, int]]:
        """(bucket, first, end) of the stretches of distinct hashes."""
        for k, a, b in _split(self.g, self.bits):
            yield self.step * PARTED + k, a, b

    def codes(self, said: dict[int, np.ndarray]) -> np.ndarray:
        out = np.zeros(len(self.g), np.uint8)
        for k, a, b in self.places():
            if k in said:
                out[a:b] = said[k]
        return out

    def parted(self, code: np.ndarray, buf: np.ndarray) -> _Contexts:
        """The parts of the contexts that are to be parted, each with the hash of what all its possible windows share."""
        some = code[self.index] == PART
        x, lo, hi = self.x[some], self.lo[some], self.hi[some]
        size = STEPS[self.step + 1]
        near, far = (x - hi) // size, (x - lo) // size
        n = far - near + 1
        x, lo, hi, block = np.repeat(x, n), np.repeat(lo, n), np.repeat(hi, n), _ranges(near, n)
        last = np.minimum(block * size + size - 1, SPAN - 1)
        begin, end = x - block * size, x - last + LENGTH
        lo, hi = np.maximum(lo, x - last), np.minimum(hi, begin)
        order = np.argsort(lo, kind="stable")
        x, lo, hi, block, begin, end = (v[order] for v in (x, lo, hi, block, begin, end))
        g, c = np.zeros(len(x), np.uint64), np.zeros(len(x), np.uint64)
        i = 0
        while i < len(x):
            j = int(np.searchsorted(lo, lo[i] + PIECE, "right"))
            a, b = int(lo[i]), int(hi[i:j].max()) + LENGTH
            p, inv = _pow(b - a + 1)
            plain, other = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[buf[a:b]] * p[: b - a], dtype=np.uint64)]) for values in (_PLAIN, _OTHER))
            u, v = begin[i:j] - a, end[i:j] - a
            g[i:j] = (plain[v] - plain[u]) * inv[u] + block[i:j].astype(np.uint64) * _A
            u, v = lo[i:j] - a, hi[i:j] + LENGTH - a
            c[i:j] = mix((other[v] - other[u]) * inv[u] + (x - lo)[i:j].astype(np.uint64) * _A + (hi - lo)[i:j].astype(np.uint64) * _B)
            i = j
        return _Contexts(x, lo, hi, mix(mix(g) * _B), c, self.bits, self.step + 1)


def remove_repeats(docs: DataFrame, with_kept: bool = False, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and (if asked for) kept bytes of every row of ``docs`` (doc_id,
    text): all bytes that LENGTH-byte repeats cover are removed, from every copy.

    A null or short text keeps all its bytes; repeated rows are repeats of each other; null ids are carried; other columns
    are passed over; an empty table gives no rows. Which contexts are copies of one another is decided by 128 bits of
    hash, whether windows are repeated by suffix arrays over the text. Memory follows the chunk (CHUNK bytes of text or
    one longer document) and the bucket. ``hot`` bounds the contexts of one gram in a suffix array; it does not
    change the result.
    """
    base = docs.select("doc_id", "text")
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(6, math.ceil(math.log2(max(1, 2 * total / SPAN / PER_BUCKET))))

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, held, ids, texts = TaskContext.get().partitionId(), 0, 0, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, held, ids, texts
            if not ids:
                return
            buf, off = np.concatenate([b for b, _ in texts]), np.concatenate([[0], np.cumsum(np.concatenate([np.diff(o) for _, o in texts]))]).astype(np.int64)
            chunk = part * (1 << 32) + number
            rows = [(chunk, -1, _squeeze(pickle.dumps((pa.concat_arrays(ids).to_pylist(), buf.tobytes(), off))))]
            rows += _Contexts(*_found(buf, off), bits).rows(chunk)
            yield from _as_table(rows).to_batches()
            number, held, ids, texts = number + 1, 0, [], []

        for batch in batches:
            buf, off = column_bytes(batch.column(1))
            i, n = 0, len(off) - 1
            while i < n:
                j = max(i + 1, int(np.searchsorted(off, off[i] + CHUNK - held, "right")) - 1)
                ids.append(batch.column(0).slice(i, j - i))
                texts.append((buf[off[i] : off[j]].copy(), off[i : j + 1] - off[i]))
                held += int(off[j] - off[i])
                if held >= CHUNK or j < n:
                    yield from flush()
                i = j
        yield from flush()

    def levels(buf: np.ndarray, off: np.ndarray, said: dict[int, np.ndarray]) -> Iterator[tuple[_Contexts, np.ndarray]]:
        """The contexts with the codes that the buckets gave them, and the parts of those that were parted."""
        level = _Contexts(*_found(buf, off), bits)
        while True:
            code = level.codes(said)
            yield level, code
            if not (code == PART).any():
                return
            level = level.parted(code, buf)

    def read(codes: pa.Table) -> dict[int, tuple]:
        return {k: _read_codes(blob.as_buffer(), n) for k, n, blob in zip(codes.column("bucket").to_pylist(), codes.column("entries").to_pylist(), codes.column("blob"), strict=True)}

    def part(key, chunk: pa.Table, codes: pa.Table) -> pa.Table:
        """The entries of the parts that have no codes yet."""
        _, buf, off = _text_of(chunk)
        said = {k: code for k, (code, _, _) in read(codes).items()}
        level, _ = list(levels(buf, off, said))[-1]
        return _as_table(level.rows(chunk.column("chunk")[0].as_py()))

    def ship(key, chunk: pa.Table, codes: pa.Table) -> pa.Table:
        """The texts that the buckets asked for."""
        if not chunk.num_rows or not codes.num_rows:
            return _as_table([])
        _, buf, off = _text_of(chunk)
        said, rows = read(codes), []
        for level, _ in levels(buf, off, {k: code for k, (code, _, _) in said.items()}):
            order = np.argsort(level.index, kind="stable")
            first = np.searchsorted(level.index[order], np.arange(len(level.g)))
            for k, a, _ in level.places():
                if k not in said:
                    continue
                code, context, group = said[k]
                some = np.flatnonzero((code > NONE) & (code < PART))
                one, two = code[some] >= SHIP, code[some] == SHIP_TWO
                at = np.concatenate([order[first[a + some[one]]], order[first[a + some[two]] + 1]])
                if len(at):
                    rows.append((-1, k, _send(buf, level.x[at], level.lo[at], level.hi[at], np.concatenate([context[one], context[two]]), np.concatenate([group[one], group[two]]))))
        return _as_table(rows)

    def finish(key, chunk: pa.Table, answers: pa.Table) -> pa.Table:
        ids, buf, off = _text_of(chunk)
        gone = np.zeros(len(buf), bool)
        if answers.num_rows:
            blobs, said, hits = {}, {}, []
            for k, n, blob in zip(answers.column("bucket").to_pylist(), answers.column("entries").to_pylist(), answers.column("blob"), strict=True):
                blobs[k] = _unsqueeze(blob)
                said[k] = np.frombuffer(blobs[k], np.uint8, n)
            for level, _ in levels(buf, off, said):
                order = np.argsort(level.index, kind="stable")
                first = np.searchsorted(level.index[order], np.arange(len(level.g) + 1))
                for k, a, b in level.places():
                    if k not in said:
                        continue
                    known = np.frombuffer(blobs[k], np.uint8, -1, b - a).reshape(-1, _WIDTH)
                    context, offset = np.nonzero(np.unpackbits(known, axis=1))
                    context = a + np.flatnonzero((said[k] > NONE) & (said[k] < PART))[context]
                    copies = (first[1:] - first[:-1])[context]
                    hits.append(level.lo[order[_ranges(first[context], copies)]] + np.repeat(offset, copies))
            gone = _marked(len(buf), np.concatenate(hits)) if hits else gone
        return _result(pa.array(ids, pa.int64()), buf, off, gone, with_kept)

    def judging(limit: int):
        return lambda t: judge(t, limit)

    entries = "chunk long, bucket long, blob binary"
    judged = f"{entries}, entries long, hot long"
    with settings(base.sparkSession, {"spark.sql.execution.arrow.maxBytesPerBatch": BATCH}):
        packed = materialize(base.mapInArrow(survey, entries), "chunks")
    texts = packed.where("bucket < 0").select("chunk", "blob")
    codes = materialize(packed.where("bucket >= 0").groupBy("bucket").applyInArrow(judging(hot), judged), "codes")
    made = [codes]
    for step in range(1, len(STEPS)):
        crowded = made[-1].where("hot > 0").select("chunk").distinct()
        if not crowded.limit(1).count():
            break
        some = texts.join(crowded, "chunk", "left_semi")
        entered = some.groupBy("chunk").cogroup(codes.join(crowded, "chunk", "left_semi").groupBy("chunk")).applyInArrow(part, entries)
        limit = hot if step + 1 < len(STEPS) else 1 << 62  # a window's copies are one context
        made.append(materialize(entered.groupBy("bucket").applyInArrow(judging(limit), judged), "codes"))
        codes = codes.unionByName(made[-1])
    sent = texts.groupBy("chunk").cogroup(codes.groupBy("chunk")).applyInArrow(ship, entries)
    answers = materialize(codes.groupBy("bucket").cogroup(sent.groupBy("bucket")).applyInArrow(lambda a, b: answer(a, b), "chunk long, bucket long, entries long, blob binary"), "answers")
    drop(*made)
    out = texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, _OUT)
    return out if with_kept else out.drop("kept")
