"""Benchmark decontamination by template canonicalisation.

Tokens lose case and edge punctuation; numbers, names and units become typed placeholders, so a question whose figures or
names were exchanged keeps its template. Characters of scripts without blanks between words are tokens of their own.
Windows of five tokens are looked up in a hash table of the benchmark's windows: by their values, and by template if enough
of their tokens are literal. Where a window matches by template, the item's windows of fewer literals are compared with
the tokens at their places. Within one occurrence of an item the slot values under matched windows must be consistent: every
benchmark value (within the item) stands for one document value, the most frequent one, and windows that say otherwise are
dropped. Occurrences are the windows in one line (document position minus item position), those whose lines differ by less
than the item's length (copies with words put in or left out), and all windows of the document (copies in pieces). An item
is leaked if in any occurrence the remaining windows cover at least ``coverage`` of its tokens, and of its literal tokens
where windows of fewer literals took other values. Items of two to four tokens are leaked if their values stand in the
document in a row, those of one token if it stands there as a sentence or line of its own.

The corpus is only scanned: the benchmark is read in blocks of bounded size, each block's table is broadcast, and every
block is matched against all documents. No document's windows are shuffled or gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronograph.llm.text import _FOLDED, _IS_GAP, _pow, column_bytes, mix

WINDOW = 5
LITERALS = 3  # of a window's tokens at least if it is to match by template, so that placeholders alone match nothing
COVERAGE = 0.6
BLOCK_BYTES = 8 << 20  # of benchmark text in one broadcast table

# Unit words that stand for one another.
UNITS = """mm cm m km inch inches foot feet yard yards mile miles meter meters metre metres centimeter centimeters
kilometer kilometers mg g kg gram grams kilogram kilograms ton tons tonne tonnes ounce ounces pound pounds lb lbs oz ml l
liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month
months year years euro euros dollar dollars cent cents percent km/h mph kb mb gb tb hz khz mhz ghz w kw v kv c f k""".split()

NUMBER, NAME, UNIT = (np.uint64(x) for x in (0x11, 0x22, 0x33))
_C = np.random.default_rng(11).integers(1, 2**63, WINDOW + 1, dtype=np.uint64) | np.uint64(1)
_EDGE = np.zeros(256, bool)
_EDGE[[i for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in "+-%$#&*|<>"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_IN_NUMBER = _DIGIT.copy()
_IN_NUMBER[[ord(c) for c in "+-.,:/%$"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:"]] = True
PIECE = 1 << 18
MOST = 1 << 21  # matches expanded at once
_C_VALUE = np.random.default_rng(12).integers(1, 2**63, WINDOW + 1, dtype=np.uint64) | np.uint64(1)
MARKS = "\u3000、。〃「」『』【】〈〉《》〔〕！，．：；？（）"  # parted from the characters around them
STOPS = "。！？"


def _scripts(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which bytes begin a character of a script without blanks or come after one, which belong to its punctuation, and
    which end a sentence or a line."""
    n = len(buf)
    first, marks, stop = np.zeros(n + 4, bool), np.zeros(n, bool), buf == 10
    at = np.flatnonzero(buf >= 0xE0)
    if not len(at):
        return first[:n], marks, stop
    lead, second, third = buf[at], buf[np.minimum(at + 1, n - 1)], buf[np.minimum(at + 2, n - 1)]
    code = (lead.astype(np.int64) << 16) | (second.astype(np.int64) << 8) | third
    mark = np.isin(code, [int.from_bytes(c.encode(), "big") for c in MARKS])
    for i in range(3):
        marks[np.minimum(at[mark] + i, n - 1)] = True
    stop[at[np.isin(code, [int.from_bytes(c.encode(), "big") for c in STOPS])]] = True
    wide = (lead >= 0xE3) & (lead <= 0xE9) | (lead == 0xE0) & (second >= 0xB8) & (second <= 0xBB) | (lead == 0xE1) & np.isin(second, [0x80, 0x81, 0x82, 0x9E, 0x9F])
    four = (lead == 0xF0) & (second >= 0xA0) & (second <= 0xAF)
    for which, length in ((wide & ~mark, 3), (four, 4)):
        first[at[which]] = first[at[which] + length] = True
    return first[:n], marks, stop


def _fold(buf: np.ndarray) -> np.ndarray:
    """Lower-case A-Z, and the accented Latin letters U+00C0 to U+00DE."""
    out = buf.copy()
    upper = _UPPER[out]
    out[upper] += 32
    if len(out) > 1:
        second = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)) + 1
        out[second] += 32
    return out


def template(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts buf[off[i]:off[i+1]]: each token's row, value hash, template hash (a placeholder for slots), whether it
    is a slot and whether it is a sentence or line of its own. Tokens of punctuation alone are passed over."""
    n = len(buf)
    first, marks, stop = _scripts(buf)
    solid = ~(_IS_GAP[buf] | marks)
    first[0] = True
    first[1:] |= ~solid[:-1]
    begins = off[:-1] - off[0]
    first[begins[begins < n]] = True
    last = np.empty(n, bool)
    last[-1] = True
    last[:-1] = first[1:] | ~solid[1:]
    starts, ends = np.flatnonzero(solid & first), np.flatnonzero(solid & last) + 1
    row = np.searchsorted(off - off[0], starts, "right") - 1
    closes = _STOP[buf[ends - 1]]
    inner = np.where(_EDGE[buf], n, np.arange(n))  # the nearest other byte from each on, and up to each
    starts = np.minimum(np.minimum.accumulate(inner[::-1])[::-1][starts], ends - 1)
    ends = np.maximum(np.maximum.accumulate(np.where(_EDGE[buf], -1, np.arange(n)))[ends - 1], starts) + 1
    real = ~_EDGE[buf[starts]]
    starts, ends, row, closes = starts[real], ends[real], row[real], closes[real]
    if not len(starts):
        z = np.zeros(0, np.uint64)
        return np.zeros(0, np.int64), z, z, np.zeros(0, bool), np.zeros(0, bool)
    folded = _fold(buf)
    p, inv = _pow(n)

    def sums(x):
        out = np.zeros(n + 1, x.dtype if x.dtype == np.uint64 else np.int64)
        np.cumsum(x, out=out[1:])
        return out

    h = sums(_FOLDED[folded] * p[:n])
    value = mix((h[ends] - h[starts]) * inv[starts] + (ends - starts).astype(np.uint64))
    digits, allowed = sums(_DIGIT[buf].astype(np.int64)), sums(_IN_NUMBER[buf].astype(np.int64))
    length = ends - starts
    number = (digits[ends] - digits[starts] > 0) & (allowed[ends] - allowed[starts] == length)
    begin = np.ones(len(starts), bool)
    begin[1:] = (row[1:] != row[:-1]) | closes[:-1]
    second = buf[np.minimum(starts + 1, n - 1)]
    capital = _UPPER[buf[starts]] | ((buf[starts] == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97))
    name = capital & ~begin & ~number
    unit = np.zeros(len(starts), bool)
    after = np.zeros(len(starts), bool)
    after[1:] = number[:-1] & (row[1:] == row[:-1])
    unit[after] = np.isin(value[after], _unit_hashes())  # a unit follows a number
    slot = number | name | unit
    kind = np.where(number, NUMBER, np.where(unit, UNIT, NAME))
    stops = sums(stop.astype(np.int64))
    opens = np.ones(len(starts) + 1, bool)
    opens[1:-1] = begin[1:] | (stops[starts[1:]] > stops[ends[:-1]])
    return row, value, np.where(slot, mix(kind), value), slot, opens[:-1] & opens[1:]


_units: list[np.ndarray] = []


def _unit_hashes() -> np.ndarray:
    if not _units:
        out = []
        p, _ = _pow(64)
        for u in UNITS:
            b = np.frombuffer(u.encode(), np.uint8)
            out.append(mix(np.array([(_FOLDED[b] * p[: len(b)]).sum(dtype=np.uint64) + np.uint64(len(b))], np.uint64))[0])
        _units.append(np.array(out, np.uint64))
    return _units[0]


def windows(row: np.ndarray, value: np.ndarray, tokens: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first token, hash, whether by template) of windows within a text: of the template tokens where enough of them are
    literal, and of the values of every window."""
    k = max(0, len(tokens) - WINDOW + 1)
    if not k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    h, exact, literal = np.zeros(k, np.uint64), np.zeros(k, np.uint64), np.zeros(k, np.int64)
    for i in range(WINDOW):
        h += tokens[i : i + k] * _C[i]
        exact += value[i : i + k] * _C_VALUE[i]
        literal += ~slot[i : i + k]
    at = np.flatnonzero(row[:k] == row[WINDOW - 1 :])
    rich = at[literal[at] >= LITERALS]
    return np.concatenate([rich, at]), mix(np.concatenate([h[rich], exact[at] + _C_VALUE[WINDOW]])), np.arange(len(rich) + len(at)) < len(rich)


def runs(row: np.ndarray, value: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first token, hash) of every ``size`` values in a row within a text."""
    k = max(0, len(value) - size + 1)
    h = np.full(k, size, np.uint64)
    for i in range(size):
        h += value[i : i + k] * _C_VALUE[i]
    at = np.flatnonzero(row[:k] == row[size - 1 : size - 1 + k])
    return at, mix(h[at])


def _lookup(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into ``h``, index into the sorted ``keys``) of all equal pairs."""
    lo, hi = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
    n = hi - lo
    return np.repeat(np.arange(len(h)), n), np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


class Table:
    """A block of benchmark items as sorted window hashes with their tokens."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.ids = [i for i, _ in items]
        buf, off = column_bytes(pa.array([t for _, t in items], pa.string()))
        if len(buf):
            self.row, self.value, self.token, self.slot, _ = template(buf, off)
        else:
            self.row, self.value, self.token, self.slot = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)
        at, h, rich = windows(self.row, self.value, self.token, self.slot)
        order = np.argsort(h, kind="stable")
        self.at = at[order]
        self.keys, rank = np.unique(h[order], return_inverse=True)
        self.places = rank.reshape(-1) * len(items) + self.row[self.at]  # ascending: by hash, then item
        self.size = np.bincount(self.row, minlength=len(items))
        self.literals = np.bincount(self.row[~self.slot], minlength=len(items))
        self.begin = np.cumsum(self.size) - self.size
        self.dense = np.setdiff1d(at[~rich], at[rich])  # windows of few literals, in item order
        self.dense_of = np.bincount(self.row[self.dense], minlength=len(items))
        self.short = {}  # by number of tokens: sorted hashes of whole items and their indices
        for k in range(1, WINDOW):
            at, h = runs(self.row, self.value, k)
            whole = self.size[self.row[at]] == k
            if whole.any():
                order = np.argsort(h[whole], kind="stable")
                self.short[k] = h[whole][order], self.row[at[whole]][order]
        self.flags = np.zeros(1 << 20, bool)
        self.flags[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def match_short(self, row: np.ndarray, value: np.ndarray, alone: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """As ``match``, for the items of fewer tokens than a window."""
        found = []
        for k, (keys, items) in self.short.items():
            at, h = runs(row, value, k)
            if k == 1:
                at, h = at[alone[at]], h[alone[at]]
            i, j = _lookup(keys, h)
            pairs = np.unique(row[at[i]] * len(self.ids) + items[j])
            found += [(int(p) // len(self.ids), int(p) % len(self.ids), k, k, 0) for p in pairs]
        return found

    def extended(self, here: np.ndarray, there: np.ndarray, row: np.ndarray, value: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The windows of few literals that equal the item's template, with other values, in line with the given windows."""
        item = self.row[there]
        lines = np.unique(np.stack([here - there, item, row[here]], axis=1)[self.dense_of[item] > 0], axis=0)
        found, steps = [(here[:0], there[:0])], np.arange(WINDOW)
        first = np.cumsum(self.dense_of) - self.dense_of
        n = self.dense_of[lines[:, 1]]
        total, i = np.cumsum(n), 0
        while i < len(lines):
            j = max(i + 1, int(np.searchsorted(total, total[i] - n[i] + PIECE // 4, "right")))
            part, m = lines[i:j], n[i:j]
            w = self.dense[np.repeat(first[part[:, 1]], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)]
            x, r = w + np.repeat(part[:, 0], m), np.repeat(part[:, 2], m)
            inside = (x >= 0) & (x + WINDOW <= len(row))
            x, w, r = x[inside], w[inside], r[inside]
            same = (row[x] == r) & (row[x + WINDOW - 1] == r) & (token[x[:, None] + steps] == self.token[w[:, None] + steps]).all(axis=1)
            x, w = x[same], w[same]
            other = (value[x[:, None] + steps] != self.value[w[:, None] + steps]).any(axis=1)
            found.append((x[other], w[other]))
            i = j
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))

    def match(self, row: np.ndarray, value: np.ndarray, token: np.ndarray, slot: np.ndarray, alone: np.ndarray, coverage: float, most: int = MOST) -> list[tuple[int, int, int, int, int]]:
        """(row, item index, tokens covered, tokens of the item, slots whose value differs) of every leak. Windows that many
        items share are expanded for some texts and items at a time, ``most`` matches or one text and item."""
        short = self.match_short(row, value, alone)
        at, h, rich = windows(row, value, token, slot)
        likely = self.flags[(h >> np.uint64(44)).astype(np.int64)]
        at, h, rich = at[likely], h[likely], rich[likely]
        rank = np.searchsorted(self.keys, h)
        known = rank < len(self.keys)
        known[known] = self.keys[rank[known]] == h[known]
        at, rank, rich = at[known], rank[known] * len(self.ids), rich[known]
        todo, found = [(np.arange(len(at)), 0, len(self.ids))] if len(at) else [], []
        while todo:
            some, begin, end = todo.pop()
            lo, hi = (np.searchsorted(self.places, rank[some] + p, "left") for p in (begin, end))
            n = hi - lo
            texts = row[at[some]]
            if n.sum() > most and (texts.min() < texts.max() or end - begin > 1):
                if texts.min() < texts.max():
                    left = texts <= (texts.min() + texts.max()) // 2
                    todo += [(some[left], begin, end), (some[~left], begin, end)]
                else:
                    todo += [(some, begin, (begin + end) // 2), (some, (begin + end) // 2, end)]
                continue
            i, j = np.repeat(some, n), np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            found += self.leaking(at[i], self.at[j], rich[i], row, value, token, slot, coverage)
        return short + found

    def leaking(self, here: np.ndarray, there: np.ndarray, rich: np.ndarray, row: np.ndarray, value: np.ndarray, token: np.ndarray, slot: np.ndarray, coverage: float) -> list[tuple[int, int, int, int, int]]:
        """The leaks among some texts and items whose equal windows are given: first tokens, and whether by template."""
        new = rich.copy()  # a window that matches both ways counts once
        steps = np.arange(WINDOW)
        new[~rich] = (token[here[~rich][:, None] + steps] != self.token[there[~rich][:, None] + steps]).any(axis=1) | np.isin(there[~rich], self.dense)
        here, there, rich = here[new], there[new], rich[new]
        if not len(here):
            return []
        x, w = self.extended(here[rich], there[rich], row, value, token)
        direct = np.arange(len(here) + len(x)) < len(here)
        here, there = np.concatenate([here, x]), np.concatenate([there, w])
        pair = row[here] * len(self.ids) + self.row[there]
        # pairs that could not cover enough if no window were dropped
        seen = np.unique(np.stack([np.repeat(pair, WINDOW), (there[:, None] + np.arange(WINDOW)).ravel()], axis=1), axis=0)
        pairs, counts = np.unique(seen[:, 0], return_counts=True)
        keep = np.isin(pair, pairs[counts >= coverage * self.size[pairs % len(self.ids)]])
        here, there, pair, direct = here[keep], there[keep], pair[keep], direct[keep]
        if not len(here):
            return []
        best: dict[int, tuple[int, int]] = {}

        def judge(group: np.ndarray, of: np.ndarray, which: np.ndarray) -> np.ndarray:
            """Note the leaks among the occurrences and return which windows were dropped."""
            ok, differing = self.consistent(group, here[which], there[which], value, slot)
            for g, c in self.covering(group[ok], of, there[which][ok], direct[which][ok], coverage):
                p, new = int(of[g]), (c, -differing.get(g, 0))
                best[p] = max(best.get(p, new), new)
            return ~ok

        every = np.arange(len(here))
        pairs, group = np.unique(pair, return_inverse=True)
        dropped = judge(group.reshape(-1), pairs, every)
        which = np.flatnonzero(np.isin(pair, pair[dropped]))
        if len(which):
            item = self.row[there[which]]
            line, size = here[which] - there[which] + self.begin[item], self.size[item]
            for occurrence in (line, line // size, (line + size // 2) // size):
                groups, group = np.unique(np.stack([pair[which], occurrence], axis=1), axis=0, return_inverse=True)
                judge(group.reshape(-1), groups[:, 0], which)
        return [(p // len(self.ids), p % len(self.ids), c, int(self.size[p % len(self.ids)]), -d) for p, (c, d) in best.items()]

    def consistent(self, group: np.ndarray, here: np.ndarray, there: np.ndarray, value: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, dict[int, int]]:
        """Which windows agree with the prevailing values of their group, and the slots that have another value, by group."""
        steps = np.arange(WINDOW)
        w, i = np.nonzero(slot[here[:, None] + steps])
        ok, differing = np.ones(len(here), bool), {}
        if len(w):
            rows = np.stack([group[w].astype(np.uint64), self.value[there[w] + i], value[here[w] + i]], axis=1)
            combos, inverse, count = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
            inverse = inverse.reshape(-1)
            order = np.lexsort((combos[:, 2], -count, combos[:, 1], combos[:, 0]))
            best = np.zeros(len(combos), bool)
            best[order] = np.concatenate([[True], (combos[order][1:, :2] != combos[order][:-1, :2]).any(axis=1)])
            np.logical_and.at(ok, w, best[inverse])
            for g in combos[best & (combos[:, 1] != combos[:, 2])][:, 0]:
                differing[int(g)] = differing.get(int(g), 0) + 1
        return ok, differing

    def covering(self, group: np.ndarray, of: np.ndarray, there: np.ndarray, direct: np.ndarray, coverage: float) -> Iterator[tuple[int, int]]:
        """(group, tokens covered) of the groups of windows that cover enough of the item."""
        covered = np.stack([np.repeat(group, WINDOW), (there[:, None] + np.arange(WINDOW)).ravel()], axis=1)
        full = np.unique(covered, axis=0)
        counts = np.bincount(full[:, 0], minlength=len(of))
        literal = np.bincount(full[:, 0], ~self.slot[full[:, 1]], len(of))
        plain = np.bincount(np.unique(covered[np.repeat(direct, WINDOW)], axis=0)[:, 0], minlength=len(of))
        sizes, literals = self.size[of % len(self.ids)], self.literals[of % len(self.ids)]
        leak = (plain >= coverage * sizes) | (counts >= coverage * sizes) & (literal >= coverage * literals)
        for g in np.flatnonzero(leak & (counts > 0)):
            yield int(g), int(counts[g])


def leaks_in(column: pa.Array, table: Table, coverage: float) -> Iterator[tuple[int, int, int, int, int]]:
    """Leaks of a batch of whole texts; short texts are hashed together, a long one by itself."""
    buf, off = column_bytes(column)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + PIECE, "right")) - 1)
        if off[j] > off[i]:
            for r, *rest in table.match(*template(buf[off[i] : off[j]], off[i : j + 1]), coverage):
                yield i + r, *rest
        i = j


def _blocks(benchmark: DataFrame) -> Iterator[Table]:
    """The benchmark in blocks of at most BLOCK_BYTES of text (or one longer item), streamed to the driver one by one."""
    items, held = [], 0
    rows = benchmark.select("item_id", "text").where("text is not null").orderBy(F.col("item_id").asc_nulls_first(), "text")
    for r in rows.toLocalIterator():
        size = len(r["text"].encode())
        if items and held + size > BLOCK_BYTES:
            yield Table(items)
            items, held = [], 0
        items.append((r["item_id"], r["text"]))
        held += size
    if items:
        yield Table(items)


def find_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """A row for each document and benchmark item whose template it repeats: doc_id, item_id, covered and n_tokens (of the
    item), new_values (slots of the item that the document fills otherwise; 0: verbatim but for punctuation and case).

    Items of fewer than five tokens match as a whole; null texts, empty texts and items without tokens match nothing; repeated documents and items each give
    rows of their own; null ids are carried. An empty benchmark or corpus gives no rows.
    """
    spark, base = docs.sparkSession, docs.select("doc_id", "text")
    out = spark.createDataFrame([], "doc_id long, item_id long, covered long, n_tokens long, new_values long")
    for table in _blocks(benchmark):
        shared = spark.sparkContext.broadcast(table)  # at most BLOCK_BYTES of text

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            t = shared.value
            for batch in batches:
                ids = batch.column(0)
                rows = [(ids[r].as_py(), t.ids[i], c, s, d) for r, i, c, s, d in leaks_in(batch.column(1), t, coverage)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [[]] * 5)], ["doc_id", "item_id", "covered", "n_tokens", "new_values"])

        out = out.union(base.mapInArrow(scan, out.schema))
    return out


def remove_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs`` that repeat no benchmark item, with all their columns."""
    where = docs.columns.index("text")
    out = docs
    for table in _blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(table)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[r for r, *_ in leaks_in(batch.column(where), shared.value, coverage)]] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(scan, docs.schema)
    return out
