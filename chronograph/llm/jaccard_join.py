"""N-gram Jaccard self-join with rare-first prefix filtering, and its connected components.

A document's set is its distinct word shingles. Documents with equal sets are one node from the start, named by their
smallest id. Then:

1. Document frequencies. Each chunk of documents (a few million shingles) sends every distinct shingle once, as a packed
   32-bit remainder with a count, to hash buckets, whose number follows the corpus; a bucket adds up and sends back a byte of
   rarity for each. A shingle that a third of all documents share costs a bucket one entry per chunk, not per document.
2. Prefixes. Shingles are ordered rare first. Two sets of similarity t share one of the first n - ceil(t*n) + 1; those
   that occur once can't be shared, so only the rest of the prefix is posted.
3. Candidates. Postings meet by token. Length and positional filters come first, then the suffix filter: two bounds on
   the symmetric difference, from the parities of 512 hash cells and from the counts of 64 hash ranges.
   A first round pairs each token's most connected node with the others (as many pairs as postings), verifies, and
   contracts components; a second compares what is still apart in blocks of bounded size and like set sizes, the blocks of a
   common token in a grid of tasks, so a group of thousands of near copies does not become all its pairs.
4. Verification. Each remaining pair is verified once, on the whole shingle sets of its two representatives.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronograph.llm.components import components
from chronograph.llm.storage import drop, materialize, settings, unused
from chronograph.llm.text import hashed_words, mix, shingles

CHUNK = 700_000  # shingles whose frequencies are looked up together
PER_BUCKET = 700_000  # shingles counted together
BATCH = "4m"  # bytes of text sent to Python at once, or one longer document
BLOCK = 128  # postings compared at once
HOT_NODES = 100_000  # sets that are broadcast at most, as they have so many copies
CELLS, RANGES = 512, 64
_POP = np.array([bin(i).count("1") for i in range(256)], np.int64)


def _sets(column: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for i, j, h, row in hashed_words(column):
        s, r = shingles(h, row, size, j - i)
        yield i, j, s, r


def _nodes(s: np.ndarray, r: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit identity of each row's set, and its size."""
    n = np.bincount(r, minlength=rows)
    cut = np.concatenate([[0], np.cumsum(n)])
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(s ^ np.uint64(0xA5A5)), dtype=np.uint64)])
    return mix(sums[cut[1:]] - sums[cut[:-1]] + n.astype(np.uint64)), n


def _signatures(s: np.ndarray, r: np.ndarray, rows: int) -> np.ndarray:
    """Per row: the parity of each of CELLS hash cells (bits), then the count in each of RANGES hash ranges (mod 256)."""
    cells = np.bincount(r * CELLS + (s & np.uint64(CELLS - 1)).astype(np.int64), minlength=rows * CELLS).reshape(rows, CELLS)
    ranges = np.bincount(r * RANGES + ((s >> np.uint64(20)) & np.uint64(RANGES - 1)).astype(np.int64), minlength=rows * RANGES).reshape(rows, RANGES)
    return np.concatenate([np.packbits((cells & 1).astype(np.uint8), axis=1), ranges.astype(np.uint8)], axis=1)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A lower bound of the symmetric difference of two sets, from their signatures."""
    parity = _POP[x[..., : CELLS // 8] ^ y[..., : CELLS // 8]].sum(axis=-1)
    d = x[..., CELLS // 8 :] - y[..., CELLS // 8 :]
    counts = np.minimum(d, 0 - d).astype(np.int64).sum(axis=-1)
    return np.maximum(parity, counts)


class _Threshold:
    """Exact integer forms of Jaccard >= num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def prefix(self, n):
        return n - (n * self.num + self.den - 1) // self.den + 1

    def overlap(self, n):
        """The least overlap of two sets whose sizes add up to n."""
        return (self.num * n + self.num + self.den - 1) // (self.num + self.den)

    def sizes_fit(self, x: str, y: str) -> Column:
        return F.expr(f"least({x}, {y}) * {self.den} >= greatest({x}, {y}) * {self.num}")

    def positions_fit(self, x: str, xp: str, y: str, yp: str) -> Column:
        return F.expr(f"1 + least({x} - {xp} - 1, {y} - {yp} - 1) >= ({self.num} * ({x} + {y}) + {self.num + self.den - 1}) div {self.num + self.den}")


def _number(rows: int) -> type:
    """The kind of number that holds a row of a chunk and a count of its rows."""
    return np.uint16 if rows < 1 << 16 else np.uint32


_ROW = "kind int, doc_id long, node long, n int, sig binary, token long, pos int, live int"


def _postings(docs: DataFrame, size: int, t: _Threshold) -> DataFrame:
    """Rows of kind 0 (doc_id, node, n, sig), one per document, and of kind 1 (token, node, n, pos, live): the shared
    shingles of the prefixes."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(4, math.ceil(math.log2(max(1, total / 6 / PER_BUCKET))))
    shift = np.uint64(64 - bits - 32)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, chunk, held, seen = TaskContext.get().partitionId(), 0, 0, set()
        ids, nodes, sizes, sigs, hashes, rows, base = [], [], [], [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal chunk, held, base, ids, nodes, sizes, sigs, hashes, rows
            if not ids:
                return
            known = pa.concat_arrays(ids)
            head = [np.array([len(known)], np.int64), known.fill_null(0).to_numpy(), known.is_valid().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate(nodes).view(np.int64), np.concatenate(sizes).astype(np.int64)]
            blob = np.concatenate(head).tobytes() + np.concatenate(sigs).tobytes()
            h, r = np.concatenate(hashes), np.concatenate(rows)
            order = np.argsort(h, kind="stable")
            keys, r = h[order] >> shift, r[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
            times = np.diff(np.append(first, len(keys)))
            keys = keys[first]
            kind = _number(len(known))
            blob += np.array([len(keys)], np.int64).tobytes() + times.astype(kind).tobytes() + r.astype(kind).tobytes()
            del h, order, r
            bucket = (keys >> np.uint64(32)).astype(np.int64)
            rest, seen_in = keys.astype(np.uint32), np.minimum(times, 255).astype(np.uint8)
            starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
            ends = np.append(starts[1:], len(bucket))[: len(starts)]
            keys, blobs = [-1], [blob]
            for a, b in zip(starts, ends, strict=True):
                keys.append(int(bucket[a]))
                blobs.append(rest[a:b].tobytes() + seen_in[a:b].tobytes())
            name = part * (1 << 32) + chunk
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.int64()), pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())], ["chunk", "bucket", "blob"])
            chunk, held, base, ids, nodes, sizes, sigs, hashes, rows = chunk + 1, 0, 0, [], [], [], [], [], []

        for batch in batches:
            for i, j, s, r in _sets(batch.column(1), size):
                node, n = _nodes(s, r, j - i)
                ids.append(batch.column(0).slice(i, j - i))
                valid = ids[-1].is_valid().to_numpy(zero_copy_only=False)
                fresh = np.zeros(j - i, bool)
                for k, x in enumerate(node.tolist()):
                    if valid[k] and n[k] and x not in seen:
                        seen.add(x)
                        fresh[k] = True
                nodes.append(node)
                sizes.append(n)
                sigs.append(_signatures(s, r, j - i))
                mine = fresh[r]
                hashes.append(s[mine])
                rows.append((r[mine] + base).astype(np.uint32))
                base += j - i
                held += int(mine.sum())
                if held >= CHUNK or base >= 50_000:
                    yield from flush()
        yield from flush()

    def count(table: pa.Table) -> pa.Table:
        """A byte of rarity for each entry, 0 for a shingle of one set, and the remainders of the others."""
        bucket = table.column("bucket")[0].as_py()
        if bucket < 0:
            return table
        blobs = [x.as_buffer() for x in table.column("blob")]
        rests = [np.frombuffer(x, np.uint32, len(x) // 5) for x in blobs]
        times = np.concatenate([np.frombuffer(x, np.uint8, len(r), 4 * len(r)) for x, r in zip(blobs, rests, strict=True)])
        _, inverse = np.unique(np.concatenate(rests), return_inverse=True)
        inverse = inverse.reshape(-1)
        rarity = np.minimum(255, np.floor(8 * np.log2(np.bincount(inverse, times)))).astype(np.uint8)[inverse]
        out, at = [], 0
        for rest in rests:
            q = rarity[at : at + len(rest)]
            at += len(rest)
            out.append(np.array([len(rest)], np.int64).tobytes() + q.tobytes() + rest[q > 0].tobytes())
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "blob": pa.array(out, pa.binary())})

    def post(table: pa.Table) -> pa.Table:
        token, rarity, head = [], [], b""
        for bucket, blob in sorted(zip(table.column("bucket").to_pylist(), table.column("blob"), strict=True), key=lambda x: x[0]):
            blob = blob.as_buffer()
            if bucket < 0:
                head = blob
                continue
            k = int(np.frombuffer(blob, np.int64, 1)[0])
            q = np.frombuffer(blob, np.uint8, k, 8)
            t_ = np.zeros(k, np.uint64)
            t_[q > 0] = (np.uint64(bucket) << np.uint64(32)) | np.frombuffer(blob[8 + k :], np.uint32).astype(np.uint64)
            token.append(t_)
            rarity.append(q)
        d = int(np.frombuffer(head, np.int64, 1)[0])
        ids, valid, node, n = (np.frombuffer(head, np.int64, d, 8 + 8 * d * k) for k in range(4))
        width = CELLS // 8 + RANGES
        sigs = np.frombuffer(head, np.uint8, d * width, 8 + 32 * d).reshape(d, width)
        tail = head[8 + (32 + width) * d :]
        k = int(np.frombuffer(tail, np.int64, 1)[0])
        kind = _number(d)
        times, row = np.frombuffer(tail, kind, k, 8), np.frombuffer(tail[8 + kind().itemsize * k :], kind)
        none = lambda k, kind: pa.nulls(k, kind)
        docs_part = [pa.array(np.zeros(d, np.int32)), pa.array(ids, mask=valid == 0), pa.array(node), pa.array(n.astype(np.int32)), pa.array([x.tobytes() for x in sigs], pa.binary()), none(d, pa.int64()), none(d, pa.int32()), none(d, pa.int32())]
        if not token:
            return pa.table(docs_part, names)
        token, rarity = np.repeat(np.concatenate(token), times), np.repeat(np.concatenate(rarity), times)
        token, row, rarity = token[rarity > 0], row[rarity > 0].astype(np.int64), rarity[rarity > 0]
        order = np.lexsort((token, rarity, row))
        token, row = token[order], row[order]
        several = np.bincount(row, minlength=d)
        single = n - several
        rank = np.arange(len(row)) - (np.cumsum(several) - several)[row]
        take = np.maximum(0, t.prefix(n) - single)
        ok = rank < take[row]
        token, row, pos = token[ok], row[ok], (single[row] + rank)[ok]
        k = len(row)
        posts = [pa.array(np.ones(k, np.int32)), none(k, pa.int64()), pa.array(node[row]), pa.array(n[row].astype(np.int32)), none(k, pa.binary()), pa.array(token.astype(np.int64)), pa.array(pos.astype(np.int32)), pa.array(np.minimum(take, several)[row].astype(np.int32))]
        return pa.concat_tables([pa.table(docs_part, names), pa.table(posts, names)])

    names = ["kind", "doc_id", "node", "n", "sig", "token", "pos", "live"]
    packed = docs.select("doc_id", "text").mapInArrow(pack, "chunk long, bucket long, blob binary")
    spread = packed.withColumn("key", F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(-1 - F.col("chunk")))  # a head goes alone
    counted = spread.groupBy("key").applyInArrow(lambda x: count(x.drop_columns(["key"])), "chunk long, bucket long, blob binary")
    return counted.groupBy("chunk").applyInArrow(post, _ROW)


def _with_signatures(pairs: DataFrame, nodes: DataFrame, t: _Threshold) -> DataFrame:
    """The pairs (a, b) that pass the suffix filter."""
    x = nodes.select(F.col("node").alias("a"), F.col("n").alias("an"), F.col("sig").alias("asig"))
    y = nodes.select(F.col("node").alias("b"), F.col("n").alias("bn"), F.col("sig").alias("bsig"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = CELLS // 8 + RANGES
        for batch in batches:
            n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            sig = [np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, width) for k in (4, 5)]
            ok = _apart(*sig) <= n - 2 * t.overlap(n)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return pairs.join(x, "a").join(y, "b").select("a", "b", "an", "bn", "asig", "bsig").mapInArrow(near, "a long, b long")


def _verify(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, size: int, t: _Threshold) -> DataFrame:
    """The pairs whose sets are similar, each compared once on the whole sets. Sets are made only for documents that a
    bitmap of fixed size says may be needed; an exact join follows."""
    bits = 24
    cell = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))
    needed = materialize(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(nodes.select("node", "same"), "node"), "needed")
    maps = needed.select((cell("node") + 1).alias("c")).groupBy(F.bitmap_bucket_number("c").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("c")).alias("m")).collect()
    # the functions count positions from 1
    bitmap = np.zeros(((1 << bits) >> 3) + 4096, np.uint8)
    for row in maps:
        bitmap[(row["k"] - 1) * 4096 : row["k"] * 4096] = np.frombuffer(row["m"], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((shared.value[c >> 3] >> (c & 7) & 1).astype(bool)))
            for i, j, s, r in _sets(batch.column(1), size):
                node, n = _nodes(s, r, j - i)
                cut = np.concatenate([[0], np.cumsum(n)])
                blobs = [s[cut[k] : cut[k + 1]].tobytes() for k in range(j - i)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(node.view(np.int64)), pa.array(blobs, pa.binary())], ["node", "same", "s"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok[k] = t.den * both >= t.num * (len(x) + len(y) - both)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    source = docs.where("doc_id is not null").select("doc_id", "text", cell("doc_id").alias("c"))
    sets = source.mapInArrow(make, "node long, same long, s binary").join(needed, ["node", "same"]).select("node", "s").dropDuplicates(["node"])
    sets = materialize(sets, "sets")
    x = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("x")), "a")
    both = x.join(sets.select(F.col("node").alias("b"), F.col("s").alias("y")), "b")
    links = materialize(both.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long"), "links")
    drop(needed, sets)
    return links


def _in_blocks(live: DataFrame, nodes: DataFrame, labels: DataFrame, t: _Threshold) -> DataFrame:
    """Pairs of nodes of different components that share a token and pass all filters. Sizes are classed so that only sets
    of one class or of neighbouring ones can be similar; the blocks of a token meet in a grid of tasks."""
    x = live.join(labels, "node", "left").select("token", "node", "n", "pos", F.coalesce("label", "node").alias("c"))
    open_ = x.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("token")
    width = math.log(t.den / t.num) * (1 + 1e-9)
    x = x.join(open_, "token").withColumn("size", F.floor(F.log("n") / width) if width else F.col("n").cast("long"))
    x = materialize(x, "open")
    counts = x.groupBy("token", "size").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    grid = counts.groupBy("token").agg(F.ceil(F.sqrt(F.max("blocks"))).alias("grid"))
    x = x.join(counts, ["token", "size"]).join(grid, "token").join(nodes.select("node", "sig"), "node")
    x = x.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    blocks = x.groupBy("token", "size", "block", "grid").agg(F.collect_list(F.struct("node", "n", "pos", "c", "sig")).alias("members"))
    every, own = F.sequence(F.lit(0).cast("long"), F.col("grid") - 1), F.pmod("block", "grid")
    left = blocks.select("token", F.col("size").alias("link"), own.alias("g1"), F.explode(every).alias("g2"), F.col("block").alias("b1"), F.col("members").alias("m1"))
    right = blocks.select("token", "size", "block", "grid", "members", F.explode(F.array(F.col("size"), F.col("size") - 1)).alias("link"))
    right = right.select("token", "link", F.explode(every).alias("g1"), own.alias("g2"), F.col("block").alias("b2"), F.col("members").alias("m2"), (F.col("size") == F.col("link")).alias("alike"))

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = CELLS // 8 + RANGES

        def columns(cell):
            s = cell.values
            return [s.field(k).to_numpy() for k in ("node", "n", "pos", "c")] + [np.frombuffer(b"".join(s.field("sig").to_pylist()), np.uint8).reshape(-1, width)]

        for batch in batches:
            found = set()
            for itself, m1, m2 in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                x = columns(m1)
                y = x if itself else columns(m2)
                n1, n2 = x[1][:, None].astype(np.int64), y[1][None, :].astype(np.int64)
                ok = (x[3][:, None] != y[3][None, :]) & (np.minimum(n1, n2) * t.den >= np.maximum(n1, n2) * t.num)
                need = t.overlap(n1 + n2)
                ok &= 1 + np.minimum(n1 - x[2][:, None] - 1, n2 - y[2][None, :] - 1) >= need
                if itself:
                    ok = np.triu(ok, 1)
                i, j = np.nonzero(ok)
                if len(i):
                    close = _apart(x[4][i], y[4][j]) <= (n1[i, 0] + n2[0, j]) - 2 * need[i, j]
                    a, b = x[0][i[close]], y[0][j[close]]
                    found.update(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True))
            pairs = list(zip(*found, strict=True)) if found else [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()) for p in pairs], ["a", "b"])

    joined = left.join(right, ["token", "link", "g1", "g2"]).where("not alike or b1 <= b2").select((F.col("alike") & (F.col("b1") == F.col("b2"))).alias("itself"), "m1", "m2")
    return joined.mapInArrow(cross, "a long, b long").distinct()


def join_components(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every row of ``docs`` (doc_id,
    text), where documents link if den * |intersection| >= num * |union| of their sets of ``size``-word shingles.

    Words lose the case of A-Z. A text with fewer words is one shingle; a text without words, or null, has none and its
    component is its own id. A row without an id counts its shingles, links with nothing and has a null component.
    Repeated rows and rows that share an id are alike members of the components of their texts. An empty table gives no
    rows. Sets are compared by 64-bit hashes of shingles.
    """
    with settings(docs.sparkSession, {"spark.sql.execution.arrow.maxBytesPerBatch": BATCH}):
        members, named = _joined(docs.select("doc_id", "text"), size, _Threshold(num, den))
    return _with_components(members, named)


def _joined(base: DataFrame, size: int, t: _Threshold) -> tuple[DataFrame, DataFrame]:
    """The documents with their sets (doc_id, same, n), and the sets with their copies and component (same, copies, least)."""
    rows = materialize(_postings(base, size, t), "postings")
    members = rows.where("kind = 0")
    sets = members.where("doc_id is not null and n > 0").groupBy(F.col("node").alias("same")).agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.count("*").alias("copies"))
    nodes = materialize(sets, "nodes")
    posts = rows.where("kind = 1").select(F.col("node").alias("same"), "token", "n", "pos", "live").distinct()
    posts = materialize(posts.join(nodes.select("same", "node"), "same").select("token", "node", "n", "pos", "live"), "posts")
    hubs = posts.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.max(F.struct("live", "node", "n", "pos")).alias("hub"))
    hubs = hubs.where("lo <> hi").select("token", F.col("hub.node").alias("h"), F.col("hub.n").alias("hn"), F.col("hub.pos").alias("hpos"))
    live = materialize(posts.join(hubs, "token"), "live")
    drop(posts)
    first = live.where("node <> h").where(t.sizes_fit("n", "hn") & t.positions_fit("n", "pos", "hn", "hpos"))
    first = first.select(F.least("node", "h").alias("a"), F.greatest("node", "h").alias("b")).distinct()
    first = materialize(_with_signatures(first, nodes, t), "pairs")
    labels = materialize(components(_verify(first, base, nodes, size, t)), "labels")
    rest = materialize(_in_blocks(live.select("token", "node", "n", "pos"), nodes, labels, t).join(first, ["a", "b"], "left_anti"), "pairs")
    if rest.limit(1).count():
        labels = materialize(_merged(labels, _verify(rest, base, nodes, size, t)), "labels")
    named = nodes.select("same", "node", "copies").join(labels, "node", "left").select("same", "copies", F.coalesce("label", "node").alias("least"))
    return members.select("doc_id", F.col("node").alias("same"), "n"), materialize(named, "named")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after more links: only components are contracted, not their nodes anew."""
    of = lambda name: labels.select(F.col("node").alias(name), F.col("label").alias(f"{name}_label"))
    pairs = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    pairs = materialize(pairs.select("a", "b", F.coalesce("a_label", "a").alias("x"), F.coalesce("b_label", "b").alias("y")), "merged")
    joined = materialize(components(pairs.select(F.col("x").alias("a"), F.col("y").alias("b"))), "labels").toDF("label", "to")
    every = labels.union(pairs.select("a", "x")).union(pairs.select("b", "y")).distinct()
    return every.join(joined, "label", "left").select("node", F.coalesce("to", "label").alias("label"))


def _with_components(members: DataFrame, named: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id; sets with very many copies, HOT_NODES at most, are broadcast."""
    limit = max(1000, members.count() // HOT_NODES)
    hot = F.broadcast(named.where(F.col("copies") > limit).select("same", "least"))
    full = members.where("n > 0")
    some = full.join(hot, "same").union(full.join(hot, "same", "left_anti").join(named.where(F.col("copies") <= limit).select("same", "least"), "same", "left").select("same", "doc_id", "n", "least"))
    some = some.union(members.where("n = 0").select("same", "doc_id", "n", F.lit(None).cast("long")))
    component = F.when((F.col("n") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return some.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))


def one_of_each(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of ``docs`` of each component of rows, with all its columns: that of the smallest id, a null id last, and the
    first in the table of those that share it. Rows are compared one by one, whatever their ids, so near copies among rows
    that share an id or have none are found, and a text of its own stays. Rows without words stay, repeated ones too. An
    empty table gives no rows."""
    (r,) = unused([*docs.columns, "n", "component"], "_r")
    rows = materialize(docs.select("*", F.monotonically_increasing_id().alias(r)), "rows")
    found = join_components(rows.select(F.col(r).alias("doc_id"), "text"), size, num, den).toDF(r, "n", "component")
    first = found.where("n > 0").join(rows.select(r, "doc_id"), r).groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(r).alias("r")))["r"].alias(r))
    kept = first.select(r).union(found.where("n = 0").select(r))
    return rows.join(kept, r, "left_semi").select(*docs.columns)
