"""Approximate nearest neighbours by multi-index hashing.

Vectors become binary codes: signs after rotations learned on a bounded sample (iterative quantisation: rotate so that signs
lose least). Codes are cut into substrings of 16 bits, and one table over all rows indexes them by (substring, value). A code
that lies within s bits of a query's in some substring is found by probing the values that near; by pigeonhole that
retrieves every code within Hamming radius m * (s + 1) - 1 of m substrings, and those farther away that have one substring in
common. Of what is retrieved, codes beyond a second, wider radius are left out; the rest is ranked by distance on the original
vectors, in double precision.

Both radii are learned: from 0 up, s is the first whose probes retrieve the wanted share of the true neighbours of a bounded
sample of queries, found by brute force; the outer radius covers nearly all of them. So tables whose neighbours are close are
probed at one or a few values a substring, and only those whose neighbours are far at hundreds.

The index is dealt by the first bits of the values, so that a group of entries has a bounded size: a query visits the groups
whose first bits are near enough. Crowded groups are cut into parts and their queries into chunks, and all parts meet all
chunks. A pair that several substrings bring together is reported by the first of them alone, so pairs need no distinct.
Queries that find fewer than k are answered by a scan of all rows, in blocks, and only these.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do those whose length isn't
the commonest (the longest of equals); equal rows (id and vector) count once; an id with several vectors asks with the smallest; ties
go to the smaller id; other columns play no part, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspan.llm import common as C

U64 = np.uint64
#: Vectors that the rotations are learned on, queries that the radii are, and the shares of their neighbours that probing and
#: the outer radius must cover.
SAMPLE, TRIALS, PROBED, COVERED = 20_000, 64, 0.95, 0.99
#: Bits of a code and of a substring; bits of a substring that probes may differ in at most.
BITS, SUB, FAR = 384, 16, 4
#: Entries of a group and queries of a chunk that meet in one task; rows of a block of the scan.
ENTRIES, CHUNK, BLOCK = 1 << 16, 1 << 14, 8192


# ---------------------------------------------------------------- codes


def rotations(x: np.ndarray, bits: int, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """The sample's mean, and a d x bits matrix of learned rotations side by side."""
    mean = x.mean(axis=0)
    x, d, out = x - mean, x.shape[1], []
    make = np.random.default_rng(11)
    for _ in range(-(-bits // d)):
        r = np.linalg.qr(make.standard_normal((d, d)))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.sign(x @ r).T @ x)
            r = (u @ v).T
        out.append(r)
    return mean, np.concatenate(out, axis=1)[:, :bits]


def encode(x: np.ndarray, mean: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Codes as rows of 64-bit words."""
    bits = (x - mean) @ r > 0
    full = np.zeros((len(x), -(-r.shape[1] // 64) * 64), bool)
    full[:, : r.shape[1]] = bits
    return np.packbits(full, axis=1, bitorder="little").view("<u8")


@cache
def _near(bits: int, radius: int) -> np.ndarray:
    """All values of so many bits with at most ``radius`` of them set."""
    return np.array([sum(1 << b for b in c) for n in range(radius + 1) for c in combinations(range(bits), n)], np.int64)


def substrings(codes: np.ndarray) -> np.ndarray:
    """The codes' substrings as numbers, a row a code."""
    return np.ascontiguousarray(codes).view("<u2").astype(np.int64)


def apart(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Differing bits of each substring, a row a code."""
    return np.bitwise_count(np.ascontiguousarray(codes ^ code).view("<u2"))


class Index:
    """A group of the index: entries of one substring whose values share their first ``high`` bits, sorted by the others."""

    def __init__(self, values: np.ndarray, codes: np.ndarray, high: int):
        self.low = SUB - high
        low = values & (1 << self.low) - 1
        self.order = np.argsort(low, kind="stable")
        self.codes = codes[self.order]
        self.begins = np.r_[0, np.cumsum(np.bincount(low, minlength=1 << self.low))]

    def probe(self, value: int, radius: int) -> np.ndarray:
        """Places in ``codes`` of the entries whose last bits lie within the radius."""
        want = (value & (1 << self.low) - 1) ^ _near(self.low, min(radius, self.low))
        lo, size = self.begins[want], self.begins[want + 1] - self.begins[want]
        held = size > 0
        lo, size = lo[held], size[held]
        ends = np.cumsum(size)
        return np.repeat(lo - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


def search_group(sub: int, high: int, values: np.ndarray, codes: np.ndarray, asked: np.ndarray, near: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, entry) places of the pairs that differ in at most ``near`` bits of this substring and of none before it, and in
    at most ``radius`` bits of all."""
    index, queries, entries = Index(values, codes, high), [], []
    own = substrings(asked)[:, sub]
    first = int(values[0]) >> index.low if len(values) else 0
    for q in range(len(asked)):
        left = near - ((int(own[q]) >> index.low) ^ first).bit_count()
        if left < 0:
            continue
        at = index.probe(int(own[q]), left)
        at = at[np.bitwise_count(index.codes[at] ^ asked[q]).sum(axis=1) <= radius]
        if len(at) and sub:
            at = at[(apart(index.codes[at], asked[q])[:, :sub] > near).all(axis=1)]
        queries.append(np.full(len(at), q))
        entries.append(index.order[at])
    if not queries:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(queries), np.concatenate(entries)


def learned_radii(mine: np.ndarray, theirs: np.ndarray, bits: int) -> tuple[int, int]:
    """Bits that probes may differ in, and the outer radius, from pairs of codes that ought to meet."""
    if not len(mine):
        return 0, 0
    by = np.bitwise_count((mine ^ theirs).view("<u2"))
    closest, whole = by.min(axis=1), by.sum(axis=1)
    near = next((s for s in range(FAR) if (closest <= s).mean() >= PROBED), FAR)
    return near, min(bits, max(int(np.ceil(np.quantile(whole, COVERED))), bits // SUB * (near + 1) - 1))


def scan_block(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query, id, distance) of the k best of a block for each query."""
    out = []
    for i in range(len(q)):
        rows = np.flatnonzero(ids != q_ids[i])
        d = np.sqrt(((x[rows] - q[i]) ** 2).sum(axis=1))
        best = np.lexsort((ids[rows], d))[:k]
        out += [(int(q_ids[i]), int(ids[rows[j]]), float(d[j])) for j in best.tolist()]
    return out


# ---------------------------------------------------------------- operator


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Distinct (id, v) rows that take part, v of doubles."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.col(key).isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(~bad & F.exists(v, lambda x: x != 0))
    rows = rows.select(F.col(key).cast("long").alias("id"), v.cast("array<double>").alias("v"))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("v") == (sizes["d"] if sizes else 0)).groupBy("id", "v").agg(F.lit(1).alias("one")).drop("one")


def _true_neighbours(rows: DataFrame, trial: list, k: int) -> DataFrame:
    """Brute force for the trial queries: their k nearest, with vectors."""
    q_ids, q = np.array([t["id"] for t in trial]), np.array([t["v"] for t in trial])

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            ids, x = b["id"].to_numpy(), _matrix(b["v"])
            d = np.sqrt(np.maximum((x**2).sum(1)[None] + (q**2).sum(1)[:, None] - 2 * q @ x.T, 0))
            d[q_ids[:, None] == ids[None]] = np.inf
            best = np.argsort(d, axis=1, kind="stable")[:, :k]
            n = best.shape[1]
            at = best.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(q)), n)), pa.array(np.take_along_axis(d, best, 1).ravel()), pa.array([x[j] for j in at], pa.list_(pa.float64()))], ["q", "d", "v"])

    near = rows.mapInArrow(run, "q long, d double, v array<double>").where("d < double('infinity')")
    w = Window.partitionBy("q").orderBy("d")
    return near.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).select("q", "v")


_FOUND = "query_id long, vec_id long, score double"


def _table(found: list[tuple[int, int, float]]) -> pa.Table:
    return pa.table([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])


def probed(rows: DataFrame, asks: DataFrame, mean: np.ndarray, r: np.ndarray, near: int, radius: int) -> DataFrame:
    """query_id, vec_id and score of all pairs that the index brings together."""
    bits = r.shape[1]
    m, n = bits // SUB, rows.count()
    high = min(SUB, max(0, (n // ENTRIES).bit_length()))  # first bits of a value that choose the group

    def coded(batches):
        for b in batches:
            if b.num_rows:
                codes = encode(_matrix(b["v"]), mean, r)
                yield pa.RecordBatch.from_arrays([b["id"], b["h"], pa.array([c.tobytes() for c in codes], pa.binary())], ["id", "h", "code"])

    def entries(batches):
        """A row for each substring."""
        for b in batches:
            codes = _codes(b["code"], bits)
            values = substrings(codes).ravel()
            at = pa.array(np.repeat(np.arange(b.num_rows), m))
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(m, dtype=np.int32), b.num_rows)), pa.array((values >> SUB - high).astype(np.int32)), b["id"].take(at), b["h"].take(at), pa.array(values.astype(np.int32)), b["code"].take(at)], ["sub", "first", "id", "h", "value", "code"])

    def visits(batches):
        """A row for each group that a query visits."""
        steps = _near(high, min(near, high))
        for b in batches:
            for lo in range(0, b.num_rows, max(1, (1 << 20) // (m * len(steps)))):
                part = b.slice(lo, max(1, (1 << 20) // (m * len(steps))))
                groups = ((substrings(_codes(part["code"], bits)) >> SUB - high)[:, :, None] ^ steps).ravel()
                at = pa.array(np.repeat(np.arange(part.num_rows), m * len(steps)))
                subs = np.tile(np.repeat(np.arange(m, dtype=np.int32), len(steps)), part.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array(subs), pa.array(groups.astype(np.int32)), part["id"].take(at), part["code"].take(at)], ["sub", "first", "id", "code"])

    keyed = rows.select("id", F.xxhash64("v").alias("h"), "v")
    codes = C.written(keyed.mapInArrow(coded, "id long, h long, code binary"), "codes")
    asked = C.written(asks.select("id", F.lit(0).cast("long").alias("h"), "v").mapInArrow(coded, "id long, h long, code binary"), "asked")
    left = codes.mapInArrow(entries, "sub int, first int, id long, h long, value int, code binary")
    right = asked.mapInArrow(visits, "sub int, first int, id long, code binary")
    parts = left.groupBy("sub", "first").agg(F.ceil(F.count("*") / ENTRIES).cast("int").alias("parts"))
    chunks = right.groupBy("sub", "first").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    sizes = C.written(parts.join(chunks, ["sub", "first"]), "groups")
    to = lambda column: F.explode(F.sequence(F.lit(0), F.col(column) - 1))
    left = left.join(sizes, ["sub", "first"]).withColumn("part", F.pmod(F.xxhash64("id", "h"), F.col("parts")).cast("int")).withColumn("chunk", to("chunks")).drop("parts", "chunks")
    right = right.join(sizes, ["sub", "first"]).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).withColumn("part", to("parts")).drop("parts", "chunks")

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        q = e = np.zeros(0, np.int64)
        if a.num_rows and b.num_rows:
            q, e = search_group(a["sub"][0].as_py(), high, a["value"].to_numpy().astype(np.int64), _codes(a["code"], bits), _codes(b["code"], bits), near, radius)
        found = pa.table([b["id"].take(pa.array(q)), a["id"].take(pa.array(e)), a["h"].take(pa.array(e))], ["query_id", "id", "h"])
        return found.filter(pa.array(found["query_id"].to_numpy() != found["id"].to_numpy()))

    def ranked(batches):
        for b in batches:
            if b.num_rows:
                d = np.sqrt(((_matrix(b["v"]) - _matrix(b["q"])) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([b["query_id"], b["id"], pa.array(d)], ["query_id", "vec_id", "score"])

    keys = ["sub", "first", "part", "chunk"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "query_id long, id long, h long")
    met = met.join(keyed, ["id", "h"]).join(asks.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
    return met.select("query_id", "id", "v", "q").mapInArrow(ranked, _FOUND)


def _codes(column, bits: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, bits // 64)


def scanned(rows: DataFrame, asks: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id and score of the k best of each block of rows for each of ``asks``. Blocks and chunks of queries are
    dealt by hash and have a bounded size; each block meets each chunk in one task."""
    n, n_asks = rows.count(), asks.count()
    blocks, chunks = max(1, -(-n // BLOCK)), max(1, -(-n_asks // CHUNK))
    left = rows.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    right = asks.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        return _table(scan_block(a["id"].to_numpy(), _matrix(a["v"]), b["id"].to_numpy(), _matrix(b["v"]), k) if a.num_rows and b.num_rows else [])

    return left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(meet, _FOUND)


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, key: str = "vec_id", vector: str = "embedding", bits: int = BITS) -> DataFrame:
    """query_id, rank, vec_id, score for every row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = C.written(usable(vectors, key, vector), "vectors")
    asks = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    if asks.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asks = C.written(asks, "queries")
    sample = rows.orderBy(F.xxhash64("id", "v"), "id").limit(SAMPLE).select("v").toArrow()
    mean, r = rotations(_matrix(sample["v"]), bits)
    trial = asks.orderBy(F.xxhash64("id"), "id").limit(TRIALS).collect()
    near = _true_neighbours(rows, trial, k).collect()
    mine = encode(np.array([t["v"] for t in trial]), mean, r)[[x["q"] for x in near]]
    theirs = encode(np.array([x["v"] for x in near]).reshape(len(near), -1), mean, r) if near else mine
    # An id with several vectors counts by each of them: every row is a candidate of its own.
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    top = lambda found: found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    found = C.written(top(probed(rows, asks, mean, r, *learned_radii(mine, theirs, bits))), "found")
    enough = found.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("id"))
    short = C.written(asks.join(enough, "id", "left_anti"), "short")
    whole = found.join(enough.withColumnRenamed("id", "query_id"), "query_id", "left_semi")
    if not short.isEmpty():
        whole = whole.unionByName(top(scanned(rows, short, k)))
    return whole.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
