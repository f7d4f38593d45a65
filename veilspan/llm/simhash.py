"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are 64 majority bits over a text's word shingles. Texts with one fingerprint are one class, so only distinct
fingerprints are compared. Fingerprints within the radius agree in at least one of radius + 1 or more blocks of bits
(pigeonhole): a row for each combination of blocks that must agree brings such pairs together. A bucket of rows that agree is cut into
tiles when it is large, and every two tiles of a bucket meet in one task of bounded size, so no pair is lost.

Within a meeting the bit planes stand vertically: plane b holds bit b of 64 fingerprints in a word. A fingerprint is compared
with all others at once: the planes that differ from it are added into bit-sliced counters by carry-save adders, counters
beyond the radius saturate, and a block of 64 is abandoned when all its lanes have. Links leave a meeting as a spanning forest.
Links of all meetings are joined to components by large and small stars over tables in the shared folder.

Defined cases: a null or empty text has no shingle and fingerprint 0, and links like any other; a text of fewer words than a
shingle has is one shingle; words and repeats count as they stand; rows without an id get a fingerprint and no component;
repeated rows and ids come out as often as they went in; other columns play no part, whatever their names.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspan.llm import common as C

U64 = np.uint64
BITS = 64
#: Rows of a tile, and rows of an average bucket from which more blocks are used.
TILE, CROWDED = 4096, 512
#: Fingerprints compared with a tile at once.
TOGETHER = 64


def fingerprint(text: str | None, width: int, seed: int) -> int:
    """Bits set in more than half of the shingles' XXH64 hashes."""
    import xxhash

    raw = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not raw:
        return 0
    joined = b" ".join(raw)
    ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = max(1, len(raw) - width + 1)
    ends = ends[width - 1 :] if len(raw) >= width else ends[-1:]
    digest = xxhash.xxh64_intdigest
    count = np.zeros(BITS, np.int64)
    for lo in range(0, n, 1 << 16):  # so that a long text's hashes are never all held
        hi = min(n, lo + (1 << 16))
        count += _set_bits(np.array([digest(joined[s:e], seed) for s, e in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist())], "<u8"))
    return _majority(count, n)


def _set_bits(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set."""
    return np.unpackbits(np.ascontiguousarray(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _majority(count: np.ndarray, n: int) -> int:
    return int(np.packbits(count * 2 > n, bitorder="little").view("<u8")[0])


def of_hashes(hashes: np.ndarray) -> int:
    """The fingerprint of shingles that are hashed already; 0 without any."""
    count = np.zeros(BITS, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        count += _set_bits(hashes[lo : lo + (1 << 16)])
    return _majority(count, len(hashes))


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and fp (long, the 64 bits)."""
    keep = C.kept(keep, ["fp"])
    own = C.free_name(keep, "__text")

    def run(batches):
        for b in C.slices(batches, own):
            f = np.array([fingerprint(t, width, seed) for t in b[own].to_pylist()], U64)
            yield pa.RecordBatch.from_arrays([*(b[k] for k in keep), pa.array(f.view(np.int64))], [*keep, "fp"])

    return docs.select(*keep, F.col(text).alias(own)).mapInArrow(run, C.typed(docs, keep, "fp long"))


# ---------------------------------------------------------------- bit-sliced comparison


def planes(fp: np.ndarray) -> np.ndarray:
    """BITS x words: bit b of 64 fingerprints in each word of row b."""
    n = -(-len(fp) // 64) * 64
    bits = np.unpackbits(np.ascontiguousarray(fp, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    full = np.zeros((n, BITS), np.uint8)
    full[: len(fp)] = bits
    return np.packbits(np.ascontiguousarray(full.T), axis=1, bitorder="little").view("<u8")


def _add(a, b, c):
    """Carry-save adder: sum and carry of three words of bits."""
    x = a ^ b
    return x ^ c, (a & b) | (x & c)


def within(queries: np.ndarray, own: np.ndarray, radius: int) -> np.ndarray:
    """queries x words: lanes whose fingerprint differs from the query in at most ``radius`` bits."""
    n, words = len(queries), own.shape[1]
    levels = max(1, radius.bit_length())
    flip = (queries[None, :] >> np.arange(BITS, dtype=U64)[:, None] & U64(1)) * ~U64(0)
    alive = None  # (query, word) pairs still in; at first all
    counters = [np.zeros((n, words), U64) for _ in range(levels)]
    over = np.zeros((n, words), U64)
    for lo in range(0, BITS, 8):
        if alive is None:
            d = [own[b][None, :] ^ flip[b][:, None] for b in range(lo, lo + 8)]
        else:
            d = [own[b][alive[1]] ^ flip[b][alive[0]] for b in range(lo, lo + 8)]
        # Eight planes become sums of weight 1, 2, 4 and 8 by adders, which then go into the counters.
        s1, c1 = _add(d[0], d[1], d[2])
        s2, c2 = _add(d[3], d[4], d[5])
        s3, c3 = _add(s1, s2, d[6])
        one, c4 = s3 ^ d[7], s3 & d[7]
        t1, e1 = _add(c1, c2, c3)
        two, e2 = t1 ^ c4, t1 & c4
        sums = [one, two, e1 ^ e2, e1 & e2]
        carry = np.zeros_like(over)
        for level in range(levels):
            counters[level], carry = _add(counters[level], sums[level] if level < 4 else np.zeros_like(over), carry)
        for x in [carry, *sums[levels:]]:
            over = over | x
        beyond = over | _greater(counters, radius)
        rest = ~beyond != 0
        if not rest.all():
            alive = np.nonzero(rest) if alive is None else (alive[0][rest], alive[1][rest])
            over, counters = over[rest], [c[rest] for c in counters]
            if not len(over):
                break
    out = np.zeros((n, words), U64)
    lanes = ~(over | _greater(counters, radius))
    if alive is None:
        return lanes
    out[alive] = lanes
    return out


def _greater(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is over the radius."""
    more, same = np.zeros_like(counters[0]), np.full_like(counters[0], ~U64(0))
    for level in range(len(counters) - 1, -1, -1):
        if radius >> level & 1:
            same = same & counters[level]
        else:
            more = more | (same & counters[level])
            same = same & ~counters[level]
    return more


class Forest:
    """Union-find over the rows of one meeting."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def meeting(fp: np.ndarray, tile: np.ndarray, radius: int, confirm=None) -> list[tuple[int, int]]:
    """A spanning forest of the links within one tile, or between two. Rows of tile 1 are compared with those of tile 0. With
    ``confirm(i, j)`` only rows of which it is true link; it is not asked about rows that are connected already."""
    forest, out = Forest(len(fp)), []

    def join(i, j):
        return (confirm is None or (forest.find(i) != forest.find(j) and confirm(i, j))) and forest.join(i, j)

    a = np.flatnonzero(tile == 0)
    b = np.flatnonzero(tile == 1) if tile.any() else a
    alone = b is a
    if len(a) * len(b) <= 4096:  # few: word-parallel planes don't pay
        d = np.bitwise_count(fp[b][:, None] ^ fp[a][None, :]) <= radius
        pairs = np.argwhere(np.tril(d, -1) if alone else d)
        return [(int(a[j]), int(b[i])) for i, j in pairs.tolist() if join(int(a[j]), int(b[i]))]
    own = planes(fp[a])
    for lo in range(0, len(b), TOGETHER):
        q = b[lo : lo + TOGETHER]
        lanes = within(fp[q], own, radius)
        query, word = np.nonzero(lanes)
        bits = np.unpackbits(np.ascontiguousarray(lanes[query, word]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        hit, lane = np.nonzero(bits)
        at = word[hit] * 64 + lane
        who = q[query[hit]]
        sound = at < len(a)
        if sound.sum() > 1024:  # most of a dense tile is joined already
            root = np.fromiter(map(forest.find, range(len(fp))), np.int64, len(fp))
            at = np.minimum(at, len(a) - 1)
            sound &= root[a[at]] != root[who]
        for j, i in zip(a[at[sound]].tolist(), who[sound].tolist()):
            if (j < i if alone else j != i) and join(j, i):
                out.append((j, i))
    return out


# ---------------------------------------------------------------- links


def _choices(rows: int, radius: int) -> list[list[tuple[int, int]]]:
    """Which blocks of bits must agree, as (first bit, bits): any radius + k blocks cover, k of which agree. More of them
    when buckets would be crowded; each choice is exact."""
    for k in range(1, 5):
        blocks = radius + k
        cuts = [i * BITS // blocks for i in range(blocks + 1)]
        if rows / 2.0 ** (BITS * k // blocks) <= CROWDED or k == 4:
            return [[(cuts[i], cuts[i + 1] - cuts[i]) for i in c] for c in combinations(range(blocks), k)]
    raise AssertionError


def links(nodes: DataFrame, radius: int) -> DataFrame:
    """``nodes``: node (long), fp (long), distinct. Links (a < b, nodes) that connect what lies within the radius."""
    rows = blocks(nodes, ["node", "fp"], radius)

    def pairs(tile, node, fp):
        return [(int(node[i]), int(node[j])) for i, j in meeting(fp.view(U64), tile, radius)]

    return meetings(rows, ["node", "fp"], TILE).mapInArrow(lambda batches: met(batches, ("tile", "node", "fp"), pairs), "a long, b long").distinct()


def blocks(nodes: DataFrame, keep: list[str], radius: int) -> DataFrame:
    """``nodes`` (fp and the columns to keep) once for each choice of blocks of bits that must agree; those bits are the bucket."""
    choices = _choices(nodes.count(), radius)
    fp = F.col("fp")

    def part(lo: int, n: int):
        return F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << n) - 1 if n < 63 else -1).cast("long"))

    keys = [F.struct(F.lit(i).alias("choice"), *(part(lo, n).alias(f"k{j}") for j, (lo, n) in enumerate(c))) for i, c in enumerate(choices)]
    return nodes.select(*keep, F.explode(F.array(*keys)).alias("bucket"))


def meetings(rows: DataFrame, keep: list[str], tile_rows: int) -> DataFrame:
    """``rows`` (node, other columns, bucket), dealt and sorted by group: the rows that meet. A large bucket's rows are cut into
    tiles, every two of which make a group."""
    large = rows.groupBy("bucket").agg(F.count("*").alias("n_rows")).where(F.col("n_rows") > tile_rows).select("bucket", F.ceil(F.col("n_rows") / tile_rows).cast("int").alias("tiles"))
    rows = rows.join(large, "bucket", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    mine = F.pmod(F.xxhash64(*keep[:2]), F.col("tiles")).cast("int")
    other = F.sequence(F.lit(0), F.col("tiles") - 1)
    # A row meets every tile of its bucket; in the meeting (x, y), x <= y, it stands in tile 0 if it is of x.
    dealt = rows.withColumn("mine", mine).select(*keep, "bucket", "mine", F.explode(other).alias("other"))
    dealt = dealt.select(*keep, F.struct("bucket", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y")).alias("meeting"), F.when(F.col("mine") <= F.col("other"), 0).otherwise(1).alias("tile"))
    dealt = dealt.withColumn("group", F.xxhash64("meeting")).select("group", "tile", *keep)
    return dealt.repartition(C.shuffle_partitions(rows.sparkSession), "group").sortWithinPartitions("group")


def met(batches, names: tuple[str, ...], pairs):
    """Links (a < b) that ``pairs`` finds among each group's rows; names: tile, node, and what else it takes."""

    def out(cols, edge):
        found = []
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
            if hi - lo > 1:
                found += pairs(*(c[lo:hi] for c in cols[1:]))
        if found:
            e = np.unique(np.sort(np.array(found, np.int64), axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(e[:, 0].copy()), pa.array(e[:, 1].copy())], ["a", "b"])

    rest = None
    for b in batches:
        cols = [np.asarray(b[c]) for c in ("group", *names)]
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest, cols)]
        edge = np.r_[0, np.flatnonzero(np.diff(cols[0])) + 1]
        yield from out(cols, edge)
        rest = [c[edge[-1] :] for c in cols]
    if rest is not None:
        yield from out(rest, np.array([0, len(rest[0])]))


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node with a link, by alternating large and small stars:
    links are re-hung on ever smaller nodes until each hangs on its component's smallest. Every round is a written table."""
    edges = C.written(edges.select("a", "b").where("a < b").distinct(), "links")
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    before = None
    while True:
        both = edges.union(edges.select("b", "a")).toDF("v", "n")
        low = both.groupBy("v").agg(F.least(F.min("n"), F.col("v")).alias("m"))
        large = both.where("n > v").join(low, "v").select(F.col("m").alias("a"), F.col("n").alias("b")).where("a < b").distinct()
        down = large.select(F.col("b").alias("v"), F.col("a").alias("n"))
        low = down.groupBy("v").agg(F.min("n").alias("m"))
        small = down.join(low, "v").select("m", F.col("n").alias("x")).union(low.select("m", F.col("v").alias("x")))
        edges = C.written(small.where("m < x").toDF("a", "b").distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_distinct("b")).first()
        if now == before:
            return edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component"))
        before = now


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4, seed: int = 42, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp, component_id for every row of ``docs``: which texts link, directly or through others."""
    rows = C.written(fingerprints(docs.select(key, text), width, seed, text, (key,)), "fingerprints")
    classes = rows.where(F.col(key).isNotNull()).groupBy("fp").agg(F.min(key).alias("node"))
    classes = C.written(classes, "classes")
    # A node is the smallest id of its fingerprint; an id that carries several fingerprints ties them together.
    found = components(links(classes, radius).union(_shared_ids(rows, classes, key)))
    named = classes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    out = rows.join(named, "fp", "left")
    return out.select(key, "fp", F.when(F.col(key).isNotNull(), F.col("component_id")).alias("component_id"))


def _shared_ids(rows: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """Links between the classes of an id that stands for several texts."""
    several = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x <> y").select(key)
    met = rows.join(several, key, "left_semi").join(classes, "fp").select(key, "node")
    low = met.groupBy(key).agg(F.min("node").alias("a"))
    return met.join(low, key).where("a < node").select("a", F.col("node").alias("b")).distinct()


def keep_first(docs: DataFrame, radius: int = 4, width: int = 4, seed: int = 42, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each group of near-duplicates the row with the smallest id, all its columns; rows without an id all stay."""
    return firsts(docs, near_duplicates(docs, radius, width, seed, key, text), key, text)


def firsts(docs: DataFrame, found: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of ``docs`` whose id is its component's in ``found``, each id once, and those without an id."""
    kept = found.where(F.col(key) == F.col("component_id")).select(key).distinct()
    named = docs.where(F.col(key).isNotNull()).join(kept, key, "left_semi")
    repeated = Window.partitionBy(key).orderBy(text)
    row = C.free_name(docs.columns, "__row")
    named = named.withColumn(row, F.row_number().over(repeated)).where(F.col(row) == 1).drop(row)
    return named.unionByName(docs.where(F.col(key).isNull()))


def hex_digits(fp) -> object:
    """16 lower-case hexadecimal digits of a long's 64 bits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def crowding(rows: int, radius: int) -> float:
    """Rows of an average bucket for a table of that many fingerprints (for tests and sizing)."""
    c = _choices(rows, radius)[0]
    return rows / 2.0 ** min(60, math.fsum(n for _, n in c))
