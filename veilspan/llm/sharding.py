"""Sharding by a hierarchical weighted hash tree, with DataFrame functions only.

Regions hold racks and racks hold shards; a subtree's weight is the sum of its shards'. A row descends from the root: at each
level every child draws -ln(u) / weight, with u in (0, 1) a hash of row and the child's path, and the row goes to the child
of the smallest draw, which happens in proportion to the weights. Only the children of the chosen subtree draw at the next
level, so a row costs regions + racks + shards of one path. A child's draw depends on its own path and weight alone: when
weights change in one subtree, rows move only into it or out of it at the level where it hangs, and rows that stay outside
keep their shard. ``grow`` hangs one more shard into a region of its own, so that whatever moves goes into the new shard.

Slots number each shard's rows without gaps: a running sum within (shard, bucket), buckets being a hash of the row, plus prefix
sums over the buckets' counts, a table of shards x buckets rows. Equal rows are counted before they are dealt, so neither a
shard nor a row that comes a billion times lands in one task whole.

Defined cases: a null id draws as the text 'null'; rows with the same id share a shard; a weight of 0 takes no rows; a tree
without weight is an error; a null text has no bytes; equal rows get different slots, in no particular order among them; an
empty table gives no rows; columns named shard, slot or grown_shard give way to the results.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspan.llm import common as C

#: Buckets a shard's rows are numbered in.
BUCKETS = 1024


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    weight: float = 1.0


def topology(shards: int, racks: int = 2, per_rack: int = 4) -> list[Shard]:
    """Shards of equal weight; each rack is filled before the next, each region before the next."""
    return [Shard(s // (racks * per_rack), s // per_rack % racks) for s in range(shards)]


def grow(tree: list[Shard], weight: float = 1.0) -> list[Shard]:
    """The tree with one more shard, the last, in a region of its own."""
    return [*tree, Shard(max((s.region for s in tree), default=-1) + 1, 0, weight)]


def _draw(key: Column, path: str, weight: float) -> Column:
    """-ln(u) / weight from 52 bits of a digest of path and row."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(path + "/"), key)), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / float(1 << 52)) / F.lit(float(weight))


def _descend(key: Column, nodes: dict, path: str) -> Column:
    """The shard number below this subtree: its children draw, then the one with the smallest draw descends."""
    draws = {name: _draw(key, f"{path}/{name}", weight) for name, (weight, _) in nodes.items()}
    below = {name: F.lit(child) if isinstance(child, int) else _descend(key, child, f"{path}/{name}") for name, (_, child) in nodes.items()}
    if len(nodes) == 1:
        return next(iter(below.values()))
    best = F.least(*(F.struct(d.alias("draw"), F.lit(name).alias("child")) for name, d in draws.items()))
    # The choice is made once, in a one-element array that the branches then read.
    branch = lambda c: reduce(lambda e, n: e.when(c == n, below[n]), list(nodes)[1:], F.when(c == next(iter(nodes)), below[next(iter(nodes))]))
    return F.coalesce(F.transform(F.array(best["child"]), branch)[0], F.lit(-1))  # never null, and known not to be


def place(key: Column, tree: list[Shard]) -> Column:
    """The shard number that ``key`` descends to."""
    regions: dict[int, dict[int, dict[int, float]]] = {}
    for i, s in enumerate(tree):
        if s.weight > 0:
            regions.setdefault(s.region, {}).setdefault(s.rack, {})[i] = s.weight
    if not regions:
        raise ValueError("no shard of the tree has a weight")
    nodes = {r: {k: (sum(own.values()), {i: (w, i) for i, w in own.items()}) for k, own in racks.items()} for r, racks in regions.items()}
    return _descend(key, {r: (sum(w for w, _ in racks.values()), racks) for r, racks in nodes.items()}, "root")


def bucket(key: Column, number_by: list[Column], buckets: int = BUCKETS) -> Column:
    """Which of a shard's buckets numbers the row."""
    digest = F.md5(F.concat_ws("/", key, *(F.coalesce(c.cast("string"), F.lit("null")) for c in number_by)))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")


def assign(df: DataFrame, key: str, tree: list[Shard], grown: list[Shard] | None = None, number_by: list[str] | None = None) -> DataFrame:
    """``df`` with shard, slot and, given a grown tree, grown_shard. ``number_by``: the columns that, with the key, tell rows
    apart and order them; all of them by default."""
    names = [c for c in df.columns if c.lower() not in ("shard", "slot", "grown_shard")]
    k = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    more = [F.col(c) for c in (number_by if number_by is not None else [c for c in names if c != key])]
    equal = df.groupBy(*names).agg(F.count("*").alias("__n"))
    out = equal.withColumns({"shard": place(k, tree), "grown_shard": place(k, grown) if grown else F.lit(None).cast("int"), "__bucket": bucket(k, more)})
    # Written, so that rows are hashed once and not again for the counts.
    out = C.written(out, "placed")
    counts = out.groupBy("shard", "__bucket").agg(F.sum("__n").alias("__rows"))
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("shard", "__bucket", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("shard", "__bucket").orderBy(k, *more).rowsBetween(Window.unboundedPreceding, -1)
    # At most shards x BUCKETS rows: broadcast.
    out = out.withColumn("__row", F.coalesce(F.sum("__n").over(within), F.lit(0))).join(F.broadcast(before), ["shard", "__bucket"])
    first = F.col("__before") + F.col("__row")
    return out.select(*names, "shard", "grown_shard", F.explode(F.sequence(first, first + F.col("__n") - 1)).alias("slot"))
