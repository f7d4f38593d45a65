"""A bounded sample of labelled rows for the classifiers, and one task that learns from it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm import common as C

#: UTF-8 bytes of the texts that are learnt from, at most; the first text is always.
BOUND_BYTES = 64 << 20
#: Labelled ids that are looked for among the documents, as a multiple of those wanted.
AHEAD = 2


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, key: str = "doc_id", text: str = "text", held_out: int = 0) -> DataFrame:
    """At most ``bound`` rows (text, y, h), of the ids that hash lowest outside the held-out fold. Rows without id or label,
    and ids labelled both ways, teach nothing; equal rows teach once; texts come whole."""
    y = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).where(C.fold(F.col(key)) != held_out)
    y = y.groupBy(F.col(key).alias("__id")).agg(F.min(label).alias("y"), F.max(label).alias("z")).where("y = z").select("__id", F.col("y").cast("int").alias("y"))
    y = y.withColumn("place", F.xxhash64("__id"))
    ids = docs.select(F.col(key).alias("__id"))

    def present(some: DataFrame) -> DataFrame:
        return ids.join(F.broadcast(some), "__id").groupBy("__id").agg(F.first("y").alias("y"), F.first("place").alias("place"))

    # The lowest hashes are looked for first, among all documents but for no more than so many ids; all labels only where
    # too few of these have a document.
    first = C.written(y.orderBy("place", "__id").limit(AHEAD * bound), "labelled")
    found = C.written(present(first), "labelled")
    if found.count() < bound and first.count() == AHEAD * bound:
        found = ids.distinct().join(y, "__id")
    # At most ``bound`` ids: broadcast.
    found = found.orderBy("place", "__id").limit(bound).drop("place")
    rows = docs.select(F.col(key).alias("__id"), F.col(text).alias("text")).join(F.broadcast(found), "__id")
    rows = rows.select("text", "y", F.xxhash64("__id", "text").alias("h"))
    return rows.dropDuplicates(["h", "text", "y"]).orderBy("h").limit(bound)


def learn(sample: DataFrame, fit, schema: str, bound_bytes: int = BOUND_BYTES) -> list:
    """Rows that ``fit(texts, y)`` (an iterator of record batches) gives from the sample in one task, in the order of h, until
    its texts have ``bound_bytes``."""
    import pyarrow as pa

    def run(batches):
        have, size = [], 0
        for b in batches:
            _, off = C.text_bytes(b["text"])
            n = int(np.searchsorted(off[1:] + size, bound_bytes, "right"))
            have.append(b.slice(0, n if have or n else 1))
            size += int(off[-1])
            if n < b.num_rows:
                break
        table = pa.Table.from_batches(have) if have else None
        if table is not None and table.num_rows:
            yield from fit(table["text"], table["y"].to_numpy())

    # A shuffle of the sample alone: coalescing would have one task scan all documents for it.
    return sample.repartition(1).sortWithinPartitions("h").select("text", "y").mapInArrow(run, schema).collect()
