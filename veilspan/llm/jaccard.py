"""Near-duplicates by the Jaccard similarity of word shingles.

Texts get ``simhash``'s fingerprints, of majority bits over the shingles. As there, those within RADIUS bits agree in a choice
of blocks, meet in its bucket and are compared by bit planes; all of them are found, and confirmed by both whole sets of shingle
hashes, which lie in files of the shared folder.

A radius that holds similarity 0.8 would be about a quarter of the bits, where blocks of bits no longer tell texts apart. So
beyond the radius candidates come from MinHash too: BANDS keys of ROWS minima each, and texts meet where a key agrees. They are
confirmed by the same sets. A pair of similarity 0.8 that is farther apart than the radius misses every band with probability
(1 - 0.8 ** 5) ** 24 = 7e-5. Within a meeting, pairs that are connected already are left out. Large buckets are cut into tiles
as in ``simhash``.

Defined cases: as in ``simhash``; texts without a word are copies of each other.
"""

from __future__ import annotations

import secrets

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm import common as C
from veilspan.llm import simhash

U64 = np.uint64
WIDTH, LEAST = 5, 0.8
#: Bits in which fingerprints differ that are found by their blocks.
RADIUS = 4
BANDS, ROWS = 24, 5
#: Rows of a tile, and hashes of the sets that a meeting holds at once.
TILE, HELD = 1024, 1 << 20
_ODD = C.mix64(np.arange(1, BANDS * ROWS + 1, dtype=U64)) | U64(1)


def shingles(column: pa.Array | pa.ChunkedArray, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; a shorter text is one shingle."""
    h, at = C.words(*C.text_bytes(column))
    long = np.zeros(max(0, len(h) - width + 1), U64)
    for j in range(width):
        long += h[j : j + len(long)] * _ODD[j]
    long = C.mix64(long)
    out = []
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
        if hi - lo >= width:
            out.append(np.unique(long[lo : hi - width + 1]))
        else:
            out.append(C.mix64((h[lo:hi] * _ODD[: hi - lo]).sum(dtype=U64, keepdims=True) + U64(hi - lo)) if hi > lo else np.zeros(0, U64))
    return out


def bands(own: np.ndarray) -> np.ndarray:
    """The keys of a set of shingle hashes; none for an empty set."""
    if not len(own):
        return np.zeros(0, U64)
    low = np.full(BANDS * ROWS, ~U64(0))
    for lo in range(0, len(own), 1 << 13):
        low = np.minimum(low, (own[lo : lo + (1 << 13), None] * _ODD[None, :]).min(axis=0))
    return C.mix64((low.reshape(BANDS, ROWS) * _ODD[:ROWS]).sum(axis=1, dtype=U64) + _ODD[:BANDS])


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sets of sorted distinct hashes share that part of their union."""
    if min(len(a), len(b)) + 1e-9 < least * max(len(a), len(b)):
        return False
    both = np.sort(np.concatenate([a, b]))
    common = int((both[1:] == both[:-1]).sum())
    return common + 1e-9 >= least * (len(a) + len(b) - common)


def _read(folder: str, file: int, at: int, n: int) -> np.ndarray:
    path = C._local(folder)
    if path is not None:  # not mapped: pages of a mapping would count as the worker's memory
        return np.fromfile(f"{path}/sets-{file:016x}", "<u8", n, offset=8 * at)
    return C.map_file(folder, f"sets-{file:016x}")[8 * at : 8 * (at + n)].view("<u8")


def _holding(load):
    """``load(i)``, row i's set, with sets of HELD hashes kept."""
    held, n = {}, 0

    def own(i):
        nonlocal n
        if i not in held:
            if n > HELD:
                held.clear()
                n = 0
            held[i] = load(i)
            n += len(held[i])
        return held[i]

    return own


def meeting(load, n: np.ndarray, tile: np.ndarray, least: float) -> list[tuple[int, int]]:
    """A spanning forest of the similar pairs within one tile, or between two; ``load(i)`` has row i's set."""
    a = np.flatnonzero(tile == 0)
    b = np.flatnonzero(tile == 1) if tile.any() else a
    root, out, own = np.arange(len(n)), [], _holding(load)

    for place, i in enumerate(b.tolist()):
        left = a[:place] if b is a else a
        left = left[(np.minimum(n[left], n[i]) + 1e-9 >= least * np.maximum(n[left], n[i])) & (root[left] != root[i])]
        while len(left):
            j = int(left[0])
            left = left[1:]
            if similar(own(j), own(i), least):
                out.append((j, i))
                root[root == root[i]] = root[j]
                left = left[root[left] != root[i]]
    return out


def _close(classes: DataFrame, folder: str, radius: int, least: float) -> DataFrame:
    """Links (a < b, nodes) that connect what is similar and has fingerprints within the radius."""
    names = ["node", "fp", "file", "at", "n"]

    def pairs(tile, node, fp, file, at, n):
        own = _holding(lambda i: _read(folder, int(file[i]), int(at[i]), int(n[i])))
        found = simhash.meeting(fp.view(U64), tile, radius, lambda i, j: similar(own(i), own(j), least))
        return [(int(node[i]), int(node[j])) for i, j in found]

    nodes = classes.select("node", F.col("bits").alias("fp"), "file", "at", "n")
    met = simhash.meetings(simhash.blocks(nodes, names, radius), names, simhash.TILE)
    return met.mapInArrow(lambda batches: simhash.met(batches, ("tile", *names), pairs), "a long, b long").distinct()


def _banded(classes: DataFrame, folder: str, least: float) -> DataFrame:
    """Links (a < b, nodes) that connect what is similar and shares a band."""
    names = ["node", "file", "at", "n"]

    def pairs(tile, node, file, at, n):
        return [(int(node[i]), int(node[j])) for i, j in meeting(lambda i: _read(folder, int(file[i]), int(at[i]), int(n[i])), n, tile, least)]

    met = simhash.meetings(classes.select(*names, F.explode("bands").alias("bucket")), names, TILE)
    return met.mapInArrow(lambda batches: simhash.met(batches, ("tile", *names), pairs), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = WIDTH, least: float = LEAST, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """key and component_id for every row of ``docs``: which texts link, directly or through others."""
    import xxhash

    folder = C.new_folder(docs.sparkSession, "shingles")
    C.short_batches(docs.sparkSession)

    def sets(batches):
        for b in C.slices(batches, "__text"):
            own = shingles(b["__text"], width)
            n = np.array([len(s) for s in own], np.int64)
            file = secrets.randbits(63)
            C.put_file(folder, f"sets-{file:016x}", [s.tobytes() for s in own])
            fp = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in own], U64).view(np.int64)
            bits = np.array([simhash.of_hashes(s) for s in own], U64).view(np.int64)
            keys = [bands(s).view(np.int64).tolist() for s in own]
            yield pa.RecordBatch.from_arrays([b["__key"], pa.array(fp), pa.array(bits), pa.array(np.full(len(n), file)), pa.array(np.cumsum(n) - n), pa.array(n), pa.array(keys, pa.list_(pa.int64()))], [key, "fp", "bits", "file", "at", "n", "bands"])

    kind = docs.schema[key].dataType.simpleString()
    rows = C.written(docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).mapInArrow(sets, f"`{key}` {kind}, fp long, bits long, file long, at long, n long, bands array<long>"), "shingles")
    first = rows.where(F.col(key).isNotNull()).groupBy("fp").agg(F.min(F.struct(F.col(key).alias("node"), "bits", "file", "at", "n", "bands")).alias("r"))
    classes = C.written(first.select("fp", "r.*"), "classes")
    links = _close(classes, folder, radius, least).union(_banded(classes, folder, least))
    found = simhash.components(links.union(simhash._shared_ids(rows, classes, key)))
    named = classes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return rows.select(key, "fp").join(named, "fp", "left").select(key, F.when(F.col(key).isNotNull(), F.col("component_id")).alias("component_id"))


def keep_first(docs: DataFrame, width: int = WIDTH, least: float = LEAST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each group of near-duplicates the row with the smallest id, all its columns; rows without an id all stay."""
    return simhash.firsts(docs, near_duplicates(docs, width, least, key, text), key, text)
