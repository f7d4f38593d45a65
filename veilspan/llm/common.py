"""What the training-data operators share: the shared folder, table readers, sharded sorted arrays, vectorised words."""

from __future__ import annotations

import atexit
import hashlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


# ---------------------------------------------------------------- shared folder


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir. Where that is unset, a temporary folder serves a local master (tests),
    whose executors are this machine; on a cluster it is an error."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir")
    if not found:
        set_dir = sc._jsc.sc().getCheckpointDir()
        if set_dir.isDefined():
            return set_dir.get().rstrip("/")
        if not (sc.master or "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="veilspan-shared-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    """A fresh folder name below the shared folder; whoever writes first creates it."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read again: a cut in the lineage that outlives executors."""
    path = new_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shards_for(df: DataFrame, columns: list[str], bytes_each: int = 64 << 20) -> int:
    """How many shards keep each near ``bytes_each`` of the columns' bytes, and no fewer than the shuffle has partitions. The
    size is the optimiser's estimate, or counted where it has none."""
    spark, own = df.sparkSession, df.select(*columns)
    size = int(own._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= 1 << 60:
        size = own.agg(F.sum(sum((F.coalesce(F.octet_length(c), F.lit(8)) for c in columns), F.lit(0)).cast("long"))).first()[0] or 0
    return min(1 << 16, max(shuffle_partitions(spark), -(-size // bytes_each)))


def _local(folder: str) -> str | None:
    u = urlparse(folder)
    return u.path if u.scheme in ("", "file") else None


def put_file(folder: str, name: str, parts: list[bytes]) -> None:
    """Write one file so that readers see all of it or nothing. A repeated task writes the same bytes again."""
    path = _local(folder)
    if path is None:
        from pyarrow import fs

        where, base = fs.FileSystem.from_uri(folder)
        where.create_dir(base, recursive=True)
        with where.open_output_stream(f"{base}/{name}") as out:
            for p in parts:
                out.write(p)
        return
    os.makedirs(path, exist_ok=True)
    tmp = f"{path}/.{name}.{uuid.uuid4().hex}"
    with open(tmp, "wb") as out:
        for p in parts:
            out.write(p)
    os.replace(tmp, f"{path}/{name}")


_FETCHED: dict[str, str] = {}


def _fetched(folder: str, name: str) -> str:
    """A copy of a remote file in a folder of this process, which is removed when the process ends."""
    key = f"{folder}/{name}"
    if key not in _FETCHED:
        from pyarrow import fs

        if not _FETCHED:
            _FETCHED[""] = tempfile.mkdtemp(prefix="veilspan-fetched-")
            atexit.register(shutil.rmtree, _FETCHED[""], ignore_errors=True)
        where, base = fs.FileSystem.from_uri(folder)
        full = os.path.join(_FETCHED[""], hashlib.sha256(key.encode()).hexdigest())
        with where.open_input_stream(f"{base}/{name}") as src, open(full, "wb") as out:
            while piece := src.read(1 << 22):
                out.write(piece)
        _FETCHED[key] = full
    return _FETCHED[key]


def map_file(folder: str, name: str) -> np.ndarray:
    """The file's bytes, memory-mapped. From a store without local paths it is fetched once per Python worker."""
    path = _local(folder)
    full = _fetched(folder, name) if path is None else f"{path}/{name}"
    if os.path.getsize(full) == 0:
        return np.zeros(0, np.uint8)
    return np.memmap(full, np.uint8, "r")


def put_columns(folder: str, name: str, columns: list[np.ndarray]) -> None:
    """Equally long arrays, one after the other, each padded to 8 bytes, behind their length."""
    parts = [np.array([len(columns[0])], "<u8").tobytes()]
    for c in columns:
        raw = np.ascontiguousarray(c).tobytes()
        parts.append(raw + b"\0" * (-len(raw) % 8))
    put_file(folder, name, parts)


def map_columns(folder: str, name: str, dtypes: list[str]) -> list[np.ndarray]:
    raw = map_file(folder, name)
    n, at, out = int(raw[:8].view("<u8")[0]), 8, []
    for t in dtypes:
        size = n * np.dtype(t).itemsize
        out.append(raw[at : at + size].view(t))
        at += size + (-size % 8)
    return out


# ---------------------------------------------------------------- sharded sorted arrays


def shard_bounds(shards: int) -> np.ndarray:
    """First hash of each shard but the first; shards cut the range of unsigned 64-bit hashes evenly, by the top 24 bits alone."""
    return np.array([(s << 24) // shards << 40 for s in range(1, shards)], U64)


class ShardedArrays:
    """A table of arrays sorted by a 64-bit hash, one file a shard, looked up by hash. Files are mapped when first used."""

    def __init__(self, folder: str, prefix: str, shards: int, dtypes: list[str]):
        self.folder, self.prefix, self.shards, self.dtypes = folder, prefix, shards, dtypes
        self.bounds, self.open = shard_bounds(shards), {}

    def shard(self, s: int) -> list[np.ndarray]:
        if s not in self.open:
            self.open[s] = map_columns(self.folder, f"{self.prefix}-{s:06d}", self.dtypes)
        return self.open[s]

    def find(self, keys: np.ndarray) -> list[np.ndarray]:
        """Values (first column left out) for sorted distinct keys; 0 where a key is absent."""
        out = [np.zeros(len(keys), t) for t in self.dtypes[1:]]
        cut = [0, *np.searchsorted(keys, self.bounds).tolist(), len(keys)]
        for s in range(self.shards):
            lo, hi = cut[s], cut[s + 1]
            if lo == hi:
                continue
            table, *values = self.shard(s)
            if not len(table):
                continue
            at = np.searchsorted(table, keys[lo:hi])
            at[at == len(table)] = 0
            hit = table[at] == keys[lo:hi]
            for o, v in zip(out, values):
                o[lo:hi][hit] = v[at[hit]]
        return out


def split_by_shard(sorted_keys: np.ndarray, shards: int) -> Iterator[tuple[int, slice]]:
    cut = [0, *np.searchsorted(sorted_keys, shard_bounds(shards)).tolist(), len(sorted_keys)]
    for s in range(shards):
        if cut[s] < cut[s + 1]:
            yield s, slice(cut[s], cut[s + 1])


def summed(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct keys, and the sums of each value by key."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return [keys[first], *(np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values)]


# ---------------------------------------------------------------- vectorised text

def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over unsigned 64-bit integers."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


_KEY = U64(0x2D358DCCAA6C78A5)
#: Keeps the first n bytes of a little-endian word.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], U64)
#: Spans of more bytes are hashed one by one.
LONG = 256


def span_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each symbols[start:end]: equal spans, equal hashes, wherever they stand. Each eight bytes go through
    the finaliser before the next are taken in, so that no algebra of positions makes spans collide; long spans take XXH64."""
    import xxhash

    size = symbols.itemsize
    raw = np.ascontiguousarray(symbols).view(np.uint8)
    at, n = np.asarray(starts, np.int64) * size, (np.asarray(ends, np.int64) - starts) * size
    out = mix64(n.astype(U64) * U64(0x9E3779B97F4A7C15) ^ _KEY)
    if not len(out):
        return out
    words = np.ndarray((len(raw) + 1,), "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]), strides=(1,))
    out = mix64(out ^ (words[at] & _FIRST[np.minimum(n, 8)]))
    rest = np.flatnonzero((n > 8) & (n <= LONG))
    for done in range(8, LONG, 8):
        if not len(rest):
            break
        left = n[rest] - done
        out[rest] = mix64(out[rest] ^ (words[at[rest] + done] & _FIRST[np.minimum(left, 8)]))
        rest = rest[left > 8]
    for i in np.flatnonzero(n > LONG).tolist():
        out[i] = xxhash.xxh64_intdigest(raw[at[i] : at[i] + n[i]], int(_KEY))
    return out


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and where each begins (one more entry than texts). Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary()).fill_null(b"") if column.null_count else column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, "<i8")[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(batches, column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that a slice's texts have about ``limit`` bytes (a longer text: alone)."""
    for b in batches:
        if not b.num_rows:
            continue
        _, off = text_bytes(b[column])
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield b.slice(at, to - at)
            at = to


def _cuts(raw: np.ndarray, off: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Pieces of about ``limit`` bytes that end where a text ends or before a space."""
    at, n = 0, len(raw)
    while at < n:
        to = min(n, at + limit)
        if to < n:
            end = int(off[np.searchsorted(off, to, "right") - 1])
            if end <= at:
                gaps = np.flatnonzero(_SPACE[raw[at + 1 : to]])
                if len(gaps):
                    end = at + 1 + int(gaps[-1])
                else:
                    nxt = int(off[np.searchsorted(off, to)])
                    more = np.flatnonzero(_SPACE[raw[to:nxt]])
                    end = to + int(more[0]) if len(more) else nxt
            to = end
        yield at, to
        at = to


def words(raw: np.ndarray, off: np.ndarray, limit: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the white-space-separated words, A-Z in lower case, and where each text's words begin in them."""
    hashes, begins = [], []
    inner = off[1:-1]
    for at, to in _cuts(raw, off, limit):
        piece = _LOWER[raw[at:to]]
        gap = np.empty(len(piece) + 1, bool)
        gap[:-1] = _SPACE[piece]
        gap[-1] = True
        solid = ~gap[:-1]
        lo, hi = np.searchsorted(inner, [at, to])
        heads = inner[lo:hi] - at
        first = solid.copy()
        first[1:] &= gap[:-2]
        last = solid & gap[1:]
        heads = heads[heads < len(piece)]
        first[heads] = solid[heads]
        tails = heads[heads > 0] - 1
        last[tails] = solid[tails]
        s = np.flatnonzero(first)
        hashes.append(span_hashes(piece, s, np.flatnonzero(last) + 1))
        begins.append(s + at)
    if not hashes:
        return np.zeros(0, U64), np.zeros(len(off), np.int64)
    starts = np.concatenate(begins)
    return np.concatenate(hashes), np.searchsorted(starts, off)


# ---------------------------------------------------------------- columns


def free_name(columns: list[str], name: str) -> str:
    """``name``, or that behind as many underscores as none of the columns has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def kept(keep: list[str] | tuple[str, ...] | None, results: list[str]) -> list[str]:
    """The columns to keep: one that bears the name of a result gives way to it."""
    own = {r.lower() for r in results}
    return [k for k in keep or [] if k.lower() not in own]


def short_batches(spark: SparkSession) -> None:
    """Have Arrow batches of fewer rows than usual, since rows hold whole texts; a session that names a number keeps it."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(setting, None) is None:
        spark.conf.set(setting, "1024")


def with_text(df: DataFrame, keep: list[str], text: str) -> tuple[DataFrame, str]:
    """The columns to keep and the text, which is not sent twice, and the text's name among them."""
    same = next((k for k in keep if k == text), None)
    name = same or free_name(keep, "__text")
    return df.select(*keep) if same else df.select(*keep, F.col(text).alias(name)), name


def typed(df: DataFrame, keep: list[str], more: str) -> str:
    """A schema of the kept columns and ``more``."""
    return ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in (df.schema[k] for k in keep)), more])


def fold(column: Column, folds: int = 5) -> Column:
    """crc32 of the value as text, modulo ``folds``; a null counts as empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % folds


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
