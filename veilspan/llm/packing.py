"""Packing by concatenate and cut.

Texts are tokenised once, partition by partition, and written with each document's offset within its partition (pass one).
Prefix sums over the partitions' totals turn that into one offset in the endless sequence of all tokens (pass two), and
fixed windows cut it: a document's pieces follow from its offset and length alone, so nothing is shuffled. A piece that
does not begin with its document, or does not end with it, is a boundary record.

Defined cases: a null or empty text is its end id alone; a repeated row is packed each time; an empty table gives no
sequence; the last sequence may be short, and is the only one that needs padding; a kept column that bears a result's name
gives way to the result.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm import bpe
from veilspan.llm import common as C

_TOKENIZERS: dict[str, object] = {}


class Tokenizer:
    """Ids as the tokenizer file gives them, without special tokens added. Given the same vocabulary as ranks, distinct
    pre-tokens are encoded by these, and texts gathered from them as in ``bpe``; a text that names an added token goes through
    the file's own tokenizer."""

    def __init__(self, path: str, ranks: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer as Own

        self.own = Own.from_file(path)
        self.size = self.own.get_vocab_size()
        self.added = [x.content for x in self.own.get_added_tokens_decoder().values()]
        self.kind = np.uint16 if self.size <= 1 << 16 else np.uint32
        self.fast = bpe.Codec(ranks, _by_ranks(ranks)) if ranks else None

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's begin. ``texts`` isn't empty."""
        own = [i for i, t in enumerate(texts) if t and (not self.fast or any(a in t for a in self.added))]
        ids, at = self.fast.encode(texts) if not own else (None, None)
        if own:
            parts = {i: np.array(self.own.encode(texts[i], add_special_tokens=False).ids, self.kind) for i in own}
            ids, at = self.fast.encode([None if i in parts else t for i, t in enumerate(texts)]) if self.fast else (np.zeros(0, self.kind), np.zeros(len(texts) + 1, np.int64))
            each = [parts[i] if i in parts else ids[at[i] : at[i + 1]] for i in range(len(texts))]
            ids, at = np.concatenate(each), np.r_[0, np.cumsum([len(x) for x in each])]
        return ids.astype(self.kind), at.astype(np.int64)


def _by_ranks(path: str):
    """Ids of single pre-tokens, by the library of the ranks' format."""
    import public_tokenizers
    import tiktoken

    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    return lambda raw: encoding.encode_ordinary(raw.decode("utf-8", "surrogatepass"))


_PASS_ONE = ["__part", "__local", "doc_tokens", "ids"]
_PIECES = ["start", "length", "ids", "doc_tokens", "sequence_id", "offset", "boundary"]


def tokenizer(path: str, ranks: str | None = None) -> Tokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Tokenizer(path, ranks)
    return _TOKENIZERS[path]


def tokenised(docs: DataFrame, path: str, ranks: str | None, end: int, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Pass one, written: columns ``keep``, __part, __local (tokens before it in its partition), doc_tokens, ids (binary)."""
    keep = C.kept(keep, _PASS_ONE)
    C.short_batches(docs.sparkSession)
    own = C.free_name([*keep, *_PASS_ONE], "__text")

    def run(batches):
        t = tokenizer(path, ranks)
        part, local = TaskContext.get().partitionId(), 0
        for b in C.slices(batches, own, 4 << 20):
            ids, at = t(b[own].to_pylist())
            n = len(at) - 1
            # The end id behind each document.
            begins = at + np.arange(n + 1)
            every = np.full(len(ids) + n, end, t.kind)
            mask = np.ones(len(every), bool)
            mask[begins[1:] - 1] = False
            every[mask] = ids
            size = every.itemsize
            column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer((begins * size).astype("<i8").tobytes()), pa.py_buffer(every.tobytes())])
            yield pa.RecordBatch.from_arrays([*(b[k] for k in keep), pa.array(np.full(n, part, np.int32)), pa.array(begins[:-1] + local), pa.array(np.diff(begins)), column.cast(pa.binary())], [*keep, *_PASS_ONE])
            local += int(begins[-1])

    schema = C.typed(docs, keep, "__part int, __local long, doc_tokens long, ids binary")
    return C.written(docs.select(*keep, F.col(text).alias(own)).mapInArrow(run, schema), "packing")


def offsets(rows: DataFrame) -> DataFrame:
    """Pass two: each partition's offset, from the totals of those before it. One row a partition of pass one."""
    totals = rows.groupBy("__part").agg(F.sum("doc_tokens").alias("n")).collect()
    at, out = 0, []
    for r in sorted(totals, key=lambda r: r["__part"]):
        out.append((r["__part"], at))
        at += r["n"]
    return rows.sparkSession.createDataFrame(out or [], "__part int, __before long")


def pack(docs: DataFrame, path: str, ranks: str | None = None, length: int = 1024, end: int = 0, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row a piece: columns ``keep``, start, length, ids (binary), doc_tokens, sequence_id, offset, boundary."""
    keep = C.kept(keep, [*_PASS_ONE, *_PIECES, "__before", "__at"])
    rows = tokenised(docs, path, ranks, end, text, tuple(keep))
    size = 2 if _vocabulary(path) <= 1 << 16 else 4
    where = F.broadcast(offsets(rows))  # as many rows as pass one had partitions
    rows = rows.join(where, "__part").withColumn("__at", F.col("__local") + F.col("__before"))
    window = F.explode(F.sequence(F.floor(F.col("__at") / length), F.floor((F.col("__at") + F.col("doc_tokens") - 1) / length)))
    rows = rows.withColumn("sequence_id", window)
    first = F.greatest(F.col("__at"), F.col("sequence_id") * length)
    last = F.least(F.col("__at") + F.col("doc_tokens"), (F.col("sequence_id") + 1) * length)
    rows = rows.withColumn("start", first - F.col("__at")).withColumn("length", last - first).withColumn("offset", first - F.col("sequence_id") * length)
    piece = F.substring(F.col("ids"), (F.col("start") * size + 1).cast("int"), (F.col("length") * size).cast("int"))
    boundary = (F.col("start") > 0) | (F.col("start") + F.col("length") < F.col("doc_tokens"))
    return rows.select(*keep, "start", "length", piece.alias("ids"), "doc_tokens", "sequence_id", "offset", boundary.alias("boundary"))


def _vocabulary(path: str) -> int:
    from tokenizers import Tokenizer as Own

    return Own.from_file(path).get_vocab_size()


def digests(pieces: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The pieces with ids_crc32 in place of ids: over little-endian unsigned 32-bit ids."""
    kind = np.uint16 if _vocabulary(path) <= 1 << 16 else np.uint32
    names = [*C.kept(keep, [*_PIECES, "ids_crc32"]), *(n for n in _PIECES if n != "ids")]

    def run(batches):
        for b in batches:
            crc = [zlib.crc32(np.frombuffer(x.as_buffer(), kind).astype("<u4")) for x in b["ids"]]
            yield pa.RecordBatch.from_arrays([*(b[n] for n in names), pa.array(crc, pa.int64())], [*names, "ids_crc32"])

    return pieces.select(*names, "ids").mapInArrow(run, C.typed(pieces, names, "ids_crc32 long"))
