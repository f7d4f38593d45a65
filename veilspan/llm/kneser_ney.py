"""Interpolated modified Kneser-Ney language model: counted in Spark, kept as sorted hash arrays, mapped by the scorers.

Tokens are white-space-separated words (A-Z in lower case) and one end mark a text; words are known by 64-bit hashes.
Counting sums pairs within each task first and moves them as blobs of arrays, one per range of hashes (a shard), so no row
per token crosses a shuffle. Shards are as many as the texts' bytes ask for, so that a task's share is bounded. A pair's shard follows from its first word, so that a context's figures are whole in one
shard; contexts frequent enough to outweigh a shard are spread over all shards instead and their figures, at most a few
for each shard, are added up by the driver. Scorers map the shards' files and look up sorted distinct hashes.

Defined cases: a null text is empty and has the end mark alone; a null id counts as empty text when folds are dealt;
repeated rows count and are scored once each; with no training rows every token has probability 1 / (V + 1) = 1; a kept column
that bears a result's name gives way to the result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.llm import common as C

U64 = np.uint64
END, BEGIN = U64(0x5851F42D4C957F2D), U64(0x14057B7EF767814F)
#: A shard takes this many distinct pairs from one task before it is passed on.
FLUSH = 4_000_000
TOP = 64
_BLOB = "shard int, keys binary, values binary"


@dataclass
class Model:
    """Where the arrays are, and the figures that all scorers need."""

    folder: str
    shards: int
    tokens: int
    types: int
    pairs: int
    discounts1: list[float]
    discounts2: list[float]
    left1: float
    hot: list[int]
    begin: list[float]


def _tokens(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All texts' tokens in a row, end marks included, and where each text's begin."""
    raw, off = C.text_bytes(column)
    h, at = C.words(raw, off)
    n = len(off) - 1
    out = np.full(len(h) + n, END)
    begins = at + np.arange(n + 1)
    keep = np.ones(len(out), bool)
    keep[begins[1:] - 1] = False
    out[keep] = h
    return out, begins


def _before(tokens: np.ndarray, begins: np.ndarray) -> np.ndarray:
    prev = np.empty_like(tokens)
    prev[1:] = tokens[:-1]
    prev[begins[:-1]] = BEGIN
    return prev


def pair_keys(v: np.ndarray, w: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """A pair's key: its first 24 bits, which choose the shard, come from the context unless that is a hot one."""
    whole = C.mix64(v * U64(0x9FB21C651E98DF25) + (w << U64(17) | w >> U64(47)))
    at = np.searchsorted(hot, v)
    at[at == len(hot)] = 0
    high = U64(0xFFFFFF) << U64(40)
    return np.where(hot[at] == v, whole, (v & high) | (whole & ~high))


def _blobs(shards: int, key: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row a shard; ``key`` is sorted."""
    for s, part in C.split_by_shard(key, shards):
        n = part.stop - part.start
        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([key[part].tobytes()], pa.binary()), pa.array([np.array([n], "<u8").tobytes() + b"".join(np.ascontiguousarray(c[part]).tobytes() for c in columns)], pa.binary())], ["shard", "keys", "values"])


def _joined(table: pa.Table, dtypes: list[str]) -> list[np.ndarray]:
    """The blobs of one shard as arrays: keys, then values of the given types."""
    keys = [np.frombuffer(k, U64) for k in table["keys"].to_pylist()]
    out = [np.concatenate(keys)]
    parts: list[list[np.ndarray]] = [[] for _ in dtypes]
    for raw in table["values"].to_pylist():
        n, at = int(np.frombuffer(raw, "<u8", 1)[0]), 8
        for p, t in zip(parts, dtypes):
            p.append(np.frombuffer(raw, t, n, at))
            at += n * np.dtype(t).itemsize
    return out + [np.concatenate(p) for p in parts]


def train(docs: DataFrame, text: str = "text") -> Model:
    """Count all rows of ``docs`` and write the model's arrays to the shared folder."""
    spark = docs.sparkSession
    shards, folder = C.shards_for(docs, [text]), C.new_folder(spark, "kneser-ney")
    docs = docs.select(F.col(text).alias("text"))

    def count_words(batches):
        have = []

        def passed_on():
            keys, n = C.summed(np.concatenate([a for a, _ in have]), np.concatenate([b for _, b in have]))
            have.clear()
            return keys, n

        for b in C.slices(batches, "text"):
            have.append(np.unique(_tokens(b["text"])[0], return_counts=True))
            if sum(len(a) for a, _ in have) > FLUSH:
                have.append(passed_on())
                if len(have[-1][0]) > FLUSH // 2:
                    yield from _blobs(shards, *passed_on())
        if have:
            yield from _blobs(shards, *passed_on())

    def add_words(key, table):
        keys, n = C.summed(*_joined(table, ["<i8"]))
        s = key[0].as_py()
        C.put_columns(folder, f"word-{s:06d}", [keys, n])
        top = np.argsort(-n, kind="stable")[:TOP]
        return pa.table({"types": pa.array([len(keys)], pa.int64()), "tokens": pa.array([int(n.sum())], pa.int64()), "top": pa.array([keys[top].view("<i8").tolist()], pa.list_(pa.int64())), "n": pa.array([n[top].tolist()], pa.list_(pa.int64())), "shard": pa.array([s], pa.int32())})

    words = docs.mapInArrow(count_words, _BLOB).groupBy("shard").applyInArrow(add_words, "types long, tokens long, top array<long>, n array<long>, shard int").collect()
    tokens, types = sum(r["tokens"] for r in words), sum(r["types"] for r in words)
    often = [k for r in words for k, n in zip(r["top"], r["n"]) if n * 4 * shards >= tokens]
    hot = np.unique(np.append(np.array(often, "<i8").view(U64), BEGIN))

    def count_pairs(batches):
        have = []

        def passed_on():
            k, v, w, n = (np.concatenate([h[i] for h in have]) for i in range(4))
            have.clear()
            order = np.argsort(k, kind="stable")
            k = k[order]
            first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            return k[first], v[order][first], w[order][first], np.add.reduceat(n[order], first).astype("<u4")

        def out(k, v, w, n):
            # The key can be had again from both words. Words of one context stand together: its hash is sent once.
            for s, part in C.split_by_shard(k, shards):
                ctx = v[part]
                heads = np.flatnonzero(np.r_[True, ctx[1:] != ctx[:-1]])
                runs = np.diff(np.r_[heads, len(ctx)]).astype("<u4")
                few = np.minimum(n[part], 255).astype("u1")
                more = n[part][few == 255]
                raw = np.array([len(ctx), len(more)], "<u8").tobytes() + w[part].tobytes() + few.tobytes() + more.tobytes() + runs.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([ctx[heads].tobytes()], pa.binary()), pa.array([raw], pa.binary())], ["shard", "keys", "values"])

        for b in C.slices(batches, "text"):
            w, begins = _tokens(b["text"])
            v = _before(w, begins)
            k, at, n = np.unique(pair_keys(v, w, hot), return_index=True, return_counts=True)
            have.append((k, v[at], w[at], n.astype("<u4")))
            if sum(len(h[0]) for h in have) > FLUSH:
                have.append(passed_on())
                if len(have[-1][0]) > FLUSH // 2:
                    yield from out(*passed_on())
        if have:
            yield from out(*passed_on())

    def add_pairs(key, table):
        s, vs, ws, ns = key[0].as_py(), [], [], []
        for ctx, raw in zip(table["keys"].to_pylist(), table["values"].to_pylist()):
            n, m = (int(x) for x in np.frombuffer(raw, "<u8", 2))
            ws.append(np.frombuffer(raw, U64, n, 16))
            few = np.frombuffer(raw, "u1", n, 16 + 8 * n).astype("<u4")
            few[few == 255] = np.frombuffer(raw, "<u4", m, 16 + 9 * n)
            ns.append(few)
            vs.append(np.repeat(np.frombuffer(ctx, U64), np.frombuffer(raw[16 + 9 * n + 4 * m :], "<u4")))
        v, w, n = np.concatenate(vs), np.concatenate(ws), np.concatenate(ns).astype("<i8")
        del vs, ws, ns
        k = pair_keys(v, w, hot)
        order = np.argsort(k, kind="stable")
        k = k[order]
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        k, v, w, n = k[first], v[order][first], w[order][first], np.add.reduceat(n[order], first)
        C.put_columns(folder, f"pair-{s:06d}", [k, n.astype("<u4")])
        ctx, *figures = C.summed(v, n, (n == 1).astype("<i8"), (n == 2).astype("<i8"), (n > 2).astype("<i8"))
        is_hot = np.isin(ctx, hot)
        cold = [x[~is_hot] for x in (ctx, *figures)]
        C.put_columns(folder, f"context-{s:06d}", cold)
        back = [("context", int(c), list(map(int, f))) for c, f in zip(ctx[is_hot].view("<i8"), zip(*(f[is_hot] for f in figures)))]
        back.append(("counts", 0, [int((n == i).sum()) for i in range(1, 5)] + [len(n)]))
        w, seen = np.unique(w, return_counts=True)
        rows = [(-1, None, None, json.dumps(x)) for x in back]
        for b in _blobs(shards, w, seen.astype("<u4")):
            rows.append((b["shard"][0].as_py(), b["keys"][0].as_py(), b["values"][0].as_py(), None))
        return pa.table({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate((("shard", pa.int32()), ("keys", pa.binary()), ("values", pa.binary()), ("figures", pa.string())))})

    pairs = C.written(docs.mapInArrow(count_pairs, _BLOB).groupBy("shard").applyInArrow(add_pairs, _BLOB + ", figures string"), "kneser-ney-before")
    counts, contexts = np.zeros(5, np.int64), {}
    for r in pairs.where("shard = -1").select("figures").collect():
        kind, h, f = json.loads(r[0])
        if kind == "counts":
            counts += np.array(f)
        else:
            contexts[h] = contexts.get(h, np.zeros(4, np.int64)) + np.array(f)
    begin = contexts.pop(int(BEGIN.astype("<i8")), np.zeros(4, np.int64))
    hot_keys = np.array(sorted(contexts), "<i8").view(U64)
    hot_keys_order = np.argsort(hot_keys)
    hot_figures = np.array([contexts[k] for k in sorted(contexts)], np.int64).reshape(-1, 4)[hot_keys_order]
    hot_keys = hot_keys[hot_keys_order]

    def add_contexts(key, table):
        s = key[0].as_py()
        w, seen = C.summed(*_joined(table, ["<u4"]))
        words, n = C.map_columns(folder, f"word-{s:06d}", ["<u8", "<i8"])
        at = np.searchsorted(words, w)
        assert len(w) == 0 or (at[-1] < len(words) and (words[at] == w).all()), "a word that follows another is counted"
        before = np.zeros(len(words), "<u4")
        before[at] = seen
        figures = np.zeros((4, len(words)), "<i8")
        try:
            ctx, *own = C.map_columns(folder, f"context-{s:06d}", ["<u8"] + ["<i8"] * 4)
        except FileNotFoundError:  # no pair fell into this shard
            ctx, own = np.zeros(0, U64), [np.zeros(0, "<i8")] * 4
        at = np.searchsorted(words, ctx)
        assert len(ctx) == 0 or (at[-1] < len(words) and (words[at] == ctx).all()), "a context's pairs lie in its word's shard"
        for f, o in zip(figures, own):
            f[at] = o
        inside = np.isin(hot_keys, words)  # a hot context lies in one shard: in this one, or not
        at = np.searchsorted(words, hot_keys[inside])
        figures[:, at] = hot_figures[inside].T
        C.put_columns(folder, f"vocab-{s:06d}", [words, n, before, figures[0], *(f.astype("<u4") for f in figures[1:])])
        return pa.table({"c": pa.array([[int((before == i).sum()) for i in range(1, 5)]], pa.list_(pa.int64())), "shard": pa.array([s], pa.int32())})

    done = pairs.where("shard >= 0").groupBy("shard").applyInArrow(add_contexts, "c array<long>, shard int").collect()
    lower = np.sum([r["c"] for r in done], axis=0) if done else np.zeros(4)
    present = {r["shard"] for r in words}
    spare = [s for s in range(shards) if s not in present]
    for s in spare:  # shards no word fell into: empty files, so that scorers need not ask
        C.put_columns(folder, f"vocab-{s:06d}", [np.zeros(0, U64)] * 7)
    if len(spare) < shards:
        _fill(folder, shards)
    else:
        for s in range(shards):
            C.put_columns(folder, f"pair-{s:06d}", [np.zeros(0, U64)] * 2)
    d1, d2 = _discounts(lower), _discounts(counts[:4])
    total = int(counts[4])
    left1 = float((d1[0] * lower[0] + d1[1] * lower[1] + d1[2] * (types - lower[0] - lower[1])) / total) if total else 1.0
    return Model(folder, shards, tokens, types, total, d1, d2, left1, [int(x) for x in hot], [float(x) for x in begin])


def _fill(folder: str, shards: int) -> None:
    """Empty pair files for shards without pairs (small inputs)."""
    for s in range(shards):
        try:
            C.map_file(folder, f"pair-{s:06d}")
        except (FileNotFoundError, OSError):
            C.put_columns(folder, f"pair-{s:06d}", [np.zeros(0, U64)] * 2)


def _discounts(n) -> list[float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and more, from the numbers of items counted 1 to 4 times."""
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw)]


_VOCAB = ["<u8", "<i8", "<u4", "<i8", "<u4", "<u4", "<u4"]


def _opened(m: Model) -> tuple[C.ShardedArrays, C.ShardedArrays]:
    """One set of mapped files for each model and Python worker."""
    if _OPEN.get("folder") != m.folder:
        _OPEN.clear()
        _OPEN.update(folder=m.folder, t=(C.ShardedArrays(m.folder, "vocab", m.shards, _VOCAB), C.ShardedArrays(m.folder, "pair", m.shards, ["<u8", "<u4"])))
    return _OPEN["t"]


_OPEN: dict = {}


def log_probabilities(m: Model, w: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability of each token after the one before it, and each token's count in training."""
    vocab, pair = _opened(m)
    hot = np.array(m.hot, U64)
    u, at = np.unique(w, return_inverse=True)
    count, before, total, n1, n2, n3 = vocab.find(u)
    d1, d2 = np.array([0, *m.discounts1]), np.array([0, *m.discounts2])
    lower = m.left1 / (m.types + 1) + np.maximum(before - d1[np.minimum(before, 3)], 0) / max(m.pairs, 1)
    total, left = np.append(total, m.begin[0]).astype(float), d2[1] * np.append(n1, m.begin[1]) + d2[2] * np.append(n2, m.begin[2]) + d2[3] * np.append(n3, m.begin[3])
    ctx = np.empty(len(w), np.int64)
    ctx[1:] = at[:-1]
    ctx[begins[:-1]] = len(u)
    v = np.append(u, BEGIN)[ctx]
    k, back = np.unique(pair_keys(v, w, hot), return_inverse=True)
    c = pair.find(k)[0][back]
    t = total[ctx]
    known = t > 0
    t[~known] = 1
    p = np.where(known, np.maximum(c - d2[np.minimum(c, 3)], 0) / t + left[ctx] / t * lower[at], lower[at])
    return np.log10(p), count[at]


def score(docs: DataFrame, m: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Rows of ``docs`` (columns ``keep``) with n_tokens, n_known, base_score and score."""
    keep = C.kept(keep, _SCORES)
    own_text = C.free_name(keep, "__text")
    plain = asdict(m)

    def run(batches):
        own = Model(**plain)
        for b in C.slices(batches, own_text):
            w, begins = _tokens(b[own_text])
            logs, count = log_probabilities(own, w, begins)
            at = begins[:-1]
            base = np.log10((count + 0.5) / (own.tokens + 0.5 * (own.types + 1)))
            cols = [b[c] for c in keep] + [pa.array(np.diff(begins).astype(np.int64)), pa.array(np.add.reduceat((count > 0).astype(np.int64), at)), pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(logs, at))]
            yield pa.RecordBatch.from_arrays(cols, [*keep, *_SCORES])

    rows = docs.select(*keep, F.col(text).alias(own_text))
    return rows.mapInArrow(run, C.typed(docs, keep, "n_tokens long, n_known long, base_score double, score double"))


_SCORES = ["n_tokens", "n_known", "base_score", "score"]


def train_and_score(docs: DataFrame, train_when: Column, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Learn from the rows that ``train_when`` picks, score all; with train_tokens and perplexity."""
    keep = C.kept(keep, ["train_tokens", "perplexity"])
    m = train(docs.where(train_when), text)
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))  # the end mark makes a token at least
    return score(docs, m, text, keep).withColumn("train_tokens", F.lit(m.tokens).cast("long")).withColumn("perplexity", perplexity)
