"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader, sparse dot products.

A text gives two streams of words: the words themselves, and what each looks like (its kinds of characters, its length, and
whether it repeats the word before it), which carries over to words never seen. N-grams of both are hashed into one table of
weights. A feature's value is its share of its stream's n-grams, so a text's score is a mean of weights and a sigmoid, and
long texts weigh no more than short ones.

Training reads a bounded sample of labelled rows (``bound`` rows, ``labelled.BOUND_BYTES`` of text) in one task; scoring reads every text whole, with the non-zero
weights, at most the size of the table, sent along.

Defined cases: a null or empty text has no n-gram and scores by the intercept alone; without labelled rows every score is
0.5; repeated rows are scored each and teach once; ids labelled both ways teach nothing; a kept column that bears the score's
name gives way to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm import common as C
from veilspan.llm.labelled import labelled_sample, learn

U64 = np.uint64
#: Labelled rows that are learnt from, at most; weights in the table; passes over the sample.
BOUND, TABLE, PASSES = 4_000, 1 << 18, 3
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.002, 0.002
INTERCEPT = TABLE

_KIND = np.full(256, 32, np.uint8)
_KIND[:128] = 16
_KIND[65:91], _KIND[97:123], _KIND[48:58] = 1, 2, 4
_KIND[[44, 46]] = 8
_KIND[[32, 9, 10, 11, 12, 13]] = 0


def _looks(raw: np.ndarray, starts: np.ndarray, h: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """A number for each word: kinds of characters in it, its length, and whether it repeats the word before it."""
    if not len(starts):
        return np.zeros(0, U64)
    kinds = _KIND[raw]
    has = np.bitwise_or.reduceat(kinds, starts)
    size = np.add.reduceat((kinds > 0).astype(np.int32), starts)
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    same[heads[heads < len(h)]] = False
    return has.astype(U64) | np.minimum(size // 4, 3).astype(U64) << U64(6) | same.astype(U64) << U64(8)


def _word_starts(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    solid = _KIND[raw] > 0
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    heads = off[:-1][off[:-1] < len(raw)]
    first[heads] = solid[heads]
    return np.flatnonzero(first)


def features(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weight numbers and values of all texts in a row, and where each text's begin."""
    raw, off = C.text_bytes(column)
    h, at = C.words(raw, off)
    looks = _looks(raw, _word_starts(raw, off), h, at[:-1])
    n = np.diff(at)
    text = np.repeat(np.arange(len(n)), n)
    grams = []
    for salt, stream, orders in ((0x9E3779B97F4A7C15, h, (1, 2)), (0x3C6EF372FE94F82A, looks, (1, 2, 3))):
        x = C.mix64(stream + U64(salt))
        g = x
        for order in range(1, max(orders) + 1):
            if order > 1:  # the words before, unless they stand in another text
                if len(g) < 2:
                    break
                g = C.mix64(g[:-1] * U64(31) + x[order - 1 :])
            own = text[: len(g)] == text[order - 1 :] if len(g) else np.zeros(0, bool)
            share = 1 / np.maximum(n - order + 1, 1)
            grams.append((text[: len(g)][own], (g[own] + U64(order)) % U64(TABLE), share[text[: len(g)][own]]))
    doc, number, value = (np.concatenate(x) for x in zip(*grams)) if grams else (np.zeros(0, int), np.zeros(0, U64), np.zeros(0))
    order = np.argsort(doc, kind="stable")
    return number[order].astype(np.int64), value[order], np.searchsorted(doc[order], np.arange(len(n) + 1))


def fit(texts, y: np.ndarray) -> np.ndarray:
    """Weights by FTRL-proximal, one text after the other, several passes in shuffled orders; the last is the intercept."""
    z, n = np.zeros(TABLE + 1), np.zeros(TABLE + 1)
    rows = []
    for lo in range(0, len(y), 128):
        number, value, at = features(texts.slice(lo, 128))
        for i in range(len(at) - 1):
            j, back = np.unique(number[at[i] : at[i + 1]], return_inverse=True)
            x = np.bincount(back, value[at[i] : at[i + 1]], len(j)) if len(j) else np.zeros(0)
            rows.append((np.append(j, INTERCEPT).astype(np.int32), np.append(x, 1.0).astype(np.float32)))

    def weights(zj, nj):
        return np.where(np.abs(zj) <= L1, 0.0, -(zj - np.sign(zj) * L1) / ((BETA + np.sqrt(nj)) / ALPHA + L2))

    shuffle = np.random.default_rng(7)
    for _ in range(PASSES):
        for i in shuffle.permutation(len(rows)).tolist():
            j, x = rows[i]
            zj, nj = z[j], n[j]
            w = weights(zj, nj)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y[i]) * x
            more = nj + g * g
            z[j] = zj + g - (np.sqrt(more) - np.sqrt(nj)) / ALPHA * w
            n[j] = more
    return weights(z, n)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = BOUND) -> tuple[list[int], list[float]]:
    """Numbers and values of the weights that aren't 0."""

    def one(texts, y):
        w = fit(texts, y).astype(np.float32)
        j = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array([j.astype("<i4").tobytes()], pa.binary()), pa.array([w[j].tobytes()], pa.binary())], ["j", "w"])

    for r in learn(labelled_sample(docs, labels, label, bound), one, "j binary, w binary"):
        return np.frombuffer(r["j"], "<i4"), np.frombuffer(r["w"], np.float32)
    return np.zeros(0, "<i4"), np.zeros(0, np.float32)


def score(docs: DataFrame, model, text: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """Columns ``keep`` and the score, 0 to 1."""
    keep = C.kept(keep, [name])
    rows, own = C.with_text(docs, keep, text)
    C.short_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((model[0].tobytes(), model[1].tobytes()))  # at most TABLE + 1 weights

    def run(batches):
        w = np.zeros(TABLE + 1)
        w[np.frombuffer(sent.value[0], "<i4")] = np.frombuffer(sent.value[1], np.float32)
        for b in C.slices(batches, own, 1 << 20):
            number, value, at = features(b[own])
            total = np.r_[0, np.cumsum(w[number] * value)]
            dot = w[INTERCEPT] + total[at[1:]] - total[at[:-1]]
            yield pa.RecordBatch.from_arrays([*(b[k] for k in keep), pa.array(1 / (1 + np.exp(-dot)))], [*keep, name])

    return rows.mapInArrow(run, C.typed(docs, keep, f"`{name}` double"))
