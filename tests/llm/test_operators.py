"""Sharding, packing, near-duplicates, neighbours, line dedup, transport streams and the pipeline, against plain versions."""

import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilspan.llm import jaccard, linedup, mih, mpegts, packing, queries, sharding, simhash

ODD = [(1, "a b a b"), (2, ""), (3, None), (4, "A  b\tc\n"), (5, "   "), (None, "a b"), (1, "a b a b"), (6, "é ü 🙂 x"), (7, "word " * 30_000)]
JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture
def odd(spark):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in ODD], "doc_id long, text string, shard int, component_id string")


# ---------------------------------------------------------------- sharding


def test_sharding(spark):
    ids = spark.range(20_000).select(F.col("id").alias("doc_id"))
    for n in (1, 7, 16, 17):
        rows = sharding.assign(ids, "doc_id", sharding.topology(n), sharding.grow(sharding.topology(n))).collect()
        assert {r["grown_shard"] for r in rows if r["grown_shard"] != r["shard"]} == {n}
        sizes = np.bincount([r["shard"] for r in rows])
        assert len(sizes) == n and sizes.min() > 0.85 * len(rows) / n
        for s in range(n):
            assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))


def plain_draw(key, path, weight):
    digits = hashlib.md5(f"{path}/{key}".encode()).hexdigest()[:13]
    return -math.log((int(digits, 16) + 0.5) / 2**52) / weight


def plain_place(key, tree):
    """The descent in plain Python, and how many draws it took."""
    path, own, draws = "root", [(s.region, s.rack, i, s.weight) for i, s in enumerate(tree) if s.weight > 0], 0
    for level in range(3):
        weights = {}
        for leaf in own:
            weights[leaf[level]] = weights.get(leaf[level], 0) + leaf[3]
        best = min(weights, key=lambda c: (plain_draw(key, f"{path}/{c}", weights[c]), c)) if len(weights) > 1 else next(iter(weights))
        draws += len(weights) if len(weights) > 1 else 0
        path, own = f"{path}/{best}", [leaf for leaf in own if leaf[level] == best]
    return own[0][2], draws


WEIGHTED = [sharding.Shard(i // 4, i // 2 % 2, w) for i, w in enumerate((1, 2, 3, 0, 1, 1, 1, 1))]


def test_sharding_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = con.execute(queries.ORACLE_SQL["op1_sharding"])
    names = [c[0] for c in want.description]
    assert sorted(want.fetchall()) == sorted(tuple(r) for r in queries.op1_sharding(spark, sf).select(names).collect())


def test_weights_and_movement(spark):
    ids = spark.range(30_000).select(F.col("id").alias("doc_id"))
    heavier = [*WEIGHTED[:5], sharding.Shard(1, 0, 4.0), *WEIGHTED[6:]]
    rows = sharding.assign(ids, "doc_id", WEIGHTED, heavier).collect()
    share = np.bincount([r["shard"] for r in rows], minlength=8) / len(rows)
    assert share[3] == 0 and np.allclose(share, np.array([1, 2, 3, 0, 1, 1, 1, 1]) / 10, atol=0.01)
    grown = np.bincount([r["grown_shard"] for r in rows], minlength=8) / len(rows)
    assert np.allclose(grown, np.array([1, 2, 3, 0, 1, 4, 1, 1]) / 13, atol=0.01)
    moved = [(r["shard"], r["grown_shard"]) for r in rows if r["shard"] != r["grown_shard"]]
    assert moved
    for a, b in moved:
        # Between regions rows go into the heavier one; in it, those that were there before go into the heavier rack, and in
        # that into the heavier shard. Region 0, its racks and shards, and rack 1 of region 1 exchange nothing.
        assert b >= 4 and (a < 4 or b in (4, 5)) and (a not in (4, 5) or b == 5)


def test_descent_is_the_plain_one(spark):
    tree = sharding.topology(17)
    rows = sharding.assign(spark.range(2000).select(F.col("id").alias("doc_id")), "doc_id", tree, WEIGHTED).collect()
    for r in rows:
        shard, draws = plain_place(str(r["doc_id"]), tree)
        assert r["shard"] == shard and draws <= 3 + 2 + 4  # one path, not every leaf
        assert r["grown_shard"] == plain_place(str(r["doc_id"]), WEIGHTED)[0]


def test_sharding_odd_rows(spark, odd):
    got = sharding.assign(odd, "doc_id", sharding.topology(4)).collect()  # a column named shard gives way
    assert len(got) == len(ODD) and got[0].asDict().keys() == {"doc_id", "text", "component_id", "shard", "slot", "grown_shard"}
    assert {r["shard"] for r in got if r["doc_id"] == 1} == {plain_place("1", sharding.topology(4))[0]}
    for s in range(4):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    same = spark.range(5000).select(F.lit(7).alias("doc_id"), F.lit("x").alias("slot"))
    assert sorted(r["slot"] for r in sharding.assign(same, "doc_id", sharding.topology(4)).collect()) == list(range(5000))
    assert sharding.assign(odd.limit(0), "doc_id", sharding.topology(4)).count() == 0
    with pytest.raises(ValueError):
        sharding.place(F.lit("x"), [sharding.Shard(0, 0, 0)])


# ---------------------------------------------------------------- packing


def test_packing(spark, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    rows = packing.digests(packing.pack(odd, JSON, RANKS, length=64), JSON).collect()
    total = sum(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x in ODD)
    assert sum(r["length"] for r in rows) == total
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
    for s, own in by.items():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == np.cumsum([0, *(r["length"] for r in own)])[:-1].tolist()
        assert sum(r["length"] for r in own) == 64 or s == max(by)
    ids = np.array(t.encode(ODD[-1][1], add_special_tokens=False).ids + [0], "<u4")
    for r in rows:
        if r["doc_id"] == 7:
            assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    assert packing.digests(packing.pack(odd.limit(0), JSON, RANKS), JSON).count() == 0


# ---------------------------------------------------------------- SimHash


def plain_fingerprint(text):
    words = [w.lower() for w in (text or "").encode().split()]
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, fp, radius):
    own = {i: i for i in ids}

    def find(i):
        while own[i] != i:
            i = own[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            if ids[a] == ids[b] or (fp[a] ^ fp[b]).bit_count() <= radius:
                x, y = sorted((find(ids[a]), find(ids[b])))
                own[y] = x
    return {i: find(i) for i in ids}


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 20), st.integers(0, 10**9))
def test_planes(radius, seed):
    r = np.random.default_rng(seed)
    base = r.integers(0, 2**64, 40, dtype=np.uint64)
    near = base ^ np.array([sum(1 << int(b) for b in r.choice(64, r.integers(0, radius + 3), replace=False)) for _ in range(40)], np.uint64)
    fp = np.concatenate([base, near])
    got = np.unpackbits(simhash.within(fp, simhash.planes(fp), radius).view(np.uint8), axis=1, bitorder="little")[:, :80]
    assert (got.astype(bool) == (np.bitwise_count(fp[:, None] ^ fp[None]) <= radius)).all()


def test_near_duplicates(spark, monkeypatch):
    r = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    base = [[r.choice(words) for _ in range(120)] for _ in range(12)]
    texts = []
    for i in range(150):
        t = list(r.choice(base))
        for _ in range(r.randrange(4)):
            t[r.randrange(120)] = "new"
        texts.append((1000 - i, " ".join(t)))
    texts += [(i, t) for i, t in ODD if i is not None]
    want = plain_components([i for i, _ in texts], [plain_fingerprint(t) for _, t in texts], 4)
    for tile in (4096, 8):
        monkeypatch.setattr(simhash, "TILE", tile)
        got = simhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
        assert len(got) == len(texts) and {x["doc_id"]: x["component_id"] for x in got} == want
    assert len(set(want.values())) < len(texts) - 20


def test_components_of_a_chain(spark):
    n = 60
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long")
    assert {r["component"] for r in simhash.components(edges).collect()} == {0}
    assert simhash.components(edges.limit(0)).count() == 0


def test_meeting_of_tiles():
    r = np.random.default_rng(2)
    fp = r.integers(0, 2**64, 200, dtype=np.uint64)
    fp[100:] = fp[:100] ^ np.uint64(5)
    tile = np.repeat([0, 1], 100)
    assert sorted(simhash.meeting(fp, tile, 2)) == [(i, i + 100) for i in range(100)]
    assert simhash.meeting(fp[:100], tile[:100], 2) == []


def test_near_duplicates_odd_rows(spark, odd):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    assert {r["component_id"] for r in got if r["doc_id"] in (2, 3, 5)} == {2} and [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    kept = simhash.keep_first(odd).collect()
    assert sorted(r["doc_id"] or 0 for r in kept) == [0, 1, 2, 4, 6, 7] and len(kept[0]) == 4
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_pipeline_near_duplicates(spark, monkeypatch, odd):
    import corpus_pipeline

    r = random.Random(6)
    base = [[f"w{r.randrange(5000)}" for _ in range(200)] for _ in range(30)]
    texts = [(1000 + i, " ".join(t)) for i, t in enumerate(base)]
    for i in range(120):
        t = list(r.choice(base))
        for _ in range(r.randrange(7)):  # each takes five of 196 shingles out and puts five in
            t[r.randrange(200)] = f"n{r.randrange(10**6)}"
        texts.append((i, " ".join(t)))
    sets = [{tuple(t.split()[j : j + 5]) for j in range(196)} for _, t in texts]
    up = {i: i for i, _ in texts}
    near = 0
    for x in range(len(texts)):
        for y in range(x):
            s = len(sets[x] & sets[y]) / len(sets[x] | sets[y])
            if s >= 0.8:
                near += s < 0.85
                a, b = sorted((up[texts[x][0]], up[texts[y][0]]))
                up = {k: a if v == b else v for k, v in up.items()}
    assert near > 20
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for tile in (1024, 4):
        monkeypatch.setattr(jaccard, "TILE", tile)
        assert {x["doc_id"] for x in corpus_pipeline.near_duplicates(spark, df, "").collect()} == set(up.values())
    assert sorted(x["doc_id"] or 0 for x in jaccard.keep_first(odd).collect()) == [0, 1, 2, 4, 6, 7]
    assert jaccard.keep_first(odd.limit(0)).count() == 0


def test_pairs_within_the_radius_that_share_no_band(spark):
    """Twelve words and two more: similarity 8 / 10, fingerprints within four bits, no MinHash band in common."""
    texts = []
    for seed in (289000, 372026, 422228):
        words = [f"w{seed}x{j}" for j in range(14)]
        x, y = jaccard.shingles(pa.array([" ".join(words), " ".join(words[:12])]))
        assert jaccard.similar(x, y, 0.8) and not set(jaccard.bands(x).tolist()) & set(jaccard.bands(y).tolist())
        texts += [(seed, " ".join(words)), (seed + 1, " ".join(words[:12]))]
    got = jaccard.keep_first(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in got) == [289000, 372026, 422228]


def test_pipeline_links_by_fingerprints(spark, monkeypatch):
    """What the fingerprints alone link, without bands: all that lies within the radius and is similar, and nothing else."""
    r = random.Random(8)
    base = [[f"w{r.randrange(5000)}" for _ in range(120)] for _ in range(12)]
    texts = []
    for i in range(150):
        t = list(r.choice(base))
        for _ in range(r.randrange(6)):
            t[r.randrange(120)] = f"n{r.randrange(10**6)}"
        texts.append((1000 - i, " ".join(t)))
    sets = jaccard.shingles(pa.array([t for _, t in texts]))
    bits = [sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in s.tolist()) > len(s)) for s in sets]
    assert bits == [simhash.of_hashes(s) for s in sets]
    up = {i: i for i, _ in texts}
    beyond = 0
    for x in range(len(texts)):
        for y in range(x):
            common = len(set(sets[x].tolist()) & set(sets[y].tolist()))
            if common >= 0.8 * (len(sets[x]) + len(sets[y]) - common):
                if (bits[x] ^ bits[y]).bit_count() <= jaccard.RADIUS:
                    a, b = sorted((up[texts[x][0]], up[texts[y][0]]))
                    up = {k: a if v == b else v for k, v in up.items()}
                else:
                    beyond += 1
    assert beyond and 12 < len(set(up.values())) < 140
    monkeypatch.setattr(jaccard, "_banded", lambda classes, folder, least: classes.sparkSession.createDataFrame([], "a long, b long"))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for tile in (4096, 4):
        monkeypatch.setattr(simhash, "TILE", tile)
        assert {x["doc_id"]: x["component_id"] for x in jaccard.near_duplicates(df).collect()} == up


@pytest.mark.parametrize("n", [10, 200])
def test_confirmed_links(n):
    """Few rows and bit planes: within the radius and confirmed, in one tile and between two."""
    r = np.random.default_rng(3)
    fp = r.integers(0, 2**64, 2 * n, dtype=np.uint64)
    fp[n:] = fp[:n] ^ np.uint64(5)
    for tile in (np.repeat([0, 1], n), np.zeros(2 * n, int)):
        got = simhash.meeting(fp, tile, 2, lambda i, j: min(i, j) % 2 == 0)
        assert sorted(got) == [(i, i + n) for i in range(0, n, 2)]


# ---------------------------------------------------------------- neighbours


def test_neighbours(spark, monkeypatch):
    monkeypatch.setattr(mih, "ENTRIES", 300)
    monkeypatch.setattr(mih, "CHUNK", 5)
    short = []
    monkeypatch.setattr(mih, "scanned", lambda rows, asks, k, own=mih.scanned: short.append(asks.count()) or own(rows, asks, k))
    r = np.random.default_rng(6)
    centres = r.standard_normal((20, 32))
    x = (centres[r.integers(0, 20, 1500)] + 0.4 * r.standard_normal((1500, 32))).astype(np.float32)
    x[100] = x[7]
    odd = [(2000, None), (2100, [0.0] * 32), (2200, [float("nan")] * 32), (2300, [1.0, None] * 16), (2400, [1.0]), (None, x[0].tolist()), (100, x[100].tolist())]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + odd
    df = spark.createDataFrame([(*x, 1, 2, 3, 4) for x in rows], "vec_id long, embedding array<float>, id int, v int, rank int, score int")
    got = mih.nearest(df).collect()
    assert sum(short) <= 3  # of 15 queries; the others were answered by the index
    assert {g["query_id"] for g in got} == set(range(0, 1500, 100))
    hit = 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        d[q] = np.inf
        best = np.lexsort((np.arange(1500), d))[:10]
        own = sorted((g for g in got if g["query_id"] == q), key=lambda g: g["rank"])
        assert [g["rank"] for g in own] == list(range(1, 11)) and [g["score"] for g in own] == sorted(d[g["vec_id"]] for g in own)
        hit += len(set(best.tolist()) & {g["vec_id"] for g in own})
    assert hit >= 0.95 * 150


def test_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    got = mih.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0])], schema)).collect()
    assert [(g["rank"], g["vec_id"]) for g in got] == [(1, 1), (2, 2)] and got[0]["score"] == 0
    assert mih.nearest(spark.createDataFrame([(0, [1.0])], schema)).count() == 0
    assert mih.nearest(spark.createDataFrame([], schema)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**9), st.integers(0, 3), st.sampled_from([0, 2, 5]), st.integers(20, 384))
def test_probing_retrieves_by_pigeonhole(seed, near, high, radius):
    """Over all substrings and groups: every pair within near bits in some substring and the radius in all, once."""
    r = np.random.default_rng(seed)
    asked = r.integers(0, 2**64, (4, 6), dtype=np.uint64)
    codes = np.concatenate([r.integers(0, 2**64, (60, 6), dtype=np.uint64), asked[r.integers(0, 4, 60)] ^ (r.integers(0, 2**64, (60, 6), dtype=np.uint64) & r.integers(0, 2**64, (60, 6), dtype=np.uint64) & r.integers(0, 2**64, (60, 6), dtype=np.uint64))])
    values, got = mih.substrings(codes), []
    for sub in range(24):
        first = values[:, sub] >> 16 - high
        for g in np.unique(first):
            own = np.flatnonzero(first == g)
            q, e = mih.search_group(sub, high, values[own, sub], codes[own], asked, near, radius)
            got += zip(q.tolist(), own[e].tolist())
    by = np.bitwise_count((asked[:, None] ^ codes[None]).view("<u2").reshape(4, 120, 24))
    want = np.argwhere((by.min(axis=2) <= near) & (by.sum(axis=2) <= radius))
    assert sorted(got) == [tuple(x) for x in want.tolist()]
    assert {(i, j) for i, j in np.argwhere(by.sum(axis=2) <= min(radius, 24 * (near + 1) - 1)).tolist()} <= set(got)


def test_far_queries_are_scanned(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((600, 8)) * 0.01 + r.standard_normal(8)
    x[500] = -50 * x[0]  # far from all: no probe reaches any
    got = mih.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    d = np.sqrt(((x - x[500]) ** 2).sum(axis=1))
    d[500] = np.inf
    assert [g["vec_id"] for g in sorted(got, key=lambda g: g["rank"]) if g["query_id"] == 500] == np.argsort(d, kind="stable")[:10].tolist()


def test_ties_at_the_last_rank(spark):
    rows = [(0, [1.0, 0.0]), *((i, [1.0, 1.0]) for i in range(1, 30))]
    got = mih.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert [g["vec_id"] for g in sorted(got, key=lambda g: g["rank"])] == list(range(1, 11))


# ---------------------------------------------------------------- line dedup


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=20), st.lists(st.integers(0, 6), max_size=20))
def test_align(a, b):
    pairs = linedup.align(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
    if a == b:
        assert len(pairs) == len(a)


def passage(seed, n=60):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n)) + "."


def test_line_dedup(spark):
    p, q, own = passage(1), passage(2), [passage(10 + i) for i in range(9)]
    short = "A short line."
    docs = [
        (5, f"{own[0]}\n{p}\n{own[1]}"), (3, f"{short}\n{p}\n{q}"), (9, f"{own[2]} {p} {q} {own[3]}"), (8, f"{short}\n{own[4]}"), (7, own[5]), (4, own[5]),
        (20, None), (21, ""), (None, p), (9, f"{own[2]} {p} {q} {own[3]}"), (22, f"{own[6]}\n\n{p}\n\n{own[7]}\n"),
    ]
    rows = linedup.dedup(spark.createDataFrame([(i, t, 7) for i, t in docs], "doc_id long, text string, words int")).collect()
    got = {(r["doc_id"], r["text"]) for r in rows}
    assert len(rows) == len(docs)
    assert got == {(5, f"{own[0]}\n{own[1]}"), (3, f"{short}\n{p}\n{q}"), (9, f"{own[2]} {own[3]}"), (8, f"{short}\n{own[4]}"), (7, ""), (4, own[5]), (20, None), (21, ""), (None, p), (22, f"{own[6]}\n\n{own[7]}\n")}
    assert {r["doc_id"]: r["removed_words"] for r in rows if r["doc_id"]}[9] == 120
    assert linedup.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=14), st.lists(st.integers(0, 3), max_size=14), st.integers(1, 6))
def test_repeats(a, b, least):
    words = [x % 3 + 1 for x in a]
    runs = [range(i, j) for i in range(len(a)) for j in range(i + 1, len(a) + 1) if sum(words[i:j]) >= least and any(a[i:j] == b[k : k + j - i] for k in range(len(b)))]
    assert linedup.repeats(a, b, words, least) == sorted({p for r in runs for p in r})


def test_line_dedup_of_repeated_passages(spark):
    p, q, own = passage(4, 12), passage(5, 13), [passage(30 + i) for i in range(4)]
    docs = [(1, f"{own[0]}\n{p}\n{q}\n{own[1]}"), (2, "\n".join([own[2], p, q, own[3], p, q, p, q]))]
    got = {r["doc_id"]: (r["text"], r["removed_words"]) for r in linedup.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: (docs[0][1], 0), 2: (f"{own[2]}\n{own[3]}", 75)}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(1, 5), max_size=8), min_size=1, max_size=4), st.integers(1, 9))
def test_runs(texts, least):
    words = np.array([w for t in texts for w in t], np.int64)
    at = np.r_[0, np.cumsum([len(t) for t in texts])]
    h = np.arange(len(words), dtype=np.uint64)
    got, first = linedup.runs(h, words, at, least)
    for t, (lo, hi) in enumerate(zip(at, at[1:])):
        spans = [(i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1) if sum(words[i:j]) >= least]
        want = [(i, j) for i, j in spans if (i, j - 1) not in spans or (i + 1, j) not in spans]
        plain = linedup.C.span_hashes(h, np.array([i for i, _ in want], int), np.array([j for _, j in want], int))
        assert sorted(got[first[t] : first[t + 1]]) == sorted(plain)


def test_line_dedup_of_passages_whose_units_stand_elsewhere(spark):
    parts, own = [passage(50 + i, 14) for i in range(4)], [passage(60 + i) for i in range(7)]
    docs = [(i + 1, f"{own[i]}\n{parts[i]}") for i in range(4)]
    docs += [(8, "\n".join([own[4], *parts])), (9, "\n".join([own[5], *parts, own[6]]))]
    rows = {r["doc_id"]: (r["text"], r["removed_words"]) for r in linedup.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert rows == {**{i: (t, 0) for i, t in docs}, 9: (f"{own[5]}\n{own[6]}", 56)}


def test_many_sharers_make_few_pairs(spark):
    p = passage(3)
    docs = spark.createDataFrame([(i, f"{passage(100 + i)}\n{p}") for i in range(300)], "doc_id long, text string")
    gone = linedup.deletions(docs).collect()
    assert {r["id"] for r in gone} == set(range(1, 300)) and len(gone) == 299
    left = {r["doc_id"]: (r["text"], r["removed_words"]) for r in linedup.dedup(docs).collect()}
    assert left == {0: (f"{passage(100)}\n{p}", 0), **{i: (passage(100 + i), 60) for i in range(1, 300)}}


def plain_line_dedup(docs, least):
    """Words that each document loses, by comparing it with all earlier ones: units in runs of ``least`` words or more that an
    earlier document holds as they stand."""
    own = {}
    for i, t in docs:
        raw = np.frombuffer(t.encode(), np.uint8)
        _, words, s, e, _ = linedup.units(raw, np.array([0, len(raw)]))
        own[i] = ([bytes(raw[a:b]) for a, b in zip(s, e)], words.tolist())
    out = {}
    for i, (u, w) in own.items():
        lost = set()
        for a in range(len(u)):
            for b in range(a + 1, len(u) + 1):
                if sum(w[a:b]) >= least and any(v[k : k + b - a] == u[a:b] for j, (v, _) in own.items() if j < i for k in range(len(v))):
                    lost |= set(range(a, b))
        out[i] = sum(w[x] for x in lost)
    return out


def test_line_dedup_is_all_pairs(spark):
    """Random corpora of few sentences: passages of several owners, repeated inside documents, reordered and cut."""
    for seed in range(3):
        r = random.Random(seed)
        lines = [" ".join(r.choice("abcdefgh") + str(r.randrange(5)) for _ in range(r.randrange(2, 30))) + r.choice(["", "."]) for _ in range(5)]
        docs = [(i, "".join(r.choice(lines) + r.choice(["\n", " "]) for _ in range(r.randrange(1, 9)))) for i in r.sample(range(1000), 24)]
        got = {x["doc_id"]: x["removed_words"] for x in linedup.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
        assert got == plain_line_dedup(docs, 20) and sum(got.values()) > 0


def test_passages_inside_lines_without_punctuation(spark):
    """Passages of 51 words and more go but for WINDOW - 1 words at either end, wherever they stand."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 7)))
    shared = [[word() for _ in range(n)] for n in (51, 60, 300)]
    docs, own = [], {}
    for i in range(12):
        parts = [[word() for _ in range(r.randrange(20, 60))] for _ in range(4)]
        docs.append((i, " ".join(w for p in [parts[0], shared[0], parts[1], shared[1], parts[2], shared[2], parts[3]] for w in p)))
        own[i] = sum(len(p) for p in parts)
    rows = {x["doc_id"]: (x["text"], x["removed_words"]) for x in linedup.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert rows[0] == (docs[0][1], 0)
    for i in range(1, 12):
        kept = len(rows[i][0].split())
        assert own[i] <= kept <= own[i] + 3 * 2 * (linedup.WINDOW - 1)


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s, s.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 2048])
def test_nothing_unequal_is_deleted(spark, n):
    """Words whose polynomial hashes modulo 2**64 agree whatever the multiplier."""
    a, b = thue_morse(n)
    tail = " ".join(["x"] * 40)
    docs = [(1, f"{a} {tail}"), (2, f"{b} {b}"), (3, " ".join([a] * 30)), (4, " ".join([b] * 30))]
    rows = {r["doc_id"]: r["text"] for r in linedup.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert rows == dict(docs)


@pytest.mark.parametrize("shards", [1, 7, 200])
def test_deletions_are_found_by_id_and_text(spark, shards):
    """Each row its own list, also where an id has several texts; nothing for other rows."""
    want = {(i, i * 7 % 5 - 2): list(range(i % 4 + 1)) for i in range(-50, 300)} | {(5, x): [x] for x in range(20, 40)}
    gone = spark.createDataFrame([(i, t, u) for (i, t), u in want.items()], "id long, t long, gone array<int>")
    table = linedup.Deletions.write(gone, shards)
    asked = [*want, (1000, 1), (5, 41)]
    keys = spark.createDataFrame(asked, "id long, t long").selectExpr("id", "t", "xxhash64(id, t) AS k").toPandas()
    got = table.find(keys["k"].to_numpy().view(np.uint64), keys["id"].to_numpy(), keys["t"].to_numpy())
    assert {(int(keys["id"][i]), int(keys["t"][i])): u for i, u in got.items()} == want
    # Keys that all lead to one entry, as if they collided: only its own row is found.
    same = np.full(len(keys), keys["k"].to_numpy()[0]).view(np.uint64)
    assert table.find(same, keys["id"].to_numpy(), keys["t"].to_numpy()) == {0: want[asked[0]]}


def test_line_dedup_odd_rows(spark, odd):
    p = passage(77)
    df = odd.withColumns({"removed_units": F.lit(1), "removed_words": F.lit("x"), "__gone": F.lit(2)}).drop("__gone")
    long = spark.createDataFrame([(100, f"{p}\n" * 2000, 1, "x", 1, "y"), (101, f"{p}\n{passage(78)}", 1, "x", 1, "y")], df.schema)
    got = {r["doc_id"]: r for r in linedup.dedup(df.unionByName(long)).collect()}
    assert got[101]["text"] == passage(78) and got[101]["removed_words"] == 60 and got[100]["removed_words"] == 0
    assert got[7]["text"] == ODD[-1][1] and got[3]["text"] is None and got[2]["text"] == "" and got[None]["text"] == "a b"
    assert got[1].asDict().keys() == set(df.columns)


# ---------------------------------------------------------------- transport streams


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 1200) | st.sampled_from([mpegts.UNIT - 1, mpegts.UNIT, mpegts.UNIT + 1, 40 * mpegts.UNIT + 7]), st.integers(0, 255))
def test_stream_round_trip(n, seed):
    payload = bytes((i * 31 + seed) % 256 for i in range(n))
    media = mpegts.write_stream(payload)
    got = mpegts.read_stream(media)
    units = max(1, -(-n // mpegts.UNIT))
    assert got["payload"] == payload and got["error"] is None and got["continuity_errors"] == got["duplicates"] == 0
    assert got["programs"] == [(1, 0x1000)] and got["streams"] == [(0x100, 6)] and len(media) == 188 * got["packets"]
    assert got["timestamps"] == [i * mpegts.UNIT * 90_000 // 8_000 for i in range(units)] == got["clocks"] and len(got["random_access"]) == units


def test_damaged_streams():
    media = mpegts.write_stream(bytes(5000))
    cut = media[: 188 * 5] + media[188 * 7 :]
    assert mpegts.read_stream(cut)["continuity_errors"] == 1
    twice = media[: 188 * 6] + media[188 * 5 :]
    got = mpegts.read_stream(twice)
    assert got["duplicates"] == 1 and got["payload"] == bytes(5000)
    for bad in (b"", b"x" * 188, b"hello", media[:-1], media[188:]):
        assert mpegts.read_stream(bad)["error"]


def test_streams_of_others():
    """A section over two packets, a network table as program 0, an announced discontinuity, a counter repeated by other bytes."""
    names = b"".join(bytes([6]) + (0xE100 + i).to_bytes(2, "big") + b"\xf0\0" for i in range(60))
    pat = mpegts._section(0, 1, b"\0\0\xe0\x10" + (1).to_bytes(2, "big") + b"\xf0\0")
    pmt = mpegts._section(2, 1, b"\xe1\0\xf0\0" + names)
    first = bytes([0x47, 0x50, 0, 0x10, 0]) + pmt[:183]
    rest = bytes([0x47, 0x10, 0, 0x11]) + pmt[183:]
    network = mpegts._table_packet(0x10, mpegts._section(2, 0, b"\xe2\0\xf0\0\x06\xe2\0\xf0\0")).tobytes()
    media = mpegts.write_stream(bytes(3000))
    own = [media[i : i + 188] for i in range(376, len(media), 188)]
    got = mpegts.read_stream(mpegts._table_packet(0, pat).tobytes() + network + first + rest.ljust(188, b"\xff") + b"".join(own))
    assert got["programs"] == [(0, 16), (1, 0x1000)] and got["streams"] == [(0x100 + i, 6) for i in range(60)] and got["payload"] == bytes(3000)
    tables = media[:376]
    jump = bytearray(own[5])
    jump[3] = jump[3] & 0xF0 | 12
    assert mpegts.read_stream(tables + b"".join([*own[:5], bytes(jump), *own[6:]]))["continuity_errors"] == 2
    announced = bytes([0x47, 1, 0, 0x30 | 12, 1, 0x80]) + own[5][4:186]
    assert mpegts.read_stream(tables + b"".join([*own[:5], announced]))["continuity_errors"] == 0
    other = bytearray(own[4])
    other[100] ^= 1
    got = mpegts.read_stream(tables + b"".join([*own[:5], bytes(other), *own[5:]]))
    assert got["duplicates"] == 0 and got["continuity_errors"] == 1
    cut = mpegts.read_stream(tables + b"".join(own[:5]))
    assert cut["error"] == "cut elementary packet" and 0 < len(cut["payload"]) < 3000


def test_stream_operator(spark, odd):
    assert set(mpegts.digests(odd.withColumn("feature", F.lit(1)), keep=("doc_id", "feature")).columns) == set(mpegts.digests(odd).columns)
    got = {r["doc_id"]: r for r in mpegts.digests(odd).collect()}
    for i, t in ODD:
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (got[i]["payload_sha256"], got[i]["tail_crc32"]) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert got[i]["n_bytes"] == len(raw) and got[i]["payload_bytes"] == len(payload)
    null = mpegts.read_media(mpegts.write_media(spark.createDataFrame([(1, None)], "doc_id long, payload binary"), keep=["doc_id"]), keep=["doc_id"]).first()
    assert null["payload"] is None and null["packets"] is None


# ---------------------------------------------------------------- all together


@pytest.mark.parametrize("name", queries.QUERIES)
def test_queries_cover_their_table(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    rows = df.collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").count()
    if name.startswith("op6"):
        assert len(rows) == 50
    elif name.startswith("op3"):
        assert len({r["doc_id"] for r in rows}) == docs
    else:
        assert len(rows) == docs


def test_pipeline(spark, sf):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["quality", "toxicity", "line_dedup", "near_duplicates", "packing"]
    before = docs
    for name, stage in P.STAGES[:-1]:
        after = stage(spark, before, sf)
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
        ids = {r["doc_id"] for r in after.select("doc_id").collect()}
        assert ids <= {r["doc_id"] for r in before.select("doc_id").collect()} and len(ids) > 0.7 * before.count(), name
        if name == "line_dedup":
            assert len(ids) == before.count()
        before = after
    got = P.run(spark, sf).collect()
    assert {r["doc_id"] for r in got} == ids


def test_pipeline_odd_rows(spark, sf):
    """Each stage on nulls, empty and long texts, repeated rows, more columns, and no rows at all."""
    import corpus_pipeline as P

    docs = spark.createDataFrame([(i, t, "en", "a", 3, "x", 0.5) for i, t in ODD], "doc_id long, text string, lang string, source string, n_chars long, fp string, score double")
    for name, stage in P.STAGES:
        got = stage(spark, docs, sf)
        none = stage(spark, docs.limit(0), sf)
        assert none.count() == 0
        if name == "packing":
            assert {r["doc_id"] for r in got.collect()} == {i for i, _ in ODD}
        else:
            assert got.columns == docs.columns == none.columns
            rows = got.collect()
            assert {r["text"] for r in rows} <= {t for _, t in ODD} and rows
            assert len(rows) == len(ODD) if name in ("toxicity", "line_dedup") else len(rows) <= len(ODD)


def test_registered():
    import __spark_entry__ as e

    names = [n for n in e.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in e.queries()


def test_held_out_labels_on_the_tables(spark):
    """Both classifiers on the larger test table, on labels they did not learn from."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for query, label in ((queries.op7_quality, "quality"), (queries.op4_toxicity, "toxic")):
        rows = query(spark, sf).where("held_out").join(labels, "doc_id").collect()
        right = sum(r["predicted"] == r[label] for r in rows) / len(rows)
        assert right >= 0.98, (label, right)
