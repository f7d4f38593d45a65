"""Word hashing, Kneser-Ney against brute force, the two classifiers, byte-level BPE."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilspan.llm import bpe, kneser_ney, labelled, packing, quality, toxicity
from veilspan.llm import common as C
from veilspan.llm import toxicity as T

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
ODD = [(1, "a b a b"), (2, ""), (3, None), (4, "A  b\tc\n"), (5, " " * 5), (None, "a b"), (1, "a b a b"), (6, "é ü 🙂 x"), (7, "word " * 30_000)]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in ODD], "doc_id long, text string, score int, n_tokens int")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("aAbé \t\n\v,."), max_size=30), min_size=1, max_size=6), st.integers(1, 40))
def test_words(texts, limit):
    raw, off = C.text_bytes(pa.array(texts))
    h, at = C.words(raw, off, limit)
    known: dict = {}
    for i, t in enumerate(texts):
        own = t.encode().lower().split()
        assert at[i + 1] - at[i] == len(own)
        for w, x in zip(own, h[at[i] : at[i + 1]].tolist()):
            assert known.setdefault(w, x) == x
    assert len(set(known.values())) == len(known)


def brute_force(rows, learn):
    tok = [[*(t or "").encode().lower().split(), "end"] for _, t in rows]
    c, bi = Counter(), Counter()
    for (i, _), w in zip(rows, tok):
        if learn(i):
            c.update(w)
            bi.update(zip(["begin", *w], w))
    before = Counter(w for _, w in bi)

    def discounts(x):
        n = Counter(x.values())
        return kneser_ney._discounts([n[i] for i in (1, 2, 3, 4)])

    d1, d2 = discounts(before), discounts(bi)
    total, kinds = Counter(), defaultdict(Counter)
    for (v, _), n in bi.items():
        total[v] += n
        kinds[v][min(n, 3)] += 1
    N, V, B = sum(c.values()), len(c), len(bi)
    left = sum(d1[min(n, 3) - 1] for n in before.values()) / B if B else 1

    def p(v, w):
        low = (max(before[w] - d1[min(before[w], 3) - 1], 0) / B if before[w] else 0) + left / (V + 1)
        if not total[v]:
            return low
        n = bi[v, w]
        return (max(n - d2[min(n, 3) - 1], 0) if n else 0) / total[v] + sum(d2[k - 1] * x for k, x in kinds[v].items()) / total[v] * low

    return [(len(w), sum(x in c for x in w), N, sum(math.log10((c[x] + 0.5) / (N + 0.5 * (V + 1))) for x in w), sum(math.log10(p(v, x)) for v, x in zip(["begin", *w], w))) for w in tok]


def close(got, want):
    assert len(got) == len(want)
    for g, w in zip(sorted(got), sorted(want)):
        assert g == pytest.approx(w, abs=1e-6)


def test_kneser_ney(spark):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice("the of a cat dog sat on mat x y z".split()) for _ in range(r.randrange(12)))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    got = kneser_ney.train_and_score(df, C.fold(F.col("doc_id")) != 1, keep=["doc_id"])
    close([(x["n_tokens"], x["n_known"], x["train_tokens"], x["base_score"], x["score"]) for x in got.collect()], brute_force(rows, lambda i: fold(i) != 1))


@pytest.mark.parametrize("shards", [3, 64, 96, 200])
def test_pairs_of_a_context_share_its_shard(shards):
    edge = np.array([(s << 64) // shards for s in range(1, shards)], np.uint64)
    r = np.random.default_rng(1)
    v = np.repeat(np.r_[edge, edge - np.uint64(1), edge + np.uint64(1)], 40)
    keys = kneser_ney.pair_keys(v, r.integers(0, 2**64, len(v), dtype=np.uint64), np.array([kneser_ney.BEGIN]))

    def shard(hashes):
        return {int(h): s for s, part in C.split_by_shard(np.sort(hashes), shards) for h in np.sort(hashes)[part]}

    of_word, of_pair = shard(v), shard(keys)
    assert all(of_word[int(a)] == of_pair[int(k)] for a, k in zip(v, keys))


@pytest.mark.parametrize("partitions", [1, 3, 7, 12, 200])
def test_kneser_ney_at_any_partition_count(spark, partitions):
    """Words whose hashes lie next to shards' bounds, as contexts; equal to brute force however many shards there are."""
    r = random.Random(8)
    many = [f"v{i}" for i in range(30_000)]
    raw, off = C.text_bytes(pa.array([" ".join(many)]))
    h = C.words(raw, off)[0]
    edges = np.array([(s << 64) // n for n in (3, 7, 12, 200) for s in range(1, n)], np.uint64)
    order = np.argsort(h)
    at = np.searchsorted(h[order], edges)
    near = [many[i] for i in order[np.unique(np.clip(np.concatenate([at - 1, at]), 0, len(h) - 1))]]
    near += ["v233977", "v1755598", "v326270", "v3394527"]
    rows = [(i, " ".join(r.choice(near) for _ in range(r.randrange(30)))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = kneser_ney.train_and_score(df, C.fold(F.col("doc_id")) != 1, keep=["doc_id"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = brute_force(rows, lambda i: zlib.crc32(str(i).encode()) % 5 != 1)
    close([(x["n_tokens"], x["n_known"], x["train_tokens"], x["base_score"], x["score"]) for x in got], want)


def test_shards_grow_with_the_bytes(spark):
    df = spark.createDataFrame([("x" * 1000,)] * 300, "text string")
    assert C.shards_for(df, ["text"]) == 4 and C.shards_for(df, ["text"], 10_000) >= 30
    assert C.shards_for(df.rdd.toDF(df.schema), ["text"], 10_000) >= 30


def test_kneser_ney_odd_rows(spark, odd):
    both = kneser_ney.train_and_score(odd, F.lit(True), keep=["doc_id", "score", "n_tokens"])  # these give way to the results
    assert both.columns == ["doc_id", "n_tokens", "n_known", "base_score", "score", "train_tokens", "perplexity"] and both.count() == len(ODD)
    got = kneser_ney.train_and_score(odd, F.lit(True), keep=["doc_id"]).collect()
    close([(x["n_tokens"], x["n_known"], x["train_tokens"], x["base_score"], x["score"]) for x in got], brute_force(ODD, lambda i: True))
    assert all(x["score"] == 0 for x in kneser_ney.train_and_score(odd, F.lit(False), keep=["doc_id"]).collect())
    assert kneser_ney.train_and_score(odd.limit(0), F.lit(True), keep=["doc_id"]).count() == 0


def test_probabilities_sum_to_one(spark):
    df = spark.createDataFrame([(1, "a b c a b d a"), (2, "b b a"), (3, "c a")], "doc_id long, text string")
    m = kneser_ney.train(df)
    words = ["a", "b", "c", "d", "nothing"]
    for ctx in ("a", "b", "unseen"):
        texts = [f"{ctx} {w}" for w in words]
        w, begins = kneser_ney._tokens(pa.array(texts))
        logs, _ = kneser_ney.log_probabilities(m, w, begins)
        end = kneser_ney.log_probabilities(m, *kneser_ney._tokens(pa.array([ctx])))[0][1]
        assert sum(10 ** logs[begins[:-1] + 1]) + 10**end == pytest.approx(1)


# ---------------------------------------------------------------- BPE


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(RANKS)


@pytest.fixture(scope="module")
def library(codec):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def test_perfect_hash(codec):
    assert all(codec.whole.keys[codec.whole.get(k)] == k for k in codec.ranks)
    assert sorted(codec.whole.slot.tolist()) == list(range(len(codec.ranks)))
    assert codec.whole.get(b"\xff\xfe not there") == -1


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "Bé", " ", "  ", "\n", "'", "'s", "'re", "'ll", "1٣", "!?", " ", "中", "🙂", "\r\n", "<|endoftext|>", "ve", "Ᲊ", "\U00010d40"]) | st.characters(codec="utf-8"), max_size=25).map("".join), min_size=1, max_size=5))
def test_bpe_is_the_library_s(codec, library, texts):
    ids, at = codec.encode(texts)
    for i, t in enumerate(texts):
        own = ids[at[i] : at[i + 1]].tolist()
        assert own == library.encode_ordinary(t) == codec.encode_plainly(t)
        assert codec.decode(own) == t.encode()


def test_bpe_long_text_and_small_cache(codec, library, monkeypatch):
    monkeypatch.setattr(bpe, "ARENA", 50)
    monkeypatch.setattr(bpe, "PIECE", 64)
    t = " ".join(f"wörd{i} {i}" for i in range(3000)) + "x" * 500
    ids, at = codec.encode([t, None, "", t])
    assert ids[: at[1]].tolist() == library.encode_ordinary(t) == ids[at[3] :].tolist() and at[1] == at[2] == at[3]


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s, s.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [64, 256, 1024, 2048])
def test_words_that_polynomials_confuse(spark, codec, library, n):
    a, b = thue_morse(n)
    h, _ = C.words(*C.text_bytes(pa.array([f"{a} {b}"])))
    assert h[0] != h[1]
    ids, at = codec.encode([a, b, a])
    assert ids[at[1] : at[2]].tolist() == library.encode_ordinary(b) and ids[at[2] :].tolist() == library.encode_ordinary(a)
    t = packing.Tokenizer(JSON, RANKS)
    ids, at = t([a, b])
    assert ids[at[1] :].tolist() == t.own.encode(b, add_special_tokens=False).ids
    df = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    got = {x["doc_id"]: (x["n_known"], x["train_tokens"]) for x in kneser_ney.train_and_score(df, F.col("doc_id") == 1, keep=["doc_id"]).collect()}
    assert got == {1: (2, 2), 2: (1, 2)}


def test_bpe_with_hashes_that_collide(codec, library, monkeypatch):
    """Whatever the hash, the ids' bytes are the text's."""
    own = bpe.Codec(RANKS)
    monkeypatch.setattr(C, "span_hashes", lambda symbols, starts, ends: (ends - starts).astype(np.uint64))
    texts = ["one two three four", "six ten", "été à la mer", None, "one two"]
    ids, at = own.encode(texts)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == library.encode_ordinary(t or "")


def test_bpe_operator(spark, odd):
    clash = odd.withColumn("ids", F.lit(1))
    assert bpe.encode(clash, RANKS, keep=["doc_id", "ids", "n_tokens"]).columns == ["doc_id", "ids", "n_tokens"]
    assert bpe.round_trip(odd, RANKS, keep=["doc_id", "n_tokens"]).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    import hashlib

    got = bpe.round_trip(odd, RANKS, keep=["doc_id"]).collect()
    want = sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in ODD)
    assert sorted(r["decoded_sha256"] for r in got) == want
    e = bpe.encode(odd, RANKS, keep=["doc_id"])
    assert sorted(bytes(r["decoded"]) for r in bpe.decode(e, RANKS, keep=["doc_id"]).collect()) == sorted((t or "").encode() for _, t in ODD)


def test_tokenizer_is_the_file_s():
    t = packing.Tokenizer(JSON, RANKS)
    texts = ["a b", "", None, "x<|endoftext|>  y 's", "naïve 🙂\n\n z"]
    for own in (t, packing.Tokenizer(JSON)):
        ids, at = own(texts)
        for i, x in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == t.own.encode(x or "", add_special_tokens=False).ids


# ---------------------------------------------------------------- classifiers


def labelled_rows(spark, n=600):
    r = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(r.choice("aeioulnrst") for _ in range(r.randrange(2, 8))) for _ in range(r.randrange(20, 80))]
        bad, toxic = r.random() < 0.3, r.random() < 0.3
        if bad:
            words = [w.upper() + "!!" for w in words]
        if toxic:
            words[r.randrange(len(words))] = r.choice(["idiot", "moron", "zargel", "zargon"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(scored, labels, label, least):
    rows = scored.join(labels, "doc_id").where(C.fold(F.col("doc_id")) == 0).collect()
    assert len(rows) > 50
    return sum((r["score"] >= least) == bool(r[label]) for r in rows) / len(rows)


def test_quality(spark, odd):
    docs, labels = labelled_rows(spark)
    model = quality.train(docs, labels)
    assert accuracy(quality.score(docs, model, keep=["doc_id"]), labels, "quality", 0.3) >= 0.97
    assert quality.score(odd, model, keep=["doc_id"]).count() == len(ODD)
    assert {r["score"] for r in quality.score(odd, quality.train(docs.limit(0), labels), keep=["doc_id"]).collect()} == {0.5}


def test_ftrl_is_the_plain_one():
    """Weights by a loop over rows and features, with the same order of rows."""
    r = random.Random(2)
    texts = [" ".join(r.choice("a b c d E F1 .").strip() for _ in range(r.randrange(1, 9))) for _ in range(40)]
    y = np.array([r.randrange(2) for _ in texts])
    got = quality.fit(pa.chunked_array([pa.array(texts)]), y)
    rows = []
    for t in texts:
        number, value, _ = quality.features(pa.array([t]))
        x: dict = defaultdict(float)
        for j, v in zip(number.tolist(), value.tolist()):
            x[j] += v
        x[quality.INTERCEPT] = 1.0
        rows.append({j: float(np.float32(v)) for j, v in x.items()})
    z, n = defaultdict(float), defaultdict(float)

    def weight(j):
        return 0.0 if abs(z[j]) <= quality.L1 else -(z[j] - math.copysign(quality.L1, z[j])) / ((quality.BETA + math.sqrt(n[j])) / quality.ALPHA + quality.L2)

    shuffle = np.random.default_rng(7)
    for _ in range(quality.PASSES):
        for i in shuffle.permutation(len(rows)).tolist():
            w = {j: weight(j) for j in rows[i]}
            p = 1 / (1 + math.exp(-sum(w[j] * v for j, v in rows[i].items())))
            for j, v in rows[i].items():
                g = (p - y[i]) * v
                z[j] += g - (math.sqrt(n[j] + g * g) - math.sqrt(n[j])) / quality.ALPHA * w[j]
                n[j] += g * g
    assert np.allclose(got[list(z)], [weight(j) for j in z], atol=1e-4) and np.count_nonzero(got) == sum(weight(j) != 0 for j in z)


PARTS = ["you", "are", "a", "total", "idiot", "piece", "of", "shit", "not", "said", "will", "kill", "stupid", "the", "dog", ".", "to", "go", "hell"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=14), min_size=1, max_size=3))
def test_grammar_is_the_plain_one(texts):
    """Tags and readings by loops over words and clauses."""
    known, longest = {}, {}
    lists = ((T.REPORT, T.REPORTS), (T.NEGATION, T.NEGATIONS), (T.TARGET, T.TARGETS), (T.INTENT, T.INTENTS), (T.STRONG, T.STRONG_WORDS), (T.THREAT, T.THREATS), (T.INSULT, T.INSULTS))
    for tag, own in lists:
        known.update(dict.fromkeys(own, tag))
    for tag, own in ((T.INSULT, T.INSULT_PHRASES), (T.THREAT, T.THREAT_PHRASES)):
        longest.update({tuple(x.split()): tag for x in own})
    g = T.fit(pa.chunked_array([pa.array([], pa.string())]), np.zeros(0, np.int64))
    got = T.clause_features(T.split(pa.array([" ".join(t) for t in texts])), *T._arrays(g), T.machine())
    for i, t in enumerate(texts):
        clauses, want = [[]], np.zeros(len(T.READINGS))
        for x in t:
            clauses.append([]) if x == "." else clauses[-1].append(x)
        for c in clauses:
            tags = [known.get(x, T.WORD) for x in c]
            for size in range(2, T.LONGEST + 1):
                for k in range(size, len(c) + 1):
                    tags[k - 1] = longest.get(tuple(c[k - size : k]), tags[k - 1])
            if not {T.INSULT, T.THREAT} & set(tags):
                continue
            score = 0.0
            for k, tag in enumerate(tags):
                if tag not in (T.INSULT, T.THREAT):
                    continue
                before = lambda kinds, reach: any(x in kinds for x in tags[max(0, k - reach) : k])  # noqa: B023, E731
                strong, meant = tag == T.INSULT and before((T.STRONG, T.INSULT), 2), tag == T.THREAT and before((T.INTENT,), 3)
                neg, rep, aim = before((T.NEGATION,), 3), before((T.REPORT,), len(tags)), before((T.TARGET,), 3)
                want[neg * 4 + rep * 2 + aim + (8 if tag == T.THREAT else 0)] += 1
                want[16] += strong
                want[17] += meant
                score += math.exp(0.5 * strong + (1.0 if meant else -1.0) * (tag == T.THREAT) - 1.5 * neg - 0.7 * rep + 0.7 * aim)
            want[18] = max(want[18], score)
        want[:18] = np.sqrt(want[:18])
        assert np.allclose(got[i], want), (t, got[i], want)


def test_entries_of_two_words_are_learnt():
    r = random.Random(4)
    texts, y = [], []
    for i in range(400):
        words = [r.choice("grey moon river stone walks on by the far old sea".split()) for _ in range(40)]
        bad = i % 4 == 0
        words[10:12] = ["blue", "lamp"] if bad else [("blue", "red")[i % 2], ("cup", "lamp")[i % 2]] if i % 4 != 3 else ["lamp", "blue"]
        texts.append(" ".join(words))
        y.append(int(bad))
    g = T.fit(pa.chunked_array([pa.array(texts)]), np.array(y))
    assert g.tags[g.hashes.index(T.word_key("blue lamp"))] == T.INSULT
    p = T.clause_features(T.split(pa.array(["the blue lamp", "a lamp. blue", "blue. lamp", "the red lamp"])), *T._arrays(g), T.machine())
    assert p[0, -1] > 0 and not p[1:].any()


def test_classifiers_on_odd_rows(spark, odd):
    """Scores as the docstrings define them: by the intercept for empty texts, equal for equal texts, whole long texts."""
    docs, labels = labelled_rows(spark)
    for op, label in ((quality, "quality"), (toxicity, "toxic")):
        model = op.train(docs, labels, label)
        clash = odd.withColumn("score", F.lit("x"))
        got = op.score(clash, model, keep=["doc_id", "text", "score"]).collect()
        by = defaultdict(set)
        for r in got:
            by[r["text"] or ""].add(r["score"])
        assert got[0].asDict().keys() == {"doc_id", "text", "score"} and all(len(v) == 1 for v in by.values())
        assert by[""] == by["     "] and all(0 < s < 1 for v in by.values() for s in v)
        long = "fine calm words walk on " * 40_000
        ends = spark.createDataFrame([(1, long), (2, long + "you idiot moron"), (3, long + "IDIOT!! " * 40_000)], "doc_id long, text string")
        s = {r["doc_id"]: r["score"] for r in op.score(ends, model, keep=["doc_id"]).collect()}
        assert s[2] != s[1] and s[3] != s[2]  # the ends of long texts count
        assert op.score(odd.limit(0), model, keep=["doc_id"]).count() == 0


def test_toxicity(spark, odd):
    docs, labels = labelled_rows(spark)
    model = toxicity.train(docs, labels)
    assert accuracy(toxicity.score(docs, model, keep=["doc_id"]), labels, "toxic", 0.5) >= 0.97
    assert toxicity.word_key("zargel") in model.hashes or any(t == toxicity.INSULT for t in model.tags[-30:])
    got = toxicity.score(odd, model, keep=["doc_id"]).collect()
    assert len(got) == len(ODD) and all(r["score"] < 0.5 for r in got)
    seeds = toxicity.train(docs, labels.limit(0))
    bad = spark.createDataFrame([(1, "You are a stupid idiot."), (2, "A fine day.")], "doc_id long, text string")
    s = {r["doc_id"]: r["score"] for r in toxicity.score(bad, seeds, keep=["doc_id"]).collect()}
    assert s[1] > 0.5 > s[2]


def test_grammar_reads_clauses():
    g = toxicity.grammar()
    tag = lambda *x: [toxicity.TAGS.index(t) for t in x]
    score = lambda *x: toxicity.clause_readings(g, tag(*x), [1.0] * len(x))[1]
    assert score("negation", "insult") < score("insult") < score("target", "insult")
    assert score("report", "word", "insult") < score("insult") and score("negation", "word", "word", "word", "insult") == score("insult")
    assert toxicity.clause_readings(g, tag("negation", "report", "target", "insult"), [1.0] * 4)[0][7] == 1.0
    assert g.states == (toxicity.REACH + 1) ** 2 * 2


def test_sample(spark):
    docs, labels = labelled_rows(spark)
    both = labels.union(spark.createDataFrame([(0, 0, 1), (0, 1, 0), (None, 1, 1)], labels.schema))
    s = labelled.labelled_sample(docs, both, "quality", 50)
    assert s.count() == 50 and 0 not in {r["doc_id"] for r in s.withColumn("doc_id", F.lit(1)).collect()}
    assert labelled.labelled_sample(docs, labels.limit(0), "quality", 50).count() == 0
    hot = docs.union(docs.where("doc_id = 7").crossJoin(spark.range(5000)).select("doc_id", F.concat("text", F.lit(" "), "id")))
    assert labelled.labelled_sample(hot, labels.where("doc_id = 7"), "quality", 16).count() == 16
    seen = labelled.learn(s, lambda texts, y: iter([pa.RecordBatch.from_arrays([pa.array([len(y)])], ["n"])]), "n long", 1000)[0]["n"]
    assert 1 <= seen < 20  # of 50 rows: as many texts as 1000 bytes hold
    assert np.isfinite(toxicity.newton(np.ones((4, 1)), np.array([0.0, 1, 1, 1]))).all()
