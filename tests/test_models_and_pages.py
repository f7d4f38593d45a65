"""Decoding of synthetic logits, page geometry, recogniser passes, languages, evaluation."""

import numpy as np
import pytest

from veilspan.operators import codec as M
from veilspan.operators import evaluate, geometry, language, ocr
from veilspan.operators.pages import vote


def tokenize(text, special):
    return ([1] if special else []) + [hash(w) % 1000 + 3 for w in text.split()] + ([2] if special else [])


def test_encode_and_decode():
    spec = M.Model("m", "span", ("en",), (("private_person", "person"), ("secret", "password")), 5, 3)
    c = M.Codec(spec, tokenize)
    e = c.encode([(0, 3, "Ana"), (4, 5, " "), (6, 11, "Souza")])
    assert len(e.kept) == 2 and e.words_mask[-3:] == [1, 2, 0] and len(e.ids) == len(e.words_mask)
    assert e.span_index.tolist() == [[0, 0], [0, 1], [0, 1], [1, 1], [1, 1], [1, 1]] and e.span_mask.tolist() == [True, True, False, True, False, False]
    logits = np.full((1, 2, 3, 2), -50.0)
    logits[0, 0, 1, 0], logits[0, 1, 0, 1], logits[0, 1, 1, 0] = 50, 2, 50
    assert c.decode([e], logits, 0.5) == [(0, 11, "private_person", 1.0)]
    assert c.encode([]) is None
    with pytest.raises(TypeError):
        M.span_candidates(logits, 0, 2, 3, 0.5)
    with pytest.raises(IndexError):
        M.span_candidates(logits, 1, 2, 2, 0.5)
    with pytest.raises(TypeError):
        M.Codec(spec, lambda t, s: [])
    with pytest.raises(ValueError):
        M.Model("m", "span", (), (("secret", "x"),) * 3, 2)


def test_token_decoding():
    s = np.full((1, 4, 1, 3), -50.0)
    s[0, 0, 0, M.START] = s[0, :3, 0, M.INSIDE] = s[0, 2, 0, M.END] = 50
    s[0, 1, 0, M.INSIDE] = 1
    assert M.token_candidates(s, 0, 4, 1, 0.5) == [(0, 2, 0, pytest.approx(1 / (1 + np.exp(-1))))]
    s[0, 1, 0, M.INSIDE] = -1
    assert M.token_candidates(s, 0, 4, 1, 0.5) == []
    with pytest.raises(TypeError):
        M.token_candidates(s[..., :2], 0, 4, 1, 0.5)


def test_batches_and_feeds():
    x = [M.Encoded([0] * n, [0] * n, [(0, 1, "a")]) for n in (3, 5, 2, 9, 1)]
    assert [[len(e.ids) for e in b] for b in M.batches(x, 2, 100)] == [[3, 5], [2, 9], [1]]
    assert [[len(e.ids) for e in b] for b in M.batches(x, 9, 10)] == [[3, 5], [2], [9], [1]]
    f = M.feeds(x[:2], ["input_ids", "attention_mask"])
    assert f["input_ids"].shape == (2, 5) and f["attention_mask"].tolist() == [[1, 1, 1, 0, 0], [1] * 5]
    with pytest.raises(KeyError):
        M.feeds(x[:1], ["nope"])


def test_detector_with_fake_model():
    spec = M.Model("m", "span", ("en",), (("private_person", "person"),), 5, 2)
    c = M.Codec(spec, tokenize)

    def run(f):
        out = np.full((len(f["input_ids"]), f["words_mask"].max(), 2, 1), -50.0)
        for i, (ids, words) in enumerate(zip(f["input_ids"], f["words_mask"])):
            for t, w in zip(ids, words):
                if w and t == tokenize("Ana", False)[0]:
                    out[i, w - 1, 0, 0] = 50
        return out

    find = M.detector(c, run, ["input_ids", "words_mask"], size=4, max_words=3, overlap=1)
    text = "we saw Ana and a@b.co\nANA LIMA, DR. ANA"
    assert {text[s:e] for s, e, *_ in find(text)} == {"Ana", "a@b.co", "ANA"}
    assert find("") == []


def test_reading_order():
    word = lambda t, x, y: (t, float(x), float(y), float(x + 20), float(y + 10))
    left, right = [word("a", 0, 0), word("b", 25, 0), word("c", 0, 12)], [word("x", 200, 0), word("y", 200, 12)]
    assert [w[0] for w in geometry.in_reading_order([*right, *left])] == ["a", "b", "c", "x", "y"]
    assert geometry.in_reading_order([]) == []


def test_layer_words():
    items = [{"str": "Ana  Lima", "width": 90, "height": 10, "transform": [10, 0, 0, 10, 5, 50], "fontName": "f"}, {"str": "  ", "width": 1, "height": 1, "transform": [1, 0, 0, 1, 0, 0]}, {"str": "x", "width": 1, "height": 1, "transform": ["?"]}]
    got = geometry.layer_words(items, {"f": {"ascent": 0.8, "descent": -0.2, "fontFamily": "s"}}, [1, 0, 0, -1, 0, 100])
    assert [w[0] for w in got] == ["Ana", "Lima"] and got[0][1:] == (0.0, 42.0, 40.0, 52.0) and got[1][1] == 50.0
    assert geometry.layer_words(items, {}, None) == []


def test_cover(spark):
    rows = [(1, 0, 0, i, t, x, 0.0, x + 9, 10.0) for i, (t, x) in enumerate((("Ana", 0.0), ("Lima", 12.0), ("here", 90.0)))]
    words = geometry.place_words(spark.createDataFrame(rows, "doc_id long, unit_no int, reading_no int, word_no int, text string, x0 double, y0 double, x1 double, y1 double"))
    assert geometry.surface_texts(words).first()["text"] == "Ana Lima here"
    spans = spark.createDataFrame([(1, 0, 0, 0, 8)], "doc_id long, unit_no int, reading_no int, start int, end int")
    rects, visible = geometry.cover_units(words, spans)
    assert [(r["x"], r["width"]) for r in rects.collect()] == [(0.0, 21.0)] and [w["text"] for w in visible.collect()] == ["here"]
    pages = spark.createDataFrame([(1, 0), (1, 1)], "doc_id long, unit_no int")
    assert {r["unit_no"]: r["action"] for r in geometry.page_actions(pages, rects).collect()} == {0: "paint", 1: "copy"}


def test_pixels():
    assert ocr.binarize(np.array([0, 0, 0, 7, 200, 200, 200, 9], np.uint8)).tolist() == [0, 0, 0, 7, 255, 255, 255, 9]
    with pytest.raises(IndexError):
        ocr.binarize(np.zeros(3, np.uint8))
    assert geometry.paint(np.full((2, 2, 4), 5, np.uint8), [(0, 0, 1, 1)])[0, 0].tolist() == [0, 0, 0, 5]


def test_second_look():
    passes = {"raw": (50.0, [("a", 10.0, None)] * 4), "prepared": (90.0, [("a", 80.0, None)] * 3)}
    best, over, lang, kind = ocr.read_page("raw", lambda page, _: passes[page], lambda _: "prepared")
    assert len(best) == 3 and over == [[]] and kind == "legible" and lang == "en"
    asked = []
    ocr.read_page("raw", lambda page, lang: asked.append(lang) or (90.0, [(w, 99.0, None) for w in "nao sao uma pelo voce ela".split()]), lambda p: p)
    assert asked == ["en", "pt"]


def test_languages(spark):
    texts = ["the cat is on the mat and it was not for that", "não é uma casa, são dos filhos da voce", "xyz", "", "muito the"]
    assert [vote(t) for t in texts] == ["en", "pt", None, None, None]
    df = spark.createDataFrame(list(enumerate(texts)) + [(9, None)], "doc_id long, text string")
    assert [r["language"] for r in language.languages(df).orderBy("doc_id").collect()] == ["en", "pt", None, None, None, None]


def test_evaluate(spark):
    schema = "doc_id long, start int, end int, label string"
    gold = spark.createDataFrame([(1, 0, 5, "a"), (1, 10, 15, "a"), (2, 0, 3, "b")], schema)
    got = spark.createDataFrame([(1, 1, 4, "a", 1.0), (1, 3, 6, "a", 1.0), (1, 6, 8, "a", 1.0), (2, 0, 3, "a", 1.0)], schema + ", score double")
    rows = {r["label"]: tuple(r)[1:4] for r in evaluate.by_label(evaluate.counts(gold, got)).collect()}
    assert rows == {"a": (1, 2, 1), "b": (0, 0, 1), "TOTAL": (1, 2, 2)}
    exact = evaluate.by_label(evaluate.counts(gold, got, exact=True)).where("label = 'TOTAL'").first()
    assert exact["true_positive"] == 0 and exact["f1"] == 0
    assert "TOTAL" in evaluate.report(evaluate.by_label(evaluate.counts(gold, got)))


def test_token_decode_reads_all_components(spark, tmp_path):
    from veilspan.plans import queries

    last = [-1.0] * 60 + [1.0, 1.0, 1.0, -1.0]
    spark.createDataFrame([(1, last)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert [(r["start"], r["end"], r["entity"]) for r in queries.QUERIES["q37_token_decode"](spark, str(tmp_path)).collect()] == [(10, 10, 0)]
