from pyspark.sql import functions as F

from veilspan.operators import words as W


def test_split_words(spark):
    text = "Ana-Maria_2 pagou R$ 3,50 ção!"
    assert [w for _, _, w in W.split_words(text)] == ["Ana-Maria_2", "pagou", "R", "$", "3", ",", "50", "ção", "!"]
    assert all(text[s:e] == w for s, e, w in W.split_words(text))
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    assert df.select(W.words(F.col("text"))).first()[0] == [w for _, _, w in W.split_words(text)]
    assert W.word_rows(df).where("doc_id = 1").count() == 9 and W.word_rows(df).where("doc_id > 1").count() == 0


def test_chunks(spark):
    import pytest

    for n in range(30):
        want = W.chunk_list(list(range(n)), 7, 2)
        items = spark.createDataFrame([(list(range(n)),)], "x array<int>")
        assert [r["x"] for r in W.chunk_rows(items, "x", 7, 2).orderBy("first").collect()] == want
        assert sorted({x for c in want for x in c}) == list(range(n))
    with pytest.raises(ValueError):
        W.chunk_list([1], 2, 2)


def test_shouting():
    assert W.title_cased("JOHN O'NEIL aBC X") == "John O'Neil aBc X"
    text = "plain line\nJOHN SMITH, LTDA\nALONE\nDR. ANA LIMA"
    segments, joined = W.shouted_segments(text)
    assert joined == "John Smith, Ltda\nDr. Ana Lima" and [s[0] for s in segments] == [11, 34]
    assert all(text[s:e].lower() == w.lower() for s, e, w, _ in W.shouted_words(text))
    assert {line for *_, line in W.shouted_words(text)} == {0, 1}
    assert W.shouted_words("quiet") == []


def test_lines(spark):
    df = spark.createDataFrame([(1, "ab\n\ncde")], "doc_id long, text string")
    assert [tuple(r) for r in W.lines(df).select("line_no", "at", "line").collect()] == [(0, 0, "ab"), (1, 3, ""), (2, 4, "cde")]
