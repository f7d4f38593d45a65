import pytest
from pyspark.sql import functions as F

from veilspan.functions import text as X
from veilspan.operators.mask import mask_texts, masked


@pytest.mark.parametrize(
    ("text", "ranges", "want"),
    [
        ("hello world", [(0, 5)], "█████ world"),
        ("a🙂b", [(1, 2)], "a█b"),
        ("👨‍👩‍👧x", [(0, 5)], "█x"),
        ("ab\r\ncd", [(1, 5)], "a█\r\n█d"),
        ("e\u0301!", [(0, 2)], "█!"),
        ("abc", [], "abc"),
        ("abc", None, "abc"),
        ("abcdef", [(0, 1), (3, 6)], "█bc███"),
    ],
)
def test_masked(spark, text, ranges, want):
    df = spark.createDataFrame([(text, ranges)], "t string, r array<struct<start:int,end:int>>")
    assert df.select(masked(F.col("t"), F.col("r"))).first()[0] == want


def test_outside_is_an_error(spark):
    df = spark.createDataFrame([("abc", [(1, 9)])], "t string, r array<struct<start:int,end:int>>")
    with pytest.raises(Exception, match="outside"):
        df.select(masked(F.col("t"), F.col("r"))).collect()


def test_many_spans(spark):
    n = 10_000
    docs = spark.createDataFrame([(1, "0123456789 " * n)], "doc_id long, text string")
    ranges = spark.range(n).selectExpr("1L AS doc_id", "CAST(id * 11 AS int) AS start", "CAST(id * 11 + 10 AS int) AS end")
    assert mask_texts(docs, ranges).first()["text"] == ("█" * 10 + " ") * n


def test_text_functions(spark):
    df = spark.createDataFrame([("  The   Clíent ", "A B", "x" * 100)], "a string, b string, c string")
    r = df.select(X.as_term(F.col("a")), X.normalise(F.col("b")), F.length(X.preview(F.col("c"))), X.value_key(F.col("a")), X.is_masked(F.lit("██ █")), X.is_masked(F.lit("█a")), X.to_utf16(F.lit("a🙂b"), F.lit(2))).first()
    assert tuple(r) == ("clíent", "A B", 80, "theclient", True, False, 3)
    for raw in ("a+b(c)", "x.y*[z]{1}|\\/^$?"):
        assert spark.range(1).select(F.regexp_like(F.lit(raw), F.concat(F.lit("^"), X.escaped(F.lit(raw)), F.lit("$")))).first()[0]
