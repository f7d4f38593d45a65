"""A labelled corpus: texts in which values stand as [[label|value]]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.functions.dimensions import LABELS, LANGUAGES

SCHEMA = "id string, language string, source string, format string, marked string"
_MARK = r"\[\[([a-z_]+)\|([^\]]*)\]\]"
_SOH, _STX = "\x01", "\x02"


def _pieces(marked: Column) -> Column:
    return F.split(F.regexp_replace(marked, _MARK, f"{_SOH}$1{_STX}$2{_SOH}"), _SOH, -1)


def parse_marked(df: DataFrame, marked: str = "marked", keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """(keep, text, spans): the text without marks, and where the values stand. Unknown labels and empty values are errors."""
    p = _pieces(F.col(marked))
    value = lambda x, i: F.when(i % 2 == 1, F.element_at(F.split(x, _STX, -1), 2)).otherwise(x)
    label = lambda x: F.element_at(F.split(x, _STX, -1), 1)
    rows = df.select(*keep, F.transform(p, value).alias("v"), F.transform(p, label).alias("l"))
    start = lambda i: F.aggregate(F.slice("v", 1, i), F.lit(0), lambda n, x: n + F.length(x))
    spans = F.transform("v", lambda x, i: F.struct(i.alias("i"), start(i).alias("start"), (start(i) + F.length(x)).alias("end"), F.get("l", i).alias("label")))
    spans = F.filter(spans, lambda s: s["i"] % 2 == 1)
    bad = F.exists(spans, lambda s: ~s["label"].isin(*LABELS) | (s["end"] == s["start"]))
    spans = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label")))
    return rows.select(*keep, F.array_join("v", "").alias("text"), F.when(bad, F.raise_error(F.lit("a marked span has no value or an unknown label"))).otherwise(spans).alias("spans"))


def load(spark: SparkSession, path: str) -> DataFrame:
    """(id, language, source, format, text, spans) of a folder of JSON files, one document each; bad or repeated ids raise."""
    rows = spark.read.schema(SCHEMA).option("multiLine", "true").json(path).fillna("text", ["format"])
    fine = F.coalesce((F.length("id") > 0) & F.col("language").isin(*LANGUAGES) & (F.length("marked") > 0) & F.col("source").isin("handwritten", "synthetic") & F.col("format").isin("csv", "json", "text"), F.lit(False))
    rows = rows.withColumn("marked", F.when(fine, F.col("marked")).otherwise(F.raise_error(F.concat(F.lit("not a corpus document: "), F.coalesce("id", F.lit("no id"))))))
    if (twice := rows.groupBy("id").count().where("count > 1").first()) is not None:
        raise ValueError(f"two documents are called {twice['id']}")
    return parse_marked(rows, keep=("id", "language", "source", "format"))


def gold_spans(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("id").alias("doc_id"), F.explode("spans").alias("s")).select("doc_id", "s.start", "s.end", "s.label")
