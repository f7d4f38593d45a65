"""Masking: one block for each covered grapheme, line breaks kept, everything else byte for byte."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions.text import blocks


def masked(text: Column, ranges: Column, breaks: bool = True) -> Column:
    """``text`` with sorted disjoint ranges (array<struct<start, end>>) covered, line breaks in them too without ``breaks``. A range outside the text is an error: a
    guessed position is never masked."""
    ranges = F.coalesce(ranges, F.array().cast("array<struct<start:int,end:int>>"))
    n = F.length(text)
    bad = F.exists(ranges, lambda r: (r["start"] < 0) | (r["end"] > n) | (r["end"] < r["start"]))
    # Each range with the end of the one before it; pieces are joined once, so the work is linear in the text.
    ends = F.concat(F.array(F.lit(0)), F.transform(ranges, lambda r: r["end"].cast("int")))
    parts = F.transform(ranges, lambda r, i: F.concat(F.substr(text, F.get(ends, i) + 1, (r["start"] - F.get(ends, i)).cast("int")), blocks(F.substr(text, (r["start"] + 1).cast("int"), (r["end"] - r["start"]).cast("int")), breaks)))
    whole = F.concat(F.array_join(parts, ""), F.substr(text, F.element_at(ends, -1) + 1))
    return F.when(bad, F.raise_error(F.lit("a range lies outside the text"))).otherwise(whole)


def ranges_of(ranges: DataFrame, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row a group: its disjoint ranges as a sorted array."""
    return ranges.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")))).alias("ranges"))


def mask_texts(texts: DataFrame, ranges: DataFrame, by: tuple[str, ...] = ("doc_id",), text: str = "text", breaks: bool = True) -> DataFrame:
    """``texts`` with ``text`` masked."""
    return texts.join(ranges_of(ranges, by), list(by), "left").withColumn(text, masked(F.col(text), F.col("ranges"), breaks)).drop("ranges")
