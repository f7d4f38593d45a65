"""A text's language by a vote of its stopwords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions.dimensions import LANGUAGES, MIN_CONFIDENCE, MIN_HITS, OCR_DATA, STOPWORDS
from veilspan.functions.text import plain


def tokens_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(plain(text)), F.lit(r"([\p{L}']+)"), F.lit(1))


def votes(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep, hits_en, hits_es, hits_pt) of every row: how many of its tokens are a language's stopwords. A projection, no
    shuffle; a null text has no hits."""
    rows = df.select(*keep, tokens_of(F.col(text)).alias("__tokens"))
    hits = lambda own: F.coalesce(F.size(F.filter("__tokens", lambda t: t.isin(*own))), F.lit(0)).cast("long")
    return rows.select(*keep, *(hits(list(STOPWORDS[x])).alias(f"hits_{x}") for x in LANGUAGES))


def winner(hits: dict[str, Column]) -> Column:
    """The language that outvotes every other with enough hits to trust, or null."""
    ranked = F.reverse(F.array_sort(F.array(*hits.values())))
    top, second, total = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1)), sum(hits.values(), F.lit(0))
    sure = (top > second) & (top / F.greatest(total, F.lit(1)) * F.least(F.lit(1.0), total / MIN_HITS) >= MIN_CONFIDENCE)
    named = F.coalesce(*(F.when(h == top, F.lit(lang)) for lang, h in hits.items()))
    return F.when(sure, named)


def languages(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    v = votes(df, text, keep)
    return v.withColumn("language", winner({x: F.col(f"hits_{x}") for x in LANGUAGES}))


def ocr_data(language: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in OCR_DATA.items() for x in kv)), language)
