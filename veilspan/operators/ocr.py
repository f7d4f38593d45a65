"""What to make of a recogniser's passes: legibility, a second look, which pass is chosen."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspan.functions.dimensions import LAYER_WORDS, LEGIBLE_WORD, LUMINANCE, UNREADABLE_SHARE


def flatten(blocks: DataFrame) -> DataFrame:
    """blocks > paragraphs > lines > words of a recogniser as one row a word; blank words go."""
    for level in ("blocks", "paragraphs", "lines", "words"):
        blocks = blocks.select(*(c for c in blocks.columns if c != level), F.explode(level).alias("__x")).select(*(c for c in blocks.columns if c != level), "__x.*")
    return blocks.where(F.trim("text") != "")


def legibility(read: Column, legible: Column) -> Column:
    return F.when(read == 0, "blank").when((read - legible) / read > UNREADABLE_SHARE, "unreadable").otherwise("legible")


def assess(words: DataFrame, passes: DataFrame, by: tuple[str, ...] = ("doc_id", "unit_no", "pass_no")) -> DataFrame:
    """``passes`` with words read, legible ones among them, and the pass's legibility."""
    n = words.groupBy(*by).agg(F.count("*").alias("read"), F.count_if(F.col("confidence") >= LEGIBLE_WORD).alias("legible"))
    out = passes.join(n, list(by), "left").fillna(0, ["read", "legible"])
    return out.withColumn("legibility", legibility(F.col("read"), F.col("legible")))


def choose(assessed: DataFrame, unit: tuple[str, ...] = ("doc_id", "unit_no")) -> DataFrame:
    """The pass with most legible words, then the more confident, then the first, becomes reading 0; the others follow."""
    w = Window.partitionBy(*unit).orderBy(F.desc("legible"), F.desc("confidence"), "pass_no")
    return assessed.withColumn("reading_no", F.row_number().over(w) - 1)


def layer_is_enough(words: Column) -> Column:
    return words >= LAYER_WORDS


def binarize(pixels: np.ndarray) -> np.ndarray:
    """RGBA bytes with red, green and blue all black or all white, by luminance; alpha stays."""
    if pixels.size % 4:
        raise IndexError("pixels end inside a pixel")
    out = pixels.reshape(-1, 4).copy()
    dark = out[:, :3] @ np.array([0.299, 0.587, 0.114]) < LUMINANCE
    out[:, :3] = np.where(dark, 0, 255)[:, None]
    return out.reshape(pixels.shape)


def read_page(page, recognise: Callable, prepare: Callable, known: str | None = None):
    """(chosen, passed over, language, legibility) of one page. ``recognise(page, language)`` gives (confidence, words),
    words being (text, confidence, box). A page not known to be in a language is probed in English; an illegible one is
    prepared and read again."""
    from veilspan.operators.pages import vote

    def look(image):
        language = known or "en"
        got = recognise(image, language)
        if known is None and (named := vote(" ".join(w[0] for w in got[1]))) not in (None, language):
            language, got = named, recognise(image, named)
        legible = [w for w in got[1] if w[1] >= LEGIBLE_WORD]
        n = len(got[1])
        kind = "blank" if not n else "unreadable" if (n - len(legible)) / n > UNREADABLE_SHARE else "legible"
        return (len(legible), got[0]), legible, language, kind

    first = look(page)
    if first[3] == "legible":
        return first[1], [], first[2], first[3]
    again = look(prepare(page))
    best, other = (again, first) if again[0] > first[0] else (first, again)
    return best[1], [other[1]], best[2], best[3]
