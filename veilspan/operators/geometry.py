"""Words on pages: surfaces, reading order, rectangles to paint, what stays visible.

A word is (text, x0, y0, x1, y1); a surface adds each word's characters in the text that blanks join. Long tables do what
windows and joins can; reading order folds page by page.
"""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspan.functions.dimensions import BLEED, BLOCK_GAP, COLUMN_GAP, SAME_LINE

SURFACE = ("doc_id", "unit_no", "reading_no")
Word = tuple[str, float, float, float, float]


# ---------------------------------------------------------------- long tables


def place_words(words: DataFrame, by: tuple[str, ...] = SURFACE) -> DataFrame:
    """``words`` (by, word_no, text, ...) with char_start and char_end in the surface's text."""
    before = Window.partitionBy(*by).orderBy("word_no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("int")
    return words.withColumn("char_start", start).withColumn("char_end", (F.col("char_start") + F.length("text")).cast("int"))


def surface_texts(words: DataFrame, by: tuple[str, ...] = SURFACE) -> DataFrame:
    every = F.array_sort(F.collect_list(F.struct("word_no", "text")))
    return words.groupBy(*by).agg(F.array_join(F.transform(every, lambda w: w["text"]), " ").alias("text"))


def covered_words(placed: DataFrame, spans: DataFrame, by: tuple[str, ...] = SURFACE) -> DataFrame:
    """Words whose characters a span overlaps, with ``span_start`` and ``span_end``."""
    s = spans.select(*by, F.col("start").alias("span_start"), F.col("end").alias("span_end")).distinct()
    return placed.join(s, list(by)).where((F.col("char_start") < F.col("span_end")) & (F.col("char_end") > F.col("span_start")))


def unit_heights(words: DataFrame, by: tuple[str, ...] = SURFACE) -> DataFrame:
    """The upper median of a surface's word heights."""
    heights = F.sort_array(F.collect_list(F.col("y1") - F.col("y0")))
    return words.groupBy(*by).agg(F.get(heights, F.floor(F.count("*") / 2).cast("int")).alias("unit"))


def runs(words: DataFrame, units: DataFrame, by: tuple[str, ...] = SURFACE, within: tuple[str, ...] = ()) -> DataFrame:
    """``words`` with ``run``: a run ends where the line changes or a gap is wide."""
    w = Window.partitionBy(*by, *within).orderBy("word_no")
    rows = words.join(units, list(by))
    apart = (F.abs(F.lag("y1").over(w) - F.col("y1")) >= F.col("unit") * SAME_LINE) | (F.col("x0") - F.lag("x1").over(w) > F.col("unit") * COLUMN_GAP)
    rows = rows.withColumn("__new", F.when(F.lag("y1").over(w).isNull() | apart, 1).otherwise(0))
    return rows.withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__new", "unit")


def rectangles(placed: DataFrame, spans: DataFrame, by: tuple[str, ...] = SURFACE) -> DataFrame:
    """(by, span_start, span_end, run, x, y, width, height): one rectangle a span and run."""
    hit = runs(covered_words(placed, spans, by), unit_heights(placed, by), by, ("span_start", "span_end"))
    box = hit.groupBy(*by, "span_start", "span_end", "run").agg(F.min("x0").alias("x"), F.min("y0").alias("y"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return box.withColumn("width", F.col("x1") - F.col("x")).withColumn("height", F.col("y1") - F.col("y")).drop("x1", "y1")


def uncovered(words: DataFrame, rects: DataFrame, unit: tuple[str, ...] = ("doc_id", "unit_no")) -> DataFrame:
    """Words that no rectangle of their unit overlaps, whichever reading it came from."""
    r = rects.select(*(F.col(c).alias(f"r_{c}") for c in unit), "x", "y", "width", "height")
    meets = (F.col("x0") < F.col("x") + F.col("width")) & (F.col("x1") > F.col("x")) & (F.col("y0") < F.col("y") + F.col("height")) & (F.col("y1") > F.col("y"))
    for c in unit:
        meets = meets & (F.col(c) == F.col(f"r_{c}"))
    return words.join(r, meets, "left_anti")


def cover_units(placed: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rectangles of every reading, words of each unit's chosen reading, number 0, that stay visible)."""
    rects = rectangles(placed, spans)
    return rects, uncovered(placed.where("reading_no = 0"), rects)


def page_actions(pages: DataFrame, rects: DataFrame) -> DataFrame:
    """A page without rectangles is copied as it is, any other painted. Where ``pages`` says which are ``copyable``, the first
    clean page that isn't, and all that follow in its document, are painted too."""
    dirty = rects.groupBy("doc_id", "unit_no").agg(F.count("*").alias("n"))
    rows = pages.join(dirty, ["doc_id", "unit_no"], "left")
    copied = F.col("n").isNull()
    if "copyable" in pages.columns:
        upto = Window.partitionBy("doc_id").orderBy("unit_no").rowsBetween(Window.unboundedPreceding, 0)
        copied = copied & ~F.max(F.col("n").isNull() & ~F.coalesce("copyable", F.lit(False))).over(upto)
    return rows.withColumn("action", F.when(copied, "copy").otherwise("paint")).drop("n")


def carried_languages(pages: DataFrame) -> DataFrame:
    """``pages`` (doc_id, unit_no, language or null) with ``known``: the first language named up to the page."""
    w = Window.partitionBy("doc_id").orderBy("unit_no").rowsBetween(Window.unboundedPreceding, 0)
    return pages.withColumn("known", F.first("language", ignorenulls=True).over(w))


# ---------------------------------------------------------------- one page


def unit_of(words: list[Word]) -> float | None:
    heights = sorted(w[4] - w[2] for w in words)
    return heights[len(heights) // 2] if heights else None


def extent(words: list[Word]) -> tuple[float, float, float, float]:
    return min(w[1] for w in words), min(w[2] for w in words), max(w[3] for w in words), max(w[4] for w in words)


def _level(a: Word, b: Word, unit: float) -> bool:
    return abs(a[4] - b[4]) < unit * SAME_LINE


def runs_of(words: list[Word], unit: float) -> list[list[Word]]:
    out: list[list[Word]] = []
    for w in words:
        if out and _level(out[-1][-1], w, unit) and w[1] - out[-1][-1][3] <= unit * COLUMN_GAP:
            out[-1].append(w)
        else:
            out.append([w])
    return out


def in_reading_order(words: list[Word]) -> list[Word]:
    """By lines, lines cut into runs, runs gathered into the first block of columns they continue."""
    unit = unit_of(words)
    if unit is None:
        return []
    order = lambda a, b: (a[1] - b[1] if _level(a, b, unit) else a[4] - b[4])
    by_line = sorted(words, key=functools.cmp_to_key(lambda a, b: (order(a, b) > 0) - (order(a, b) < 0)))
    gathered: list[list] = []  # [x0, y0, x1, y1, words]
    for run in runs_of(by_line, unit):
        x0, y0, x1, y1 = extent(run)
        home = next((g for g in gathered if y0 - g[3] < unit * BLOCK_GAP and y0 >= g[1] - unit and x0 < g[2] and x1 > g[0]), None)
        if home is None:
            gathered.append([x0, y0, x1, y1, [*run]])
        else:
            home[0], home[1], home[2], home[3] = min(home[0], x0), y0, max(home[2], x1), y1
            home[4] += run
    return [w for g in gathered for w in g[4]]


def compose(outer, inner) -> list[float] | None:
    """Two affine maps (a, b, c, d, e, f) one after the other; None if either isn't six numbers."""
    try:
        m = [np.array([[v[0], v[2], v[4]], [v[1], v[3], v[5]], [0, 0, 1]], float) for v in (outer, inner)]
    except (TypeError, ValueError, IndexError):
        return None
    p = m[0] @ m[1]
    return [p[0, 0], p[1, 0], p[0, 1], p[1, 1], p[0, 2], p[1, 2]]


def layer_words(items: list[dict], styles: dict, viewport, measure=lambda text, family: 0.0) -> list[Word]:
    """A PDF text layer's items as words with boxes: each is placed by the share of its run's measured width before it."""
    import regex

    if viewport is None or compose(viewport, (1, 0, 0, 1, 0, 0)) is None:
        return []
    scale, out = math.hypot(viewport[0], viewport[1]), []
    size = lambda s: len(regex.findall(r"\X", s))
    for item in items:
        if not isinstance(item, dict) or not isinstance(item.get("str"), str) or not item["str"].strip():
            continue
        at = compose(viewport, item.get("transform"))
        if at is None:
            continue
        style = styles.get(item.get("fontName"), {"ascent": 1, "descent": 0, "fontFamily": "sans-serif"})
        height, width = math.hypot(at[2], at[3]) or item["height"] * scale, item["width"] * scale
        each = width / size(item["str"])
        total = measure(item["str"], style["fontFamily"])
        offset = lambda s, style=style, total=total, width=width, each=each: measure(s, style["fontFamily"]) / total * width if total > 0 else size(s) * each
        for m in regex.finditer(r"\S+", item["str"]):
            left, right = offset(item["str"][: m.start()]), offset(item["str"][: m.end()])
            out.append((m[0], at[4] + left - each * BLEED, at[5] - height * style["ascent"], at[4] + right + each * BLEED, at[5] - height * style["descent"]))
    return out


def paint(pixels: np.ndarray, rects: list[tuple[float, float, float, float]]) -> np.ndarray:
    """Rows x columns x channels with every (x, y, width, height) black, alpha left alone."""
    out = pixels.copy()
    for x, y, w, h in rects:
        out[max(0, math.floor(y)) : max(0, math.ceil(y + h)), max(0, math.floor(x)) : max(0, math.ceil(x + w)), :3] = 0
    return out


#: What the standard fonts' encoding has beyond Latin-1.
_BEYOND = bytes(range(128, 160)).decode("cp1252", "ignore")


def drawable(text: Column) -> Column:
    """Whether a standard font of PDF can write the text."""
    return text.rlike(f"^[ -~\u00a0-\u00ff{_BEYOND}]*$")


def dropped_characters(visible: DataFrame) -> DataFrame:
    """(doc_id, warning) of documents with words that ``invisible_words`` can't write."""
    return visible.where(~drawable(F.col("text"))).select("doc_id", F.lit("warning.droppedCharacters").alias("warning")).distinct()


def invisible_words(visible: DataFrame, page_height: str = "page_height") -> DataFrame:
    """Where the surviving words are written back, unseen: half the box's height as size, upwards from the page's foot."""
    return visible.withColumn("size", (F.col("y1") - F.col("y0")) / 2).withColumn("x", F.col("x0")).withColumn("y", F.col(page_height) - F.col("y1"))
