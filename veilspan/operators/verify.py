"""Reading the output again: whatever a detector still finds there has leaked, unless it is mask."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.functions.dimensions import APPLY_SCORE
from veilspan.functions.text import WS, is_masked
from veilspan.operators.extract import Detect, spans_by


def leaks(visible: DataFrame, find: Detect, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Confident spans over more than mask. ``find`` is the raw detector, without field names."""
    seen = visible.where(~F.col(text).rlike(f"^[{WS}]*$"))
    return spans_by(seen, find, text, keep, value=True).where(F.col("score") >= APPLY_SCORE).where(~is_masked(F.col("value")))


def verified(visible: DataFrame, find: Detect, text: str = "text", keep: tuple[str, ...] = ("doc_id",), warnings: str = "warnings") -> DataFrame:
    """``visible`` with warning.notFullyRedacted added to its warnings where something leaked."""
    bad = leaks(visible, find, text, keep).select(*keep).distinct().withColumn("__leaked", F.lit(True))
    have = F.col(warnings) if warnings in visible.columns else F.array().cast("array<string>")
    out = visible.join(bad, list(keep), "left")
    return out.withColumn(warnings, F.when(F.col("__leaked"), F.array_append(have, F.lit("warning.notFullyRedacted"))).otherwise(have)).drop("__leaked")
