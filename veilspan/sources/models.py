"""Files of models: what they are called where they are kept, what is missing, stale, shared or half fetched.

Nothing here fetches: these are the plans of it, over tables of urls, sizes and ranges.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kept_name(url: Column) -> Column:
    """A file's name in the store: the start of its address's digest, and the address's last part."""
    return F.concat(F.substr(F.sha2(url, 256), F.lit(1), F.lit(16)), F.lit("-"), F.element_at(F.split(url, "/"), -1))


def file_urls(models: DataFrame, hub: str) -> DataFrame:
    """(id, url) of the weights and the two tokenizer files of models (id, repo, revision, file)."""
    base = F.concat(F.lit(hub.rstrip("/") + "/"), "repo", F.lit("/resolve/"), "revision", F.lit("/"))
    files = F.array(F.concat(F.lit("onnx/"), "file"), F.lit("tokenizer.json"), F.lit("tokenizer_config.json"))
    return models.select("id", F.explode(F.transform(files, lambda f: F.concat(base, f))).alias("url"))


def owned_urls(urls: DataFrame, model: str) -> DataFrame:
    """A model's files that no other model shares, which go when it goes."""
    mine, others = urls.where(F.col("id") == model), urls.where(F.col("id") != model)
    return mine.join(others, "url", "left_anti").select("url")


def stale(kept: DataFrame, urls: DataFrame) -> DataFrame:
    """Kept files that no model names any more."""
    return kept.join(urls, "url", "left_anti")


def status(urls: DataFrame, kept: DataFrame) -> DataFrame:
    """(id, bytes, status) of each model: ready, partial or absent, by which of its files are kept."""
    n = urls.join(kept.select("url", "size"), "url", "left").groupBy("id").agg(F.count("*").alias("files"), F.count("size").alias("have"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    return n.select("id", "bytes", F.when(F.col("have") == F.col("files"), "ready").when(F.col("have") > 0, "partial").otherwise("absent").alias("status"))


def ranges(files: DataFrame, chunk: int) -> DataFrame:
    """(url, start, size) of the ranges that make up files (url, total)."""
    starts = F.when(F.col("total") > 0, F.sequence(F.lit(0).cast("long"), F.col("total").cast("long") - 1, F.lit(chunk).cast("long")))
    rows = files.select("url", "total", F.explode(starts).alias("start"))
    return rows.select("url", "start", F.least(F.lit(chunk), F.col("total") - F.col("start")).cast("long").alias("size"))


def missing(files: DataFrame, held: DataFrame, chunk: int) -> DataFrame:
    """Ranges still to be fetched: all of a file's without those held (url, start)."""
    return ranges(files, chunk).join(held, ["url", "start"], "left_anti")


def banked(files: DataFrame, held: DataFrame, chunk: int) -> DataFrame:
    """(url, bytes) held already."""
    return ranges(files, chunk).join(held, ["url", "start"], "left_semi").groupBy("url").agg(F.sum("size").alias("bytes"))


# The ranges of code points that a trimmed vocabulary keeps.
KEPT_RANGES = (
    (0x0000, 0x007F), (0x00A0, 0x00FF), (0x0100, 0x017F), (0x0180, 0x024F), (0x0250, 0x02FF), (0x0300, 0x036F),
    (0x1E00, 0x1EFF), (0x2000, 0x206F), (0x2580, 0x259F), (0x20A0, 0x20CF), (0x2100, 0x214F),
)


def in_kept_ranges(piece: Column) -> Column:
    """Whether all characters of a vocabulary's piece are in KEPT_RANGES."""
    return piece.rlike("^[" + "".join(f"\\x{{{lo:x}}}-\\x{{{hi:x}}}" for lo, hi in KEPT_RANGES) + "]*\\z")


def trimmed(vocabulary: DataFrame, protected: DataFrame) -> DataFrame:
    """``vocabulary`` (piece, old) without pieces of other scripts, those ``protected`` (piece) aside."""
    own = protected.select("piece").distinct().withColumn("__protected", F.lit(True))
    return vocabulary.join(own, "piece", "left").where(F.col("__protected").isNotNull() | in_kept_ranges(F.col("piece"))).drop("__protected")


def read_json_object(folder: str, name: str) -> dict:
    """A tokenizer's file, which must hold an object."""
    with open(os.path.join(folder, name), encoding="utf-8") as f:
        value = json.load(f)
    if not isinstance(value, dict):
        raise TypeError(f"{name} doesn't hold an object")
    return value
