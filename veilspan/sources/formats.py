"""Which reader a file is for, by its type or its name's extension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.functions.dimensions import FILES_AT_MOST, FORMATS, STRETCHES, UNDECODABLE


def extension_of(name: Column) -> Column:
    """The lower-case suffix from the last dot; a leading dot alone is none."""
    return F.lower(F.regexp_extract(name, r"(?s)^.+(\.[^.]*)$", 1))


def type_matches(pattern: str, mime: Column) -> Column:
    return mime.startswith(pattern[:-1]) if pattern.endswith("/*") else mime == pattern


def format_of(name: Column, mime: Column | None = None) -> Column:
    """The first format that accepts the type or the extension; null if none does."""
    mime = F.coalesce(mime, F.lit("")) if mime is not None else F.lit("")
    out = None
    for fmt, types, extensions in FORMATS:
        takes = extension_of(name).isin(*extensions)
        for t in types:
            takes = takes | type_matches(t, mime)
        out = F.when(takes, fmt) if out is None else out.when(takes, fmt)
    return out


def node_types() -> dict[str, str]:
    """Extension to type, for formats that can be decoded without a browser."""
    return {e: t for _, _, own in FORMATS for e, t in own.items() if e not in UNDECODABLE}


def type_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(node_types().items()), "extension string, mime string")


def accept_list() -> str:
    return ",".join(x for _, types, own in FORMATS for x in (*own, *types))


def clean_path(path: Column) -> Column:
    """Without empty, . and .. segments, whichever way the slashes lean."""
    return F.array_join(F.filter(F.split(path, r"[\\/]"), lambda s: ~s.isin("", ".", "..")), "/")


def fraction_at(stage: Column, done: Column) -> Column:
    """How far along the whole a stage is that is ``done`` (0 to 1)."""
    out = None
    for i, (lo, stages) in enumerate(STRETCHES):
        hi = STRETCHES[i + 1][0] if i + 1 < len(STRETCHES) else 1.0
        value = F.lit(lo) + F.lit(hi - lo) * F.least(F.greatest(done, F.lit(0.0)), F.lit(1.0))
        out = F.when(stage.isin(*stages), value) if out is None else out.when(stage.isin(*stages), value)
    return out


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of the paths that are there."""
    conf, hadoop = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs
    return [p for p in paths if (at := hadoop.Path(p)).getFileSystem(conf).exists(at)]


def read_files(spark: SparkSession, path: str | list[str], at_most: int | None = FILES_AT_MOST) -> tuple[DataFrame, DataFrame]:
    """(readable files, dead letters): name, path, format, content. With ``at_most``, the first so many by path, and
    ``limited`` says whether there were more; a limit is the feature of an interactive selection, None reads all."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    files = files.select("path", name.alias("name"), format_of(name).alias("format"), "length", "content")
    known, unknown = files.where(F.col("format").isNotNull()), files.where(F.col("format").isNull())
    if at_most is not None:
        first = known.select("path").orderBy("path").limit(at_most + 1).collect()
        keep = [r[0] for r in first[:at_most]]
        known = known.where(F.col("path").isin(keep)).withColumn("limited", F.lit(len(first) > at_most))
    dead = unknown.select("path", "name", F.lit("failure.unsupported").alias("error_key"))
    return known, dead


def read_texts(spark: SparkSession, path: str | list[str], at_most: int | None = None) -> DataFrame:
    """doc_id (the path), name, format and text of csv, json and text files."""
    known, _ = read_files(spark, path, at_most)
    return known.where(F.col("format").isin("csv", "json", "text")).select(F.col("path").alias("doc_id"), "name", "format", F.decode("content", "UTF-8").alias("text"))


def listing(files: DataFrame) -> DataFrame:
    """Directories first, then by name as people sort, with whether each can be read."""
    rows = files.withColumn("supported", F.col("is_dir") | format_of(F.col("name")).isNotNull())
    return rows.orderBy(~F.col("is_dir"), F.collate("name", "UNICODE"))
