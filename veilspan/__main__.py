"""python -m veilspan SOURCE... TARGET: the csv, json and text files that SOURCES name or hold, with personal data masked, as files
of the same names below TARGET/files; the table of results in TARGET/results, and a summary. Sources that aren't there are
skipped. Under spark-submit the session's own settings hold. python -m veilspan models: the models the codec knows."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import functions as F

from veilspan.functions.dimensions import FILES_AT_MOST
from veilspan.operators.codec import MODELS
from veilspan.operators.fields import STRUCTURES
from veilspan.plans.redact import redact_files
from veilspan.session import session, ship
from veilspan.sources import archive, formats


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="veilspan", description=__doc__)
    p.add_argument("source", nargs="+")
    p.add_argument("target")
    p.add_argument("--master", default=None, help="local[8], for instance, where nothing else sets it")
    p.add_argument("--jobs", type=int, default=None, help="files at once on this machine, where no master is set")
    p.add_argument("--zip", action="store_true", help=f"TARGET/redacted.zip too, of at most {FILES_AT_MOST} files")
    return p


def models() -> list[tuple[str, str, str]]:
    """(id, decoding, languages) of the models; their weights are the user's own."""
    rows = [(m.id, m.decoding, ",".join(m.languages)) for m in MODELS.values()]
    print("\n".join("  ".join(r) for r in rows))
    return rows


def main(args: list[str] | None = None) -> dict | list:
    import sys

    args = sys.argv[1:] if args is None else args
    if args in (["models"], ["models", "list"]):
        return models()
    own = _parser().parse_args(args)
    spark = ship(session(own.master or (f"local[{own.jobs}]" if own.jobs else None)))
    sources = formats.existing(spark, own.source)
    if not sources:
        raise SystemExit(f"nothing there: {' '.join(own.source)}")
    known, dead = formats.read_files(spark, sources, None)
    # Pages and images need engines that are the caller's.
    dead = dead.unionByName(known.where(~F.col("format").isin(*STRUCTURES)).select("path", "name", F.lit("failure.unsupported").alias("error_key")))
    archive.numbered_names(redact_files(formats.read_texts(spark, sources)), "doc_id").write.mode("overwrite").parquet(f"{own.target}/results")
    done = spark.read.parquet(f"{own.target}/results")
    fine = done.where("error_key IS NULL").select("entry", F.encode("text", "UTF-8").alias("content"))
    written = archive.write_files(fine, f"{own.target}/files").agg(F.count("*")).first()[0]
    if own.zip and written:
        if written > FILES_AT_MOST:
            raise SystemExit(f"{written} files are too many for one archive")
        archive.write_zip(os.path.join(own.target, "redacted.zip"), [(r["entry"], bytes(r["content"])) for r in fine.orderBy("entry").collect()])
    failed = dead.select("name", F.lit(0).cast("long").alias("redaction_count"), F.array().cast("array<string>").alias("warnings"), "error_key")
    rows = done.select(F.col("entry").alias("name"), "redaction_count", F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"), F.col("error_key")).unionByName(failed)
    total = archive.summary(rows).first().asDict(recursive=True)
    print(total)
    return total


if __name__ == "__main__":
    main()
