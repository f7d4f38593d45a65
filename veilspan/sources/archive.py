"""Names of results in an archive, and the archive itself."""

from __future__ import annotations

import io
import os
import uuid
import zipfile
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspan.sources.formats import clean_path


def split_extension(name: str) -> tuple[str, str]:
    at = name.rfind(".")
    return (name, "") if at <= 0 else (name[:at], name[at:])


def unique_name(name: str, taken: set[str], n: int = 1) -> tuple[str, int]:
    """The name, or with the first number from ``n`` on that is free, and that number."""
    base, extension = split_extension(name)
    numbered = lambda n: f"{base} ({n}){extension}" if n > 1 else name
    while numbered(n) in taken:
        n += 1
    return numbered(n), n


def archive_names(names: Iterable[str]) -> list[str]:
    """In order: no name climbs out of its folder, none is empty, none comes twice."""
    taken: set[str] = set()
    out, last = [], {}
    for name in names:
        parts = [p for p in name.replace("\\", "/").split("/") if p not in ("", ".", "..")]
        clean = "/".join(parts) or "file"
        # A number once taken stays so: the search goes on where it ended.
        entry, last[clean] = unique_name(clean, taken, last.get(clean, 1))
        out.append(entry)
        taken.add(entry)
    return out


def path_entry(path: Column, name: Column) -> Column:
    """A result's name in the folder that its file was picked from."""
    return F.concat(F.regexp_extract(path, r"(?s)^(.*/)?", 0), name)


def numbered_names(files: DataFrame, order: str, name: str = "name") -> DataFrame:
    """``files`` with ``entry``: the cleaned name, the second of a kind as 'base (2).ext'. Names alike but for such numbers can
    meet these; they are numbered one after the other as ``archive_names`` does, all names of such a kind in one task."""
    clean = F.when(clean_path(F.col(name)) == "", "file").otherwise(clean_path(F.col(name)))
    rows = files.withColumn("__clean", clean)
    # The last dot begins the extension unless it begins the name.
    dot = F.col("__clean").rlike(r"(?s)^.+\.[^.]*$")
    base = F.when(dot, F.regexp_extract("__clean", r"(?s)^(.+)\.[^.]*$", 1)).otherwise(F.col("__clean"))
    ending = F.when(dot, F.regexp_extract("__clean", r"(?s)(\.[^.]*)$", 1)).otherwise(F.lit(""))
    rows = rows.withColumn("__base", F.regexp_replace(base, r"(?: \([0-9]+\))+$", "")).withColumn("__kind", F.struct("__base", ending.alias("ending")))
    rows = rows.withColumn("__mixed", F.max(F.length("__base") < F.length(base)).over(Window.partitionBy("__kind"))).drop("__base")
    plain, mixed = _by_rank(rows.where(~F.col("__mixed")), order), rows.where("__mixed")

    columns = files.columns

    def one_by_one(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        return table.select(columns).append_column("entry", pa.array(archive_names(table["__clean"].to_pylist()), pa.string()))

    numbered = mixed.groupBy("__kind").applyInArrow(one_by_one, files.withColumn("entry", F.lit("")).schema)
    return plain.unionByName(numbered)


def _by_rank(rows: DataFrame, order: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("__clean").orderBy(order))
    rows = rows.withColumn("__n", n)
    base, ext = F.regexp_extract("__clean", r"(?s)^(.+)(\.[^.]*)$", 1), F.regexp_extract("__clean", r"(?s)^(.+)(\.[^.]*)$", 2)
    numbered = F.when(base == "", F.concat("__clean", F.lit(" ("), "__n", F.lit(")"))).otherwise(F.concat(base, F.lit(" ("), "__n", F.lit(")"), ext))
    return rows.withColumn("entry", F.when(F.col("__n") == 1, F.col("__clean")).otherwise(numbered)).drop("__clean", "__n", "__kind", "__mixed")


def build_zip(files: list[tuple[str, bytes]]) -> bytes:
    if not files:
        raise ValueError("an archive needs a file")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=6) as z:
        for entry, (_, raw) in zip(archive_names(n for n, _ in files), files):
            z.writestr(entry, raw)
    return out.getvalue()


def write_zip(path: str, files: list[tuple[str, bytes]]) -> str:
    """Written beside and linked into place: another's file is never overwritten, the next free name is taken."""
    raw, folder = build_zip(files), os.path.dirname(os.path.abspath(path))
    tmp = os.path.join(folder, f".{os.path.basename(path)}.{os.getpid()}")
    with open(tmp, "wb") as f:
        f.write(raw)
    try:
        taken: set[str] = set()
        while True:
            target = os.path.join(folder, unique_name(os.path.basename(path), taken)[0])
            try:
                os.link(tmp, target)
                return target
            except FileExistsError:
                taken.add(os.path.basename(target))
    finally:
        os.unlink(tmp)


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """(entry, size): each row's ``content`` as a file below the folder, which all executors must see. Files come whole and under
    a name of their own first, so that a repeated task changes nothing."""

    def write(batches):
        from pyarrow import fs

        for b in batches:
            where, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), os.path.abspath(folder))
            for entry, content in zip(b["entry"].to_pylist(), b["content"].to_pylist()):
                home, _, name = f"{base}/{entry}".rpartition("/")
                where.create_dir(home, recursive=True)
                with where.open_output_stream(part := f"{home}/.{uuid.uuid4().hex}") as out:
                    out.write(content)
                where.move(part, f"{home}/{name}")
            yield pa.RecordBatch.from_arrays([b["entry"], pa.array([len(c) for c in b["content"].to_pylist()], pa.int64())], ["entry", "size"])

    return rows.select("entry", F.coalesce("content", F.lit(b"")).alias("content")).mapInArrow(write, "entry string, size long")


def image_name(name: F.col, mime: F.col):
    """Pixels come out in the type they came in, if it can be written, and as PNG otherwise."""
    return F.when(mime.isin("image/jpeg", "image/png", "image/webp"), name).otherwise(F.concat(F.regexp_replace(name, r"(?s)(?<=.)\.[^.]*$", ""), F.lit(".png")))


def summary(results: DataFrame) -> DataFrame:
    """One row: files, redactions, failures, and the files that carry warnings."""
    warned = F.array_sort(F.collect_list(F.when(F.size("warnings") > 0, F.struct("name", "warnings"))))
    return results.agg(F.count_if(F.col("error_key").isNull()).alias("file_count"), F.coalesce(F.sum("redaction_count"), F.lit(0)).alias("redaction_count"), F.count_if(F.col("error_key").isNotNull()).alias("failures"), warned.alias("warnings"))
