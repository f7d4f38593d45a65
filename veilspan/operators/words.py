"""Words of a text with offsets, sliding chunks of them, and shouted lines in a calmer spelling."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions.text import offsets

#: A word with inner hyphens or underscores, or any other character that isn't white space. Fixed value.
WORD = r"[\p{L}\p{N}_]+(?:[\-_][\p{L}\p{N}_]+)*|[^" + "\\s\\x{0B}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}" + "]"
#: Two runs of capitals, close together, make a line a shouted one. Fixed values.
SHOUTED = r"\p{Lu}{2,}(?:['’]\p{Lu}+)?[^\p{L}\p{N}]{1,3}\p{Lu}{2,}"
CAPITALS = r"\p{Lu}{2,}(?:['’]\p{Lu}+)?"

_RX: dict[str, object] = {}


def _rx(name: str):
    import regex

    if name not in _RX:
        spelled = {"word": WORD.replace("\\s\\x{0B}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}", "\\t-\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"), "shouted": SHOUTED, "capitals": CAPITALS}[name]
        _RX[name] = regex.compile(spelled)
    return _RX[name]


def words(text: Column) -> Column:
    """array<string>: the words of a text, inside the JVM."""
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def split_words(text: str) -> list[tuple[int, int, str]]:
    return [(*m.span(), m[0]) for m in _rx("word").finditer(text)]


def word_rows(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows (keep, word_no from 0, start, end, word)."""

    def run(batches):
        for b in batches:
            at, rows = [], []
            for i, t in enumerate(b["__text"].to_pylist()):
                own = split_words(t or "")
                rows += [(n, *w) for n, w in enumerate(own)]
                at += [i] * len(own)
            held = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([*(b[k].take(held) for k in keep), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.string())))], [*keep, "word_no", "start", "end", "word"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)
    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, f"{fields}, word_no int, start int, end int, word string")


def chunk_firsts(n: Column, size: int, overlap: int) -> Column:
    """array<int>: where windows of ``size`` items that share ``overlap`` begin; the last is the first to reach the end."""
    if overlap >= size:
        raise ValueError(f"chunks of {size} can't share {overlap}")
    stride = size - overlap
    count = F.when(n <= 0, 0).when(n <= size, 1).otherwise(F.ceil((n - size) / stride) + 1).cast("int")
    return F.transform(F.filter(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: i < count), lambda i: i * stride)


def chunk_rows(df: DataFrame, items: str, size: int, overlap: int) -> DataFrame:
    """``df`` with a row for each chunk of the array column ``items``: first, and the chunk in the array's place. The array is
    made once a row and cut behind the explode."""
    rows = df.withColumn("first", F.explode(chunk_firsts(F.size(items), size, overlap)))
    return rows.withColumn(items, F.slice(items, F.col("first") + 1, F.lit(size)))


def chunk_list(items: list, size: int, overlap: int) -> list[list]:
    if overlap >= size:
        raise ValueError(f"chunks of {size} can't share {overlap}")
    stride = size - overlap
    last = max(0, -(-(len(items) - size) // stride)) if items else -1
    return [items[i * stride : i * stride + size] for i in range(last + 1)]


def title_cased(text: str) -> str:
    """Runs of capitals keep their first letter."""
    return _rx("capitals").sub(lambda m: m[0][0] + m[0][1:].lower(), text)


def is_shouted(line: Column) -> Column:
    return line.rlike(SHOUTED)


def shouted_segments(text: str) -> tuple[list[tuple[int, int, int]], str]:
    """Shouted lines re-cased and joined by line ends, with (at in the text, start, end in the joined text) of each."""
    segments, lines, source, joined = [], [], 0, 0
    for line in text.split("\n"):
        calm = title_cased(line) if _rx("shouted").search(line) else line
        if calm != line and len(calm) == len(line):
            segments.append((source, joined, joined + len(calm)))
            lines.append(calm)
            joined += len(calm) + 1
        source += len(line) + 1
    return segments, "\n".join(lines)


def shouted_words(text: str, base: int = 0) -> list[tuple[int, int, str, int]]:
    """(start, end, word, line) of the re-cased copy, at their places in the text."""
    segments, joined = shouted_segments(text)
    out, line = [], 0
    for start, end, word in split_words(joined):
        while line < len(segments) and start >= segments[line][2]:
            line += 1
        if line < len(segments) and start >= segments[line][1]:
            at, lo, hi = segments[line]
            out.append((start + at - lo + base, min(end, hi) + at - lo + base, word, line))
    return out


def lines(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows (keep, line_no, at, line): the text's lines and where they begin."""
    every = F.split(text, "\n", -1)
    cut = df.select(*keep, every.alias("__lines")).where(F.col("__lines").isNotNull())
    starts = F.slice(offsets(F.col("__lines"), 1), F.lit(1), F.size("__lines"))
    rows = cut.select(*keep, F.explode(F.arrays_zip(F.col("__lines").alias("line"), starts.alias("at"), F.sequence(F.lit(0), F.size("__lines") - 1).alias("line_no"))).alias("l"))
    return rows.select(*keep, "l.line_no", "l.at", "l.line")
