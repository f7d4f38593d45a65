"""Text to spans: pattern matches with offsets, in one Arrow pass or as native expressions.

``pattern_spans`` runs every pattern over a text in one pass, which is how production reads a table once. ``native_spans``
does one pattern inside the JVM: the matches are fenced by a control character and the text split there, so that odd pieces
are matches and the lengths before them are offsets. A cheap test inside the expression keeps texts that can't match from
being searched at all.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions import patterns as P
from veilspan.functions import text as X

SPANS = "start int, end int, label string, score double"
_SOH = "\x01"
_DIGIT = re.compile("[0-9]")
_COMPILED: list[tuple[P.Pattern, Callable[[str], Iterable[tuple[int, int]]]]] = []

Span = tuple[int, int, str, float]
Detect = Callable[[str], list[Span]]


def absorb(spans: Iterable[Span]) -> list[Span]:
    """Spans nested in another of their label fold into it; the container keeps the strongest score. Sorted by start."""
    out: list[list] = []
    open_: dict[str, list] = {}
    for start, end, label, score in sorted(spans, key=lambda s: (s[0], -s[1])):
        box = open_.get(label)
        if box and end <= box[1]:
            box[3] = max(box[3], score)
        else:
            open_[label] = box = [start, end, label, score]
            out.append(box)
    return [tuple(b) for b in out]


def _finder(p: P.Pattern) -> Callable[[str], Iterable[tuple[int, int]]]:
    if p.need == "@":
        return P.outwards(p)
    each, group = P.python(p).finditer, int(p.value)
    return lambda text: [m.span(group) for m in each(text)]


def find_patterns(text: str) -> list[Span]:
    """All verified pattern matches of a text, nested ones absorbed."""
    if not _COMPILED:
        _COMPILED.extend((p, _finder(p)) for p in P.PATTERNS)
    has_digit, found = _DIGIT.search(text) is not None, []
    for p, each in _COMPILED:
        if ("@" not in text) if p.need == "@" else not has_digit:
            continue
        for start, end in each(text):
            if p.verify is None or P.VERIFY[p.verify](text[start:end]):
                found.append((start, end, p.label, 1.0))
    return absorb(found)


def spans_by(df: DataFrame, find: Detect, text: str = "text", keep: tuple[str, ...] = ("doc_id",), value: bool = False) -> DataFrame:
    """Rows (keep, start, end, label, score) of what ``find`` sees in each text. Empty texts are never shown to it.
    With ``value`` the covered characters come along, which saves a join with the texts later."""
    kinds = {"start": pa.int32(), "end": pa.int32(), "label": pa.string(), "score": pa.float64()} | ({"value": pa.string()} if value else {})

    def run(batches):
        for b in batches:
            at, rows = [], []
            for i, t in enumerate(b["__text"].to_pylist()):
                own = find(t)
                rows += [(*s, t[s[0] : s[1]]) for s in own] if value else own
                at += [i] * len(own)
            held = pa.array(at, pa.int32())
            cols = [b[k].take(held) for k in keep]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values()))], [*keep, *kinds])

    rows = df.where(F.length(text) > 0).select(*keep, F.col(text).alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)
    return rows.mapInArrow(run, f"{fields}, {SPANS}" + (", value string" if value else ""))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt over all cores by their keys, before work that is heavy beside their bytes: a file of keys alone is a few
    splits, whatever its rows cost. Do it while the rows are narrow. The count is what the cores and the settings say."""
    spark = df.sparkSession
    n = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *keys)


def pattern_spans(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    return spans_by(df, find_patterns, text, keep)


def pieces(text: Column, p: P.Pattern) -> Column:
    """array<string>: the text between a pattern's unverified matches, and these in the odd places. U+0001 must not occur."""
    if p.value:
        head, tail = _around_value(P.java(p))
        fenced, put = f"({head})({tail[0]}){tail[1]}", f"$1{_SOH}$2{_SOH}"
    else:
        fenced, put = P.java(p), f"{_SOH}$0{_SOH}"
    need = text.contains("@") if p.need == "@" else text.rlike("[0-9]")
    return F.split(F.when(need, F.regexp_replace(text, F.lit(fenced), F.lit(put))).otherwise(F.lit("")), _SOH, -1)


def located(cut: Column) -> Column:
    """array<struct<start, end, value>> of the matches among a text's pieces. ``cut`` should be a column of its own, so that the
    text is searched once."""
    every = F.zip_with(cut, X.offsets(cut), lambda x, at: F.struct(at.alias("start"), (at + F.length(x)).alias("end"), x.alias("value")))
    return F.filter(every, lambda s, i: (i % 2 == 1) & s["value"].isNotNull())


def _around_value(rx: str) -> tuple[str, tuple[str, str]]:
    """A pattern's text before its value group, the group's inside, and the text behind it."""
    at = next(i for i in range(len(rx)) if rx[i] == "(" and rx[i + 1] != "?" and rx[i - 1] not in "\\[")
    depth, i = 0, at
    while True:
        depth += {"(": 1, ")": -1}.get(rx[i], 0) if rx[i - 1] != "\\" else 0
        if not depth:
            return rx[:at], (rx[at + 1 : i], rx[i + 1 :])
        i += 1


def native_spans(df: DataFrame, names: Iterable[str], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows (keep, start, end, label, score, value) of some patterns, one scan, no Python."""
    own = [P.by_id(name) for name in names]

    def verified(i: int, p: P.Pattern) -> Column:
        found = located(F.col(f"__cut{i}"))
        if p.verify:
            found = F.filter(found, lambda s: P.VERIFY_COLUMN[p.verify](s["value"]))
        return F.transform(found, lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), F.lit(p.label).alias("label"), F.lit(1.0).alias("score"), s["value"].alias("value")))

    rows = df.where(F.length(text) > 0).select(*keep, *(pieces(F.col(text), p).alias(f"__cut{i}") for i, p in enumerate(own)))
    rows = rows.select(*keep, F.explode(F.flatten(F.array(*(verified(i, p) for i, p in enumerate(own))))).alias("s"))
    return rows.select(*keep, "s.*")


def native_places(df: DataFrame, names: Iterable[str], text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (keep, and for each pattern by its name array<struct<start, end, value>> of its verified matches), one scan for all."""
    own = [P.by_id(name) for name in names]
    rows = df.where(F.length(text) > 0).select(*keep, *(pieces(F.col(text), p).alias(p.id) for p in own))

    def verified(p: P.Pattern) -> Column:
        found = located(F.col(p.id))
        return F.filter(found, lambda s: P.VERIFY_COLUMN[p.verify](s["value"])) if p.verify else found

    return rows.select(*keep, *(verified(p).alias(p.id) for p in own))


def dictionary(needles: dict[str, tuple[str, float]]) -> Detect:
    """A stand-in for a model: every occurrence of known phrases, with label and score."""

    def find(text: str) -> list[Span]:
        out = []
        for phrase, (label, score) in needles.items():
            at = text.find(phrase) if phrase else -1
            while at >= 0:
                out.append((at, at + len(phrase), label, score))
                at = text.find(phrase, at + len(phrase))
        return sorted(out)

    return find


def with_patterns(model: Detect) -> Detect:
    """A model's spans tightened to the verified ones."""
    return lambda text: tighten(model(text), find_patterns(text), text)


def tighten(found: list[Span], exact: list[Span], text: str) -> list[Span]:
    """A model's span gives way to a verified one of its label inside it, unless a digit stands in a margin."""

    def gives_way(s: Span) -> bool:
        return any(e[2] == s[2] and s[0] <= e[0] and e[1] <= s[1] and not any("0" <= c <= "9" for c in text[s[0] : e[0]] + text[e[1] : s[1]]) for e in exact)

    return [s for s in found if not gives_way(s)] + exact
