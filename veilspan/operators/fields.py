"""Spans that a structured text's field names give: values below CSV headers, values behind JSON keys."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.functions import patterns
from veilspan.functions.dimensions import field_labels, field_table
from veilspan.functions.text import field_key
from veilspan.operators.extract import Span, spans_by

#: Delimiters in order of preference. Fixed value.
DELIMITERS = (",", ";", "\t")
_BLANKS = "".join(chr(c) for c in patterns.SPACES if c not in (10, 13))


def label_of(name: str) -> str | None:
    bare = "".join(c for c in unicodedata.normalize("NFD", name) if not unicodedata.combining(c)).lower()
    return field_labels().get("".join(c for c in bare if c.isascii() and c.isalnum()))


def labelled_fields(names: DataFrame, column: str = "name") -> DataFrame:
    """``names`` with the label of each field name, or null: a join with a table of fixed size."""
    keyed = names.withColumn("field", field_key(F.col(column)))
    return keyed.join(F.broadcast(field_table(names.sparkSession)), "field", "left").drop("field")


# ---------------------------------------------------------------- CSV


class _Scanner:
    """Reads one cell after the other; stops for good at a quote it can't place."""

    def __init__(self, text: str, delimiter: str):
        self.text, self.delimiter, self.at, self.n = text, delimiter, 0, len(text)

    def _separator(self, at: int) -> str | None:
        t = self.text
        if at >= self.n:
            return ""
        if t[at] == self.delimiter:
            return self.delimiter
        return ("\r\n" if t[at : at + 2] == "\r\n" else t[at]) if t[at] in "\r\n" else None

    def cell(self) -> tuple[int, int, str] | None:
        """(start, end, separator) of the next cell, quotes and padding included."""
        start = at = self.at
        t, blanks = self.text, _BLANKS.replace(self.delimiter, "")
        while at < self.n and t[at] in blanks:
            at += 1
        if at < self.n and t[at] == '"':
            at += 1
            while True:
                at = t.find('"', at)
                if at < 0:
                    break
                if t[at + 1 : at + 2] != '"':
                    at += 1
                    while at < self.n and t[at] in blanks:
                        at += 1
                    sep = self._separator(at)
                    if sep is not None:
                        self.at = at + len(sep)
                        return start, at, sep
                    break
                at += 2
        at = start
        while at < self.n and t[at] not in f'"\r\n{self.delimiter}':
            at += 1
        sep = self._separator(at)
        if sep is None:
            return None
        self.at = at + len(sep)
        return start, at, sep


def _inner(text: str, start: int, end: int) -> tuple[int, int, str]:
    """A cell without padding and surrounding quotes, and its value."""
    raw = text[start:end]
    start, end = start + len(raw) - len(raw.lstrip(_BLANKS + "\r\n")), end - len(raw) + len(raw.rstrip(_BLANKS + "\r\n"))
    end = max(start, end)
    if end - start >= 2 and text[start] == text[end - 1] == '"':
        start, end = start + 1, end - 1
    return start, end, text[start:end].replace('""', '"')


def csv_rows(text: str, delimiter: str) -> Iterator[tuple[list[tuple[int, int, str]], int]]:
    """(cells, end) of rows that have any value."""
    scan, cells = _Scanner(text, delimiter), []
    while True:
        before = scan.at
        got = scan.cell()
        if got is None or (scan.at == before and not cells):
            return
        start, end, sep = got
        cells.append(_inner(text, start, end))
        if sep == delimiter:
            continue
        if any(v for _, _, v in cells):
            yield cells, scan.at
        cells = []
        if sep == "":
            return


def pick_delimiter(text: str) -> str:
    """The one that gives the first row most columns; the earlier of equals."""
    width = {d: len(next(csv_rows(text, d), ([], 0))[0]) for d in DELIMITERS}
    return max(DELIMITERS, key=lambda d: (width[d], -DELIMITERS.index(d)))


def csv_spans(text: str) -> list[Span]:
    rows = csv_rows(text, pick_delimiter(text))
    head = next(rows, None)
    labels = [label_of(v) for _, _, v in head[0]] if head else []
    return [(s, e, labels[i], 1.0) for cells, _ in rows for i, (s, e, v) in enumerate(cells) if i < len(labels) and labels[i] and v.strip()]


def csv_body(text: str) -> str:
    """What stands behind the header row."""
    head = next(csv_rows(text, pick_delimiter(text)), None)
    return text[head[1] :] if head else ""


# ---------------------------------------------------------------- JSON


def _strict(value: str):
    raise ValueError(value)


def json_spans(text: str) -> list[Span]:
    """Strings and numbers that follow a known key directly, if the whole text is valid JSON."""
    import regex

    try:
        json.loads(text, parse_constant=_strict, parse_int=float)
    except (ValueError, RecursionError):
        return []
    token = regex.compile(r'"(?:[^"\\]|\\.)*+"(?P<key>\s*:)?|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+\-]?[0-9]+)?|true|false|null|[{}\[\],]')
    out, label = [], None
    for m in token.finditer(text):
        if m["key"]:
            label = label_of(json.loads(m[0][: -len(m["key"])], strict=False))
            continue
        quote = int(m[0][0] == '"')
        if label and (quote or m[0][0] in "-0123456789") and m.end() - m.start() > 2 * quote:
            out.append((m.start() + quote, m.end() - quote, label, 1.0))
        label = None
    return out


STRUCTURES = {"csv": (csv_body, csv_spans), "json": (lambda t: t, json_spans), "text": (lambda t: t, lambda t: [])}


def field_spans(df: DataFrame, kind: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    return spans_by(df, STRUCTURES[kind][1], text, keep)


def with_fields(find, kind: str):
    """A detector that also gives the structure's own spans."""
    return lambda text: find(text) + STRUCTURES[kind][1](text)
