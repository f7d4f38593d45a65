"""Whole pipelines: analyse, decide, apply, verify, count; in two phases with a review between, or in one go."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.functions.dimensions import ALIAS_WINDOW, APPLY_SCORE, FAILURES, MASK, MIN_TOKEN
from veilspan.operators import analysis as A
from veilspan.operators.extract import Detect, absorb, find_patterns, spans_by
from veilspan.operators.fields import STRUCTURES, csv_body, with_fields
from veilspan.operators.mask import mask_texts
from veilspan.operators.spans import merge_ranges
from veilspan.operators.verify import verified


class RedactionFailure(Exception):
    """A failure that a user can be told about: its key is one of FAILURES."""

    def __init__(self, key: str, message: str | None = None):
        super().__init__(message or key)
        self.key = key


def failure_key(cause: BaseException) -> str | None:
    """The key of a failure that has a known one."""
    key = getattr(cause, "key", None)
    return key if isinstance(key, str) and key in FAILURES else None


@dataclass
class Analysis:
    """What was read and found; the apply phase needs nothing else. Write the tables to keep them for a later review."""

    readings: DataFrame
    marks: DataFrame
    detections: DataFrame
    warnings: DataFrame
    cached: tuple[DataFrame, ...] = ()

    def release(self) -> None:
        """Give back the storage that the spans and marks take, once their results are written."""
        for df in self.cached:
            df.unpersist()


def analyse(docs: DataFrame, find: Detect = find_patterns, kind: str = "text") -> Analysis:
    """``docs``: doc_id, text. Nulls count as empty texts."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    readings = A.as_readings(docs)
    # Spans and marks are few beside the texts and are used several times over; a lost block is found again from the texts.
    spans = spans_by(readings, with_fields(find, kind), keep=A.READING, value=True).persist(StorageLevel.MEMORY_AND_DISK)
    marks = A.marks(A.reconcile(spans, readings), readings).persist(StorageLevel.MEMORY_AND_DISK)
    empty = F.when(F.length("text") == 0, F.array(F.lit("warning.noText"))).otherwise(F.array().cast("array<string>"))
    return Analysis(readings, marks, A.detections(marks), docs.select("doc_id", empty.alias("warnings")), (spans, marks))


def analyse_readings(readings: DataFrame, find: Detect = find_patterns) -> tuple[DataFrame, DataFrame]:
    """(marks, detections) of any readings, scans and pages included."""
    marks = A.marks(A.reconcile(spans_by(readings, find, keep=A.READING, value=True), readings), readings)
    return marks, A.detections(marks)


def apply(analysis: Analysis, decisions: DataFrame, find: Detect = find_patterns, kind: str = "text", breaks: bool = True) -> DataFrame:
    """(doc_id, text, redaction_count, warnings): the analysed text with what was decided covered, read again. Line breaks inside
    what is covered stay, unless ``breaks`` is false."""
    kept = A.kept(analysis.marks, decisions)
    masked = mask_texts(analysis.readings.select("doc_id", "text"), merge_ranges(kept.select("doc_id", "start", "end")), breaks=breaks)
    counts = A.redaction_counts(kept, analysis.readings)
    out = masked.join(counts, "doc_id", "left").fillna(0, ["redaction_count"]).join(analysis.warnings, "doc_id")
    visible = F.udf(csv_body, "string", useArrow=True)("text") if kind == "csv" else F.col("text")
    seen = verified(out.withColumn("__visible", visible), find, "__visible")
    return seen.select("doc_id", "text", "redaction_count", "warnings")


def redact_long(docs: DataFrame, find: Detect = find_patterns, kind: str = "text", breaks: bool = True) -> DataFrame:
    """Analyse, take the default decisions, apply: by windows and joins, as a review would go."""
    a = analyse(docs, find, kind)
    return apply(a, A.default_decisions(a.detections), find, kind, breaks)


def redact(docs: DataFrame, find: Detect = find_patterns, kind: str = "text", isolate: bool = False, breaks: bool = True) -> DataFrame:
    """The same for whole files with nobody to ask: a document is one row, so one pass over the rows does it all and
    nothing is shuffled. With ``isolate`` a document whose detector fails has no text and its failure as its warning,
    by its key if that is a known one, and the others go on; without, the failure is raised."""

    def one(text: str) -> tuple:
        try:
            return redact_one(text, find, kind, breaks)
        except Exception as e:
            if not isolate:
                raise
            return None, 0, [failure_key(e) or f"failure: {type(e).__name__}: {e}"]

    def run(batches):
        for b in batches:
            done = [one(t or "") for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.list_(pa.string()))))], ["doc_id", "text", "redaction_count", "warnings"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string, redaction_count long, warnings array<string>")


def redact_files(files: DataFrame, find: Detect = find_patterns) -> DataFrame:
    """``files``: doc_id, name, format, text. Each format by its own rules; a format without one fails alone."""
    done = None
    for kind in STRUCTURES:
        part = redact(files.where(F.col("format") == kind), find, kind)
        done = part if done is None else done.unionByName(part)
    named = files.select("doc_id", "name", "format").join(done, "doc_id", "left")
    return named.withColumn("error_key", F.when(~F.coalesce(F.col("format").isin(*STRUCTURES), F.lit(False)), "failure.unsupported"))


_SPACE = r"[\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
_RX: dict[str, object] = {}


def _rx(name: str, rx: str, fold: bool = True):
    import regex

    if name not in _RX:
        _RX[name] = regex.compile(rx.replace(r"\s", _SPACE), regex.IGNORECASE if fold else 0)
    return _RX[name]


def _folded(value: str) -> str:
    return _rx("ws", r"\s+").sub(" ", _rx("ends", r"^\s+|\s+$").sub("", value)).lower()


def _bounded(phrase: str):
    import regex

    words = (r"\s+".replace(r"\s", _SPACE)).join(map(regex.escape, phrase.split(" ")))
    return regex.compile(r"(?<![\p{L}\p{N}])" + words + r"(?![\p{L}\p{N}])", regex.IGNORECASE)


def _terms(text: str, spans: list) -> set[str]:
    """Terms the text defines for itself, those that shorten personal data just before the bracket aside."""
    if not any(q in text for q in "\"“”"):
        return set()
    out = set()
    for m in _rx("definition", r"\(\s*(?:the\s+|each,?\s+(?:an?\s+)?|an?\s+)?[\"“”]\s*([^\"“”()]{2,60}?)\s*[\"“”]\s*\)").finditer(text):
        near = (text[s[0] : s[1]] for s in spans if s[1] > max(0, m.start() - ALIAS_WINDOW) and s[0] < m.start())
        if not any(_folded(v) != _folded(m[1]) and _bounded(m[1]).search(v) for v in near):
            out.add(_folded(m[1]))
    return out


def redact_one(text: str, find: Detect = find_patterns, kind: str = "text", breaks: bool = True) -> tuple[str, int, list[str]]:
    """One text inside a Python worker: (masked, redactions, warnings)."""
    body, _ = STRUCTURES[kind]
    if not text:
        return text, 0, ["warning.noText"]
    spans = with_fields(find, kind)(text)
    strong: dict[str, tuple] = {}
    for s, e, label, score in spans:
        token = _rx("ws", r"\s+").sub(" ", _rx("ends", r"^\s+|\s+$").sub("", text[s:e]))
        if score >= APPLY_SCORE and len(token) >= MIN_TOKEN and (token.lower() not in strong or strong[token.lower()][2] < score):
            strong[token.lower()] = (token, label, score)
    terms = _terms(text, spans)
    again: dict[tuple, tuple] = {}
    for token, label, score in strong.values():
        for m in _bounded(token).finditer(text):
            again[m.span()] = (label, score)
    spans = spans + [(*at, *what) for at, what in again.items()]
    article = _rx("article", r"^(?:the|an?|el|l[ao]s?|un[ao]?|[ao]s?)\s+")
    spans = [s for s in spans if article.sub("", _folded(text[s[0] : s[1]])) not in terms] if terms else spans
    covered: list[list[int]] = []
    for lo, hi in sorted((s[0], s[1]) for s in absorb(spans) if s[3] >= APPLY_SCORE):
        if covered and lo <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], hi)
        else:
            covered.append([lo, hi])
    out, at = [], 0
    for lo, hi in covered:
        grapheme = _rx("grapheme", r"(?![\r\n\u2028\u2029])\X", False) if breaks else _rx("any grapheme", r"[\r\n]|\X", False)
        out += [text[at:lo], grapheme.sub(MASK, text[lo:hi])]
        at = hi
    masked = "".join([*out, text[at:]])
    seen = body(masked)
    leaked = seen.strip() and any(s[3] >= APPLY_SCORE and seen[s[0] : s[1]].replace(MASK, "").strip() for s in find(seen))
    return masked, len(covered), ["warning.notFullyRedacted"] if leaked else []
