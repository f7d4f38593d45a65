"""Document-wide reconciliation: values repeat wherever they stand, defined terms are dropped, every detection gets an identity.

Long tables: readings(doc_id, unit_no, reading_no, is_scan, page, text) and spans(doc_id, unit_no, reading_no, start, end,
label, score). A scan's readings are alternatives; typed text has one reading a unit.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspan.functions import text as X
from veilspan.functions.dimensions import ALIAS_WINDOW, APPLY_SCORE, MIN_TOKEN
from veilspan.operators.spans import absorb_nested, merged_values, with_value

READING = ("doc_id", "unit_no", "reading_no")
SPAN_COLUMNS = [*READING, "start", "end", "label", "score", "value"]


def as_readings(docs: DataFrame, text: str = "text") -> DataFrame:
    """Typed files as readings: one unit, one reading."""
    return docs.select("doc_id", F.lit(0).alias("unit_no"), F.lit(0).alias("reading_no"), F.lit(False).alias("is_scan"), F.lit(None).cast("int").alias("page"), F.col(text).alias("text"))


def tokens(spans: DataFrame, readings: DataFrame) -> DataFrame:
    """(doc_id, key, token, label, score): strong whole values of a document, once each; the strongest, then the first."""
    v = with_value(spans.where(F.col("score") >= APPLY_SCORE), readings.select(*READING, "text"), READING).withColumn("token", X.normalise(F.col("value")))
    v = v.where(F.length("token") >= MIN_TOKEN).withColumn("key", F.lower("token"))
    first = Window.partitionBy("doc_id", "key").orderBy(F.desc("score"), "unit_no", "reading_no", "start", "end", "label")
    return v.withColumn("n", F.row_number().over(first)).where("n = 1").select("doc_id", "key", "token", "label", "score")


def repeats(tokens_: DataFrame, readings: DataFrame) -> DataFrame:
    """Every bounded occurrence of a document's tokens in all its readings, letter case and white space aside.

    The document's tokens come as one array, which its values bound; each reading is searched once, for all of them."""
    own = tokens_.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("key", "token", "label", "score"))).alias("tokens"))
    rows = readings.join(own, "doc_id").select(*READING, "text", "tokens")

    def run(batches):
        import regex

        space = "[\\t-\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]+"
        for b in batches:
            at, out = [], []
            for i, (text, own) in enumerate(zip(b["text"].to_pylist(), b["tokens"].to_pylist())):
                found = {}
                for t in own:
                    rx = regex.compile(r"(?<![\p{L}\p{N}])" + space.join(map(regex.escape, t["token"].split(" "))) + r"(?![\p{L}\p{N}])", regex.IGNORECASE)
                    for m in rx.finditer(text or ""):
                        found[m.span()] = (t["label"], t["score"])
                rows_ = [(s, e, *found[s, e], text[s:e]) for s, e in sorted(found)]
                out += rows_
                at += [i] * len(rows_)
            held = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([*(b[k].take(held) for k in READING), *(pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.string())))], SPAN_COLUMNS)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in readings.select(*READING).schema.fields)
    return rows.mapInArrow(run, f"{fields}, start int, end int, label string, score double, value string")


#: A term that a document defines for itself: (the "Client"). Fixed value; group 1 is the term.
DEFINITION = r"(?iu)\([\s\p{Z}]*(?:the[\s\p{Z}]+|each,?[\s\p{Z}]+(?:an?[\s\p{Z}]+)?|an?[\s\p{Z}]+)?[\"“”][\s\p{Z}]*([^\"“”()]{2,60}?)[\s\p{Z}]*[\"“”][\s\p{Z}]*\)"


def definitions(readings: DataFrame) -> DataFrame:
    """(reading, at, term) of each definition; nothing but the JVM's regular expressions."""
    soh, stx = "\x01", "\x02"
    fenced = F.regexp_replace(F.col("text"), DEFINITION, f"{soh}$1{stx}$0{soh}")
    pieces = F.split(F.when(F.col("text").rlike("[\"“”]"), fenced).otherwise(F.lit("")), soh, -1)
    size = lambda p, i: F.when(i % 2 == 1, F.length(F.element_at(F.split(p, stx), -1))).otherwise(F.length(p))
    before = F.transform("p", lambda x, i: F.aggregate(F.transform(F.slice("p", 1, i), size), F.lit(0), lambda n, k: n + k))
    rows = readings.select(*READING, pieces.alias("p"))
    every = F.transform("p", lambda x, i: F.struct(i.alias("i"), F.get(before, i).alias("at"), F.element_at(F.split(x, stx), 1).alias("term")))
    return rows.select(*READING, F.explode(F.filter(every, lambda s: s["i"] % 2 == 1)).alias("d")).select(*READING, "d.at", "d.term")


def defined_terms(spans: DataFrame, readings: DataFrame) -> DataFrame:
    """(doc_id, term), folded: defined terms that aren't a part of longer personal data just before the bracket."""
    d = definitions(readings)
    v = with_value(spans, readings.select(*READING, "text"), READING)
    v = v.select(*(F.col(c).alias(f"v_{c}") for c in READING), "start", "end", "value")
    bounded = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])"), X.escaped(F.col("term")), F.lit(r"(?![\p{L}\p{N}])"))
    alias = (F.col("end") > F.greatest(F.lit(0), F.col("at") - ALIAS_WINDOW)) & (F.col("start") < F.col("at")) & (X.folded(F.col("value")) != X.folded(F.col("term"))) & F.regexp_like("value", bounded)
    for c in READING:
        alias = alias & (F.col(c) == F.col(f"v_{c}"))
    return d.join(v, alias, "left_anti").select("doc_id", X.folded(F.col("term")).alias("term")).distinct()


def drop_terms(spans: DataFrame, terms: DataFrame, readings: DataFrame) -> DataFrame:
    """Spans whose text, a leading article aside, isn't a term of their document."""
    v = with_value(spans, readings.select(*READING, "text"), READING).withColumn("term", X.as_term(F.col("value")))
    return v.join(terms, ["doc_id", "term"], "left_anti").select(*SPAN_COLUMNS)


def reconcile(spans: DataFrame, readings: DataFrame) -> DataFrame:
    """Detected spans and repeats, without defined terms. Terms come from what was detected, repeats join before they go."""
    spans = with_value(spans, readings.select(*READING, "text"), READING).select(*SPAN_COLUMNS)
    every = spans.unionByName(repeats(tokens(spans, readings), readings))
    return drop_terms(every, defined_terms(spans, readings), readings)


def marks_by_position(spans: DataFrame, readings: DataFrame) -> DataFrame:
    """Typed readings: nested spans absorbed, each place a decision of its own."""
    spans = with_value(spans, readings.select(*READING, "text"), READING).select(*SPAN_COLUMNS)
    kept = absorb_nested(spans, READING).join(readings.where(~F.col("is_scan")).select(*READING, "page"), list(READING))
    ident = F.concat(F.coalesce(F.col("page").cast("string"), F.lit("")), F.lit(":"), F.col("start"), F.lit("-"), F.col("end"), F.lit(":"), F.col("label"))
    return kept.withColumn("detection_id", ident)


def marks_by_value(spans: DataFrame, readings: DataFrame, accents: bool = False) -> DataFrame:
    """Scans: a value is one decision, whichever reading shows it; a place is marked once for a value. With ``accents`` values that
    differ in marks only are two."""
    scans = readings.where("is_scan").select(*READING, "page", "text")
    v = with_value(spans, scans.select(*READING, "text"), READING).select(*SPAN_COLUMNS).join(scans.select(*READING, "page"), list(READING))
    ident = F.concat(F.coalesce(F.col("page").cast("string"), F.lit("")), F.lit(":"), F.col("label"), F.lit(":"), X.value_key(F.col("value"), accents))
    v = v.withColumn("detection_id", ident)
    return v.groupBy(*READING, "page", "start", "end", "label", "value", "detection_id").agg(F.max("score").alias("score"))


def marks(spans: DataFrame, readings: DataFrame, accents: bool = False) -> DataFrame:
    """(reading, page, start, end, label, score, value, detection_id) of typed readings and scans."""
    names = [*READING, "page", "start", "end", "label", "score", "value", "detection_id"]
    return marks_by_position(spans, readings).select(*names).unionByName(marks_by_value(spans, readings, accents).select(*names))


def detections(marks_: DataFrame) -> DataFrame:
    """One row a decision to take: the strongest mark, the first of equals, with a preview."""
    first = Window.partitionBy("doc_id", "unit_no", "detection_id").orderBy(F.desc("score"), "reading_no", "start", "end")
    rows = marks_.withColumn("n", F.row_number().over(first)).where("n = 1")
    return rows.select("doc_id", "unit_no", "detection_id", "page", "start", "end", "label", "score", X.preview(F.col("value")).alias("preview"))


def default_decisions(detections_: DataFrame, floor: float = APPLY_SCORE) -> DataFrame:
    return detections_.where(F.col("score") >= floor).select("doc_id", "detection_id")


def review_list(detections_: DataFrame, floor: float = APPLY_SCORE) -> DataFrame:
    """Detections by label, the least certain first, split into certain ones and suggestions."""
    bucket = F.when(F.col("score") >= floor, "certain").otherwise("suggestion")
    at = Window.partitionBy("doc_id", "label").orderBy("score", "start", "end", "detection_id")
    return detections_.withColumn("bucket", bucket).withColumn("place", F.row_number().over(at))


def kept(marks_: DataFrame, decisions: DataFrame) -> DataFrame:
    """Marks that are decided to be covered."""
    return marks_.join(decisions.select("doc_id", "detection_id").distinct(), ["doc_id", "detection_id"], "left_semi")


def redaction_counts(kept_: DataFrame, readings: DataFrame, accents: bool = False) -> DataFrame:
    """(doc_id, redaction_count): of a unit's readings a value counts as often as in the one that shows it most."""
    merged = merged_values(with_value(kept_, readings.select(*READING, "text"), READING), READING)
    each = merged.groupBy(*READING, X.value_key(F.col("value"), accents).alias("key")).count()
    return each.groupBy("doc_id", "unit_no", "key").agg(F.max("count").alias("n")).groupBy("doc_id").agg(F.sum("n").alias("redaction_count"))
