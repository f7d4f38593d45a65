"""The evaluation run: a labelled corpus against what a detector finds, in six ways."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.functions.dimensions import APPLY_SCORE
from veilspan.operators import evaluate
from veilspan.operators.extract import Detect, find_patterns, pattern_spans, spans_by
from veilspan.operators.fields import STRUCTURES, with_fields
from veilspan.plans.redact import analyse
from veilspan.sources.corpus import gold_spans

#: The tables of a run, in the order of its report.
TABLES = ("overlap", "exact", "by_language", "patterns", "everything", "analysed")
_TITLES = {
    "overlap": "Detector, spans that overlap", "exact": "Detector, spans with the same bounds", "by_language": "Detector by language, spans that overlap",
    "patterns": "Patterns alone, spans that overlap", "everything": "Detector and field names, spans that overlap", "analysed": "Review list, spans that overlap",
}


@dataclass
class Evaluation:
    """Scores by the names of TABLES, and each document's predictions."""

    tables: dict[str, DataFrame]
    predicted: DataFrame

    def report(self) -> str:
        return "\n\n".join(evaluate.report(self.tables[t], _TITLES[t], "language" if t == "by_language" else "label") for t in TABLES)

    def scores(self) -> DataFrame:
        """All tables as one: (table, name, counts, precision, recall, f1)."""
        out = None
        for t in TABLES:
            rows = self.tables[t].withColumnRenamed("language" if t == "by_language" else "label", "name").withColumn("table", F.lit(t))
            out = rows if out is None else out.unionByName(rows)
        return out


def run(corpus: DataFrame, find: Detect = find_patterns, chosen: str | None = None, floor: float = APPLY_SCORE) -> Evaluation:
    """``corpus`` as ``sources.corpus.load`` gives it; with ``chosen`` the documents whose id holds that text, of which there must
    be one at least. What the detector finds below ``floor`` doesn't count."""
    if chosen is not None:
        corpus = corpus.where(F.col("id").contains(chosen))
        if corpus.isEmpty():
            raise ValueError(f"no document of the corpus matches {chosen}")

    def strong(text: str) -> list:
        return [s for s in find(text) if s[3] >= floor]

    docs, gold = corpus.select(F.col("id").alias("doc_id"), "language", "format", "text"), gold_spans(corpus)
    span = ("doc_id", "start", "end", "label", "score")
    found = spans_by(docs, strong).select(*span).persist(StorageLevel.MEMORY_AND_DISK)
    fields = analysed = None
    for kind in STRUCTURES:
        own = docs.where(F.col("format") == kind)
        more = spans_by(own, with_fields(strong, kind)).select(*span)
        listed = analyse(own.select("doc_id", "text"), strong, kind).detections.select(*span)
        fields, analysed = (more, listed) if fields is None else (fields.unionByName(more), analysed.unionByName(listed))
    overlap = evaluate.counts(gold, found)
    by_label = {"overlap": overlap, "exact": evaluate.counts(gold, found, exact=True), "patterns": evaluate.counts(gold, pattern_spans(docs)), "everything": evaluate.counts(gold, fields), "analysed": evaluate.counts(gold, analysed)}
    tables = {name: evaluate.by_label(c) for name, c in by_label.items()} | {"by_language": evaluate.by_language(overlap, docs)}
    spans = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "label", "score"))).alias("predicted"))
    none = F.array().cast(spans.schema["predicted"].dataType)
    predicted = docs.join(spans, "doc_id", "left").select(F.col("doc_id").alias("id"), "language", F.coalesce("predicted", none).alias("predicted"))
    return Evaluation(tables, predicted)
