"""Redaction of streams. A document is its own whole, so no state crosses rows."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from veilspan.operators.analysis import default_decisions
from veilspan.operators.extract import Detect, find_patterns
from veilspan.plans.redact import analyse, apply, redact_one


def redact_rows(stream: DataFrame, find: Detect = find_patterns, kind: str = "text", text: str = "text") -> DataFrame:
    """Stateless: ``text`` masked and ``redaction_count`` added, all other columns as they are; append mode, no watermark."""
    names = stream.columns

    def run(batches):
        for b in batches:
            done = [(None, 0, []) if t is None else redact_one(t, find, kind) for t in b[text].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(pa.array([d[0] for d in done], b[text].type) if c == text else b[c] for c in names), pa.array([d[1] for d in done], pa.int64())], [*names, "redaction_count"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)
    return stream.mapInArrow(run, f"{fields}, redaction_count long")


def redact_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, find: Detect = find_patterns, kind: str = "text") -> StreamingQuery:
    """The whole pipeline, windows and joins included, on every micro-batch; ``write`` gets its result and its number, and
    should overwrite by number so that a repeated batch changes nothing."""

    def each(batch: DataFrame, number: int) -> None:
        analysis = analyse(batch, find, kind)
        try:
            write(apply(analysis, default_decisions(analysis.detections), find, kind), number)
        finally:
            analysis.release()  # a long stream would fill the storage memory otherwise

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
