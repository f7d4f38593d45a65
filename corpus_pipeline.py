"""A training corpus from raw documents: quality, toxicity, line dedup, near-duplicates, packing.

Every stage takes the documents that the one before kept, with all their columns, and defines the odd cases as its operator
does: a null text counts as empty, stays null where it is kept, and is packed as its end mark; an empty text is scored by the
classifiers' intercepts; texts of any length are read whole; equal rows are judged each until near-duplicates, where one of each
group stays (rows without an id all stay); an empty table, or labels that name none of the documents, give an empty
table or models that keep everything the defaults keep; columns of any name are passed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm import jaccard, linedup, packing, quality, toxicity
from veilspan.llm.common import free_name, read_table, written
from veilspan.llm.queries import GOOD, TOXIC, _tokenizer


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches GOOD. The classifier learns from this stage's own documents. Without labels all
    score 0.5 and stay."""
    model, name = quality.train(docs, read_table(spark, sf_dir, "labels")), free_name(docs.columns, "__score")
    return quality.score(docs, model, "text", docs.columns, name).where(F.col(name) >= GOOD).drop(name)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays under TOXIC. Without labels the grammar's seeds decide; empty texts stay."""
    model, name = toxicity.train(docs, read_table(spark, sf_dir, "labels")), free_name(docs.columns, "__score")
    return toxicity.score(docs, model, "text", docs.columns, name).where(F.col(name) < TOXIC).drop(name)


def lines_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks of lines that an earlier one holds; n_chars, if there is one, follows the text. Null and
    empty texts, and rows without an id, stay as they are; a document that loses all its text stays, empty."""
    out = linedup.dedup(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    own = [c for c in docs.columns if c in out.columns]
    return out.select(own)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are similar by 0.8 or more stays, the one with the smallest id."""
    return jaccard.keep_first(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in windows of 1024. A null or empty text is its end mark; the last window may be short."""
    path = _tokenizer("byte_bpe_50k.json")
    return packing.digests(packing.pack(docs, path, _tokenizer("byte_bpe_50k.tiktoken")), path)


STAGES = [("quality", good_quality), ("toxicity", not_toxic), ("line_dedup", lines_once), ("near_duplicates", near_duplicates), ("packing", packed)]

#: The stages hash, train and tokenise in ways SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
