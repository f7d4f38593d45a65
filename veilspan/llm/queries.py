"""The queries op1 to op10: each operator over its whole table, with the settings of production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm import bpe, kneser_ney, linedup, mih, mpegts, packing, quality, sharding, simhash, toxicity
from veilspan.llm.common import fold, read_table

SHARDS = 16
#: A text is toxic from the first score on, and good enough from the second on.
TOXIC, GOOD = 0.5, 0.3


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 1
    docs = docs.select("doc_id", size.alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    tree = sharding.topology(SHARDS)
    out = sharding.assign(docs, "doc_id", tree, sharding.grow(tree), ["size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op2_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold(F.col("doc_id")) == 1
    out = kneser_ney.train_and_score(docs, ~held_out, keep=["doc_id"])
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    path = _tokenizer("byte_bpe_50k.json")
    pieces = packing.pack(docs, path, _tokenizer("byte_bpe_50k.tiktoken"), length=1024, end=0)
    return packing.digests(pieces, path).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "boundary")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.score(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")), keep=["doc_id"])
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = simhash.near_duplicates(docs, radius=4, width=4, seed=42)
    return out.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op6_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mih.nearest(read_table(spark, sf_dir, "embeddings"), k=10, every=100)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.score(docs, quality.train(docs, read_table(spark, sf_dir, "labels")), keep=["doc_id"])
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_mpegts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpegts.digests(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, _tokenizer("byte_bpe_50k.tiktoken"), keep=["doc_id"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_kneser_ney": op2_kneser_ney,
    "op3_packing": op3_packing,
    "op4_toxicity": op4_toxicity,
    "op5_simhash": op5_simhash,
    "op6_multi_index": op6_multi_index,
    "op7_quality": op7_quality,
    "op8_line_dedup": op8_line_dedup,
    "op9_mpegts": op9_mpegts,
    "op10_bpe": op10_bpe,
}

def _sharding_sql() -> str:
    """op1 in SQL: the same descent by MD5, running slots in the order of buckets, and CRC-32 by a fold over bytes."""

    def child(path: str, weights: dict[int, float]) -> str:
        draw = lambda c, w: f"-ln((CAST('0x' || substr(md5('{path}/{c}/' || k), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) / {w:.1f}"
        return f"list_sort([{', '.join(f'{{d: {draw(c, w)}, c: {c}}}' for c, w in weights.items())}])[1].c" if len(weights) > 1 else str(next(iter(weights)))

    def descend(tree: list[sharding.Shard], level: int = 0, path: str = "root", own: list[int] | None = None) -> str:
        own = list(range(len(tree))) if own is None else own
        of = lambda i: (tree[i].region, tree[i].rack, i)[level]
        weights: dict[int, float] = {}
        for i in own:
            weights[of(i)] = weights.get(of(i), 0) + tree[i].weight
        if level == 2:
            return child(path, weights)
        below = {c: descend(tree, level + 1, f"{path}/{c}", [i for i in own if of(i) == c]) for c in weights}
        return f"(CASE {child(path, weights)} {' '.join(f'WHEN {c} THEN {x}' for c, x in below.items())} END)"

    tree = sharding.topology(SHARDS)
    crc = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT))), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), CAST(4294967295 AS BIGINT))"
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END"
    return f"""WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, b: {step})) AS tab),
      d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size, {crc} AS text_crc32 FROM documents, t),
      p AS (SELECT *, CAST({descend(tree)} AS INT) AS shard, CAST({descend(sharding.grow(tree))} AS INT) AS grown_shard, CAST('0x' || substr(md5(k || '/' || size || '/' || text_crc32), 1, 8) AS BIGINT) % {sharding.BUCKETS} AS bucket FROM d)
      SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY bucket, k, size, text_crc32) - 1 AS slot, grown_shard FROM p"""


#: The others can't be said in SQL that DuckDB runs: they hash with XXH64, train, tokenise or write streams.
ORACLE_SQL: dict[str, str] = {"op1_sharding": _sharding_sql()}
