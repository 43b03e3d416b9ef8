"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import byte_bpe, chat, ctw, exact_dedup, hard_negatives, packing, prefix_hash, quality, repeats, simhash, token_files, whitening, wrapper
from tessera.llm.common import read
from tessera.session import new_path


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = ctw.split()
    return ctw.score(read(spark, sf_dir, "documents"), ~held_out).withColumn("held_out", held_out)


def op2_prefix_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_hash.edited_pairs(read(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = spark.range(2, numPartitions=1).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return chat.digests(read(spark, sf_dir, "conversations").select(*said.columns).unionByName(said))


_CONTROLS = r"\\|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|\[ASST\]|\[ROLE\]|\[/ROLE\]"
#: Each control string or backslash in a text costs one more character; the rest is the marks of a turn.
OP4_SQL = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)
), counted AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '{_CONTROLS}')) + CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 10 WHEN 'system' THEN 15
    ELSE 17 + length(role) + len(regexp_extract_all(role, '{_CONTROLS}')) END AS size FROM said
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(size)::BIGINT AS formatted_chars
FROM counted GROUP BY conv_id
"""


def op5_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.main_texts(read(spark, sf_dir, "pages"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = _vocabulary("byte_bpe_50k.tiktoken")
    encoded = byte_bpe.encode(read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    decoded = byte_bpe.decode(encoded, ranks, public_tokenizers.PATTERN)
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("data", 256).alias("decoded_sha256"),
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents")).drop("bucket", "slot")


OP7_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json")).drop("ids")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(read(spark, sf_dir, "documents"), words=4, distance=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removed_bytes(read(spark, sf_dir, "documents"), least=50)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0, positives=5, negatives=5, low=80)


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: coalesce(isfinite(c), false))) = len(embedding)
), s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_inner_product(a.x, r.x) AS BIGINT) AS score FROM v a JOIN v r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 5
"""


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"), components=4)


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    token_files.write(read(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), path, end_id=2)
    return token_files.documents(spark, path).drop("ids")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ctw": op1_ctw,
    "op2_prefix_hash": op2_prefix_hash,
    "op3_quality": op3_quality,
    "op4_chat": op4_chat,
    "op5_wrapper": op5_wrapper,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_packing": op8_packing,
    "op9_simhash": op9_simhash,
    "op10_repeats": op10_repeats,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_whitening": op12_whitening,
    "op13_token_files": op13_token_files,
}
ORACLE_SQL: dict[str, str] = {"op4_chat": OP4_SQL, "op7_exact_dedup": OP7_SQL, "op11_hard_negatives": OP11_SQL}
