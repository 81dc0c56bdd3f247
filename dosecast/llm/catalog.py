"""The registered queries of the thirteen operators, and their SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dosecast.llm import ann, bpe, chat, lm, minhash, mixing, negatives, pii, quality, sharding, simhash, toxicity, whitening
from dosecast.llm.common import documents, embeddings, labels
from dosecast.session import ship_package

#: Wanted shares of tokens by the label ``quality``.
MIX_WEIGHTS = {1: 0.95, 0: 0.05}

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return pii.pii_digest(documents(spark, sf_dir))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return quality.quality(documents(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return toxicity.toxicity(documents(spark, sf_dir), labels(spark, sf_dir))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return bpe.encoding_digest(documents(spark, sf_dir), RANKS, public_tokenizers.PATTERN)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = sharding.shard_by_bytes(documents(spark, sf_dir), keep=["doc_id"])
    return sharded.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return ann.nearest(embeddings(spark, sf_dir), F.col("id") % 20 == 0)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    rated, domains = mixing.mixing_rates(documents(spark, sf_dir), labels(spark, sf_dir), MIX_WEIGHTS, "quality")
    of = {d: F.col("posterior")[i] for i, d in enumerate(domains)}
    wanted = [of.get(d, F.lit(None).cast("double")).alias(f"quality_{d}") for d in sorted(MIX_WEIGHTS)]
    return rated.select("doc_id", "tokens", *wanted, "rate", "copies")


def op8_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against itself with its neighbour's last reply."""
    own = chat.turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "conv_id")
    segments = chat.preference_segments(own, chat.swapped_replies(own))
    return segments.select(F.col("pair").alias("conv_id"), "turn", "copy", "part", "role", "segment", "mask")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return simhash.simhash_classes(documents(spark, sf_dir))


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = documents(spark, sf_dir)
    scored = lm.lm_scores(docs, ~lm.held_out(docs["doc_id"]))
    return scored.select("doc_id", lm.held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return whitening.whitened(embeddings(spark, sf_dir))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return minhash.minhash_classes(documents(spark, sf_dir), shingle=4)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    rows = embeddings(spark, sf_dir)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", label), F.col("id") % 100 == 0)


QUERIES = {f.__name__: f for f in (op1_pii, op2_quality, op3_toxicity, op4_bpe, op5_sharding, op6_ann, op7_mixing, op8_preference, op9_simhash, op10_lm, op11_whitening, op12_minhash, op13_hard_negatives)}

ORACLES = {
    "op8_preference": """
WITH own AS (
  SELECT conv_id AS pair, coalesce(turn, -1) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id, coalesce(turn, -1) ORDER BY coalesce(role, ''), coalesce(text, '')) AS copy
  FROM conversations WHERE conv_id IS NOT NULL),
last AS (
  SELECT pair, turn, copy, text FROM own WHERE role = 'assistant'
  QUALIFY row_number() OVER (PARTITION BY pair ORDER BY turn DESC, copy DESC) = 1),
swapped AS (
  SELECT o.pair, o.turn, o.copy, o.role, CASE WHEN l.pair IS NULL THEN o.text ELSE n.text END AS text
  FROM own o LEFT JOIN last l ON l.pair = o.pair AND l.turn = o.turn AND l.copy = o.copy
  LEFT JOIN last n ON n.pair = xor(o.pair, 1)
  WHERE l.pair IS NULL OR n.text IS NOT NULL),
places AS (
  SELECT coalesce(a.pair, b.pair) AS pair, coalesce(a.turn, b.turn) AS turn, coalesce(a.copy, b.copy) AS copy,
         a.role AS own_role, a.text AS own_text, b.role AS other_role, b.text AS other_text,
         a.role IS NOT DISTINCT FROM b.role AND a.text IS NOT DISTINCT FROM b.text AS same
  FROM own a FULL JOIN swapped b ON a.pair = b.pair AND a.turn = b.turn AND a.copy = b.copy),
prefixed AS (
  SELECT *, bool_and(same) OVER (PARTITION BY pair ORDER BY turn, copy) AS common FROM places),
parts AS (
  SELECT pair, turn, copy, CASE WHEN common THEN 'prompt' ELSE 'chosen' END AS part, own_role AS role, own_text AS text
  FROM prefixed WHERE own_role IS NOT NULL
  UNION ALL
  SELECT pair, turn, copy, 'rejected', other_role, other_text FROM prefixed WHERE NOT common AND other_role IS NOT NULL)
SELECT pair AS conv_id, turn, copy, part, role, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS segment,
       CAST(part <> 'prompt' AND role = 'assistant' AS INTEGER) AS mask
FROM parts
""",
    "op13_hard_negatives": """
WITH whole AS (
  SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT a.id AS anchor_id, r.id, r.label = a.label AS same,
         CAST(list_sum([a.x[i] * r.x[i] FOR i IN range(1, len(a.x) + 1)]) AS BIGINT) AS score
  FROM whole a JOIN whole r ON r.id <> a.id WHERE a.id % 100 = 0),
positive AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
mined AS (
  SELECT p.anchor_id, p.positive_id, s.id AS negative_id, p.positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS place
  FROM positive p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
   AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM mined WHERE place <= 10
""",
}
