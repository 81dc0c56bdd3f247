"""Feature tables: vector, target, label and cancer type per prompt variant."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosecast.functions.vectors import json_to_vector

# Prompt column -> variant name of its feature table.
VARIANTS = {
    "question_prompt": "question",
    "question_prompt_0": "question0",
    "question_prompt_1": "question1",
    "question_prompt_2": "question2",
    "refined_prompt_few_shot": "few_shot",
    "refined_prompt_context": "context",
    "refined_prompt_cell": "cellline_context",
    "refined_prompt_drug": "drug_context",
}

CARRIED = ("AUC", "label", "cancer_type")


def project_variant(embedded: DataFrame, column: str, carried: Sequence[str] = CARRIED) -> DataFrame:
    """(AUC, label, cancer_type, emb_x) of one prompt column of a wide embedded table."""
    return embedded.select(*carried, f"emb_{column}")


def feature_variants(
    embedded: DataFrame,
    dataset: str,
    keys: Sequence[str] = (),
    carried: Sequence[str] = CARRIED,
    variants: dict[str, str] = VARIANTS,
) -> DataFrame:
    """All variants of a wide embedded table as one long table, from one pass over it."""
    found = {c: v for c, v in variants.items() if f"emb_{c}" in embedded.columns}
    items = [F.struct(F.lit(v).alias("variant"), F.col(f"emb_{c}").alias("features")) for c, v in found.items()]
    return embedded.select(F.lit(dataset).alias("dataset"), *keys, *carried, F.inline(F.array(*items)))


def attach_targets(vectors: DataFrame, rows: DataFrame, key: str, carried: Sequence[str] = CARRIED) -> DataFrame:
    """Join targets to vectors that arrived as a separate table; ``key`` is unique on both sides."""
    return vectors.join(rows.select(key, *carried), key)


def parse_vectors(df: DataFrame, text: str, output: str = "features") -> DataFrame:
    """Parse JSON vectors; ``bad_vector`` marks rows for the quarantine."""
    return df.withColumn(output, json_to_vector(F.col(text))).withColumn("bad_vector", F.col(output).isNull())


def quarantine(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows); nothing is dropped silently."""
    return parsed.filter(~F.col("bad_vector")).drop("bad_vector"), parsed.filter("bad_vector")


def features_target(df: DataFrame, target: str = "AUC", dropped: Sequence[str] = ("label", "cancer_type")) -> DataFrame:
    """Wide table -> (features array, y): every column but target and ``dropped`` is a feature."""
    names = [c for c in df.columns if c != target and c not in dropped]
    return df.select(F.array(*[F.col(c).cast("double") for c in names]).alias("features"), F.col(target).alias("y"))


def content_keys(df: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows that came without a key get one: the digest of their cells, and which of its equals a row is.

    Equal rows are counted before they are numbered, so a row repeated without end is one row in the shuffle.
    """
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_times"))
    copies = counted.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))))
    digest = F.md5(F.to_json(F.struct(*df.columns)).cast("binary"))
    return copies.select(F.concat_ws(":", digest, "_copy").alias(key), *df.columns)


def filter_groups(df: DataFrame, groups: Sequence[str], column: str = "cancer_type") -> DataFrame:
    """Rows of the listed groups, in one scan for all of them."""
    return df.filter(F.col(column).isin(*groups))
