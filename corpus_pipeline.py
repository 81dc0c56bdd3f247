"""A corpus pipeline of five stages: toxicity, near-duplicates, personal data, mixing, encoding.

Each stage takes (spark, docs, sf_dir), works on every row that its predecessor kept, and returns a
DataFrame, which is written as Parquet and read again before the next one. All but the last return the
columns of ``documents``; the last returns one digest row for every encoded text.

Defined cases are those of the operators: null and empty texts pass the filters (they match nothing; the
near-duplicates among them become one row), empty tables pass through.

A stage's own intermediate tables are deleted when the next stage begins: its result is written by then. Write a
stage's result before you call another stage.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dosecast.llm import bpe, mixing, pii, simhash, toxicity
from dosecast.llm.catalog import MIX_WEIGHTS, RANKS
from dosecast.llm.common import documents, key_remainder, labels
from dosecast.session import drop_scratch, materialize, scratch_folders, ship_package

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

_spent: list[str] = []  # intermediate tables of the stage before


def stage(function: Stage) -> Stage:
    """Ship the package, and delete what the stage before has left, before a stage begins."""

    @wraps(function)
    def begin(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        drop_scratch(spark, _spent)
        before = set(scratch_folders())
        out = function(spark, docs, sf_dir)
        _spent[:] = [f for f in scratch_folders() if f not in before]
        return out

    return begin


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator scores under 0.5."""
    marked = labels(spark, sf_dir)
    model = toxicity.fit_toxicity(docs, marked, key_remainder(marked["doc_id"], toxicity.FOLDS) != 0)
    scored = toxicity.add_score(docs.withColumn("_scored", F.col("text")), model, "_scored", docs.columns)
    return scored.filter("score < 0.5").select(*docs.columns)


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class."""
    return simhash.first_of_classes(docs)


@stage
def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span replaced by its kind; the character count follows."""
    redacted = pii.redact_column(docs)
    return redacted.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its fitted rate says."""
    return mixing.mixed(docs, labels(spark, sf_dir), MIX_WEIGHTS, "quality")


@stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every text."""
    return bpe.encoding_digest(docs, RANKS, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("byte_level_bpe", encode),
]

#: Learnt scores, hashes and merges are beyond SQL; the tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, step in STAGES[:-1]:
        docs = materialize(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
