"""From response rows to the prompt table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dosecast.functions import text
from dosecast.functions.hashing import random_token
from dosecast.sources.tables import PROMPT_SCHEMA

# The columns every derived text depends on.
BASE_COLUMNS = ("AUC", "label", "cell_line_name", "cancer_type", "Cellline_desc", "drug_name", "drug_desc")
ALIKE = ("drug_name", "drug_desc", "Cellline_desc", "cancer_type", "cell_line_name", "label", "AUC")  # those of longer texts first


def control_tokens(seed: int) -> dict[str, Column]:
    """The four random names of a run; each is one constant for the whole table."""
    slots = ("drug_0", "cell_0", "cell_1", "drug_2")
    return {slot: random_token(seed, slot) for slot in slots}


def add_questions(df: DataFrame, seed: int = 42) -> DataFrame:
    """The question and its three controls with a random drug and / or cell line."""
    names = control_tokens(seed)
    drug, cell = F.col("drug_name"), F.col("cell_line_name")
    return df.withColumns(
        {
            "question": text.question(drug, cell),
            "question_0": text.question(names["drug_0"], names["cell_0"]),
            "question_1": text.question(drug, names["cell_1"]),
            "question_2": text.question(names["drug_2"], cell),
        }
    )


def add_question_prompts(df: DataFrame) -> DataFrame:
    suffixes = ("", "_0", "_1", "_2")
    return df.withColumns({f"question_prompt{s}": text.with_prefix(F.col(f"question{s}")) for s in suffixes})


def add_sentences(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "cellline_description": text.cell_sentence(F.col("cell_line_name"), F.col("Cellline_desc")),
            "drug_final_description": text.drug_sentence(F.col("drug_desc")),
        }
    )


def tag_dataset(df: DataFrame, dataset: str = "DATASET") -> DataFrame:
    return df.withColumn("DATASET", F.lit(dataset))


def join_context(df: DataFrame) -> DataFrame:
    """Replace ``CONTEXT`` by the two sentences joined with a full stop."""
    return df.withColumn(
        "CONTEXT", text.joined_context(F.col("cellline_description"), F.col("drug_final_description"))
    )


def add_refined_prompts(df: DataFrame) -> DataFrame:
    question = F.col("question")
    return df.withColumns(
        {
            "refined_prompt_few_shot": text.few_shot_prompt(question, F.col("CONTEXT")),
            "refined_prompt_context": text.zero_shot_prompt(question, F.col("CONTEXT")),
            "refined_prompt_drug": text.zero_shot_prompt(question, F.col("drug_final_description")),
            "refined_prompt_cell": text.zero_shot_prompt(question, F.col("cellline_description")),
        }
    )


def dedup_rows(df: DataFrame) -> DataFrame:
    """Drop exact duplicates of the input columns.

    All prompt texts are functions of these columns, so dropping duplicates before
    the texts are built gives the same rows as doing it after, and shuffles a
    fraction of the bytes. ``CONTEXT`` takes part when the input has it.
    """
    columns = [c for c in (*BASE_COLUMNS, "CONTEXT") if c in df.columns]
    return df.select(*columns).dropDuplicates()


def project_required(df: DataFrame) -> DataFrame:
    """The 16 columns of the processed table, in order."""
    return df.select(*PROMPT_SCHEMA.fieldNames()[:16])


def prompt_table(
    response: DataFrame, dataset: str = "DATASET", seed: int = 42, row_id: str | None = None, alike: bool = False
) -> DataFrame:
    """Response rows to the 21-column prompt table: one shuffle, for the duplicates.

    ``row_id`` names an extra key column, unique because duplicates are gone. With ``alike`` the rows of a task come ordered,
    still without their texts, so that like prompts are neighbours, which a compressed file keeps in less room.
    """
    rows = dedup_rows(response)
    if alike:
        rows = rows.sortWithinPartitions(*[c for c in (*ALIKE, "CONTEXT") if c in rows.columns])
    keys = [row_id] if row_id else []
    if row_id:
        rows = with_content_key(rows, row_id)
    rows = tag_dataset(add_sentences(add_question_prompts(add_questions(rows, seed))), dataset)
    return add_refined_prompts(join_context(rows)).select(*keys, *PROMPT_SCHEMA.fieldNames())


def with_content_key(df: DataFrame, name: str) -> DataFrame:
    """A key made of the whole row's content, so it needs no ordering and no shuffle."""
    return df.withColumn(name, F.md5(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})))


def random_names(df: DataFrame, key: str, seed: int = 42, length: int = 5) -> DataFrame:
    """A random name for every row instead of one for the table."""
    return df.withColumn("token", random_token(seed, F.col(key), length=length))


def union_sources(first: DataFrame, second: DataFrame, names: tuple[str, str]) -> DataFrame:
    """Stack two tables by column name; a column one of them lacks becomes null."""
    return first.withColumn("dataset", F.lit(names[0])).unionByName(
        second.withColumn("dataset", F.lit(names[1])), allowMissingColumns=True
    )


