"""Prompt texts.

Two null rules coexist. Questions are plain concatenations, so a null name makes
the question null. Sentences and refined prompts are formatted, so a null prints
as ``nan``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The prompt texts, byte for byte.
QUESTION_HEAD = "Is the drug "
QUESTION_MIDDLE = " Resistant or Sensitive to cell line "
QUESTION_TAIL = "?\n"
QUERY_PREFIX = (
    "You are an expert scientist. I will give the query, and your task is to return a single word answer: "
    "Resistant or Sensitive.\n"
)
FEW_SHOT_PREFIX = (
    "You are an expert scientist. I will give you two examples, followed by the query and the context, "
    "and your task is to return a single word answer: Resistant or Sensitive.\n"
)
FEW_SHOT_EXAMPLES = (
    "Example 1:\nQuery: Is the drug Topotecan sensitive or resistant to 22Rv1 cell line?\nAnswer: Resistant\n"
    "Example 2:\nQuery: Is the drug jq1 sensitive or resistant to cell line KMS-11?\nAnswer: Sensitive\n"
)
ZERO_SHOT_PREFIX = (
    "You are an expert scientist, your task is to return a single word answer: Resistant or Sensitive.\n"
)
CELL_HEAD = "The cell line "
CELL_MIDDLE = ", which is taken from "
MISSING = "nan"


def question(drug: Column, cell_line: Column) -> Column:
    return F.concat(F.lit(QUESTION_HEAD), drug, F.lit(QUESTION_MIDDLE), cell_line, F.lit(QUESTION_TAIL))


def with_prefix(question_text: Column) -> Column:
    return F.concat(F.lit(QUERY_PREFIX), question_text)


def printed(value: Column) -> Column:
    """A value as a formatted text shows it: null prints as ``nan``."""
    return F.coalesce(value, F.lit(MISSING))


def cell_sentence(cell_line: Column, description: Column) -> Column:
    return F.concat(F.lit(CELL_HEAD), printed(cell_line), F.lit(CELL_MIDDLE), printed(description))


def drug_sentence(description: Column) -> Column:
    return F.concat(F.lit(" "), printed(description))


def joined_context(cell_text: Column, drug_text: Column) -> Column:
    return F.concat(cell_text, F.lit("."), drug_text)


def few_shot_prompt(question_text: Column, context: Column) -> Column:
    return F.concat(
        F.lit(FEW_SHOT_PREFIX + FEW_SHOT_EXAMPLES + "New Query: "),
        printed(question_text),
        F.lit("\nContext: "),
        printed(context),
        F.lit("\nAnswer:"),
    )


def zero_shot_prompt(question_text: Column, context: Column) -> Column:
    return F.concat(
        F.lit(ZERO_SHOT_PREFIX + "Query: "),
        printed(question_text),
        F.lit(" Context: "),
        printed(context),
        F.lit("\nAnswer:"),
    )
