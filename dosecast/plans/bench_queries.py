"""Extra benchmark queries that have no counterpart among the registered ones."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from dosecast.operators.embed import TokenHashEncoder, embed_columns
from dosecast.operators.prompts import prompt_table
from dosecast.plans.views import load
from dosecast.session import materialize

CONTROLS = ("question_prompt_0", "question_prompt_1", "question_prompt_2")


def embed_controls(spark: SparkSession, sf_dir: str, distinct: bool) -> DataFrame:
    """Embed the three control prompts of every response row."""
    prompts = materialize(prompt_table(load(spark, sf_dir, "v_response"), row_id="row_id"), "prompts")
    return embed_columns(prompts, "row_id", CONTROLS, TokenHashEncoder, batch_size=256, distinct=distinct)


EXTRA = {
    "embed_controls_every_row": partial(embed_controls, distinct=False),
    "embed_controls_distinct": partial(embed_controls, distinct=True),
}
