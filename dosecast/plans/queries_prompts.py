"""Registered queries: prompts, projections, duplicates, unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from dosecast.functions import text
from dosecast.operators import features, prompts
from dosecast.operators.prompts import BASE_COLUMNS
from dosecast.plans import sql as q
from dosecast.plans.catalog import query
from dosecast.plans.views import CANCER_TYPES, load
from dosecast.functions.vectors import wide_columns
from dosecast.sources.tables import PROMPT_SCHEMA

SEED = 42
VECTOR_WIDTH = 64
NAMES = "drug_name, cell_line_name"


def _token(slot: str) -> str:
    return q.token(f"'{SEED}'", f"'{slot}'")


def _question(drug: str, cell: str) -> str:
    head, middle, tail = (q.quoted(t) for t in (text.QUESTION_HEAD, text.QUESTION_MIDDLE, text.QUESTION_TAIL))
    return f"({head} || {drug} || {middle} || {cell} || {tail})"


QUESTIONS = {
    "question": _question("drug_name", "cell_line_name"),
    "question_0": _question(_token("drug_0"), _token("cell_0")),
    "question_1": _question("drug_name", _token("cell_1")),
    "question_2": _question(_token("drug_2"), "cell_line_name"),
}
PREFIX = q.quoted(text.QUERY_PREFIX)
PROMPTS = {c.replace("question", "question_prompt"): f"({PREFIX} || {e})" for c, e in QUESTIONS.items()}
CELL = (
    f"({q.quoted(text.CELL_HEAD)} || coalesce(cell_line_name, 'nan') || {q.quoted(text.CELL_MIDDLE)} "
    "|| coalesce(Cellline_desc, 'nan'))"
)
DRUG = "(' ' || coalesce(drug_desc, 'nan'))"
CONTEXT = f"({CELL} || '.' || {DRUG})"


def _zero_shot(context: str) -> str:
    head = q.quoted(text.ZERO_SHOT_PREFIX + "Query: ")
    tail = q.quoted("\nAnswer:")
    return f"({head} || coalesce({QUESTIONS['question']}, 'nan') || ' Context: ' || {context} || {tail})"


FEW_SHOT = (
    f"({q.quoted(text.FEW_SHOT_PREFIX + text.FEW_SHOT_EXAMPLES + 'New Query: ')} "
    f"|| coalesce({QUESTIONS['question']}, 'nan') || {q.quoted(chr(10) + 'Context: ')} || {CONTEXT} "
    f"|| {q.quoted(chr(10) + 'Answer:')})"
)
REFINED = {
    "refined_prompt_few_shot": FEW_SHOT,
    "refined_prompt_context": _zero_shot(CONTEXT),
    "refined_prompt_drug": _zero_shot(DRUG),
    "refined_prompt_cell": _zero_shot(CELL),
}
PROMPT_TABLE = {
    "cellline_description": CELL,
    "drug_final_description": DRUG,
    **QUESTIONS,
    **PROMPTS,
    **{c: c for c in ("AUC", "label", "cell_line_name", "cancer_type", "drug_name")},
    "DATASET": "'DATASET'",
    "CONTEXT": CONTEXT,
    **REFINED,
}
assert list(PROMPT_TABLE) == PROMPT_SCHEMA.fieldNames()


def _select(columns: dict[str, str], view: str = "v_response_nulls", distinct: bool = False) -> str:
    picked = ", ".join(f"{e} AS {c}" for c, e in columns.items())
    rows = f"(SELECT DISTINCT * FROM {view})" if distinct else view
    return f"{q.WITH(view)} SELECT {picked} FROM {rows}"


def _names() -> dict[str, str]:
    return {c: c for c in ("drug_name", "cell_line_name")}


def _question_query(name: str):
    @query(f"prompt_{name}", _select({**_names(), name: QUESTIONS[name]}))
    def run(spark, sf):
        return prompts.add_questions(load(spark, sf, "v_response_nulls"), SEED).select(
            "drug_name", "cell_line_name", name
        )


for _name in QUESTIONS:
    _question_query(_name)


@query("random_token", f"SELECT doc_id, {q.token(str(SEED), 'doc_id')} AS token FROM documents")
def random_token(spark, sf):
    return prompts.random_names(load(spark, sf, "v_docs"), "doc_id", SEED).select("doc_id", "token")


@query("prompt_prefixed", _select({**_names(), **PROMPTS}))
def prompt_prefixed(spark, sf):
    rows = prompts.add_question_prompts(prompts.add_questions(load(spark, sf, "v_response_nulls"), SEED))
    return rows.select("drug_name", "cell_line_name", *PROMPTS)


@query("cell_sentence", _select({"cell_line_name": "cell_line_name", "cellline_description": CELL}))
def cell_sentence(spark, sf):
    return prompts.add_sentences(load(spark, sf, "v_response_nulls")).select("cell_line_name", "cellline_description")


@query("drug_sentence", _select({"drug_name": "drug_name", "drug_final_description": DRUG}))
def drug_sentence(spark, sf):
    return prompts.add_sentences(load(spark, sf, "v_response_nulls")).select("drug_name", "drug_final_description")


@query("dataset_tag", _select({**_names(), "DATASET": "'first study'"}))
def dataset_tag(spark, sf):
    return prompts.tag_dataset(load(spark, sf, "v_response_nulls"), "first study").select(
        "drug_name", "cell_line_name", "DATASET"
    )


@query("context_join", _select({**_names(), "CONTEXT": CONTEXT}))
def context_join(spark, sf):
    rows = prompts.join_context(prompts.add_sentences(load(spark, sf, "v_response_nulls")))
    return rows.select("drug_name", "cell_line_name", "CONTEXT")


def _refined_query(query_id: str, column: str):
    @query(query_id, _select({**_names(), column: REFINED[column]}))
    def run(spark, sf):
        rows = prompts.add_sentences(prompts.add_questions(load(spark, sf, "v_response_nulls"), SEED))
        rows = prompts.add_refined_prompts(prompts.join_context(rows))
        return rows.select("drug_name", "cell_line_name", column)


for _column in REFINED:
    _refined_query(_column.replace("refined_", ""), _column)


@query("project_required", _select({c: PROMPT_TABLE[c] for c in list(PROMPT_TABLE)[:16]}, distinct=True))
def project_required(spark, sf):
    rows = prompts.dedup_rows(load(spark, sf, "v_response_nulls"))
    rows = prompts.add_sentences(prompts.add_question_prompts(prompts.add_questions(rows, SEED)))
    return prompts.project_required(prompts.tag_dataset(rows))


@query(
    "dedup_rows",
    f"""{q.WITH('v_response')}
    SELECT {', '.join(BASE_COLUMNS)}, question
    FROM (SELECT DISTINCT {', '.join(BASE_COLUMNS)},
                 {', '.join(f'{e} AS {c}' for c, e in {**QUESTIONS, **PROMPTS}.items())},
                 {CELL} AS cellline_description, {DRUG} AS drug_final_description, 'DATASET' AS DATASET
          FROM v_response)""",
)
def dedup_rows(spark, sf):
    rows = prompts.add_questions(prompts.dedup_rows(load(spark, sf, "v_response")), SEED)
    return rows.select(*BASE_COLUMNS, "question")


_UNION = ("drug_name", "cell_line_name", "AUC", "cancer_type", "Cellline_desc")


@query(
    "union_sources",
    f"""{q.WITH('v_response', 'v_response_nulls')}
    SELECT {', '.join(_UNION)}, label, NULL AS drug_desc, 'first' AS dataset FROM v_response
    UNION ALL
    SELECT {', '.join(_UNION)}, NULL, drug_desc, 'second' FROM v_response_nulls""",
)
def union_sources(spark, sf):
    first = load(spark, sf, "v_response").drop("drug_desc")
    second = load(spark, sf, "v_response_nulls").drop("label")
    return prompts.union_sources(first, second, ("first", "second"))


_WIDE_SQL = ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS feature_{i + 1}" for i in range(VECTOR_WIDTH))


@query("project_variant", f"{q.WITH('v_features')} SELECT AUC, label, cancer_type, {_WIDE_SQL} FROM v_features")
def project_variant(spark, sf):
    embedded = load(spark, sf, "v_features").withColumnRenamed("embedding", "emb_question_prompt")
    rows = features.project_variant(embedded, "question_prompt")
    return rows.select("AUC", "label", "cancer_type", *wide_columns("emb_question_prompt", VECTOR_WIDTH))


@query(
    "project_features_target",
    f"""{q.WITH('v_features')}
    SELECT AUC AS y, i - 1 AS position, CAST(embedding[i] AS DOUBLE) AS value
    FROM v_features CROSS JOIN (SELECT CAST(unnest(range(1, {VECTOR_WIDTH + 1})) AS INT) AS i)""",
)
def project_features_target(spark, sf):
    wide = load(spark, sf, "v_features").select(
        *wide_columns("embedding", VECTOR_WIDTH), "AUC", "label", "cancer_type"
    )
    rows = features.features_target(wide, "AUC")
    return rows.select("y", F.posexplode("features").alias("position", "value"))


_THREE = CANCER_TYPES[:3]


@query(
    "filter_cancer_type",
    f"""{q.WITH('v_features')} SELECT vec_id, cancer_type, AUC FROM v_features
    WHERE cancer_type IN ({', '.join(q.quoted(t) for t in _THREE)})""",
)
def filter_cancer_type(spark, sf):
    return features.filter_groups(load(spark, sf, "v_features"), _THREE).select("vec_id", "cancer_type", "AUC")


@query(
    "attach_targets",
    f"{q.WITH('v_features')} SELECT vec_id, AUC, label, cancer_type, {_WIDE_SQL} FROM v_features",
)
def attach_targets(spark, sf):
    rows = load(spark, sf, "v_features")
    joined = features.attach_targets(rows.select("vec_id", "embedding"), rows.drop("embedding"), "vec_id")
    return joined.select("vec_id", "AUC", "label", "cancer_type", *wide_columns("embedding", VECTOR_WIDTH))
