from pyspark.sql import functions as F

from dosecast.operators import prompts
from dosecast.sources.tables import PROMPT_SCHEMA

COLUMNS = "AUC double, label string, cell_line_name string, cancer_type string, Cellline_desc string, drug_name string, drug_desc string"
ROW = (0.5, "Resistant", "A549", "Lung Cancer", "lung tissue", "aspirin", "a pain killer")


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), COLUMNS)


def test_texts_byte_for_byte(spark):
    row = prompts.prompt_table(frame(spark, ROW)).first()
    question = "Is the drug aspirin Resistant or Sensitive to cell line A549?\n"
    cell = "The cell line A549, which is taken from lung tissue"
    assert row["question"] == question
    assert row["question_prompt"] == (
        "You are an expert scientist. I will give the query, and your task is to return a single word answer: "
        "Resistant or Sensitive.\n" + question
    )
    assert row["cellline_description"] == cell
    assert row["drug_final_description"] == " a pain killer"
    assert row["CONTEXT"] == cell + ". a pain killer"
    zero_shot = (
        "You are an expert scientist, your task is to return a single word answer: Resistant or Sensitive.\n"
        "Query: " + question + " Context: {}\nAnswer:"
    )
    assert row["refined_prompt_context"] == zero_shot.format(cell + ". a pain killer")
    assert row["refined_prompt_drug"] == zero_shot.format(" a pain killer")
    assert row["refined_prompt_cell"] == zero_shot.format(cell)
    assert row["refined_prompt_few_shot"] == (
        "You are an expert scientist. I will give you two examples, followed by the query and the context, and your "
        "task is to return a single word answer: Resistant or Sensitive.\n"
        "Example 1:\nQuery: Is the drug Topotecan sensitive or resistant to 22Rv1 cell line?\nAnswer: Resistant\n"
        "Example 2:\nQuery: Is the drug jq1 sensitive or resistant to cell line KMS-11?\nAnswer: Sensitive\n"
        "New Query: " + question + "\nContext: " + cell + ". a pain killer\nAnswer:"
    )


def test_null_rules(spark):
    row = prompts.prompt_table(frame(spark, (0.5, None, None, None, None, None, None))).first()
    assert row["question"] is None and row["question_prompt"] is None
    assert row["question_1"] is None and row["question_2"] is None
    assert row["question_0"] is not None
    assert row["cellline_description"] == "The cell line nan, which is taken from nan"
    assert row["drug_final_description"] == " nan"
    assert "Query: nan Context: " in row["refined_prompt_drug"]


def test_controls_use_one_name_per_table(spark):
    other = (0.1, "Sensitive", "K562", "Leukemia", "blood", "taxol", "bark")
    table = prompts.prompt_table(frame(spark, ROW, other), seed=7)
    assert table.select("question_0").distinct().count() == 1
    assert table.select("question_1").distinct().count() == 2
    again = prompts.prompt_table(frame(spark, ROW, other), seed=7)
    assert table.exceptAll(again).isEmpty()
    changed = prompts.prompt_table(frame(spark, ROW, other), seed=8)
    assert table.select("question_0").first() != changed.select("question_0").first()


def test_columns_and_keys(spark):
    table = prompts.prompt_table(frame(spark, ROW, ROW, (0.6, *ROW[1:])), row_id="row_id")
    assert table.columns == ["row_id", *PROMPT_SCHEMA.fieldNames()]
    assert table.count() == 2 and table.select("row_id").distinct().count() == 2
    processed = prompts.project_required(prompts.tag_dataset(prompts.add_sentences(
        prompts.add_question_prompts(prompts.add_questions(frame(spark, ROW))))))
    assert processed.columns == PROMPT_SCHEMA.fieldNames()[:16]


def test_duplicates_are_judged_before_the_projection(spark):
    rows = frame(spark, ROW, ROW).withColumn("CONTEXT", F.lit("a"))
    other = frame(spark, ROW).withColumn("CONTEXT", F.lit("b"))
    table = prompts.prompt_table(rows.unionByName(other))
    assert table.count() == 2
    assert table.distinct().count() == 1


def test_union_sources_fills_missing_columns(spark):
    first, second = frame(spark, ROW), frame(spark, ROW).drop("label").withColumn("extra", F.lit(1))
    rows = prompts.union_sources(first, second, ("one", "two")).orderBy("dataset").collect()
    assert [r["dataset"] for r in rows] == ["one", "two"]
    assert rows[0]["extra"] is None and rows[1]["label"] is None


def test_random_names_depend_on_the_row_only(spark):
    rows = spark.range(200)
    names = {r["id"]: r["token"] for r in prompts.random_names(rows, "id", 3).collect()}
    again = {r["id"]: r["token"] for r in prompts.random_names(rows.repartition(7), "id", 3).collect()}
    assert names == again and len(set(names.values())) == 200
    assert all(len(n) == 5 and n.isalnum() for n in names.values())
