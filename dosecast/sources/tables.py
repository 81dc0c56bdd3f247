"""Tables as text (TSV / CSV) and as Parquet.

Prompts contain line breaks, so text cells are quoted and may span lines; such files
are read in byte ranges side by side (``sources.records``). Between the steps of a
large run Parquet is still the better choice.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dosecast.functions.vectors import json_to_vector, vector_to_json, wide_columns
from dosecast.operators.features import content_keys
from dosecast.session import setting
from dosecast.sources.records import read_records

# Cell texts that count as missing.
MISSING_TEXTS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

OPEN_FILES = 16  # that a task writes side by side
PACKED_ROWS = 100_000  # rows of a compressed file, which one task reads

_TEXT_OPTIONS = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}

RESPONSE_SCHEMA = T.StructType(
    [
        T.StructField("AUC", T.DoubleType()),
        *[
            T.StructField(name, T.StringType())
            for name in ("label", "cell_line_name", "cancer_type", "Cellline_desc", "drug_name", "drug_desc", "CONTEXT")
        ],
    ]
)

PROMPT_COLUMNS = (
    "question_prompt",
    "question_prompt_0",
    "question_prompt_1",
    "question_prompt_2",
    "refined_prompt_cell",
    "refined_prompt_context",
    "refined_prompt_drug",
    "refined_prompt_few_shot",
)

PROMPT_SCHEMA = T.StructType(
    [
        T.StructField(name, T.DoubleType() if name == "AUC" else T.StringType())
        for name in (
            "cellline_description",
            "drug_final_description",
            "question",
            "question_0",
            "question_1",
            "question_2",
            "question_prompt",
            "question_prompt_0",
            "question_prompt_1",
            "question_prompt_2",
            "AUC",
            "label",
            "cell_line_name",
            "cancer_type",
            "drug_name",
            "DATASET",
            "CONTEXT",
            "refined_prompt_few_shot",
            "refined_prompt_context",
            "refined_prompt_drug",
            "refined_prompt_cell",
        )
    ]
)


def read_text_table(spark: SparkSession, path, schema: T.StructType, sep: str = "\t", multi_line: bool = True) -> DataFrame:
    """Read text files with a header by a declared schema.

    ``path`` may be a file, a folder, a glob or a list; all files have the same header. Columns are found by
    the header's names; cells that spell a missing value become null; a cell that does
    not fit its declared type fails the read. Files are split between tasks, whether their
    cells hold line breaks (``multi_line``) or not; packed ones cannot be split, and Spark parses each in a task.
    """
    header = spark.read.options(**_TEXT_OPTIONS, sep=sep, multiLine=multi_line, enforceSchema=False).csv(path)
    if multi_line and not all(f.endswith(".gz") for f in header.inputFiles()):
        known = set(header.columns)
        header = read_records(spark, path, header.columns, [f.name for f in schema if f.name in known], sep)
    cells = {name: F.col(f"`{name}`") for name in header.columns}
    missing = [f.name for f in schema if f.name not in cells]
    if missing:
        raise ValueError(f"columns {missing} not found in {path}")
    return header.select(
        *[
            F.when(~cells[f.name].isin(*MISSING_TEXTS), cells[f.name]).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )


def write_text_table(df: DataFrame, path: str, sep: str = "\t", by: str | None = None, packed: bool = False) -> None:
    """Write a header and rows, no index. Empty strings and nulls are both empty cells.

    With ``by`` the rows of each value of that column go to a folder of their own, in the same job. ``packed`` files are
    compressed with gzip; they are read whole, so each has at most ``PACKED_ROWS`` rows.
    """
    out = df.write.options(**_TEXT_OPTIONS, sep=sep, emptyValue="")
    if packed:
        out = out.options(compression="gzip", maxRecordsPerFile=PACKED_ROWS).option("zlib.compress.level", "BEST_COMPRESSION")
    (out.partitionBy(by) if by else out).csv(path)


def read_response(spark: SparkSession, path, with_context: bool = False) -> DataFrame:
    """The response table; ``CONTEXT`` is read only when asked for, it is never needed."""
    fields = [f for f in RESPONSE_SCHEMA if with_context or f.name != "CONTEXT"]
    return read_text_table(spark, path, T.StructType(fields))


def write_prompts(prompts: DataFrame, path: str) -> None:
    """The prompt table as packed text: its prompts repeat one instruction and the same few sentences row after row."""
    write_text_table(prompts, path, packed=True)


def read_prompts(spark: SparkSession, path) -> DataFrame:
    return read_text_table(spark, path, PROMPT_SCHEMA)


def write_embedded(df: DataFrame, path: str, vectors: list[str], by: str | None = None) -> None:
    """Embedded table as text: each ``emb_*`` vector as a JSON cell, empty when it failed."""
    df_text = df.select(*[vector_to_json(F.col(c)).alias(c) if c in vectors else F.col(c) for c in df.columns])
    write_text_table(df_text, path, by=by)


def read_embedded(spark: SparkSession, path, schema: T.StructType, vectors: list[str]) -> DataFrame:
    """One embedded table, or every ``processed_chunk_*.tsv`` of a glob, with parsed vectors."""
    text = T.StructType([*schema.fields, *[T.StructField(v, T.StringType()) for v in vectors]])
    df = read_text_table(spark, path, text)
    return df.select(*[json_to_vector(F.col(c)).alias(c) if c in vectors else F.col(c) for c in df.columns])


def features_schema(width: int, target: str = "AUC") -> T.StructType:
    return T.StructType(
        [
            *[T.StructField(f"feature_{i + 1}", T.DoubleType()) for i in range(width)],
            T.StructField(target, T.DoubleType()),
            T.StructField("label", T.StringType()),
            T.StructField("cancer_type", T.StringType()),
        ]
    )


def write_features_csv(df: DataFrame, path: str, width: int, vector: str = "features", target: str = "AUC") -> None:
    """The wide comma-separated form: ``feature_1..feature_N``, target, label, cancer type."""
    wide = df.select(*wide_columns(vector, width), target, "label", "cancer_type")
    write_text_table(wide, path, sep=",")


def read_features_csv(spark: SparkSession, path, width: int | None = None, target: str = "AUC") -> DataFrame:
    """The wide form, split between tasks; without ``width`` the header tells how many features there are."""
    if width is None:
        header = spark.read.options(**_TEXT_OPTIONS, sep=",").csv(path).columns
        width = sum(name.startswith("feature_") for name in header)
    return read_text_table(spark, path, features_schema(width, target), sep=",", multi_line=False)


def read_features_keyed(spark: SparkSession, path, target: str = "AUC") -> DataFrame:
    """A feature CSV as models take it: (row_id, features, target, label, cancer_type)."""
    wide = read_features_csv(spark, path, target=target)
    kept = [target, "label", "cancer_type"]
    cells = F.array(*[F.col(c) for c in wide.columns if c not in kept])
    return content_keys(wide.select(cells.alias("features"), *kept))


def write_features_variants(long: DataFrame, path: str) -> None:
    """All variants of all datasets in one job, one folder per (dataset, variant).

    Rows of one variant stay spread over the writing tasks; nothing is gathered. A task keeps a file open for each of a
    few variants; only rows of more are sorted first.
    """
    with setting(long.sparkSession, "spark.sql.maxConcurrentOutputFileWriters", str(OPEN_FILES)):
        long.write.partitionBy("dataset", "variant").parquet(path)


def read_features_variant(
    spark: SparkSession, path: str, schema: T.StructType, variant: str, dataset: str
) -> DataFrame:
    """One variant; the folder filter prunes all other files."""
    df = spark.read.schema(schema).parquet(path)
    return df.filter((F.col("variant") == variant) & (F.col("dataset") == dataset)).drop("variant", "dataset")


def write_results(results: DataFrame, path: str) -> None:
    write_text_table(results, path, sep=",")


def write_trials(trials: DataFrame, path: str) -> None:
    """Trials as CSV; the list of layer widths becomes JSON text."""
    write_text_table(trials.withColumn("hidden_dims", F.to_json("hidden_dims")), path, sep=",")


def write_best_params(best: DataFrame, path: str) -> None:
    """The best trial's parameters as one JSON object: batch_size, learning_rate, n_layers, n_units_l0 and so on."""
    pair = lambda name, value: F.concat(F.lit('"'), name, F.lit('": '), value.cast("string"))
    numbers = [pair(F.lit(n), v) for n, v in (("batch_size", F.col("batch_size")), ("learning_rate", F.col("learning_rate")), ("n_layers", F.size("hidden_dims")))]
    units = F.transform("hidden_dims", lambda n, i: pair(F.concat(F.lit("n_units_l"), i.cast("string")), n))
    best.select(F.concat(F.lit("{"), F.array_join(F.concat(F.array(*numbers), units), ", "), F.lit("}")).alias("value")).write.text(path)


def read_best_params(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])
