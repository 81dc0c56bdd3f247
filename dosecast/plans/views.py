"""The pipeline's input tables, derived from the driver's Parquet tables.

``SPARK_VIEWS`` and ``DUCKDB_VIEWS`` hold the same views for the two engines; they
differ only in how a list element is addressed.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

# The cancer types that are modelled one by one.
CANCER_TYPES = (
    "Lung Cancer",
    "Breast Cancer",
    "Skin Cancer",
    "Neuroblastoma",
    "Leukemia",
    "Acute Myeloid Leukemia",
    "Brain Cancer",
    "Pancreatic Adenocarcinoma",
    "Ovarian Cancer",
    "Colon/Colorectal Cancer",
)

_TYPE_CASE = "CASE vec_id % 10 " + " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(CANCER_TYPES)) + " END"

_VIEWS = {
    "v_response": """
        SELECT p_name AS drug_name, s_name AS cell_line_name, l_discount AS AUC,
               CASE WHEN l_discount < 0.05 THEN 'Sensitive' ELSE 'Resistant' END AS label,
               n_name AS cancer_type, r_name || ' tissue' AS Cellline_desc, p_type AS drug_desc
        FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
             JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey""",
    "v_response_nulls": """
        SELECT nullif(drug_name, 'blue bolt') AS drug_name, cell_line_name, AUC, label, cancer_type, Cellline_desc,
               nullif(drug_desc, 'SMALL') AS drug_desc
        FROM v_response""",
    "v_features": f"""
        SELECT vec_id, embedding, CAST(e.label AS DOUBLE) / 10 AS AUC,
               CASE WHEN e.label >= 5 THEN 'Resistant' ELSE 'Sensitive' END AS label,
               {_TYPE_CASE} AS cancer_type
        FROM embeddings e""",
    "v_pairs": """
        SELECT l_returnflag AS grp, l_quantity AS y, l_extendedprice / 2000 AS p FROM lineitem""",
    "v_pairs_keyed": """
        SELECT vec_id, cancer_type, AUC AS y, CAST({first} AS DOUBLE) AS p FROM v_features""",
    "v_docs": """
        SELECT doc_id, text, lang, source FROM documents""",
    "v_docs_labeled": """
        SELECT d.doc_id, text, lang, quality, toxic FROM documents d JOIN labels l ON l.doc_id = d.doc_id""",
    "v_epochs": """
        SELECT event_id, CAST(floor(event_id / 10000.0) AS BIGINT) AS run,
               CAST(floor((event_id % 10000) / 100.0) AS INT) AS epoch,
               CAST(floor((event_id % 100) / 10.0) AS INT) AS batch, value AS loss
        FROM events""",
    "v_trials": """
        SELECT vec_id AS trial_number, CAST({first} AS DOUBLE) AS val_spearman FROM embeddings
        UNION ALL SELECT -1, CAST('NaN' AS DOUBLE)""",
}

SPARK_VIEWS = {name: sql.replace("{first}", "element_at(embedding, 1)") for name, sql in _VIEWS.items()}
DUCKDB_VIEWS = {name: sql.replace("{first}", "embedding[1]") for name, sql in _VIEWS.items()}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view over the tables in ``sf_dir``."""
    for source in _sources(name):
        if source in TABLES:
            table(spark, sf_dir, source).createOrReplaceTempView(source)
        else:
            spark.sql(SPARK_VIEWS[source]).createOrReplaceTempView(source)
    return spark.sql(SPARK_VIEWS[name])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def duckdb_with(*names: str) -> str:
    """``WITH`` clause that defines the views, and the views they build on, in DuckDB."""
    wanted = dict.fromkeys(v for name in names for v in [*_sources(name), name] if v not in TABLES)
    return "WITH " + ", ".join(f"{v} AS ({DUCKDB_VIEWS[v]})" for v in wanted) + "\n"


def _sources(name: str) -> list[str]:
    """Tables and views that a view reads, each after the ones it builds on."""
    found: dict[str, None] = {}
    for source in re.findall(r"(?:FROM|JOIN) (\w+)", _VIEWS[name]):
        if source in _VIEWS:
            found.update(dict.fromkeys(_sources(source)))
        found[source] = None
    return list(found)
