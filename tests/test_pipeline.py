"""The whole flow, file to file, on response rows of the smallest tables."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dosecast.operators.features import VARIANTS
from dosecast.operators.prompts import prompt_table
from dosecast.plans import modeling, queries_models, registry
from dosecast.plans.pipeline import feature_table
from dosecast.plans.views import load
from dosecast.session import materialize, scratch_path
from dosecast.sources import tables


def test_from_response_file_to_results_file(spark):
    folder = scratch_path(spark, "flow")
    tables.write_text_table(load(spark, "/root/testdata/sf0.001", "v_response"), f"{folder}/response.tsv")
    response = tables.read_response(spark, f"{folder}/response.tsv")
    prompts = prompt_table(response)

    long = feature_table(response, "study", batch_size=128, distinct=True)
    tables.write_features_variants(long, f"{folder}/features")
    stored = spark.read.parquet(f"{folder}/features")
    counts = {r["variant"]: r["count"] for r in stored.groupBy("variant").count().collect()}
    assert counts == dict.fromkeys(VARIANTS.values(), prompts.count())
    control = stored.filter("variant = 'question0'").select("features").distinct()
    assert control.count() == 1

    context = tables.read_features_variant(spark, f"{folder}/features", stored.schema, "context", "study")
    settings = modeling.Settings(n_bootstrap=20)
    results = modeling.run_models(context, "linear", settings=settings)
    tables.write_results(results, f"{folder}/results.csv")
    back = tables.read_text_table(spark, f"{folder}/results.csv", results.schema, sep=",").collect()
    assert len(back) == 1 and back[0]["model_label"] == "LinearRegression"
    assert back[0]["test_mse"] == pytest.approx(results.first()["test_mse"])


def test_results_do_not_depend_on_shuffle_partitions(spark):
    rows = load(spark, "/root/testdata/sf0.001", "v_features").withColumn("two", F.slice("embedding", 1, 2))
    columns = modeling.Columns(key="vec_id", features="two")
    found = []
    for partitions in ("2", "9"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        table = modeling.run_models(rows, "linear", columns=columns, settings=modeling.Settings(n_bootstrap=25))
        found.append(table.select("test_spearman", "test_ci_lower", "test_ci_upper", "validation_r2").first())
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0][:3] == found[1][:3] and found[0][3] == pytest.approx(found[1][3], abs=1e-12)


def test_the_query_from_response_to_results(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["variant"]: r for r in registry.QUERIES["response_to_results"](spark, sf).collect()}
    assert set(got) == set(VARIANTS.values())
    assert got["question0"]["test_spearman"] is None  # one prompt for all rows: every prediction is the same
    long = feature_table(load(spark, sf, "v_response"), "study", columns=["question_prompt"]).withColumn("all", F.lit("x"))
    columns = modeling.Columns(key="row_id", group="all")
    rows = materialize(modeling.split_table(long, columns, queries_models.SETTINGS, by_group=False), "split").toPandas()
    train, test = (rows[rows["split"] == s] for s in ("train", "test"))
    x = np.stack(train["features"].to_list()).astype(float)
    slopes = np.linalg.lstsq(x - x.mean(axis=0), train["y"] - train["y"].mean(), rcond=np.finfo(float).eps * len(train))[0]
    p = train["y"].mean() + (np.stack(test["features"].to_list()) - x.mean(axis=0)) @ slopes
    own = got["question"]
    assert own["test_mse"] == pytest.approx(((test["y"] - p) ** 2).mean(), abs=2e-6)
    assert own["test_spearman"] == pytest.approx(np.corrcoef(test["y"].rank(), pd.Series(p).round(12).rank())[0, 1], abs=1e-4)
    assert own["test_ci_lower"] < own["test_spearman"] < own["test_ci_upper"] and own["quarantined"] == 0
