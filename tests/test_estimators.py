"""The models as stages of a Spark ML pipeline: fitted, applied, saved and loaded."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel

from dosecast.operators.linear import fit_linear, predict_linear
from dosecast.plans.estimators import ResponseRegressor
from dosecast.session import materialize, scratch_path

SETTINGS = {"rounds": 3, "maxEpochs": 3}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(31)
    x = rng.normal(size=(120, 4))
    y = x @ np.array([0.5, -0.2, 0.1, 0.0]) + rng.normal(0, 0.05, 120)
    split = np.where(np.arange(120) % 5 < 3, "train", np.where(np.arange(120) % 5 == 3, "val", "test"))
    table = [(i, x[i].tolist(), float(y[i]), str(split[i]), "ab"[i % 2], i) for i in range(120)]
    table += [(200, None, 1.0, "test", "a", 0), (202, [1.0, 2.0], None, "test", "b", 0), (203, [0.0] * 4, None, "test", "unseen", 0)]
    return materialize(spark.createDataFrame(table, "row_id long, features array<double>, y double, split string, kind string, extra long"), "estimator_rows")


def predicted(df):
    return {r["row_id"]: (r["extra"], None if r["p"] is None else round(r["p"], 9)) for r in df.collect()}


@pytest.mark.parametrize("name", ["linear", "xgboost", "mlp", "custom"])
def test_all_models_fit_save_and_load_in_a_pipeline(spark, rows, name):
    stage = ResponseRegressor(modelName=name, groupCol="kind", **SETTINGS)
    pipeline_path, model_path = scratch_path(spark, "unfitted"), scratch_path(spark, "fitted")
    Pipeline(stages=[stage]).save(pipeline_path)
    again = Pipeline.load(pipeline_path)
    assert again.getStages()[0].value("groupCol") == "kind" and again.getStages()[0].value("rounds") == 3
    model = again.fit(rows)
    model.save(model_path)
    scored = model.transform(rows)
    assert scored.columns == [*rows.columns, "p"]
    got = predicted(scored)
    assert got == predicted(PipelineModel.load(model_path).transform(rows))
    assert len(got) == 123 and all((got[i][1] is None) == (i >= 200) for i in got) and all(got[i][0] == i for i in range(120))


def test_linear_is_the_operator(rows):
    model = ResponseRegressor(groupCol="", predictionCol="p").fit(rows.filter("row_id < 200"))
    plain = predict_linear(fit_linear(rows.filter("row_id < 200 AND split = 'train'")), rows.filter("row_id < 200"))
    assert predicted(model.transform(rows.filter("row_id < 200"))) == predicted(plain)


def test_an_unknown_model_is_refused(rows):
    with pytest.raises(ValueError, match="Unknown model"):
        ResponseRegressor(modelName="forest").fit(rows)
