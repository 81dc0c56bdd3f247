"""Registered queries: fits, predictions, model runs, search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosecast.operators import boosted as boosting
from dosecast.operators.boosted import fit_boosted, predict_boosted, splits
from dosecast.operators.features import VARIANTS
from dosecast.operators.linear import fit_linear, predict_linear
from dosecast.operators.neural import dnn_spec, fit_networks, mlp_spec, predict_networks
from dosecast.plans import modeling
from dosecast.plans import sql as q
from dosecast.plans.catalog import query
from dosecast.plans.pipeline import feature_table
from dosecast.plans.queries_scores import METRIC_NAMES, SEED, metric_columns_sql, metric_picks_sql, r6, rounded
from dosecast.plans.search import run_search
from dosecast.plans.views import CANCER_TYPES, load
from dosecast.session import materialize, scratch_path
from dosecast.sources import tables

COLUMNS = modeling.Columns(key="vec_id", features="embedding")
TWO = modeling.Columns(key="vec_id", features="two")
SETTINGS = modeling.Settings(seed=SEED)
WIDTH = 64

_FEATURES = """
    features AS (SELECT vec_id AS row_id, cancer_type, AUC AS y, CAST(embedding[1] AS DOUBLE) AS x1,
                        CAST(embedding[2] AS DOUBLE) AS x2 FROM v_features)"""


def _linear_sql(group: str | None) -> str:
    return f"""{q.WITH('v_features')}, {_FEATURES},
    split_rows AS ({q.split('features', 'row_id', 0.2, 0.2, SEED, group)}),
    train_rows AS (SELECT * FROM split_rows WHERE split = 'train'),
    unseen AS (SELECT * FROM split_rows WHERE split <> 'train'),
    scored AS ({q.linear_two('train_rows', 'unseen', group)})"""


_BY_GROUP = f"""{q.WITH('v_features').replace('WITH', 'WITH RECURSIVE', 1)},
    features AS (SELECT vec_id AS row_id, cancer_type, AUC AS y, embedding AS x FROM v_features),
    split_rows AS ({q.split('features', 'row_id', 0.2, 0.2, SEED, 'cancer_type')}),
    train_rows AS (SELECT * FROM split_rows WHERE split = 'train'),
    unseen AS (SELECT * FROM split_rows WHERE split <> 'train'),
    {q.linear_groups('train_rows', 'unseen', WIDTH, 'cancer_type')}"""


def features(spark, sf) -> DataFrame:
    """The feature table with a second vector column of the first two features only."""
    return load(spark, sf, "v_features").withColumn("two", F.slice("embedding", 1, 2))


def split_rows(spark, sf, columns=COLUMNS) -> DataFrame:
    return materialize(modeling.split_table(features(spark, sf), columns, SETTINGS, by_group=False), "split")


def _predictions(scored: DataFrame) -> DataFrame:
    return rounded(scored.select("row_id", "split", "y", "p"), "p")


def _linear_predictions(rows: DataFrame) -> DataFrame:
    return _predictions(predict_linear(fit_linear(rows.filter("split = 'train'")), rows.filter("split <> 'train'")))


_ALL_FEATURES = f"""
    features AS (SELECT vec_id AS row_id, AUC AS y, embedding AS x FROM v_features),
    split_rows AS ({q.split('features', 'row_id', 0.2, 0.2, SEED)}),
    train_rows AS (SELECT * FROM split_rows WHERE split = 'train'),
    unseen AS (SELECT * FROM split_rows WHERE split <> 'train')"""


@query(
    "fit_linear",
    f"""{q.WITH('v_features').replace('WITH', 'WITH RECURSIVE', 1)}, {_ALL_FEATURES},
    {q.linear_all('train_rows', 'unseen', WIDTH)}
    SELECT row_id, split, y, {r6('p')} AS p FROM scored""",
)
def linear(spark, sf):
    return _linear_predictions(split_rows(spark, sf))


@query("fit_linear_two_features", f"{_linear_sql(None)} SELECT row_id, split, y, {r6('p')} AS p FROM scored")
def linear_two(spark, sf):
    return _linear_predictions(split_rows(spark, sf, TWO))


_SCORED = f"""{q.WITH('v_features')}, {_ALL_FEATURES}
    SELECT row_id, split, y, true AS scored FROM unseen"""


def _scored(predicted: DataFrame) -> DataFrame:
    """Unseen rows, and whether each got a finite prediction: the predictions themselves are beyond SQL."""
    finite = F.col("p").isNotNull() & ~F.isnan("p") & (F.abs("p") != float("inf"))
    return predicted.select("row_id", "split", "y", finite.alias("scored"))


@query("fit_boosted", _SCORED)
def boosted(spark, sf):
    rows = split_rows(spark, sf)
    model = fit_boosted(rows.filter("split = 'train'"))
    return _scored(predict_boosted(model, rows.filter("split <> 'train'")))


ROUNDS_IN_SQL = 2

_FIRST_ROUNDS = f"""{q.WITH('v_features')},
    features AS (SELECT vec_id AS row_id, cancer_type, AUC AS y, embedding AS x FROM v_features),
    split_rows AS MATERIALIZED ({q.split('features', 'row_id', 0.2, 0.2, SEED, 'cancer_type')}),
    {q.boosted('split_rows', WIDTH, 'cancer_type', ROUNDS_IN_SQL, boosting.DEPTH, boosting.BINS, boosting.STEP, boosting.BITS)}"""


def _first_rounds(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The split rows, and the first rounds of all cancer types' trees."""
    rows = materialize(modeling.split_table(features(spark, sf), COLUMNS, SETTINGS, by_group=True), "split")
    return rows, fit_boosted(rows.filter("split = 'train'"), "cancer_type", rounds=ROUNDS_IN_SQL)


@query(
    "fit_boosted_splits",
    f"""{_FIRST_ROUNDS}
    SELECT cancer_type, round, node, feature, {r6('threshold')} AS threshold, {r6('gain')} AS gain FROM boosted_splits""",
)
def boosted_splits(spark, sf):
    return rounded(splits(_first_rounds(spark, sf)[1], "cancer_type"), "threshold", "gain")


@query(
    "fit_boosted_first_rounds",
    f"""{_FIRST_ROUNDS}
    SELECT cancer_type, row_id, split, y, {r6('p')} AS p FROM boosted_scored WHERE split <> 'train'""",
)
def boosted_first_rounds(spark, sf):
    rows, model = _first_rounds(spark, sf)
    scored = predict_boosted(model, rows.filter("split <> 'train'"), "cancer_type")
    return rounded(scored.select("cancer_type", "row_id", "split", "y", "p"), "p")


def _network(rows: DataFrame, spec) -> DataFrame:
    models = fit_networks(rows, [spec], "row_id")
    return _scored(predict_networks(rows.filter("split <> 'train'"), models, "row_id"))


@query("fit_mlp", _SCORED)
def mlp(spark, sf):
    return _network(split_rows(spark, sf), mlp_spec(seed=SEED))


@query("fit_dnn", _SCORED)
def dnn(spark, sf):
    return _network(split_rows(spark, sf), dnn_spec(seed=SEED))


@query(
    "predict_score",
    f"""{_BY_GROUP}
    SELECT 'linear' AS model, cancer_type, split, row_id, y, {r6('p')} AS p FROM scored""",
)
def predict_score(spark, sf):
    return rounded(modeling.predict_score(features(spark, sf), "linear", CANCER_TYPES, COLUMNS, SETTINGS), "p")


_METRICS = [f"{s}_{m}" for s in ("validation", "test") for m in METRIC_NAMES]


@query(
    "run_models_by_group",
    f"""{_BY_GROUP}, named AS (SELECT 'linear' AS model_name, * FROM scored),
    {metric_columns_sql('named', ['model_name', 'cancer_type'], 'row_id')}
    SELECT model_name, 'LinearRegression' AS model_label, cancer_type, 0 AS quarantined, {metric_picks_sql()}
    FROM scores GROUP BY model_name, cancer_type""",
)
def by_group(spark, sf):
    return rounded(modeling.run_models(features(spark, sf), "linear", CANCER_TYPES, COLUMNS, SETTINGS), *_METRICS)


@query(
    "run_models_from_csv",
    f"""{q.WITH('v_features')}, rows_in AS (SELECT vec_id AS row_id, cancer_type FROM v_features),
    split_rows AS ({q.split('rows_in', 'row_id', 0.2, 0.2, SEED, 'cancer_type')})
    SELECT cancer_type, split, count(*) AS n_rows, count(*) AS n_keys, count(*) AS n_scored
    FROM split_rows WHERE split <> 'train' GROUP BY cancer_type, split""",
)
def from_csv(spark, sf):
    """A feature file without keys or a known width is fitted by type; what is compared does not depend on the keys."""
    path = scratch_path(spark, "features.csv")
    tables.write_features_csv(load(spark, sf, "v_features"), path, WIDTH, "embedding")
    rows = materialize(tables.read_features_keyed(spark, path), "keyed_features")
    scored = modeling.predict_score(rows, "linear", CANCER_TYPES, settings=SETTINGS)
    return scored.groupBy("cancer_type", "split").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("row_id").alias("n_keys"),
        F.count(F.when(~F.isnan("p"), F.col("p"))).alias("n_scored"),
    )


@query("run_models")
def run_models(spark, sf):
    return modeling.run_models(features(spark, sf), modeling.ALL_MODELS, None, COLUMNS, SETTINGS)


@query("run_models_by_group_networks")
def by_group_networks(spark, sf):
    """All four models, boosted trees too, inside every cancer type."""
    return modeling.run_models(features(spark, sf), modeling.ALL_MODELS, CANCER_TYPES, COLUMNS, SETTINGS)


@query("response_to_results")
def response_to_results(spark, sf):
    """Response rows to prompts, vectors and feature tables, and the linear model's results on every prompt variant."""
    long = feature_table(load(spark, sf, "v_response"), "study", distinct=True, batch_size=256)
    path = scratch_path(spark, "features")
    tables.write_features_variants(long, path)
    rows = spark.read.schema(long.schema).parquet(path)
    columns = modeling.Columns(key="row_id", group="variant")
    results = modeling.run_models(rows, "linear", list(VARIANTS.values()), columns, SETTINGS)
    return rounded(results.withColumnRenamed("cancer_type", "variant"), *_METRICS)


@query("run_search")
def search(spark, sf):
    found = run_search(features(spark, sf), seed=SEED, columns=COLUMNS)
    return found.trials.withColumn("hidden_dims", F.array_join("hidden_dims", "-"))
