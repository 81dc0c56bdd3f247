"""Fit and score: models by name, on a whole split table or inside groups."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dosecast.operators.boosted import fit_boosted, predict_boosted
from dosecast.operators.features import filter_groups
from dosecast.operators.linear import fit_linear, predict_linear
from dosecast.operators.metrics import metrics_table, score_predictions
from dosecast.operators.neural import dnn_spec, fit_networks, mlp_spec, predict_networks
from dosecast.operators.split import split_three_way
from dosecast.session import materialize

# Model names and the labels they carry in results.
MODEL_LABELS = {"linear": "LinearRegression", "xgboost": "XGboost", "mlp": "MLP", "custom": "DNN"}
ALL_MODELS = "all"


@dataclass(frozen=True)
class Columns:
    """Names of the table that models are fitted on."""

    key: str = "row_id"
    features: str = "features"
    target: str = "AUC"
    group: str = "cancer_type"


@dataclass(frozen=True)
class Settings:
    """What may be changed about a run; the defaults are the full run."""

    test_size: float = 0.2
    val_size: float = 0.2
    seed: int = 42
    n_bootstrap: int = 1000
    alpha: float = 0.05
    boosted_rounds: int = 100
    mlp_epochs: int = 500
    dnn_epochs: int = 500


def chosen_models(model: str | Sequence[str]) -> list[str]:
    """``all``, one name or several; an unknown name is an error."""
    names = list(MODEL_LABELS) if model == ALL_MODELS else [model] if isinstance(model, str) else list(model)
    for name in names:
        if name not in MODEL_LABELS:
            raise ValueError(f"Unknown model: {name}")
    return names


def unusable(df: DataFrame, columns: Columns) -> Column:
    """Rows of ``df`` that no model can take: a missing vector, a missing or NaN cell in it, a missing or NaN target."""
    vector, target = F.col(columns.features), F.col(columns.target).cast("double")
    kind = df.select(vector).schema[0].dataType.elementType
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        # In compiled code, unlike a function of every cell; null where a cell is missing and none is NaN.
        bad_cells = F.array_contains(vector, F.lit(float("nan")).cast(kind))
    else:
        bad_cells = F.exists(vector, lambda x: x.isNull() | F.isnan(x))
    return F.coalesce(vector.isNull() | bad_cells | target.isNull() | F.isnan(target), F.lit(True))


def split_table(df: DataFrame, columns: Columns, settings: Settings, by_group: bool) -> DataFrame:
    """(row_id, features, y, group, split), the one table that every model reads; ``unusable`` rows stay out."""
    rows = df.filter(~unusable(df, columns)).select(
        F.col(columns.key).alias("row_id"),
        F.col(columns.features).alias("features"),
        F.col(columns.target).cast("double").alias("y"),
        F.col(columns.group).alias("cancer_type"),
    )
    return split_three_way(
        rows, "row_id", settings.test_size, settings.val_size, settings.seed, ["cancer_type"] if by_group else []
    )


def predictions_linear(rows: DataFrame, group: str | None, groups: Sequence[str], settings: Settings) -> DataFrame:
    model = fit_linear(rows.filter("split = 'train'"), group)
    return _long(predict_linear(model, rows.filter("split <> 'train'"), group), "linear")


def predictions_boosted(rows: DataFrame, group: str | None, groups: Sequence[str], settings: Settings) -> DataFrame:
    model = fit_boosted(rows.filter("split = 'train'"), group, rounds=settings.boosted_rounds)
    return _long(predict_boosted(model, rows.filter("split <> 'train'"), group), "xgboost")


def predictions_networks(make_spec: Callable, name: str, epochs: str) -> Callable:
    def predict(rows: DataFrame, group: str | None, groups: Sequence[str], settings: Settings) -> DataFrame:
        limit = {"max_epochs": getattr(settings, epochs), "seed": settings.seed}
        specs = [make_spec(g, g, **limit) for g in groups] if group else [make_spec(name, **limit)]
        models = fit_networks(rows, specs, "row_id", group)
        unseen = rows.filter("split <> 'train'")
        scored = predict_networks(unseen, models, "row_id", group, carried=["cancer_type"])
        return _long(scored.drop("model"), name)

    return predict


MODELS: dict[str, Callable] = {
    "linear": predictions_linear,
    "xgboost": predictions_boosted,
    "mlp": predictions_networks(mlp_spec, "mlp", "mlp_epochs"),
    "custom": predictions_networks(dnn_spec, "custom", "dnn_epochs"),
}


def predict_score(
    df: DataFrame,
    model: str | Sequence[str] = ALL_MODELS,
    groups: Sequence[str] | None = None,
    columns: Columns = Columns(),
    settings: Settings = Settings(),
) -> DataFrame:
    """Fit the models and return the written long table (model, cancer_type, split, row_id, y, p).

    ``df`` is a written feature table: the split is recomputed in each scan, which is
    cheaper than keeping a second copy of the vectors, and group filters reach the files.

    With ``groups`` every model is fitted inside each listed cancer type that has rows.
    """
    names = chosen_models(model)
    by_group = groups is not None
    rows = filter_groups(df, groups, columns.group) if by_group else df
    rows = split_table(rows, columns, settings, by_group)
    present = groups_with_rows(rows, groups) if by_group else []
    group = "cancer_type" if by_group else None
    scored = [materialize(MODELS[name](rows, group, present, settings), "predictions") for name in names]
    return reduce(DataFrame.unionByName, scored)


def groups_with_rows(rows: DataFrame, groups: Sequence[str], column: str = "cancer_type") -> list[str]:
    """The listed groups that have rows, in listed order; the others cannot be modelled."""
    found = {r[column] for r in filter_groups(rows, groups, column).select(column).distinct().collect()}
    return [g for g in groups if g in found]


def run_models(
    df: DataFrame,
    model: str | Sequence[str] = ALL_MODELS,
    groups: Sequence[str] | None = None,
    columns: Columns = Columns(),
    settings: Settings = Settings(),
) -> DataFrame:
    """Results, one row per model (and cancer type): validation and test metrics, both names, ``quarantined`` rows."""
    predictions = predict_score(df, model, groups, columns, settings)
    results = results_table(predictions, groups is not None, settings)
    bad = df.filter(unusable(df, columns))
    if groups is None:
        return results.withColumn("quarantined", F.lit(bad.count()).cast("long"))
    counts = filter_groups(bad, groups, columns.group).groupBy(F.col(columns.group).alias("cancer_type")).agg(F.count(F.lit(1)).alias("quarantined"))
    return results.join(counts, "cancer_type", "left").withColumn("quarantined", F.coalesce("quarantined", F.lit(0)).cast("long"))


def results_table(predictions: DataFrame, by_group: bool, settings: Settings = Settings()) -> DataFrame:
    by = ["model_name", "cancer_type"] if by_group else ["model_name"]
    named = predictions.withColumnRenamed("model", "model_name")
    scores = score_predictions(
        named, [*by, "split"], "row_id", settings.n_bootstrap, settings.alpha, settings.seed
    )
    labels = F.create_map(*[F.lit(x) for pair in MODEL_LABELS.items() for x in pair])
    return metrics_table(scores, by).withColumn("model_label", labels[F.col("model_name")])


def append_results(parts: Sequence[DataFrame]) -> DataFrame:
    """Result rows of several runs as one table, matched by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _long(scored: DataFrame, name: str) -> DataFrame:
    return scored.select(
        F.lit(name).alias("model"), "cancer_type", "split", "row_id", F.col("y"), F.col("p").cast("double").alias("p")
    )
