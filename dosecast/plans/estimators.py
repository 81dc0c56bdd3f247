"""The four models as a Spark ML estimator, so that they take part in a ``Pipeline`` and are saved with it.

``ResponseRegressor(modelName=...)`` fits one of ``modeling.MODEL_LABELS`` on the rows whose split is ``train`` (networks
watch those of ``val`` for early stopping), over all rows or inside each value of ``groupCol``. The fitted
``ResponseModel`` adds ``predictionCol`` to every row; a row of a group without a model, or whose vector is missing, has
another width, or (but for trees) holds null or NaN, gets null. Vectors are arrays, as in the feature tables.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosecast.operators.boosted import fit_boosted, load_boosted, predict_boosted, save_boosted
from dosecast.operators.linear import fit_linear, predict_linear
from dosecast.operators.neural import ALL, dnn_spec, fit_networks, load_network, mlp_spec, predict_networks, save_network, width_of
from dosecast.plans.modeling import Columns, chosen_models, unusable

SPECS = {"mlp": mlp_spec, "custom": dnn_spec}


class ResponseParams(Params):
    """What the estimator and its models share."""

    modelName = Param(Params._dummy(), "modelName", "linear, xgboost, mlp or custom", TypeConverters.toString)
    keyCol = Param(Params._dummy(), "keyCol", "unique key", TypeConverters.toString)
    featuresCol = Param(Params._dummy(), "featuresCol", "array of numbers", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "target", TypeConverters.toString)
    splitCol = Param(Params._dummy(), "splitCol", "train, val or test", TypeConverters.toString)
    groupCol = Param(Params._dummy(), "groupCol", "one model for each value; empty: one model", TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "added column", TypeConverters.toString)
    rounds = Param(Params._dummy(), "rounds", "rounds of boosted trees", TypeConverters.toInt)
    maxEpochs = Param(Params._dummy(), "maxEpochs", "most epochs of a network", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of a network's first weights and batches", TypeConverters.toInt)

    def __init__(self):
        super().__init__()
        self._setDefault(
            modelName="linear",
            keyCol="row_id",
            featuresCol="features",
            labelCol="y",
            splitCol="split",
            groupCol="",
            predictionCol="p",
            rounds=100,
            maxEpochs=500,
            seed=42,
        )

    def value(self, name: str):
        return self.getOrDefault(self.getParam(name))

    def group(self) -> str | None:
        return self.value("groupCol") or None


class ResponseRegressor(Estimator, ResponseParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(
        self,
        *,
        modelName="linear",
        keyCol="row_id",
        featuresCol="features",
        labelCol="y",
        splitCol="split",
        groupCol="",
        predictionCol="p",
        rounds=100,
        maxEpochs=500,
        seed=42,
    ):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "ResponseModel":
        (name,) = chosen_models(self.value("modelName"))
        features, label, split, group = self.value("featuresCol"), self.value("labelCol"), self.value("splitCol"), self.group()
        usable = dataset.filter(~unusable(dataset, Columns(features=features, target=label)))
        if name in SPECS:
            picked = [F.col(self.value("keyCol")).alias("_key"), F.col(features).alias("features"), F.col(label).cast("double").alias("y"), F.col(split).alias("split")]
            rows = usable.select(*picked, *([F.col(group).cast("string").alias("_of")] if group else []))
            groups = [r["_of"] for r in rows.filter("split = 'train' AND _of IS NOT NULL").select("_of").distinct().collect()] if group else [ALL]
            limit = {"max_epochs": self.value("maxEpochs"), "seed": self.value("seed")}
            fitted = fit_networks(rows, [SPECS[name](g, g, **limit) for g in sorted(groups)], "_key", "_of" if group else None)
        else:
            train = usable.filter(F.col(split) == "train")
            fitted = fit_linear(train, group, features, label) if name == "linear" else fit_boosted(train, group, features, label, rounds=self.value("rounds"))
        return self._copyValues(ResponseModel(fitted))


class ResponseModel(Model, ResponseParams, MLReadable, MLWritable):
    """``fitted`` is a table of coefficients or of trees, or the networks by group."""

    def __init__(self, fitted=None):
        super().__init__()
        self.fitted = fitted

    def _transform(self, dataset: DataFrame) -> DataFrame:
        name, features, output, group = self.value("modelName"), self.value("featuresCol"), self.value("predictionCol"), self.group()
        if name == "xgboost":
            return predict_boosted(self.fitted, dataset, group, features, output)
        broken = F.exists(F.col(features), lambda x: x.isNull() | F.isnan(x))
        if name == "linear":
            scored = predict_linear(self.fitted, dataset.withColumn("_vector", F.when(~broken, F.col(features))), group, "_vector", output)
            return scored.select(*dataset.columns, output)
        fits = ~broken & (F.size(features) == width_of(self.fitted))
        if group:
            fits &= F.col(group).cast("string").isin(*self.fitted)
        fits = F.coalesce(fits, F.lit(False))
        row = F.struct(*[F.col(f"`{c}`") for c in dataset.columns]).alias("_row")
        own = F.col(group).cast("string") if group else F.lit(ALL)
        packed = dataset.filter(fits).select(row, F.col(features).alias("features"), own.alias("_of"), F.lit(0).alias("_key"), F.lit("").alias("split"), F.lit(0.0).alias("y"))
        scored = predict_networks(packed, self.fitted, "_key", "_of" if group else None, carried=["_row"])
        rest = dataset.filter(~fits).withColumn(output, F.lit(None).cast("double"))
        return scored.select("_row.*", F.col("p").alias(output)).unionByName(rest)

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader()


class _ModelWriter(MLWriter):
    def __init__(self, model: ResponseModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        model, spark = self.model, self.sparkSession
        networks = sorted(model.fitted) if isinstance(model.fitted, dict) else []
        DefaultParamsWriter.saveMetadata(model, path, spark, extraMetadata={"networks": networks})
        for i, name in enumerate(networks):
            save_network(spark, model.fitted[name], f"{path}/data/{i}")
        if not isinstance(model.fitted, dict):
            save_boosted(model.fitted, f"{path}/data")  # a table, of trees or of coefficients


class _ModelReader(MLReader):
    def load(self, path: str) -> ResponseModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = ResponseModel()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        if model.value("modelName") in SPECS:
            model.fitted = {n: load_network(self.sparkSession, f"{path}/data/{i}") for i, n in enumerate(metadata["networks"])}
        else:
            model.fitted = load_boosted(self.sparkSession, f"{path}/data")
        return model
