"""Registered queries: what is written and read back is what was there."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dosecast.functions.vectors import wide_columns
from dosecast.operators import prompts
from dosecast.operators.boosted import fit_boosted, load_boosted, predict_boosted, save_boosted
from dosecast.operators.early_stop import best_trial
from dosecast.operators.embed import embed_chunks
from dosecast.operators.features import VARIANTS, feature_variants
from dosecast.operators.metrics import mse, r2
from dosecast.operators.neural import load_network, predict_networks
from dosecast.plans import sql as q
from dosecast.plans.queries_embed import DIMS, _VARIANT_ROWS, _WIDE_SQL, embedded_wide, variant_rows
from dosecast.plans.queries_prompts import PROMPT_TABLE, _select
from dosecast.plans.queries_scores import SEED, r6, rounded, space_sql
from dosecast.plans.catalog import query
from dosecast.plans.modeling import Columns
from dosecast.plans.search import run_search, save_search, search_space
from dosecast.plans.space import Space
from dosecast.plans.views import load
from dosecast.session import scratch_path
from dosecast.sources import tables

RESPONSE = [f.name for f in tables.RESPONSE_SCHEMA if f.name != "CONTEXT"]


@query(
    "src_response_tsv",
    f"{q.WITH('v_response_nulls')} SELECT {', '.join(RESPONSE)} FROM v_response_nulls",
)
def src_response_tsv(spark, sf):
    path = scratch_path(spark, "response.tsv")
    tables.write_text_table(load(spark, sf, "v_response_nulls"), path)
    return tables.read_response(spark, path)


def _digests(columns, text):
    """Long prompts are compared by their md5."""
    return [c for c in columns if c not in text], [c for c in columns if c in text]


_PLAIN, _LONG = _digests(PROMPT_TABLE, [c for c in PROMPT_TABLE if "prompt" in c or "question" in c])


@query(
    "src_prompt_tsv",
    _select({**{c: PROMPT_TABLE[c] for c in _PLAIN}, **{c: f"md5({PROMPT_TABLE[c]})" for c in _LONG}}, distinct=True),
)
def src_prompt_tsv(spark, sf):
    path = scratch_path(spark, "prompts.tsv")
    tables.write_prompts(prompts.prompt_table(load(spark, sf, "v_response_nulls"), seed=SEED, alike=True), path)
    back = tables.read_prompts(spark, path)
    return back.select(*_PLAIN, *[F.md5(c).alias(c) for c in _LONG])


_EMBEDDED_SCHEMA = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("AUC", T.DoubleType()),
        T.StructField("label", T.StringType()),
        T.StructField("cancer_type", T.StringType()),
    ]
)
_VECTORS = [f"emb_{column}" for column in VARIANTS]
_EMBEDDED_SQL = f"""{q.WITH('v_features')}, failing AS (
    SELECT * REPLACE (CASE WHEN vec_id % 50 <> 0 THEN embedding END AS embedding) FROM v_features), {variant_rows('failing')}
    SELECT variant, vec_id, AUC, label, cancer_type, {_WIDE_SQL} FROM variants"""


def _embedded(spark, sf):
    """A wide embedded table with the vectors of all eight prompt columns, some of which failed."""
    rows = load(spark, sf, "v_features").withColumn("embedding", F.when(F.col("vec_id") % 50 != 0, F.col("embedding")))
    return embedded_wide(rows).select("vec_id", "AUC", "label", "cancer_type", *_VECTORS)


def _read_embedded(spark, path):
    long = feature_variants(tables.read_embedded(spark, path, _EMBEDDED_SCHEMA, _VECTORS), "study", ["vec_id"])
    return long.select("variant", *_EMBEDDED_SCHEMA.fieldNames(), *wide_columns("features", DIMS))


@query("src_embedded_tsv", _EMBEDDED_SQL)
def src_embedded_tsv(spark, sf):
    path = scratch_path(spark, "embedded.tsv")
    tables.write_embedded(_embedded(spark, sf), path, _VECTORS)
    return _read_embedded(spark, path)


@query("src_embedded_glob", _EMBEDDED_SQL)
def src_embedded_glob(spark, sf):
    """One write deals the chunks of all devices to files of their own; a glob reads them as one table."""
    folder = scratch_path(spark, "chunks")
    rows = embed_chunks(_embedded(spark, sf), "vec_id", chunk_rows=100, devices=4)
    numbered = rows.withColumnRenamed("device", "processed_chunk").drop("row_no", "chunk")
    tables.write_embedded(numbered, folder, _VECTORS, by="processed_chunk")
    return _read_embedded(spark, f"{folder}/processed_chunk=*")


@query("src_features_csv", f"{q.WITH('v_features')} SELECT {_WIDE_SQL}, AUC, label, cancer_type FROM v_features")
def src_features_csv(spark, sf):
    path = scratch_path(spark, "features.csv")
    tables.write_features_csv(load(spark, sf, "v_features"), path, DIMS, "embedding")
    return tables.read_features_csv(spark, path, DIMS)


@query("sink_table_tsv", f"{q.WITH('v_docs')} SELECT doc_id, nullif(text, '') AS text, lang, source FROM v_docs")
def sink_table_tsv(spark, sf):
    path = scratch_path(spark, "docs.tsv")
    rows = load(spark, sf, "v_docs")
    tables.write_text_table(rows, path)
    return tables.read_text_table(spark, path, rows.schema)


@query(
    "sink_features_variants",
    f"""{q.WITH('v_features')}, {_VARIANT_ROWS}
    SELECT variant, vec_id, AUC, label, cancer_type, {_WIDE_SQL} FROM variants""",
)
def sink_features_variants(spark, sf):
    path = scratch_path(spark, "variants")
    long = feature_variants(embedded_wide(load(spark, sf, "v_features")), "study", ["vec_id"])
    tables.write_features_variants(long, path)
    back = [
        tables.read_features_variant(spark, path, long.schema, v, "study").withColumn("variant", F.lit(v))
        for v in VARIANTS.values()
    ]
    return reduce(DataFrame.unionByName, back).select("variant", "vec_id", "AUC", "label", "cancer_type", *wide_columns("features", DIMS))


@query(
    "sink_results",
    f"""{q.WITH('v_pairs')} SELECT 'price' AS model_name, grp AS cancer_type, {r6(q.MSE)} AS test_mse,
        {r6(q.R2)} AS test_r2 FROM v_pairs GROUP BY grp""",
)
def sink_results(spark, sf):
    path = scratch_path(spark, "results.csv")
    pairs = load(spark, sf, "v_pairs").withColumnRenamed("grp", "cancer_type")
    scored = pairs.groupBy("cancer_type").agg(mse().alias("test_mse"), r2().alias("test_r2"))
    results = rounded(scored, "test_mse", "test_r2").select(F.lit("price").alias("model_name"), "*")
    tables.write_results(results, path)
    return tables.read_text_table(spark, path, results.schema, sep=",")


@query(
    "sink_trials_params",
    f"""SELECT trial_number, batch_size, learning_rate, hidden_dims, val_spearman,
               trial_number = first(trial_number) OVER (ORDER BY score DESC, trial_number) AS is_best
    FROM (SELECT vec_id AS trial_number, {space_sql('vec_id')}, CAST(embedding[1] AS DOUBLE) AS score,
                 {r6('CAST(embedding[1] AS DOUBLE)')} AS val_spearman FROM embeddings)""",
)
def sink_trials_params(spark, sf):
    folder = scratch_path(spark, "search")
    rows = load(spark, sf, "v_features").withColumnRenamed("vec_id", "trial_number")
    scores = rows.select("trial_number", F.get("embedding", F.lit(0)).cast("double").alias("val_spearman"))
    trials = search_space(rows, SEED).join(scores, "trial_number")
    tables.write_trials(trials, f"{folder}/trials")
    tables.write_best_params(best_trial(trials), f"{folder}/best_params")
    schema = T.StructType(
        [f if f.name != "hidden_dims" else T.StructField("hidden_dims", T.StringType()) for f in trials.schema]
    )
    back = tables.read_text_table(spark, f"{folder}/trials", schema, sep=",")
    best = tables.read_best_params(spark, f"{folder}/best_params")
    dims = F.from_json("hidden_dims", "array<int>")
    is_best = (
        (F.col("learning_rate") == best["learning_rate"])
        & (F.col("batch_size") == best["batch_size"])
        & (dims == F.array(*[F.lit(best[f"n_units_l{i}"]) for i in range(best["n_layers"])]))
    )
    return back.select(
        "trial_number",
        "batch_size",
        F.round("learning_rate", 9).alias("learning_rate"),
        F.array_join(dims, "-").alias("hidden_dims"),
        (F.round("val_spearman", 6) + F.lit(0.0)).alias("val_spearman"),
        is_best.alias("is_best"),
    )


@query("sink_model", f"{q.WITH('v_features')} SELECT vec_id, AUC AS y, true AS unchanged FROM v_features")
def sink_model(spark, sf):
    """A model that was saved and loaded predicts exactly what it did before."""
    rows = load(spark, sf, "v_features").select("vec_id", F.col("embedding").alias("features"), F.col("AUC").alias("y"))
    path = scratch_path(spark, "model")
    fitted = fit_boosted(rows)
    save_boosted(fitted, path)
    before = predict_boosted(fitted, rows, output="before")
    after = predict_boosted(load_boosted(spark, path), before, output="after")
    return after.select("vec_id", "y", (F.col("before") == F.col("after")).alias("unchanged"))


@query("sink_search", f"{q.WITH('v_features')} SELECT vec_id, AUC AS y, true AS unchanged, 6 AS trials FROM v_features")
def sink_search(spark, sf):
    """A search's files: the trials, and the best network, which predicts what it did before it was saved."""
    rows = load(spark, sf, "v_features")
    columns = Columns(key="vec_id", features="embedding")
    found = run_search(rows, 6, SEED, columns, epochs=10, space=Space(layer_widths=(64, 128)), startup=4, wave=2)
    folder = scratch_path(spark, "search")
    save_search(spark, found, folder)
    params, network = tables.read_best_params(spark, f"{folder}/best_params"), load_network(spark, f"{folder}/best_model")
    text = T.StructType([T.StructField("trial_number", T.LongType()), T.StructField("val_spearman", T.DoubleType())])
    trials = tables.read_text_table(spark, f"{folder}/trials", text, sep=",")
    best = best_trial(trials).first()
    same = params == found.best_params and best["val_spearman"] == found.best_value and network.spec == found.best_model.spec
    asked = rows.select("vec_id", F.lit("all").alias("split"), F.col("embedding").alias("features"), F.col("AUC").alias("y"))
    before, after = (predict_networks(asked, {"m": m}, "vec_id").select("vec_id", "y", F.col("p").alias(c)) for m, c in ((found.best_model, "before"), (network, "after")))
    unchanged = (F.col("before") == F.col("after")) & F.lit(same)
    return before.join(after.drop("y"), "vec_id").select("vec_id", "y", unchanged.alias("unchanged"), F.lit(trials.count()).cast("int").alias("trials"))
