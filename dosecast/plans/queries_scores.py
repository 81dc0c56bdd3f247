"""Registered queries: metrics, ranks, splits, early stopping, trial choice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosecast.operators import metrics, ranking
from dosecast.operators.early_stop import best_trial, early_stop_epoch
from dosecast.operators.split import split_three_way
from dosecast.plans import sql as q
from dosecast.plans.modeling import append_results
from dosecast.plans.catalog import query
from dosecast.plans.search import search_space, trial_table
from dosecast.plans.views import load
from dosecast.session import materialize

SEED = 42
REPLICATES = 1000
PATIENCE = 5


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Round, and turn -0.0 into 0.0 so that values compare as text too."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


def r6(expression: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0"


@query("metric_mse", f"{q.WITH('v_pairs')} SELECT grp, {r6(q.MSE)} AS mse FROM v_pairs GROUP BY grp")
def metric_mse(spark, sf):
    return rounded(load(spark, sf, "v_pairs").groupBy("grp").agg(metrics.mse().alias("mse")), "mse")


@query("metric_r2", f"{q.WITH('v_pairs')} SELECT grp, {r6(q.R2)} AS r2 FROM v_pairs GROUP BY grp")
def metric_r2(spark, sf):
    return rounded(load(spark, sf, "v_pairs").groupBy("grp").agg(metrics.r2().alias("r2")), "r2")


@query(
    "metric_spearman",
    f"{q.WITH('v_pairs')} SELECT grp, n, {r6('spearman')} AS spearman FROM ({q.spearman('v_pairs', 'grp')})",
)
def metric_spearman(spark, sf):
    return rounded(metrics.spearman(load(spark, sf, "v_pairs"), ["grp"]), "spearman")


@query(
    "metric_spearman_p",
    f"""{q.WITH('v_pairs_keyed')}, scores AS ({q.spearman('v_pairs_keyed', 'cancer_type')})
    SELECT cancer_type, n, {r6('spearman')} AS spearman,
           {r6('spearman * sqrt((n - 2) / ((1 + spearman) * (1 - spearman)))')} AS t,
           {r6('spearman_p')} AS spearman_p
    FROM ({q.spearman_p('scores', 'cancer_type')})""",
)
def metric_spearman_p(spark, sf):
    scores = metrics.spearman(load(spark, sf, "v_pairs_keyed"), ["cancer_type"])
    scores = metrics.with_spearman_p(scores.withColumn("t", metrics.spearman_t()))
    return rounded(scores, "spearman", "t", "spearman_p")


_DRAWS = f"""
    base AS (SELECT cancer_type, y, p, count(*) OVER (PARTITION BY cancer_type) AS n,
                    row_number() OVER (PARTITION BY cancer_type
                                       ORDER BY {q.md5(str(SEED), 'vec_id')}, vec_id) - 1 AS pos
             FROM v_pairs_keyed),
    draws AS (SELECT cancer_type, rep, {q.md5_long(str(SEED), 'rep', 'pos')} % n AS pos
              FROM base CROSS JOIN (SELECT unnest(range({REPLICATES})) AS rep)),
    drawn AS (SELECT d.cancer_type || ':' || rep AS g, y, p FROM draws d JOIN base USING (cancer_type, pos)),
    reps AS (SELECT split_part(g, ':', 1) AS cancer_type, spearman FROM ({q.spearman('drawn', 'g')}))"""


@query(
    "metric_bootstrap_ci",
    f"""{q.WITH('v_pairs_keyed')}, {_DRAWS}
    SELECT cancer_type, {r6('quantile_cont(spearman, 0.025)')} AS ci_lower,
           {r6('quantile_cont(spearman, 0.975)')} AS ci_upper, count(spearman) AS replicates,
           count(*) FILTER (spearman IS NULL) AS dropped_replicates
    FROM reps GROUP BY cancer_type""",
)
def metric_bootstrap_ci(spark, sf):
    pairs = load(spark, sf, "v_pairs_keyed")
    return rounded(
        metrics.bootstrap_ci(pairs, "vec_id", ["cancer_type"], REPLICATES, seed=SEED), "ci_lower", "ci_upper"
    )


@query(
    "metric_percentile",
    f"""{q.WITH('v_pairs')}
    SELECT grp, {r6('quantile_cont(p, 0.025)')} AS low, {r6('quantile_cont(p, 0.975)')} AS high
    FROM v_pairs GROUP BY grp""",
)
def metric_percentile(spark, sf):
    found = ranking.exact_percentiles(load(spark, sf, "v_pairs"), "p", {"low": 0.025, "high": 0.975}, ["grp"])
    return rounded(found, "low", "high")


_EPOCHS = """epochs AS (
    SELECT run, epoch, avg(batch_loss) AS epoch_loss
    FROM (SELECT run, epoch, batch, avg(loss) AS batch_loss FROM v_epochs GROUP BY ALL) GROUP BY ALL)"""


@query(
    "loss_epoch_mean",
    f"{q.WITH('v_epochs')}, {_EPOCHS} SELECT run, epoch, {r6('epoch_loss')} AS epoch_loss FROM epochs",
)
def loss_epoch_mean(spark, sf):
    return rounded(metrics.loss_epoch_mean(load(spark, sf, "v_epochs"), epoch=["run", "epoch"]), "epoch_loss")


@query(
    "early_stop_epoch",
    f"""{q.WITH('v_epochs')}, {_EPOCHS},
    marked AS (SELECT run, epoch, epoch_loss, row_number() OVER w AS n,
                      min(epoch_loss) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best
               FROM (SELECT run, epoch, round(epoch_loss, 6) AS epoch_loss FROM epochs)
               WINDOW w AS (PARTITION BY run ORDER BY epoch)),
    gaps AS (SELECT run, epoch, n - max(CASE WHEN best IS NULL OR epoch_loss < best THEN n END)
                                        OVER (PARTITION BY run ORDER BY epoch) AS gap
             FROM marked)
    SELECT run, coalesce(min(epoch) FILTER (gap >= {PATIENCE}), max(epoch)) AS stop_epoch,
           coalesce(bool_or(gap >= {PATIENCE}), false) AS stopped_early
    FROM gaps GROUP BY run""",
)
def early_stops(spark, sf):
    losses = metrics.loss_epoch_mean(load(spark, sf, "v_epochs"), epoch=["run", "epoch"])
    return early_stop_epoch(rounded(losses, "epoch_loss"), ["run"], PATIENCE)


_MODELLED = f"""
    features AS (SELECT vec_id, cancer_type, AUC AS y, CAST(embedding[1] AS DOUBLE) AS x1,
                        CAST(embedding[2] AS DOUBLE) AS x2 FROM v_features),
    split_rows AS ({q.split('features', 'vec_id', 0.2, 0.2, SEED, 'cancer_type')}),
    predictions AS (
        SELECT 'first' AS model_name, vec_id, cancer_type, split, y, x1 AS p FROM split_rows WHERE split <> 'train'
        UNION ALL SELECT 'second', vec_id, cancer_type, split, y, x2 FROM split_rows WHERE split <> 'train')"""


def metric_columns_sql(source: str, by: list[str], key_column: str) -> str:
    """CTEs that score ``source`` per (by, split) with bootstrap intervals, ending in ``scores``."""
    key = " || '|' || ".join([*by, "split"])
    columns = ", ".join([*by, "split"])
    return f"""
    keyed AS (SELECT {key} AS g, * FROM {source}),
    errors AS (SELECT g, {columns}, {q.MSE} AS mse, {q.R2} AS r2 FROM keyed GROUP BY g, {columns}),
    ranks AS ({q.spearman('keyed', 'g')}),
    tails AS ({q.spearman_p('ranks', 'g')}),
    base AS (SELECT g, y, p, count(*) OVER (PARTITION BY g) AS n,
                    row_number() OVER (PARTITION BY g ORDER BY {q.md5(str(SEED), key_column)}, {key_column}) - 1 AS pos
             FROM keyed),
    draws AS (SELECT g, rep, {q.md5_long(str(SEED), 'rep', 'pos')} % n AS pos
              FROM base CROSS JOIN (SELECT unnest(range({REPLICATES})) AS rep)),
    drawn AS (SELECT d.g || ':' || rep AS g, y, p FROM draws d JOIN base USING (g, pos)),
    reps AS (SELECT split_part(g, ':', 1) AS g, spearman FROM ({q.spearman('drawn', 'g')})),
    intervals AS (SELECT g, quantile_cont(spearman, 0.025) AS ci_lower, quantile_cont(spearman, 0.975) AS ci_upper,
                         count(spearman) AS replicates, count(*) FILTER (spearman IS NULL) AS dropped_replicates
                  FROM reps GROUP BY g),
    scores AS (SELECT errors.*, n, spearman, spearman_p, ci_lower, ci_upper, replicates, dropped_replicates
               FROM errors JOIN tails USING (g) JOIN intervals USING (g))"""


METRIC_NAMES = ("mse", "r2", "spearman", "spearman_p", "ci_lower", "ci_upper")
COUNT_NAMES = ("replicates", "dropped_replicates")


def metric_picks_sql() -> str:
    sides = (("val", "validation"), ("test", "test"))
    values = [f"{r6(f'''max({m}) FILTER (split = '{s}')''')} AS {n}_{m}" for s, n in sides for m in METRIC_NAMES]
    counts = [f"max({m}) FILTER (split = '{s}') AS {n}_{m}" for s, n in sides for m in COUNT_NAMES]
    return ", ".join(values + counts)


def rounded_metrics(table: DataFrame) -> DataFrame:
    return rounded(table, *[f"{s}_{m}" for s in ("validation", "test") for m in METRIC_NAMES])


@query(
    "metrics_table",
    f"""{q.WITH('v_features')}, {_MODELLED},
    {metric_columns_sql('predictions', ['model_name', 'cancer_type'], 'vec_id')}
    SELECT model_name, cancer_type, {metric_picks_sql()} FROM scores GROUP BY model_name, cancer_type""",
)
def metrics_table(spark, sf):
    rows = load(spark, sf, "v_features").select("vec_id", "cancer_type", F.col("AUC").alias("y"), "embedding")
    rows = split_three_way(rows, "vec_id", seed=SEED, group=["cancer_type"]).filter("split <> 'train'")
    models = F.array(
        *[
            F.struct(F.lit(m).alias("model_name"), F.get("embedding", F.lit(i)).cast("double").alias("p"))
            for i, m in enumerate(("first", "second"))
        ]
    )
    predictions = materialize(rows.select("vec_id", "cancer_type", "split", "y", F.inline(models)), "predictions")
    by = ["model_name", "cancer_type"]
    scores = metrics.score_predictions(predictions, [*by, "split"], "vec_id", REPLICATES, seed=SEED)
    return rounded_metrics(metrics.metrics_table(scores, by))


_APPENDED = f"""
    (SELECT 'price' AS model_name, grp AS cancer_type, {r6(q.MSE)} AS mse, {r6(q.R2)} AS r2 FROM v_pairs GROUP BY grp)
    UNION ALL
    (SELECT 'constant', grp, round(avg((y - 25.5) * (y - 25.5)), 6) + 0.0, NULL FROM v_pairs GROUP BY grp)"""


@query("append_results", f"{q.WITH('v_pairs')} {_APPENDED}")
def append(spark, sf):
    pairs = load(spark, sf, "v_pairs").withColumnRenamed("grp", "cancer_type")
    scored = pairs.groupBy("cancer_type").agg(metrics.mse().alias("mse"), metrics.r2().alias("r2"))
    constant = pairs.withColumn("p", F.lit(25.5)).groupBy("cancer_type").agg(metrics.mse().alias("mse"))
    parts = [
        rounded(scored, "mse", "r2").withColumn("model_name", F.lit("price")),
        rounded(constant, "mse").withColumn("model_name", F.lit("constant")),
    ]
    return append_results(parts)


@query(
    "rank_average",
    f"""{q.WITH('v_pairs')}
    SELECT grp, y, p, {q.average_rank('y', 'grp')} AS rank_y, {q.average_rank('p', 'grp')} AS rank_p FROM v_pairs""",
)
def rank_average(spark, sf):
    ranked = ranking.average_rank(load(spark, sf, "v_pairs"), "y", ["grp"], "rank_y")
    return ranking.average_rank(ranked, "p", ["grp"], "rank_p")


@query(
    "split_order",
    f"""{q.WITH('v_features')} SELECT vec_id,
    row_number() OVER (ORDER BY {q.md5(str(SEED), 'vec_id')}, vec_id) AS position FROM v_features""",
)
def split_order(spark, sf):
    return ranking.random_order(load(spark, sf, "v_features").select("vec_id"), "vec_id", SEED)


def _split_query(name: str, test: float, val: float, group: str | None):
    source = "(SELECT vec_id, cancer_type FROM v_features)"
    sql = f"{q.WITH('v_features')} {q.split(source, 'vec_id', test, val, SEED, group)}"

    @query(name, sql)
    def run(spark, sf):
        rows = load(spark, sf, "v_features").select("vec_id", "cancer_type")
        return split_three_way(rows, "vec_id", test, val, SEED, [group] if group else [])

@query("best_trial", f"""{q.WITH('v_trials')} SELECT trial_number, {r6('val_spearman')} AS val_spearman FROM v_trials
    WHERE NOT isnan(val_spearman) ORDER BY v_trials.val_spearman DESC, trial_number LIMIT 1""")
def best(spark, sf):
    return rounded(best_trial(load(spark, sf, "v_trials")), "val_spearman")


for _arguments in (
    ("split_three_way", 0.2, 0.2, None),
    ("split_search", 0.1, 0.1, None),
    ("split_per_group", 0.2, 0.2, "cancer_type"),
):
    _split_query(*_arguments)


def _integer_sql(low: int, high: int, *parts: str) -> str:
    return f"({low} + {q.md5_long(*parts)} % {high - low + 1})"


def space_sql(trial: str) -> str:
    """The drawn parameters of a trial; layer widths as text joined by '-'."""
    layers = _integer_sql(2, 5, str(SEED), "'n_layers'", trial)
    width = _integer_sql(64, 1024, str(SEED), "'n_units'", "i", trial)
    return f"""
        list_extract([64, 128, 256], CAST({q.md5_long(str(SEED), "'batch_size'", trial)} % 3 AS INT) + 1) AS batch_size,
        round({q.double(1e-4)} * pow({q.double(1e-2 / 1e-4)}, {q.md5_unit(str(SEED), "'learning_rate'", trial)}), 9)
            AS learning_rate,
        array_to_string(list_transform(range({layers}), lambda i: {width}), '-') AS hidden_dims"""


def space_text(space: DataFrame) -> DataFrame:
    return space.withColumn("learning_rate", F.round("learning_rate", 9)).withColumn(
        "hidden_dims", F.array_join("hidden_dims", "-")
    )


@query("search_space", f"SELECT vec_id AS trial_number, {space_sql('vec_id')} FROM embeddings")
def space(spark, sf):
    trials = load(spark, sf, "v_features").select(F.col("vec_id").alias("trial_number"))
    return space_text(search_space(trials, SEED))


_TRIAL_PREDICTIONS = f"""
    trial_rows AS (SELECT CAST(round(y * 10) AS BIGINT) AS trial_number, vec_id, p AS y, sin(vec_id) AS p
                   FROM v_pairs_keyed),
    trial_split AS ({q.split('trial_rows', 'vec_id', 0.4, 0.6, SEED)}),
    predictions AS (SELECT CAST(trial_number AS VARCHAR) AS model, split, y, p FROM trial_split)"""
_TRIAL_PICKS = {
    "val_r2_final": ("val", "r2"),
    "mse_final": ("val", "mse"),
    "val_spearman": ("val", "spearman"),
    "test_r2_final": ("test", "r2"),
    "test_spearman": ("test", "spearman"),
}


@query(
    "trial_table",
    f"""{q.WITH('v_pairs_keyed')}, {_TRIAL_PREDICTIONS},
    keyed AS (SELECT model || '|' || split AS g, * FROM predictions),
    errors AS (SELECT g, model, split, {q.MSE} AS mse, {q.R2} AS r2 FROM keyed GROUP BY ALL),
    scores AS (SELECT errors.*, spearman FROM errors JOIN ({q.spearman('keyed', 'g')}) USING (g))
    SELECT CAST(model AS BIGINT) AS trial_number, {space_sql('CAST(model AS BIGINT)')},
           {', '.join(f'''{r6(f"max({v}) FILTER (split = '{s}')")} AS {n}''' for n, (s, v) in _TRIAL_PICKS.items())}
    FROM scores GROUP BY model""",
)
def trials(spark, sf):
    pairs = load(spark, sf, "v_pairs_keyed").select(
        F.round(F.col("y") * 10).cast("bigint").alias("trial_number"),
        "vec_id",
        F.col("p").alias("y"),
        F.sin(F.col("vec_id").cast("double")).alias("p"),
    )
    rows = split_three_way(pairs, "vec_id", 0.4, 0.6, SEED)
    predictions = materialize(rows.withColumn("model", F.col("trial_number").cast("string")), "trial_predictions")
    drawn = search_space(predictions.select("trial_number").distinct(), SEED)
    return rounded(space_text(trial_table(drawn, predictions)), *_TRIAL_PICKS)
