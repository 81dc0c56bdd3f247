import numpy as np
import pytest
from pyspark.sql import functions as F

from dosecast.operators import linear, neural
from dosecast.operators.early_stop import best_trial, early_stop_epoch
from dosecast.operators.features import content_keys
from dosecast.operators.split import split_three_way
from dosecast.plans import modeling, queries_models, search
from dosecast.plans.space import Space
from dosecast.plans.views import CANCER_TYPES
from dosecast.session import materialize, scratch_path
from dosecast.sources import tables

WIDTH = 6


@pytest.fixture(scope="module")
def planted(spark):
    """900 rows with a smooth signal; two thirds of them are one cancer type."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(900, WIDTH))
    y = 0.5 + x @ np.array([0.4, -0.3, 0.2, 0.0, 0.1, 0.0]) + 0.3 * np.abs(x[:, 0]) + rng.normal(0, 0.05, 900)
    kind = np.where(np.arange(900) % 3 > 0, "Lung Cancer", np.where(np.arange(900) % 2 > 0, "Leukemia", "Skin Cancer"))
    rows = [(i, x[i].tolist(), float(y[i]), kind[i]) for i in range(900)]
    df = spark.createDataFrame(rows, "row_id long, features array<float>, AUC double, cancer_type string")
    return materialize(df, "planted")


def split_of(planted):
    return materialize(split_three_way(planted.withColumnRenamed("AUC", "y"), "row_id"), "split")


def arrays(df):
    part = df.toPandas()
    return np.array(part["features"].to_list(), dtype=float), part["y"].to_numpy()


def test_least_squares_per_group_and_overall(planted):
    rows = split_of(planted)
    for group in (None, "cancer_type"):
        model = linear.fit_linear(rows, group)
        for fitted in model.collect():
            part = rows if group is None else rows.filter(F.col(group) == fitted[group])
            x, y = arrays(part)
            want = np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), y, rcond=None)[0]
            assert np.allclose([fitted["intercept"], *fitted["coefficients"]], want, atol=1e-8)
            assert fitted["n"] == len(y) and fitted["rank"] == WIDTH


def test_partial_moments_may_be_handed_on_early(planted, monkeypatch):
    rows = split_of(planted)
    whole = {r["cancer_type"]: r for r in linear.fit_linear(rows, "cancer_type").collect()}
    monkeypatch.setattr(linear, "HELD_CELLS", 1)
    for r in linear.fit_linear(rows, "cancer_type").collect():
        want = whole[r["cancer_type"]]
        assert np.allclose(r["coefficients"], want["coefficients"]) and r["n"] == want["n"]


def test_too_few_rows_give_the_minimum_norm_fit(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(4, 10)), rng.normal(size=4)
    df = spark.createDataFrame([(x[i].tolist(), float(y[i])) for i in range(4)], "features array<double>, y double")
    fitted = linear.fit_linear(df).first()
    want = np.linalg.pinv(x - x.mean(axis=0)) @ (y - y.mean())
    assert np.allclose(fitted["coefficients"], want, atol=1e-7) and fitted["rank"] == 3


def test_large_models_are_joined_instead_of_shipped(planted, monkeypatch):
    rows = split_of(planted)
    model = linear.fit_linear(rows, "cancer_type")
    shipped = linear.predict_linear(model, rows, "cancer_type").select("row_id", "p").toPandas()
    monkeypatch.setattr(linear, "SHIPPED_CELLS", 0)
    joined = linear.predict_linear(model, rows, "cancer_type").select("row_id", "p").toPandas()
    both = shipped.merge(joined, on="row_id")
    assert len(both) == 900 and np.allclose(both["p_x"], both["p_y"])


def test_vectors_of_unequal_length_are_refused(spark):
    df = spark.createDataFrame([([1.0, 2.0], 1.0), ([1.0], 2.0)], "features array<double>, y double")
    with pytest.raises(Exception, match="(?i)dimension|vector must have"):
        linear.fit_linear(df)


def test_gradient_matches_finite_differences():
    spec = neural.NetSpec("m", hidden=(5, 4), learning_rate=1e-3, seed=1)
    state = neural.NetState.fresh(spec, 3)
    state.theta = state.theta.astype(np.float64)
    state.first, state.second = np.zeros_like(state.theta), np.zeros_like(state.theta)
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(8, 3)), rng.normal(size=8)
    shapes, before = spec.shapes(3), state.theta.copy()
    numeric = []
    for k in range(len(before)):
        up, down = before.copy(), before.copy()
        up[k] += 1e-6
        down[k] -= 1e-6
        losses = [neural.batch_loss(x, y, neural.layers(t, shapes)) for t in (up, down)]
        numeric.append((losses[0] - losses[1]) / 2e-6)
    neural.adam_step(state, x, y)
    assert np.allclose(state.first / (1 - neural.DECAY_1), numeric, atol=1e-5)


@pytest.mark.parametrize("rows_per_part", [neural.NetSpec.rows_per_part, 160])
def test_networks_learn_planted_signal(planted, rows_per_part):
    rows = split_of(planted)
    specs = [
        neural.NetSpec("deep", hidden=(32, 16), batch_size=32, max_epochs=25, learning_rate=5e-3, rows_per_part=rows_per_part),
        neural.mlp_spec("flat", max_epochs=25, learning_rate=1e-2, batch_size=32, rows_per_part=rows_per_part),
    ]
    models = neural.fit_networks(rows, specs, "row_id")
    scored = neural.predict_networks(rows.filter("split = 'test'"), models, "row_id").toPandas()
    for _, part in scored.groupby("model"):
        assert len(part) == 180
        assert ((part["y"] - part["p"]) ** 2).mean() < 0.25 * part["y"].var()
    losses = neural.epoch_losses(rows.sparkSession, models).filter("model = 'deep'").orderBy("epoch").collect()
    assert [r["epoch"] for r in losses] == list(range(1, len(losses) + 1)) and len(losses) == models["deep"].epochs
    assert losses[-1]["val_loss"] < losses[0]["val_loss"]


@pytest.mark.parametrize("rows_per_part", [neural.NetSpec.rows_per_part, 160])
def test_early_stopping_follows_the_recorded_losses(planted, rows_per_part):
    rows = split_of(planted)
    spec = neural.NetSpec("m", hidden=(16,), batch_size=64, max_epochs=60, learning_rate=0.05, patience=3, rows_per_part=rows_per_part)
    models = neural.fit_networks(rows, [spec], "row_id")
    losses = neural.epoch_losses(rows.sparkSession, models)
    stop = early_stop_epoch(losses, ["model"], 3, loss="val_loss").first()
    assert stop["stop_epoch"] == models["m"].epochs
    assert stop["stopped_early"] == (models["m"].epochs < 60)


def test_training_is_repeatable_and_survives_saving(spark, planted):
    rows = split_of(planted)
    spec = neural.NetSpec("m", hidden=(8,), max_epochs=3)
    first = neural.fit_networks(rows, [spec], "row_id")["m"]
    again = neural.fit_networks(rows.repartition(5), [spec], "row_id")["m"]
    assert np.array_equal(first.theta, again.theta)
    path = scratch_path(spark, "network")
    neural.save_network(spark, first, path)
    loaded = neural.load_network(spark, path)
    assert loaded.spec == first.spec and np.array_equal(loaded.theta, first.theta)


@pytest.mark.parametrize("rows_per_part", [neural.NetSpec.rows_per_part, 160])
def test_weights_depend_on_neither_tasks_nor_batches(spark, planted, monkeypatch, rows_per_part):
    rows = split_of(planted)
    spec = neural.NetSpec("m", hidden=(8,), batch_size=32, max_epochs=4, rows_per_part=rows_per_part)
    want = neural.fit_networks(rows, [spec], "row_id")["m"].theta
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    try:
        spark.conf.set(batch, "50")
        monkeypatch.setattr(neural, "TASKS_PER_CORE", 0)  # a single task for all parts
        got = neural.fit_networks(rows.repartition(3), [spec], "row_id")["m"].theta
    finally:
        spark.conf.set(batch, before)
    assert np.allclose(got, want, rtol=0, atol=1e-6)


def test_many_networks_are_applied_in_several_scans(planted, monkeypatch):
    rows = split_of(planted)
    specs = [neural.NetSpec(str(i), hidden=(4,), max_epochs=1, seed=i) for i in range(3)]
    models = neural.fit_networks(rows, specs, "row_id")
    at_once = neural.predict_networks(rows, models, "row_id").toPandas()
    monkeypatch.setattr(neural, "DRIVER_CELLS", 1)
    in_waves = neural.predict_networks(rows, models, "row_id").toPandas()
    order = ["model", "row_id"]
    assert at_once.sort_values(order, ignore_index=True).equals(in_waves.sort_values(order, ignore_index=True))


def test_predictions_without_a_vector_or_model_are_null_either_way(spark, planted, monkeypatch):
    model = linear.fit_linear(split_of(planted), "cancer_type")
    rows = spark.createDataFrame(
        [
            (0, [1.0] * WIDTH, "Lung Cancer"),
            (1, None, "Lung Cancer"),
            (2, [1.0], "Lung Cancer"),
            (3, [1.0] * WIDTH, "Unseen"),
            (4, [float("nan")] * WIDTH, "Lung Cancer"),
            (5, [1.0] * WIDTH, None),
        ],
        "row_id long, features array<float>, cancer_type string",
    )
    found = []
    for cells in (linear.SHIPPED_CELLS, 0):
        monkeypatch.setattr(linear, "SHIPPED_CELLS", cells)
        got = {r["row_id"]: r["p"] for r in linear.predict_linear(model, rows, "cancer_type").collect()}
        assert [k for k in sorted(got) if got[k] is None] == [1, 2, 3, 5] and np.isnan(got[4])
        found.append(got[0])
    assert np.isclose(*found)


def test_a_factor_is_handed_on_once_per_task(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(x.tolist(), float(x[0]), f"g{i % 3}") for i, x in enumerate(rng.normal(size=(90, 4)))]
    df = spark.createDataFrame(rows, "features array<double>, y double, kind string").repartition(2)
    monkeypatch.setattr(linear, "HELD_CELLS", 1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
        handed = linear.factor_rows(df, "kind", "features", "y", 4, np.zeros(5), 2).filter("_row = 0").count()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert handed <= 2 * 3


def test_constant_features_have_no_slope(spark):
    rows = [(i, [0.1, 1 / 3, 7e8 + 0.1], float(i % 5), "a" if i % 2 else "b") for i in range(333)]
    df = spark.createDataFrame(rows, "row_id long, features array<double>, y double, kind string").repartition(5)
    for got in linear.fit_linear(df, "kind").collect():
        assert got["rank"] == 0 and not any(got["coefficients"]) and got["intercept"] == pytest.approx(2, abs=0.02)


def test_collinear_wide_vectors_agree_with_a_dense_solve(spark):
    rng = np.random.default_rng(8)
    for width, n in ((3072, 150), (40, 300)):
        base = rng.normal(size=(n, 20)) * np.logspace(0, -5, 20)  # squared, the smallest would drown
        x = np.concatenate([base @ rng.normal(size=(20, width - 20)), base], axis=1) + 3.0
        y = base @ rng.normal(size=20) * 10 + 1.0
        rows = spark.createDataFrame([(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y))], "row_id long, features array<double>, y double")
        model = linear.fit_linear(rows.repartition(6))
        centred = x - x.mean(axis=0)
        want = np.linalg.lstsq(centred, y - y.mean(), rcond=np.finfo(float).eps * max(n, width))[0]
        got = model.first()
        assert got["n"] == n and got["rank"] == 20
        p = np.array([r["p"] for r in linear.predict_linear(model, rows).orderBy("row_id").collect()])
        assert np.abs(p - (y.mean() + centred @ want)).max() < 1e-8 and np.abs(np.array(got["coefficients"]) - want).max() < 1e-8


def test_early_stop_epoch(spark):
    losses = {"a": [5, 4, 4, 4.5, 3], "b": [5, 4, 3, 2], "c": [1, 2, 3, 0.5]}
    rows = [(k, i + 1, float(v)) for k, vs in losses.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "run string, epoch int, epoch_loss double")
    got = {r["run"]: (r["stop_epoch"], r["stopped_early"]) for r in early_stop_epoch(df, ["run"], 2).collect()}
    assert got == {"a": (4, True), "b": (4, False), "c": (3, True)}


def test_best_trial_ignores_nan_and_prefers_the_earliest(spark):
    rows = [(0, float("nan")), (1, 0.5), (2, 0.7), (3, 0.7), (4, None)]
    df = spark.createDataFrame(rows, "trial_number int, val_spearman double")
    assert best_trial(df).first()["trial_number"] == 2
    assert best_trial(df.filter("trial_number = 0")).first() is None


def test_unknown_model_is_an_error():
    with pytest.raises(ValueError, match="Unknown model: forest"):
        modeling.chosen_models("forest")
    assert modeling.chosen_models("all") == ["linear", "xgboost", "mlp", "custom"]


def test_all_models_by_group(planted):
    settings = modeling.Settings(n_bootstrap=20, boosted_rounds=4, mlp_epochs=80, dnn_epochs=80)
    groups = ["Lung Cancer", "Leukemia", "Brain Cancer"]
    table = modeling.run_models(planted, "all", groups, settings=settings).toPandas()
    assert sorted(table["cancer_type"].unique()) == ["Leukemia", "Lung Cancer"]
    assert len(table) == 8 and table.notna().all().all()
    assert dict(zip(table["model_name"], table["model_label"])) == modeling.MODEL_LABELS
    assert (table["test_spearman"] > 0.4).all()
    assert modeling.groups_with_rows(planted, groups) == ["Lung Cancer", "Leukemia"]


def test_the_query_by_type_runs_all_models_in_full(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(queries_models, "features", lambda spark, sf: None)
    monkeypatch.setattr(modeling, "run_models", lambda *args: asked.append(args))
    queries_models.by_group_networks(spark, "")
    _, model, groups, _, settings = asked[0]
    assert modeling.chosen_models(model) == list(modeling.MODEL_LABELS) and list(groups) == list(CANCER_TYPES)
    assert (settings.boosted_rounds, settings.n_bootstrap) == (100, 1000)


def test_search_space_is_within_bounds(spark):
    rows = search.search_space(spark.range(400).withColumnRenamed("id", "trial_number"), 1).collect()
    assert {r["batch_size"] for r in rows} == {64, 128, 256}
    assert {len(r["hidden_dims"]) for r in rows} == {2, 3, 4, 5}
    widths = [w for r in rows for w in r["hidden_dims"]]
    assert min(widths) >= 64 and max(widths) <= 1024 and min(widths) < 100 and max(widths) > 980
    rates = np.log10([r["learning_rate"] for r in rows])
    assert -4 <= rates.min() < -3.9 and -2.1 < rates.max() <= -2 and abs(rates.mean() + 3) < 0.1


def test_search_keeps_the_best_trial(spark, planted):
    small = Space(layer_widths=(8, 24))
    found = search.run_search(planted, n_trials=7, epochs=4, seed=5, space=small, startup=3, wave=3)
    trials = found.trials.toPandas()
    assert sorted(trials["trial_number"]) == list(range(7)) and trials.notna().all().all()
    top = trials.sort_values(["val_spearman", "trial_number"], ascending=[False, True]).iloc[0]
    assert found.best_value == top["val_spearman"] and found.best_params["batch_size"] == top["batch_size"]
    assert list(found.best_model.spec.hidden) == list(top["hidden_dims"])
    folder = scratch_path(spark, "search")
    search.save_search(spark, found, folder)
    assert tables.read_best_params(spark, f"{folder}/best_params") == found.best_params
    assert np.array_equal(neural.load_network(spark, f"{folder}/best_model").theta, found.best_model.theta)


def test_bad_vectors_and_targets_are_counted_and_do_not_stop_a_run(spark):
    nan = float("nan")
    good = [(i, [float(i % 7), float(i % 5)], i % 7 + 0.5 * (i % 5), "x" if i % 2 else "y") for i in range(80)]
    bad = [(100, None, 1.0, "x"), (101, [1.0, nan], 1.0, "x"), (102, [1.0, None], 1.0, "y"), (103, [1.0, 2.0], None, "y"), (104, [1.0, 2.0], nan, "y")]
    df = spark.createDataFrame(good + bad, "row_id long, features array<double>, AUC double, cancer_type string")
    settings = modeling.Settings(n_bootstrap=5, mlp_epochs=2)
    whole = modeling.run_models(df, ["linear", "mlp"], settings=settings).collect()
    assert [r["quarantined"] for r in whole] == [5, 5]
    linear = next(r for r in whole if r["model_name"] == "linear")
    assert linear["test_mse"] == pytest.approx(0, abs=1e-12)
    by_type = modeling.run_models(df, "linear", ["x", "y"], settings=settings).collect()
    assert {r["cancer_type"]: r["quarantined"] for r in by_type} == {"x": 2, "y": 3}


def test_rows_without_a_key_get_one_each(spark):
    rows = [([1.0, 2.0], 0.5, "a"), ([1.0, 2.0], 0.5, "a"), ([1.0, 2.0], 0.5, None), ([2.0, 1.0], None, "a")]
    df = spark.createDataFrame(rows, "features array<double>, AUC double, label string")
    keyed = content_keys(df).collect()
    assert len(keyed) == 4 and len({r["row_id"] for r in keyed}) == 4
    assert content_keys(df).exceptAll(content_keys(df.repartition(3))).isEmpty()
    assert content_keys(df.limit(0)).isEmpty()


def test_an_adam_step_is_the_plain_one_in_little_room():
    import tracemalloc

    from dosecast.operators import neural

    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(32, 64)).astype(np.float32), rng.normal(size=32).astype(np.float32)
    state = neural.NetState.fresh(neural.NetSpec("a", hidden=(512, 512), l2=1e-3), 64)
    gradient = np.empty_like(state.theta)
    for step in range(1, 4):
        theta, first, second = state.theta.copy(), state.first.copy(), state.second.copy()
        tracemalloc.start()
        neural.adam_step(state, x, y, gradient)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 2 * state.theta.nbytes  # the penalty's product, activations and blocks; no copies of moments
        first += (1 - neural.DECAY_1) * (gradient - first)
        second += (1 - neural.DECAY_2) * (gradient * gradient - second)
        scale = state.spec.learning_rate * (1 - neural.DECAY_2**step) ** 0.5 / (1 - neural.DECAY_1**step)
        theta -= scale * first / (np.sqrt(second) + neural.EPSILON)
        assert all(np.array_equal(a, b) for a, b in ((theta, state.theta), (first, state.first), (second, state.second)))


def test_equal_vectors_have_equal_predictions(spark):
    rng = np.random.default_rng(8)
    kinds = rng.normal(size=(3, 64)).astype(np.float32)
    rows = [(i, kinds[i % 3].tolist(), float(i % 7)) for i in range(2003)]
    df = spark.createDataFrame(rows, "row_id long, features array<float>, y double").repartition(3)
    model = spark.createDataFrame([("all", 0.1, rng.normal(size=64).tolist())], "model_group string, intercept double, coefficients array<double>")
    assert linear.predict_linear(model, df).select("p").distinct().count() == 3


@pytest.mark.parametrize("kind", ["float", "double", "int"])
def test_rows_with_a_missing_cell_are_unusable(spark, kind):
    nan = float("nan")
    cells = [[1, 2], [None, 2], [1, None], None, [], *([] if kind == "int" else [[1, nan], [nan, None], [nan]])]
    rows = [(i, c if c is None or kind == "int" else [None if v is None else float(v) for v in c], 1.0) for i, c in enumerate(cells)]
    rows += [(20, rows[0][1], None), (21, rows[0][1], nan)]
    df = spark.createDataFrame(rows, f"row_id long, features array<{kind}>, AUC double")
    kept = df.filter(~modeling.unusable(df, modeling.Columns()))
    assert sorted(r["row_id"] for r in kept.collect()) == [0, 4]


def test_rows_of_few_groups_are_folded_as_they_come(spark):
    rng = np.random.default_rng(9)
    rows = [(x.tolist(), float(x[0] + x[1] * (i % 3)), f"g{i % 3}") for i, x in enumerate(rng.normal(size=(6000, 4)))]
    df = spark.createDataFrame(rows, "features array<double>, y double, kind string").repartition(2)
    plain = linear.factor_rows(df, "kind", "features", "y", 4, np.zeros(5), 2, groups=3)
    assert "Sort" not in plain._jdf.queryExecution().toString()
    assert plain.filter("_row = 0").count() <= 2 * 3
    for r in linear.fit_linear(df, "kind").collect():
        assert np.allclose(r["coefficients"], [1, int(r["kind"][1]), 0, 0], atol=1e-9) and r["n"] == 2000


def test_parts_are_averaged_by_their_rows_in_order():
    spec = neural.NetSpec("m", hidden=(3,))
    states = [neural.NetState.fresh(neural.NetSpec("m", hidden=(3,), seed=s), 2) for s in (1, 2)]
    tallies = [np.array([n, 0.5, 2, 0.25, 1]) for n in (30.0, 10.0)]
    batches = [b for part, (s, t) in enumerate(zip(states, tallies)) for b in neural.state_rows("m", part, s, t, None)]
    (row,) = neural.averaged(batches)
    want = (30 * states[0].theta.astype(float) + 10 * states[1].theta.astype(float)) / 40
    got = np.frombuffer(row.column("cells")[0].as_buffer(), np.float32)[: spec.parameters(2)]
    assert np.array_equal(got, want.astype(np.float32))
    assert [row.column(c)[0].as_py() for c in neural.TALLY] == [40, 1.0, 4, 0.5, 2]
    assert list(neural.averaged([])) == []
