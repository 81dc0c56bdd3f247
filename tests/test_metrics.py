import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import functions as F

from dosecast.functions.tdist import two_sided_p
from dosecast.operators import metrics


def pairs_frame(n=600, seed=2):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 12, n) / 10.0
    return pd.DataFrame(
        {"id": np.arange(n), "g": np.where(rng.random(n) < 0.6, "hot", "cold"), "y": y, "p": y + rng.normal(0, 0.5, n)}
    )


def rank_corr(part):
    return np.corrcoef(part["y"].rank(), part["p"].rank())[0, 1]


def test_errors(spark):
    frame = pairs_frame()
    row = spark.createDataFrame(frame).agg(metrics.mse().alias("mse"), metrics.r2().alias("r2")).first()
    error = frame["y"] - frame["p"]
    assert row["mse"] == pytest.approx((error**2).mean())
    assert row["r2"] == pytest.approx(1 - (error**2).sum() / ((frame["y"] - frame["y"].mean()) ** 2).sum())


@pytest.mark.parametrize("p,want", [((2.0, 2.0), 1.0), ((1.0, 2.0), 0.0)])
def test_r2_of_a_constant_truth(spark, p, want):
    df = spark.createDataFrame([(2.0, x) for x in p], "y double, p double")
    assert df.agg(metrics.r2().alias("r2")).first()["r2"] == want


@pytest.mark.parametrize("window_rows", [10**6, 5])
def test_spearman(spark, window_rows):
    frame = pairs_frame()
    df = spark.createDataFrame(frame)
    got = {r["g"]: r for r in metrics.spearman(df, ["g"], window_rows=window_rows).collect()}
    for g, part in frame.groupby("g"):
        assert got[g]["spearman"] == pytest.approx(rank_corr(part)) and got[g]["n"] == len(part)
    whole = metrics.spearman(df, window_rows=window_rows).first()["spearman"]
    vectors = VectorAssembler(inputCols=["y", "p"], outputCol="x").transform(df)
    assert whole == pytest.approx(Correlation.corr(vectors, "x", "spearman").first()[0].toArray()[0, 1])


def test_spearman_edges(spark):
    rows = [("constant", 1.0, float(i)) for i in range(5)] + [("pair", 0.0, 1.0), ("pair", 1.0, 0.0)]
    rows += [("perfect", float(i), float(i) ** 3) for i in range(6)] + [("null", None, 1.0)]
    rows += [("broken", float(i), float("nan") if i == 2 else float(i)) for i in range(6)]
    df = spark.createDataFrame(rows, "g string, y double, p double")
    scored = metrics.with_spearman_p(metrics.spearman(df, ["g"]).withColumn("t", metrics.spearman_t()))
    got = {r["g"]: r for r in scored.collect()}
    assert got["constant"]["spearman"] is None
    assert got["pair"]["spearman"] == pytest.approx(-1) and got["pair"]["t"] is None
    assert got["perfect"]["spearman"] == pytest.approx(1) and got["perfect"]["spearman_p"] == pytest.approx(0, abs=1e-12)
    assert "null" not in got and math.isnan(got["broken"]["spearman"])
    one = spark.createDataFrame([(1.0, 1.0)], "y double, p double").agg(metrics.r2().alias("r2")).first()
    assert one["r2"] is None


@pytest.mark.parametrize(
    "t,dof,want",  # table values of Student's t
    [(2.228138851964939, 10, 0.05), (12.706204736432095, 1, 0.05), (2.750, 30, 0.010), (1.959963984540054, 10**7, 0.05)],
)
def test_t_tail(t, dof, want):
    r = t / math.sqrt(dof + t * t)
    assert two_sided_p(r, dof + 2) == pytest.approx(want, rel=2e-3)
    assert two_sided_p(0.0, 20) == pytest.approx(1.0)
    assert math.isnan(two_sided_p(0.5, 2))


@given(st.floats(-0.99, 0.99), st.integers(4, 3000))
def test_t_tail_is_the_integral_of_the_density(r, n):
    """The tail is the share of the integral of cos(u)^(n-3) over [0, pi/2] above asin|r|."""

    def integral(low):
        u = np.linspace(low, np.pi / 2, 20_001)
        f = np.cos(u).clip(0) ** (n - 3)
        return (f[0] + f[-1] + 4 * f[1:-1:2].sum() + 2 * f[2:-1:2].sum()) * (u[1] - u[0]) / 3

    assert two_sided_p(r, n) == pytest.approx(integral(math.asin(abs(r))) / integral(0.0), abs=1e-7)


def test_bootstrap_paths_agree_and_hold_the_estimate(spark, monkeypatch):
    df = spark.createDataFrame(pairs_frame(200))
    one = metrics.bootstrap_ci(df, "id", ["g"], 60, seed=3).orderBy("g").collect()
    many = metrics.bootstrap_ci(df, "id", ["g"], 60, seed=3, replicate_rows=0).orderBy("g").collect()
    for a, b in zip(one, many):
        assert a["ci_lower"] == pytest.approx(b["ci_lower"]) and a["ci_upper"] == pytest.approx(b["ci_upper"])
    estimates = {r["g"]: r["spearman"] for r in metrics.spearman(df, ["g"]).collect()}
    assert all(r["ci_lower"] < estimates[r["g"]] < r["ci_upper"] for r in one)
    shuffled = metrics.bootstrap_ci(df.repartition(9), "id", ["g"], 60, seed=3).orderBy("g").collect()
    assert shuffled == one
    monkeypatch.setattr(metrics, "BLOCK_DRAWS", 5000)
    mixed = metrics.bootstrap_ci(df, "id", ["g"], 60, seed=3, replicate_rows=100).orderBy("g").collect()  # one group of each kind
    for a, b in zip(one, mixed):
        assert a["ci_lower"] == pytest.approx(b["ci_lower"]) and a["ci_upper"] == pytest.approx(b["ci_upper"])


def test_replicates_equal_plain_draws(spark, monkeypatch):
    monkeypatch.setattr(metrics, "PART_DRAWS", 100)
    monkeypatch.setattr(metrics, "LEAST_REPLICATES", 3)
    rng = np.random.default_rng(6)
    frame = pd.DataFrame({"id": range(40), "g": ["a"] * 25 + ["b"] * 15, "y": rng.integers(0, 4, 40) / 2, "p": rng.integers(-2, 3, 40) * 0.0 + rng.integers(0, 5, 40)})
    frame.loc[30, "p"] = np.nan
    sizes = spark.createDataFrame([("a", 25), ("b", 15)], "g string, _n long")
    got = {(r["g"], r["rep"]): r["spearman"] for r in metrics.replicates_in_parts(spark.createDataFrame(frame), "id", sizes, ["g"], 10, 9).collect()}
    assert len(got) == 20
    digest = lambda *parts: hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()
    for g, part in frame.groupby("g"):
        ordered = part.assign(h=[digest(9, i) for i in part["id"]]).sort_values(["h", "id"])
        for rep in range(10):
            drawn = ordered.iloc[[int(digest(9, rep, i)[:15], 16) % len(ordered) for i in range(len(ordered))]]
            if drawn["p"].isna().any():
                assert math.isnan(got[g, rep])
            elif drawn["y"].nunique() == 1 or drawn["p"].nunique() == 1:
                assert got[g, rep] is None
            else:
                assert got[g, rep] == pytest.approx(rank_corr(drawn))


def test_bootstrap_of_nothing(spark):
    df = spark.createDataFrame([(1, "a", None, 1.0)], "id long, g string, y double, p double")
    assert metrics.bootstrap_ci(df, "id", ["g"], 10).collect() == [] and metrics.bootstrap_ci(df.limit(0), "id", ["g"], 10).collect() == []


def test_bootstrap_counts_dropped_replicates(spark):
    df = spark.createDataFrame([(i, 1.0, float(i)) for i in range(5)], "id long, y double, p double")
    row = metrics.bootstrap_ci(df, "id", n_bootstrap=20).first()
    assert row["replicates"] == 0 and row["dropped_replicates"] == 20 and row["ci_lower"] is None


def test_epoch_mean_counts_batches_alike(spark):
    rows = [(1, 0, 1.0), (1, 0, 3.0), (1, 1, 10.0), (2, 0, 4.0)]
    df = spark.createDataFrame(rows, "epoch int, batch int, loss double")
    got = {r["epoch"]: r["epoch_loss"] for r in metrics.loss_epoch_mean(df).collect()}
    assert got == {1: 6.0, 2: 4.0}


def test_metrics_table_has_one_row_per_model(spark):
    frame = pairs_frame()
    df = spark.createDataFrame(frame).withColumn("split", F.when(F.col("id") % 2 == 0, "val").otherwise("test"))
    scores = metrics.score_predictions(df.withColumnRenamed("g", "model"), ["model", "split"], "id", n_bootstrap=30)
    table = metrics.metrics_table(scores, ["model"]).toPandas()
    assert len(table) == 2 and table.notna().all().all()
    want = frame[(frame["g"] == "hot") & (frame["id"] % 2 == 1)]
    hot = table[table["model"] == "hot"].iloc[0]
    assert hot["test_spearman"] == pytest.approx(rank_corr(want))
    assert hot["test_ci_lower"] < hot["test_spearman"] < hot["test_ci_upper"]


@pytest.mark.parametrize("n", [1e9, 1e12, 1e13, 1e14])
@pytest.mark.parametrize("z", [0.0, 0.5, 2.0, 6.0])
def test_tail_over_many_rows_is_the_normal_one(n, z):
    assert two_sided_p(z / math.sqrt(n), n) == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-6)


def test_tail_has_no_step_where_the_method_changes():
    for z in (0.5, 2.0, 6.0):
        below, above = (two_sided_p(z / math.sqrt(n), n) for n in (1e6, 1e6 + 1))
        assert below == pytest.approx(above, rel=1e-7)


@pytest.mark.parametrize("bundle_rows", [2_000_000, 2_100])
def test_groups_share_the_hashes_of_their_draws(spark, monkeypatch, bundle_rows):
    monkeypatch.setattr(metrics, "BUNDLE_ROWS", bundle_rows)
    hashes = metrics.draw_hashes(9, 3, 40)
    assert [int(h) for h in hashes] == [int(hashlib.md5(f"9:3:{i}".encode()).hexdigest()[:16], 16) >> 4 for i in range(40)]
    frame = pairs_frame(90)
    frame["g"] = np.where(frame["id"] < 50, "many", np.where(frame["id"] < 70, "few", "as few"))
    pairs = spark.createDataFrame(frame)
    packed = {r["g"]: r for r in metrics.value_classes(pairs, "id", ["g"], 9).collect()}
    assert {g: r["_n"] for g, r in packed.items()} == {"many": 50, "few": 20, "as few": 20}
    sizes = pairs.groupBy("g").agg(F.count(F.lit(1)).alias("_n"))
    got = {(r["g"], r["rep"]): r["spearman"] for r in metrics.replicates_in_parts(pairs, "id", sizes, ["g"], 12, 9).collect()}
    assert len(got) == 36
    for g in packed:
        alone = metrics.replicates_in_parts(pairs.filter(F.col("g") == g), "id", sizes.filter(F.col("g") == g), ["g"], 12, 9)
        assert all(got[g, r["rep"]] == r["spearman"] for r in alone.collect())


@pytest.mark.parametrize("n", [0, 7, 1000, 1001, 25_000, 110_003])
def test_numbers_digested_side_by_side_have_the_same_md5(n):
    plain = [int(hashlib.md5(f"42:17:{i}".encode()).hexdigest()[:16], 16) >> 4 for i in range(n)]
    assert metrics.draw_hashes(42, 17, n).tolist() == plain


def test_a_long_message_is_digested_plainly():
    seed = 10**52
    assert metrics.draw_hashes(seed, 3, 1002)[-1] == int(hashlib.md5(f"{seed}:3:1001".encode()).hexdigest()[:16], 16) >> 4


def test_no_draw_of_a_group_of_half_a_million_rows_is_shuffled(spark, monkeypatch):
    monkeypatch.setattr(metrics.BootstrapRows, "draws", lambda self, replicates: pytest.fail("draws left their task"))
    y, noise = (F.col("id") % 11).cast("double"), (F.xxhash64("id") % 1000).cast("double") / 100
    rows = spark.range(500_000).select("id", y.alias("y"), (y + noise).alias("p"))
    row = metrics.bootstrap_ci(rows, "id", n_bootstrap=4).first()
    estimate = metrics.spearman(rows).first()["spearman"]
    assert row["replicates"] == 4 and row["ci_lower"] < row["ci_upper"] and abs(row["ci_lower"] - estimate) < 0.01
