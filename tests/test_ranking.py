import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dosecast.operators import lookup, ranking


@pytest.fixture(scope="module")
def skewed(spark):
    """20,000 rows; group 0 holds most of them and one value holds a third."""
    rng = np.random.default_rng(5)
    n = 20_000
    frame = pd.DataFrame(
        {
            "id": np.arange(n),
            "g": np.where(rng.random(n) < 0.7, 0, rng.integers(1, 40, n)).astype("int64"),
            "v": np.where(rng.random(n) < 0.34, 0.5, rng.random(n).round(3)),
        }
    )
    return frame, spark.createDataFrame(frame).repartition(6)


@pytest.mark.parametrize("window_rows", [10**6, 10])
@pytest.mark.parametrize("group", [[], ["g"]])
def test_average_rank(skewed, window_rows, group):
    frame, df = skewed
    got = ranking.average_rank(df, "v", group, window_rows=window_rows).toPandas().set_index("id")["rank"].sort_index()
    want = frame.groupby("g")["v"].rank() if group else frame["v"].rank()
    assert np.allclose(got.to_numpy(), want.to_numpy())


@pytest.mark.parametrize("window_rows", [10**6, 10])
def test_percentiles(skewed, window_rows):
    frame, df = skewed
    points = {"low": 0.025, "mid": 0.5, "high": 0.975, "top": 1.0}
    got = ranking.exact_percentiles(df, "v", points, ["g"], window_rows).toPandas().set_index("g").sort_index()
    for name, point in points.items():
        want = frame.groupby("g")["v"].quantile(point).sort_index()
        assert np.allclose(got[name].to_numpy(), want.to_numpy())
    whole = ranking.exact_percentiles(df, "v", points, [], window_rows).first()
    assert whole["mid"] == pytest.approx(np.percentile(frame["v"], 50))


@pytest.mark.parametrize("bucket_rows", [ranking.BUCKET_ROWS, 2])
def test_random_order_is_a_stable_permutation_per_group(skewed, monkeypatch, bucket_rows):
    _, df = skewed
    unpatched = ranking.random_order(df, "id", 1, ["g"]).select("id", "g", "position")
    monkeypatch.setattr(ranking, "BUCKET_ROWS", bucket_rows)
    assert ranking.random_order(df, "id", 1, ["g"]).select("id", "g", "position").exceptAll(unpatched).isEmpty()
    first = ranking.random_order(df, "id", 1, ["g"]).select("id", "g", "position").toPandas()
    again = ranking.random_order(df.repartition(11), "id", 1, ["g"]).select("id", "g", "position").toPandas()
    assert first.sort_values("id").reset_index(drop=True).equals(again.sort_values("id").reset_index(drop=True))
    for _, part in first.groupby("g"):
        assert sorted(part["position"]) == list(range(1, len(part) + 1))
    assert not first.sort_values(["g", "position"])["id"].is_monotonic_increasing


def test_sorted_order(skewed):
    _, df = skewed
    numbered = ranking.sorted_order(df.select("id"), ["id"]).toPandas()
    assert (numbered["id"] == numbered["row_no"]).all()


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_join_answers_hot_keys_apart(skewed, spark, how):
    frame, df = skewed
    table = spark.range(0, 30).select(F.col("id").alias("g"), (F.col("id") * 2).alias("twice"))
    plain = df.join(table, "g", how)
    for options in ({}, {"max_rows": 0}, {"max_rows": 0, "even": True}):
        joined = lookup.lookup_join(df, table, ["g"], how, **options)
        assert joined.count() == plain.count()
        assert joined.select(plain.columns).exceptAll(plain).isEmpty()


def test_broadcast_is_bounded_by_bytes(spark):
    wide = spark.range(100).select(F.array_repeat(F.lit(1.0), 1000).alias("v"))
    assert lookup.fits_broadcast(wide)
    assert not lookup.fits_broadcast(wide, max_bytes=100_000)
    assert not lookup.fits_broadcast(wide, max_rows=99)
