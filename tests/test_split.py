import hashlib
import math

import pytest
from pyspark.sql import functions as F

from dosecast.operators import ranking
from dosecast.operators.split import split_three_way


def expected(ids, test, val, seed):
    ordered = sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))
    n_test = math.ceil(test * len(ordered))
    n_val = math.ceil(val / (1 - test) * (len(ordered) - n_test))
    return {i: "test" if k < n_test else "val" if k < n_test + n_val else "train" for k, i in enumerate(ordered)}


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 5003])
@pytest.mark.parametrize("sizes", [(0.2, 0.2), (0.1, 0.1), (0.33, 0.5)])
def test_whole_table(spark, n, sizes):
    rows = split_three_way(spark.range(n), "id", *sizes, seed=9).collect()
    assert {r["id"]: r["split"] for r in rows} == expected(range(n), *sizes, 9)


@pytest.mark.parametrize("n", [1, 5, 300, 5003])
def test_many_buckets(spark, monkeypatch, n):
    monkeypatch.setattr(ranking, "BUCKET_ROWS", 2)
    assert ranking.bucket_digits(5003) == 2 and ranking.bucket_digits(5) == 0
    rows = split_three_way(spark.range(n), "id", 0.2, 0.2, seed=9).collect()
    assert {r["id"]: r["split"] for r in rows} == expected(range(n), 0.2, 0.2, 9)


@pytest.mark.parametrize("bucket_rows", [ranking.BUCKET_ROWS, 2])
def test_groups_with_a_hot_one(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(ranking, "BUCKET_ROWS", bucket_rows)
    rows = spark.range(6000).withColumn("g", F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(
        F.concat(F.lit("g"), F.col("id") % 50)))
    got = split_three_way(rows, "id", seed=4, group=["g"]).collect()
    by_group = {}
    for r in got:
        by_group.setdefault(r["g"], {})[r["id"]] = r["split"]
    assert len(got) == 6000
    for members in by_group.values():
        assert members == expected(members, 0.2, 0.2, 4)


def test_partitioning_does_not_matter(spark):
    rows = spark.range(2000)
    a = split_three_way(rows.repartition(1), "id")
    b = split_three_way(rows.repartition(13), "id")
    assert a.exceptAll(b).isEmpty()
    assert split_three_way(rows, "id", seed=1).exceptAll(a).count() > 0


def test_wide_rows_are_not_shuffled(spark):
    rows = spark.range(1000).withColumn("features", F.array_repeat(F.lit(1.0), 10))
    plan = split_three_way(rows, "id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
