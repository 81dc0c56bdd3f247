"""Exact, reproducible three-way splits, overall or inside groups.

Each group is ordered by the md5 of (seed, key). The first ceil(test * n) rows are
the test set, the next ceil(val / (1 - test) * rest) the validation set, the others
the training set. Rows are not sorted for this: the two cut keys of a group are
found from bucket counts plus one bucket each, and every row is then compared with
them in place, so wide rows never move.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dosecast.operators.lookup import lookup_join
from dosecast.operators.ranking import bucket_digits, bucket_offsets, hash_buckets, largest_group
from dosecast.session import materialize

ALL_ROWS = "_all"


def split_sizes(total: str, test_size: float, val_size: float) -> tuple[Column, Column]:
    """Sizes of the test and the validation set for a column of row counts."""
    test = F.ceil(F.lit(float(test_size)) * F.col(total))
    relative = float(val_size) / (1.0 - float(test_size))
    return test, F.ceil(F.lit(relative) * (F.col(total) - test))


def split_cuts(hashed: DataFrame, key: str, test_size: float, val_size: float, group: Sequence[str]) -> DataFrame:
    """Per group: the (hash, key) of the last test row and of the last validation row."""
    group = list(group)
    hashed = hashed.select(*group, key, "_hash", "_bucket")
    test, val = split_sizes("_total", test_size, val_size)
    positions = enumerate((test, test + val))
    cuts = F.array(*[F.struct(F.lit(i).alias("cut"), at.alias("at")) for i, at in positions])
    within = F.col("_cut.at") - F.col("_before")
    boundaries = (
        bucket_offsets(hashed.select(*group, "_bucket"), group)
        .withColumn("_cut", F.explode(cuts))
        .filter((within > 0) & (within <= F.col("_in_bucket")))
        .groupBy(*group, "_bucket")
        .agg(F.collect_list(F.struct("_cut.cut", within.alias("at"))).alias("_cuts"))
    )
    # Only the rows of at most two buckets per group are ordered.
    in_bucket = Window.partitionBy(*group, "_bucket").orderBy("_hash", key)
    cut_rows = (
        lookup_join(hashed, materialize(boundaries, "boundaries"), [*group, "_bucket"], "inner", even=True)
        .withColumn("_local", F.row_number().over(in_bucket))
        .withColumn("_cut", F.explode("_cuts"))
        .filter(F.col("_local") == F.col("_cut.at"))
    )
    last = F.struct(F.col("_hash"), F.col(key).alias("_key"))
    return cut_rows.groupBy(*group).agg(
        F.max(F.when(F.col("_cut.cut") == 0, last)).alias("_test_cut"),
        F.max(F.when(F.col("_cut.cut") == 1, last)).alias("_val_cut"),
    )


def split_three_way(
    df: DataFrame,
    key: str,
    test_size: float = 0.2,
    val_size: float = 0.2,
    seed: int = 42,
    group: Sequence[str] = (),
    column: str = "split",
) -> DataFrame:
    """Add ``split`` = train / val / test. ``key`` is unique; ``group`` is non-null."""
    grouped = df if group else df.withColumn(ALL_ROWS, F.lit(0))
    by = list(group) or [ALL_ROWS]
    hashed = hash_buckets(grouped, key, seed, bucket_digits(largest_group(grouped.select(*by, key), by)))
    cuts = materialize(split_cuts(hashed, key, test_size, val_size, by), "split_cuts")
    here = F.struct(F.col("_hash"), F.col(key).alias("_key"))
    name = F.when(here <= F.col("_test_cut"), "test").when(here <= F.col("_val_cut"), "val").otherwise("train")
    return (
        lookup_join(hashed, cuts, by)
        .withColumn(column, name)
        .drop("_hash", "_bucket", "_test_cut", "_val_cut", ALL_ROWS)
    )
