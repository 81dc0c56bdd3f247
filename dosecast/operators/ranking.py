"""Positions and ranks over a whole table, without ever sorting it in one task."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dosecast.functions.hashing import md5_long
from dosecast.operators.lookup import BROADCAST_ROWS, fits_broadcast, lookup_join, shuffled_lookup
from dosecast.session import materialize

# One task orders whole groups only while all groups together are known to be this small.
WINDOW_ROWS = 1_000_000
PIECE_ROWS = 2_000_000  # distinct values that one task orders beyond that
BUCKET_ROWS = 2_000  # about the rows of the largest group that share an md5 bucket, up to 16 times more
MAX_DIGITS = 5
HASH_BITS = 60


def largest_group(df: DataFrame, group: Sequence[str]) -> int:
    """Rows of the largest group."""
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")) if group else df.agg(F.count(F.lit(1)).alias("_n"))
    return sizes.agg(F.max("_n")).first()[0] or 0


def bucket_digits(rows: int) -> int:
    """Hex digits of the md5 that cut a group of ``rows`` rows into small even buckets."""
    digits = 0
    while digits < MAX_DIGITS and rows > BUCKET_ROWS * 16 ** (digits + 1):
        digits += 1
    return digits


def hash_buckets(df: DataFrame, key: str, seed: int, digits: int) -> DataFrame:
    """Add the md5 order key (its leading 60 bits) and its bucket (its leading ``digits``)."""
    return df.withColumn("_hash", md5_long(seed, F.col(key))).withColumn(
        "_bucket", F.shiftright("_hash", HASH_BITS - 4 * digits).cast("int")
    )


def bucket_offsets(hashed: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Rows per (group, bucket), rows in earlier buckets, and rows of the group.

    Both windows run over the pre-aggregated buckets of a group, whose number is bounded.
    """
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    earlier = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return (
        hashed.groupBy(*group, "_bucket")
        .agg(F.count(F.lit(1)).alias("_in_bucket"))
        .withColumn("_before", F.coalesce(F.sum("_in_bucket").over(earlier), F.lit(0)))
        .withColumn("_total", F.sum("_in_bucket").over(whole))
    )


def random_order(
    df: DataFrame, key: str, seed: int, group: Sequence[str] = (), position: str = "position"
) -> DataFrame:
    """Number the rows 1..n of each group in md5 order of a unique key.

    Rows are sorted only inside even hash buckets, so a hot group is spread over
    all tasks; the join to the bucket offsets reuses the window's shuffle.
    """
    group = list(group)
    hashed = hash_buckets(df, key, seed, bucket_digits(largest_group(df.select(*group, key), group)))
    local = hashed.withColumn(
        "_local", F.row_number().over(Window.partitionBy(*group, "_bucket").orderBy("_hash", key))
    )
    offsets = bucket_offsets(hashed.select(*group, "_bucket"), group).drop("_in_bucket", "_total")
    return (
        local.join(offsets, [*group, "_bucket"])
        .withColumn(position, (F.col("_before") + F.col("_local")).cast("bigint"))
        .drop("_hash", "_bucket", "_local", "_before")
    )


def sorted_order(df: DataFrame, order: Sequence[str], position: str = "row_no") -> DataFrame:
    """Number all rows 0..n-1 in the order of a unique key, range partition by range partition."""
    ranged = (
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_mid", F.monotonically_increasing_id())
    )
    ranged = materialize(ranged, "sorted")
    part = F.shiftrightunsigned("_mid", 33)
    local = F.col("_mid").bitwiseAND((1 << 33) - 1)
    # One row per range partition.
    sizes = ranged.groupBy(part.alias("_pid")).agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(
        sizes.select("_pid", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start")), "offsets"
    )
    return (
        lookup_join(ranged.withColumn("_pid", part), offsets, ["_pid"], "inner")
        .withColumn(position, (F.col("_start") + local).cast("bigint"))
        .drop("_mid", "_pid", "_start")
    )


def value_counts(df: DataFrame, value: str, group: Sequence[str]) -> DataFrame:
    """Rows per (group, value), written. A value that fills a third of the table is one
    row from here on."""
    rows = df.filter(F.col(value).isNotNull()).groupBy(*group, value)
    return materialize(rows.agg(F.count(F.lit(1)).alias("_count")), "value_counts")


def with_count_before(counts: DataFrame, value: str, group: Sequence[str], fits_task: bool) -> DataFrame:
    """Add ``_before``, the number of rows with smaller values of the group, to written counts.

    ``fits_task`` says that all of ``counts`` is known to fit one task.
    """
    group = list(group)
    by_group = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    preceding = (Window.unboundedPreceding, -1)
    if fits_task:
        before = F.sum("_count").over(by_group.orderBy(value).rowsBetween(*preceding))
        return counts.withColumn("_before", F.coalesce(before, F.lit(0)))

    # Range partitions cut every group, hot or not, into even pieces of its value order.
    shuffle_partitions = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = max(shuffle_partitions, -(-counts.count() // PIECE_ROWS))
    pieces = materialize(
        counts.repartitionByRange(wanted, *group, value).withColumn("_pid", F.spark_partition_id()), "value_ranges"
    )
    in_piece = Window.partitionBy("_pid", *group).orderBy(value).rowsBetween(*preceding)
    local = pieces.withColumn("_local", F.coalesce(F.sum("_count").over(in_piece), F.lit(0)))
    # Only the group that continues from an earlier piece has an offset, so there
    # is at most one such row per range partition.
    sizes = pieces.groupBy("_pid", *group).agg(F.sum("_count").alias("_size"))
    start = F.sum("_size").over(by_group.orderBy("_pid").rowsBetween(*preceding))
    offsets = materialize(
        sizes.withColumn("_start", start).filter("_start IS NOT NULL").select("_pid", *group, "_start"), "offsets"
    )
    return (
        lookup_join(local, offsets, ["_pid", *group])
        .withColumn("_before", F.col("_local") + F.coalesce("_start", F.lit(0)))
        .drop("_pid", "_local", "_start")
    )


@dataclass
class RankTable:
    """Average ranks per (group, value), ready to be joined to rows."""

    ranks: DataFrame
    counts: DataFrame
    keys: list[str]
    small: bool

    def attach(self, rows: DataFrame) -> DataFrame:
        if self.small:
            return rows.join(F.broadcast(self.ranks), self.keys, "left")
        return shuffled_lookup(rows, self.ranks, self.keys, "left", key_counts=self.counts, written=False)


def average_rank_table(
    df: DataFrame, value: str, group: Sequence[str] = (), rank: str = "rank", window_rows: int = WINDOW_ROWS
) -> RankTable:
    """The average rank that equal values of a group share."""
    counts = value_counts(df, value, group)
    small = fits_broadcast(counts, min(window_rows, BROADCAST_ROWS))
    ranked = with_count_before(counts, value, group, small or counts.count() <= window_rows)
    ranks = ranked.select(*group, value, (F.col("_before") + (F.col("_count") + 1) / 2).alias(rank))
    return RankTable(ranks, counts, [*group, value], small)


def average_rank(
    df: DataFrame, value: str, group: Sequence[str] = (), rank: str = "rank", window_rows: int = WINDOW_ROWS
) -> DataFrame:
    """Add the average rank of ``value`` inside its group (ties share the mean)."""
    return average_rank_table(df, value, group, rank, window_rows).attach(df)


def exact_percentiles(
    df: DataFrame, value: str, points: dict[str, float], group: Sequence[str] = (), window_rows: int = WINDOW_ROWS
) -> DataFrame:
    """Linearly interpolated percentiles ``{column: fraction}`` of whole groups of any size.

    The two neighbours of each percentile are looked up by position among the
    distinct values, so no group is ever gathered.
    """
    group = list(group)
    counts = value_counts(df, value, group)
    sizes = materialize(counts.groupBy(*group).agg(F.sum("_count").alias("_n")), "sizes")
    ordered = with_count_before(counts, value, group, counts.count() <= window_rows)
    if group:
        placed = lookup_join(ordered, sizes, group, "inner")
    else:
        placed = ordered.withColumn("_n", F.lit(sizes.first()["_n"]))
    picks = []
    for name, fraction in points.items():
        at = F.lit(float(fraction)) * (F.col("_n") - 1)
        low, high = F.floor(at), F.ceil(at)

        def value_at(position: Column) -> Column:
            return F.max(
                F.when((position >= F.col("_before")) & (position < F.col("_before") + F.col("_count")), F.col(value))
            )

        share = F.max(at - low)
        picks.append((value_at(low) + share * (value_at(high) - value_at(low))).alias(name))
    return placed.groupBy(*group).agg(*picks)


def null_safe_corr(a: str, b: str) -> Column:
    """Pearson correlation; null when either side is constant."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
