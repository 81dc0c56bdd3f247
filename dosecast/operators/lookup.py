"""Attaching a key-unique table to rows whose keys may be heavily skewed."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dosecast.session import materialize

BROADCAST_ROWS = 250_000
BROADCAST_BYTES = 64 << 20
HOT_FRACTION = 1000  # a key is hot when it holds more than 1/1000 of the rows
SALTS = 64  # copies of hot lookup rows that are too large to broadcast


def row_bytes(df: DataFrame) -> Column:
    """Estimated bytes of a row once it sits in a broadcast hash table."""
    total = F.lit(16)
    for field in df.schema:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            total = total + 16 + F.coalesce(F.octet_length(field.name), F.lit(0))
        elif isinstance(field.dataType, T.ArrayType):
            total = total + 16 + 8 * F.greatest(F.size(field.name), F.lit(0))
        else:
            total = total + 16
    return total


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """True when ``df`` is within both bounds; call it on written tables."""
    seen = df.limit(max_rows + 1).select(row_bytes(df).alias("_bytes"))
    found = seen.agg(F.count(F.lit(1)).alias("rows"), F.sum("_bytes").alias("bytes")).first()
    return found["rows"] <= max_rows and (found["bytes"] or 0) <= max_bytes


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    max_rows: int = BROADCAST_ROWS,
    key_counts: DataFrame | None = None,
    even: bool = False,
) -> DataFrame:
    """Join ``lookup`` (unique and non-null on ``keys``, already written) to ``rows``.

    A lookup of checked size is broadcast. A larger one is joined by shuffle, but
    rows of hot keys are answered by broadcasting their lookup rows only: fewer
    than ``HOT_FRACTION`` keys can each hold more than that share of the rows. Where even
    those are too large, they are copied ``SALTS`` times and met by salted rows. Rows with
    a null key match nothing and stay spread as they came.

    ``how`` is ``left`` or ``inner``. ``key_counts`` (keys, ``_count``) saves a pass
    over the rows where the counts are known; ``even`` says that no key is hot.
    """
    keys = list(keys)
    if fits_broadcast(lookup, max_rows):
        return rows.join(F.broadcast(lookup), keys, how)
    return shuffled_lookup(rows, lookup, keys, how, key_counts, even)


def shuffled_lookup(
    rows: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    how: str,
    key_counts: DataFrame | None = None,
    even: bool = False,
    written: bool = True,
) -> DataFrame:
    """The shuffle join of ``lookup_join``; ``written=False`` for a lookup that is still a plan."""
    if even:
        return rows.join(lookup, keys, how)
    if key_counts is None:
        key_counts = materialize(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_count")), "key_counts")
    total = key_counts.agg(F.sum("_count")).first()[0] or 0
    hot_keys = materialize(key_counts.filter(F.col("_count") > total / HOT_FRACTION).select(*keys), "hot_keys")
    if hot_keys.isEmpty():
        return cold_lookup(rows, lookup, keys, how)
    lookup = lookup if written else materialize(lookup, "lookup")
    hot_lookup = lookup.join(F.broadcast(hot_keys), keys, "left_semi")
    hot_rows = rows.join(F.broadcast(hot_keys), keys, "left_semi")
    if fits_broadcast(hot_lookup):
        # Dealt out, as whatever partitions they come from are merged by size before a hot key's rows are known.
        spark = rows.sparkSession
        hot_rows = hot_rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        hot_rows = hot_rows.join(F.broadcast(hot_lookup), keys, how)
    else:
        copies = hot_lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = hot_rows.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
        hot_rows = salted.join(copies.hint("shuffle_merge"), [*keys, "_salt"], how).drop("_salt")
    cold_rows = rows.join(F.broadcast(hot_keys), keys, "left_anti")
    return hot_rows.unionByName(cold_lookup(cold_rows, lookup, keys, how))


def cold_lookup(rows: DataFrame, lookup: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A shuffle join without hot keys; rows with a null key go on by their partition instead of all to one task."""
    if how != "left":
        return rows.join(lookup, keys, how)
    missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    spread = rows.withColumn("_spread", F.when(missing, F.spark_partition_id()).otherwise(F.lit(0)))
    return spread.join(lookup.withColumn("_spread", F.lit(0)), [*keys, "_spread"], how).drop("_spread")
