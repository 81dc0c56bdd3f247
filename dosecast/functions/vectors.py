"""Vector columns: ``array<float>`` inside, JSON text or wide columns at the edge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VECTOR_TYPE = "array<float>"


def fill_empty(text: Column) -> Column:
    """A missing prompt is embedded as the empty string."""
    return F.coalesce(text, F.lit(""))


def vector_to_json(vector: Column) -> Column:
    """JSON text of a vector; a failed (null) vector becomes the empty string."""
    return F.coalesce(F.to_json(vector), F.lit(""))


def json_to_vector(text: Column) -> Column:
    """Parse JSON text; anything but a non-empty list of finite numbers gives null."""
    parsed = F.from_json(text, VECTOR_TYPE)
    finite = F.forall(parsed, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when((F.size(parsed) > 0) & finite, parsed)


def vector_width(df: DataFrame, vector: str) -> int:
    """The longest vector, which is the number of columns of the wide form."""
    return df.agg(F.max(F.size(vector)).alias("n")).first()["n"] or 0


def wide_columns(vector: str, width: int) -> list[Column]:
    """``feature_1 .. feature_N`` as doubles; short vectors are padded with nulls."""
    return [F.get(F.col(vector), F.lit(i)).cast("double").alias(f"feature_{i + 1}") for i in range(width)]
