"""Row-local work in Arrow batches, and the few columns that all text operators share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: White space of the contracts: the bytes that ``bytes.split`` splits on.
WORD = r"[^\x20\x09-\x0D]+"

Work = Callable[[list], Sequence]

ROWS_AT_ONCE = 1_000  # rows of a batch whose Python values are held together


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def key_remainder(key: Column, divisor: int) -> Column:
    """crc32 of a key's decimal text, modulo ``divisor``; a null key counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % divisor


def add_columns(df: DataFrame, column: str, make: Callable[[], Work], fields: Sequence[T.StructField], keep: Sequence[str], as_arrow: bool = False) -> DataFrame:
    """The ``keep`` columns of ``df`` and new ones computed from ``column``, some rows of an Arrow batch at a time.

    ``make`` runs once in each task and returns a function from the values of a batch to one
    sequence of results per field; with ``as_arrow`` it gets them as an Arrow array. A kept column with the name of a field gives way to the field.
    """
    taken = {f.name.lower() for f in fields}
    names = [c for c in keep if c.lower() not in taken]
    source = df.select(*[df[f"`{c}`"] for c in names], df[f"`{column}`"].alias("_input"))
    schema = T.StructType([*source.schema.fields[:-1], *fields])
    types = to_arrow_schema(T.StructType(list(fields)))

    def run(batches):
        work = make()
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(start, ROWS_AT_ONCE)
                values = batch.column(batch.num_columns - 1)
                results = work(values if as_arrow else values.to_pylist())
                added = [pa.array(r, type=f.type, from_pandas=False) for r, f in zip(results, types)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *added], names=[*names, *types.names])

    return source.mapInArrow(run, schema)


def field(name: str, kind: str) -> T.StructField:
    return T.StructField(name, T._parse_datatype_string(kind))
