"""Ordinary least squares, overall or per group, by a tree of QR factors.

Each task folds its rows into one triangular factor per group; factors are stacked and factored again,
a few at a time, until a group has one. What is shuffled and solved is at most d x d per group whatever the row count, so
a hot group costs no more than a small one. Squares are never formed, so nearly collinear features keep their
digits; the minimum-norm solution is returned where features are collinear or rows too few.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosecast.operators.lookup import lookup_join
from dosecast.session import materialize

HELD_CELLS = 4_000_000  # cells of rows that a task factors at once, at least as many rows as a factor has
BLOCK_ROWS = 1_024  # rows that are factored at a time, or four times the width
COUNTED = 10_000  # groups that are told apart before rows are folded; with more, rows are ordered by group
FOLDS_PER_CORE = 2  # tasks that fold: each hands on a whole matrix, so few and large ones
NOISE = 16  # units in the last place of the means that centring may leave in a feature
STACKED = 4  # factors that meet in one task
SHIPPED_CELLS = 4_000_000  # coefficients that travel with the tasks


def feature_matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of equal-length lists as a float64 matrix, without Python objects."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False)
    if len(values) != width * len(column):
        raise ValueError(f"every feature vector must have {width} values")
    return values.reshape(-1, width).astype(np.float64)


def vector_width(df: DataFrame, features: str = "features") -> int:
    """Width of the first vector; a vector of another width fails in the task that meets it."""
    first = df.filter(F.col(features).isNotNull()).select(F.size(features).alias("width")).first()
    if first is None:
        raise ValueError("there are no rows to fit on")
    return first["width"]


def column_means(df: DataFrame, group: str, features: str, target: str) -> tuple[np.ndarray, int]:
    """The means of all features, and of the target behind them, and the number of groups, counted up to ``COUNTED``.

    Each task sums up its rows as matrices.
    """

    def sums(batches):
        n, total, names = 0, 0.0, set()
        for batch in batches:
            if len(batch):
                if len(names) < COUNTED:
                    names.update(batch.column("_group").unique().to_pylist())
                x = feature_matrix(batch.column(features), len(batch.column(features)[0]))
                y = batch.column(target).to_numpy(zero_copy_only=False).astype(np.float64)
                n, total = n + len(y), total + np.append(x.sum(axis=0), y.sum())
        if n:
            cells = [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n], pa.int64()), pa.array([total.tolist()]), pa.array([list(names)[:COUNTED]], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cells, ["part", "n", "total", "names"])

    rows = df.select(F.col(group).cast("string").alias("_group"), features, target)
    found = rows.mapInArrow(sums, "part int, n bigint, total array<double>, names array<string>").collect()
    if not found:
        raise ValueError("there are no rows to fit on")
    if len({len(r["total"]) for r in found}) > 1:
        raise ValueError("every feature vector must have the same number of values")
    found.sort(key=lambda r: r["part"])
    means = np.sum([r["total"] for r in found], axis=0) / sum(r["n"] for r in found)
    return means, min(COUNTED, len(set().union(*(r["names"] for r in found))))


def _factor(z: np.ndarray) -> np.ndarray:
    """The triangular factor of a matrix, with no more rows than the matrix has; of a long one by blocks that a core's cache holds."""
    rows, size = z.shape
    block = max(BLOCK_ROWS, 4 * size)
    if rows >= 2 * block:
        whole = rows // block
        factors = np.linalg.qr(z[: whole * block].reshape(whole, block, size), mode="r")
        z = np.concatenate([factors.reshape(-1, size), z[whole * block :]])
    return np.linalg.qr(z, mode="r") if len(z) > 1 else z


def _factor_batch(name: str | None, part: int, factor: np.ndarray) -> pa.RecordBatch:
    rows, size = factor.shape
    cells = pa.ListArray.from_arrays(np.arange(0, rows * size + 1, size, dtype=np.int32), pa.array(factor.reshape(-1)))
    columns = [pa.array([name] * rows, pa.string()), pa.array([part] * rows, pa.int32()), pa.array(np.arange(rows, dtype=np.int32)), cells]
    return pa.RecordBatch.from_arrays(columns, ["_group", "_part", "_row", "_cells"])


_FACTORS = "_group string, _part int, _row int, _cells array<double>"


def factor_rows(df: DataFrame, group: str, features: str, target: str, width: int, shift: np.ndarray, tasks: int, groups: int | None = None) -> DataFrame:
    """One triangular factor per task and group, row by row, of the rows z = (1, x - shift, y - shift).

    Where the factors of all ``groups`` fit a task, rows are folded as they come; else they are ordered by group first.
    """
    size = width + 2
    at_once = max(size, HELD_CELLS // size)
    ordered = groups is None or groups >= COUNTED or 2 * groups * size > at_once

    def fold(batches):
        part = TaskContext.get().partitionId()
        held: dict[str, list] = {}
        rows = 0
        for batch in batches:
            x = feature_matrix(batch.column(features), width)
            y = batch.column(target).to_numpy(zero_copy_only=False).astype(np.float64)
            z = np.column_stack([np.ones(len(x)), x - shift[:-1], y - shift[-1]])
            codes, names = pd.factorize(batch.column("_group").to_pandas())
            for code, found in enumerate(names):
                if ordered and found not in held:  # groups come one after the other
                    yield from (_factor_batch(name, part, _factor(np.concatenate(own))) for name, own in held.items())
                    held, rows = {}, 0
                held.setdefault(found, []).append(z[codes == code] if len(names) > 1 else z)
                rows += len(held[found][-1])
                if rows >= at_once:
                    held = {name: [_factor(np.concatenate(own))] for name, own in held.items()}
                    rows = sum(len(own[0]) for own in held.values())
        yield from (_factor_batch(name, part, _factor(np.concatenate(own))) for name, own in held.items())

    rows = df.select(F.col(group).cast("string").alias("_group"), features, target)
    rows = rows.coalesce(tasks)
    return (rows.sortWithinPartitions("_group") if ordered else rows).mapInArrow(fold, _FACTORS)


def stacked(factors: DataFrame, parts: int) -> DataFrame:
    """One factor per group from those of ``parts`` tasks, by stacking ``STACKED`` at a time."""

    def combine(own: pa.Table) -> pa.Table:
        size = len(own.column("_cells")[0])
        z = own.column("_cells").combine_chunks().flatten().to_numpy().reshape(-1, size)
        order = np.lexsort((own.column("_row").to_numpy(), own.column("_before").to_numpy()))  # the same sums whatever comes first
        return pa.Table.from_batches([_factor_batch(own.column("_group")[0].as_py(), own.column("_part")[0].as_py(), _factor(z[order]))])

    while parts > 1:
        parts = -(-parts // STACKED)
        met = factors.withColumn("_before", F.col("_part")).withColumn("_part", F.floor(F.col("_part") / STACKED).cast("int"))
        factors = met.groupBy("_group", "_part").applyInArrow(combine, _FACTORS)
    return factors


def fit_linear(
    train: DataFrame, group: str | None = None, features: str = "features", target: str = "y"
) -> DataFrame:
    """One row per group: ``intercept``, ``coefficients``, ``n``, ``rank`` of the centred features.

    Without ``group`` there is a single row whose group is ``all``.
    """
    by = group or "_group"
    rows = (train if group else train.withColumn(by, F.lit("all"))).filter(F.col(target).isNotNull())
    shift, groups = column_means(rows, by, features, target)
    width = len(shift) - 1
    tasks = FOLDS_PER_CORE * train.sparkSession.sparkContext.defaultParallelism
    factors = factor_rows(rows, by, features, target, width, shift, tasks, groups)

    def solve(own: pd.DataFrame) -> pd.DataFrame:
        r = np.stack(own.sort_values("_row")["_cells"].to_list())
        mean = r[0, 1:] / r[0, 0]  # the first row has the sums, what is below it is centred
        n = int(round(r[0, 0] ** 2))
        coefficients, rank, eps = np.zeros(width), 0, np.finfo(float).eps
        centred = r[1:, 1:-1]
        size, noise = np.linalg.norm(centred), NOISE * eps * np.sqrt(n) * np.linalg.norm(shift[:-1])
        if size > noise:  # else features are constant but for what centring has rounded
            coefficients, _, rank, _ = np.linalg.lstsq(centred, r[1:, -1], rcond=max(eps * max(n, width), noise / size))
        intercept = mean[-1] + shift[-1] - (mean[:-1] + shift[:-1]) @ coefficients
        return pd.DataFrame(
            {
                "_group": [own["_group"].iloc[0]],
                "intercept": [intercept],
                "coefficients": [coefficients],
                "n": [n],
                "rank": [int(rank)],
            }
        )

    # Each group here is the rows of its one factor, at most d + 2.
    fitted = stacked(factors, tasks).groupBy("_group").applyInPandas(
        solve, "_group string, intercept double, coefficients array<double>, n bigint, rank int"
    )
    return materialize(fitted.withColumnRenamed("_group", group or "model_group"), "linear_model")


def predict_linear(
    model: DataFrame, rows: DataFrame, group: str | None = None, features: str = "features", output: str = "p"
) -> DataFrame:
    """Add the prediction; rows of a group without a model, or without a vector of its width, get null.

    Coefficients of a bounded number travel with the tasks and are applied as matrix
    products. Beyond that they are joined to the rows by group.
    """
    by = group or "model_group"
    keyed = rows if group else rows.withColumn(by, F.lit("all"))
    cells = model.agg(F.sum(F.size("coefficients"))).first()[0] or 0
    found = model.collect() if cells <= SHIPPED_CELLS else []
    if found:
        fitted = {r[by]: (r["intercept"], np.array(r["coefficients"])) for r in found}
        width = len(found[0]["coefficients"])
        shipped = rows.sparkSession.sparkContext.broadcast(fitted)

        @F.arrow_udf("double")
        def apply(names: pa.Array, vectors: pa.Array) -> pa.Array:
            fits = pc.fill_null(pc.equal(pc.list_value_length(vectors), width), False)
            at = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
            x = feature_matrix(vectors.filter(fits), width)
            out, missing = np.zeros(len(vectors)), np.ones(len(vectors), bool)
            codes, found = pd.factorize(names.filter(fits).to_pandas())
            for code, name in enumerate(found):
                if name in shipped.value:
                    intercept, coefficients = shipped.value[name]
                    here = at[codes == code]
                    # Row by row, as the sums of a matrix product depend on a row's place: equal vectors must have equal ranks.
                    out[here] = (x[codes == code] * coefficients).sum(axis=1) + intercept
                    missing[here] = False
            return pa.array(out, mask=missing)

        scored = keyed.withColumn(output, apply.asNondeterministic()(F.col(by).cast("string"), F.col(features)))
    else:
        joined = lookup_join(keyed, model.select(by, "intercept", "coefficients"), [by])
        products = F.zip_with(features, "coefficients", lambda x, c: x.cast("double") * c)
        dot = F.aggregate(products, F.lit(0.0), lambda s, v: s + v)  # a vector of another width gives null
        scored = joined.withColumn(output, F.col("intercept") + dot).drop("intercept", "coefficients")
    return scored if group else scored.drop(by)
