"""Embedding whitening: eigenvectors of the covariance by spectral divide and conquer on polar factors.

Vectors become whole numbers, so counts and sums are exact; every row is centred with them before anything is
multiplied, and the covariance is summed by Spark from what each task folds. Its eigenvectors come from QDWH: the
polar factor of the covariance minus a shift, found by a dynamically weighted Halley iteration on QR factors, has the
eigenvalues +1 and -1; half its sum with the identity projects on the part of space above the shift. An orthonormal
basis of either part splits the covariance into two smaller ones, recursively, until a part has one
dimension or one eigenvalue. Parts below the components asked for are not split further. The components, at most
``components`` vectors of the embeddings' width, are broadcast, and each row is whitened where it lies.

What passes through the driver is one matrix of width x width (``MAX_WIDTH`` bounds it: 134 MB), whatever the rows.

Defined cases: rows with a null vector or a null or non-finite entry are left out; null and repeated keys take part, row
by row; shorter vectors (an empty one too) have zero entries beyond their end; whole entries are held within +-2**40 of
the shift; a deviation beyond a long is null, ``deviation_exact`` has it as decimal; components without variance
(eigenvalue under ``RANK`` of the largest) are not returned, so a table of equal rows, of one row or of none gives no
rows; equal eigenvalues share a part, whose basis is one of many; other input columns play no part, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dosecast.session import materialize

SCALE, SHIFT = 64, 1_000_000  # whole entries are floor(SCALE * c) + SHIFT
COMPONENTS = 32
MAX_WIDTH = 4_096
HELD = 1 << 40  # bound of floor(SCALE * c)
RANK = 1e-12
FOLDS_PER_CORE = 2  # tasks that fold: each hands on a whole matrix, so few and large ones
SHIFTS = 50  # tries to part two eigenvalues after median and mean of the diagonal
EPS = np.finfo(np.float64).eps


# the small dense part: polar factors and splits


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The unitary polar factor of a symmetric matrix without eigenvalue zero, by QDWH with QR factors only."""
    n = len(a)
    x = a / max(np.linalg.norm(a), np.finfo(float).tiny)
    least = max(EPS, 0.9 / max(np.linalg.cond(x, 1) * np.sqrt(n), 1.0))  # a lower bound of the singular values
    for _ in range(60):
        l2 = least * least
        d = np.cbrt(4 * max(1 - l2, 0.0) / (l2 * l2))
        h = np.sqrt(1 + d) + 0.5 * np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - l2) / (l2 * np.sqrt(1 + d))))
        b = (h - 1) ** 2 / 4
        c = h + b - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, np.eye(n)]))
        following = (b / c) * x + (h - b / c) / np.sqrt(c) * (q[:n] @ q[n:].T)
        least = min(1.0, least * (h + b * l2) / (1 + c * l2))
        moved = np.linalg.norm(following - x)
        x = (following + following.T) / 2
        if moved < 10 * EPS ** (1 / 3) and abs(1 - least) < 10 * EPS and moved < 1e-8:
            break
    return x


def split(a: np.ndarray, rng: np.random.Generator, noise: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the parts of space above and below a shift; None for a matrix of one eigenvalue, but for ``noise``."""
    values = np.diag(a)
    spread = np.linalg.norm(a - np.eye(len(a)) * values.mean())
    if spread <= noise:
        return None
    for shift in (np.median(values), values.mean(), *(values.mean() + spread / np.sqrt(len(a)) * rng.uniform(-1, 1, SHIFTS))):
        moved = a - shift * np.eye(len(a))
        projector = (polar_factor(moved) + np.eye(len(a))) / 2
        rank = int(round(np.trace(projector)))
        if not 0 < rank < len(a) or np.linalg.norm(projector @ projector - projector) > 1e-10 * len(a):
            continue  # all on one side, or the shift hit an eigenvalue
        # Subspace iteration from random vectors: the projector's range after one step, once more for its last digits.
        basis, _ = np.linalg.qr(projector @ rng.normal(size=(len(a), rank)))
        basis, _ = np.linalg.qr(projector @ basis)
        whole, _ = np.linalg.qr(np.hstack([basis, rng.normal(size=(len(a), len(a) - rank))]))
        rest = whole[:, rank:] - projector @ whole[:, rank:]
        rest, _ = np.linalg.qr(rest - basis @ (basis.T @ rest))
        return basis, rest
    raise ArithmeticError(f"no shift parts the eigenvalues of a matrix of {len(a)} columns")


def eigenvectors(a: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns."""
    rng = np.random.default_rng(len(a))
    noise = 8 * EPS * np.linalg.norm(a)
    found: list[tuple[float, np.ndarray]] = []
    parts = [(a, np.eye(len(a)))]  # what is still to split, the part with the largest eigenvalues last
    while parts and len(found) < wanted:
        part, basis = parts.pop()
        halves = split(part, rng, noise) if len(part) > 1 else None
        if halves is None:
            found += [(float(part[i, i]), basis[:, i]) for i in range(len(part))]
            continue
        for half in reversed(halves):
            smaller = half.T @ part @ half
            parts.append(((smaller + smaller.T) / 2, basis @ half))
    found = sorted(found, key=lambda pair: -pair[0])[:wanted]
    values, vectors = np.array([v for v, _ in found]), np.stack([v for _, v in found], axis=1)
    return values, vectors / np.linalg.norm(vectors, axis=0)


# the rows


def whole_rows(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, x): the whole entries, without the shift, of the rows that take part; as wide as each vector is."""
    rows = df.select(df[f"`{key}`"].alias("id"), df[f"`{vector}`"].cast("array<double>").alias("c"))
    bad = F.exists("c", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.col("c").isNotNull()).filter(~F.coalesce(bad, F.lit(True)))
    held = float(HELD)
    return rows.select("id", F.transform("c", lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(held)), F.lit(-held)))).alias("x"))


def _padded(column: pa.Array, width: int) -> np.ndarray:
    """Lists of at most ``width`` whole numbers as a matrix, zero beyond their ends."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (lengths == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(column), width), dtype=np.int64)
    out[np.arange(width) < lengths[:, None]] = values
    return out


@dataclass(frozen=True)
class Centre:
    """Exact sums of the whole entries (without the shift, which cancels), and how they centre a row."""

    n: int
    sums: list[int]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n to double precision: whole parts cancel before anything is rounded."""
        whole = np.array([s // self.n for s in self.sums], dtype=np.int64)
        rest = np.array([s % self.n / self.n for s in self.sums])
        return (x - whole).astype(np.float64) - rest

    def deviations(self, x: np.ndarray) -> list[int]:
        """Exact sums of (n * x - S)^2."""
        whole = np.array([s // self.n for s in self.sums], dtype=np.int64)
        rest = np.array([s % self.n for s in self.sums], dtype=object)
        off = x - whole
        most = max(int(np.abs(off).max(initial=0)) + 1, 1) * self.n
        if most * most * max(1, x.shape[1]) < 1 << 62:
            own = off * self.n - rest.astype(np.int64)
            return (own * own).sum(axis=1).tolist()
        own = off.astype(object) * self.n - rest
        return [int(v) for v in (own * own).sum(axis=1)]


def exact_sums(rows: DataFrame, width: int) -> Centre:
    """Counts and sums of every dimension: whole numbers in the tasks, decimals across them."""

    def add(batches):
        total, n = [0] * width, 0
        for batch in batches:
            x = _padded(batch.column("x"), width)
            total = [a + int(b) for a, b in zip(total, x.sum(axis=0))]
            n += len(x)
        if n:
            yield pa.RecordBatch.from_pydict({"dimension": list(range(width)), "total": pa.array([str(t) for t in total]), "n": [n] * width}, schema=pa.schema([("dimension", pa.int32()), ("total", pa.string()), ("n", pa.int64())]))

    parts = rows.select("x").mapInArrow(add, "dimension int, total string, n long")
    summed = parts.groupBy("dimension").agg(F.sum(F.col("total").cast("decimal(28,0)")).alias("total"), F.sum("n").alias("n")).orderBy("dimension").collect()
    return Centre(summed[0]["n"] if summed else 0, [int(r["total"]) for r in summed])


def folded(rows: DataFrame, width: int, fold, size: int) -> np.ndarray:
    """The sum over all rows of what ``fold`` makes of a batch's whole entries: a matrix of ``size`` columns."""

    def run(batches):
        total = None
        for batch in batches:
            part = fold(_padded(batch.column("x"), width))
            total = part if total is None else total + part
        if total is not None:
            for at in range(0, len(total), 256):  # rows of a matrix go out some at a time
                some = total[at : at + 256]
                cells = pa.ListArray.from_arrays(np.arange(0, some.size + 1, size, dtype=np.int32), pa.array(some.reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(some), dtype=np.int32)), cells], ["line", "cells"])

    few = rows.select("x").coalesce(FOLDS_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism)
    summed = few.mapInArrow(run, "line int, cells array<double>").groupBy("line").agg(vector_to_array(Summarizer.sum(array_to_vector("cells"))).alias("cells"))
    return np.stack([np.array(r["cells"]) for r in summed.orderBy("line").collect()])


@dataclass(frozen=True)
class Whitener:
    """How a row is whitened: its centre, the components as columns, their eigenvalues and shares of the trace."""

    centre: Centre
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    width: int

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ self.vectors / np.sqrt(self.values)


def fit_whitener(rows: DataFrame, components: int = COMPONENTS) -> Whitener | None:
    """Fit on all rows (id, x), which are written; None where nothing varies."""
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    if width > MAX_WIDTH:
        raise ValueError(f"vectors of {width} entries: the covariance may have at most {MAX_WIDTH} columns")
    if not width:
        return None
    centre = exact_sums(rows, width)

    def scatter(x):
        d = centre.centred(x)
        return np.vstack([d.T @ d, d.sum(axis=0)])

    summed = folded(rows, width, scatter, width)
    covariance, rest = summed[:-1] / centre.n, summed[-1] / centre.n  # what rounding has left of the mean
    covariance -= np.outer(rest, rest)
    trace = float(np.trace(covariance))
    if not trace > 0:
        return None
    values, vectors = eigenvectors((covariance + covariance.T) / 2, min(components, width))
    kept = values > RANK * values[0]
    return Whitener(centre, vectors[:, kept], values[kept], values[kept] / trace, width)


def identity_error(rows: DataFrame, fitted: Whitener) -> float:
    """The largest entry of the whitened rows' covariance minus the identity."""
    size = len(fitted.values)
    shipped = rows.sparkSession.sparkContext.broadcast(fitted)
    n, width = fitted.centre.n, fitted.width
    mean = folded(rows, width, lambda x: shipped.value.whiten(x).sum(axis=0)[None, :], size)[0] / n

    def scatter(x):
        w = shipped.value.whiten(x) - mean
        return w.T @ w

    return float(np.abs(folded(rows, width, scatter, size) / n - np.eye(size)).max())


RESULT = "component int, n long, deviation long, whitened double, explained double, identity_error double, eigenvalue double, deviation_exact decimal(38,0)"


def whitened(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per row that takes part and component: (key, component, n, deviation, whitened, explained, identity_error, ...)."""
    spark = df.sparkSession
    rows = materialize(whole_rows(df, key, vector), "whole")
    kind = rows.schema["id"].dataType
    schema = T.StructType([T.StructField(key, kind), *T._parse_datatype_string(RESULT).fields])
    fitted = fit_whitener(rows, components)
    if fitted is None:
        return spark.createDataFrame([], schema)
    error = identity_error(rows, fitted)
    shipped = spark.sparkContext.broadcast(fitted)  # components x width doubles, and the sums

    def run(batches):
        model = shipped.value
        k = len(model.values)
        for whole in batches:
            for start in range(0, whole.num_rows, 1_000):
                batch = whole.slice(start, 1_000)
                x = _padded(batch.column("x"), model.width)
                deviations = model.centre.deviations(x)
                longs = [d if d < 1 << 63 else None for d in deviations]
                of_row = np.repeat(np.arange(len(x)), k)
                cells = {
                    key: batch.column("id").take(pa.array(of_row)),
                    "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    "n": pa.array(np.full(len(of_row), model.centre.n, dtype=np.int64)),
                    "deviation": pa.array(longs, pa.int64()).take(pa.array(of_row)),
                    "whitened": pa.array(model.whiten(x).reshape(-1)),
                    "explained": pa.array(np.tile(model.explained, len(x))),
                    "identity_error": pa.array(np.full(len(of_row), error)),
                    "eigenvalue": pa.array(np.tile(model.values, len(x))),
                    "deviation_exact": pa.array([Decimal(d) if d < 10**38 else None for d in deviations], pa.decimal128(38, 0)).take(pa.array(of_row)),
                }
                yield pa.RecordBatch.from_arrays(list(cells.values()), list(cells))

    return rows.mapInArrow(run, schema)
