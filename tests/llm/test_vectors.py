"""Whitening and hard negatives against plain versions."""

import math
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from dosecast.llm import catalog, negatives, whitening

SF = "/root/testdata/sf0.001"
# Every internal name as an extra column.
VECTORS = "vec_id long, embedding array<float>, label int, id int, x int, c int, n int, component int, row int, body string, whitened double"


def vec(i, v, label=0):
    return (i, v, label, 1, 1, 1, 1, 1, 1, "extra", 1.0)


def whole(c, scale):
    return math.floor(scale * float(np.float32(c)))


def takes_part(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


# whitening


def plain_whitening(rows):
    kept = [(i, v) for i, v in rows if takes_part(v)]
    width = max((len(v) for _, v in kept), default=0)
    x = [[whole(c, 64) + 1_000_000 for c in v] + [1_000_000] * (width - len(v)) for _, v in kept]
    n, sums = len(x), [sum(col) for col in zip(*x)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x]
    centred = np.array([[float((n * a - s) / n) for a, s in zip(row, sums)] for row in x])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return kept, n, deviation, centred, values[::-1], vectors[:, ::-1]


def check_whitening(got, rows, components=32):
    kept, n, deviation, centred, values, vectors = plain_whitening(rows)
    k = min(components, int((values > 1e-9 * values[0]).sum()))
    assert len(got) == len(kept) * k
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], []).append(r)
    for at, (i, _) in enumerate(kept):
        own = sorted(by[i], key=lambda r: r["component"])
        assert [r["component"] for r in own] == list(range(1, k + 1))
        assert {r["n"] for r in own} == {n} and {r["deviation_exact"] for r in own} == {Decimal(deviation[at])}
        assert {r["deviation"] for r in own} == {deviation[at] if deviation[at] < 1 << 63 else None}
    w = np.array([[r["whitened"] for r in sorted(by[i], key=lambda r: r["component"])] for i, _ in kept])
    want = centred @ vectors[:, :k] / np.sqrt(values[:k])
    sign = np.sign((w * want).sum(axis=0))
    assert np.abs(w * sign - want).max() < 1e-7
    explained = np.array([r["explained"] for r in sorted(by[kept[0][0]], key=lambda r: r["component"])])
    assert np.allclose(explained, values[:k] / values.sum(), rtol=1e-9)
    error = {r["identity_error"] for r in got}
    assert len(error) == 1 and abs(error.pop() - np.abs(w.T @ w / n - np.eye(k)).max()) < 1e-9


def test_whitening_of_the_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = catalog.op11_whitening(spark, SF).collect()
    check_whitening(got, rows)
    assert got[0]["identity_error"] < 1e-9


def test_whitening_of_odd_rows(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(5, 2) * (j + 1) for j in range(6)]) for i in range(60)]
    rows += [(100, None), (101, [1.0, None]), (102, [float("nan")] * 6), (103, [float("inf")] * 6), (104, []), (105, [1.0, 2.0])]
    table = spark.createDataFrame([vec(i, v) for i, v in rows], VECTORS).repartition(4)
    check_whitening(whitening.whitened(table).collect(), rows)
    check_whitening(whitening.whitened(table, components=2).collect(), rows, 2)


def test_whitening_without_variance(spark):
    for rows in ([], [vec(1, [1.0, 2.0])], [vec(i, [3.0, 3.0]) for i in range(9)], [vec(1, None)], [vec(1, [])]):
        assert whitening.whitened(spark.createDataFrame(rows, VECTORS)).collect() == []
    line = whitening.whitened(spark.createDataFrame([vec(i, [float(i), 2.0 * i, 0.0]) for i in range(9)], VECTORS)).collect()
    assert {r["component"] for r in line} == {1} and abs(line[0]["explained"] - 1) < 1e-12


def test_deviation_beyond_a_long(spark):
    rows = [(i, [1e9 * (i % 7), float(i)]) for i in range(50)]
    check_whitening(whitening.whitened(spark.createDataFrame([vec(i, v) for i, v in rows], VECTORS)).collect(), rows)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64])
def test_eigenvectors_equal_a_dense_solver(n):
    rng = np.random.default_rng(n)
    basis, _ = np.linalg.qr(rng.normal(size=(n, n)))
    for values in (rng.uniform(0, 9, n), np.repeat([5.0, 5.0 - 1e-9, 1.0], n)[:n], np.zeros(n) + 2, np.logspace(0, -14, n)):
        a = (basis * np.sort(values)[::-1]) @ basis.T
        found, vectors = whitening.eigenvectors((a + a.T) / 2, n)
        assert np.allclose(found, np.sort(values)[::-1], atol=1e-14 * n)
        assert np.abs(a @ vectors - vectors * found).max() < 1e-13 * n and np.abs(vectors.T @ vectors - np.eye(n)).max() < 1e-13 * n


# hard negatives


def plain_negatives(rows):
    kept = [(i, label, [whole(c, 256) for c in v]) for i, v, label in rows if i is not None and label is not None and takes_part(v)]
    kept = sorted({(i, label, tuple(v)) for i, label, v in kept})
    out = []
    for i, label, v in kept:
        if i % 100:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in kept if j != i))
        for s, p, other in [t for t in scored if t[2] == label][:5]:
            fits = [t for t in scored if t[2] != label and 30 * -s <= 100 * -t[0] <= 90 * -s]
            out += [(i, p, rank, t[1], -s, -t[0]) for rank, t in enumerate(fits[:10], 1)]
    return sorted(out)


def found(rows):
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in rows)


def test_negatives_of_the_table(spark):
    rows = [(r["vec_id"], r["embedding"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").filter("label IS NOT NULL").collect()]
    assert found(catalog.op13_hard_negatives(spark, SF).collect()) == plain_negatives(rows)


@pytest.mark.parametrize("block", [7, 8_192])
@pytest.mark.parametrize("size", [1.0, 3e5])
def test_negatives_in_blocks(spark, monkeypatch, block, size):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", block)
    rng = random.Random(block)
    rows = [(i * 20, [rng.choice([-1, 0, 0.5, 1, rng.random()]) * size for _ in range(rng.choice([3, 3, 3, 2]))], rng.choice([0, 0, 1, 2])) for i in range(120)]
    rows += [(700, [size, size, size], 0)] * 40 + [(1, None, 0), (2, [None, 1.0, 1.0], 1), (3, [float("nan")] * 3, 1), (4, [1.0] * 3, None), (None, [1.0] * 3, 1), (5, [], 1), (900, [0.0] * 3, 0)]
    table = spark.createDataFrame([vec(*r) for r in rows], VECTORS).repartition(3)
    got = found(negatives.hard_negatives(table, F.col("id") % 100 == 0).collect())
    assert got == plain_negatives([(i, v, label) for i, v, label in rows])


def test_negatives_of_nothing(spark):
    for rows in ([], [vec(100, [1.0])], [vec(100, [1.0], 0), vec(200, [1.0], 1)], [vec(None, None, None)]):
        assert negatives.hard_negatives(spark.createDataFrame(rows, VECTORS), F.col("id") % 100 == 0).collect() == []


def test_packed_scores_are_exact():
    rng = random.Random(5)
    for most in (1, 300, 1 << 20, negatives.limit(5)):
        x = [[rng.randint(-most, most) for _ in range(5)] for _ in range(33)] + [[most] * 5, [-most] * 5]
        packed = negatives.Packed(np.array(x, dtype=np.int64), most)
        for anchor in (*x[:4], *x[-2:], [0] * 5):
            assert packed.scores(anchor).tolist() == [sum(a * b for a, b in zip(anchor, v)) for v in x]
