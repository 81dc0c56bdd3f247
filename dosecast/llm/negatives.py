"""Hard negatives by Kronecker-packed products: one wide integer holds a component of many candidates.

Components are whole numbers. A task biases one component of all candidates of its block to non-negative fields and
joins the fields, of a few bytes each, into one wide integer; there is one such integer for each dimension. An anchor's
scores against the whole block are then one multiplication of integer and component for each dimension, added
up: the fields of the sum are the inner products, which an offset keeps from borrowing of each other, so they are
read from its bytes exactly. The width of a field follows from the largest component of either side.

Anchors and rows meet in blocks of bounded size, twice: first each block passes on an anchor's best rows of its own
label, then the best rows of other labels between the bounds that the positives' scores set. What a block passes on
is bounded, however many rows share a label or a score.

Defined cases: rows without key, label or vector, and vectors with null or non-finite components, take no part;
rows that repeat key, label and vector count once; "other" rows are those with another key; vectors shorter than the
longest (an empty one too) count as zero beyond their end; whole components are held within ``limit(width)`` on both
sides (2**28 at 64 dimensions), so a score always fits a long; a positive score below zero allows no negatives (its bounds
are crossed), zero allows those of zero; equal scores go to the smaller key; an anchor with no other row of its label, or
a positive with no negative, gives no rows; empty tables give none; other input columns play no part, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from dosecast.session import materialize

SCALE = 256  # whole components are floor(SCALE * x)
POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = 30, 90  # bounds of a negative's score, in percent of the positive's
BLOCK_ROWS = 8_192  # candidates in one wide integer, and anchors in a block, at most
BLOCK_CELLS = 4_000_000  # components of a block, at most


def limit(width: int) -> int:
    """The largest whole component: a sum of ``width`` products of two such stays below 2**62."""
    return math.isqrt((1 << 62) // max(1, width))


def usable(df: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    """(id, label, vector) of the rows that take part, once each."""
    rows = df.select(df[f"`{key}`"].alias("id"), df[f"`{label}`"].alias("label"), df[f"`{vector}`"].cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").filter(~F.coalesce(bad, F.lit(True)))


def whole_components(rows: DataFrame, width: int, scale: int) -> DataFrame:
    """(id, label, x): ``x`` holds ``width`` whole components."""
    most = float(limit(width))
    padded = F.slice(F.concat("vector", F.array_repeat(F.lit(0.0), width)), 1, max(1, width))
    whole = F.transform(padded, lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(most)), F.lit(-most))))
    return rows.select("id", "label", whole.alias("x"))


class Packed:
    """The candidates of a block, a wide integer for each dimension."""

    def __init__(self, x: np.ndarray, most: int):
        self.rows, width = x.shape
        self.bound = max(1, width * most * 2 * most)  # of a sum over biased fields
        self.field = 4 if 2 * self.bound < 1 << 32 else 8 if 2 * self.bound < 1 << 64 else 16
        self.bias = most
        self.wide = [self._pack(x[:, d] + most) for d in range(width)]
        self.offset = self._pack(np.ones(self.rows, dtype=np.int64)) * self.bound

    def _pack(self, values: np.ndarray) -> int:
        cells = np.zeros((self.rows, self.field), dtype=np.uint8)
        own = values.astype("<u8").view(np.uint8).reshape(self.rows, 8)
        held = min(8, self.field)
        cells[:, :held] = own[:, :held]
        return int.from_bytes(cells.tobytes(), "little")

    def scores(self, anchor: list[int]) -> np.ndarray:
        """The inner products of an anchor with all candidates, exactly."""
        total = self.offset
        for a, wide in zip(anchor, self.wide):
            if a:
                total += a * wide
        cells = total.to_bytes(self.rows * self.field + 1, "little")[: self.rows * self.field]
        lift = self.bias * sum(anchor) + self.bound  # what bias and offset have added to every field
        if self.field == 16:
            words = np.frombuffer(cells, dtype="<u8").reshape(-1, 2)
            return np.array([int(low) + (int(high) << 64) - lift for low, high in words], dtype=np.int64)
        raw = np.frombuffer(cells, dtype=f"<u{self.field}")
        if abs(lift) < 1 << 62 and 2 * self.bound < 1 << 63:
            return raw.astype(np.int64) - lift
        return np.array([int(v) - lift for v in raw], dtype=np.int64)


def best(scores: np.ndarray, ids: np.ndarray, among: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` best places among the given ones, higher scores first, then smaller ids."""
    if len(among) > k:
        own = scores[among]
        least = -np.partition(-own, k - 1)[k - 1]
        among = among[own >= least]
    return among[np.lexsort((ids[among], -scores[among]))[:k]]


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def met_in_blocks(rows: DataFrame, anchors: DataFrame, width: int, most: int, n_rows: int, n_anchors: int, pick, schema: str) -> DataFrame:
    """``pick(scores, ids, labels, anchor)`` of every block of rows and every anchor; ``anchors`` may carry columns more."""
    held = max(1, min(BLOCK_ROWS, BLOCK_CELLS // max(1, width)))
    row_blocks, anchor_blocks = max(1, -(-n_rows // held)), max(1, -(-n_anchors // held))
    own = lambda blocks: F.pmod(F.xxhash64("id", "x"), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    at = ["row_block", "anchor_block"]
    left = rows.withColumn("row_block", own(row_blocks)).withColumn("anchor_block", every(anchor_blocks))
    right = anchors.withColumn("anchor_block", own(anchor_blocks)).withColumn("row_block", every(row_blocks))

    def meet(candidates: pa.Table, asking: pa.Table) -> pa.Table:
        found = []
        if len(candidates) and len(asking):
            packed = Packed(_matrix(candidates.column("x"), width), most)
            ids, labels = (candidates.column(c).to_numpy() for c in ("id", "label"))
            for anchor in asking.to_pylist():
                found.extend(pick(packed.scores(anchor["x"]), ids, labels, anchor))
        return pa.Table.from_pylist(found, schema=out)

    out = to_arrow_schema(T._parse_datatype_string(schema))
    return left.groupBy(*at).cogroup(right.groupBy(*at)).applyInArrow(meet, schema)


def hard_negatives(
    df: DataFrame,
    is_anchor: Column,
    key: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
    scale: int = SCALE,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); ``is_anchor`` is over the column ``id``.

    An anchor's positives are its ``positives`` best other rows of the same label; for each of them the ``negatives`` best
    rows of another label whose score lies between ``low`` and ``high`` percent of the positive's.
    """
    source = usable(df, key, label, vector)
    width = max(1, source.agg(F.max(F.size("vector"))).first()[0] or 1)
    rows = materialize(whole_components(source, width, scale).withColumn("id", F.col("id").cast("long")).withColumn("label", F.col("label").cast("long")).distinct(), "whole")
    anchors = materialize(rows.filter(is_anchor).withColumn("row", F.monotonically_increasing_id()), "anchors")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.array_max(F.transform("x", F.abs))).alias("most"), F.count_if(is_anchor).alias("anchors")).first()
    most, n_rows, n_anchors = max(1, size["most"] or 0), size["n"], size["anchors"]

    def nearest_of_label(scores, ids, labels, anchor):
        among = np.flatnonzero((labels == anchor["label"]) & (ids != anchor["id"]))
        return [{"row": anchor["row"], "positive_id": int(ids[i]), "positive_score": int(scores[i])} for i in best(scores, ids, among, positives)]

    proposed = met_in_blocks(rows, anchors, width, most, n_rows, n_anchors, nearest_of_label, "row long, positive_id long, positive_score long")
    by_score = Window.partitionBy("row").orderBy(F.desc("positive_score"), "positive_id")
    kept = proposed.withColumn("_place", F.row_number().over(by_score)).filter(F.col("_place") <= positives)
    pairs = kept.groupBy("row").agg(F.collect_list(F.struct("_place", "positive_id", "positive_score")).alias("positives"))
    paired = materialize(anchors.join(pairs, "row"), "positives")

    def within_bounds(scores, ids, labels, anchor):
        others = np.flatnonzero(labels != anchor["label"])
        order = others[np.lexsort((ids[others], -scores[others]))]
        falling = -scores[order]
        for positive in anchor["positives"]:
            own = positive["positive_score"]
            least, top = -((-low * own) // 100), (high * own) // 100  # low * own <= 100 * score <= high * own
            start, end = np.searchsorted(falling, -top, "left"), np.searchsorted(falling, -least, "right")
            for i in order[start : min(end, start + negatives)]:
                yield {"row": anchor["row"], "anchor_id": anchor["id"], **positive, "negative_id": int(ids[i]), "negative_score": int(scores[i])}

    shape = "row long, anchor_id long, _place int, positive_id long, positive_score long, negative_id long, negative_score long"
    mined = met_in_blocks(rows, paired, width, most, n_rows, n_anchors, within_bounds, shape)
    order = Window.partitionBy("row", "_place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = mined.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
