"""Approximate nearest neighbours by a forest of random-projection trees.

Trees are grown on a bounded sample: every inner node splits its sample at the median along a random direction,
down to ``leaves`` leaves whatever the table's size, so that what a query passes on from its leaves does not
grow with the table. All distinct vectors are then dealt to their leaf in each tree.
A query walks all trees at once through one priority queue, nearest branch first (squared margins of the
planes it has crossed), until it has ``searched`` of one tree's leaves and enough vectors in them. Leaves and
their queries meet in blocks of bounded size, are ranked there by the exact measure in double precision, and
each block passes on the ``k`` best of each query.

Equal vectors are one vector with its ``k + 1`` smallest ids (more could never be returned), so a vector that
is repeated without end costs one. Vectors without structure need most leaves for a high recall, which the
default ``searched`` allows for; clustered ones need few.

Defined cases: vectors that are null, empty, zero, hold null or non-finite components, have no id, or another
length than most, take no part; rows that repeat id and vector count once; with fewer than ``k`` candidates
all are returned; ties go to the smaller id; an empty table gives no rows; other input columns play no part.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dosecast.session import materialize

TREES = 4
SAMPLE = 20_000  # distinct vectors that the trees are grown on, at most
LEAVES = 64  # of each tree
LEAST_ROWS = 50  # vectors of the sample in a leaf, at least
SEARCHED = 1.4  # leaves that a query visits, of all trees, in leaves of one tree
BLOCK = 8_192  # rows, and queries, that meet in one block
K = 20
SEED = 7


@dataclass(frozen=True)
class Tree:
    """Inner nodes: plane, offset and children; a negative child ~i is leaf i."""

    planes: np.ndarray
    offsets: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaves: int

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64) if len(self.planes) else np.full(len(x), -1)
        if len(self.planes):
            side = x @ self.planes.T > self.offsets
        while (open_rows := np.flatnonzero(node >= 0)).size:
            at = node[open_rows]
            node[open_rows] = np.where(side[open_rows, at], self.right[at], self.left[at])
        return ~node


def grow(sample: np.ndarray, leaf_rows: int, rng: np.random.Generator) -> Tree:
    planes, offsets, left, right, leaves = [], [], [], [], 0

    def child(rows: np.ndarray) -> int:
        nonlocal leaves
        if len(rows) > leaf_rows:
            plane = rng.normal(size=sample.shape[1])
            plane /= np.linalg.norm(plane)
            along = sample[rows] @ plane
            offset = float(np.median(along))
            above = along > offset
            if 0 < above.sum() < len(rows):
                node = len(planes)
                planes.append(plane)
                offsets.append(offset)
                left.append(0)
                right.append(0)
                left[node], right[node] = child(rows[~above]), child(rows[above])
                return node
        leaves += 1
        return ~(leaves - 1)

    child(np.arange(len(sample)))
    return Tree(np.array(planes).reshape(-1, sample.shape[1]), np.array(offsets), np.array(left, dtype=np.int64), np.array(right, dtype=np.int64), leaves)


@dataclass(frozen=True)
class Forest:
    trees: list[Tree]

    def first_leaf(self) -> list[int]:
        return np.cumsum([0] + [t.leaves for t in self.trees]).tolist()

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        """One leaf number per tree for every row, unique over the forest."""
        return np.stack([t.leaf_of(x) + first for t, first in zip(self.trees, self.first_leaf())], axis=1)

    def search(self, x: np.ndarray, visits: int, least: int, rows_in: dict[int, int]) -> list[list[int]]:
        """The leaves each query visits, from one queue over all trees."""
        first = self.first_leaf()
        margins = [x @ t.planes.T - t.offsets if len(t.planes) else None for t in self.trees]
        out = []
        for q in range(len(x)):
            queue = [(0.0, t, 0 if len(tree.planes) else -1) for t, tree in enumerate(self.trees)]
            heapq.heapify(queue)
            found, rows = [], 0
            while queue and (len(found) < visits or rows < least):
                far, t, node = heapq.heappop(queue)
                tree = self.trees[t]
                while node >= 0:
                    m = margins[t][q, node]
                    near, other = (tree.right[node], tree.left[node]) if m > 0 else (tree.left[node], tree.right[node])
                    heapq.heappush(queue, (far + float(m * m), t, int(other)))
                    node = int(near)
                leaf = first[t] + ~node
                found.append(leaf)
                rows += rows_in.get(leaf, 0)
            out.append(found)
        return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vector) of the rows that take part."""
    rows = df.select(df[f"`{key}`"].alias("id"), df[f"`{vector}`"].alias("vector")).filter("id IS NOT NULL AND vector IS NOT NULL")
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(~F.coalesce(bad, F.lit(True))).filter(F.exists("vector", lambda x: x != 0))
    widths = rows.groupBy(F.size("vector").alias("width")).agg(F.count(F.lit(1)).alias("n"))
    most = widths.orderBy(F.desc("n"), "width").limit(1).first()
    return rows.filter(F.size("vector") == (most["width"] if most else 0))


def distinct_vectors(rows: DataFrame, ids: int) -> DataFrame:
    """(node, vector, ids): every distinct vector with its smallest ids; written down, so that nodes keep their numbers."""
    place = Window.partitionBy("vector").orderBy("id")
    # The limit on the rank reaches the tasks before the exchange, so a frequent vector is cut down there.
    few = rows.distinct().withColumn("_place", F.row_number().over(place)).filter(F.col("_place") <= ids)
    grouped = few.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return materialize(grouped.withColumn("node", F.monotonically_increasing_id()), "vectors")


def fit_forest(nodes: DataFrame, width: int, trees: int, leaves: int, sample: int) -> Forest:
    chosen = nodes.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(sample).toArrow()
    x = _matrix(chosen.column("vector").combine_chunks(), width) if len(chosen) else np.zeros((0, width))
    per_leaf = max(LEAST_ROWS, -(-len(x) // leaves))
    rng = np.random.default_rng(SEED)
    return Forest([grow(x, per_leaf, rng) for _ in range(trees)])


def nearest(
    df: DataFrame,
    is_query: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = K,
    trees: int = TREES,
    leaves: int = LEAVES,
    searched: float = SEARCHED,
    sample: int = SAMPLE,
    block: int = BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest by inner product; ``is_query`` is over the column ``id``."""
    rows = usable(df, key, vector)
    nodes = distinct_vectors(rows, k + 1)
    one = nodes.select(F.size("vector").alias("width")).first()
    width = one["width"] if one else 1
    forest = fit_forest(nodes, width, trees, leaves, sample)
    spark = df.sparkSession
    held = spark.sparkContext.broadcast(forest)  # the planes between at most 2 * leaves leaves in each tree
    element = nodes.schema["vector"].dataType.simpleString()

    def deal(batches):
        for b in batches:
            leaves = held.value.leaves_of(_matrix(b.column("vector"), width))
            offsets = pa.array(np.arange(len(leaves) + 1, dtype=np.int32) * leaves.shape[1])
            dealt = pa.ListArray.from_arrays(offsets, pa.array(leaves.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("first"), b.column("vector"), dealt], names=["node", "first", "vector", "leaves"])

    source = nodes.select("node", F.col("ids")[0].alias("first"), "vector")
    id_type = source.schema["first"].dataType.simpleString()
    dealt = source.mapInArrow(deal, f"node long, first {id_type}, vector {element}, leaves array<int>").select("node", "first", "vector", F.explode("leaves").alias("leaf"))
    rows_in = {r["leaf"]: r["count"] for r in dealt.groupBy("leaf").count().collect()}  # one for each leaf
    visits = max(1, round(searched * max(t.leaves for t in forest.trees)))

    asked = materialize(rows.filter(is_query).distinct().join(nodes.select("node", "vector"), "vector").select(F.col("id").alias("query_id"), "node"), "asked")
    queries = nodes.join(asked.select("node").distinct(), "node", "left_semi").select("node", "vector")

    def probe(batches):
        for b in batches:
            found = held.value.search(_matrix(b.column("vector"), width), visits, k + 1, rows_in)
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("vector"), pa.array(found, pa.list_(pa.int32()))], names=["node", "vector", "leaves"])

    probed = queries.mapInArrow(probe, f"node long, vector {element}, leaves array<int>").select("node", "vector", F.explode("leaves").alias("leaf"))
    probed = materialize(probed, "probes")
    asked_in = {r["leaf"]: r["count"] for r in probed.groupBy("leaf").count().collect()}

    # A leaf's rows and queries are cut into blocks, and every block of the one meets every block of the other.
    cut = [(leaf, -(-n // block), -(-asked_in[leaf] // block)) for leaf, n in rows_in.items() if leaf in asked_in]
    sizes = F.broadcast(spark.createDataFrame(cut, "leaf int, row_blocks int, query_blocks int"))
    own = lambda blocks: F.pmod(F.xxhash64("node"), F.col(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    at = ["leaf", "row_block", "query_block"]
    left = dealt.join(sizes, "leaf").select("leaf", "node", "first", "vector", own("row_blocks").alias("row_block"), every("query_blocks").alias("query_block"))
    right = probed.join(sizes, "leaf").select("leaf", "node", "vector", own("query_blocks").alias("query_block"), every("row_blocks").alias("row_block"))

    def rerank(rows_: pa.Table, queries_: pa.Table) -> pa.Table:
        found = ([], [], [], [])
        if len(rows_) and len(queries_):
            x, q = (_matrix(t.column("vector").combine_chunks(), width) for t in (rows_, queries_))
            node, first, asking = rows_.column("node").to_numpy(), rows_.column("first").to_numpy(), queries_.column("node").to_numpy()
            for start in range(0, len(q), 256):
                scores = q[start : start + 256] @ x.T
                for i, s in enumerate(scores):
                    near = np.arange(len(s))
                    if len(s) > k + 1:
                        near = np.flatnonzero(s >= np.partition(s, len(s) - k - 1)[len(s) - k - 1])
                    near = near[np.lexsort((first[near], -s[near]))[: k + 1]]
                    found[0].append(np.full(len(near), asking[start + i]))
                    found[1].append(node[near])
                    found[2].append(first[near])
                    found[3].append(s[near])
        types = (pa.int64(), pa.int64(), rows_.schema.field("first").type, pa.float64())
        return pa.table({n: pa.array(np.concatenate(c) if c else [], t) for n, c, t in zip(("query", "node", "first", "score"), found, types)})

    best = left.groupBy(*at).cogroup(right.groupBy(*at)).applyInArrow(rerank, f"query long, node long, first {id_type}, score double")
    best = best.groupBy("query", "node").agg(F.max("score").alias("score"), F.min("first").alias("first"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "first")
    top = best.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= k + 1)
    named = top.join(nodes.select("node", "ids"), "node").select("query", "score", F.explode("ids").alias("id"))
    listed = named.groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "id"))).alias("found"))
    short = listed.select(F.col("query").alias("node"), F.slice("found", 1, k + 1).alias("found"))
    others = F.slice(F.filter("found", lambda f: f["id"] != F.col("query_id")), 1, k)
    return (
        asked.join(short, "node")
        .select("query_id", F.posexplode(others).alias("place", "f"))
        .select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("f.id").alias("vec_id"), (-F.col("f.far")).alias("score"))
    )
