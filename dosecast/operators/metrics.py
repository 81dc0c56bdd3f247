"""Scores of predictions, from one long table (group columns, y, p)."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from dosecast.functions.hashing import md5_key, md5_long
from dosecast.functions.tdist import two_sided_p
from dosecast.operators.lookup import lookup_join
from dosecast.operators.ranking import RankTable, average_rank_table, null_safe_corr, random_order
from dosecast.session import materialize

# Groups are drawn from and ranked inside tasks only up to this many rows.
REPLICATE_ROWS = 4_000_000
PART_DRAWS = 250_000  # of the largest such group in one task, about
BUNDLE_ROWS = 16_000_000  # rows of the groups that share their draws, about
PACKED_ROWS = 250_000  # rows that a task packs, about, where groups are no larger
HELD_DRAWS = 64_000_000  # counts of drawn rows that a task holds at a time, about
MOST_TASKS = 10_000
GROUP_COST = 2_000  # rows that a group counts for besides its own
LEAST_REPLICATES = 20  # of a task, whatever the rows: at most 1 / 20 of the replicates are copies of the rows
DRAWS_PER_TASK = 5_000_000
BLOCK_DRAWS = 20_000_000_000  # draws shuffled or written at a time


def mse(y: str = "y", p: str = "p") -> Column:
    """Mean squared error."""
    return F.avg((F.col(y) - F.col(p)) * (F.col(y) - F.col(p)))


def r2(y: str = "y", p: str = "p") -> Column:
    """1 - SSE/SST; a constant truth scores 1 when predicted exactly, else 0; null below two rows."""
    residual = F.sum((F.col(y) - F.col(p)) * (F.col(y) - F.col(p)))
    spread = F.var_pop(y) * F.count(y)
    score = F.when(spread > 0, 1 - F.try_divide(residual, spread)).when(residual == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(F.count(y) > 1, score)


def complete_pairs(pairs: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    return pairs.filter(F.col(y).isNotNull() & F.col(p).isNotNull())


def spearman(pairs: DataFrame, group: Sequence[str] = (), y: str = "y", p: str = "p", **rank_args) -> DataFrame:
    """Rank correlation with average ranks; one row per group (``n``, ``spearman``).

    Null when a side is constant, NaN when a value of the group is NaN.
    """
    group = list(group)
    pairs = complete_pairs(pairs, y, p).select(*group, y, p)

    @inheritable_thread_target(pairs.sparkSession)
    def rank_side(side: tuple[str, str]) -> RankTable:
        return average_rank_table(pairs, side[0], group, side[1], **rank_args)

    with ThreadPool(2) as pool:  # the two sides do not wait for each other
        y_ranks, p_ranks = pool.map(rank_side, [(y, "_ry"), (p, "_rp")])
    ranked = p_ranks.attach(y_ranks.attach(pairs))
    return ranked.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), rank_corr(y, p).alias("spearman"))


def rank_corr(y: str, p: str, ry: str = "_ry", rp: str = "_rp") -> Column:
    broken = F.bool_or(F.isnan(y) | F.isnan(p))
    return F.when(broken, F.lit(float("nan"))).otherwise(null_safe_corr(ry, rp))


def spearman_t(r: str = "spearman", n: str = "n") -> Column:
    """t statistic of a rank correlation; infinite at |r| = 1, null below three rows."""
    rho = F.col(r)
    room = (1 + rho) * (1 - rho)
    t = rho * F.sqrt(F.try_divide(F.col(n) - 2, F.when(room > 0, room)))
    return F.when(F.col(n) > 2, F.coalesce(t, F.when(F.abs(rho) >= 1, rho * F.lit(float("inf")))))


def with_spearman_p(scores: DataFrame, r: str = "spearman", n: str = "n") -> DataFrame:
    """Add the two-sided p-value (Student t with n - 2 degrees of freedom)."""

    @F.pandas_udf("double")
    def tail(rho: pd.Series, rows: pd.Series) -> pd.Series:
        return pd.Series([two_sided_p(a, b) for a, b in zip(rho, rows)], dtype="float64")

    return scores.withColumn("spearman_p", tail(F.col(r), F.col(n).cast("double")))


def percentiles(value: str, points: Sequence[float]) -> Column:
    """Linearly interpolated percentiles (fractions in [0, 1])."""
    return F.percentile(value, F.array(*[F.lit(float(x)) for x in points]))


@dataclass
class BootstrapRows:
    """The rows to draw from, numbered from 0 in each group, and their sizes."""

    rows: DataFrame
    sizes: DataFrame
    group: list[str]
    largest: int
    total: int
    seed: int

    def draws(self, replicates: range) -> DataFrame:
        """n draws with replacement per replicate: rows (group, rep, y, p).

        Draw i of replicate r takes the row at position md5(seed:r:i) mod n.
        """
        cores = self.rows.sparkSession.sparkContext.defaultParallelism
        tasks = max(cores, self.total * len(replicates) // DRAWS_PER_TASK)
        slots = self.rows.select(*self.group, F.col("_pos").alias("_slot")).repartition(tasks, *self.group, "_slot")
        if self.group:
            slots = lookup_join(slots, self.sizes, self.group, "inner")
        else:
            slots = slots.withColumn("_n", F.lit(self.largest))
        draws = slots.withColumn("rep", F.explode(F.sequence(F.lit(replicates[0]), F.lit(replicates[-1]))))
        at = F.coalesce(F.pmod(md5_long(self.seed, F.col("rep"), F.col("_slot")), F.col("_n")), F.lit(0))
        drawn = draws.select(*self.group, "rep", at.alias("_pos"))
        return lookup_join(drawn, self.rows, [*self.group, "_pos"], "inner", even=True).drop("_pos")


def bootstrap_rows(pairs: DataFrame, key: str, seed: int, group: Sequence[str] = ()) -> BootstrapRows:
    group = list(group)
    base = random_order(complete_pairs(pairs).select(*group, key, "y", "p"), key, seed, group, "_pos")
    base = materialize(base.select(*group, (F.col("_pos") - 1).alias("_pos"), "y", "p"), "bootstrap_rows")
    sizes = materialize(base.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")), "bootstrap_sizes")
    found = sizes.agg(F.max("_n").alias("largest"), F.sum("_n").alias("total")).first()
    return BootstrapRows(base, sizes, group, found["largest"] or 0, found["total"] or 0, seed)


def replicate_correlations(base: BootstrapRows, n_bootstrap: int) -> DataFrame:
    """Spearman per (group, rep) of large groups, piece by piece, in blocks of replicates that bound the draws in flight."""
    by = [*base.group, "rep"]
    step = max(1, BLOCK_DRAWS // max(base.total, 1))
    blocks = [range(at, min(at + step, n_bootstrap)) for at in range(0, n_bootstrap, step)]
    return reduce(DataFrame.unionByName, [materialize(spearman(materialize(base.draws(b), "draws"), by), "replicates") for b in blocks])


def midranks(weight: np.ndarray) -> np.ndarray | None:
    """Average ranks, around their mean, of classes that hold ``weight`` rows each; null when one class holds all rows."""
    if np.count_nonzero(weight) < 2:
        return None
    upto = np.cumsum(weight)
    return upto - weight / 2 - upto[-1] / 2  # average ranks, but for a constant


def drawn_corr(times: np.ndarray, y_ranks: np.ndarray | None, y_squares: float, order: np.ndarray, y_class: np.ndarray, starts: np.ndarray) -> float | None:
    """Rank correlation of rows drawn so many ``times``, by their places; null where a side is constant.

    ``order`` has the rows by p, ``y_class`` their values of y in that order, and ``starts`` where each value of p begins.
    """
    if y_ranks is None:
        return None
    here = times.take(order, mode="clip").astype(np.float64)
    weight = np.add.reduceat(here, starts)
    p_ranks = midranks(weight)
    if p_ranks is None:
        return None
    here *= y_ranks.take(y_class, mode="clip")
    return float(np.add.reduceat(here, starts) @ p_ranks / np.sqrt(y_squares * ((weight * p_ranks) @ p_ranks)))


MD5_SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
MD5_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
MD5_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
LOW_DIGITS = 4  # of the numbers that are digested side by side
PLAIN_DRAWS = 1_000  # a power of ten: numbers below it are too few to be digested side by side
ONE_BLOCK = 55  # bytes that a block of md5 takes


def md5_numbers(prefix: bytes, high: bytes, digits: int) -> np.ndarray:
    """The leading 64 bits of md5(prefix + high + number) of all numbers of so many ``digits``, zeros in front.

    One round after the other over all numbers; of the 16 words of a message only those with digits differ.
    """
    text = prefix + high + b"0" * digits
    block = bytearray(text + b"\x80" + bytes(63 - len(text)))
    block[56:64] = (8 * len(text)).to_bytes(8, "little")
    words: list = np.frombuffer(bytes(block), "<u4").tolist()
    number = np.arange(10**digits, dtype=np.uint32)
    for k in range(digits):
        at = len(text) - 1 - k
        words[at // 4] = words[at // 4] + (number // np.uint32(10**k) % np.uint32(10) << np.uint32(8 * (at % 4)))
    a, b, c, d = (np.full(len(number), v, np.uint32) for v in MD5_START)
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        if isinstance(words[g], int):
            f += np.uint32((MD5_SINES[i] + words[g]) & 0xFFFFFFFF)
        else:
            f += words[g]
            f += np.uint32(MD5_SINES[i])
        turned = f << np.uint32(MD5_SHIFTS[i])
        f >>= np.uint32(32 - MD5_SHIFTS[i])
        turned |= f
        turned += b
        a, d, c, b = d, c, b, turned
    found = np.empty((len(number), 2), "<u4")
    found[:, 0], found[:, 1] = a + np.uint32(MD5_START[0]), b + np.uint32(MD5_START[1])
    return found.reshape(-1).view(">u8")


def draw_hashes(seed: int, replicate: int, n: int) -> np.ndarray:
    """md5(seed:replicate:i) of the first ``n`` draws, which is the same for every group."""
    prefix = f"{seed}:{replicate}:".encode()
    found = np.empty(n, np.int64)
    at = n if len(prefix) + len(str(n)) > ONE_BLOCK else min(n, PLAIN_DRAWS)
    found[:at] = [int.from_bytes(hashlib.md5(prefix + b"%d" % i).digest()[:8], "big") >> 4 for i in range(at)]
    while at < n:  # numbers that differ in their last digits only
        text = str(at).encode()
        digits = min(LOW_DIGITS, len(text) - 1)
        hashes = md5_numbers(prefix, text[:-digits], digits)[: n - at]
        found[at : at + len(hashes)] = hashes.astype(np.uint64) >> np.uint64(4)
        at += len(hashes)
    return found


def draw_times(hashes: np.ndarray, n: int) -> np.ndarray:
    """How often each of ``n`` positions is drawn: draw i takes position ``hashes[i]`` mod n."""
    return np.bincount(hashes[:n] % n, minlength=n)


def numbered(values: np.ndarray) -> bytes:
    """The classes of values in order, each in as few bytes as the number of classes needs."""
    found, classes = np.unique(values, return_inverse=True)
    return classes.astype(np.min_scalar_type(max(len(found) - 1, 0))).tobytes()


def unnumbered(cells: pa.Buffer, n: int) -> np.ndarray:
    """What ``numbered`` wrote of ``n`` values; the bytes tell the width of a number."""
    return np.frombuffer(cells, f"<u{cells.size // n}").astype(np.intp)


def value_classes(pairs: DataFrame, key: str, group: Sequence[str], seed: int) -> DataFrame:
    """(group, _n, _y, _order, _starts, _broken) of groups that each fit one task, their rows packed in the order they are drawn from.

    ``_y`` numbers y's values in order; ``_order`` has the rows by p, and ``_starts`` the first row of each of p's values there.
    Broken rows hold a NaN, and are listed only where there are any.
    """
    group = list(group)
    # The key itself need not travel: keys of one digest are equal.
    keyed = pairs.select(*group, F.unhex(md5_key(seed, F.col(key))).alias("_hash"), F.col("y").cast("double").alias("y"), F.col("p").cast("double").alias("p"))
    packed = [T.StructField("_n", T.IntegerType()), *[T.StructField(c, T.BinaryType()) for c in ("_y", "_order", "_starts", "_broken")]]
    schema = T.StructType([*[keyed.schema[g] for g in group], *packed])
    arrow = to_arrow_schema(schema)

    def pack(rows: pa.Table) -> pa.Table:
        halves = np.concatenate([binary_halves(c) for c in rows.column("_hash").chunks])
        y, p = rows.column("y").to_numpy(), rows.column("p").to_numpy()
        order = np.lexsort((p, y, halves[:, 1], halves[:, 0]))
        y, p = y[order], p[order]
        broken = np.isnan(y) | np.isnan(p)
        by_p = np.argsort(p, kind="stable")
        starts = np.append(0, np.flatnonzero(p[by_p][1:] != p[by_p][:-1]) + 1)  # each NaN is a value here: a replicate that draws one has no correlation
        cells = [len(y), numbered(y), by_p.astype("<u4").tobytes(), starts.astype("<u4").tobytes(), broken.tobytes() if broken.any() else b""]
        return pa.Table.from_arrays([pa.array([v], t) for v, t in zip([*[rows.column(g)[0].as_py() for g in group], *cells], arrow.types)], schema=arrow)

    return materialize(keyed.groupBy(*group).applyInArrow(pack, schema), "value_classes")


def binary_halves(column: pa.Array) -> np.ndarray:
    """The two 64-bit halves of 16-byte cells, whose order is that of the cells."""
    start = int.from_bytes(memoryview(column.buffers()[1])[4 * column.offset : 4 * column.offset + 4], "little")
    return np.frombuffer(column.buffers()[2], ">u8", 2 * len(column), start).reshape(-1, 2).astype(np.uint64)


def replicates_in_parts(pairs: DataFrame, key: str, sizes: DataFrame, group: Sequence[str], n_bootstrap: int, seed: int) -> DataFrame:
    """(group, rep, spearman) for groups that each fit one task; ``sizes`` has their rows in ``_n``.

    The draws never leave the task that makes them. A draw's hash does not depend on the group, so groups meet in bundles
    of bounded rows, and each of a bundle's tasks hashes the draws of some replicates once for all its groups. Values are ordered once a group.
    """
    group = list(group)
    most, cost, count = sizes.agg(F.max("_n"), F.sum(F.col("_n") + GROUP_COST), F.count(F.lit(1))).first()
    each = min(n_bootstrap, max(LEAST_REPLICATES, PART_DRAWS // most))
    own = lookup_join(pairs, materialize(sizes.select(*group), "small"), group, "inner") if group else pairs
    if group:
        cores = pairs.sparkSession.sparkContext.defaultParallelism
        own = own.repartition(min(2 * count, max(cores, cost // PACKED_ROWS)), *group)
    packed = value_classes(own, key, group, seed)
    bundles, parts = -(-cost // BUNDLE_ROWS), -(-n_bootstrap // each)
    bundle = F.pmod(F.xxhash64(*group), F.lit(bundles)) if group else F.lit(0)
    shared = packed.withColumn("_bundle", bundle.cast("long")).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    tasks = min(bundles * parts, MOST_TASKS)
    shared = shared.repartitionById(tasks, F.pmod(F.col("_bundle") * parts + F.col("_part"), F.lit(tasks)).cast("int")).sortWithinPartitions("_bundle", "_part", "_n", F.xxhash64("_y"))
    kinds = [packed.schema[g] for g in group]
    schema = T.StructType([*kinds, T.StructField("rep", T.IntegerType()), T.StructField("spearman", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def replicates(rows: pa.Table) -> pa.Table:
        part, sizes = rows.column("_part")[0].as_py(), rows.column("_n").to_pylist()
        reps = range(part * each, min((part + 1) * each, n_bootstrap))
        found = np.empty((len(reps), rows.num_rows), dtype=object)
        step = max(1, HELD_DRAWS // sum(set(sizes)))
        for start in range(0, len(reps), step):
            some = reps[start : start + step]
            times: dict[int, list] = {n: [] for n in sizes}
            for rep in some:
                hashes = draw_hashes(seed, rep, max(sizes))
                for n, held in times.items():
                    drawn = draw_times(hashes, n)
                    held.append(drawn.astype(np.min_scalar_type(drawn.max())))
            y_sides: dict[tuple, list] = {}  # groups whose rows have the same y, such as the variants of a text, share that side
            for i, n in enumerate(sizes):
                y, order, starts, broken = (rows.column(c)[i].as_buffer() for c in ("_y", "_order", "_starts", "_broken"))
                by_y, y_class = (n, hashlib.md5(y).digest()), unnumbered(y, n)
                if by_y not in y_sides:
                    weights = [np.bincount(y_class, drawn) for drawn in times[n]]
                    y_sides = {by_y: [(ranks, 0.0 if ranks is None else float((w * ranks) @ ranks)) for w, ranks in zip(weights, map(midranks, weights))]}
                order, starts, broken = np.frombuffer(order, "<u4").astype(np.intp), np.frombuffer(starts, "<u4").astype(np.intp), np.frombuffer(broken, bool)
                y_class = y_class[order]
                for at, (drawn, side) in enumerate(zip(times[n], y_sides[by_y]), start):
                    bad = len(broken) and drawn[broken].any()
                    found[at, i] = float("nan") if bad else drawn_corr(drawn, *side, order, y_class, starts)
        own = rows.select(group).take(pa.array(np.tile(np.arange(rows.num_rows), len(reps))))
        return pa.table([*own.columns, pa.array(np.repeat(np.array(reps), rows.num_rows), pa.int32()), pa.array(found.reshape(-1).tolist(), pa.float64())], schema=arrow)

    def by_task(batches):
        held, at = [], None
        for batch in batches:
            for i in range(len(batch)):
                here = (batch.column("_bundle")[i].as_py(), batch.column("_part")[i].as_py())
                if held and here != at:
                    yield from replicates(pa.Table.from_batches(held)).to_batches()
                    held = []
                at = here
                held.append(batch.slice(i, 1))
        if held:
            yield from replicates(pa.Table.from_batches(held)).to_batches()

    return materialize(shared.mapInArrow(by_task, schema), "replicates")


def bootstrap_ci(
    pairs: DataFrame,
    key: str,
    group: Sequence[str] = (),
    n_bootstrap: int = 1000,
    alpha: float = 0.05,
    seed: int = 42,
    y: str = "y",
    p: str = "p",
    replicate_rows: int = REPLICATE_ROWS,
) -> DataFrame:
    """Percentile bootstrap interval of the rank correlation, one row per group.

    Replicates without a correlation (a constant side, a NaN) are dropped and counted.
    """
    group = list(group)
    pairs = pairs.select(*group, key, F.col(y).alias("y"), F.col(p).alias("p"))
    pairs = complete_pairs(pairs)
    sizes = materialize(pairs.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 0"), "bootstrap_sizes")
    small, large = sizes.filter(F.col("_n") <= replicate_rows), sizes.filter(F.col("_n") > replicate_rows)
    found = []
    if not small.isEmpty():
        found.append(replicates_in_parts(pairs, key, small, group, n_bootstrap, seed))
    if not large.isEmpty():
        own = lookup_join(pairs, materialize(large.select(*group), "large"), group, "inner") if group else pairs
        found.append(replicate_correlations(bootstrap_rows(own, key, seed, group), n_bootstrap).select(*group, "rep", "spearman"))
    if not found:
        found.append(pairs.limit(0).select(*group, F.lit(0).alias("rep"), F.lit(None).cast("double").alias("spearman")))
    reps = reduce(DataFrame.unionByName, found)
    reps = reps.withColumn("spearman", F.when(~F.isnan("spearman"), F.col("spearman")))
    bounds = percentiles("spearman", [alpha / 2, 1 - alpha / 2])
    return (
        reps.groupBy(*group)
        .agg(
            bounds.alias("_bounds"),
            F.count("spearman").alias("replicates"),
            F.count_if(F.col("spearman").isNull()).alias("dropped_replicates"),
        )
        .select(
            *group,
            F.get("_bounds", F.lit(0)).alias("ci_lower"),
            F.get("_bounds", F.lit(1)).alias("ci_upper"),
            "replicates",
            "dropped_replicates",
        )
    )


def score_predictions(
    predictions: DataFrame, group: Sequence[str], key: str, n_bootstrap: int = 1000, alpha: float = 0.05, seed: int = 42
) -> DataFrame:
    """All metrics, one row per group of a written long prediction table."""
    group = list(group)
    errors = complete_pairs(predictions).groupBy(*group).agg(mse().alias("mse"), r2().alias("r2"))
    ranks = with_spearman_p(spearman(predictions, group))
    scores = errors.join(ranks, group)
    if n_bootstrap:
        scores = scores.join(bootstrap_ci(predictions, key, group, n_bootstrap, alpha, seed), group)
    return scores


def metrics_table(scores: DataFrame, group: Sequence[str], split: str = "split") -> DataFrame:
    """One row per model (and group): validation and test metrics side by side, and the replicates intervals rest on."""
    names = ("mse", "r2", "spearman", "spearman_p", "ci_lower", "ci_upper", "replicates", "dropped_replicates")
    values = [c for c in names if c in scores.columns]
    picks = [
        F.max(F.when(F.col(split) == short, F.col(v))).alias(f"{long}_{v}")
        for short, long in (("val", "validation"), ("test", "test"))
        for v in values
    ]
    return scores.groupBy(*group).agg(*picks)


def loss_epoch_mean(
    losses: DataFrame, loss: str = "loss", epoch: Sequence[str] = ("epoch",), batch: str = "batch"
) -> DataFrame:
    """Mean of the batch losses of an epoch, every batch counting alike."""
    per_batch = losses.groupBy(*epoch, batch).agg(F.avg(loss).alias("_batch_loss"))
    return per_batch.groupBy(*epoch).agg(F.avg("_batch_loss").alias("epoch_loss"))
