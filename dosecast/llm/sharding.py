"""Near-equal shards by bytes, by histogram sort, in DataFrame operations only.

Rows have a place in one order: by a hash of the text, so that equal texts lie together, then by one of
the key, then by a hash of the row's number in a written table, which parts even rows that are alike in
everything. The three hashes are one key of 62 bits. Splitters cut that order into ``shards * pieces``
cells of near-equal bytes: the exact bytes of 4,096 equal key ranges are counted over all partitions, every range
that holds a wanted splitter is counted again in 256 finer ranges, and so on until each splitter is
within ``tolerance`` of its aim or its range is one key. Then rows are exchanged once, by cell; a shard is
``pieces`` cells in a row, so no task handles a whole shard. A group of copies lies in neighbouring cells and
is cut wherever a splitter falls.

Defined cases: a null text has no bytes and the checksum of an empty one; every row costs ``ROW_BYTES`` more;
a null key is a key like others; repeated rows are parted like others; an empty table has no shards; input
columns are kept (``keep``), those named like a result give way to it.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dosecast.session import materialize

SHARDS = 24
PIECES = 8  # cells in a shard
TOLERANCE = 0.002  # of a shard's bytes, for each splitter
ROW_BYTES = 8
KEY_BITS, TEXT_BITS, ID_BITS = 62, 30, 16
FIRST_BITS, NEXT_BITS = 12, 8
RESULTS = ("size", "text_crc32", "shard", "slot")


def _bits(hashed: Column, bits: int) -> Column:
    return F.shiftrightunsigned(hashed, 64 - bits)


def order_key(text: Column, key: Column, number: Column) -> Column:
    row_bits = KEY_BITS - TEXT_BITS - ID_BITS
    parts = F.shiftleft(_bits(F.xxhash64(text), TEXT_BITS), ID_BITS + row_bits)
    return parts.bitwiseOR(F.shiftleft(_bits(F.xxhash64(key, text), ID_BITS), row_bits)).bitwiseOR(_bits(F.xxhash64(number), row_bits))


def splitters(keyed: DataFrame, cells: int, tolerance: float) -> list[int]:
    """Ascending keys; a row's cell is the number of splitters at or below its key.

    ``tolerance`` is in bytes. Only counts of ranges reach the driver: 4,096 at first, then 256 for each
    open splitter.
    """
    shift = KEY_BITS - FIRST_BITS
    counted = keyed.groupBy(F.shiftright("_key", shift).alias("range")).agg(F.sum("size").alias("bytes")).collect()
    ranges = sorted((r["range"] << shift, r["bytes"]) for r in counted)
    total = sum(b for _, b in ranges)
    if not total:
        return []
    aims = [total * i / cells for i in range(1, cells)]

    def place(edges: list[int], before: list[int], aim: float) -> tuple[int, float]:
        """The edge with bytes before it nearest to the aim."""
        i = bisect_left(before, aim)
        return min(((edges[j], abs(before[j] - aim)) for j in (i - 1, i) if 0 <= j < len(edges)), key=lambda x: x[1])

    def edges_of(found: list[tuple[int, int]], start: int, width: int) -> tuple[list[int], list[int]]:
        edges, before, at = [], [], start
        for low, size in found:
            edges += [low, low + width]
            before += [at, at + size]
            at += size
        return edges, before

    edges, before = edges_of(ranges, 0, 1 << shift)
    chosen, todo = {}, {}
    for aim in aims:
        edge, off = place(edges, before, aim)
        chosen[aim] = edge
        if off > tolerance:
            todo[aim] = None
    known, starts = dict(ranges), {low: b for low, b in zip(edges[::2], before[::2])}
    while todo and shift:
        finer = max(0, shift - NEXT_BITS)
        lows = sorted(starts)
        at = [starts[low] for low in lows]
        for aim in todo:  # the range that holds the aim
            todo[aim] = lows[max(0, bisect_left(at, aim) - 1)]
        wanted = sorted(set(todo.values()))
        within = F.shiftright("_key", shift).isin([low >> shift for low in wanted])
        counted = keyed.filter(within).groupBy(F.shiftright("_key", finer).alias("range")).agg(F.sum("size").alias("bytes")).collect()
        by_parent: dict[int, list[tuple[int, int]]] = {low: [] for low in wanted}
        for r in counted:
            low = r["range"] << finer
            by_parent[low >> shift << shift].append((low, r["bytes"]))
        nested = {}
        for parent, found in by_parent.items():
            found.sort()
            edges, before = edges_of(found, starts[parent], 1 << finer)
            nested.update(zip(edges[::2], before[::2]))
            for aim in [a for a, p in todo.items() if p == parent]:
                edge, off = place(edges, before, aim)
                chosen[aim] = edge
                if off <= tolerance:
                    del todo[aim]
        starts, shift = nested, finer
    return sorted(chosen.values())


def shard_by_bytes(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    keep: list[str] | None = None,
    shards: int = SHARDS,
    pieces: int = PIECES,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """The ``keep`` columns (all by default) and ``size``, ``text_crc32``, ``shard`` and ``slot`` (its place in the shard, from 0).

    The keyed rows are written once to the shared folder, so that every count and the exchange see the
    same order.
    """
    names = [c for c in (df.columns if keep is None else keep) if c.lower() not in RESULTS]
    body, own = F.coalesce(df[f"`{text}`"], F.lit("")), df[f"`{key}`"]
    rows = df.select(
        *[df[f"`{c}`"] for c in names],
        (F.octet_length(body) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        order_key(body, own, F.monotonically_increasing_id()).alias("_key"),
    )
    keyed = materialize(rows, "keyed_rows")
    total = keyed.agg(F.sum("size")).first()[0] or 0
    cuts = splitters(keyed.select("_key", "size"), shards * pieces, tolerance * total / shards)
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>")
    celled = keyed.withColumn("_cell", F.size(F.filter(bounds, lambda b: b <= F.col("_key"))))
    counts = celled.groupBy("_cell").agg(F.count(F.lit(1)).alias("n")).collect()  # one row for each cell
    rows_in = {r["_cell"]: r["n"] for r in counts}
    offsets = []
    for cell in range(shards * pieces):
        offsets.append(0 if cell % pieces == 0 else offsets[-1] + rows_in.get(cell - 1, 0))
    order = Window.partitionBy("_cell").orderBy("_key", F.xxhash64(*[F.col(f"`{c}`") for c in names]) if names else "_key")
    before = F.element_at(F.array(*[F.lit(o).cast("long") for o in offsets]), F.col("_cell") + 1)
    slot = before + F.row_number().over(order) - 1
    return celled.withColumn("slot", slot.cast("long")).select(
        *[F.col(f"`{c}`") for c in names], "size", "text_crc32", F.floor(F.col("_cell") / pieces).cast("int").alias("shard"), "slot"
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder of files for each shard."""
    sharded.write.partitionBy("shard").parquet(path)
