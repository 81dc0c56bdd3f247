"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified links, connected classes.

A fingerprint has 64 bits; two of them that differ in at most ``distance`` bits agree in at least
``blocks - distance`` of the blocks that the bits are split into. Every fingerprint is therefore listed
under each choice of that many blocks, and only fingerprints listed together are compared bit by bit.
A listing with many members is not compared pairwise: each member names itself and all values one bit
away (``ceil(distance / 2)`` bits in general), and members that name the same value are neighbours of it;
two members within the distance always name a common value, and the few that name one are compared.

Equal fingerprints are one node, so a text copied any number of times costs one. Classes are found by
contracting the graph: every node joins its smallest neighbour, the joined nodes become one, until no link
is left; each step is a few joins, written to the shared folder.

Defined cases: a null or empty text has no words and fingerprint zero, linked like any other; a text with
fewer words than a shingle is one shingle; a null key takes part but is never a class's name unless the
class has no other; repeated rows share a class; other input columns play no part.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dosecast.llm.common import add_columns, field
from dosecast.session import materialize

SHINGLE = 3
DISTANCE = 2
BLOCKS = 4
BITS = 64
SEED = 42
MANY = 64  # members of a listing beyond which it is not compared pairwise
PIECE = 200_000  # words whose hashes are held at once


def _add_votes(votes: np.ndarray, hashes: list) -> None:
    bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
    votes += bits.sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64 majority bits of a text's shingle hashes; zero without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    votes = np.zeros(BITS, dtype=np.int64)
    for start in range(0, n, PIECE):
        _add_votes(votes, [digest(b" ".join(words[i : i + shingle]), SEED) for i in range(start, min(n, start + PIECE))])
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


def fingerprints(df: DataFrame, key: str, text: str, shingle: int, keep: list[str] | None = None) -> DataFrame:
    """The kept columns and ``fp``, the fingerprint as a signed long."""

    def make():
        def work(texts):
            found = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64)
            return [found.view(np.int64)]

        return work

    return add_columns(df, text, make, [field("fp", "long")], keep or [key])


def _bounds(blocks: int) -> list[tuple[int, int]]:
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    return list(zip(edges, edges[1:]))


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def block_masks(blocks: int, distance: int) -> list[int]:
    """Bit masks of every choice of ``blocks - distance`` blocks."""
    masks = []
    for chosen in combinations(_bounds(blocks), blocks - distance):
        masks.append(sum(((1 << (b - a)) - 1) << a for a, b in chosen))
    return masks


def _differing(a: str | Column, b: str | Column) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.bit_count(a.bitwiseXOR(b))


def links(nodes: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """(a, b) with a < b: verified links between distinct fingerprints ``fp`` that connect all within the distance.

    In small listings every pair within the distance is a link; in large ones as many as keep the
    classes connected.
    """
    if blocks <= distance:
        raise ValueError("more blocks than differing bits are needed")
    masks = block_masks(blocks, distance)
    listed = nodes.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.lit(_signed(m)).alias("mask")) for i, m in enumerate(masks)])).alias("m"))
    listed = listed.select("fp", F.col("m.choice").alias("choice"), F.col("fp").bitwiseAND(F.col("m.mask")).alias("part"))
    listing = ["choice", "part"]
    sizes = listed.groupBy(*listing).agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    shared = materialize(listed.join(sizes, listing), "listings")  # most fingerprints share no listing
    few = shared.filter(F.col("members") <= MANY)
    left, right = few.select(*listing, F.col("fp").alias("a")), few.select(*listing, F.col("fp").alias("b"))
    pairs = left.join(right, listing).filter((F.col("a") < F.col("b")) & (_differing("a", "b") <= distance)).select("a", "b")
    many = shared.filter(F.col("members") > MANY)
    if many.isEmpty():
        return pairs.distinct()
    return pairs.unionByName(crowded_links(many.select("fp").distinct(), distance)).distinct()


def crowded_links(nodes: DataFrame, distance: int) -> DataFrame:
    """Links among fingerprints of large listings, through the values near them."""
    reach = (distance + 1) // 2
    flips = [0]
    for n in range(1, reach + 1):
        flips += [_signed(sum(1 << b for b in bits)) for bits in combinations(range(BITS), n)]
    named = nodes.select("fp", F.explode(F.array(*[F.lit(f).cast("long") for f in flips])).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("near"))
    # At most 65 values lie within one bit of a value, so these groups are small whatever the listing's size.
    both = named.groupBy("near").agg(F.collect_list("fp").alias("members")).filter(F.size("members") > 1)
    if distance == 2 * reach:  # all that name one value are within the distance of each other
        return both.select(F.array_min("members").alias("a"), F.explode("members").alias("b")).filter("a <> b")
    a, b = both.select(F.explode("members").alias("a"), "members"), F.explode("members").alias("b")
    return a.select("a", b).filter((F.col("a") < F.col("b")) & (_differing("a", "b") <= distance))


def _roots(parent: DataFrame) -> DataFrame:
    """(node, parent) with every parent replaced by the end of its chain; chains halve with each pass."""
    while True:
        above = parent.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        jumped = materialize(parent.join(above, "parent").select("node", "grand", (F.col("grand") != F.col("parent")).alias("moved")), "parents")
        parent = jumped.select("node", F.col("grand").alias("parent"))
        if jumped.filter("moved").isEmpty():
            return parent


def classes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(fp, root) for every node: the class that the edges put it in.

    Every node with a link has its smallest neighbour, or itself, as parent; trees of parents become
    one node each, which leaves at most half of the nodes.
    """
    linked = edges.select(F.col("a").alias("fp")).union(edges.select(F.col("b").alias("fp"))).distinct()
    member = materialize(linked.select("fp", F.col("fp").alias("root")), "members")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        smallest = both.groupBy("a").agg(F.min("b").alias("least"))
        root = _roots(materialize(smallest.select(F.col("a").alias("node"), F.least("a", "least").alias("parent")), "parents"))
        step = root.select(F.col("node").alias("root"), F.col("parent").alias("next"))
        member = materialize(member.join(step, "root", "left").select("fp", F.coalesce("next", "root").alias("root")), "members")
        ends = [root.select(F.col("node").alias(c), F.col("parent").alias(f"to_{c}")) for c in ("a", "b")]
        moved = edges.join(ends[0], "a").join(ends[1], "b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
        edges = materialize(moved.filter("a <> b").distinct(), "edges")
    return nodes.join(member, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def fingerprint_classes(printed: DataFrame, key: str, distance: int, blocks: int) -> DataFrame:
    """(fp, root, component_id) for every fingerprint of ``printed`` (key, fp), which is written already."""
    nodes = materialize(printed.groupBy("fp").agg(F.min(key).alias("least_key")), "fingerprints")
    rooted = classes(nodes.select("fp"), materialize(links(nodes, distance, blocks), "edges"))
    named = rooted.join(nodes, "fp")
    least = named.groupBy("root").agg(F.min("least_key").alias("component_id"))
    return materialize(named.join(least, "root").select("fp", "root", "component_id"), "classes")


def simhash_classes(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """One row per text: (key, fingerprint in hex, component_id), the smallest key of its class."""
    printed = materialize(fingerprints(df, key, text, shingle), "printed")
    found = fingerprint_classes(printed, key, distance, blocks).select("fp", "component_id")
    return printed.join(found, "fp").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_classes(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """``df`` with one row of each class: that with the smallest key, then the smallest other columns."""
    columns = df.columns
    keyed = df.select(*[F.col(f"`{c}`") for c in columns], df[f"`{text}`"].alias("_shingled"))
    printed = materialize(fingerprints(keyed, key, "_shingled", shingle, [*columns]), "printed")
    found = fingerprint_classes(printed.select(key, "fp"), key, distance, blocks)
    named = printed.join(found, "fp").filter(F.col(key).eqNullSafe(F.col("component_id")))
    order = Window.partitionBy("root").orderBy(F.col(key).asc_nulls_last(), *[F.col(f"`{c}`") for c in columns if c != key])
    return named.withColumn("_place", F.row_number().over(order)).filter("_place = 1").select(*[F.col(f"`{c}`") for c in columns])
