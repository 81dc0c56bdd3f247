"""MinHash near-duplicates by min-max hashing: bands propose, full sets confirm, links make classes.

A text is the set of its distinct word shingles. Every permutation of the hashed shingles gives two values,
the smallest and the largest, so a signature needs half as many permutations as values. A band joins smallest
values of some permutations with largest values of others, so that its values are independent; two sets of
similarity s agree in a band of r values with probability s^r. With 64 bands of 6 values, a pair at 0.8 is missed
with probability 4e-9, a closer one less often.

Equal sets are one node (a 128-bit digest), so a text copied any number of times costs one. Nodes of a small
listing (band and values) are compared pairwise. In a crowded listing every node is compared with one leader, twice, and
links are contracted: copies with small changes are one class after that, and listings of one class are done. Nodes of the
others meet once more, all of them, by the rarest hashes of their sets: two linked sets always share one among the first fifth
of both. What many texts have in common (a passage, a form) is not rare and proposes nothing, classes meet before their nodes
do, and no partner is passed over.

Every link is confirmed on the full sets of 64-bit shingle hashes, recomputed from the texts of nodes in question;
two shingles of a pair share a hash with probability under 1e-9 for a million shingles each.

Defined cases: null and empty texts have an empty set, link with nothing and are classes of their own; a text
with fewer words than a shingle is one shingle; a null key takes part but names a class only where there
is no other, and a row with a null key and an empty set is in the class null; rows that repeat a key share one class if their sets
do, else each has its own; a long text is hashed in pieces of bounded size, of which the 64-bit hashes of its distinct shingles are kept; an empty table gives no rows; other
input columns play no part, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dosecast.llm.common import add_columns, field
from dosecast.llm.simhash import classes
from dosecast.operators.lookup import lookup_join
from dosecast.session import materialize

SHINGLE = 5
PERCENT = 80  # least 100 * intersection / union of a link
BANDS, VALUES = 64, 6  # and the values of a band
MANY = 32  # members of a listing beyond which it is not compared pairwise
TURNS = 2  # of one leader for each node of crowded listings
SALT = 16  # copies of a leader's set, so that a hot leader is not one task
PIECE_BYTES = 1 << 20  # of a text whose words are held at once, up to the next blank
PIECE = 1_024  # shingles that meet all permutations at once
SEED = 20_011
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def word_lists(text: str, length: int) -> Iterator[list[bytes]]:
    """The words of a text, lower-cased in A-Z, some at a time: a list begins with the last ``length - 1`` words of the one before."""
    data, before, at = text.encode().lower(), [], 0
    while at < len(data):
        cut = _BLANK.search(data, at + PIECE_BYTES)
        end = cut.start() if cut else len(data)
        words = before + data[at:end].split()
        yield words
        before, at = words[len(words) - length + 1 :] if len(words) >= length else words, end


def hashed_set(text: str | None, length: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles; with fewer words than ``length`` the whole sequence is one."""
    digest, found, words = xxhash.xxh64_intdigest, [np.empty(0, np.uint64)], []
    for words in word_lists(text or "", length):
        n = len(words) - length + 1
        if n > 0:
            found.append(np.unique(np.fromiter((digest(b" ".join(words[i : i + length])) for i in range(n)), np.uint64, n)))
    if len(found) == 1 and words:
        return np.array([digest(b" ".join(words))], np.uint64)
    return np.unique(np.concatenate(found)) if len(found) > 2 else found[-1]


#: An odd factor for each permutation of the 32-bit values; every one gives a smallest and a largest value.
_FACTORS = np.random.default_rng(SEED).integers(0, 2**32, size=BANDS * VALUES // 2, dtype=np.uint32) | np.uint32(1)


def min_max(hashes: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest value of a set under every permutation, of the upper halves of its hashes."""
    low, high = np.full(len(factors), 2**32 - 1, dtype=np.uint32), np.zeros(len(factors), dtype=np.uint32)
    for start in range(0, len(hashes), PIECE):
        mixed = (hashes[start : start + PIECE] >> np.uint64(32)).astype(np.uint32)[:, None] * factors
        np.minimum(low, mixed.min(axis=0), out=low)
        np.maximum(high, mixed.max(axis=0), out=high)
    return low, high


def band_keys(hashes: np.ndarray) -> list[int]:
    """One signed long for each band: a hash of its number and its values, half smallest, half largest.

    The largest values are those of the next band's permutations, so no permutation lends a band both.
    """
    half = VALUES // 2
    low, high = min_max(hashes, _FACTORS)
    joined = np.concatenate([low.reshape(BANDS, half), np.roll(high.reshape(BANDS, half), -1, axis=0)], axis=1)
    keys = np.array([xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(joined)], dtype=np.uint64)
    return keys.view(np.int64).tolist()


def texts_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, body) and where a row is found again: the digests of its text and of its key."""
    rows = df.select(df[f"`{key}`"].alias("id"), df[f"`{text}`"].alias("body"))
    return rows.withColumn("line", F.unhex(F.md5(F.col("body").cast("binary")))).withColumn("spot", F.xxhash64("id"))


def digests(rows: DataFrame, length: int) -> DataFrame:
    """(id, n, node, bands): the size of each text's set, its digest (null if empty) and the keys of its bands."""

    def printed(text):
        own = hashed_set(text, length)
        return (len(own), xxhash.xxh3_128_digest(own.tobytes()), band_keys(own)) if len(own) else (0, None, [])

    def make():
        return lambda texts: list(zip(*[printed(t) for t in texts])) or [[], [], []]

    return add_columns(rows, "body", make, [field("n", "long"), field("node", "binary"), field("bands", "array<long>")], ["id", "line", "spot"])


def full_sets(rows: DataFrame, firsts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(node, hashes) of the wanted nodes: their whole sets, from the text of one row each, written down."""
    one = firsts.join(wanted, "node", "left_semi").select("node", "at.line", "at.spot")
    texts = rows.join(one, ["line", "spot"]).dropDuplicates(["line", "spot"])  # a key of text and row: copies of a text stay spread

    def make():
        return lambda found: [[hashed_set(t, length).view(np.int64) for t in found]]

    return materialize(add_columns(texts, "body", make, [field("hashes", "array<long>")], ["node"]), "sets")


def overlaps(pairs: DataFrame, sets: DataFrame, hot: str | None = None) -> DataFrame:
    """``pairs`` (a, b, ...) with ``same`` and ``total``: the sizes of intersection and union of the full sets.

    The sets of the side ``hot`` go out in several copies, so that a node in many pairs is several tasks.
    """
    own = pairs.columns
    left, right = (sets.select(F.col("node").alias(c), F.col("hashes").alias(f"{c}_hashes")) for c in "ab")
    if hot is None:
        joined = pairs.join(left, "a").join(right, "b")
    else:
        cold = "a" if hot == "b" else "b"
        spread = F.pmod(F.xxhash64(cold), F.lit(SALT)).cast("int")
        copies = {"a": left, "b": right}[hot].withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        leading = pairs.select(hot).distinct()
        joined = pairs.join({"a": left, "b": right}[cold], cold).withColumn("_salt", spread)
        joined = joined.join(copies.join(leading, hot, "left_semi"), [hot, "_salt"])
    same = F.size(F.array_intersect("a_hashes", "b_hashes")).cast("long")
    measured = joined.select(*own, same.alias("same"), (F.size("a_hashes") + F.size("b_hashes")).alias("_sizes"))
    return measured.select(*own, "same", (F.col("_sizes") - F.col("same")).alias("total"))


def near(percent: int) -> Column:
    return 100 * F.col("same") >= percent * F.col("total")


def listings(keyed: DataFrame, name: str) -> DataFrame:
    """(listing, node, members) of all listings with at least two members."""
    listed = keyed.select("node", F.explode("bands").alias("listing"))
    sizes = listed.groupBy("listing").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    return materialize(listed.join(sizes, "listing"), name)


def pairs_within(listed: DataFrame, sizes: DataFrame, percent: int, roots: DataFrame | None = None) -> DataFrame:
    """Distinct pairs (a, b), a < b, of members of one listing whose set sizes allow a link; with ``roots`` of different classes only."""
    named = listed.select("listing", "node").join(sizes.select("node", "n"), "node")
    named = named.withColumn("root", F.col("node")) if roots is None else named.join(roots, "node")
    a, b = (named.select("listing", F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("root").alias(f"root_{c}")) for c in "ab")
    sized = (100 * F.col("n_a") >= percent * F.col("n_b")) & (100 * F.col("n_b") >= percent * F.col("n_a"))
    return a.join(b, "listing").filter((F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b")) & sized).select("a", "b").distinct()


def contracted(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root): the class of every node so far."""
    found = classes(nodes.select(F.col("node").alias("fp")), edges)
    return materialize(found.select(F.col("fp").alias("node"), "root"), "contracted")


def joined_roots(root: DataFrame, found: DataFrame) -> DataFrame:
    """``root`` (node, root) after the links (a, b) between its nodes were contracted too."""
    ends = [root.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab"]
    moved = found.join(ends[0], "a").join(ends[1], "b").filter("root_a <> root_b")
    between = materialize(moved.select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct(), "between")
    step = contracted(root.select(F.col("root").alias("node")).distinct(), between)
    return materialize(root.join(step.select(F.col("node").alias("root"), F.col("root").alias("next")), "root").select("node", F.col("next").alias("root")), "roots")


def parted(listed: DataFrame, root: DataFrame) -> DataFrame:
    """The rows (listing, node, root) of listings whose members are in more than one class, written down."""
    named = listed.select("listing", "node").join(root, "node")
    mixed = named.groupBy("listing").agg(F.min("root").alias("one"), F.max("root").alias("other")).filter("one <> other").select("listing")
    return materialize(named.join(mixed, "listing").select("listing", "node", "root"), "parted")


def led(live: DataFrame, root: DataFrame, sets: DataFrame, percent: int, turn: int) -> tuple[DataFrame, DataFrame]:
    """Links found, and classes after them, when every node of ``live`` (listing, node, root) is compared with one leader.

    A listing's leader is its member that is in most listings, which has least of its own and is nearest to all others; in
    later turns its first member by a hash. A node takes the first leader of its listings, so there are no more comparisons than nodes.
    """
    ranked = live.join(live.groupBy("node").agg((-F.count(F.lit(1))).alias("rare")), "node")
    order = F.col("rare") if turn == 0 else F.xxhash64("node", F.lit(turn))
    leaders = ranked.groupBy("listing").agg(F.min(F.struct(order.alias("order"), F.col("node").alias("leader"))).alias("first"))
    own = live.select("listing", "node").join(leaders, "listing").groupBy("node").agg(F.min("first").alias("first"))
    asked = own.select(F.col("node").alias("b"), F.col("first.leader").alias("a")).filter("a <> b")
    found = overlaps(asked, sets, hot="a").filter(near(percent)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    found = materialize(found.distinct(), "led")
    return found, joined_roots(root, found)


def prefix_pairs(live: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of nodes (node, root) of different classes that may be linked, none left out.

    The hashes of a set are ordered by how few of the nodes hold them. Two linked sets share a hash among the first
    ``n - ceil(percent * n / 100) + 1`` of both; what many nodes have in common comes last, so it proposes
    no pair of texts that differ in enough else. At the first hash that a pair shares, what follows in the shorter rest bounds the overlap.
    """
    held = sets.join(live, "node").select("node", "root", F.size("hashes").alias("n"), F.explode("hashes").alias("hash"))
    often = held.groupBy("hash").agg(F.count(F.lit(1)).alias("often"))
    ordered = held.join(often, "hash").groupBy("node", "root", "n").agg(F.array_sort(F.collect_list(F.struct("often", "hash"))).alias("own"))
    first = (F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1).cast("int")
    prefix = materialize(ordered.select("node", "root", "n", F.posexplode(F.slice("own", 1, first)).alias("at", "h")).select("node", "root", "n", "at", "h.hash"), "prefixes")
    # Classes meet before their nodes do, so that the many nodes of one class are not compared with each other.
    mixed = prefix.groupBy("hash").agg(F.min("root").alias("one"), F.max("root").alias("other")).filter("one <> other").select("hash")
    shared = materialize(prefix.join(mixed, "hash"), "shared")
    enough = lambda a, b, sizes: (100 + percent) * F.least(a, b) >= percent * sizes
    of = shared.groupBy("hash", "root").agg(F.max(F.col("n") - F.col("at")).alias("rest"), F.min("n").alias("least"))
    ends = [of.select("hash", *[F.col(x).alias(f"{x}_{c}") for x in ("root", "rest", "least")]) for c in "ab"]
    may = enough(F.col("rest_a"), F.col("rest_b"), F.col("least_a") + F.col("least_b"))
    classes_met = ends[0].join(ends[1], "hash").filter((F.col("root_a") < F.col("root_b")) & may).select("hash", "root_a", "root_b", "rest_b", "least_b")
    a, b = (shared.select("hash", *[F.col(x).alias(f"{x}_{c}") for x in ("node", "root", "n", "at")]) for c in "ab")
    rest = enough(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"), F.col("n_a") + F.col("n_b"))  # with the shared hash itself
    sized = (100 * F.col("n_a") >= percent * F.col("n_b")) & (100 * F.col("n_b") >= percent * F.col("n_a"))
    one = classes_met.join(a, ["hash", "root_a"]).filter(enough(F.col("n_a") - F.col("at_a"), F.col("rest_b"), F.col("n_a") + F.col("least_b")))
    met = one.join(b, ["hash", "root_b"]).filter(rest & sized)
    return met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def links(rows: DataFrame, firsts: DataFrame, length: int, percent: int) -> DataFrame:
    """(a, b): confirmed links between distinct sets that put every two linked texts into one class."""
    listed = listings(firsts, "listings")
    crowded = listed.filter(F.col("members") > MANY)
    pairs = materialize(pairs_within(listed.filter(F.col("members") <= MANY), firsts, percent), "pairs")
    again = materialize(crowded.select("node").distinct(), "crowded")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).union(again).distinct()
    sets = full_sets(rows, firsts, wanted, length)
    edges = materialize(overlaps(pairs, sets).filter(near(percent)).select("a", "b"), "edges")
    if again.isEmpty():
        return edges
    root = materialize(contracted(firsts.select("node"), edges).join(again, "node", "left_semi"), "roots")
    # Copies of one text with small changes become one class here, at one comparison a node and turn.
    live = parted(crowded, root)
    for turn in range(TURNS):
        found, root = led(live, root, sets, percent, turn)
        edges, live = edges.unionByName(found), parted(live, root)

    left = materialize(live.select("node", "root").distinct(), "left")
    apart = materialize(prefix_pairs(left, sets, percent), "pairs")
    return edges.unionByName(overlaps(apart, sets).filter(near(percent)).select("a", "b")).distinct()


def minhash_classes(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per text: (key, n_shingles, component_id, kept); ``kept`` says that the row names its class."""
    rows = texts_of(df, key, text)
    printed = materialize(digests(rows, shingle), "printed")
    grouped = printed.filter("n > 0").groupBy("node").agg(
        F.min("id").alias("least_key"), F.min(F.struct("line", "spot")).alias("at"), F.max("n").alias("n"), F.first("bands").alias("bands")
    )
    firsts = materialize(grouped, "firsts")
    found = contracted(firsts.select("node"), materialize(links(rows, firsts, shingle, percent), "edges"))
    named = found.join(firsts.select("node", "least_key"), "node")
    least = named.groupBy("root").agg(F.min("least_key").alias("least"))
    component = materialize(named.join(least, "root").select("node", "least"), "components")
    joined = lookup_join(printed.select("id", "n", "node"), component, ["node"])  # a node may hold a third of all rows
    component_id = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("least"))
    return joined.select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), component_id.alias("component_id"), F.col("id").eqNullSafe(component_id).alias("kept")
    )
