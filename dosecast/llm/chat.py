"""Preference pairs for chat training, in DataFrame operations only.

A chosen and a rejected conversation are compared turn by turn. Their longest common prefix of turns is
the prompt, rendered once and never trained on; the rest of either side is its completion, in which the
turns of one role (the assistant) are trained on. Turns are rows from start to end, and a turn's place is
part of every key, so neither a long conversation nor a frequent first turn meets in one task; the prefix
length is a minimum over differing places. ``pair_records`` puts the segments of a pair together where a
consumer wants one record.

Defined cases: turns are ordered by number, then role, then text; a null number comes first, null roles and
texts count as empty; repeated turns are turns of their own; a conversation missing on one side leaves the
prompt empty; if one side is a prefix of the other, its completion is empty; rows without a pair key play no
part; other input columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dosecast.session import materialize

# The markers of a rendered turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"


def turns(df: DataFrame, pair: str, turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(pair, turn, copy, role, text, digest): ``copy`` numbers the rows that share a pair and a turn; written down.

    ``digest`` stands for role and text where turns are compared, so that texts need not travel for it.
    """
    rows = df.filter(df[f"`{pair}`"].isNotNull()).select(
        df[f"`{pair}`"].alias("pair"),
        F.coalesce(df[f"`{turn}`"].cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce(df[f"`{role}`"], F.lit("")).alias("role"),
        F.coalesce(df[f"`{text}`"], F.lit("")).alias("text"),
    )
    # Equal rows are counted before they are numbered, so a row repeated without end is one row here.
    counted = rows.groupBy("pair", "turn", "role", "text").agg(F.count(F.lit(1)).alias("_times"))
    order = Window.partitionBy("pair", "turn").orderBy("role", "text").rowsBetween(Window.unboundedPreceding, -1)
    first = counted.withColumn("_before", F.coalesce(F.sum("_times").over(order), F.lit(0)))
    copies = first.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))).alias("_copy"))
    numbered = copies.select("pair", "turn", (F.col("_before") + F.col("_copy")).alias("copy"), "role", "text")
    return materialize(numbered.withColumn("digest", digest(F.col("role"), F.col("text"))), "turns")


def digest(role: Column, text: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit("\n"), text, F.lit(CLOSE + "\n"))


def preference_segments(chosen: DataFrame, rejected: DataFrame, trained_role: str = TRAINED_ROLE) -> DataFrame:
    """One row per rendered turn: (pair, part, turn, copy, role, segment, mask).

    ``chosen`` and ``rejected`` come from ``turns``. ``part`` is prompt, chosen or rejected; ``mask`` is 1
    where a turn is trained on.
    """
    place = ["pair", "turn", "copy"]
    left = chosen.select(*place, F.col("digest").alias("mine"))
    right = rejected.select(*place, F.col("digest").alias("theirs"))
    at = F.struct("turn", "copy")
    differing = left.join(right, place, "full_outer").filter(~F.col("mine").eqNullSafe(F.col("theirs")))
    ends = materialize(differing.groupBy("pair").agg(F.min(at).alias("end")), "prompt_ends")

    def side(rows: DataFrame, name: str) -> DataFrame:
        after = at >= F.col("end")  # null where the two sides never differ
        part = F.when(after, F.lit(name)).otherwise(F.lit("prompt"))
        return rows.join(ends, "pair", "left").select(*place, part.alias("part"), "role", render(F.col("role"), F.col("text")).alias("segment"))

    # The prompt is the same on both sides: the chosen side renders it.
    rows = side(chosen, "chosen").unionByName(side(rejected, "rejected").filter("part <> 'prompt'"))
    trained = (F.col("part") != "prompt") & (F.col("role") == trained_role)
    return rows.select(*place, "part", "role", "segment", trained.cast("int").alias("mask"))


def pair_records(segments: DataFrame) -> DataFrame:
    """One row per pair: prompt, chosen and rejected texts, and the trained spans (start, end) of either completion in code points."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "copy", "segment", "mask")))
    by_part = segments.groupBy("pair", "part").agg(ordered.alias("turns"))
    start = lambda s, i: F.aggregate(F.slice("turns", F.lit(1), i), F.lit(0), lambda a, t: a + F.length(t["segment"]))
    spans = F.transform("turns", lambda s, i: F.struct(start(s, i).alias("start"), (start(s, i) + F.length(s["segment"])).alias("end"), s["mask"].alias("mask")))
    whole = by_part.select("pair", "part", F.array_join(F.transform("turns", lambda s: s["segment"]), "").alias("body"), F.filter(spans, lambda s: s["mask"] == 1).alias("spans"))
    pick = lambda part, c: F.max(F.when(F.col("part") == part, F.col(c)))
    text = lambda part: F.coalesce(pick(part, "body"), F.lit(""))
    return whole.groupBy("pair").agg(
        text("prompt").alias("prompt"),
        text("chosen").alias("chosen"),
        text("rejected").alias("rejected"),
        F.coalesce(pick("chosen", "spans"), F.array().cast("array<struct<start:int,end:int,mask:int>>")).alias("chosen_spans"),
        F.coalesce(pick("rejected", "spans"), F.array().cast("array<struct<start:int,end:int,mask:int>>")).alias("rejected_spans"),
    )


def swapped_replies(own: DataFrame, trained_role: str = TRAINED_ROLE) -> DataFrame:
    """Rejected conversations for unpaired ones: the last reply of each comes from its neighbour.

    ``own`` comes from ``turns`` with whole-number pair keys; neighbours are 2k and 2k + 1. A reply that the
    neighbour lacks is left out.
    """
    replies = own.filter(F.col("role") == trained_role)
    last = replies.groupBy("pair").agg(F.max(F.struct("turn", "copy")).alias("last")).select("pair", "last.turn", "last.copy")
    given = replies.join(last, ["pair", "turn", "copy"])
    lent = given.select(F.col("pair").bitwiseXOR(F.lit(1).cast("long")).alias("pair"), F.col("text").alias("lent"), F.col("digest").alias("lent_digest"))
    # One row for each conversation with a reply: its place, and the neighbour's text.
    swaps = last.join(lent, "pair", "left").withColumn("swapped", F.lit(True))
    joined = own.join(swaps, ["pair", "turn", "copy"], "left")
    swapped = lambda mine, theirs: F.when(F.col("swapped"), F.col(theirs)).otherwise(F.col(mine)).alias(mine)
    return joined.select("pair", "turn", "copy", "role", swapped("text", "lent"), swapped("digest", "lent_digest")).filter("digest IS NOT NULL")
