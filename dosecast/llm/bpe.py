"""Byte-level BPE by overlapping chunks, and decoding by concatenated bytes.

A long text is cut into overlapping chunks that are pre-tokenised side by side. A chunk's own first
boundaries may be wrong (it starts in mid-word), but from any boundary that it shares with its
predecessor both agree, since a match depends only on the text from its start on. Texts are therefore
cut again at the first shared boundary of each overlap, and the slices between those are encoded side
by side. From where two chunks share no boundary (a run longer than the overlap), a text stays one slice.
Texts no longer than a chunk are one slice as they are.

Defined cases: a null text counts as empty; an empty text has no ids; special tokens are ordinary text;
equal rows give equal results; a null key is carried along; other input columns play no part.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosecast.llm.common import add_columns, field
from dosecast.session import materialize

CHUNK = 32_768  # code points that a chunk owns
OVERLAP = 1_024  # code points that it shares with the next one
SAFE = 2  # the longest look beyond a match: "'r" might have become "'re"
CACHED_PIECES = 200_000


class Codec:
    """The ranks and the pattern, with the ids of recent pieces at hand."""

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pattern = regex.compile(pattern)
        self.bytes_of = {rank: piece for piece, rank in ranks.items()}
        self._merge = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self._known: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str) -> list[int]:
        """Every match of the pattern by itself."""
        ids: list[int] = []
        known = self._known
        for piece in self.pattern.findall(text):
            got = known.get(piece)
            if got is None:
                got = tuple(self._merge(piece))
                if len(piece) < 64:
                    if len(known) >= CACHED_PIECES:
                        known.clear()
                    known[piece] = got
            ids += got
        return ids

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def starts(self, text: str) -> list[int]:
        return [m.start() for m in self.pattern.finditer(text)]


_codecs: dict[tuple[str, str], Codec] = {}


def codec(ranks_path: str, pattern: str) -> Codec:
    """One codec for each worker process."""
    if (ranks_path, pattern) not in _codecs:
        _codecs[ranks_path, pattern] = Codec(ranks_path, pattern)
    return _codecs[ranks_path, pattern]


def encode_slices(df: DataFrame, slice_: str, keep: list[str], ranks_path: str, pattern: str) -> DataFrame:
    """The ``keep`` columns and ``ids``, the token ids of a text that starts and ends at a boundary."""

    def make():
        own = codec(ranks_path, pattern)
        return lambda texts: [[np.array(own.encode(t or ""), dtype=np.int32) for t in texts]]

    return add_columns(df, slice_, make, [field("ids", "array<int>")], keep)


def chunk_edges(chunks: DataFrame, ranks_path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """Pre-tokenise chunks (row, chunk, piece): boundaries in the first overlap and in the last one, from the chunk's start."""

    def make():
        own = codec(ranks_path, pattern)

        def work(texts):
            heads, tails = [], []
            for text in texts:
                starts = own.starts(text)
                heads.append([s for s in starts if s < overlap])
                # A start is sure when the match before it is: it must not have looked at the cut end.
                # Where white space precedes it, a slice that ends there would be split otherwise.
                sure = (s for s in starts if s >= chunk and s + SAFE <= len(text))
                tails.append([s - chunk for s in sure if not text[s - 1].isspace()])
            return [heads, tails]

        return work

    return add_columns(chunks, "piece", make, [field("head", "array<int>"), field("tail", "array<int>")], ["row", "chunk"])


def slices_of_long(long: DataFrame, ranks_path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(row, slice, piece) of the texts of ``long`` (row, text), cut where chunks resynchronise."""
    cores = long.sparkSession.sparkContext.defaultParallelism
    step = F.lit(chunk)
    n_chunks = F.greatest(F.lit(1), F.ceil(F.length("text") / step)).cast("int")
    chunks = long.select("row", "text", F.explode(F.sequence(F.lit(0), n_chunks - 1)).alias("chunk")).select(
        "row", "chunk", F.expr(f"substring(text, chunk * {chunk} + 1, {chunk + overlap})").alias("piece")
    )
    edges = materialize(chunk_edges(chunks.repartition(cores * 2, "row", "chunk"), ranks_path, pattern, chunk, overlap), "edges")
    after = edges.select("row", (F.col("chunk") - 1).alias("chunk"), F.col("head").alias("next_head"))
    shared = F.array_min(F.array_intersect("tail", "next_head"))
    found = (
        edges.select("row", "chunk", "tail")
        .join(after, ["row", "chunk"])
        .select("row", "chunk", ((F.col("chunk") + 1) * step + shared).cast("int").alias("cut"))
        .filter("cut IS NOT NULL")
        .groupBy("row")
        .agg(F.array_sort(F.collect_list(F.struct("chunk", "cut"))).alias("found"))
    )
    # A chunk is proven right from its cut on only if its predecessor is: cuts count up to the first gap.
    proven = F.filter("found", lambda x, i: x["chunk"] == i)
    cuts = found.select("row", F.transform(proven, lambda x: x["cut"]).alias("cuts"))
    bounds = F.concat(F.array(F.lit(0)), F.coalesce("cuts", F.array().cast("array<int>")), F.array(F.length("text")))
    return (
        long.join(cuts, "row", "left")
        .withColumn("bounds", bounds)
        .select("row", "text", "bounds", F.explode(F.sequence(F.lit(1), F.size("bounds") - 1)).alias("slice"))
        .select("row", "slice", F.expr("substring(text, bounds[slice - 1] + 1, bounds[slice] - bounds[slice - 1])").alias("piece"))
        .repartition(cores * 2, "row", "slice")
    )


def parted(df: DataFrame, key: str, text: str, chunk: int) -> tuple[DataFrame, DataFrame]:
    """Texts up to a chunk (key, text), and longer ones (row, key, text), which are few and written down.

    Written, the number of a row stays the same when a lost task runs again.
    """
    rows = df.select(df[f"`{key}`"].alias(key), F.coalesce(df[f"`{text}`"], F.lit("")).alias("text"))
    long = rows.filter(F.length("text") > chunk).withColumn("row", F.monotonically_increasing_id())
    return rows.filter(F.length("text") <= chunk), materialize(long, "long_texts")


def long_ids(long: DataFrame, key: str, ranks_path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(key, ids) of long texts, by way of their slices."""
    if not 0 < overlap <= chunk:
        raise ValueError("an overlap is at least one code point and at most a chunk")
    slices = slices_of_long(long.select("row", "text"), ranks_path, pattern, chunk, overlap)
    encoded = encode_slices(slices, "piece", ["row", "slice"], ranks_path, pattern)
    joined = encoded.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("slice", "ids"))).alias("parts"))
    whole = joined.select("row", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
    return long.select("row", key).join(whole, "row").select(key, "ids")


def encode_texts(
    df: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """(key, ids) for every text; see the module for the method and the defined cases."""
    short, long = parted(df, key, text, chunk)
    return encode_slices(short, "text", [key], ranks_path, pattern).unionByName(long_ids(long, key, ranks_path, pattern, chunk, overlap))


def _lists(ids: pa.ListArray):
    """The lists of an Arrow array as NumPy arrays; a null counts as empty."""
    offsets, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False)
    present = ids.is_valid().to_numpy(zero_copy_only=False)
    return [flat[a:b] if p else flat[:0] for a, b, p in zip(offsets, offsets[1:], present)]


def decode_ids(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and ``decoded``, the bytes behind the ids; a null list counts as empty."""

    def make():
        own = codec(ranks_path, pattern)
        return lambda lists: [[own.decode(x.tolist()) for x in _lists(lists)]]

    return add_columns(df, ids, make, [field("decoded", "binary")], list(keep), as_arrow=True)


def digest(own: Codec, lists) -> list[list]:
    """Token counts, digests of the ids, and digests of the bytes that they decode to."""
    arrays = [np.asarray(x, dtype="<u4") for x in lists]
    decoded = (own.decode(x.tolist()) for x in arrays)
    return [[len(x) for x in arrays], [hashlib.sha256(x.tobytes()).hexdigest() for x in arrays], [hashlib.sha256(d).hexdigest() for d in decoded]]


def encoding_digest(
    df: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """One row per text: token count, a digest of the ids and one of the bytes they decode to."""
    fields = [field("n_tokens", "long"), field("ids_sha256", "string"), field("decoded_sha256", "string")]

    def of_texts():
        own = codec(ranks_path, pattern)
        return lambda texts: digest(own, [np.array(own.encode(t), dtype="<u4") for t in texts])

    def of_ids():
        own = codec(ranks_path, pattern)
        return lambda ids: digest(own, _lists(ids))

    short, long = parted(df, key, text, chunk)
    ids = long_ids(long, key, ranks_path, pattern, chunk, overlap)
    return add_columns(short, "text", of_texts, fields, [key]).unionByName(add_columns(ids, "ids", of_ids, fields, [key], as_arrow=True))
