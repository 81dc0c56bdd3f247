"""Language-model scores from a log-frequency Bloom filter.

Words and pairs of neighbouring words are counted over all training texts. A count c is kept as its level
1 + floor(log c / log BASE): the filter holds one entry for each n-gram and each level up to its own, so
probing levels upwards until one is missing gives the level back, never too low. Built segment by segment on
the executors, the filter is broadcast (at most ``MAX_FILTER_BYTES``). Where all n-grams would need more, it holds
those from the smallest frequency that fits. The others are held by a second filter of the same kind, whose segments
stay where they were filled and grow in number with the text: each batch of texts sends the n-grams it
has to ask for, once each, to their segments and gets the levels back, so that every n-gram counts at every size.
A word's probability mixes the pair's share of its first word with the add-one share of the word itself; as levels
round counts up or down, the probabilities after a word need not sum to one.

Beside the model's ``score`` stands an exact baseline: add-one unigrams from exact counts. The counts of the most
frequent words, at most ``FREQUENT``, are broadcast; the rest are joined by shuffle, each word once for each text.
Words are known by 128-bit hashes.

Defined cases: a null or empty text is one end token; without training texts all counts are zero; equal rows
get equal scores; a null key counts as an empty text in choosing training texts and is carried along; other
input columns play no part.
"""

from __future__ import annotations

import itertools
import math
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dosecast.llm.common import add_columns, field, key_remainder
from dosecast.session import materialize

BASE = 1.5
PROBES = 6
BITS_PER_ENTRY = 10
MAX_FILTER_BYTES = 64 << 20
SEGMENTS = 64
FREQUENT = 300_000  # words whose exact counts are broadcast, 24 bytes each
MIN_PAIR = 1  # the least count of a pair that counts: after a word seen once, its share is 1
SEGMENT_TEXT = 4 << 20  # bytes of training text behind a segment of the filter that is not broadcast
MIX = 0.5  # weight of the pair's share
COUNTED_CHARS = 12 << 20  # characters of texts whose words are counted together before they are handed on
SCORED_BYTES = 4 << 20  # bytes of texts that are scored, and ask for n-grams, together
FILLED_AT_ONCE = 1 << 20  # n-grams that are put into segments together
SENT_AT_ONCE = 50_000  # counts of an Arrow batch, which the JVM holds outside its heap
ROWS_SENT = 500  # packed counts of an Arrow batch
MERGED_AT_ONCE = 2 << 20  # counts of a segment that are held before they are merged
END = b"\n"  # no word: it is white space
UNKNOWN = -1  # the level of an n-gram that the filter may leave out

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M2
        x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(first * _M1 + mix(second + _M2))


def word_keys(words: np.ndarray) -> np.ndarray:
    return mix(words + _M3)


def level_of(counts: np.ndarray) -> np.ndarray:
    """The quantised log of a count, from 1."""
    return 1 + np.floor(np.log(counts) / math.log(BASE) + 1e-9).astype(np.int64)


def count_of(levels: np.ndarray) -> np.ndarray:
    """A count for a level: the middle of those that share it, on a log scale; 0 for none."""
    low = BASE ** np.maximum(levels - 1, 0)
    return np.where(levels > 0, np.maximum(1.0, low * BASE**0.5 * (levels > 1) + (levels == 1)), 0.0)


class Batch:
    """Texts as word numbers: distinct words with their hashes, one long row of numbers, where texts end."""

    def __init__(self, texts: list):
        number: dict[bytes, int] = {END: 0}
        ids: list[int] = []
        ends = np.empty(len(texts), dtype=np.int64)
        known = number.setdefault
        for i, text in enumerate(texts):
            ids += [known(w, len(number)) for w in (text or "").encode().lower().split()]
            ids.append(0)
            ends[i] = len(ids)
        self.ids = np.array(ids, dtype=np.int64)
        self.ends = ends
        digests = b"".join(map(xxhash.xxh3_128_digest, number))
        both = np.frombuffer(digests, dtype=">u8").astype(np.uint64).reshape(-1, 2)
        self.high, self.low = both[:, 0], both[:, 1]

    def owners(self) -> np.ndarray:
        """The text of every token."""
        return np.repeat(np.arange(len(self.ends)), np.diff(self.ends, prepend=0))

    def before(self) -> np.ndarray:
        """The number of the word before every token; a text starts after an end."""
        return np.concatenate([[0], self.ids[:-1]]) if len(self.ids) else self.ids


def pieces(batches):
    """Lists of whole texts, each of ``COUNTED_CHARS`` or little more, across Arrow batches."""
    held, size = [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, 200):
            texts = batch.column(0).slice(start, 200).to_pylist()
            held += texts
            size += sum(len(t) for t in texts if t)
            if size >= COUNTED_CHARS:
                yield held
                held, size = [], 0
    if held:
        yield held


def planes(values: np.ndarray) -> bytes:
    """64-bit numbers byte by byte, all first bytes first: small and sorted numbers then compress well."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def packed(kind: int, high: np.ndarray, low: np.ndarray | None, n: np.ndarray, segments: int):
    """A row (segment, kind, high, low, n) for each segment, its n-grams in the order of their hashes."""
    own = (high & np.uint64(segments - 1)).astype(np.int64)
    bits = np.uint64(segments.bit_length() - 1)
    order = np.argsort((high << (np.uint64(64) - bits)) | (high >> bits))
    high, low, n, own = high[order], None if low is None else low[order], n[order], own[order]
    present, starts = np.unique(own, return_index=True)
    for s, start, end in zip(present.tolist(), starts.tolist(), [*starts[1:].tolist(), len(high)]):
        yield s, kind, planes(high[start:end]), None if low is None else planes(low[start:end]), planes(n[start:end])


def partial_counts(batches, segments: int):
    """Packed counts of the distinct words (0) and pairs (1, no low) of some texts."""
    schema = pa.schema([("segment", pa.int32()), ("kind", pa.int32()), ("high", pa.binary()), ("low", pa.binary()), ("n", pa.binary())])
    for texts in pieces(batches):
        b = Batch(texts)
        words, n_words = np.unique(b.ids, return_counts=True)
        pairs, n_pairs = np.unique(b.before() * (len(b.high) + 1) + b.ids, return_counts=True)
        keys = pair_keys(b.high[pairs // (len(b.high) + 1)], b.high[pairs % (len(b.high) + 1)])
        rows = itertools.chain(packed(0, b.high[words], b.low[words], n_words, segments), packed(1, keys, None, n_pairs, segments))
        while some := list(itertools.islice(rows, ROWS_SENT)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)


def merged(high: np.ndarray, low: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal n-grams once, their counts summed."""
    order = np.lexsort((low, high)) if low.any() else np.argsort(high)
    high, low, n = high[order], low[order], n[order]
    starts = np.flatnonzero(np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])]))
    return high[starts], low[starts], np.add.reduceat(n, starts)


def merge_counts(batches):
    """(kind, high, low, n) from packed counts in the order of (segment, kind); held are a segment's distinct n-grams of a kind
    and ``MERGED_AT_ONCE`` more."""
    held, size, done, place = [], 0, 0, None

    def out():
        kind, (high, low, n) = place[1], merged(*map(np.concatenate, zip(*held)))
        lows = pa.array(low.view(np.int64)) if kind == 0 else pa.nulls(len(low), pa.int64())
        counted = pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(high), kind, dtype=np.int32)), pa.array(high.view(np.int64)), lows, pa.array(n.astype(np.int64))], names=["kind", "high", "low", "n"]
        )
        yield from (counted.slice(start, SENT_AT_ONCE) for start in range(0, counted.num_rows, SENT_AT_ONCE))

    for batch in batches:
        for row in zip(*(batch.column(i) for i in range(5))):
            segment, kind, high, low, n = (x.as_py() for x in row)
            if place != (segment, kind):
                if held:
                    yield from out()
                held, size, done, place = [], 0, 0, (segment, kind)
            keys = from_planes(high)
            held.append((keys, from_planes(low) if low is not None else np.zeros(len(keys), dtype=np.uint64), from_planes(n)))
            size += len(keys)
            if size > max(MERGED_AT_ONCE, 2 * done):
                held = [merged(*map(np.concatenate, zip(*held)))]
                size = done = len(held[0][0])
    if held:
        yield from out()


def segments_for(texts: DataFrame) -> int:
    """How many segments the n-grams that are not broadcast are dealt to: a power of two that grows with the text."""
    size = texts.agg(F.sum(F.octet_length(texts.columns[0]))).first()[0] or 0
    return 1 << max(6, int(size // SEGMENT_TEXT).bit_length())


def ngram_counts(texts: DataFrame, segments: int) -> DataFrame:
    """(kind, high, low, n) of all words and of all pairs; the n-grams of a segment lie in one file.

    Texts are counted before they are shuffled, so an n-gram is sent once by each piece and no key is hot. A row of the
    shuffle is what a piece and a segment have in common, packed.
    """
    parts = texts.mapInArrow(lambda b: partial_counts(b, segments), "segment int, kind int, high binary, low binary, n binary")
    dealt = parts.repartition("segment").sortWithinPartitions("segment", "kind")
    counted = dealt.mapInArrow(merge_counts, "kind int, high long, low long, n long")
    return materialize(counted, "ngram_counts")


@dataclass(frozen=True)
class Shape:
    """Bits of a segment, the highest level held, and the least count of a held n-gram: 1 if all are held."""

    segment_bits: int
    levels: int
    least: int


def levels_of_counts(counts: DataFrame) -> list:
    """(kind, level, rows, least count, tokens): one row for each kind and level."""
    level = (F.floor(F.log("n") / math.log(BASE) + 1e-9) + 1).cast("int")
    sums = (F.count(F.lit(1)).alias("rows"), F.min("n").alias("least"), F.sum("n").alias("tokens"))
    return counts.groupBy("kind", level.alias("level")).agg(*sums).collect()


def bits_for(entries: int, segments: int) -> int:
    bits = max(1 << 10, -(-entries * BITS_PER_ENTRY // segments))
    return int(bits + -bits % 8)


def shape_of(found: list, max_bytes: int) -> Shape:
    by_level: dict[int, int] = {}
    for r in found:
        by_level[r["level"]] = by_level.get(r["level"], 0) + r["rows"]
    entries = sum(level * n for level, n in by_level.items())
    least = 1
    for level, n in sorted(by_level.items()):
        if entries * BITS_PER_ENTRY <= max_bytes * 8:
            break
        entries -= level * n
        least = int(math.ceil(BASE**level - 1e-9))
    return Shape(bits_for(entries, SEGMENTS), max(by_level, default=0), least)


def shape_for(counts: DataFrame, max_bytes: int = MAX_FILTER_BYTES) -> Shape:
    """The smallest frequency whose n-grams fit, and the filter's size for them."""
    return shape_of(levels_of_counts(counts), max_bytes)


def rest_shape(found: list, least: int, segments: int) -> Shape:
    """The shape of the filter of n-grams that are rarer than ``least``."""
    rarer = [r for r in found if r["least"] < least]
    return Shape(bits_for(sum(r["level"] * r["rows"] for r in rarer), segments), max((r["level"] for r in rarer), default=0), 1)


def frequent_from(found: list, most: int) -> int | None:
    """The least count from which on there are at most ``most`` words; None if even the highest level holds more."""
    least, held = None, 0
    for r in sorted((r for r in found if r["kind"] == 0), key=lambda r: -r["level"]):
        held += r["rows"]
        if held > most:
            break
        least = r["least"]
    return least


def probes(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the probes of keys at a level start, and how far apart they are."""
    with np.errstate(over="ignore"):
        h = mix(keys + np.uint64(level) * _M1)
    return h, mix(h) | np.uint64(1)


def position(start: np.ndarray, step: np.ndarray, probe: int, bits: int) -> np.ndarray:
    """The bit of a probe in a segment."""
    with np.errstate(over="ignore"):
        return ((start + np.uint64(probe) * step) >> np.uint64(1)) % np.uint64(bits)


def fill_segments(batches, segment_bits: int):
    """(segment, bits) of the n-grams (kind, high, n, segment) of a task."""
    own: dict[int, np.ndarray] = {}

    def put(pending):
        kind, high, n, segment = (np.concatenate(c) for c in zip(*pending))
        keys = np.where(kind == 1, high.view(np.uint64), word_keys(high.view(np.uint64)))
        order = np.argsort(segment, kind="stable")
        keys, levels = keys[order], level_of(n)[order]
        present, starts = np.unique(segment[order], return_index=True)
        for s, start, end in zip(present.tolist(), starts, [*starts[1:], len(keys)]):
            one = np.zeros(segment_bits, dtype=bool)
            held, up_to = keys[start:end], levels[start:end]
            for level in range(1, int(up_to.max()) + 1):
                first, step = probes(held[up_to >= level], level)
                for probe in range(PROBES):
                    one[position(first, step, probe, segment_bits)] = True
            packed = np.packbits(one, bitorder="little")
            own[s] = own[s] | packed if s in own else packed

    pending, rows = [], 0
    for batch in batches:
        pending.append([batch.column(i).to_numpy() for i in range(4)])
        rows += batch.num_rows
        if rows >= FILLED_AT_ONCE:
            put(pending)
            pending, rows = [], 0
    if rows:
        put(pending)
    for s, bits in own.items():
        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([bits.tobytes()], pa.binary())], names=["segment", "bits"])


def build_filter(counts: DataFrame, shape: Shape) -> bytes:
    """The broadcast filter's segments, one after the other: each is filled by one task from the n-grams that belong to it."""
    bits = shape.segment_bits
    held = counts.filter(F.col("n") >= shape.least).withColumn("segment", F.pmod("high", F.lit(SEGMENTS)).cast("int"))
    parts = held.select("kind", "high", "n", "segment").repartition(SEGMENTS, "segment").mapInArrow(lambda b: fill_segments(b, bits), "segment int, bits binary")
    size = bits // 8
    whole = bytearray(size * SEGMENTS)
    for r in parts.toLocalIterator():  # at most MAX_FILTER_BYTES in all
        whole[r["segment"] * size : (r["segment"] + 1) * size] = r["bits"]
    return bytes(whole)


def rest_segments(counts: DataFrame, below: int, shape: Shape, segments: int) -> DataFrame:
    """(segment, bits) of the n-grams rarer than ``below``, filled where their file is read; a file that two tasks
    read gives two rows of a segment."""
    bits = shape.segment_bits
    rarer = counts.filter(F.col("n") < below).select("kind", "high", "n", F.pmod("high", F.lit(segments)).cast("int").alias("segment"))
    return rarer.mapInArrow(lambda b: fill_segments(b, bits), "segment int, bits binary")


def levels_in(bits: np.ndarray, shape: Shape, keys: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """The level of each n-gram by repeated membership probes, 0 if it is not held; ``offset`` is the first byte of its segment."""
    out = np.zeros(len(keys), dtype=np.int64)
    alive = np.arange(len(keys))
    for level in range(1, shape.levels + 1):
        first, step = probes(keys[alive], level)
        for probe in range(PROBES):
            p = position(first, step, probe, shape.segment_bits)
            byte = bits[offset[alive] + (p >> np.uint64(3)).astype(np.int64)]
            held = (byte >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
            if not held.all():
                alive, first, step = alive[held], first[held], step[held]
        if not len(alive):
            break
        out[alive] = level
    return out


class Filter:
    """Levels of n-grams from the broadcast segments."""

    def __init__(self, segments: bytes, shape: Shape):
        self.bits = np.frombuffer(segments, dtype=np.uint8)  # the broadcast bytes themselves, no second copy
        self.shape = shape

    def levels(self, keys: np.ndarray, owners: np.ndarray) -> np.ndarray:
        """``owners`` are the hashes that choose the segment."""
        return levels_in(self.bits, self.shape, keys, (owners.view(np.int64) % SEGMENTS) * (self.shape.segment_bits // 8))


@dataclass(frozen=True)
class LanguageModel:
    """Exact totals, the frequent words' exact counts (sorted by hash), and the filter's broadcast handle."""

    tokens: int
    words: int
    frequent: object
    filter: object
    shape: Shape
    rest: Shape  # of the filter that is not broadcast
    segments: int  # of that filter
    name: str  # unlike any other model's


def train(texts: DataFrame, frequent: int = FREQUENT, max_bytes: int = MAX_FILTER_BYTES) -> tuple[LanguageModel, DataFrame]:
    """The model of the one text column of ``texts``, and the exact counts (kind, high, low, n)."""
    context = texts.sparkSession.sparkContext
    segments = segments_for(texts)
    counts = ngram_counts(texts, segments)
    found = levels_of_counts(counts)
    words = [r for r in found if r["kind"] == 0]
    least = frequent_from(found, frequent)
    often = counts.filter("kind = 0").filter(F.lit(False) if least is None else F.col("n") >= least)
    top = often.select("high", "low", "n").toArrow()
    high, low, n = (top.column(c).to_numpy() for c in ("high", "low", "n"))
    order = np.argsort(high.view(np.uint64), kind="stable")
    exact = context.broadcast((high.view(np.uint64)[order], low.view(np.uint64)[order], n[order]))
    shape = shape_of(found, max_bytes)
    held = context.broadcast(build_filter(counts, shape))
    totals = sum(r["tokens"] for r in words), sum(r["rows"] for r in words)
    return LanguageModel(*totals, exact, held, shape, rest_shape(found, shape.least, segments), segments, uuid.uuid4().hex), counts


_filters: dict[str, Filter] = {}


def _filter_of(model: LanguageModel) -> Filter:
    """One filter for each worker process; an older model's goes."""
    if model.name not in _filters:
        _filters.clear()
        _filters[model.name] = Filter(model.filter.value, model.shape)
    return _filters[model.name]


def log_probability(pair: np.ndarray, first: np.ndarray, second: np.ndarray, tokens: int, words: int) -> np.ndarray:
    """log10 of the smoothed probability of words, from the levels of the pairs, of the words before and of the words."""
    together, before, single = count_of(pair), count_of(first), count_of(second)
    own = (single + 1) / (tokens + words + 1)
    share = np.minimum(1.0, together / np.maximum(1.0, before))
    return np.log10(np.where(before > 0, MIX * share + (1 - MIX) * own, own))


class Grams:
    """The distinct pairs of a batch, and the levels of its words and pairs; ``UNKNOWN`` where others must be asked."""

    def __init__(self, batch: Batch, held: Filter, counted: np.ndarray):
        """``counted``: the tokens of training texts."""
        width = len(batch.high) + 1
        pairs, self.inverse = np.unique(batch.before() * width + batch.ids, return_inverse=True)
        self.first, self.second = pairs // width, pairs % width
        self.keys = pair_keys(batch.high[self.first], batch.high[self.second])
        self.single = held.levels(word_keys(batch.high), batch.high)
        self.together = held.levels(self.keys, self.keys)
        least = held.shape.least
        if least > 1:
            for levels, at in ((self.single, batch.ids), (self.together, self.inverse)):
                levels[levels < level_of(np.int64(least))] = UNKNOWN
                if least == 2:  # what is trained on and not held has been counted once
                    once = np.zeros(len(levels), dtype=bool)
                    once[at[counted]] = True
                    levels[once & (levels == UNKNOWN)] = 1
        self.clear = (self.together >= 0) & (self.single[self.first] >= 0) & (self.single[self.second] >= 0)


def _lists(owners: np.ndarray, n_texts: int, **columns: np.ndarray) -> pa.ListArray:
    """For each text a list of structs; ``owners``, sorted, are the texts of the structs."""
    starts = np.searchsorted(owners, np.arange(n_texts + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(starts), pa.StructArray.from_arrays([pa.array(c) for c in columns.values()], names=list(columns)))


def unanswered(batch: Batch, grams: Grams, owners: np.ndarray, n_texts: int, segments: int) -> tuple[pa.ListArray, pa.ListArray]:
    """Tokens whose levels are not all known, by text, and the n-grams to ask for, with the first text.

    A level that is not known is written as -1 - its place among those asked for.
    """
    words, pairs = np.flatnonzero(grams.single < 0), np.flatnonzero(grams.together < 0)
    single, together = grams.single.copy(), grams.together.copy()
    single[words] = -1 - np.arange(len(words))
    together[pairs] = -1 - len(words) - np.arange(len(pairs))
    tokens = np.flatnonzero(~grams.clear[grams.inverse])
    n = len(grams.keys)
    codes, times = np.unique(owners[tokens] * n + grams.inverse[tokens], return_counts=True)
    of, pair = codes // max(1, n), codes % max(1, n)
    small = lambda x: x.astype(np.int32)
    rest = _lists(of, n_texts, pair=small(together[pair]), first=small(single[grams.first[pair]]), second=small(single[grams.second[pair]]), times=small(times))
    segment = small(np.concatenate([batch.high[words], grams.keys[pairs]]).view(np.int64) % segments)
    key = np.concatenate([word_keys(batch.high[words]), grams.keys[pairs]]).view(np.int64)
    return rest, _lists(np.zeros(len(key), dtype=np.int64), n_texts, segment=segment, key=key)


def _exact(batch: Batch, table: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The exact count of every distinct word that is frequent, and whether it is."""
    high, low, n = table
    if not len(high):
        return np.zeros(len(batch.high), dtype=np.int64), np.zeros(len(batch.high), dtype=bool)
    at = np.minimum(np.searchsorted(high, batch.high), len(high) - 1)
    found = (high[at] == batch.high) & (low[at] == batch.low)
    return np.where(found, n[at], 0), found


def score_batch(rows: pa.StructArray, model: LanguageModel, number: int) -> list:
    """Columns: n_tokens, known, base (both of the frequent words), score, the other words (high, low, n), and, as far as
    the filter may not hold all: the batch's number, the tokens that are not scored yet, and the n-grams to ask for."""
    b = Batch(rows.field("text").to_pylist())
    n_texts, owners = len(rows), b.owners()
    per_text = lambda values: np.bincount(owners, weights=values, minlength=n_texts)
    counts, found = _exact(b, model.frequent.value)
    logs = np.where(found, np.log10((counts + 1) / (model.tokens + model.words + 1)), 0.0)
    trained = np.array(rows.field("training").to_pylist(), dtype=bool)
    grams = Grams(b, _filter_of(model), trained[owners])
    known = log_probability(grams.together, grams.single[grams.first], grams.single[grams.second], model.tokens, model.words)
    score = per_text(np.where(grams.clear, known, 0.0)[grams.inverse])
    rest = np.flatnonzero(~found[b.ids])
    width = len(b.high) + 1
    pairs, times = np.unique(owners[rest] * width + b.ids[rest], return_counts=True)
    words = pairs % width
    others = _lists(pairs // width, n_texts, high=b.high[words].view(np.int64), low=b.low[words].view(np.int64), n=times.astype(np.int64))
    out = [np.diff(b.ends, prepend=0), per_text(found[b.ids].astype(float)).astype(np.int64), per_text(logs[b.ids]), score, others]
    return out if model.shape.least == 1 else [*out, np.full(n_texts, number), *unanswered(b, grams, owners, n_texts, model.segments)]


def in_pieces(rows: pa.StructArray, model: LanguageModel, numbers) -> list:
    """The columns of ``score_batch``, for some rows at a time: ``SCORED_BYTES`` of texts, or one longer text."""
    before = np.cumsum(pc.fill_null(pc.binary_length(rows.field("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = np.flatnonzero(np.diff(before // SCORED_BYTES, prepend=0)) if len(rows) else []
    bounds = sorted({0, *cuts, len(rows)})
    parts = [score_batch(rows.slice(a, b - a), model, next(numbers)) for a, b in zip(bounds, bounds[1:])] or [score_batch(rows, model, next(numbers))]
    return [pa.concat_arrays([pa.array(x) for x in column]) for column in zip(*parts)]


def rest_scores(rows: DataFrame, counts: DataFrame, model: LanguageModel) -> DataFrame:
    """(_row, rest_score): the scores of the tokens that the broadcast filter left open, from the segments of the other one."""
    tokens, words, shape = model.tokens, model.words, model.rest
    asked = rows.filter(F.size("_asked") > 0).select(F.col("_batch").alias("asker"), F.posexplode("_asked").alias("place", "g")).select("asker", "place", "g.key", "g.segment")
    segments = rest_segments(counts, model.shape.least, shape, model.segments)

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows and right.num_rows:
            bits = np.bitwise_or.reduce([np.frombuffer(x.as_py(), dtype=np.uint8) for x in right.column("bits")])
            keys = left.column("key").to_numpy().view(np.uint64)
            level = levels_in(bits, shape, keys, np.zeros(len(keys), dtype=np.int64))
        else:
            level = np.zeros(left.num_rows, dtype=np.int64)
        found = pa.table({"asker": left.column("asker"), "place": left.column("place"), "level": pa.array(level.astype(np.int32))})
        return found.filter(pa.array(level > 0))

    # An n-gram is asked for once by each batch, and it is a rare one: one that many texts share is no hot key.
    answers = asked.groupBy("segment").cogroup(segments.groupBy("segment")).applyInArrow(probe, "asker long, place int, level int")
    open_rows = rows.filter(F.size("_rest") > 0).select("_row", "_batch", "_rest")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        lists = left.column("_rest").combine_chunks()
        flat = lists.flatten()
        pair, first, second, times = (flat.field(n).to_numpy().astype(np.int64) for n in ("pair", "first", "second", "times"))
        levels = np.zeros(1 + max((int(-x.min()) for x in (pair, first, second) if len(x)), default=0), dtype=np.int64)
        place, level = right.column("place").to_numpy(), right.column("level").to_numpy()
        needed = place < len(levels) - 1
        levels[place[needed]] = level[needed]
        read = lambda x: np.where(x >= 0, x, levels[np.maximum(-1 - x, 0)])
        logs = log_probability(read(pair), read(first), read(second), tokens, words) * times
        owners = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        return pa.table({"_row": left.column("_row"), "rest_score": np.bincount(owners, weights=logs, minlength=len(lists))})

    return open_rows.groupBy("_batch").cogroup(answers.groupBy("asker")).applyInArrow(score, "_row long, rest_score double")


def lm_scores(df: DataFrame, training: Column, key: str = "doc_id", text: str = "text", frequent: int = FREQUENT, max_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """One row per text: (key, n_tokens, n_known, train_tokens, base_score, score); learnt where ``training`` holds."""
    model, counts = train(df.filter(training).select(df[f"`{text}`"].alias("text")), frequent, max_bytes)
    fields = [
        field("n_tokens", "long"),
        field("_known", "long"),
        field("_base", "double"),
        field("score", "double"),
        field("_others", "array<struct<high:long,low:long,n:long>>"),
    ]
    partial = model.shape.least > 1
    if partial:
        fields += [
            field("_batch", "long"),
            field("_rest", "array<struct<pair:int,first:int,second:int,times:int>>"),
            field("_asked", "array<struct<segment:int,key:long>>"),
        ]

    def make():
        numbers = itertools.count(TaskContext.get().partitionId() << 33)
        return lambda rows: in_pieces(rows, model, numbers)

    given = df.select(df[f"`{key}`"], F.struct(F.coalesce(training, F.lit(False)).alias("training"), df[f"`{text}`"].alias("text")).alias("_given"))
    scored = add_columns(given, "_given", make, fields, [key], as_arrow=True)
    # Texts get a number each; written down, so that a retry cannot number them anew.
    rows = materialize(scored.withColumn("_row", F.monotonically_increasing_id()), "lm_scores")
    others = rows.select("_row", F.explode("_others").alias("w")).select("_row", "w.high", "w.low", F.col("w.n").alias("times"))
    exact = counts.filter("kind = 0").select("high", "low", "n")
    c = F.coalesce("n", F.lit(0))
    rare = (
        others.join(exact, ["high", "low"], "left")
        .groupBy("_row")
        .agg(
            F.sum(F.when(c > 0, F.col("times")).otherwise(F.lit(0))).alias("rare_known"),
            F.sum(F.col("times") * F.log10((c + 1) / F.lit(float(model.tokens + model.words + 1)))).alias("rare_base"),
        )
    )
    none = F.lit(0)
    wide = rows.drop("_others", "_rest", "_asked").join(rare, "_row", "left")
    if partial:
        wide = wide.join(rest_scores(rows, counts, model), "_row", "left")
    return wide.select(
        key,
        "n_tokens",
        (F.col("_known") + F.coalesce("rare_known", none)).cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("_base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("rest_score", F.lit(0.0)) if partial else F.col("score")).alias("score"),
    )


def held_out(key: Column, folds: int = 7, fold: int = 2) -> Column:
    return key_remainder(key, folds) == fold
