"""Quality rules: base counts, and how far a text's histograms are from those of its language.

Every text is reduced to small histograms: characters by class, and a list of common words (all other
words together). The histograms of each language, summed over all of its texts that pass the base rules,
are its references. A text is kept unless it fails the base rules or one of its two Jensen-Shannon
distances (square root of the divergence in bits, 0 to 1) to its language's reference passes a limit. Short
texts are far from any reference by chance, so a limit is wider by ``slack / sqrt(length)``, and below a
least length (words, characters) a distance does not count.

The references of the ``MAX_LANGUAGES`` languages with most words are sent to the workers; those of further languages
are joined to their texts, so a verdict does not depend on how many languages there are.

Defined cases: a null text has no words and fails; a null language, or one without a text that passes the base rules, is
held against all references that were sent and the nearest counts; without any reference only the base rules count; equal rows give equal results; a null key is carried along; other
input columns play no part.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosecast.llm.common import add_columns, field
from dosecast.session import materialize

MIN_WORDS = 50
MAX_REPEATED = 50  # per cent of the words
MAX_LANGUAGES = 64  # references that are sent to the workers
MAX_CLASS_DISTANCE, CLASS_SLACK = 0.14, 1.5
MAX_WORD_DISTANCE, WORD_SLACK = 0.22, 1.2
GUARD_WORDS, GUARD_CHARS = 50, 200

# Frequent words of four languages.
COMMON = (
    "the of and to in a is that for it as was with be by on not he this are or his from at which but have an had they you were "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach "
    "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son aux "
    "el que y los se del las por con no su al lo como más pero sus le ya o porque cuando muy sin sobre también me hasta"
).split()
COMMON = tuple(dict.fromkeys(COMMON))
CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "other_ascii", "beyond_ascii")

_SPACES = b" \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


def _class_of_byte() -> np.ndarray:
    """The character class that a UTF-8 byte starts; continuation bytes start none."""
    table = np.full(256, CLASSES.index("other_ascii"))
    for name, members in (
        ("lower", bytes(range(97, 123))),
        ("upper", bytes(range(65, 91))),
        ("digit", bytes(range(48, 58))),
        ("space", _SPACES),
        ("stop", b".,;:?!'\"()-"),
        ("symbol", _SYMBOLS.encode()),
        ("beyond_ascii", bytes(range(192, 256))),
    ):
        table[list(members)] = CLASSES.index(name)
    table[128:192] = len(CLASSES)
    return table


_CLASS = _class_of_byte()


def repeated_words(words: list) -> int:
    """Words inside windows of three words that the text holds twice or more."""
    if len(words) < 4:
        return 0
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    windows = len(ids) - 2
    width = len(number)
    # Number pairs first, so that no product can overflow.
    _, pairs = np.unique(ids[:-2] * width + ids[1:-1], return_inverse=True)
    _, inverse, count = np.unique(pairs * width + ids[2:], return_inverse=True, return_counts=True)
    often = count[inverse] > 1
    covered = np.zeros(len(ids), dtype=bool)
    for shift in range(3):
        covered[shift : shift + windows] |= often
    return int(covered.sum())


def measure(text: str | None) -> tuple:
    """Base counts, then the histograms of characters and of common words (the rest last)."""
    text = text or ""
    data = text.encode()
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    words = data.split()
    spaces = int(counts[list(_SPACES)].sum())
    symbols = int(counts[list(_SYMBOLS.encode())].sum())
    lines = [line for line in data.split(b"\n") if line.strip(_SPACES)]
    classes = np.bincount(_CLASS, weights=counts, minlength=len(CLASSES) + 1)[: len(CLASSES)].astype(np.int64)
    folded = Counter(text.lower().split())
    common = [folded[w] + folded[w + "."] + folded[w + ","] for w in COMMON]
    common.append(max(0, len(words) - sum(common)))
    return (
        len(words),
        len(text) - spaces,
        symbols,
        len(lines) - len(set(lines)),
        repeated_words(words),
        classes.tolist(),
        common,
    )


def measured(df: DataFrame, key: str, text: str, language: str) -> DataFrame:
    """(key, language, base counts, base_failed, classes, common) of every text."""
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    fields = [*[field(n, "long") for n in base], field("classes", "array<long>"), field("common", "array<long>")]
    source = df.select(df[f"`{key}`"].alias(key), df[f"`{language}`"].alias("_language"), df[f"`{text}`"].alias("_text"))
    out = add_columns(source, "_text", lambda: lambda texts: list(zip(*map(measure, texts))) or [[]] * 7, fields, [key, "_language"])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def references(stats: DataFrame) -> tuple[dict[str, tuple[list, list]], DataFrame]:
    """Histograms of each language, summed over its texts that pass the base rules: of the ``MAX_LANGUAGES`` with most words
    as a dict, of all others as a table (_language, _own: their classes and common words)."""
    sums = [F.sum(F.col(c)[i]).alias(f"{c}_{i}") for c, n in (("classes", len(CLASSES)), ("common", len(COMMON) + 1)) for i in range(n)]
    usable = stats.filter("NOT base_failed AND _language IS NOT NULL").groupBy("_language").agg(F.sum("n_words").alias("_n"), *sums)
    every = materialize(usable, "quality_references")
    rows = every.orderBy(F.desc("_n"), "_language").limit(MAX_LANGUAGES).collect()
    cells = len(CLASSES)
    sent = {r["_language"]: (list(r[2 : 2 + cells]), list(r[2 + cells :])) for r in rows}
    others = every.filter(~F.col("_language").isin(*sent)) if sent else every
    classes, common = (F.array(*[c for c in every.columns if c.startswith(f"{name}_")]).alias(name) for name in ("classes", "common"))
    return sent, others.select("_language", F.struct(classes, common).alias("_own"))


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance in bits between the rows of ``p`` and of ``q``; 1 for an empty histogram."""
    p, q = np.atleast_2d(p).astype(float), np.atleast_2d(q).astype(float)
    total_p, total_q = p.sum(1, keepdims=True), q.sum(1, keepdims=True)
    p, q = p / np.where(total_p > 0, total_p, 1), q / np.where(total_q > 0, total_q, 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(1)
    distance = np.sqrt(np.clip((left + right) / 2, 0, 1))
    return np.where((total_p[:, 0] > 0) & (total_q[:, 0] > 0), distance, 1.0)


def quality(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    language: str = "lang",
    max_class_distance: float = MAX_CLASS_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
    guard_words: int = GUARD_WORDS,
    guard_chars: int = GUARD_CHARS,
) -> DataFrame:
    """One row per text: the base counts and verdict, both distances, and ``kept``."""
    stats = materialize(measured(df, key, text, language), "quality_stats")
    held, others = references(stats)
    names = list(held)
    reference = [np.array([held[n][i] for n in names], dtype=float) for i in (0, 1)]

    def make():
        place = {n: i for i, n in enumerate(names)}

        def work(rows):
            out = [[], []]
            for i, what in enumerate(("classes", "common")):
                if not names or not rows:
                    out[i] = [0.0] * len(rows)
                    continue
                own = np.array([r[what] for r in rows], dtype=float)
                every = np.stack([js_distance(own, np.broadcast_to(x, own.shape)) for x in reference[i]])
                at = np.array([place.get(r["_language"], -1) for r in rows])
                found = np.where(at >= 0, every[at, np.arange(len(rows))], every.min(0))
                joined = [j for j, r in enumerate(rows) if r["_own"] is not None]
                if joined:
                    found[joined] = js_distance(own[joined], np.array([rows[j]["_own"][what] for j in joined], dtype=float))
                out[i] = found.tolist()
            return out

        return work

    keep = [key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "_chars"]
    # The languages that hold many texts are among those sent, so no key of this join is hot.
    packed = stats.join(others, "_language", "left").withColumn("_chars", F.aggregate("classes", F.lit(0).cast("long"), lambda a, b: a + b)).withColumn(
        "_histograms", F.struct("_language", "classes", "common", "_own")
    )
    scored = add_columns(packed, "_histograms", make, [field("class_distance", "double"), field("word_distance", "double")], keep)
    limit = lambda base, slack, length: base + slack / F.sqrt(F.greatest(F.col(length), F.lit(1)))
    far_classes = F.col("class_distance") > limit(max_class_distance, CLASS_SLACK, "_chars")
    far_words = F.col("word_distance") > limit(max_word_distance, WORD_SLACK, "n_words")
    far = ((F.col("_chars") >= guard_chars) & far_classes) | ((F.col("n_words") >= guard_words) & far_words)
    return scored.withColumn("kept", ~F.col("base_failed") & ~far).drop("_chars")
