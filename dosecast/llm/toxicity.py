"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols: insult, threat, target, negation, report, other. Five small transducers read the
symbols of a clause: an insult weighs what the lexicon says; a threat counts once it meets a target; a
target before an insult makes it heavier; a negation within three words and reported speech make insults
and threats lighter. They are composed into one machine before any text is read. A text is scored by its
matched clauses: a logistic function of their total, their heaviest, their number and their density.

The lexicon is a fixed list and, beside it, words learnt from labelled texts: those found in many
different contexts of toxic texts (copies of one text are one context) and rarely in clean ones. Lexicon
and logistic weights come from at most ``sample`` labelled texts, chosen by a hash of their key; counting and
scoring cover everything.

Defined cases: a null or empty text matches nothing and gets the score of no match; without usable labels
the fixed lexicon and fixed weights hold; of repeated keys the greatest label and the least text are
learnt from; equal rows give equal results; a null key is carried along and never learnt from; other input
columns play no part.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field as dataclass_field

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dosecast.llm.common import add_columns, field, key_remainder
from dosecast.session import materialize

SAMPLE = 40_000  # labelled texts that lexicon and weights are learnt from, at most
MAX_LEARNT = 20_000  # learnt words, at most
MIN_CONTEXTS = 4  # different neighbourhoods in toxic texts that a learnt word needs
MIN_RATIO = 4.0  # and how many times as frequent it is there than in clean texts
FOLDS = 5

# The grammar's word lists.
INSULTS = (
    "idiot idiots moron morons stupid dumb fool fools loser losers scum trash garbage worthless pathetic disgusting clown clowns "
    "imbecile jerk creep freak pig pigs rat rats vermin filth coward cowards liar liars ugly useless "
    "dummkopf trottel abschaum versager arschloch idiotisch crétin imbécile salaud ordure connard minable "
    "idiota imbécil estúpido estúpida basura escoria inútil payaso"
).split()
THREATS = "kill hurt destroy beat smash shoot stab burn attack crush töten vernichten schlagen tuer frapper détruire matar golpear destruir".split()
TARGETS = "you your yours yourself they them he him she her du dich dir ihr euch sie tu toi vous ils elles tú te usted ustedes ellos".split()
NEGATIONS = "not no never isn't aren't wasn't don't won't nicht kein keine nie pas jamais aucun nunca jamás ningún".split()
REPORTS = "said says say called calls wrote claimed reported quoted alleged sagte nannte schrieb behauptete dit appelé écrit dijo llamó escribió".split()

# What the transducers do to a weight.
INSULT_WEIGHT, THREAT_WEIGHT = 3.0, 3.0
AIMED, NEGATED, REPORTED = 1.5, 0.4, 0.6
NEGATION_SCOPE = 3
#: Intercept, total, heaviest clause, number of clauses, weight per hundred words: used without labels.
DEFAULT_WEIGHTS = (-3.0, 1.5, 0.7, 0.7, 0.1)

SYMBOLS = ("insult", "threat", "target", "negation", "report", "other")

_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_CLAUSE = re.compile(r"[.!?;:\n]+")


@dataclass(frozen=True)
class Transducer:
    """``moves``: (state, symbol) -> (next state, factor); an unlisted symbol does what ``idle`` says."""

    moves: dict = dataclass_field(default_factory=dict)
    idle: dict = dataclass_field(default_factory=dict)

    def step(self, state: int, symbol: str) -> tuple[int, float]:
        return self.moves.get((state, symbol), (self.idle.get(state, state), 1.0))


def negation() -> Transducer:
    """State: how many further words stand under a negation."""
    moves = {(s, "negation"): (NEGATION_SCOPE, 1.0) for s in range(NEGATION_SCOPE + 1)}
    for s in range(1, NEGATION_SCOPE + 1):
        moves[s, "insult"] = moves[s, "threat"] = moves[s, "target"] = (s - 1, NEGATED)
    return Transducer(moves, {s: max(0, s - 1) for s in range(NEGATION_SCOPE + 1)})


def target() -> Transducer:
    """State: whether somebody has been named; insults are then aimed at them."""
    return Transducer({(0, "target"): (1, 1.0), (1, "insult"): (1, AIMED)})


def report() -> Transducer:
    """State: whether the clause reports what others say."""
    aimed = {(1, s): (1, REPORTED) for s in ("insult", "target")}
    return Transducer({(0, "report"): (1, 1.0), **aimed})


def threat() -> Transducer:
    """State: whether a threat waits for its target; meeting it is an event of its own."""
    return Transducer({(0, "threat"): (1, 1.0), (1, "target"): (0, 1.0)})


def compose() -> dict[tuple[tuple, str], tuple[tuple, float, bool]]:
    """All reachable moves of the product machine: (state, symbol) -> (next state, factor, threat met)."""
    parts = (negation(), target(), report(), threat())
    start = (0,) * len(parts)
    table, open_states = {}, [start]
    while open_states:
        state = open_states.pop()
        for symbol in SYMBOLS:
            if (state, symbol) in table:
                continue
            steps = [p.step(s, symbol) for p, s in zip(parts, state)]
            after = tuple(s for s, _ in steps)
            met = symbol == "target" and state[3] == 1
            # Factors act on events only: on an insult, or on the target that completes a threat.
            factor = float(np.prod([f for _, f in steps])) if symbol == "insult" or met else 1.0
            table[state, symbol] = (after, factor, met)
            open_states.append(after)
    return table


GRAMMAR = compose()
START = (0, 0, 0, 0)


def clause_weight(tokens: list[str], symbols: dict[str, str], weights: dict[str, float]) -> float:
    """What the composed machine adds up over one clause."""
    state, total = START, 0.0
    for token in tokens:
        symbol = symbols.get(token, "other")
        state, factor, met = GRAMMAR[state, symbol]
        if symbol == "insult":
            total += factor * weights[token]
        elif met:
            total += factor * THREAT_WEIGHT
    return total


def features(text: str | None, symbols: dict[str, str], weights: dict[str, float]) -> list[float]:
    """Total, heaviest, number and density of the matched clauses."""
    folded = (text or "").lower()
    tokens = _TOKEN.findall(folded)
    if not any(symbols.get(t) in ("insult", "threat") for t in set(tokens)):
        return [0.0] * 4
    found = [w for w in (clause_weight(_TOKEN.findall(c), symbols, weights) for c in _CLAUSE.split(folded)) if w > 0]
    if not found:
        return [0.0] * 4
    return [float(np.log1p(sum(found))), float(np.log1p(max(found))), float(np.log1p(len(found))), min(5.0, 100 * sum(found) / max(20, len(tokens)))]


@dataclass(frozen=True)
class ToxicityModel:
    """Insult weights by word (learnt and fixed), and the logistic weights; at most ``MAX_LEARNT`` words."""

    insults: dict
    logistic: tuple

    def symbols(self) -> dict[str, str]:
        table = {}
        for symbol, words in (("report", REPORTS), ("negation", NEGATIONS), ("target", TARGETS), ("threat", THREATS), ("insult", self.insults)):
            table.update(dict.fromkeys(words, symbol))
        return table


def fixed_lexicon() -> dict[str, float]:
    return dict.fromkeys(INSULTS, INSULT_WEIGHT)


def labelled_sample(docs: DataFrame, labels: DataFrame, usable: Column, key: str, text: str, label: str, sample: int) -> DataFrame:
    """(key, toxic, text) of at most ``sample`` labelled texts for which ``usable`` holds, written down."""
    known = labels.filter(labels[key].isNotNull() & labels[label].isNotNull()).filter(usable).groupBy(key).agg(F.max(label).cast("int").alias("toxic"))
    chosen = materialize(known.orderBy(F.xxhash64(key), key).limit(sample), "labelled_keys")
    texts = docs.select(docs[f"`{key}`"].alias(key), F.coalesce(docs[f"`{text}`"], F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), key)  # at most ``sample`` narrow rows
    return materialize(found.groupBy(key).agg(F.max("toxic").alias("toxic"), F.min("text").alias("text")), "labelled_texts")


def learn_lexicon(sampled: DataFrame) -> dict[str, float]:
    """Word -> log ratio of its frequency in toxic and in clean texts, for words that speak clearly."""

    def contexts(batches):
        import pyarrow as pa

        for batch in batches:
            words, near = [], []
            for text in batch.column(0).to_pylist():
                tokens = ["", *_TOKEN.findall(text.lower()), ""]
                for i, w in enumerate(tokens[1:-1], 1):
                    words.append(w)
                    near.append(xxhash.xxh32_intdigest(f"{tokens[i - 1]} {tokens[i + 1]}"))
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(near, pa.int64())], names=["word", "near"])

    counts = {r["toxic"]: r["n"] for r in sampled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = counts.get(1, 0), counts.get(0, 0)
    if not n_toxic or not n_clean:
        return {}
    around = sampled.filter("toxic = 1").select("text").mapInArrow(contexts, "word string, near long").distinct()
    seen = around.groupBy("word").agg(F.count(F.lit(1)).alias("contexts")).filter(F.col("contexts") >= MIN_CONTEXTS)

    def present(batches):
        import pyarrow as pa

        for batch in batches:
            words, labels = [], []
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = set(_TOKEN.findall(text.lower()))
                words += own
                labels += [toxic] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(labels, pa.int32())], names=["word", "toxic"])

    found = sampled.select("toxic", "text").mapInArrow(present, "word string, toxic int").groupBy("word")
    counted = found.agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("all")).join(seen, "word")
    in_toxic = (F.least("bad", "contexts") + 0.5) / (n_toxic + 1)
    in_clean = (F.col("all") - F.col("bad") + 0.5) / (n_clean + 1)
    clear = counted.withColumn("ratio", in_toxic / in_clean).filter(F.col("ratio") >= MIN_RATIO)
    rows = clear.orderBy(F.desc("contexts"), "word").limit(MAX_LEARNT).select("word", "ratio").collect()
    return {r["word"]: float(min(6.0, np.log(r["ratio"]))) for r in rows}


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> tuple:
    """Newton steps on the ridge-penalised log loss; the intercept is free."""
    if len(y) == 0 or y.min() == y.max():
        return DEFAULT_WEIGHTS
    x = np.hstack([np.ones((len(x), 1)), x])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (y - p) - penalty * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        move = np.linalg.solve(hessian, gradient)
        w = w + move
        if np.abs(move).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def add_features(df: DataFrame, text: str, symbols: dict, weights: dict, keep: list[str]) -> DataFrame:
    def make():
        return lambda texts: [[features(t, symbols, weights) for t in texts]]

    return add_columns(df, text, make, [field("features", "array<double>")], keep)


def fit_toxicity(docs: DataFrame, labels: DataFrame, usable: Column, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> ToxicityModel:
    """Lexicon and logistic weights from labelled texts; ``usable`` (over labels) says which may be learnt from."""
    sampled = labelled_sample(docs, labels, usable, key, text, label, sample)
    lexicon = {**fixed_lexicon(), **learn_lexicon(sampled)}
    symbols = ToxicityModel(lexicon, ()).symbols()
    rows = add_features(sampled, "text", symbols, lexicon, [key, "toxic"]).select("toxic", "features").collect()
    x = np.array([r["features"] for r in rows]).reshape(-1, 4)
    return ToxicityModel(lexicon, fit_logistic(x, np.array([float(r["toxic"]) for r in rows])))


def add_score(df: DataFrame, model: ToxicityModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns and ``score``, the chance that a text is toxic."""
    symbols, weights, logistic = model.symbols(), model.insults, np.array(model.logistic)

    def make():
        def work(texts):
            x = np.array([features(t, symbols, weights) for t in texts]).reshape(-1, 4)
            z = logistic[0] + x @ logistic[1:]
            return [(1 / (1 + np.exp(-np.clip(z, -30, 30)))).tolist()]

        return work

    return add_columns(df, text, make, [field("score", "double")], keep or df.columns)


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """One row per text: (key, held_out, score, predicted); texts held out by their key are never learnt from."""
    model = fit_toxicity(docs, labels, key_remainder(labels[key], FOLDS) != 0, key, text, label, sample)
    scored = add_score(docs.select(docs[f"`{key}`"].alias(key), docs[f"`{text}`"].alias("text")), model, "text", [key])
    return scored.select(key, (key_remainder(F.col(key), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
