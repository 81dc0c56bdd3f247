"""Mixing to target weights with soft membership.

A classifier learnt from a labelled table gives every document a posterior over domains. Nonnegative rates
r (how often a document is to appear) are fitted so that the expected tokens of each domain, the sum of
rate x tokens x posterior, are the wanted ones: accelerated projected-gradient least squares from rates of
one, on residuals scaled by each domain's own tokens, which makes a step length of one safe. A step needs only the
domain sums: one pass over (tokens, posterior), whose rows replay the steps so far from the residuals, a few
numbers each. No rates travel and none are kept between passes.

The classifier is a softmax regression on character histograms, learnt from at most ``sample`` labelled
documents chosen by a hash of their key; everything else covers all rows.

Defined cases: a null or empty text has no tokens and the posterior of an empty histogram; without usable
labels, or with one domain only, every document belongs to the wanted domains in equal parts, so all rates are
one; a wanted domain that no label names is left out and the other weights are scaled up; targets that
cannot be met exactly are met in the least-squares sense; equal rows get equal rates, and copies drawn by key;
a null key is carried along; other input columns play no part.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosecast.llm.common import add_columns, field
from dosecast.llm.toxicity import labelled_sample
from dosecast.session import materialize

SAMPLE = 20_000  # labelled documents that the classifier is learnt from, at most
TOLERANCE = 1e-3  # of a domain's wanted tokens
STEPS = 200
FIT_STEPS = 300


def histogram(text: str | None) -> np.ndarray:
    """Square roots of byte shares, the length on a log scale, and the tokens (not a feature) last."""
    data = (text or "").encode()
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    out = np.empty(258)
    out[:256] = np.sqrt(counts / max(1, len(data)))
    out[257] = len(data.split())
    out[256] = np.log1p(out[257])
    return out


class Classifier:
    """Softmax regression; ``domains`` are the label values in order."""

    def __init__(self, domains: list, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray):
        self.domains, self.mean, self.scale, self.weights = domains, mean, scale, weights

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        if len(self.domains) < 2:
            return np.ones((len(x), len(self.domains)))
        z = np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))]) @ self.weights
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def fit_softmax(x: np.ndarray, y: np.ndarray, domains: list, ridge: float = 1e-4, steps: int = FIT_STEPS) -> Classifier:
    """Accelerated gradient descent on standardised features."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    wanted = (y[:, None] == np.arange(len(domains))).astype(float)
    # The log loss is at most half as curved as the features' covariance.
    step = 1.0 / (0.5 * float(np.linalg.eigvalsh(z.T @ z / len(z))[-1]) + ridge)
    w = ahead = np.zeros((z.shape[1], len(domains)))
    t = 1.0
    for _ in range(steps):
        scores = z @ ahead
        e = np.exp(scores - scores.max(axis=1, keepdims=True))
        gradient = z.T @ (e / e.sum(axis=1, keepdims=True) - wanted) / len(z) + ridge * ahead
        after, s = ahead - step * gradient, (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = after + (t - 1) / s * (after - w), after, s
    return Classifier(domains, mean, scale, w)


def fit_classifier(docs: DataFrame, labels: DataFrame, domain: str, key: str, text: str, sample: int = SAMPLE) -> Classifier:
    """Learnt from labelled documents; the label column ``domain`` holds whole numbers."""
    sampled = labelled_sample(docs, labels, F.lit(True), key, text, domain, sample)
    cells = add_columns(sampled, "text", lambda: lambda texts: [[histogram(t).tolist() for t in texts]], [field("x", "array<double>")], ["toxic"])
    rows = cells.select(F.col("toxic").alias("domain"), "x").toArrow()
    domains = sorted(set(rows.column("domain").to_pylist()))
    if len(domains) < 2:
        return Classifier(domains, np.zeros(257), np.ones(257), np.zeros((258, len(domains))))
    x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(-1, 258)[:, :257]
    place = {d: i for i, d in enumerate(domains)}
    return fit_softmax(x, np.array([place[d] for d in rows.column("domain").to_pylist()]), domains)


def add_posteriors(df: DataFrame, model: Classifier, text: str, keep: list[str]) -> DataFrame:
    """The kept columns, ``tokens`` and ``posterior`` (in the order of the model's domains)."""

    def make():
        def work(texts):
            x = np.array([histogram(t) for t in texts]).reshape(-1, 258)
            return [x[:, 257].astype(np.int64), model.posteriors(x[:, :257]).tolist()]

        return work

    return add_columns(df, text, make, [field("tokens", "long"), field("posterior", "array<double>")], keep)


def replay(posterior: np.ndarray, pulls: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rates after the steps so far, and the rates ahead of them that the next step starts from.

    Each step moves a document along its posterior and stops at zero; momentum runs ahead of it.
    """
    rates = ahead = np.ones(len(posterior))
    t = 1.0
    for pull in pulls:
        after = np.maximum(0.0, ahead - posterior @ pull)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, rates, t = after + (t - 1) / s * (after - rates), after, s
    return rates, ahead


def _posteriors(batch: pa.RecordBatch, n: int) -> np.ndarray:
    return batch.column("posterior").flatten().to_numpy(zero_copy_only=False).reshape(-1, n)


def domain_tokens(rows: DataFrame, pulls: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Expected tokens of each domain at the present rates and at those ahead: one row of sums from each task."""

    def sums(batches):
        total = np.zeros(2 * n)
        for batch in batches:
            p = _posteriors(batch, n)
            tokens = batch.column("tokens").to_numpy(zero_copy_only=False)
            total += np.concatenate([(r * tokens) @ p for r in replay(p, pulls)])
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["sums"])

    parts = rows.select("tokens", "posterior").mapInArrow(sums, "sums array<double>")
    found = parts.agg(*[F.sum(F.col("sums")[i]) for i in range(2 * n)]).first()
    held = np.array([v or 0.0 for v in found])
    return held[:n], held[n:]


def fit_rates(rows: DataFrame, targets: np.ndarray, tolerance: float = TOLERANCE, steps: int = STEPS) -> list[np.ndarray]:
    """The pulls of projected-gradient descent towards ``targets`` (shares of all tokens, one per domain).

    It ends when every domain is within ``tolerance`` of its wanted tokens, when ten steps gain less than a
    hundredth, or after ``steps``.
    """
    n, pulls = len(targets), []
    own, ahead = domain_tokens(rows, pulls, n)
    held, wanted = own, targets * own.sum()
    scale = np.where(own > 0, own, 1.0)
    allowed, marks = np.maximum(tolerance * wanted, 0.5), []
    for _ in range(steps):
        off = np.abs(held - wanted)
        marks.append(float((off / scale).max()))
        if (off <= allowed).all() or (len(marks) > 10 and marks[-1] > 0.99 * marks[-11]):
            break
        pulls.append((ahead - wanted) / scale)
        held, ahead = domain_tokens(rows, pulls, n)
    return pulls


def wanted_shares(domains: list, weights: Mapping) -> np.ndarray:
    """The wanted share of each learnt domain; equal shares where no weight names one."""
    shares = np.array([float(weights.get(d, 0.0)) for d in domains])
    return shares / shares.sum() if shares.sum() > 0 else np.full(len(domains), 1 / max(1, len(domains)))


def mixing_rates(
    docs: DataFrame, labels: DataFrame, weights: Mapping, domain: str, key: str = "doc_id", text: str = "text", keep: list[str] | None = None, sample: int = SAMPLE
) -> tuple[DataFrame, list]:
    """The kept columns with ``tokens``, ``posterior``, ``rate`` and ``copies``; and the domains in order.

    ``copies`` turns a rate into a count: its whole part, and one more with the chance of the rest, drawn
    by a hash of the key.
    """
    keep = [key] if keep is None else keep
    model = fit_classifier(docs, labels, domain, key, text, sample)
    n = len(model.domains)
    source = docs.select(*[docs[f"`{c}`"] for c in keep], docs[f"`{text}`"].alias("_mixed"))
    judged = materialize(add_posteriors(source, model, "_mixed", keep), "posteriors")
    names = [c for c in judged.columns if c.lower() not in ("rate", "copies")]
    pulls = fit_rates(judged, wanted_shares(model.domains, weights)) if n > 1 else []

    def make():
        def work(posteriors):
            if n < 2:
                return [[1.0] * len(posteriors)]
            return [replay(np.array(posteriors, dtype=float).reshape(-1, n), pulls)[0].tolist()]

        return work

    rated = add_columns(judged.withColumn("_posterior", F.col("posterior")), "_posterior", make, [field("rate", "double")], names)
    draw = F.shiftrightunsigned(F.xxhash64(F.col(f"`{key}`"), F.lit("copies")), 11) / float(1 << 53)
    return rated.withColumn("copies", F.floor(F.col("rate") + draw).cast("int")), model.domains


def mixed(docs: DataFrame, labels: DataFrame, weights: Mapping, domain: str, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """``docs`` with every row as often as its ``copies`` say."""
    rated, _ = mixing_rates(docs, labels, weights, domain, key, text, docs.columns, sample)
    often = rated.filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return often.select(*[F.col(f"`{c}`") for c in docs.columns])
