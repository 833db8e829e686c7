"""A quality classifier learned from positives and unlabelled text.

Trusted positives and a sample of all texts train a small network; the risk is
the non-negative unbiased one, which needs the share of positives among the
unlabelled. That share is estimated from how a first model, which tells
positives from unlabelled text, ranks the two.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import drawn, remainder, stored, table
from millrace.llm.textstats import text_stats

# Rows that training may use of each kind, drawn by hash.
MAX_POSITIVES = 20_000
MAX_UNLABELLED = 20_000
HIDDEN = 16
STEPS = 600
THRESHOLD = 0.3
FEATURES = 10


def features(text: str | None) -> list[float]:
    """Numbers that do not depend on the language; an empty text has all 0."""
    s = text_stats(text)
    words, lines = max(s["n_words"], 1), max(s["n_lines"], 1)
    return [
        float(np.log1p(s["n_words"])),
        s["word_chars"] / words,
        s["n_symbols"] / words,
        s["n_dup_lines"] / lines,
        s["n_repeat_words"] / words,
        s["n_distinct_words"] / words,
        s["n_after_itself"] / words,
        s["n_stops"] / words,
        float(np.log1p(s["n_words"] / lines)),
        1.0 if s["n_words"] else 0.0,
    ]


def with_features(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``features array<double>`` of every whole text."""

    def count(batches):
        for batch in batches:
            rows = [features(text) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(rows, pa.list_(pa.float64()))],
                ["doc_id", "features"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, features array<double>")


class Network:
    """One hidden layer; ``margin`` above 0 means positive is likelier."""

    def __init__(self, points: np.ndarray, hidden: int = HIDDEN, seed: int = 5):
        random = np.random.default_rng(seed)
        self.mean = points.mean(axis=0) if len(points) else np.zeros(FEATURES)
        self.spread = points.std(axis=0) + 1e-3 if len(points) else np.ones(FEATURES)
        self.w1 = random.normal(0, 1 / np.sqrt(FEATURES), (FEATURES, hidden))
        self.b1, self.w2, self.b2 = np.zeros(hidden), random.normal(0, 0.3, hidden), np.zeros(1)
        self.state = None

    def margin(self, points: np.ndarray) -> np.ndarray:
        return np.tanh(self._scaled(points) @ self.w1 + self.b1) @ self.w2 + self.b2[0]

    def _scaled(self, points):
        # Far outside of what was seen, a feature says no more than at the edge.
        return np.clip((points - self.mean) / self.spread, -6, 6)

    def step(self, points: np.ndarray, slope: np.ndarray, rate: float = 0.02) -> None:
        """Move against ``slope``, the gradient of the risk by the margins (Adam)."""
        x = self._scaled(points)
        h = np.tanh(x @ self.w1 + self.b1)
        back = np.outer(slope, self.w2) * (1 - h * h)
        weights = [self.w1, self.b1, self.w2, self.b2]
        grads = [x.T @ back, back.sum(axis=0), h.T @ slope, np.array([slope.sum()])]
        if self.state is None:
            self.state = [0, [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]]
        self.state[0] += 1
        t, firsts, seconds = self.state
        for w, g, first, second in zip(weights, grads, firsts, seconds, strict=True):
            g = g + 1e-4 * w
            first += 0.1 * (g - first)
            second += 0.001 * (g * g - second)
            w -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def estimate_prior(positives: np.ndarray, unlabelled: np.ndarray, steps: int = STEPS // 2) -> float:
    """The share of positives among the unlabelled.

    Any region holds at least that share of its weight among the positives, so
    the least ratio of the two weights bounds it. The regions tried are those
    above each score of a model that tells the two samples apart, and that hold
    a tenth of the positives or more. A half of the rows is scored by a model of
    the other half, equal rows together, as a model ranks too well what it has
    seen; and each ratio counts with one standard error on top, as the least of
    many is too low by chance.
    """
    half = lambda rows: np.array([zlib.crc32(row.tobytes()) % 2 for row in rows])
    p_half, u_half = half(positives), half(unlabelled)
    p, u = [], []
    for own in (0, 1):
        some_p, some_u = positives[p_half != own], unlabelled[u_half != own]
        if not len(some_p) or not len(some_u):
            continue
        both = np.concatenate([some_p, some_u])
        label = np.concatenate([np.ones(len(some_p)), np.zeros(len(some_u))])
        weight = np.where(label == 1, 1 / len(some_p), 1 / len(some_u))
        model = Network(both)
        for _ in range(steps):
            model.step(both, weight * (sigmoid(model.margin(both)) - label))
        p.append(model.margin(positives[p_half == own]))
        u.append(model.margin(unlabelled[u_half == own]))
    p, u = np.sort(np.concatenate(p or [[]])), np.sort(np.concatenate(u or [[]]))
    if not len(p) or not len(u):
        return 0.5
    cuts = np.quantile(p, np.linspace(0, 0.9, 91))
    p_above = 1 - np.searchsorted(p, cuts) / len(p)
    u_above = 1 - np.searchsorted(u, cuts) / len(u)
    error = np.sqrt(u_above * (1 - u_above) / len(u) + u_above**2 * (1 - p_above) / p_above / len(p))
    return float(np.clip(((u_above + error) / p_above).min(), 0.05, 0.99))


def fit(positives: np.ndarray, unlabelled: np.ndarray, steps: int = STEPS) -> Network:
    """Minimise the non-negative risk with logistic loss.

    Risk of the positives as such, plus that of the unlabelled taken as
    negatives less what the positives among them add to it. If the latter
    difference falls below 0 it only shows overfitting: the step then goes
    the other way on that part.
    """
    model = Network(np.concatenate([positives, unlabelled]))
    if not len(positives) or not len(unlabelled):
        return model
    prior = estimate_prior(positives, unlabelled)
    both, n = np.concatenate([positives, unlabelled]), len(positives)
    for _ in range(steps):
        margin = model.margin(both)
        share = sigmoid(margin)
        loss_as_negative = np.logaddexp(0, margin)
        as_positive = prior * (share[:n] - 1) / n
        negative = np.concatenate([-prior * share[:n] / n, share[n:] / len(unlabelled)])
        rest = loss_as_negative[n:].mean() - prior * loss_as_negative[:n].mean()
        if rest < 0:
            model.step(both, -negative)
        else:
            negative[:n] += as_positive
            model.step(both, negative)
    return model


def _points(rows: DataFrame) -> np.ndarray:
    found = rows.select("features").toPandas()["features"]
    return np.stack(found.to_list()) if len(found) else np.zeros((0, FEATURES))


def train(
    featured: DataFrame,
    labels: DataFrame,
    max_positives: int = MAX_POSITIVES,
    max_unlabelled: int = MAX_UNLABELLED,
) -> Network:
    """Fit to ``(doc_id, features)`` and the positives in ``(doc_id, quality)``."""
    keys = F.col("doc_id"), F.col("features").cast("string")
    trusted = labels.filter("quality = 1").select("doc_id").distinct()
    positives = featured.join(trusted, "doc_id", "left_semi")
    return fit(
        _points(drawn(positives, max_positives, *keys)), _points(drawn(featured, max_unlabelled, *keys))
    )


def score(featured: DataFrame, model: Network) -> DataFrame:
    """``doc_id, score``: the probability of being positive."""

    def scored(batches):
        for batch in batches:
            rows = batch.column("features").to_pylist()
            points = np.array(rows, dtype=float).reshape(len(rows), FEATURES)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sigmoid(model.margin(points)))],
                ["doc_id", "score"],
            )

    kind = featured.schema["doc_id"].dataType.simpleString()
    return featured.mapInArrow(scored, f"doc_id {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, score, predicted``, a row per row of ``docs``.

    ``labels`` are those that may be learned from. NULL and empty texts are
    scored like any other. Without a positive or a text to learn from, the
    untrained model scores. Rows that repeat an id are scored each. Only
    ``doc_id`` and ``text`` are read.
    """
    featured = stored(with_features(docs), "quality-features")
    return score(featured, train(featured, labels)).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int")
    )


def op9_quality_classifier(spark, sf_dir: str) -> DataFrame:
    held_out = remainder(F.col("doc_id"), 5) == 0
    labels = table(spark, sf_dir, "labels").filter(~held_out)
    return classify(table(spark, sf_dir, "documents"), labels).select(
        "doc_id", held_out.alias("held_out"), "score", "predicted"
    )
