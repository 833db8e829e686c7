"""Quality rules, with an isolation forest on the rules' statistics.

Random splits isolate an odd document in few steps. The forest is fitted to a
bounded sample of labelled documents; the score above which a document is odd
is set by the labels of all of them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import drawn, stored, table
from millrace.llm.textstats import text_stats

STATS = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_lines",
    "n_dup_lines",
    "n_repeat_words",
)
# Labelled documents the forest may be fitted to; each tree draws SUBSAMPLE.
MAX_FIT = 20_000
# Isolation needs odd rows to be few: bad rows may be such a share of the fit.
CONTAMINATION = 0.01
TREES = 128
SUBSAMPLE = 1024
# Repeated lines are usual up to what this share of clean documents stays below.
USUAL_SHARE = 0.999
# A clean document lost counts as so many bad ones kept.
CLEAN_WEIGHT = 10.0
SCORE_BINS = 1000


def rule_stats(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the statistics of every whole text; NULL has no words."""

    def count(batches):
        for batch in batches:
            rows = [text_stats(text) for text in batch.column("text").to_pylist()]
            columns = [pa.array([row[name] for row in rows], pa.int64()) for name in STATS]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *columns], ["doc_id", *STATS]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{name} bigint" for name in STATS)
    return docs.select("doc_id", "text").mapInArrow(count, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features(rows, usual: float = 0.0) -> np.ndarray:
    """Shares, so that a long document is not odd for its length.

    Split points are drawn evenly over a feature's range, so the long tail of
    symbols is pulled in, and repeated lines up to a share ``usual`` that clean
    texts have too are drawn together.
    """
    words = np.maximum(np.asarray(rows["n_words"], dtype=float), 1)
    lines = np.maximum(np.asarray(rows["n_lines"], dtype=float), 1)
    share = lambda name, of: np.asarray(rows[name], dtype=float) / of
    return np.stack(
        [
            share("word_chars", words),
            np.log1p(20 * share("n_symbols", words)),
            np.maximum(share("n_dup_lines", lines) - usual, 0),
            share("n_repeat_words", words) ** 2,
        ],
        axis=1,
    )


def expected_path(size: int) -> float:
    """Mean steps of a failed search in a binary tree of ``size`` points."""
    if size < 2:
        return 0.0
    return 2 * (math.log(size - 1) + 0.5772156649) - 2 * (size - 1) / size


class IsolationForest:
    """Trees as arrays: node i has the children 2i + 1 and 2i + 2."""

    def __init__(
        self, points: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed=7, usual: float = 0.0
    ):
        random = np.random.default_rng(seed)
        size = min(subsample, len(points))
        self.usual, self.votes = usual, size > 1
        self.depth = max(1, math.ceil(math.log2(max(size, 2))))
        self.scale = expected_path(size) or 1.0
        nodes = 2 ** (self.depth + 1) - 1
        self.feature = np.full((trees, nodes), -1)
        self.split = np.zeros((trees, nodes))
        self.path = np.zeros((trees, nodes))
        for tree in range(trees):
            drawn = points[random.choice(len(points), size, replace=False)] if size else points
            self._grow(tree, 0, 0, drawn, random)

    def _grow(self, tree, node, depth, points, random):
        self.path[tree, node] = depth + expected_path(len(points))
        if depth == self.depth or len(points) < 2:
            return
        low, high = points.min(axis=0), points.max(axis=0)
        open_features = np.flatnonzero(high > low)
        if not len(open_features):
            return
        f = random.choice(open_features)
        at = random.uniform(low[f], high[f])
        right = points[:, f] > at
        self.feature[tree, node], self.split[tree, node] = f, at
        self._grow(tree, 2 * node + 1, depth + 1, points[~right], random)
        self._grow(tree, 2 * node + 2, depth + 1, points[right], random)

    def score(self, points: np.ndarray) -> np.ndarray:
        """0 to 1; one half is ordinary, near 1 is soon alone. A forest of fewer
        than two points has nothing to compare with: all are ordinary."""
        if not self.votes:
            return np.full(len(points), 0.5)
        total, rows = np.zeros(len(points)), np.arange(len(points))
        for feature, split, path in zip(self.feature, self.split, self.path, strict=True):
            node = np.zeros(len(points), dtype=int)
            for _ in range(self.depth):
                f = feature[node]
                below = 2 * node + 1 + (points[rows, f] > split[node])
                node = np.where(f >= 0, below, node)
            total += path[node]
        return 2.0 ** (-total / len(self.feature) / self.scale)


def fit(
    labelled: DataFrame, max_fit: int = MAX_FIT, contamination: float = CONTAMINATION
) -> IsolationForest:
    """A forest for ``(doc_id, STATS..., quality)``.

    Up to ``max_fit`` clean rows, drawn by hash, and few enough bad ones. What
    share of repeated lines is usual is said by all clean rows.
    """
    repeated = F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))
    clean_rows = labelled.filter("quality = 1")
    usual = clean_rows.agg(F.percentile_approx(repeated, USUAL_SHARE, 10_000)).first()[0] or 0.0

    def points(rows: DataFrame, n: int) -> np.ndarray:
        some = drawn(rows, n, F.col("doc_id"), *map(F.col, STATS))
        return features(some.select(*STATS).toPandas(), usual)

    clean = points(clean_rows, max_fit)
    bad = points(labelled.filter("quality != 1"), math.ceil(contamination * max_fit))
    few = math.ceil(contamination * len(clean)) if len(clean) else len(bad)
    return IsolationForest(np.concatenate([clean, bad[:few]]), usual=usual)


def with_score(stats: DataFrame, forest: IsolationForest) -> DataFrame:
    """Add ``score`` to rows that have STATS."""
    names = stats.columns

    def score(batches):
        for batch in batches:
            rows = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in STATS}
            scores = pa.array(forest.score(features(rows, forest.usual)))
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*names, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stats.schema)
    return stats.mapInArrow(score, schema + ", score double")


def threshold(scored: DataFrame, clean_weight: float = CLEAN_WEIGHT) -> float | None:
    """The score above which to drop, from ``(score, quality)`` of all labelled rows.

    A histogram of the scores by label is all that the choice needs. Without
    bad rows, or without clean ones, there is none.
    """
    bins = (
        scored.filter("quality IS NOT NULL")
        .groupBy(F.floor(F.col("score") * SCORE_BINS).cast("int").alias("bin"), "quality")
        .agg(F.count("*").alias("n"))
        .collect()
    )
    bad, clean = np.zeros(SCORE_BINS + 2), np.zeros(SCORE_BINS + 2)
    for row in bins:
        (clean if row.quality == 1 else bad)[row.bin] += row.n
    if not bad.sum() or not clean.sum():
        return None
    # Losses if everything from a bin on is dropped.
    lost = np.cumsum(clean[::-1])[::-1] / clean.sum()
    kept = 1 - np.cumsum(bad[::-1])[::-1] / bad.sum()
    return float(np.argmin(clean_weight * lost + kept)) / SCORE_BINS


def apply_rules(docs: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT) -> DataFrame:
    """``doc_id``, STATS, ``base_failed, score, kept``, a row per row of ``docs``.

    The base rules fail a text of under 50 words, or with over half of its
    words in repeated windows. Of the others the forest drops those that score
    above the calibrated threshold. NULL and empty texts have no words and
    fail. A label of a missing document, or a NULL label, is not used; a
    document labelled twice counts twice in the calibration. Without labels
    of both kinds the base rules alone decide. Other columns are not read.
    """
    stats = stored(rule_stats(docs).withColumn("base_failed", base_failed()), "rule-stats")
    quality = labels.select("doc_id", "quality").filter("quality IS NOT NULL")
    labelled = stats.filter("NOT base_failed").join(quality, "doc_id")
    forest = fit(labelled, max_fit)
    at = threshold(with_score(labelled.select(*STATS, "quality"), forest))
    kept = ~F.col("base_failed")
    if at is not None:
        kept &= F.floor(F.col("score") * SCORE_BINS) / SCORE_BINS < F.lit(at)
    return with_score(stats, forest).withColumn("kept", kept)


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    ruled = apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return ruled.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        F.round("score", 6).alias("score"),
    )
