"""Logistic regression by DataFrame jobs, for small tables of binary features."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import number_array


def probability(weights: list[float], features: str) -> Column:
    """The model's probability for an array of feature numbers from 1.

    ``weights[0]`` is the intercept. The others are divided by the square root
    of the number of features, so long and short rows weigh alike.
    """
    table = number_array(weights)
    size = F.greatest(F.size(features), F.lit(1))
    total = F.aggregate(features, F.lit(0.0), lambda s, f: s + F.element_at(table, f + 1))
    margin = F.lit(weights[0]) + total / F.sqrt(size)
    return 1 / (1 + F.exp(-margin))


def train(
    rows: DataFrame, n_features: int, steps: int = 25, rate: float = 0.5, decay: float = 1e-3
) -> list[float]:
    """Fit to ``rows (features array<int>, label double, weight double)``.

    Full-batch gradient steps, each one grouped sum over the table; a feature's
    step is divided by the root of its squared gradients so far. What reaches
    the driver is a sum per feature, ``n_features`` at most. A table of no rows
    gives a model that says one half.
    """
    weights, squares = [0.0] * (n_features + 1), [1e-12] * (n_features + 1)
    for _ in range(steps):
        sums = (
            rows.withColumn("p", probability(weights, "features"))
            .withColumn("g", F.col("weight") * (F.col("p") - F.col("label")))
            .withColumn("part", F.col("g") / F.sqrt(F.greatest(F.size("features"), F.lit(1))))
            # The intercept is feature 0.
            .select(
                F.explode(F.concat(F.array(F.lit(0)), F.col("features"))).alias("f"), "g", "part"
            )
            .groupBy("f")
            .agg(F.sum(F.when(F.col("f") == 0, F.col("g")).otherwise(F.col("part"))).alias("g"))
        )
        # In a set order, and rounded: sums must not depend on who came first.
        slopes = {row.f: round(row.g, 6) for row in sums.collect()}
        for f, slope in slopes.items():
            slope += decay * weights[f] if f else 0.0
            squares[f] += slope * slope
            weights[f] -= rate * slope / math.sqrt(squares[f])
    return [round(w, 6) for w in weights]
