"""Connected components of a table of links, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``(a, b)``; the root is the least node.

    In turn every node hands its greater neighbours, and then its smaller ones,
    to the least node it knows, until each node knows only its root. The number
    of rounds grows with the logarithm of the size, and no node's neighbours are
    ever gathered in one place: least values are formed before they are moved.
    """
    apart = links.filter("a != b")
    edges = stored(
        apart.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(),
        "links",
    )
    state = _fingerprint(edges)
    while True:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("v_least"))
        large = (
            both.join(least, "u")
            .filter("v > u")
            .select(F.col("v").alias("hi"), F.least("u", "v_least").alias("lo"))
            .distinct()
        )
        large = stored(large, "links")
        roots = large.groupBy("hi").agg(F.min("lo").alias("root"))
        small = (
            large.join(roots, "hi")
            .filter("lo != root")
            .select(F.col("lo").alias("hi"), F.col("root").alias("lo"))
            .unionByName(roots.select("hi", F.col("root").alias("lo")))
            .distinct()
        )
        edges = stored(small, "links")
        before, state = state, _fingerprint(edges)
        if state == before:
            break
    return (
        edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        .unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")))
        .distinct()
    )


def _fingerprint(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges."""
    row = F.xxhash64("hi", "lo")
    mixed = F.sum(F.shiftrightunsigned(row, 24)), F.sum(row.bitwiseAND(F.lit(0xFFFFFF)))
    return tuple(edges.agg(F.count("*"), *mixed).first())
