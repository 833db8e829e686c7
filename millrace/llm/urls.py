"""Judge URLs by rules on host and path, and by a model where no rule fits.

The model is a logistic regression on hashed character n-grams of host and
path. Everything is DataFrame code; nothing leaves the JVM but the gradient
sums of a bounded training table.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import logistic
from millrace.llm.common import order_hash, stored, table

ALLOW, BLOCK = "allow", "block"
NGRAM = 3
BUCKETS = 4096
# Labelled URLs that the model is fitted to, per verdict.
MAX_LABELLED = 2000


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule(ALLOW, "org", "/"),
    Rule(BLOCK, "example.org", "/es/"),
    Rule(BLOCK, "example.org", "/en/1"),
    Rule(ALLOW, "com", "/fr/"),
    Rule(BLOCK, "com", "/de/"),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z in lower case."""
    host = F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def decision(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> Column:
    """``(rule, verdict)`` of the longest rule that fits, NULL if none does."""
    arms = [
        F.when(
            F.endswith(F.concat(F.lit("."), host), F.lit("." + rule.host))
            & F.startswith(path, F.lit(rule.path)),
            F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict")),
        )
        for rule in sorted(rules, key=lambda rule: -len(rule.text))
    ]
    return F.coalesce(*arms)


def parts_of(pages: DataFrame, *columns: str) -> DataFrame:
    """``columns``, host and path; both empty for a NULL url or one without ``://``."""
    return pages.select(
        *columns,
        F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"),
        F.coalesce(path_of(F.col("url")), F.lit("")).alias("path"),
    )


def ngrams(host: Column, path: Column, n: int = NGRAM, buckets: int = BUCKETS) -> Column:
    """Feature numbers from 1: the distinct hashed n-grams of host and path."""

    def hashed(part: Column, mark: str) -> Column:
        # With ends, so that a short part has an n-gram too.
        chars = F.split(F.concat(F.lit("^"), part, F.lit("$")), "")
        starts = F.when(F.size(chars) >= n, F.sequence(F.lit(0), F.size(chars) - n))
        gram = lambda i: F.concat(F.lit(mark), *[F.get(chars, i + k) for k in range(n)])
        bucket = lambda i: (F.crc32(gram(i).cast("binary")) % buckets + 1).cast("int")
        return F.coalesce(F.transform(starts, bucket), F.array().cast("array<int>"))

    return F.array_distinct(F.concat(hashed(host, "h"), hashed(path, "p")))


def fit(
    labelled: DataFrame,
    max_labelled: int = MAX_LABELLED,
    n: int = NGRAM,
    buckets: int = BUCKETS,
    steps: int = 25,
) -> list[float]:
    """Weights from a table ``(url, verdict)``.

    Of each verdict ``max_labelled`` different addresses (host and path) are
    used, drawn by hash; both verdicts weigh alike.
    """
    addresses = (
        parts_of(labelled, "verdict")
        .distinct()
        .withColumn("draw", order_hash(F.col("host"), F.col("path")))
    )
    drawn = [
        addresses.filter(F.col("verdict") == verdict)
        .orderBy("draw", "host", "path")
        .limit(max_labelled)
        for verdict in (ALLOW, BLOCK)
    ]
    rows = stored(
        drawn[0]
        .unionByName(drawn[1])
        .select(
            ngrams(F.col("host"), F.col("path"), n, buckets).alias("features"),
            (F.col("verdict") == BLOCK).cast("double").alias("label"),
        )
        .coalesce(1),
        "url-training",
    )
    sizes = {row.label: row.n for row in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    weight = F.lit(1.0)
    for label, size in sizes.items():
        weight = F.when(F.col("label") == label, F.lit(100.0 / size)).otherwise(weight)
    return logistic.train(rows.withColumn("weight", weight), buckets, steps)


def judge(
    pages: DataFrame,
    weights: list[float],
    rules: Sequence[Rule] = RULES,
    n: int = NGRAM,
    buckets: int = BUCKETS,
) -> DataFrame:
    """``page_id, url, host, path, rule, block_score, verdict`` of every page.

    The longest rule decides; without one, a score of one half or more blocks.
    A NULL url, or one without ``://``, has an empty host and path, and is
    judged by the model as such. Repeated rows stay; other columns are not read.
    """
    host, path = F.col("host"), F.col("path")
    return (
        parts_of(pages, "page_id", "url")
        .withColumn("decision", decision(host, path, rules))
        .withColumn("features", ngrams(host, path, n, buckets))
        .withColumn("block_score", logistic.probability(weights, "features"))
        .withColumn("by_model", F.when(F.col("block_score") >= 0.5, BLOCK).otherwise(ALLOW))
        .select(
            "page_id",
            "url",
            "host",
            "path",
            F.col("decision.rule").alias("rule"),
            "block_score",
            F.coalesce("decision.verdict", "by_model").alias("verdict"),
        )
    )


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    """The labelled URLs are the pages that a rule decides."""
    pages = table(spark, sf_dir, "pages")
    decided = parts_of(pages, "url").withColumn(
        "decision", decision(F.col("host"), F.col("path"))
    )
    labelled = decided.filter("decision IS NOT NULL").select("url", "decision.verdict")
    return judge(pages, fit(labelled)).select(
        "page_id", "host", "path", "rule", "verdict", F.round("block_score", 6).alias("block_score")
    )
