"""Reports over clean tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.fixed_values import PAYMENT_COUNT_LABEL, PAYMENT_TYPE, PAYMENT_TYPE_LABEL
from millrace.operators.rules import quoted


def count_by(
    df: DataFrame, key: str, key_label: str | None = None, count_label: str = "n"
) -> DataFrame:
    """Rows per value of ``key``, most first; NULL is a value.

    Counts are formed before the shuffle, so a value that fills most of the
    table costs no more than a rare one. Ties are ordered by the key.
    """
    label = key_label or key
    counts = df.groupBy(F.col(quoted(key)).alias(label)).agg(F.count("*").alias(count_label))
    return counts.orderBy(F.desc(quoted(count_label)), F.asc(quoted(label)))


def payment_chart(payments: DataFrame) -> DataFrame:
    """Payments per payment type, labelled as the dashboard shows them."""
    return count_by(payments, PAYMENT_TYPE, PAYMENT_TYPE_LABEL, PAYMENT_COUNT_LABEL)
