from millrace.operators.reports import count_by, payment_chart
from millrace.operators.rules import (
    dedupe,
    dedupe_latest,
    fill_missing,
    identity,
    keep_positive,
    parse_timestamp,
    stamp_load,
)

__all__ = [
    "count_by",
    "dedupe",
    "dedupe_latest",
    "fill_missing",
    "identity",
    "keep_positive",
    "parse_timestamp",
    "payment_chart",
    "stamp_load",
]
