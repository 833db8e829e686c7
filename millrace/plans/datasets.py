"""Which cleaning rules a file gets, and which table it fills."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.fixed_values import (
    CATEGORY,
    CUSTOMER,
    CUSTOMERS,
    ITEMS,
    LOAD_TIME,
    ORDERS,
    PAYMENTS,
    PRICE,
    PRODUCTS,
    PURCHASE_TIME,
    UNKNOWN,
)
from millrace.functions import file_name, first_match, target_table
from millrace.operators import (
    dedupe,
    fill_missing,
    identity,
    keep_positive,
    parse_timestamp,
    stamp_load,
)
from millrace.operators.rules import Rule


@dataclass(frozen=True)
class Dataset:
    """How to read and clean the files whose name contains ``fragment``.

    Give ``schema`` in production: without it the types are guessed from the first
    lines, and a load whose later rows do not fit them starts again, with a pass
    over the input to infer them. When types are inferred,
    ``text_columns`` stay text and ``types`` sets those of other columns. Columns
    that a rule names belong in one of the two: a key is a text, and the type of
    a price must not depend on other rows. With ``infer=False`` all columns but
    those of ``types`` are text, and a load reads the header and then its input
    once. With ``by_name`` part files may have their columns in any order.
    """

    name: str
    fragment: str
    rules: Sequence[Rule] = ()
    schema: StructType | str | None = None
    text_columns: Sequence[str] = ()
    types: Mapping[str, str] = field(default_factory=dict)
    csv_options: Mapping[str, str] = field(default_factory=dict)
    infer: bool = True
    by_name: bool = False


# In the order their fragments are tried.
DATASETS = (
    Dataset(
        "orders",
        ORDERS,
        rules=(parse_timestamp(PURCHASE_TIME), stamp_load(LOAD_TIME)),
        text_columns=(PURCHASE_TIME,),
    ),
    Dataset("items", ITEMS, rules=(keep_positive(PRICE),), types={PRICE: "double"}),
    Dataset("customers", CUSTOMERS, rules=(dedupe(CUSTOMER),), text_columns=(CUSTOMER,)),
    Dataset(
        "products", PRODUCTS, rules=(fill_missing({CATEGORY: UNKNOWN}),), text_columns=(CATEGORY,)
    ),
    Dataset("payments", PAYMENTS, rules=(identity,)),
)

# For files no fragment fits: loaded as they are. To add a dataset, pass
# ``DATASETS + (Dataset(...),)`` to the functions below; nothing here changes.
IDENTITY = Dataset("identity", "", rules=(identity,))


def route_files(
    files: DataFrame, datasets: Sequence[Dataset] = DATASETS, path: str = "path"
) -> DataFrame:
    """Add ``file``, ``rule`` and ``table_name`` to a DataFrame of paths."""
    if len({dataset.name for dataset in datasets}) < len(datasets):
        raise ValueError("datasets need names of their own")
    choices = [(dataset.fragment, dataset.name) for dataset in datasets]
    return (
        files.withColumn("file", file_name(F.col(path)))
        .withColumn("rule", first_match(F.col("file"), choices, IDENTITY.name))
        .withColumn("table_name", target_table(F.col("file")))
    )
