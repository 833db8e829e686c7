"""Cleaning rules: each call returns a function for ``DataFrame.transform``.

A rule whose column is missing raises Spark's ``AnalysisException`` when it is
applied, before any data is read.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, NumericType, StringType

from millrace.fixed_values import LOAD_TIME
from millrace.functions import parsed_timestamp, positive

Rule = Callable[[DataFrame], DataFrame]


def _type_of(df: DataFrame, column: str) -> DataType:
    return df.select(column).schema[0].dataType


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def unused_name(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it in any case."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def parse_timestamp(column: str) -> Rule:
    """Replace a column by the timestamps it stands for, NULL where none."""
    return lambda df: df.withColumn(column, parsed_timestamp(F.col(column)))


def stamp_load(column: str = LOAD_TIME) -> Rule:
    """Add the time of the load. Spark fixes it once per query, not per task."""
    return lambda df: df.withColumn(column, F.current_timestamp())


def keep_positive(column: str) -> Rule:
    """Keep rows whose value is above zero; NULL goes, NaN stays."""
    return lambda df: df.filter(positive(F.col(column), _type_of(df, column)))


def dedupe(*keys: str) -> Rule:
    """One row per key, whichever comes first; all NULL keys are one group.

    The rest of the row travels as one struct. With ``dropDuplicates`` every
    column is an aggregate of its own; as soon as one is text both plans sort,
    map task sends at most one row per key, so a key that holds a third of the
    table is little more work for its reducer than any other.
    """

    def one_per_key(df: DataFrame) -> DataFrame:
        rest = [name for name in df.columns if name not in keys]
        if not rest:
            return df.dropDuplicates(list(keys))
        row = F.struct(*[F.col(quoted(name)) for name in rest])
        kept_row = unused_name(df, "kept_row")
        kept = df.groupBy(*map(quoted, keys)).agg(F.any_value(row).alias(kept_row))
        # Keys are read from the grouping, so a plan that needs only them
        # drops the struct and becomes a hash aggregate.
        return kept.select(
            *[
                F.col(quoted(name)) if name in keys else F.col(f"{kept_row}.{quoted(name)}")
                for name in df.columns
            ]
        )

    return one_per_key


def dedupe_latest(keys: list[str], order_by: list[str]) -> Rule:
    """One row per key, the highest by ``order_by``.

    Repeatable if ``order_by`` has no ties within a key. Spark puts a group
    limit before the shuffle, so each map task sends one row per key.
    """

    def latest_per_key(df: DataFrame) -> DataFrame:
        rank = unused_name(df, "key_rank")
        newest_first = Window.partitionBy(*map(quoted, keys)).orderBy(
            *[F.desc(quoted(name)) for name in order_by]
        )
        ranked = df.withColumn(rank, F.row_number().over(newest_first))
        return ranked.filter(F.col(rank) == 1).drop(rank)

    return latest_per_key


def fill_missing(values: Mapping[str, object]) -> Rule:
    """Replace NULL by a value per column; blanks are values and stay.

    A column that is not text becomes text if its filler is text, since that has
    no other form. A filler that is not text needs a column of its own kind.
    """

    def filled(df: DataFrame) -> DataFrame:
        for name, value in values.items():
            column = _type_of(df, name)
            if not isinstance(value, str):
                wanted = BooleanType if isinstance(value, bool) else NumericType
                if not isinstance(column, wanted):
                    raise TypeError(f"cannot fill {name} ({column.simpleString()}) with {value!r}")
            elif not isinstance(column, StringType):
                df = df.withColumn(name, F.col(name).cast("string"))
        return df.na.fill(dict(values))

    return filled


def identity(df: DataFrame) -> DataFrame:
    """The rule for tables that need none."""
    return df
