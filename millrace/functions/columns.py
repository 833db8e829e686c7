"""Column expressions. All are built-ins, so they stay in generated JVM code."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType

from millrace.fixed_values import NAME_PREFIX, NAME_SUFFIX, TABLE_POSTFIX


def parsed_timestamp(column: Column) -> Column:
    """The timestamp a value stands for, NULL where it stands for none.

    ``to_timestamp`` would end an ANSI-mode job on the first bad cell.
    """
    return F.try_to_timestamp(column)


def positive(column: Column, data_type: DataType) -> Column:
    """``column > 0``; NULL and unreadable text are not, NaN is.

    Text is compared as double: left to Spark, the literal 0 would make the
    comparison an integer one and ``0.5`` would not be positive. Numbers are
    compared as they are, so the filter can reach the scan.
    """
    number = column.try_cast("double") if isinstance(data_type, StringType) else column
    return number > F.lit(0)


def file_name(path: Column) -> Column:
    """The last part of a path; a folder of part files has its own name."""
    return F.substring_index(F.rtrim(path, F.lit("/")), "/", -1)


def first_match(text: Column, choices: Iterable[tuple[str, str]], default: str) -> Column:
    """The value of the first ``(fragment, value)`` whose fragment is in ``text``."""
    arms = [F.when(F.contains(text, F.lit(fragment)), value) for fragment, value in choices]
    return F.coalesce(*arms, F.lit(default))


def target_table(
    name: Column,
    prefix: str = NAME_PREFIX,
    suffix: str = NAME_SUFFIX,
    postfix: str = TABLE_POSTFIX,
) -> Column:
    """Table name for a file name.

    ``prefix`` and ``suffix`` are dropped wherever they stand, and as often; a
    name without ``suffix`` keeps its extension.
    """
    bare = F.replace(F.replace(name, F.lit(prefix)), F.lit(suffix))
    return F.concat(bare, F.lit(postfix))
