"""Tables of a database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_jdbc_table(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str | None = None,
    lower: object = None,
    upper: object = None,
    partitions: int = 1,
    **options: str,
) -> DataFrame:
    """Read a table, or a bracketed query with an alias, which the database runs.

    With ``partition_column`` the read is split into ``partitions`` ranges
    between ``lower`` and ``upper``, one connection each; rows outside the
    bounds fall to the first and last range. Without it one task reads all, so
    that is for bracketed queries with a small answer, such as a grouped count;
    a table by name is refused.
    """
    if not partition_column and not table.lstrip().startswith("("):
        raise ValueError(f"name a partition column to read {table}")
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partition_column:
        reader = reader.options(
            partitionColumn=partition_column,
            lowerBound=str(lower),
            upperBound=str(upper),
            numPartitions=str(partitions),
        )
    return reader.load()
