"""Clean tables as Parquet."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.operators.rules import quoted
from millrace.sources.paths import literal


def overwrite_parquet(root: str) -> Callable[[DataFrame, str], None]:
    """Replace ``<root>/<table>``. The old files go before the new ones are
    complete, so a load that fails leaves no table: see :func:`publish_view`.
    """

    def replace(clean: DataFrame, table: str) -> None:
        clean.write.mode("overwrite").parquet(f"{root}/{table}")

    return replace


def view_parts(spark: SparkSession, table: str) -> list[str]:
    """Database, if there is one, and view of a table's name."""
    parts = table.split(".")
    if len(parts) > 2 or not all(parts):
        raise ValueError(f"not a name of a view: {table!r}")
    if len(parts) == 2 and not spark.catalog.databaseExists(quoted(parts[0])):
        raise ValueError(f"no database {parts[0]!r} for the view {table!r}")
    return parts


def publish_view(root: str) -> Callable[[DataFrame, str], None]:
    """Write each load to a folder of its own and point the view ``<table>`` at
    it once the write has committed.

    The swap moves no data, which renaming would on an object store, and works
    with a changed schema. A load that fails leaves the view as it was. A dot
    in the table name separates database and view. Other sessions see the view
    if they share a catalog. Earlier loads stay under ``<root>/<table>`` for
    readers still at work; expire them by the store's own rules. A name that no
    view can have is refused before anything is written.
    """

    def replace(clean: DataFrame, table: str) -> None:
        spark = clean.sparkSession
        parts = view_parts(spark, table)
        location = f"{root}/{table}/{uuid.uuid4().hex}"
        clean.write.parquet(location)
        view = ".".join(map(quoted, parts))
        spark.sql(
            f"CREATE OR REPLACE VIEW {view} AS SELECT * FROM parquet.{quoted(literal(location))}"
        )

    return replace
