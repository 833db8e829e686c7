"""Tables that change together."""

from __future__ import annotations

import hashlib
import time
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.rules import quoted, unused_name
from millrace.sinks.files import view_parts
from millrace.sources.paths import exists, literal

POINTER = "release string, table_name string, columns string, folder string"


class Release:
    """A set of loads that readers see all at once, or not at all.

    Each load goes to a folder of its own. :meth:`publish` then appends one file to
    ``<root>/releases``, and that commit is the switch: every view reads the
    newest release that the file names for its table, as a filter on a folder
    name that Spark evaluates before it lists files to scan. A table that the set
    does not load stays at its last release. Data of a set that is never
    published is seen by nobody; expire it, and old releases, by the store's own
    rules.

    A view has fixed columns. Where a load changes them the view is replaced
    after the switch and shows the old rows until then, the one step that
    is not part of it.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        # Later than any other, whatever the clocks say.
        newest = _releases(spark, self.root).agg(F.max("release")).first()[0]
        number = max(time.time_ns(), 1 + int(newest[1:].split("-")[0]) if newest else 0)
        self.name = f"r{number:020d}-{uuid.uuid4().hex}"
        self._tables: dict[str, tuple[str, DataFrame]] = {}

    def sink(self, clean: DataFrame, table: str) -> None:
        """Write a table of the set; to be given to ``load_files``."""
        view_parts(self.spark, table)
        columns = hashlib.sha256(clean.schema.json().encode()).hexdigest()[:16]
        key = unused_name(clean, "release")
        folder = f"{self.root}/tables/{table}/{columns}/{key}={self.name}"
        clean.write.mode("overwrite").parquet(folder)
        self._tables[table] = columns, clean.limit(0)

    def publish(self) -> None:
        """Switch all tables of the set, then make the views that are new."""
        if not self._tables:
            return
        before = {
            row.table_name: row.columns for row in current_releases(self.spark, self.root).collect()
        }
        rows = [
            {"release": self.name, "table_name": table, "columns": columns,
             "folder": f"{self.root}/tables/{table}/{columns}"}
            for table, (columns, _) in self._tables.items()
        ]
        kinds = pa.schema([(name.split()[0], pa.string()) for name in POINTER.split(", ")])
        pointer = self.spark.createDataFrame(pa.Table.from_pylist(rows, kinds))
        pointer.coalesce(1).write.mode("append").parquet(f"{self.root}/releases")
        for table, (columns, clean) in self._tables.items():
            if before.get(table) != columns or not self.spark.catalog.tableExists(
                ".".join(map(quoted, view_parts(self.spark, table)))
            ):
                self._make_view(table, columns, clean)

    def _make_view(self, table: str, columns: str, clean: DataFrame) -> None:
        def files(folder: str) -> str:
            return f"parquet.{quoted(literal(folder))}"

        def text(value: str) -> str:
            return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"

        names = ", ".join(quoted(name) for name in clean.columns)
        view = ".".join(map(quoted, view_parts(self.spark, table)))
        self.spark.sql(
            f"""
            CREATE OR REPLACE VIEW {view} AS
            SELECT {names} FROM {files(f"{self.root}/tables/{table}/{columns}")}
            WHERE {quoted(unused_name(clean, "release"))} = (
                SELECT max(release) FROM {files(f"{self.root}/releases")}
                WHERE table_name = {text(table)} AND columns = {text(columns)})
            """
        )


def _releases(spark: SparkSession, root: str) -> DataFrame:
    folder = f"{root}/releases"
    if not exists(spark, folder):
        return spark.createDataFrame([], POINTER)
    return spark.read.schema(POINTER).parquet(literal(folder))


def current_releases(spark: SparkSession, root: str) -> DataFrame:
    """``release, table_name, columns, folder`` that each table is at."""
    last = F.max_by(F.struct("*"), "release").alias("last")
    return _releases(spark, root.rstrip("/")).groupBy("table_name").agg(last).select("last.*")
