"""Loads that go on where the last one ended.

A ledger is a folder with a row for each file that has been loaded: its path, size
and time of change, and what became of it. A row is written once the file's table
is, so a file whose row is missing may have been loaded and is loaded again,
which a full refresh allows.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from threading import Lock

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from millrace.plans.datasets import DATASETS, Dataset, route_files
from millrace.plans.ingest import MANIFEST, Sink, load_files
from millrace.sources import list_files
from millrace.sources.paths import exists, literal

LEDGER = f"path string, bytes bigint, modified timestamp, {MANIFEST}, loaded_at timestamp"


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """The last load of each path."""
    if not exists(spark, ledger):
        return spark.createDataFrame([], LEDGER)
    # A folder per run, as two writers of one folder would be in each other's way.
    rows = spark.read.schema(LEDGER).option("recursiveFileLookup", "true").parquet(literal(ledger))
    last = F.max_by(F.struct("*"), "loaded_at").alias("last")
    return rows.groupBy("path").agg(last).select("last.*")


def pending(files: DataFrame, done: DataFrame) -> DataFrame:
    """Entries of :func:`list_files` that are not in a ledger as they are now."""
    return files.join(done, ["path", "bytes", "modified"], "left_anti")


def load_folder(
    spark: SparkSession,
    directory: str,
    sink: Sink,
    ledger: str,
    datasets: Sequence[Dataset] = DATASETS,
    at_once: int = 1,
    suffix: str = ".csv",
) -> DataFrame:
    """Load what is new or changed in a folder; the manifest of these files.

    After a failure the same call loads the rest. Files that fill the same table
    are loaded again together, in order, so that the last of them stays the
    one that counts. Files that have gone keep their table and their row. The
    folder is listed once: a file that changes during the load is loaded again by
    the next call.
    """
    listed = list_files(spark, directory, suffix).select(
        "path", "bytes", F.unix_micros("modified").alias("micros")
    )
    # As numbers, since times that pass through Python depend on its time zone.
    entries = pa.Table.from_pylist(
        [row.asDict() for row in listed.collect()],
        pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("micros", pa.int64())]),
    )
    files = spark.createDataFrame(entries).select(
        "path", "bytes", F.timestamp_micros("micros").alias("modified")
    )
    new = {row.path for row in pending(files, read_ledger(spark, ledger)).collect()}
    routes = sorted(route_files(files, datasets).collect(), key=lambda route: route.path)
    tables = {route.table_name for route in routes if route.path in new}
    paths = [route.path for route in routes if route.table_name in tables]

    run, one_at_a_time = f"{ledger}/{uuid.uuid4().hex}", Lock()

    def record(done: Row) -> None:
        row = files.filter(F.col("path") == done.path).select(
            "path",
            "bytes",
            "modified",
            *[F.lit(done[name]).alias(name) for name in ("file", "rule", "table_name")],
            F.lit(done.rows).cast("bigint").alias("rows"),
            F.current_timestamp().alias("loaded_at"),
        )
        with one_at_a_time:
            row.coalesce(1).write.mode("append").parquet(run)

    return load_files(spark, paths, sink, datasets, at_once, loaded=record)
