"""Clean tables in a database."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from millrace.fixed_values import POSTGRES_DRIVER
from millrace.sources import read_jdbc_table

STAGING_POSTFIX = "__staging"


def overwrite_jdbc(
    url: str, user: str, password: str, driver: str = POSTGRES_DRIVER, **options: str
) -> Callable[[DataFrame, str], None]:
    """Drop and recreate the table, with column types chosen by Spark's dialect.

    Every running task holds a connection. Pass ``numPartitions`` to cap them at
    what the database allows, and ``batchsize`` for fewer round trips.
    """
    target = {"url": url, "user": user, "password": password, "driver": driver, **options}

    def replace(clean: DataFrame, table: str) -> None:
        most = {key.lower(): value for key, value in options.items()}.get("numpartitions")
        if most:
            # Spark would merge partitions down to that number, and with them
            # the tasks that read and clean.
            clean = clean.repartition(int(most))
        clean.write.format("jdbc").options(dbtable=table, **target).mode("overwrite").save()

    return replace


def staged_jdbc(
    swap: Callable[[str, str], None],
    url: str,
    user: str,
    password: str,
    driver: str = POSTGRES_DRIVER,
    **options: str,
) -> Callable[[DataFrame, str], None]:
    """Fill ``<table>__staging``, check it, then call ``swap(staging, table)``.

    The plain overwrite drops the old table first, so a load that fails midway
    loses it. Also, a task whose executor is lost after its commit runs again
    and inserts its rows twice; here the staged count is compared with the
    rows Spark wrote, and a difference keeps the swap from happening. ``swap``
    renames in whatever way the database does that atomically.
    """
    fill = overwrite_jdbc(url, user, password, driver, **options)

    def replace(clean: DataFrame, table: str) -> None:
        staging = table + STAGING_POSTFIX
        written = Observation()
        fill(clean.observe(written, F.count(F.lit(1)).alias("n")), staging)
        staged = read_jdbc_table(
            clean.sparkSession,
            url,
            f"(SELECT count(*) AS n FROM {staging}) staged",
            user=user,
            password=password,
            driver=driver,
        ).first()[0]
        if staged != written.get["n"]:
            raise RuntimeError(f"{staging} has {staged} rows, {written.get['n']} were written")
        swap(staging, table)

    return replace
