"""What lies in a landing folder."""

from __future__ import annotations

import posixpath
import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.paths import exists, file_count, literal

_SCHEME_AND_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"
FILES_PER_TASK = 200


def list_files(spark: SparkSession, directory: str, suffix: str = ".csv") -> DataFrame:
    """Entries of a folder whose name ends in ``suffix`` (case matters), by path.

    Columns: ``path``, ``file``, ``bytes``, ``parts``, ``modified``. A folder
    of part files is one entry. Files deeper down are not entries, and names
    starting with ``_`` or ``.`` are skipped, as Spark's readers skip them.
    ``directory`` is absolute or a URI. Contents are never opened.
    """
    directory = directory.rstrip("/")
    root = re.sub(_SCHEME_AND_HOST, "", directory)
    if root == directory and root and not root.startswith("/"):
        raise ValueError(f"need an absolute path or a URI, not {directory!r}")
    # As Hadoop writes it in the paths it returns.
    root = posixpath.normpath("/" + root.strip("/")).rstrip("/")

    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    try:
        files = found.load(f"{literal(directory)}/*{literal(suffix)}")
    except AnalysisException as error:
        # Spark calls a pattern that nothing fits an absent path.
        if error.getCondition() != "PATH_NOT_FOUND" or not exists(spark, directory + "/"):
            raise
        files = spark.createDataFrame([], "path string, length long, modificationTime timestamp")
    else:
        # A task looks up each of its files. Left alone, Spark cuts partitions by
        # bytes though none are read: 100 TB would be 800,000 tasks.
        files = files.select("path", "length", "modificationTime").coalesce(
            -(-max(1, file_count(files)) // FILES_PER_TASK)
        )
    below_root = F.substr(
        F.regexp_replace("path", _SCHEME_AND_HOST, ""), F.lit(len(root) + len("/") + 1)
    )
    return (
        files.withColumn("file", F.substring_index(below_root, "/", 1))
        .filter(F.endswith("file", F.lit(suffix)) & ~F.substr("file", F.lit(1), F.lit(1)).isin("_", "."))
        .groupBy("file")
        .agg(
            F.sum("length").alias("bytes"),
            F.count("*").alias("parts"),
            F.max("modificationTime").alias("modified"),
        )
        .select(
            F.concat(F.lit(directory + "/"), "file").alias("path"),
            "file",
            "bytes",
            "parts",
            "modified",
        )
        .orderBy("path")
    )
