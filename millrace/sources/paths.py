"""Paths as Spark's readers take them."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession


def literal(path: str) -> str:
    """A path that means one entry: characters of a pattern stand for themselves."""
    return re.sub(r"([\\[\]{}*?])", r"\\\1", path)


def literals(path: str | list[str]) -> str | list[str]:
    return literal(path) if isinstance(path, str) else [literal(one) for one in path]


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder of this name; needs the driver's JVM."""
    entry = spark._jvm.org.apache.hadoop.fs.Path(path)
    return entry.getFileSystem(spark._jsc.hadoopConfiguration()).exists(entry)


def file_count(files: DataFrame) -> int:
    """The files that a scan reads; counted without fetching their names, where
    there is a JVM to ask."""
    try:
        return len(files._jdf.inputFiles())
    except AttributeError:
        return len(files.inputFiles())


def part_files(spark: SparkSession, path: str | list[str]) -> list[str]:
    """The files a scan of ``path`` reads, as paths that readers take, in order."""
    return sorted(unquote(name) for name in spark.read.text(literals(path)).inputFiles())


def first_line(spark: SparkSession, path: str, encoding: str = "UTF-8", comment: str = "") -> str | None:
    """The first line of a file that is not blank and no comment; needs the
    driver's JVM. Of the file only the first block is read."""
    hadoop = spark._jvm.org.apache.hadoop
    conf = spark._jsc.hadoopConfiguration()
    entry = hadoop.fs.Path(path)
    codec = hadoop.io.compress.CompressionCodecFactory(conf).getCodec(entry)
    stream = entry.getFileSystem(conf).open(entry)
    java = spark._jvm.java.io
    reader = java.BufferedReader(
        java.InputStreamReader(codec.createInputStream(stream) if codec else stream, encoding)
    )
    try:
        while (line := reader.readLine()) is not None:
            if line.strip(" ") and not (comment and line.startswith(comment)):
                return line
        return None
    finally:
        reader.close()


def remove(spark: SparkSession, path: str) -> None:
    """Delete scratch of one's own; without a JVM to ask it stays."""
    try:
        entry = spark._jvm.org.apache.hadoop.fs.Path(path)
    except AttributeError:
        return
    entry.getFileSystem(spark._jsc.hadoopConfiguration()).delete(entry, True)
