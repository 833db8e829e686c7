"""Session settings, and the shared folder jobs may write to."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import SparkSession

DEFAULTS = {
    # Timestamps without a zone must mean the same on every executor.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    # "Name" is a name and 'text' is text, so a dashboard's SQL runs as it is.
    "spark.sql.ansi.doubleQuotedIdentifiers": "true",
}


def object_store_conf(endpoint: str, access_key: str, secret_key: str) -> dict[str, str]:
    """Session settings for an S3-compatible store addressed by path."""
    s3a = "spark.hadoop.fs.s3a."
    return {
        s3a + "endpoint": endpoint,
        s3a + "access.key": access_key,
        s3a + "secret.key": secret_key,
        s3a + "path.style.access": "true",
        s3a + "impl": "org.apache.hadoop.fs.s3a.S3AFileSystem",
    }


def sized_for(input_bytes: int) -> dict[str, str]:
    """Session settings for loads of about this size.

    Scan tasks read 128 MB, and more only where that would make over 100,000 of
    them. Shuffles start with a partition per 256 MB, within bounds; Spark
    merges what turns out small. Sorts and aggregates spill, so the bounds cost
    disk rather than memory.
    """
    mb = 1 << 20
    split = min(max(128 * mb, input_bytes // 100_000), 1024 * mb)
    partitions = min(max(200, -(-input_bytes // (256 * mb))), 32_768)
    return {
        "spark.sql.files.maxPartitionBytes": str(split),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * mb),
        # Or Spark would cut small tables into as many files as there are cores.
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }


def build_session(
    app_name: str, conf: Mapping[str, str] | None = None, master: str | None = None
) -> SparkSession:
    """A session with our defaults; ``conf`` wins over them."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir``.

    Only a local session, whose executors share the driver's disk, may do
    without the setting; it gets one for temporary files. A ``file:``
    folder on a cluster has to be a mounted one, which only the caller can know.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    return f"{tempfile.gettempdir()}/millrace"


def scratch_dir(spark: SparkSession) -> str:
    """What this application has written under :func:`shared_dir`."""
    return f"{shared_dir(spark)}/millrace-{spark.conf.get('spark.app.id', 'app')}"


def new_folder(spark: SparkSession, name: str) -> str:
    """An unused path for scratch; nothing is created."""
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove_scratch(spark: SparkSession) -> bool:
    """Delete all scratch of this application; say whether there was any.

    Results that are not yet written or collected are lost with it.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return store.delete(path, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    Needed where Python workers cannot import it: where it is neither installed
    on the executors nor in the folder that the driver runs in. The archive goes
    by the shared folder.
    """
    name = f"{__package__}.zip"
    if name in spark.sparkContext._python_includes:
        return
    package = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for module in sorted(package.rglob("*.py")):
            archive.write(module, module.relative_to(package.parent))
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{new_folder(spark, 'package')}/{name}")
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    try:
        stream.write(packed.getvalue())
    finally:
        stream.close()
    spark.sparkContext.addPyFile(path.toString())
