"""Load files into clean tables."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from functools import reduce

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from millrace.observed import observed
from millrace.plans.datasets import DATASETS, IDENTITY, Dataset, route_files
from millrace.sinks.release import Release
from millrace.sources import guess_csv_table, land_csv, read_csv_table
from millrace.sources.delimited import MISFITS
from millrace.sources.paths import remove

Sink = Callable[[DataFrame, str], None]

# What load_files returns; the last column only if bad lines are kept.
MANIFEST = "file string, rule string, table_name string, rows bigint"
BAD_ROWS = ", bad_rows bigint"

# Seconds in which the count of rows has to follow the write.
COUNT_WAIT = 60.0

log = logging.getLogger(__name__)


class LoadError(RuntimeError):
    """Loads that failed: ``failures`` has the error of each path, in order.

    ``path`` is the first of them, and ``loaded`` are the manifest rows of the
    files that were finished.
    """

    def __init__(self, failures: Mapping[str, BaseException], loaded: Sequence[Row]):
        paths = ", ".join(failures)
        super().__init__(f"could not load {paths}; {len(loaded)} files were loaded")
        self.failures = dict(failures)
        self.path = next(iter(failures))
        self.loaded = list(loaded)


def object_paths(names: str | Iterable[str], bucket: str) -> list[str]:
    """Full paths of objects in a bucket; ``names`` may be a JSON array."""
    if isinstance(names, str):
        names = json.loads(names)
    return [f"s3a://{bucket}/{name}" for name in names]


def _routes(spark: SparkSession, paths: Sequence[str], datasets: Sequence[Dataset]) -> list[Row]:
    # From Arrow the paths become part of the plan, and no job is run for them.
    files = spark.createDataFrame(pa.table({"path": pa.array(paths, pa.string())}))
    return route_files(files, datasets).collect()


def _written(clean: DataFrame, sink: Sink, table: str, path: str, wait: float | None) -> int:
    """The rows that the sink wrote, counted in the stage that writes, where a
    repeated task counts once."""
    written = Observation()
    sink(clean.observe(written, F.count(F.lit(1)).alias("rows")), table)
    wait = COUNT_WAIT if wait is None else wait
    found = observed(written, wait)
    if not found:
        raise RuntimeError(
            f"no count of {table} came within {wait:g} s: the sink for {path} returned without having "
            "written its rows, or has replaced the table and Spark lost the count"
        )
    return found["rows"]


def _load(
    spark: SparkSession,
    route: Row,
    sink: Sink,
    datasets: Sequence[Dataset],
    bad_lines: str | None = None,
    count_wait: float | None = None,
    loaded: Callable[[Row], None] | None = None,
) -> Row:
    dataset = next((known for known in datasets if known.name == route.rule), IDENTITY)
    if dataset is IDENTITY:
        log.warning("no rule for %s, loading it as it is", route.file)
    how = dict(
        text_columns=dataset.text_columns if dataset.schema is None else (),
        types=dataset.types if dataset.schema is None else None,
        options=dataset.csv_options,
    )
    fixed = dict(schema=dataset.schema, infer=dataset.infer, by_name=dataset.by_name)

    def write(raw: DataFrame) -> int:
        clean = reduce(lambda df, rule: df.transform(rule), dataset.rules, raw)
        return _written(clean, sink, route.table_name, route.path, count_wait)

    counts = {}
    if bad_lines is not None:
        landed = land_csv(spark, route.path, **how, **fixed)
        try:
            # First, as these never stand for the table itself.
            lines = landed.bad_lines.select(F.lit(route.file).alias("file"), "raw_line")
            counts["bad_rows"] = _written(
                lines, sink, route.table_name + bad_lines, route.path, count_wait
            )
            rows = write(landed.rows)
        finally:
            remove(spark, landed.folder)
    else:
        guess = None
        if dataset.schema is None and dataset.infer and not dataset.by_name:
            guess = guess_csv_table(spark, route.path, **how)
        try:
            rows = write(guess if guess else read_csv_table(spark, route.path, **how, **fixed))
        except Exception as error:
            if not guess or not any(text in str(error) for text in MISFITS):
                raise
            log.info("the types of %s are not those of its first lines", route.file)
            rows = write(read_csv_table(spark, route.path, **how, **fixed))
    log.info("%s -> %s: %d rows", route.file, route.table_name, rows)
    done = Row(file=route.file, rule=route.rule, table_name=route.table_name, rows=rows, **counts)
    if loaded:
        loaded(Row(path=route.path, **done.asDict()))
    return done


def load_file(
    spark: SparkSession,
    path: str,
    sink: Sink,
    datasets: Sequence[Dataset] = DATASETS,
    bad_lines: str | None = None,
    count_wait: float | None = None,
) -> Row:
    """Read, clean and write one file, or one folder of part files.

    With ``bad_lines`` (a postfix such as ``"_bad"``) lines that are too short,
    too long or have unreadable cells go through the same sink to a table of
    that name, as ``file, raw_line``, and the rules never see them. Both come from
    one scan. The rows written have to be known ``count_wait`` seconds after a
    write (60 by default): an error that says so comes when the table has
    already been replaced.
    """
    return _load(spark, _routes(spark, [path], datasets)[0], sink, datasets, bad_lines, count_wait)


def load_files(
    spark: SparkSession,
    paths: Sequence[str],
    sink: Sink,
    datasets: Sequence[Dataset] = DATASETS,
    at_once: int = 1,
    bad_lines: str | None = None,
    count_wait: float | None = None,
    loaded: Callable[[Row], None] | None = None,
) -> DataFrame:
    """Load files and return the manifest: file, rule, table and rows written,
    and with ``bad_lines`` (see :func:`load_file`) also the bad rows.

    Files are taken in order, ``at_once`` side by side, and the next is begun as
    soon as one is done, so that neither small nor large ones leave a cluster
    idle. After a failure no file is begun; those under way are finished, and
    :class:`LoadError` tells of all. Tables already written stay. ``loaded`` is
    called with the path and the manifest row of each file once it is written,
    on the thread that has loaded it; an error in it is a failure of that file.
    """
    routes = _routes(spark, paths, datasets)
    tables = [route.table_name for route in routes]
    if at_once > 1 and len(set(tables)) < len(tables):
        raise ValueError("two files fill the same table: load them one at a time")

    load = inheritable_thread_target(spark)(_load)
    jobs: list[Future] = []
    with ThreadPoolExecutor(max_workers=at_once) as pool:
        running: set[Future] = set()
        for route in routes:
            if len(running) == at_once:
                done, running = wait(running, return_when=FIRST_COMPLETED)
                if any(job.exception() for job in done):
                    break
            jobs.append(pool.submit(load, spark, route, sink, datasets, bad_lines, count_wait, loaded))
            running.add(jobs[-1])
    # Leaving the pool has waited for those still under way.
    finished = [job.result() for job in jobs if not job.exception()]
    failures = {
        route.path: job.exception()
        for route, job in zip(routes, jobs, strict=False)
        if job.exception()
    }
    if failures:
        raise LoadError(failures, finished) from next(iter(failures.values()))
    columns = MANIFEST + (BAD_ROWS if bad_lines is not None else "")
    return spark.createDataFrame(finished, columns)


def load_release(
    spark: SparkSession,
    paths: Sequence[str],
    root: str,
    datasets: Sequence[Dataset] = DATASETS,
    at_once: int = 1,
    bad_lines: str | None = None,
) -> DataFrame:
    """Load files as one set: their views change together once all are loaded.

    After a failure every view is as before (:class:`millrace.sinks.Release`).
    """
    release = Release(spark, root)
    manifest = load_files(spark, paths, release.sink, datasets, at_once, bad_lines)
    release.publish()
    return manifest
