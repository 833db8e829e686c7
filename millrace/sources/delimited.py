"""CSV files with a header line."""

from __future__ import annotations

from collections.abc import Collection, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, StringType, StructField, StructType

from millrace.operators.rules import quoted
from millrace.session import new_folder
from millrace.sources.paths import first_line, literals, part_files

# Reader options for fields with line breaks and doubled quotes. Such a file
# cannot be split: one task reads it, so land it as many files of bounded size
# and declare its schema, as inferring looks up each of them by name.
MULTILINE = {"multiLine": "true", "escape": '"'}


# With these a line of the file is not a line of plain text.
_NEEDS_FILES = {"multiline", "linesep", "encoding", "charset"}
# These say how lines are written, not what cells stand for.
_SHAPE_LINES = _NEEDS_FILES | {"sep", "delimiter", "quote", "escape", "comment", "mode"}
_LEAST_LONG = -(2**63)


def _parsed(
    spark: SparkSession, path: str | list[str], options: Mapping[str, str] | None, **more: str
) -> DataFrame:
    """What Spark makes of the files when it is told no schema.

    Given a path, Spark lists the folder and then looks up each file by name
    again, 4 ms each: an hour for 800,000 part files. Given the lines it makes
    the same of them. Python's reader does not take a DataFrame of lines, the
    JVM's does; a client without a JVM, and options that change what a line is,
    get the slow way.
    """
    reader = spark.read.options(**(options or {})).options(**more)
    path = literals(path)
    if not _NEEDS_FILES & {name.lower() for name in options or {}}:
        # Options such as a limit on the time of change choose files here too.
        lines = spark.read.options(**(options or {})).text(path).select("value")
        try:
            return DataFrame(reader._jreader.csv(_as_lines(spark, lines)), spark)
        except AttributeError:
            pass
    return reader.csv(path)


def infer_csv_schema(
    spark: SparkSession,
    path: str | list[str],
    options: Mapping[str, str] | None = None,
    all_text: bool = False,
) -> StructType:
    """The types the whole input fits; one full pass over it.

    There is no sampling: a type that only the sample fits would turn the other
    values into NULL. Store the result (``schema.json()``) to spare later loads
    the pass. With ``all_text`` every column is text, and only the header read.
    """
    infer = "false" if all_text else "true"
    schema = _parsed(spark, path, options, header="true", inferSchema=infer).schema
    if not schema.fields:
        raise ValueError(f"no header line in {path}")
    return schema


def _named_as_in_header(
    spark: SparkSession, path: str | list[str], names: list[str], options: Mapping[str, str] | None
) -> bool:
    """Whether the header has these names; repeated and empty ones are renamed."""
    first = _parsed(spark, path, options, header="false", inferSchema="false").first()
    return first is not None and list(first) == names


def _names_in(
    spark: SparkSession, line: str, options: Mapping[str, str] | None
) -> tuple[list[str], bool]:
    """Column names that Spark takes from a header line, and whether they stand there."""
    one = _as_lines(spark, spark.createDataFrame(pa.table({"value": [line]})))

    def parsed(header: str) -> DataFrame:
        reader = spark.read.options(**(options or {})).options(header=header, inferSchema="false")
        return DataFrame(reader._jreader.csv(one), spark)

    names, written = parsed("true").columns, parsed("false").first()
    return names, written is not None and list(written) == names


def _as_lines(spark: SparkSession, lines: DataFrame):
    """For the JVM's reader; Python's takes no DataFrame of lines."""
    return getattr(lines._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())


def _fields(schema: StructType, given: Mapping[str, str]) -> list[StructField]:
    """The columns, with the types that are given by name in any case."""
    return [
        StructField(f.name, DataType.fromDDL(given[f.name.lower()])) if f.name.lower() in given else f
        for f in schema.fields
    ]


def _given(text_columns: Collection[str], types: Mapping[str, str] | None) -> dict[str, str]:
    given = {name.lower(): "string" for name in text_columns}
    return given | {name.lower(): kind for name, kind in (types or {}).items()}


# Lines from which types are guessed.
SAMPLE_LINES = 1000

# What Spark says of a row that does not fit its types, and what a guess says.
MISFITS = ("MALFORMED_RECORD_IN_PARSING", "does not fit its guessed type")


def guess_csv_table(
    spark: SparkSession,
    path: str | list[str],
    text_columns: Collection[str] = (),
    types: Mapping[str, str] | None = None,
    options: Mapping[str, str] | None = None,
) -> DataFrame | None:
    """The files with types that their first lines fit, for a job that can be repeated.

    One scan then shows whether the guess holds: a line or cell of any row that
    does not fit ends the job with one of ``MISFITS``, and the types have to be
    inferred from all rows. If the job ends well its types are those that
    inference finds: the least for the first lines, and all others fit them. None
    where options say otherwise what a line is or what becomes of bad ones.
    """
    if {name.lower() for name in options or {}} & (_NEEDS_FILES | {"mode", "columnnameofcorruptrecord"}):
        return None

    def reader(**more: str):
        return spark.read.options(**(options or {})).options(**more)

    # Taken from the first task's lines if it has as many.
    first = reader().text(literals(path)).select("value").take(SAMPLE_LINES)
    first = pa.table({"value": pa.array([row.value for row in first], pa.string())})
    try:
        lines = _as_lines(spark, spark.createDataFrame(first).coalesce(1))
    except AttributeError:
        return None
    schema = DataFrame(reader(header="true", inferSchema="true")._jreader.csv(lines), spark).schema
    if not schema.fields:
        raise ValueError(f"no header line in {path}")
    rows = DataFrame(reader(header="false", inferSchema="false")._jreader.csv(lines), spark).collect()
    checked = list(rows[0]) == schema.names
    filled = [any(row[i] for row in rows[1:]) for i in range(len(schema))]

    given = _given(text_columns, types)
    fields, columns = [], []
    for field, seen in zip(_fields(schema, given), filled, strict=True):
        cell = F.col(quoted(field.name))
        known = field.name.lower() in given
        if not known and isinstance(field.dataType, DateType):
            # The reader would take a timestamp for a date.
            day = cell.try_cast("date")
            cell = _or_misfit(cell, day.cast("string") == cell, day, field.name)
            field = StructField(field.name, StringType())
        elif not known and not seen:
            # Any type would do so far.
            cell = _or_misfit(cell, cell == "", cell, field.name)
        fields.append(field)
        columns.append(cell.alias(field.name))
    read = _scan(spark, path, fields, None, {**(options or {}), "mode": "FAILFAST"}, checked)
    # What is counted here is not needed, but no filter goes past it: rows that a
    # rule drops have to fit as well.
    return read.select(columns).observe(Observation(), F.count(F.lit(1)).alias("rows"))


def _or_misfit(cell: Column, fits: Column, value: Column, name: str) -> Column:
    misfit = F.raise_error(F.lit(f"a cell of {name} {MISFITS[1]}"))
    return F.when(cell.isNull(), F.lit(None)).when(fits, value).otherwise(misfit)


# Files whose first line is read side by side.
HEADERS_AT_ONCE = 32


def header_groups(
    spark: SparkSession, path: str | list[str], options: Mapping[str, str] | None = None
) -> dict[tuple[str, ...], list[str]]:
    """Part files by the column names of their header, in the order of the files.

    The driver opens each file and reads its first line, as a scan would have to
    read all lines for that. Names that repeat or are empty cannot be told apart
    and are refused, as are files without a header.
    """
    given = {name.lower(): value for name, value in (options or {}).items()}
    if "linesep" in given:
        raise ValueError("columns by name need lines that end as usual")
    encoding = given.get("encoding", given.get("charset", "UTF-8"))
    files = part_files(spark, path)
    if not files:
        raise ValueError(f"no header line in {path}")
    with ThreadPoolExecutor(min(len(files), HEADERS_AT_ONCE)) as pool:
        lines = list(
            pool.map(lambda file: first_line(spark, file, encoding, given.get("comment", "")), files)
        )
    by_line: dict[str, list[str]] = {}
    for file, line in zip(files, lines, strict=True):
        if line is None:
            raise ValueError(f"no header line in {file}")
        by_line.setdefault(line, []).append(file)
    groups: dict[tuple[str, ...], list[str]] = {}
    for line, of_line in by_line.items():
        names, as_written = _names_in(spark, line, options)
        if not as_written:
            raise ValueError(f"{of_line[0]} repeats column names or leaves them empty")
        groups.setdefault(tuple(names), []).extend(of_line)
    return groups


def _infer_by_name(
    spark: SparkSession,
    groups: Mapping[tuple[str, ...], list[str]],
    options: Mapping[str, str] | None,
    all_text: bool,
) -> StructType:
    """The types that the rows of all groups fit; their lines are written alike for it."""
    names = list(next(iter(groups)))
    texts = [StructField(name, StringType()) for name in names]
    if all_text:
        return StructType(texts)
    cells = _by_name(spark, groups, texts, None, options)
    lines = cells.select(F.to_csv(F.struct(*map(quoted, names))).alias("value"))
    kept = {k: v for k, v in (options or {}).items() if k.lower() not in _SHAPE_LINES}
    reader = spark.read.options(**kept).options(header="false", inferSchema="true")
    found = DataFrame(reader._jreader.csv(_as_lines(spark, lines)), spark).schema
    return StructType([StructField(name, f.dataType) for name, f in zip(names, found, strict=True)])


@dataclass(frozen=True)
class Landed:
    """Lines of CSV files that one scan has dealt into two tables.

    ``rows`` parse; ``bad_lines`` (``raw_line``) do not. Both read from
    ``folder``, which is scratch.
    """

    rows: DataFrame
    bad_lines: DataFrame
    folder: str


def land_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: StructType | str | None = None,
    text_columns: Collection[str] = (),
    types: Mapping[str, str] | None = None,
    options: Mapping[str, str] | None = None,
    infer: bool = True,
    by_name: bool = False,
) -> Landed:
    """Scan the files once and write rows and bad lines to folders of their own.

    A line is bad if it is too short, too long or has unreadable cells. Without
    ``schema`` the types are inferred before, from bad lines too.
    """
    raw = "raw_line"
    fields, checked, groups = _columns(spark, path, schema, text_columns, types, options, infer, by_name)
    while raw.lower() in {f.name.lower() for f in fields}:
        raw += "_"
    read = _by_name(spark, groups, fields, raw, options) if groups else _scan(spark, path, fields, raw, options, checked)
    # Names of one's own: a file may have any.
    line = F.col(quoted(raw))
    cells = [F.col(quoted(f.name)).alias(f"c{i}") for i, f in enumerate(fields)]
    dealt = read.select(*cells, line.alias("raw_line"), line.isNotNull().alias("bad"))
    folder = new_folder(spark, "landed")
    dealt.write.partitionBy("bad").parquet(folder)
    stored = spark.read.schema(dealt.schema).parquet(folder)
    if not groups and not stored.take(1):
        _need_header(spark, path)
    rows = stored.filter("NOT bad").select([F.col(f"c{i}").alias(f.name) for i, f in enumerate(fields)])
    return Landed(rows, stored.filter("bad").select("raw_line"), folder)


def _columns(
    spark: SparkSession,
    path: str | list[str],
    schema: StructType | str | None,
    text_columns: Collection[str],
    types: Mapping[str, str] | None,
    options: Mapping[str, str] | None,
    infer: bool,
    by_name: bool,
) -> tuple[list[StructField], bool, dict[tuple[str, ...], list[str]] | None]:
    """Columns, whether headers are to be checked against them, and files by header."""
    groups = header_groups(spark, path, options) if by_name else None
    if schema is not None:
        declared = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        return _fields(declared, _given(text_columns, types)), True, groups
    if groups:
        found, checked = _infer_by_name(spark, groups, options, all_text=not infer), True
    else:
        found = infer_csv_schema(spark, path, options, all_text=not infer)
        checked = _named_as_in_header(spark, path, found.names, options)
    return _fields(found, _given(text_columns, types)), checked, groups


def _by_name(
    spark: SparkSession,
    groups: Mapping[tuple[str, ...], list[str]],
    fields: list[StructField],
    corrupt_column: str | None,
    options: Mapping[str, str] | None,
) -> DataFrame:
    """The files of each header read by it, with the columns in the order of ``fields``."""
    wanted = {f.name: f for f in fields}
    extra = [corrupt_column] if corrupt_column else []
    parts = []
    for names, files in groups.items():
        if set(names) != set(wanted):
            raise ValueError(f"{files[0]} has columns {sorted(names)} instead of {sorted(wanted)}")
        part = _scan(spark, files, [wanted[name] for name in names], corrupt_column, options, True)
        parts.append(part.select([quoted(name) for name in [*wanted, *extra]]))
    return reduce(DataFrame.union, parts)


def _scan(
    spark: SparkSession,
    path: str | list[str],
    fields: list[StructField],
    corrupt_column: str | None,
    options: Mapping[str, str] | None,
    checked: bool,
) -> DataFrame:
    reader = spark.read.options(**(options or {}))
    if corrupt_column:
        fields = [*fields, StructField(corrupt_column, StringType())]
        reader = reader.option("columnNameOfCorruptRecord", corrupt_column)
    return reader.schema(StructType(fields)).csv(literals(path), header=True, enforceSchema=not checked)


def _need_header(spark: SparkSession, path: str | list[str]) -> None:
    if not spark.read.text(literals(path)).filter("trim(value) != ''").take(1):
        raise ValueError(f"no header line in {path}")


def read_csv_table(
    spark: SparkSession,
    path: str | list[str],
    schema: StructType | str | None = None,
    text_columns: Collection[str] = (),
    types: Mapping[str, str] | None = None,
    corrupt_column: str | None = None,
    options: Mapping[str, str] | None = None,
    infer: bool = True,
    by_name: bool = False,
) -> DataFrame:
    """Read a file, a folder of part files, or a list of either.

    Without ``schema`` the types are inferred, which reads the input twice;
    ``text_columns`` keep their text whatever it looks like, and ``types`` gives
    single columns a type (names are compared as Spark does, in any case). With
    ``infer=False`` columns without a type are text; then, and with ``schema``
    (a ``StructType`` or DDL text), the input is read once. Either way
    a part file whose header differs is an error, unless names are repeated or
    empty and no schema is given. With ``by_name`` part files may have their
    columns in any order, as long as each has them all (:func:`header_groups`).

    ``corrupt_column`` adds the raw line of every row that is too short, too
    long or has unreadable cells, and NULL for the rest, whichever columns are
    selected later. For that every column is parsed whenever it is used.
    """
    fields, checked, groups = _columns(spark, path, schema, text_columns, types, options, infer, by_name)
    if groups:
        df = _by_name(spark, groups, fields, corrupt_column, options)
    else:
        df = _scan(spark, path, fields, corrupt_column, options, checked)
    # The first row shows a wrong header before a load replaces anything. Only
    # if there is none does the header have to be looked for.
    if schema is not None and not groups and not df.take(1):
        _need_header(spark, path)
    if corrupt_column and fields:
        # A scan flags what it notices in the columns it reads. The comparison
        # always holds, but Spark cannot know that, so it reads them all.
        cells = F.xxhash64(*[quoted(f.name) for f in fields])
        flag = F.when(cells >= F.lit(_LEAST_LONG), F.col(quoted(corrupt_column)))
        df = df.withColumn(corrupt_column, flag)
    return df
