import datetime as dt
import json
import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrameReader
from pyspark.sql.types import LongType, StringType, StructField, StructType

from millrace.catalogue import land
from millrace.sources import (
    MULTILINE,
    guess_csv_table,
    header_groups,
    infer_csv_schema,
    land_csv,
    list_files,
    read_csv_table,
)
from millrace.sources.delimited import MISFITS


def types(df):
    return dict(df.dtypes)


def values(df):
    return [tuple(row) for row in df.collect()]


def test_types_are_inferred_from_clean_cells(spark, csv_file):
    path = csv_file(
        "a.csv",
        "id,order_purchase_timestamp,price,note",
        "1,2017-10-02 10:56:33,0.5,x",
        "2,2018-07-24 20:41:37,2,",
    )
    df = read_csv_table(spark, path)
    assert types(df) == {
        "id": "int",
        "order_purchase_timestamp": "timestamp",
        "price": "double",
        "note": "string",
    }
    assert values(df)[1] == (2, dt.datetime(2018, 7, 24, 20, 41, 37), 2.0, None)


def test_dates_and_mixed_dates(spark, csv_file):
    dates = csv_file("dates.csv", "id,d", "1,2017-10-02", "2,2018-07-24")
    mixed = csv_file("mixed.csv", "id,d", "1,2017-10-02", "2,2018-07-24 20:41:37")
    assert types(read_csv_table(spark, dates))["d"] == "date"
    assert types(read_csv_table(spark, mixed))["d"] == "timestamp"


def test_inference_drops_leading_zeros_unless_told_not_to(spark, csv_file):
    path = csv_file("z.csv", "z,n", "01151,1", "09790,2")
    assert values(read_csv_table(spark, path)) == [(1151, 1), (9790, 2)]
    assert values(read_csv_table(spark, path, text_columns=["z"])) == [("01151", 1), ("09790", 2)]
    assert values(read_csv_table(spark, path, schema="z string, n int")) == [
        ("01151", 1),
        ("09790", 2),
    ]


def test_inferred_schema_can_be_stored_and_reused(spark, csv_file):
    path = csv_file("a.csv", "id,name", "1,x", "2,y")
    stored = infer_csv_schema(spark, path).json()
    again = StructType.fromJson(json.loads(stored))
    assert values(read_csv_table(spark, path, schema=again)) == [(1, "x"), (2, "y")]


def test_types_are_those_sparks_own_reader_finds(spark, csv_file):
    csv_file(
        "t.csv/part-0.csv",
        "i,l,d,big,b,day,ts,mixed,zip,none,i,",
        "1,1,1,1,true,2020-01-01,2020-01-01 10:00:00,1,01,,1,x",
        "",
    )
    csv_file(
        "t.csv/part-1.csv",
        "i,l,d,big,b,day,ts,mixed,zip,none,i,",
        "2,3000000000,1.5e3,99999999999999999999,FALSE,2021-12-31,2020-01-01,x,02,,-2,",
        ",,,,,,,,,,,",
        '3,4,-5,1,true,2020-01-01,2020-01-01T00:00:00Z,"a, b",03,,1,short',
    )
    for path in [csv_file("one.csv", "a,b", "1,x"), csv_file("t.csv/part-2.csv").rsplit("/", 1)[0]]:
        expected = spark.read.csv(path, header=True, inferSchema=True)
        assert infer_csv_schema(spark, path) == expected.schema
        df = read_csv_table(spark, path)
        assert df.schema == expected.schema
        assert sorted(values(df), key=str) == sorted(values(expected), key=str)


def test_bigint_survives_with_a_schema_only(spark, tmp_path):
    table = spark.range(3).withColumnRenamed("id", "big")
    path = str(tmp_path / "big.csv")
    table.write.csv(path, header=True)
    assert types(read_csv_table(spark, path)) == {"big": "int"}
    assert types(read_csv_table(spark, path, schema=table.schema)) == {"big": "bigint"}


def test_header_must_match_a_declared_schema(spark, csv_file):
    path = csv_file("a.csv", "id,name", "1,x")
    swapped = StructType([StructField("name", StringType()), StructField("id", LongType())])
    with pytest.raises(Exception, match="FAILED_READ_FILE"):
        read_csv_table(spark, path, schema=swapped)
    # Without a schema, repeated names are renamed and read.
    doubled = csv_file("b.csv", "id,id", "1,2")
    assert values(read_csv_table(spark, doubled)) == [(1, 2)]


def test_header_of_every_part_file_is_checked(spark, csv_file):
    csv_file("parts.csv/a.csv", "id,name", "1,x")
    path = csv_file("parts.csv/b.csv", "name,id", "y,2").rsplit("/", 1)[0]
    with pytest.raises(Exception, match="FAILED_READ_FILE"):
        read_csv_table(spark, path, schema="id int, name string").collect()


def test_empty_cells_are_null_and_blanks_are_not(spark, csv_file):
    path = csv_file("c.csv", "id,c", "1,a", "2,", '3,""', '4,"  "')
    assert [row.c for row in read_csv_table(spark, path).collect()] == ["a", None, None, "  "]


def test_line_breaks_and_quotes_in_fields(spark, csv_file):
    path = csv_file("q.csv", "id,msg", '1,"line one', 'line two"', '2,"say ""hi"" now"')
    whole = values(read_csv_table(spark, path, options=MULTILINE))
    assert whole == [(1, "line one\nline two"), (2, 'say "hi" now')]
    assert len(values(read_csv_table(spark, path))) == 3


def test_any_text_survives_a_round_trip(spark, tmp_path):
    draw = random.Random(1)
    rows = [
        (n, "".join(draw.choice('ab",\n\r\\ ;é#\t') for _ in range(draw.randint(1, 8))))
        for n in range(1000)
    ]
    path = land(spark.createDataFrame(rows, "id int, t string"), str(tmp_path / "t.csv"))
    df = read_csv_table(spark, path, schema="id int, t string", options=MULTILINE)
    assert sorted(values(df)) == rows


def test_ragged_rows_are_kept_and_can_be_told(spark, csv_file):
    path = csv_file("r.csv", "a,b", "1,2", "3", "4,5,6", "7,x")
    schema = "a int, b int"
    assert values(read_csv_table(spark, path, schema=schema)) == [
        (1, 2),
        (3, None),
        (4, 5),
        (7, None),
    ]
    told = read_csv_table(spark, path, schema=schema, corrupt_column="raw_line")
    assert [row.raw_line for row in told.collect()] == [None, "3", "4,5,6", "7,x"]


def test_every_selection_flags_the_same_rows(spark, csv_file):
    path = csv_file("r.csv", "a,b", "1,2", "3", "4,5,6", "7,x")
    told = read_csv_table(spark, path, schema="a int, b int", corrupt_column="raw")
    for columns in [["a", "b", "raw"], ["a", "raw"], ["b", "raw"], ["raw"]]:
        assert told.select(columns).filter("raw IS NOT NULL").count() == 3
        assert [row.raw for row in told.select(columns).collect()] == [None, "3", "4,5,6", "7,x"]
    assert told.filter("raw IS NULL").count() == 1
    assert values(told.filter("a > 3").select("raw")) == [("4,5,6",), ("7,x",)]


def test_columns_without_a_type_can_be_text(spark, csv_file):
    path = csv_file("t.csv", "Id,zip,price", "1,01,0.5", "2,02,x")
    df = read_csv_table(spark, path, types={"PRICE": "double"}, infer=False)
    assert df.dtypes == [("Id", "string"), ("zip", "string"), ("price", "double")]
    assert values(df) == [("1", "01", 0.5), ("2", "02", None)]
    empty = csv_file("u.csv", "a,b")
    assert values(read_csv_table(spark, empty, infer=False)) == []
    with pytest.raises(ValueError, match="no header line"):
        read_csv_table(spark, csv_file("zero.csv"), infer=False)


def test_options_do_not_make_inference_look_up_files(spark, csv_file, monkeypatch):
    csv_file("s.csv/a.csv", "id;name", "1;x,y", "#2;z")
    path = csv_file("s.csv/b.csv", "id;name", "3;w").rsplit("/", 1)[0]
    options = {"sep": ";", "comment": "#"}
    expected = spark.read.options(**options).csv(path, header=True, inferSchema=True).schema
    with monkeypatch.context() as without:
        without.delattr(DataFrameReader, "csv")
        assert infer_csv_schema(spark, path, options) == expected
    read = read_csv_table(spark, path, options=options)
    assert sorted(values(read)) == [(1, "x,y"), (3, "w")]
    # A line end of one's own still goes by the file.
    bars = csv_file("bars.csv", "id,n|1,2|3,4", end="")
    assert values(read_csv_table(spark, bars, options={"lineSep": "|"})) == [(1, 2), (3, 4)]


@pytest.mark.parametrize("schema", [None, "a string, b string"])
def test_header_only_is_an_empty_table(spark, csv_file, schema):
    df = read_csv_table(spark, csv_file("h.csv", "a,b"), schema=schema)
    assert types(df) == {"a": "string", "b": "string"}
    assert values(df) == []


@pytest.mark.parametrize("schema", [None, "a string, b string"])
def test_a_file_without_header_is_refused(spark, csv_file, schema):
    with pytest.raises(ValueError, match="no header line"):
        read_csv_table(spark, csv_file("zero.csv"), schema=schema)


def test_several_files_are_one_table(spark, csv_file):
    paths = [csv_file("a.csv", "id,x", "1,a"), csv_file("b.csv", "id,x", "2,b")]
    assert sorted(values(read_csv_table(spark, paths))) == [(1, "a"), (2, "b")]


def test_declared_schema_reads_only_what_is_used(spark, csv_file, plan_of):
    path = csv_file("p.csv", "id,price,name", "1,0.5,a", "2,-1,b")
    df = read_csv_table(spark, path, schema="id int, price double, name string")
    plan = plan_of(df.filter("price > 0").select("name"))
    assert "ReadSchema: struct<price:double,name:string>" in plan
    assert "PushedFilters: [IsNotNull(price), GreaterThan(price,0.0)]" in plan


def test_listing(spark, csv_file, tmp_path):
    csv_file("in/a.csv", "id", "1")
    csv_file("in/B.CSV", "id", "1")
    csv_file("in/notes.txt", "x")
    csv_file("in/_hidden.csv", "id")
    csv_file("in/deeper/d.csv", "id", "1")
    csv_file("in/key=1/e.csv", "id", "1")
    csv_file("in/parts.csv/part-0.csv", "id", "1")
    csv_file("in/parts.csv/part-1", "id", "2")
    folder = str(tmp_path / "in")
    found = list_files(spark, folder + "/").collect()
    assert [(f.path, f.file, f.bytes, f.parts) for f in found] == [
        (f"{folder}/a.csv", "a.csv", 5, 1),
        (f"{folder}/parts.csv", "parts.csv", 10, 2),
    ]
    as_uri = list_files(spark, f"file:{folder}").collect()
    assert [f.path for f in as_uri] == [f"file:{folder}/a.csv", f"file:{folder}/parts.csv"]
    untidy = list_files(spark, str(tmp_path) + "//x/../in").collect()
    assert [f.file for f in untidy] == ["a.csv", "parts.csv"]
    # What is listed can be read.
    assert read_csv_table(spark, as_uri[1].path).count() == 2


def test_listing_does_not_walk_other_folders(spark, csv_file, tmp_path):
    csv_file("in/a.csv", "id", "1")
    for n in range(50):
        csv_file(f"in/deep/er/{n}.csv", "id", "1")
    csv_file("in/_parts.csv/part-0", "id", "1")
    csv_file("in/.b.csv", "id", "1")
    found = list_files(spark, str(tmp_path / "in"))
    assert [f.file for f in found.collect()] == ["a.csv"]
    assert not [path for path in found.inputFiles() if "/deep/" in path]
    csv_file("other/x.txt", "id")
    assert list_files(spark, str(tmp_path / "other")).collect() == []


def test_listing_of_nothing(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    assert list_files(spark, str(tmp_path / "empty")).collect() == []
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        list_files(spark, str(tmp_path / "absent"))
    with pytest.raises(ValueError, match="absolute"):
        list_files(spark, "relative/folder")


def test_listing_tasks_do_not_grow_with_bytes(spark, tmp_path, plan_of):
    for n in range(40):
        (tmp_path / f"f{n}.csv").write_text("x" * 100)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() >= 20
        found = list_files(spark, str(tmp_path))
        assert "Coalesce 1" in plan_of(found)
        assert len(found.collect()) == 40
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_listing_tasks_grow_with_files(spark, tmp_path, plan_of, monkeypatch):
    monkeypatch.setattr("millrace.sources.listing.FILES_PER_TASK", 10)
    for n in range(35):
        (tmp_path / f"f{n}.csv").write_text("x")
    assert "Coalesce 4" in plan_of(list_files(spark, str(tmp_path)))


# --- Guessed types ---------------------------------------------------------


def finishes(df):
    try:
        return df.collect()
    except Exception as error:
        assert any(text in str(error) for text in MISFITS)
        return None


CELLS = [
    *["1", "-5", "+7", " 5", "007", "2147483648", "9223372036854775808", "9" * 39, "1.", "100.", "1.5", ".5"],
    *[".", "1e5", "1d", "NaN", "nan", "Inf", "inf", "-", "", "0", "TRUE", "False", "t", "2017", "2017-10"],
    *["2017-10-02", "2017-1-2", " 2017-10-02", "2017-13-01", "2017-10-02 10:56:33", "2017/10/02", "abc"],
]


def test_a_guess_that_holds_is_what_inference_finds(spark, csv_file, monkeypatch):
    monkeypatch.setattr("millrace.sources.delimited.SAMPLE_LINES", 3)
    draw = random.Random(6)
    held = 0
    for k in range(40):
        few = draw.sample(CELLS, 3)
        columns = [draw.choices(few, k=6) for _ in range(3)]
        path = csv_file(f"{k}.csv", "a,b,a", *map(",".join, zip(*columns, strict=True)))
        guess = guess_csv_table(spark, path)
        rows = finishes(guess)
        expected = read_csv_table(spark, path)
        if rows is not None:
            held += 1
            assert str(rows) == str(expected.collect())
            # A column of numbers and dates may be one or the other, by their order.
            assert guess.dtypes == expected.dtypes
    assert 5 < held < 40


@pytest.mark.parametrize(
    "first, later",
    [("1", "x"), ("1", "3000000000"), ("1", "1.5"), ("2017-10-02", "2017-10-02 10:00:00"), ("true", "1"),
     ("", "1"), ("", "x"), ("1.5", "inf"), ("2017-10-02", "2017"), ("1,2", "3"), ("1", "2,3")],
)
def test_what_does_not_fit_ends_the_job(spark, csv_file, monkeypatch, first, later):
    monkeypatch.setattr("millrace.sources.delimited.SAMPLE_LINES", 2)
    path = csv_file("a.csv", "k,n", f"a,{first}", f"b,{first}", f"c,{later}")
    assert finishes(guess_csv_table(spark, path)) is None
    # Also where a rule would drop the row.
    assert finishes(guess_csv_table(spark, path).filter("k = 'a'")) is None


def test_a_guess_leaves_given_types_and_odd_options_alone(spark, csv_file):
    path = csv_file("a.csv", "z,p,d", "01,1,2017-10-02", "02,2,2017-10-03")
    guess = guess_csv_table(spark, path, text_columns=["Z"], types={"P": "double"})
    assert guess.dtypes == [("z", "string"), ("p", "double"), ("d", "date")]
    assert values(guess) == [("01", 1.0, dt.date(2017, 10, 2)), ("02", 2.0, dt.date(2017, 10, 3))]
    for options in [MULTILINE, {"mode": "DROPMALFORMED"}, {"lineSep": "|"}]:
        assert guess_csv_table(spark, path, options=options) is None
    with pytest.raises(ValueError, match="no header line"):
        guess_csv_table(spark, csv_file("zero.csv"))
    assert values(guess_csv_table(spark, csv_file("h.csv", "a,b"))) == []


# --- Bad lines, columns by name --------------------------------------------


def test_bad_lines_and_rows_are_told_apart(spark, csv_file):
    path = csv_file("b.csv", "a b,`b`", "1,2", "8", "3,4,5", "6,7")
    for schema in [None, "`a b` int, ```b``` int"]:
        landed = land_csv(spark, path, schema=schema)
        assert landed.rows.dtypes == [("a b", "int"), ("`b`", "int")]
        assert sorted(values(landed.rows)) == [(1, 2), (6, 7)]
        assert sorted(values(landed.bad_lines)) == [("3,4,5",), ("8",)]
    clash = land_csv(spark, csv_file("c.csv", "raw_line,bad", "1,2", "3"))
    assert values(clash.rows) == [(1, 2)] and values(clash.bad_lines) == [("3",)]
    with pytest.raises(ValueError, match="no header line"):
        land_csv(spark, csv_file("zero.csv"), schema="a int")


def test_part_files_by_name(spark, csv_file):
    csv_file("p 1.csv/a.csv", "id,name", "1,x", "2,")
    csv_file("p 1.csv/b.csv", "", "name,id", "y,2.5")
    path = csv_file("p 1.csv/c[1].csv", '"id",name', "3,z").rsplit("/", 1)[0]
    groups = header_groups(spark, path)
    assert {names: len(files) for names, files in groups.items()} == {("id", "name"): 2, ("name", "id"): 1}
    df = read_csv_table(spark, path, by_name=True)
    assert df.dtypes == [("id", "double"), ("name", "string")]
    assert sorted(values(df), key=str) == [(1.0, "x"), (2.0, None), (2.5, "y"), (3.0, "z")]
    declared = read_csv_table(spark, path, schema="name string, id double", by_name=True)
    assert sorted(values(declared), key=str) == sorted([(b, a) for a, b in values(df)], key=str)
    told = read_csv_table(spark, path, types={"id": "int"}, corrupt_column="raw", by_name=True)
    assert [r.raw for r in told.collect() if r.raw] == ["y,2.5"]


def test_part_files_without_all_columns_are_refused(spark, csv_file):
    csv_file("m.csv/a.csv", "id,name", "1,x")
    path = csv_file("m.csv/b.csv", "id,nom", "1,x").rsplit("/", 1)[0]
    with pytest.raises(ValueError, match=r"b\.csv has columns"):
        read_csv_table(spark, path, by_name=True)
    for header in ["id,id", "id,"]:
        with pytest.raises(ValueError, match="repeats"):
            read_csv_table(spark, csv_file("r.csv", header, "1,2"), by_name=True)
    with pytest.raises(ValueError, match="no header line"):
        read_csv_table(spark, csv_file("zero.csv"), by_name=True)


def test_compressed_part_files_by_name(spark, tmp_path):
    path = str(tmp_path / "z.csv")
    for names in (["a", "b"], ["b", "a"]):
        spark.range(3).selectExpr("id AS a", "id * 2 AS b").select(names).write.mode("append").csv(
            path, header=True, compression="gzip"
        )
    read = read_csv_table(spark, path, by_name=True).select("a", "b")
    assert sorted(values(read)) == [(0, 0), (0, 0), (1, 2), (1, 2), (2, 4), (2, 4)]
