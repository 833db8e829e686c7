import dataclasses
import datetime as dt
import os
import threading

import pytest
from pyspark import TaskContext

from millrace.fixed_values import (
    CUSTOMERS,
    ITEMS,
    NAME_PREFIX,
    NAME_SUFFIX,
    ORDERS,
    PAYMENTS,
    PRODUCTS,
)
from millrace.plans import (
    DATASETS,
    Dataset,
    LoadError,
    load_file,
    load_files,
    load_folder,
    load_release,
    read_ledger,
)
from millrace.session import scratch_dir
from millrace.sinks import Release, current_releases, overwrite_parquet, publish_view
from millrace.sources import land_csv


def values(df):
    return sorted((tuple(row) for row in df.collect()), key=str)


@pytest.fixture
def clean(spark, tmp_path):
    """Where tables go, and how to read one back."""
    root = str(tmp_path / "clean")
    sink = overwrite_parquet(root)
    sink.read = lambda table: spark.read.parquet(f"{root}/{table}")
    return sink


def test_orders(spark, csv_file, clean):
    path = csv_file(
        f"{ORDERS}.csv",
        "order_id,order_purchase_timestamp",
        "a,2017-10-02 10:56:33",
        "b,soon",
    )
    before = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    done = load_file(spark, path, clean)
    assert tuple(done) == (f"{ORDERS}.csv", "orders", "orders_data", 2)
    table = clean.read("orders_data")
    assert values(table.drop("processed_at")) == [
        ("a", dt.datetime(2017, 10, 2, 10, 56, 33)),
        ("b", None),
    ]
    (stamp,) = table.select("processed_at").distinct().collect()
    assert stamp[0] >= before - dt.timedelta(seconds=1)


def test_items_customers_products_payments_and_others(spark, csv_file, clean):
    paths = [
        csv_file(f"{ITEMS}.csv", "order_id,price", "a,10.5", "b,0", "c,-1", "d,"),
        csv_file(f"{CUSTOMERS}.csv", "customer_id,city", "x,A", "x,A", "y,B", ",C", ",C"),
        csv_file(f"{PRODUCTS}.csv", "product_id,product_category_name", "p,010", "q,"),
        csv_file(f"{PAYMENTS}.csv", "order_id,payment_type", "a,card", "a,card"),
        csv_file("sellers.csv", "seller_id,zip", "s,01151"),
    ]
    manifest = load_files(spark, paths, clean)
    assert manifest.columns == ["file", "rule", "table_name", "rows"]
    assert [(row.rule, row.table_name, row.rows) for row in manifest.collect()] == [
        ("items", "order_items_data", 1),
        ("customers", "customers_data", 3),
        ("products", "products_data", 2),
        ("payments", "order_payments_data", 2),
        ("identity", "sellers.csv_data", 1),
    ]
    assert values(clean.read("order_items_data")) == [("a", 10.5)]
    assert values(clean.read("customers_data")) == [("x", "A"), ("y", "B"), (None, "C")]
    assert values(clean.read("products_data")) == [("p", "010"), ("q", "unknown")]
    assert values(clean.read("order_payments_data")) == [("a", "card"), ("a", "card")]
    assert values(clean.read("sellers.csv_data")) == [("s", 1151)]


def test_an_unknown_file_is_loaded_with_a_warning(spark, csv_file, clean, caplog):
    load_file(spark, csv_file("lookup.csv", "a", "1"), clean)
    assert "no rule for lookup.csv" in caplog.text


def test_a_second_load_replaces_rows_and_columns(spark, csv_file, clean):
    load_file(spark, csv_file("one/t.csv", "a", "1", "2"), clean)
    load_file(spark, csv_file("two/t.csv", "b,c", "x,3"), clean)
    assert clean.read("t.csv_data").columns == ["b", "c"]
    assert values(clean.read("t.csv_data")) == [("x", 3)]


@pytest.mark.parametrize("name", [d.fragment + ".csv" for d in DATASETS] + ["other.csv"])
def test_a_header_without_rows_is_an_empty_table(spark, csv_file, clean, name):
    header = "order_purchase_timestamp,price,customer_id,product_category_name"
    done = load_file(spark, csv_file(name, header), clean)
    assert done.rows == 0
    assert clean.read(done.table_name).count() == 0


def test_everything_filtered_out_is_an_empty_table(spark, csv_file, clean):
    done = load_file(spark, csv_file(f"{ITEMS}.csv", "price", "0", "-1"), clean)
    assert done.rows == 0


def test_declared_schema_and_options_of_a_dataset(spark, csv_file, clean):
    notes = Dataset(
        "notes",
        "notes",
        schema="id string, note string",
        csv_options={"multiLine": "true", "escape": '"'},
    )
    path = csv_file("notes.csv", "id,note", '007,"two', 'lines"')
    assert load_file(spark, path, clean, datasets=[notes]).rows == 1
    assert values(clean.read("notes.csv_data")) == [("007", "two\nlines")]


def test_declared_schema_of_a_known_dataset(spark, csv_file, clean):
    customers = dataclasses.replace(DATASETS[2], schema="customer_id string, zip string")
    path = csv_file(f"{CUSTOMERS}.csv", "customer_id,zip", "01,001", "1,002", "01,001")
    load_file(spark, path, clean, datasets=[customers])
    assert values(clean.read("customers_data")) == [("01", "001"), ("1", "002")]


def test_cells_that_do_not_fit_a_declared_type(spark, csv_file, clean):
    path = csv_file("counts.csv", "id,n", "a,1", "b,many")
    lenient = Dataset("counts", "counts", schema="id string, n int")
    strict = dataclasses.replace(lenient, csv_options={"mode": "FAILFAST"})
    load_file(spark, path, clean, datasets=[lenient])
    assert values(clean.read("counts.csv_data")) == [("a", 1), ("b", None)]
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        load_file(spark, path, clean, datasets=[strict])


def test_nothing_to_load(spark, clean):
    assert load_files(spark, [], clean).collect() == []


def test_the_first_failure_ends_the_run(spark, csv_file, clean):
    paths = [
        csv_file("first.csv", "a", "1"),
        csv_file(f"{ITEMS}.csv", "no_price", "1"),
        csv_file("last.csv", "a", "1"),
    ]
    with pytest.raises(LoadError) as failure:
        load_files(spark, paths, clean)
    assert failure.value.path == paths[1]
    assert [row.table_name for row in failure.value.loaded] == ["first.csv_data"]
    assert "no_price" in str(failure.value.__cause__)
    assert clean.read("first.csv_data").count() == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        clean.read("last.csv_data")


def test_a_sink_that_writes_nothing_is_a_failure(spark, csv_file, monkeypatch):
    monkeypatch.setattr("millrace.plans.ingest.COUNT_WAIT", 1.0)
    path = csv_file("a.csv", "a", "1")
    with pytest.raises(RuntimeError, match="without having written"):
        load_file(spark, path, lambda df, name: df.createOrReplaceTempView("unwritten"))


def test_a_slow_load_does_not_hold_others_back(spark, csv_file, clean):
    others_done = threading.Event()
    done = []

    def sink(df, name):
        if name == "t0.csv_data":
            # Without a free slot for the rest this would time out.
            assert others_done.wait(60)
        clean(df, name)
        done.append(name)
        if len(done) == 3:
            others_done.set()

    paths = [csv_file(f"t{n}.csv", "a", "1") for n in range(4)]
    manifest = load_files(spark, paths, sink, at_once=2).collect()
    assert [row.file for row in manifest] == [f"t{n}.csv" for n in range(4)]


def test_all_failures_of_a_run_are_told(spark, csv_file, clean):
    both_begun = threading.Barrier(2)

    def sink(df, name):
        both_begun.wait(60)
        raise OSError(name)

    paths = [csv_file(f"t{n}.csv", "a", "1") for n in range(4)]
    with pytest.raises(LoadError) as failure:
        load_files(spark, paths, sink, at_once=2)
    assert list(failure.value.failures) == paths[:2]
    assert [str(e) for e in failure.value.failures.values()] == ["t0.csv_data", "t1.csv_data"]
    assert failure.value.path == paths[0] and failure.value.loaded == []


def test_a_load_without_inference_scans_its_input_once(spark, csv_file, clean):
    csv_file("once.csv/a.csv", "k,v", *["1,2"] * 10)
    path = csv_file("once.csv/b.csv", "k,v", *["3,4"] * 10).rsplit("/", 1)[0]
    once = Dataset("once", "once", types={"v": "int"}, infer=False)
    group = "one-pass"
    spark.sparkContext.setJobGroup(group, "")
    try:
        assert load_file(spark, path, clean, datasets=[once]).rows == 20
    finally:
        spark.sparkContext.setJobGroup("", "")
    # One-task jobs that take the first line, for names and header; then the load.
    tracker = spark.sparkContext.statusTracker()
    jobs = [tracker.getJobInfo(job) for job in sorted(tracker.getJobIdsForGroup(group))]
    tasks = [tracker.getStageInfo(stage).numTasks for job in jobs for stage in job.stageIds]
    assert tasks == [1, 1, 1, 2]
    assert clean.read("once.csv_data").dtypes == [("k", "string"), ("v", "int")]


@pytest.mark.parametrize("path", ["/absent/a.csv", "s3a://bucket/a.csv"])
def test_an_unreachable_file_is_a_failure(spark, clean, path):
    with pytest.raises(LoadError, match="could not load"):
        load_files(spark, [path], clean)


def test_files_side_by_side(spark, csv_file, clean):
    paths = [csv_file(f"t{n}.csv", "a", *["1"] * (n + 1)) for n in range(5)]
    manifest = load_files(spark, paths, clean, at_once=3).collect()
    assert [(row.file, row.rows) for row in manifest] == [(f"t{n}.csv", n + 1) for n in range(5)]


def test_the_same_table_twice_is_loaded_in_turn_only(spark, csv_file, clean):
    paths = [csv_file("one/t.csv", "a", "1"), csv_file("two/t.csv", "a", "2")]
    with pytest.raises(ValueError, match="same table"):
        load_files(spark, paths, clean, at_once=2)
    load_files(spark, paths, clean)
    assert values(clean.read("t.csv_data")) == [(2,)]


@pytest.mark.parametrize("shuffled", [False, True])
def test_repeated_tasks_neither_double_rows_nor_the_count(spark, tmp_path, clean, shuffled):
    raw = str(tmp_path / "big.csv")
    spark.range(0, 4000, 1, 4).selectExpr("id", "id % 100 AS k").write.csv(raw, header=True)

    def lost_once(batches):
        yield from batches
        if TaskContext.get().attemptNumber() == 0:
            raise RuntimeError("executor lost")

    def flaky(df):
        df = df.mapInPandas(lost_once, df.schema)
        return df.repartition(3, "k") if shuffled else df

    flaky_set = Dataset("flaky", "big", rules=(flaky,))
    done = load_file(spark, raw, clean, datasets=[flaky_set])
    assert done.rows == 4000
    assert clean.read("big.csv_data").distinct().count() == 4000
    assert clean.read("big.csv_data").count() == 4000


def failing(df):
    return df.selectExpr("a", "raise_error('no') AS b")


def test_a_published_view_outlives_a_failed_load(spark, csv_file, tmp_path):
    sink = publish_view(str(tmp_path / "published"))
    datasets = [Dataset("bad", "bad_", rules=(failing,))]
    load_file(spark, csv_file(f"{NAME_PREFIX}v{NAME_SUFFIX}", "a", "1", "2"), sink)
    assert spark.table("v_data").count() == 2

    with pytest.raises(LoadError):
        path = csv_file(f"bad_{NAME_PREFIX}v{NAME_SUFFIX}", "a", "9")
        load_files(spark, [path], lambda df, _: sink(df, "v_data"), datasets=datasets)
    assert values(spark.table("v_data")) == [(1,), (2,)]

    load_file(spark, csv_file(f"more/{NAME_PREFIX}v{NAME_SUFFIX}", "b", "x"), sink)
    assert values(spark.table("v_data")) == [("x",)]


def test_a_dot_in_a_view_name_names_a_database(spark, csv_file, tmp_path):
    sink = publish_view(str(tmp_path / "published"))
    with pytest.raises(ValueError, match="no database"):
        load_file(spark, csv_file("lookup.csv", "a", "1"), sink)
    assert not (tmp_path / "published").exists()
    spark.sql("CREATE DATABASE lookup")
    load_file(spark, csv_file("lookup.csv", "a", "1"), sink)
    assert spark.table("lookup.csv_data").count() == 1


# --- Bad lines -------------------------------------------------------------


def test_bad_lines_go_to_a_table_of_their_own(spark, csv_file, clean):
    path = csv_file(f"{ITEMS}.csv", "order_id,price", "a,10.5", "b", "c,1,2", "d,many", "e,0")
    done = load_file(spark, path, clean, bad_lines="_bad")
    assert (done.rows, done.bad_rows) == (1, 3)
    assert values(clean.read("order_items_data")) == [("a", 10.5)]
    assert values(clean.read("order_items_data_bad")) == [
        (f"{ITEMS}.csv", line) for line in ["b", "c,1,2", "d,many"]
    ]
    manifest = load_files(spark, [csv_file("none.csv", "a", "1")], clean, bad_lines="_bad")
    assert manifest.columns[-1] == "bad_rows" and manifest.first().bad_rows == 0
    assert values(clean.read("none.csv_data_bad")) == []


def test_a_load_leaves_no_scratch(spark, csv_file, clean):
    def landed():
        return [name for name in os.listdir(scratch_dir(spark).removeprefix("file:")) if "landed" in name]

    land_csv(spark, csv_file("first.csv", "a", "1"))
    before = landed()
    assert before
    load_file(spark, csv_file("a.csv", "a", "1"), clean, bad_lines="_bad")
    with pytest.raises(Exception, match="no_price"):
        load_file(spark, csv_file(f"{ITEMS}.csv", "no_price", "1"), clean, bad_lines="_bad")
    assert landed() == before


def test_reordered_part_files_of_a_dataset(spark, csv_file, clean):
    csv_file("mixed.csv/a.csv", "a,b", "1,x")
    path = csv_file("mixed.csv/b.csv", "b,a", "y,2").rsplit("/", 1)[0]
    with pytest.raises(Exception, match="FAILED_READ_FILE"):
        load_file(spark, path, clean)
    load_file(spark, path, clean, datasets=[Dataset("mixed", "mixed", by_name=True)])
    assert values(clean.read("mixed.csv_data")) == [(1, "x"), (2, "y")]


# --- Resuming --------------------------------------------------------------


def test_a_rerun_loads_what_is_left(spark, csv_file, tmp_path, clean):
    for name in ["a.csv", "b.csv", "c.csv", "d.csv"]:
        path = csv_file(f"in/{name}", "v", "1")
    folder, ledger = path.rsplit("/", 1)[0], str(tmp_path / "ledger")
    asked = []

    def failing(df, table):
        asked.append(table)
        if table == "c.csv_data" and asked.count(table) == 1:
            raise OSError("no space")
        clean(df, table)

    with pytest.raises(LoadError):
        load_folder(spark, folder, failing, ledger)
    assert [row.file for row in load_folder(spark, folder, failing, ledger, at_once=2).collect()] == ["c.csv", "d.csv"]
    assert load_folder(spark, folder, failing, ledger).collect() == []
    csv_file("in/b.csv", "v", "1", "2")
    csv_file("in/e.csv", "v", "5")
    again = load_folder(spark, folder, failing, ledger)
    assert [(row.file, row.rows) for row in again.collect()] == [("b.csv", 2), ("e.csv", 1)]
    rows = {row.file: row.rows for row in read_ledger(spark, ledger).collect()}
    assert rows == {"a.csv": 1, "b.csv": 2, "c.csv": 1, "d.csv": 1, "e.csv": 1}
    assert sorted(asked) == [f"{name}.csv_data" for name in "abbccde"]


def test_files_of_one_table_are_loaded_again_together(spark, csv_file, tmp_path, clean):
    csv_file(f"in/1_{NAME_PREFIX}t{NAME_SUFFIX}", "v", "1")
    path = csv_file(f"in/{NAME_PREFIX}1_t{NAME_SUFFIX}", "v", "2")
    folder, ledger = path.rsplit("/", 1)[0], str(tmp_path / "ledger")
    assert load_folder(spark, folder, clean, ledger).count() == 2
    csv_file(f"in/1_{NAME_PREFIX}t{NAME_SUFFIX}", "v", "1", "3")
    assert load_folder(spark, folder, clean, ledger).count() == 2
    assert values(clean.read("1_t_data")) == [(2,)]


# --- Sets of tables --------------------------------------------------------


@pytest.fixture
def tables(spark, csv_file, tmp_path):
    """Load named files as a set of views that only this test has."""
    unique = tmp_path.name.replace("-", "_")

    def load(rows, datasets=(), **how):
        paths = [
            csv_file(f"{sum(map(len, rows.values()))}/{NAME_PREFIX}{name}_{unique}{NAME_SUFFIX}", *lines)
            for name, lines in rows.items()
        ]
        return load_release(spark, paths, str(tmp_path / "root"), list(datasets), **how)

    load.read = lambda name: spark.table(f"{name}_{unique}_data")
    load.root = str(tmp_path / "root")
    return load


def test_a_set_with_a_failing_last_file_changes_no_table(spark, tables):
    tables({"a": ["v", "1"], "b": ["w", "x"], "z": ["n", "0"]})
    first = current_releases(spark, tables.root).collect()
    bad = Dataset("bad", f"{NAME_PREFIX}z", rules=(lambda df: df.selectExpr("raise_error('no') AS n"),))
    with pytest.raises(LoadError) as failure:
        tables({"a": ["v", "2", "3"], "b": ["w", "y", "z"], "z": ["n", "9"]}, [bad])
    assert len(failure.value.loaded) == 2
    assert [values(tables.read(name)) for name in "abz"] == [[(1,)], [("x",)], [(0,)]]
    assert current_releases(spark, tables.root).collect() == first

    tables({"a": ["v", "4", "5", "6"], "b": ["w", "u", "v"]})
    assert [values(tables.read(name)) for name in "abz"] == [[(4,), (5,), (6,)], [("u",), ("v",)], [(0,)]]


def test_views_follow_one_pointer(spark, tables, tmp_path, plan_of):
    tables({"a": ["v", "1"], "b": ["v", "1"]})
    release = Release(spark, tables.root)
    for name in "ab":
        release.sink(spark.sql("SELECT 7 AS v"), tables.read(name).inputFiles()[0].split("/tables/")[1].split("/")[0])
    # Written, but seen only after the switch, which needs no view to change.
    assert [values(tables.read(name)) for name in "ab"] == [[(1,)], [(1,)]]
    before = spark.catalog.listTables()
    release.publish()
    assert [values(tables.read(name)) for name in "ab"] == [[(7,)], [(7,)]]
    assert spark.catalog.listTables() == before
    plan = plan_of(tables.read("a"))
    assert "PartitionFilters: [isnotnull(release" in plan and "Subquery" in plan


def test_a_set_may_change_columns(spark, tables):
    tables({"a": ["v,release", "1,old"]})
    assert values(tables.read("a")) == [(1, "old")]
    tables({"a": ["release,more", "new,2"]})
    assert tables.read("a").columns == ["release", "more"]
    assert values(tables.read("a")) == [("new", 2)]
    tables({"a": ["v,release", "5,back", "6,again"]})
    assert values(tables.read("a")) == [(5, "back"), (6, "again")]


def test_releases_are_in_order_whatever_the_clock_says(spark, tables, monkeypatch):
    tables({"a": ["v", "1"]})
    monkeypatch.setattr("millrace.sinks.release.time.time_ns", lambda: 5)
    tables({"a": ["v", "2", "3"]})
    assert values(tables.read("a")) == [(2,), (3,)]


# --- Types without a pass of their own -------------------------------------


def tasks_of(spark, work):
    """Tasks of each stage that ``work`` has run."""
    group = work.__name__
    spark.sparkContext.setJobGroup(group, "")
    try:
        work()
    finally:
        spark.sparkContext.setJobGroup("", "")
    tracker = spark.sparkContext.statusTracker()
    jobs = [tracker.getJobInfo(job) for job in sorted(tracker.getJobIdsForGroup(group))]
    return [tracker.getStageInfo(stage).numTasks for job in jobs for stage in job.stageIds]


def test_a_default_load_scans_its_input_once(spark, csv_file, clean):
    for part in "abc":
        path = csv_file(f"lookup.csv/{part}.csv", "k,v,n", *[f"{part},2017-10-02,"] * 10)
    path = path.rsplit("/", 1)[0]

    def load():
        assert load_file(spark, path, clean).rows == 30

    tasks = tasks_of(spark, load)
    # Apart from jobs on the first lines, one that reads the three files.
    assert [n for n in tasks if n > 2] == [3] and len(tasks) < 8
    assert clean.read("lookup.csv_data").dtypes == [("k", "string"), ("v", "date"), ("n", "string")]


@pytest.mark.parametrize("sink_kind", ["parquet", "view"])
def test_a_wrong_guess_is_made_good(spark, csv_file, tmp_path, clean, monkeypatch, sink_kind):
    monkeypatch.setattr("millrace.sources.delimited.SAMPLE_LINES", 3)
    unique = tmp_path.name.replace("-", "_")
    sink = clean if sink_kind == "parquet" else publish_view(str(tmp_path / "views"))
    lines = ["n,d,e", "1,2017-10-02,", "2,2017-10-03,", "3,2017-10-04 10:00:00,", "4.5,2017-10-05,x", "5,,,9", "6"]
    done = load_file(spark, csv_file(f"{NAME_PREFIX}{unique}{NAME_SUFFIX}", *lines), sink)
    table = clean.read(done.table_name) if sink_kind == "parquet" else spark.table(done.table_name)
    assert done.rows == 6
    assert table.dtypes == [("n", "double"), ("d", "timestamp"), ("e", "string")]
    assert [r.n for r in table.orderBy("n").collect()] == [1.0, 2.0, 3.0, 4.5, 5.0, 6.0]


def test_other_errors_are_not_taken_for_a_wrong_guess(spark, csv_file):
    calls = []

    def sink(df, table):
        calls.append(table)
        raise OSError("no space")

    with pytest.raises(OSError, match="no space"):
        load_file(spark, csv_file("a.csv", "a", "1"), sink)
    assert calls == ["a.csv_data"]
