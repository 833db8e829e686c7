import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from millrace import operators as op
from millrace.sources import read_csv_table

few = settings(
    max_examples=12,
    deadline=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture],
)


def values(df):
    return [tuple(row) for row in df.collect()]


# --- parse_timestamp, stamp_load -------------------------------------------


def test_unreadable_timestamps_become_null(spark, csv_file):
    path = csv_file(
        "t.csv", "id,order_purchase_timestamp", "1,2017-10-02 10:56:33", "2,not-a-date", "3,"
    )
    df = read_csv_table(spark, path).transform(op.parse_timestamp("order_purchase_timestamp"))
    assert values(df) == [(1, dt.datetime(2017, 10, 2, 10, 56, 33)), (2, None), (3, None)]
    assert df.columns == ["id", "order_purchase_timestamp"]


def test_dates_become_midnight(spark, csv_file):
    path = csv_file("d.csv", "id,d", "1,2017-10-02", "2,2018-07-24")
    df = read_csv_table(spark, path).transform(op.parse_timestamp("d"))
    assert dict(df.dtypes)["d"] == "timestamp"
    assert [row.d for row in df.collect()] == [
        dt.datetime(2017, 10, 2),
        dt.datetime(2018, 7, 24),
    ]


def test_numbers_are_seconds(spark):
    df = spark.sql("SELECT 60 AS t").transform(op.parse_timestamp("t"))
    assert values(df) == [(dt.datetime(1970, 1, 1, 0, 1),)]


def test_timestamps_stay(spark):
    df = spark.sql("SELECT timestamp'2020-01-02 03:04:05.678901' AS t")
    assert values(df.transform(op.parse_timestamp("t"))) == values(df)


def test_one_stamp_per_load(spark):
    stamped = spark.range(0, 1000, 1, 8).transform(op.stamp_load())
    assert stamped.columns == ["id", "processed_at"]
    assert stamped.select("processed_at").distinct().count() == 1
    assert stamped.filter("processed_at IS NULL").count() == 0


def test_a_stamp_replaces_an_older_one(spark):
    old = spark.sql("SELECT 1 AS id, timestamp'2000-01-01 00:00:00' AS processed_at")
    (row,) = old.transform(op.stamp_load()).collect()
    assert row.processed_at.year > 2000


# --- keep_positive ---------------------------------------------------------


def test_prices(spark, csv_file):
    path = csv_file(
        "p.csv", "z,price", "01151,0.5", "09790,-1", "00000,0", "14409,", "14410,NaN"
    )
    kept = read_csv_table(spark, path).transform(op.keep_positive("price"))
    assert [row.z for row in kept.collect()] == [1151, 14410]


def test_one_bad_price_costs_one_row(spark, csv_file):
    path = csv_file("p.csv", "id,price", "1,0.5", "2,abc", "3,5", "4,1.5", "5,-2", "6,0.0")
    df = read_csv_table(spark, path)
    assert dict(df.dtypes)["price"] == "string"
    assert [row.id for row in df.transform(op.keep_positive("price")).collect()] == [1, 3, 4]


def test_decimals_and_big_integers(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (9223372036854775807, 0.01BD), (-1, 0.02BD), (1, 0BD) AS t(a, b)"
    )
    kept = df.transform(op.keep_positive("a")).transform(op.keep_positive("b"))
    assert [row.a for row in kept.collect()] == [2**63 - 1]


@few
@given(st.lists(st.one_of(st.none(), st.floats(width=64)), min_size=1, max_size=30))
def test_keep_positive_twice_is_once(spark, prices):
    df = spark.createDataFrame([(price,) for price in prices], "price double")
    once = df.transform(op.keep_positive("price"))
    kept = [row.price for row in once.collect()]
    assert len(kept) == sum(p is not None and not p <= 0 for p in prices)
    assert once.transform(op.keep_positive("price")).count() == len(kept)


# --- dedupe ----------------------------------------------------------------


def test_one_row_per_key_and_one_for_null(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("a", 4)], "k string, v int")
    kept = dict(values(df.transform(op.dedupe("k"))))
    assert set(kept) == {None, "a"}
    assert kept[None] in (1, 2) and kept["a"] in (3, 4)


def test_kept_rows_are_whole_rows_in_their_column_order(spark):
    rows = [(n, f"k{n % 7}", f"text {n}", None if n % 3 else float(n)) for n in range(200)]
    df = spark.createDataFrame(rows, "`odd name` int, k string, t string, x double").repartition(5)
    kept = df.transform(op.dedupe("k"))
    assert kept.schema == df.schema
    assert set(values(kept)) <= set(rows)
    assert kept.count() == 7


def test_dedupe_by_several_keys_and_by_all(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (1, 2, "c")], "a int, b int, c string")
    assert df.transform(op.dedupe("a", "b")).count() == 2
    assert df.select("a").transform(op.dedupe("a")).count() == 1


@few
@given(
    st.lists(
        st.tuples(st.one_of(st.none(), st.sampled_from("abcd")), st.integers(0, 9)),
        min_size=1,
        max_size=40,
    )
)
def test_dedupe_leaves_one_row_per_distinct_key(spark, rows):
    df = spark.createDataFrame(rows, "k string, v int")
    once = df.transform(op.dedupe("k"))
    kept = values(once)
    assert sorted(map(str, (k for k, _ in kept))) == sorted(map(str, {k for k, _ in rows}))
    assert set(kept) <= set(rows)
    assert sorted(map(str, values(once.transform(op.dedupe("k"))))) == sorted(map(str, kept))


@few
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 9)), min_size=1, max_size=40))
def test_dedupe_latest_is_the_maximum_per_key(spark, rows):
    rows = [(k, v, n) for n, (k, v) in enumerate(rows)]
    df = spark.createDataFrame(rows, "k int, v int, n int").repartition(3)
    latest = values(df.transform(op.dedupe_latest(["k"], ["v", "n"])))
    expected = {}
    for row in rows:
        expected[row[0]] = max(expected.get(row[0], row), row, key=lambda r: (r[1], r[2]))
    assert sorted(latest) == sorted(expected.values())


# --- fill_missing, identity ------------------------------------------------


def test_categories(spark, csv_file):
    path = csv_file("c.csv", "id,product_category_name", "1,a", "2,", '3,""', '4,"  "')
    filled = read_csv_table(spark, path).transform(
        op.fill_missing({"product_category_name": "unknown"})
    )
    assert [row[1] for row in filled.collect()] == ["a", "unknown", "unknown", "  "]


def test_numeric_categories_become_text(spark):
    df = spark.createDataFrame([(1, 10), (2, None)], "id int, c int")
    filled = df.transform(op.fill_missing({"c": "unknown"}))
    assert values(filled) == [(1, "10"), (2, "unknown")]


def test_fill_leaves_other_columns_alone(spark):
    df = spark.createDataFrame([(None, None)], "c string, d string")
    assert values(df.transform(op.fill_missing({"c": "unknown"}))) == [("unknown", None)]


def test_identity(spark):
    df = spark.range(3)
    assert df.transform(op.identity) is df


@pytest.mark.parametrize(
    "rule",
    [
        op.parse_timestamp("absent"),
        op.keep_positive("absent"),
        op.dedupe("absent"),
        op.dedupe_latest(["absent"], ["id"]),
        op.fill_missing({"absent": "unknown"}),
    ],
)
def test_a_missing_column_is_an_error(spark, rule):
    with pytest.raises(AnalysisException):
        spark.range(3).transform(rule)


# --- reports ---------------------------------------------------------------


def test_counts_most_first_with_null_as_a_value(spark):
    df = spark.createDataFrame([(k,) for k in ["a", "b", None, "b", None, "c"]], "k string")
    assert values(op.count_by(df, "k")) == [(None, 2), ("b", 2), ("a", 1), ("c", 1)]


def test_payment_chart_counts_rows_not_orders(spark):
    df = spark.createDataFrame(
        [(1, "card"), (1, "voucher"), (1, "voucher"), (2, "card"), (3, "card")],
        "order_id int, payment_type string",
    )
    chart = op.payment_chart(df)
    assert chart.columns == ["Тип оплаты", "Количество заказов"]
    assert values(chart) == [("card", 3), ("voucher", 2)]


def test_report_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "payment_type string")
    assert values(op.payment_chart(empty)) == []


def test_report_key_may_be_called_like_the_count(spark):
    df = spark.range(4).select((F.col("id") % 2).alias("kind"))
    assert op.count_by(df, "kind", key_label="type", count_label="rows").columns == ["type", "rows"]
