import pytest
from pyspark.sql import functions as F

from millrace.operators import keep_positive
from millrace.plans import DATASETS, Dataset, object_paths, route_files


def routes(spark, *paths, **options):
    files = spark.createDataFrame([(path,) for path in paths], "path string")
    return [
        (row.file, row.rule, row.table_name) for row in route_files(files, **options).collect()
    ]


@pytest.mark.parametrize(
    "file, rule, table",
    [
        ("olist_orders_dataset.csv", "orders", "orders_data"),
        ("olist_order_items_dataset.csv", "items", "order_items_data"),
        ("olist_customers_dataset.csv", "customers", "customers_data"),
        ("olist_products_dataset.csv", "products", "products_data"),
        ("olist_order_payments_dataset.csv", "payments", "order_payments_data"),
        ("lookup.csv", "identity", "lookup.csv_data"),
        # The fragment may stand anywhere; words are dropped wherever they stand.
        ("2024_olist_orders_dataset_v2.csv", "orders", "2024_orders_dataset_v2.csv_data"),
        ("olist_olist_orders_dataset.csv_dataset.csv", "orders", "orders_data"),
        # Case matters.
        ("Olist_Orders_Dataset.csv", "identity", "Olist_Orders_Dataset.csv_data"),
        # Two fragments: the first in the list wins.
        (
            "olist_customers_dataset_olist_orders_dataset.csv",
            "orders",
            "customers_dataset_orders_data",
        ),
    ],
)
def test_routes(spark, file, rule, table):
    assert routes(spark, f"s3a://bucket/in/{file}") == [(file, rule, table)]


def test_a_folder_is_named_like_a_file(spark):
    assert routes(spark, "/in/olist_orders_dataset.csv/") == [
        ("olist_orders_dataset.csv", "orders", "orders_data")
    ]


def test_only_the_last_part_of_a_path_counts(spark):
    assert routes(spark, "/olist_orders_dataset/x.csv") == [("x.csv", "identity", "x.csv_data")]


def test_a_dataset_is_added_without_a_change_here(spark):
    more = DATASETS + (Dataset("fees", "fees_", rules=(keep_positive("fee"),)),)
    assert routes(spark, "fees_2024.csv", datasets=more) == [
        ("fees_2024.csv", "fees", "fees_2024.csv_data")
    ]


def test_object_paths():
    expected = ["s3a://landing/a.csv", "s3a://landing/b.csv"]
    assert object_paths(["a.csv", "b.csv"], "landing") == expected
    assert object_paths('["a.csv", "b.csv"]', "landing") == expected
    assert object_paths("[]", "landing") == []
    with pytest.raises(ValueError):
        object_paths("[a.csv", "landing")


def test_routes_of_a_listing(spark, csv_file, tmp_path):
    from millrace.sources import list_files

    csv_file("in/olist_products_dataset.csv", "id", "1")
    csv_file("in/lookup.csv", "id", "1")
    listed = route_files(list_files(spark, str(tmp_path / "in")))
    rows = listed.select("rule", "bytes").orderBy(F.desc("rule")).collect()
    assert [tuple(row) for row in rows] == [("products", 5), ("identity", 5)]


def test_datasets_need_names_of_their_own(spark):
    with pytest.raises(ValueError, match="names"):
        routes(spark, "x.csv", datasets=DATASETS + (Dataset("orders", "x"),))
