"""One query per operator over the given tables, with the SQL that checks it.

Queries about CSV files, loads and sinks first write the table they are about
to a new folder under the shared folder (see :mod:`millrace.session`).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import operators as op
from millrace.fixed_values import (
    CUSTOMER,
    CUSTOMERS,
    ITEMS,
    NAME_PREFIX,
    NAME_SUFFIX,
    ORDERS,
    PAYMENT_COUNT_LABEL,
    PAYMENT_TYPE,
    PAYMENT_TYPE_LABEL,
    PAYMENTS,
    PRODUCTS,
    PURCHASE_TIME,
    TABLE_POSTFIX,
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
    route_files,
)
from millrace.session import new_folder
from millrace.sinks import overwrite_parquet, publish_view
from millrace.sources import MULTILINE, list_files, read_csv_table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def checked_by(sql: str, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query, by default under its function's name."""

    def register(query: Query) -> Query:
        QUERIES[name or query.__name__] = query
        ORACLE_SQL[name or query.__name__] = sql
        return query

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own_name(name: str) -> str:
    """A name that no other run and no real table has."""
    return f"{name}_{uuid.uuid4().hex}"


def land(df: DataFrame, path: str) -> str:
    """Write a table as CSV with headers, every field as it is."""
    df.write.options(
        escape='"', ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false"
    ).csv(path, header=True)
    return path


def as_text(timestamp: str) -> Column:
    return F.date_format(timestamp, "yyyy-MM-dd HH:mm:ss")


# --- Reports ---------------------------------------------------------------


@checked_by("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def count_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.count_by(table(spark, sf_dir, "events"), "event_type")


@checked_by(
    """
    SELECT o_orderpriority AS "Тип оплаты", count(*) AS "Количество заказов"
    FROM orders GROUP BY o_orderpriority
    """
)
def payment_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return op.payment_chart(orders.withColumnRenamed("o_orderpriority", "payment_type"))


@checked_by(
    """
    SELECT event_type AS "Тип оплаты", count(*) AS "Количество заказов"
    FROM events GROUP BY event_type ORDER BY 2 DESC
    """
)
def payment_chart_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chart as a dashboard asks for it, of a table known by name."""
    events = table(spark, sf_dir, "events")
    view = own_name("payments_data")
    events.withColumnRenamed("event_type", PAYMENT_TYPE).createOrReplaceTempView(view)
    return spark.sql(
        f"""
        SELECT {PAYMENT_TYPE} AS `{PAYMENT_TYPE_LABEL}`, count(*) AS `{PAYMENT_COUNT_LABEL}`
        FROM {view} GROUP BY {PAYMENT_TYPE} ORDER BY 2 DESC
        """
    )


@checked_by(
    """
    SELECT nullif(l_returnflag, 'N') AS flag, count(*) AS n
    FROM lineitem GROUP BY nullif(l_returnflag, 'N')
    """
)
def count_by_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return op.count_by(lines.withColumn("flag", F.nullif("l_returnflag", F.lit("N"))), "flag")


# --- Cleaning rules --------------------------------------------------------


@checked_by(
    """
    SELECT o_orderkey, o_orderdate AS ordered,
           CASE o_orderstatus WHEN 'P' THEN NULL ELSE o_orderdate END AS readable
    FROM orders
    """
)
def parse_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        as_text("o_orderdate").alias("ordered"),
        F.when(F.col("o_orderstatus") == "P", "not-a-date")
        .when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM-dd"))
        .otherwise(as_text("o_orderdate"))
        .alias("readable"),
    )
    read = written.transform(op.parse_timestamp("ordered")).transform(
        op.parse_timestamp("readable")
    )
    return read.select(
        "o_orderkey",
        F.col("ordered").cast("timestamp_ntz").alias("ordered"),
        F.col("readable").cast("timestamp_ntz").alias("readable"),
    )


@checked_by(
    "SELECT count(*) AS n, count(*) AS stamped, CAST(1 AS BIGINT) AS stamps FROM orders"
)
def stamp_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamped = table(spark, sf_dir, "orders").transform(op.stamp_load())
    return stamped.agg(
        F.count("*").alias("n"),
        F.count("processed_at").alias("stamped"),
        F.countDistinct("processed_at").alias("stamps"),
    )


@checked_by("SELECT * FROM customer WHERE c_acctbal > 0")
def keep_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").transform(op.keep_positive("c_acctbal"))


@checked_by(
    """
    SELECT * FROM (
        SELECT l_orderkey, l_linenumber,
               CASE l_linenumber WHEN 1 THEN -l_extendedprice WHEN 2 THEN 0.0 WHEN 3 THEN NULL
                                 ELSE l_extendedprice END AS price
        FROM lineitem)
    WHERE price > 0
    """
)
def keep_positive_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.select("l_orderkey", "l_linenumber", mixed_price().alias("price")).transform(
        op.keep_positive("price")
    )


def mixed_price() -> Column:
    """Negative, zero, missing and positive prices by line number."""
    line, price = F.col("l_linenumber"), F.col("l_extendedprice")
    return (
        F.when(line == 1, -price)
        .when(line == 2, F.lit(0.0))
        .when(line == 3, F.lit(None))
        .otherwise(price)
    )


@checked_by(
    """
    SELECT o_orderkey FROM (
        SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'n/a' WHEN 'F' THEN '0.5'
                           ELSE CAST(-o_totalprice AS VARCHAR) END AS price
        FROM orders)
    WHERE try_cast(price AS DOUBLE) > 0
    """
)
def keep_positive_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    price = (
        F.when(status == "P", "n/a")
        .when(status == "F", "0.5")
        .otherwise((-F.col("o_totalprice")).cast("string"))
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", price.alias("price"))
    return orders.transform(op.keep_positive("price")).select("o_orderkey")


@checked_by("SELECT DISTINCT text FROM documents")
def dedupe_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").transform(op.dedupe("text")).select("text")


@checked_by(
    """
    SELECT DISTINCT customer_id, 'name of ' || customer_id AS customer_name FROM (
        SELECT CASE o_orderstatus WHEN 'F' THEN 'frequent'
                                  ELSE CAST(o_custkey AS VARCHAR) END AS customer_id
        FROM orders)
    """
)
def dedupe_hot_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers_with_hot_key(spark, sf_dir).transform(op.dedupe("customer_id"))


def customers_with_hot_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer per order; one customer has a third of them."""
    customer = F.when(F.col("o_orderstatus") == "F", "frequent").otherwise(
        F.col("o_custkey").cast("string")
    )
    orders = table(spark, sf_dir, "orders").select(customer.alias("customer_id"))
    return orders.withColumn("customer_name", F.concat(F.lit("name of "), "customer_id"))


@checked_by(
    """
    SELECT DISTINCT nullif(event_type, 'error') AS event_type,
           coalesce(nullif(event_type, 'error'), 'none') AS shown
    FROM events
    """
)
def dedupe_missing_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        F.nullif("event_type", F.lit("error")).alias("event_type")
    )
    shown = events.withColumn("shown", F.coalesce("event_type", F.lit("none")))
    return shown.transform(op.dedupe("event_type"))


@checked_by(
    """
    SELECT * EXCLUDE (key_rank) FROM (
        SELECT *, row_number() OVER (
            PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS key_rank
        FROM orders)
    WHERE key_rank = 1
    """
)
def dedupe_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").transform(
        op.dedupe_latest(["o_custkey"], ["o_orderdate", "o_orderkey"])
    )


@checked_by(
    """
    SELECT p_partkey, p_name, coalesce(nullif(p_type, 'ECONOMY'), 'unknown') AS p_type FROM part
    """
)
def fill_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(
        "p_partkey", "p_name", F.nullif("p_type", F.lit("ECONOMY")).alias("p_type")
    )
    return parts.transform(op.fill_missing({"p_type": "unknown"}))


@checked_by(
    """
    SELECT p_partkey, coalesce(CAST(nullif(p_size, 1) AS VARCHAR), 'unknown') AS p_size FROM part
    """
)
def fill_missing_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(
        "p_partkey", F.nullif("p_size", F.lit(1)).alias("p_size")
    )
    return parts.transform(op.fill_missing({"p_size": "unknown"}))


# --- CSV scans -------------------------------------------------------------


@checked_by("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def csv_count_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land events as CSV, load them as they are, count over the table by SQL name."""
    folder = new_folder(spark, "csv-count")
    land(table(spark, sf_dir, "events"), f"{folder}/raw/events.csv")
    loaded = load_file(spark, f"{folder}/raw/events.csv", overwrite_parquet(f"{folder}/clean"))
    events = spark.read.parquet(f"{folder}/clean/{loaded.table_name}")
    view = own_name("events_data")
    events.createOrReplaceTempView(view)
    return op.count_by(spark.table(view), "event_type")


@checked_by("SELECT * FROM part")
def csv_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    path = land(parts, new_folder(spark, "part.csv"))
    return read_csv_table(spark, path, schema=parts.schema)


@checked_by(
    """
    SELECT CAST(p_partkey AS BIGINT) AS p_partkey, p_name, p_size, p_retailprice,
           CAST(p_size AS VARCHAR) AS size_text, 'STRING' AS size_text_type,
           'DOUBLE' AS price_type
    FROM part
    """
)
def csv_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types found in the data, but for a column that is to stay text."""
    parts = table(spark, sf_dir, "part").select(
        "p_partkey", "p_name", "p_size", "p_retailprice", F.col("p_size").alias("size_text")
    )
    path = land(parts, new_folder(spark, "part.csv"))
    read = read_csv_table(spark, path, text_columns=["size_text"])
    return (
        read.withColumn("size_text_type", F.upper(F.typeof("size_text")))
        .withColumn("price_type", F.upper(F.typeof("p_retailprice")))
        .withColumn("p_partkey", F.col("p_partkey").cast("bigint"))
    )


@checked_by("SELECT doc_id, text, lang, source, n_chars FROM documents")
def csv_multiline(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    path = land(documents, new_folder(spark, "documents.csv"))
    return read_csv_table(spark, path, schema=documents.schema, options=MULTILINE)


RAGGED_SCHEMA = "event_id bigint, event_type string, user_id bigint"


def land_ragged(spark: SparkSession, sf_dir: str, path: str) -> str:
    """Short rows, long rows and unreadable cells, by event type."""
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    cells = (
        F.when(kind == "error", F.array("event_id"))
        .when(kind == "click", F.array("event_id", kind, F.lit("who?")))
        .when(kind == "view", F.array("event_id", kind, user, F.lit("more")))
        .otherwise(F.array("event_id", kind, user))
    )
    lines = (
        table(spark, sf_dir, "events")
        .withColumn("event_id", F.col("event_id").cast("string"))
        .select(F.array_join(cells, ",").alias("event_id,event_type,user_id"))
    )
    # One column without commas to quote by: lines and header come out as they are.
    lines.write.options(sep="\x01", quote="").csv(path, header=True)
    return path


def ragged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed with faults; ``raw_line`` tells."""
    path = land_ragged(spark, sf_dir, new_folder(spark, "ragged.csv"))
    return read_csv_table(spark, path, schema=RAGGED_SCHEMA, corrupt_column="raw_line")


@checked_by(
    """
    SELECT event_id, CASE event_type WHEN 'error' THEN NULL ELSE event_type END AS event_type,
           CASE WHEN event_type IN ('error', 'click') THEN NULL ELSE user_id END AS user_id,
           event_type IN ('error', 'click', 'view') AS bad
    FROM events
    """
)
def csv_ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = ragged_events(spark, sf_dir)
    return read.withColumn("bad", F.col("raw_line").isNotNull()).drop("raw_line")


@checked_by(
    """
    SELECT CASE event_type WHEN 'error' THEN NULL ELSE event_type END AS event_type,
           count(*) AS n_bad
    FROM events
    WHERE event_type IN ('error', 'click', 'view')
    GROUP BY 1
    """
)
def csv_bad_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bad lines per event type, with no other column selected."""
    bad = ragged_events(spark, sf_dir).select("event_type", "raw_line").filter("raw_line IS NOT NULL")
    return bad.groupBy("event_type").agg(F.count("*").alias("n_bad"))


@checked_by(
    """
    SELECT 'customer.csv' AS file, 2 AS parts, 2 * (count(*) + 2) AS bytes FROM customer
    UNION ALL SELECT 'orders.csv', 3, 2 * (count(*) + 3) FROM orders
    """,
    name="list_files",
)
def list_landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only entries of the folder itself, and only with the lower-case suffix."""
    folder = new_folder(spark, "landing")
    for name, file, parts in [
        ("customer", "customer.csv", 2),
        ("orders", "orders.csv", 3),
        ("part", "PART.CSV", 1),
        ("supplier", "deeper/supplier.csv", 1),
    ]:
        # Two bytes a line, and the header again in each part.
        lines = table(spark, sf_dir, name).select(F.lit("x").alias("c"))
        land(lines.repartition(parts), f"{folder}/{file}")
    return list_files(spark, folder).select("file", "parts", "bytes")


# --- Routing and loads -----------------------------------------------------


@checked_by(
    f"""
    SELECT o_orderkey, file,
           CASE WHEN contains(file, '{ORDERS}') THEN 'orders'
                WHEN contains(file, '{ITEMS}') THEN 'items'
                WHEN contains(file, '{CUSTOMERS}') THEN 'customers'
                WHEN contains(file, '{PRODUCTS}') THEN 'products'
                WHEN contains(file, '{PAYMENTS}') THEN 'payments'
                ELSE 'identity' END AS rule,
           replace(replace(file, '{NAME_PREFIX}', ''), '{NAME_SUFFIX}', '')
               || '{TABLE_POSTFIX}' AS table_name
    FROM (SELECT o_orderkey,
                 CASE o_orderstatus WHEN 'P' THEN o_custkey || '_' ELSE '' END
                 || CASE o_orderpriority WHEN '1-URGENT' THEN '{ORDERS}.csv'
                                         WHEN '2-HIGH' THEN '{ITEMS}.csv'
                                         WHEN '3-MEDIUM' THEN '{PRODUCTS}.csv'
                                         WHEN '4-NOT SPECIFIED' THEN '{PAYMENTS}.csv'
                                         ELSE '{NAME_PREFIX}{CUSTOMERS}.csv' END
                 || CASE o_orderstatus WHEN 'F' THEN '.bak' ELSE '' END AS file
          FROM orders)
    """,
    name="route_files",
)
def route_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path per order: the fragment at the front, in the middle, doubled words."""
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    name = (
        F.when(priority == "1-URGENT", f"{ORDERS}.csv")
        .when(priority == "2-HIGH", f"{ITEMS}.csv")
        .when(priority == "3-MEDIUM", f"{PRODUCTS}.csv")
        .when(priority == "4-NOT SPECIFIED", f"{PAYMENTS}.csv")
        .otherwise(f"{NAME_PREFIX}{CUSTOMERS}.csv")
    )
    before = F.when(status == "P", F.concat("o_custkey", F.lit("_"))).otherwise("")
    after = F.when(status == "F", ".bak").otherwise("")
    paths = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.concat(F.lit("s3a://landing/"), "o_orderkey", F.lit("/"), before, name, after).alias(
            "path"
        ),
    )
    return route_files(paths).drop("path")


def loaded_from(
    spark: SparkSession, raw: DataFrame, file: str, declared: bool = False
) -> DataFrame:
    """The clean table that a landed file ends up as, its types inferred or declared."""
    folder = new_folder(spark, "load")
    land(raw, f"{folder}/raw/{file}")
    datasets = DATASETS
    if declared:
        datasets = [replace(dataset, schema=raw.schema) for dataset in DATASETS]
    sink = overwrite_parquet(f"{folder}/clean")
    done = load_file(spark, f"{folder}/raw/{file}", sink, datasets)
    return spark.read.parquet(f"{folder}/clean/{done.table_name}")


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    purchased = F.when(F.col("o_orderstatus") == "P", "not-a-date").when(
        F.col("o_orderpriority") != "5-LOW", as_text("o_orderdate")
    )
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("order "), "o_orderkey").alias("order_id"),
        F.col("o_orderstatus").alias("order_status"),
        purchased.alias("order_purchase_timestamp"),
    )


@checked_by(
    """
    SELECT 'order ' || o_orderkey AS order_id, o_orderstatus AS order_status,
           CASE WHEN o_orderstatus = 'P' OR o_orderpriority = '5-LOW' THEN NULL
                ELSE o_orderdate END AS order_purchase_timestamp,
           true AS stamped
    FROM orders
    """
)
def load_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = loaded_from(spark, raw_orders(spark, sf_dir), f"{ORDERS}.csv")
    return clean.select(
        "order_id",
        "order_status",
        F.col("order_purchase_timestamp").cast("timestamp_ntz").alias("order_purchase_timestamp"),
        F.col("processed_at").isNotNull().alias("stamped"),
    )


def raw_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("order "), "l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        mixed_price().alias("price"),
    )


@checked_by(
    """
    SELECT 'order ' || l_orderkey AS order_id, l_linenumber AS order_item_id,
           l_extendedprice AS price
    FROM lineitem WHERE l_linenumber > 3 AND l_extendedprice > 0
    """
)
def load_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_items(spark, sf_dir)
    return loaded_from(spark, raw, f"{ITEMS}.csv", declared=True)


@checked_by(ORACLE_SQL["dedupe_hot_key"])
def load_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = customers_with_hot_key(spark, sf_dir)
    return loaded_from(spark, raw, f"{CUSTOMERS}.csv", declared=True)


def raw_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("product "), "p_partkey").alias("product_id"),
        F.nullif("p_type", F.lit("ECONOMY")).alias("product_category_name"),
        "p_size",
    )


@checked_by(
    """
    SELECT 'product ' || p_partkey AS product_id,
           coalesce(nullif(p_type, 'ECONOMY'), 'unknown') AS product_category_name, p_size
    FROM part
    """
)
def load_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loaded_from(spark, raw_products(spark, sf_dir), f"{PRODUCTS}.csv")


def raw_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("order "), "o_orderkey").alias("order_id"),
        F.lower("o_orderpriority").alias("payment_type"),
        F.col("o_totalprice").alias("payment_value"),
    )


@checked_by(
    """
    SELECT 'order ' || o_orderkey AS order_id, lower(o_orderpriority) AS payment_type,
           o_totalprice AS payment_value
    FROM orders
    """
)
def load_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_payments(spark, sf_dir)
    return loaded_from(spark, raw, f"{PAYMENTS}.csv", declared=True)


@checked_by(
    """
    SELECT lower(o_orderpriority) AS "Тип оплаты", count(*) AS "Количество заказов"
    FROM orders GROUP BY lower(o_orderpriority)
    """
)
def load_payments_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the landed file to the dashboard's chart."""
    return op.payment_chart(load_payments(spark, sf_dir))


@checked_by("SELECT s_name, s_nationkey, s_acctbal FROM supplier")
def load_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "supplier").select("s_name", "s_nationkey", "s_acctbal")
    return loaded_from(spark, raw, "suppliers.csv")


@checked_by(
    f"""
    SELECT '{ORDERS}.csv' AS file, 'orders' AS rule, 'orders_data' AS table_name,
           count(*) AS rows FROM orders
    UNION ALL SELECT '{ITEMS}.csv', 'items', 'order_items_data', count(*)
        FROM lineitem WHERE l_linenumber > 3 AND l_extendedprice > 0
    UNION ALL SELECT '{CUSTOMERS}.csv', 'customers', 'customers_data', count(*)
        FROM ({ORACLE_SQL["dedupe_hot_key"]})
    UNION ALL SELECT '{PRODUCTS}.csv', 'products', 'products_data', count(*) FROM part
    UNION ALL SELECT '{PAYMENTS}.csv', 'payments', 'order_payments_data', count(*)
        FROM orders
    UNION ALL SELECT 'suppliers.csv', 'identity', 'suppliers.csv_data', count(*) FROM supplier
    """
)
def load_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Find all landed files and load them; what was loaded."""
    folder = new_folder(spark, "load-all")
    landed = {
        f"{ORDERS}.csv": raw_orders(spark, sf_dir),
        f"{ITEMS}.csv": raw_items(spark, sf_dir),
        f"{CUSTOMERS}.csv": customers_with_hot_key(spark, sf_dir),
        f"{PRODUCTS}.csv": raw_products(spark, sf_dir),
        f"{PAYMENTS}.csv": raw_payments(spark, sf_dir),
        "suppliers.csv": table(spark, sf_dir, "supplier"),
    }
    for file, raw in landed.items():
        land(raw, f"{folder}/raw/{file}")
    # One row per table to be filled.
    paths = [entry.path for entry in list_files(spark, f"{folder}/raw").collect()]
    return load_files(spark, paths, overwrite_parquet(f"{folder}/clean"), at_once=3)


# --- Full refresh ----------------------------------------------------------


@checked_by("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def overwrite_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second load replaces rows and columns of the first."""
    folder = new_folder(spark, "overwrite")
    customers = table(spark, sf_dir, "customer")
    sink = overwrite_parquet(folder)
    sink(customers.select("c_custkey", "c_acctbal"), "customers_data")
    sink(customers.select("c_custkey", "c_name", "c_mktsegment"), "customers_data")
    return spark.read.parquet(f"{folder}/customers_data")


@checked_by("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def publish_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report reads whatever the view points at after the second load."""
    events = table(spark, sf_dir, "events")
    sink = publish_view(new_folder(spark, "publish"))
    view = own_name("published_events_data")
    sink(events.select("event_id"), view)
    sink(events.select("event_id", "event_type"), view)
    return op.count_by(spark.table(view), "event_type")


# --- What inference must not decide ----------------------------------------


@checked_by(
    """
    SELECT DISTINCT repeat('0', (c_custkey % 3)::INT) || (c_custkey // 3) AS customer_id
    FROM customer
    """
)
def load_customers_text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that are different texts and may be the same number."""
    zeros = F.repeat(F.lit("0"), (F.col("c_custkey") % 3).cast("int"))
    key = F.concat(zeros, F.floor(F.col("c_custkey") / 3).cast("string"))
    raw = table(spark, sf_dir, "customer").select(key.alias(CUSTOMER), "c_mktsegment")
    return loaded_from(spark, raw, f"{CUSTOMERS}.csv").select(CUSTOMER)


@checked_by(
    """
    SELECT o_orderkey AS order_id, CASE WHEN o_orderstatus = 'F' THEN NULL
           ELSE o_orderdate END AS order_purchase_timestamp
    FROM orders
    """
)
def load_orders_numeric_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells such as 20171002 stand for no timestamp, whatever the others are."""
    written = F.when(F.col("o_orderstatus") == "F", "20171002").otherwise(as_text("o_orderdate"))
    raw = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"), written.alias(PURCHASE_TIME)
    )
    clean = loaded_from(spark, raw, f"{ORDERS}.csv")
    return clean.select("order_id", F.col(PURCHASE_TIME).cast("timestamp_ntz").alias(PURCHASE_TIME))


@checked_by(
    """
    SELECT event_id, event_type FROM events
    """
)
def load_odd_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names with characters of a pattern mean themselves."""
    folder = new_folder(spark, "odd[1]")
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    names = ("x[1].csv", "x1.csv", "a{b}.csv")
    for i, name in enumerate(names):
        land(events.filter(F.col("event_id") % len(names) == i), f"{folder}/{name}")
    found = {entry.file: entry.path for entry in list_files(spark, folder).collect()}
    parts = [
        read_csv_table(spark, found[name], schema=events.schema).filter(
            F.col("event_id") % len(names) == i
        )
        for i, name in enumerate(names)
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@checked_by(
    """
    SELECT o_custkey, max(o_orderkey) AS o_orderkey, 7 AS key_rank FROM orders GROUP BY o_custkey
    """
)
def dedupe_latest_any_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column may be called what a rule calls its own."""
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", F.lit(7).alias("key_rank")
    )
    return orders.transform(op.dedupe_latest(["o_custkey"], ["o_orderkey"]))


# --- Loads that keep, resume and switch ------------------------------------


def quarantined(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Manifest, table and bad lines of events with faults, from one scan."""
    folder = new_folder(spark, "quarantine")
    path = land_ragged(spark, sf_dir, f"{folder}/raw/events.csv")
    datasets = [Dataset("events", "events", rules=(op.dedupe("event_id"),), schema=RAGGED_SCHEMA)]
    sink = overwrite_parquet(f"{folder}/clean")
    manifest = load_files(spark, [path], sink, datasets, bad_lines="_bad")
    name = manifest.first().table_name
    return (
        manifest,
        spark.read.parquet(f"{folder}/clean/{name}"),
        spark.read.parquet(f"{folder}/clean/{name}_bad"),
    )


@checked_by(
    """
    SELECT event_id, event_type, user_id, CAST(NULL AS VARCHAR) AS file, CAST(NULL AS VARCHAR) AS raw_line
    FROM events WHERE event_type NOT IN ('error', 'click', 'view')
    UNION ALL
    SELECT NULL, NULL, NULL, 'events.csv',
           CASE event_type WHEN 'error' THEN CAST(event_id AS VARCHAR)
                           WHEN 'click' THEN event_id || ',click,who?'
                           ELSE event_id || ',view,' || user_id || ',more' END
    FROM events WHERE event_type IN ('error', 'click', 'view')
    """
)
def load_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that parse in the table, the others in a table of raw lines."""
    _, rows, bad = quarantined(spark, sf_dir)
    return rows.unionByName(bad, allowMissingColumns=True)


@checked_by(
    """
    SELECT 'events.csv' AS file, 'events' AS rule, 'events.csv_data' AS table_name,
           count(*) FILTER (event_type NOT IN ('error', 'click', 'view')) AS rows,
           count(*) FILTER (event_type IN ('error', 'click', 'view')) AS bad_rows
    FROM events
    """
)
def load_quarantine_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quarantined(spark, sf_dir)[0]


@checked_by("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def csv_reordered_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part files with the same columns in three orders; types inferred over all."""
    customers = table(spark, sf_dir, "customer")
    orders = (
        ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"],
        ["c_mktsegment", "c_acctbal", "c_name", "c_custkey"],
        ["c_acctbal", "c_custkey", "c_mktsegment", "c_name"],
    )
    path = new_folder(spark, "customer.csv")
    for i, names in enumerate(orders):
        part = customers.filter(F.col("c_custkey") % len(orders) == i).select(names)
        part.write.mode("append").csv(path, header=True)
    read = read_csv_table(spark, path, by_name=True)
    return read.select(
        F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_name", "c_acctbal", "c_mktsegment"
    )


@checked_by(
    f"""
    SELECT '{CUSTOMERS}.csv' AS file, 'customers_data' AS table_name, count(*) AS rows, 1 AS run
    FROM customer
    UNION ALL SELECT '{PAYMENTS}.csv', 'order_payments_data', count(*), 2 FROM orders
    UNION ALL SELECT 'suppliers.csv', 'suppliers.csv_data', count(*), 3 FROM supplier
    """
)
def load_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of three runs has loaded a file: the first fails at the second file,
    the second goes on, and before the third a file has changed."""
    folder = new_folder(spark, "resume")
    raw, ledger = f"{folder}/raw", f"{folder}/ledger"
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias(CUSTOMER), "c_name")
    suppliers = table(spark, sf_dir, "supplier").select("s_name", "s_acctbal")
    land(customers, f"{raw}/{CUSTOMERS}.csv")
    land(raw_payments(spark, sf_dir), f"{raw}/{PAYMENTS}.csv")
    land(suppliers.limit(0), f"{raw}/suppliers.csv")
    write = overwrite_parquet(f"{folder}/clean")

    def failing(clean: DataFrame, name: str) -> None:
        if name != "customers_data":
            raise OSError(f"no space for {name}")
        write(clean, name)

    runs = []
    try:
        load_folder(spark, raw, failing, ledger)
    except LoadError as error:
        runs.append([row.file for row in error.loaded])
    runs.append([row.file for row in load_folder(spark, raw, write, ledger).collect()])
    suppliers.write.mode("append").csv(f"{raw}/suppliers.csv", header=True)
    runs.append([row.file for row in load_folder(spark, raw, write, ledger).collect()])
    last = {file: number for number, files in enumerate(runs, start=1) for file in files}
    run = F.coalesce(*[F.when(F.col("file") == file, number) for file, number in last.items()])
    return read_ledger(spark, ledger).select("file", "table_name", "rows", run.alias("run"))


@checked_by(
    """
    SELECT 'orders' AS name, count(*) AS n, 'order ' || min(o_orderkey) AS first_key
    FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT 'items', count(*), 'order ' || min(l_orderkey) FROM lineitem WHERE l_linenumber = 4
    """
)
def load_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What views show after two sets of tables and one that has failed midway."""
    folder = new_folder(spark, "sets")
    unique = uuid.uuid4().hex
    # As file names; their tables are called likewise.
    files = {name: f"{name}_{unique}{NAME_SUFFIX}" for name in ("orders", "items", "suppliers")}
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")

    def release(number: int, status: str, line: int, **more: DataFrame) -> None:
        parts = {
            "orders": orders.filter(F.col("o_orderstatus") == status).select("o_orderkey"),
            "items": lines.filter(F.col("l_linenumber") == line).select("l_orderkey"),
            **more,
        }
        paths = [land(part, f"{folder}/raw{number}/{files[name]}") for name, part in parts.items()]
        # The last file of the third set has no column for its rule.
        broken = Dataset("broken", "suppliers", rules=(op.parse_timestamp("no_such_column"),))
        load_release(spark, paths, f"{folder}/clean", [broken], at_once=1)

    def counted(name: str, key: str) -> DataFrame:
        view = spark.table(files[name].replace(NAME_SUFFIX, TABLE_POSTFIX))
        first = F.concat(F.lit("order "), F.min(key).cast("string"))
        return view.agg(F.lit(name).alias("name"), F.count("*").alias("n"), first.alias("first_key"))

    release(1, "O", 1)
    release(2, "F", 4)
    try:
        release(3, "P", 5, suppliers=table(spark, sf_dir, "supplier").select("s_name"))
    except LoadError:
        pass
    return counted("orders", "o_orderkey").unionAll(counted("items", "l_orderkey"))
