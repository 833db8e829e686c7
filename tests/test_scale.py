"""What must hold at any size is visible in the physical plans."""

import re

import pytest
from pyspark.sql import functions as F

from millrace import catalogue
from millrace import operators as op

SF = "/root/testdata/sf0.001"


def exchanges(plan):
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning")


def below_shuffle(plan):
    return plan[plan.index("Exchange hashpartitioning") :]


def table(spark, name):
    return catalogue.table(spark, SF, name)


def test_report_reads_one_column_and_counts_before_the_shuffle(spark, plan_of):
    plan = plan_of(op.count_by(table(spark, "events"), "event_type"))
    assert "ReadSchema: struct<event_type:string>" in plan
    assert "partial_count" in below_shuffle(plan)
    assert exchanges(plan) == 2  # groups, and their order


def test_positive_filter_reaches_the_scan(spark, plan_of):
    plan = plan_of(table(spark, "customer").transform(op.keep_positive("c_acctbal")))
    assert "PushedFilters: [IsNotNull(c_acctbal), GreaterThan(c_acctbal,0.0)]" in plan
    assert exchanges(plan) == 0


@pytest.mark.parametrize(
    "rule",
    [
        op.parse_timestamp("o_orderdate"),
        op.stamp_load(),
        op.keep_positive("o_totalprice"),
        op.fill_missing({"o_orderpriority": "unknown"}),
    ],
)
def test_row_rules_neither_shuffle_nor_leave_generated_code(spark, plan_of, rule):
    plan = plan_of(table(spark, "orders").transform(rule))
    assert exchanges(plan) == 0
    assert "Python" not in plan
    assert re.search(r"\*\(1\) (Project|Filter)", plan)


def test_dedupe_sends_one_row_per_key_and_task(spark, plan_of):
    plan = plan_of(table(spark, "orders").transform(op.dedupe("o_custkey")))
    assert "partial_first" in below_shuffle(plan)
    assert exchanges(plan) == 1


def test_dedupe_of_keys_alone_is_a_hash_aggregate_of_one_column(spark, plan_of):
    keys = table(spark, "orders").transform(op.dedupe("o_custkey")).select("o_custkey")
    plan = plan_of(keys)
    assert "SortAggregate" not in plan
    assert "ReadSchema: struct<o_custkey:bigint>" in plan


def test_dedupe_latest_limits_groups_before_the_shuffle(spark, plan_of):
    plan = plan_of(
        table(spark, "orders").transform(op.dedupe_latest(["o_custkey"], ["o_orderdate"]))
    )
    assert re.search(r"WindowGroupLimit .*row_number\(\), 1, Partial", below_shuffle(plan))
    assert exchanges(plan) == 1


def shuffled_rows(df):
    """Rows that the first shuffle of a finished plan was given."""
    plan = df._jdf.queryExecution().executedPlan()
    stage = plan.executedPlan()
    while stage.nodeName() != "ShuffleQueryStage":
        in_stage = stage.nodeName().endswith("QueryStage")
        stage = stage.plan() if in_stage else stage.children().head()
    return stage.plan().metrics().apply("shuffleRecordsWritten").value()


@pytest.mark.parametrize(
    "rule", [op.dedupe("k"), op.dedupe_latest(["k"], ["id"])], ids=["dedupe", "dedupe_latest"]
)
def test_a_hot_key_is_not_shuffled_whole(spark, rule):
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(
        (F.col("id") % 50).cast("string")
    )
    df = spark.range(0, 30000, 1, 6).withColumn("k", key).withColumn("t", F.lit("text"))
    kept = df.transform(rule)
    assert len(kept.collect()) == 51
    assert shuffled_rows(kept) <= 51 * 6


def test_routing_is_one_projection(spark, plan_of):
    plan = plan_of(catalogue.route_paths(spark, SF))
    assert exchanges(plan) == 0
    assert "Python" not in plan
