"""Payments from lineitem: numbered where the join dealt them, read once, and their ends without all rows."""

import datetime as dt

from paygrove.operators import splits
from paygrove.plans import q_evaluate, tables

SF = "/root/testdata/sf0.001"


def test_rows_are_numbered_where_the_join_dealt_them(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = tables.pay_lineitem(spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 2  # both sides of the join, none for the numbers


def test_customers_are_read_from_what_was_written(spark):
    plan = q_evaluate.scored(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan


def test_ends_give_the_same_plan_with_lines_without_orders(spark, tmp_path):
    li, o = spark.read.parquet(f"{SF}/lineitem.parquet"), spark.read.parquet(f"{SF}/orders.parquet")
    odd = spark.createDataFrame([(*r[:10], d) for r in li.limit(2).collect() for d in (dt.datetime(1970, 1, 1), dt.datetime(2050, 1, 1))], li.schema)
    odd = odd.selectExpr("-1L AS l_orderkey", *li.columns[1:])
    li.unionByName(odd).write.parquet(f"{tmp_path}/lineitem.parquet")
    o.write.parquet(f"{tmp_path}/orders.parquet")
    for sf in (SF, str(tmp_path)):
        assert q_evaluate._folds(spark, sf)[1] == splits.plan(tables.pay_lineitem(spark, sf))
        assert tables.lineitem_ends(spark, sf).count() < tables.pay_lineitem(spark, sf).count() / 10
