"""Exchanges in the physical plans: the layouts hold what they promise."""

import pytest
from pyspark.sql import functions as F

from keyorder.operators import fold_from_keyed_start, map_with_resource, sorted_fold, sorted_fold_py, sorted_groups, sorted_join


@pytest.fixture(autouse=True)
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return plan(df).count("Exchange ")


@pytest.fixture
def lines(spark, data):
    return spark.read.parquet(f"{data}/lineitem.parquet")


def test_one_exchange(spark, lines):
    values = ["l_linenumber", "l_partkey"]
    step = lambda acc, v: acc + v["l_partkey"]
    starts = spark.range(10).select(F.col("id").alias("l_orderkey"), F.lit(0).cast("bigint").alias("s"))
    assert exchanges(sorted_groups(lines, "l_orderkey", values=values)) == 1
    assert exchanges(sorted_groups(lines, "l_orderkey", values=values, num_partitions=7)) == 1
    assert exchanges(sorted_fold(lines, "l_orderkey", None, 0, step, "bigint", values=values)) == 1
    assert exchanges(sorted_fold_py(lines, "l_orderkey", None, 0, step, "bigint", values=values)) == 1
    assert exchanges(fold_from_keyed_start(lines, starts, "l_orderkey", None, step, "bigint", start="s", values=values)) == 1
    assert exchanges(map_with_resource(lines, starts, "l_orderkey", None, lambda r, v: r["s"], values=values)) == 1


def test_one_exchange_where_the_caller_places(spark, lines):
    values = ["l_linenumber", "l_partkey"]
    step = lambda acc, v: acc + v["l_partkey"]
    starts = spark.range(10).select(F.col("id").alias("l_orderkey"), F.lit(0).cast("bigint").alias("s"))
    for chosen in (F.pmod("l_orderkey", F.lit(3)).cast("int"), F.lit(1)):
        place = {"values": values, "num_partitions": 3, "partition_id": chosen}
        for found in (
            sorted_groups(lines, "l_orderkey", **place),
            sorted_fold(lines, "l_orderkey", None, 0, step, "bigint", **place),
            fold_from_keyed_start(lines, starts, "l_orderkey", None, step, "bigint", start="s", **place),
            map_with_resource(lines, starts, "l_orderkey", None, lambda r, v: r["s"], **place),
        ):
            assert exchanges(found) == 1 and found.rdd.getNumPartitions() == 3 and "Python" not in plan(found) and "MapInArrow" not in plan(found)
        side = [lines.select("l_orderkey", c) for c in ("l_partkey", "l_suppkey", "l_linenumber", "l_quantity")]
        for how, most in (("inner", 4), ("left", 4), ("right", 4), ("full", 5)):
            found = sorted_join(how, *side, keys="l_orderkey", num_partitions=3, partition_id=chosen)
            assert exchanges(found) == most and found.rdd.getNumPartitions() == 3 and "MapInArrow" not in plan(found)


def test_columns_are_pruned(lines):
    found = plan(sorted_fold_py(lines, "l_orderkey", None, 0, lambda a, v: a, "bigint", values=["l_partkey"]))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>" in found


def test_join_exchanges(lines):
    side = lines.select("l_orderkey", "l_partkey")
    assert exchanges(sorted_join("inner", side, side, side, side, keys="l_orderkey")) <= 4
    assert exchanges(sorted_join("left", *[lines.select("l_orderkey", c) for c in ("l_partkey", "l_suppkey", "l_linenumber", "l_quantity")], keys="l_orderkey")) == 4
    full = sorted_join("full", *[lines.select("l_orderkey", c) for c in ("l_partkey", "l_suppkey", "l_linenumber", "l_quantity")], keys="l_orderkey")
    assert exchanges(full) <= 5
