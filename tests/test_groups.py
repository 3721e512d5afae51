import math
import random

import pytest
from pyspark.sql import functions as F

from keyorder.functions import Order, asc, desc
from keyorder.operators import sorted_groups


def frame(spark, rows, schema):
    rows = list(rows)
    random.Random(8).shuffle(rows)
    return spark.createDataFrame(rows, schema)


def as_lists(df, field="value"):
    return {r["key"]: [v[field] for v in r["values"]] for r in df.collect()}


@pytest.fixture
def multiples(spark):
    return frame(spark, [(k, k * i) for k in (2, 3, 31) for i in range(60)], "key int, value int")


EXPECTED = {k: [k * i for i in range(60)] for k in (2, 3, 31)}


def test_natural_order(multiples):
    assert as_lists(sorted_groups(multiples, "key")) == EXPECTED


@pytest.mark.parametrize("n", [1, 3, 7])
def test_exact_partitions(multiples, n):
    found = sorted_groups(multiples, "key", num_partitions=n)
    assert found.rdd.getNumPartitions() == n
    assert as_lists(found) == EXPECTED


def test_placed_by_id(multiples):
    found = sorted_groups(multiples, "key", num_partitions=3, partition_id=F.pmod("key", F.lit(3)))
    assert found.rdd.getNumPartitions() == 3
    assert as_lists(found) == EXPECTED
    at = {r["key"]: r["p"] for r in found.withColumn("p", F.spark_partition_id()).collect()}
    assert at == {k: k % 3 for k in at}


def test_prepartitioned_input(spark):
    df = frame(spark, [(3**e, 3**e * i) for e in range(6) for i in range(50)], "key int, value int").repartition(3, "key")
    found = as_lists(sorted_groups(df, "key"))
    assert found == {3**e: [3**e * i for i in range(50)] for e in range(6)}


def test_many_keys_in_a_task(spark):
    rows = [(k, (k * 7919 + i * 104729) % 1009, i) for k in range(500) for i in range(8)]
    found = sorted_groups(frame(spark, rows, "key int, value int, id int"), "key", num_partitions=1)
    for r in found.collect():
        got = [(v["value"], v["id"]) for v in r["values"]]
        assert got == sorted(got) and len(got) == 8


def test_keys_ascend_in_partitions(spark):
    df = frame(spark, [(k, 0) for k in range(200)], "key int, value int")
    for part in sorted_groups(df, "key").rdd.glom().collect():
        keys = [r["key"] for r in part]
        assert keys == sorted(keys)


@pytest.mark.parametrize("placed", [False, True])
@pytest.mark.parametrize(
    "order, expected",
    [
        ([lambda: desc("value")], [3, 2, 1, None]),
        ([lambda: desc("value", nulls_last=False)], [None, 3, 2, 1]),
        ([lambda: asc("value", nulls_last=True)], [1, 2, 3, None]),
        (["value"], [None, 1, 2, 3]),
        ([lambda: -F.col("value")], [None, 3, 2, 1]),
        ([lambda: Order(F.col("value") % 2), lambda: desc("value")], [None, 2, 3, 1]),
    ],
)
def test_orders(spark, order, expected, placed):
    df = spark.createDataFrame([("k", v) for v in (2, None, 3, 1)], "key string, value int")
    order = [x() if callable(x) else x for x in order]
    place = {"num_partitions": 2, "partition_id": F.lit(1)} if placed else {}
    assert as_lists(sorted_groups(df, "key", order, **place))["k"] == expected


def test_payload_without_order(spark):
    df = spark.createDataFrame([("k", i, {"v": i}) for i in (3, 1, 2)], "key string, s int, m map<string,int>")
    found = sorted_groups(df, "key", "s").first()["values"]
    assert [v["m"] for v in found] == [{"v": 1}, {"v": 2}, {"v": 3}]
    with pytest.raises(ValueError, match="can't be ordered"):
        sorted_groups(df, "key")


def test_order_by_nested_field(spark):
    df = spark.createDataFrame([("k", (i,)) for i in (3, 1, 2)], "key string, value struct<value:int>")
    found = sorted_groups(df, "key", F.col("value.value")).first()["values"]
    assert [v["value"]["value"] for v in found] == [1, 2, 3]


def test_null_and_nan_keys_are_groups(spark):
    rows = [(None, 2), (None, 1), (math.nan, 4), (math.nan, 3), (0.0, 6), (-0.0, 5)]
    df = spark.createDataFrame(rows, "key double, value int")
    for place in ({}, {"num_partitions": 1, "partition_id": F.lit(0)}):
        found = [(r["key"], [v["value"] for v in r["values"]]) for r in sorted_groups(df, "key", **place).collect()]
        assert sorted(v for _, v in found) == [[1, 2], [3, 4], [5, 6]]


def test_null_values_and_duplicates_stay(spark):
    df = spark.createDataFrame([("k", None), ("k", 1), ("k", 1), ("k", None)], "key string, value int")
    assert as_lists(sorted_groups(df, "key")) == {"k": [None, None, 1, 1]}


def test_strings_order_by_bytes(spark):
    df = spark.createDataFrame([("k", s) for s in ("\U0001f600", "￮", "a")], "key string, value string")
    assert as_lists(sorted_groups(df, "key")) == {"k": ["a", "￮", "\U0001f600"]}


def test_composite_keys_and_value_choice(spark):
    df = spark.createDataFrame([(1, "a", 2, 9), (1, "a", 1, 8), (1, "b", 0, 7)], "x int, y string, v int, w int")
    found = {(r.x, r.y): [tuple(v) for v in r["vs"]] for r in sorted_groups(df, ["x", "y"], values=["v"], into="vs").collect()}
    assert found == {(1, "a"): [(1,), (2,)], (1, "b"): [(0,)]}


def test_empty_table(spark):
    assert sorted_groups(spark.createDataFrame([], "key int, value int"), "key").collect() == []


def test_wrong_calls(spark):
    df = spark.createDataFrame([(1, 2, {})], "key int, value int, m map<string,int>")
    for call in (
        lambda: sorted_groups(df, "key", []),
        lambda: sorted_groups(df, "nope", ["value"]),
        lambda: sorted_groups(df, [], ["value"]),
        lambda: sorted_groups(df, "m", ["value"]),
        lambda: sorted_groups(df, "key", ["value"], num_partitions=0),
        lambda: sorted_groups(df, "key", ["value"], partition_id=F.lit(0)),
        lambda: sorted_groups(df.withColumn("__ko_x", F.lit(1)), "key", ["value"]),
    ):
        with pytest.raises(ValueError):
            call()
