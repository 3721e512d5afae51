import pytest
from pyspark.sql import functions as F

from keyorder.functions import desc
from keyorder.operators import map_with_resource, map_with_resource_py

LOOK_UP = lambda r, v: r["m"][v["value"]]


@pytest.fixture
def values(spark):
    rows = [("sea", 6), ("fen", 5), ("sea", 2), ("fen", 9)]
    return spark.createDataFrame(rows, "key string, value int").coalesce(1)


def resources(spark, *keys):
    maps = {"sea": {2: 14, 6: 42}, "fen": {5: 1, 9: 0}}
    return spark.createDataFrame([(k, maps[k]) for k in keys], "key string, m map<int,int>").coalesce(1)


def look_up_py(r, v):
    return dict(r["m"])[v["value"]]


def native(values, res, **kw):
    return map_with_resource(values, res, "key", None, LOOK_UP, **kw)


def python(values, res, **kw):
    return map_with_resource_py(values, res, "key", None, look_up_py, "int", **kw)


BOTH = pytest.mark.parametrize("apply", [native, python])


def by_key(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["key"], []).append(r["result"])
    return out


@BOTH
@pytest.mark.parametrize("n", [None, 7])
def test_applied_in_order(spark, values, apply, n):
    found = apply(values, resources(spark, "sea", "fen"), num_partitions=n)
    assert by_key(found) == {"sea": [14, 42], "fen": [1, 0]}
    if n:
        assert found.rdd.getNumPartitions() == n


@BOTH
def test_placed_by_id(spark, values, apply):
    found = apply(values, resources(spark, "sea", "fen"), num_partitions=3, partition_id=F.when(F.col("key") == "fen", 2).otherwise(1))
    assert found.rdd.getNumPartitions() == 3
    assert {(r["key"], r["p"]) for r in found.withColumn("p", F.spark_partition_id()).collect()} == {("sea", 1), ("fen", 2)}
    assert by_key(found) == {"sea": [14, 42], "fen": [1, 0]}


def test_prepared(spark, values):
    res = resources(spark, "sea", "fen")
    negate = lambda r: F.transform_values(r["m"], lambda _, x: -x)
    assert by_key(map_with_resource(values, res, "key", None, lambda r, v: r[v["value"]], prepare=negate)) == {"sea": [-14, -42], "fen": [-1, 0]}
    found = map_with_resource_py(
        values, res, "key", None, lambda r, v: r[v["value"]], "int", prepare=lambda r: {k: -x for k, x in dict(r["m"]).items()}
    )
    assert by_key(found) == {"sea": [-14, -42], "fen": [-1, 0]}


def test_prepared_once_a_key(spark):
    values = spark.range(100).select((F.col("id") % 4).alias("key"), F.col("id").alias("value"))
    res = spark.range(4).select(F.col("id").alias("key"), F.lit(0).alias("n"))
    calls = spark.sparkContext.accumulator(0)

    def prepare(r):
        calls.add(1)
        return r["n"]

    found = map_with_resource_py(values, res, "key", None, lambda r, v: r + v["value"], "bigint", prepare=prepare)
    assert sum(sum(v) for v in by_key(found).values()) == sum(range(100))
    assert calls.value == 4


def test_curried_and_order(spark, values):
    def ready(r):
        seen = []
        return lambda v: (seen.append(v["value"]), list(seen))[1]

    found = map_with_resource_py(values, resources(spark, "sea", "fen"), "key", [desc("value")], ready, "array<int>", curried=True)
    assert by_key(found) == {"sea": [[6], [6, 2]], "fen": [[9], [9, 5]]}


@BOTH
def test_values_without_resource_fail(spark, values, apply):
    for kept in ("sea", "fen"):
        found = apply(values, resources(spark, kept))
        for action in (found.collect, found.count):
            with pytest.raises(Exception, match="values without a resource"):
                action()


@BOTH
def test_resource_without_values_fails(spark, values, apply):
    for kept in ("sea", "fen"):
        with pytest.raises(Exception, match="a resource without values"):
            apply(values.filter(F.col("key") == kept), resources(spark, "sea", "fen")).count()


@BOTH
def test_two_resources_fail_even_without_values(spark, values, apply):
    for rows in (values, values.limit(0)):
        with pytest.raises(Exception, match="more than one resource"):
            apply(rows, resources(spark, "fen", "fen", "sea")).collect()


@BOTH
def test_empty(spark, values, apply):
    assert apply(values.limit(0), resources(spark)).collect() == []


@BOTH
def test_null_keys_and_null_resources(spark, apply):
    values = spark.createDataFrame([(None, 1)], "key string, value int")
    res = spark.createDataFrame([(None, {1: 5})], "key string, m map<int,int>")
    assert by_key(apply(values, res)) == {None: [5]}


def test_null_resource_is_a_resource(spark):
    values = spark.createDataFrame([("a", 1)], "key string, value int")
    res = spark.createDataFrame([("a", None)], "key string, r int")
    assert by_key(map_with_resource(values, res, "key", None, lambda r, v: F.coalesce(r["r"], v["value"]))) == {"a": [1]}
