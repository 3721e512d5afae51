import random

import pytest
from pyspark.sql import functions as F

from keyorder.functions import desc
from keyorder.operators import fold_from_keyed_start, fold_from_keyed_start_py, sorted_fold, sorted_fold_py

APPEND = lambda acc, v: F.array_append(acc, v["value"])


def append_py(acc, v):
    acc.append(v["value"])  # changes the start value: each key needs its own
    return acc


@pytest.fixture
def values(spark):
    rows = [("oak", 8), ("elm", 12), ("oak", 3), ("oak", 40), ("elm", -6), ("oak", 21)]
    return spark.createDataFrame(rows, "key string, value int")


def result(df):
    return {r["key"]: r["result"] for r in df.collect()}


@pytest.mark.parametrize("n", [None, 7])
def test_fold_appends_in_order(values, n):
    native = sorted_fold(values, "key", None, F.array(), APPEND, "array<int>", num_partitions=n)
    python = sorted_fold_py(values, "key", None, [], append_py, "array<int>", num_partitions=n)
    assert result(native) == result(python) == {"oak": [3, 8, 21, 40], "elm": [-6, 12]}
    if n:
        assert native.rdd.getNumPartitions() == python.rdd.getNumPartitions() == n


def test_fold_order_by(values):
    native = sorted_fold(values, "key", [desc("value")], F.array(), APPEND, "array<int>")
    python = sorted_fold_py(values, "key", [-F.col("value")], list, append_py, "array<int>")
    assert result(native) == result(python) == {"oak": [40, 21, 8, 3], "elm": [12, -6]}


@pytest.mark.parametrize("fold, init, op", [(sorted_fold, F.array, APPEND), (sorted_fold_py, list, append_py)])
def test_fold_placed_by_id(values, fold, init, op):
    init = init() if fold is sorted_fold else init
    found = fold(values, "key", None, init, op, "array<int>", num_partitions=3, partition_id=F.length("key") % 2)
    assert found.rdd.getNumPartitions() == 3
    assert {r["p"] for r in found.withColumn("p", F.spark_partition_id()).collect()} == {1}
    assert result(found) == {"oak": [3, 8, 21, 40], "elm": [-6, 12]}


def test_fold_start_of_another_type(spark):
    df = spark.createDataFrame([("a", 4), ("a", 2), ("a", -10)], "key string, value int")
    assert result(sorted_fold(df, "key", None, 1.0, lambda acc, v: acc + v["value"], "double")) == {"a": -3.0}


def test_group_crosses_batches(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("key"), F.col("id").alias("value"))
    step = lambda acc, v: (acc * 31 + v["value"]) % 1_000_003
    expected = result(sorted_fold(df, "key", None, 7, step, "bigint"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        assert result(sorted_fold_py(df, "key", None, 7, step, "bigint")) == expected
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("seed", range(3))
def test_native_equals_python_equals_model(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([None, *range(300)]), rng.choice([None, *range(6)]), rng.randrange(50)) for _ in range(4000)]
    df = spark.createDataFrame(rows, "key int, s int, value int")
    model = {}
    for k, s, v in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        model[k] = (model.get(k, 1) * 31 + v) % 1_000_003
    step = lambda acc, v: (acc * 31 + v["value"]) % 1_000_003
    assert result(sorted_fold(df, "key", ["s", "value"], 1, step, "bigint")) == model
    assert result(sorted_fold_py(df, "key", ["s", "value"], 1, step, "bigint")) == model


BOTH = pytest.mark.parametrize("fold, op", [(fold_from_keyed_start, APPEND), (fold_from_keyed_start_py, append_py)])


def starts(spark, *rows):
    return spark.createDataFrame(list(rows), "key string, start array<int>")


@BOTH
@pytest.mark.parametrize("n", [None, 7])
def test_keyed_start(spark, values, fold, op, n):
    s = starts(spark, ("oak", [0]), ("elm", [99]))
    found = fold(values, s, "key", None, op, "array<int>", start="start", num_partitions=n)
    assert result(found) == {"oak": [0, 3, 8, 21, 40], "elm": [99, -6, 12]}
    if n:
        assert found.rdd.getNumPartitions() == n


@BOTH
def test_keyed_start_placed_by_id(spark, values, fold, op):
    s = starts(spark, ("oak", [0]), ("elm", [99]))
    place = F.when(F.col("key") == "oak", 2).otherwise(0)
    found = fold(values, s, "key", None, op, "array<int>", start="start", num_partitions=4, partition_id=place)
    assert found.rdd.getNumPartitions() == 4
    assert {r["key"]: r["p"] for r in found.withColumn("p", F.spark_partition_id()).collect()} == {"oak": 2, "elm": 0}
    assert result(found) == {"oak": [0, 3, 8, 21, 40], "elm": [99, -6, 12]}


@BOTH
def test_start_without_values_is_the_result(spark, values, fold, op):
    s = starts(spark, ("oak", [0]), ("elm", [99]))
    found = fold(values.filter("key = 'oak'"), s, "key", None, op, "array<int>", start="start")
    assert result(found) == {"oak": [0, 3, 8, 21, 40], "elm": [99]}


@BOTH
def test_values_without_start_fail(spark, values, fold, op):
    found = fold(values, starts(spark, ("oak", [0])), "key", None, op, "array<int>", start="start")
    for action in (found.collect, found.count):
        with pytest.raises(Exception, match="values without a start value.*elm"):
            action()


@BOTH
def test_two_starts_fail(spark, values, fold, op):
    s = starts(spark, ("oak", [0]), ("oak", [7]), ("elm", [99]))
    with pytest.raises(Exception, match="more than one start value.*oak"):
        fold(values, s, "key", None, op, "array<int>", start="start").collect()


@BOTH
def test_keyed_start_empty(spark, values, fold, op):
    assert fold(values.limit(0), starts(spark).limit(0), "key", None, op, "array<int>", start="start").collect() == []


@BOTH
def test_null_start_and_null_key(spark, fold, op):
    values = spark.createDataFrame([(None, 2), (None, 1)], "key string, value int")
    found = fold(values, starts(spark, (None, [0])), "key", None, op, "array<int>", start="start")
    assert result(found) == {None: [0, 1, 2]}


def test_null_start_is_a_start(spark):
    values = spark.createDataFrame([("a", 2)], "key string, value int")
    s = spark.createDataFrame([("a", None), ("b", None)], "k string, start int")
    native = fold_from_keyed_start(values, s, "key", None, lambda acc, v: F.coalesce(acc, F.lit(10)) + v["value"], "int", start="start", start_keys="k")
    python = fold_from_keyed_start_py(values, s, "key", None, lambda acc, v: (acc or 10) + v["value"], "int", start="start", start_keys="k")
    assert result(native) == result(python) == {"a": 12, "b": None}
