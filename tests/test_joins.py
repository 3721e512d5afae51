import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from keyorder.operators import sorted_join
from keyorder.plans import queries as core

R1 = [("p", "w1"), ("p", "w2"), ("q", "w3"), ("t", "w4"), ("u", "w5")]
R2 = [("q", "x1"), ("q", "x2"), ("r", "x3"), ("t", "x4")]
R3 = [("p", "y1"), ("q", "y2"), ("t", "y3"), ("t", "y4"), ("v", "y5")]
R4 = [("p", "z1"), ("q", "z2"), ("q", "z3"), ("r", "z4"), ("t", "z5")]
KINDS = ("full", "inner", "left", "right")


def order(x):
    return (x is not None, x if x is not None else "")


def model(how, sides):
    held = [{} for _ in sides]
    for h, rows in zip(held, sides):
        for k, v in rows:
            h.setdefault(k, []).append(v)
    out = []
    for k in {k for h in held for k in h}:
        present = [k in h for h in held]
        if {"full": True, "inner": all(present), "left": present[0], "right": present[-1]}[how]:
            out += [(k, *row) for row in itertools.product(*(h.get(k, ["absent"]) for h in held))]
    return sorted(out, key=lambda r: [order(x) for x in r])


def tables(spark, sides):
    out = []
    for rows in sides:
        rows = list(rows)
        random.Random(8).shuffle(rows)
        out.append(spark.createDataFrame(rows, "key string, value string"))
    return out


def rows_of(df):
    return [(r[0], *("absent" if x is None else x["value"] for x in r[1:])) for r in df.collect()]


def place(kind):
    if kind == "id":
        return {"num_partitions": 3, "partition_id": F.pmod(F.hash("key"), F.lit(3))}
    return {"num_partitions": 7} if kind == "count" else {}


@pytest.mark.parametrize("how", KINDS)
@pytest.mark.parametrize("n", [2, 3, 4])
@pytest.mark.parametrize("kind", ["default", "count", "id"])
def test_kinds_and_arities(spark, how, n, kind):
    sides = [R1, R2, R3, R4][:n]
    found = sorted_join(how, *tables(spark, sides), keys="key", **place(kind))
    if kind != "default":
        assert found.rdd.getNumPartitions() == {"count": 7, "id": 3}[kind]
    for part in found.rdd.glom().collect():
        got = [tuple(r) for r in part]
        assert got == sorted(got, key=lambda r: [order(x) for x in r])
    assert sorted(rows_of(found), key=lambda r: [order(x) for x in r]) == model(how, sides)


def test_right_join_is_anchored_on_the_last(spark):
    found = rows_of(sorted_join("right", *tables(spark, [R1, R2, R3, R4]), keys="key"))
    assert ("p", "w2", "absent", "y1", "z1") in found and ("r", "absent", "x3", "absent", "z4") in found
    without_r = [r for r in R4 if r[0] != "r"]
    assert {r[0] for r in rows_of(sorted_join("right", *tables(spark, [R1, R2, R3, without_r]), keys="key"))} == {"p", "q", "t"}


@pytest.mark.parametrize("how", KINDS)
@pytest.mark.parametrize("kind", ["default", "id"])
def test_random_many_to_many(spark, how, kind):
    rng = random.Random(3)
    sides = [[(rng.choice(["a", "b", "c", "d", "e", None]), rng.choice("xyz")) for _ in range(rng.randrange(8))] for _ in range(4)]
    found = sorted_join(how, *tables(spark, sides), keys="key", **place(kind))
    assert sorted(rows_of(found), key=lambda r: [order(x) for x in r]) == model(how, sides)


@pytest.mark.parametrize("how", KINDS)
def test_absent_differs_from_null_values(spark, how):
    a = spark.createDataFrame([("k", None), ("l", "x")], "key string, value string")
    b = spark.createDataFrame([("k", None)], "key string, value string")
    found = {r["key"]: r for r in sorted_join(how, a, b, keys="key").collect()}
    assert found["k"]["a"] is not None and found["k"]["a"]["value"] is None and found["k"]["b"] is not None
    assert ("l" in found) == (how in ("full", "left"))
    if "l" in found:
        assert found["l"]["b"] is None


@pytest.mark.parametrize("how", KINDS)
def test_null_and_nan_keys_meet(spark, how):
    rows = [(None, 1), (math.nan, 2), (-0.0, 3)]
    a = spark.createDataFrame(rows, "key double, value int")
    b = spark.createDataFrame([(None, 4), (math.nan, 5), (0.0, 6)], "key double, value int")
    found = sorted_join(how, a, b, keys="key").collect()
    assert sorted((r["a"]["value"], r["b"]["value"]) for r in found) == [(1, 4), (2, 5), (3, 6)]


@pytest.mark.parametrize("how", KINDS)
def test_empty_sides(spark, how):
    a = spark.createDataFrame([("k", "x")], "key string, value string")
    none = a.limit(0)
    assert len(sorted_join(how, a, none, none, keys="key").collect()) == (how in ("full", "left"))
    assert sorted_join(how, none, none, keys="key").collect() == []


def test_names_and_differing_keys(spark):
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    b = spark.createDataFrame([("y", 1)], "w string, id bigint")
    found = sorted_join("inner", a, b, keys=[["k"], ["id"]], names=["one", "two"]).first()
    assert found["k"] == 1 and found["one"]["v"] == "x" and found["two"]["w"] == "y"


def test_wrong_calls(spark):
    a = spark.createDataFrame([("k", "x")], "key string, value string")
    m = spark.createDataFrame([("k", {})], "key string, value map<string,int>")
    for call in (
        lambda: sorted_join("cross", a, a, keys="key"),
        lambda: sorted_join("inner", a, keys="key"),
        lambda: sorted_join("inner", a, a, a, a, a, keys="key"),
        lambda: sorted_join("inner", a, m, keys="key"),
    ):
        with pytest.raises(ValueError):
            call()


@pytest.mark.parametrize("n", [2, 3, 4])
@pytest.mark.parametrize("how", KINDS)
def test_whole_tables_are_joined(spark, data, how, n):
    read = lambda name, *columns: [tuple(r) for r in spark.read.parquet(f"{data}/{name}.parquet").select(*columns).collect()]
    sides = [read("orders", "o_custkey", "o_orderkey"), read("events", "user_id", "event_id"), read("conversations", "conv_id", "turn")]
    sides = [*sides, read("customer", "c_custkey", "c_nationkey")][:n]
    values = [f"{c}v" for c in "abcd"[:n]]
    found = core.queries()[f"join_{how}_{n}"](spark, data).select("k", *values).collect()
    held = [{} for _ in sides]
    for h, rows in zip(held, sides):
        for k, v in rows:
            h.setdefault(k, []).append(v)
    needed = {"full": [], "inner": held, "left": held[:1], "right": held[-1:]}[how]
    keys = [k for k in {k for h in held for k in h} if all(k in h for h in needed)]
    expected = [(k, *row) for k in keys for row in itertools.product(*(h.get(k, [None]) for h in held))]
    by = lambda row: [(x is not None, x or 0) for x in row]
    assert sorted(map(tuple, found), key=by) == sorted(expected, key=by)
