import zlib

import pytest
from pyspark.sql import functions as F

from keyorder.llm import queries, sharding


def check(rows, shards, tolerance):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    total = sum(r.size for r in rows)
    for shard, held in by.items():
        assert 0 <= shard < shards
        assert sorted(r.slot for r in held) == list(range(len(held)))
        assert abs(sum(r.size for r in held) - total / shards) <= tolerance


def test_query(spark, data):
    docs = {r.doc_id: r.text for r in queries.documents(spark, data).collect()}
    rows = queries.op7_sampled_splitters(spark, data).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        text = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text) + 1, zlib.crc32(text), "bytes", None)
    check(rows, 16, 2 * max(r.size for r in rows))


def test_equal_texts_stay_together_and_a_large_group_is_split(spark):
    small = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 1000).alias("text"))
    large = spark.range(3000, 9000).select(F.col("id").alias("doc_id"), F.lit("the same text").alias("text"))
    rows = sharding.shard(small.unionByName(large), "doc_id", "text", 8).collect()
    check(rows, 8, 0.03 * sum(r.size for r in rows) / 8 + 30)
    homes = {}
    for r in rows:
        homes.setdefault(r.text_crc32, set()).add(r.shard)
    assert len(homes.pop(zlib.crc32(b"the same text"))) > 4
    assert sum(len(h) > 1 for h in homes.values()) == 0


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, None), (1, None), (None, ""), (2, "x" * 200_000)]])
def test_few_rows(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS size", "2 AS shard", "3 AS key")
    found = sharding.shard(df, "doc_id", "text", 4).collect()
    assert len(found) == len(rows)
    check(found, 4, 10**6)


def test_ranges_by_binary_search(spark):
    cuts = [-5, 0, 7, 100]
    keys = [-9, -5, -4, 0, 1, 7, 8, 100, 101]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    import bisect

    assert [r[0] for r in df.select(sharding.range_of(F.col("k"), cuts)).collect()] == [bisect.bisect_left(cuts, k) for k in keys]


def test_no_python(spark, data):
    plan = queries.op7_sampled_splitters(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
