import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyorder.llm import ann, queries


def brute(ids, x, query, k=20):
    scores = (x * x[query]).sum(1)
    order = [i for i in np.lexsort((ids, -scores)).tolist() if ids[i] != ids[query]]
    return [int(ids[i]) for i in order[:k]], scores


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    found = {}
    for r in queries.op10_cross_polytope(spark, sf).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r)
    recall = []
    for q in np.flatnonzero(ids % 20 == 0).tolist():
        best, scores = brute(ids, x, q)
        got = found[int(ids[q])]
        assert [r["rank"] for r in got] == list(range(1, len(got) + 1))
        keys = [(-r.score, r.vec_id) for r in got]
        assert keys == sorted(keys)
        by = dict(zip(ids.tolist(), scores.tolist(), strict=True))
        assert all(math.isclose(r.score, by[r.vec_id], abs_tol=1e-12) for r in got)
        recall.append(len({r.vec_id for r in got} & set(best)) / len(best))
    assert len(found) == len(recall) and np.mean(recall) >= 0.9


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int").coalesce(2)


def search(df, k=20):
    out = {}
    for r in ann.nearest(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0, k).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


def test_all_candidates_when_few(spark):
    rng = np.random.default_rng(1)
    df = frame(spark, [(i, rng.normal(size=8).tolist(), 0) for i in range(10)])
    found = search(df)
    assert set(found) == {0} and sorted(found[0]) == list(range(1, 10))


def test_unusable_vectors_take_no_part(spark):
    bad = [None, [0.0, 0.0], [1.0, None], [math.nan, 1.0], [math.inf, 1.0], []]
    rows = [(20 * i, v, 0) for i, v in enumerate(bad)] + [(200, [1.0, 0.0], 0), (201, [1.0, 0.0], 0), (None, [1.0, 0.0], 0), (203, [1.0, 0.0, 0.0], 0)]
    assert search(frame(spark, rows)) == {200: [201]}
    assert search(frame(spark, rows[:6])) == {}
    assert search(frame(spark, rows).limit(0)) == {}


def test_ties_go_to_smaller_ids_and_large_groups_are_whole(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [0.6, 0.8, 0.0, 0.0], 0) for i in range(300)] + [(300 + i, v.tolist(), 0) for i, v in enumerate(rng.normal(size=(100, 4)))]
    old = ann.PART_ROWS
    ann.PART_ROWS = 50
    try:
        found = search(frame(spark, [r for r in rows if r[0] < 300]))
    finally:
        ann.PART_ROWS = old
    assert found[0] == list(range(1, 21)) and found[20] == [*range(20)]
    assert found[100] == list(range(20))
    assert set(search(frame(spark, rows))) == {r[0] for r in rows if r[0] % 20 == 0}


def test_repeated_ids_are_one_candidate(spark):
    rows = [(0, [1.0, 0.0], 0), (0, [0.9, 0.1], 0), (1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [0.5, 0.5], 0)]
    assert search(frame(spark, rows), k=3)[0] == [1, 2]


def test_lengths_that_differ(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 12)) * rng.uniform(0.2, 4, (400, 1))
    x = x.astype(np.float32)
    found = search(frame(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)]))
    ids = np.arange(400)
    recall = [len(set(found[q]) & set(brute(ids, x.astype(np.float64), q)[0])) / 20 for q in range(0, 400, 20)]
    assert np.mean(recall) >= 0.9


def test_hashes_get_longer_with_the_logarithm_of_the_rows():
    assert ann.Rotations(64, 1000, None).axes == (128,)
    assert ann.Rotations(64, 128 * ann.BUCKET_ROWS + 1, None).axes == (128, 2)
    assert ann.Rotations(64, 10**6, None).axes == (128, 32)
    assert ann.Rotations(64, 10**9, None).axes == (128, 128, 128, 2)
    for axes in ((8,), (8, 2), (8, 8, 4)):
        r = ann.Rotations(4, 1, None)
        r.__dict__["axes"] = axes
        x = np.random.default_rng(6).normal(size=(3, 4))
        short = r.shortfalls(x, 0)
        assert np.array_equal([r.probes([s[i] for s in short], 1e-12)[0] for i in range(3)], r.buckets(x, 0))
        sums = np.zeros((3, 1))
        for s in short:
            sums = (sums[:, :, None] + s[:, None, :]).reshape(3, -1)
        for most in (0.5, 1.5, np.inf):
            assert [sorted(r.probes([s[i] for s in short], most)) for i in range(3)] == [np.flatnonzero(v <= most).tolist() for v in sums]


@pytest.mark.parametrize("bucket_rows", [2, 20])
def test_longer_hashes_find_the_neighbours(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(ann, "BUCKET_ROWS", bucket_rows)
    monkeypatch.setattr(ann, "TASK_BYTES", 20_000)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 8))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    assert len(ann.Rotations(8, 3000, None).axes) > 1
    found = search(frame(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)]))
    recall = [len(set(found[q]) & set(brute(np.arange(3000), x.astype(np.float64), q)[0])) / 20 for q in range(0, 3000, 20)]
    assert np.mean(recall) >= 0.9


def test_doubles_of_any_size(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 5)) * 1e60
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, rank int")
    found = search(df)
    recall = [len(set(found[q]) & set(brute(np.arange(300), x, q)[0])) / 20 for q in range(0, 300, 20)]
    assert np.mean(recall) >= 0.9


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(4).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(ann.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(ann.hadamard(ann.hadamard(x)), x)
