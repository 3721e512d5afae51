"""Approximate nearest neighbours by cross-polytope hashing.

A vector is rotated by three rounds of random signs and a fast Hadamard
transform; its hash is the signed axis nearest to it.  A bucket of a table is a
combination of such hashes, of as many and with as many axes as leave about
``BUCKET_ROWS`` rows to a bucket: hashes get longer as the logarithm of the
rows grows.  A query probes, in each table, the buckets whose axes fall short of
its own nearest axes by at most some sum.  Rows of a probed bucket are scored
exactly, in double precision on the original vectors, and the best of all tables
and buckets are kept.

That sum is the least that reaches ``TARGET`` on a sample of ``TUNING_QUERIES``
queries, whose true neighbours are found among all rows.  Buckets of more than
``PART_ROWS`` rows are split, and their queries go to every part.  Buckets are
dealt to tasks by hash, at most about ``TASK_BYTES`` to each, and a query goes
once to each task that holds some of its buckets.  A query that finds fewer
neighbours than asked for is searched again in all buckets.

Inner products of vectors that aren't of one length are served by the usual
extra coordinate.  Vectors that are null, zero, or hold null or non-finite
components take no part; only vectors of equal dimension meet.  Rows that share
an id are one candidate, and none for a query of that id; ids are integers.
An empty table gives no rows, and only the named columns are read, whatever
others are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyorder.llm.common import materialize, released

TABLES = 2
TARGET = 0.95
TUNING_QUERIES = 128
BUCKET_ROWS = 256
PART_ROWS = 8192
TASK_BYTES = 64 << 20
ROUNDS = 3
SEED = 20
#: Rough scores closer than this, relative to the largest, may be equal in truth; exact scores decide.
SLACK = {np.dtype(np.float32): 2e-6, np.dtype(np.float64): 1e-12}


@lru_cache(maxsize=64)
def _signs(dim: int, width: int, table: int, part: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim, table, part]).choice([-1.0, 1.0], (ROUNDS, width))


@dataclass(frozen=True)
class Rotations:
    """Hashes of vectors of one dimension; ``longest``: the largest norm, if norms differ."""

    dim: int
    rows: int
    longest: float | None

    @property
    def width(self) -> int:
        return 1 << max(0, (self.dim + (self.longest is not None) - 1)).bit_length()

    @cached_property
    def axes(self) -> tuple[int, ...]:
        """Signed axes of each hash of a bucket; the last may use a part of the coordinates."""
        out = [2 * self.width]
        while (missing := self.rows / BUCKET_ROWS / np.prod(out)) > 1:
            out.append(min(2 * self.width, max(2, 1 << int(np.ceil(np.log2(missing))))))
        return tuple(out)

    def coordinates(self, x: np.ndarray, table: int, query: bool) -> list[np.ndarray]:
        """For each hash, coordinates on its signed axes: column 2i is -axis i, column 2i + 1 is +axis i."""
        whole = np.zeros((len(x), self.width))
        whole[:, : self.dim] = x
        if self.longest is not None:
            norm = np.sqrt(np.einsum("ij,ij->i", whole, whole))
            if query:
                whole /= np.maximum(norm, 1e-300)[:, None]
            else:
                whole /= self.longest
                whole[:, self.dim] = np.sqrt(np.maximum(0, 1 - (norm / self.longest) ** 2))
        made = []
        for part, axes in enumerate(self.axes):
            out = whole
            for s in _signs(self.dim, self.width, table, part):
                out = hadamard(out * s)
            out = out[:, : axes // 2]
            made.append(np.stack([-out, out], 2).reshape(len(x), axes))
        return made

    def codes(self, x: np.ndarray, table: int) -> list[np.ndarray]:
        return [np.argmax(c, 1) for c in self.coordinates(x, table, query=False)]

    def buckets(self, x: np.ndarray, table: int) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        for code, axes in zip(self.codes(x, table), self.axes, strict=True):
            out = out * axes + code
        return out

    def shortfalls(self, x: np.ndarray, table: int) -> list[np.ndarray]:
        """How far each axis of each hash falls short of the query's nearest one."""
        return [c.max(1, keepdims=True) - c for c in self.coordinates(x, table, query=True)]

    def probes(self, shortfalls: list[np.ndarray], most: float) -> np.ndarray:
        """Buckets of one query whose shortfalls sum up to ``most`` at most."""
        code, total = np.zeros(1, np.int64), np.zeros(1)
        for short, axes in zip(shortfalls, self.axes, strict=True):
            sums = total[:, None] + short[None, :]
            i, j = np.nonzero(sums <= most)
            code, total = code[i] * axes + j, sums[i, j]
        return code


def hadamard(x: np.ndarray) -> np.ndarray:
    n, h = x.shape[1], 1
    while h < n:
        pairs = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def _vectors(column: pa.Array) -> np.ndarray:
    """List column of one dimension."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, vectors, is query) of each dimension in a batch of (id, vector, is query)."""
    dims = np.asarray(batch.column(1).value_lengths().to_numpy(zero_copy_only=False))
    for dim in np.unique(dims).tolist():
        part = batch.filter(pa.array(dims == dim))
        yield part.column(0).to_numpy(zero_copy_only=False), _vectors(part.column(1)), part.column(2).to_numpy(zero_copy_only=False)


def _best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best distinct ids of each query: largest score first, ties to the smaller id; ``own`` ids don't count."""
    order = np.lexsort((-scores, ids, query))
    q, i = query[order], ids[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (np.diff(q) != 0) | (np.diff(i) != 0)
    order = order[fresh & (i != own[q])]
    order = order[np.lexsort((ids[order], -scores[order], query[order]))]
    q = query[order]
    first = np.searchsorted(q, q)
    return order[np.arange(len(order)) - first < k]


def _exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows, the same for the same two rows wherever they stand."""
    return np.add.reduce(x.astype(np.float64) * q.astype(np.float64), axis=1)


def _copies(*columns: np.ndarray) -> int:
    """How often the most frequent row of the columns occurs."""
    order = np.lexsort(columns)
    change = np.logical_or.reduce([np.diff(c[order]) != 0 for c in columns])
    return int(np.diff(np.flatnonzero(np.concatenate([[True], change, [True]]))).max(initial=1))


def _near(x: np.ndarray, q: np.ndarray, take: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, rough score) of all rows that may be among the first ``take`` of each query."""
    rough = q @ x.T
    if len(x) <= take:
        floor = np.full(len(q), -np.inf)
    else:
        slack = SLACK[rough.dtype] * np.maximum(1e-300, np.abs(rough).max(1, initial=0))
        floor = np.partition(rough, len(x) - take, axis=1)[:, len(x) - take] - 2 * slack
    query, row = np.nonzero(rough >= floor[:, None])
    return query, row, rough[query, row]


class _Held:
    """The rows of one dimension that a task holds, by the bucket parts in which they lie."""

    def __init__(self, units: list[np.ndarray], ids: list[np.ndarray], x: list[np.ndarray]):
        units, self.ids, self.x = np.concatenate(units), np.concatenate(ids), np.concatenate(x)
        self.copies = _copies(self.ids), _copies(units, self.ids)  # of an id, here and in one unit
        self.units, starts = np.unique(units, return_index=True)  # rows come sorted by them
        self.starts = np.append(starts, len(units))

    def answer(self, own: np.ndarray, q: np.ndarray, asked: list[np.ndarray | None], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of the k best rows here of each query, among the units that it asks for (None: all), by query."""
        who = np.repeat(np.arange(len(q)), [len(self.units) if a is None else len(a) for a in asked])
        unit = np.concatenate([self.units if a is None else a for a in asked]) if asked else np.empty(0, np.int64)
        at = np.searchsorted(self.units, unit)
        there = at < len(self.units)
        there[there] = self.units[at[there]] == unit[there]
        who, at = who[there], at[there]
        order = np.argsort(at, kind="stable")
        who, at = who[order], at[order]
        cuts = np.flatnonzero(np.diff(at, prepend=-1, append=-1))
        query, row, rough = [], [], []
        for a, b in zip(cuts, cuts[1:]):
            lo, hi = self.starts[at[a]], self.starts[at[a] + 1]
            i, j, r = _near(self.x[lo:hi], q[who[a:b]], (k + 1) * self.copies[1])  # its own id is one of them
            query.append(who[a:b][i])
            row.append(j + lo)
            rough.append(r)
        if not query:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        query, row, rough = np.concatenate(query), np.concatenate(row), np.concatenate(rough)
        # Of all that, what may be among the best of the whole task.
        slack = SLACK[rough.dtype] * max(1e-300, float(np.abs(rough).max()))
        order = np.lexsort((-rough, query))
        query, row, rough = query[order], row[order], rough[order]
        last = np.minimum(np.searchsorted(query, query) + (k + 1) * self.copies[0], np.searchsorted(query, query, side="right")) - 1
        some = rough >= rough[last] - 2 * slack
        query, row = query[some], row[some]
        scores = _exact(self.x[row], q[query])
        best = _best(query, self.ids[row], scores, own, k)
        return query[best], self.ids[row[best]], scores[best]


def _mixed(values: np.ndarray) -> np.ndarray:
    h = values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _lists(flat: pa.Array, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), flat)


def _unit(dim: int, table: int, bucket: np.ndarray, part: np.ndarray) -> np.ndarray:
    """An id of a part of a bucket of a table, by hash: two in one may meet, which costs a comparison and errs in nothing."""
    return (_mixed(_mixed(bucket + (np.int64(dim) << 8) + table) ^ part.astype(np.uint64)) >> np.uint64(1)).astype(np.int64)


def _dealt(rows: DataFrame, rotations: dict[int, Rotations], most: dict[int, float], parts: dict[tuple[int, int, int], int], tables: int, places: int) -> DataFrame:
    """(place, kind, unit, id, vector, units): each vector in a place for each table, each query in every place that holds units of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["place", "kind", "unit", "id", "vector", "units"]
        for batch in batches:
            for begin in range(0, len(batch), 512):
                for ids, x, query in _by_dim(batch.slice(begin, 512)):
                    r, n = rotations[x.shape[1]], len(ids)
                    split = lambda table, buckets: np.array([parts.get((r.dim, table, b), 1) for b in buckets.tolist()], np.int64) if parts else np.ones(len(buckets), np.int64)  # noqa: B023, E731
                    flat = pa.array(x.reshape(-1))
                    for table in range(tables):
                        bucket = r.buckets(x, table)
                        part = (_mixed(ids) % split(table, bucket).astype(np.uint64)).astype(np.int64)
                        unit = _unit(r.dim, table, bucket, part)
                        place = (_mixed(unit) % np.uint64(places)).astype(np.int32)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(place), pa.array(np.zeros(n, np.int32)), pa.array(unit), pa.array(ids), _lists(flat, np.full(n, r.dim)), pa.nulls(n, pa.list_(pa.int64()))], names
                        )
                    asked = np.flatnonzero(query)
                    short = [r.shortfalls(x[asked], table) for table in range(tables)] if len(asked) else []
                    at_place, asker, wanted = [], [], []
                    for j, row in enumerate(asked.tolist()):
                        if np.isinf(most[r.dim]):  # every bucket of one table, wherever it is
                            at_place.append(np.arange(places))
                            asker.append(np.full(places, row))
                            wanted += [None] * places
                            continue
                        units = []
                        for table in range(tables):
                            probed = r.probes([s[j] for s in short[table]], most[r.dim])
                            times = split(table, probed)
                            part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                            units.append(_unit(r.dim, table, np.repeat(probed, times), part))
                        units = np.concatenate(units)
                        place = (_mixed(units) % np.uint64(places)).astype(np.int64)
                        order = np.argsort(place, kind="stable")
                        where, first = np.unique(place[order], return_index=True)
                        at_place.append(where)
                        asker.append(np.full(len(where), row))
                        wanted += np.split(units[order], first[1:])
                    if at_place:
                        place, who, units = np.concatenate(at_place).astype(np.int32), np.concatenate(asker), wanted
                        for lo in range(0, len(place), 4096):
                            some, lists = who[lo : lo + 4096], units[lo : lo + 4096]
                            yield pa.RecordBatch.from_arrays(
                                [
                                    pa.array(place[lo : lo + 4096]), pa.array(np.ones(len(some), np.int32)), pa.array(np.full(len(some), r.dim, np.int64)), pa.array(ids[some]),
                                    _lists(pa.array(x[some].reshape(-1)), np.full(len(some), r.dim)), pa.array(lists, pa.list_(pa.int64())),
                                ],
                                names,
                            )

    kinds = [("place", T.IntegerType()), ("kind", T.IntegerType()), ("unit", T.LongType()), ("id", T.LongType())]
    schema = T.StructType([*(T.StructField(n, t) for n, t in kinds), rows.schema["vector"], T.StructField("units", T.ArrayType(T.LongType()))])
    return rows.mapInArrow(released(run), schema)


def _search(dealt: DataFrame, k: int, places: int) -> DataFrame:
    """(query_id, ids, scores): the k best that each place holds for each query that comes there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh: dict[int, tuple[list, list, list]] = {}
        held: dict[int, _Held] = {}
        for batch in batches:
            kind = batch.column(0).to_numpy()
            dims = np.asarray(batch.column(3).value_lengths().to_numpy(zero_copy_only=False))
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero((kind == 0) & (dims == dim))
                if len(rows):
                    part = batch.take(pa.array(rows))
                    for column, value in zip(fresh.setdefault(dim, ([], [], [])), (part.column(1).to_numpy(), part.column(2).to_numpy(), _vectors(part.column(3))), strict=True):
                        column.append(value)
                rows = np.flatnonzero((kind == 1) & (dims == dim))
                if not len(rows):
                    continue
                if dim in fresh:  # all rows are there by now
                    held[dim] = _Held(*fresh.pop(dim))
                if dim not in held:
                    continue
                for lo in range(0, len(rows), 256):
                    part = batch.take(pa.array(rows[lo : lo + 256]))
                    own = part.column(2).to_numpy()
                    asked = [None if not u.is_valid else u.values.to_numpy() for u in part.column(4)]
                    query, ids, scores = held[dim].answer(own, _vectors(part.column(3)), asked, k)
                    some, first = np.unique(query, return_index=True)
                    lengths = np.diff(np.append(first, len(query)))
                    yield pa.RecordBatch.from_arrays([pa.array(own[some]), _lists(pa.array(ids), lengths), _lists(pa.array(scores), lengths)], ["query_id", "ids", "scores"])

    laid = dealt.repartitionById(places, "place").sortWithinPartitions("kind", "unit").select("kind", "unit", "id", "vector", "units")
    return laid.mapInArrow(released(run), "query_id long, ids array<long>, scores array<double>")


def _merge(found: DataFrame, k: int) -> DataFrame:
    """The k best of all that the places found for a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, ids, scores = [], [], []

        def close(cut: int) -> Iterator[pa.RecordBatch]:
            """All but the rows from ``cut`` on, whose query may go on."""
            q, lengths = np.concatenate(who), np.concatenate([np.diff(i.offsets.to_numpy()) for i in ids])
            flat = [np.concatenate([c.flatten().to_numpy() for c in columns]) for columns in (ids, scores)]
            done = int(lengths[:cut].sum())
            some, at = np.unique(np.repeat(q[:cut], lengths[:cut]), return_inverse=True)
            i, s = flat[0][:done], flat[1][:done]
            best = _best(at, i, s, some, k)
            lengths_out = np.bincount(at[best], minlength=len(some))
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(some), _lists(pa.array(i[best]), lengths_out), _lists(pa.array(s[best]), lengths_out)], ["query_id", "ids", "scores"])
            who[:], ids[:], scores[:] = [q[cut:]], [_lists(pa.array(flat[0][done:]), lengths[cut:])], [_lists(pa.array(flat[1][done:]), lengths[cut:])]

        for batch in batches:
            if len(batch):
                who.append(batch.column(0).to_numpy())
                ids.append(pa.concat_arrays([batch.column(1)]))
                scores.append(pa.concat_arrays([batch.column(2)]))
                q = np.concatenate(who)
                yield from close(int(np.searchsorted(q, q[-1])))
        if who:
            yield from close(sum(map(len, who)))

    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found.repartition(n, "query_id").sortWithinPartitions("query_id").mapInArrow(released(run), found.schema)


def _tuned(rows: DataFrame, rotations: dict[int, Rotations], k: int, tables: int) -> dict[int, float]:
    """For each dimension, the least sum of shortfalls within which TARGET of the sampled queries' true neighbours lie."""
    sampled = rows.filter("query").orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(TUNING_QUERIES).collect()
    queries: dict[int, list] = {}
    for r in sampled:
        queries.setdefault(len(r["vector"]), []).append((r["id"], r["vector"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x, _ in _by_dim(batch):
                r = rotations[x.shape[1]]
                if r.dim not in queries:
                    continue
                own, q = np.array([i for i, _ in queries[r.dim]]), np.array([v for _, v in queries[r.dim]], x.dtype)
                query, row, _ = _near(x, q, (k + 1) * _copies(ids))
                scores = _exact(x[row], q[query])
                best = _best(query, ids[row], scores, own, k)
                query, row, scores = query[best], row[best], scores[best]
                least = np.full(len(row), np.inf)
                for t in range(tables):
                    short, codes = r.shortfalls(q, t), r.codes(x, t)
                    least = np.minimum(least, sum(s[query, c[row]] for s, c in zip(short, codes, strict=True)))
                columns = (np.full(len(row), r.dim, np.int32), query.astype(np.int32), ids[row], scores, least)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["d", "q", "id", "score", "short"])

    near = rows.mapInArrow(released(run), "d int, q int, id long, score double, short double")
    first = F.row_number().over(Window.partitionBy("d", "q").orderBy(F.desc("score"), "id"))
    known: dict[int, list[float]] = {}
    for r in near.withColumn("_k", first).filter(F.col("_k") <= k).select("d", "short").collect():
        known.setdefault(r["d"], []).append(r["short"])
    out = {}
    for d in rotations:
        short = sorted(known.get(d, []))
        out[d] = short[min(len(short) - 1, int(np.ceil(TARGET * len(short))))] + 1e-9 if short else np.inf
    return out


def nearest(df: DataFrame, id_col: str, vector_col: str, is_query: Column, k: int = 20, tables: int = TABLES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for every query row, by inner product."""
    spark = df.sparkSession
    kind = df.schema[vector_col].dataType
    element = kind.elementType if isinstance(kind.elementType, T.FloatType) else T.DoubleType()
    vector = F.col(vector_col).cast(T.ArrayType(element))
    rows = df.filter(F.col(id_col).isNotNull() & usable(vector)).select(
        F.col(id_col).cast("long").alias("id"), vector.alias("vector"), F.coalesce(is_query, F.lit(False)).alias("query")
    )
    norm = F.sqrt(F.aggregate(F.col("vector").cast("array<double>"), F.lit(0.0), lambda a, v: a + v * v))
    # A row for each dimension that occurs.
    seen = rows.groupBy(F.size("vector").alias("d")).agg(F.min(norm).alias("lo"), F.max(norm).alias("hi"), F.count("*").alias("n")).collect()
    rotations = {r["d"]: Rotations(r["d"], r["n"], r["hi"] if r["lo"] < 0.999 * r["hi"] else None) for r in seen}
    held = sum(r["n"] * tables * (r["d"] * 8 + 16) for r in seen)
    places = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held // TASK_BYTES))
    most = _tuned(rows, rotations, k, tables)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x, _ in _by_dim(batch):
                r = rotations[x.shape[1]]
                for table in range(tables):
                    bucket, n = np.unique(r.buckets(x, table), return_counts=True)
                    columns = (np.full(len(n), r.dim, np.int32), np.full(len(n), table, np.int32), bucket, n.astype(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["d", "t", "b", "c"])

    full = rows.mapInArrow(count, "d int, t int, b long, c long").groupBy("d", "t", "b").agg(F.sum("c").alias("c")).filter(F.col("c") > PART_ROWS)
    # At most one row for PART_ROWS vectors of a table.
    parts = {(r["d"], r["t"], r["b"]): -(-r["c"] // PART_ROWS) for r in full.collect()}
    found = _merge(_search(_dealt(rows, rotations, most, parts, tables, places), k, places), k)
    found = materialize(found, "ann-found")
    enough = F.lit(0)
    for r in seen:
        enough = F.when(F.size("vector") == r["d"], F.lit(min(k, r["n"] - 1))).otherwise(enough)
    asked = rows.filter("query").select("id", enough.alias("enough"))
    short = asked.join(found.select(F.col("query_id").alias("id"), F.size("ids").alias("n")), "id", "left").filter(F.coalesce("n", F.lit(0)) < F.col("enough"))
    if short.limit(1).count():
        again = rows.join(short.select(F.col("id").alias("again")).distinct(), F.col("id") == F.col("again"), "left")
        again = again.select("id", "vector", F.col("again").isNotNull().alias("query"))
        everywhere = dict.fromkeys(rotations, np.inf)
        whole = _merge(_search(_dealt(again, rotations, everywhere, parts, 1, places), k, places), k)
        found = found.join(whole.select("query_id"), "query_id", "left_anti").unionByName(whole)
    return found.select("query_id", F.posexplode(F.arrays_zip("ids", "scores")).alias("rank", "hit")).select(
        "query_id", (F.col("rank") + 1).alias("rank"), F.col("hit.ids").alias("vec_id"), F.col("hit.scores").alias("score")
    )
