"""One pass over rows sorted by key, in Arrow batches, with state for the current key only.

Python operations see a key's rows as they stream by, so a group never has to
fit in memory and may cross any number of batches.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of an output batch.
FLUSH_ROWS = 10_000


class Group:
    """What happens to one key.  Each step may emit output rows; ``rows`` is called once for each batch that the key is in."""

    def open(self, key: tuple) -> Iterable[tuple]:
        return ()

    def rows(self, rows: Iterable[tuple]) -> Iterable[tuple]:
        return ()

    def close(self) -> Iterable[tuple]:
        return ()


def same_key(a: tuple, b: tuple) -> bool:
    """Equality under which null equals null and NaN equals NaN, as in Spark's grouping."""
    return all(
        x == y or (isinstance(x, float) and isinstance(y, float) and math.isnan(x) and math.isnan(y))
        for x, y in zip(a, b, strict=True)
    )


def changed(column: pa.Array) -> np.ndarray:
    """For each row but the first: whether it differs from the row before, in the sense of ``same_key``."""
    n, kind = len(column) - 1, column.type
    if pa.types.is_nested(kind):
        plain = column.to_pylist()
        return np.fromiter((not same_key((x,), (y,)) for x, y in pairwise(plain)), bool, n)
    a, b = column.slice(1), column.slice(0, n)
    differs = pc.fill_null(pc.not_equal(a, b), False)
    if pa.types.is_floating(kind):
        differs = pc.and_not(differs, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
    return pc.or_(differs, pc.xor(a.is_null(), b.is_null())).to_numpy(zero_copy_only=False)


def stream(batches: Iterator[pa.RecordBatch], keys: int, make: Callable[[], Group]) -> Iterator[tuple]:
    """Output rows of a partition whose rows come sorted by their first ``keys`` columns."""
    group: Group | None = None
    current: tuple = ()
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        breaks = np.logical_or.reduce([changed(c) for c in batch.columns[:keys]]) if n > 1 else np.empty(0, bool)
        cuts = [0, *(np.flatnonzero(breaks) + 1).tolist(), n]
        heads = list(zip(*(c.take(pa.array(cuts[:-1])).to_pylist() for c in batch.columns[:keys]), strict=True))
        rows = list(zip(*(c.to_pylist() for c in batch.columns[keys:]), strict=True))
        for key, (a, b) in zip(heads, pairwise(cuts), strict=True):
            if group is None or not same_key(key, current):
                if group is not None:
                    yield from group.close()
                group, current = make(), key
                yield from group.open(key)
            yield from group.rows(rows[a:b])
    if group is not None:
        yield from group.close()


def run(sorted_rows: DataFrame, keys: int, make: Callable[[], Group], schema: T.StructType) -> DataFrame:
    """``make`` a group for every key of rows laid out by key; nothing is shuffled here."""
    arrow = to_arrow_schema(schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = zip(*held, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for row in stream(batches, keys, make):
            held.append(row)
            if len(held) >= FLUSH_ROWS:
                yield batch()
                held = []
        if held:
            yield batch()

    return sorted_rows.mapInArrow(task, schema)
