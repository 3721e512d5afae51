"""Sorted equi-joins of two to four tables on one key.

A key gives the product of its values on every side.  Full joins keep keys of
any side, inner joins those of all sides, left joins those of the first and
right joins those of the last.  Each side is one struct column; null means that
the side has no row of the key, which differs from a row whose values are null.
Null keys equal each other, and so do NaN keys.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyorder.operators.groups import VALUE
from keyorder.operators.spec import RESERVED, Keyed, Placement, orderable

KINDS = ("full", "inner", "left", "right")
KEY = f"{RESERVED}k"


def sorted_join(
    how: str, *tables: DataFrame, keys: str | Sequence[str] | Sequence[Sequence[str]], names: Sequence[str] | None = None,
    num_partitions: int | None = None, partition_id: Column | None = None,
) -> DataFrame:
    """Key columns (named as in the first table) and a struct for each side, sorted by key, then by the sides in turn.

    ``keys``: the same names for all tables, or a list of them for each.
    ``names`` of the struct columns are ``a``, ``b``, ``c``, ``d`` by default.
    """
    if how not in KINDS:
        raise ValueError(f"how must be one of {KINDS}")
    if not 2 <= len(tables) <= 4:
        raise ValueError("two to four tables can be joined")
    same = isinstance(keys, str) or all(isinstance(k, str) for k in keys)
    sides = [Keyed.of(t, keys if same else keys[i]) for i, t in enumerate(tables)]
    names = tuple(names or "abcd"[: len(tables)])
    for side in sides:
        if not orderable(side.value_type()):
            raise ValueError("values of a sorted join must be orderable")
        if len(side.keys) != len(sides[0].keys):
            raise ValueError("all tables need the same number of keys")
    out_keys = sides[0].keys
    kinds = [sides[0].df.schema[k].dataType for k in out_keys]
    placement = Placement(num_partitions, partition_id)
    on = [KEY, *placement.by]

    def side(i: int) -> DataFrame:
        """The key as one struct, which is never null and equals itself, and the values as another."""
        keyed = sides[i]
        keys = [F.col(k).cast(t).alias(o) for k, t, o in zip(keyed.keys, kinds, out_keys, strict=True)]
        slim = keyed.df.select(*keys, keyed.value().alias(VALUE))
        return slim.select(*out_keys, F.struct(*out_keys).alias(KEY), VALUE)

    def placed(rows: DataFrame, *columns: Column | str) -> DataFrame:
        by = out_keys if partition_id is not None else [KEY]
        return placement.spread(rows, by).select(*on, *columns)

    def values(i: int) -> DataFrame:
        return placed(side(i), F.col(VALUE).alias(names[i]))

    n = len(tables)
    if how == "inner":
        joined = reduce(lambda x, i: x.join(values(i), on, "inner"), range(1, n), values(0))
    elif how == "left":
        joined = reduce(lambda x, i: x.join(values(i), on, "left"), range(1, n), values(0))
    elif how == "right":
        joined = reduce(lambda x, i: x.join(values(i), on, "left"), reversed(range(n - 1)), values(n - 1))
    elif n == 2:
        joined = values(0).join(values(1), on, "full")
    else:
        # All keys once, then left joins on the same partitioning: full joins in
        # a row would lose it with every coalesced key.
        every = placed(reduce(DataFrame.unionByName, [side(i).select(*out_keys, KEY) for i in range(n)])).distinct()
        joined = reduce(lambda x, i: x.join(values(i), on, "left"), range(n), every)
    flat = joined.select(*(F.col(KEY)[k].alias(k) for k in out_keys), *names)
    return flat.sortWithinPartitions(*out_keys, *names)
