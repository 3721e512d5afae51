"""Sorted group-by-key: each key with all its values, in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyorder.functions.order import Order, comparator
from keyorder.operators.spec import RESERVED, Keyed, Ordering, Placement, orderable

VALUE = f"{RESERVED}v"


def sorted_values(rows: Column, named: list, value_type: T.StructType) -> Column:
    """An array of {sort columns, value} as the array of values, in order.

    The sort stands inside the aggregate, so it holds whatever order rows arrive
    in.  Ties are broken by the value, left to right, where it can be ordered.
    """
    whole = orderable(value_type)
    if whole and all(o.plain for _, o in named):
        ordered = F.sort_array(rows)
    else:
        ties = [(VALUE, Order(F.lit(0)))] if whole else []
        ordered = F.array_sort(rows, comparator([*named, *ties]))
    return F.transform(ordered, lambda x: x[VALUE])


def collected(keyed: Keyed, order_by: Sequence[Ordering] | Ordering | None, placement: Placement) -> DataFrame:
    """Keys and ``__ko_values``: one exchange, one aggregate."""
    slim, named = keyed.slim(keyed.orders(order_by))
    rows = F.collect_list(F.struct(*(n for n, _ in named), VALUE))
    return placement.spread(slim, keyed.keys).groupBy(*keyed.keys, *placement.by).agg(sorted_values(rows, named, keyed.value_type()).alias(f"{RESERVED}values"))


def laid_out(keyed: Keyed, order_by: Sequence[Ordering] | Ordering | None, placement: Placement) -> DataFrame:
    """Keys and value struct, placed by key and sorted by key and value order: one exchange, one sort."""
    slim, named = keyed.slim(keyed.orders(order_by))
    ties = [VALUE] if orderable(keyed.value_type()) else []
    placed = placement.apply(slim, keyed.keys)
    return placed.sortWithinPartitions(*keyed.keys, *(o.sort_column(F.col(n)) for n, o in named), *ties).select(*keyed.keys, VALUE)


def sorted_groups(
    df: DataFrame, keys: str | Sequence[str], order_by: Sequence[Ordering] | Ordering | None = None, *,
    values: Sequence[str] | None = None, num_partitions: int | None = None, partition_id: Column | None = None, into: str = "values",
) -> DataFrame:
    """One row a key: the key columns and ``into``, an array of value structs in order.

    Without ``order_by`` values sort by all their columns, left to right; rows
    with null values are kept, and null keys are one group.  Partitions hold
    their keys in ascending order.  ``num_partitions`` gives exactly so many
    partitions; ``partition_id``, a column that depends on the key alone,
    chooses the partition.
    """
    keyed = Keyed.of(df, keys, values)
    grouped = collected(keyed, order_by, Placement(num_partitions, partition_id))
    return grouped.select(*keyed.keys, F.col(f"{RESERVED}values").alias(into)).sortWithinPartitions(*keyed.keys)
