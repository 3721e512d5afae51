"""Operators that bring a second table, with one row a key: start values and resources.

Both tables become one stream of tagged rows, so a single exchange and sort
brings each key's side row ahead of its values, and the rules are checked as the
rows pass:

=========================  ======================  ================
a key has                  start values            resources
=========================  ======================  ================
a side row and values      folded from it          applied
values, no side row        error                   error
a side row, no values      the start is the result error
two side rows              error                   error
=========================  ======================  ================

Errors are raised by the tasks and name the key; an action that reads only part
of the result may not meet them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyorder.operators import arrow
from keyorder.operators.fold import data_type
from keyorder.operators.groups import VALUE, sorted_values
from keyorder.operators.spec import RESERVED, Keyed, Ordering, Placement, orderable

TAG, SIDE = f"{RESERVED}tag", f"{RESERVED}side"

NO_START = "values without a start value"
TWO_STARTS = "more than one start value"
NO_RESOURCE = "values without a resource"
TWO_RESOURCES = "more than one resource"
NO_VALUES = "a resource without values"


def _tagged(keyed: Keyed, side: Keyed, order_by: Sequence[Ordering] | Ordering | None) -> tuple[DataFrame, list]:
    """Both tables as rows of keys, tag (0 for side rows), side struct, sort columns and value struct."""
    if len(keyed.keys) != len(side.keys):
        raise ValueError("both tables need the same number of keys")
    slim, named = keyed.slim(keyed.orders(order_by))
    rows = slim.withColumns({TAG: F.lit(1), SIDE: F.lit(None).cast(side.value_type())})
    keys = [F.col(s).cast(keyed.df.schema[k].dataType).alias(k) for k, s in zip(keyed.keys, side.keys, strict=True)]
    heads = side.df.select(*keys, F.lit(0).alias(TAG), side.value().alias(SIDE))
    return rows.unionByName(heads, allowMissingColumns=True), named


def _key_text(keys: Sequence[str]) -> Column:
    return F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})


def _failed(message: str, keys: Sequence[str]) -> Column:
    return F.raise_error(F.concat(F.lit(f"{message}: key "), _key_text(keys))).cast("boolean")


def _layout(tagged: DataFrame, named: list, keyed: Keyed, placement: Placement) -> DataFrame:
    ties = [VALUE] if orderable(keyed.value_type()) else []
    return placement.apply(tagged, keyed.keys).sortWithinPartitions(
        *keyed.keys, TAG, *(o.sort_column(F.col(n)) for n, o in named), *ties
    )


def fold_from_keyed_start(
    df: DataFrame, starts: DataFrame, keys: str | Sequence[str], order_by: Sequence[Ordering] | Ordering | None,
    op: Callable[[Column, Column], Column], result_type: str | T.DataType, *, start: str | None = None,
    start_keys: str | Sequence[str] | None = None, values: Sequence[str] | None = None, num_partitions: int | None = None,
    partition_id: Column | None = None, into: str = "result",
) -> DataFrame:
    """As ``sorted_fold``, each key from its own start: column ``start`` of its row in ``starts`` (all its value columns as a struct without one)."""
    keyed = Keyed.of(df, keys, values)
    side = Keyed.of(starts, keyed.keys if start_keys is None else start_keys, [start] if start else None)
    kind = data_type(result_type)
    tagged, named = _tagged(keyed, side, order_by)
    placement = Placement(num_partitions, partition_id)
    is_value = F.col(TAG) == 1
    gathered = placement.spread(tagged, keyed.keys).groupBy(*keyed.keys, *placement.by).agg(
        F.count_if(~is_value).alias(f"{RESERVED}starts"),
        F.first(F.when(~is_value, F.struct(SIDE)), ignorenulls=True).alias(f"{RESERVED}start"),
        sorted_values(F.collect_list(F.when(is_value, F.struct(*(n for n, _ in named), VALUE))), named, keyed.value_type()).alias(f"{RESERVED}values"),
    )
    n = F.col(f"{RESERVED}starts")
    checked = gathered.filter(
        F.when(n == 0, _failed(NO_START, keyed.keys)).when(n > 1, _failed(TWO_STARTS, keyed.keys)).otherwise(F.lit(True))
    )
    first = F.col(f"{RESERVED}start")[SIDE]
    first = (first[start] if start else first).cast(kind)
    folded = F.aggregate(f"{RESERVED}values", first, lambda acc, v: op(acc, v).cast(kind))
    return checked.select(*keyed.keys, folded.alias(into)).sortWithinPartitions(*keyed.keys)


def fold_from_keyed_start_py(
    df: DataFrame, starts: DataFrame, keys: str | Sequence[str], order_by: Sequence[Ordering] | Ordering | None,
    op: Callable[[Any, dict], Any], result_type: str | T.DataType, *, start: str | None = None,
    start_keys: str | Sequence[str] | None = None, values: Sequence[str] | None = None,
    num_partitions: int | None = None, partition_id: Column | None = None, into: str = "result",
) -> DataFrame:
    """As ``fold_from_keyed_start`` with a Python ``op(accumulator, value dict)``; values stream through."""
    keyed = Keyed.of(df, keys, values)
    side = Keyed.of(starts, keyed.keys if start_keys is None else start_keys, [start] if start else None)
    tagged, named = _tagged(keyed, side, order_by)

    class Fold(arrow.Group):
        def open(self, key):
            self.key, self.begun = key, False
            return ()

        def rows(self, rows):
            for tag, first, value in rows:
                if tag == 0:
                    if self.begun:
                        raise ValueError(f"{TWO_STARTS}: key {self.key}")
                    self.begun, self.state = True, first[start] if start else first
                elif not self.begun:
                    raise ValueError(f"{NO_START}: key {self.key}")
                else:
                    self.state = op(self.state, value)
            return ()

        def close(self):
            return ((*self.key, self.state),)

    rows = _layout(tagged, named, keyed, Placement(num_partitions, partition_id)).select(*keyed.keys, TAG, SIDE, VALUE)
    schema = T.StructType([*(df.schema[k] for k in keyed.keys), T.StructField(into, data_type(result_type))])
    return arrow.run(rows, len(keyed.keys), Fold, schema)


def map_with_resource(
    df: DataFrame, resources: DataFrame, keys: str | Sequence[str], order_by: Sequence[Ordering] | Ordering | None,
    op: Callable[[Column, Column], Column], *, prepare: Callable[[Column], Column] | None = None,
    resource_keys: str | Sequence[str] | None = None, values: Sequence[str] | None = None,
    num_partitions: int | None = None, partition_id: Column | None = None, into: str = "result",
) -> DataFrame:
    """One row a value: keys and ``op(resource struct, value struct)``, sorted by key and value order.

    ``prepare`` is applied to the resource struct before the tables meet, once a
    resource.  Resources are neither broadcast nor copied to each value: running
    windows over the sorted stream hand a key's resource on from row to row.
    """
    keyed = Keyed.of(df, keys, values)
    side = Keyed.of(resources, keyed.keys if resource_keys is None else resource_keys)
    if prepare is not None:
        ready = side.df.select(*side.keys, prepare(side.value()).alias(f"{RESERVED}r"))
        side = Keyed(ready, side.keys, (f"{RESERVED}r",))
    tagged, named = _tagged(keyed, side, order_by)
    placement = Placement(num_partitions, partition_id)
    placed = placement.apply(tagged, keyed.keys)
    ties = [VALUE] if orderable(keyed.value_type()) else []
    w = Window.partitionBy(*keyed.keys, *placement.by).orderBy(TAG, *(o.sort_column(F.col(n)) for n, o in named), *ties)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    walked = placed.withColumns(
        {
            f"{RESERVED}held": F.first(F.when(F.col(TAG) == 0, F.struct(SIDE)), ignorenulls=True).over(so_far),
            f"{RESERVED}before": F.lag(TAG).over(w),
            f"{RESERVED}next": F.lead(TAG).over(w),
        }
    )
    before, following = F.col(f"{RESERVED}before"), F.col(f"{RESERVED}next")
    is_side = F.col(TAG) == 0
    kept = walked.filter(
        F.when(is_side & before.isNotNull(), _failed(TWO_RESOURCES, keyed.keys))
        .when(is_side & following.isNull(), _failed(NO_VALUES, keyed.keys))
        .when(~is_side & F.col(f"{RESERVED}held").isNull(), _failed(NO_RESOURCE, keyed.keys))
        .otherwise(~is_side)
    )
    resource = F.col(f"{RESERVED}held")[SIDE]
    return kept.select(*keyed.keys, op(resource[f"{RESERVED}r"] if prepare is not None else resource, F.col(VALUE)).alias(into))


def map_with_resource_py(
    df: DataFrame, resources: DataFrame, keys: str | Sequence[str], order_by: Sequence[Ordering] | Ordering | None,
    op: Callable[[Any, dict], Any], result_type: str | T.DataType, *, prepare: Callable[[dict], Any] | None = None,
    curried: bool = False, resource_keys: str | Sequence[str] | None = None, values: Sequence[str] | None = None,
    num_partitions: int | None = None, partition_id: Column | None = None, into: str = "result",
) -> DataFrame:
    """As ``map_with_resource`` with Python operations.

    ``prepare(resource dict)`` runs once a key, in the task that needs it; what
    it returns may be any object.  With ``curried``, ``op(resource)`` is called
    once a key and returns the function of a value.
    """
    keyed = Keyed.of(df, keys, values)
    side = Keyed.of(resources, keyed.keys if resource_keys is None else resource_keys)
    tagged, named = _tagged(keyed, side, order_by)

    class Apply(arrow.Group):
        def open(self, key):
            self.key, self.apply, self.used = key, None, False
            return ()

        def rows(self, rows):
            for tag, resource, value in rows:
                if tag == 0:
                    if self.apply is not None:
                        raise ValueError(f"{TWO_RESOURCES}: key {self.key}")
                    ready = resource if prepare is None else prepare(resource)
                    self.apply = op(ready) if curried else lambda v, ready=ready: op(ready, v)
                    continue
                if self.apply is None:
                    raise ValueError(f"{NO_RESOURCE}: key {self.key}")
                self.used = True
                yield (*self.key, self.apply(value))

        def close(self):
            if not self.used:
                raise ValueError(f"{NO_VALUES}: key {self.key}")
            return ()

    rows = _layout(tagged, named, keyed, Placement(num_partitions, partition_id)).select(*keyed.keys, TAG, SIDE, VALUE)
    schema = T.StructType([*(df.schema[k] for k in keyed.keys), T.StructField(into, data_type(result_type))])
    return arrow.run(rows, len(keyed.keys), Apply, schema)
