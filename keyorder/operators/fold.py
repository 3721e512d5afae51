"""Ordered folds by key; the operation need be neither commutative nor associative."""

from __future__ import annotations

import copy
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyorder.operators import arrow
from keyorder.operators.groups import collected, laid_out
from keyorder.operators.spec import RESERVED, Keyed, Ordering, Placement


def data_type(kind: str | T.DataType) -> T.DataType:
    return T.DataType.fromDDL(kind) if isinstance(kind, str) else kind


def sorted_fold(
    df: DataFrame, keys: str | Sequence[str], order_by: Sequence[Ordering] | Ordering | None, init: Any,
    op: Callable[[Column, Column], Column], result_type: str | T.DataType, *,
    values: Sequence[str] | None = None, num_partitions: int | None = None, partition_id: Column | None = None, into: str = "result",
) -> DataFrame:
    """One row a key: the fold of ``op(accumulator, value struct)`` from ``init`` over its values in order.

    ``op`` is made of columns, so all of it runs inside Spark.  A key's values
    are gathered for it; for keys whose values don't fit in memory use
    ``sorted_fold_py``.
    """
    keyed = Keyed.of(df, keys, values)
    kind = data_type(result_type)
    start = (init if isinstance(init, Column) else F.lit(init)).cast(kind)
    grouped = collected(keyed, order_by, Placement(num_partitions, partition_id))
    folded = F.aggregate(f"{RESERVED}values", start, lambda acc, v: op(acc, v).cast(kind))
    return grouped.select(*keyed.keys, folded.alias(into)).sortWithinPartitions(*keyed.keys)


def sorted_fold_py(
    df: DataFrame, keys: str | Sequence[str], order_by: Sequence[Ordering] | Ordering | None, init: Any,
    op: Callable[[Any, dict], Any], result_type: str | T.DataType, *,
    values: Sequence[str] | None = None, num_partitions: int | None = None, partition_id: Column | None = None, into: str = "result",
) -> DataFrame:
    """As ``sorted_fold`` with a Python ``op(accumulator, value dict)``.

    Values stream through, whatever the size of a group.  Every key starts from
    a copy of ``init``, or from ``init()`` when it is callable.
    """
    keyed = Keyed.of(df, keys, values)
    schema = T.StructType([*(df.schema[k] for k in keyed.keys), T.StructField(into, data_type(result_type))])

    class Fold(arrow.Group):
        def open(self, key):
            self.key, self.state = key, init() if callable(init) else copy.deepcopy(init)
            return ()

        def rows(self, rows):
            state = self.state
            for (value,) in rows:
                state = op(state, value)
            self.state = state
            return ()

        def close(self):
            return ((*self.key, self.state),)

    rows = laid_out(keyed, order_by, Placement(num_partitions, partition_id))
    return arrow.run(rows, len(keyed.keys), Fold, schema)
