"""What an operator is asked to do: keys, values, order and placement, checked against the schema."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyorder.functions.order import Order, as_order

#: Names of the engine's own columns; inputs may not use them.
RESERVED = "__ko_"
#: Column of the partition that the caller has chosen.
PLACE = f"{RESERVED}place"

Ordering = Order | Column | str


def orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(orderable(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return orderable(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType, T.CalendarIntervalType))


@dataclass(frozen=True)
class Placement:
    """Output partitions: as Spark chooses, exactly n by key hash, or n by an id that depends on the key alone."""

    num_partitions: int | None = None
    partition_id: Column | None = None

    def __post_init__(self) -> None:
        if self.num_partitions is not None and self.num_partitions < 1:
            raise ValueError("num_partitions must be positive")
        if self.partition_id is not None and self.num_partitions is None:
            raise ValueError("partition_id needs num_partitions")

    @property
    def by(self) -> tuple[str, ...]:
        """What else to group or join by: a chosen partition counts as clustering by key only if it is named there."""
        return () if self.partition_id is None else (PLACE,)

    def spread(self, df: DataFrame, keys: Sequence[str]) -> DataFrame:
        """As ``apply``; left to the aggregate or join that follows where the caller has no wish."""
        return df if self.num_partitions is None else self.apply(df, keys)

    def apply(self, df: DataFrame, keys: Sequence[str]) -> DataFrame:
        if self.partition_id is not None:
            # The second term keeps a constant from being folded away, and with it the clustering.
            chosen = F.coalesce(self.partition_id.cast("int"), F.lit(0)) + F.hash(*keys).bitwiseAND(F.lit(0))
            return df.withColumn(PLACE, chosen).repartitionById(self.num_partitions, PLACE)
        if self.num_partitions is not None:
            return df.repartition(self.num_partitions, *keys)
        return df.repartition(*keys)


@dataclass(frozen=True)
class Keyed:
    """A table of key and value columns, reduced to the columns that an operator needs."""

    df: DataFrame
    keys: tuple[str, ...]
    values: tuple[str, ...]

    @staticmethod
    def of(df: DataFrame, keys: str | Sequence[str], values: Sequence[str] | None = None) -> Keyed:
        keys = (keys,) if isinstance(keys, str) else tuple(keys)
        if not keys:
            raise ValueError("at least one key column is needed")
        values = tuple(c for c in df.columns if c not in keys) if values is None else tuple(values)
        for c in (*keys, *values):
            if c not in df.columns:
                raise ValueError(f"no column {c!r} among {df.columns}")
            if c.startswith(RESERVED):
                raise ValueError(f"column names may not begin with {RESERVED!r}: {c!r}")
        for k in keys:
            if not orderable(df.schema[k].dataType):
                raise ValueError(f"key {k!r} can't be ordered")
        if not values:
            raise ValueError("at least one value column is needed")
        return Keyed(df, keys, values)

    def value(self) -> Column:
        return F.struct(*self.values)

    def value_type(self) -> T.StructType:
        return T.StructType([self.df.schema[c] for c in self.values])

    def orders(self, order_by: Sequence[Ordering] | Ordering | None) -> list[Order]:
        """The order of values; all value columns, left to right, when none is given."""
        if order_by is None:
            for c in self.values:
                if not orderable(self.df.schema[c].dataType):
                    raise ValueError(f"value column {c!r} can't be ordered: give order_by")
            return [as_order(c) for c in self.values]
        items = [order_by] if isinstance(order_by, (Order, Column, str)) else list(order_by)
        if not items:
            raise ValueError("order_by is empty: values would come in no order")
        return [as_order(x) for x in items]

    def slim(self, orders: Sequence[Order]) -> tuple[DataFrame, list[tuple[str, Order]]]:
        """Keys, one struct of values, and computed sort columns: nothing else is shuffled."""
        named = [(f"{RESERVED}s{i}", o) for i, o in enumerate(orders)]
        return self.df.select(*self.keys, *(o.expr.alias(n) for n, o in named), self.value().alias(f"{RESERVED}v")), named
