"""How values are ordered inside a key: direction and null placement as data.

A sort over rows takes ``Order.sort_column``; a sort inside an array can't, so
``comparator`` says the same as a lambda over two structs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Order:
    """One sort expression.  Nulls come first when ascending and last when descending, unless said otherwise."""

    expr: Column
    descending: bool = False
    nulls_last: bool | None = None

    @property
    def nulls_at_end(self) -> bool:
        return self.descending if self.nulls_last is None else self.nulls_last

    @property
    def plain(self) -> bool:
        """Whether this is the order in which arrays sort by themselves."""
        return not self.descending and not self.nulls_at_end

    def sort_column(self, expr: Column | None = None) -> Column:
        e = self.expr if expr is None else expr
        if self.descending:
            return e.desc_nulls_last() if self.nulls_at_end else e.desc_nulls_first()
        return e.asc_nulls_last() if self.nulls_at_end else e.asc_nulls_first()


def _column(expr: Column | str) -> Column:
    return F.col(expr) if isinstance(expr, str) else expr


def asc(expr: Column | str, *, nulls_last: bool = False) -> Order:
    return Order(_column(expr), False, nulls_last)


def desc(expr: Column | str, *, nulls_last: bool = True) -> Order:
    return Order(_column(expr), True, nulls_last)


def as_order(item: Order | Column | str) -> Order:
    """Plain columns and names are ascending, nulls first."""
    return item if isinstance(item, Order) else asc(item)


def comparator(orders: list[tuple[str, Order]]) -> Callable[[Column, Column], Column]:
    """Comparison of two structs by their fields in turn, for ``array_sort``."""

    def compare(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for name, order in reversed(orders):
            x, y = a[name], b[name]
            first, last = (1, -1) if order.nulls_at_end else (-1, 1)
            less, more = (1, -1) if order.descending else (-1, 1)
            out = (
                F.when(x.isNull() & y.isNull(), out)
                .when(x.isNull(), first)
                .when(y.isNull(), last)
                .when(x < y, less)
                .when(x > y, more)
                .otherwise(out)
            )
        return out

    return compare
