"""Orders for values and lambdas for folds."""

from keyorder.functions.order import Order, asc, desc

__all__ = ["Order", "asc", "desc"]
