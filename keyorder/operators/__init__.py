"""Order-sensitive keyed operators on DataFrames."""

from keyorder.operators.fold import sorted_fold, sorted_fold_py
from keyorder.operators.groups import sorted_groups
from keyorder.operators.joins import sorted_join
from keyorder.operators.keyed import (
    fold_from_keyed_start,
    fold_from_keyed_start_py,
    map_with_resource,
    map_with_resource_py,
)

__all__ = [
    "fold_from_keyed_start",
    "fold_from_keyed_start_py",
    "map_with_resource",
    "map_with_resource_py",
    "sorted_fold",
    "sorted_fold_py",
    "sorted_groups",
    "sorted_join",
]
