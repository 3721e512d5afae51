"""Inputs are any DataFrame; this reads the tables that the queries use."""

from keyorder.sources.tables import table

__all__ = ["table"]
