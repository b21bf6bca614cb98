"""Registered queries, each with its SQL twin where SQL can say the same."""

from tabloom.catalog import columns, encoders, groups, models, rules, tables  # noqa: F401
from tabloom.catalog.base import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
