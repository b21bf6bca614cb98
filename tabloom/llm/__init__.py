"""Operators of a training-data pipeline over text, and their queries."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the workers whole, so workers need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from tabloom.llm import queries as _queries  # noqa: E402, F401
from tabloom.llm.registry import QUERIES, TWINS  # noqa: E402


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(TWINS)


__all__ = ["oracle_sql", "queries"]
