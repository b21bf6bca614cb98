"""Group statistics and imputation from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.operators.joining import attach_stats


def group_size(df: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """Rows per key set, as a double. Counts are combined before the shuffle."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias(out))


def group_evidence(df: DataFrame, keys: Sequence[str], segments: Mapping[str, Column], label: str) -> DataFrame:
    """Per key and segment: ``<segment>_count`` and ``<segment>_rate`` of the label.

    All segments share one aggregate. A key with no row in a segment reads null.
    """
    measures = []
    for prefix, inside in segments.items():
        rows = F.count(F.when(inside, F.lit(1)))
        measures.append(F.when(rows > 0, rows.cast("double")).alias(f"{prefix}_count"))
        measures.append(F.avg(F.when(inside, F.col(label).cast("double"))).alias(f"{prefix}_rate"))
    return df.groupBy(*keys).agg(*measures)


def first_known(column: str, levels: Sequence[str], default: float) -> Column:
    """The value, or else the first known statistic, or else the default."""
    return F.coalesce(F.col(column), *[F.col(c) for c in levels], F.lit(default)).cast("double")


def impute_hierarchical(
    df: DataFrame,
    column: str,
    levels: Sequence[tuple[DataFrame, Sequence[str]]],
    default: float,
    out: str,
    **limits: int,
) -> DataFrame:
    """Fill a column from ever coarser group statistics, then from ``default``.

    Each level is (statistics with one value column, its keys), finest first.
    """
    names = [next(c for c in stats.columns if c not in keys) for stats, keys in levels]
    attached = attach_stats(df, levels, **limits)
    return attached.withColumn(out, first_known(column, names, default)).drop(*names)
