"""Attaching one-row-per-key statistics to a large table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial, reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.runtime import BROADCAST_BYTES, fits_broadcast, materialize, together

HOT_ROWS = 1_000_000
# Hot keys are at most rows / HOT_ROWS; their table is broadcast up to this size, and salted beyond.
HOT_BYTES = 32 * 1024 * 1024
SALTS = 256


def attach_by_key(
    df: DataFrame,
    stats: DataFrame,
    keys: Sequence[str],
    max_broadcast_bytes: int = BROADCAST_BYTES,
    hot_rows: int = HOT_ROWS,
    written: bool = False,
) -> DataFrame:
    """Left join ``stats`` (at most one row per key) to ``df``.

    The statistics are written once and measured. If they fit the limit they
    are broadcast, and ``df`` is not shuffled. Otherwise ``df`` is shuffled by
    key, except for rows of hot keys and of null keys: hot keys are few (at
    most rows / ``hot_rows``), so their statistics are broadcast (or copied to
    salts, if that is too much) and their rows never meet in one task, however
    alike they are. A null key finds no match. ``written`` says that ``stats``
    already is a written table.
    """
    return attach_stats(df, [(stats, keys)], max_broadcast_bytes, hot_rows, written)


def attach_stats(
    df: DataFrame,
    tables: Sequence[tuple[DataFrame, Sequence[str]]],
    max_broadcast_bytes: int = BROADCAST_BYTES,
    hot_rows: int = HOT_ROWS,
    written: bool = False,
) -> DataFrame:
    """Attach several statistics tables, each with its own keys.

    The tables are written and measured side by side.
    """

    def prepare(stats: DataFrame) -> tuple[DataFrame, bool]:
        table = stats if written else materialize(stats, "stats")
        return table, fits_broadcast(table, max_broadcast_bytes)

    prepared = together(df.sparkSession, [partial(prepare, stats) for stats, _ in tables])
    for (_, keys), (table, small) in zip(tables, prepared, strict=True):
        if small:
            df = df.join(F.broadcast(table), list(keys), "left")
        else:
            df = _attach_large(df, table, list(keys), max_broadcast_bytes, hot_rows)
    return df


def _attach_large(
    df: DataFrame, stats: DataFrame, keys: list[str], max_broadcast_bytes: int, hot_rows: int
) -> DataFrame:
    values = [c for c in stats.columns if c not in keys]
    # At most one key per ``hot_rows`` rows, also those that have no statistics.
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") > hot_rows).drop("__rows")
    hot = materialize(sizes.dropna().join(stats, keys, "left"), "hot-stats")
    no_key = reduce(or_, [F.col(k).isNull() for k in keys])
    cold = df.where(~no_key).join(_small_side(hot.select(*keys), max_broadcast_bytes), keys, "left_anti")
    columns = [*keys, *[c for c in df.columns if c not in keys]]
    order = [F.col(f"`{c}`") for c in [*columns, *values]]
    kinds = {f.name: f.dataType for f in stats.schema.fields}
    none = df.where(no_key).withColumns({v: F.lit(None).cast(kinds[v]) for v in values})
    parts = [cold.join(stats, keys, "left"), _attach_hot(df, hot, keys, max_broadcast_bytes), none]
    return reduce(lambda x, y: x.union(y), [part.select(*order) for part in parts])


def _small_side(table: DataFrame, limit: int) -> DataFrame:
    return F.broadcast(table) if fits_broadcast(table, max(limit, HOT_BYTES)) else table


def _attach_hot(df: DataFrame, hot: DataFrame, keys: list[str], max_broadcast_bytes: int) -> DataFrame:
    """Rows of hot keys stay where they are; beyond the limit, each statistic is copied to every salt instead."""
    if fits_broadcast(hot, max(max_broadcast_bytes, HOT_BYTES)):
        return df.join(F.broadcast(hot), keys)
    copies = hot.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = df.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return salted.join(copies, [*keys, "__salt"]).drop("__salt")


def join_by_id(frames: Sequence[DataFrame], id_col: str, how: str = "inner") -> DataFrame:
    """Join frames that hold one row per id, such as predictions of ensemble members.

    With ``inner`` an id that one frame lacks is lost; ``left`` keeps the first
    frame's ids. The ids are unique, so the shuffle by id is even.
    """
    return reduce(lambda left, right: left.join(right, id_col, how), frames)
