"""Positions in a total order, found without a one-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.runtime import materialize

# monotonically_increasing_id puts the partition above these low bits.
ROW_BITS = 33


def position_in_order(df: DataFrame, order: Sequence[Column | str], out: str = "position") -> DataFrame:
    """Number the rows 0, 1, 2, ... in a total order.

    The sort is by range over all executors. The written, sorted table gives
    each row its place in its partition; the partitions' row counts (one row
    per partition) give the offsets.
    """
    placed = materialize(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "sorted")
    placed = placed.withColumn("__part", F.shiftright("__at", ROW_BITS))
    ahead = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("__part")
        .agg(F.count(F.lit(1)).alias("__rows"))
        .select("__part", F.coalesce(F.sum("__rows").over(ahead), F.lit(0)).alias("__offset"))
    )
    in_part = F.col("__at") - F.shiftleft("__part", ROW_BITS)
    return (
        placed.join(F.broadcast(offsets), "__part")
        .withColumn(out, F.col("__offset") + in_part)
        .drop("__part", "__offset", "__at")
    )


def order_by_id(df: DataFrame, id_col: str) -> DataFrame:
    return df.orderBy(F.col(id_col).asc())


def disagreement_order(flag: str, id_col: str, probability: str | None = None) -> list[Column]:
    """Disagreements first; then, if given, the most certain probability; then the id."""
    certain = [] if probability is None else [F.abs(F.col(probability) - F.lit(0.5)).desc()]
    return [F.col(flag).desc(), *certain, F.col(id_col).asc()]


def best_candidate(
    scores: DataFrame, accuracy: str = "accuracy", auc: str = "auc", position: str = "grid_pos"
) -> DataFrame:
    """The row of highest accuracy, then highest AUC, then earliest grid position."""
    return scores.orderBy(F.col(accuracy).desc(), F.col(auc).desc(), F.col(position).asc()).limit(1)
