"""Exact order statistics without collecting a group into one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.runtime import fits_broadcast, materialize

ROWS_PER_SLICE = 1_000_000
# Slices that one sketch cuts; more are made by cutting each slice again.
FAN = 1_000
VALUE = "__value"
SLICE = "__slice"


def present(df: DataFrame, column: str) -> Column:
    """Whether the value is neither null nor NaN."""
    value = F.col(f"`{column}`")
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        return value.isNotNull() & ~F.isnan(value)
    return value.isNotNull()


def with_value_slices(df: DataFrame, column: str, n_rows: int, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Number ascending value ranges that hold about ``rows_per_slice`` rows each.

    The cut points come from one mergeable sketch, so every key's rows are
    spread over the slices however skewed the keys are. Beyond ``FAN`` slices,
    each slice is cut again by a sketch of its own, as often as needed. Equal
    values always share a slice, NaN is above all numbers, and cuts are fixed
    numbers: a retried task gives the same slices.
    """
    wanted = math.ceil(n_rows / rows_per_slice)
    fan = min(wanted, FAN)
    cuts: list[float] = []
    if fan > 1:
        steps = [i / fan for i in range(1, fan)]
        cuts = sorted(set(df.approxQuantile(column, steps, 1.0 / (4 * fan))))
    if not cuts:
        return df.withColumn(SLICE, F.lit(0.0))
    edges = [-math.inf, *cuts, math.inf]
    sliced = Bucketizer(splits=edges, inputCol=column, outputCol=SLICE, handleInvalid="keep").transform(df)
    while wanted > fan:
        wanted = math.ceil(wanted / fan)
        fan = min(wanted, FAN)
        sliced = _cut_again(sliced, column, fan)
    return sliced


def _cut_again(sliced: DataFrame, column: str, fan: int) -> DataFrame:
    """Each slice cut into up to ``fan`` new ones, in order, by its own sketch; a cut's own value is a slice of its own,
    so that a very common value does not keep its neighbours together."""
    steps = F.array(*[F.lit(i / fan) for i in range(1, fan)])
    cuts = materialize(
        sliced.groupBy(SLICE).agg(F.array_distinct(F.percentile_approx(column, steps, 4 * fan)).alias("__cuts")), "cuts"
    ).withColumnRenamed(SLICE, "__whole")
    joined = sliced.join(F.broadcast(cuts) if fits_broadcast(cuts) else cuts, F.col(SLICE) == F.col("__whole"), "left")
    count = lambda test: F.coalesce(F.size(F.filter("__cuts", test)), F.lit(0))
    place = count(lambda cut: cut <= F.col(column)) + count(lambda cut: cut < F.col(column))
    return joined.withColumn(SLICE, F.col(SLICE) * (2 * fan) + place).drop("__whole", "__cuts")


def grouped_quantile(
    df: DataFrame,
    keys: Sequence[str],
    column: str,
    out: str,
    fraction: float = 0.5,
    rows_per_slice: int = ROWS_PER_SLICE,
    n_rows: int | None = None,
) -> DataFrame:
    """The exact discrete quantile of the present values of each key set.

    An actual element is returned: for 1, 2, 3, 4 and 0.5 it is 2. Groups with
    no value are absent, and a null key is a group. A table of at most
    ``rows_per_slice`` rows is one plain aggregate. Above it, values are
    counted per (key, slice), the slice that holds the wanted rank is chosen,
    and only its values are ranked, so a task never holds a whole hot group.
    """
    keys = list(keys)
    kept = df.where(present(df, column)).select(*keys, F.col(f"`{column}`").alias(VALUE))
    if n_rows is None:
        n_rows = kept.count()
    kind = df.schema[column].dataType
    # Spark's percentile_disc returns doubles, which do not hold every long.
    if n_rows <= rows_per_slice and not isinstance(kind, (T.LongType, T.DecimalType)):
        picked = F.expr(f"percentile_disc({fraction}) WITHIN GROUP (ORDER BY {VALUE})")
        grouped = kept.groupBy(*keys) if keys else kept.groupBy()
        result = grouped.agg(picked.cast(kind).alias(out))
        return result if keys else result.where(F.col(out).isNotNull())
    return _sliced_quantile(kept, keys, out, fraction, n_rows, rows_per_slice)


def _sliced_quantile(
    kept: DataFrame, keys: list[str], out: str, fraction: float, n_rows: int, rows_per_slice: int
) -> DataFrame:
    # Null keys must find their own slice again, so keys are compared null-safely.
    value_type = kept.schema[VALUE].dataType
    sliced = with_value_slices(kept.withColumn("__number", F.col(VALUE).cast("double")), "__number", n_rows, rows_per_slice)
    per_slice = sliced.groupBy(*keys, SLICE).agg(F.count(F.lit(1)).alias("__rows"))
    # At most one row per slice and key: a bounded window.
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = F.sum("__rows").over(group.orderBy(SLICE)) - F.col("__rows")
    rank = F.greatest(F.ceil(F.sum("__rows").over(group) * F.lit(fraction)), F.lit(1))
    target = (
        per_slice.select(*keys, SLICE, "__rows", before.alias("__before"), rank.alias("__rank"))
        .where((F.col("__before") < F.col("__rank")) & (F.col("__rank") <= F.col("__before") + F.col("__rows")))
        .select(
            *[F.col(k).alias(f"__t_{k}") for k in keys],
            F.col(SLICE).alias("__t_slice"),
            (F.col("__rank") - F.col("__before")).alias("__need"),
        )
    )
    target = materialize(target, "quantile-targets")
    if fits_broadcast(target):
        target = F.broadcast(target)
    match = F.col(SLICE) == F.col("__t_slice")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"__t_{k}"))
    # Beyond the broadcast limit this shuffles by (key, slice), which no hot key fills.
    counted = sliced.join(target, match).groupBy(*keys, VALUE).agg(
        F.count(F.lit(1)).alias("__rows"), F.first("__need").alias("__need")
    )
    reached = F.sum("__rows").over(group.orderBy(VALUE))
    hits = counted.withColumn("__reached", reached).where(F.col("__reached") >= F.col("__need"))
    grouped = hits.groupBy(*keys) if keys else hits.groupBy()
    result = grouped.agg(F.min(VALUE).cast(value_type).alias(out))
    return result if keys else result.where(F.col(out).isNotNull())


def grouped_median(
    df: DataFrame,
    keys: Sequence[str],
    column: str,
    out: str,
    n_rows: int | None = None,
    rows_per_slice: int = ROWS_PER_SLICE,
    approximate: bool = False,
) -> DataFrame:
    """Lower-middle value of each key set, as a double.

    ``approximate`` uses Spark's sketch instead: one pass, but for groups of
    more than some thousand rows it may return a neighbouring element.
    """
    if approximate:
        return df.where(present(df, column)).groupBy(*keys).agg(
            F.percentile_approx(F.col(f"`{column}`"), 0.5).cast("double").alias(out)
        )
    exact = grouped_quantile(df, keys, column, out, 0.5, rows_per_slice, n_rows)
    return exact.withColumn(out, F.col(out).cast("double"))


def global_median(
    df: DataFrame,
    column: str,
    default: float,
    n_rows: int | None = None,
    rows_per_slice: int = ROWS_PER_SLICE,
    relative_error: float = 0.0,
) -> float:
    """The median of a column, or ``default`` if the column has no value.

    A positive ``relative_error`` accepts Spark's sketch in place of the exact value.
    """
    if relative_error > 0:
        found = df.approxQuantile(column, [0.5], relative_error)
        return found[0] if found else default
    row = grouped_quantile(df, [], column, "m", 0.5, rows_per_slice, n_rows).first()
    return default if row is None else float(row["m"])


def impute_median(
    df: DataFrame,
    columns: Sequence[str],
    outputs: Sequence[str],
    fit_on: DataFrame | None = None,
    default: float = 0.0,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Null and NaN replaced by the exact median of the column.

    Columns of one type are handled in one pass over (column, value) pairs. The output
    keeps the input's type. A column with no value at all gets ``default``.
    """
    source = df if fit_on is None else fit_on
    # Whole numbers do not pass through doubles, which hold them up to 2^53 only.
    kinds: dict[str, list[str]] = {}
    for c in columns:
        kind = source.schema[c].dataType
        exact = isinstance(kind, (T.LongType, T.DecimalType))
        kinds.setdefault(kind.simpleString() if exact else "double", []).append(c)
    found = {}
    for kind, members in kinds.items():
        pair = lambda c, kind=kind: F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast(kind).alias("value"))
        pairs = source.select(F.explode(F.array(*[pair(c) for c in members])).alias("p")).select("p.column", "p.value")
        medians = grouped_quantile(pairs, ["column"], "value", "median", 0.5, rows_per_slice)
        found |= {r["column"]: r["median"] for r in medians.collect()}
    filled = {}
    for c, out in zip(columns, outputs, strict=True):
        kind = df.schema[c].dataType
        middle = F.lit(found.get(c, default)).cast(kind)
        filled[out] = F.when(present(df, c), F.col(f"`{c}`")).otherwise(middle)
    return df.withColumns(filled)
