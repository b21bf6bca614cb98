"""Model quality as aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.operators.quantile import ROWS_PER_SLICE, SLICE, VALUE, with_value_slices

# The weights of the second model that a sweep tries.
SWEEP_WEIGHTS = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5)
SWEEP_PREFIX = "rmse_xgb_"
# End of fixed values.


def hit_rate(prediction: Column, label: Column) -> Column:
    """Aggregate: the share of rows whose prediction equals the label."""
    return F.avg((prediction == label.cast("double")).cast("double"))


def accuracy(
    df: DataFrame,
    prediction: str = "prediction",
    label: str = "label",
    keys: Sequence[str] = (),
    out: str = "accuracy",
) -> DataFrame:
    return df.groupBy(*keys).agg(hit_rate(F.col(prediction), F.col(label)).alias(out))


def roc_auc(
    df: DataFrame,
    score: str,
    label: str,
    keys: Sequence[str] = (),
    out: str = "auc",
    rows_per_slice: int = ROWS_PER_SLICE,
    n_rows: int | None = None,
) -> DataFrame:
    """Exact area under the ROC curve per key set; a tie counts one half.

    Rows are first counted per distinct score. Scores are cut into ascending
    slices of bounded size, each slice counts its own pairs, and a running sum
    over the slices (one row each) adds the pairs between slices. No task sorts
    all scores. A key with one class only reads null. NaN is the highest score.
    """
    kept = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(
        *keys, F.col(score).cast("double").alias(VALUE), F.col(label).cast("double").alias("__label")
    )
    if n_rows is None:
        n_rows = kept.count()
    tied = (
        with_value_slices(kept, VALUE, n_rows, rows_per_slice)
        .groupBy(*keys, SLICE, VALUE)
        .agg(
            F.sum(F.when(F.col("__label") == 1.0, 1.0).otherwise(0.0)).alias("__pos"),
            F.sum(F.when(F.col("__label") == 1.0, 0.0).otherwise(1.0)).alias("__neg"),
        )
    )
    pos, neg = F.col("__pos"), F.col("__neg")
    below = F.sum(neg).over(Window.partitionBy(*keys, SLICE).orderBy(VALUE)) - neg
    per_slice = (
        tied.withColumn("__pairs", pos * (below + neg * 0.5))
        .groupBy(*keys, SLICE)
        .agg(*[F.sum(c).alias(c) for c in ("__pairs", "__pos", "__neg")])
    )
    slices = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(SLICE)
    between = pos * (F.sum(neg).over(slices) - neg)
    return (
        per_slice.withColumn("__pairs", F.col("__pairs") + between)
        .groupBy(*keys)
        .agg(F.try_divide(F.sum("__pairs"), F.sum(pos) * F.sum(neg)).alias(out))
    )


def classification_scores(
    df: DataFrame,
    label: str,
    keys: Sequence[str],
    prediction: str = "prediction",
    score: str = "probability_one",
    n_rows: int | None = None,
) -> DataFrame:
    """Accuracy and AUC per key set, such as per fold or per rule variant."""
    keys = list(keys)
    hits = accuracy(df, prediction, label, keys)
    # A null key is a group of its own, and a group without scores keeps its accuracy.
    ranked = roc_auc(df, score, label, keys, n_rows=n_rows)
    ranked = ranked.select(*[F.col(f"`{k}`").alias(f"__{k}") for k in keys], "auc")
    same = reduce(and_, [F.col(f"`{k}`").eqNullSafe(F.col(f"`__{k}`")) for k in keys], F.lit(True))
    return hits.join(ranked, same, "left").drop(*[f"__{k}" for k in keys])


def rmse_of(label: Column, prediction: Column) -> Column:
    """Aggregate: root of the mean squared error."""
    return F.sqrt(F.avg(F.pow(label - prediction, F.lit(2.0))))


def rmse(df: DataFrame, label: str, prediction: str, keys: Sequence[str] = (), out: str = "rmse") -> DataFrame:
    return df.groupBy(*keys).agg(rmse_of(F.col(label), F.col(prediction)).alias(out))


def blended(first: Column, second: Column, weight: float) -> Column:
    """(1 - weight) of the first prediction and weight of the second."""
    return first * F.lit(1.0 - weight) + second * F.lit(weight)


def sweep_column(weight: float) -> str:
    return f"{SWEEP_PREFIX}{weight * 100:.0f}"


def blend_sweep(
    df: DataFrame,
    first: str,
    second: str,
    label: str,
    weights: Sequence[float] = SWEEP_WEIGHTS,
    keys: Sequence[str] = (),
) -> DataFrame:
    """The RMSE of every blend weight, all in one aggregate."""
    measures = [
        rmse_of(F.col(label), blended(F.col(first), F.col(second), w)).alias(sweep_column(w)) for w in weights
    ]
    return df.groupBy(*keys).agg(*measures)


def fold_mean(scores: DataFrame, by: Sequence[str], metrics: Mapping[str, str] | Sequence[str]) -> DataFrame:
    """Unweighted mean of fold scores per candidate."""
    names = metrics if isinstance(metrics, Mapping) else {m: m for m in metrics}
    return scores.groupBy(*by).agg(*[F.avg(source).alias(out) for source, out in names.items()])


def seed_summary(
    scores: DataFrame, value: str, keys: Sequence[str] = (), mean: str = "mean", spread: str = "stddev"
) -> DataFrame:
    """Mean and population spread over seeds; no row where there is one seed only."""
    return (
        scores.groupBy(*keys)
        .agg(F.avg(value).alias(mean), F.stddev_pop(value).alias(spread), F.count(value).alias("__seeds"))
        .where(F.col("__seeds") > 1)
        .drop("__seeds")
    )
