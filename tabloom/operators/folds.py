"""Folds and holdouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLD = "__fold"
HASH_RANGE = 1 << 53


def hash_fold(id_col: str, k: int) -> Column:
    """A fold in 0..k-1 from the id's hash; the id's type is part of the hash.

    The hash is widened first, since the minimum int has no positive twin.
    """
    return F.pmod(F.abs(F.hash(F.col(id_col)).cast("long")), F.lit(k)).cast("int")


def with_folds(df: DataFrame, id_col: str, k: int, out: str = FOLD) -> DataFrame:
    if k < 2:
        raise ValueError("at least 2 folds are needed")
    return df.withColumn(out, hash_fold(id_col, k))


def fold_split(df: DataFrame, fold: int, column: str = FOLD) -> tuple[DataFrame, DataFrame]:
    """Training rows (all other folds) and validation rows (this fold)."""
    return df.where(F.col(column) != fold).drop(column), df.where(F.col(column) == fold).drop(column)


def holdout_choice(seed: int, id_col: str, train_fraction: float = 0.8) -> Column:
    """Whether a row trains under a seed."""
    place = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(HASH_RANGE))
    return place < F.lit(int(train_fraction * HASH_RANGE))


def holdout(
    df: DataFrame, seed: int, id_col: str, train_fraction: float = 0.8, by_partition: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows.

    The default takes each row's side from its id and the seed, so a row stays
    on its side however the table is partitioned, also when a task is retried.
    ``by_partition`` uses ``randomSplit``, whose choice depends on partitions.
    """
    if by_partition:
        train, rest = df.randomSplit([train_fraction, 1.0 - train_fraction], seed)
        return train, rest
    inside = holdout_choice(seed, id_col, train_fraction)
    return df.where(inside), df.where(~inside)
