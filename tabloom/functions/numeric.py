"""Numeric features, as built-in column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(name: str) -> Column:
    """The column as a double; text that is no number gives null, not an error."""
    return F.col(f"`{name}`").try_cast("double")


def flag(condition: Column) -> Column:
    """1.0 where the condition holds; 0.0 where it does not or is null."""
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))


def known_flag(value: Column) -> Column:
    return flag(value.isNotNull())


def or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def positive_flag(value: Column) -> Column:
    return flag(or_zero(value) > 0.0)


def sum_plus(values: Sequence[Column], constant: float) -> Column:
    """Sum plus a constant; null if any value is null."""
    return reduce(add, values) + F.lit(constant)


def sum_or_zero(values: Sequence[Column], weights: Sequence[float] | None = None) -> Column:
    """Weighted sum in which a null counts as zero."""
    if weights is None:
        return reduce(add, [or_zero(v) for v in values])
    return reduce(add, [or_zero(v) * F.lit(w) for v, w in zip(values, weights, strict=True)])


def difference(left: Column, right: Column) -> Column:
    return left - right


def product(left: Column, right: Column) -> Column:
    return left * right


def power(value: Column, exponent: float) -> Column:
    return F.pow(value, F.lit(exponent))


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Ratio with a denominator of 1.0 in place of one that is not positive."""
    return numerator / F.when(denominator <= 0.0, F.lit(1.0)).otherwise(denominator)


def clamped_log1p(value: Column) -> Column:
    """log(1 + x) with null and negative values as zero."""
    return F.log1p(F.greatest(or_zero(value), F.lit(0.0)))


def at_threshold(probability: Column, threshold: float) -> Column:
    return flag(probability >= F.lit(threshold))


def prob_at_one(probability: Column) -> Column:
    """The probability of class 1 out of an ML probability vector."""
    return vector_to_array(probability)[1]


def raw_vector(probability: Column) -> Column:
    """The two-class vector [1 - p, p]."""
    return array_to_vector(F.array(F.lit(1.0) - probability, probability))


def densify(vector: Column) -> Column:
    """A sparse vector in dense form."""
    return array_to_vector(vector_to_array(vector))
