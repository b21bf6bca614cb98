"""Category codes as a distributed join, and the encoder stages of fitted models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.feature import (
    Imputer,
    OneHotEncoder,
    StandardScaler,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.numeric import densify
from tabloom.operators.joining import attach_by_key
from tabloom.operators.ordering import position_in_order
from tabloom.runtime import materialize


def category_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, code): codes by falling frequency, ties by value.

    One pass counts the values of all columns, and one distributed sort numbers
    them, so a column may hold more distinct values than a driver can. Columns
    of different types are coded by their values as text.
    """
    as_text = len({df.schema[c].dataType.simpleString() for c in columns}) > 1
    value_of = lambda c: F.col(f"`{c}`").cast("string") if as_text else F.col(f"`{c}`")
    pairs = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column"), value_of(c).alias("value")) for c in columns])
        ).alias("p")
    ).select("p.column", "p.value")
    counts = pairs.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("rows"))
    placed = position_in_order(counts, ["column", F.col("rows").desc(), "value"], "position")
    starts = placed.groupBy("column").agg(F.min("position").alias("start"))
    # One row per column.
    return placed.join(F.broadcast(starts), "column").select(
        "column", "value", (F.col("position") - F.col("start")).cast("double").alias("code")
    )


def string_index(df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None, suffix: str = "Indexed") -> DataFrame:
    """``<c>Indexed``: the code of each value; unseen values and null get the next free code."""
    codes = materialize(category_codes(df if fit_on is None else fit_on, columns), "codes")
    free = {r["column"]: r["n"] for r in codes.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    for c in columns:
        out = f"{c}{suffix}"
        value = F.col("value").cast(df.schema[c].dataType)
        of_column = codes.where(F.col("column") == c).select(value.alias(c), F.col("code").alias(out))
        df = attach_by_key(df, of_column, [c], written=True).withColumn(
            out, F.coalesce(F.col(out), F.lit(float(free.get(c, 0))))
        )
    return df


def indexer(columns: Sequence[str], outputs: Sequence[str]) -> StringIndexer:
    """Codes for all columns, counted in one pass; null and unseen get the next free code."""
    return StringIndexer(inputCols=list(columns), outputCols=list(outputs), handleInvalid="keep")


def one_hot(columns: Sequence[str], outputs: Sequence[str], drop_last: bool = True) -> OneHotEncoder:
    return OneHotEncoder(inputCols=list(columns), outputCols=list(outputs), handleInvalid="keep", dropLast=drop_last)


def scaler(column: str, out: str, centered: bool) -> StandardScaler:
    return StandardScaler(inputCol=column, outputCol=out, withMean=centered, withStd=True)


def assembler(columns: Sequence[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(columns), outputCol=out, handleInvalid="keep")


def median_imputer(columns: Sequence[str], outputs: Sequence[str], relative_error: float = 0.001) -> Imputer:
    return Imputer(
        inputCols=list(columns), outputCols=list(outputs), strategy="median", relativeError=relative_error
    )


class Densifier(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Stage that turns a sparse vector column into a dense one."""

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getOutputCol(), densify(F.col(self.getInputCol())))
