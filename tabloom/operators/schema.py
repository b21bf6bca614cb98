"""Set operations, casts, guarded columns and column roles."""

from __future__ import annotations

from collections.abc import Collection, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.numeric import as_double
from tabloom.functions.text import MISSING

TRAIN_FLAG = "__is_train"


def union_labeled(train: DataFrame, test: DataFrame, label: str, flag: str = TRAIN_FLAG) -> DataFrame:
    """Train and test rows in one frame, by column name; the test label is null.

    Columns that one side lacks become null there, and duplicates are kept.
    """
    label_type = train.schema[label].dataType
    marked_test = test.withColumns({label: F.lit(None).cast(label_type), flag: F.lit(False)})
    return train.withColumn(flag, F.lit(True)).unionByName(marked_test, allowMissingColumns=True)


def split_labeled(df: DataFrame, label: str, flag: str = TRAIN_FLAG) -> tuple[DataFrame, DataFrame]:
    """The train side with its label and the test side without it."""
    return df.where(F.col(flag)).drop(flag), df.where(~F.col(flag)).drop(flag, label)


def to_double(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: as_double(c) for c in columns})


def drop_temp(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def keep_columns(df: DataFrame, id_col: str, label: str) -> DataFrame:
    """The id, and the label if the frame has one."""
    return df.select([c for c in (id_col, label) if c in df.columns])


@dataclass(frozen=True)
class Derived:
    """A column that can be computed where all of ``inputs`` exist."""

    name: str
    inputs: tuple[str, ...]
    value: Column


def with_column_if_present(df: DataFrame, name: str, required: Iterable[str], value: Column) -> DataFrame:
    """``df`` with the derived column, or unchanged if an input is missing."""
    return df.withColumn(name, value) if set(required) <= set(df.columns) else df


def with_present(df: DataFrame, derived: Iterable[Derived]) -> DataFrame:
    """All derived columns whose inputs exist, in as few projections as possible.

    A new projection starts only where a column reads one of the open batch.
    """
    have = set(df.columns)
    batch: dict[str, Column] = {}
    for item in derived:
        if not set(item.inputs) <= have:
            continue
        if batch.keys() & {item.name, *item.inputs}:
            df, batch = df.withColumns(batch), {}
        batch[item.name] = item.value
        have.add(item.name)
    return df.withColumns(batch) if batch else df


@dataclass(frozen=True)
class Roles:
    numeric: list[str]
    categorical: list[str]


def infer_roles(
    df: DataFrame,
    id_col: str,
    targets: Collection[str],
    force_categorical: Collection[str] = (),
) -> Roles:
    """Feature roles from the schema alone; no job runs.

    Numeric types are numeric unless forced; all other types are categorical.
    """
    skip = {id_col, *targets}
    features = [f for f in df.schema.fields if f.name not in skip]
    numeric = [
        f.name for f in features if isinstance(f.dataType, T.NumericType) and f.name not in force_categorical
    ]
    return Roles(numeric, [f.name for f in features if f.name not in set(numeric)])


def text_name(column: str) -> str:
    return f"{column}_text"


def categorical_text(df: DataFrame, columns: Sequence[str], fill: str = MISSING) -> DataFrame:
    """``<c>_text``: each value as text, null as ``fill``."""
    return df.withColumns(
        {text_name(c): F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(fill)) for c in columns}
    )


def log_target(df: DataFrame, target: str, out: str) -> DataFrame:
    return df.withColumn(out, F.log1p(as_double(target)))


def filter_training_outliers(
    df: DataFrame,
    area: str,
    target: str,
    area_limit: float = 4000.0,
    price_floor: float = 300000.0,
    enabled: bool = True,
) -> DataFrame:
    """Drop rows which are both large and cheap. Rows with a null stay."""
    return df.where(not_outlier(df, area, target, area_limit, price_floor)) if enabled else df


def not_outlier(df: DataFrame, area: str, target: str, area_limit: float = 4000.0, price_floor: float = 300000.0) -> Column:
    """Whether a row is not both large and cheap; true with a null, or in a table without these columns."""
    if not {area, target} <= set(df.columns):
        return F.lit(True)
    size, price = as_double(area), as_double(target)
    return (size < area_limit) | (price >= price_floor) | F.col(f"`{area}`").isNull() | F.col(f"`{target}`").isNull()
