"""Reading tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    null_value: str | None = None,
    infer: bool = True,
) -> DataFrame:
    """Read a Parquet folder/file, or else CSV with a header.

    ``schema`` is preferred at scale: inference reads the whole text once more.
    ``null_value`` is read as null before types are inferred, so that a numeric
    column with such markers stays numeric. ``infer=False`` gives text columns.
    """
    if path.rstrip("/").endswith(".parquet"):
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.parquet(path)
    reader = spark.read.option("header", True)
    if null_value is not None:
        reader = reader.option("nullValue", null_value)
    if schema is not None:
        reader = reader.schema(schema)
    else:
        reader = reader.option("inferSchema", infer)
    return reader.csv(path)


def read_pair(
    spark: SparkSession,
    train_path: str,
    test_path: str,
    label: str,
    null_value: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Read train and test with ONE schema: inferred on train, applied to test.

    Inferring both apart can type a category as ``20`` here and ``20.0`` there.
    """
    train = read_table(spark, train_path, null_value=null_value)
    test_names = read_table(spark, test_path, null_value=null_value, infer=False).columns
    types = {f.name: f for f in train.schema.fields}
    schema = T.StructType([types.get(c, T.StructField(c, T.StringType())) for c in test_names if c != label])
    return train, read_table(spark, test_path, schema=schema, null_value=null_value)
