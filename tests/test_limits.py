"""What must hold at any size: no switch of meaning, no hot task, no loss of digits, no scratch left behind."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tabloom.operators import quantile
from tabloom.operators.encode import string_index
from tabloom.operators.joining import attach_by_key
from tabloom.operators.metrics import classification_scores, roc_auc
from tabloom.operators.quantile import grouped_quantile, impute_median
from tabloom.plans.boost import HistogramBooster
from tabloom.runtime import scratch_root, table_bytes
from tabloom.sources.sinks import classification_output, regression_output


def test_nan_scores_mean_the_same_in_one_slice_and_in_many(spark):
    rng = random.Random(4)
    rows = [(math.nan if rng.random() < 0.1 else rng.random(), float(rng.random() < 0.4)) for _ in range(1000)]
    df = spark.createDataFrame(rows, "s double, y double")
    values = [roc_auc(df, "s", "y", rows_per_slice=n).first()["auc"] for n in (10**6, 100, 7)]
    order = [(math.inf if math.isnan(s) else s, y) for s, y in rows]
    pos, neg = [s for s, y in order if y], [s for s, y in order if not y]
    want = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert values == pytest.approx([want] * 3)


def test_slices_are_cut_again_beyond_the_fan(spark, monkeypatch):
    monkeypatch.setattr(quantile, "FAN", 3)
    rng = random.Random(5)
    rows = [(i % 2, rng.choice([rng.random(), 0.5])) for i in range(900)]
    df = spark.createDataFrame(rows, "k int, v double")
    slices = quantile.with_value_slices(df, "v", 900, 20).groupBy(quantile.SLICE).agg(
        F.min("v").alias("low"), F.max("v").alias("high"), F.countDistinct("v").alias("n")
    ).orderBy(quantile.SLICE).collect()
    assert len(slices) > 9 and all(a["high"] < b["low"] for a, b in zip(slices, slices[1:]))
    assert max(s["n"] for s in slices) < 80
    for fraction in (0.1, 0.5, 0.9):
        got = {r["k"]: r["q"] for r in grouped_quantile(df, ["k"], "v", "q", fraction, rows_per_slice=20).collect()}
        for k in (0, 1):
            own = sorted(v for x, v in rows if x == k)
            assert got[k] == own[max(math.ceil(len(own) * fraction), 1) - 1]


@pytest.mark.parametrize("limit", [0, 1 << 26])
def test_rows_of_a_hot_key_never_meet_however_alike(spark, limit):
    df = spark.range(20_000).repartition(8).select(F.when(F.col("id") % 50 == 0, F.lit(None)).otherwise("hot").alias("k"))
    stats = spark.createDataFrame([("hot", 1.5), ("cold", 2.5)], "k string, v double")
    joined = attach_by_key(df, stats, ["k"], max_broadcast_bytes=limit, hot_rows=1000)
    sizes = [r["count"] for r in joined.where("k = 'hot'").groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 19_600 and max(sizes) <= 2 * sum(sizes) / len(sizes)
    assert {(r["k"], r["v"]) for r in joined.distinct().collect()} == {("hot", 1.5), (None, None)}


def test_salted_copies_when_hot_statistics_are_large(spark, monkeypatch):
    from tabloom.operators import joining

    monkeypatch.setattr(joining, "HOT_BYTES", 0)
    df = spark.range(3000).select((F.col("id") % 3).alias("k"), "id")
    stats = spark.createDataFrame([(0, "a"), (1, "b")], "k long, v string")
    got = attach_by_key(df, stats, ["k"], max_broadcast_bytes=0, hot_rows=10)
    assert {(r["k"], r["v"], r["count"]) for r in got.groupBy("k", "v").count().collect()} == {
        (0, "a", 1000), (1, "b", 1000), (2, None, 1000)}


def test_nested_columns_are_measured(spark):
    wide = spark.createDataFrame([(Vectors.dense([0.0] * 10_000), {"k": "x" * 9_000}, (["y" * 500] * 4,))] * 5)
    assert 5 * (80_000 + 9_000 + 2_000) <= table_bytes(wide) <= 2 * 5 * (80_000 + 9_000 + 2_000)


def test_codes_of_a_number_and_a_text_column(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y"), (20, "y"), (None, None)], "n long, t string")
    got = {(r["n"], r["t"]): (r["nIndexed"], r["tIndexed"]) for r in string_index(df, ["n", "t"]).collect()}
    assert got == {(1, "x"): (0.0, 1.0), (1, "y"): (0.0, 0.0), (20, "y"): (1.0, 0.0), (None, None): (2.0, 2.0)}


def test_a_null_key_keeps_its_scores(spark):
    rows = [(None, 1.0, 0.9, 1.0), (None, 0.0, 0.1, 0.0), ("a", 1.0, 0.2, 0.0), ("a", 1.0, 0.8, 1.0)]
    df = spark.createDataFrame(rows, "k string, prediction double, probability_one double, y double")
    got = {r["k"]: (r["accuracy"], r["auc"]) for r in classification_scores(df, "y", ["k"]).collect()}
    assert got == {None: (1.0, 1.0), "a": (0.5, 1.0)}


def test_medians_of_long_numbers_keep_every_digit(spark):
    big = 9007199254740993
    df = spark.createDataFrame([(big, 1.0), (None, None), (big, 3.0)], "n long, x double")
    row = impute_median(df, ["n", "x"], ["m", "y"]).where("n IS NULL").first()
    assert (row["m"], row["y"]) == (big, 1.0)


def test_ids_above_the_int_range(spark):
    df = spark.createDataFrame([(1 << 40, 1.0)], "id long, prediction double")
    assert classification_output(df, "id", "y").first()["id"] == 1 << 40
    assert regression_output(df, "id", "y").first()["id"] == 1 << 40
    assert dict(classification_output(spark.range(1).withColumn("prediction", F.lit(1.0)), "id", "y", id_type="int").dtypes)["id"] == "int"


def folders(spark):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/tabloom-{spark.sparkContext.applicationId}")
    fs = path.getFileSystem(conf)
    return [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []


def test_a_fold_of_one_class_and_the_margins_left_behind(spark):
    rows = VectorAssembler(inputCols=["a"], outputCol="features").transform(
        spark.range(60).select("id", (F.col("id") % 7).cast("double").alias("a"), F.lit(1.0).alias("label"))
    )
    before = sum(name.startswith("boost-rows") for name in folders(spark))
    booster = HistogramBooster(objective="logistic", rounds=6, maxDepth=2, writeEvery=2, idCol="id")
    scored = booster.fit(rows).transform(rows)
    assert scored.where("prediction = 1").count() == 60
    assert sum(name.startswith("boost-rows") for name in folders(spark)) <= before + 1
