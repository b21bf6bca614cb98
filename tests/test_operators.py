"""Group statistics, joins, orders, metrics and folds, also on skewed and sliced data."""

import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from tabloom.operators import encode, folds, groups, metrics, ordering, quantile, votes
from tabloom.operators.joining import attach_by_key
from tabloom.runtime import fits_broadcast, materialize, table_bytes

FEW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def lower_middle(values):
    ordered = sorted(values)
    return ordered[(len(ordered) + 1) // 2 - 1]


def skewed(n=3000, seed=1):
    """A third of all rows under one key, some null keys and null values."""
    rng = random.Random(seed)
    keys = lambda: "hot" if rng.random() < 0.34 else rng.choice(["a", "b", "c", None])
    return [(i, keys(), None if rng.random() < 0.1 else rng.randrange(500) / 4) for i in range(n)]


def test_median_of_four_is_the_lower_middle(spark):
    df = spark.createDataFrame([(v,) for v in (4.0, 1.0, 3.0, 2.0)], "x double")
    assert quantile.global_median(df, "x", 0.0) == 2.0


def test_median_default_only_without_values(spark):
    df = spark.createDataFrame([(None,), (float("nan"),)], "x double")
    assert quantile.global_median(df, "x", 28.0) == 28.0


@pytest.mark.parametrize("per_slice", [10**6, 100])
def test_grouped_median_against_brute_force(spark, per_slice):
    rows = skewed()
    df = spark.createDataFrame(rows, "i int, k string, x double").repartition(4)
    got = {r["k"]: r["m"] for r in quantile.grouped_median(df, ["k"], "x", "m", rows_per_slice=per_slice).collect()}
    want = {}
    for _, k, x in rows:
        if x is not None:
            want.setdefault(k, []).append(x)
    assert got == {k: lower_middle(v) for k, v in want.items()}


@FEW
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=80), st.sampled_from([1, 7, 10**6]))
def test_median_of_any_list(spark, values, per_slice):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    assert quantile.global_median(df, "x", 0.0, rows_per_slice=per_slice) == lower_middle(values)


def test_large_longs_keep_all_digits(spark):
    big = 2**60 + 1
    df = spark.createDataFrame([(big,), (big + 2,), (big + 4,)], "x long")
    assert quantile.grouped_quantile(df, [], "x", "m").first()["m"] == big + 2


def test_impute_median_keeps_types_and_skips_nan(spark):
    df = spark.createDataFrame([(1, 1.0), (2, float("nan")), (None, 5.0), (4, None)], "a int, b double")
    out = quantile.impute_median(df, ["a", "b"], ["a2", "b2"])
    assert dict(out.dtypes)["a2"] == "int"
    assert sorted(r["a2"] for r in out.collect()) == [1, 2, 2, 4]
    assert sorted(r["b2"] for r in out.collect()) == [1.0, 1.0, 1.0, 5.0]


@pytest.mark.parametrize("limit,hot_rows", [(1 << 26, 10**6), (150, 500), (40, 100), (0, 10)])
def test_attach_gives_the_same_rows_however_it_joins(spark, limit, hot_rows):
    rows = skewed()
    df = spark.createDataFrame(rows, "i int, k string, x double").repartition(4)
    sizes = groups.group_size(df, ["k"], "n")
    got = attach_by_key(df, sizes, ["k"], max_broadcast_bytes=limit, hot_rows=hot_rows)
    count = {}
    for _, k, _ in rows:
        count[k] = count.get(k, 0) + 1
    want = sorted((i, k, float(count[k]) if k is not None else None) for i, k, _ in rows)
    assert sorted(map(tuple, got.select("i", "k", "n").collect())) == want


def test_hot_and_null_keys_stay_out_of_the_shuffle(spark):
    df = spark.createDataFrame(skewed(), "i int, k string, x double")
    sizes = groups.group_size(df, ["k"], "n")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = attach_by_key(df, sizes, ["k"], max_broadcast_bytes=40, hot_rows=700)
        plan = got._jdf.queryExecution().executedPlan().toString()
        # The one shuffle by key is below the anti join that takes hot keys out, and one part of a union.
        assert "Union" in plan and "LeftAnti" in plan and len(re.findall(r"SortMergeJoin", plan)) == 1
        assert got.count() == 3000 and got.where("n IS NULL").count() == df.where("k IS NULL").count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_attach_on_two_keys_keeps_unmatched_rows(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, None, 1), (4, "z", 9)], "i int, k string, j int")
    stats = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 20.0), (None, 1, 30.0)], "k string, j int, v double")
    for limit in (1 << 20, 0):
        got = attach_by_key(df, stats, ["k", "j"], max_broadcast_bytes=limit)
        assert sorted(map(tuple, got.select("i", "v").collect())) == [(1, 10.0), (2, 20.0), (3, None), (4, None)]


def test_table_size_is_measured(spark):
    table = materialize(spark.range(1000).withColumn("s", F.lit("x" * 100)))
    assert table_bytes(table) > 100_000
    assert not fits_broadcast(table, 50_000) and fits_broadcast(table, 1 << 20)


def test_evidence_without_rows_reads_null(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 1.0, 0), ("b", 0.0, 1)], "k string, f double, y int")
    out = groups.group_evidence(df, ["k"], {"in": F.col("f") == 1.0}, "y")
    assert {r["k"]: (r["in_count"], r["in_rate"]) for r in out.collect()} == {"a": (2.0, 0.5), "b": (None, None)}


def test_positions_follow_the_order(spark):
    rows = [(i, random.Random(i).randrange(5)) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, v int").repartition(6)
    got = ordering.position_in_order(df, [F.col("v").desc(), F.col("i").asc()])
    want = [i for i, _ in sorted(rows, key=lambda r: (-r[1], r[0]))]
    assert [r["i"] for r in sorted(got.collect(), key=lambda r: r["position"])] == want
    assert sorted(r["position"] for r in got.collect()) == list(range(500))


def test_best_candidate_prefers_accuracy_then_auc_then_grid_order(spark):
    rows = [("a", 0.8, 0.7, 0), ("b", 0.9, 0.6, 1), ("c", 0.9, 0.65, 3), ("d", 0.9, 0.65, 2)]
    df = spark.createDataFrame(rows, "name string, accuracy double, auc double, grid_pos int")
    assert ordering.best_candidate(df).first()["name"] == "d"


def test_codes_by_frequency_then_value(spark):
    fit = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",), (None,)], "v string")
    df = spark.createDataFrame([("a",), ("b",), ("c",), (None,), ("unseen",)], "v string")
    got = {r["v"]: r["vIndexed"] for r in encode.string_index(df, ["v"], fit).collect()}
    assert got == {"a": 0.0, "b": 1.0, "c": 2.0, None: 3.0, "unseen": 3.0}
    same = encode.indexer(["v"], ["m"]).fit(fit).transform(df)
    assert {r["v"]: r["m"] for r in same.collect()} == got


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 3.0)], "a double, b double")
    vectors = encode.assembler(["a", "b"], "v").transform(df)
    for centered in (True, False):
        out = encode.scaler("v", "s", centered).fit(vectors).transform(vectors)
        assert [r["s"][1] for r in out.collect()] == [0.0, 0.0]


def test_densifier_is_a_stage_that_can_be_stored(spark, tmp_path):
    df = encode.assembler(["a"], "v").transform(spark.createDataFrame([(0.0,)], "a double"))
    stage = encode.Densifier(inputCol="v", outputCol="d")
    stage.write().overwrite().save(str(tmp_path / "stage"))
    again = encode.Densifier.load(str(tmp_path / "stage"))
    assert type(again.transform(df).first()["d"]).__name__ == "DenseVector"


def pair_auc(rows):
    pos = [s for s, y in rows if y == 1]
    neg = [s for s, y in rows if y == 0]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("per_slice", [10**6, 20])
def test_auc_counts_pairs_with_ties(spark, per_slice):
    rng = random.Random(3)
    rows = [(round(rng.random(), 2), int(rng.random() < 0.4)) for _ in range(400)]
    df = spark.createDataFrame(rows, "s double, y int").repartition(5)
    got = metrics.roc_auc(df, "s", "y", rows_per_slice=per_slice).first()["auc"]
    assert got == pytest.approx(pair_auc(rows), abs=1e-12)
    raw = df.withColumn("y", F.col("y").cast("double"))
    exact = BinaryClassificationEvaluator(rawPredictionCol="s", labelCol="y", numBins=0).evaluate(raw)
    assert got == pytest.approx(exact, abs=1e-12)


def test_auc_with_one_class_is_null(spark):
    df = spark.createDataFrame([(0.1, 1), (0.2, 1)], "s double, y int")
    assert metrics.roc_auc(df, "s", "y").first()["auc"] is None


def test_recorded_spread_of_three_seeds(spark):
    df = spark.createDataFrame([(0.11452,), (0.11708,), (0.13001,)], "rmse double")
    row = metrics.seed_summary(df, "rmse").first()
    assert round(row["stddev"], 5) == 0.00678 and round(row["mean"], 5) == 0.12054
    assert metrics.seed_summary(df.limit(1), "rmse").count() == 0


def test_sweep_columns(spark):
    df = spark.createDataFrame([(1.0, 0.0, 2.0), (3.0, 2.0, 4.0)], "y double, a double, b double")
    row = metrics.blend_sweep(df, "a", "b", "y").first().asDict()
    assert list(row) == [f"rmse_xgb_{w}" for w in (0, 10, 20, 30, 40, 50)]
    assert row["rmse_xgb_0"] == 1.0 and row["rmse_xgb_50"] == 0.0


def test_vote_sums_and_nulls(spark):
    df = spark.createDataFrame([(1, 1, 1), (2, 1, 0), (3, 0, 0), (4, 1, None)], "i int, pred_a int, pred_b int")
    strict = {r["i"]: (r["vote_sum"], r["split"]) for r in votes.vote_sum(df, flag="split").collect()}
    assert strict == {1: (2, False), 2: (1, True), 3: (0, False), 4: (None, None)}
    loose = votes.vote_sum(df, flag="split", null_as_zero=True).where("i = 4").first()
    assert (loose["vote_sum"], loose["variant_count"], loose["split"]) == (1, 2, True)


def test_vote_is_inclusive_at_the_threshold(spark):
    df = spark.createDataFrame([(0.25, 0.75), (0.25, 0.5)], "p0 double, p1 double")
    assert [r["prediction"] for r in votes.soft_vote(df, ["p0", "p1"]).collect()] == [1.0, 0.0]


def test_folds_partition_rows_and_survive_repartitioning(spark):
    df = spark.range(2000)
    first = {r["id"]: r["__fold"] for r in folds.with_folds(df, "id", 5).collect()}
    again = {r["id"]: r["__fold"] for r in folds.with_folds(df.repartition(7), "id", 5).collect()}
    assert first == again and set(first.values()) == set(range(5))
    train, rest = folds.fold_split(folds.with_folds(df, "id", 5), 2)
    assert train.count() + rest.count() == 2000 and train.join(rest, "id").count() == 0


def test_fold_of_the_smallest_hash_does_not_overflow(spark):
    # The hash is widened before its sign is dropped; the smallest int alone would raise.
    widened = F.pmod(F.abs(F.lit(-(2**31)).cast("long")), F.lit(5)).cast("int")
    assert spark.range(1).select(widened).first()[0] == (2**31) % 5
    ids = folds.with_folds(spark.range(100_000), "id", 5)
    assert ids.where((F.col("__fold") < 0) | (F.col("__fold") > 4)).count() == 0


def test_holdout_is_stable_and_near_its_share(spark):
    df = spark.range(20_000)
    train, rest = folds.holdout(df, 42, "id")
    again, _ = folds.holdout(df.repartition(9), 42, "id")
    assert train.exceptAll(again).count() == 0 and train.count() + rest.count() == 20_000
    assert 0.78 < train.count() / 20_000 < 0.82
    other, _ = folds.holdout(df, 43, "id")
    assert train.exceptAll(other).count() > 0
    parts = folds.holdout(df, 42, "id", by_partition=True)
    assert sum(p.count() for p in parts) == 20_000
