"""Where intermediate tables go, and how they are laid out."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tabloom.operators.folds import with_folds
from tabloom.operators.quantile import grouped_median
from tabloom import runtime
from tabloom.plans import passenger, views
from tabloom.runtime import deal, in_fixed_order, materialize, scratch_path, scratch_root, together
from tests.harness import DATA


def fake(master, configured="", current=None):
    held = {"dir": current}
    context = SimpleNamespace(
        master=master,
        getCheckpointDir=lambda: held["dir"],
        setCheckpointDir=lambda folder: held.update(dir=f"file:{folder}"),
    )
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: configured or default))


def test_the_cluster_names_the_folder():
    assert scratch_root(fake("spark://host:7077", "hdfs://shared/dir/")) == "hdfs://shared/dir"
    assert scratch_root(fake("spark://host:7077", "", "hdfs://shared/other")) == "hdfs://shared/other"
    with pytest.raises(RuntimeError):
        scratch_root(fake("spark://host:7077"))


def test_local_mode_makes_its_own_folder_once():
    session = fake("local[2]")
    first = scratch_root(session)
    assert first.startswith("file:") and scratch_root(session) == first


def test_paths_are_never_shared(spark):
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_spread_uses_all_cores_and_keeps_rows(spark):
    table = materialize(spark.range(100).coalesce(1), spread=True)
    assert table.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sorted(r["id"] for r in table.collect()) == list(range(100))
    wide = spark.range(100).repartition(64)
    assert deal(wide) is wide


def test_the_fixed_layout_grows_with_the_rows(spark, monkeypatch):
    """16 partitions whatever the table made one task read more and more."""
    rows = spark.range(500)
    assert in_fixed_order(rows, "id").rdd.getNumPartitions() == 16
    monkeypatch.setattr(runtime, "FIT_ROWS", 10)
    assert in_fixed_order(rows, "id").rdd.getNumPartitions() == 50
    spark.conf.set("spark.tabloom.fit.partitions", "3")
    try:
        assert in_fixed_order(rows, "id").rdd.getNumPartitions() == 3
    finally:
        spark.conf.unset("spark.tabloom.fit.partitions")


def test_a_fold_filter_reads_its_own_files(spark):
    table = materialize(with_folds(spark.range(500), "id", 5), partition_by=["__fold"])
    one = table.where(F.col("__fold") == 2)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(__fold" in plan
    assert one.count() == with_folds(spark.range(500), "id", 5).where("__fold = 2").count()


def test_jobs_run_together_in_order(spark):
    counts = together(spark, [lambda n=n: spark.range(n).count() for n in (3, 1, 2)])
    assert counts == [3, 1, 2] and together(spark, []) == []


def test_sketched_medians_agree_on_small_groups(spark):
    rows = views.passengers(spark, str(DATA / "sf0.001"))
    for column in ("Age", "Fare"):
        exact = grouped_median(rows, ["Sex", "Pclass"], column, "m")
        sketched = grouped_median(rows, ["Sex", "Pclass"], column, "m", approximate=True)
        assert exact.exceptAll(sketched).count() == 0
    train, test = views.passenger_sides(spark, str(DATA / "sf0.001"))
    features, _ = passenger.passenger_features(train, test, exact=False)
    assert features.where("AgeFilled IS NULL OR FareFilled IS NULL").count() == 0


def test_scans_read_only_what_a_query_needs(spark):
    rows = passenger.row_features(views.passengers(spark, str(DATA / "sf0.001")))
    plan = rows.groupBy("Surname").count()._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan and "o_orderstatus" not in plan and "o_orderpriority" not in plan
