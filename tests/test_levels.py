"""Trees grown by level jobs: against brute force, over one and many partitions, and as beginnings of longer fits."""

import math
import random

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tabloom.plans import levels
from tabloom.plans.boost import BoostedTreesModel, HistogramBooster, HistogramForest
from tabloom.plans.encoded import encode_views
from tabloom.plans.fits import Fits
from tabloom.plans.steps import Steps
from tabloom.plans.trees import Trees, as_dicts, bins_of, from_dicts
from tests.test_models import brute_split

def stages_of(*model):
    return Pipeline(stages=[VectorAssembler(inputCols=["a", "b", "c"], outputCol="features", handleInvalid="keep"), *model])


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    rng = random.Random(11)
    made = []
    for i in range(700):
        a, b, c = rng.random() * 10, rng.choice([0.0, 1.0, math.nan]), float(rng.randrange(5))
        y = (3.0 if a > 4 else 0.0) + (2.0 if math.isnan(b) else b) + 0.1 * c
        made.append((i, a, b, c, y, float(y > 2.6 or rng.random() < 0.1), i % 3))
    path = str(tmp_path_factory.mktemp("levels") / "rows")
    spark.createDataFrame(made, "id long, a double, b double, c double, y double, k double, fold int").repartition(4).write.parquet(path)
    return spark.read.parquet(path)


def same(first: Trees, second: Trees) -> bool:
    return all(np.array_equal(x, y) for x, y in zip(first.arrays(), second.arrays()))


@pytest.mark.parametrize("seed", range(4))
def test_best_split_by_trying_all(seed):
    rng = random.Random(seed)
    rows = [{"g": float(rng.randrange(-20, 20)), "h": 1.0, "bins": [rng.randrange(-1, 6) for _ in range(4)]} for _ in range(80)]
    sums = np.zeros((2, 1, 4, 7))
    for r in rows:
        for f, b in enumerate(r["bins"]):
            sums[:, 0, f, b + 1] += r["g"], r["h"]
    found = levels.best_splits(sums, 1.0, 1.0)
    gain, feature, cut, missing_right = brute_split(rows)
    assert found["gain"][0] == pytest.approx(gain)
    assert (found["feature"][0], found["bin"][0] - 1, found["missing_left"][0]) == (-feature, -cut, not missing_right)
    assert found["left"][0] + found["right"][0] == pytest.approx(found["whole"][0])


def test_a_node_without_gain_is_a_leaf():
    sums = np.zeros((2, 1, 2, 4))
    sums[:, 0, :, 1] = [[3.0, 3.0], [3.0, 3.0]]
    sums[:, 0, :, 2] = [[3.0, 3.0], [3.0, 3.0]]
    assert levels.best_splits(sums, 0.0, 1.0)["gain"][0] == 0.0


def grown(rows, chains, forests):
    views = encode_views(rows, "id", "k", [F.col("fold") != 0, F.lit(True)], stages_of(), max_bins=32)
    out = views.grow(chains), [views.grow_forest(f) for f in forests], views.blocks.getNumPartitions()
    views.close()
    return out


def test_one_partition_and_many_give_the_same_trees(spark, rows, monkeypatch):
    chains = [
        levels.Chain("logistic", 0, 4, 3, 0.3, row_sample=0.8, column_sample=0.7), levels.Chain("log_residual", 1, 3, 2, 0.1, reg=0.0),
        levels.Chain("squared", 0, 2, 4, 0.5), levels.Chain("residual", 1, 3, 2, 0.5, reg=0.0),
    ]
    forests = [levels.Forest(0, 6, 4, 1.0, 0.8, 2, 7, True), levels.Forest(1, 3, 3, 2.0, 1.0, None, 7)]
    monkeypatch.setattr(levels, "TREES_TOGETHER", 4)
    one = grown(rows, chains, forests)
    monkeypatch.setattr(levels, "PARTITION_ROWS", 200)
    monkeypatch.setattr(levels, "BLOCK_ROWS", 64)
    monkeypatch.setattr(levels, "WRITE_EVERY", 2)
    monkeypatch.setattr(levels, "FOREST_CELLS", 200)
    many = grown(rows, chains, forests)
    assert one[2] == 1 < many[2]
    for first, second in zip(one[0] + one[1], many[0] + many[1]):
        assert same(first, second)
    # Chains that grow together are those that grow alone.
    alone, _, _ = grown(rows, chains[:1], [])
    assert same(alone[0], one[0][0])


def test_fewer_rounds_trees_and_levels_are_beginnings(spark, rows):
    short, long = ([levels.Chain("logistic", 1, n, 3, 0.3)] for n in (2, 5))
    small, large = ([levels.Forest(1, n, d, 1.0, 0.9, 2, 3, True)] for n, d in ((3, 2), (5, 4)))
    (first,), (few,), _ = grown(rows, short, small)
    (second,), (many,), _ = grown(rows, long, large)
    assert same(first, second[:2])
    model = HistogramForest(idCol="id", labelCol="k", numTrees=3, maxDepth=2)
    assert same(Trees.unpacked(model.model_of(many, []).getOrDefault("trees")), Trees.unpacked(model.model_of(few, []).getOrDefault("trees")))


def test_first_order_boosting_follows_its_residuals(spark, rows):
    stages = stages_of(HistogramBooster(objective="residual", labelCol="y", idCol="id", rounds=3, maxDepth=1, eta=0.5, regLambda=0.0, maxBins=32))
    model = stages.fit(rows)
    held = rows.select("id", "a", "b", "c", "y").collect()
    x = np.array([[r["a"], r["b"], r["c"]] for r in held])
    y = np.array([r["y"] for r in held])
    trees, cuts = from_dicts(model.stages[-1].getOrDefault("trees"))
    bins = bins_of(x, cuts)
    margin = np.zeros(len(y))
    for t in range(3):
        target = y if t == 0 else 2.0 * (y - margin)
        place = trees[t : t + 1].places(bins)[:, 0]
        for node in np.unique(place):
            weight = 1.0 if t == 0 else 0.5
            assert trees.value[t, node] == pytest.approx(weight * target[place == node].mean(), abs=1e-4)
        margin += trees[t : t + 1].values(bins)[:, 0]
    scored = {r["id"]: r["prediction"] for r in model.transform(rows).select("id", "prediction").collect()}
    assert [scored[r["id"]] for r in held] == pytest.approx(margin.tolist())


def test_trees_as_text_and_back():
    rng = np.random.default_rng(3)
    cuts = [np.array([1.0, 2.0, 5.0]), np.array([]), np.array([0.5])]
    trees = Trees.empty(2, 2)
    trees.feature[0, 0], trees.bin[0, 0], trees.missing_left[0, 0] = 0, 2, True
    trees.feature[0, 1], trees.bin[0, 1] = 2, 2
    trees.value[:] = rng.random(trees.value.shape)
    again, used = from_dicts(as_dicts(trees, cuts))
    x = np.array([[0.0, 1.0, 0.2], [1.5, 1.0, 0.7], [9.0, 0.0, math.nan], [math.nan, 0.0, 0.1]])
    assert np.allclose(trees.sums(bins_of(x, cuts))[:, 0], again.sums(bins_of(x[:, : len(used)], used))[:, 0])
    assert same(Trees.unpacked(trees.packed()), trees)


def boosted(rounds, **settings):
    return stages_of(HistogramBooster(objective="logistic", labelCol="k", idCol="id", rounds=rounds, maxDepth=2, maxBins=32, **settings))


def forest(trees, depth=3):
    return stages_of(HistogramForest(labelCol="k", idCol="id", numTrees=trees, maxDepth=depth))


def test_a_store_fits_nothing_twice(spark, rows):
    fits = Fits(rows, [F.col("fold") != f for f in range(3)], "id", "k", ["fold"])
    scores = fits.out_of_choice([boosted(2), boosted(3), forest(4), forest(2, 2)], range(3))
    assert scores.count() == 4 * 700 and fits.fitted == 6
    assert scores.groupBy("position", "choice").count().count() == 12
    fits.grow([boosted(3), forest(4)], range(3))
    fits.all_models({"a": boosted(3), "b": forest(3)}, 1)
    assert fits.fitted == 6
    # Scores from the blocks are those of the fitted models.
    for position, stages in ((1, boosted(3)), (3, forest(2, 2))):
        model = fits.model(stages, 2)
        column = F.col("probability").cast("string")
        plain = model.transform(rows.where("fold = 2")).select("prediction", column).count()
        own = scores.where((F.col("position") == position) & (F.col("choice") == 2))
        assert own.count() == plain
        hits = model.transform(rows.where("fold = 2")).agg(F.sum("prediction")).first()[0]
        assert own.agg(F.sum("prediction")).first()[0] == hits
    assert fits.fitted == 6
    assert isinstance(fits.model(boosted(2), 0).stages[-1], BoostedTreesModel)
    fits.close()


def test_steps_go_on_where_a_run_ended(spark, tmp_path):
    steps, made = Steps(str(tmp_path), "table v1"), []

    def compute(name, fails=False):
        def run():
            made.append(name)
            df = spark.range(3)
            return df.select(F.raise_error(F.lit("lost")).cast("long").alias("id")) if fails else df

        return run

    steps.table(spark, "first", 1, compute("first"))
    with pytest.raises(Exception):
        steps.table(spark, "second", 1, compute("second", fails=True))
    again = Steps(str(tmp_path), "table v1")
    assert again.table(spark, "first", 1, compute("first")).count() == 3
    assert again.table(spark, "second", 1, compute("second")).count() == 3
    assert made == ["first", "second", "second"]
    assert again.table(spark, "first", 2, compute("other")).count() == 3 and made[-1] == "other"


def test_a_large_table_has_work_for_all_cores():
    """900,000 rows were 4 partitions on any number of cores; small tables stay one."""
    assert levels.partitions_for(900_000, 12) == 12 and levels.partitions_for(300_000, 12) == 5
    assert levels.partitions_for(levels.PARTITION_ROWS, 12) == 1
    assert levels.partitions_for(9_000_000, 12) == 35


@pytest.mark.parametrize("direct", [0, 1 << 30])
def test_sums_added_up_by_the_driver_or_a_shuffle_give_the_same_trees(spark, rows, monkeypatch, direct):
    chains = [levels.Chain("logistic", 0, 2, 3, 0.3), levels.Chain("squared", 1, 2, 3, 0.5, column_sample=0.7)]
    one, _, _ = grown(rows, chains, [])
    monkeypatch.setattr(levels, "PARTITION_ROWS", 200)
    monkeypatch.setattr(levels, "BLOCK_ROWS", 64)
    # Parts of one feature and of one node, so that the best of several parts is looked for.
    monkeypatch.setattr(levels, "CELLS_TOGETHER", 1)
    monkeypatch.setattr(levels, "DIRECT_BYTES", direct)
    jobs = []
    shuffled = levels.reduced
    monkeypatch.setattr(levels, "reduced", lambda sums, keys=None: jobs.append(keys) or shuffled(sums, keys))
    many, _, parts = grown(rows, chains, [])
    assert parts > 1 and bool(jobs) == (direct == 0)
    assert all(same(x, y) for x, y in zip(one, many))


def test_sums_in_one_number_are_those_of_two(monkeypatch):
    """Sums of gradients and rows travel as one number while they have room, and as two from the block on that has none."""
    rng = np.random.default_rng(5)
    chain, scale = levels.Chain("residual", 0, 3, 2, 0.5), 2.0**15

    def blocks():
        for n, far in ((300, 1.0), (200, 900.0), (100, 1.0)):
            bins = np.asfortranarray(rng.integers(0, 6, (n, 3)).astype(np.uint8))
            yield levels.Block(view=0, y=rng.normal(size=n) * far, key=np.arange(n, dtype=np.uint64), bins=bins, margins={0: np.zeros(n)})

    held = list(blocks())
    work = lambda: [levels.Growing(chain, 0, 1, scale, np.arange(3), Trees.empty(1, 2), np.zeros(1, np.int64))]
    kinds = {}
    for upto in (1, 2, 3):
        ((key, sums),) = levels.level_sums(iter(held[:upto]), work(), [6])
        kinds[upto] = isinstance(sums, tuple)
        expected = np.zeros((2, 1, 3, 6))
        for block in held[:upto]:
            g = np.rint(-2.0 * block["y"] * scale) / scale
            for f in range(3):
                expected[0, 0, f] += np.bincount(block["bins"][:, f], g, 6)
                expected[1, 0, f] += np.bincount(block["bins"][:, f], minlength=6)
        assert key == (0, 0, 0, 0) and np.array_equal(levels.pair_of(sums), expected)
    assert kinds[1]
    monkeypatch.setattr(levels, "FLOAT_BITS", 40)
    ((_, sums),) = levels.level_sums(iter(held), work(), [6])
    assert not isinstance(sums, tuple) and np.array_equal(levels.pair_of(sums), expected)


def test_parts_of_sums_are_dealt_evenly():
    """Numbers of first nodes are multiples of 64, which dealt by themselves all met in one of 8 tasks."""
    nodes = [levels.number_of(first) % 8 for first in range(0, 64 * 64, levels.NODES_TOGETHER)]
    assert [nodes.count(i) for i in range(8)] == [8] * 8
    block = levels.Block(
        view=0, y=np.zeros(4), key=np.arange(4, dtype=np.uint64), bins=np.zeros((4, 40), np.uint8, order="F"), margins={i: np.zeros(4) for i in range(3)}
    )
    work = [levels.Growing(levels.Chain("squared"), i, 0, 1.0, np.arange(40), Trees.empty(1, 6), np.zeros(1, np.int64)) for i in range(3)]
    keys = [key for key, _ in levels.level_sums(iter([block]), work, [40000])]
    assert len(keys) > 8 and [levels.number_of(k) for k in keys] == list(range(len(keys)))


@pytest.mark.parametrize("rate", [0.3, 0.85, 1.0, 2.5])
def test_draws_by_their_first_bits(rate):
    """Draws looked up by 16 bits are those of the whole share, also where 16 bits do not tell."""
    keys = np.arange(200_000, dtype=np.uint64)
    steps = np.cumsum(np.exp(-rate) * np.cumprod(np.concatenate([[1.0], rate / np.arange(1, 16)])))
    expected = np.searchsorted(steps, levels.share_of(keys, 7, 3), side="right")
    found = levels.drawn(levels.hashed(keys, 7), 3, levels.draw_steps(rate))
    assert np.array_equal(found, expected) and (levels.draw_steps(rate)[1] < 0).any()


def test_a_model_reads_the_training_rows_of_its_view_only(spark, rows):
    views = encode_views(rows, "id", "k", [F.col("fold") != 0, F.col("fold") != 1, F.lit(True)], stages_of(), max_bins=32)
    counts = lambda chosen: sorted(views.training(chosen).map(lambda b: (b["view"], len(b["y"]), b["bins"].shape)).collect())
    first = rows.where("fold <> 0").count()
    assert counts([0]) == [(0, first, (first, 3))]
    assert {(v, n) for v, n, _ in counts([1, 2])} == {(1, rows.where("fold <> 1").count()), (2, 700)}
    assert set(views.training([0]).first()) == {"view", "y", "key", "bins"}


def test_choices_of_a_large_table_share_their_jobs(spark, rows, monkeypatch):
    """Three holdouts of 500 rounds were three times as many jobs; a table of one partition still has a task for each."""
    choices = [F.col("fold") != f for f in range(3)]
    asked, jobs = levels.asked, []
    monkeypatch.setattr(levels, "asked", lambda state, growing, setting: jobs.append(len(growing)) or asked(state, growing, setting))
    small = Fits(rows, choices, "id", "k", ["fold"], whole=False)
    small.grow([boosted(2)], range(3))
    assert not jobs and len(small.choices) == 3
    monkeypatch.setattr(levels, "PARTITION_ROWS", 200)
    monkeypatch.setattr(levels, "BLOCK_ROWS", 64)
    large = Fits(rows, choices, "id", "k", ["fold"], whole=False)
    large.grow([boosted(2)], range(3))
    assert jobs == [3] * 4
    assert all(same(trees, large.grown[place]) for place, trees in small.grown.items())
    # Sums beyond a task's room are asked for in batches.
    monkeypatch.setattr("tabloom.plans.fits.JOB_BYTES", 1)
    jobs.clear()
    more = Fits(rows, choices, "id", "k", ["fold"], whole=False)
    more.grow([boosted(1)], range(3))
    assert jobs == [1] * 6


def test_partitions_of_the_largest_tables_follow_the_cores():
    """54 million rows were 206 partitions on 12 cores, each with sums of its own to exchange."""
    assert levels.partitions_for(54_000_000, 12) == 36 and levels.partitions_for(54_000_000, 120) == 206


@pytest.mark.parametrize("kind", [np.uint8, np.uint16])
@pytest.mark.parametrize("layout", ["C", "F"])
def test_rows_go_down_trees_as_by_their_definition(kind, layout, monkeypatch):
    """Stepwise ways and sums against one row and node at a time, with missing values on both sides and the highest bin."""
    rng, most = np.random.default_rng(9), np.iinfo(kind).max
    bins = np.asarray(rng.choice([0, 1, 2, 3, most - 1, most], (90, 4)).astype(kind), order=layout)
    trees = Trees.empty(5, 3)
    inner = rng.random((5, 7)) < 0.8
    trees.feature[:, :7] = np.where(inner, rng.integers(0, 4, (5, 7)), -1)
    trees.bin[:, :7] = rng.choice([1, 2, 3, min(int(most), 32_000)], (5, 7))
    trees.missing_left[:3, :7], trees.value[:] = rng.random((3, 7)) < 0.5, rng.integers(0, 100, trees.value.shape)

    def leaf(t, row, depth):
        n = 0
        for _ in range(depth):
            f = trees.feature[t, n]
            if f < 0:
                break
            left = trees.missing_left[t, n] if row[f] == 0 else row[f] <= trees.bin[t, n]
            n = 2 * n + (1 if left else 2)
        return n

    monkeypatch.setattr("tabloom.plans.trees.ROWS", 32)
    for depth in (1, 2, 3):
        expected = [[sum(trees.value[t, leaf(t, row, depth)] for t in range(upto)) for upto in (2, 5)] for row in bins]
        assert trees.sums(bins, depth, (2, 5)).tolist() == expected
    node = np.zeros(len(bins), np.int64)
    for depth in (1, 2, 3):
        node = trees.step(bins, np.arange(len(bins)), node)
        assert node.tolist() == [leaf(0, row, depth) for row in bins]
    assert trees[1:2].only(bins).tolist() == [trees.value[1, leaf(1, row, 3)] for row in bins]
