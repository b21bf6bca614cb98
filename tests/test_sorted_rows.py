"""Growth by a task that has all rows: against growth from blocks, on large and small nodes, labels with and without room."""

import random
from functools import partial

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tabloom.plans import levels, sorted_rows
from tabloom.plans.boost import HistogramBooster
from tabloom.plans.encoded import encode_views
from tabloom.plans.fits import Fits
from tabloom.plans.trees import Trees

COUNTS = [4, 40, 9, 5, 33, 300]


def made_blocks(rng, kind, far=1.0):
    for n in (500, 301, 40):
        bins = np.stack([rng.integers(0 if c != 9 else 1, min(c, np.iinfo(kind).max), n) for c in COUNTS], axis=1).astype(kind)
        y = np.where(bins[:, 0] + bins[:, 2] > 5, 1.0, 0.0) * far
        y = np.where(rng.random(n) < 0.2, far - y, y)
        yield levels.Block(view=0, y=y, key=rng.integers(0, 1 << 62, n).astype(np.uint64), bins=np.asfortranarray(bins))


@pytest.mark.parametrize("large, cells", [(1, 2048), (1, 4), (60, 200), (1 << 20, 2048)])
@pytest.mark.parametrize("kind, classes, far", [(np.uint8, True, 1.0), (np.uint16, False, 0.37), (np.uint16, False, 1e13)])
def test_rows_sorted_by_node_give_the_trees_of_blocks(monkeypatch, large, cells, kind, classes, far):
    monkeypatch.setattr(sorted_rows, "LARGE_NODE", large)
    monkeypatch.setattr(sorted_rows, "JOINT_CELLS", cells)
    monkeypatch.setattr(levels, "SORTED_BYTES", 40_000)
    held = list(made_blocks(np.random.default_rng(4), kind, far))
    forest = levels.Forest(0, 7, 6, 2.0, 0.9, 3, 11, classes)
    grove = lambda: levels.Grove(forest, 0, Trees.empty(7, 6), len(COUNTS), 300, 1.0 if classes else 1024.0)
    (found,) = levels.grove_here(iter(held), grove(), COUNTS)
    blocks = grove()
    ask = lambda level, tree, node: list(levels.forest_splits(blocks.sums(iter(held), level, tree, node), forest.least))
    expected = blocks.grow(ask).arrays()
    assert (expected[0] >= 0).sum() > 100 and expected[2].any()
    assert all(np.array_equal(x, y) for x, y in zip(found, expected))


def test_features_are_counted_as_one_within_the_room():
    groups = sorted_rows.together_by_bins((4, 33, 5, 6, 33, 300), 1100)
    assert sorted(p for g in groups for p in g) == list(range(6))
    sizes = [int(np.prod([[4, 33, 5, 6, 33, 300][p] for p in g])) for g in groups]
    assert max(sizes) <= 1100 and len(groups) == 3
    assert sorted_rows.together_by_bins((300, 4), 10) == [[0], [1]]


def test_a_forest_on_a_larger_table_exchanges_nothing(spark, tmp_path, monkeypatch):
    """Each level of each 75 trees was a job with a shuffle of sums, and drew all rows and took them down from the root again."""
    rng = random.Random(3)
    rows = [(i, rng.random(), float(rng.randrange(4)), float(rng.random() < 0.4)) for i in range(600)]
    spark.createDataFrame(rows, "id long, a double, b double, k double").repartition(4).write.parquet(str(tmp_path / "t"))
    monkeypatch.setattr(levels, "PARTITION_ROWS", 200)
    monkeypatch.setattr(levels, "BLOCK_ROWS", 64)
    stages = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="features")])
    views = encode_views(spark.read.parquet(str(tmp_path / "t")), "id", "k", [F.col("id") % 3 != 0], stages, max_bins=32)
    exchanged, shuffled = [], levels.reduced
    monkeypatch.setattr(levels, "reduced", lambda *args: exchanged.append(1) or shuffled(*args))
    forest = levels.Forest(0, 5, 4, 1.0, 0.9, 1, 7, True)
    whole = views.grow_forest(forest)
    assert not exchanged and views.blocks.getNumPartitions() > 1 and views.counts == [400]
    # A table beyond a task's room grows from its partitions.
    monkeypatch.setattr(levels, "WHOLE_BYTES", 799)
    parts = views.grow_forest(forest)
    assert exchanged and all(np.array_equal(x, y) for x, y in zip(whole.arrays(), parts.arrays()))
    assert partial(levels.bins_bytes, 400)([np.arange(3.0)] * 2) == 800 and levels.bins_bytes(4, [np.arange(300.0)]) == 8


@pytest.mark.parametrize("large", [1, 50])
@pytest.mark.parametrize("chain", [
    levels.Chain("squared", 0, 5, 4, 0.3, row_sample=0.8, column_sample=0.7), levels.Chain("residual", 0, 4, 3, 0.5, reg=0.0),
    levels.Chain("logistic", 0, 4, 4, 0.3, row_sample=0.6), levels.Chain("log_residual", 0, 4, 3, 0.1, reg=0.0), levels.Chain("squared", 0, 2, 0),
])
def test_a_chain_from_all_rows_is_that_of_blocks(monkeypatch, large, chain):
    """The side of fewer rows is counted, the other is the rest of their node; both as if both were counted."""
    monkeypatch.setattr(sorted_rows, "LARGE_NODE", large)
    held = list(made_blocks(np.random.default_rng(6), np.uint16))
    scale, start = 2.0**20, 0.25
    setting = levels.Setting([chain], [scale], [len(COUNTS)], [300])
    ((_, found),) = levels.rounds_here(iter(held), setting, COUNTS, {0: start})
    state = [{**block, "margins": {0: np.full(len(block["y"]), start)}} for block in held]
    grown = []
    for number in range(chain.rounds):
        ask = lambda work: list(levels.level_splits(levels.added(levels.level_sums(iter(state), work, [300])), setting.limits))
        done = setting.round(number, ask)
        state = list(levels.with_trees(iter(state), done))
        grown.append(done[0][2])
    expected = levels.joined(grown).arrays()
    assert chain.depth == 0 or (expected[0] >= 0).sum() > 10
    assert all(np.array_equal(x, y) for x, y in zip(found, expected))


def test_a_long_chain_on_a_larger_table_is_one_task(spark, tmp_path, monkeypatch):
    """500 rounds of depth 6 on 0.1 GB were 3,000 jobs, each with all rows read, drawn and taken down from the root again."""
    rng = random.Random(8)
    rows = [(i, rng.random(), float(rng.randrange(4)), float(rng.random() < 0.4)) for i in range(600)]
    spark.createDataFrame(rows, "id long, a double, b double, k double").repartition(4).write.parquet(str(tmp_path / "t"))
    monkeypatch.setattr(levels, "PARTITION_ROWS", 200)
    monkeypatch.setattr(levels, "BLOCK_ROWS", 64)
    stages = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="features")])
    choices = [F.col("id") % 3 != 0, F.col("id") % 3 != 1]
    views = encode_views(spark.read.parquet(str(tmp_path / "t")), "id", "k", choices, stages, max_bins=32)
    asked, jobs = levels.asked, []
    monkeypatch.setattr(levels, "asked", lambda state, growing, setting: jobs.append(len(growing)) or asked(state, growing, setting))
    chains = [levels.Chain("logistic", v, 33, 2, eta) for v in (0, 1) for eta in (0.1, 0.3)]
    alone = views.grow(chains)
    assert not jobs and views.parts > 1 and all(views.alone(c) for c in chains)
    # A table beyond a task's room grows from its partitions.
    monkeypatch.setattr(levels, "CHAIN_BYTES", 799)
    shared = views.grow(chains)
    assert jobs == [4] * len(jobs) and len(jobs) > 33 and not any(views.alone(c) for c in chains)
    for one, many in zip(alone, shared):
        assert all(np.array_equal(x, y) for x, y in zip(one.arrays(), many.arrays()))


def test_a_level_job_counts_the_lighter_sides_only(spark, monkeypatch):
    """Every level counted all rows, though of two sides one is what is left of their node."""
    held = list(made_blocks(np.random.default_rng(12), np.uint16))
    chain = levels.Chain("squared", 0, 3, 4, 0.3)
    cuts = [[np.arange(float(c - 2)) for c in COUNTS]]
    seen, counted = [], levels.splits_of

    def watched(growing, nodes, parts, setting):
        parts = list(parts)
        seen.append((growing[0].level, sum(own[1, :, 0].sum() for (_, _, feature, _), own in parts if feature == 0)))
        return counted(growing, nodes, iter(parts), setting)

    grow = lambda: levels.grow_chains(spark, spark.sparkContext.parallelize(held, 2), [chain], cuts, [0.25], [3.0])[0]
    monkeypatch.setattr(levels, "splits_of", watched)
    direct = grow()
    assert [level for level, _ in seen] == [0, 1, 2, 3] * 3
    assert all(rows == 841 if level == 0 else 0 < rows <= 841 / 2 for level, rows in seen)
    monkeypatch.setattr(levels, "DIRECT_BYTES", 0)
    assert all(np.array_equal(x, y) for x, y in zip(direct.arrays(), grow().arrays()))


def test_chains_of_all_depths_share_their_jobs(spark, tmp_path, monkeypatch):
    """Boosters of each depth were jobs of their own, each of which read all rows with keys that no chain needs."""
    rng = random.Random(9)
    rows = [(i, rng.random(), float(rng.randrange(4)), float(rng.random() < 0.4)) for i in range(600)]
    spark.createDataFrame(rows, "id long, a double, b double, k double").repartition(4).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))

    def boosted(depth, sample=1.0):
        model = HistogramBooster(objective="logistic", labelCol="k", idCol="id", rounds=2, maxDepth=depth, rowSample=sample, maxBins=32)
        return Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="features"), model])

    alone = Fits(table, [], "id", "k")
    alone.grow([boosted(1), boosted(3), boosted(3, 0.8)], [0])
    monkeypatch.setattr(levels, "PARTITION_ROWS", 200)
    monkeypatch.setattr(levels, "BLOCK_ROWS", 64)
    asked, jobs = levels.asked, []
    seen = lambda state: jobs.append((state.getNumPartitions() > 1, *sorted(state.first()), state.first()["y"].dtype))
    monkeypatch.setattr(levels, "asked", lambda state, growing, setting: seen(state) or asked(state, growing, setting))
    shared = Fits(table, [], "id", "k")
    shared.grow([boosted(1), boosted(3)], [0])
    assert jobs == [(True, "bins", "margins", "view", "y", np.dtype(np.uint8))] * 6
    jobs.clear()
    shared.grow([boosted(3, 0.8)], [0])
    assert all("key" in job for job in jobs) and len(jobs) == 6
    for place, trees in alone.grown.items():
        assert all(np.array_equal(x, y) for x, y in zip(trees.arrays(), shared.grown[place].arrays()))


def test_a_round_writes_margins_only(spark, monkeypatch):
    """Each round held all blocks anew, with the bins, beside those of the round before."""
    held = list(made_blocks(np.random.default_rng(13), np.uint16))
    chains = [levels.Chain("squared", 0, 3, 2, 0.3), levels.Chain("squared", 0, 2, 3, 0.1)]
    cuts = [[np.arange(float(c - 2)) for c in COUNTS]]
    written, tables, kept = [], [], levels.block_by_block

    def watched(blocks):
        tables.append(kept(blocks))
        written.append(tables[-1].first())
        return tables[-1]

    monkeypatch.setattr(levels, "block_by_block", watched)
    levels.grow_chains(spark, spark.sparkContext.parallelize(held, 2), chains, cuts, [0.25] * 2, [3.0] * 2, write_every=2)
    fixed, *margins = written
    assert set(fixed) == {"view", "y", "bins"} and len(margins) == 3
    assert all(set(m) == {0, 1} and all(x.dtype == np.float64 and len(x) == len(fixed["y"]) for x in m.values()) for m in margins)
    assert not any(t.getStorageLevel().useMemory or t.getStorageLevel().useDisk for t in tables)
