"""Candidates of a grid that go over the rows together give what each of their models gives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.functions.numeric import prob_at_one
from tabloom.plans import encoded, grids, passenger, views
from tabloom.plans import experiments as ex
from tabloom.plans.fits import Fits
from tabloom.plans.trees import Trees
from tabloom.runtime import materialize
from tests.harness import DATA

def candidates():
    forests = [grids.forest(42, trees, depth, 1, 0.8) for trees in (2, 5) for depth in (2, 4)] + [grids.forest(42, 3, 3, 2, 1.0)]
    residuals = [grids.boosted_residuals(42, n, 2, step) for n in (2, 3) for step in (0.1, 0.3)]
    second_order = [grids.boosted(42, depth, 0.3, n) for depth in (2, 3) for n in (1, 3)]
    return [*forests, *residuals, *second_order, grids.logistic(0.1, 0.0), grids.logistic(0.01, 0.5)]


@pytest.fixture(scope="module")
def sides(spark):
    train, test = passenger.passenger_features(*views.passenger_sides(spark, str(DATA / "sf0.001")))
    return materialize(train, "t"), materialize(test, "t")


def test_all_candidates_at_once(spark, sides, monkeypatch):
    train, test = sides
    pipelines = candidates()
    fits = Fits(train, [], ex.ID, ex.LABEL)
    walks, summed = [], encoded.sums_of
    monkeypatch.setattr("tabloom.plans.fits.sums_of", lambda spark, asked, *args: walks.append(len(asked)) or summed(spark, asked, *args))
    found = fits.predictions(pipelines, fits.every, test, ["PassengerId"])
    assert found.columns == ["position", "PassengerId", "prediction", "score"]
    # One pass for the tree models of the same encoders and number of bins; each candidate was one of its own before.
    assert walks == [9, 4]
    parts = []
    for position, stages in enumerate(pipelines):
        scored = fits.model(stages, fits.every).transform(test)
        score = prob_at_one(F.col("probability"))
        parts.append(scored.select(F.lit(position).alias("position"), "PassengerId", "prediction", score.alias("score")))
    expected = ex.union_all(parts)
    assert found.count() == len(pipelines) * test.count() and found.dtypes == expected.dtypes
    assert found.exceptAll(expected).count() == 0


def test_less_deep_trees_are_on_the_way_of_deeper_ones(monkeypatch):
    rng = np.random.default_rng(2)
    bins, trees = rng.integers(0, 5, (100, 3)).astype(np.uint8), Trees.empty(4, 3)
    trees.feature[:, :7], trees.bin[:, :7] = rng.integers(-1, 3, (4, 7)), rng.integers(1, 5, (4, 7))
    trees.value[:] = rng.random(trees.value.shape)
    monkeypatch.setattr("tabloom.plans.trees.ROWS", 32)
    found = trees.sums_at(bins, (3, 0, 2), (1, 4))
    for d, depth in enumerate((3, 0, 2)):
        values = trees.values(bins, depth)
        assert np.allclose(found[d], np.stack([values[:, :1].sum(axis=1), values.sum(axis=1)], axis=1))
    calls = []
    step = Trees.step
    monkeypatch.setattr(Trees, "step", lambda self, *args: calls.append(1) or step(self, *args))
    trees.sums_at(bins[:30], (1, 2, 3), (4,))
    assert len(calls) == 4 * 3
