"""The number of fits of whole runs: none twice, and all that can be shared is shared."""

import os

import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from tabloom.catalog import models
from tabloom.plans import experiments as ex
from tabloom.plans import grids, house, passenger, views
from tabloom.plans.fits import Fits, family, signatures
from tabloom.plans.steps import Steps
from tabloom.runtime import materialize
from tests.harness import DATA

SF = str(DATA / "sf0.001")


@pytest.fixture(scope="module")
def sides(spark):
    train, test = passenger.passenger_features(*views.passenger_sides(spark, SF))
    return materialize(train, "t"), materialize(test, "t")


def growths(candidates):
    return len({family(c.stages.getStages()[-1].chain()) if hasattr(c.stages.getStages()[-1], "chain") else family(c.stages.getStages()[-1].forest(13)) for c in candidates})


def test_whole_grids_share_their_growths(spark):
    assert [len(g) for g in (grids.rf_grid(), grids.gbt_grid(), grids.boost_grid())] == [24, 18, 12]
    assert [growths(g) for g in (grids.rf_grid(), grids.gbt_grid(), grids.boost_grid())] == [4, 9, 6]


def test_a_vote_takes_up_the_fits_of_a_selection(spark, sides):
    train, test = sides
    members = {
        "rf": grids.forest(42, 3, 3, 1, 0.8), "gbt": grids.boosted_residuals(42, 2, 2, 0.1), "xgb": grids.boosted(42, 2, 0.3, 2),
    }
    fits = ex.folded_fits(train, 2)
    ex.select_and_fit(train, test, [grids.Candidate("rf", members["rf"])], 2, fits=fits)
    assert fits.fitted == 3
    scores, models, voted = ex.soft_vote_cv(train, test, members, 2, fits=fits)
    assert scores.count() == 2 and voted.count() == test.count() and set(models) == set(members)
    # Two folds and all rows of two more members.
    assert fits.fitted == 9
    ex.soft_vote_cv(train, test, members, 2, fits=fits)
    ex.variant_cv(train, members["rf"], 2, fits=fits)
    assert fits.fitted == 9


def test_a_run_that_ended_goes_on(spark, sides, tmp_path, monkeypatch):
    train, test = sides
    base = grids.Candidate("rf", grids.forest(42, 3, 3, 1, 0.8))
    others = {"xgb": grids.boosted(42, 1, 0.3, 1)}
    whole = ex.postprocess(train, test, base, others, 2)
    steps = Steps(str(tmp_path), "sf0.001")

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as broken:
        # The run ends after the cross validation.
        broken.setattr(ex, "best_candidate", lost)
        with pytest.raises(RuntimeError):
            ex.postprocess(train, test, base, others, 2, steps=steps)
    calls = []
    real_cv = ex.variant_cv
    monkeypatch.setattr(ex, "variant_cv", lambda *a, **k: calls.append(1) or real_cv(*a, **k))
    first = ex.postprocess(train, test, base, others, 2, steps=steps)
    again = ex.postprocess(train, test, base, others, 2, steps=steps)
    assert not calls
    for done in (first, again):
        assert done.best == whole.best
        assert done.diagnostics.exceptAll(whole.diagnostics).count() == 0 and done.diagnostics.count() == whole.diagnostics.count()


def test_members_do_not_depend_on_the_layout(spark, sides):
    train, test = sides
    members = {"rf": grids.forest(1, 3, 3, 1, 0.8), "xgb": grids.boosted(1, 2, 0.3, 2), "lr": grids.logistic(0.1, 0.5)}
    outputs = []
    for parts in (1, 5):
        models = ex.fit_members(members, train.repartition(parts, F.rand(parts)))
        scored = ex.score_members(models, test, lambda n: {f"p_{n}": ex.prob_at_one(F.col("probability"))})
        outputs.append({r[0]: [round(x, 9) for x in r[1:]] for r in scored.select("PassengerId", *[f"p_{n}" for n in members]).collect()})
    assert outputs[0] == outputs[1]


def test_store_of_fits_needs_no_choices(spark, sides):
    train, _ = sides
    fits = Fits(train, [], ex.ID, ex.LABEL)
    assert fits.every == 0 and fits.rows(0).count() == train.count()


def test_candidates_of_a_grid_share_their_encoders(spark):
    """A default output column holds the stage's name; taken for a setting, it kept candidates from sharing anything."""
    for grid in (grids.rf_grid(), grids.gbt_grid(), grids.boost_grid(), grids.lr_grid()):
        assert len({signatures(c.stages)[:-1] for c in grid}) == 1
        assert len({signatures(c.stages) for c in grid}) == len(grid)


def test_encoded_rows_of_one_choice_are_held_at_a_time(spark, sides, monkeypatch):
    """Vectors are as many as the table's rows in each fold; those of all folds at once filled the disk."""
    train, _ = sides
    fits, held, written = ex.folded_fits(train, 3), [], []
    single, encoded = Fits._single_scores, Fits._encoded

    def watched(self, *args):
        held.append({key[-1] for key in self.prefixes})
        return single(self, *args)

    def kept(self, *args):
        found = encoded(self, *args)
        written.extend(files for _, _, *table in self.prefixes.values() for t in table for files in t.inputFiles())
        return found

    monkeypatch.setattr(Fits, "_single_scores", watched)
    monkeypatch.setattr(Fits, "_encoded", kept)
    lines = [c.stages for c in grids.lr_grid()[:2]]
    scores = fits.out_of_choice(lines, range(3))
    assert held == [{0}] * 2 + [{1}] * 2 + [{2}] * 2 and not fits.prefixes
    assert written and not any(os.path.exists(f.removeprefix("file://")) for f in written)
    assert scores.count() == 2 * train.count() and fits.fitted == 6
    # What is fitted already needs no rows again.
    written.clear()
    assert fits.out_of_choice(lines, range(3)).count() == 2 * train.count() and fits.fitted == 6 and not written


@pytest.fixture()
def fitted_on(monkeypatch):
    """The frames that pipelines are fitted on, with whether they are held then."""
    found, fit = [], Pipeline._fit

    def watched(self, dataset):
        found.append((dataset, dataset.is_cached))
        return fit(self, dataset)

    monkeypatch.setattr(Pipeline, "_fit", watched)
    return found


def test_stages_of_a_fit_share_one_exchange(spark, fitted_on):
    """Each stage exchanged all rows for itself, and columns that no stage reads with them."""
    prepared = ex.prepare_houses(views.houses(spark, SF))
    ex.validate_seeds(prepared, "lr", (42, 7)).collect()
    assert [held for _, held in fitted_on] == [True, True]
    assert all(not frame.is_cached and house.LABEL in frame.columns for frame, _ in fitted_on)


def test_trees_need_no_layout(spark, fitted_on):
    """Forests draw rows by their ids, so their rows are not exchanged before the fit."""
    models._predict(spark, SF, grids.forest(1, 3, 2, 1, 0.8))
    ((frame, held),) = fitted_on
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert not held and "Exchange" not in plan and "Name" not in frame.columns


def test_the_planted_table_is_scored_on_all_cores(spark, monkeypatch):
    """A small table came out in one partition, and each model scored it in one task."""

    class Seen(Exception):
        pass

    def fits(table, *args):
        raise Seen(table.rdd.getNumPartitions())

    monkeypatch.setattr(models, "Fits", fits)
    with pytest.raises(Seen) as seen:
        models.planted_price(spark, SF)
    assert seen.value.args[0] >= spark.sparkContext.defaultParallelism
