"""The catalog's fits have the library's own grids, folds, rounds and seeds."""

import inspect

import pytest

from tabloom import catalog
from tabloom.catalog import models, tables
from tabloom.plans import experiments as ex
from tabloom.plans import grids
from tests.harness import DATA

SF = str(DATA / "sf0.001")


class Called(Exception):
    pass


@pytest.fixture
def caught(spark, monkeypatch):
    """Arguments with which a query calls a function, which does not run."""

    def of(query, owner, name):
        kept = inspect.signature(getattr(owner, name))

        def catch(*args, **kwargs):
            bound = kept.bind(*args, **kwargs)
            bound.apply_defaults()
            raise Called(bound.arguments)

        with monkeypatch.context() as patch, pytest.raises(Called) as found:
            patch.setattr(owner, name, catch)
            catalog.queries()[query](spark, SF)
        return found.value.args[0]

    return of


@pytest.mark.parametrize("query, grid", [
    ("rf_class_grid", grids.rf_grid), ("gbt_class_grid", grids.gbt_grid), ("lr_class_grid", grids.lr_grid),
    ("boost_class_grid", grids.boost_grid),
])
def test_whole_grids(caught, query, grid):
    assert [c.name for c in caught(query, models, "_predict_all")["candidates"]] == [c.name for c in grid()]


def test_whole_selections(caught):
    for query, name, size in (("cv_score", "cv_scores", 9), ("grid_select_fit", "select_and_fit", 24)):
        got = caught(query, ex, name)
        assert (len(got["candidates"]), got["folds"]) == (size, 5)
    assert caught("variant_cv", ex, "variant_cv")["folds"] == 5
    got = caught("soft_vote_cv", ex, "soft_vote_cv")
    assert (tuple(got["members"]), got["folds"]) == (ex.VOTE_MEMBERS, 5)
    got = caught("postprocess_run", ex, "postprocess")
    assert (tuple(got["others"]), got["folds"], got["base"].name) == (ex.DISAGREEMENT_MODELS, 5, grids.rf_grid()[0].name)
    got = caught("experiment_table", ex, "run_experiments")
    assert (got["names"], got["folds"], got["grids"]) == (ex.MODEL_EXPERIMENTS, 5, None)


def test_default_rounds(caught):
    for query in ("gbt_reg", "boost_reg"):
        assert caught(query, models, "_price").get("settings", {}) == {}
    got = caught("blend_validation", ex, "blend_validate")
    assert got["seeds"] == (42, 1337, 2026) and got.get("settings", {}) == {}
    for query, grid in (("pipe_tree", grids.rf_grid), ("pipe_linear", grids.lr_grid), ("pipe_boost", grids.boost_grid)):
        model, own = caught(query, models, "_predict")["stages"].getStages()[-1], grid()[0].stages.getStages()[-1]
        settings = lambda m: {p.name: v for p, v in m.extractParamMap().items()}
        assert settings(model) == settings(own)


def test_every_candidate_predicts(spark):
    few = [grids.Candidate(f"lr_{reg}", grids.logistic(reg, 0.0)) for reg in (0.01, 0.1)]
    got = models._predict_all(spark, SF, few).groupBy("grid_pos", "candidate").count().collect()
    assert sorted((r["grid_pos"], r["candidate"]) for r in got) == [(0, "lr_0.01"), (1, "lr_0.1")]
    assert len({r["count"] for r in got}) == 1


def test_untyped_csv_has_all_columns(caught):
    assert len(caught("src_csv_untyped", tables, "write_parts")["df"].columns) > 2
