"""Every query with a SQL twin gives the twin's rows; the others give rows."""

import pytest

import __spark_entry__ as entry
from tabloom import catalog
from tests.harness import DATA, differences

QUERIES, TWINS = catalog.queries(), catalog.oracle_sql()
# Fits that other tests run at this size already.
SLOW = {
    "rf_class_baseline", "rf_class_grid", "gbt_class_grid", "lr_class_grid", "boost_class_grid", "gbt_reg", "rf_reg",
    "experiment_table", "soft_vote_cv", "grid_select_fit", "cv_score", "variant_cv", "postprocess_run",
    "blend_validation", "multi_seed_validation", "boost_reg", "pipe_boost",
}


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twin(spark, name):
    sf_dir = str(DATA / "sf0.001")
    assert differences(QUERIES[name](spark, sf_dir), TWINS[name], sf_dir) == []


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - TWINS.keys() - SLOW))
def test_rows(spark, name):
    assert QUERIES[name](spark, str(DATA / "sf0.001")).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "Survived"


def test_twins_belong_to_queries():
    assert TWINS.keys() <= QUERIES.keys() <= entry.queries().keys()
    assert TWINS.items() <= entry.oracle_sql().items()
