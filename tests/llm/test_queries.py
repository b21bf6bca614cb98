"""Every query with a SQL twin gives the twin's rows on the smallest tables."""

import pytest

from tabloom import llm
from tests.harness import DATA, differences

TWINS = llm.oracle_sql()


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twin(spark, name):
    sf_dir = str(DATA / "sf0.001")
    assert differences(llm.queries()[name](spark, sf_dir), TWINS[name], sf_dir) == []


def test_all_are_registered():
    assert {name.split("_")[0] for name in llm.queries()} == {f"op{n}" for n in range(1, 14)}
