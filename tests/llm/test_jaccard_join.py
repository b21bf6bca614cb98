import random

import pytest

from tabloom.llm import base
from tabloom.llm import jaccard_join as jj
from tabloom.llm.components import components
from tests.llm.data import awkward, documents, prose


def sets_of(text, words):
    own = (text or "").encode().lower().split()
    if not own:
        return frozenset()
    return frozenset(tuple(own[i : i + words]) for i in range(max(len(own) - words + 1, 1)))


def brute(rows, words, percent):
    """Component and number of links by comparing every pair."""
    sets = [(i, sets_of(t, words)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(sets)
    for x, (i, a) in enumerate(sets):
        for y, (j, b) in enumerate(sets[:x]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                links[x] += 1
                links[y] += 1
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return sorted((i, len(s), find(i), n) for (i, s), n in zip(sets, links))


def near_copies(seed):
    rng = random.Random(seed)
    rows = []
    for group in range(6):
        base = prose(rng, rng.choice([3, 30, 90, 150]), 400).split()
        for _ in range(12):
            own = list(base)
            for _ in range(rng.randrange(0, 6)):
                own[rng.randrange(len(own))] = f"e{rng.randrange(9)}"
            rows.append((len(rows) + 100, " ".join(own)))
    rows += [(len(rows) + 100, prose(rng, 60, 400)) for _ in range(20)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, words, percent, block", [(1, 4, 85, 1000), (2, 5, 80, 5), (3, 2, 60, 7)])
def test_groups_by_brute_force(spark, seed, words, percent, block):
    rows = near_copies(seed) + awkward(seed)
    got = jj.jaccard_groups(documents(spark, rows), words=words, percent=percent, block=block)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, words, percent)


def test_search_finds_what_a_scan_finds():
    rng = random.Random(9)
    import numpy as np

    sets = [np.unique(np.array([rng.randrange(60) for _ in range(rng.randrange(1, 50))])) for _ in range(150)]
    index = jj.Index(sets)
    for percent in (50, 70, 85, 100):
        for q in sets[:40]:
            want = [i for i, s in enumerate(sets) if 100 * len(np.intersect1d(q, s)) >= percent * len(np.union1d(q, s))]
            assert index.search(q, percent).tolist() == want


def test_empty_table_and_null_ids(spark):
    assert jj.jaccard_groups(documents(spark, [])).count() == 0
    got = jj.jaccard_groups(documents(spark, [(None, "a b c d e"), (1, "a b c d e")])).collect()
    assert [tuple(r) for r in got] == [(1, 2, 1, 0)]


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1040)]
    got = components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {(r["node"], r["component"]) for r in got} == {(i, 0) for i in range(61)} | {(i, 1000) for i in range(1000, 1040)}


def test_workers_hold_little_text_at_once(spark):
    """Four workers beside a grown JVM have 3,000 MB together; 8 MB of Arrow text and 4 MB of shingles were too much."""
    base.bounded_batches(spark)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 2 << 20
    assert base.CUT_BYTES <= 2 << 20 and jj.CUT <= 2 << 20
