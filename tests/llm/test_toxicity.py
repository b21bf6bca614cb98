import random

import numpy as np

from tabloom.llm import toxicity as tx
from tests.llm.data import awkward, documents, prose


def labelled(n, seed):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = prose(rng, rng.randrange(20, 80), 500).split()
        for _ in range(rng.choice([1, 2, 6, 8]) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["vile", "vilest", "awful!", "Nasty"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_order_of_severity(spark):
    rows, labels = labelled(600, 1)
    table = spark.createDataFrame(labels[:400], "doc_id long, toxic int")
    model = tx.train(documents(spark, rows), table)
    assert model.cuts == sorted(model.cuts) and len(model.cuts) == 2
    scored = {r["doc_id"]: r["expected_severity"] for r in tx.score(documents(spark, rows), model).collect()}
    caught = [scored[i] >= tx.THRESHOLD for i, t in labels[400:] if t]
    clean = [scored[i] >= tx.THRESHOLD for i, t in labels[400:] if not t]
    assert np.mean(caught) > 0.95 and np.mean(clean) < 0.02
    mild, hard = "w1 w2 vile w3", "w1 vile vilest awful nasty w3"
    two = tx.score(documents(spark, [(1, mild), (2, hard), (3, "w1 w2 w3")]), model).orderBy("doc_id").collect()
    assert two[2]["expected_severity"] < two[0]["expected_severity"] < two[1]["expected_severity"] <= 2


def test_gradient_reaches_the_optimum_of_a_small_model():
    # One feature, three grades: the fit must beat its neighbours in likelihood.
    rng = np.random.default_rng(0)
    grades = rng.integers(0, 3, 300)
    lists = [np.array([7] * int(rng.random() < 0.1 + 0.4 * g), np.int64) for g in grades]
    model = tx.fit_severity(lists, grades, rounds=800, spread=100.0)

    def loss(w, cuts):
        s = np.array([w * len(x) for x in lists])
        edges = np.array([-np.inf, *cuts, np.inf])
        p = tx.sigmoid(edges[grades + 1] - s) - tx.sigmoid(edges[grades] - s)
        return -np.log(p).sum()

    w, cuts = model.weights[7], model.cuts
    best = loss(w, cuts)
    for dw, a, b in [(0.1, 0, 0), (-0.1, 0, 0), (0, 0.1, 0), (0, -0.1, 0), (0, 0, 0.1), (0, 0, -0.1)]:
        assert best <= loss(w + dw, [cuts[0] + a, cuts[1] + b]) + 1e-3


def test_awkward_rows_and_missing_labels(spark):
    docs = documents(spark, awkward())
    none = spark.createDataFrame([], "doc_id long, toxic int")
    nulls = spark.createDataFrame([(1, None), (None, 1), (4, 0), (4, 1), (7, 0)], "doc_id long, toxic int")
    for labels in (none, nulls):
        scored = tx.score(docs, tx.train(docs, labels)).collect()
        assert len(scored) == len(awkward())
        assert all(r["expected_severity"] < tx.THRESHOLD and r["kept"] == "k" for r in scored)
    assert tx.score(documents(spark, []), tx.train(docs, none)).count() == 0
