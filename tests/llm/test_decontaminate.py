import random

from pyspark.sql import functions as F

from tabloom.llm import decontaminate as dc
from tests.llm.data import awkward, documents, prose


def brute(text, items, window):
    words, hit, found = dc.words_of(text), set(), set()
    for name, item in items:
        own = dc.words_of(item)
        k = min(window, len(own))
        grams = {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if own else set()
        for i in range(len(words) - k + 1 if k else 0):
            if tuple(words[i : i + k]) in grams:
                hit |= set(range(i, i + k))
                found.add(name)
    return len(words), len(hit), found


def items_table(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_automaton_by_brute_force(monkeypatch):
    for seed in range(60):
        rng = random.Random(seed)
        items = [(str(i), " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 12)))) for i in range(6)]
        automaton = dc.Automaton([(n, dc.words_of(t)) for n, t in items], window=4)
        for _ in range(5):
            text = " ".join(rng.choice("abcd") for _ in range(30))
            spans, found = automaton.scan(dc.words_of(text))
            n, hit, names = brute(text, items, 4)
            assert sum(b - a for a, b in spans) == hit
            assert {automaton.names[i] for i in found} == names
            assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_blocks_give_what_one_automaton_gives(spark, monkeypatch):
    rng = random.Random(3)
    items = [(i, prose(rng, rng.randrange(0, 40))) for i in range(12)] + [(99, None), (98, ""), (1, "w1 w2")]
    rows = awkward() + [(30, f"x {items[3][1]} y {items[5][1]} w1 W2"), (31, items[7][1])]
    docs = documents(spark, rows)
    one = dc.contamination(docs, items_table(spark, items))
    monkeypatch.setattr(dc, "BLOCK_WORDS", 50)
    many = dc.contamination(docs, items_table(spark, items))
    view = lambda df: sorted(
        (str(r[0]), r[1] or "", r[2], tuple(r[3]), tuple(sorted(r[4])))
        for r in df.select("doc_id", "text", "n_words", "spans", "items").collect()
    )
    assert view(one) == view(many)
    named = [(str(i), t) for i, t in items]
    for r in one.withColumn("hit", dc.hit_words()).collect():
        n, hit, found = brute(r["text"], named, 10)
        assert (r["n_words"], r["hit"], set(r["items"])) == (n, hit, found)


def test_clean_cuts_passages_and_drops_what_is_mostly_benchmark(spark):
    rng = random.Random(5)
    item, own = prose(rng, 30), prose(rng, 100)
    half = own[: len(own) // 2].rsplit(" ", 1)[0]
    rows = [(1, own), (2, f"{half}, {item}! {half}"), (3, item), (4, None), (5, "")]
    got = {r["doc_id"]: r["text"] for r in dc.clean(documents(spark, rows), items_table(spark, [(1, item)])).collect()}
    assert got[1] == own and got[4] is None and got[5] == "" and 3 not in got
    assert "w" in got[2] and not brute(got[2], [("1", item)], 10)[1] and got[2].startswith(half)


def test_no_items_and_no_documents(spark):
    none = items_table(spark, [])
    assert dc.contamination(documents(spark, awkward()), none).where(F.size("items") > 0).count() == 0
    assert dc.contamination(documents(spark, []), items_table(spark, [(1, "a b")])).count() == 0
