import math
import time
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from tabloom.llm import lattice_lm as lm
from tabloom.llm.sentence_pieces import MARK, load_pieces
from tests.llm.data import awkward, documents

PIECES = load_pieces()


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def brute_word(lattice, word, i=0):
    """Sum over all cuts, by plain recursion on probabilities."""
    marked = MARK + word.replace(MARK, "\0")
    memo = {len(marked): 1.0}
    for start in reversed(range(len(marked))):
        total = 0.0
        for end in range(start + 1, min(len(marked), start + 16) + 1):
            part = marked[start:end]
            if part in lattice.weights:
                total += math.exp(lattice.weights[part][i]) * memo[end]
        if marked[start] not in lattice.weights:
            letter = MARK if marked[start] == "\0" else marked[start]
            total += math.exp(lattice.byte[i] * len(letter.encode())) * memo[start + 1]
        memo[start] = total
    return math.log(memo[0])


@pytest.mark.parametrize("word", ["the", "hested", "x", "running,", "日本", "naïve", "▁"])
def test_marginal_by_brute_force(word):
    lattice = lm.Lattice(PIECES)
    got = lattice.log_probabilities([word])[0]
    assert np.allclose(got, [brute_word(lattice, word, i) for i in range(len(lm.SCALES))], rtol=1e-9)


def test_shared_prefixes_change_nothing():
    words = sorted(["a", "ab", "abc", "abd", "b", "bcd", "theory", "the", "then"])
    alone = [lm.Lattice(PIECES).log_probabilities([w])[0] for w in words]
    assert np.allclose(lm.Lattice(PIECES).log_probabilities(words), alone)


def test_probabilities_sum_to_one():
    lattice = lm.Lattice(PIECES)
    total = sum(np.exp(w) for w in lattice.weights.values()) + 256 * np.exp(lattice.byte)
    assert np.allclose(total, 1)


def test_scores_by_brute_force(spark):
    rows = awkward() + [(100 + i, f"alpha beta w{i} w{i % 5}") for i in range(40)] + [(None, "alpha alpha")]
    got = lm.score_documents(documents(spark, rows)).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    counts = Counter(t for i, x in rows if not held(i) for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, x in rows:
        own = tokens(x)
        base = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own)
        want[(i, held(i), len(own), sum(counts[t] > 0 for t in own), n, round(base, 6))] += 1
    assert Counter((r[0], r[1], r[2], r[3], r[4], round(r[5], 6)) for r in got) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    # The text's score is the product over its words, a word or an end chosen each time.
    fit = {r["doc_id"]: r["score"] for r in got}
    assert fit[7] == fit[8] and fit[1] == fit[2] == fit[3] and fit[15] < fit[7] < fit[4] < fit[1]


def test_empty_table(spark):
    assert lm.score_documents(documents(spark, [])).count() == 0


def test_expected_uses_by_brute_force():
    """The expected uses of a piece are the derivative of the words' values by its log weight."""
    words = sorted(["the", "then", "theory", "日本", "a▁"])
    start = lm.Lattice(PIECES).start()
    uses = Counter()
    values = lm.walk_of(PIECES, start).run(words, uses)
    assert len(values) == len(words)
    names = [*lm.walk_of(PIECES, start).weights, ""]
    for piece in (MARK + "the", "the", "ory", "日", "e", ""):
        step = np.zeros(len(start))
        step[names.index(piece)] = 1e-6
        slope = (sum(lm.walk_of(PIECES, start + step).run(words)) - sum(lm.walk_of(PIECES, start - step).run(words))) / 2e-6
        assert math.isclose(uses[piece], slope, rel_tol=1e-4, abs_tol=1e-6)


def test_learned_weights_sum_to_one():
    start = lm.Lattice(PIECES).start()
    for uses in ({}, {5: 3 << 20, len(start) - 1: 7 << 20}):
        logs = lm.learned(start, uses)
        assert math.isclose(np.exp(logs[:-1]).sum() + 256 * math.exp(logs[-1]), 1)


def test_scores_by_value(spark):
    """A trained word is a piece of its own beside its cuts, so held-out scores stay near the base."""
    rows = [(i, " ".join(f"word{(i * 7 + j) % 40}" for j in range(30))) for i in range(200)] + [(1000 + i, f"only{i} word1 word1") for i in range(50)]
    got = {r["doc_id"]: r for r in lm.score_documents(documents(spark, rows)).collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    counts = Counter(w for i, x in rows if not held(i) for w in x.split())
    ends = sum(not held(i) for i, _ in rows)
    n, v = sum(counts.values()), len(counts)
    once, twice = (sum(c == k for c in counts.values()) for k in (1, 2))
    discount = (once + 1) / (once + 2 * twice + 2)
    start, uses = lm.Lattice(PIECES).start(), Counter()
    first = lm.walk_of(PIECES, start)
    first.run(sorted(counts), uses)
    place = {p: i for i, p in enumerate([*first.weights, ""])}
    walk = lm.walk_of(PIECES, lm.learned(start, {place[p]: round(x * lm.USES) for p, x in uses.items()}))
    for i, x in rows:
        want = math.log10((ends + 1) / (n + ends + 2))
        for w in x.split():
            cuts = math.exp(walk.run([w])[0])
            want += math.log10(max(counts[w] - discount, 0) / n + discount * v / n * cuts) + math.log10((n + 1) / (n + ends + 2))
        assert math.isclose(got[i]["score"], want, rel_tol=1e-6)
    near = [r["score"] / r["base_score"] for r in got.values() if r["held_out"] and r["n_known"] == r["n_tokens"]]
    assert near and max(near) < 1.1


def test_batches_cost_little_beside_their_words(monkeypatch):
    """Words are dealt and sorted as columns; a Python sort of them took some ten times the time of finding them."""
    monkeypatch.setattr(lm, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    words = [f"{zlib.crc32(str(i).encode()):x}" for i in range(200_000)]
    texts = pa.array([" ".join(words[i : i + 200]) for i in range(0, len(words), 200)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([False] * len(texts)), texts], names=["doc_id", "held", "text"])

    def seconds(work):
        took = []
        for _ in range(3):
            began = time.process_time()
            work()
            took.append(time.process_time() - began)
        return min(took)

    rows = [r for out in lm._batches(24)(iter([batch])) for r in out.to_pylist() if r["kind"] == "words"]
    assert sorted(w for r in rows for w in r["words"]) == sorted(set(words))
    assert all(r["words"] == sorted(r["words"]) for r in rows)
    assert seconds(lambda: list(lm._batches(24)(iter([batch])))) < 15 * seconds(lambda: lm.coded(lm.split_words(texts, lower=True)[0]))
