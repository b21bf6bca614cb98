import itertools
import tracemalloc
import weakref

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T
from sentencepiece import SentencePieceProcessor

from tabloom.llm import base
from tabloom.llm import sentence_pieces as sp
from tabloom.llm.base import cut
from tests.llm.data import awkward, documents

PIECES = sp.load_pieces()
SURFACE = pa.array(PIECES.surface, pa.binary())


def score(ids):
    byte_ids = set(PIECES.byte_ids)
    names = {i: s for s, i in PIECES.ids.values()}
    return sum(names[i] for i in ids if i not in byte_ids)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_round_trip_is_exact(text):
    ids = sp.encode_texts(pa.array([text]), PIECES)
    assert sp.decode_ids(ids, SURFACE).to_pylist() == [text]


def best_by_brute_force(word):
    marked = word.replace(" ", sp.MARK)
    found = []
    for cuts in itertools.product([0, 1], repeat=len(marked) - 1):
        edges = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(marked)]
        parts = [marked[a:b] for a, b in zip(edges, edges[1:])]
        if all(p in PIECES.ids for p in parts):
            found.append(sum(PIECES.ids[p][0] for p in parts))
    return max(found)


@pytest.mark.parametrize("word", ["the", "hester", "lereaux", "running,", "x", "Hello.", "éèê"])
def test_best_score_of_all_cuts(word):
    ids = sp.encode_texts(pa.array([word]), PIECES).to_pylist()[0]
    assert score(ids) == best_by_brute_force(" " + word)


def test_scores_are_the_best_the_library_finds():
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.ParseFromString(open(sp.model_path(), "rb").read())
    model.trainer_spec.model_type = 1
    library = SentencePieceProcessor(model_proto=model.SerializeToString())
    for word in "the hested ariear enestion antidisestablishment quantum".split():
        best = library.nbest_encode_as_ids(word, 2)[0]
        assert score(sp.encode_texts(pa.array([word]), PIECES).to_pylist()[0]) == score(best)


def test_prefixes_share_scores_but_not_results():
    words = [" a", " ab", " abc", " abd", " b", " abc"]
    together = sp.segment_words(set(words), PIECES)
    assert all(together[w] == sp.segment_words([w], PIECES)[w] for w in words)


def test_awkward_rows(spark):
    rows = awkward()
    encoded = sp.encode(documents(spark, rows), "text", "ids")
    back = sp.decode(encoded, "ids", "back").select("doc_id", "text", "ids", "back", "kept").collect()
    assert len(back) == len(rows)
    assert all(r["back"] == r["text"] and r["kept"] == "k" for r in back)
    assert all((r["ids"] is None) == (r["text"] is None) for r in back)


def test_ids_outside_the_vocabulary_and_empty_tables(spark):
    df = spark.createDataFrame([([5, -1, 10**6, None],), (None,), ([],)], "ids array<int>")
    assert len(sp.decode(df, "ids", "text").collect()) == 3
    assert sp.encode(documents(spark, []), "text", "ids").count() == 0


def test_round_trip_in_the_tasks(spark):
    """What the last stage of the pipeline takes from a worker: ids and a mark, whatever the texts are."""
    rows = awkward()
    docs = documents(spark, rows)
    got = sp.encode_round_trip(docs, "text", "ids", "same", keep=["doc_id"])
    assert got.columns == ["doc_id", "ids", "same"]
    want = sp.encode_and_decode(docs, "text", "ids", "back", keep=["doc_id"]).collect()
    found = got.collect()
    assert sorted((r["doc_id"], r["ids"]) for r in found if r["ids"]) == sorted((r["doc_id"], r["ids"]) for r in want if r["ids"])
    assert len(found) == len(rows) and all(r["same"] for r in found)


def test_lossy_round_trip_is_told(spark, monkeypatch):
    monkeypatch.setattr(sp, "load_pieces", lambda path=None: sp.Pieces(PIECES.ids, PIECES.byte_ids, [b"?"] * len(PIECES.surface), PIECES.unknown))
    got = sp.encode_round_trip(documents(spark, [(1, "word"), (2, None), (3, "")]), "text", "ids", "same").collect()
    assert {r["doc_id"]: r["same"] for r in got} == {1: False, 2: True, 3: True}


def test_few_strings_are_held_at_once():
    """4 MB of words at once are some 100 MB of Python strings and lists, in each of an executor's workers."""
    words = [f"w{i % 5000}" for i in range(800_000)]
    texts = pa.array([" ".join(words[i : i + 100]) for i in range(0, len(words), 100)])
    batch = pa.RecordBatch.from_arrays([texts], names=["text"])
    tracemalloc.start()
    for piece in cut(batch, 0, sp.CUT):
        sp.encode_texts(piece.column(0), PIECES)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held < 32 << 20


def test_a_task_that_has_ended_holds_no_model(spark, monkeypatch):
    """Workers outlive their tasks; what a task has prepared is freed before memory goes back to the system."""
    docs, models, held = documents(spark, [(1, "a")]), [], []

    class Model:
        pass

    def prepare():
        model = Model()
        models.append(weakref.ref(model))
        return lambda texts: [pa.array([model is not None] * len(texts))]

    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: run)
    monkeypatch.setattr(base, "release", lambda: held.append(models[-1]() is not None))
    run = base.with_arrow(docs, "text", [T.StructField("out", T.BooleanType())], prepare, keep=["doc_id"])
    rows = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["a", None])], names=["doc_id", "__value"])
    assert [len(out) for out in run(iter([rows, rows]))] == [2, 2]
    assert held == [True, True, False]
