"""Byte-level BPE against the tokenizers library and against merging one pair after the other."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tabloom import llm
from tabloom.llm import byte_pairs as bp
from tests.harness import DATA
from tests.llm.data import awkward, documents


@pytest.fixture(scope="module")
def merges():
    return bp.merges(bp.tokenizer_path())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bp.tokenizer_path())


def texts_of(rng, n):
    parts = "'s|'| |  |\n|\t|\x1c|\x85|é|日本|a|b|the| the|ing|1|23|<|endoftext|>|<|\r\n|\xa0|🙂|'ll|'LL|!!|...|　|​|ß|qzx".split("|")
    return ["".join(rng.choice([*parts, "<|endoftext|>", "|"]) for _ in range(rng.randrange(30))) for _ in range(n)]


def test_ids_and_texts_are_those_of_the_library(merges, library):
    rng = random.Random(5)
    texts = [*texts_of(rng, 800), None, "", " " * 300, "a" * 3000, "ab" * 2000, "".join(rng.choice("abcdeé") for _ in range(5000))]
    texts += ["x" + chr(c) + " " + chr(c) * 2 for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    ids = merges.encode(pa.array(texts))
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert ids.to_pylist() == want
    assert merges.decode(ids).to_pylist() == [library.decode(x, skip_special_tokens=False) for x in want]


def test_proposals_fail_exactly_where_merging_differs(merges):
    rng = random.Random(6)
    words = sorted({"".join(rng.choice("aeinrsth") for _ in range(rng.randrange(1, 14))) for _ in range(3000)})
    tokens, owners = merges.propose(pa.array(words))
    exact = [merges.merged(w.encode()) for w in words]
    assert [x.tolist() for x in merges.exact(pa.array(words))] == exact
    wrong = 0
    for i in range(len(words)):
        own = tokens[owners == i]
        fits = bool(merges.compatible(own[:-1], own[1:]).all()) and bool(merges.sound[own].all())
        assert fits == (own.tolist() == exact[i])
        wrong += not fits
    assert 0 < wrong < len(words)
    assert merges.encode_words(pa.array(words))[2] == wrong


def test_ids_without_text(merges):
    lists = pa.array([[300, 200], None, [], [255, 195]], pa.list_(pa.int32()))
    assert merges.decode(lists).to_pylist()[1:3] == [None, ""]
    assert "�" in merges.decode(pa.array([[merges.byte_ids[195]]], pa.list_(pa.int32()))).to_pylist()[0]
    assert merges.decode(lists.slice(2)).to_pylist()[0] == ""


def test_frames(spark, library):
    rows = awkward()
    found = bp.encode(documents(spark, rows)).select("doc_id", "ids", "n_words").collect()
    want = sorted((i, library.encode(t or "", add_special_tokens=False).ids) for i, t in rows)
    assert sorted((r["doc_id"], r["ids"]) for r in found) == want and {r["n_words"] for r in found} == {-1}
    back = bp.decode(bp.encode(documents(spark, rows)), keep=["doc_id"]).collect()
    assert sorted((r["doc_id"], r["decoded"]) for r in back) == sorted((i, t or "") for i, t in rows)
    assert bp.encode(documents(spark, [(1, None)]).limit(0)).count() == 0


def test_query(spark, library):
    sf_dir = str(DATA / "sf0.001")
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = llm.queries()["op11_byte_pairs"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(texts[r["doc_id"]]))
    assert np.all([r["n_tokens"] is not None for r in rows])
