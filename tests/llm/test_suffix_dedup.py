import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tabloom.llm import suffix_dedup as sd
from tests.llm.data import documents


def brute(rows):
    """Length, removed bytes, spans and hash of the rest, for unique ids."""
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        hit = bytearray(len(raw))
        for at in range(len(raw) - 99):
            part = raw[at : at + 100]
            if part in seen:
                hit[at : at + 100] = b"\1" * 100
            seen.add(part)
        kept = bytes(b for b, x in zip(raw, hit) if not x)
        spans = sum(1 for at, x in enumerate(hit) if x and not (at and hit[at - 1]))
        out[i] = (len(raw), sum(hit), spans, hashlib.sha256(kept).hexdigest())
    return out


def texts(seed):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcdé fg") for _ in range(n)) for n in (90, 99, 100, 101, 150, 400)]
    rows = [(1, None), (2, ""), (3, "é" * 49), (4, "é" * 51), (5, "a" * 3000), (6, "a" * 99), (7, "ab" * 700), (8, "ba" * 300)]
    for i in range(40):
        parts = [rng.choice(passages) if rng.random() < 0.6 else "".join(rng.choice("hijklm ") for _ in range(rng.randrange(1, 200))) for _ in range(rng.randrange(1, 6))]
        rows.append((100 + i, "".join(parts)))
    rows += [(200, rows[20][1]), (201, rows[20][1]), (90, rows[25][1][:-1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, parts", [(1, 1), (2, 4)])
def test_removed_bytes_by_brute_force(spark, seed, parts):
    rows = texts(seed)
    got = sd.remove_repeats(documents(spark, rows, parts)).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]]
        assert r["kept"] == "k" and isinstance(r["kept_text"], str)


def test_segments_cut_nothing(spark, monkeypatch):
    monkeypatch.setattr(sd, "SEGMENT", 257)
    rows = texts(5)
    found = {}
    for i, t in sorted(rows):
        found[i] = (t or "").encode()
    data = np.frombuffer(b"".join(found.values()), np.uint8)
    ends = np.cumsum([len(t) for t in found.values()])
    first, last, *_ = sd.phrases(data, ends, sd.Hashes(257 + 100))
    strings = sum(max(len(t) - 99, 0) for t in found.values())
    assert int((last - first + 1).sum()) == strings


def test_repeated_ids_null_ids_and_equal_rows(spark):
    text, other = "x" * 10 + "".join(chr(97 + i % 23) for i in range(200)), "".join(chr(97 + i % 19) for i in range(300))
    rows = [(None, text), (5, text), (5, text), (7, other), (7, other + "!"), (8, "short")]
    got = sd.remove_repeats(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    left = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in got)
    repeated = [x for x in left if x[3]]
    # The null id comes first, so both rows of id 5 repeat it; of id 7 one text repeats what the other has.
    assert (True, 5, len(text), len(text)) in repeated and left.count((True, 5, len(text), len(text))) == 2
    assert left[0][3] < len(text)
    assert any(x[1] == 7 for x in repeated)


def test_empty_table(spark):
    assert sd.remove_repeats(documents(spark, [])).count() == 0


def test_whole_letters():
    raw = "aéb".encode()
    assert sd.whole_letters(raw, [(2, 4)]) == [(3, 4)] and sd.whole_letters(raw, [(0, 2)]) == [(0, 1)]


def test_phrases_go_evenly_over_buckets(spark):
    """Triggers are the smallest hashes of their neighbours; dealt as they are, most phrases met in the first buckets."""
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(4000))) for i in range(60)]
    docs = documents(spark, rows).selectExpr("doc_id AS doc", "text")
    sizes = Counter()
    for row in docs.mapInArrow(sd._entries(24), sd.ENTRIES).select("bucket", "size").collect():
        sizes[row["bucket"]] += len(row["size"])
    assert len(sizes) == 24 and max(sizes.values()) < 2 * sum(sizes.values()) / 24
