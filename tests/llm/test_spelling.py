"""Spelling groups against edit distances of all pairs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tabloom.llm import spelling as sp

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {w: min(near[w], key=lambda x: (-n[x], x), default=None) for w in n}
    form = {w: f if f and n[f] >= 2 * n[w] else None for w, f in form.items()}
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root))
    return sorted(out)


def grouped(spark, rows, parts=3):
    wide = [(t, i, "w", 1, "r") for i, t in rows]
    df = spark.createDataFrame(wide, "text string, doc_id long, word string, n int, root string").repartition(parts)
    return sorted(tuple(r) for r in sp.spelling_groups(df).select("word", "n", "n_near", "form", "form_n", "root").collect())


def variants(rng, n):
    stems = ["".join(rng.choice("abcdeéß") for _ in range(rng.randrange(5, 12))) for _ in range(6)]
    words = []
    for _ in range(n):
        word = rng.choice(stems)
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
            at = rng.randrange(len(word))
            word = rng.choice([word[:at] + word[at + 1 :], word[:at] + rng.choice("abx") + word[at:], word[:at] + "y" + word[at + 1 :]])
        words.append(word)
    return words


@pytest.mark.parametrize("block", [sp.BLOCK, 4])
def test_groups_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(sp, "BLOCK", block)
    monkeypatch.setattr(sp, "QUERIES", 3 * block)
    rng = random.Random(block)
    words = variants(rng, 3600)
    rows = [(i, " ".join(rng.choice((w, w.upper(), w + "1")) for w in words[60 * i : 60 * i + 60])) for i in range(60)]
    rows += [(None, None), (3, ""), (None, "zzzzz " * 4), (7, rows[7][1]), (8, "a" * 4000 + " " + "a" * 4001 + " x"), (8, "a" * 4000 + " " + "a" * 4001)]
    rows += [(8, "a" * 4000 + ", " + "a" * 4001), (9, "×÷×÷×÷ " * 3 + "日本語日本語 " * 3)]
    # Chains of forms: each step twice as frequent.
    rows += [(20 + i, " ".join(["chaina"] * 3 + ["chainab"] * 7 + ["chainabc"] * 15 + ["chainabcd"] * 31)) for i in range(2)]
    got = grouped(spark, rows)
    assert got == brute(rows)
    assert any(r[3] and r[3] != r[5] for r in got) and any(r[2] > 2 for r in got)


def test_empty_tables(spark):
    assert grouped(spark, [(1, None)]) == []
    assert sp.spelling_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_bitsets_find_exactly_one_edit():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 8))) for _ in range(400)})
    asked = words + ["q", "abq", "qab", "x" * 30]
    q, w = sp.PositionIndex(words).near(asked)
    assert sorted(zip(q.tolist(), w.tolist())) == [(i, j) for i, a in enumerate(asked) for j, b in enumerate(words) if one_edit(a, b)]


def test_hashes_continue():
    words = ["", "a", "é" * 40, "x" * 47, "y" * 48, "z" * 49, "w" * 3000]
    starts = np.array([zlib.crc32(f"{i}:".encode()) for i in range(14)], np.uint32)
    which = np.array([i % 7 for i in range(14)])
    got = sp.crc32_after(starts, pa.array(words), which)
    assert got.tolist() == [zlib.crc32(f"{i}:{words[i % 7]}".encode()) for i in range(14)]
