import random
import re

from tabloom import llm
from tabloom.llm import license_scan as ls
from tests.llm.data import awkward, documents, prose


def bigrams(text):
    words = [w for w in re.split(r"[\x00-/:-`{-\x7f]+", text.translate({c: c + 32 for c in range(65, 91)})) if w]
    return set(zip(words, words[1:]))


def brute(text, templates, least):
    units = [*text.split("\n"), *re.split(r"\n[ \t\r]*\n", text), text]
    found = []
    for u in units:
        a = bigrams(u)
        for name, t in templates.items():
            b = bigrams(t)
            if a and 2 * len(a & b) >= least * (len(a) + len(b)):
                found.append((-2 * len(a & b) / (len(a) + len(b)), name))
    best = min(found, default=(None, None))
    return best[1], None if best[0] is None else -best[0], sorted({n for _, n in found})


def test_matches_by_brute_force(spark):
    mit = ls.TEMPLATES["MIT-grant"]
    wrapped = re.sub(r"((?:\S+\s+){9})", r"\1\n", mit)
    rows = awkward() + [
        (50, ls.TEMPLATES["GPL-3.0"]), (51, f"Some text.\n{ls.TEMPLATES['Apache-2.0'].upper()}\nMore of it."),
        (52, f"Heading words here\n\n{wrapped}\n\nOther words at the end"), (53, wrapped), (54, mit.replace("Software", "Product")),
        (55, "Licensed under CC BY-NC 4.0\nReleased under MIT"), (56, "Released under the MIT license today or not"),
    ]
    got = ls.scan(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        name, dice, names = brute(r["text"] or "", ls.TEMPLATES, ls.MIN_DICE)
        assert (r["license"], r["licenses"]) == (name, names)
        assert (r["dice"] is None) == (dice is None) and (dice is None or abs(r["dice"] - dice) < 1e-12)
    best = {r["doc_id"]: r["license"] for r in got}
    assert best[52] == best[53] == best[54] == "MIT-grant" and best[51] == "Apache-2.0" and best[1] is None


def best_window(text, template):
    words = [w for w in re.split(r"[\x00-/:-`{-\x7f]+", text.translate({c: c + 32 for c in range(65, 91)})) if w]
    pairs, b = list(zip(words, words[1:])), bigrams(template)
    best = 0.0
    for i in range(len(pairs)):
        seen = set()
        for p in pairs[i:]:
            seen.add(p)
            best = max(best, 2 * len(seen & b) / (len(seen) + len(b)))
    return best


def test_windows_by_brute_force(spark):
    rng = random.Random(3)
    texts = ["released under the mit license " * 30, "This work is licensed under " + "x x " * 60 + "the GNU General Public License, version 3"]
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            own = ls.TEMPLATES[rng.choice(sorted(ls.TEMPLATES))].split()
            own = own[rng.randrange(0, 3) : len(own) - rng.randrange(0, 3)]
            own = [w for w in own if rng.random() > 0.05]
            own = own * rng.randrange(1, 3) if len(own) < 20 else own
            parts += own + [f"w{rng.randrange(4)}" for _ in range(rng.randrange(0, 12))]
        texts.append(" ".join(w + ("\n" if rng.random() < 0.1 else "") for w in parts))
    rows = awkward() + list(enumerate(texts, 100))
    text = dict(rows)
    got = ls.scan(documents(spark, rows), windows=True).collect()
    assert len(got) == len(rows) and sum(r["license"] is not None for r in got) > 40
    for r in got:
        if r["doc_id"] < 100:
            assert r["license"] is None and r["licenses"] == []
            continue
        found = {n: best_window(text[r["doc_id"]], t) for n, t in ls.TEMPLATES.items()}
        found = {n: v for n, v in found.items() if v >= ls.MIN_DICE}
        assert r["licenses"] == sorted(found)
        best = min(((-v, n) for n, v in found.items()), default=(None, None))
        assert r["license"] == best[1] and (best[0] is None or abs(r["dice"] + best[0]) < 1e-12)


def test_split_and_embedded_notices(spark, tmp_path):
    gpl, bsd = ls.TEMPLATES["GPL-3.0-notice"], ls.TEMPLATES["BSD-2-Clause"]
    gpl = re.sub(r"\. (This program is distributed|You should)", r".\n\n\1", gpl)
    bsd = re.sub(r" ([12]\.) ", r"\n\n\1 ", bsd)
    rng = random.Random(5)
    rows = [
        (1, f"{prose(rng, 300)}\n\n{gpl}\n\n{prose(rng, 300)}"), (2, f"{prose(rng, 300)}\n\n{bsd}\n\n{prose(rng, 300)}"),
        (3, "This project is released under the MIT License. See the LICENSE file for details."),
        (4, f"{prose(rng, 300)} {ls.TEMPLATES['MIT-grant']} {prose(rng, 300)}"), (5, prose(rng, 900)),
    ]
    table = documents(spark, rows)
    units = {r["doc_id"]: r["license"] for r in ls.scan(table).collect()}
    got = {r["doc_id"]: r["license"] for r in ls.scan(table, windows=True).collect()}
    assert [units[i] for i in range(1, 6)] == [None] * 5
    assert [got[i] for i in range(1, 6)] == ["GPL-3.0-notice", "BSD-2-Clause", "MIT", "MIT-grant", None]
    table.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    query = llm.queries()["op2_license_scan"](spark, str(tmp_path))
    assert {r["doc_id"]: r["license"] for r in query.collect()} == got


def test_empty_table(spark):
    assert ls.scan(documents(spark, [])).count() == 0
