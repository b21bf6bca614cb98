"""The source audit against sums over all terms."""

import random
import re
from collections import Counter, defaultdict

from tabloom.llm import source_audit as sa

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs, top):
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    groups = sorted({(lang or "", source or "") for _, lang, source in rows})
    for text, lang, source in rows:
        terms = [t.translate(LOWER) for t in TERM.findall(text or "")]
        docs[lang or ""].update(set(terms))
        counts[lang or "", source or ""].update(terms)
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= min_docs)
        sources = [s for g, s in groups if g == lang]
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {s: share(counts[lang, s]) for s in sources}, share(whole)
        for s in sources:
            pair = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            term = [(f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, values, limit in (("pair", pair, None), ("term", term, top)):
                order = sorted(values, key=lambda x: (-x[0], x[1].encode()))[:limit]
                out += [(lang, s, part, item, value, i) for i, (value, item) in enumerate(order, 1)]
    return sorted(out)


def audited(spark, rows, min_docs=sa.MIN_DOCS, top=sa.TOP_TERMS, parts=3):
    wide = [(t, lang, source, "a", "b", 7, "p") for t, lang, source in rows]
    df = spark.createDataFrame(wide, "text string, lang string, source string, term string, item string, value int, path string").repartition(parts)
    return sorted(tuple(r) for r in sa.audit(df, min_docs=min_docs, top=top).collect())


def test_sums_over_all_terms(spark, monkeypatch):
    rng = random.Random(3)
    rows = []
    for _ in range(300):
        lang, source = rng.choice(["en", "fr", "de", None]), rng.choice(["s1", "s2", "s3", "é", None, "hot", "hot", "hot"])
        words = [rng.choice("Aa Bb É ß the THE of don't x1y née".split() + [f"w{chr(97 + rng.randrange(26))}"]) for _ in range(rng.randrange(12))]
        rows.append((" ".join(words), lang, source))
    rows += [(None, "en", "empty"), ("", "xx", "only"), ("1 2 3", "xx", "other"), ("zz " * 5000, "en", "s1"), (rows[0]), (rows[0])]
    rows += [("a b c", "zz", "lone")] * 12
    for min_docs, top in ((10, 10), (1, 3), (2, 2)):
        assert audited(spark, rows, min_docs, top) == brute(rows, min_docs, top)


def test_ties_and_tables_without_terms(spark):
    rows = [("alpha beta", "en", s) for s in ("a", "b", "c") for _ in range(10)]
    found = audited(spark, rows)
    assert found == brute(rows, 10, 10) and {r[4] for r in found} == {0}
    assert [r[3] for r in found if r[1] == "b" and r[2] == "pair"] == ["a", "c"]
    assert audited(spark, [("1 2", None, None), (None, None, "x")]) == brute([("1 2", None, None), (None, None, "x")], 10, 10)
    assert audited(spark, [("x", "a", "b")]) == []
    empty = spark.createDataFrame([], "text string, lang string, source string")
    assert sa.audit(empty).collect() == []


def test_a_path_is_shared_and_flushed(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(sa, "FLUSH", 3)
    item = lambda s, n: {"source": s, "n": n, "p": 10 * n + 1, "zero": 3}
    paths = [[item("a", 1), item("b", 2)], [item("a", 1), item("b", 2), item("c", 1)], [item("a", 1), item("c", 5)], [item("b", 1), item("c", 1)]]
    kind = pa.list_(pa.struct([("source", pa.string()), ("n", pa.int64()), ("p", pa.int64()), ("zero", pa.int64())]))
    batch = pa.RecordBatch.from_arrays([pa.array(["x"] * 4), pa.array(paths, kind), pa.array([3, 1, 2, 5])], names=["lang", "path", "rows"])
    got = {(a, b): v for out in sa.tree_corrections(iter([batch])) for _, a, b, v in zip(*[c.to_pylist() for c in out.columns])}
    want = Counter()
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for path, rows in zip(paths, [3, 1, 2, 5]):
        for i, x in enumerate(path):
            for y in path[i + 1 :]:
                want[x["source"], y["source"]] += rows * (f(x["p"], y["p"]) - f(x["p"], 3) - f(3, y["p"]) + f(3, 3))
    assert got == dict(want)
