import re
from collections import Counter

from tabloom.llm.line_rules import line_rules
from tests.llm.data import awkward, documents


def counts(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    again = {i + j for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again),
    )


def test_counts_by_brute_force(spark):
    rows = awkward() + [(20, "a b c d e f g h " * 5), (21, "#*$%&|<> \n x | y\n x | y"), (22, "z\n\nz\n")]
    got = line_rules(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counts(r["text"])
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])


def test_bad_lines_go_and_clean_text_stays(spark):
    good = "This is a plain sentence that ends well and says something about many things in the world today."
    menu = "Home | About | Contact | Help | Imprint | Shop | Cart | Login | News | Jobs | Press | Blog | FAQ"
    more = "Nobody knows exactly why the second line of a text should differ from the first, but this one surely does."
    rows = [(1, f"{good}\n{more}"), (2, f"{good}\n{menu}\nClick here"), (3, "\n".join([menu] * 5 + [good]))]
    got = {r["doc_id"]: r for r in line_rules(documents(spark, rows)).collect()}
    assert got[1]["kept"] and got[1]["cleaned_text"] == rows[0][1]
    assert got[2]["cleaned_text"] == good and got[2]["n_bad_lines"] == 2
    assert not got[3]["kept"]


def test_empty_table(spark):
    assert line_rules(documents(spark, [])).count() == 0
