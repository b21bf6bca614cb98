"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, n_words long, component_id string, ids string, spans string, kept string"


def documents(spark: SparkSession, rows: list[tuple[int | None, str | None]], parts: int = 3) -> DataFrame:
    """(id, text) rows with extra columns whose names the operators use themselves."""
    wide = [(i, t, -1, "c", "i", "s", "k") for i, t in rows]
    return spark.createDataFrame(wide, SCHEMA).repartition(parts)


def prose(rng: random.Random, n: int, kinds: int = 300) -> str:
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


def awkward(seed: int = 7) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    base, other = prose(rng, 120), prose(rng, 200)
    near = base.split()
    near[60] = "changed"
    rows: list[tuple[int | None, str | None]] = [
        (1, None), (2, ""), (3, "   \n\t "), (4, "one two"), (5, "one two"), (6, "Éa ▁ \x00 日本語 🙂 \r\n x"),
        (7, base), (8, base), (9, " ".join(near)), (10, other), (11, other + " " + base), (12, "a" * 5000),
        (13, "ab" * 3000), (14, base.upper()), (15, prose(rng, 4000)), (16, other), (16, other), (17, "x\n" * 40),
    ]
    return rows
