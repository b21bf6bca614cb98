"""A corpus pipeline of five stages over ``documents``; each stage works on all that the one before kept.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir).
All but the last return the columns of ``documents``. A changed text gets its
new ``n_chars``. Rows with a null id or text pass through the filters: they
are never toxic, near copies or contaminated. Rows that repeat an id stand or
fall together in the near-copy stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm import decontaminate, jaccard_join, sentence_pieces, suffix_dedup, toxicity
from tabloom.llm.base import table
from tabloom.runtime import fits_broadcast, materialize

# Near copies share 80 % of their five-word shingles.
NEAR_WORDS = 5
NEAR_PERCENT = 80


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity stays below the threshold."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.withColumn("__text", F.col("text")), model, "__text")
    return scored.where(F.col("expected_severity") < toxicity.THRESHOLD).select(*docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    groups = jaccard_join.jaccard_groups(docs, words=NEAR_WORDS, percent=NEAR_PERCENT)
    others = materialize(groups.where("doc_id <> component_id").select("doc_id").distinct(), "near-copies")
    return docs.join(F.broadcast(others) if fits_broadcast(others) else others, "doc_id", "left_anti").select(*docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 100 bytes that an earlier document or place has; documents left empty by that go."""
    cut = suffix_dedup.remove_repeats(docs.withColumn("__source_text", F.col("text")), text="__source_text")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    cut = cut.withColumn("text", text).where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    n_chars = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", n_chars).select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; documents that are mostly benchmark go."""
    cleaned = decontaminate.clean(docs.withColumn("__was", F.octet_length("text")), table(spark, sf_dir, "benchmark"))
    changed = ~F.octet_length("text").eqNullSafe(F.col("__was"))
    n_chars = F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", n_chars).select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text's pieces, and whether decoding them gives the text back."""
    kept = ["doc_id", "lang", "source", "n_chars"]
    encoded = sentence_pieces.encode_round_trip(docs, "text", "ids", "round_trip", keep=kept)
    return encoded.select(*kept, "ids", F.size("ids").cast("long").alias("n_tokens"), "round_trip")


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_jaccard_join", one_of_near_copies),
    ("suffix_array_dedup", without_repeats),
    ("benchmark_decontamination", without_benchmark),
    ("sentencepiece", pieces),
]

# A fitted model and suffix order cannot be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read by the next stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
