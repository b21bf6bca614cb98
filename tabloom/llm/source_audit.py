"""Source divergence audit: how far the term shares of each source lie from those of the others of its language.

A document's terms are runs of letters, A-Z lower-cased. Each language keeps the
terms of at least ``min_docs`` of its documents. A group (language and source)
gives a term of count c the smoothed share p = 1 + floor(10^9 (c + 2) / (N + 2 V));
two shares differ by floor((p - q)^2 / (p + q)). All arithmetic is in integers.

The sum over all terms of a pair of sources is never taken term by term. Most
counts are zero, so the sum is that of two empty rows for every term, plus a
correction for each nonzero count alone, plus one for each two nonzero counts of
the same term. Term rows (their nonzero counts in the order of sources, equal
rows merged with a multiplicity) go through a frequent-pattern tree: rows sorted
by their path share its nodes, and a node's correction with each of its
ancestors is made once, times the documents' rows that pass through it. A task
holds the open path of the tree only, since sorted rows close their branches.

Null text, language and source are ''. Repeated rows count each. A group without
terms, or of a language without kept terms, has shares of empty counts (value 0
without kept terms). No documents, no rows. Other columns are not read. A term row
holds at most one entry per source, and the result holds one row per two sources.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.base import bounded_batches, coded, cut, flat, release
from tabloom.operators.joining import attach_by_key
from tabloom.runtime import materialize

MIN_DOCS = 10
TOP_TERMS = 10
# Parts into which one language's rows are dealt before they meet its sources.
SALTS = 32
# Node-ancestor combinations that a task holds before it sums them.
FLUSH = 1 << 18

NOT_TERMS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
COUNTS = "lang string, source string, term string, n long, docs long"
SHARES = "lang string, a string, b string, value long"


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts per (lang, source, term) of each piece of (text, lang, source); a group also has a row without a term."""
    for batch in batches:
        for piece in cut(batch, 0):
            texts, langs, sources = piece.columns
            lang, langs = coded(langs)
            source, sources = coded(sources)
            group, inverse = np.unique(lang.astype(np.int64) * len(sources) + source, return_inverse=True)
            words, rows = flat(pc.split_pattern_regex(pc.ascii_lower(texts), NOT_TERMS))
            full = pc.greater(pc.binary_length(words), 0)
            code, names = coded(words.filter(full))
            width = max(len(names), 1)
            in_doc, counts = np.unique(rows[full.to_numpy(zero_copy_only=False)] * np.int64(width) + code, return_counts=True)
            key, first = np.unique(inverse[in_doc // width] * np.int64(width) + in_doc % width, return_inverse=True)
            n = np.zeros(len(key), np.int64)
            np.add.at(n, first, counts)
            docs = np.bincount(first, minlength=len(key)).astype(np.int64)
            owner = np.concatenate([group, group[key // width]])
            none = np.zeros(len(group), np.int64)
            term = pa.concat_arrays([pa.nulls(len(group), pa.string()), names.take(pa.array(key % width)).cast(pa.string())])
            columns = [
                langs.take(pa.array(owner // len(sources))), sources.take(pa.array(owner % len(sources))), term,
                pa.array(np.concatenate([none, n])), pa.array(np.concatenate([none, docs])),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
        release()


def share(count: str) -> Column:
    """The smoothed share of a count in a group of ``total`` occurrences; ``terms`` are kept."""
    return F.expr(f"1 + (CAST({count} + 2 AS DECIMAL(20, 0)) * 1000000000) div CAST(total + 2 * terms AS DECIMAL(20, 0))")


def divergence(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def tree_corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What terms with counts in both of two sources add, from a tree over sorted (lang, path, multiplicity) rows."""
    sums: dict[tuple[str, str, str], int] = {}
    lang: str | None = None
    path: list[tuple] = []  # open nodes: (source, n, p, p of no count)
    passed: list[int] = []  # rows that pass through each open node
    upper: list[tuple] = []
    lower: list[tuple] = []
    spans: list[int] = []
    weights: list[int] = []

    def flush() -> None:
        if upper:
            codes: dict[str, int] = {}
            above = np.array([(codes.setdefault(s, len(codes)), p, z) for s, _, p, z in upper], np.int64)
            below = np.array([(codes.setdefault(s, len(codes)), p, z) for s, _, p, z in lower], np.int64)
            below = np.repeat(below, spans, axis=0)
            p, z, q, y = above[:, 1], above[:, 2], below[:, 1], below[:, 2]
            value = (apart(p, q) - apart(p, y) - apart(z, q) + apart(z, y)) * np.repeat(np.array(weights, np.int64), spans)
            key, at = np.unique(above[:, 0] * len(codes) + below[:, 0], return_inverse=True)
            total = np.zeros(len(key), np.int64)
            np.add.at(total, at, value)
            names = list(codes)
            for k, v in zip(key.tolist(), total.tolist()):
                pair = (lang, names[k // len(codes)], names[k % len(codes)])
                sums[pair] = sums.get(pair, 0) + v
        for held in (upper, lower, spans, weights):
            held.clear()

    def close(depth: int) -> None:
        while len(path) > depth:
            item, rows = path.pop(), passed.pop()
            if path:
                passed[-1] += rows
                upper.extend(path)
                lower.append(item)
                spans.append(len(path))
                weights.append(rows)
        if len(upper) > FLUSH:
            flush()

    for batch in batches:
        held = [c.to_pylist() for c in batch.columns]
        for own, items, rows in zip(*held):
            if own != lang:
                close(0)
                flush()
                lang = own
            items = [(i["source"], i["n"], i["p"], i["zero"]) for i in items]
            shared = 0
            while shared < min(len(path), len(items)) and path[shared] == items[shared]:
                shared += 1
            close(shared)
            path.extend(items[shared:])
            passed.extend([0] * (len(items) - shared))
            passed[-1] += rows
    close(0)
    flush()
    release()
    if sums:
        columns = [pa.array(x) for x in zip(*[(*k, v) for k, v in sums.items()])]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "a", "b", "value"])


def both_ways(pairs: DataFrame) -> DataFrame:
    """Each (lang, a, b, value) for a and for b."""
    ends = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    return pairs.select("lang", "value", F.explode(ends).alias("e")).select("lang", "e.source", "e.item", "value")


def with_others(rows: DataFrame, groups: DataFrame, spread_by: list[str]) -> DataFrame:
    """Rows (lang, source, ...) next to each other source of the language, dealt over ``SALTS`` parts of a language."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(*spread_by), F.lit(SALTS)))
    salts = F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)]))
    others = groups.select("lang", F.col("source").alias("other"), F.col("zero").alias("other_zero"), salts.alias("salt"))
    return salted.join(others, ["lang", "salt"]).where("source <> other")


def audit(
    df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP_TERMS
) -> DataFrame:
    """(lang, source, part, item, value, rank): parts ``pair`` (all other sources) and ``term`` (the first ``top``)."""
    bounded_batches(df.sparkSession)
    texts = df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))])
    partial = texts.mapInArrow(count_terms, COUNTS)
    counts = materialize(partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    present = counts.where("term IS NOT NULL")
    kept = present.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("n_lang"), F.collect_list(F.struct("source", "n")).alias("items")
    )
    rows = materialize(kept.where(F.col("docs") >= min_docs).drop("docs"), "term-rows")
    single = rows.select("lang", "term", "n_lang", F.explode("items").alias("i")).select("lang", "term", "n_lang", "i.source", "i.n")
    langs = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n_lang").alias("total_lang"))
    totals = single.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = (
        counts.where("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
        .select("lang", "source", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("total", "terms", "total_lang")])
    )
    groups = materialize(groups.withColumn("zero", F.when(F.col("terms") > 0, share("0"))), "term-groups")
    shared = attach_by_key(single, groups, ["lang", "source"], written=True).withColumn("p", share("n"))
    shared = materialize(shared, "term-shares")

    # Part term.
    q = F.expr("1 + (CAST(n_lang + 2 AS DECIMAL(20, 0)) * 1000000000) div CAST(total_lang + 2 * terms AS DECIMAL(20, 0))")
    over = shared.withColumn("q", q).where("p > q").withColumn("value", divergence("p", "q"))
    by_value = lambda item: Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), item)
    ranked = over.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", F.row_number().over(by_value("term")).alias("rank"))
    terms = ranked.where(F.col("rank") <= top)

    # Part pair: no counts at all, one count alone, two counts of one term.
    empty = with_others(groups, groups, ["source"]).select(
        "lang", "source", F.col("other").alias("item"),
        F.when(F.col("terms") > 0, F.col("terms") * divergence("zero", "other_zero")).otherwise(F.lit(0).cast("long")).alias("value"),
    )
    alone = shared.groupBy("lang", "source", "p", "zero").agg(F.count(F.lit(1)).alias("rows"))
    alone = with_others(alone, groups, ["source", "p"]).select(
        "lang", F.col("source").alias("a"), F.col("other").alias("b"),
        (F.col("rows") * (divergence("p", "other_zero") - divergence("zero", "other_zero"))).alias("value"),
    )
    paths = shared.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("source", "n", "p", "zero"))).alias("path"))
    patterns = paths.where(F.size("path") > 1).groupBy("lang", "path").agg(F.count(F.lit(1)).alias("rows"))
    ordered = patterns.repartitionByRange("lang", "path").sortWithinPartitions("lang", "path")
    joint = ordered.mapInArrow(tree_corrections, SHARES)
    parts = empty.unionByName(both_ways(alone.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))).unionByName(both_ways(joint))
    sums = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = sums.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_value("item")).alias("rank"))
    return pairs.unionByName(terms)
