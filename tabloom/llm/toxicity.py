"""Toxicity as ordinal severity: a cumulative-link model over sparse text features.

P(grade >= k) = sigmoid(s - cut_k), with one score s of shared weights and
ordered cuts. A feature is a hashed word or beginning of a word; its value is
the number of distinct words of the text that have it, so neither length nor
repetition of one word inflates a score. The output is the expected severity,
the sum of P(grade >= k).

The model is fitted from at most ``SAMPLE_ROWS`` labelled rows, those with the
smallest hashes of their ids, and at most ``MAX_FEATURES`` features. Spark
counts the sample's features, and the driver fits the telling ones; scoring covers every row and every whole text, in one pass without a
shuffle. Null and empty texts have no features. Ids that repeat among the
sampled rows count once. Labels that are null are left out; without labels,
or with one class, nothing is rejected.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.base import coded, flat, per_row, with_arrow
from tabloom.runtime import materialize

SAMPLE_ROWS = 8_000
MAX_FEATURES = 20_000
MIN_ROWS = 5
MIN_Z = 2.5
# Least share of toxic rows among the rows with a feature.
MIN_SHARE = 0.2
BUCKETS = 1 << 22
PREFIXES = (3, 4, 5, 6)
THRESHOLD = 0.3
# Sampled features in one text at most; a text beyond that is left out of the fit (never of the scoring).
SAMPLE_WORDS = 20_000


def distinct_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes of the distinct lower-case words of each text, the words, and the row of each code."""
    lists = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[\x00-/:-`{-\x7f]+")
    words, rows = flat(lists)
    full = pc.greater(pc.binary_length(words), 0)
    codes, names = coded(words.filter(full))
    keys = np.unique(rows[full.to_numpy(zero_copy_only=False)] * np.int64(max(len(names), 1)) + codes)
    return keys % max(len(names), 1), names, keys // max(len(names), 1)


def features_of(word: str) -> list[int]:
    raw = [word + "$", *[word[:n] for n in PREFIXES if len(word) >= n]]
    return [zlib.crc32(x.encode()) % BUCKETS for x in raw]


@dataclass
class Severity:
    """A fitted model: weights by feature, the cuts in rising order, and the bias inside the cuts."""

    weights: dict[int, float]
    cuts: list[float]

    def word_scores(self, names: pa.Array) -> np.ndarray:
        weights = self.weights
        return np.array([sum(weights.get(f, 0.0) for f in features_of(w)) for w in names.to_pylist()], np.float64)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def severity_grades(toxic: np.ndarray, lists: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """Grade 0 for rows that are not toxic; toxic ones are 1 or 2 by the share of their words' features (``sizes`` of
    them) that (nearly) only toxic rows have, below or from its median among toxic rows."""
    odds, _ = log_odds(toxic, lists)
    sharp = {f for f, (z, a, b) in odds.items() if z >= MIN_Z and a >= MIN_ROWS and b * 20 <= a}
    share = np.array([sum(f in sharp for f in x.tolist()) for x in lists]) / np.maximum(sizes, 1)
    bad = toxic > 0
    middle = np.median(share[bad]) if bad.any() else 0.0
    return np.where(bad, 1 + (share >= middle), 0)


def log_odds(toxic: np.ndarray, lists: list[np.ndarray]) -> tuple[dict[int, tuple[float, float, float]], np.ndarray]:
    """By feature: z of its log odds between toxic and other rows, and the rows of either kind that have it."""
    sets = [np.unique(x) for x in lists]
    every = np.concatenate(sets) if sets else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    ids, inverse = np.unique(every, return_inverse=True)
    a = np.bincount(inverse, toxic[owner] > 0, len(ids))
    b = np.bincount(inverse, toxic[owner] <= 0, len(ids))
    p, q = (toxic > 0).sum(), (toxic <= 0).sum()
    logit = np.log((a + 0.5) / (p - a + 0.5)) - np.log((b + 0.5) / (q - b + 0.5))
    z = logit / np.sqrt(1 / (a + 0.5) + 1 / (p - a + 0.5) + 1 / (b + 0.5) + 1 / (q - b + 0.5))
    common = a + b >= MIN_ROWS
    return {int(f): (float(s), float(x), float(y)) for f, s, x, y in zip(ids[common], z[common], a[common], b[common])}, ids


def telling(z: float, a: float, b: float) -> bool:
    """Whether a feature goes into the model: clearly rarer in toxic rows, or clearly and often enough in them."""
    return z <= -MIN_Z or (z >= MIN_Z and a >= MIN_SHARE * (a + b + 1))


def fit_severity(lists: list[np.ndarray], grades: np.ndarray, rounds: int = 400, spread: float = 1.0) -> Severity:
    """The most probable model under a normal prior of deviation ``spread`` for weights, by Adam over all rows.

    Weights are shared by the cuts, which stay in order.
    """
    grades = np.asarray(grades)
    top = int(grades.max()) if len(grades) else 0
    if top == 0 or not (grades == 0).any():
        return Severity({}, [np.inf] * max(top, 1))
    odds, _ = log_odds(grades, lists)
    order = sorted((f for f, v in odds.items() if telling(*v)), key=lambda f: (-abs(odds[f][0]), f))
    order = np.array(sorted(order[:MAX_FEATURES]), np.int64)
    cols, rows = [], []
    for i, x in enumerate(lists):
        at = np.searchsorted(order, x)
        hit = at[(at < len(order)) & (order[np.minimum(at, len(order) - 1)] == x)] if len(order) else at[:0]
        cols.append(hit)
        rows.append(np.full(len(hit), i))
    cols, rows = np.concatenate(cols), np.concatenate(rows)
    n, m = len(lists), len(order)
    share = np.array([(grades >= k).mean() for k in range(1, top + 1)]).clip(1e-4, 1 - 1e-4)
    start = np.log((1 - share) / share)
    # The first cut, then the logs of the steps to the next ones.
    x = np.concatenate([np.zeros(m), start[:1], np.log(np.maximum(np.diff(start), 0.1))])
    first, second = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, rounds + 1):
        w = x[:m]
        cuts = x[m] + np.concatenate([[0.0], np.cumsum(np.exp(x[m + 1 :]))])
        score = np.bincount(rows, w[cols], n)
        edges = np.concatenate([[-np.inf], cuts, [np.inf]])
        low, high = sigmoid(edges[grades] - score), sigmoid(edges[grades + 1] - score)
        p = np.maximum(high - low, 1e-12)
        d_high, d_low = high * (1 - high) / p, low * (1 - low) / p
        g_score = d_high - d_low
        g_cut = np.array([(d_low[grades == k].sum() - d_high[grades == k - 1].sum()) for k in range(1, top + 1)])
        tails = np.cumsum(g_cut[::-1])[::-1]
        g = np.concatenate([np.bincount(cols, g_score[rows], m), tails[:1], tails[1:] * np.exp(x[m + 1 :])]) / n
        g[:m] += w / (n * spread * spread)
        first = 0.9 * first + 0.1 * g
        second = 0.999 * second + 0.001 * g * g
        step = 0.1 * min(1.0, 4 * (1 - t / (rounds + 1)))
        rate = step / (np.sqrt(second / (1 - 0.999**t)) + 1e-6)
        x = x - rate * first / (1 - 0.9**t)
    cuts = x[m] + np.concatenate([[0.0], np.cumsum(np.exp(x[m + 1 :]))])
    return Severity({int(f): float(v) for f, v in zip(order, x[:m]) if v}, [float(c) for c in cuts])


def telling_features(rows: DataFrame) -> np.ndarray:
    """The features of the sample that go into the model, counted by Spark; at most twice ``MAX_FEATURES``."""
    bad = (F.col("__label") > 0).cast("long")
    p, q = rows.agg(F.coalesce(F.sum(bad), F.lit(0)), F.coalesce(F.sum(1 - bad), F.lit(0))).first()
    counts = (
        rows.select(bad.alias("bad"), F.explode(F.array_distinct("__features")).alias("f")).groupBy("f")
        .agg(F.sum("bad").alias("a"), F.sum(1 - F.col("bad")).alias("b")).where(F.col("a") + F.col("b") >= MIN_ROWS)
    )
    a, b, half = F.col("a"), F.col("b"), F.lit(0.5)
    logit = F.log((a + half) / (F.lit(p) - a + half)) - F.log((b + half) / (F.lit(q) - b + half))
    spread = F.sqrt(1 / (a + half) + 1 / (F.lit(p) - a + half) + 1 / (b + half) + 1 / (F.lit(q) - b + half))
    ranked = counts.withColumn("z", logit / spread)
    kept = ranked.where((F.col("z") <= -MIN_Z) | ((F.col("z") >= MIN_Z) & (a >= MIN_SHARE * (a + b + 1))))
    found = kept.orderBy(F.abs("z").desc(), "f").limit(2 * MAX_FEATURES).select("f").collect()
    return np.array(sorted(r["f"] for r in found), np.int64)


def labelled_features(
    docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, sample_rows: int
) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Of a bounded sample, the rows whose ids have the smallest hashes: labels, telling features, numbers of features.

    Features are counted on the executors; the driver gets the telling ones alone.
    """
    ids = (
        labels.select(F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{label}`").cast("int").alias("__label"))
        .where("__id IS NOT NULL AND __label IS NOT NULL")
        .orderBy(F.xxhash64("__id"), "__id", "__label")
        .limit(sample_rows)
        .dropDuplicates(["__id"])
    )
    texts = docs.select(F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{text}`").alias("__text"))
    sampled = texts.join(F.broadcast(ids), "__id")

    def prepare():
        def make(values: pa.Array) -> list[pa.Array]:
            codes, names, rows = distinct_words(values)
            ends = np.concatenate([[0], np.cumsum(per_row(rows, len(values)))])
            own = [features_of(w) for w in names.to_pylist()]
            lists = [[f for c in codes[a:b] for f in own[c]] if b - a <= SAMPLE_WORDS else None for a, b in zip(ends, ends[1:])]
            return [pa.array(lists, pa.list_(pa.int32()))]

        return make

    fields = [T.StructField("__features", T.ArrayType(T.IntegerType()))]
    found = with_arrow(sampled, "__text", fields, prepare, keep=["__id", "__label"]).where("__features IS NOT NULL")
    rows = materialize(found.dropDuplicates(["__id"]), "toxicity-sample")
    chosen = telling_features(rows)

    def narrow():
        def make(values: pa.Array) -> list[pa.Array]:
            lists = [np.asarray(x.values) for x in values]
            return [pa.array([x[np.isin(x, chosen)] for x in lists], pa.list_(pa.int32())), pa.array([len(x) for x in lists], pa.int64())]

        return make

    fields = [T.StructField("__kept", T.ArrayType(T.IntegerType())), T.StructField("__size", T.LongType())]
    kept = with_arrow(rows, "__features", fields, narrow, keep=["__id", "__label"])
    sample = kept.orderBy(F.xxhash64("__id"), "__id").toArrow()
    lists = [np.asarray(x.values.to_numpy(zero_copy_only=False), np.int64) for x in sample["__kept"]]
    return np.asarray(sample["__label"].to_numpy(), np.int64), lists, np.asarray(sample["__size"].to_numpy(), np.int64)


def train(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
    sample_rows: int = SAMPLE_ROWS,
) -> Severity:
    toxic, lists, sizes = labelled_features(docs, labels, doc_id, text, label, sample_rows)
    return fit_severity(lists, severity_grades(toxic, lists, sizes))


SEVERITY = T.StructField("expected_severity", T.DoubleType())


def score(df: DataFrame, model: Severity, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` with ``expected_severity`` and the probability ``p_toxic`` of grade 1 or more."""
    parts = df.sparkSession.sparkContext.broadcast((model.weights, model.cuts))

    def prepare():
        weights, cuts = parts.value
        own = Severity(weights, cuts)

        def make(texts: pa.Array) -> list[pa.Array]:
            codes, names, rows = distinct_words(texts)
            scores = np.bincount(rows, own.word_scores(names)[codes], len(texts)) if len(codes) else np.zeros(len(texts))
            above = np.stack([sigmoid(scores - c) for c in cuts])
            return [pa.array(above.sum(0), pa.float64()), pa.array(above[0], pa.float64())]

        return make

    return with_arrow(df, text, [SEVERITY, T.StructField("p_toxic", T.DoubleType())], prepare, keep=keep)
