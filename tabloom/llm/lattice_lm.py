"""Document likelihood under a lattice of words and subwords, with a word model beside it as a base.

Every cut of a word into pieces of an existing vocabulary is a path of the
lattice, and a word of the training texts is one more piece: itself. A training
word of count c weighs (c - D) / N, with N training words in all; what the
discount D takes from the V distinct ones, D * V / N, is the weight of the
paths of subwords, of known and unknown words alike. No piece reaches over a
word's end, so the marginal over all cuts of a text is the product over its
words, each by a forward recursion in log space. Words are walked as a sorted
trie: a prefix's forward value is computed once.

All weights are learned from the training texts: counts of words; D from how
many occur once and twice; the share of ends; and the pieces' weights by a step
of expectation and maximisation over the distinct training words. It starts from
the vocabulary's scores, which are ranks: the mean of exp(score / scale) / sum
over a grid of scales. The expected uses are the derivatives of the forward
values, carried back over the same trie.

A text is scored as its sequence of lower-cased words and one end, the events
of the base model too. Characters without a piece are spelled in byte pieces.

1. Each batch of documents is counted once: its words go to buckets by hash,
   its counts per document stay together. Nothing is gathered per document.
2. Buckets add up the training counts of their words (a word is one entry per
   batch there, however frequent) and the expected uses of pieces.
3. Buckets send each batch the two scores of its words; the batch's counts are
   multiplied with them. Every group is a batch or a bucket, bounded by bytes.

Null and empty texts have no words and score their end alone. A null id is in
training. Repeated rows are documents each. Without training documents the
base is uniform, and words have the paths of subwords alone.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.base import bounded_batches, bucketed, coded, cut, per_row, planes, release, split_words, tidy, unplaned
from tabloom.llm.sentence_pieces import MARK, Pieces, common_prefix, load_pieces
from tabloom.runtime import materialize

HELD_OUT = 10
ALPHA = 0.1
BUCKET_BYTES = 12 << 20
CUT = 4 << 20
SCALES = (500.0, 1000.0, 2000.0, 4000.0, 8000.0, 16000.0)
# Pieces with a score as low as this are there for form only and have no weight.
NO_WEIGHT = -1e6


# Occurrences of the start's pieces that the learned weights are smoothed with, and parts of one use that are counted.
PRIOR = 2000.0
USES = 1 << 20


class Walk:
    """A walk over sorted words for one log weight of each piece and of a byte."""

    def __init__(self, pieces: Pieces, weights: dict[str, float], byte: float) -> None:
        self.pieces, self.weights, self.byte = pieces, weights, byte
        # Per end of a prefix that begins a piece: what it goes on as, and (length, log weight, piece or bytes) of the last pieces.
        self.steps: dict[str, tuple[str, list[tuple[int, float, str | int]]]] = {}

    def step(self, context: str) -> tuple[str, list[tuple[int, float, str | int]]]:
        state, _ = self.pieces.step(context)
        ends: list = [(len(context) - i, self.weights[context[i:]], context[i:]) for i in range(len(context)) if context[i:] in self.weights]
        if context[-1] not in self.weights:
            size = len((MARK if context[-1] == "\0" else context[-1]).encode())
            ends.append((1, self.byte * size, size))
        return state, ends

    def run(self, words: Iterable[str], uses: Counter | None = None) -> list[float]:
        """The marginal natural-log probability of each word behind a space mark; ``uses`` adds up what is expected of each piece."""
        steps, step, exp, log = self.steps, self.step, math.exp, math.log
        forward, states, paths, last, out = [0.0], [""], [None], "", []
        # The derivative of all words' values by each forward value on the path.
        slope = [0.0]

        def back(depth: int) -> None:
            """Carry the slopes beyond ``depth`` to the pieces and the prefixes before them."""
            for at in range(len(forward) - 1, depth, -1):
                here, value = slope[at], forward[at]
                for size, weight, piece in paths[at]:
                    share = here * exp(forward[at - size] + weight - value)
                    slope[at - size] += share
                    if type(piece) is str:
                        uses[piece] += share
                    else:
                        uses[""] += share * piece

        for word in words:
            marked = MARK + word.replace(MARK, "\0")
            depth = common_prefix(last, marked)
            if uses is not None:
                back(depth)
            del forward[depth + 1 :], states[depth + 1 :], paths[depth + 1 :], slope[depth + 1 :]
            state = states[depth]
            for letter in marked[depth:]:
                depth += 1
                found = steps.get(state + letter)
                if found is None:
                    found = steps[state + letter] = step(state + letter)
                state, ends = found
                if len(ends) == 1:
                    forward.append(forward[depth - ends[0][0]] + ends[0][1])
                else:
                    values = [forward[depth - size] + weight for size, weight, _ in ends]
                    top, total = max(values), 0.0
                    for value in values:
                        total += exp(value - top)
                    forward.append(top + log(total))
                states.append(state)
                paths.append(ends)
                slope.append(0.0)
            slope[depth] += 1.0
            last = marked
            out.append(forward[depth])
        if uses is not None:
            back(0)
        return out


class Lattice:
    """Log weights of pieces and bytes for each of several scales, normalised over all of them."""

    def __init__(self, pieces: Pieces, scales: tuple[float, ...] = SCALES) -> None:
        self.pieces, self.scales = pieces, np.array(scales)
        scores = {p: s for p, (s, _) in pieces.ids.items() if s > NO_WEIGHT}
        lowest = min(scores.values())
        every = np.array([*scores.values(), *[lowest] * 256])[:, None] / self.scales
        total = every.max(0) + np.log(np.exp(every - every.max(0)).sum(0))
        self.weights = {p: s / self.scales - total for p, s in scores.items()}
        self.byte = lowest / self.scales - total

    def log_probabilities(self, words: Iterable[str]) -> np.ndarray:
        """The marginal natural-log probability of each word behind a space mark, per scale; words are sorted."""
        words = list(words)
        walks = [Walk(self.pieces, {p: float(w[i]) for p, w in self.weights.items()}, float(self.byte[i])) for i in range(len(self.scales))]
        return np.array([walk.run(words) for walk in walks]).reshape(len(walks), len(words)).T

    def start(self) -> np.ndarray:
        """Log weights of all pieces, and of a byte last: the mean probability over the scales."""
        every = np.array([*self.weights.values(), self.byte])
        return np.log(np.exp(every).mean(1))


def learned(start: np.ndarray, uses: dict[int, int]) -> np.ndarray:
    """Log weights from the expected uses of pieces (the last are bytes), smoothed with the start."""
    found = np.zeros(len(start))
    for piece, times in uses.items():
        found[piece] = times / USES
    # All 256 bytes weigh the same.
    found[-1] /= 256
    size = np.append(np.ones(len(start) - 1), 256.0)
    return np.log((found + PRIOR * np.exp(start)) / ((found * size).sum() + PRIOR))


def walk_of(pieces: Pieces, logs: np.ndarray) -> Walk:
    names = [p for p, (s, _) in pieces.ids.items() if s > NO_WEIGHT]
    return Walk(pieces, dict(zip(names, logs.tolist())), float(logs[-1]))


BATCHES = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("kind", "chunk")] + [T.StructField("bucket", T.IntegerType())]
    + [T.StructField("words", T.ArrayType(T.StringType()))]
    + [T.StructField(n, T.BinaryType()) for n in ("counts", "ids", "named", "starts", "codes", "times")]
)


def _batches(n_buckets: int):
    """Per batch: a row per bucket with its words and their training counts, and one with the counts per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in cut(batch, 2, CUT):
                chunk, number = f"{part}:{number}", number + 1
                held = piece.column(1).to_numpy(zero_copy_only=False).astype(bool)
                n = len(held)
                words, rows = split_words(piece.column(2), lower=True)
                codes, names = coded(words)
                digests = np.fromiter(map(xxhash.xxh3_64_intdigest, names.cast(pa.binary()).to_pylist()), np.uint64, len(names))
                home, _ = bucketed(digests, n_buckets)
                # Words by bucket, then by text: each bucket's part is sorted.
                by_text = pc.sort_indices(names).to_numpy()
                order = by_text[np.argsort(home[by_text], kind="stable")]
                rank = np.empty(len(names), np.int64)
                rank[order] = np.arange(len(names))
                keys, times = np.unique(rows * max(len(names), 1) + rank[codes] if len(codes) else np.zeros(0, np.int64), return_counts=True)
                of, ranks = keys // max(len(names), 1), keys % max(len(names), 1)
                trained = np.bincount(ranks, np.where(held[of], 0, times), len(names)).astype(np.int64)
                edges = np.searchsorted(home[order], np.arange(n_buckets + 1))
                starts = np.concatenate([[0], np.cumsum(per_row(of, n))])
                full = np.flatnonzero(np.diff(edges))
                lists = pa.ListArray.from_arrays(pa.array(np.append(edges[full], len(names)), pa.int32()), names.take(pa.array(order)))
                ids = piece.column(0)
                parts = (pc.fill_null(ids, 0).to_numpy(), pc.is_valid(ids).to_numpy(zero_copy_only=False).astype(np.uint8), starts,
                         ranks.astype(np.uint32), times.astype(np.uint32))
                nothing = [None] * len(full)
                columns = [
                    pa.array(["words"] * len(full) + ["texts"], pa.string()), pa.array([chunk] * (len(full) + 1), pa.string()),
                    pa.array([*full.tolist(), -1], pa.int32()), pa.concat_arrays([lists, pa.nulls(1, lists.type)]),
                    pa.array([*[planes(trained[edges[b] : edges[b + 1]]) for b in full], None], pa.binary()),
                    *[pa.array([*nothing, planes(x)], pa.binary()) for x in parts],
                ]
                yield pa.RecordBatch.from_arrays(columns, names=BATCHES.names)
                release()

    return run


def _vocabulary(group: pa.Table) -> tuple[np.ndarray, list[str], np.ndarray]:
    """The code of each entry of a bucket's rows, the sorted distinct words, and the training count of each."""
    flat = pa.concat_arrays([c.flatten() for c in group["words"].chunks])
    counts = np.concatenate([unplaned(x, np.int64) for x in group["counts"].to_pylist()])
    codes, names = coded(flat)
    names = names.to_pylist()
    order = np.array(sorted(range(len(names)), key=names.__getitem__), np.int64)
    rank = np.empty(len(names), np.int64)
    rank[order] = np.arange(len(names))
    codes = rank[codes]
    return codes, [names[i] for i in order], np.bincount(codes, counts, len(names)).astype(np.int64)


def _train(parts, start):
    """Per bucket: training words, distinct ones, those that occur once and twice, and the expected uses of pieces by the distinct ones."""

    def run(group: pa.Table) -> pa.Table:
        _, names, counts = _vocabulary(group)
        known = np.flatnonzero(counts)
        uses: Counter = Counter()
        walk = walk_of(Pieces(*parts.value), start.value)
        walk.run([names[i] for i in known], uses)
        place = {p: i for i, p in enumerate([*walk.weights, ""])}
        used = {place[p]: round(x * USES) for p, x in uses.items()}
        return pa.table({
            "n": [int(counts.sum())], "v": [len(known)], "once": [int((counts == 1).sum())], "twice": [int((counts == 2).sum())],
            "piece": pa.array([list(used)], pa.list_(pa.int32())), "uses": pa.array([list(used.values())], pa.list_(pa.int64())),
        })

    return run


TRAINED = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n", "v", "once", "twice")]
    + [T.StructField("piece", T.ArrayType(T.IntegerType())), T.StructField("uses", T.ArrayType(T.LongType()))]
)
SCORED = T.StructType([T.StructField("chunk", T.StringType()), T.StructField("bucket", T.IntegerType())] + [T.StructField(n, T.BinaryType()) for n in ("counts", "values")])


def word_logs(counts: np.ndarray, cuts: np.ndarray, n: int, v: int, discount: float) -> np.ndarray:
    """Log probabilities of words over all their paths: the word itself, if trained, and its ``cuts`` into subwords."""
    if not n:
        return cuts
    with np.errstate(divide="ignore"):
        return np.logaddexp(np.log(np.maximum(counts - discount, 0.0) / n), np.log(discount * v / n) + cuts)


def _score_words(parts, logs, n: int, v: int, discount: float):
    """Each batch's words of a bucket with the training count and the log probability of each."""

    def run(group: pa.Table) -> pa.Table:
        codes, names, counts = _vocabulary(group)
        values = word_logs(counts, np.array(walk_of(Pieces(*parts.value), logs.value).run(names)), n, v, discount)
        counts, values = counts[codes], values[codes]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in group["words"].to_pylist()])]).tolist()
        return pa.table({
            "chunk": group["chunk"], "bucket": group["bucket"],
            "counts": pa.array([planes(counts[a:b]) for a, b in zip(ends, ends[1:])], pa.binary()),
            "values": pa.array([planes(values[a:b]) for a, b in zip(ends, ends[1:])], pa.binary()),
        })

    return run


TEXTS = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("place", "n_tokens", "n_known")] + [T.StructField(n, T.DoubleType()) for n in ("base", "lattice")]
)


def _score_texts(n: int, v: int, ends: int):
    """Sums over the words of each document of a batch; the base has its end, the lattice has words alone."""
    below = np.log10(n + ALPHA * (v + 1))
    end = np.log10(ends + ALPHA) - below

    def run(words: pa.Table, texts: pa.Table) -> pa.Table:
        words = words.sort_by("bucket")
        counts = np.concatenate([np.zeros(0, np.int64), *[unplaned(x, np.int64) for x in words["counts"].to_pylist()]])
        values = np.concatenate([np.zeros(0), *[unplaned(x, np.float64) for x in words["values"].to_pylist()]])
        out = []
        for row in texts.to_pylist():
            starts, place, named = unplaned(row["starts"], np.int64), unplaned(row["ids"], np.int64), unplaned(row["named"], np.uint8)
            ranks, times = unplaned(row["codes"], np.uint32), unplaned(row["times"], np.uint32).astype(np.int64)
            owner = np.repeat(np.arange(len(place)), np.diff(starts))
            tokens = np.bincount(owner, times, len(place)).astype(np.int64) + 1
            known = np.bincount(owner, times * (counts[ranks] > 0), len(place)).astype(np.int64) + (ends > 0)
            base = np.bincount(owner, times * (np.log10(counts[ranks] + ALPHA) - below), len(place)) + end
            lattice = np.bincount(owner, times * values[ranks], len(place))
            out.append(pa.table([pa.array(place, mask=named == 0), tokens, known, base, lattice], TEXTS.names))
        return pa.concat_tables(out) if out else TEXTS_EMPTY

    return run


TEXTS_EMPTY = pa.table({"place": pa.array([], pa.int64()), "n_tokens": pa.array([], pa.int64()), "n_known": pa.array([], pa.int64()),
                        "base": pa.array([], pa.float64()), "lattice": pa.array([], pa.float64())})


def score_documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Per document: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``."""
    spark = df.sparkSession
    bounded_batches(spark)
    held = F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string")) % HELD_OUT == 0, F.lit(False))
    docs = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), held.alias("held"), F.col(f"`{text}`").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text").cast("long")), F.coalesce(F.sum((~F.col("held")).cast("long")), F.lit(0))).first()
    total, ends = size[0] or 0, size[1]
    n_buckets = max(24, -(-total // BUCKET_BYTES))
    pieces = load_pieces(path)
    parts, start = spark.sparkContext.broadcast(pieces.parts()), spark.sparkContext.broadcast(Lattice(pieces).start())
    batches = materialize(docs.mapInArrow(_batches(n_buckets), BATCHES), "word-batches", partition_by=("kind",))
    words = batches.where("kind = 'words'").select("chunk", "bucket", "words", "counts")
    trained = materialize(words.groupBy("bucket").applyInArrow(tidy(_train(parts, start)), TRAINED), "piece-uses")
    row = trained.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "v", "once", "twice")]).first()
    n, v = row[0] + ends, row[1] + (ends > 0)
    # As many rows as the vocabulary has pieces.
    uses = trained.select(F.explode(F.arrays_zip("piece", "uses")).alias("x")).groupBy("x.piece").agg(F.sum("x.uses")).collect()
    logs = spark.sparkContext.broadcast(learned(start.value, dict(map(tuple, uses))))
    discount = (row[2] + 1) / (row[2] + 2 * row[3] + 2)
    scored = words.groupBy("bucket").applyInArrow(tidy(_score_words(parts, logs, row[0], row[1], discount)), SCORED)
    texts = batches.where("kind = 'texts'").select("chunk", "ids", "named", "starts", "codes", "times")
    sums = scored.groupBy("chunk").cogroup(texts.groupBy("chunk")).applyInArrow(_score_texts(n, v, ends), TEXTS)
    # A word or an end comes next: the share of ends among both, learned from the training texts.
    go, stop = np.log10((n - ends + 1) / (n + 2)), np.log10((ends + 1) / (n + 2))
    lattice = F.col("lattice") / F.lit(float(np.log(10))) + F.lit(float(go)) * (F.col("n_tokens") - 1) + F.lit(float(stop))
    is_held = F.coalesce(F.crc32(F.col("place").cast("string")) % HELD_OUT == 0, F.lit(False))
    return sums.select(
        F.col("place").alias("doc_id"), is_held.alias("held_out"), "n_tokens", "n_known",
        F.lit(n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), lattice.alias("score"),
    )
