"""Grouping of spelling variants by a bit-sliced position index.

Words are the corpus's runs of letters, with their occurrences. Two are near if
one inserted, deleted or replaced code point turns one into the other. A word's
form is its most frequent near word, if that is at least ``RATIO`` times as
frequent; its root is the last of the chain of forms.

A block of the vocabulary is an index of bitsets, one per (position, letter): bit
j tells that word j has the letter there. A query walks its letters once, for all
words of the block and all queries side by side, with four sets: words without
error so far (Z) and words with one error whose letters lie at the same place
(S, replaced), one further (P, inserted) or one back (M, deleted):

    S' = S & B[i] | Z & ~B[i]     P' = P & B[i + 1] | Z'     M' = M & B[i - 1] | Z     Z' = Z & B[i]

Not every word meets every block. Near words whose shorter has m letters share
their first (m - 1) // 2 letters or the rest of m - 1 letters at their end, so
words are dealt by both; a pair counts where it shares its beginning, else at
its end, hence once. Buckets beyond ``BLOCK`` words are split: each part indexes
its share, and all words of the bucket are asked. A task holds one block.

Null texts have no words. A null id is written as nothing. Repeated rows count
each. Ties among forms go to the smaller word in code-point order. A word
without near words has no form and is its own root. Chains end, since counts
double with each step. Words of any length take part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.base import bounded_batches, coded, cut, flat, release
from tabloom.operators.joining import attach_by_key
from tabloom.runtime import materialize

# Fixed values of the words: runs of these letters; at least so many code points and occurrences.
NOT_LETTERS = "[^A-Za-zÀ-ÿ]+"
MIN_LETTERS = 5
MIN_COUNT = 3
RATIO = 2
# One of so many (document, run) pairs loses a letter.
NOISE = 97
BLOCK = 1024
BLOCK_LETTERS = 1 << 16
QUERIES = 2048
# Bytes up to which words are hashed side by side.
SIDE_BY_SIDE = 48


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & np.uint32(1), (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


CRC = _crc_table()


def crc32_after(starts: np.ndarray, words: pa.Array, which: np.ndarray) -> np.ndarray:
    """crc32 of a beginning (whose crc32 is given) followed by word ``which``, for each pair."""
    words = words.cast(pa.large_binary())
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    sizes = np.diff(offsets)[which]
    order = np.argsort(-sizes, kind="stable")
    state = (starts.astype(np.uint32) ^ np.uint32(0xFFFFFFFF))[order]
    at, sizes = offsets[:-1][which][order], sizes[order]
    long = int(np.searchsorted(-sizes, -SIDE_BY_SIDE, side="left"))
    for i in range(long):
        raw = data[at[i] : at[i] + sizes[i]].tobytes()
        state[i] = zlib.crc32(raw, int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    step = 0
    while True:
        stop = int(np.searchsorted(-sizes, -step, side="left"))
        if stop <= long:
            break
        now = state[long:stop]
        state[long:stop] = CRC[(now ^ data[at[long:stop] + step]) & np.uint32(0xFF)] ^ (now >> np.uint32(8))
        step += 1
    out = np.empty(len(state), np.uint32)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of each piece of (id, text); runs whose hash says so lose a letter first."""
    for batch in batches:
        for piece in cut(batch, 1):
            ids, texts = piece.columns
            words, rows = flat(pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), NOT_LETTERS))
            full = pc.greater_equal(pc.utf8_length(words), MIN_LETTERS)
            code, names = coded(words.filter(full))
            if not len(names):
                continue
            width = len(names)
            key, n = np.unique(rows[full.to_numpy(zero_copy_only=False)] * np.int64(width) + code, return_counts=True)
            starts = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids.to_pylist()], np.uint32)
            which = key % width
            h = crc32_after(starts[key // width], names, which)
            noisy = h % NOISE == 0
            counts = np.bincount(which[~noisy], n[~noisy], width).astype(np.int64)
            changed: dict[str, int] = {}
            touched = names.take(pa.array(which[noisy])).to_pylist()
            for word, hash_, times in zip(touched, h[noisy].tolist(), n[noisy].tolist()):
                gap = hash_ % len(word)
                short = word[:gap] + word[gap + 1 :]
                if len(short) >= MIN_LETTERS:
                    changed[short] = changed.get(short, 0) + times
            whole = pa.array(counts > 0)
            out = pa.concat_arrays([names.filter(whole).cast(pa.string()), pa.array(list(changed), pa.string())])
            sums = np.concatenate([counts[counts > 0], np.array(list(changed.values()), np.int64)])
            yield pa.RecordBatch.from_arrays([out, pa.array(sums)], names=["word", "n"])
        release()


def letters_of(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all words in a row, where each word starts in it, and the words' lengths."""
    sizes = np.array([len(w) for w in words], np.int64)
    flat_letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    return flat_letters, np.cumsum(sizes) - sizes, sizes


class PositionIndex:
    """Bitsets over a block of words by (position, letter)."""

    def __init__(self, words: list[str]):
        letters, starts, sizes = letters_of(words)
        self.width = (len(words) + 63) // 64
        self.count = len(words)
        self.sizes = sizes
        self.alphabet = np.unique(letters)
        owner = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(len(letters)) - starts[owner] + 1
        slot = place * len(self.alphabet) + np.searchsorted(self.alphabet, letters)
        self.slots, row = np.unique(slot, return_inverse=True)
        # The last row is that of letters which no word has at a position.
        self.bits = np.zeros((len(self.slots) + 1, self.width), np.uint64)
        one = np.uint64(1) << (owner & 63).astype(np.uint64)
        np.bitwise_or.at(self.bits, (row, owner >> 6), one)
        self.longest = int(sizes.max()) if len(words) else 0

    def having(self, test: np.ndarray) -> np.ndarray:
        """The set of words that pass a test, as bits."""
        raw = np.zeros(self.width * 64, np.uint8)
        raw[: self.count] = test
        return np.packbits(raw, bitorder="little").view(np.uint64)

    def at(self, position: int, letters: np.ndarray) -> np.ndarray:
        """For each query's letter, the words that have it at a position."""
        code = np.searchsorted(self.alphabet, letters)
        known = self.alphabet[np.minimum(code, len(self.alphabet) - 1)] == letters
        slot = position * len(self.alphabet) + code
        row = np.minimum(np.searchsorted(self.slots, slot), len(self.slots) - 1)
        return self.bits[np.where(known & (self.slots[row] == slot), row, len(self.slots))]

    def near(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) numbers of all pairs that are exactly one edit apart."""
        letters, starts, sizes = letters_of(words)
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        zero = np.tile(self.having(np.ones(self.count, bool)), (len(words), 1))
        same, back = np.zeros_like(zero), np.zeros_like(zero)
        further = np.tile(self.having(self.sizes >= 1), (len(words), 1))
        queries, found = [], []
        steps = min(int(sizes[0]), self.longest + 1) if len(words) else 0
        for i in range(1, steps + 1):
            live = int(np.searchsorted(-sizes, -i, side="right"))
            zero, same, further, back = (x[:live] for x in (zero, same, further, back))
            own = letters[starts[:live] + i - 1]
            here, after, before = self.at(i, own), self.at(i + 1, own), self.at(i - 1, own)
            same = (same & here) | (zero & ~here & self.having(self.sizes >= i))
            back = (back & before) | zero
            zero = zero & here
            further = (further & after) | (zero & self.having(self.sizes > i))
            first = int(np.searchsorted(-sizes, -i, side="left"))
            if first < live:
                end = [(same, i), (further, i + 1), (back, i - 1)]
                hit = np.bitwise_or.reduce([x[first:live] & self.having(self.sizes == n) for x, n in end])
                q, cell = np.nonzero(hit)
                ones, bit = np.nonzero((hit[q, cell][:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1))
                queries.append(order[first:live][q[ones]])
                found.append(cell[ones] * 64 + bit)
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *queries]), np.concatenate([none, *found])


ENTRIES = "word string, n long, near long, best_n long, best string"


def ask_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of sorted (m, ending, key, part, indexed, word, n) rows, summed per word and block.

    Words of a part that are indexed come first. A pair counts in the bucket that both are in, if m is the length of
    the shorter, and, at a common end, if their beginnings differ.
    """
    index: list[tuple] = []
    asked: list[tuple] = []
    state: dict = {"group": None, "rows": 0, "letters": 0}
    built: list[PositionIndex] = []

    def answer() -> Iterator[pa.RecordBatch]:
        if index and asked:
            if not built:
                built.append(PositionIndex([x[2] for x in index]))
            q, w = built[0].near([x[2] for x in asked])
            found: dict[int, list] = {}
            for a, b in zip(q.tolist(), w.tolist()):
                bucket, head, word, n = asked[a]
                other_bucket, other_head, other, other_n = index[b]
                m, ending = bucket[:2]
                if bucket == other_bucket and min(len(word), len(other)) == m and not (ending and head == other_head):
                    held = found.setdefault(a, [0, 0, ""])
                    held[0] += 1
                    if other_n > held[1] or (other_n == held[1] and other < held[2]):
                        held[1:] = other_n, other
            if found:
                rows = [(asked[a][2], asked[a][3], *held) for a, held in found.items()]
                columns = [pa.array(x, k) for x, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=["word", "n", "near", "best_n", "best"])
        asked.clear()

    def close_group() -> None:
        # A bucket of one word has no pair.
        if state["rows"] == 1:
            state["letters"] -= len(index[-1][2])
            index.pop()
            asked.pop()
        state["rows"] = 0

    for batch in batches:
        for m, ending, key, part, indexed, word, n in zip(*[c.to_pylist() for c in batch.columns]):
            if (m, ending, key, part) != state["group"]:
                close_group()
                if len(index) >= BLOCK or state["letters"] >= BLOCK_LETTERS:
                    yield from answer()
                    index.clear()
                    built.clear()
                    state["letters"] = 0
                state["group"] = (m, ending, key, part)
                built.clear()
            entry = (state["group"], word[: (m - 1) // 2], word, n)
            if indexed:
                index.append(entry)
                state["letters"] += len(word)
            asked.append(entry)
            state["rows"] += 1
            if not indexed and len(asked) >= QUERIES:
                yield from answer()
    close_group()
    yield from answer()
    release()


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of the words of (word, n) that have near ones."""
    sizes = f"filter(array(char_length(word) - 1, char_length(word)), x -> x >= {MIN_LETTERS})"
    by_size = vocabulary.select("word", "n", F.explode(F.expr(sizes)).alias("m"))
    head, tail = "left(word, (m - 1) div 2)", "right(word, m - 1 - (m - 1) div 2)"
    keyed = f"stack(2, false, {head}, true, {tail}) AS (ending, key)"
    entries = by_size.selectExpr("word", "n", "m", keyed)
    bucket = ["m", "ending", "key"]
    large = entries.groupBy(*bucket).agg(F.count(F.lit(1)).alias("words")).where(F.col("words") > BLOCK)
    parts = large.select(*bucket, F.ceil(F.col("words") / BLOCK).cast("int").alias("parts"))
    dealt = attach_by_key(entries, parts, bucket).withColumn("parts", F.coalesce("parts", F.lit(1)))
    asked = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    asked = asked.withColumn("indexed", F.pmod(F.xxhash64("word"), F.col("parts")) == F.col("part"))
    rows = asked.select(*bucket, "part", "indexed", "word", "n").repartition(*bucket, "part")
    rows = rows.sortWithinPartitions(*bucket, "part", F.col("indexed").desc(), "word")
    best = F.min(F.struct((-F.col("best_n")).alias("rank"), F.col("best").alias("best"))).alias("b")
    found = rows.mapInArrow(ask_blocks, ENTRIES).groupBy("word").agg(F.sum("near").alias("n_near"), best)
    return found.select("word", "n_near", (-F.col("b.rank")).alias("best_n"), F.col("b.best").alias("best"))


def with_roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words of (word, form): chains are halved until none moves."""
    links = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = materialize(
            links.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")),
            "roots",
        )
        if not links.where("moved").take(1):
            return links.drop("moved")
        links = links.drop("moved")


def spelling_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every word of the vocabulary."""
    bounded_batches(df.sparkSession)
    texts = df.select(F.col(f"`{doc_id}`").cast("string").alias("id"), F.col(f"`{text}`").alias("text"))
    counts = texts.mapInArrow(count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    vocabulary = materialize(counts.where(F.col("n") >= MIN_COUNT), "vocabulary")
    near = vocabulary.join(near_words(vocabulary), "word", "left")
    formed = F.col("best_n") >= RATIO * F.col("n")
    words = materialize(
        near.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n")),
        "spellings",
    )
    roots = with_roots(words.where("form IS NOT NULL"))
    return words.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
