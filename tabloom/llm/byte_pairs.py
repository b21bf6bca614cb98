"""Byte-level BPE by speculation: propose tokens greedily, check all pairs at once, merge only what fails.

Exact BPE applies the merge of lowest rank again and again. Its result can be
recognised without doing it: a sequence of tokens is the encoding of a word if
each token is the encoding of its own bytes and no merge crosses a boundary
between two neighbours before both are complete. That is a walk back in time
over the two tokens' own merges (the inner edges of the boundary), and it needs
only the pair, so all neighbours of all words are walked side by side.

1. Words come from the tokenizer's pattern, and each distinct word of a batch is
   worked on once.
2. Greedy longest match over a trie of the vocabulary proposes tokens, all words
   side by side; a word that is a token is its own proposal.
3. ``Merges.compatible`` checks every adjacent pair of every word.
4. Words with a pair that fails go through exact merging, by a heap.

Decoding joins the bytes of the ids. Null and empty texts have no ids and decode
to ''. Special tokens written in a text become their ids and back. Texts and
words of any length are whole; a batch is cut to a bounded size of text.
"""

from __future__ import annotations

import functools
import heapq
import json
import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tabloom.llm.base import coded, with_arrow

TOKENIZER = "byte_bpe_50k.json"
# The words of a byte-level tokenizer: a fixed value of its format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Text encoded at once.
BATCH_TEXT = 4 << 20
# Words beyond this many bytes propose their tokens one after the other.
SIDE_BY_SIDE = 64
# Words that are merged exactly side by side at once.
ROWS = 1 << 14
NEVER = np.int64(1) << 40


def tokenizer_path(name: str = TOKENIZER) -> str:
    """The tokenizer's file: in the folder that TABLOOM_TOKENIZERS names, else where public_tokenizers has it."""
    if folder := os.environ.get("TABLOOM_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Merges:
    """A vocabulary, its merges in order, and the special tokens, as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        model, letters = stored["model"], byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = {raw(t): i for t, i in model["vocab"].items()}
        self.byte_ids = [ids[bytes([b])] for b in range(256)]
        self.special = {t["content"]: t["id"] for t in stored["added_tokens"]}
        size = 1 + max([*ids.values(), *self.special.values()])
        self.bytes_of = [b""] * size
        for token, i in ids.items():
            self.bytes_of[i] = token
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        # A token's rank and parts; single bytes have rank -1 and no parts.
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(pairs):
            left, right, whole = ids[raw(a)], ids[raw(b)], ids[raw(a) + raw(b)]
            self.ranks[left, right] = rank, whole
            if self.left[whole] >= 0:
                raise ValueError("two merges give the same token")
            self.rank[whole], self.left[whole], self.right[whole] = rank, left, right
        merged = np.flatnonzero(self.left >= 0)
        if (np.maximum(self.rank[self.left[merged]], self.rank[self.right[merged]]) >= self.rank[merged]).any():
            raise ValueError("a merge comes before its parts")
        self.size = size
        keys = np.array([a * size + b for a, b in self.ranks], np.int64)
        self.whole = np.array([w for _, w in self.ranks.values()], np.int64)
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_ranks = np.array([r for r, _ in self.ranks.values()], np.int64)[order]
        # The trie: state and byte to state, and the token that ends in a state.
        steps: dict[int, int] = {}
        ends = [-1]
        for token, i in ids.items():
            state = 0
            for byte in token:
                following = steps.get(state << 8 | byte)
                if following is None:
                    following = steps[state << 8 | byte] = len(ends)
                    ends.append(-1)
                state = following
            ends[state] = i
        trie = np.array(sorted(steps.items()), np.int64)
        self.step_keys, self.step_to, self.ends = trie[:, 0], trie[:, 1], np.array(ends, np.int64)
        self._step: dict[int, int] = {}
        # Tokens that exact merging of their own bytes gives; others never stand in a right proposal.
        merged = merged[np.argsort(self.rank[merged])]
        whole = self.compatible(self.left[merged], self.right[merged], self.rank[merged])
        sound = [i in self.byte_ids for i in range(size)]
        for i, fits, a, b in zip(merged.tolist(), whole.tolist(), self.left[merged].tolist(), self.right[merged].tolist()):
            sound[i] = fits and sound[a] and sound[b]
        self.sound = np.array(sound)
        lengths = np.array([len(b) for b in self.bytes_of], np.int64)
        self.starts = np.cumsum(lengths) - lengths
        self.lengths = lengths
        self.data = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        del self.bytes_of

    def compatible(self, a: np.ndarray, b: np.ndarray, upto: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge crosses the boundary between tokens ``a`` and ``b`` before both are complete.

        The walk goes back in time: the later of the two edges is taken apart, and the pair at the boundary must not
        merge before the edge became part of its whole. Equal ranks fall to the left, so an edge of ``b`` also loses
        against a merge of its own rank. With ``upto``, merges of these ranks and later are not asked.
        """
        good = np.ones(len(a), bool)
        a, b = a.astype(np.int64), b.astype(np.int64)
        # Merges at the boundary count if they come before these.
        until = np.full(len(a), NEVER, np.int64) if upto is None else upto.copy()
        live = np.arange(len(a))
        while len(live):
            x, y, limit = a[live], b[live], until[live]
            bad = self.rank_of(x, y) < limit
            good[live[bad]] = False
            rank_x, rank_y = self.rank[x], self.rank[y]
            done = bad | ((rank_x < 0) & (rank_y < 0))
            later_x = rank_x > rank_y
            x, limit = np.where(later_x, self.right[x], x), np.where(later_x, rank_x, rank_y + 1)
            y = np.where(later_x, y, self.left[y])
            a[live], b[live], until[live] = x, y, np.minimum(until[live], limit)
            live = live[~done]
        return good

    def merged(self, word: bytes) -> list[int]:
        """Exact merging: the pair of lowest rank first, the leftmost of equals."""
        tokens = [self.byte_ids[b] for b in word]
        before, after = list(range(-1, len(tokens) - 1)), list(range(1, len(tokens) + 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(tokens) and (found := self.ranks.get((tokens[i], tokens[j]))):
                heapq.heappush(heap, (found[0], i, tokens[i], tokens[j]))

        for i in range(len(tokens) - 1):
            offer(i)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i] if tokens[i] == left else len(tokens)
            if j >= len(tokens) or tokens[j] != right:
                continue
            tokens[i], tokens[j] = self.ranks[left, right][1], -1
            after[i] = after[j]
            if after[j] < len(tokens):
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [t for t in tokens if t >= 0]

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair, or ``NEVER``."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NEVER)

    def merged_side_by_side(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        """Exact merging of many words of at most ``sizes.max()`` bytes, one merge per word and round."""
        n, width = len(starts), int(sizes.max())
        column = np.arange(width)
        inside = column < sizes[:, None]
        tokens = np.where(inside, np.array(self.byte_ids)[data[np.minimum(starts[:, None] + column, len(data) - 1)]], -1)
        after, before = np.tile(column + 1, (n, 1)), np.tile(column - 1, (n, 1))
        ranks = np.full((n, width), NEVER)
        paired = inside[:, 1:]
        ranks[:, :-1][paired] = self.rank_of(tokens[:, :-1][paired], tokens[:, 1:][paired])
        live = np.arange(n)
        while len(live):
            at = ranks[live].argmin(axis=1)
            rank = ranks[live, at]
            live, at, rank = live[rank < NEVER], at[rank < NEVER], rank[rank < NEVER]
            gone = after[live, at]
            tokens[live, at], tokens[live, gone] = self.whole[rank], -1
            ranks[live, gone] = NEVER
            following = after[live, gone]
            after[live, at] = following
            more = following < sizes[live]
            before[live[more], following[more]] = at[more]
            ranks[live, at] = NEVER
            ranks[live[more], at[more]] = self.rank_of(tokens[live[more], at[more]], tokens[live[more], following[more]])
            first = before[live, at]
            has = first >= 0
            ranks[live[has], first[has]] = self.rank_of(tokens[live[has], first[has]], tokens[live[has], at[has]])
        return np.split(tokens[tokens >= 0], np.cumsum((tokens >= 0).sum(axis=1))[:-1])

    def exact(self, words: pa.Array) -> list[np.ndarray]:
        """Exact merging of each word; words of like lengths go side by side, very long ones through a heap."""
        words = words.cast(pa.large_binary())
        offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        sizes, out = np.diff(offsets), [np.zeros(0, np.int64)] * len(words)
        for w in np.flatnonzero(sizes > SIDE_BY_SIDE).tolist():
            out[w] = np.array(self.merged(data[offsets[w] : offsets[w + 1]].tobytes()), np.int64)
        low = 0
        for high in (8, 16, 32, SIDE_BY_SIDE):
            own = np.flatnonzero((sizes > low) & (sizes <= high))
            for part in np.array_split(own, len(own) // ROWS + 1):
                if len(part):
                    for w, ids in zip(part.tolist(), self.merged_side_by_side(data, offsets[:-1][part], sizes[part])):
                        out[w] = ids
            low = high
        return out

    def greedy(self, word: bytes) -> list[int]:
        if not self._step:
            self._step = dict(zip(self.step_keys.tolist(), self.step_to.tolist()))
        out, at, step, ends = [], 0, self._step, self.ends
        while at < len(word):
            state, token, reach = 0, -1, at
            for i in range(at, len(word)):
                state = step.get(state << 8 | word[i], -1)
                if state < 0:
                    break
                if ends[state] >= 0:
                    token, reach = int(ends[state]), i + 1
            out.append(token)
            at = reach
        return out

    def propose(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Greedy tokens of all words, and the word of each; words are not empty."""
        words = words.cast(pa.large_binary())
        offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        stop_of, sizes = offsets[1:], np.diff(offsets)
        tokens, owners, places = [], [], []
        for w in np.flatnonzero(sizes > SIDE_BY_SIDE).tolist():
            own = self.greedy(data[offsets[w] : stop_of[w]].tobytes())
            tokens.append(np.array(own, np.int64))
            owners.append(np.full(len(own), w))
            places.append(np.arange(len(own)))
        live = np.flatnonzero(sizes <= SIDE_BY_SIDE)
        at, number = offsets[:-1][live].copy(), 0
        while len(live):
            token, reach = np.full(len(live), -1, np.int64), at.copy()
            walk, state, place = np.arange(len(live)), np.zeros(len(live), np.int64), at.copy()
            while len(walk):
                key = state << 8 | data[place]
                found = np.minimum(np.searchsorted(self.step_keys, key), len(self.step_keys) - 1)
                there = self.step_keys[found] == key
                walk, place, state = walk[there], place[there] + 1, self.step_to[found[there]]
                ending = self.ends[state]
                final = ending >= 0
                token[walk[final]], reach[walk[final]] = ending[final], place[final]
                inside = place < stop_of[live[walk]]
                walk, place, state = walk[inside], place[inside], state[inside]
            tokens.append(token)
            owners.append(live)
            places.append(np.full(len(live), number))
            more = reach < stop_of[live]
            live, at, number = live[more], reach[more], number + 1
        none = np.zeros(0, np.int64)
        tokens, owners, places = (np.concatenate([none, *x]) for x in (tokens, owners, places))
        order = np.lexsort((places, owners))
        return tokens[order], owners[order]

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids of all words in order, where each word's ids start (and the end), and how many words were merged exactly."""
        tokens, owners = self.propose(words)
        failing = np.zeros(len(words), bool)
        failing[owners[~self.sound[tokens]]] = True
        inner = np.flatnonzero(owners[1:] == owners[:-1])
        pair, which = np.unique(tokens[inner] * self.size + tokens[inner + 1], return_inverse=True)
        fits = self.compatible(pair // self.size, pair % self.size)
        failing[owners[inner[~fits[which]]]] = True
        again = np.flatnonzero(failing)
        exact = self.exact(words.take(pa.array(again)))
        kept = ~failing[owners]
        tokens = np.concatenate([tokens[kept], *exact])
        owners = np.concatenate([owners[kept], *[np.full(len(x), w) for x, w in zip(exact, again)]])
        order = np.argsort(owners, kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=len(words)))]).astype(np.int64)
        return tokens[order], ends, len(again)

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """The ids of each text. Null has none."""
        split = regex.compile(PATTERN).findall
        special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        words: list[str] = []
        sizes, marks = [], []
        for text in pc.fill_null(texts, "").to_pylist():
            before = len(words)
            parts = special.split(text) if special and any(s in text for s in self.special) else [text]
            for part in parts:
                if part in self.special:
                    marks.append((len(words), self.special[part]))
                    words.append(part)
                else:
                    words.extend(split(part))
            sizes.append(len(words) - before)
        code, names = coded(pa.array(words, pa.large_string()))
        ids, starts, _ = self.encode_words(names)
        counts = np.diff(starts)
        at, n = starts[:-1][code], counts[code]
        if marks:
            # A special token is one id, put behind the words' own.
            places, named = (np.array(x, np.int64) for x in zip(*marks))
            at[places], n[places] = len(ids) + np.arange(len(places)), 1
            ids = np.concatenate([ids, named])
        ends = np.cumsum(n)
        values = ids[np.repeat(at - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        word_ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        offsets = np.concatenate([[0], ends])[word_ends]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))

    def decode(self, lists: pa.ListArray) -> pa.Array:
        """The text of each list of ids; bytes that are no UTF-8 become replacement marks. Null gives null."""
        ids = lists.values[lists.offsets[0].as_py() : lists.offsets[-1].as_py()].to_numpy(zero_copy_only=False).astype(np.int64)
        n = self.lengths[ids]
        ends = np.cumsum(n)
        data = self.data[np.repeat(self.starts[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        edges = np.concatenate([[0], ends])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
        return pa.array(texts, pa.string(), mask=lists.is_null().to_numpy(zero_copy_only=False))


@functools.lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    """The vocabulary of a file, read once by the driver; workers hold one broadcast copy each (some 10 MB)."""
    return Merges(path)


def _apply(df: DataFrame, column: str, fields: list[T.StructField], work: Callable, path: str | None, keep: list[str] | None) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(merges(path or tokenizer_path()))
    return with_arrow(df, column, fields, lambda: functools.partial(work, shared.value), BATCH_TEXT, keep)


def _ids(name: str) -> T.StructField:
    return T.StructField(name, T.ArrayType(T.IntegerType()))


def encode(df: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``df`` with the ids of each text."""
    return _apply(df, text, [_ids(ids)], lambda own, texts: [own.encode(texts)], path, keep)


def decode(df: DataFrame, ids: str = "ids", text: str = "decoded", path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``df`` with the text of each list of ids."""
    return _apply(df, ids, [T.StructField(text, T.StringType())], lambda own, lists: [own.decode(lists)], path, keep)


def encode_and_decode(
    df: DataFrame, text: str = "text", ids: str = "ids", decoded: str = "decoded", path: str | None = None, keep: list[str] | None = None
) -> DataFrame:
    """Both in one pass: the ids, and the text that they give back."""

    def work(own: Merges, texts: pa.Array) -> list[pa.Array]:
        lists = own.encode(texts)
        return [lists, own.decode(lists)]

    return _apply(df, text, [_ids(ids), T.StructField(decoded, T.StringType())], work, path, keep)
