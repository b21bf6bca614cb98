"""SentencePiece encoding and decoding by a Viterbi search that words with a common prefix share.

The scores of an existing model are taken as unigram weights: a text is cut
into the pieces with the largest sum of scores. No piece has the space mark
behind another character, so the best cut of a text is that of its marked words
(spaces and the word behind them). The distinct marked words of a batch are
sorted: that is their trie in depth-first order. The best score of a prefix
depends on the prefix alone, so the next word keeps the scores of the prefix it
shares with the word before and goes on from there.

Characters without a piece become byte pieces, also the space mark itself when
a text holds it, so that decoding gives back every text exactly. Equal scores
are settled for the longest last piece, as the public library settles them.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tabloom.llm.base import coded, with_arrow

MARK = "▁"
UNKNOWN_PENALTY = 10.0
MODEL = "piece_bpe_32k.model"


def model_path(path: str | None = None) -> str:
    """The model file; ``TABLOOM_TOKENIZERS`` or /opt/tokenizers unless a path is given."""
    return path or os.path.join(os.environ.get("TABLOOM_TOKENIZERS", "/opt/tokenizers"), MODEL)


@dataclass
class Pieces:
    """A vocabulary: scores and ids of text pieces, ids of byte pieces, and the bytes each id stands for."""

    ids: dict[str, tuple[float, int]]
    byte_ids: list[int]
    surface: list[bytes]
    unknown: float
    prefixes: set[str] = field(init=False, repr=False)
    steps: dict[str, tuple[str, tuple[tuple[int, float], ...]]] = field(init=False, repr=False)

    def __post_init__(self) -> None:
        self.prefixes = {piece[:i] for piece in self.ids for i in range(len(piece) + 1)}
        self.steps = {}

    def parts(self) -> tuple:
        return self.ids, self.byte_ids, self.surface, self.unknown

    def step(self, context: str) -> tuple[str, tuple[tuple[int, float], ...]]:
        """The longest end of ``context`` that begins a piece, and (length, score) of the pieces that end here.

        Longest first; a last character without a piece of its own is an unknown of length 1.
        """
        ends = tuple((len(context) - i, self.ids[context[i:]][0]) for i in range(len(context)) if context[i:] in self.ids)
        if context[-1] not in self.ids:
            ends += ((1, self.unknown),)
        start = next(i for i in range(len(context) + 1) if context[i:] in self.prefixes)
        return context[start:], ends


def load_pieces(path: str | None = None) -> Pieces:
    """The vocabulary of a model file, read on the driver; tasks get it as a broadcast of fixed size."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=model_path(path))
    ids, byte_ids, surface = {}, [0] * 256, []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[1:-1], 16)] = i
            surface.append(bytes([int(piece[1:-1], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            surface.append(b"")
        else:
            if MARK in piece.lstrip(MARK):
                raise ValueError(f"piece {piece!r} reaches over a word's end")
            ids[piece] = (model.get_score(i), i)
            surface.append(piece.replace(MARK, " ").encode())
    return Pieces(ids, byte_ids, surface, min(s for s, _ in ids.values()) - UNKNOWN_PENALTY)


def common_prefix(a: str, b: str) -> int:
    if b.startswith(a):
        return len(a)
    return len(os.path.commonprefix((a, b)))


def segment_words(words: Iterable[str], pieces: Pieces) -> dict[str, list[int]]:
    """The ids of each distinct marked word (space mark as a space), by one walk over their trie."""
    ids, steps, step = pieces.ids, pieces.steps, pieces.step
    out: dict[str, list[int]] = {}
    # Of each prefix on the path: its best score, where its last piece begins, and its end that begins a piece.
    best, back, states, last = [0.0], [0], [""], ""
    for word in sorted(words):
        depth = common_prefix(last, word)
        del best[depth + 1 :], back[depth + 1 :], states[depth + 1 :]
        # A mark that the text itself holds has no piece; \0 has none either.
        marked = word.replace(MARK, "\0").replace(" ", MARK)
        state = states[depth]
        for letter in marked[depth:]:
            depth += 1
            context = state + letter
            found = steps.get(context)
            if found is None:
                found = steps[context] = step(context)
            state, ends = found
            at, top = ends[0]
            top += best[depth - at]
            for size, score in ends[1:]:
                score += best[depth - size]
                if score > top:
                    top, at = score, size
            best.append(top)
            back.append(depth - at)
            states.append(state)
        last, cut, end = word, [], len(word)
        while end:
            start = back[end]
            if hit := ids.get(marked[start:end]):
                cut.append(hit[1])
            else:
                cut.extend(pieces.byte_ids[b] for b in reversed(word[start:end].encode()))
            end = start
        out[word] = cut[::-1]
    return out


# No piece holds a line end, so a marked word ends there too.
MARKED = re.compile(r" *[^ \n]+|\n+| +")


# Words whose ids a task keeps for its next batches; beyond that it begins anew.
KEPT_WORDS = 120_000
# Bytes of text encoded at once: a worker holds all their words as Python strings.
CUT = 1 << 20


def encode_texts(texts: pa.Array, pieces: Pieces, kept: dict[str, list[int]] | None = None) -> pa.Array:
    """Lists of ids; null for null and empty for an empty text. ``kept`` holds words from earlier batches."""
    words: list[str] = []
    ends = np.zeros(len(texts) + 1, np.int64)
    for i, text in enumerate(texts.to_pylist()):
        if text:
            words += MARKED.findall(" " + text)
        ends[i + 1] = len(words)
    codes, distinct = coded(pa.array(words, pa.string()))
    del words
    if not len(distinct):
        return pa.array([None if t is None else [] for t in texts.to_pylist()], pa.list_(pa.int32()))
    names, kept = distinct.to_pylist(), {} if kept is None else kept
    if len(kept) > KEPT_WORDS:
        kept.clear()
    kept.update(segment_words((w for w in names if w not in kept), pieces))
    parts = pa.array([kept[w] for w in names], pa.list_(pa.int32()))
    sizes = np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy()[codes])])
    values = parts.take(pa.array(codes)).flatten()
    lists = pa.ListArray.from_arrays(pa.array(sizes[ends], pa.int32()), values)
    return pc.if_else(pc.is_valid(texts), lists, None) if texts.null_count else lists


def decode_ids(lists: pa.Array, surface: pa.Array) -> pa.Array:
    """Texts of id lists. The dummy space in front goes; ids outside the vocabulary and control ids are empty;
    bytes that are no UTF-8 become U+FFFD. Null for null."""
    values = lists.flatten()
    known = pc.and_(pc.greater_equal(values, 0), pc.less(values, len(surface)))
    values = pc.if_else(pc.fill_null(known, False), values, 0)
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    parts = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), surface.take(values))
    joined = pc.binary_join(parts, b"")
    try:
        texts = joined.cast(pa.string())
    except pa.ArrowInvalid:
        texts = pa.array([b.decode(errors="replace") for b in joined.to_pylist()], pa.string())
    texts = pc.replace_substring_regex(texts, "^ ", "")
    return pc.if_else(pc.is_valid(lists), texts, None)


def encode(
    df: DataFrame, text: str = "text", out: str = "ids", path: str | None = None, keep: list[str] | None = None
) -> DataFrame:
    """``df`` with the ids of ``text`` as an array column. No shuffle; rows stay as they are."""
    parts = df.sparkSession.sparkContext.broadcast(load_pieces(path).parts())
    field = T.StructField(out, T.ArrayType(T.IntegerType()))

    def prepare():
        pieces, kept = Pieces(*parts.value), {}
        return lambda texts: [encode_texts(texts, pieces, kept)]

    return with_arrow(df, text, [field], prepare, CUT, keep)


def encode_and_decode(
    df: DataFrame, text: str = "text", ids: str = "ids", decoded: str = "decoded", path: str | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """``df`` with the ids of ``text`` and the text that these ids decode to, in one pass by one worker per task."""
    parts = df.sparkSession.sparkContext.broadcast(load_pieces(path).parts())
    fields = [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())]

    def prepare():
        pieces, kept = Pieces(*parts.value), {}
        surface = pa.array(pieces.surface, pa.binary())

        def make(texts: pa.Array) -> list[pa.Array]:
            lists = encode_texts(texts, pieces, kept)
            return [lists, decode_ids(lists, surface)]

        return make

    return with_arrow(df, text, fields, prepare, CUT, keep)


def encode_round_trip(
    df: DataFrame, text: str = "text", ids: str = "ids", same: str = "round_trip", path: str | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """``df`` with the ids of ``text`` and whether they decode to the very text (null to null); the decoded texts stay in the tasks."""
    parts = df.sparkSession.sparkContext.broadcast(load_pieces(path).parts())
    fields = [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(same, T.BooleanType())]

    def prepare():
        pieces, kept = Pieces(*parts.value), {}
        surface = pa.array(pieces.surface, pa.binary())

        def make(texts: pa.Array) -> list[pa.Array]:
            lists = encode_texts(texts, pieces, kept)
            decoded = decode_ids(lists, surface)
            equal = pc.fill_null(pc.equal(decoded, texts), False)
            return [lists, pc.or_(equal, pc.and_(pc.is_null(decoded), pc.is_null(texts)))]

        return make

    return with_arrow(df, text, fields, prepare, CUT, keep)


def decode(
    df: DataFrame, ids: str = "ids", out: str = "text", path: str | None = None, keep: list[str] | None = None
) -> DataFrame:
    """``df`` with the text of an array column of ids."""
    surface = df.sparkSession.sparkContext.broadcast(load_pieces(path).surface)

    def prepare():
        table = pa.array(surface.value, pa.binary())
        return lambda lists: [decode_ids(lists, table)]

    return with_arrow(df, ids, [T.StructField(out, T.StringType())], prepare, keep=keep)
