"""Line-first quality rules: bad lines go, and documents that lose too much text go with them.

Each line is judged alone: navigation (menu separators), boilerplate (short
lines with a stock phrase) and punctuation (several words without any closing
mark). The lines that stay are the cleaned text. A document is rejected if the
words of failed lines hold more than ``max_lost`` of its word characters, or if
it fails a base rule (too few words, or too many words in repeated windows).

Null and empty texts have no words and fail the base rule; their cleaned text
is null or empty. Repeated rows are judged each by itself. A text is judged
whole, however long; all counts are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.base import coded, flat, per_row, split_words, with_arrow

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
MAX_LOST = 0.5

# Phrases of page furniture, in lower case, and the longest line (in words) they condemn.
BOILERPLATE = (
    "accept all cookies", "all rights reserved", "click here", "cookie policy", "enable javascript", "lorem ipsum",
    "privacy policy", "read more", "sign up for our newsletter", "skip to content", "subscribe now", "terms of service",
    "terms of use", "use of cookies",
)
BOILERPLATE_WORDS = 12

# A line of this many words or more needs a closing mark somewhere; prose of any language here has one.
UNPUNCTUATED_WORDS = 30
CLOSING = r"[.!?:;…。！？]"
# A line is a menu if at least this share of its words are separators.
SEPARATORS = ("|", "»", "›", "•", "·", ">")
MENU_SHARE = 0.25

FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("word_chars", T.LongType()),
    T.StructField("n_symbols", T.LongType()),
    T.StructField("n_dup_lines", T.LongType()),
    T.StructField("n_repeat_words", T.LongType()),
    T.StructField("n_lines", T.LongType()),
    T.StructField("n_bad_lines", T.LongType()),
    T.StructField("lost_chars", T.LongType()),
]


def repeated_words(codes: np.ndarray, rows: np.ndarray, n: int, window: int = WINDOW) -> np.ndarray:
    """Per row, the words inside windows of ``window`` words that occur twice or more in that row.

    Windows get exact ranks by doubling: a window of 2k words is a pair of ranks of k words.
    """
    if window & (window - 1):
        raise ValueError("the window is a power of two")
    if len(codes) < window:
        return np.zeros(n, np.int64)
    ranks, size = codes.astype(np.int64), 1
    while size < window:
        pairs = ranks[:-size] * (int(ranks.max()) + 1) + ranks[size:]
        ranks = np.unique(pairs, return_inverse=True)[1]
        size *= 2
    starts = np.flatnonzero(rows[: len(ranks)] == rows[window - 1 :])
    keys = rows[starts] * (int(ranks.max()) + 1) + ranks[starts]
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    again = starts[counts[inverse] > 1]
    edge = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + window, -1)
    return per_row(rows[np.cumsum(edge[:-1]) > 0], n)


def char_counts(words: pa.Array, rows: np.ndarray, n: int) -> np.ndarray:
    return per_row(rows, n, pc.utf8_length(words).to_numpy(zero_copy_only=False))


def bad_lines(lines: pa.Array) -> np.ndarray:
    """Which lines fail a rule."""
    words, rows = split_words(lines, lower=False)
    n_words = per_row(rows, len(lines))
    separators = per_row(rows[pc.is_in(words, pa.array(SEPARATORS)).to_numpy(zero_copy_only=False)], len(lines))
    menu = separators > np.maximum(n_words * MENU_SHARE, 1)
    unclosed = n_words >= UNPUNCTUATED_WORDS
    at = np.flatnonzero(unclosed)
    unclosed[at] = ~pc.match_substring_regex(lines.take(pa.array(at)), CLOSING).to_numpy(zero_copy_only=False)
    stock = (n_words > 0) & (n_words <= BOILERPLATE_WORDS)
    at = np.flatnonzero(stock)
    pattern = "|".join(BOILERPLATE)
    stock[at] = pc.match_substring_regex(pc.ascii_lower(lines.take(pa.array(at))), pattern).to_numpy(zero_copy_only=False)
    return menu | unclosed | stock


def judge(texts: pa.Array, cleaned: bool) -> list[pa.Array]:
    n, valid = len(texts), pc.is_valid(texts)
    texts = pc.fill_null(texts, "")
    words, rows = split_words(texts, lower=False)
    codes, _ = coded(words)
    symbols = pc.count_substring_regex(texts, r"[#*$%&|<>]").to_numpy(zero_copy_only=False)
    split = pc.split_pattern(texts, "\n")
    lines, of = flat(split)
    line_words, line_rows = split_words(lines, lower=False)
    chars = char_counts(line_words, line_rows, len(lines))
    full = np.flatnonzero(chars)
    line_codes, distinct = coded(lines.take(pa.array(full)))
    kinds = np.unique(of[full] * max(len(distinct), 1) + line_codes) // max(len(distinct), 1)
    bad = bad_lines(lines)
    out = [
        per_row(rows, n), char_counts(words, rows, n), symbols, per_row(of[full], n) - per_row(kinds, n),
        repeated_words(codes, rows, n), per_row(of[full], n), per_row(of[bad], n), per_row(of, n, np.where(bad, chars, 0)),
    ]
    arrays = [pa.array(x, pa.int64()) for x in out]
    if cleaned:
        kept = np.flatnonzero(~bad)
        ends = np.concatenate([[0], np.cumsum(per_row(of[kept], n))])
        parts = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), lines.take(pa.array(kept)))
        arrays.append(pc.if_else(valid, pc.binary_join(parts, "\n"), None))
    return arrays


def line_rules(
    df: DataFrame, text: str = "text", cleaned: str | None = "cleaned_text", max_lost: float = MAX_LOST,
    keep: list[str] | None = None,
) -> DataFrame:
    """``df`` with the counts, ``base_failed``, ``kept`` and, unless ``cleaned`` is None, the text without bad lines."""
    fields = FIELDS + ([T.StructField(cleaned, T.StringType())] if cleaned else [])
    judged = with_arrow(df, text, fields, lambda: lambda texts: judge(texts, bool(cleaned)), keep=keep)
    failed = (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT
    )
    lost = F.col("lost_chars") > F.col("word_chars") * F.lit(max_lost)
    return judged.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~lost)
