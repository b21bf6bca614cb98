"""Benchmark decontamination with a generalised suffix automaton of the test items.

One automaton holds every sub-sequence of words of all items. A document's
words are walked through it, keeping the longest match that ends at each word.
A match of ``window`` words or more ends a window; an item with fewer words is
one window of its own. Words inside windows are hits.

The items are dealt into blocks of bounded size, each with its own automaton,
so memory does not grow with the benchmark; documents pass through one block
after the other and are never shuffled. A table between blocks keeps each
chain of tasks short.

Null and empty texts have no words; items without words never occur. Repeated
items count each by its own id, items with a null id count in ``n_items`` but
have no name in the list. Documents are rows: repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.base import with_arrow
from tabloom.runtime import materialize

WINDOW = 10
# Words of items in one automaton, at some 300 bytes of memory each.
BLOCK_WORDS = 500_000

# Above this percentage of hit words a document goes as a whole.
MAX_PERCENT = 50

# Separators \x00-\x2F, \x3A-\x60 and \x7B-\x7F become spaces once A-Z are lower-cased.
LETTERS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 32 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(LETTERS).split() if text else []


class Automaton:
    """A generalised suffix automaton over word codes.

    ``step[s]``: word to state, ``link[s]``: the state of the longest suffix in
    another class, ``size[s]``: the longest sequence of the class.
    """

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.step: list[dict[bytes, int]] = [{}]
        self.link, self.size = [-1], [0]
        items = [(name, words) for name, words in items if words]
        for _, words in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
        # The items whose windows end in a state, and the short items that are a suffix of it.
        self.items: list[set[int]] = [set() for _ in self.step]
        self.whole: list[list[tuple[int, int]]] = [[] for _ in self.step]
        self.names = [name for name, _ in items]
        for i, (_, words) in enumerate(items):
            state = 0
            for at, word in enumerate(words, 1):
                state = self.step[state][word]
                if at >= window:
                    self.items[self.ending(state)].add(i)
            if len(words) < window:
                self.whole[state].append((len(words), i))
        self.short = [0] * len(self.step)
        for s in sorted(range(1, len(self.step)), key=self.size.__getitem__):
            own, above = self.whole[s], self.link[s]
            self.short[s] = s if own else self.short[above]

    def ending(self, state: int) -> int:
        """The state of the last ``window`` words of a match in ``state``."""
        while self.size[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def _extend(self, last: int, word: bytes) -> int:
        step, link, size = self.step, self.link, self.size
        if word in step[last]:
            there = step[last][word]
            return there if size[there] == size[last] + 1 else self._split(last, word, there)
        new = self._state({}, size[last] + 1)
        while last >= 0 and word not in step[last]:
            step[last][word] = new
            last = link[last]
        if last < 0:
            link[new] = 0
        else:
            there = step[last][word]
            link[new] = there if size[there] == size[last] + 1 else self._split(last, word, there)
        return new

    def _split(self, last: int, word: bytes, there: int) -> int:
        copy = self._state(dict(self.step[there]), self.size[last] + 1)
        self.link[copy], self.link[there] = self.link[there], copy
        while last >= 0 and self.step[last].get(word) == there:
            self.step[last][word] = copy
            last = self.link[last]
        return copy

    def _state(self, step: dict[bytes, int], size: int) -> int:
        self.step.append(step)
        self.link.append(0)
        self.size.append(size)
        return len(self.step) - 1

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """The hit spans (start, end) of a document in order, merged, and the items that occur."""
        step, link, size, short, window = self.step, self.link, self.size, self.short, self.window
        spans, found = [], set()
        state = length = 0
        for at, word in enumerate(words, 1):
            there = step[state].get(word)
            if there is None:
                if not state:
                    continue
                while there is None and state > 0:
                    state = link[state]
                    there = step[state].get(word)
                if there is None:
                    state = length = 0
                    continue
                length = size[state]
            state, length = there, length + 1
            reach = 0
            if length >= window:
                reach = window
                found |= self.items[self.ending(state)]
            at_short = short[state]
            while at_short:
                # Of this state's short items all have its full size; those of its suffix states fit as well.
                for n, item in self.whole[at_short]:
                    if n <= length:
                        found.add(item)
                        reach = max(reach, n)
                at_short = short[link[at_short]]
            if reach:
                start = at - reach
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, at))
        return spans, found


FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.LongType())),
    T.StructField("items", T.ArrayType(T.StringType())),
]


def merged(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(a + b):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def item_blocks(items: DataFrame, id_col: str, text: str) -> Iterator[list[tuple[object, list[bytes]]]]:
    """The items in blocks of bounded size; the driver holds one block at a time."""
    block, words = [], 0
    rows = items.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text}`").alias("text"))
    for row in rows.toLocalIterator():
        own = words_of(row["text"])
        if block and words + len(own) > BLOCK_WORDS:
            yield block
            block, words = [], 0
        block.append((row["id"], own))
        words += len(own)
    if block:
        yield block


def contamination(
    df: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, keep: list[str] | None = None,
) -> DataFrame:
    """``df`` with ``n_words``, hit ``spans`` (start, end, start, end ... in words) and the ``items`` that occur."""
    kept = [c for c in df.columns if (keep is None or c in keep) and c not in {f.name for f in FIELDS}]
    out = df.select(
        *[f"`{c}`" for c in kept], F.col(f"`{text}`").alias("__text"),
        F.array().cast("array<bigint>").alias("spans"), F.array().cast("array<string>").alias("items"),
    )
    done = 0
    for block in item_blocks(items, item_id, item_text):
        out = _through(materialize(out, "contamination") if done else out, block, window)
        done += 1
    return (out if done else _through(out, [], window)).drop("__text")


def _through(df: DataFrame, block: list[tuple[object, list[bytes]]], window: int) -> DataFrame:
    """``df`` with ``n_words``, and with what this block's items add to ``spans`` and ``items``."""
    shared = df.sparkSession.sparkContext.broadcast(block)

    def prepare():
        automaton = Automaton(shared.value, window)

        def make(rows: pa.Array) -> list[pa.Array]:
            counts, spans, items = [], [], []
            before = zip(*[rows.field(i).to_pylist() for i in range(3)])
            for text, old, names in before:
                words = words_of(text)
                where, found = automaton.scan(words)
                where = merged(list(zip(old[::2], old[1::2])), where) if old else where
                counts.append(len(words))
                spans.append([x for span in where for x in span])
                items.append(names + [automaton.names[i] for i in sorted(found)])
            return [
                pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string())),
            ]

        return make

    state = F.struct(F.col("__text").alias("text"), "spans", "items")
    return with_arrow(df.withColumn("__state", state), "__state", FIELDS, prepare).drop("__state")


def remove_spans(text: str | None, spans: list[int]) -> str | None:
    """The text without its hit words and what lies between them; the rest stays as it is."""
    if not text or not spans:
        return text
    raw = text.encode()
    spaced = raw.translate(LETTERS)
    edges, at = [], 0
    for word in spaced.split():
        start = spaced.index(word, at)
        at = start + len(word)
        edges.append((start, at))
    out, at = [], 0
    for start, end in zip(spans[::2], spans[1::2]):
        out.append(raw[at : edges[start][0]])
        at = edges[end - 1][1]
    return b"".join([*out, raw[at:]]).decode()


def hit_words(spans: str = "spans"):
    """Words inside the spans, as a column."""
    signed = F.transform(spans, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    return F.aggregate(signed, F.lit(0).cast("long"), lambda a, x: a + x)


def clean(
    df: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, max_percent: int = MAX_PERCENT,
) -> DataFrame:
    """``df`` without documents of which more than ``max_percent`` of the words are hits, and without the hit spans of
    the others. Texts without hits never leave the JVM a second time and stay byte for byte as they are."""
    found = contamination(df, items, text, item_id, item_text, window)
    kept = found.where(hit_words() * 100 <= F.col("n_words") * max_percent)
    value = F.struct(F.when(F.size("spans") > 0, F.col(f"`{text}`")).alias("text"), F.col("spans").alias("spans"))

    def prepare():
        def make(rows: pa.Array) -> list[pa.Array]:
            texts, spans = rows.field("text").to_pylist(), rows.field("spans").to_pylist()
            return [pa.array([remove_spans(t, s) for t, s in zip(texts, spans)], pa.string())]

        return make

    cut = with_arrow(kept.withColumn("__pair", value), "__pair", [T.StructField("__cut", T.StringType())], prepare)
    return cut.select(
        *[F.coalesce("__cut", f"`{c}`").alias(c) if c == text else F.col(f"`{c}`") for c in df.columns]
    )
