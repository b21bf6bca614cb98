"""Removal of repeated long strings by prefix-free parsing of the corpus.

Every 100-byte string that starts earlier in the corpus makes its later copies
go. Comparing all suffixes of a corpus is the work of a suffix array; parsing
first shrinks what has to be sorted.

1. Parsing. A rolling hash of 32 bytes triggers phrases: a string of 100 bytes
   belongs to the leftmost smallest hash inside it, so equal strings have equal
   triggers at equal offsets, wherever they stand. A phrase is the bytes of all
   strings with one trigger; phrases overlap and none is a prefix of another.
2. Dictionary. Equal phrases (trigger and content) are one entry, first per
   batch, then per bucket of the trigger's hash. All but the first occurrence in
   corpus order are repeats. An entry whose trigger has no other entry is done:
   most of the text, whose phrases are unique, is never compared.
3. Suffixes. Of entries that share a trigger, the suffixes of 100 bytes or more
   are sorted by their first 100 bytes together with their place in the corpus;
   all but the first of equal ones are repeats. Neighbours are compared byte by
   byte, so hashes only sort. Suffixes are dealt by the 83 bytes that 18
   neighbouring offsets share, not by trigger, so a trigger that many documents
   share is spread.
4. The spans of both steps are joined to their documents and cut out.

A trigger frequent within a batch deals its phrases by content, and leaves only
a flag at its own bucket, so one common passage is no hot bucket either.

Order is by document id, then place in the text. Null texts are empty. Ids that
repeat with other texts, and null ids (they come first), get a rank by id and
text hash; rows equal in id and text are one document and get equal results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.base import bounded_batches, bucketed, cut, mixed, planes, release, tidy, unplaned
from tabloom.operators.ordering import position_in_order
from tabloom.runtime import materialize

LENGTH = 100
TRIGGER = 32
SEGMENT = 1 << 18
# Bytes of text in one bucket, and parsed at once; phrases take some 4 times their text while sorted.
BUCKET_BYTES = 8 << 20
PARSE_BYTES = 2 << 20
SPLIT = 18

# Values of bytes, and powers of an odd base with their inverses modulo 2^64.
BYTE = mixed(np.arange(1, 257, dtype=np.uint64))
BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


class Hashes:
    """Rolling hashes of any part of a byte string of at most ``n`` bytes."""

    def __init__(self, n: int) -> None:
        self.power = _powers(BASE, n + 1)
        self.inverse = _powers(pow(BASE, -1, 1 << 64), n + 1)

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE[data] * self.power[: len(data)], out=out[1:])
        return out

    def parts(self, sums: np.ndarray, starts: np.ndarray | slice, stops: np.ndarray | slice) -> np.ndarray:
        return mixed((sums[stops] - sums[starts]) * self.inverse[: len(sums)][starts])


def triggers(data: np.ndarray, hashes: Hashes, length: int = LENGTH, k: int = TRIGGER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each string of ``length`` bytes of ``data``: the place of its trigger; and the sums and the trigger hashes."""
    sums = hashes.sums(data)
    own = hashes.parts(sums, slice(0, len(data) - k + 1), slice(k, len(data) + 1))
    # The hash in the high 40 bits and the place in the low 24: the smallest is the leftmost of the smallest hashes.
    least = (own & ~np.uint64(0xFFFFFF)) | np.arange(len(own), dtype=np.uint64)
    width, need = 1, length - k + 1
    while width * 2 <= need:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if need > width:
        least = np.minimum(least[: len(least) - (need - width)], least[need - width :])
    return (least & np.uint64(0xFFFFFF)).astype(np.int64), sums, own


def phrases(data: np.ndarray, ends: np.ndarray, hashes: Hashes) -> tuple[np.ndarray, ...]:
    """Phrases of documents laid end to end: first and last string, document, trigger hash, content hash, and the
    offset of the trigger."""
    out = []
    for a in range(0, max(len(data) - LENGTH + 1, 0), SEGMENT):
        part = data[a : a + SEGMENT + LENGTH - 1]
        at, sums, own = triggers(part, hashes)
        place = np.arange(a, a + len(at))
        doc = np.searchsorted(ends, place, side="right")
        valid = np.flatnonzero(place + LENGTH <= ends[doc])
        if not len(valid):
            continue
        new = (np.diff(valid) != 1) | (np.diff(at[valid]) != 0)
        first = valid[np.concatenate([[True], new])]
        last = valid[np.concatenate([new, [True]])]
        content = hashes.parts(sums, first, last + LENGTH)
        content = mixed(content ^ ((at[first] - first).astype(np.uint64) << np.uint64(32)) ^ (last - first).astype(np.uint64))
        out.append((first + a, last + a, doc[first], own[at[first]], content, at[first] - first))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none
    return tuple(np.concatenate(x) for x in zip(*out))


BLOBS = ("key", "content", "doc", "start", "size", "offset", "flag", "known_doc", "known_start", "known_size")
KINDS = (np.uint32, np.uint64, np.int64, np.uint32, np.uint8, np.uint8, np.uint8, np.int64, np.uint32, np.uint8)
KIND = dict(zip(BLOBS, KINDS))
# Sorting goes through a bucket in this many ranges, as a power of two.
RANGE_BITS = 3
ENTRIES = T.StructType([T.StructField("bucket", T.IntegerType())] + [T.StructField(n, T.BinaryType()) for n in BLOBS])
# Flags: an entry dealt by trigger, one dealt by content, and the mark at a trigger that has several entries.
PLAIN, DEALT, MARK = 0, 1, 2


def _entries(n_buckets: int):
    """Per batch and bucket: the batch's first occurrence of each phrase, and the places of its later ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes(SEGMENT + LENGTH)
        for batch in batches:
            for piece in cut(batch, 1, PARSE_BYTES):
                ids = piece.column(0).to_numpy(zero_copy_only=False)
                order = np.argsort(ids, kind="stable")
                ids, texts = ids[order], piece.column(1).take(pa.array(order)).to_pylist()
                raw = [(t or "").encode() for t in texts]
                ends = np.cumsum([len(t) for t in raw])
                data = np.frombuffer(b"".join(raw), np.uint8)
                first, last, row, trigger, content, offset = phrases(data, ends, hashes)
                content >>= np.uint64(16)
                start, size = first - np.concatenate([[0], ends])[row], last - first + 1
                doc = ids[row]
                by = np.lexsort((content, trigger))
                t, c = trigger[by], content[by]
                head = np.concatenate([[True], (t[1:] != t[:-1]) | (c[1:] != c[:-1])])[: len(by)]
                # A row that repeats id and text has the same places; it repeats nothing.
                lead = by[head][np.cumsum(head) - 1]
                later = by[~head & ((doc[by] != doc[lead]) | (start[by] != start[lead]))]
                by = by[head]
                t, c = trigger[by], content[by]
                edge = np.concatenate([[True], t[1:] != t[:-1]])[: len(by)]
                several = np.bincount(np.cumsum(edge) - 1)[np.cumsum(edge) - 1] > 1
                marks = np.flatnonzero(several & edge)
                spread = mixed(trigger ^ (content * np.uint64(BASE)))
                # A trigger is the smallest hash of its neighbours; mixed again, triggers go evenly over the buckets.
                even = mixed(t)
                key = np.concatenate([np.where(several, spread[by], even), even[marks]])
                rec = np.concatenate([by, by[marks]])
                flag = np.concatenate([np.where(several, DEALT, PLAIN), np.full(len(marks), MARK)]).astype(np.uint8)
                sort = np.argsort(key, kind="stable")
                key, rec, flag = key[sort], rec[sort], flag[sort]
                bucket, rest = bucketed(key, n_buckets)
                # Later occurrences are final; by document they make no bucket hot.
                known = bucketed(mixed(doc[later].astype(np.uint64)), n_buckets)[0]
                order = np.argsort(known, kind="stable")
                later, known = later[order], known[order]
                edges = np.searchsorted(bucket, np.arange(n_buckets + 1)).tolist()
                others = np.searchsorted(known, np.arange(n_buckets + 1)).tolist()
                rows = []
                for b in range(n_buckets):
                    x, y = slice(edges[b], edges[b + 1]), slice(others[b], others[b + 1])
                    r, k = rec[x], later[y]
                    if len(r) or len(k):
                        values = (np.diff(rest[x], prepend=np.uint32(0)), content[r], doc[r], start[r], size[r], offset[r], flag[x], doc[k], start[k], size[k])
                        rows.append((b, *[planes(v.astype(kind)) for v, kind in zip(values, KINDS)]))
                columns = list(zip(*rows)) or [()] * 11
                arrays = [pa.array(columns[0], pa.int32()), *[pa.array(x, pa.binary()) for x in columns[1:]]]
                yield pa.RecordBatch.from_arrays(arrays, names=ENTRIES.names)
                release()

    return run


MARKS = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("doc", "start", "stop", "offset")] + [T.StructField("ask", T.BooleanType())]
)


def _dictionary(group: pa.Table) -> pa.Table:
    """Of a bucket: spans of phrases that occur earlier, and those entries (``ask``) whose trigger has others.

    One range of keys is sorted at a time.
    """
    column = lambda n: np.concatenate([unplaned(x, KIND[n]) for x in group[n].to_pylist()])
    key = np.concatenate([np.cumsum(unplaned(x, np.uint32), dtype=np.uint32) for x in group["key"].to_pylist()])
    held = [column(n) for n in BLOBS[1:7]]
    slot = (key >> np.uint32(32 - RANGE_BITS)).astype(np.uint8)
    found = [_earlier(key[at], *[x[at] for x in held]) for r in range(1 << RANGE_BITS) if len(at := np.flatnonzero(slot == r))]
    del key, held, slot
    known = [column(n) for n in BLOBS[7:]]
    starts = known[1].astype(np.int64)
    none = np.zeros(len(starts), np.int64)
    found.append((known[0], starts, starts + known[2] + LENGTH - 1, none, none > 0))
    return pa.table({n: np.concatenate([f[i] for f in found]) for i, n in enumerate(MARKS.names)})


def _earlier(key, content, doc, start, size, offset, flag) -> tuple[np.ndarray, ...]:
    order = np.lexsort((start, doc, flag == MARK, content, key))
    key, content, doc, start, size, offset, flag = (x[order] for x in (key, content, doc, start, size, offset, flag))
    new_key = np.concatenate([[True], key[1:] != key[:-1]])
    new = new_key | np.concatenate([[True], content[1:] != content[:-1]])
    group_of = np.cumsum(new_key) - 1
    several = (np.bincount(group_of, new) > 1) | (np.bincount(group_of, flag > 0) > 0)
    real = flag != MARK
    ask = new & real & several[group_of]
    # Equal rows have equal places: they are one occurrence and none repeats the other.
    entry = np.cumsum(new) - 1
    lead = np.flatnonzero(new)
    same = (doc == doc[lead][entry]) & (start == start[lead][entry])
    out = ask | (real & ~same)
    starts = start[out].astype(np.int64)
    return doc[out], starts, starts + size[out] + LENGTH - 1, offset[out].astype(np.int64), ask[out]


SUFFIXES = T.StructType(
    [T.StructField("bucket", T.IntegerType()), T.StructField("doc", T.LongType()), T.StructField("start", T.LongType()), T.StructField("bytes", T.BinaryType())]
)


def _suffixes(n_buckets: int):
    """The asked phrases of each document in parts of ``SPLIT`` offsets from their trigger, dealt by what the part's
    strings have in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in cut(batch, 1, 1 << 20):
                rows = []
                for doc, text, spans in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), piece.column(2).to_pylist()):
                    raw = text.encode()
                    for span in spans:
                        begin, trigger = span["start"], span["offset"]
                        final = span["stop"] - begin - LENGTH
                        # String s has its trigger at offset trigger - s; parts hold offsets [j SPLIT, (j + 1) SPLIT).
                        for j in range((trigger - final) // SPLIT, trigger // SPLIT + 1):
                            top, bottom = trigger - j * SPLIT, trigger - (j + 1) * SPLIT + 1
                            common = xxhash.xxh3_64_intdigest(raw[begin + top : begin + bottom + LENGTH], j)
                            low, high = max(bottom, 0), min(top, final)
                            rows.append((common * n_buckets >> 64, doc, begin + low, raw[begin + low : begin + high + LENGTH]))
                columns = list(zip(*rows)) or [()] * 4
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=SUFFIXES.names)
                release()

    return run


SPANS = T.StructType(MARKS.fields[:3])


def _sort_suffixes(group: pa.Table) -> pa.Table:
    """Spans of the strings that occur earlier among the suffixes of a bucket."""
    parts = group["bytes"].to_pylist()
    sizes = np.array([len(p) for p in parts], np.int64)
    data = np.frombuffer(b"".join(parts), np.uint8)
    base = np.cumsum(sizes) - sizes
    counts = sizes - LENGTH + 1
    owner = np.repeat(np.arange(len(parts), dtype=np.int32), counts)
    offset = (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.int32)
    place = base[owner] + offset
    hashes = Hashes(len(data))
    value = hashes.parts(hashes.sums(data), place, place + LENGTH)
    del hashes
    docs, starts = group["doc"].to_numpy(), group["start"].to_numpy()
    again = np.zeros(len(value), bool)
    strings = np.lib.stride_tricks.sliding_window_view(data, LENGTH) if len(data) >= LENGTH else None
    slot = (value >> np.uint64(64 - RANGE_BITS)).astype(np.uint8)
    # One range of hashes is sorted at a time.
    for r in range(1 << RANGE_BITS):
        at = np.flatnonzero(slot == r)
        doc, start = docs[owner[at]], starts[owner[at]] + offset[at]
        order = np.lexsort((start, doc, value[at]))
        at, doc, start = at[order], doc[order], start[order]
        new = np.concatenate([[True], np.diff(value[at]) != 0])[: len(at)]
        lead = np.flatnonzero(new)[np.cumsum(new) - 1]
        far = np.flatnonzero((np.arange(len(at)) != lead) & ((doc != doc[lead]) | (start != start[lead])))
        for first in range(0, len(far), 1 << 16):
            x = far[first : first + (1 << 16)]
            if not (strings[place[at[x]]] == strings[place[at[lead[x]]]]).all():
                raise ArithmeticError("two different strings have one 64-bit hash; change BASE")
            again[at[x]] = True
    del value, slot
    hit = np.flatnonzero(again)
    if not len(hit):
        return pa.table({n: pa.array([], pa.int64()) for n in SPANS.names})
    cutoff = np.concatenate([[True], (np.diff(hit) != 1) | (np.diff(owner[hit]) != 0)])
    first, last = hit[cutoff], hit[np.concatenate([cutoff[1:], [True]])]
    begin, end = starts[owner[first]] + offset[first], starts[owner[last]] + offset[last]
    return pa.table({"doc": docs[owner[first]], "start": begin, "stop": end + LENGTH})


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc, start, stop) of repeated bytes, overlapping and in no order; ``docs`` has a unique ``doc`` and ``text``."""
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n_buckets = max(24, -(-total // BUCKET_BYTES))
    entries = docs.mapInArrow(_entries(n_buckets), ENTRIES)
    marks = materialize(entries.groupBy("bucket").applyInArrow(tidy(_dictionary), MARKS), "marks")
    asked = marks.where("ask").groupBy("doc").agg(F.collect_list(F.struct("start", "stop", "offset")).alias("spans"))
    # Joined by shuffle at every size, so that the plan does not change as the corpus grows.
    texts = docs.join(asked, "doc").select("doc", "text", "spans")
    suffixes = texts.mapInArrow(_suffixes(n_buckets), SUFFIXES)
    sorted_out = suffixes.groupBy("bucket").applyInArrow(tidy(_sort_suffixes), SPANS)
    return marks.where("NOT ask").select("doc", "start", "stop").union(sorted_out)


def merge_spans(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted((s["start"], s["stop"]) for s in spans or ()):
        if out and start <= out[-1][1]:
            if stop > out[-1][1]:
                out[-1] = (out[-1][0], stop)
        else:
            out.append((start, stop))
    return out


def whole_letters(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans made smaller where they would cut a UTF-8 character in two."""
    out = []
    for start, stop in spans:
        while start < stop and raw[start] & 0xC0 == 0x80:
            start += 1
        while stop > start and stop < len(raw) and raw[stop] & 0xC0 == 0x80:
            stop -= 1
        out.append((start, stop))
    return out


def _ranked(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``df`` with ``__doc``, unique for each id and text and in the order of ids, and ``__text`` without nulls."""
    base = df.withColumn("__id", F.col(f"`{doc_id}`").cast("long")).withColumn("__text", F.coalesce(F.col(f"`{text}`"), F.lit("")))
    base = base.withColumn("__hash", F.xxhash64("__text"))
    kinds = base.groupBy("__id").agg(F.min("__hash").alias("low"), F.max("__hash").alias("high"))
    if kinds.where("low <> high OR __id IS NULL").limit(1).count() == 0:
        return base.withColumn("__doc", F.col("__id")).drop("__id", "__hash")
    keys = base.select("__id", "__hash").distinct().withColumn("__known", F.col("__id").isNotNull())
    ranks = materialize(position_in_order(keys, ["__known", "__id", "__hash"], "__doc"), "ranks")
    joined = base.join(ranks.drop("__known"), base["__id"].eqNullSafe(ranks["__id"]) & (base["__hash"] == ranks["__hash"]))
    return joined.select(*[base[c] for c in base.columns if c not in ("__id", "__hash")], ranks["__doc"])


CUT = [
    T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
    T.StructField("kept_sha256", T.StringType()), T.StructField("kept_text", T.StringType()),
]


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", kept: bool = True, keep: list[str] | None = None) -> DataFrame:
    """``df`` with ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` of the remaining bytes and, with ``kept``,
    ``kept_text``: the remaining text, where characters that a cut would split stay whole."""
    bounded_batches(df.sparkSession)
    fields = CUT if kept else CUT[:-1]
    ranked = _ranked(df, doc_id, text)
    docs = ranked.select(F.col("__doc").alias("doc"), F.col("__text").alias("text"))
    spans = repeated_spans(docs).groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("__spans"))
    joined = ranked.join(spans.withColumnRenamed("doc", "__doc"), "__doc", "left")
    names = {f.name for f in fields}
    columns = [f for f in df.schema.fields if f.name not in names and (keep is None or f.name in keep)]
    source = joined.select(*[f"`{f.name}`" for f in columns], "__text", "__spans")
    schema, n = T.StructType([*columns, *fields]), len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in cut(batch, n, PARSE_BYTES):
                rows = []
                for value, spans in zip(piece.column(n).to_pylist(), piece.column(n + 1).to_pylist()):
                    raw = value.encode()
                    where = merge_spans(spans)
                    edges = [0, *[x for span in where for x in span], len(raw)]
                    rest = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                    row = [len(raw), len(raw) - len(rest), len(where), hashlib.sha256(rest).hexdigest()]
                    if kept:
                        edges = [0, *[x for span in whole_letters(raw, where) for x in span], len(raw)]
                        row.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])).decode())
                    rows.append(row)
                kinds = [pa.int64()] * 3 + [pa.string()] * (len(fields) - 3)
                arrays = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([*piece.columns[:n], *arrays], names=schema.names)
                release()

    return source.mapInArrow(run, schema)
