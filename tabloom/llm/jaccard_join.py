"""Exact Jaccard join of word-shingle sets by T-occurrence search, and the groups that its links form.

1. Every text becomes the set of its distinct shingles, as 64-bit hashes.
   Texts with equal sets are one set with a number of copies.
2. Shingles are counted over the corpus, dealt by hash into buckets of bounded
   size. A set in a link shares at least ``percent`` of its shingles, so a set
   with more shingles of its own than that is done. Counting on 32 bits within
   a bucket can only overstate how common a shingle is: no set is lost by it.
3. Of the sets left, the rarest shingles that a link must touch (the prefix)
   tie sets into groups; only sets of one group can be linked.
4. Within a group, T-occurrence search (DivideSkip): for a query set, the lists
   of its shingles are split by length; the short ones are merged, counting how
   often each set occurs; sets that can still reach the overlap are looked up
   in the long lists by binary search. Every set of a group is a query against
   all others. Large groups are cut into blocks, and each pair of blocks is a
   task of its own, so no task holds a group.

Only spanning links leave a task, besides each set's number of links: there are
never more of them than sets. The work within one group of near copies grows
with the square of its distinct sets, as its links do.

Null and empty texts have empty sets, link with nothing and are their own
component. Rows that repeat a document id count as one member each in
``n_links``; component ids are the smallest document id. Null ids are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.base import bounded_batches, bucketed, coded, cut, mixed, per_row, planes, release, split_words, tidy, unplaned
from tabloom.llm.components import components
from tabloom.runtime import fits_broadcast, materialize

WORDS = 4
PERCENT = 85
# Bytes of text whose shingles one bucket counts, and distinct sets in a block.
BUCKET_BYTES = 12 << 20
BLOCK_SETS = 1_000
# Bytes of text hashed at once.
CUT = 2 << 20
FACTORS = mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text. A text with fewer words is one shingle, one without has none."""
    found, rows = split_words(texts, lower=True)
    codes, names = coded(found)
    hashes = np.array([xxhash.xxh3_64_intdigest(w.encode()) for w in names.to_pylist()], np.uint64)[codes]
    ends = np.concatenate([[0], np.cumsum(per_row(rows, len(texts)))])
    grams = np.zeros(max(len(hashes) - words + 1, 0), np.uint64)
    for i in range(words):
        grams += hashes[i : i + len(grams)] * FACTORS[i]
    grams = mixed(grams)
    out = []
    for start, end in zip(ends[:-1].tolist(), ends[1:].tolist()):
        if end - start >= words:
            out.append(np.unique(grams[start : end - words + 1]))
        else:
            # Its length is part of the hash, so it equals no shingle of full length.
            few = (hashes[start:end] * FACTORS[: end - start]).sum(dtype=np.uint64) + np.uint64(end - start)
            out.append(mixed(np.array([few] if end > start else [], np.uint64)))
    return out


def set_hashes(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set: sums of its mixed members."""
    ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    out = []
    for salt in (1, 2):
        sums = np.zeros(len(every) + 1, np.uint64)
        np.cumsum(mixed(every ^ np.uint64(salt)), dtype=np.uint64, out=sums[1:])
        out.append((sums[ends[1:]] - sums[ends[:-1]]).view(np.int64))
    return out[0], out[1]


POSTINGS = T.StructType(
    [T.StructField("bucket", T.IntegerType()), T.StructField("chunk", T.StringType()), T.StructField("size", T.IntegerType())]
    + [T.StructField(n, T.BinaryType()) for n in ("hashes", "docs", "head")]
)


def _postings(n_buckets: int, words: int):
    """Per batch and bucket: the sorted 32-bit rests of its shingles with the text of each; bucket 0 also has the
    texts' ids, set sizes and set hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in cut(batch, 1, CUT):
                sets = shingle_sets(piece.column(1), words)
                chunk, number = f"{part}:{number}", number + 1
                sizes = np.array([len(s) for s in sets], np.int64)
                every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                owner = np.repeat(np.arange(len(sets), dtype=np.uint32), sizes)
                ids = piece.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                head = np.stack([ids, sizes, *set_hashes(sets)]).tobytes()
                order = np.argsort(every)
                every, owner = every[order], owner[order]
                bucket, rest = bucketed(every, n_buckets)
                edges = np.searchsorted(bucket, np.arange(n_buckets + 1))
                rows = [
                    (b, chunk, len(sets), planes(np.diff(rest[a:z], prepend=np.uint32(0))), planes(owner[a:z]), head if not b else None)
                    for b, (a, z) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist()))
                    if z > a or not b
                ]
                kinds = [pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=POSTINGS.names)
                release()

    return run


OWN = T.StructType([T.StructField("chunk", T.StringType()), T.StructField("own", T.BinaryType()), T.StructField("head", T.BinaryType())])


def _own_in_bucket(group: pa.Table) -> pa.Table:
    """Per batch: how many shingles of each text occur in no other text, as far as this bucket goes."""
    rests = [np.cumsum(unplaned(x, np.uint32), dtype=np.uint32) for x in group["hashes"].to_pylist()]
    every = np.concatenate(rests)
    order = np.argsort(every, kind="stable")
    same = every[order][1:] == every[order][:-1]
    single = np.ones(len(every), bool)
    single[order[1:][same]] = False
    single[order[:-1][same]] = False
    own, at = [], 0
    for rest, docs, size in zip(rests, group["docs"].to_pylist(), group["size"].to_pylist()):
        mine = unplaned(docs, np.uint32)[single[at : at + len(rest)]]
        own.append(np.bincount(mine, minlength=size).astype(np.uint32).tobytes())
        at += len(rest)
    return pa.table({"chunk": group["chunk"], "own": pa.array(own, pa.binary()), "head": group["head"]})


DOCS = T.StructType([T.StructField(n, T.LongType()) for n in ("doc", "n", "s1", "s2", "own")])


def _own_of_docs(group: pa.Table) -> pa.Table:
    own = sum(np.frombuffer(x, np.uint32).astype(np.int64) for x in group["own"].to_pylist())
    head = np.frombuffer(next(h for h in group["head"].to_pylist() if h is not None), np.int64).reshape(4, -1)
    return pa.table({n: pa.array(x) for n, x in zip(DOCS.names, [*head, own])})


def document_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Per row of ``docs`` (columns doc, text): set size ``n``, a 128-bit hash of the set, and the number ``own`` of
    shingles that no other row has. Written to the shared folder."""
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n_buckets = max(24, -(-total // BUCKET_BYTES))
    postings = docs.mapInArrow(_postings(n_buckets, words), POSTINGS)
    owned = postings.groupBy("bucket").applyInArrow(tidy(_own_in_bucket), OWN)
    return materialize(owned.groupBy("chunk").applyInArrow(_own_of_docs, DOCS), "sets")


FULL = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("doc", "n", "s1", "s2")] + [T.StructField("hashes", T.ArrayType(T.LongType()))]
)


def _full_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in cut(batch, 1, CUT):
                sets = shingle_sets(piece.column(1), words)
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                columns = [piece.column(0), *[pa.array(x, pa.int64()) for x in (np.diff(ends), *set_hashes(sets))], lists]
                yield pa.RecordBatch.from_arrays(columns, names=FULL.names)

    return run


def prefix_keys(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(key, doc) for the shingles of each set's prefix that other sets share, rarest first.

    A link of a set of n needs ceil(percent n / 100) common shingles, so it
    touches the n - that + 1 rarest ones. Shingles of one set only come first in
    that order and tie nothing. Sets that share too few shingles drop out.
    """
    postings = sets.select("doc", "n", F.explode("hashes").alias("key"))
    counts = postings.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = postings.join(counts, "key").groupBy("doc", "n").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("k"))
    need = F.ceil(F.col("n") * percent / 100)
    reach = F.col("n") - need + 1 - (F.col("n") - F.size("k"))
    return shared.where((F.size("k") >= need) & (reach > 0)).select(
        "doc", F.explode(F.slice("k", F.lit(1), reach.cast("int"))).alias("x")
    ).select(F.col("x.key").alias("key"), "doc")


def candidate_groups(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc`` and ``group``: sets that prefix keys tie together, each key as a star around its smallest set."""
    keys = materialize(prefix_keys(sets, percent), "keys")
    pivots = keys.groupBy("key").agg(F.min("doc").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    edges = keys.join(pivots, "key").where("doc <> pivot").select("doc", "pivot").distinct()
    return components(edges, "doc", "pivot").select(F.col("node").alias("doc"), F.col("component").alias("group"))


class Index:
    """Inverted lists of sets: per distinct shingle the sets that hold it, in order."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(s) for s in sets], np.int64)
        every = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.lexsort((owner, every))
        self.keys, self.starts = np.unique(every[order], return_index=True)
        self.lists = owner[order]
        self.starts = np.append(self.starts, len(every))
        # Place of (list, set) in one sorted array, for binary probes.
        self.places = np.repeat(np.arange(len(self.keys)), np.diff(self.starts)) * len(sets) + self.lists

    def search(self, query: np.ndarray, percent: int) -> np.ndarray:
        """The sets with 100 * intersection >= percent * union."""
        n, count = len(query), len(self.sizes)
        at = np.searchsorted(self.keys, query)
        at = at[(at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == query)]
        need = -(-percent * n // 100)
        if len(at) < need:
            return np.zeros(0, np.int64)
        lengths = self.starts[at + 1] - self.starts[at]
        order = np.argsort(lengths, kind="stable")
        at, lengths = at[order], lengths[order]
        # The number of long lists that costs least: postings merged, against probes of at most
        # merged / (need - long) sets in each long list, at 40 times the cost of a posting.
        merged = np.concatenate([[0], np.cumsum(lengths)])
        long = np.arange(0, need)
        cost = merged[len(at) - long] + np.minimum(merged[len(at) - long] // (need - long), count) * long * 40
        long = int(long[np.argmin(cost)])
        short, probe = at[: len(at) - long], at[len(at) - long :]
        spans = lengths[: len(short)]
        take = np.repeat(self.starts[short] - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + np.arange(spans.sum())
        counts = np.bincount(self.lists[take], minlength=count)
        sizes = self.sizes
        found = np.flatnonzero((counts >= need - long) & (100 * sizes >= percent * n) & (100 * n >= percent * sizes))
        hits = counts[found]
        if long and len(found):
            wanted = (probe[:, None] * count + found[None, :]).ravel()
            where = np.minimum(np.searchsorted(self.places, wanted), len(self.places) - 1)
            hits = hits + (self.places[where] == wanted).reshape(long, -1).sum(0)
        return found[100 * hits >= percent * (n + sizes[found] - hits)]


LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("links", T.LongType())])


def _linked(percent: int):
    """Links among the sets of a pair of blocks: spanning pairs (a, b), and per set its number of linked documents."""

    def run(group: pa.Table) -> pa.Table:
        docs = group["doc"].to_numpy()
        side, copies = group["side"].to_numpy(), group["copies"].to_numpy()
        sets = [np.asarray(x.values, np.int64) for x in group["hashes"]]
        first = np.flatnonzero(side == side.min())
        alone = side.min() == side.max()
        second = first if alone else np.flatnonzero(side != side.min())
        if alone and group["i"][0].as_py() != group["j"][0].as_py():
            return pa.table({n: pa.array([], pa.int64()) for n in LINKS.names})
        index = Index([sets[i] for i in first])
        root = list(range(len(docs)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        degree, spanning = np.zeros(len(docs), np.int64), []
        for q in second.tolist():
            hits = first[index.search(sets[q], percent)]
            if alone:
                hits = hits[hits < q]
            degree[q] += copies[hits].sum()
            degree[hits] += copies[q]
            for h in hits.tolist():
                x, y = find(q), find(h)
                if x != y:
                    root[x] = y
                    spanning.append((docs[q], docs[h]))
        linked = np.flatnonzero(degree)
        a = [*[x for x, _ in spanning], *docs[linked].tolist()]
        b = [*[y for _, y in spanning], *[None] * len(linked)]
        n = [*[0] * len(spanning), *degree[linked].tolist()]
        return pa.table({k: pa.array(v, pa.int64()) for k, v in zip(LINKS.names, (a, b, n))})

    return run


def links(sets: DataFrame, groups: DataFrame, percent: int = PERCENT, block: int = BLOCK_SETS) -> DataFrame:
    """Spanning links (a, b) and, with null b, numbers of links; ``sets`` has doc, copies and hashes."""
    sizes = groups.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    placed = groups.join(sizes, "group").withColumn("side", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "doc", "group", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j")
    )
    rows = sets.select("doc", "copies", "hashes").join(pairs, "doc")
    return rows.groupBy("group", "i", "j").applyInArrow(_linked(percent), LINKS)


def jaccard_groups(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT,
    block: int = BLOCK_SETS,
) -> DataFrame:
    """Per document: ``doc_id``, ``n_shingles``, ``component_id`` and ``n_links``, the documents it is linked with."""
    bounded_batches(df.sparkSession)
    docs = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text")).where("doc IS NOT NULL")
    table = document_sets(docs, words)
    kinds = table.where("n > 0").groupBy("n", "s1", "s2").agg(
        F.min("doc").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min("own").alias("own")
    )
    kinds = materialize(kinds, "kinds")
    near = kinds.where(f"100 * (n - own) >= {percent} * n").select(F.col("rep").alias("doc"), "n", "s1", "s2", "copies")
    ids, small = near.select("doc").distinct(), fits_broadcast(near)
    texts = docs.join(F.broadcast(ids) if small else ids, "doc", "left_semi")
    # A repeated id may have several texts; the one meant has the set's size and hashes.
    sets = texts.mapInArrow(_full_sets(words), FULL).join(F.broadcast(near) if small else near, ["doc", "n", "s1", "s2"])
    sets = materialize(sets.dropDuplicates(["doc", "n", "s1", "s2"]).select("doc", "n", "copies", "hashes"), "near-sets")
    found = materialize(links(sets, candidate_groups(sets, percent), percent, block), "links")
    joined = components(found.where("b IS NOT NULL"), "a", "b")
    degree = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("others"))
    labels = kinds.select("n", "s1", "s2", "rep", "copies").join(joined, F.col("rep") == F.col("node"), "left").drop("node")
    labels = labels.join(degree, F.col("rep") == F.col("node"), "left").select(
        "n", "s1", "s2", F.coalesce("component", "rep").alias("component_id"),
        (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    out = table.join(labels, ["n", "s1", "s2"], "left")
    return out.select(
        F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )
