"""Growing many tree models at once: one exchange of sums per tree level, for all models that have that level.

The rows stand in blocks of bin numbers, dealt over partitions by their number,
and stay cached. A level's job sends the trees grown so far to the blocks, sums
gradients per (model, node, feature, bin) in each partition, adds them up per
node and some features in a shuffle, and returns the best split of each. Sums of
at most ``DIRECT_BYTES`` in all partitions together, as of the upper levels, are
added up by the driver instead, which spares the shuffle. So what the driver
receives at once is bounded, whatever the data. Rows whose bins have room in a
task (``WHOLE_BYTES``, ``CHAIN_BYTES``) need no exchange: each task has all rows
and grows some trees of a forest, or a whole chain. Both ways give the same trees.

A ``view`` is a choice of training rows with encoders fitted on them, as of a
fold or a holdout seed: each row has its bins in every view and a mark whether
it trains there. So folds and seeds are models of the same jobs.

Gradients are multiples of a power of two, so sums are exact and do not depend
on the order or number of partitions. Cached blocks are rebuilt from their
lineage if an executor is lost; the lineage is cut by checkpoints.
"""

from __future__ import annotations

import pickle
import random
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, replace
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.serializers import BatchedSerializer, CPickleSerializer
from pyspark.sql import DataFrame, SparkSession

from tabloom.plans.sorted_rows import Columns, Round, at_root, in_one, sorted_sums
from tabloom.plans.trees import Trees, bins_of, joined
from tabloom.runtime import drop_path, materialize, scratch_root, together

# Rows in one block, and in one partition at least.
BLOCK_ROWS = 1 << 16
PARTITION_ROWS = 1 << 18
# Bytes of partial sums of all partitions that the driver adds up itself, and histogram cells that travel together.
DIRECT_BYTES = 32 << 20
CELLS_TOGETHER = 1 << 16
# Bits of a number of rows beside a sum of gradients in one float, which holds 53.
ROW_BITS, FLOAT_BITS = 18, 52
# Partitions for each core of the largest tables: each sends its own sums, so more of them would be more to exchange.
PARTS_PER_CORE = 3
# Rounds between written margins.
WRITE_EVERY = 40
# Histogram cells of a step of a forest, trees that grow in one step, and nodes that travel together.
FOREST_CELLS = 1 << 22
TREES_TOGETHER = 75
NODES_TOGETHER = 64
# Bytes of the bins of a task that has all rows, and of where the rows of its trees stand.
WHOLE_BYTES = 256 << 20
SORTED_BYTES = 64 << 20
# The same for a chain, which is one task's work then, and the number of level jobs in a row beyond which that is less work.
CHAIN_BYTES, FEW_JOBS = 64 << 20, 64


def bins_bytes(rows: int, cuts: list[np.ndarray]) -> int:
    return rows * len(cuts) * (1 if max(map(len, cuts), default=0) + 2 <= 256 else 2)


def hashed(keys: np.ndarray, *numbers: int) -> np.ndarray:
    """64-bit hashes of row keys together with numbers."""
    x = keys.astype(np.uint64)
    for n in numbers:
        x = x ^ np.uint64((n * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(31))
    return x


def share_of(keys: np.ndarray, *numbers: int) -> np.ndarray:
    """Even numbers in [0, 1) from row keys."""
    return (hashed(keys, *numbers) >> np.uint64(11)).astype(np.float64) / (1 << 53)


# A block of rows: id, y, key and trains (row x view) in one column, the bins of each view (row x feature) in one more each.
# What a model grows from has one view's training rows only: view, y, key, bins, and margins by model. Both are dicts of
# arrays, so they can be read wherever the library is not installed.
Block = dict


def block_schema(views: int) -> str:
    return ", ".join(["block binary", *[f"bins{v} binary" for v in range(views)]])


def packed_blocks(batches: Iterator[pa.RecordBatch], cuts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """(id, y, key, trains, x of each view) rows as pickled blocks and their bins."""
    held: list[pa.RecordBatch] = []

    def block() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        flat = lambda name: rows[name].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
        y = rows["y"].to_numpy().astype(np.float64)
        made = Block(id=rows["id"].combine_chunks(), y=y, key=rows["key"].to_numpy().view(np.uint64), trains=flat("trains").astype(bool))
        # Feature by feature, as they are counted.
        bins = [np.asfortranarray(bins_of(flat(f"x{v}"), own)) for v, own in enumerate(cuts)]
        columns = [pa.array([pickle.dumps(x, protocol=5)], pa.binary()) for x in (made, *bins)]
        return pa.RecordBatch.from_arrays(columns, names=["block", *[f"bins{v}" for v in range(len(bins))]])

    count = 0
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK_ROWS):
            held.append(batch.slice(start, BLOCK_ROWS))
            count += held[-1].num_rows
            if count >= BLOCK_ROWS:
                yield block()
                count = 0
    if held:
        yield block()


def partitions_for(rows: int, cores: int) -> int:
    """One partition for a small table; a larger one has work for all cores, as far as there are blocks for them."""
    parts = max(1, -(-rows // PARTITION_ROWS))
    if parts == 1:
        return 1
    # A task reads a block at a time, so its memory does not grow with its rows.
    return max(min(parts, max(2, PARTS_PER_CORE * cores)), min(cores, -(-rows // BLOCK_ROWS)))


def block_rows(table: DataFrame, cuts: list[list[np.ndarray]], rows: int) -> tuple[DataFrame, int]:
    """The blocks of a written table, as a table in the shared folder, and the number of partitions to grow from."""
    parts = partitions_for(rows, table.sparkSession.sparkContext.defaultParallelism)
    if parts > table.rdd.getNumPartitions():
        table = table.repartition(parts)
    few = table.coalesce(parts) if parts < table.rdd.getNumPartitions() else table
    return materialize(few.mapInArrow(partial(packed_blocks, cuts=cuts), block_schema(len(cuts))), "blocks"), parts


def training_rows(packed: DataFrame, views: Sequence[int], parts: int) -> RDD:
    """The training rows of some views, a block for each view: no model reads the bins or rows of a view that is not its own."""
    own = packed.select("block", *[f"bins{v}" for v in views])
    spread = own.coalesce(parts) if parts < own.rdd.getNumPartitions() else own

    def blocks(rows: Iterator) -> Iterator[Block]:
        for row in rows:
            common = pickle.loads(row["block"])
            for v in views:
                bins, at = pickle.loads(row[f"bins{v}"]), np.flatnonzero(common["trains"][:, v])
                if 0 < len(at) < len(bins):
                    bins = np.take(bins.T, at, axis=1).T
                if len(at):
                    yield Block(view=v, y=common["y"][at], key=common["key"][at], bins=bins)

    return spread.rdd.mapPartitions(blocks)


# Best splits from histograms


def best_splits(sums: np.ndarray, reg: float, least: float) -> dict[str, np.ndarray]:
    """The split of highest gain of each node, from sums ([g, h], node, feature, bin); bin 0 holds missing values.

    A tie goes to the lower feature, then the lower bin, then to missing values on the right. ``gain`` is 0 where
    nothing is gained.
    """
    lost_g, lost_h = sums[0, :, :, 0], sums[1, :, :, 0]
    known_g, known_h = np.cumsum(sums[0, :, :, 1:], axis=2), np.cumsum(sums[1, :, :, 1:], axis=2)
    all_g, all_h = known_g[:, :, -1] + lost_g, known_h[:, :, -1] + lost_h
    smallest = max(least, 1e-300)

    def gains(g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Gains of all bins if rows of sums ``g`` and ``h`` go left; 0 where a side is too small."""
        other_g, other_h = all_g[:, :, None] - g, all_h[:, :, None] - h
        few = np.minimum(h, other_h) < smallest
        sides = g * g / (h + reg + few) + other_g * other_g / (other_h + reg + few)
        gain = sides - (all_g * all_g / np.maximum(all_h + reg, smallest))[:, :, None]
        # What rounding leaves of equal scores is no gain.
        gain[few | (gain <= 1e-10 * sides)] = 0.0
        return 0.5 * gain

    right = gains(known_g, known_h)
    left = gains(known_g + lost_g[:, :, None], known_h + lost_h[:, :, None]) if lost_h.any() else None
    best = right if left is None else np.maximum(right, left)
    node, count = np.arange(best.shape[0]), best.shape[2]
    flat = best.reshape(len(node), -1)
    at = flat.argmax(axis=1)
    feature, bin_ = np.divmod(at, count)
    place = node, feature, bin_
    missing_left = np.zeros(len(node), bool) if left is None else left[place] > right[place]
    chosen = np.stack([k[place] + missing_left * lost[node, feature] for k, lost in ((known_g, lost_g), (known_h, lost_h))], axis=1)
    whole = np.stack([all_g[node, feature], all_h[node, feature]], axis=1)
    return {
        "gain": flat[node, at], "feature": feature, "bin": bin_ + 1, "missing_left": missing_left,
        "left": chosen, "right": whole - chosen, "whole": whole,
    }


# Boosting

SQUARED, LOGISTIC, RESIDUAL, LOG_RESIDUAL = "squared", "logistic", "residual", "log_residual"


@dataclass(frozen=True)
class Chain:
    """A sequence of trees, each fitted to what those before it leave.

    ``squared`` and ``logistic`` are second-order losses from a start; ``residual`` and ``log_residual`` fit plain means
    of first-order residuals (the first tree those of the label itself, with weight 1), as gradient boosting machines do.
    """

    objective: str
    view: int = 0
    rounds: int = 100
    depth: int = 6
    eta: float = 0.3
    reg: float = 1.0
    least: float = 1.0
    row_sample: float = 1.0
    column_sample: float = 1.0
    seed: int = 42

    def features(self, number: int, width: int) -> np.ndarray:
        if self.column_sample >= 1.0:
            return np.arange(width)
        count = max(1, round(self.column_sample * width))
        return np.array(sorted(random.Random(self.seed * 1_000_003 + number).sample(range(width), count)))

    def gradients(self, y: np.ndarray, margin: np.ndarray, number: int, scale: float) -> tuple[np.ndarray, np.ndarray | None]:
        """First and second derivatives as multiples of a power of two; the second is None where it is 1."""
        h = None
        if self.objective == SQUARED:
            g = margin - y
        elif self.objective == RESIDUAL:
            g = margin - y if number == 0 else 2.0 * (margin - y)
        elif self.objective == LOGISTIC:
            p = 1.0 / (1.0 + np.exp(-margin))
            g, h = p - y, np.rint(p * (1.0 - p) * scale) / scale
        else:
            sign = 2.0 * y - 1.0
            g = margin - sign if number == 0 else -4.0 * sign / (1.0 + np.exp(2.0 * sign * margin))
        return np.rint(g * scale) / scale, h

    def weight(self, number: int) -> float:
        return 1.0 if number == 0 and self.objective in (RESIDUAL, LOG_RESIDUAL) else self.eta


@dataclass
class Growing:
    """A chain's tree of this round: the nodes of the level that may split, and their places in the histogram."""

    chain: Chain
    column: int
    number: int
    scale: float
    features: np.ndarray
    tree: Trees
    open: np.ndarray
    level: int = 0
    # Weights of nodes; sums of the level above, if the driver has them, and their nodes.
    weight: np.ndarray | None = None
    above: np.ndarray | None = None
    nodes_above: np.ndarray | None = None

    def counted(self) -> np.ndarray:
        """The nodes to sum up for this level: where sums of the level above are known, only the lighter side of each node."""
        if self.above is None:
            return self.open
        left = 2 * np.unique((self.open - 1) // 2) + 1
        return left + (self.weight[left + 1] < self.weight[left])

    def whole(self, sums: np.ndarray, counted: np.ndarray) -> np.ndarray:
        """Sums of all nodes of the level from those that were counted; the heavier side is what is left of its node."""
        if self.above is None:
            return sums
        parents = (counted - 1) // 2
        rest = self.above[:, np.searchsorted(self.nodes_above, parents)] - sums
        place = np.searchsorted(parents, (self.open - 1) // 2)
        return np.where((counted[place] == self.open)[None, :, None, None], sums[:, place], rest[:, place])

    def slots(self) -> np.ndarray:
        out = np.full(2**self.level, -1)
        out[self.open - (2**self.level - 1)] = np.arange(len(self.open))
        return out


@dataclass
class Standing:
    """The rows of a block that a level counts: bins of the tree's features by column, gradients, and places of their nodes."""

    columns: list[np.ndarray]
    g: np.ndarray
    h: np.ndarray | None
    slot: np.ndarray


def standing(block: Block, w: Growing) -> Standing:
    chain, bins = w.chain, block["bins"]
    y, margin, columns = block["y"], block["margins"][w.column], [bins[:, f] for f in w.features]
    rows = np.arange(len(y))
    if chain.row_sample < 1.0:
        rows = np.flatnonzero(share_of(block["key"], chain.seed, w.number) < chain.row_sample)
    node, way = np.zeros(len(rows), np.int64), w.tree.way(0, bins)
    for _ in range(w.level):
        node = w.tree.step(bins, rows, node, way)
    node -= 2**w.level - 1
    slot = w.slots().take(node, mode="clip")
    # Rows at a leaf are done, and those of a side that is not counted are not looked at.
    kept = np.flatnonzero((slot >= 0) & (node >= 0))
    if len(kept) < len(y):
        rows, slot = rows.take(kept), slot.take(kept)
        y, margin, columns = y.take(rows), margin.take(rows), [c.take(rows, mode="clip") for c in columns]
    return Standing(columns, *chain.gradients(y, margin, w.number, w.scale), slot)


def in_one_task(chain: Chain, rows: int, cuts: list[np.ndarray]) -> bool:
    """Whether a chain on so many rows grows in a task of its own, rather than by jobs over all partitions."""
    return chain.rounds * chain.depth > FEW_JOBS and bins_bytes(rows, cuts) <= CHAIN_BYTES


def sums_bytes(chain: Chain, cuts: list[np.ndarray]) -> int:
    """Bytes of the sums of a chain's lowest level."""
    return 16 * 2 ** max(chain.depth - 1, 0) * len(cuts) * (max(map(len, cuts), default=0) + 2)


def features_together(nodes: int, width: int) -> int:
    """How many features of some nodes travel in one part of the sums."""
    return max(1, CELLS_TOGETHER // max(min(nodes, NODES_TOGETHER) * width, 1))


class Sums:
    """Sums [g, h] per (node, feature, bin) of a task's blocks.

    Where h is 1 for each row, g and the number of rows are one number as long as they have room in it, which is half to
    count and half to send.
    """

    def __init__(self, nodes: int, features: int, bins: int, scale: float):
        self.shape, self.scale = (nodes, features, bins), scale
        self.rows, self.largest = 0, 0.0
        self.both: np.ndarray | None = np.zeros(self.shape)
        self.pair: np.ndarray | None = None

    def add(self, first: np.ndarray, held: Standing) -> None:
        """Count rows whose cells of bin 0 are ``first``."""
        nodes, _, bins = self.shape
        size, shape = nodes * bins, (nodes, bins)
        if self.both is not None:
            self.rows += len(held.g)
            self.largest = max(self.largest, float(np.abs(held.g).max(initial=0.0)) * self.scale)
            if held.h is not None or self.rows >= 1 << ROW_BITS or self.rows * self.largest >= 1 << (FLOAT_BITS - ROW_BITS):
                self.pair, self.both = apart(self.scale, self.both), None
        together_ = None if self.both is None else held.g * (self.scale * (1 << ROW_BITS)) + 1.0
        # A feature at a time, so that what is being counted stays in the processor's cache.
        for f, column in enumerate(held.columns):
            cell = first + column
            if together_ is not None:
                self.both[:, f] += np.bincount(cell, together_, size).reshape(shape)
            else:
                self.pair[0, :, f] += np.bincount(cell, held.g, size).reshape(shape)
                self.pair[1, :, f] += np.bincount(cell, held.h, size).reshape(shape)

    def part(self, nodes: slice, features: slice) -> np.ndarray | tuple[float, np.ndarray]:
        return self.pair[:, nodes, features] if self.both is None else (self.scale, self.both[nodes, features])


def apart(scale: float, both: np.ndarray) -> np.ndarray:
    """[g, h] of sums in one number."""
    whole = both.astype(np.int64)
    return np.stack([(whole >> ROW_BITS) / scale, (whole & ((1 << ROW_BITS) - 1)).astype(np.float64)])


def pair_of(sums: np.ndarray | tuple[float, np.ndarray]) -> np.ndarray:
    return apart(*sums) if isinstance(sums, tuple) else sums


def level_sums(blocks: Iterator[Block], work: list[Growing], width: list[int]) -> Iterator[tuple]:
    """Sums of gradients per node of every growing tree: ((column, first node, first feature, number), sums of some nodes and features)."""
    sums = {w.column: Sums(len(w.open), len(w.features), width[w.chain.view], w.scale) for w in work}
    for block in blocks:
        for w in work:
            if w.chain.view != block["view"]:
                continue
            held = standing(block, w)
            sums[w.column].add(held.slot * width[w.chain.view], held)
    number = 0
    for column, whole in sums.items():
        nodes, features, bins = whole.shape
        step = features_together(nodes, bins)
        for first in range(0, nodes, NODES_TOGETHER):
            for feature in range(0, max(features, 1), step):
                yield (column, first, feature, number), whole.part(slice(first, first + NODES_TOGETHER), slice(feature, feature + step))
                number += 1


def level_splits(sums: Iterator[tuple], limits: dict[int, tuple[float, float]]) -> Iterator[tuple]:
    for (column, first, feature, _), own in sums:
        split = best_splits(pair_of(own), *limits[column])
        split["feature"] += feature
        yield (column, first, feature), split


def over_features(found: list[tuple]) -> list[tuple]:
    """The best splits of nodes over the parts of their features; a tie goes to the lower feature."""
    parts: dict[tuple, list[tuple]] = {}
    for (column, first, feature), split in found:
        parts.setdefault((column, first), []).append((feature, split))
    out = []
    for key, own in sorted(parts.items()):
        splits = [split for _, split in sorted(own, key=lambda x: x[0])]
        best = np.argmax([s["gain"] for s in splits], axis=0)
        rows = np.arange(len(best))
        out.append((key, {name: np.stack([s[name] for s in splits])[best, rows] for name in splits[0]}))
    return out


def added(parts: Iterable[tuple]) -> Iterator[tuple]:
    """Partial sums of several partitions added up."""
    whole: dict[tuple, np.ndarray] = {}
    for key, sums in parts:
        if key in whole:
            whole[key] += pair_of(sums)
        else:
            whole[key] = np.array(pair_of(sums))
    return iter(whole.items())


def number_of(key: tuple | int) -> int:
    """The place of a key among those of its level, by which it is dealt: one by one, so that no task gets most of them."""
    return key[-1] if isinstance(key, tuple) else key // NODES_TOGETHER


def reduced(sums: RDD, keys: int | None = None) -> RDD:
    """Partial sums added up, in no more tasks than there are ``keys``; those of one partition are whole already."""
    parts = sums.getNumPartitions()
    return sums if parts == 1 else sums.partitionBy(parts if keys is None else max(1, min(parts, keys)), number_of).mapPartitions(added)


def asked(rows: RDD, growing: list[Growing], setting: Setting) -> list[tuple]:
    """The splits of a level, from one job over all blocks. Sums that the driver adds up itself are kept for the level below."""
    cells = lambda w, count: count * len(w.features) * setting.width[w.chain.view]
    sent = [replace(w, open=w.counted(), weight=None, above=None, nodes_above=None) for w in growing]
    if 16 * sum(cells(w, len(w.open)) for w in sent) * rows.getNumPartitions() <= DIRECT_BYTES:
        found = added(rows.mapPartitions(partial(level_sums, work=sent, width=setting.width)).collect())
        return splits_of(growing, {w.column: w.open for w in sent}, found, setting)
    for w in growing:
        w.above = None
    sent = [replace(w, weight=None, nodes_above=None) for w in growing]
    sums = rows.mapPartitions(partial(level_sums, work=sent, width=setting.width))
    sizes = [(len(w.open), len(w.features), setting.width[w.chain.view]) for w in growing]
    keys = sum(-(-n // NODES_TOGETHER) * -(-f // features_together(n, b)) for n, f, b in sizes)
    return reduced(sums, keys).mapPartitions(partial(level_splits, limits=setting.limits)).collect()


def splits_of(growing: list[Growing], counted: dict[int, np.ndarray], parts: Iterator[tuple], setting: Setting) -> list[tuple]:
    """Best splits of a level from sums of the counted nodes, which come in parts; the sums are kept."""
    of_chain = {w.column: np.zeros((2, len(counted[w.column]), len(w.features), setting.width[w.chain.view])) for w in growing}
    for (column, first, feature, _), own in parts:
        of_chain[column][:, first : first + own.shape[1], feature : feature + own.shape[2]] = own
    out = []
    for w in growing:
        w.above = w.whole(of_chain.pop(w.column), counted[w.column])
        w.nodes_above = w.open
        step = features_together(len(w.open), w.above.shape[3])
        for feature in range(0, max(len(w.features), 1), step):
            split = best_splits(w.above[:, :, feature : feature + step], *setting.limits[w.column])
            split["feature"] += feature
            out.append(((w.column, 0, feature), split))
    return out


def with_trees(blocks: Iterator[Block], done: list[tuple[int, int, Trees]]) -> Iterator[Block]:
    """Blocks whose margins have grown by the trees of (column, view, trees)."""
    for block in blocks:
        margins = dict(block["margins"])
        for column, view, trees in done:
            if view == block["view"]:
                margins[column] = margins[column] + trees.only(block["bins"])
        yield {**block, "margins": margins}


def absorb(growing: list[Growing], found: list[tuple]) -> list[Growing]:
    """Put the splits of a level into the trees; the trees that have a further level."""
    by_column = {w.column: w for w in growing}
    opened: dict[int, list[np.ndarray]] = {}
    for (column, begin_at), split in found:
        w = by_column[column]
        nodes = w.open[begin_at : begin_at + len(split["gain"])]
        value = lambda s: -w.chain.weight(w.number) * s[:, 0] / (s[:, 1] + w.chain.reg)
        if w.level == 0:
            w.tree.value[0, 0] = value(split["whole"])[0] if split["whole"][0, 1] > 0 else 0.0
        good = split["gain"] > 0
        nodes, split = nodes[good], {k: v[good] for k, v in split.items()}
        w.tree.feature[0, nodes] = w.features[split["feature"]]
        w.tree.bin[0, nodes], w.tree.missing_left[0, nodes] = split["bin"], split["missing_left"]
        w.tree.value[0, 2 * nodes + 1], w.tree.value[0, 2 * nodes + 2] = value(split["left"]), value(split["right"])
        if w.weight is None:
            w.weight = np.zeros(w.tree.value.shape[1])
        w.weight[2 * nodes + 1], w.weight[2 * nodes + 2] = split["left"][:, 1], split["right"][:, 1]
        opened.setdefault(column, []).extend([2 * nodes + 1, 2 * nodes + 2])
    following = []
    for w in growing:
        w.level += 1
        w.open = np.sort(np.concatenate(opened.get(w.column, [np.zeros(0, np.int64)])))
        if len(w.open) and w.level < w.chain.depth:
            following.append(w)
    return following


@dataclass
class Setting:
    """The chains that grow together, and what their histograms need."""

    chains: list[Chain]
    scales: list[float]
    features: list[int]
    width: list[int]

    @property
    def limits(self) -> dict[int, tuple[float, float]]:
        return {i: (c.reg, c.least) for i, c in enumerate(self.chains)}

    def round(self, number: int, ask: Callable[[list[Growing]], list[tuple]]) -> list[tuple[int, int, Trees]]:
        """The trees of a round as (column, view, tree); ``ask`` gives the splits of a level."""
        work = [
            Growing(c, i, number, self.scales[i], c.features(number, self.features[c.view]), Trees.empty(1, c.depth), np.zeros(1, np.int64))
            for i, c in enumerate(self.chains) if number < c.rounds
        ]
        growing = [w for w in work if w.chain.depth > 0]
        while growing:
            growing = absorb(growing, over_features(ask(growing)))
        return [(w.column, w.chain.view, w.tree) for w in work]


class Here:
    """Chains of one view that grow in a task which has all their rows."""

    def __init__(self, setting: Setting, rows: Columns, margins: dict[int, np.ndarray]):
        self.setting, self.rows, self.margins = setting, rows, margins
        self.rounds: dict[int, Round] = {}
        self.seeded: dict[int, np.ndarray] = {}

    def begin(self, w: Growing) -> Round:
        chain, y, margin = w.chain, self.rows.labels, self.margins[w.column]
        g, h = chain.gradients(y, margin, w.number, w.scale)
        numbers, counts, total = g * w.scale, np.ones(len(y)) if h is None else h, len(y)
        if chain.row_sample < 1.0:
            if chain.seed not in self.seeded:
                self.seeded[chain.seed] = hashed(self.rows.seeded, chain.seed)
            taken = share_of(self.seeded[chain.seed], w.number) < chain.row_sample
            numbers, counts, total = numbers * taken, counts * taken, int(taken.sum())
        weights, shift = [numbers, counts], 0
        if h is None:
            weights, shift = in_one(numbers, counts, total, float(np.abs(numbers).sum()))
        return Round(at_root(np.arange(len(y)), weights, shift))

    def ask(self, growing: list[Growing]) -> list[tuple]:
        found = []
        for w in growing:
            width, chain = self.setting.width[w.chain.view], w.chain
            if w.level == 0:
                self.rounds[w.column] = self.begin(w)
            sums = self.rounds[w.column].sums(self.rows, w.tree, w.open, w.features, width, w.scale, self.margins[w.column])
            step = features_together(len(w.open), width)
            for feature in range(0, max(len(w.features), 1), step):
                split = best_splits(sums[:, :, feature : feature + step], chain.reg, chain.least)
                split["feature"] += feature
                found.append(((w.column, 0, feature), split))
        return found

    def grow(self, number: int) -> list[tuple[int, int, Trees]]:
        done = self.setting.round(number, self.ask)
        for column, _, tree in done:
            margin, grown = self.margins[column], self.rounds.pop(column, None)
            if grown is None:
                margin += tree.value[0, 0]
            else:
                grown.finish(self.rows, tree, margin)
        return done


def rounds_here(blocks: Iterator[Block], setting: Setting, counts: list[int], starts: dict[int, float]) -> Iterator[tuple]:
    """All rounds of a task that has all rows of a view: (column, arrays of the chain's trees)."""
    rows = whole_columns(blocks, counts)
    if rows is None:
        return
    rows.join()
    here = Here(setting, rows, {column: np.full(len(rows.labels), start) for column, start in starts.items()})
    trees: dict[int, list[Trees]] = {column: [] for column in starts}
    for number in range(max(c.rounds for c in setting.chains)):
        for column, _, tree in here.grow(number):
            trees[column].append(tree)
    for column, own in trees.items():
        yield column, joined(own).arrays()


def grow_chains(
    spark: SparkSession, blocks: RDD, chains: Sequence[Chain], cuts: list[list[np.ndarray]], starts: Sequence[float],
    spans: Sequence[float], write_every: int = WRITE_EVERY,
) -> list[Trees]:
    """The trees of every chain, from shared level jobs over the ``training_rows`` of their views, or from a task that has all rows
    of their view, if that is the only partition. ``spans`` bound the distance of labels from the starts."""
    bounded = [c.objective in (LOGISTIC, LOG_RESIDUAL) for c in chains]
    scales = [2.0 ** (22 if b else 20 - int(np.ceil(np.log2(max(s, 1e-12))))) for b, s in zip(bounded, spans)]
    width = [max((len(c) for c in own), default=0) + 2 for own in cuts]
    setting = Setting(list(chains), scales, [len(own) for own in cuts], width)
    first = [(i, c.view, float(s)) for i, (c, s) in enumerate(zip(chains, starts))]

    sampling = any(c.row_sample < 1.0 for c in chains)

    def begin(held: Iterator[Block]) -> Iterator[Block]:
        # Every level's job reads all of a block, so it holds no more than the chains need.
        for block in held:
            y = block["y"].astype(np.uint8) if all(bounded) else block["y"]
            yield Block(view=block["view"], y=y, bins=block["bins"], **({"key": block["key"]} if sampling else {}))

    def margins_of(held: Iterator[Block]) -> Iterator[dict[int, np.ndarray]]:
        for block in held:
            yield {i: np.full(len(block["y"]), s) for i, view, s in first if view == block["view"]}

    if blocks.getNumPartitions() == 1:
        (view,) = {c.view for c in chains}
        sent = partial(rounds_here, setting=setting, counts=[len(c) + 2 for c in cuts[view]], starts={i: s for i, _, s in first})
        found = dict(blocks.mapPartitions(sent).collect())
        return [Trees(*found[i]) for i in range(len(chains))]
    # What never changes is written once; a round's margins are a few bytes a row.
    fixed = block_by_block(blocks.mapPartitions(begin)).persist(StorageLevel.DISK_ONLY)
    margins = block_by_block(fixed.mapPartitions(margins_of)).persist(StorageLevel.MEMORY_AND_DISK)
    held: list[RDD] = [margins]
    stored = None
    trees: list[list[Trees]] = [[] for _ in chains]
    rounds = max(c.rounds for c in chains)
    for number in range(rounds):
        state = fixed.zip(margins).map(with_margins)
        done = setting.round(number, partial(asked, state, setting=setting))
        for column, _, tree in done:
            trees[column].append(tree)
        # What came before the margins just read is no longer needed.
        for old in held[:-1]:
            old.unpersist()
        held = held[-1:]
        if number + 1 < rounds:
            margins = block_by_block(state.mapPartitions(partial(margins_after, done=done))).persist(StorageLevel.MEMORY_AND_DISK)
            held.append(margins)
            if (number + 1) % write_every == 0:
                if spark.sparkContext.getCheckpointDir() is None:
                    spark.sparkContext.setCheckpointDir(scratch_root(spark))
                margins.checkpoint()
                margins.count()
                if stored:
                    drop_path(spark, stored)
                stored = margins.getCheckpointFile()
    for old in [*held, fixed]:
        old.unpersist()
    if stored:
        drop_path(spark, stored)
    return [joined(own) for own in trees]


def block_by_block(blocks: RDD) -> RDD:
    """The same elements, each serialized by itself: elements of two such tables meet one by one, without another pass."""
    return blocks._reserialize(BatchedSerializer(CPickleSerializer(), 1))


def with_margins(pair: tuple[Block, dict[int, np.ndarray]]) -> Block:
    return {**pair[0], "margins": pair[1]}


def margins_after(blocks: Iterator[Block], done: list[tuple[int, int, Trees]]) -> Iterator[dict[int, np.ndarray]]:
    for block in with_trees(blocks, done):
        yield block["margins"]


# Forests


@dataclass(frozen=True)
class Forest:
    """Trees of their own: rows are drawn with replacement by a hash of (row, tree), features by a hash of (tree, node).

    So fewer trees, or less deep ones, are the beginnings of these. ``tries`` features are looked at per node.
    """

    view: int = 0
    trees: int = 200
    depth: int = 6
    least: float = 1.0
    row_sample: float = 1.0
    tries: int | None = None
    seed: int = 42
    # Labels are 0 and 1.
    classes: bool = False


def draw_steps(rate: float) -> tuple[np.ndarray, np.ndarray]:
    """The distribution of Poisson numbers of the rate, and the number of each share by its first 16 bits, -1 where it depends
    on the others."""
    steps = np.cumsum(np.exp(-rate) * np.cumprod(np.concatenate([[1.0], rate / np.arange(1, 16)])))
    lowest = np.searchsorted(steps, np.arange(1 << 16) / (1 << 16), side="right")
    highest = np.searchsorted(steps, ((np.arange(1, (1 << 16) + 1) << 37) - 1) / (1 << 53), side="right")
    return steps, np.where(lowest == highest, lowest, -1).astype(np.int8)


def drawn(seeded: np.ndarray, tree: int, steps: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How often each row is drawn for a tree: Poisson numbers, from hashes of keys and seed."""
    x = hashed(seeded, tree)
    distribution, by_bits = steps
    times = by_bits.take((x >> np.uint64(48)).astype(np.int64))
    open_ = np.flatnonzero(times < 0)
    if len(open_):
        share = (x[open_] >> np.uint64(11)).astype(np.float64) / (1 << 53)
        times[open_] = np.searchsorted(distribution, share, side="right")
    return times


def features_of(forest: Forest, width: int, tree: np.ndarray, node: np.ndarray) -> np.ndarray:
    """The features that each (tree, node) looks at, in rising order."""
    tries = forest.tries or width
    if tries >= width:
        return np.tile(np.arange(width), (len(node), 1))
    key = (tree.astype(np.uint64) << np.uint64(32)) | node.astype(np.uint64)
    order = np.stack([hashed(key, forest.seed, f) for f in range(width)], axis=1)
    return np.sort(np.argsort(order, axis=1, kind="stable")[:, :tries], axis=1)


def forest_sums(
    blocks: Iterator[Block], forest: Forest, grown: Trees, low: int, level: int, tree: np.ndarray, node: np.ndarray, width: int,
    scale: float,
) -> Iterator[tuple]:
    """Sums of drawn labels and numbers of draws per (tree, node) of a level, sorted by tree; ``grown`` starts at ``low``."""
    looked = None
    sums = None
    steps = draw_steps(forest.row_sample)
    for block in blocks:
        # Labels as whole numbers of 1 / scale.
        bins, labels = block["bins"], np.rint(block["y"] * scale)
        largest, seeded = float(np.abs(labels).max(initial=0.0)), hashed(block["key"], forest.seed)
        count, flat = len(bins), bins.ravel(order="F")
        if sums is None:
            looked = features_of(forest, bins.shape[1], tree, node)
            sums = np.zeros((2, len(node), looked.shape[1], width))
        for t in np.unique(tree).tolist():
            first, stop = np.searchsorted(tree, [t, t + 1])
            own = grown[t - low : t - low + 1]
            times = drawn(seeded, t, steps)
            at = np.flatnonzero(times).astype(np.int32)
            times, place, way = times.take(at), np.zeros(len(at), np.int32), own.way(0, bins)
            for _ in range(level):
                place = own.step(bins, at, place, way)
            inside = place >= 2**level - 1
            if not inside.all():
                at, times, place = at[inside], times[inside], place[inside]
            slots = np.full(2**level, -1)
            slots[node[first:stop] - (2**level - 1)] = np.arange(stop - first)
            slot = slots.take(place - (2**level - 1))
            if (slot < 0).any():
                at, times, slot = at[slot >= 0], times[slot >= 0], slot[slot >= 0]
            numbers, draws = labels.take(at) * times, times.astype(np.float64)
            # Sums of labels and draws in one number, if both have room in its 53 bits.
            total = int(draws.sum())
            shift = total.bit_length()
            both = numbers * float(1 << shift) + draws if (total + 1) * (largest + 1) * (1 << shift) < 1 << 52 else None
            from_cell, shape = slot * width, (stop - first, width)
            size, into = shape[0] * width, sums[:, first:stop]
            # A feature of each node at a time, so that what is being counted stays in the processor's cache.
            for place_of, column in enumerate(looked[first:stop].T.astype(np.int64) * count):
                cell = column.take(slot)
                cell += at
                cell = flat.take(cell) + from_cell
                if both is None:
                    into[0, :, place_of] += np.bincount(cell, numbers, size).reshape(shape) / scale
                    into[1, :, place_of] += np.bincount(cell, draws, size).reshape(shape)
                else:
                    found = np.bincount(cell, both, size).astype(np.int64).reshape(shape)
                    into[0, :, place_of] += (found >> shift) / scale
                    into[1, :, place_of] += found & ((1 << shift) - 1)
    if sums is not None:
        for first in range(0, sums.shape[1], NODES_TOGETHER):
            yield first, sums[:, first : first + NODES_TOGETHER]


@dataclass
class Grove:
    """Some trees of a forest as they grow, numbered from ``low``."""

    forest: Forest
    low: int
    trees: Trees
    features: int
    width: int
    scale: float

    def absorb(self, level: int, tree: np.ndarray, node: np.ndarray, found: list[tuple]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Put splits of (tree, node) into the trees; the sides that may split again."""
        looked = features_of(self.forest, self.features, tree, node)
        following = []
        for first, split in found:
            held = slice(first, first + len(split["gain"]))
            t, n, features = tree[held] - self.low, node[held], looked[held]
            if level == 0:
                self.trees.value[t, 0] = _mean(split["whole"])
            good = split["gain"] > 0
            t, n, features, split = t[good], n[good], features[good], {k: v[good] for k, v in split.items()}
            self.trees.feature[t, n] = features[np.arange(len(t)), split["feature"]]
            self.trees.bin[t, n], self.trees.missing_left[t, n] = split["bin"], split["missing_left"]
            self.trees.value[t, 2 * n + 1], self.trees.value[t, 2 * n + 2] = _mean(split["left"]), _mean(split["right"])
            # A side of one kind of label, or too small, is a leaf.
            for side, child in (("left", 2 * n + 1), ("right", 2 * n + 2)):
                sums = split[side]
                large = sums[:, 1] >= max(2 * self.forest.least, 2)
                if self.forest.classes:
                    large &= (sums[:, 0] > 0) & (sums[:, 0] < sums[:, 1])
                following.append((t[large] + self.low, child[large]))
        return following

    def grow(self, ask: Callable[[int, np.ndarray, np.ndarray], list[tuple]]) -> Trees:
        """Level by level; a step takes as many nodes as its histogram has room for."""
        count = len(self.trees)
        tree, node = self.low + np.arange(count), np.zeros(count, np.int64)
        tries = min(self.forest.tries or self.features, self.features)
        room = max(1, FOREST_CELLS // max(tries * self.width, 1))
        for level in range(self.forest.depth):
            following: list[tuple[np.ndarray, np.ndarray]] = []
            for start in range(0, len(node), room):
                own = tree[start : start + room], node[start : start + room]
                following += self.absorb(level, *own, ask(level, *own))
            if not following:
                break
            tree, node = (np.concatenate(x) for x in zip(*following))
            order = np.lexsort((node, tree))
            tree, node = tree[order], node[order]
        return self.trees

    def sums(self, blocks: Iterator[Block], level: int, tree: np.ndarray, node: np.ndarray) -> Iterator[tuple]:
        return forest_sums(blocks, self.forest, self.trees, self.low, level, tree, node, self.width, self.scale)


def whole_columns(blocks: Iterator[Block], counts: list[int], seed: int | None = None, scale: float | None = None) -> Columns | None:
    """All rows of a task's blocks, feature by feature; with a scale, labels are whole numbers of 1 / scale, and with a seed, keys are hashed."""
    held = list(blocks)
    if not held:
        return None
    count = sum(len(block["y"]) for block in held)
    bins = np.empty((count, held[0]["bins"].shape[1]), held[0]["bins"].dtype, order="F")
    labels, seeded, start = np.empty(count), np.empty(count, np.uint64), 0
    held.reverse()
    while held:
        block = held.pop()
        own = slice(start, start + len(block["y"]))
        bins[own], labels[own] = block["bins"], block["y"] if scale is None else np.rint(block["y"] * scale)
        seeded[own] = block["key"] if seed is None else hashed(block["key"], seed)
        start = own.stop
    return Columns(bins, counts, labels, seeded)


def grove_here(blocks: Iterator[Block], grove: Grove, counts: list[int]) -> Iterator[tuple]:
    """The trees of a task that has all rows, as arrays; so many at a time that where their rows stand has room."""
    forest = grove.forest
    rows = whole_columns(blocks, counts, forest.seed, grove.scale)
    if rows is None:
        return
    steps = draw_steps(forest.row_sample)
    at_once = max(1, SORTED_BYTES // max(16 * len(rows.labels), 1))
    for low in range(0, len(grove.trees), at_once):
        own = Grove(forest, grove.low + low, grove.trees[low : low + at_once], grove.features, grove.width, grove.scale)
        memory: dict = {}

        def ask(level: int, tree: np.ndarray, node: np.ndarray) -> list[tuple]:
            looked = features_of(forest, own.features, tree, node)
            draw = lambda t: drawn(rows.seeded, t, steps)
            sums = sorted_sums(rows, memory, draw, own.trees, own.low, level, tree, node, looked, own.width, own.scale)
            return list(forest_splits(iter([(0, sums)]), forest.least))

        own.grow(ask)
    yield grove.trees.arrays()


def grow_forest(
    spark: SparkSession, blocks: RDD, forest: Forest, cuts: list[list[np.ndarray]], span: float = 1.0, at_once: int = 8, rows: int | None = None
) -> Trees:
    """A forest from the ``training_rows`` of its view; ranges of its trees grow side by side.

    Trees do not need each other, so each task grows some trees from all rows if the bins of these ``rows`` have room in it.
    """
    own = cuts[forest.view]
    width = max((len(c) for c in own), default=0) + 2
    # Classes are whole numbers as they are.
    scale = 1.0 if forest.classes else 2.0 ** (20 - int(np.ceil(np.log2(max(span, 1e-12)))))
    whole = blocks.getNumPartitions() == 1 or (rows is not None and bins_bytes(rows, own) <= WHOLE_BYTES)
    counts = [len(c) + 2 for c in own]

    def grow(low: int) -> Trees:
        count = min(TREES_TOGETHER, forest.trees - low)
        grove = Grove(forest, low, Trees.empty(count, forest.depth), len(own), width, scale)
        if whole:
            (arrays,) = blocks.coalesce(1).mapPartitions(partial(grove_here, grove=grove, counts=counts)).collect()
            return Trees(*arrays)

        def ask(level: int, tree: np.ndarray, node: np.ndarray) -> list[tuple]:
            sent = partial(grove_sums, grove=grove, level=level, tree=tree, node=node)
            return reduced(blocks.mapPartitions(sent)).mapPartitions(partial(forest_splits, least=forest.least)).collect()

        return grove.grow(ask)

    blocks.persist(StorageLevel.MEMORY_AND_DISK)
    trees = joined(together(spark, [partial(grow, low) for low in range(0, forest.trees, TREES_TOGETHER)], at_once))
    blocks.unpersist()
    return trees


def grove_sums(blocks: Iterator[Block], grove: Grove, level: int, tree: np.ndarray, node: np.ndarray) -> Iterator[tuple]:
    return grove.sums(blocks, level, tree, node)


def _mean(sums: np.ndarray) -> np.ndarray:
    return sums[:, 0] / np.maximum(sums[:, 1], 1.0)


def forest_splits(sums: Iterator[tuple], least: float) -> Iterator[tuple]:
    for first, own in sums:
        yield first, best_splits(own, 0.0, least)
