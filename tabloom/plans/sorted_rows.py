"""Rows of a tree kept sorted by node, for a task that sees all rows and levels of its trees.

A level goes on from the one before: the rows of a node are parted into those of
its sides. The rows of a large node are looked at by themselves, so what the node
looks at are whole columns; several features with few bins are counted as one
(row by row, the cell of all of them), and each one's sums are sums over the
others' bins. Small nodes are counted side by side.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from tabloom.plans.trees import Trees

# Rows of a node that is looked at by itself, and cells of features that are counted as one.
LARGE_NODE = 2048
JOINT_CELLS = 2048


@dataclass
class Columns:
    """Rows feature by feature: bins, the number of bins of each feature, and labels as whole numbers."""

    bins: np.ndarray
    counts: list[int]
    labels: np.ndarray
    seeded: np.ndarray

    def __post_init__(self):
        self.flat = self.bins.ravel(order="F")
        self.columns = [self.bins[:, f] for f in range(self.bins.shape[1])]
        self.largest = float(np.abs(self.labels).max(initial=0.0))
        self.joint: list[tuple[list[int], list[int], np.ndarray]] = []

    def join(self) -> None:
        """Count the same features as one from now on, for trees that look at all of them."""
        for group in together_by_bins(tuple(self.counts), JOINT_CELLS):
            counts = [self.counts[f] for f in group]
            self.joint.append((group, counts, _joint([self.columns[f] for f in group], counts)))


@dataclass
class Sorted:
    """A tree's rows by node: those of ``nodes[i]`` are at ``bounds[i]`` to ``bounds[i + 1]`` of ``at``. ``weights`` are what is summed
    up, for all rows of the table: whole numbers and counts in one (numbers times 2 to the power of ``shift``), or in two where one
    has no room."""

    at: np.ndarray
    weights: list[np.ndarray]
    shift: int
    nodes: np.ndarray
    bounds: np.ndarray
    level: int = 0


def drawn_rows(rows: Columns, times: np.ndarray) -> Sorted:
    draws = times.astype(np.float64)
    total = int(draws.sum())
    weights, shift = in_one(rows.labels * draws, draws, total, (total + 1) * (rows.largest + 1))
    return at_root(np.flatnonzero(times), weights, shift)


def in_one(numbers: np.ndarray, counts: np.ndarray, total: int, most: float) -> tuple[list[np.ndarray], int]:
    """Whole numbers, whose sums are at most ``most``, and counts, whose sum is ``total``, as one number each if both have room."""
    shift = total.bit_length()
    if (most + 1) * (1 << shift) >= 1 << 52:
        return [numbers, counts], shift
    numbers *= float(1 << shift)
    numbers += counts
    return [numbers], shift


def at_root(at: np.ndarray, weights: list[np.ndarray], shift: int) -> Sorted:
    return Sorted(at, weights, shift, np.zeros(1, np.int64), np.array([0, len(at)]))


def _sides(values: np.ndarray, limit: int | np.ndarray, missing_left: bool | np.ndarray) -> np.ndarray:
    """Whether rows go right; missing values are 0."""
    right = values > limit
    lost = values == 0
    return right | (lost & ~missing_left) if np.any(lost) else right


def parted(held: Sorted, rows: Columns, tree: Trees) -> Sorted:
    """The rows one level further down; those at a leaf are done."""
    feature, limit, missing = tree.feature[0], tree.bin[0], tree.missing_left[0]
    inner = np.flatnonzero(feature[held.nodes] >= 0).tolist()
    sizes = np.diff(held.bounds)
    found: dict[int, list[np.ndarray]] = {}
    for i in inner:
        if sizes[i] < LARGE_NODE:
            continue
        at, node = held.at[held.bounds[i] : held.bounds[i + 1]], held.nodes[i]
        right = _sides(rows.columns[feature[node]].take(at, mode="clip"), limit[node], missing[node])
        found[i] = [at.compress(~right), at.compress(right)]
    small = [i for i in inner if sizes[i] < LARGE_NODE]
    if small:
        at = np.concatenate([held.at[held.bounds[i] : held.bounds[i + 1]] for i in small])
        nodes, many = held.nodes[small], sizes[small]
        values = rows.flat.take(np.repeat(feature[nodes].astype(np.int64) * len(rows.bins), many) + at, mode="clip")
        right = _sides(values, np.repeat(limit[nodes], many), np.repeat(missing[nodes], many))
        side = (2 * np.repeat(np.arange(len(small)), many) + right).astype(np.uint16)
        at = at.take(np.argsort(side, kind="stable"))
        ends = np.concatenate([[0], np.cumsum(np.bincount(side, minlength=2 * len(small)))]).tolist()
        for j, i in enumerate(small):
            found[i] = [at[ends[k] : ends[k + 1]] for k in (2 * j, 2 * j + 1)]
    pieces = [piece for i in inner for piece in found[i]]
    nodes = (2 * held.nodes[inner][:, None] + [1, 2]).ravel()
    bounds = np.cumsum([0, *map(len, pieces)])
    return Sorted(np.concatenate(pieces) if pieces else held.at[:0], held.weights, held.shift, nodes, bounds, held.level + 1)


@lru_cache(4096)
def together_by_bins(counts: tuple[int, ...], cells: int) -> list[list[int]]:
    """Places of numbers of bins in groups whose product is at most ``cells``."""
    groups: list[tuple[int, list[int]]] = []
    for place in sorted(range(len(counts)), key=lambda i: -counts[i]):
        for g, (size, own) in enumerate(groups):
            if size * counts[place] <= cells:
                groups[g] = size * counts[place], [*own, place]
                break
        else:
            groups.append((counts[place], [place]))
    return [own for _, own in groups]


def _joint(columns: Sequence[np.ndarray], counts: Sequence[int]) -> np.ndarray:
    """Cells of several columns as one."""
    cell = columns[0]
    if len(columns) > 1:
        cell = cell.astype(np.uint16)
        for column, count in zip(columns[1:], counts[1:]):
            cell *= np.uint16(count)
            cell += column
    return cell


def _counted(cell: np.ndarray, weights: list[np.ndarray], counts: Sequence[int], places: Sequence[int | None], into: np.ndarray) -> None:
    """Sums (weight, place, bin) of each of some features from cells of all of them; a place of None is not wanted."""
    cell = cell.astype(np.int64)
    for w, weight in enumerate(weights):
        whole = np.bincount(cell, weight, int(np.prod(counts))).reshape(counts)
        for axis, place in enumerate(places):
            if place is not None:
                into[w, place, : counts[axis]] = whole.sum(axis=tuple(a for a in range(len(counts)) if a != axis))


def _large_node(rows: Columns, at: np.ndarray, weights: list[np.ndarray], features: list[int], into: np.ndarray) -> None:
    """Sums (weight, feature, bin) of one node into ``into``."""
    # All rows are in their order only before the first split.
    taken = (lambda x: x) if len(at) == len(rows.bins) else (lambda x: x.take(at, mode="clip"))
    weights = [taken(w) for w in weights]
    if rows.joint:
        place_of = {f: place for place, f in enumerate(features)}
        for group, counts, column in rows.joint:
            places = [place_of.get(f) for f in group]
            if any(p is not None for p in places):
                _counted(taken(column), weights, counts, places, into)
        return
    counts = [rows.counts[f] for f in features]
    for group in together_by_bins(tuple(counts), min(JOINT_CELLS, 1 << max(len(at).bit_length() - 2, 0))):
        own = [counts[p] for p in group]
        _counted(_joint([taken(rows.columns[features[p]]) for p in group], own), weights, own, group, into)


def level_of(held: Sorted, rows: Columns, nodes: np.ndarray, looked: np.ndarray, width: int, scale: float) -> np.ndarray:
    """Sums of numbers and counts (2, node, feature looked at, bin) of some nodes of the level; numbers are whole ones of 1 / scale."""
    tries = looked.shape[1]
    sums = np.zeros((len(held.weights), len(nodes), tries, width))
    place = np.searchsorted(held.nodes, nodes)
    begin, end = held.bounds[place], held.bounds[place + 1]
    large = end - begin >= LARGE_NODE
    for i in np.flatnonzero(large).tolist():
        _large_node(rows, held.at[begin[i] : end[i]], held.weights, looked[i].tolist(), sums[:, i])
    small = np.flatnonzero(~large)
    if len(small):
        at = np.concatenate([held.at[begin[i] : end[i]] for i in small.tolist()])
        weights, many = [w.take(at, mode="clip") for w in held.weights], (end - begin)[small]
        from_cell = np.repeat(np.arange(len(small)) * width, many)
        for k in range(tries):
            cell = np.repeat(looked[small, k] * len(rows.bins), many)
            cell += at
            cell = rows.flat.take(cell, mode="clip") + from_cell
            for w, weight in enumerate(weights):
                sums[w, small, k] = np.bincount(cell, weight, len(small) * width).reshape(len(small), width)
    if len(held.weights) == 1:
        both = sums[0].astype(np.int64)
        return np.stack([(both >> held.shift) / scale, (both & ((1 << held.shift) - 1)).astype(np.float64)])
    sums[0] /= scale
    return sums


def sorted_sums(
    rows: Columns, memory: dict[int, Sorted], draw: Callable[[int], np.ndarray], grown: Trees, low: int, level: int, tree: np.ndarray,
    node: np.ndarray, looked: np.ndarray, width: int, scale: float,
) -> np.ndarray:
    """Sums of labels and draws per (tree, node) of a level, sorted by tree; ``grown`` starts at ``low``. ``memory`` keeps where the
    rows of each tree stand."""
    parts = []
    for t in np.unique(tree).tolist():
        first, stop = np.searchsorted(tree, [t, t + 1])
        held = memory.get(t) or drawn_rows(rows, draw(t))
        while held.level < level:
            held = parted(held, rows, grown[t - low : t - low + 1])
        memory[t] = held
        parts.append(level_of(held, rows, node[first:stop], looked[first:stop], width, scale))
    return np.concatenate(parts, axis=1)


@dataclass
class Round:
    """A tree of a chain as it grows, from all rows of a task. Rows that are not in the tree's sample have weight 0, so every row's
    leaf is known in the end. Of two sides the one of fewer rows is counted; the other one is what is left of their node."""

    held: Sorted
    above: np.ndarray | None = None
    nodes: np.ndarray | None = None

    def sums(self, rows: Columns, tree: Trees, nodes: np.ndarray, features: np.ndarray, width: int, scale: float, margin: np.ndarray) -> np.ndarray:
        """Sums (2, node, feature, bin) of the next level's nodes."""
        looked = lambda count: np.broadcast_to(features, (count, len(features)))
        if self.nodes is None:
            found = level_of(self.held, rows, nodes, looked(len(nodes)), width, scale)
        else:
            self.go_on(rows, tree, margin)
            parents = np.unique((nodes - 1) // 2)
            size = np.diff(self.held.bounds)[np.searchsorted(self.held.nodes, 2 * parents[:, None] + [1, 2])]
            fewer = 2 * parents + 1 + (size[:, 1] < size[:, 0])
            counted = level_of(self.held, rows, fewer, looked(len(fewer)), width, scale)
            rest = self.above[:, np.searchsorted(self.nodes, parents)] - counted
            place = np.searchsorted(parents, (nodes - 1) // 2)
            found = np.where((fewer[place] == nodes)[None, :, None, None], counted[:, place], rest[:, place])
        self.above, self.nodes = found, nodes
        return found

    def go_on(self, rows: Columns, tree: Trees, margin: np.ndarray) -> None:
        """One level down; rows at a leaf take its value."""
        nodes, bounds = self.held.nodes, self.held.bounds
        for i in np.flatnonzero(tree.feature[0, nodes] < 0).tolist():
            margin[self.held.at[bounds[i] : bounds[i + 1]]] += tree.value[0, nodes[i]]
        self.held = parted(self.held, rows, tree)

    def finish(self, rows: Columns, tree: Trees, margin: np.ndarray) -> None:
        """Give the rows that are still on their way the values of their leaves."""
        while len(self.held.at):
            self.go_on(rows, tree, margin)
