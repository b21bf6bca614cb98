"""Trees as arrays: how a row of bins goes through many trees at once.

Node n of a tree has the children 2n + 1 and 2n + 2. Bin 0 is a missing value;
bin b > 0 holds the values from cut b - 1 up to cut b. A tree is data, never
code, so nothing is compiled for it and its number of nodes has no limit.
"""

from __future__ import annotations

import base64
import io
import json
import zlib
from dataclasses import dataclass

import numpy as np

# Rows that go through the trees at once.
ROWS = 1 << 14


@dataclass
class Trees:
    """``feature`` is -1 at a leaf; rows up to ``bin`` go left, missing ones by ``missing_left``; each node has a value."""

    feature: np.ndarray
    bin: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray

    @staticmethod
    def empty(count: int, depth: int) -> Trees:
        shape = (count, 2 ** (depth + 1) - 1)
        return Trees(np.full(shape, -1, np.int16), np.zeros(shape, np.int16), np.zeros(shape, bool), np.zeros(shape))

    def arrays(self) -> tuple[np.ndarray, ...]:
        return self.feature, self.bin, self.missing_left, self.value

    def __len__(self) -> int:
        return len(self.feature)

    def __getitem__(self, which: slice) -> Trees:
        return Trees(self.feature[which], self.bin[which], self.missing_left[which], self.value[which])

    @property
    def depth(self) -> int:
        return (self.feature.shape[1] + 1).bit_length() - 2

    def places(self, bins: np.ndarray, depth: int | None = None) -> np.ndarray:
        """The node that each row (of rows x features) reaches in each tree, at most ``depth`` levels down."""
        rows, count, nodes = len(bins), len(self), self.feature.shape[1]
        base = np.arange(count) * nodes
        node = np.zeros((rows, count), np.int64)
        features, limits, missing = self.feature.ravel(), self.bin.ravel(), self.missing_left.ravel()
        width = bins.shape[1]
        flat, start = np.ascontiguousarray(bins).ravel(), (np.arange(rows) * width)[:, None]
        for _ in range(self.depth if depth is None else min(depth, self.depth)):
            at = node + base
            feature = features[at]
            inner = feature >= 0
            if not inner.any():
                break
            value = flat[start + np.maximum(feature, 0)]
            left = np.where(value == 0, missing[at], value <= limits[at])
            node = np.where(inner, 2 * node + 2 - left, node)
        return node

    def way(self, t: int, bins: np.ndarray) -> tuple:
        """How rows go down a tree: each node's feature as an offset, its limit, and its left child; a leaf leads to itself."""
        feature, inner, most = self.feature[t], self.feature[t] >= 0, np.iinfo(bins.dtype).max
        offset = np.where(inner, feature, 0).astype(np.int64) * (len(bins) if bins.flags.f_contiguous else 1)
        # Bins are looked at less by one, so that missing values are the highest and go right.
        limit = np.where(inner, np.clip(self.bin[t].astype(np.int64) - 1, 0, most), most).astype(bins.dtype)
        nodes = np.arange(len(feature))
        missing = self.missing_left[t] & inner
        return offset, limit, np.where(inner, 2 * nodes + 1, nodes), missing if missing.any() else None

    def step(self, bins: np.ndarray, rows: np.ndarray, node: np.ndarray, way: tuple | None = None) -> np.ndarray:
        """One level down the first tree (or the one of ``way``), from the nodes of some rows; rows at a leaf stay."""
        offset, limit, left, missing = way or self.way(0, bins)
        by_column = bins.flags.f_contiguous
        at = offset.take(node)
        at += rows if by_column else rows.astype(np.int64) * bins.shape[1]
        value = bins.ravel(order="F" if by_column else "C").take(at)
        right = value - value.dtype.type(1) > limit.take(node)
        if missing is not None:
            right &= ~(missing.take(node) & (value == 0))
        return left.take(node) + right

    def only(self, bins: np.ndarray) -> np.ndarray:
        """The value of each row in the first tree."""
        return self.sums(bins, upto=(1,))[:, 0]

    def values(self, bins: np.ndarray, depth: int | None = None) -> np.ndarray:
        """The value of each row in each tree."""
        return self.value[np.arange(len(self)), self.places(bins, depth)]

    def sums(self, bins: np.ndarray, depth: int | None = None, upto: tuple[int, ...] = ()) -> np.ndarray:
        """Sums of the values over the first trees, one column for each number in ``upto`` (all trees by default)."""
        return self.sums_at(bins, (self.depth if depth is None else depth,), upto or (len(self),))[0]

    def sums_at(self, bins: np.ndarray, depths: tuple[int, ...], upto: tuple[int, ...]) -> np.ndarray:
        """The same (depth, row, number) for trees of several depths, as what a less deep tree gives is on the way; numbers rise."""
        levels = [min(depth, self.depth) for depth in depths]
        out = np.zeros((len(depths), len(bins), len(upto)))
        # A tree at a time over so few rows that they stay in the processor's cache.
        for first in range(0, len(bins), ROWS):
            part = np.asfortranarray(bins[first : first + ROWS])
            rows, total, done = np.arange(len(part)), np.zeros((len(depths), len(part))), 0
            for column, stop in enumerate(upto):
                for t in range(done, stop):
                    node, way = np.zeros(len(part), np.int64), self.way(t, part)
                    for level in range(max(levels) + 1):
                        if level:
                            node = self.step(part, rows, node, way)
                        for d in (d for d, own in enumerate(levels) if own == level):
                            total[d] += self.value[t].take(node)
                done = stop
                out[:, first : first + ROWS, column] = total
        return out

    def packed(self) -> str:
        """All arrays as text, for a model's store."""
        held = io.BytesIO()
        np.savez(held, feature=self.feature, bin=self.bin, missing_left=self.missing_left, value=self.value)
        return base64.b64encode(zlib.compress(held.getvalue(), 1)).decode()

    @staticmethod
    def unpacked(text: str) -> Trees:
        held = np.load(io.BytesIO(zlib.decompress(base64.b64decode(text))))
        return Trees(held["feature"], held["bin"], held["missing_left"], held["value"])


def joined(parts: list[Trees]) -> Trees:
    """Trees of one depth behind each other."""
    return Trees(*[np.concatenate([getattr(p, name) for p in parts]) for name in ("feature", "bin", "missing_left", "value")])


def bins_of(values: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Values (rows x features) as bins; NaN is bin 0."""
    widest = max((len(c) for c in cuts), default=0) + 2
    out = np.zeros(values.shape, np.uint8 if widest <= 256 else np.uint16)
    for f, own in enumerate(cuts):
        column = values[:, f]
        out[:, f] = np.where(np.isnan(column), 0, np.searchsorted(own, column, side="right") + 1)
    return out


def as_dicts(trees: Trees, cuts: list[np.ndarray]) -> str:
    """Trees as JSON: a leaf has a weight; a split has a feature, a bin, the value below which rows go left, and two sides."""

    def node(t: int, n: int) -> dict:
        feature = int(trees.feature[t, n])
        if feature < 0:
            return {"leaf": float(trees.value[t, n])}
        own, at = cuts[feature], int(trees.bin[t, n]) - 1
        return {
            "feature": feature, "bin": at, "missing_left": bool(trees.missing_left[t, n]), "cut": float(own[at]) if at < len(own) else None,
            "left": node(t, 2 * n + 1), "right": node(t, 2 * n + 2),
        }

    return json.dumps([node(t, 0) for t in range(len(trees))])


def from_dicts(text: str) -> tuple[Trees, list[np.ndarray]]:
    """Trees of ``as_dicts`` on bins of the cuts that they use, and those cuts."""
    stored = json.loads(text)
    found: dict[int, set[float]] = {}

    def look(tree: dict) -> int:
        if "leaf" in tree:
            return 0
        found.setdefault(tree["feature"], set()).update([] if tree["cut"] is None else [tree["cut"]])
        return 1 + max(look(tree["left"]), look(tree["right"]))

    depth = max(map(look, stored), default=0)
    cuts = [np.array(sorted(found.get(f, ()))) for f in range(max(found, default=-1) + 1)]
    out = Trees.empty(len(stored), depth)

    def put(tree: dict, t: int, n: int) -> None:
        if "leaf" in tree:
            out.value[t, n] = tree["leaf"]
            return
        own = cuts[tree["feature"]]
        out.feature[t, n], out.missing_left[t, n] = tree["feature"], tree["missing_left"]
        out.bin[t, n] = len(own) + 1 if tree["cut"] is None else int(np.searchsorted(own, tree["cut"])) + 1
        put(tree["left"], t, 2 * n + 1)
        put(tree["right"], t, 2 * n + 2)

    for t, tree in enumerate(stored):
        put(tree, t, 0)
    return out, cuts
