"""Rows encoded once for many fits: every view's bins side by side, written once and read by all models.

A view is a choice of training rows (a fold, a holdout seed, or all) with the
stages before the model fitted on them. Encoders are fitted once per view, one
job writes all views' vectors, and one more their bins. Models of all candidates
and all views then grow from the same blocks, and rows outside a view's choice
are scored from the same blocks too.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.plans.levels import WRITE_EVERY, Chain, Forest, block_rows, grow_chains, grow_forest, in_one_task, training_rows
from tabloom.plans.trees import Trees, bins_of
from tabloom.runtime import materialize, together

# Rows that cut points are taken from, about; all rows of smaller tables.
CUT_ROWS = 100_000
HASH_RANGE = 1 << 53
# The share of a class that a view lacks is taken as this.
ONE_CLASS = 1e-6


@dataclass
class Views:
    """Encoded rows; by view: the fitted stages, the cuts of each feature, the labels' mean, their span around 0, and their number."""

    packed: DataFrame
    parts: int
    models: list[PipelineModel | None]
    cuts: list[list[np.ndarray]]
    means: list[float]
    spans: list[float]
    counts: list[int]
    id_type: str

    def start(self, chain: Chain) -> float:
        mean = self.means[chain.view]
        if chain.objective == "squared":
            return float(mean)
        if chain.objective == "logistic":
            # A fold of one class has no finite log odds.
            held = min(max(mean, ONE_CLASS), 1.0 - ONE_CLASS)
            return math.log(held / (1.0 - held))
        return 0.0

    @property
    def blocks(self) -> RDD:
        """The training rows of all views, in the partitions that models grow from."""
        return self.training(range(len(self.cuts)))

    def training(self, views: Sequence[int]) -> RDD:
        return training_rows(self.packed, sorted(set(views)), self.parts)

    def alone(self, chain: Chain) -> bool:
        """Whether a booster grows in a task of its own."""
        return self.parts == 1 or in_one_task(chain, self.counts[chain.view], self.cuts[chain.view])

    def grow(self, chains: Sequence[Chain], write_every: int = WRITE_EVERY) -> list[Trees]:
        """The trees of boosters; those that do not grow alone share their level jobs."""
        spark = self.packed.sparkSession

        def some(own: Sequence[Chain], parts: int) -> list[Trees]:
            starts, spans = [self.start(c) for c in own], [2.0 * self.spans[c.view] + 1.0 for c in own]
            rows = training_rows(self.packed, sorted({c.view for c in own}), parts)
            return grow_chains(spark, rows, own, self.cuts, starts, spans, write_every)

        shared = [c for c in chains if not self.alone(c)]
        # A level's job is short, so more partitions than cores would be more to start and more sums to add up.
        parts = max(2, min(self.parts, spark.sparkContext.defaultParallelism))
        groups = [([c], 1) for c in chains if self.alone(c)] + ([(shared, parts)] if shared else [])
        found = together(spark, [partial(some, *group) for group in groups], len(groups))
        grown = dict(zip([id(c) for own, _ in groups for c in own], [trees for own in found for trees in own], strict=True))
        return [grown[id(c)] for c in chains]

    def grow_forest(self, forest: Forest) -> Trees:
        rows = self.training([forest.view])
        span, count = self.spans[forest.view] + 1.0, self.counts[forest.view]
        return grow_forest(self.packed.sparkSession, rows, forest, self.cuts, span, rows=count)

    def close(self) -> None:
        """Growths hold their rows themselves while they run; only the written blocks stay."""


def quantile_cuts(rows: DataFrame, column: str, share: float, bins: int) -> list[np.ndarray]:
    """Distinct quantiles of each place of an array column as cut points; NaN takes no part.

    They come from a ``share`` of the rows, chosen by a hash of their keys, so neither files nor cores matter. Rows
    are all binned; only where the cuts lie is estimated, as gradient boosting libraries do.
    """
    if share < 1.0:
        rows = rows.where(F.pmod(F.xxhash64("key", F.lit("cuts")), F.lit(HASH_RANGE)) < int(share * HASH_RANGE))
    held = rows.select(column).toArrow()[column].combine_chunks()
    values = held.flatten().to_numpy(zero_copy_only=False).reshape(len(held), -1) if len(held) else np.zeros((0, 0))
    cuts = []
    for own in values.T:
        own = np.sort(own[~np.isnan(own)])
        cuts.append(np.unique(own[np.arange(1, bins) * len(own) // bins]) if len(own) else own)
    return cuts


def encode_views(
    df: DataFrame, id_col: str, label: str, choices: Sequence[Column], stages: Pipeline | None = None, features: str = "features",
    max_bins: int = 32, keep: Sequence[str] = (),
) -> Views:
    """Encode the labelled rows of a written table for every choice of training rows."""
    spark = df.sparkSession
    rows = df.where(F.col(f"`{label}`").isNotNull())
    models: list[PipelineModel | None] = [None] * len(choices)
    if stages is not None:
        models = together(spark, [partial(stages.fit, rows.where(choice)) for choice in choices], 4)
    marks = F.array(*[F.coalesce(choice, F.lit(False)) for choice in choices])
    key = F.xxhash64(F.col(f"`{id_col}`")) if id_col else F.xxhash64(vector_to_array(F.col(features)))
    frame = rows.withColumns({"__trains": marks, "__key": key})
    kept = list(frame.columns)
    for v, model in enumerate(models):
        vectors = model.transform(frame) if model is not None else frame
        frame = vectors.withColumn(f"__x{v}", vector_to_array(F.col(features)))
        kept.append(f"__x{v}")
        frame = frame.select(*[F.col(f"`{c}`") for c in kept])
    ident = F.col(f"`{id_col}`") if id_col else F.col("__key")
    flat = materialize(
        frame.select(
            ident.alias("id"), F.col(f"`{label}`").cast("double").alias("y"), F.col("__key").alias("key"), F.col("__trains").alias("trains"),
            *[F.col(f"__x{v}").alias(f"x{v}") for v in range(len(choices))],
        ),
        "encoded",
    )
    per_view = [
        F.struct(
            F.count(F.when(F.col("trains")[v], 1)).alias("rows"), F.avg(F.when(F.col("trains")[v], F.col("y"))).alias("mean"),
            F.coalesce(F.max(F.when(F.col("trains")[v], F.abs("y"))), F.lit(0.0)).alias("span"),
        ).alias(f"v{v}")
        for v in range(len(choices))
    ]
    found = flat.agg(F.count(F.lit(1)).alias("rows"), *per_view).first()
    stats = [found[f"v{v}"] for v in range(len(choices))]
    if not all(s["rows"] for s in stats):
        raise ValueError("no labelled row to fit on")
    cut = lambda v: quantile_cuts(flat.where(F.col("trains")[v]), f"x{v}", CUT_ROWS / stats[v]["rows"], max_bins)
    cuts = together(spark, [partial(cut, v) for v in range(len(choices))], 4)
    packed, parts = block_rows(flat, cuts, found["rows"])
    return Views(packed, parts, models, cuts, [s["mean"] for s in stats], [s["span"] for s in stats], [s["rows"] for s in stats], flat.schema["id"].dataType.simpleString())


@dataclass(frozen=True)
class Scorer:
    """A model that scores the rows outside its view's choice: ``of_sums`` turns the sum over the first ``upto`` trees
    (at most ``depth`` levels down) into a score."""

    position: int
    view: int
    trees: Trees
    of_sums: Callable[[np.ndarray], np.ndarray]
    upto: int
    depth: int | None = None


def sums_of(spark: SparkSession, asked: Sequence[tuple[Trees, int, int]], cuts: list[np.ndarray], features: str) -> Column:
    """Sums of each (trees, first so many, depth) for each row of a vector column, as an array. What models share is summed up once."""
    distinct = {id(trees): trees for trees, _, _ in asked}
    place = {known: i for i, known in enumerate(distinct)}
    wanted: dict[int, list[tuple[int, int, int]]] = {}
    for position, (trees, upto, depth) in enumerate(asked):
        wanted.setdefault(place[id(trees)], []).append((position, upto, depth))
    shared = spark.sparkContext.broadcast(([t.arrays() for t in distinct.values()], cuts))
    count = len(asked)

    @F.arrow_udf("array<double>")
    def sums(rows: pa.Array) -> pa.Array:
        arrays, cuts = shared.value
        if not len(rows):
            return pa.array([], pa.list_(pa.float64()))
        values = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
        bins = bins_of(values[:, : len(cuts)], cuts)
        out = np.empty((len(rows), count))
        for which, own in wanted.items():
            marks, depths = tuple(sorted({o[1] for o in own})), tuple(sorted({o[2] for o in own}))
            found = Trees(*arrays[which]).sums_at(bins, depths, marks)
            for position, upto, depth in own:
                out[:, position] = found[depths.index(depth), :, marks.index(upto)]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * count), pa.array(out.ravel()))

    return sums(vector_to_array(F.col(features)))


def out_of_view_scores(views: Views, scorers: Sequence[Scorer]) -> DataFrame:
    """(id, y, position, view, score) of each model's rows outside its view, from one pass over the blocks."""
    spark = views.packed.sparkSession
    # Models that share their trees share one broadcast copy, and are summed up once.
    distinct = {id(s.trees): s.trees for s in scorers}
    places = {known: i for i, known in enumerate(distinct)}
    shared = spark.sparkContext.broadcast([t.arrays() for t in distinct.values()])
    asked: dict[tuple, list[tuple]] = {}
    for s in scorers:
        asked.setdefault((places[id(s.trees)], s.view), []).append((s.upto, s.trees.depth if s.depth is None else s.depth, s.position, s.of_sums))

    used = sorted({s.view for s in scorers})

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Trees(*arrays) for arrays in shared.value]
        for batch in batches:
            for row in batch.to_pylist():
                block = pickle.loads(row["block"])
                bins = {v: pickle.loads(row[f"bins{v}"]) for v in used}
                for (place, view), own in asked.items():
                    rows = np.flatnonzero(~block["trains"][:, view])
                    marks, depths = tuple(sorted({o[0] for o in own})), tuple(sorted({o[1] for o in own}))
                    sums = trees[place].sums_at(bins[view][rows], depths, marks)
                    ids, y, of_view = block["id"].take(pa.array(rows)), pa.array(block["y"][rows]), pa.array(np.full(len(rows), view, np.int32))
                    for upto, depth, position, of_sums in own:
                        score = of_sums(sums[depths.index(depth), :, marks.index(upto)])
                        columns = [ids, y, pa.array(np.full(len(rows), position, np.int32)), of_view, pa.array(score)]
                        yield pa.RecordBatch.from_arrays(columns, names=["id", "y", "position", "view", "score"])

    return views.packed.select("block", *[f"bins{v}" for v in used]).mapInArrow(score, f"id {views.id_type}, y double, position int, view int, score double")
