"""Boosted trees (second order after Chen & Guestrin 2016, or first-order residuals) and forests as Spark estimators.

They grow by the level jobs of ``levels``; a model is arrays of trees, scored in
batches. ``histogram`` and ``best_splits`` are the same step in SQL, for tables
whose bins are columns.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.numeric import at_threshold
from tabloom.plans.encoded import Views, encode_views
from tabloom.plans.levels import LOG_RESIDUAL, LOGISTIC, RESIDUAL, SQUARED, Chain, Forest
from tabloom.plans.trees import Trees, as_dicts, bins_of, from_dicts


def histogram(rows: DataFrame, features: Sequence[int]) -> DataFrame:
    """Sums of ``g`` and ``h`` per node, feature and bin.

    ``rows`` has ``node``, ``g``, ``h`` and the array ``bins``.
    """
    numbers = ", ".join(map(str, features))
    chosen = ", ".join(f"bins[{f}]" for f in features)
    return (
        rows.selectExpr("node", "g", "h", f"posexplode(array({chosen})) AS (place, bin)")
        .selectExpr("node", f"array({numbers})[place] AS feature", "bin", "g", "h")
        .groupBy("node", "feature", "bin")
        .agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    )


SPLIT_SQL = """
WITH running AS (
  SELECT node, feature, bin,
    sum(g) OVER whole AS g_all,
    sum(h) OVER whole AS h_all,
    sum(if(bin < 0, g, 0D)) OVER whole AS g_lost,
    sum(if(bin < 0, h, 0D)) OVER whole AS h_lost,
    sum(if(bin < 0, 0D, g)) OVER upto AS g_known,
    sum(if(bin < 0, 0D, h)) OVER upto AS h_known
  FROM {sums}
  WINDOW whole AS (PARTITION BY node, feature), upto AS (PARTITION BY node, feature ORDER BY bin)
),
sided AS (
  SELECT node, feature, bin, missing_left, g_left, h_left, g_all - g_left AS g_right, h_all - h_left AS h_right, g_all, h_all
  FROM running
  LATERAL VIEW stack(2, false, g_known, h_known, true, g_known + g_lost, h_known + h_lost) AS missing_left, g_left, h_left
  WHERE bin >= 0
),
gained AS (
  SELECT *,
    0.5D * (g_left * g_left / (h_left + :reg) + g_right * g_right / (h_right + :reg) - g_all * g_all / (h_all + :reg)) AS gain
  FROM sided
  WHERE h_left >= :least AND h_right >= :least AND h_left > 0 AND h_right > 0
),
best AS (
  SELECT node, feature, max_by(
    struct(bin, missing_left, gain, g_left, h_left, g_right, h_right), struct(gain, -bin, NOT missing_left)
  ) AS s
  FROM gained
  WHERE gain > 0
  GROUP BY node, feature
)
SELECT node, feature, s.* FROM best
"""


def feature_splits(sums: DataFrame, reg_lambda: float = 1.0, min_child_weight: float = 1.0) -> DataFrame:
    """The split of highest gain per node and feature: rows up to ``bin`` go left.

    Rows with a missing value go to the side that gains more; a tie goes to
    the lower bin. A feature without a split that gains anything is absent.
    Every window is over the bins of one node and feature.
    """
    arguments = {"reg": float(reg_lambda), "least": float(min_child_weight)}
    return sums.sparkSession.sql(SPLIT_SQL, args=arguments, sums=sums)


def best_splits(sums: DataFrame, reg_lambda: float = 1.0, min_child_weight: float = 1.0) -> DataFrame:
    """The split of highest gain per node; a tie goes to the lower feature."""
    splits = feature_splits(sums, reg_lambda, min_child_weight)
    details = F.struct(*[F.col(c) for c in splits.columns if c != "node"])
    rank = F.struct(F.col("gain"), -F.col("feature"))
    return splits.groupBy("node").agg(F.max_by(details, rank).alias("s")).select("node", "s.*")


OBJECTIVES = (SQUARED, LOGISTIC, RESIDUAL, LOG_RESIDUAL)


class _TreeParams(HasFeaturesCol, HasLabelCol):
    predictionCol = Param(Params._dummy(), "predictionCol", "prediction column", TypeConverters.toString)
    idCol = Param(Params._dummy(), "idCol", "row id for row sampling; '' hashes the features", TypeConverters.toString)
    maxDepth = Param(Params._dummy(), "maxDepth", "levels of splits", TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "bins per feature", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of the samples", TypeConverters.toInt)


class _BoostParams(_TreeParams):
    objective = Param(Params._dummy(), "objective", "squared, logistic, residual or log_residual", TypeConverters.toString)
    rounds = Param(Params._dummy(), "rounds", "number of trees", TypeConverters.toInt)
    eta = Param(Params._dummy(), "eta", "shrinkage of each tree", TypeConverters.toFloat)
    minChildWeight = Param(Params._dummy(), "minChildWeight", "least hessian sum of a side", TypeConverters.toFloat)
    regLambda = Param(Params._dummy(), "regLambda", "L2 term of leaf weights", TypeConverters.toFloat)
    rowSample = Param(Params._dummy(), "rowSample", "share of rows per tree", TypeConverters.toFloat)
    columnSample = Param(Params._dummy(), "columnSample", "share of features per tree", TypeConverters.toFloat)
    writeEvery = Param(Params._dummy(), "writeEvery", "rounds between written margins", TypeConverters.toInt)

    def _defaults(self) -> None:
        self._setDefault(
            objective="squared", featuresCol="features", labelCol="label", predictionCol="prediction", idCol="",
            rounds=100, eta=0.3, maxDepth=6, minChildWeight=1.0, regLambda=1.0, rowSample=1.0, columnSample=1.0,
            maxBins=256, seed=42, writeEvery=40,
        )


class HistogramBooster(Estimator, _BoostParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits boosted trees on a vector column. Missing values are NaN."""

    @keyword_only
    def __init__(
        self,
        *,
        objective=None,
        featuresCol=None,
        labelCol=None,
        predictionCol=None,
        idCol=None,
        rounds=None,
        eta=None,
        maxDepth=None,
        minChildWeight=None,
        regLambda=None,
        rowSample=None,
        columnSample=None,
        maxBins=None,
        seed=None,
        writeEvery=None,
    ):
        super().__init__()
        self._defaults()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def chain(self, view: int = 0) -> Chain:
        """What the level jobs grow for this booster."""
        get = self.getOrDefault
        if get("objective") not in OBJECTIVES:
            raise ValueError(f"the objective is one of {OBJECTIVES}")
        if get("rounds") <= 0 or get("eta") <= 0:
            raise ValueError("rounds and eta must be positive")
        return Chain(
            get("objective"), view, get("rounds"), get("maxDepth"), get("eta"), get("regLambda"), get("minChildWeight"),
            get("rowSample"), get("columnSample"), get("seed"),
        )

    def model_of(self, trees: Trees, cuts: Sequence[np.ndarray], start: float) -> BoostedTreesModel:
        model = BoostedTreesModel()
        self._copyValues(model)
        own = trees[: self.getOrDefault("rounds")]
        model.held = own, list(cuts)
        return model._set(trees=as_dicts(own, list(cuts)), start=float(start))

    def _fit(self, dataset: DataFrame) -> BoostedTreesModel:
        chain = self.chain()
        views = _one_view(self, dataset)
        (trees,) = views.grow([chain], self.getOrDefault("writeEvery"))
        views.close()
        return self.model_of(trees, views.cuts[0], views.start(chain))


def _one_view(estimator: _TreeParams, dataset: DataFrame) -> Views:
    get = estimator.getOrDefault
    return encode_views(dataset, get("idCol"), get("labelCol"), [F.lit(True)], None, get("featuresCol"), get("maxBins"))


@dataclass
class _Scored:
    """Trees and the cuts of their bins, sent once to every executor."""

    trees: Trees
    cuts: list[np.ndarray]

    def sums(self, dataset: DataFrame, features: str) -> Column:
        """The sum of all trees for each row of a vector column."""
        shared = dataset.sparkSession.sparkContext.broadcast((self.trees.arrays(), self.cuts))

        @F.arrow_udf("double")
        def total(rows: pa.Array) -> pa.Array:
            arrays, cuts = shared.value
            trees = Trees(*arrays)
            if not len(rows):
                return pa.array([], pa.float64())
            values = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
            bins = bins_of(values[:, : len(cuts)], cuts) if cuts else np.zeros((len(rows), 1), np.uint8)
            return pa.array(trees.sums(bins)[:, 0])

        return total(vector_to_array(F.col(features)))


def probability_of(objective: str, margin: Column) -> Column:
    """The probability of class 1 of a margin; the log-odds of first-order boosting are twice the margin."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp((-2.0 if objective == LOG_RESIDUAL else -1.0) * margin))


def with_classes(scored: DataFrame, columns: Sequence[str], raw: Column, p: str, prediction: Column, out: str) -> DataFrame:
    return scored.select(
        *[F.col(f"`{c}`") for c in columns],
        array_to_vector(F.array(-raw, raw)).alias("rawPrediction"),
        array_to_vector(F.array(F.lit(1.0) - F.col(p), F.col(p))).alias("probability"),
        prediction.alias(out),
    )


class BoostedTreesModel(Model, _BoostParams, DefaultParamsReadable, DefaultParamsWritable):
    """Boosted trees, stored as JSON."""

    trees = Param(Params._dummy(), "trees", "the trees as JSON", TypeConverters.toString)
    start = Param(Params._dummy(), "start", "the margin before the first tree", TypeConverters.toFloat)

    def __init__(self):
        super().__init__()
        self._defaults()
        # The arrays and cuts of a model just fitted; one that is read again takes them from its parameters.
        self.held: tuple[Trees, list[np.ndarray]] | None = None

    def _transform(self, dataset: DataFrame) -> DataFrame:
        get = self.getOrDefault
        sums = _Scored(*(self.held or from_dicts(get("trees")))).sums(dataset, get("featuresCol"))
        scored = dataset.withColumn("__margin", F.lit(get("start")) + sums)
        out, objective = get("predictionCol"), get("objective")
        if objective in (SQUARED, RESIDUAL):
            return scored.withColumn(out, F.col("__margin")).drop("__margin")
        scored = scored.withColumn("__p", probability_of(objective, F.col("__margin")))
        prediction = at_threshold(F.col("__p"), 0.5) if objective == LOGISTIC else F.when(F.col("__margin") > 0, 1.0).otherwise(0.0)
        return with_classes(scored, dataset.columns, F.col("__margin"), "__p", prediction, out)


class _ForestParams(_TreeParams):
    task = Param(Params._dummy(), "task", "classify (labels 0 and 1) or regress", TypeConverters.toString)
    numTrees = Param(Params._dummy(), "numTrees", "number of trees", TypeConverters.toInt)
    minRows = Param(Params._dummy(), "minRows", "least number of drawn rows of a side", TypeConverters.toFloat)
    rowSample = Param(Params._dummy(), "rowSample", "draws per row and tree", TypeConverters.toFloat)
    features = Param(Params._dummy(), "features", "features looked at per node: sqrt or all", TypeConverters.toString)

    def _defaults(self) -> None:
        self._setDefault(
            task="classify", featuresCol="features", labelCol="label", predictionCol="prediction", idCol="", numTrees=20,
            maxDepth=5, minRows=1.0, rowSample=1.0, features="sqrt", maxBins=32, seed=42,
        )


class HistogramForest(Estimator, _ForestParams, DefaultParamsReadable, DefaultParamsWritable):
    """A forest whose draws come from row ids, trees and nodes alone, so neither cores nor partitions matter."""

    @keyword_only
    def __init__(
        self,
        *,
        task=None,
        featuresCol=None,
        labelCol=None,
        predictionCol=None,
        idCol=None,
        numTrees=None,
        maxDepth=None,
        minRows=None,
        rowSample=None,
        features=None,
        maxBins=None,
        seed=None,
    ):
        super().__init__()
        self._defaults()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def forest(self, width: int, view: int = 0) -> Forest:
        get = self.getOrDefault
        if get("task") not in ("classify", "regress") or get("features") not in ("sqrt", "all"):
            raise ValueError("the task is classify or regress, the features sqrt or all")
        if get("numTrees") <= 0 or get("maxDepth") < 0 or get("rowSample") <= 0:
            raise ValueError("trees and row sample must be positive, the depth not negative")
        tries = math.ceil(math.sqrt(width)) if get("features") == "sqrt" else None
        classes = get("task") == "classify"
        return Forest(view, get("numTrees"), get("maxDepth"), get("minRows"), get("rowSample"), tries, get("seed"), classes)

    def model_of(self, trees: Trees, cuts: Sequence[np.ndarray]) -> ForestModel:
        """The model of the first trees and levels that this estimator asks for."""
        nodes = 2 ** (self.getOrDefault("maxDepth") + 1) - 1
        own = trees[: self.getOrDefault("numTrees")]
        own = Trees(*[array[:, :nodes].copy() for array in own.arrays()])
        own.feature[:, nodes // 2 :], own.bin[:, nodes // 2 :], own.missing_left[:, nodes // 2 :] = -1, 0, False
        model = ForestModel()
        self._copyValues(model)
        model.held = own, list(cuts)
        return model._set(trees=own.packed(), cuts=[";".join(map(repr, c.tolist())) for c in cuts])

    def _fit(self, dataset: DataFrame) -> ForestModel:
        self.forest(1)
        views = _one_view(self, dataset)
        trees = views.grow_forest(self.forest(len(views.cuts[0])))
        views.close()
        return self.model_of(trees, views.cuts[0])


class ForestModel(Model, _ForestParams, DefaultParamsReadable, DefaultParamsWritable):
    """A forest: means over its trees."""

    trees = Param(Params._dummy(), "trees", "the trees' arrays as text", TypeConverters.toString)
    cuts = Param(Params._dummy(), "cuts", "cut points of each feature", TypeConverters.toListString)

    def __init__(self):
        super().__init__()
        self._defaults()
        self.held: tuple[Trees, list[np.ndarray]] | None = None

    def _transform(self, dataset: DataFrame) -> DataFrame:
        get = self.getOrDefault
        stored = lambda: (Trees.unpacked(get("trees")), [np.array([float(x) for x in c.split(";") if x]) for c in get("cuts")])
        trees, cuts = self.held or stored()
        mean = _Scored(trees, cuts).sums(dataset, get("featuresCol")) / F.lit(float(len(trees)))
        scored = dataset.withColumn("__p", mean)
        out = get("predictionCol")
        if get("task") == "regress":
            return scored.withColumn(out, F.col("__p")).drop("__p")
        votes = F.col("__p") * float(len(trees))
        return with_classes(scored, dataset.columns, votes, "__p", forest_class(F.col("__p")), out)


def forest_class(p: Column) -> Column:
    """Class 1 if it has more votes than class 0."""
    return F.when(p > 0.5, 1.0).otherwise(0.0)
