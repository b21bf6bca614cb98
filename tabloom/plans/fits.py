"""A store of fits: models of one table by their stages and their choice of training rows, none fitted twice.

Choices are folds (all rows but the fold's) or holdout seeds, and all rows last.
Trees of all candidates and choices grow from rows encoded once per choice.
Fewer rounds, fewer trees and less deep forests are beginnings of longer ones,
so candidates that differ in these only share one growth. Other models are
fitted one by one on rows encoded once per choice.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import replace
from functools import partial, reduce

import numpy as np
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.numeric import at_threshold, prob_at_one
from tabloom.operators.encode import Densifier
from tabloom.plans.boost import HistogramBooster, HistogramForest, forest_class, probability_of
from tabloom.plans.encoded import Scorer, Views, encode_views, out_of_view_scores, sums_of
from tabloom.plans.levels import LOG_RESIDUAL, LOGISTIC, RESIDUAL, SQUARED, Chain, Forest, sums_bytes
from tabloom.plans.trees import Trees
from tabloom.runtime import drop_table, in_fixed_order, materialize, together

FITS_AT_ONCE = 4
# Stages that come out the same on any layout of the rows: they count, or draw rows by their ids.
ANY_LAYOUT = (StringIndexer, OneHotEncoder, VectorAssembler, Densifier, HistogramBooster, HistogramForest)
# Bytes of the sums that a task holds for boosters that share their jobs.
JOB_BYTES = 1 << 26


def signature(stage: Estimator) -> tuple:
    """What a stage does: its kind and its parameters, but not its name, which some defaults hold."""
    return type(stage).__name__, tuple(sorted((p.name, repr(v).replace(stage.uid, "")) for p, v in stage.extractParamMap().items()))


def signatures(stages: Pipeline) -> tuple:
    return tuple(map(signature, stages.getStages()))


def family(grown: Chain | Forest) -> Chain | Forest:
    """What candidates have in common that share one growth."""
    return replace(grown, rounds=0) if isinstance(grown, Chain) else replace(grown, trees=0, depth=0)


def size_of(grown: Chain | Forest) -> tuple[int, int]:
    return (grown.rounds, grown.depth) if isinstance(grown, Chain) else (grown.trees, grown.depth)


def columns_read(stages: Pipeline, columns: Sequence[str], id_col: str) -> list[str]:
    """The columns that the stages name, and the id; all where a stage is SQL, which may read any."""
    if any(isinstance(stage, SQLTransformer) for stage in stages.getStages()):
        return list(columns)
    named = {id_col}
    for value in (v for stage in stages.getStages() for v in stage.extractParamMap().values()):
        named.update([value] if isinstance(value, str) else value if isinstance(value, list) else ())
    return [c for c in columns if c in named]


def fit_in_order(stages: Pipeline, df: DataFrame, id_col: str) -> PipelineModel:
    """``stages`` fitted on rows in their fixed layout, which are exchanged once for all stages, or not at all if none sees it."""
    df = df.select(*[F.col(f"`{c}`") for c in columns_read(stages, df.columns, id_col)])
    if all(isinstance(stage, ANY_LAYOUT) for stage in stages.getStages()):
        return stages.fit(df)
    rows = in_fixed_order(df, id_col).persist()
    try:
        return stages.fit(rows)
    finally:
        rows.unpersist()


class Fits:
    """Fitted models of ``table``, which is written and has the columns that ``choices`` name."""

    def __init__(
        self, table: DataFrame, choices: Sequence[Column], id_col: str, label: str, drop: Sequence[str] = (), at_once: int = FITS_AT_ONCE,
        whole: bool = True,
    ):
        """``whole`` is False where nothing is fitted on all rows, which then are not encoded for it."""
        self.table, self.id_col, self.label, self.at_once = table, id_col, label, at_once
        self.choices = [*choices, F.lit(True)] if whole else list(choices)
        self.drop = list(drop)
        self.views: dict[tuple, Views] = {}
        self.grown: dict[tuple, Trees] = {}
        self.models: dict[tuple, PipelineModel] = {}
        self.prefixes: dict[tuple, tuple[PipelineModel, DataFrame, DataFrame]] = {}
        # Growths and single fits so far.
        self.fitted = 0

    @property
    def every(self) -> int:
        """The number of the choice of all rows."""
        return len(self.choices) - 1

    def rows(self, choice: int) -> DataFrame:
        return self.table.where(self.choices[choice]).drop(*self.drop)

    def others(self, choice: int) -> DataFrame:
        return self.table.where(~self.choices[choice]).drop(*self.drop)

    # Trees

    def _views(self, stages: Pipeline) -> tuple[tuple, Views]:
        *prefix, model = stages.getStages()
        get = model.getOrDefault
        key = (tuple(map(signature, prefix)), get("labelCol"), get("featuresCol"), get("maxBins"))
        if key not in self.views:
            self.views[key] = encode_views(self.table, self.id_col, key[1], self.choices, Pipeline(stages=prefix), key[2], key[3])
        return key, self.views[key]

    def _plan(self, stages: Pipeline, choice: int) -> tuple[tuple, Chain | Forest]:
        key, views = self._views(stages)
        model = stages.getStages()[-1]
        plan = model.chain(choice) if isinstance(model, HistogramBooster) else model.forest(len(views.cuts[choice]), choice)
        return key, plan

    def grow(self, pipelines: Sequence[Pipeline], choices: Sequence[int]) -> None:
        """Grow what these tree models need for these choices and what is not there yet, all side by side."""
        self.grow_together([(stages, choice) for stages in pipelines for choice in choices])

    def grow_together(self, wanted: Sequence[tuple[Pipeline, int]]) -> None:
        needed: dict[tuple, Chain | Forest] = {}
        for stages, choice in wanted:
            if not is_tree(stages):
                continue
            key, plan = self._plan(stages, choice)
            place = (key, family(plan))
            held = needed.get(place)
            if held is not None:
                most = tuple(map(max, size_of(held), size_of(plan)))
                plan = replace(plan, rounds=most[0]) if isinstance(plan, Chain) else replace(plan, trees=most[0], depth=most[1])
            needed[place] = plan
        missing = {p: g for p, g in needed.items() if p not in self.grown or not self._enough(self.grown[p], g)}
        # Boosters of one encoding share their jobs; these and forests run side by side.
        tasks: list[Callable[[], list[tuple[tuple, Trees]]]] = []
        chains: dict[tuple, list[tuple[tuple, Chain]]] = {}
        for place, plan in missing.items():
            if isinstance(plan, Chain):
                chains.setdefault(self._jobs_of(place[0], plan), []).append((place, plan))
            else:
                tasks.append(partial(self._one_forest, place, plan))
        jobs = [(key, own) for (key, *_), group in chains.items() for own in self._batches(key, group)]
        tasks = [partial(self._some_chains, key, own) for key, own in jobs] + tasks
        for found in together(self.table.sparkSession, tasks, 3 * self.at_once):
            self.grown.update(found)
        self.fitted += len(missing)

    def _jobs_of(self, key: tuple, plan: Chain) -> tuple:
        """Chains of the same jobs: those of one encoding, as a job has work for all cores and reads all rows, whatever the number
        of chains. A chain that has room in a task has that task, side by side with the others."""
        return key, plan if self.views[key].alone(plan) else None

    def _batches(self, key: tuple, group: list[tuple[tuple, Chain]]) -> list[list[tuple[tuple, Chain]]]:
        """Chains whose sums of a level have room in a task."""
        cuts = self.views[key].cuts
        batches: list[list[tuple[tuple, Chain]]] = []
        room = 0
        for place, plan in group:
            needs = sums_bytes(plan, cuts[plan.view])
            if not batches or needs > room:
                batches.append([])
                room = JOB_BYTES
            batches[-1].append((place, plan))
            room -= needs
        return batches

    def _enough(self, trees: Trees, plan: Chain | Forest) -> bool:
        count, depth = size_of(plan)
        return len(trees) >= count and trees.depth >= depth

    def _some_chains(self, key: tuple, own: list[tuple[tuple, Chain]]) -> list[tuple[tuple, Trees]]:
        found = self.views[key].grow([chain for _, chain in own])
        return [(place, trees) for (place, _), trees in zip(own, found, strict=True)]

    def _one_forest(self, place: tuple, plan: Forest) -> list[tuple[tuple, Trees]]:
        return [(place, self.views[place[0]].grow_forest(plan))]

    # Models

    def _key(self, stages: Pipeline, choice: int) -> tuple:
        return *map(signature, stages.getStages()), choice

    def model(self, stages: Pipeline, choice: int) -> PipelineModel:
        """The whole pipeline fitted on the rows of a choice."""
        key = self._key(stages, choice)
        if key not in self.models:
            self.models[key] = self._tree_model(stages, choice) if is_tree(stages) else self._single(stages, choice)
        return self.models[key]

    def all_models(self, pipelines: Mapping[str, Pipeline], choice: int) -> dict[str, PipelineModel]:
        self.grow(list(pipelines.values()), [choice])
        found = together(self.table.sparkSession, [partial(self.model, s, choice) for s in pipelines.values()], self.at_once)
        return dict(zip(pipelines, found, strict=True))

    def _tree_model(self, stages: Pipeline, choice: int) -> PipelineModel:
        self.grow([stages], [choice])
        key, plan = self._plan(stages, choice)
        views, trees, model = self.views[key], self.grown[key, family(plan)], stages.getStages()[-1]
        if isinstance(model, HistogramBooster):
            fitted = model.model_of(trees, views.cuts[choice], views.start(plan))
        else:
            fitted = model.model_of(trees, views.cuts[choice])
        return PipelineModel([*views.models[choice].stages, fitted])

    def _encoded(self, stages: Pipeline, choice: int) -> tuple[PipelineModel, DataFrame]:
        """The fitted stages before the model, and the choice's rows through them, written once in their fixed layout."""
        prefix = stages.getStages()[:-1]
        key = (*map(signature, prefix), choice)
        if key not in self.prefixes:
            fitted = fit_in_order(Pipeline(stages=prefix), self.rows(choice), self.id_col)
            features = stages.getStages()[-1].getOrDefault("featuresCol")
            vectors = materialize(fitted.transform(self.rows(choice)).select(self.id_col, self.label, features), "vectors")
            self.prefixes[key] = fitted, in_fixed_order(vectors, self.id_col).persist(), vectors
        return self.prefixes[key][:2]

    def release(self, choice: int) -> None:
        """Drop the encoded rows of a choice, cached and written: they are as many as the table's. A later fit encodes them anew."""
        for key in [k for k in self.prefixes if k[-1] == choice]:
            _, cached, written = self.prefixes.pop(key)
            cached.unpersist()
            drop_table(written)

    def _single(self, stages: Pipeline, choice: int) -> PipelineModel:
        prefix, vectors = self._encoded(stages, choice)
        self.fitted += 1
        return PipelineModel([*prefix.stages, stages.getStages()[-1].fit(vectors)])

    # Scores of rows outside a choice

    def out_of_choice(self, pipelines: Sequence[Pipeline], choices: Sequence[int]) -> DataFrame:
        """(position, choice, label, prediction, score) of each pipeline on the rows outside each choice: class 1's probability, or the value."""
        self.grow(pipelines, choices)
        trees = [(i, s) for i, s in enumerate(pipelines) if is_tree(s)]
        parts = self._tree_scores(trees, choices)
        singles = [(i, s) for i, s in enumerate(pipelines) if not is_tree(s)]
        # A choice at a time, so that one choice's encoded rows are held and not those of all.
        for c in choices if singles else ():
            # Encoders first, so that fits that run side by side find them.
            missing = [s for _, s in singles if self._key(s, c) not in self.models]
            together(self.table.sparkSession, [partial(self._encoded, s, c) for s in _first_of_each(missing)], self.at_once)
            parts += together(self.table.sparkSession, [partial(self._single_scores, i, s, c) for i, s in singles], self.at_once)
            self.release(c)
        return reduce(DataFrame.unionByName, parts)

    def _tree_scores(self, trees: Sequence[tuple[int, Pipeline]], choices: Sequence[int]) -> list[DataFrame]:
        by_views: dict[tuple, list[Scorer]] = {}
        kinds: dict[int, str] = {}
        for position, stages in trees:
            model = stages.getStages()[-1]
            boosted = isinstance(model, HistogramBooster)
            kinds[position] = model.getOrDefault("objective") if boosted else model.getOrDefault("task")
            for choice in choices:
                key, plan = self._plan(stages, choice)
                count, depth = size_of(plan)
                start = self.views[key].start(plan) if boosted else 0.0
                by_views.setdefault((key, choice), []).append(
                    Scorer(position, choice, self.grown[key, family(plan)], _score_of(kinds[position], start, count), count, None if boosted else depth)
                )
        # A choice at a time, so that a worker holds the trees of one choice.
        parts = [out_of_view_scores(self.views[key], own) for (key, _), own in by_views.items()]
        kind = F.create_map(*[x for p, k in kinds.items() for x in (F.lit(p), F.lit(k))]) if kinds else None
        label_type = self.table.schema[self.label].dataType
        write = lambda part: (
            materialize(
                part.select(
                    "position", F.col("view").alias("choice"), F.col("y").cast(label_type).alias(self.label),
                    F.when(kind[F.col("position")] == LOGISTIC, at_threshold(F.col("score"), 0.5))
                    .when(kind[F.col("position")].isin(SQUARED, RESIDUAL, "regress"), F.col("score"))
                    .otherwise(forest_class(F.col("score"))).alias("prediction"),
                    "score",
                ),
                "fold-predictions",
            )
        )
        return together(self.table.sparkSession, [partial(write, part) for part in parts], self.at_once)

    def predictions(self, pipelines: Sequence[Pipeline], choice: int, data: DataFrame, columns: Sequence[str]) -> DataFrame:
        """(position, columns, prediction, score) of every classifier's row of ``data``. Tree models of the same encoders go over the
        rows together: what one's trees have in common with another's is summed up once."""
        self.grow(pipelines, [choice])
        together_: dict[tuple, list[int]] = {}
        for position, stages in enumerate(pipelines):
            if is_tree(stages):
                together_.setdefault(self._plan(stages, choice)[0], []).append(position)
        parts = [self._tree_predictions(key, own, pipelines, choice, data, columns) for key, own in together_.items()]

        def single(position: int) -> DataFrame:
            scored = self.model(pipelines[position], choice).transform(data)
            return scored.select(F.lit(position).alias("position"), *columns, "prediction", prob_at_one(F.col("probability")).alias("score"))

        singles = [i for i, s in enumerate(pipelines) if not is_tree(s)]
        for position in singles[:1]:
            # Encoders first, so that fits that run side by side find them.
            parts.append(single(position))
        parts += together(self.table.sparkSession, [partial(single, i) for i in singles[1:]], self.at_once)
        return reduce(DataFrame.unionByName, parts)

    def _tree_predictions(
        self, key: tuple, positions: Sequence[int], pipelines: Sequence[Pipeline], choice: int, data: DataFrame, columns: Sequence[str]
    ) -> DataFrame:
        views, asked, of_sums = self.views[key], [], []
        for position in positions:
            model, (_, plan) = pipelines[position].getStages()[-1], self._plan(pipelines[position], choice)
            trees, (count, depth) = self.grown[key, family(plan)], size_of(plan)
            asked.append((trees, count, depth))
            raw = F.col("__sum")
            if isinstance(plan, Chain):
                margin = F.lit(views.start(plan)) + raw
                p = probability_of(plan.objective, margin)
                prediction = at_threshold(p, 0.5) if plan.objective == LOGISTIC else F.when(margin > 0, 1.0).otherwise(0.0)
            else:
                p = raw / F.lit(float(count))
                prediction = forest_class(p)
            of_sums.append(F.struct(F.lit(position).alias("position"), prediction.alias("prediction"), p.alias("score")))
        sums = sums_of(self.table.sparkSession, asked, views.cuts[choice], pipelines[positions[0]].getStages()[-1].getOrDefault("featuresCol"))
        summed = views.models[choice].transform(data).select(*columns, F.posexplode(sums).alias("__place", "__sum"))
        chosen = reduce(lambda rest, i: F.when(F.col("__place") == i, of_sums[i]).otherwise(rest), range(len(of_sums) - 1), of_sums[-1])
        return summed.select(*columns, chosen.alias("__scored")).select("__scored.position", *columns, "__scored.prediction", "__scored.score")

    def _single_scores(self, position: int, stages: Pipeline, choice: int) -> DataFrame:
        scored = self.model(stages, choice).transform(self.others(choice))
        score = prob_at_one(F.col("probability")) if "probability" in scored.columns else F.col("prediction")
        return materialize(
            scored.select(F.lit(position).alias("position"), F.lit(choice).alias("choice"), self.label, "prediction", score.alias("score")),
            "fold-predictions",
        )

    def close(self) -> None:
        for views in self.views.values():
            views.close()
        for _, vectors, _ in self.prefixes.values():
            vectors.unpersist()


def is_tree(stages: Pipeline) -> bool:
    return isinstance(stages.getStages()[-1], (HistogramBooster, HistogramForest))


def _first_of_each(pipelines: Sequence[Pipeline]) -> list[Pipeline]:
    return list({tuple(map(signature, s.getStages()[:-1])): s for s in reversed(pipelines)}.values())


def _score_of(kind: str, start: float, count: int) -> Callable[[np.ndarray], np.ndarray]:
    if kind == LOGISTIC:
        return lambda sums: 1.0 / (1.0 + np.exp(-(start + sums)))
    if kind == LOG_RESIDUAL:
        return lambda sums: 1.0 / (1.0 + np.exp(-2.0 * (start + sums)))
    if kind in (SQUARED, RESIDUAL):
        return lambda sums: start + sums
    return lambda sums: sums / count
