"""Validation, selection and ensembles. Each run leaves a score table.

Fits of one step run side by side; predictions of all folds, seeds or members
are written once and scored in one aggregate.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.numeric import prob_at_one
from tabloom.operators.folds import FOLD, holdout, holdout_choice, with_folds
from tabloom.operators.metrics import (
    SWEEP_WEIGHTS,
    blend_sweep,
    classification_scores,
    fold_mean,
    rmse,
    seed_summary,
    sweep_column,
)
from tabloom.operators.ordering import best_candidate
from tabloom.operators.rules import (
    RULE_VARIANTS,
    RuleVariant,
    apply_rules,
    attach_evidence,
    model_disagreement,
    variant_columns,
    variant_diagnostics,
    variant_rows,
)
from tabloom.operators.schema import (
    Roles,
    categorical_text,
    filter_training_outliers,
    infer_roles,
    keep_columns,
    log_target,
    not_outlier,
)
from tabloom.operators.votes import log_blend, soft_vote
from tabloom.plans import house, passenger
from tabloom.plans.fits import FITS_AT_ONCE, Fits, fit_in_order, signatures
from tabloom.plans.grids import Candidate, baseline_grid, boost_grid, gbt_grid, lr_grid, rf_grid
from tabloom.plans.stages import ALGORITHMS, house_stages
from tabloom.plans.steps import Steps
from tabloom.runtime import materialize, together
from tabloom.sources.sinks import (
    classification_output,
    regression_output,
    results_table,
    save_members,
    save_model,
    write_results,
    write_single_csv,
)

# Experiment names, file names and the name of the vote.
BASELINE, FOREST, GBT, LINEAR, BOOST, VOTE = (
    "baseline_001",
    "rf_tuned_v2",
    "gbt_v1",
    "lr_v1",
    "xgb_v1",
    "ensemble_v1",
)
POSTPROCESS = "postprocess_v1"
MODEL_EXPERIMENTS = (BASELINE, FOREST, GBT, LINEAR, BOOST, VOTE)
VOTE_MEMBERS = (FOREST, GBT, BOOST)
VOTE_NAME = "soft_vote_rf_gbt_xgb"
DISAGREEMENT_MODELS = ("rf", "gbt", "lr", "xgb")
BLEND_WEIGHT = 0.4
# End of fixed values.

ID, LABEL = passenger.ID, passenger.LABEL

def with_probability(predictions: DataFrame, out: str = "base_probability") -> DataFrame:
    return predictions.withColumn(out, prob_at_one(F.col("probability")))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


# Cross validation and selection


def folded_table(train: DataFrame, folds: int, id_col: str = ID) -> DataFrame:
    """A written table with a fold column; each fold is a partition of its own files.

    A frame that has the fold column already is taken as it is, so one written
    table can serve many experiments.
    """
    if FOLD in train.columns:
        return train
    return materialize(with_folds(train, id_col, folds), "folds", [FOLD], spread=True)


def folded_fits(train: DataFrame, folds: int, id_col: str = ID, label: str = LABEL, at_once: int = FITS_AT_ONCE) -> Fits:
    """A store of fits over folds; its last choice is all rows."""
    folded = folded_table(train, folds, id_col)
    return Fits(folded, [F.col(FOLD) != f for f in range(folds)], id_col, label, [FOLD], at_once)


def cv_scores(
    train: DataFrame,
    candidates: Sequence[Candidate],
    folds: int = 5,
    id_col: str = ID,
    label: str = LABEL,
    at_once: int = FITS_AT_ONCE,
    fits: Fits | None = None,
) -> DataFrame:
    """Accuracy and AUC per candidate and fold: (grid_pos, candidate, fold, accuracy, auc). ``fits`` is taken up if given."""
    fits = fits or folded_fits(train, folds, id_col, label, at_once)
    predictions = fits.out_of_choice([c.stages for c in candidates], range(folds))
    names = F.array(*[F.lit(c.name) for c in candidates])
    named = predictions.select(
        F.col("position").alias("grid_pos"), names[F.col("position")].alias("candidate"), F.col("choice").alias("fold"),
        F.col(label), "prediction", F.col("score").alias("probability_one"),
    )
    return classification_scores(named, label, ["grid_pos", "candidate", "fold"])


def cv_summary(fold_scores: DataFrame) -> DataFrame:
    """Mean of the folds per candidate."""
    return fold_mean(fold_scores, ["grid_pos", "candidate"], ["accuracy", "auc"])


@dataclass(frozen=True)
class Selected:
    """A chosen and refitted model with its scores and test predictions."""

    candidate: str
    accuracy: float
    auc: float
    scores: DataFrame
    model: PipelineModel
    predictions: DataFrame


def select_and_fit(
    train: DataFrame,
    test: DataFrame,
    candidates: Sequence[Candidate],
    folds: int = 5,
    at_once: int = FITS_AT_ONCE,
    fits: Fits | None = None,
) -> Selected:
    """Score all candidates, refit the best one on all rows, predict the test rows."""
    fits = fits or folded_fits(train, folds, at_once=at_once)
    scores = materialize(cv_summary(cv_scores(train, candidates, folds, fits=fits)), "scores")
    best = best_candidate(scores).first()
    model = fits.model(candidates[best["grid_pos"]].stages, fits.every)
    return Selected(best["candidate"], best["accuracy"], best["auc"], scores, model, model.transform(test))


# Soft vote


def fit_members(members: Mapping[str, Pipeline], train: DataFrame, id_col: str = ID, at_once: int = FITS_AT_ONCE) -> dict[str, PipelineModel]:
    """Every member fitted on rows in their fixed layout."""
    fitted = together(train.sparkSession, [partial(fit_in_order, s, train, id_col) for s in members.values()], at_once)
    return dict(zip(members, fitted, strict=True))


def score_members(models: Mapping[str, PipelineModel], data: DataFrame, outputs: Callable[[str], dict[str, Column]]) -> DataFrame:
    """All members' outputs side by side, from one pass over ``data``.

    Members score the same rows one after the other, so no join by id is needed.
    """
    frame, kept = data, list(data.columns)
    for name, model in models.items():
        added = outputs(name)
        frame = model.transform(frame).select(
            *[F.col(f"`{c}`") for c in kept], *[value.alias(out) for out, value in added.items()]
        )
        kept += list(added)
    return frame


def soft_vote_predict(models: Mapping[str, PipelineModel], data: DataFrame, id_col: str = ID, label: str = LABEL) -> DataFrame:
    scored = score_members(models, data, lambda name: {f"p_{name}": prob_at_one(F.col("probability"))})
    columns = [f"p_{name}" for name in models]
    return soft_vote(scored.select(*keep_columns(data, id_col, label).columns, *columns), columns)


def soft_vote_cv(
    train: DataFrame,
    test: DataFrame,
    members: Mapping[str, Pipeline],
    folds: int = 5,
    id_col: str = ID,
    label: str = LABEL,
    at_once: int = FITS_AT_ONCE,
    fits: Fits | None = None,
) -> tuple[DataFrame, dict[str, PipelineModel], DataFrame]:
    """Fold scores of the vote, the members fitted on all rows, and the test predictions."""
    fits = fits or folded_fits(train, folds, id_col, label, at_once)
    fits.grow(list(members.values()), range(folds + 1))

    def vote(fold: int) -> DataFrame:
        voted = soft_vote_predict(fits.all_models(members, fold), fits.others(fold), id_col, label)
        return materialize(voted.select(F.lit(fold).alias("fold"), label, "prediction", "probability_one"), "votes")

    parts = together(train.sparkSession, [partial(vote, f) for f in range(folds)], at_once)
    models = fits.all_models(members, fits.every)
    return classification_scores(union_all(parts), label, ["fold"]), models, soft_vote_predict(models, test, id_col, label)


# Rule variants


def variant_cv(
    train: DataFrame,
    stages: Pipeline,
    folds: int = 5,
    variants: Sequence[RuleVariant] = RULE_VARIANTS,
    at_once: int = FITS_AT_ONCE,
    fits: Fits | None = None,
) -> DataFrame:
    """Mean scores per variant. One fit per fold; evidence comes from its training rows only."""
    fits = fits or folded_fits(train, folds, at_once=at_once)
    fits.grow([stages], range(folds))

    def predict(fold: int) -> DataFrame:
        scored = with_probability(fits.model(stages, fold).transform(fits.others(fold)))
        judged = variant_rows(attach_evidence(scored, fits.rows(fold), LABEL), [LABEL], variants)
        return materialize(judged.withColumn("fold", F.lit(fold)), "variant-predictions")

    judged = union_all(together(train.sparkSession, [partial(predict, f) for f in range(folds)], at_once))
    scores = classification_scores(judged, LABEL, ["grid_pos", "variant", "fold"])
    return fold_mean(scores, ["grid_pos", "variant"], ["accuracy", "auc"])


@dataclass(frozen=True)
class Postprocessed:
    best: str
    metrics: DataFrame
    model: PipelineModel
    wide: DataFrame
    outputs: dict[str, DataFrame]
    diagnostics: DataFrame
    disagreement: DataFrame


def variant_outputs(evidenced: DataFrame, variants: Sequence[RuleVariant] = RULE_VARIANTS) -> dict[str, DataFrame]:
    """One id-and-class table per variant."""
    return {v.name: classification_output(apply_rules(evidenced, v), ID, LABEL) for v in variants}


def disagreement_of(
    models: Mapping[str, Pipeline], train: DataFrame, test: DataFrame, at_once: int = FITS_AT_ONCE, fits: Fits | None = None
) -> DataFrame:
    """How independently fitted models disagree on the test rows. A fit that fails is raised."""
    usable = fits.all_models(models, fits.every) if fits else fit_members(models, train, ID, at_once)
    outputs = lambda n: {
        f"pred_{n}": F.col("prediction").cast("int"),
        f"p_{n}": prob_at_one(F.col("probability")),
    }
    return model_disagreement(score_members(usable, test, outputs), ID)


def postprocess(
    train: DataFrame,
    test: DataFrame,
    base: Candidate,
    others: Mapping[str, Pipeline],
    folds: int = 5,
    variants: Sequence[RuleVariant] = RULE_VARIANTS,
    out_dir: str | None = None,
    model_path: str | None = None,
    fits: Fits | None = None,
    steps: Steps | None = None,
) -> Postprocessed:
    """Variant scores, the base model, all variants on the test rows, and diagnostics.

    ``others`` are the models whose disagreement is shown. Files are written if
    ``out_dir`` is given; the model if ``model_path`` is. With ``steps`` a run
    that ended half-way goes on from the tables it has written.
    """
    fits = fits or folded_fits(train, folds)
    steps = steps or Steps()
    inputs = (signatures(base.stages), tuple((n, signatures(s)) for n, s in others.items()), folds, tuple(v.name for v in variants))
    metrics = steps.table(train.sparkSession, "variant-scores", inputs, lambda: variant_cv(train, base.stages, folds, variants, fits=fits))
    fits.grow([base.stages, *others.values()], [fits.every])
    whole = fits.rows(fits.every)
    best = best_candidate(metrics).first()["variant"]
    model = fits.model(base.stages, fits.every)

    def evidence() -> DataFrame:
        scored = attach_evidence(with_probability(model.transform(test)), whole, LABEL)
        return scored.select(*[c for c in scored.columns if c not in ("rawPrediction", "probability", "features")])

    evidenced = steps.table(train.sparkSession, "evidence", inputs, evidence)
    wide = variant_columns(evidenced, variants)
    result = Postprocessed(
        best,
        metrics,
        model,
        wide,
        variant_outputs(evidenced, variants),
        variant_diagnostics(wide, ID),
        disagreement_of(others, whole, test, fits=fits),
    )
    if model_path:
        save_model(model, model_path)
    if out_dir:
        for name, table in result.outputs.items():
            write_single_csv(table, f"{out_dir}/submission_{name}.csv")
        write_single_csv(result.outputs[best], f"{out_dir}/submission.csv")
        write_single_csv(result.diagnostics, f"{out_dir}/postprocess_diagnostics.csv")
        write_single_csv(result.disagreement, f"{out_dir}/model_disagreements.csv")
        write_single_csv(metrics.orderBy("grid_pos").drop("grid_pos"), f"{out_dir}/postprocess_metrics.csv")
    return result


# Classification experiments


def default_grids(seed: int = 42) -> dict[str, list[Candidate]]:
    return {
        BASELINE: baseline_grid(seed),
        FOREST: rf_grid(seed),
        GBT: gbt_grid(seed),
        LINEAR: lr_grid(),
        BOOST: boost_grid(seed),
    }


def planned_fits(names: Sequence[str], grids: Mapping[str, Sequence[Candidate]]) -> tuple[list[Pipeline], list[Pipeline]]:
    """The pipelines that experiments on the feature set fit per fold, and those that they fit on all rows for sure."""
    per_fold, whole = [], []
    for name in names:
        if name == VOTE:
            members = [grids[m][0].stages for m in VOTE_MEMBERS]
            per_fold, whole = per_fold + members, whole + members
        elif name == POSTPROCESS:
            per_fold.append(grids[FOREST][0].stages)
            whole += [grids[m][0].stages for m in (FOREST, GBT, BOOST)]
        elif name != BASELINE and name in grids:
            per_fold += [c.stages for c in grids[name]]
    return per_fold, whole


def run_experiment(
    name: str,
    raw: tuple[DataFrame, DataFrame],
    enhanced: tuple[DataFrame, DataFrame],
    grids: Mapping[str, Sequence[Candidate]],
    folds: int = 5,
    out_dir: str | None = None,
    model_dir: str | None = None,
    fits: Fits | None = None,
) -> tuple[tuple, DataFrame]:
    """One experiment's result row and its test-side output table.

    The baseline reads the raw columns; all others read the feature set, and share the store of its fits.
    """
    model_path = f"{model_dir}/{name}" if model_dir else None
    output_path = f"{out_dir}/submission_{name}.csv" if out_dir else None
    train, test = raw if name == BASELINE else enhanced
    if name == BASELINE:
        fits = None
    elif fits is None:
        fits = folded_fits(train, folds)
    if name == POSTPROCESS:
        models = dict(zip(DISAGREEMENT_MODELS, (FOREST, GBT, LINEAR, BOOST), strict=True))
        others = {short: grids[long][0].stages for short, long in models.items()}
        done = postprocess(train, test, grids[FOREST][0], others, folds, out_dir=out_dir, model_path=model_path, fits=fits)
        row = done.metrics.where(F.col("variant") == done.best).first()
        candidate, accuracy, auc, output = done.best, row["accuracy"], row["auc"], done.outputs[done.best]
    elif name == VOTE:
        members = {m: grids[m][0].stages for m in VOTE_MEMBERS}
        scores, models, predictions = soft_vote_cv(train, test, members, folds, fits=fits)
        mean = fold_mean(scores, [], ["accuracy", "auc"]).first()
        candidate, accuracy, auc = VOTE_NAME, mean["accuracy"], mean["auc"]
        output = classification_output(predictions, ID, LABEL)
        if model_path:
            save_members(models, model_path)
    elif name in grids:
        chosen = select_and_fit(train, test, grids[name], folds, fits=fits)
        candidate, accuracy, auc = chosen.candidate, chosen.accuracy, chosen.auc
        output = classification_output(chosen.predictions, ID, LABEL)
        if model_path:
            save_model(chosen.model, model_path)
    else:
        raise ValueError(f"unknown experiment: {name}")
    if output_path:
        write_single_csv(output, output_path)
    return (name, candidate, accuracy, auc, model_path, output_path), output


def run_experiments(
    raw_train: DataFrame,
    raw_test: DataFrame,
    names: Sequence[str] = MODEL_EXPERIMENTS,
    folds: int = 5,
    grids: Mapping[str, Sequence[Candidate]] | None = None,
    out_dir: str | None = None,
    model_dir: str | None = None,
    seed: int = 42,
) -> tuple[DataFrame, DataFrame | None]:
    """Run experiments on written tables: the score table and the best output.

    The raw rows and the feature set are written once, with folds as partitions.
    A failing experiment is raised: a table with a model missing is no result.
    ``seed`` is that of the default grids.
    """
    if folds < 2:
        raise ValueError("at least 2 folds are needed")
    spark = raw_train.sparkSession
    grids = default_grids(seed) if grids is None else grids
    train, test = passenger.passenger_features(raw_train, raw_test)
    train, test, raw_train = together(
        spark,
        [
            partial(folded_table, train, folds),
            partial(materialize, test, "features"),
            partial(folded_table, raw_train, folds),
        ],
    )
    raw, enhanced = (raw_train, raw_test), (train, test)
    # All trees that any experiment needs grow at once: each candidate's folds, and those that are fitted on all rows.
    fits = folded_fits(train, folds)
    needed, refitted = planned_fits(names, grids)
    fits.grow(needed, range(folds))
    fits.grow(refitted, [fits.every])
    rows: list[tuple] = []
    outputs: dict[str, DataFrame] = {}
    for name in names:
        row, outputs[name] = run_experiment(name, raw, enhanced, grids, folds, out_dir, model_dir, fits)
        rows.append(row)
    table = write_results(spark, rows, f"{out_dir}/experiments.csv") if out_dir else results_table(spark, rows)
    if not rows:
        return table, None
    best = min(range(len(rows)), key=lambda i: (-rows[i][2], -rows[i][3], i))
    chosen = outputs[rows[best][0]]
    if out_dir:
        write_single_csv(chosen, f"{out_dir}/submission.csv")
    return table, chosen


# Regression


@dataclass(frozen=True)
class Prepared:
    train: DataFrame
    test: DataFrame | None
    roles: Roles


def prepare_houses(train: DataFrame, test: DataFrame | None = None, advanced: bool = False) -> Prepared:
    """Derived columns, log target, roles and text categories."""
    ready = log_target(house.house_features(train, advanced), house.TARGET, house.LABEL)
    roles = infer_roles(ready, house.ID, (house.TARGET, house.LABEL), house.FORCED_CATEGORICAL)
    ready_test = None
    if test is not None:
        ready_test = categorical_text(house.house_features(test, advanced), roles.categorical)
    return Prepared(categorical_text(ready, roles.categorical), ready_test, roles)


def seed_choices(prepared: Prepared, seeds: Sequence[int], remove_outliers: bool) -> list[tuple[Column, Column]]:
    """Which rows train under each holdout seed, and which validate."""
    inside = [holdout_choice(seed, house.ID) for seed in seeds]
    usable = not_outlier(prepared.train, house.AREA, house.TARGET) if remove_outliers else F.lit(True)
    return [(i & usable, ~i) for i in inside]


def validate_seeds(
    prepared: Prepared,
    algorithm: str = "lr",
    seeds: Sequence[int] = (42,),
    remove_outliers: bool = False,
    by_partition: bool = False,
    at_once: int = FITS_AT_ONCE,
    **settings,
) -> DataFrame:
    """Log-RMSE per holdout seed. The model keeps its own seed; only the split varies."""
    stages = house_stages(prepared.roles, algorithm, **settings)
    table = prepared.train if by_partition else materialize(prepared.train, "houses")

    def split(position: int) -> tuple[DataFrame, DataFrame]:
        if not by_partition:
            return table.where(choices[position][0]), table.where(choices[position][1])
        training, validation = holdout(table, seeds[position], house.ID, by_partition=True)
        return filter_training_outliers(training, house.AREA, house.TARGET, enabled=remove_outliers), validation

    choices = seed_choices(prepared, seeds, remove_outliers)
    fits = None
    if not by_partition and algorithm != "lr":
        fits = Fits(table, [inside for inside, _ in choices], house.ID, house.LABEL, at_once=at_once, whole=False)
        fits.grow([stages], range(len(seeds)))

    def predict(position: int) -> DataFrame:
        training, validation = split(position)
        model = fits.model(stages, position) if fits else fit_in_order(stages, training, house.ID)
        scored = model.transform(validation)
        return materialize(scored.select(F.lit(seeds[position]).alias("seed"), house.LABEL, "prediction"), "seed-predictions")

    parts = together(prepared.train.sparkSession, [partial(predict, i) for i in range(len(seeds))], at_once)
    return rmse(union_all(parts), house.LABEL, "prediction", ["seed"], "log_rmse")


def blend_validate(
    prepared: Prepared,
    seeds: Sequence[int] = (42,),
    weights: Sequence[float] = SWEEP_WEIGHTS,
    remove_outliers: bool = False,
    at_once: int = FITS_AT_ONCE,
    **settings,
) -> DataFrame:
    """RMSE of every blend weight per seed. Both the split and the models use the seed; all seeds' boosters grow in the same jobs."""
    table = materialize(prepared.train, "houses")
    choices = seed_choices(prepared, seeds, remove_outliers)
    boosters = [house_stages(prepared.roles, "xgb", **{**settings, "seed": seed}) for seed in seeds]
    lines = [house_stages(prepared.roles, "lr", **{**settings, "seed": seed}) for seed in seeds]
    fits = Fits(table, [inside for inside, _ in choices], house.ID, house.LABEL, at_once=at_once, whole=False)
    fits.grow_together([(stages, position) for position, stages in enumerate(boosters)])

    def predict(position: int) -> DataFrame:
        line = fit_in_order(lines[position], table.where(choices[position][0]), house.ID)
        models = {"lr": line, "xgb": fits.model(boosters[position], position)}
        scored = score_members(models, table.where(choices[position][1]), lambda name: {f"{name}_prediction": F.col("prediction")})
        return materialize(
            scored.select(F.lit(seeds[position]).alias("seed"), house.LABEL, "lr_prediction", "xgb_prediction"), "blends"
        )

    parts = together(prepared.train.sparkSession, [partial(predict, i) for i in range(len(seeds))], at_once)
    return blend_sweep(union_all(parts), "lr_prediction", "xgb_prediction", house.LABEL, weights, ["seed"])


def blend_summary(swept: DataFrame, weights: Sequence[float] = SWEEP_WEIGHTS) -> DataFrame:
    """Mean and population spread over seeds, one row per weight."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(w).alias("weight"), F.col(sweep_column(w)).alias("rmse")) for w in weights])
    )
    return seed_summary(swept.select(pairs.alias("s")).select("s.*"), "rmse", ["weight"])


def _fit_pair(roles: Roles, training: DataFrame, **settings) -> dict[str, PipelineModel]:
    return fit_members({a: house_stages(roles, a, **settings) for a in ("lr", "xgb")}, training, house.ID, 2)


@dataclass(frozen=True)
class Regression:
    scores: DataFrame
    summary: DataFrame
    models: dict[str, PipelineModel]
    output: DataFrame | None


def run_regression(
    train: DataFrame,
    test: DataFrame,
    algorithm: str = "lr",
    seeds: Sequence[int] = (),
    advanced: bool = False,
    remove_outliers: bool = False,
    validation_only: bool = False,
    blend_weight: float = BLEND_WEIGHT,
    model_path: str | None = None,
    output_path: str | None = None,
    seed: int = 42,
    **settings,
) -> Regression:
    """Validate over holdout seeds, then fit on all rows and predict the test rows.

    ``algorithm`` is one of the four regressors, or ``ensemble`` for the blend.
    """
    if algorithm not in (*ALGORITHMS, "ensemble"):
        raise ValueError(f"unknown algorithm: {algorithm}")
    if not 0.0 <= blend_weight <= 1.0:
        raise ValueError("the blend weight must be between 0 and 1")
    prepared = prepare_houses(train, test, advanced)
    settings = {**settings, "seed": seed}
    seeds = list(seeds) or [seed]
    if algorithm == "ensemble":
        scores = blend_validate(prepared, seeds, remove_outliers=remove_outliers, **settings)
        summary = blend_summary(scores)
    else:
        scores = validate_seeds(prepared, algorithm, seeds, remove_outliers, **settings)
        summary = seed_summary(scores, "log_rmse")
    if validation_only:
        return Regression(scores, summary, {}, None)
    full = filter_training_outliers(prepared.train, house.AREA, house.TARGET, enabled=remove_outliers)
    if algorithm == "ensemble":
        models = _fit_pair(prepared.roles, full, **settings)
        scored = score_members(models, prepared.test, lambda name: {f"{name}_prediction": F.col("prediction")})
        predicted = log_blend(scored, "lr_prediction", "xgb_prediction", blend_weight)
    else:
        models = {algorithm: fit_in_order(house_stages(prepared.roles, algorithm, **settings), full, house.ID)}
        predicted = models[algorithm].transform(prepared.test)
    output = regression_output(predicted, house.ID, house.TARGET)
    if model_path:
        if len(models) > 1:
            save_members(models, model_path)
        else:
            save_model(models[algorithm], model_path)
    if output_path:
        write_single_csv(output, output_path)
    return Regression(scores, summary, models, output)
