"""Fits. Their exact output is no SQL matter, so most have no twin.

The data are always whole, and so are grids, folds, rounds and seeds: they are the library's own (the README
says how long they take, as far as measured).
"""

from __future__ import annotations

from functools import partial

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tabloom.catalog.base import features, fold_sql, from_houses, from_passengers, register, written_features
from tabloom.functions.numeric import prob_at_one
from tabloom.operators.folds import holdout, with_folds
from tabloom.plans import experiments as ex
from tabloom.plans import grids, house, views
from tabloom.plans.boost import best_splits, histogram
from tabloom.plans.fits import Fits, fit_in_order
from tabloom.plans.stages import baseline_stages, house_stages
from tabloom.runtime import materialize, together
from tabloom.sources.sinks import classification_output

FOLDS, SEEDS = 5, (42, 1337, 2026)


def _predict(spark, sf_dir, stages):
    """Fit on the labelled rows, predict the others."""
    train, test = written_features(spark, sf_dir)
    scored = fit_in_order(stages, train, ex.ID).transform(test)
    return scored.select("PassengerId", "prediction", prob_at_one(F.col("probability")).alias("p"))


def _predict_all(spark, sf_dir, candidates):
    """Every candidate of a grid, fitted on the labelled rows; its predictions of the others. Candidates share what they can."""
    train, test = written_features(spark, sf_dir)
    fits = Fits(train, [], ex.ID, ex.LABEL)
    scored = fits.predictions([c.stages for c in candidates], fits.every, test, ["PassengerId"])
    names = F.array(*[F.lit(c.name) for c in candidates])
    named = F.col("position").alias("grid_pos"), names[F.col("position")].alias("candidate")
    return scored.select(*named, "PassengerId", "prediction", F.col("score").alias("p"))


@register("pipe_tree")
def pipe_tree(spark, sf_dir):
    return _predict(spark, sf_dir, grids.rf_grid()[0].stages)


@register("pipe_linear")
def pipe_linear(spark, sf_dir):
    return _predict(spark, sf_dir, grids.lr_grid()[0].stages)


@register("pipe_boost")
def pipe_boost(spark, sf_dir):
    return _predict(spark, sf_dir, grids.boost_grid()[0].stages)


def _baseline(spark, sf_dir, stages):
    train, test = views.passenger_sides(spark, sf_dir, dealt=True)
    scored = fit_in_order(stages, materialize(train, "labelled"), ex.ID).transform(test)
    return scored.select("PassengerId", "prediction", prob_at_one(F.col("probability")).alias("p"))


@register("pipe_baseline")
def pipe_baseline(spark, sf_dir):
    return _baseline(spark, sf_dir, baseline_stages(42))


@register("rf_class_baseline")
def rf_class_baseline(spark, sf_dir):
    return _baseline(spark, sf_dir, grids.baseline_grid()[0].stages)


@register("rf_class_grid")
def rf_class_grid(spark, sf_dir):
    return _predict_all(spark, sf_dir, grids.rf_grid())


@register("gbt_class_grid")
def gbt_class_grid(spark, sf_dir):
    return _predict_all(spark, sf_dir, grids.gbt_grid())


@register("lr_class_grid")
def lr_class_grid(spark, sf_dir):
    return _predict_all(spark, sf_dir, grids.lr_grid())


@register("boost_class_grid")
def boost_class_grid(spark, sf_dir):
    return _predict_all(spark, sf_dir, grids.boost_grid())


# Models of a planted target, which SQL can state: every kind of classifier must find the rule.
PLANTED_CLASS = """SELECT PassengerId, unnest(['forest', 'residuals', 'second_order', 'linear']) AS model,
  CASE WHEN Sex = 'female' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prediction FROM p WHERE Survived IS NULL"""


@register("planted_class", from_passengers(PLANTED_CLASS))
def planted_class(spark, sf_dir):
    """The first candidates of all grids, fitted on labels that are a function of one category, on the unlabelled rows."""
    train, test = features(spark, sf_dir)
    train = materialize(train.withColumn(ex.LABEL, F.when(F.col("Sex") == "female", 1).otherwise(0)), "planted")
    firsts = {
        "forest": grids.rf_grid()[0], "residuals": grids.gbt_grid()[0], "second_order": grids.boost_grid()[0], "linear": grids.lr_grid()[0],
    }
    fits = Fits(train, [], ex.ID, ex.LABEL)
    models = fits.all_models({name: c.stages for name, c in firsts.items()}, fits.every)
    test = materialize(test, "features")
    scored = [m.transform(test).select("PassengerId", F.lit(name).alias("model"), "prediction") for name, m in models.items()]
    return ex.union_all(scored)


PLANTED_PRICE = """SELECT Id, unnest(['gbt', 'xgb']) AS model, round(ln(1 + 50000.0::DOUBLE * OverallQual), 2) AS prediction FROM h"""


@register("planted_price", from_houses(PLANTED_PRICE))
def planted_price(spark, sf_dir):
    """Both boosters, fitted on prices that are a function of one number, on all rows."""
    rows = views.houses(spark, sf_dir, dealt=True).withColumn("SalePrice", F.col("OverallQual") * 50000.0)
    prepared = ex.prepare_houses(rows)
    table = materialize(prepared.train, "planted", spread=True)
    fits = Fits(table, [], house.ID, house.LABEL)
    settings = {"gbt": {"iterations": 100}, "xgb": {"rounds": 60, "eta": 0.3}}
    models = fits.all_models({a: house_stages(prepared.roles, a, **s) for a, s in settings.items()}, fits.every)
    scored = [m.transform(table).select("Id", F.lit(a).alias("model"), F.round("prediction", 2).alias("prediction")) for a, m in models.items()]
    return ex.union_all(scored)


def _price(spark, sf_dir, algorithm, **settings):
    """Fit on a holdout's training rows, predict its validation rows."""
    prepared = ex.prepare_houses(views.houses(spark, sf_dir, dealt=True))
    train, validation = holdout(materialize(prepared.train, "houses", spread=True), 42, house.ID)
    model = fit_in_order(house_stages(prepared.roles, algorithm, **settings), train, house.ID)
    return model.transform(validation).select("Id", house.LABEL, "prediction")


@register("pipe_house")
def pipe_house(spark, sf_dir):
    return _price(spark, sf_dir, "rf", seed=7)


@register("lr_reg")
def lr_reg(spark, sf_dir):
    return _price(spark, sf_dir, "lr")


@register("rf_reg")
def rf_reg(spark, sf_dir):
    return _price(spark, sf_dir, "rf")


@register("gbt_reg")
def gbt_reg(spark, sf_dir):
    return _price(spark, sf_dir, "gbt")


@register("boost_reg")
def boost_reg(spark, sf_dir):
    return _price(spark, sf_dir, "xgb")


@register(
    "lr_reg_line",
    from_houses(
        "SELECT round(regr_slope(SalePrice / 1000, GrLivArea), 4) AS slope, round(regr_intercept(SalePrice / 1000, GrLivArea), 4) AS intercept FROM h"
    ),
)
def lr_reg_line(spark, sf_dir):
    """Without penalty and with one feature, the fit is the least-squares line."""
    rows = views.houses(spark, sf_dir).select((F.col("SalePrice") / 1000).alias("y"), "GrLivArea")
    vectors = VectorAssembler(inputCols=["GrLivArea"], outputCol="features").transform(rows)
    model = LinearRegression(labelCol="y", solver="normal").fit(vectors)
    fitted = vectors.select(
        F.lit(float(model.coefficients[0])).alias("slope"), F.lit(float(model.intercept)).alias("intercept")
    ).distinct()
    return fitted.select(*[F.round(c, 4).alias(c) for c in ("slope", "intercept")])


SPLIT_SQL = """, rows AS (
  SELECT MoSold % 2 AS node, 250000.0::DOUBLE - SalePrice AS g, 1.0::DOUBLE AS h,
    [OverallQual - 1, CAST(GrLivArea // 250 AS INT), FullBath, coalesce(CAST(TotalBsmtSF // 100 AS INT), -1)] AS bins FROM h
),
hist AS (
  SELECT node, feature, bin, sum(g) AS g, sum(h) AS h FROM (
    SELECT node, g, h, unnest([0, 1, 2, 3]) AS feature, unnest(bins) AS bin FROM rows) GROUP BY ALL
),
cum AS (
  SELECT node, feature, bin,
    sum(g) OVER (PARTITION BY node, feature) AS ga, sum(h) OVER (PARTITION BY node, feature) AS ha,
    sum(CASE WHEN bin < 0 THEN g ELSE 0 END) OVER (PARTITION BY node, feature) AS gm,
    sum(CASE WHEN bin < 0 THEN h ELSE 0 END) OVER (PARTITION BY node, feature) AS hm,
    sum(CASE WHEN bin >= 0 THEN g ELSE 0 END) OVER (PARTITION BY node, feature ORDER BY bin) AS gk,
    sum(CASE WHEN bin >= 0 THEN h ELSE 0 END) OVER (PARTITION BY node, feature ORDER BY bin) AS hk
  FROM hist
),
options AS (
  SELECT node, feature, bin, false AS missing_left, gk AS gl, hk AS hl, ga, ha FROM cum WHERE bin >= 0
  UNION ALL SELECT node, feature, bin, true, gk + gm, hk + hm, ga, ha FROM cum WHERE bin >= 0
),
gains AS (
  SELECT *, (gl * gl / (hl + 1) + (ga - gl) * (ga - gl) / (ha - hl + 1) - ga * ga / (ha + 1)) / 2 AS gain
  FROM options WHERE hl >= 1 AND ha - hl >= 1
)
SELECT CAST(node AS INT) AS node, CAST(feature AS INT) AS feature, CAST(bin AS INT) AS bin, missing_left,
  round(gain / 1e9, 6) AS gain FROM gains WHERE gain > 0
QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, feature, bin, missing_left) = 1"""


@register("boost_split", from_houses(SPLIT_SQL))
def boost_split(spark, sf_dir):
    """The best split of two nodes from given bins; a missing area has bin -1."""
    rows = views.houses(spark, sf_dir).select(
        (F.col("MoSold") % 2).alias("node"),
        (F.lit(250000.0) - F.col("SalePrice")).alias("g"),
        F.lit(1.0).alias("h"),
        F.array(
            F.col("OverallQual") - 1,
            F.floor(F.col("GrLivArea") / 250).cast("int"),
            F.col("FullBath"),
            F.coalesce(F.floor(F.col("TotalBsmtSF") / 100).cast("int"), F.lit(-1)),
        ).alias("bins"),
    )
    best = best_splits(histogram(rows, [0, 1, 2, 3]))
    return best.select("node", "feature", "bin", "missing_left", F.round(F.col("gain") / 1e9, 6).alias("gain"))


@register(
    "hash_fold",
    from_passengers(f", {fold_sql('p', 'PassengerId', 5)} SELECT PassengerId, fold FROM folded"),
)
def hash_fold(spark, sf_dir):
    return with_folds(views.passengers(spark, sf_dir).select("PassengerId"), "PassengerId", 5, "fold")


@register("cv_score")
def cv_score(spark, sf_dir):
    train, _ = written_features(spark, sf_dir)
    return ex.cv_scores(train, grids.lr_grid(), FOLDS)


@register("grid_select_fit")
def grid_select_fit(spark, sf_dir):
    train, test = written_features(spark, sf_dir)
    chosen = ex.select_and_fit(train, test, grids.rf_grid(), FOLDS)
    return classification_output(chosen.predictions, ex.ID, ex.LABEL).withColumn("candidate", F.lit(chosen.candidate))


@register("random_holdout")
def random_holdout(spark, sf_dir):
    rows = views.houses(spark, sf_dir).select("Id")
    train, validation = holdout(rows, 42, "Id")
    return train.withColumn("validates", F.lit(False)).unionByName(validation.withColumn("validates", F.lit(True)))


@register("multi_seed_validation")
def multi_seed_validation(spark, sf_dir):
    prepared = ex.prepare_houses(views.houses(spark, sf_dir, dealt=True))
    return ex.validate_seeds(prepared, "lr", SEEDS)


@register("soft_vote_cv")
def soft_vote_cv(spark, sf_dir):
    train, test = written_features(spark, sf_dir)
    members = {m: ex.default_grids()[m][0].stages for m in ex.VOTE_MEMBERS}
    scores, _, _ = ex.soft_vote_cv(train, test, members, FOLDS)
    return scores


@register("blend_validation")
def blend_validation(spark, sf_dir):
    prepared = ex.prepare_houses(views.houses(spark, sf_dir, dealt=True))
    return ex.blend_summary(ex.blend_validate(prepared, SEEDS))


@register("experiment_table")
def experiment_table(spark, sf_dir):
    raw = views.passenger_sides(spark, sf_dir, dealt=True)
    table, _ = ex.run_experiments(*raw, folds=FOLDS)
    return table.drop("model_path", "submission_path")


@register("variant_cv")
def variant_cv(spark, sf_dir):
    train, _ = written_features(spark, sf_dir)
    return ex.variant_cv(train, grids.rf_grid()[0].stages, FOLDS)


@register("postprocess_run")
def postprocess_run(spark, sf_dir):
    train, test = written_features(spark, sf_dir)
    models = zip(ex.DISAGREEMENT_MODELS, (ex.FOREST, ex.GBT, ex.LINEAR, ex.BOOST), strict=True)
    others = {short: ex.default_grids()[long][0].stages for short, long in models}
    return ex.postprocess(train, test, grids.rf_grid()[0], others, FOLDS).diagnostics
