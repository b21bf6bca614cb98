"""Properties of fits, boosting against brute force, and whole experiment runs."""

import json
import math
import random

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tabloom.operators.folds import holdout
from tabloom.operators.metrics import rmse
from tabloom.plans import experiments as ex
from tabloom.plans import grids, house, passenger, views
from tabloom.plans.boost import BoostedTreesModel, HistogramBooster, best_splits, histogram
from tabloom.plans.stages import baseline_stages, boost_stages, house_stages, linear_stages
from tabloom.runtime import materialize
from tabloom.sources.sinks import load_model, save_model, write_results, write_single_csv
from tabloom.sources.tables import read_pair, read_table
from tests.harness import DATA

SF = str(DATA / "sf0.001")


@pytest.fixture(scope="module")
def sides(spark):
    train, test = passenger.passenger_features(*views.passenger_sides(spark, SF))
    return materialize(train, "t", spread=True), materialize(test, "t", spread=True)


def tiny_grids():
    return {
        ex.BASELINE: [grids.Candidate("baseline", baseline_stages(42, 3, 3))],
        ex.FOREST: [grids.Candidate("rf_3", grids.forest(42, 3, 3, 1, 0.8)), grids.Candidate("rf_4", grids.forest(42, 4, 3, 1, 0.8))],
        ex.GBT: [grids.Candidate("gbt", grids.boosted_mllib(42, 2, 2, 0.1))],
        ex.LINEAR: [grids.Candidate("lr", grids.logistic(0.1, 0.5))],
        ex.BOOST: [grids.Candidate("xgb", grids.boosted(42, 1, 0.3, 1))],
    }


@pytest.fixture(scope="module")
def houses(spark):
    return ex.prepare_houses(views.houses(spark, SF))


# Boosting


def brute_split(rows, reg=1.0, least=1.0):
    """Best (gain, feature, bin, missing_left) by trying every split."""
    best = None
    g_all, h_all = sum(r["g"] for r in rows), sum(r["h"] for r in rows)
    for feature in range(len(rows[0]["bins"])):
        for cut in sorted({r["bins"][feature] for r in rows} - {-1}):
            for missing_left in (False, True):
                left = [r for r in rows if (r["bins"][feature] <= cut if r["bins"][feature] >= 0 else missing_left)]
                g, h = sum(r["g"] for r in left), sum(r["h"] for r in left)
                if h < least or h_all - h < least:
                    continue
                gain = 0.5 * (g * g / (h + reg) + (g_all - g) ** 2 / (h_all - h + reg) - g_all**2 / (h_all + reg))
                key = (gain, -feature, -cut, not missing_left)
                if gain > 0 and (best is None or key > best):
                    best = key
    return best


@pytest.mark.parametrize("seed", range(3))
def test_split_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [
        {"node": 1 + (i % 2), "g": float(rng.randrange(-20, 20)), "h": 1.0, "bins": [rng.randrange(-1, 6) for _ in range(4)]}
        for i in range(120)
    ]
    df = spark.createDataFrame(rows, "node int, g double, h double, bins array<int>").repartition(3)
    got = {r["node"]: r for r in best_splits(histogram(df, range(4))).collect()}
    for node in (1, 2):
        gain, feature, cut, missing_right = brute_split([r for r in rows if r["node"] == node])
        found = got[node]
        assert found["gain"] == pytest.approx(gain)
        assert (found["feature"], found["bin"], found["missing_left"]) == (-feature, -cut, not missing_right)


def planted(spark, n=600):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        a, b = rng.random() * 10, rng.choice([0.0, 1.0, math.nan])
        y = (3.0 if a > 4 else 0.0) + (2.0 if math.isnan(b) else b)
        rows.append((i, Vectors.dense(a, b, 7.0), y, float(y > 2.5)))
    return spark.createDataFrame(rows, ["id", "features", "y", "c"])


def test_boosting_finds_planted_steps_and_missing_values(spark):
    df = planted(spark)
    model = HistogramBooster(labelCol="y", idCol="id", rounds=9, eta=0.7, maxDepth=3, regLambda=0.0, writeEvery=4).fit(df)
    assert rmse(model.transform(df), "y", "prediction").first()["rmse"] < 0.15
    assert model.transform(df).count() == 600


def test_more_rounds_never_raise_the_training_loss(spark):
    df = planted(spark)
    model = HistogramBooster(labelCol="y", idCol="id", rounds=5, eta=0.3, maxDepth=2, writeEvery=2).fit(df)
    trees = json.loads(model.getOrDefault("trees"))
    losses = []
    for n in range(1, 6):
        part = BoostedTreesModel()
        model._copyValues(part)
        part._set(trees=json.dumps(trees[:n]), start=model.getOrDefault("start"))
        losses.append(rmse(part.transform(df), "y", "prediction").first()["rmse"])
    assert losses == sorted(losses, reverse=True)


def test_logistic_boosting_gives_probabilities(spark):
    df = planted(spark)
    model = HistogramBooster(objective="logistic", labelCol="c", idCol="id", rounds=3, eta=0.7, maxDepth=3).fit(df)
    scored = ex.with_probability(model.transform(df), "p")
    row = scored.agg(F.min("p").alias("lo"), F.max("p").alias("hi"), F.avg((F.col("prediction") == F.col("c")).cast("int")).alias("hit")).first()
    assert 0.0 <= row["lo"] < row["hi"] <= 1.0 and row["hit"] > 0.95


def test_samples_do_not_depend_on_partitions(spark):
    df = planted(spark)
    settings = dict(labelCol="y", idCol="id", rounds=3, maxDepth=2, rowSample=0.7, columnSample=0.67)
    first, second = (HistogramBooster(**settings).fit(d) for d in (df.repartition(2), df.repartition(5)))
    splits = [[(t["feature"], t["bin"]) for t in json.loads(m.getOrDefault("trees"))] for m in (first, second)]
    assert splits[0] == splits[1]


def test_booster_rejects_bad_settings(spark):
    for bad in ({"rounds": 0}, {"eta": 0.0}, {"objective": "other"}):
        with pytest.raises(ValueError):
            HistogramBooster(labelCol="y", **bad).fit(planted(spark, 20))


# Stages


def test_stored_models_give_the_same_predictions(spark, sides, tmp_path):
    train, test = sides
    stages = boost_stages(
        HistogramBooster(objective="logistic", labelCol="Survived", idCol="PassengerId", rounds=2, maxDepth=2)
    )
    for name, fitted in (("boost", stages.fit(train)), ("linear", linear_stages(LogisticRegression(labelCol="Survived", maxIter=5)).fit(train))):
        again = load_model(save_model(fitted, str(tmp_path / name)))
        assert isinstance(again, PipelineModel)
        first, second = (ex.with_probability(m.transform(test), "p").select("PassengerId", "p") for m in (fitted, again))
        assert first.exceptAll(second).count() == 0 and first.count() == test.count()


def test_baseline_predicts_each_id_once(spark):
    train, test = views.passenger_sides(spark, SF)
    scored = baseline_stages(1, 5, 3).fit(train).transform(test)
    assert scored.count() == test.count() == scored.select("PassengerId").distinct().count()


@pytest.mark.parametrize("algorithm,settings,limit", [("lr", {}, 0.12), ("xgb", {"rounds": 8, "eta": 0.4, "depth": 3}, 0.15), ("rf", {"trees": 20}, 0.3), ("gbt", {"iterations": 8, "depth": 3}, 0.3)])
def test_regressors_learn_the_planted_price(spark, houses, algorithm, settings, limit):
    train, rest = holdout(houses.train, 42, house.ID)
    model = house_stages(houses.roles, algorithm, **settings).fit(train)
    assert rmse(model.transform(rest), house.LABEL, "prediction").first()["rmse"] < limit


def test_bad_settings_are_refused(houses):
    for algorithm, settings in (("other", {}), ("rf", {"max_bins": 16}), ("rf", {"colour": 1})):
        with pytest.raises(ValueError):
            house_stages(houses.roles, algorithm, **settings)


def test_grid_sizes_and_names(spark):
    assert [len(g) for g in ex.default_grids().values()] == [1, 24, 18, 9, 12]
    assert grids.rf_grid()[0].name == "rf_trees_300_depth_5_min_1_sub_0.8"
    assert grids.gbt_grid()[-1].name == "gbt_iter_150_depth_4_step_0.1"
    assert grids.lr_grid()[1].name == "lr_reg_0.01_elastic_0.5"
    assert grids.boost_grid()[1].name == "xgb_round_200_depth_2_eta_0.03"


# Feature scope


def test_statistics_of_train_rows_only(spark):
    train, test = views.passenger_sides(spark, SF)
    both, _ = passenger.passenger_features(train, test)
    own, _ = passenger.passenger_features(train, test, scope="train")
    sums = [d.agg(F.sum("TicketGroupSize")).first()[0] for d in (both, own)]
    assert sums[0] > sums[1]
    with pytest.raises(ValueError):
        passenger.passenger_features(train, test, scope="other")


# Experiments


def test_fold_scores_and_selection(spark, sides):
    train, test = sides
    candidates = tiny_grids()[ex.FOREST]
    scores = ex.cv_scores(train, candidates, 2)
    assert scores.count() == 4
    assert scores.where("accuracy < 0 OR accuracy > 1 OR auc < 0 OR auc > 1").count() == 0
    chosen = ex.select_and_fit(train, test, candidates, 2)
    assert chosen.candidate in {c.name for c in candidates} and chosen.predictions.count() == test.count()


def test_all_experiments_write_their_files(spark, tmp_path):
    raw = views.passenger_sides(spark, SF)
    grid = tiny_grids()
    out = str(tmp_path / "out")
    table, best = ex.run_experiments(*raw, folds=2, grids=grid, out_dir=out, model_dir=str(tmp_path / "models"))
    rows = {r["experiment"]: r for r in table.collect()}
    assert set(rows) == set(ex.MODEL_EXPERIMENTS) and rows[ex.VOTE]["candidate"] == ex.VOTE_NAME
    stored = read_table(spark, f"{out}/submission.csv")
    assert stored.columns == ["PassengerId", "Survived"] and stored.count() == raw[1].count()
    assert read_table(spark, f"{out}/experiments.csv").count() == 6
    assert (tmp_path / "models" / f"{ex.VOTE}_{ex.BOOST}").exists()


def test_a_failing_experiment_is_raised(spark):
    raw = views.passenger_sides(spark, SF)
    broken = boost_stages(HistogramBooster(objective="logistic", labelCol="no such column"))
    bad = {**tiny_grids(), ex.BOOST: [grids.Candidate("broken", broken)]}
    with pytest.raises(Exception):
        ex.run_experiments(*raw, names=(ex.LINEAR, ex.BOOST), folds=2, grids=bad)
    with pytest.raises(Exception):
        ex.disagreement_of({"xgb": broken}, *raw)
    with pytest.raises(ValueError):
        ex.run_experiments(*raw, folds=1)


def test_postprocess_writes_all_outputs(spark, sides, tmp_path):
    train, test = sides
    grid = tiny_grids()
    out = str(tmp_path / "post")
    done = ex.postprocess(train, test, grid[ex.FOREST][0], {"lr": grid[ex.LINEAR][0].stages}, 2, out_dir=out)
    assert done.metrics.count() == 7 and done.best in set(done.outputs)
    plain = [r["auc"] for r in done.metrics.where("variant LIKE '%threshold%'").collect()]
    assert len(set(plain)) == 1
    assert read_table(spark, f"{out}/postprocess_diagnostics.csv").count() == test.count()
    disagreement = read_table(spark, f"{out}/model_disagreements.csv")
    assert "pred_lr" in disagreement.columns and "pred_xgb" not in disagreement.columns


def test_regression_run(spark, tmp_path):
    rows = views.houses(spark, SF)
    train, test = holdout(rows, 99, "Id")
    path = str(tmp_path / "houses.csv")
    done = ex.run_regression(
        train, test.drop("SalePrice"), "ensemble", (42, 7), output_path=path, model_path=str(tmp_path / "m"),
        rounds=2, eta=0.5, depth=2, iterations=10, remove_outliers=True,
    )
    assert done.scores.count() == 2 and done.summary.count() == 6
    stored = read_table(spark, path)
    assert stored.columns == ["Id", "SalePrice"] and stored.count() == test.count()
    assert stored.where("SalePrice < 0").count() == 0
    single = ex.run_regression(train, test.drop("SalePrice"), "lr", iterations=10, validation_only=True)
    assert single.output is None and single.summary.count() == 0 and single.scores.count() == 1
    with pytest.raises(ValueError):
        ex.run_regression(train, test, "other")


# Sources and sinks


def test_one_schema_for_both_files(spark, tmp_path):
    write_single_csv(spark.createDataFrame([(1, 20, 0), (2, 30, 1)], "id int, kind int, y int"), str(tmp_path / "a.csv"))
    (tmp_path / "b.csv").write_text("id,kind\n3,NA\n")
    train, test = read_pair(spark, str(tmp_path / "a.csv"), str(tmp_path / "b.csv"), "y", null_value="NA")
    assert test.columns == ["id", "kind"] and test.first()["kind"] is None
    assert dict(test.dtypes)["kind"] == dict(train.dtypes)["kind"] == "int"


def test_marker_keeps_numbers_numeric(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,v\n1,NA\n2,3.5\n")
    assert dict(read_table(spark, str(tmp_path / "a.csv")).dtypes)["v"] == "string"
    assert dict(read_table(spark, str(tmp_path / "a.csv"), null_value="NA").dtypes)["v"] == "double"


def test_single_file_replaces_and_stays_one_file_at_any_size(spark, tmp_path):
    path = tmp_path / "deep" / "out.csv"
    for n in (3, 5, 5000):
        write_single_csv(spark.range(n).repartition(3).orderBy("id"), str(path))
        assert path.read_text().splitlines() == ["id", *map(str, range(n))]
    assert [p.name for p in path.parent.iterdir() if not p.name.startswith(".")] == ["out.csv"]


def test_results_table(spark, tmp_path):
    table = write_results(spark, [("e", "c", 0.5, 0.6, None, None)], str(tmp_path / "r.csv"))
    assert table.first()["accuracy"] == 0.5 and (tmp_path / "r.csv").exists()
