"""Chains of fitted stages that end in a model."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.regression import LinearRegression

from tabloom.functions.text import TITLE_PATTERN
from tabloom.operators.encode import Densifier, assembler, indexer, median_imputer, one_hot, scaler
from tabloom.operators.schema import Roles, text_name
from tabloom.plans import house, passenger
from tabloom.plans.boost import HistogramBooster, HistogramForest
from tabloom.plans.levels import RESIDUAL

# Columns of the two SQL steps, feature orders and model settings. The SQL texts are values that must
# match: what the steps compute is given, and they are stated plainly.
BASE_FEATURES = {
    "PclassText": "CAST(Pclass AS STRING)",
    "EmbarkedText": "COALESCE(Embarked, 'missing')",
    "FamilySize": "CAST(SibSp + Parch + 1 AS DOUBLE)",
    "IsAlone": "CASE WHEN SibSp + Parch = 0 THEN 1.0D ELSE 0.0D END",
    "Title": f"COALESCE(regexp_extract(Name, r'{TITLE_PATTERN}', 1), 'missing')",
}
DERIVED_FEATURES = {"FarePerPerson": "FareImputed / CASE WHEN FamilySize <= 0 THEN 1.0D ELSE FamilySize END"}
BASELINE_IMPUTED = {"Age": "AgeImputed", "Fare": "FareImputed"}
BASELINE_INDEXED = {
    "Sex": "SexIndexed",
    "EmbarkedText": "EmbarkedIndexed",
    "PclassText": "PclassIndexed",
    "Title": "TitleIndexed",
}
BASELINE_FEATURES = (
    "PclassIndexed",
    "SexIndexed",
    "EmbarkedIndexed",
    "TitleIndexed",
    "AgeImputed",
    "FareImputed",
    "SibSp",
    "Parch",
    "FamilySize",
    "IsAlone",
    "FarePerPerson",
)
BASELINE_TREES, BASELINE_DEPTH = 200, 6
REGRESSION_DEFAULTS = {
    "max_bins": 512,
    "trees": 300,
    "depth": 6,
    "iterations": 250,
    "reg": 0.01,
    "elastic": 0.8,
    "rounds": 500,
    "eta": 0.03,
    "seed": 42,
}
FOREST_MIN_ROWS, FOREST_ROW_SAMPLE, FOREST_FEATURES = 2, 0.85, "sqrt"
GBT_STEP = 0.05
BOOST_MIN_WEIGHT, BOOST_ROW_SAMPLE, BOOST_COLUMN_SAMPLE, BOOST_LAMBDA = 1.0, 0.8, 0.8, 1.0
ALGORITHMS = ("lr", "rf", "gbt", "xgb")
# End of fixed values.

INDEXED = tuple(f"{c}Indexed" for c in passenger.CATEGORICAL)
ONE_HOT = tuple(f"{c}OneHot" for c in passenger.CATEGORICAL)


def sql_stage(columns: Mapping[str, str]) -> SQLTransformer:
    """A stage that adds columns given as SQL expressions."""
    added = ", ".join(f"{value} AS {name}" for name, value in columns.items())
    return SQLTransformer(statement=f"SELECT *, {added} FROM __THIS__")


def tree_stages(model: Estimator) -> Pipeline:
    """Category codes and numeric columns in one vector, for a tree model."""
    coded = indexer(passenger.CATEGORICAL, INDEXED)
    return Pipeline(stages=[coded, assembler([*INDEXED, *passenger.NUMERIC]), model])


def linear_stages(model: Estimator) -> Pipeline:
    """One-hot categories and centred, scaled numeric columns, for a linear model."""
    return Pipeline(
        stages=[
            indexer(passenger.CATEGORICAL, INDEXED),
            one_hot(INDEXED, ONE_HOT),
            assembler(passenger.NUMERIC, "numericFeatures"),
            scaler("numericFeatures", "scaledNumericFeatures", centered=True),
            assembler([*ONE_HOT, "scaledNumericFeatures"]),
            model,
        ]
    )


def boost_stages(model: HistogramBooster) -> Pipeline:
    """The same columns as ``tree_stages``, for the booster."""
    return tree_stages(model)


def baseline_stages(seed: int = 42, trees: int = BASELINE_TREES, depth: int = BASELINE_DEPTH) -> Pipeline:
    """SQL features, median imputation, codes and a plain forest on the raw columns."""
    forest = RandomForestClassifier(
        labelCol=passenger.LABEL, featuresCol="features", seed=seed, numTrees=trees, maxDepth=depth
    )
    return Pipeline(
        stages=[
            sql_stage(BASE_FEATURES),
            median_imputer(list(BASELINE_IMPUTED), list(BASELINE_IMPUTED.values())),
            sql_stage(DERIVED_FEATURES),
            indexer(list(BASELINE_INDEXED), list(BASELINE_INDEXED.values())),
            assembler(BASELINE_FEATURES),
            forest,
        ]
    )


def house_stages(roles: Roles, algorithm: str = "lr", label: str = house.LABEL, id_col: str = house.ID, **settings) -> Pipeline:
    """Imputed numeric and coded text columns, and one of four regressors."""
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown algorithm: {algorithm}")
    unknown = settings.keys() - REGRESSION_DEFAULTS.keys()
    if unknown:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    s = {**REGRESSION_DEFAULTS, **settings}
    if s["max_bins"] < 32:
        raise ValueError("max_bins must be at least 32")
    imputed = [f"{c}_imputed" for c in roles.numeric]
    coded = [f"{c}_indexed" for c in roles.categorical]
    shared = [median_imputer(roles.numeric, imputed)] if imputed else []
    if coded:
        shared.append(indexer([text_name(c) for c in roles.categorical], coded))
    if algorithm == "lr":
        tail = _linear_tail(imputed, coded, label, s)
    else:
        tail = _tree_tail(algorithm, [*imputed, *coded], label, id_col, s)
    return Pipeline(stages=[*shared, *tail])


def _linear_tail(imputed: Sequence[str], coded: Sequence[str], label: str, s: dict) -> list:
    hot = [c.replace("_indexed", "_onehot") for c in coded]
    encoder = [one_hot(coded, hot, drop_last=False)] if coded else []
    return [
        *encoder,
        assembler(imputed, "numeric_features"),
        scaler("numeric_features", "numeric_scaled", centered=False),
        assembler(["numeric_scaled", *hot]),
        LinearRegression(
            labelCol=label,
            featuresCol="features",
            maxIter=s["iterations"],
            regParam=s["reg"],
            elasticNetParam=s["elastic"],
            standardization=True,
        ),
    ]


def _tree_tail(algorithm: str, columns: Sequence[str], label: str, id_col: str, s: dict) -> list:
    shared = {"labelCol": label, "featuresCol": "features", "idCol": id_col, "seed": s["seed"], "maxDepth": s["depth"]}
    if algorithm == "rf":
        model = HistogramForest(
            task="regress",
            numTrees=s["trees"],
            maxBins=s["max_bins"],
            minRows=float(FOREST_MIN_ROWS),
            rowSample=FOREST_ROW_SAMPLE,
            features=FOREST_FEATURES,
            **shared,
        )
        return [assembler(columns), model]
    if algorithm == "gbt":
        model = HistogramBooster(
            objective=RESIDUAL, rounds=s["iterations"], maxBins=s["max_bins"], eta=GBT_STEP, regLambda=0.0, **shared
        )
        return [assembler(columns), model]
    model = HistogramBooster(
        objective="squared",
        rounds=s["rounds"],
        eta=s["eta"],
        minChildWeight=BOOST_MIN_WEIGHT,
        rowSample=BOOST_ROW_SAMPLE,
        columnSample=BOOST_COLUMN_SAMPLE,
        regLambda=BOOST_LAMBDA,
        **shared,
    )
    return [
        assembler(columns, "features_sparse_or_dense"),
        Densifier(inputCol="features_sparse_or_dense", outputCol="features"),
        model,
    ]
