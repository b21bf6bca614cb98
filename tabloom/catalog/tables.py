"""Sources, sinks, projections, filters and set operations."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from tabloom.catalog.base import auc_sql, from_houses, from_passengers, fold_sql, given_score, register, scored, scores_sql
from tabloom.functions.numeric import at_threshold
from tabloom.operators import schema
from tabloom.operators.encode import indexer
from tabloom.operators.folds import fold_split, with_folds
from tabloom.operators.metrics import accuracy, roc_auc
from tabloom.plans import house, views
from tabloom.runtime import scratch_path
from tabloom.sources.sinks import (
    classification_output,
    load_model,
    regression_output,
    save_model,
    write_parts,
    write_results,
    write_single_csv,
)
from tabloom.sources.tables import read_table

@register("src_csv", "SELECT * FROM orders")
def src_csv(spark, sf_dir):
    path = write_parts(views.table(spark, sf_dir, "orders"), scratch_path(spark, "csv"), "csv")
    back = read_table(spark, path)
    return back.withColumns({c: F.col(c).cast("long") for c in ("o_orderkey", "o_custkey")})


@register("src_csv_nullmarker", from_passengers("SELECT * FROM p"))
def src_csv_nullmarker(spark, sf_dir):
    path = scratch_path(spark, "csv")
    rows = views.passengers(spark, sf_dir)
    rows.write.option("header", True).option("nullValue", "NA").csv(path)
    return read_table(spark, path, null_value="NA").withColumn("PassengerId", F.col("PassengerId").cast("long"))


@register("src_csv_untyped", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus FROM orders")
def src_csv_untyped(spark, sf_dir):
    """All columns are written and read back; those that the twin states are returned."""
    rows = views.table(spark, sf_dir, "orders")
    back = read_table(spark, write_parts(rows, scratch_path(spark, "csv"), "csv"), infer=False)
    return back.select("o_orderkey", "o_orderstatus")


@register("sink_single_csv", "SELECT * FROM customer")
def sink_single_csv(spark, sf_dir):
    rows = views.table(spark, sf_dir, "customer").orderBy("c_custkey")
    path = write_single_csv(rows, scratch_path(spark, "single") + ".csv")
    return read_table(spark, path, schema=rows.schema)


@register(
    "sink_class_submission",
    from_passengers(
        f"SELECT CAST(PassengerId AS INT) AS PassengerId, CAST({views.score_sql(37, 'PassengerId')} >= 0.5 AS INT) AS Survived FROM p"
    ),
)
def sink_class_submission(spark, sf_dir):
    rows = views.passengers(spark, sf_dir).withColumn("prediction", at_threshold(given_score(37), 0.5))
    return classification_output(rows, "PassengerId", "Survived", id_type="int")


@register(
    "sink_reg_submission",
    from_houses(
        "SELECT CAST(Id AS INT) AS Id, round(greatest(exp(CASE WHEN MoSold = 1 THEN -1.0 ELSE ln(1 + SalePrice) END) - 1, 0), 6)"
        " AS SalePrice FROM h"
    ),
)
def sink_reg_submission(spark, sf_dir):
    guess = F.when(F.col("MoSold") == 1, -1.0).otherwise(F.log1p("SalePrice"))
    out = regression_output(views.houses(spark, sf_dir).withColumn("prediction", guess), "Id", "SalePrice", id_type="int")
    return out.withColumn("SalePrice", F.round("SalePrice", 6))


MEMBER_SCORES_SQL = "q AS (SELECT Survived, unnest(['m0', 'm1', 'm2', 'm3']) AS candidate, unnest([m0, m1, m2, m3]) AS score FROM (SELECT *, {scores} FROM p))"


def member_scores(df):
    """One row per row and given score."""
    pairs = F.array(*[F.struct(F.lit(m).alias("candidate"), F.col(m).alias("score")) for m in ("m0", "m1", "m2", "m3")])
    return scored(df).select("Survived", F.explode(pairs).alias("s")).select("Survived", "s.*")


@register(
    "sink_results",
    from_passengers(
        ", "
        + MEMBER_SCORES_SQL.format(scores=scores_sql())
        + ", a AS ("
        + auc_sql("q", "score", "Survived", "candidate")
        + ") SELECT 'given' AS experiment, candidate, round(avg(CAST((score >= 0.5) = (Survived = 1) AS DOUBLE)), 6) AS accuracy,"
        " round(any_value(auc), 6) AS auc FROM q JOIN a USING (candidate) WHERE Survived IS NOT NULL GROUP BY candidate"
    ),
)
def sink_results(spark, sf_dir):
    rows = member_scores(views.passengers(spark, sf_dir)).withColumn("prediction", at_threshold(F.col("score"), 0.5))
    scores = accuracy(rows, label="Survived", keys=["candidate"]).join(
        roc_auc(rows, "score", "Survived", ["candidate"]), "candidate"
    )
    path = scratch_path(spark, "results") + ".csv"
    write_results(spark, [("given", r["candidate"], r["accuracy"], r["auc"], None, None) for r in scores.collect()], path)
    back = read_table(spark, path).select("experiment", "candidate", "accuracy", "auc")
    return back.withColumns({c: F.round(c, 6) for c in ("accuracy", "auc")})


CODES_SQL = """, c AS (SELECT {c} AS v, count(*) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY {c}),
i AS (SELECT v, CAST(row_number() OVER (ORDER BY n DESC, v) - 1 AS DOUBLE) AS code FROM c)"""


@register(
    "model_store",
    from_passengers(
        CODES_SQL.format(c="Embarked", source="p")
        + " SELECT PassengerId, coalesce(code, (SELECT CAST(count(*) AS DOUBLE) FROM i)) AS EmbarkedIndexed FROM p LEFT JOIN i ON v = Embarked"
    ),
)
def model_store(spark, sf_dir):
    rows = views.passengers(spark, sf_dir)
    fitted = Pipeline(stages=[indexer(["Embarked"], ["EmbarkedIndexed"])]).fit(rows)
    again = load_model(save_model(fitted, scratch_path(spark, "model")))
    return again.transform(rows).select("PassengerId", "EmbarkedIndexed")


@register(
    "union_train_test",
    "SELECT doc_id, source, n_chars, lang, quality, true AS is_train FROM documents JOIN labels USING (doc_id)"
    " UNION ALL SELECT doc_id, source, n_chars, NULL, NULL, false FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def union_train_test(spark, sf_dir):
    documents, labels = (views.table(spark, sf_dir, n) for n in ("documents", "labels"))
    documents = documents.select("doc_id", "source", "n_chars", "lang")
    train = documents.join(labels.select("doc_id", "quality"), "doc_id")
    test = documents.join(labels.select("doc_id"), "doc_id", "left_anti").drop("lang")
    return schema.union_labeled(train, test, "quality", "is_train")


@register("split_by_flag", from_passengers("SELECT PassengerId, Name, Ticket FROM p WHERE Survived IS NULL"))
def split_by_flag(spark, sf_dir):
    both = schema.union_labeled(*views.passenger_sides(spark, sf_dir), "Survived")
    _, test = schema.split_labeled(both, "Survived")
    return test.select("PassengerId", "Name", "Ticket")


@register(
    "cast_numeric",
    from_passengers("SELECT PassengerId, CAST(Pclass AS DOUBLE) AS Pclass, TRY_CAST(Ticket AS DOUBLE) AS Ticket FROM p"),
)
def cast_numeric(spark, sf_dir):
    return schema.to_double(views.passengers(spark, sf_dir).select("PassengerId", "Pclass", "Ticket"), ["Pclass", "Ticket"])


@register("drop_temp", from_passengers("SELECT * EXCLUDE (Name, Cabin) FROM p"))
def drop_temp(spark, sf_dir):
    return schema.drop_temp(views.passengers(spark, sf_dir), ["Name", "Cabin"])


@register(
    "guarded_column", from_houses("SELECT Id, CAST(YrSold AS DOUBLE) - CAST(YearBuilt AS DOUBLE) AS HouseAgeAtSale FROM h")
)
def guarded_column(spark, sf_dir):
    df = views.houses(spark, sf_dir).select("Id", "YrSold", "YearBuilt")
    df = schema.with_column_if_present(
        df, "HouseAgeAtSale", ["YrSold", "YearBuilt"], F.col("YrSold").cast("double") - F.col("YearBuilt").cast("double")
    )
    df = schema.with_column_if_present(df, "Pools", ["PoolArea"], F.col("PoolArea"))
    return df.drop("YrSold", "YearBuilt")


HOUSE_ROLES = {
    "MSSubClass": "categorical", "MoSold": "categorical", "YrSold": "categorical", "YearBuilt": "numeric",
    "YearRemodAdd": "numeric", "GarageYrBlt": "numeric", "OverallQual": "numeric", "GrLivArea": "numeric",
    "TotalBsmtSF": "numeric", "1stFlrSF": "numeric", "2ndFlrSF": "numeric", "FullBath": "numeric",
    "HalfBath": "numeric", "Neighborhood": "categorical", "GarageType": "categorical",
}


@register(
    "role_discovery",
    from_houses(
        " UNION ALL ".join(
            f"SELECT '{c}' AS feature, '{role}' AS role, count(\"{c}\") AS known FROM h" for c, role in HOUSE_ROLES.items()
        )
    ),
)
def role_discovery(spark, sf_dir):
    """The role of each column, and how many of its values are known."""
    df = views.houses(spark, sf_dir)
    roles = schema.infer_roles(df, house.ID, (house.TARGET,), house.FORCED_CATEGORICAL)
    named = [(c, "numeric") for c in roles.numeric] + [(c, "categorical") for c in roles.categorical]
    counted = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c, _ in named])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(r).alias("role"), F.col(f"`{c}`").alias("known")) for c, r in named])
    return counted.select(F.explode(rows).alias("s")).select("s.*")


@register(
    "categorical_text",
    from_houses(
        "SELECT Id, coalesce(CAST(MSSubClass AS VARCHAR), 'missing') AS MSSubClass_text, coalesce(GarageType, 'missing') AS GarageType_text FROM h"
    ),
)
def categorical_text(spark, sf_dir):
    df = views.houses(spark, sf_dir).select("Id", "MSSubClass", "GarageType")
    return schema.categorical_text(df, ["MSSubClass", "GarageType"]).drop("MSSubClass", "GarageType")


@register("log_target", from_houses("SELECT Id, round(ln(1 + SalePrice), 6) AS SalePriceLog FROM h"))
def log_target(spark, sf_dir):
    df = schema.log_target(views.houses(spark, sf_dir), house.TARGET, house.LABEL)
    return df.select("Id", F.round(house.LABEL, 6).alias(house.LABEL))


@register(
    "outlier_filter",
    from_houses("SELECT Id, TotalBsmtSF, SalePrice FROM h WHERE TotalBsmtSF < 1000 OR SalePrice >= 300000 OR TotalBsmtSF IS NULL OR SalePrice IS NULL"),
)
def outlier_filter(spark, sf_dir):
    df = views.houses(spark, sf_dir).select("Id", "TotalBsmtSF", "SalePrice")
    return schema.filter_training_outliers(df, "TotalBsmtSF", "SalePrice", area_limit=1000.0)


@register("keep_columns", from_passengers("SELECT PassengerId, Survived FROM p"))
def keep_columns(spark, sf_dir):
    return schema.keep_columns(views.passengers(spark, sf_dir), "PassengerId", "Survived")


@register(
    "fold_filter",
    from_passengers(f", {fold_sql('p', 'PassengerId', 5)} SELECT PassengerId, fold = 3 AS validates FROM folded"),
)
def fold_filter(spark, sf_dir):
    folded = with_folds(views.passengers(spark, sf_dir).select("PassengerId"), "PassengerId", 5)
    training, validation = fold_split(folded, 3)
    return training.withColumn("validates", F.lit(False)).unionByName(validation.withColumn("validates", F.lit(True)))


@register("sql_statement_stage", from_passengers("SELECT Sex, Pclass, count(*) AS n, count(Age) AS known FROM p GROUP BY ALL"))
def sql_statement_stage(spark, sf_dir):
    stage = SQLTransformer(statement="SELECT Sex, Pclass, count(*) AS n, count(Age) AS known FROM __THIS__ GROUP BY Sex, Pclass")
    return Pipeline(stages=[stage]).fit(df := views.passengers(spark, sf_dir)).transform(df)
