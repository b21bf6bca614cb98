"""Codes, one-hot slots, scaling, vectors."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tabloom.catalog.base import from_houses, from_passengers, given_score, register
from tabloom.catalog.tables import CODES_SQL
from tabloom.functions.numeric import prob_at_one, raw_vector
from tabloom.operators.encode import Densifier, assembler, indexer, one_hot, scaler, string_index
from tabloom.operators.quantile import impute_median
from tabloom.plans import views


@register(
    "string_index",
    from_passengers(
        ", c AS (SELECT kind, v, count(*) AS n FROM (SELECT 'Ticket' AS kind, Ticket AS v FROM p WHERE Survived IS NOT NULL"
        " UNION ALL SELECT 'Embarked', Embarked FROM p WHERE Survived IS NOT NULL) WHERE v IS NOT NULL GROUP BY ALL),"
        " i AS (SELECT kind, v, CAST(row_number() OVER (PARTITION BY kind ORDER BY n DESC, v) - 1 AS DOUBLE) AS code FROM c)"
        " SELECT PassengerId,"
        " coalesce(t.code, (SELECT CAST(count(*) AS DOUBLE) FROM i WHERE kind = 'Ticket')) AS TicketIndexed,"
        " coalesce(e.code, (SELECT CAST(count(*) AS DOUBLE) FROM i WHERE kind = 'Embarked')) AS EmbarkedIndexed"
        " FROM p LEFT JOIN i t ON t.kind = 'Ticket' AND t.v = Ticket LEFT JOIN i e ON e.kind = 'Embarked' AND e.v = Embarked"
    ),
)
def string_index_(spark, sf_dir):
    """Codes learned on the labelled rows, applied to all rows, by distributed joins."""
    rows = views.passengers(spark, sf_dir)
    coded = string_index(rows, ["Ticket", "Embarked"], fit_on=rows.where("Survived IS NOT NULL"))
    return coded.select("PassengerId", "TicketIndexed", "EmbarkedIndexed")


def _one_hot(spark, sf_dir, drop_last):
    rows = views.passengers(spark, sf_dir)
    stages = [indexer(["Embarked"], ["code"]), one_hot(["code"], ["hot"], drop_last)]
    hot = Pipeline(stages=stages).fit(rows.where("Survived IS NOT NULL")).transform(rows)
    slots = vector_to_array(F.col("hot"))
    return hot.select(
        "PassengerId",
        (F.array_position(slots, F.lit(1.0)) - 1).cast("int").alias("slot"),
        F.size(slots).alias("width"),
    )


def _one_hot_sql(extra):
    return from_passengers(
        CODES_SQL.format(c="Embarked", source="p WHERE Survived IS NOT NULL").replace(
            "WHERE Survived IS NOT NULL WHERE", "WHERE Survived IS NOT NULL AND"
        )
        + ", k AS (SELECT CAST(count(*) AS INT) AS k FROM i)"
        + f" SELECT PassengerId, CAST(coalesce(code, k) AS INT) AS slot, k + {extra} AS width FROM p CROSS JOIN k LEFT JOIN i ON v = Embarked"
    )


@register("one_hot_droplast", _one_hot_sql(1))
def one_hot_droplast(spark, sf_dir):
    return _one_hot(spark, sf_dir, True)


@register("one_hot_full", _one_hot_sql(2))
def one_hot_full(spark, sf_dir):
    return _one_hot(spark, sf_dir, False)


def _scaled(spark, sf_dir, centered):
    rows = views.houses(spark, sf_dir).select("Id", "GrLivArea", "OverallQual").withColumn("constant", F.lit(3.0))
    stages = [assembler(["GrLivArea", "OverallQual", "constant"], "v"), scaler("v", "s", centered)]
    scaled = Pipeline(stages=stages).fit(rows).transform(rows)
    out = vector_to_array(F.col("s"))
    return scaled.select("Id", *[F.round(out[i], 6).alias(f"s{i}") for i in range(3)])


def _scaled_sql(centered):
    def part(c):
        shift = f" - avg({c}) OVER ()" if centered else ""
        return f"round(({c}{shift}) / stddev_samp({c}) OVER (), 6)"

    return from_houses(f"SELECT Id, {part('GrLivArea')} AS s0, {part('OverallQual')} AS s1, 0.0::DOUBLE AS s2 FROM h")


@register("scale_centered", _scaled_sql(True))
def scale_centered(spark, sf_dir):
    return _scaled(spark, sf_dir, True)


@register("scale_uncentered", _scaled_sql(False))
def scale_uncentered(spark, sf_dir):
    return _scaled(spark, sf_dir, False)


VECTOR_SQL = from_passengers(
    "SELECT PassengerId, CAST(SibSp AS DOUBLE) AS x0, coalesce(Age, (SELECT quantile_disc(Age, 0.5) FROM p)) AS x1, CAST(Parch AS DOUBLE) AS x2 FROM p"
)


def _assembled(spark, sf_dir):
    filled = impute_median(views.passengers(spark, sf_dir), ["Age"], ["AgeImputed"])
    return assembler(["SibSp", "AgeImputed", "Parch"], "v").transform(filled)


def _elements(df, column):
    values = vector_to_array(F.col(column))
    return df.select("PassengerId", *[values[i].alias(f"x{i}") for i in range(3)])


@register("assemble", VECTOR_SQL)
def assemble(spark, sf_dir):
    return _elements(_assembled(spark, sf_dir), "v")


@register("densify", VECTOR_SQL)
def densify(spark, sf_dir):
    return _elements(Densifier(inputCol="v", outputCol="d").transform(_assembled(spark, sf_dir)), "d")


SCORE_37 = views.score_sql(37, "PassengerId")


@register("prob_at_one", from_passengers(f"SELECT PassengerId, {SCORE_37} AS p FROM p"))
def prob_at_one_(spark, sf_dir):
    score = given_score(37)
    rows = views.passengers(spark, sf_dir).withColumn("v", array_to_vector(F.array(F.lit(1.0) - score, score)))
    return rows.select("PassengerId", prob_at_one(F.col("v")).alias("p"))


@register("make_raw_vector", from_passengers(f"SELECT PassengerId, 1.0 - {SCORE_37} AS r0, {SCORE_37} AS r1 FROM p"))
def make_raw_vector(spark, sf_dir):
    rows = views.passengers(spark, sf_dir).select("PassengerId", raw_vector(given_score(37)).alias("v"))
    values = vector_to_array(F.col("v"))
    return rows.select("PassengerId", values[0].alias("r0"), values[1].alias("r1"))
