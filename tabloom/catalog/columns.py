"""Row-wise features and the two feature sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.catalog.base import features, from_features, from_houses, from_passengers, register, row_features
from tabloom.functions import numeric as num
from tabloom.functions import text as txt
from tabloom.functions.numeric import as_double
from tabloom.operators.quantile import impute_median
from tabloom.plans import house, passenger, views
from tabloom.plans.stages import BASE_FEATURES, DERIVED_FEATURES, sql_stage


def _feature(name, columns):
    """A query over columns of the row features."""

    @register(name, from_features(f"SELECT PassengerId, {', '.join(columns)} FROM b"))
    def query(spark, sf_dir):
        return row_features(spark, sf_dir).select("PassengerId", *columns)


@register("title_extract", from_features("SELECT PassengerId, raw_title AS title FROM r"))
def title_extract(spark, sf_dir):
    return views.passengers(spark, sf_dir).select("PassengerId", txt.extract_title(F.col("Name")).alias("title"))


_feature("title_group", ["TitleGroup"])
_feature("surname_extract", ["Surname"])
_feature("first_letter_code", ["Deck"])
_feature("presence_flag", ["HasCabin"])
_feature("token_count", ["CabinCount"])
_feature("alpha_prefix", ["TicketPrefix"])
_feature("numeric_code_flag", ["IsNumericTicket"])
_feature("additive_size", ["FamilySize"])
_feature("size_bucket", ["FamilyBucket"])
_feature("alone_flag", ["IsAlone"])
_feature("missing_indicator", ["AgeKnown", "FareKnown"])


@register("fill_constant", from_passengers("SELECT PassengerId, coalesce(Embarked, 'S') AS port FROM p"))
def fill_constant(spark, sf_dir):
    return views.passengers(spark, sf_dir).select("PassengerId", txt.fill_const(F.col("Embarked"), "S").alias("port"))


@register("safe_ratio", from_passengers("SELECT PassengerId, Fare / CASE WHEN SibSp <= 0 THEN 1.0 ELSE SibSp END AS ratio FROM p"))
def safe_ratio(spark, sf_dir):
    ratio = num.safe_ratio(F.col("Fare"), F.col("SibSp").cast("double"))
    return views.passengers(spark, sf_dir).select("PassengerId", ratio.alias("ratio"))


@register("log1p_feature", from_passengers("SELECT PassengerId, round(ln(1 + Fare), 6) AS FareLog1p FROM p"))
def log1p_feature(spark, sf_dir):
    return views.passengers(spark, sf_dir).select("PassengerId", F.round(F.log1p("Fare"), 6).alias("FareLog1p"))


@register("int_as_text", from_passengers("SELECT PassengerId, CAST(Pclass AS VARCHAR) AS PclassText FROM p"))
def int_as_text(spark, sf_dir):
    text = txt.as_category(F.col("Pclass").cast("double"))
    return views.passengers(spark, sf_dir).select("PassengerId", text.alias("PclassText"))


BASE_SQL = r"""SELECT PassengerId, CAST(Pclass AS VARCHAR) AS PclassText, coalesce(Embarked, 'missing') AS EmbarkedText,
 CAST(SibSp + Parch + 1 AS DOUBLE) AS FamilySize, CAST(SibSp + Parch = 0 AS DOUBLE) AS IsAlone,
 coalesce(regexp_extract(Name, ',\s*([^\.]+)\.', 1), 'missing') AS Title FROM p"""


@register("base_feature_sql", from_passengers(BASE_SQL))
def base_feature_sql(spark, sf_dir):
    return sql_stage(BASE_FEATURES).transform(views.passengers(spark, sf_dir)).select("PassengerId", *BASE_FEATURES)


@register(
    "derived_feature_sql",
    from_passengers(
        "SELECT PassengerId, coalesce(Fare, (SELECT quantile_disc(Fare, 0.5) FROM p)) / (SibSp + Parch + 1) AS FarePerPerson FROM p"
    ),
)
def derived_feature_sql(spark, sf_dir):
    base = sql_stage(BASE_FEATURES).transform(views.passengers(spark, sf_dir))
    filled = impute_median(base, ["Fare"], ["FareImputed"])
    return sql_stage(DERIVED_FEATURES).transform(filled).select("PassengerId", "FarePerPerson")


@register(
    "age_difference",
    from_houses(
        "SELECT Id, CAST(YrSold - YearBuilt AS DOUBLE) AS house_age, CAST(YrSold - GarageYrBlt AS DOUBLE) AS garage_age FROM h"
    ),
)
def age_difference(spark, sf_dir):
    return views.houses(spark, sf_dir).select(
        "Id",
        num.difference(as_double("YrSold"), as_double("YearBuilt")).alias("house_age"),
        num.difference(as_double("YrSold"), as_double("GarageYrBlt")).alias("garage_age"),
    )


@register(
    "null_as_zero_sum",
    from_houses('SELECT Id, CAST(coalesce(TotalBsmtSF, 0) + "1stFlrSF" + "2ndFlrSF" AS DOUBLE) AS TotalSF FROM h'),
)
def null_as_zero_sum(spark, sf_dir):
    parts = [as_double(c) for c in ("TotalBsmtSF", "1stFlrSF", "2ndFlrSF")]
    return views.houses(spark, sf_dir).select("Id", num.sum_or_zero(parts).alias("TotalSF"))


@register(
    "weighted_sum",
    from_houses("SELECT Id, FullBath + 0.5::DOUBLE * HalfBath + 0.5::DOUBLE * coalesce(TotalBsmtSF, 0) AS weighted FROM h"),
)
def weighted_sum(spark, sf_dir):
    parts = [as_double(c) for c in ("FullBath", "HalfBath", "TotalBsmtSF")]
    return views.houses(spark, sf_dir).select("Id", num.sum_or_zero(parts, [1.0, 0.5, 0.5]).alias("weighted"))


@register("interaction", from_houses("SELECT Id, CAST(OverallQual * TotalBsmtSF AS DOUBLE) AS crossed FROM h"))
def interaction(spark, sf_dir):
    crossed = num.product(as_double("OverallQual"), as_double("TotalBsmtSF"))
    return views.houses(spark, sf_dir).select("Id", crossed.alias("crossed"))


@register(
    "power_terms",
    from_houses("SELECT Id, CAST(OverallQual ** 2 AS DOUBLE) AS squared, CAST(OverallQual ** 3 AS DOUBLE) AS cubed FROM h"),
)
def power_terms(spark, sf_dir):
    quality = as_double("OverallQual")
    return views.houses(spark, sf_dir).select(
        "Id", num.power(quality, 2.0).alias("squared"), num.power(quality, 3.0).alias("cubed")
    )


@register(
    "positive_flags",
    from_houses(
        'SELECT Id, CAST(coalesce(TotalBsmtSF, 0) > 0 AS DOUBLE) AS HasBasement, CAST("2ndFlrSF" > 0 AS DOUBLE) AS HasSecondFloor FROM h'
    ),
)
def positive_flags(spark, sf_dir):
    return views.houses(spark, sf_dir).select(
        "Id",
        num.positive_flag(as_double("TotalBsmtSF")).alias("HasBasement"),
        num.positive_flag(as_double("2ndFlrSF")).alias("HasSecondFloor"),
    )


@register(
    "clamped_log1p",
    from_houses(
        "SELECT Id, round(ln(1 + greatest(coalesce(TotalBsmtSF - 700, 0), 0)), 6) AS x FROM h"
    ),
)
def clamped_log1p(spark, sf_dir):
    shifted = num.clamped_log1p(as_double("TotalBsmtSF") - 700.0)
    return views.houses(spark, sf_dir).select("Id", F.round(shifted, 6).alias("x"))


BASIC_SET_SQL = """SELECT h.*, CAST(YrSold - YearBuilt AS DOUBLE) AS HouseAgeAtSale, CAST(YrSold - YearRemodAdd AS DOUBLE) AS RemodAgeAtSale,
 CAST(YrSold - GarageYrBlt AS DOUBLE) AS GarageAgeAtSale,
 CAST(coalesce(TotalBsmtSF, 0) + "1stFlrSF" + "2ndFlrSF" AS DOUBLE) AS TotalSF, OverallQual * TotalSF AS OverallQualXTotalSF,
 round(ln(1 + GrLivArea), 6) AS GrLivAreaLog1p, round(ln(1 + TotalSF), 6) AS TotalSFLog1p,
 round(ln(1 + coalesce(TotalBsmtSF, 0)), 6) AS TotalBsmtSFLog1p{more} FROM h"""
ADVANCED_SET_SQL = BASIC_SET_SQL.format(
    more=""", CAST(OverallQual ** 2 AS DOUBLE) AS OverallQualSquared, CAST(OverallQual ** 3 AS DOUBLE) AS OverallQualCubed,
 CAST(OverallQual * GrLivArea AS DOUBLE) AS OverallQualXGrLivArea, CAST("2ndFlrSF" > 0 AS DOUBLE) AS HasSecondFloor,
 CAST(coalesce(TotalBsmtSF, 0) > 0 AS DOUBLE) AS HasBasement, round(ln(1 + "1stFlrSF"), 6) AS "1stFlrSFLog1p",
 round(ln(1 + "2ndFlrSF"), 6) AS "2ndFlrSFLog1p", round(ln(1 + FullBath), 6) AS FullBathLog1p,
 round(ln(1 + HalfBath), 6) AS HalfBathLog1p"""
)


def _house_set(spark, sf_dir, advanced):
    df = house.house_features(views.houses(spark, sf_dir), advanced)
    return df.withColumns({c: F.round(F.col(f"`{c}`"), 6) for c in df.columns if c.endswith("Log1p")})


@register("house_feature_set", from_houses(BASIC_SET_SQL.format(more="")))
def house_feature_set(spark, sf_dir):
    return _house_set(spark, sf_dir, False)


@register("house_feature_set_advanced", from_houses(ADVANCED_SET_SQL))
def house_feature_set_advanced(spark, sf_dir):
    return _house_set(spark, sf_dir, True)


SET_COLUMNS = ("PassengerId", "Surname", "Name", "Ticket", "Cabin", *passenger.CATEGORICAL, *passenger.NUMERIC)


@register(
    "passenger_feature_set",
    from_features(
        f"SELECT Survived, {', '.join(c for c in SET_COLUMNS if c != 'FareLog1p')}, round(FareLog1p, 6) AS FareLog1p FROM f"
    ),
)
def passenger_feature_set(spark, sf_dir):
    train, test = features(spark, sf_dir)
    both = train.unionByName(test, allowMissingColumns=True).select("Survived", *SET_COLUMNS)
    return both.withColumn("FareLog1p", F.round("FareLog1p", 6))
