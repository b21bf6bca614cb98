"""The registry, and SQL that several twins share."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.plans import passenger, views
from tabloom.runtime import materialize, together

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_TWINS: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = query
        if sql is not None:
            _TWINS[name] = sql
        return query

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_TWINS)


PASSENGERS = f"p AS ({views.for_duckdb(views.PASSENGERS_SQL)})"
HOUSES = f"h AS ({views.for_duckdb(views.HOUSES_SQL)})"


def from_passengers(body: str) -> str:
    return f"WITH {PASSENGERS} {body}"


def from_houses(body: str) -> str:
    return f"WITH {HOUSES} {body}"


# Row features, group statistics and imputed values of the passenger view.
FEATURES = (
    PASSENGERS
    + r""",
r AS (
  SELECT PassengerId, Survived, CAST(Pclass AS DOUBLE) AS Pclass, Name, Sex, Age,
    CAST(SibSp AS DOUBLE) AS SibSp, CAST(Parch AS DOUBLE) AS Parch, Ticket, Fare, Cabin, Embarked,
    regexp_extract(Name, ',\s*([^\.]+)\.', 1) AS raw_title,
    regexp_extract(Name, '^([^,]+),', 1) AS Surname,
    coalesce(Embarked, 'S') AS EmbarkedFilled,
    CASE WHEN Cabin IS NULL OR length(trim(Cabin)) = 0 THEN 'missing' ELSE substring(Cabin, 1, 1) END AS Deck,
    CASE WHEN Cabin IS NULL OR length(trim(Cabin)) = 0 THEN 0.0::DOUBLE
      ELSE CAST(len(regexp_split_to_array(trim(Cabin), '\s+')) AS DOUBLE) END AS CabinCount,
    regexp_replace(regexp_extract(upper(Ticket), '^([^0-9]+)', 1), '[^A-Z]', '', 'g') AS raw_prefix,
    CAST(SibSp + Parch + 1 AS DOUBLE) AS FamilySize
  FROM p
),
b AS (
  SELECT *,
    CASE WHEN raw_title IN ('Mr', 'Mrs', 'Miss', 'Master') THEN raw_title WHEN raw_title IN ('Mlle', 'Ms') THEN 'Miss'
      WHEN raw_title = 'Mme' THEN 'Mrs' ELSE 'Rare' END AS TitleGroup,
    CASE WHEN Deck = 'missing' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS HasCabin,
    CASE WHEN raw_prefix = '' THEN 'NUMERIC' ELSE raw_prefix END AS TicketPrefix,
    CASE WHEN raw_prefix = '' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS IsNumericTicket,
    CASE WHEN FamilySize = 1 THEN 'single' WHEN FamilySize <= 3 THEN 'small' WHEN FamilySize <= 5 THEN 'medium'
      ELSE 'large' END AS FamilyBucket,
    CASE WHEN FamilySize = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS IsAlone,
    CASE WHEN Age IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS AgeKnown,
    CASE WHEN Fare IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS FareKnown
  FROM r
),
s1 AS (SELECT Surname, CAST(count(*) AS DOUBLE) AS SurnameGroupSize FROM b GROUP BY Surname),
s2 AS (SELECT Ticket, CAST(count(*) AS DOUBLE) AS TicketGroupSize FROM b GROUP BY Ticket),
a1 AS (SELECT Sex, Pclass, TitleGroup, quantile_disc(Age, 0.5) AS m FROM b WHERE Age IS NOT NULL GROUP BY ALL),
a2 AS (SELECT Sex, Pclass, quantile_disc(Age, 0.5) AS m FROM b WHERE Age IS NOT NULL GROUP BY ALL),
f1 AS (SELECT Pclass, EmbarkedFilled, quantile_disc(Fare, 0.5) AS m FROM b WHERE Fare IS NOT NULL GROUP BY ALL),
f2 AS (SELECT Pclass, quantile_disc(Fare, 0.5) AS m FROM b WHERE Fare IS NOT NULL GROUP BY ALL),
g AS (SELECT coalesce(quantile_disc(Age, 0.5), 28.0) AS age, coalesce(quantile_disc(Fare, 0.5), 14.4542) AS fare FROM b),
j AS (
  SELECT b.*, SurnameGroupSize, TicketGroupSize,
    coalesce(b.Age, a1.m, a2.m, g.age) AS AgeFilled, coalesce(b.Fare, f1.m, f2.m, g.fare) AS FareFilled
  FROM b LEFT JOIN s1 USING (Surname) LEFT JOIN s2 USING (Ticket)
    LEFT JOIN a1 ON a1.Sex = b.Sex AND a1.Pclass = b.Pclass AND a1.TitleGroup = b.TitleGroup
    LEFT JOIN a2 ON a2.Sex = b.Sex AND a2.Pclass = b.Pclass
    LEFT JOIN f1 ON f1.Pclass = b.Pclass AND f1.EmbarkedFilled = b.EmbarkedFilled
    LEFT JOIN f2 ON f2.Pclass = b.Pclass CROSS JOIN g
),
f AS (
  SELECT * EXCLUDE (raw_title, raw_prefix),
    FareFilled / CASE WHEN FamilySize <= 0 THEN 1.0 ELSE FamilySize END AS FarePerPerson,
    ln(1 + FareFilled) AS FareLog1p, CAST(CAST(Pclass AS INT) AS VARCHAR) AS PclassText
  FROM j
)
"""
)


def from_features(body: str) -> str:
    return f"WITH {FEATURES} {body}"


def row_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passenger.row_features(views.passengers(spark, sf_dir))


def features(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return passenger.passenger_features(*views.passenger_sides(spark, sf_dir, dealt=True))


def written_features(spark: SparkSession, sf_dir: str, spread: bool = True) -> list[DataFrame]:
    """Both sides as written tables, for queries that scan them more than once."""
    sides = features(spark, sf_dir)
    return together(spark, [partial(materialize, side, "features", spread=spread) for side in sides])


def given_score(multiplier: int, id_col: str = "PassengerId") -> Column:
    return F.expr(views.score_sql(multiplier, id_col))


def scored(df: DataFrame, id_col: str = "PassengerId") -> DataFrame:
    """Four given scores ``m0`` to ``m3`` in place of fitted models."""
    return df.withColumns({f"m{i}": given_score(m, id_col) for i, m in enumerate(views.SCORE_MULTIPLIERS)})


def scores_sql(id_col: str = "PassengerId") -> str:
    return ", ".join(f"{views.score_sql(m, id_col)} AS m{i}" for i, m in enumerate(views.SCORE_MULTIPLIERS))


def auc_sql(source: str, score: str, label: str, keys: str = "") -> str:
    """AUC by ranks, with the mean rank for ties."""
    group = f"PARTITION BY {keys}" if keys else ""
    tie = f"{keys}, {score}" if keys else score
    head = f"{keys}, " if keys else ""
    by = f"GROUP BY {keys}" if keys else ""
    return f"""
SELECT {head}(sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) AS auc
FROM (
  SELECT {head}CAST({label} AS DOUBLE) AS y,
    rank() OVER ({group} ORDER BY {score}) + (count(*) OVER (PARTITION BY {tie}) - 1) / 2.0 AS rk
  FROM {source} WHERE {label} IS NOT NULL
) {by}"""


# The fold hash in SQL: Murmur3 of a bigint with seed 42, step by step on unsigned 32-bit words.
def fold_sql(source: str, id_col: str, k: int) -> str:
    """CTEs ``k1`` .. ``folded`` over ``source``; ``folded`` adds ``fold``."""

    def times(x: str, factor: int) -> str:
        return f"(({x}) * {factor}::UBIGINT) % 4294967296::UBIGINT"

    def rotate(x: str, r: int) -> str:
        return f"((({x}) * {1 << r}::UBIGINT) % 4294967296::UBIGINT + ({x}) // {1 << (32 - r)}::UBIGINT)"

    def shift(x: str, r: int) -> str:
        return f"xor({x}, {x} // {1 << r}::UBIGINT)"

    mix = lambda word, state, name, prev: (
        f"{name}a AS (SELECT *, {times(word, 0xCC9E2D51)} AS {name}x FROM {prev}), "
        f"{name}b AS (SELECT *, {times(rotate(name + 'x', 15), 0x1B873593)} AS {name}y FROM {name}a), "
        f"{name}c AS (SELECT *, xor({state}, {name}y) AS {name}z FROM {name}b), "
        f"{name} AS (SELECT *, (({rotate(name + 'z', 13)}) * 5::UBIGINT + {0xE6546B64}::UBIGINT) % 4294967296::UBIGINT"
        f" AS {name}h FROM {name}c)"
    )
    return (
        f"w AS (SELECT *, CAST({id_col} AS UBIGINT) % 4294967296::UBIGINT AS lo, "
        f"CAST({id_col} AS UBIGINT) // 4294967296::UBIGINT AS hi FROM {source}), "
        + mix("lo", "42::UBIGINT", "k1", "w")
        + ", "
        + mix("hi", "k1h", "k2", "k1")
        + f", e1 AS (SELECT *, xor(k2h, 8::UBIGINT) AS q0 FROM k2)"
        + f", e2 AS (SELECT *, {shift('q0', 16)} AS q1 FROM e1)"
        + f", e3 AS (SELECT *, {times('q1', 0x85EBCA6B)} AS q2 FROM e2)"
        + f", e4 AS (SELECT *, {shift('q2', 13)} AS q3 FROM e3)"
        + f", e5 AS (SELECT *, {times('q3', 0xC2B2AE35)} AS q4 FROM e4)"
        + f", e6 AS (SELECT *, {shift('q4', 16)} AS q5 FROM e5)"
        + ", folded AS (SELECT * EXCLUDE (lo, hi, k1x, k1y, k1z, k1h, k2x, k2y, k2z, k2h, q0, q1, q2, q3, q4, q5), "
        + f"CAST(abs(CASE WHEN q5 >= 2147483648 THEN CAST(q5 AS BIGINT) - 4294967296 ELSE CAST(q5 AS BIGINT) END) % {k} AS INT)"
        + " AS fold FROM e6)"
    )
