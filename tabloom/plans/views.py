"""Two views over the order and customer tables with nulls, groups and planted signal.

Each is one SQL text, which Spark and the checking engine both read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabloom.runtime import deal

PASSENGERS_SQL = """
SELECT o_orderkey AS PassengerId,
 CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS Survived,
 CAST(o_orderkey % 3 + 1 AS INT) AS Pclass,
 concat('Fam', c_custkey % 97, ', ', CASE o_orderkey % 9 WHEN 0 THEN 'Mr' WHEN 1 THEN 'Mrs' WHEN 2 THEN 'Miss'
   WHEN 3 THEN 'Master' WHEN 4 THEN 'Mlle' WHEN 5 THEN 'Ms' WHEN 6 THEN 'Mme' WHEN 7 THEN 'the Countess'
   ELSE 'Dr' END, '. N', o_orderkey) AS Name,
 CASE WHEN c_custkey % 2 = 0 THEN 'male' ELSE 'female' END AS Sex,
 CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST((o_orderkey * 7) % 80 AS DOUBLE) END AS Age,
 CAST(o_orderkey % 4 AS INT) AS SibSp,
 CAST((o_orderkey % 12 - o_orderkey % 4) / 4 AS INT) AS Parch,
 CASE o_orderkey % 4 WHEN 0 THEN concat('A/5. ', c_custkey % 211) WHEN 1 THEN concat('STON/O2. ', c_custkey % 211)
   WHEN 2 THEN concat('', c_custkey % 211) ELSE 'LINE' END AS Ticket,
 CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS Fare,
 CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'C23 C25' WHEN 2 THEN '' WHEN 3 THEN concat('B', o_orderkey % 50)
   ELSE 'E12' END AS Cabin,
 CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'Q' WHEN 2 THEN 'C' ELSE 'S' END AS Embarked
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
"""

HOUSES_SQL = """
SELECT o_orderkey AS Id,
 CAST(100 * (500 + (o_orderkey * 37) % 4500) + 5000 * (1 + o_orderkey % 10) AS DOUBLE) AS SalePrice,
 CAST(20 + 10 * (o_orderkey % 5) AS INT) AS MSSubClass, CAST(1 + o_orderkey % 12 AS INT) AS MoSold,
 CAST(2006 + o_orderkey % 5 AS INT) AS YrSold,
 CAST(1900 + (o_orderkey * 13) % 100 AS INT) AS YearBuilt, CAST(1950 + (o_orderkey * 17) % 55 AS INT) AS YearRemodAdd,
 CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(1900 + (o_orderkey * 19) % 105 AS INT) END AS GarageYrBlt,
 CAST(1 + o_orderkey % 10 AS INT) AS OverallQual, CAST(500 + (o_orderkey * 37) % 4500 AS INT) AS GrLivArea,
 CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE CAST((o_orderkey * 11) % 2000 AS INT) END AS TotalBsmtSF,
 CAST((o_orderkey * 23) % 2500 AS INT) AS `1stFlrSF`,
 CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE CAST((o_orderkey * 29) % 1500 AS INT) END AS `2ndFlrSF`,
 CAST(o_orderkey % 4 AS INT) AS FullBath, CAST(o_orderkey % 3 AS INT) AS HalfBath,
 o_orderpriority AS Neighborhood, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS GarageType
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
"""

# The members of a vote on given scores: multipliers of the id.
SCORE_MULTIPLIERS = (37, 101, 211, 389)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _view(spark: SparkSession, sf_dir: str, sql: str, dealt: bool = False) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return spark.sql(sql, orders=deal(orders) if dealt else orders, customer=table(spark, sf_dir, "customer"))


def passengers(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """Rows with an unknown outcome are the test side."""
    return _view(spark, sf_dir, PASSENGERS_SQL, dealt)


def passenger_sides(spark: SparkSession, sf_dir: str, dealt: bool = False) -> tuple[DataFrame, DataFrame]:
    """Labelled and unlabelled rows; ``dealt`` uses all cores even if the source is one small file."""
    rows = passengers(spark, sf_dir, dealt)
    return rows.where("Survived IS NOT NULL"), rows.where("Survived IS NULL").drop("Survived")


def houses(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    return _view(spark, sf_dir, HOUSES_SQL, dealt)


def score_sql(multiplier: int, id_col: str) -> str:
    """A repeatable score in [0, 1) with ties and values on the threshold."""
    return f"CAST(({id_col} * {multiplier}) % 1000 AS DOUBLE) / 1000"


def for_duckdb(sql: str) -> str:
    return sql.format(orders="orders", customer="customer").replace("`", '"').strip()
