"""Null, no-match, tie and edge cases of row-wise features."""

import math

from pyspark.sql import functions as F

from tabloom.functions import numeric as num
from tabloom.functions import text as txt
from tabloom.operators import schema
from tabloom.plans import house


def texts(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")


def column(df, value):
    return [r[0] for r in df.orderBy("i").select(value).collect()]


def test_names(spark):
    df = texts(spark, ["Braund, Mr. O", "x", None, "Rothes, the Countess. of"])
    assert column(df, txt.extract_title(F.col("v"))) == ["Mr", "", None, "the Countess"]
    assert column(df, txt.extract_surname(F.col("v"))) == ["Braund", "", None, "Rothes"]


def test_title_groups(spark):
    df = texts(spark, ["Mr", "Mlle", "Ms", "Mme", "Master", "Dr", "", None])
    groups = column(df, txt.group_values(F.col("v"), txt.TITLE_GROUPS, txt.RARE_TITLE))
    assert groups == ["Mr", "Miss", "Miss", "Mrs", "Master", "Rare", "Rare", "Rare"]


def test_tickets(spark):
    df = texts(spark, ["STON/O2. 3101282", "113803", "LINE", None, "a/5 21"])
    assert column(df, txt.alpha_prefix(F.col("v"))) == ["STONO", "NUMERIC", "LINE", None, "A"]
    assert column(df, num.flag(txt.alpha_prefix(F.col("v")) == "NUMERIC")) == [0.0, 1.0, 0.0, 0.0, 0.0]


def test_cabins(spark):
    df = texts(spark, [None, "  ", "C23 C25  C27", " B5"])
    assert column(df, txt.first_letter(F.col("v"))) == ["missing", "missing", "C", " "]
    assert column(df, txt.token_count(F.col("v"))) == [0.0, 0.0, 3.0, 1.0]


def test_buckets(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 2.0, 3.0, 4.0, 5.0, 6.0, None])], "i int, v double")
    names = column(df, txt.bucket(F.col("v"), 1.0, (3.0, 5.0), ("single", "small", "medium", "large")))
    assert names == ["single", "small", "small", "medium", "medium", "large", "large"]


def test_null_rules_differ_by_operator(spark):
    df = spark.createDataFrame([(0, 1.0, None), (1, 2.0, 3.0)], "i int, a double, b double")
    a, b = F.col("a"), F.col("b")
    assert column(df, num.difference(a, b)) == [None, -1.0]
    assert column(df, num.sum_plus([a, b], 1.0)) == [None, 6.0]
    assert column(df, num.sum_or_zero([a, b], [1.0, 0.5])) == [1.0, 3.5]
    assert column(df, num.positive_flag(b)) == [0.0, 1.0]
    assert column(df, num.known_flag(b)) == [0.0, 1.0]
    assert column(df, num.clamped_log1p(-a)) == [0.0, 0.0]


def test_ratio_guard(spark):
    df = spark.createDataFrame([(0, 6.0, 0.0), (1, 6.0, -2.0), (2, 6.0, 3.0)], "i int, a double, b double")
    assert column(df, num.safe_ratio(F.col("a"), F.col("b"))) == [6.0, 6.0, 2.0]


def test_bad_numbers_become_null(spark):
    df = schema.to_double(texts(spark, ["1.5", "x", None]), ["v"])
    assert column(df, F.col("v")) == [1.5, None, None]


def test_vectors(spark):
    df = spark.range(1).select(F.lit(0).alias("i"), num.raw_vector(F.lit(0.25)).alias("v"))
    assert column(df, num.prob_at_one(F.col("v"))) == [0.25]
    assert column(df, num.densify(F.col("v")))[0].toArray().tolist() == [0.75, 0.25]


def test_union_and_split(spark):
    train = spark.createDataFrame([(1, "a", 0), (1, "a", 0)], "id int, x string, y int")
    test = spark.createDataFrame([(2, 5.0)], "id int, z double")
    both = schema.union_labeled(train, test, "y")
    assert sorted(map(tuple, both.select("id", "x", "z", "y").collect()), key=str) == [
        (1, "a", None, 0), (1, "a", None, 0), (2, None, 5.0, None)]
    left, right = schema.split_labeled(both, "y")
    assert (left.count(), right.count(), "y" in right.columns) == (2, 1, False)


def test_present_columns_build_on_each_other(spark):
    df = spark.createDataFrame([(1, 2.0)], "i int, a double")
    out = schema.with_present(
        df,
        [
            schema.Derived("b", ("a",), F.col("a") + 1),
            schema.Derived("no", ("missing",), F.col("missing")),
            schema.Derived("c", ("b",), F.col("b") * 2),
            schema.Derived("d", ("no",), F.col("no")),
        ],
    )
    assert out.columns == ["i", "a", "b", "c"]
    assert out.first()["c"] == 6.0


def test_roles(spark):
    df = spark.createDataFrame([(1, 2.0, "x", True, 3, 1.0)], "id int, a double, b string, c boolean, d int, y double")
    roles = schema.infer_roles(df, "id", ["y"], ["d"])
    assert (roles.numeric, roles.categorical) == (["a"], ["b", "c", "d"])


def test_outliers_keep_nulls(spark):
    rows = [(0, 5000.0, 1.0), (1, 5000.0, 300000.0), (2, 3999.0, 1.0), (3, None, 1.0), (4, 5000.0, None)]
    df = spark.createDataFrame(rows, "i int, area double, price double")
    kept = schema.filter_training_outliers(df, "area", "price")
    assert column(kept, "i") == [1, 2, 3, 4]
    assert schema.filter_training_outliers(df, "area", "price", enabled=False).count() == 5
    assert schema.filter_training_outliers(df, "area", "nothing").count() == 5


def test_house_sets(spark):
    row = {c: 2.0 for c in house.ADVANCED_LOGS if c not in ("TotalSF", "TotalHomeSF", "TotalPorchSF")}
    row |= {"Id": 1.0, "YrSold": 2010.0, "YearBuilt": 2000.0, "YearRemodAdd": 2005.0, "GarageYrBlt": None, "OverallQual": 3.0}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"`{c}` double" for c in row))
    basic, advanced = house.house_features(df), house.house_features(df, advanced=True)
    got = advanced.first()
    assert got["HouseAgeAtSale"] == 10.0 and got["GarageAgeAtSale"] is None
    assert (got["TotalBathrooms"], got["TotalPorchSF"], got["TotalHomeSF"]) == (6.0, 8.0, 8.0)
    assert (got["OverallQualSquared"], got["OverallQualCubed"], got["OverallQualXTotalSF"]) == (9.0, 27.0, 18.0)
    assert got["HasPool"] == 1.0 and math.isclose(got["TotalHomeSFLog1p"], math.log(9))
    assert sum(c.endswith("Log1p") for c in basic.columns) == 9
    assert sum(c.endswith("Log1p") for c in advanced.columns) == 31
    assert "OverallQualSquared" not in basic.columns
