"""Aggregations, joins and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.catalog.base import (
    auc_sql,
    fold_sql,
    from_features,
    from_houses,
    from_passengers,
    given_score,
    register,
    row_features,
    scored,
    scores_sql,
)
from tabloom.catalog.tables import MEMBER_SCORES_SQL, member_scores
from tabloom.functions.numeric import at_threshold
from tabloom.operators import groups, metrics, ordering, votes
from tabloom.operators.folds import with_folds
from tabloom.operators.joining import attach_stats, join_by_id
from tabloom.operators.quantile import grouped_median, grouped_quantile, impute_median
from tabloom.operators.rules import segment_flags
from tabloom.plans import passenger, views

# Aggregations


@register(
    "group_size",
    from_features(
        "SELECT 'Surname' AS kind, Surname AS value, SurnameGroupSize AS size FROM s1 UNION ALL SELECT 'Ticket', Ticket, TicketGroupSize FROM s2"
    ),
)
def group_size(spark, sf_dir):
    rows = row_features(spark, sf_dir)
    parts = [
        groups.group_size(rows, [k], "size").select(F.lit(k).alias("kind"), F.col(k).alias("value"), "size")
        for k in ("Surname", "Ticket")
    ]
    return parts[0].unionByName(parts[1])


@register(
    "group_size_suppliers",
    "SELECT l_suppkey, l_returnflag, CAST(count(*) AS DOUBLE) AS size FROM lineitem GROUP BY ALL",
)
def group_size_suppliers(spark, sf_dir):
    return groups.group_size(views.table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_returnflag"], "size")


@register(
    "grouped_median",
    from_features(
        "SELECT 'a1' AS level, Sex, Pclass, TitleGroup, CAST(NULL AS VARCHAR) AS port, m FROM a1"
        " UNION ALL SELECT 'a2', Sex, Pclass, NULL, NULL, m FROM a2"
        " UNION ALL SELECT 'f1', NULL, Pclass, NULL, EmbarkedFilled, m FROM f1"
        " UNION ALL SELECT 'f2', NULL, Pclass, NULL, NULL, m FROM f2"
    ),
)
def grouped_median_(spark, sf_dir):
    rows = row_features(spark, sf_dir).withColumnRenamed("EmbarkedFilledBase", "port")
    n_rows = rows.count()
    levels = {
        "a1": (["Sex", "Pclass", "TitleGroup"], "Age"),
        "a2": (["Sex", "Pclass"], "Age"),
        "f1": (["Pclass", "port"], "Fare"),
        "f2": (["Pclass"], "Fare"),
    }
    out = None
    for name, (keys, column) in levels.items():
        part = grouped_median(rows, keys, column, "m", n_rows).withColumn("level", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.select("level", "Sex", "Pclass", "TitleGroup", "port", "m")


@register(
    "grouped_median_prices",
    "SELECT l_returnflag, l_linestatus, quantile_disc(l_extendedprice, 0.5) AS m FROM lineitem GROUP BY ALL",
)
def grouped_median_prices(spark, sf_dir):
    """Few large groups: values are counted per slice, and only one slice of each group is ranked."""
    rows = views.table(spark, sf_dir, "lineitem")
    return grouped_median(rows, ["l_returnflag", "l_linestatus"], "l_extendedprice", "m", rows_per_slice=20_000)


@register(
    "global_median",
    from_passengers(
        "SELECT 'Age' AS feature, quantile_disc(Age, 0.5) AS m FROM p UNION ALL SELECT 'Fare', quantile_disc(Fare, 0.5) FROM p"
    ),
)
def global_median(spark, sf_dir):
    rows = views.passengers(spark, sf_dir)
    parts = [grouped_quantile(rows, [], c, "m").select(F.lit(c).alias("feature"), "m") for c in ("Age", "Fare")]
    return parts[0].unionByName(parts[1])


@register(
    "median_imputer",
    from_houses(
        "SELECT Id, coalesce(GarageYrBlt, (SELECT quantile_disc(GarageYrBlt, 0.5) FROM h)) AS GarageYrBlt_imputed,"
        " coalesce(TotalBsmtSF, (SELECT quantile_disc(TotalBsmtSF, 0.5) FROM h)) AS TotalBsmtSF_imputed FROM h"
    ),
)
def median_imputer(spark, sf_dir):
    columns = ["GarageYrBlt", "TotalBsmtSF"]
    return impute_median(views.houses(spark, sf_dir).select("Id", *columns), columns, [f"{c}_imputed" for c in columns]).drop(
        *columns
    )


EVIDENCE_SQL = " UNION ALL ".join(
    f"""SELECT '{key}' AS kind, {key} AS key, nullif(CAST(count(*) FILTER (WHERE am) AS DOUBLE), 0) AS am_count,
 avg(Survived) FILTER (WHERE am) AS am_rate, nullif(CAST(count(*) FILTER (WHERE NOT am) AS DOUBLE), 0) AS wc_count,
 avg(Survived) FILTER (WHERE NOT am) AS wc_rate
 FROM (SELECT *, coalesce(Sex = 'male' AND Age >= 16 AND TitleGroup <> 'Master', false) AS am FROM b WHERE Survived IS NOT NULL) GROUP BY {key}"""
    for key in ("Surname", "Ticket")
)


@register("group_rule_stats", from_features(EVIDENCE_SQL))
def group_rule_stats(spark, sf_dir):
    known = segment_flags(row_features(spark, sf_dir).where("Survived IS NOT NULL"), age="Age")
    segments = {"am": F.col("AdultMale") == 1.0, "wc": F.col("WomenChild") == 1.0}
    parts = [groups.group_evidence(known, [k], segments, "Survived").withColumnRenamed(k, "key") for k in ("Surname", "Ticket")]
    surname, ticket = [p.select(F.lit(k).alias("kind"), *p.columns) for k, p in zip(("Surname", "Ticket"), parts)]
    return surname.unionByName(ticket)


@register(
    "accuracy",
    from_passengers(
        ", "
        + MEMBER_SCORES_SQL.format(scores=scores_sql())
        + " SELECT candidate, round(avg(CAST((score >= 0.5) = (Survived = 1) AS DOUBLE)), 6) AS accuracy FROM q GROUP BY candidate"
    ),
)
def accuracy(spark, sf_dir):
    rows = member_scores(views.passengers(spark, sf_dir)).withColumn("prediction", at_threshold(F.col("score"), 0.5))
    out = metrics.accuracy(rows, label="Survived", keys=["candidate"])
    return out.withColumn("accuracy", F.round("accuracy", 6))


@register(
    "auc_roc",
    from_passengers(
        ", "
        + MEMBER_SCORES_SQL.format(scores=scores_sql())
        + " SELECT candidate, round(auc, 6) AS auc FROM ("
        + auc_sql("q", "score", "Survived", "candidate")
        + ")"
    ),
)
def auc_roc(spark, sf_dir):
    out = metrics.roc_auc(member_scores(views.passengers(spark, sf_dir)), "score", "Survived", ["candidate"])
    return out.withColumn("auc", F.round("auc", 6))


@register(
    "auc_roc_sliced",
    "SELECT round(auc, 6) AS auc FROM ("
    + auc_sql("(SELECT l_extendedprice AS score, CAST(l_returnflag = 'R' AS INT) AS hit FROM lineitem)", "score", "hit")
    + ")",
)
def auc_roc_sliced(spark, sf_dir):
    """Nearly continuous scores, ranked slice by slice."""
    rows = views.table(spark, sf_dir, "lineitem").select(
        F.col("l_extendedprice").alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("hit")
    )
    out = metrics.roc_auc(rows, "score", "hit", rows_per_slice=10_000)
    return out.withColumn("auc", F.round("auc", 6))


def house_guesses(spark, sf_dir):
    """The log target and two given predictions of it."""
    return views.houses(spark, sf_dir).select(
        "Id",
        F.log1p("SalePrice").alias("y"),
        (F.lit(11.0) + F.col("OverallQual") / 5.0).alias("first"),
        (F.lit(11.0) + F.col("GrLivArea") / 2500.0).alias("second"),
    )


HOUSE_GUESSES = "q AS (SELECT Id, ln(1 + SalePrice) AS y, 11.0::DOUBLE + OverallQual / 5.0::DOUBLE AS first, 11.0::DOUBLE + GrLivArea / 2500.0::DOUBLE AS second FROM h)"


@register("log_rmse", from_houses(f", {HOUSE_GUESSES} SELECT round(sqrt(avg((y - first) ** 2)), 6) AS rmse FROM q"))
def log_rmse(spark, sf_dir):
    return metrics.rmse(house_guesses(spark, sf_dir), "y", "first").withColumn("rmse", F.round("rmse", 6))


@register(
    "weight_sweep",
    from_houses(
        f", {HOUSE_GUESSES} SELECT "
        + ", ".join(
            f"round(sqrt(avg((y - (first * {1 - w} + second * {w})) ** 2)), 6) AS rmse_xgb_{w * 100:.0f}"
            for w in metrics.SWEEP_WEIGHTS
        )
        + " FROM q"
    ),
)
def weight_sweep(spark, sf_dir):
    out = metrics.blend_sweep(house_guesses(spark, sf_dir), "first", "second", "y")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@register(
    "fold_mean",
    from_passengers(
        f", {fold_sql('p', 'PassengerId', 5)}, "
        + "q AS (SELECT fold, Survived, unnest(['m0', 'm1', 'm2', 'm3']) AS candidate, unnest([m0, m1, m2, m3]) AS score FROM (SELECT *, "
        + scores_sql()
        + " FROM folded)), a AS ("
        + auc_sql("q", "score", "Survived", "candidate, fold")
        + "), s AS (SELECT candidate, fold, avg(CAST((score >= 0.5) = (Survived = 1) AS DOUBLE)) AS accuracy FROM q GROUP BY ALL)"
        " SELECT candidate, round(avg(accuracy), 6) AS accuracy, round(avg(auc), 6) AS auc FROM s JOIN a USING (candidate, fold) GROUP BY candidate"
    ),
)
def fold_mean(spark, sf_dir):
    rows = scored(with_folds(views.passengers(spark, sf_dir), "PassengerId", 5))
    pairs = F.array(*[F.struct(F.lit(m).alias("candidate"), F.col(m).alias("score")) for m in ("m0", "m1", "m2", "m3")])
    long = rows.select("__fold", "Survived", F.explode(pairs).alias("s")).select("__fold", "Survived", "s.*")
    long = long.withColumn("prediction", at_threshold(F.col("score"), 0.5))
    scores = metrics.classification_scores(long, "Survived", ["candidate", "__fold"], score="score")
    out = metrics.fold_mean(scores, ["candidate"], ["accuracy", "auc"])
    return out.withColumns({c: F.round(c, 6) for c in ("accuracy", "auc")})


@register(
    "seed_summary",
    from_houses(
        f", {HOUSE_GUESSES}, s AS (SELECT Neighborhood AS seed, sqrt(avg((y - first) ** 2)) AS rmse FROM q JOIN h USING (Id) GROUP BY ALL)"
        " SELECT round(avg(rmse), 6) AS mean, round(stddev_pop(rmse), 6) AS stddev FROM s"
    ),
)
def seed_summary(spark, sf_dir):
    """One score per neighbourhood in place of one per seed."""
    rows = views.houses(spark, sf_dir).select(
        F.col("Neighborhood").alias("seed"), F.log1p("SalePrice").alias("y"), (F.lit(11.0) + F.col("OverallQual") / 5.0).alias("first")
    )
    out = metrics.seed_summary(metrics.rmse(rows, "y", "first", ["seed"]), "rmse")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@register(
    "vote_sum",
    from_passengers(
        f", v AS (SELECT PassengerId, {', '.join(f'CAST({views.score_sql(m, 'PassengerId')} >= 0.5 AS INT) AS pred_{i}' for i, m in enumerate(views.SCORE_MULTIPLIERS))},"
        " CASE WHEN Survived IS NULL THEN NULL ELSE 1 END AS pred_known FROM p)"
        " SELECT PassengerId, pred_0 + pred_1 + pred_2 + pred_3 + pred_known AS votes, 5 AS voters,"
        " pred_0 + pred_1 + pred_2 + pred_3 + coalesce(pred_known, 0) AS votes0 FROM v"
    ),
)
def vote_sum(spark, sf_dir):
    rows = scored(views.passengers(spark, sf_dir)).select(
        "PassengerId",
        *[at_threshold(F.col(f"m{i}"), 0.5).cast("int").alias(f"pred_{i}") for i in range(4)],
        F.when(F.col("Survived").isNotNull(), 1).alias("pred_known"),
    )
    strict = votes.vote_sum(rows, total="votes", count="voters")
    return votes.vote_sum(strict, total="votes0", count="voters", null_as_zero=True).select(
        "PassengerId", "votes", "voters", "votes0"
    )


# Joins


@register(
    "join_group_stats",
    from_features("SELECT PassengerId, SurnameGroupSize, TicketGroupSize, a1.m AS AgeMedianTitle, a2.m AS AgeMedianClass,"
                  " f1.m AS FareMedianPort, f2.m AS FareMedianClass FROM j"
                  " LEFT JOIN a1 ON a1.Sex = j.Sex AND a1.Pclass = j.Pclass AND a1.TitleGroup = j.TitleGroup"
                  " LEFT JOIN a2 ON a2.Sex = j.Sex AND a2.Pclass = j.Pclass"
                  " LEFT JOIN f1 ON f1.Pclass = j.Pclass AND f1.EmbarkedFilled = j.EmbarkedFilled"
                  " LEFT JOIN f2 ON f2.Pclass = j.Pclass"),
)
def join_group_stats(spark, sf_dir):
    rows = row_features(spark, sf_dir)
    rows = rows.withColumn("EmbarkedFilled", F.coalesce("Embarked", F.lit("S")))
    medians = [
        ("Age", "AgeMedianTitle", ["Sex", "Pclass", "TitleGroup"]), ("Age", "AgeMedianClass", ["Sex", "Pclass"]),
        ("Fare", "FareMedianPort", ["Pclass", "EmbarkedFilled"]), ("Fare", "FareMedianClass", ["Pclass"]),
    ]
    tables = [(groups.group_size(rows, [k], f"{k}GroupSize"), [k]) for k in ("Surname", "Ticket")]
    tables += [(grouped_median(rows, keys, column, out), keys) for column, out, keys in medians]
    return attach_stats(rows, tables).select("PassengerId", "SurnameGroupSize", "TicketGroupSize", *[m[1] for m in medians])


@register(
    "join_group_stats_equal_rows",
    "SELECT l_returnflag, CAST(count(*) OVER (PARTITION BY l_returnflag) AS DOUBLE) AS flag_size FROM lineitem",
)
def join_group_stats_equal_rows(spark, sf_dir):
    """Rows with nothing but a hot key, their statistics taken as too large to broadcast."""
    rows = views.table(spark, sf_dir, "lineitem").select("l_returnflag")
    sizes = groups.group_size(rows, ["l_returnflag"], "flag_size")
    return attach_stats(rows, [(sizes, ["l_returnflag"])], max_broadcast_bytes=0, hot_rows=1_000)


@register(
    "join_group_stats_large",
    "SELECT l_orderkey, l_linenumber, l_partkey, flag_size, part_size FROM ("
    " SELECT *, CAST(count(*) OVER (PARTITION BY l_returnflag) AS DOUBLE) AS flag_size,"
    " CAST(count(*) OVER (PARTITION BY l_partkey) AS DOUBLE) AS part_size FROM lineitem)",
)
def join_group_stats_large(spark, sf_dir):
    """Statistics taken as too large to broadcast: hot keys are spread, the rest is shuffled."""
    rows = views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    tables = [
        (groups.group_size(rows, ["l_returnflag"], "flag_size"), ["l_returnflag"]),
        (groups.group_size(rows, ["l_partkey"], "part_size"), ["l_partkey"]),
    ]
    return attach_stats(rows, tables, max_broadcast_bytes=100, hot_rows=5_000).drop("l_returnflag")


@register("hierarchical_impute", from_features("SELECT PassengerId, AgeFilled, FareFilled FROM f"))
def hierarchical_impute(spark, sf_dir):
    rows = row_features(spark, sf_dir)
    n_rows = rows.count()
    for column, levels, default in (("Age", passenger.AGE_LEVELS, 28.0), ("Fare", passenger.FARE_LEVELS, 14.4542)):
        tables = [(grouped_median(rows, keys, column, out, n_rows), list(keys)) for out, keys in levels]
        rows = groups.impute_hierarchical(rows, column, tables, default, f"{column}Filled")
    return rows.select("PassengerId", "AgeFilled", "FareFilled")


@register(
    "join_predictions_inner",
    from_passengers(
        "SELECT x.PassengerId, p0, p1 FROM (SELECT PassengerId, " + views.score_sql(37, "PassengerId") + " AS p0 FROM p) x JOIN"
        " (SELECT PassengerId, " + views.score_sql(101, "PassengerId") + " AS p1 FROM p WHERE Age IS NOT NULL) y USING (PassengerId)"
    ),
)
def join_predictions_inner(spark, sf_dir):
    rows = views.passengers(spark, sf_dir)
    first = rows.select("PassengerId", given_score(37).alias("p0"))
    second = rows.where("Age IS NOT NULL").select("PassengerId", given_score(101).alias("p1"))
    return join_by_id([first, second], "PassengerId")


@register(
    "join_diagnostics",
    from_passengers(
        "SELECT p.PassengerId, p0, p1 FROM p LEFT JOIN (SELECT PassengerId, " + views.score_sql(37, "PassengerId") + " AS p0 FROM p"
        " WHERE Fare IS NOT NULL) x USING (PassengerId) LEFT JOIN (SELECT PassengerId, " + views.score_sql(101, "PassengerId") +
        " AS p1 FROM p WHERE Age IS NOT NULL) y USING (PassengerId)"
    ),
)
def join_diagnostics(spark, sf_dir):
    rows = views.passengers(spark, sf_dir)
    first = rows.where("Fare IS NOT NULL").select("PassengerId", given_score(37).alias("p0"))
    second = rows.where("Age IS NOT NULL").select("PassengerId", given_score(101).alias("p1"))
    return join_by_id([rows.select("PassengerId"), first, second], "PassengerId", "left")


# Orders, shown as positions


@register("order_by_id", from_passengers("SELECT PassengerId, row_number() OVER (ORDER BY PassengerId) - 1 AS position FROM p"))
def order_by_id(spark, sf_dir):
    return ordering.position_in_order(views.passengers(spark, sf_dir).select("PassengerId"), [F.col("PassengerId").asc()])


DISAGREE_SQL = f"d AS (SELECT PassengerId, {views.score_sql(37, 'PassengerId')} AS s, ({views.score_sql(37, 'PassengerId')} >= 0.5) <> ({views.score_sql(101, 'PassengerId')} >= 0.5) AS differ FROM p)"


def disagreeing(spark, sf_dir):
    first, second = given_score(37), given_score(101)
    return views.passengers(spark, sf_dir).select(
        "PassengerId", first.alias("s"), ((first >= 0.5) != (second >= 0.5)).alias("differ")
    )


@register(
    "order_diagnostics",
    from_passengers(
        f", {DISAGREE_SQL} SELECT PassengerId, differ, row_number() OVER (ORDER BY differ DESC, abs(s - 0.5) DESC, PassengerId) - 1 AS position FROM d"
    ),
)
def order_diagnostics(spark, sf_dir):
    order = ordering.disagreement_order("differ", "PassengerId", "s")
    return ordering.position_in_order(disagreeing(spark, sf_dir), order).drop("s")


@register(
    "order_disagreement",
    from_passengers(
        f", {DISAGREE_SQL} SELECT PassengerId, differ, row_number() OVER (ORDER BY differ DESC, PassengerId) - 1 AS position FROM d"
    ),
)
def order_disagreement(spark, sf_dir):
    order = ordering.disagreement_order("differ", "PassengerId")
    return ordering.position_in_order(disagreeing(spark, sf_dir), order).drop("s")


@register(
    "best_candidate",
    from_passengers(
        ", "
        + MEMBER_SCORES_SQL.format(scores=scores_sql())
        + ", a AS ("
        + auc_sql("q", "score", "Survived", "candidate")
        + "), s AS (SELECT candidate, avg(CAST((score >= 0.5) = (Survived = 1) AS DOUBLE)) AS accuracy FROM q GROUP BY candidate)"
        " SELECT candidate, round(accuracy, 6) AS accuracy, round(auc, 6) AS auc FROM s JOIN a USING (candidate)"
        " ORDER BY s.accuracy DESC, a.auc DESC, candidate LIMIT 1"
    ),
)
def best_candidate(spark, sf_dir):
    rows = member_scores(views.passengers(spark, sf_dir)).withColumn("prediction", at_threshold(F.col("score"), 0.5))
    scores = metrics.classification_scores(rows, "Survived", ["candidate"], score="score")
    best = ordering.best_candidate(scores, position="candidate")
    return best.withColumns({c: F.round(c, 6) for c in ("accuracy", "auc")})
