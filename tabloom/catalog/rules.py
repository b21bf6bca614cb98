"""Rules over given scores, votes and diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.catalog.base import (
    FEATURES,
    features,
    from_features,
    from_houses,
    from_passengers,
    given_score,
    register,
    scored,
    scores_sql,
    written_features,
)
from tabloom.catalog.groups import HOUSE_GUESSES, house_guesses
from tabloom.functions.numeric import at_threshold
from tabloom.operators import rules, votes
from tabloom.operators.rules import RULE_VARIANTS
from tabloom.plans import views
from tabloom.plans.experiments import variant_outputs as outputs_of

SCORE = views.score_sql(37, "PassengerId")
BALANCED = next(v for v in RULE_VARIANTS if v.use_family and v.use_ticket and v.balanced)

# Groups fine enough that many of them had one outcome only.
SEGMENTED = (
    FEATURES
    + f""",
t AS (
  SELECT * EXCLUDE (Surname, Ticket), concat(Surname, ' ', Ticket) AS Surname, concat(Ticket, ' ', PclassText) AS Ticket,
    {SCORE} AS base_probability,
    CASE WHEN coalesce(Sex = 'male' AND AgeFilled >= 16 AND TitleGroup <> 'Master', false) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS AdultMale
  FROM f
),
u AS (SELECT *, 1.0::DOUBLE - AdultMale AS WomenChild FROM t)"""
)


def _evidence(key: str, source: str) -> str:
    parts = ", ".join(
        f"nullif(CAST(count(*) FILTER (WHERE {flag} = 1) AS DOUBLE), 0) AS {source}_{seg}_count,"
        f" avg(Survived) FILTER (WHERE {flag} = 1) AS {source}_{seg}_rate"
        for seg, flag in (("wc", "WomenChild"), ("am", "AdultMale"))
    )
    return f"e_{source} AS (SELECT {key}, {parts} FROM u WHERE Survived IS NOT NULL GROUP BY {key})"


EVIDENCED = (
    SEGMENTED
    + f", {_evidence('Surname', 'family')}, {_evidence('Ticket', 'ticket')},"
    + " x AS (SELECT u.*, e_family.* EXCLUDE (Surname), e_ticket.* EXCLUDE (Ticket)"
    + " FROM u LEFT JOIN e_family USING (Surname) LEFT JOIN e_ticket USING (Ticket))"
)


def _verdict_sql(variant) -> str:
    """CTE ``v`` over ``x`` with the verdict of one variant, in SQL of its own."""

    def fires(source, seg, value, on):
        flag = {"wc": "WomenChild", "am": "AdultMale"}[seg]
        return f"({flag} = 1 AND {source}_{seg}_count >= 1 AND {source}_{seg}_rate = {value})" if on else "false"

    fam, tic, bal = variant.use_family, variant.use_ticket, variant.balanced
    died = [
        (fires("family", "wc", 0, fam), "family_women_child_all_died"),
        (fires("ticket", "wc", 0, tic), "ticket_women_child_all_died"),
        (fires("family", "am", 0, fam and bal), "family_adult_male_all_died"),
        (fires("ticket", "am", 0, tic and bal), "ticket_adult_male_all_died"),
    ]
    lived = [
        (fires("family", "am", 1, fam), "family_adult_male_all_survived"),
        (fires("ticket", "am", 1, tic), "ticket_adult_male_all_survived"),
        (fires("family", "wc", 1, fam and bal), "family_women_child_all_survived"),
        (fires("ticket", "wc", 1, tic and bal), "ticket_women_child_all_survived"),
    ]
    reasons = " ".join(f"WHEN {c} THEN '{label}'" for c, label in died + lived)
    any_died, any_lived = (" OR ".join(c for c, _ in part) for part in (died, lived))
    return (
        f"SELECT *, CASE WHEN prediction = base_prediction THEN base_probability WHEN prediction = 1 THEN 0.99::DOUBLE"
        f" ELSE 0.01::DOUBLE END AS probability_one FROM (SELECT *, CASE WHEN {any_died} THEN 0.0::DOUBLE WHEN {any_lived} THEN 1.0::DOUBLE"
        f" ELSE base_prediction END AS prediction, CASE {reasons} ELSE 'model' END AS rule_reason FROM (SELECT *,"
        f" CASE WHEN base_probability >= {variant.threshold}::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS base_prediction FROM x))"
    )


def _with(body: str) -> str:
    return f"WITH {EVIDENCED} {body}"


def rule_sides(spark, sf_dir):
    """Labelled and unlabelled rows with fine groups and a given probability."""

    def fine(df):
        return df.withColumns(
            {
                "Surname": F.concat("Surname", F.lit(" "), "Ticket"),
                "Ticket": F.concat("Ticket", F.lit(" "), "PclassText"),
                "base_probability": given_score(37),
            }
        )

    train, test = written_features(spark, sf_dir, spread=False)
    return fine(train), fine(test)


def evidenced(spark, sf_dir):
    """All rows with the evidence of the labelled rows."""
    train, test = rule_sides(spark, sf_dir)
    return rules.attach_evidence(train.unionByName(test, allowMissingColumns=True), train)


@register("segment_flags", f"WITH {SEGMENTED} SELECT PassengerId, AdultMale, WomenChild FROM u")
def segment_flags(spark, sf_dir):
    train, test = features(spark, sf_dir)
    both = train.unionByName(test, allowMissingColumns=True)
    return rules.segment_flags(both).select("PassengerId", "AdultMale", "WomenChild")


THRESHOLDS = (("t047", 0.47), ("t050", 0.50), ("t053", 0.53))


@register(
    "threshold_prediction",
    from_passengers(
        "SELECT PassengerId, " + ", ".join(f"CAST({SCORE} >= {t} AS DOUBLE) AS {n}" for n, t in THRESHOLDS) + " FROM p"
    ),
)
def threshold_prediction(spark, sf_dir):
    return views.passengers(spark, sf_dir).select(
        "PassengerId", *[at_threshold(given_score(37), t).alias(n) for n, t in THRESHOLDS]
    )


EVIDENCE_COLUMNS = [f"{s}_{g}_{m}" for s in ("family", "ticket") for g in ("wc", "am") for m in ("count", "rate")]


@register("join_rule_evidence", _with(f"SELECT PassengerId, {', '.join(EVIDENCE_COLUMNS)} FROM x"))
def join_rule_evidence(spark, sf_dir):
    return evidenced(spark, sf_dir).select("PassengerId", *EVIDENCE_COLUMNS)


def _reasons_sql():
    parts = []
    for r in rules.EVIDENCE_RULES:
        flag = rules.SEGMENT_FLAGS[r.segment]
        prefix = f"{r.source}_{r.segment}"
        parts.append(
            f"count(*) FILTER (WHERE {flag} = 1 AND {prefix}_count >= 1 AND {prefix}_rate = {int(r.survived)}) AS {r.reason}"
        )
    return ", ".join(parts)


@register("evidence_rules", _with(f"SELECT Sex, {_reasons_sql()} FROM x GROUP BY Sex"))
def evidence_rules(spark, sf_dir):
    """How many rows each rule fires for."""
    fired = [F.count(F.when(r.fires(), 1)).alias(r.reason) for r in rules.EVIDENCE_RULES]
    return evidenced(spark, sf_dir).groupBy("Sex").agg(*fired)


@register("rule_override", _with(f"SELECT PassengerId, base_prediction, prediction FROM ({_verdict_sql(BALANCED)})"))
def rule_override(spark, sf_dir):
    return rules.apply_rules(evidenced(spark, sf_dir), BALANCED).select("PassengerId", "base_prediction", "prediction")


@register("probability_override", _with(f"SELECT PassengerId, probability_one FROM ({_verdict_sql(BALANCED)})"))
def probability_override(spark, sf_dir):
    return rules.apply_rules(evidenced(spark, sf_dir), BALANCED).select("PassengerId", "probability_one")


@register("rule_reason", _with(f"SELECT PassengerId, rule_reason FROM ({_verdict_sql(BALANCED)})"))
def rule_reason(spark, sf_dir):
    return rules.apply_rules(evidenced(spark, sf_dir), BALANCED).select("PassengerId", "rule_reason")


@register(
    "variant_set",
    _with(
        " UNION ALL ".join(
            f"SELECT '{v.name}' AS variant, rule_reason, count(*) AS n, CAST(sum(prediction) AS DOUBLE) AS survivors FROM ({_verdict_sql(v)}) GROUP BY rule_reason"
            for v in RULE_VARIANTS
        )
    ),
)
def variant_set(spark, sf_dir):
    """All seven variants over all rows: rows and predicted survivors per reason."""
    judged = rules.variant_rows(evidenced(spark, sf_dir), ["PassengerId"])
    return judged.groupBy("variant", "rule_reason").agg(
        F.count(F.lit(1)).alias("n"), F.sum("prediction").alias("survivors")
    )


@register(
    "variant_outputs",
    _with(
        " UNION ALL ".join(
            f"SELECT '{v.name}' AS variant, CAST(PassengerId AS INT) AS PassengerId, CAST(prediction AS INT) AS Survived"
            f" FROM ({_verdict_sql(v)}) WHERE Survived IS NULL"
            for v in RULE_VARIANTS
        )
    ),
)
def variant_outputs(spark, sf_dir):
    train, test = rule_sides(spark, sf_dir)
    out = None
    for name, table in outputs_of(rules.attach_evidence(test, train)).items():
        part = table.withColumn("variant", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def _wide_sql():
    columns = ", ".join(
        f"v{i}.prediction AS pred_{v.name}, v{i}.probability_one AS p_{v.name}, v{i}.rule_reason AS rule_{v.name}"
        for i, v in enumerate(RULE_VARIANTS)
    )
    joins = " ".join(f"JOIN ({_verdict_sql(v)}) v{i} USING (PassengerId)" for i, v in enumerate(RULE_VARIANTS))
    total = " + ".join(f"CAST(pred_{v.name} AS INT)" for v in RULE_VARIANTS) + " + pred_base"
    casts = ", ".join(f"CAST(pred_{v.name} AS INT) AS pred_{v.name}" for v in RULE_VARIANTS)
    return _with(
        f", y AS (SELECT {', '.join('x.' + c for c in rules.DIAGNOSTIC_COLUMNS)}, x.base_probability,"
        f" CAST(x.base_probability >= 0.5 AS INT) AS pred_base, {columns} FROM x {joins} WHERE x.Survived IS NULL)"
        f" SELECT * REPLACE ({casts}), {total} AS vote_sum, 8 AS variant_count, ({total}) NOT IN (0, 8) AS has_disagreement FROM y"
    )


@register("variant_diagnostics", _wide_sql())
def variant_diagnostics(spark, sf_dir):
    train, test = rule_sides(spark, sf_dir)
    based = rules.attach_evidence(test, train).withColumn("prediction", at_threshold(F.col("base_probability"), 0.5))
    return rules.variant_diagnostics(rules.variant_columns(based))


MODELS = ("rf", "gbt", "lr", "xgb")


@register(
    "model_disagreement",
    from_features(
        f", y AS (SELECT {', '.join(rules.DIAGNOSTIC_COLUMNS)}, "
        + ", ".join(
            f"CAST({views.score_sql(m, 'PassengerId')} >= 0.5 AS INT) AS pred_{n}, {views.score_sql(m, 'PassengerId')} AS p_{n}"
            for n, m in zip(MODELS, views.SCORE_MULTIPLIERS, strict=True)
        )
        + " FROM f WHERE Survived IS NULL) SELECT *, pred_rf + pred_gbt + pred_lr + pred_xgb AS model_vote_sum, 4 AS model_count,"
        " pred_rf + pred_gbt + pred_lr + pred_xgb NOT IN (0, 4) AS model_disagreement FROM y"
    ),
)
def model_disagreement(spark, sf_dir):
    _, test = features(spark, sf_dir)
    voted = {}
    for name, multiplier in zip(MODELS, views.SCORE_MULTIPLIERS, strict=True):
        voted[f"pred_{name}"] = at_threshold(given_score(multiplier), 0.5).cast("int")
        voted[f"p_{name}"] = given_score(multiplier)
    return rules.model_disagreement(test.withColumns(voted))


@register(
    "soft_vote",
    from_passengers(
        f", v AS (SELECT PassengerId, Survived, (m0 + m1 + m2 + m3) / 4 AS probability_one FROM (SELECT *, {scores_sql()} FROM p))"
        " SELECT PassengerId, Survived, probability_one, CAST(probability_one >= 0.5 AS DOUBLE) AS prediction FROM v"
    ),
)
def soft_vote(spark, sf_dir):
    rows = scored(views.passengers(spark, sf_dir)).select("PassengerId", "Survived", "m0", "m1", "m2", "m3")
    return votes.soft_vote(rows, ["m0", "m1", "m2", "m3"]).select("PassengerId", "Survived", "probability_one", "prediction")


@register("log_blend", from_houses(f", {HOUSE_GUESSES} SELECT Id, round(first * 0.6 + second * 0.4, 6) AS prediction FROM q"))
def log_blend(spark, sf_dir):
    out = votes.log_blend(house_guesses(spark, sf_dir), "first", "second", 0.4)
    return out.select("Id", F.round("prediction", 6).alias("prediction"))
