"""The classification feature set: row features, group sizes, imputed values."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions import numeric as num
from tabloom.functions import text as txt
from tabloom.operators.groups import first_known, group_size
from tabloom.operators.joining import attach_stats
from tabloom.operators.quantile import global_median, grouped_median
from tabloom.operators.schema import TRAIN_FLAG, drop_temp, split_labeled, to_double, union_labeled
from tabloom.runtime import materialize, together

# Column names, buckets, fill values and imputation levels.
ID = "PassengerId"
LABEL = "Survived"
AS_DOUBLE = ("Pclass", "SibSp", "Parch", "Age", "Fare")
PORT_FILL = "S"
SIZE_EDGES = (3.0, 5.0)
SIZE_NAMES = ("single", "small", "medium", "large")
AGE_LEVELS = (
    ("AgeMedianTitle", ("Sex", "Pclass", "TitleGroup")),
    ("AgeMedianClass", ("Sex", "Pclass")),
)
FARE_LEVELS = (
    ("FareMedianEmbarked", ("Pclass", "EmbarkedFilledBase")),
    ("FareMedianClass", ("Pclass",)),
)
AGE_DEFAULT, FARE_DEFAULT = 28.0, 14.4542
CATEGORICAL = ("Sex", "EmbarkedFilled", "PclassText", "TitleGroup", "Deck", "TicketPrefix", "FamilyBucket")
NUMERIC = (
    "AgeFilled",
    "FareFilled",
    "FarePerPerson",
    "FareLog1p",
    "SibSp",
    "Parch",
    "FamilySize",
    "IsAlone",
    "SurnameGroupSize",
    "TicketGroupSize",
    "HasCabin",
    "CabinCount",
    "IsNumericTicket",
    "AgeKnown",
    "FareKnown",
)
# End of fixed values.

# What the statistics read of each row.
STAT_COLUMNS = ("Surname", "Ticket", "Sex", "Pclass", "TitleGroup", "EmbarkedFilledBase", "Age", "Fare")


def row_features(df: DataFrame) -> DataFrame:
    """Features that need one row only, in two projections."""
    name, ticket, cabin = F.col("Name"), F.col("Ticket"), F.col("Cabin")
    family = num.sum_plus([F.col("SibSp"), F.col("Parch")], 1.0)
    first = to_double(df, AS_DOUBLE).withColumns(
        {
            "TitleGroup": txt.group_values(txt.extract_title(name), txt.TITLE_GROUPS, txt.RARE_TITLE),
            "Surname": txt.extract_surname(name),
            "EmbarkedFilledBase": txt.fill_const(F.col("Embarked"), PORT_FILL),
            "Deck": txt.first_letter(cabin),
            "CabinCount": txt.token_count(cabin),
            "TicketPrefix": txt.alpha_prefix(ticket),
            "FamilySize": family,
            "AgeKnown": num.known_flag(F.col("Age")),
            "FareKnown": num.known_flag(F.col("Fare")),
        }
    )
    return first.withColumns(
        {
            "HasCabin": num.flag(F.col("Deck") != txt.MISSING),
            "IsNumericTicket": num.flag(F.col("TicketPrefix") == txt.NUMERIC),
            "FamilyBucket": txt.bucket(F.col("FamilySize"), 1.0, SIZE_EDGES, SIZE_NAMES),
            "IsAlone": num.flag(F.col("FamilySize") == 1.0),
        }
    )


@dataclass(frozen=True)
class PassengerStats:
    """Everything the feature set learns from rows other than the row itself."""

    tables: Sequence[tuple[DataFrame, Sequence[str]]]
    age: float
    fare: float


def passenger_stats(rows: DataFrame, exact: bool = True) -> PassengerStats:
    """Group sizes and medians, from a frame with row features.

    The few columns that are read are written once, since each statistic scans
    them. ``exact=False`` takes medians from Spark's sketches.
    """
    rows = materialize(rows.select(*STAT_COLUMNS), "stat-columns")
    n_rows = rows.count() if exact else None
    tables: list[tuple[DataFrame, Sequence[str]]] = [
        (group_size(rows, ["Surname"], "SurnameGroupSize"), ["Surname"]),
        (group_size(rows, ["Ticket"], "TicketGroupSize"), ["Ticket"]),
    ]
    for column, levels in (("Age", AGE_LEVELS), ("Fare", FARE_LEVELS)):
        for out, keys in levels:
            medians = grouped_median(rows, keys, column, out, n_rows=n_rows, approximate=not exact)
            tables.append((medians, keys))
    error = 0.0 if exact else 0.001
    age, fare = together(
        rows.sparkSession,
        [
            partial(global_median, rows, "Age", AGE_DEFAULT, n_rows, relative_error=error),
            partial(global_median, rows, "Fare", FARE_DEFAULT, n_rows, relative_error=error),
        ],
    )
    return PassengerStats(tables, age, fare)


def with_stats(rows: DataFrame, stats: PassengerStats, **limits: int) -> DataFrame:
    """Row features plus group sizes, imputed age and fare, and what follows from them."""
    family = F.col("FamilySize")
    age_names, fare_names = ([out for out, _ in levels] for levels in (AGE_LEVELS, FARE_LEVELS))
    filled = attach_stats(rows, stats.tables, **limits).withColumns(
        {
            "AgeFilled": first_known("Age", age_names, stats.age),
            "FareFilled": first_known("Fare", fare_names, stats.fare),
            "EmbarkedFilled": F.col("EmbarkedFilledBase"),
            "PclassText": txt.as_category(F.col("Pclass")),
        }
    )
    derived = filled.withColumns(
        {
            "FarePerPerson": num.safe_ratio(F.col("FareFilled"), family),
            "FareLog1p": F.log1p("FareFilled"),
        }
    )
    return drop_temp(derived, [*age_names, *fare_names])


def passenger_features(
    train: DataFrame, test: DataFrame, scope: str = "all", exact: bool = True, **limits: int
) -> tuple[DataFrame, DataFrame]:
    """Train and test with the whole feature set.

    Statistics never read the label. ``scope='all'`` takes them from train and
    test rows together; ``scope='train'`` from the train rows only.
    """
    if scope not in ("all", "train"):
        raise ValueError("scope is 'all' or 'train'")
    rows = row_features(union_labeled(train, test, LABEL))
    source = rows if scope == "all" else rows.where(F.col(TRAIN_FLAG))
    return split_labeled(with_stats(rows, passenger_stats(source, exact), **limits), LABEL)
