"""Features taken from text columns, as built-in column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and group names that the results depend on.
TITLE_PATTERN = r",\s*([^\.]+)\."
SURNAME_PATTERN = r"^([^,]+),"
LEADING_NON_DIGITS = r"^([^0-9]+)"
NOT_A_LETTER = r"[^A-Z]"
WHITESPACE = r"\s+"
MISSING = "missing"
NUMERIC = "NUMERIC"
RARE_TITLE = "Rare"
TITLE_GROUPS = {
    "Mr": "Mr",
    "Mrs": "Mrs",
    "Miss": "Miss",
    "Master": "Master",
    "Mlle": "Miss",
    "Ms": "Miss",
    "Mme": "Mrs",
}
# End of fixed values.


def extract_title(name: Column) -> Column:
    """The words between the comma and the next point; '' if there are none."""
    return F.regexp_extract(name, TITLE_PATTERN, 1)


def extract_surname(name: Column) -> Column:
    """The text before the first comma; '' if there is no comma."""
    return F.regexp_extract(name, SURNAME_PATTERN, 1)


def group_values(value: Column, groups: Mapping[str, str], other: str) -> Column:
    """Map values to group names; all other values, null too, get ``other``."""
    lookup = F.create_map(*[F.lit(part) for pair in groups.items() for part in pair])
    return F.coalesce(lookup[value], F.lit(other))


def fill_const(value: Column, constant: str) -> Column:
    return F.coalesce(value, F.lit(constant))


def is_blank(value: Column) -> Column:
    return value.isNull() | (F.length(F.trim(value)) == 0)


def first_letter(value: Column, missing: str = MISSING) -> Column:
    """The first character of the untrimmed value, or ``missing`` if blank."""
    return F.when(is_blank(value), F.lit(missing)).otherwise(F.substring(value, 1, 1))


def token_count(value: Column) -> Column:
    """How many whitespace-separated tokens, as a double; 0.0 if blank."""
    tokens = F.size(F.split(F.trim(value), WHITESPACE)).cast("double")
    return F.when(is_blank(value), F.lit(0.0)).otherwise(tokens)


def alpha_prefix(value: Column, no_letters: str = NUMERIC) -> Column:
    """The letters before the first digit, upper case; null stays null."""
    letters = F.regexp_replace(F.regexp_extract(F.upper(value), LEADING_NON_DIGITS, 1), NOT_A_LETTER, "")
    return F.when(F.length(letters) == 0, F.lit(no_letters)).otherwise(letters)


def as_category(number: Column) -> Column:
    """A number as the text of its whole part."""
    return number.cast("int").cast("string")


def bucket(value: Column, single: float, edges: Sequence[float], names: Sequence[str]) -> Column:
    """``names[0]`` at ``single``, then the first edge that is not exceeded.

    The last name takes larger values and null.
    """
    chain = F.when(value == F.lit(single), F.lit(names[0]))
    for edge, name in zip(edges, names[1:-1], strict=True):
        chain = chain.when(value <= F.lit(edge), F.lit(name))
    return chain.otherwise(F.lit(names[-1]))
