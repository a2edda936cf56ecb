"""What counts as a missing cell in the churn feed, and how its contract names are spelt."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType, FloatType, StringType, StructType

# Stand-ins that cannot be a real value of their column. Zero is a real tenure and a
# real charge; negative charges, birth years and odd spellings are wrong but not missing.
STAND_INS: dict[str, list[float]] = {
    "age": [-1, 0, 999],
    "tenure_months": [-1, -99, 9999],
    "monthly_charges": [-1, -999, 99999],
}
TEXT_STAND_INS = ["", "-", "--", "?", "n.a.", "n/a", "na", "nan", "nil", "none", "null", "unknown", "#n/a"]

# Spellings of the four contracts after lower-casing and joining words by "_".
CONTRACTS = {
    "m": "monthly", "month_to_month": "monthly", "y1": "yearly", "annual": "yearly",
    "y2": "two_year", "2_year": "two_year", "t": "trial",
}


def plain_missing(schema: StructType, name: str) -> Column:
    """Null, or NaN where the column can hold it."""
    c = F.col(name)
    if isinstance(schema[name].dataType, (DoubleType, FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def missing_cell(schema: StructType, name: str) -> Column:
    """Null, NaN, or a stand-in of that column; never null itself."""
    c = F.col(name)
    bad = plain_missing(schema, name)
    if isinstance(schema[name].dataType, StringType):
        return bad | F.lower(F.trim(c)).isin(TEXT_STAND_INS)
    if name in STAND_INS:
        return bad | F.coalesce(c.isin(STAND_INS[name]), F.lit(False))
    return bad


def folded(c: Column) -> Column:
    """One spelling per word sequence: trimmed, lower case, words joined by an underscore."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s_\-]+", "_")


def contract_name(c: Column) -> Column:
    """The contract a spelling stands for."""
    f = folded(c)
    known = F.create_map(*[F.lit(x) for kv in CONTRACTS.items() for x in kv])
    return F.coalesce(known[f], f)
