"""Number parsing and numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from cohortline.functions.text import SPACE

# Fixed value: what a number looks like in a text cell (no type suffix, no hex).
NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
# Fixed value: a number inside running text.
NUMBER_IN_TEXT = r"-?\d+(?:\.\d+)?"


def to_number(value: Column) -> Column:
    """Number in a text cell, null for anything else."""
    return F.regexp_extract(value.cast("string"), rf"(?U)^{SPACE}*({NUMBER}){SPACE}*$", 1).try_cast("double")


def finite(value: Column) -> Column:
    """Null out NaN and the infinities."""
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)


def to_id(value: Column) -> Column:
    """Nullable whole id; `12.0` reads as 12."""
    return to_number(value).cast("bigint")


def id_text(value: Column) -> Column:
    """Id as text without a trailing `.0`."""
    return F.regexp_replace(F.trim(value.cast("string")), r"\.0$", "")


def parse_age(value: Column, above: str = "> 89", stands_for: float = 300.0) -> Column:
    return F.when(value == above, F.lit(stands_for)).otherwise(to_number(value))


def first_number(value: Column) -> Column:
    return F.nullif(F.regexp_extract(value, f"({NUMBER_IN_TEXT})", 1), F.lit("")).cast("double")


def all_numbers(value: Column) -> Column:
    found = F.regexp_extract_all(value, F.lit(f"({NUMBER_IN_TEXT})"), F.lit(1))
    return F.transform(found, lambda x: x.cast("double"))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def softmax(scores: Column) -> Column:
    """Softmax of an array, shifted by its largest element."""
    shifted = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    total = F.aggregate(shifted, F.lit(0.0), lambda a, x: a + x)
    return F.transform(shifted, lambda x: x / total)


def log1p_delta(hours: Column) -> Column:
    return F.log1p(F.greatest(hours, F.lit(0.0)))
