"""Value rules: thresholds, windows, splitting and describing measured values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from cohortline.functions.numbers import to_number

# Severity bounds per analyte, from class 0 upward.
SEVERITY = {
    "creatinine": (1.2, 2.0, 3.5, 5.0),
    "bilirubin": (1.2, 2.0, 6.0, 12.0),
    "platelets": (150.0, 100.0, 50.0, 20.0),
    "wbc": (4.0, 12.0),
}
# Post-operative day windows (first one closed on both ends).
DAY_WINDOWS = (("0-30d", 0, 30), ("30-180d", 30, 180), ("180-365d", 180, 365), ("365d+", 365, None))


def severity(value: Column, analyte: str) -> Column:
    """Severity class of a mean value; platelets get worse downward, wbc has three classes."""
    bounds = SEVERITY[analyte]
    if analyte == "wbc":
        low, high = bounds
        return F.when(value < low, 0).when(value <= high, 1).when(value > high, 2)
    if analyte == "platelets":
        steps = [(value >= b, i) for i, b in enumerate(bounds)]
    else:
        steps = [(value < b, i) for i, b in enumerate(bounds)]
    chain = reduce(lambda c, s: c.when(*s), steps[1:], F.when(*steps[0]))
    return chain.when(value.isNotNull(), len(bounds))


def day_window(day: Column) -> Column:
    chain = None
    for i, (name, start, end) in enumerate(DAY_WINDOWS):
        inside = (day >= start) if i == 0 else (day > start)
        if end is not None:
            inside = inside & (day <= end)
        chain = F.when(inside, name) if chain is None else chain.when(inside, name)
    return chain


def pressure_parts(item: Column, value: Column, unit: Column) -> Column:
    """Rows of one observation: a blood pressure pair gives systolic and diastolic, anything else itself."""
    pattern = r"(-?\d+(?:\.\d+)?)\s*/\s*(-?\d+(?:\.\d+)?)"

    def row(name: Column, part: Column, of: Column) -> Column:
        return F.struct(name.alias("item"), part.alias("value"), of.alias("unit"))

    pressure_unit = F.when(unit == "", F.lit("mmHg")).otherwise(unit)
    pair = F.array(
        row(F.lit("Systolic Blood Pressure"), F.regexp_extract(value, pattern, 1), pressure_unit),
        row(F.lit("Diastolic Blood Pressure"), F.regexp_extract(value, pattern, 2), pressure_unit),
    )
    is_pair = (F.lower(F.trim(item)) == "blood pressure") & value.rlike(pattern)
    return F.when(F.coalesce(is_pair, F.lit(False)), pair).otherwise(F.array(row(item, value, unit)))


def item_and_unit(item: Column) -> Column:
    """`Weight (Lbs)` as (`Weight`, `Lbs`); no bracket gives an empty unit."""
    pattern = r"^(.*?)\s*\(([^()]*)\)\s*$"
    has = item.rlike(pattern)
    return F.struct(
        F.when(has, F.regexp_extract(item, pattern, 1)).otherwise(F.trim(item)).alias("item"),
        F.when(has, F.regexp_extract(item, pattern, 2)).otherwise(F.lit("")).alias("unit"),
    )


def value_and_unit(text: Column) -> Column:
    """Leading value and the rest as its unit, split at the first white space."""
    parts = F.split(F.trim(text), r"\s+", 2)
    return F.struct(parts[0].alias("value"), F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")).alias("unit"))


def multi_values(text: Column) -> Column:
    """Several results in one cell (`100-200`, `阴性-<400`) as an array of single results."""
    trimmed = F.trim(text)
    parts = F.filter(F.transform(F.split(trimmed, "-"), lambda x: F.trim(x)), lambda x: x != "")
    result = r"^(阴性|阳性)$|[<>]|^(\d+(\.\d+)?|\.\d+)$"
    several = (F.size(parts) >= 2) & F.forall(parts, lambda x: x.rlike(result))
    return F.when(F.coalesce(several, F.lit(False)), parts).otherwise(F.array(trimmed))


def spread_hours(index: Column, count: Column) -> Column:
    """Hours after the sample time at which the i-th of several results is placed."""
    return index * (F.lit(24.0) / count)


def described_value(text: Column, low: Column, high: Column, band: Column) -> Column:
    """A laboratory result as (value, flag): worded results, open bounds, severity band, then range."""
    plain = F.trim(text)
    word = F.lower(plain)
    number = to_number(plain)
    flag = (
        F.when(plain.contains("<"), "Normal")
        .when(plain.contains(">"), "Abnormal")
        .when(band.isNotNull(), band)
        .when((number < low) | (number > high), "Abnormal")
        .when(number.isNotNull(), "Normal")
    )
    return (
        F.when(word.isin("阴性", "negative"), F.struct(F.lit("Normal").alias("value"), F.lit("Normal").alias("flag")))
        .when(word.isin("阳性", "positive"), F.struct(F.lit("Abnormal").alias("value"), F.lit("Abnormal").alias("flag")))
        .otherwise(F.struct(plain.alias("value"), flag.alias("flag")))
    )


def index_ranges(text: Column) -> Column:
    """`3-5;9` as the ordered distinct positions [3, 4, 5, 9]; a reversed range is empty."""
    cleaned = F.filter(F.transform(F.split(text, ";"), lambda x: F.trim(x)), lambda x: x.rlike(r"^\d+(-\d+)?$"))

    def positions(part: Column) -> Column:
        ends = F.split(part, "-")
        first = ends[0].cast("int")
        last = F.element_at(ends, -1).cast("int")
        return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    return F.array_distinct(F.flatten(F.transform(cleaned, positions)))


def interface_or_system(interface: Column, system: Column) -> Column:
    return F.when(interface != "", interface).otherwise(system)
