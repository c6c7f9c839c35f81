"""Column functions on the edge values of the sources."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortline.functions import numbers, text, times, values


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("given,want", [("  Nan ", ""), ("None", ""), (None, ""), (" a b ", "a b"), ("", "")])
def test_clean_text(spark, given, want):
    assert one(spark, given, text.clean_text) == want


@pytest.mark.parametrize("given,want", [(" μ G/ L", "ug/l"), ("µg", "ug"), ("mg ( total )", "mg(total)"), (None, "")])
def test_unit_key(spark, given, want):
    assert one(spark, given, text.unit_key) == want


@pytest.mark.parametrize("given,want", [("K/µL", "k/ul"), ("mg/dL (adult)", "mg/dl"), ("mm Hg", "mm hg")])
def test_unit_key_loose(spark, given, want):
    assert one(spark, given, text.unit_key_loose) == want


@pytest.mark.parametrize("given,want", [("1d", None), ("1f", None), ("NaN", None), (" 2.5 ", 2.5), ("-1e3", -1000.0), ("", None), ("0x10", None), (".5", 0.5)])
def test_to_number(spark, given, want):
    assert one(spark, given, numbers.to_number) == want


@pytest.mark.parametrize("given,want", [("> 89", 300.0), ("45", 45.0), ("old", None), (None, None)])
def test_parse_age(spark, given, want):
    assert one(spark, given, numbers.parse_age) == want


@pytest.mark.parametrize("given,want", [("12.0", 12), ("7", 7), ("x", None)])
def test_to_id(spark, given, want):
    assert one(spark, given, numbers.to_id) == want


@pytest.mark.parametrize("given,want", [
    ("2020-01-02 03:04:05", dt.datetime(2020, 1, 2, 3, 4, 5)), ("2020-01-02", dt.datetime(2020, 1, 2)), ("NaT", None), ("", None), ("soon", None),
])
def test_parse_time(spark, given, want):
    assert one(spark, given, times.parse_time) == want


def test_gap_to_missing_time_is_far(spark):
    row = spark.sql("SELECT TIMESTAMP_NTZ '2020-01-01 00:00:00' AS a, CAST(NULL AS TIMESTAMP_NTZ) AS b")
    assert row.select(times.gap_hours(F.col("a"), F.col("b"))).first()[0] == 1e9
    assert row.select(times.gap_hours(F.col("a"), F.col("b")) < 24).first()[0] is False


@pytest.mark.parametrize("given,want", [("12345.67", "00000012345"), ("123456789012", "123456789012"), ("00071015523", "00071015523")])
def test_ndc(spark, given, want):
    assert one(spark, given, text.ndc_key) == want


@pytest.mark.parametrize("given,want", [("'Yes'", 1), ('"no"', 0), ("True", 1), ("0", 0), ("maybe", None)])
def test_binary_label(spark, given, want):
    assert one(spark, given, text.binary_label) == want


@pytest.mark.parametrize("analyte,given,want", [
    ("creatinine", 1.2, 1), ("creatinine", 1.19, 0), ("creatinine", 5.0, 4), ("platelets", 150.0, 0), ("platelets", 19.0, 4),
    ("platelets", 20.0, 3), ("wbc", 12.0, 1), ("wbc", 12.1, 2), ("wbc", 3.9, 0), ("bilirubin", None, None),
])
def test_severity(spark, analyte, given, want):
    assert one(spark, given, lambda c: values.severity(c, analyte), "double") == want


@pytest.mark.parametrize("given,want", [(0.0, "0-30d"), (30.0, "0-30d"), (30.5, "30-180d"), (365.0, "180-365d"), (366.0, "365d+"), (-1.0, None)])
def test_day_window(spark, given, want):
    assert one(spark, given, values.day_window, "double") == want


@pytest.mark.parametrize("given,want", [
    ("100-200", ["100", "200"]), ("阴性-<400", ["阴性", "<400"]), ("-5", ["-5"]), ("a-b", ["a-b"]), ("7", ["7"]),
])
def test_multi_values(spark, given, want):
    assert one(spark, given, values.multi_values) == want


@pytest.mark.parametrize("given,want", [("3-5;9", [3, 4, 5, 9]), ("9-7; 3;3", [3]), ("", [])])
def test_index_ranges(spark, given, want):
    assert one(spark, given, values.index_ranges) == want


def test_pressure_and_units(spark):
    row = spark.createDataFrame([("Blood Pressure", "120/80", "")], "i string, v string, u string")
    got = row.select(values.pressure_parts(F.col("i"), F.col("v"), F.col("u"))).first()[0]
    assert [(g["item"], g["value"], g["unit"]) for g in got] == [
        ("Systolic Blood Pressure", "120", "mmHg"), ("Diastolic Blood Pressure", "80", "mmHg")]
    assert tuple(one(spark, "Weight (Lbs)", values.item_and_unit)) == ("Weight", "Lbs")
    assert tuple(one(spark, " 4.5  mg per dL", values.value_and_unit)) == ("4.5", "mg per dL")


def test_numbers_in_text(spark):
    assert one(spark, "day -3.5 of 9", numbers.first_number) == -3.5
    assert one(spark, "0.5mg/0", numbers.all_numbers) == [0.5, 0.0]


def test_softmax_and_softplus(spark):
    got = one(spark, [0.0, 0.0], numbers.softmax, "array<double>")
    assert got == [0.5, 0.5]
    assert one(spark, 0.0, numbers.softplus, "double") == pytest.approx(0.6931471805599453)


def test_interface_unit_wins(spark):
    row = spark.createDataFrame([("mg", "g"), ("", "g")], "a string, b string")
    got = [r[0] for r in row.select(values.interface_or_system(F.col("a"), F.col("b"))).collect()]
    assert got == ["mg", "g"]


def test_white_space_of_any_script(spark):
    rows = spark.createDataFrame([("\tHeart  rate\n",), (" nan ",), ("　mg / L　",), ("\t5 ",)], "v string")
    found = rows.select(text.item_key(F.col("v")), text.unit_key(F.col("v")), numbers.to_number(F.col("v"))).collect()
    assert [r[0] for r in found] == ["heart rate", "", "mg / l", "5"]
    assert [r[1] for r in found] == ["heartrate", "", "mg/l", "5"] and [r[2] for r in found] == [None, None, None, 5.0]


def test_pairs_past_doubles(spark):
    from cohortline.operators.phenotype import pairs_among

    given = [0, 1, 2, 3, 200_000_003, 3_000_000_000]
    rows = spark.createDataFrame([(n,) for n in given], "n long").select("n", pairs_among(F.col("n")).alias("k")).collect()
    assert all(r["k"] == r["n"] * (r["n"] - 1) // 2 for r in rows)


def test_negatives_are_filled_from_a_tiny_vocabulary(spark):
    from cohortline.operators.features import candidate_labels

    samples = spark.range(400).select(F.col("id").alias("sample_id"), (F.col("id") % 6).cast("string").alias("target"))
    vocabulary = spark.range(6).select(F.col("id").alias("idx"), F.col("id").cast("string").alias("target"))
    rows = candidate_labels(samples, vocabulary, 4).groupBy("sample_id").agg(F.count("*").alias("n"), F.sum("label").alias("own")).collect()
    assert len(rows) == 400 and all((r["n"], r["own"]) == (5, 1) for r in rows)


def test_keys_and_numbers_name_their_value_once(spark):
    from cohortline.functions import numbers, text

    for made in (text.item_key, text.unit_key, text.unit_key_loose, text.squeezed, text.rule_text, numbers.to_number):
        assert str(made(F.col("zzz"))).count("zzz") == 1
    odd = [" 1　", "\x1c2.5e3 ", " .5", "+7.", "1d", "0x1", "1e", "-", "", " NaN", "1 2", "١", "3\n", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in odd], "v string").select(numbers.to_number(F.col("v"))).collect()]
    assert got == [1.0, 2500.0, 0.5, 7.0, None, None, None, None, None, None, None, None, 3.0, None]


def test_tasks_of_measurements_stay_bounded(spark):
    from cohortline.plans import bindings as b

    rows = spark.range(100)
    assert b.spread_lines(rows, 5_000_001, "id").rdd.getNumPartitions() == 11
    assert b.spread_lines(rows, 100, "id").rdd.getNumPartitions() == rows.rdd.getNumPartitions()


def test_negatives_of_repeated_targets_and_of_no_sample(spark):
    from cohortline.operators.features import candidate_labels

    samples = spark.createDataFrame([(1, "0"), (None, "1"), (2, "x")], "sample_id long, target string")
    twice = spark.range(12).select(F.col("id").alias("idx"), F.expr("cast(id div 2 as string)").alias("target"))
    once = spark.range(6).select(F.col("id").alias("idx"), F.col("id").cast("string").alias("target"))
    for vocabulary in (once, twice):
        rows = candidate_labels(samples, vocabulary, 3)
        assert "LeftAnti" not in rows._jdf.queryExecution().toString()
        got = sorted((r["sample_id"] or 0, r["label"], r["target"]) for r in rows.collect())
        assert [r[:2] for r in got] == [(0, 1), (1, 0), (1, 0), (1, 0), (1, 1), (2, 0), (2, 0), (2, 0), (2, 1)]
        assert len(set(got)) == 9 and (1, 0, "0") not in got


def test_the_summary_makes_its_cohort_once(spark):
    from cohortline.operators.labels_icu import cohort_summary

    stays = spark.range(5).selectExpr("id", "id * 10.0D AS age_years", "if(id = 4, null, id / 2.0D) AS los", "if(id < 2, 'Male', null) AS gender", "id = 1 AS died_in_unit", "'Home' AS discharge_class")
    summary = cohort_summary(stays.unionAll(stays.where("id = 4")))
    assert "Range (" not in summary._jdf.queryExecution().toString()
    got = {(r["name"], r["level"]): r["value"] for r in summary.collect()}
    assert (got["stays", ""], got["age_median", ""], got["los_mean", ""], got["los_median", ""]) == (6.0, 25.0, 0.75, 0.75)
    assert (got["gender", ""], got["gender", "Male"], got["died_in_unit", "true"]) == (4.0, 2.0, 1.0)
