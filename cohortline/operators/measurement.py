"""The uniform measurement table: Time, Item, Value, Unit, Category per sample.

Every source is one pass: a row becomes an array of (item, value, unit) by the rule of its table, which is
then exploded. Samples meet rows by bucketed range joins, so a long timeline is split over its buckets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cohortline.functions import text, times, values
from cohortline.operators.joins import within_interval
from cohortline.operators.ordered import position, time_bucket

# Category of each source table; other tables are observations.
CATEGORIES = {
    "labevents": "measurement", "microbiologyevents": "measurement", "omr": "observation", "emar": "drug_exposure",
    "triage": "measurement", "vitalsign": "measurement", "chartevents": "measurement", "inputevents": "drug_exposure",
    "outputevents": "measurement", "ingredientevents": "drug_exposure", "procedureevents": "procedure_occurrence",
    "datetimeevents": "observation", "services": "visit_detail", "transfers": "visit_detail", "poe": "observation",
    "prescriptions": "drug_exposure", "medrecon": "drug_exposure", "pyxis": "drug_exposure",
    "diagnosis": "condition_occurrence", "diagnoses_icd": "condition_occurrence", "patients": "person",
    "procedures_icd": "procedure_occurrence",
}
# Tables that never give rows, vital signs with their units, demographic columns.
EXCLUDED_TABLES = ("diagnosis", "diagnosis_icd", "diagnoses_icd", "poe")
VITALS = (
    ("temperature", "F"), ("heartrate", "bpm"), ("resprate", "breaths/min"), ("o2sat", "%"), ("sbp", "mmHg"),
    ("dbp", "mmHg"), ("pain", "score"), ("acuity", "level"), ("rhythm", ""),
)
DEMOGRAPHICS = (("anchor_age", "Age", "years"), ("gender", "Gender", ""), ("race", "Race", ""))
SEXES = {"M": "Male", "F": "Female"}
# Item, value and unit attributes of the plain tables, first non-empty wins.
ATTRIBUTES = {
    "labevents": (("item_name",), ("valuenum", "value"), ("valueuom",)),
    "chartevents": (("item_name",), ("valuenum", "value"), ("valueuom",)),
    "outputevents": (("item_name",), ("valuenum", "value"), ("valueuom",)),
    "procedureevents": (("item_name",), ("value",), ()),
    "datetimeevents": (("item_name",), ("value", "value_text"), ()),
    "services": (("curr_service", "prev_service", "service"), ("transfertime", "service"), ()),
    "transfers": (("careunit", "eventtype"), ("eventtype", "careunit"), ()),
    "prescriptions": (("drug", "formulary_drug_cd"), ("dose_val_rx", "prod_strength", "route"), ("dose_unit_rx", "form_unit_disp")),
}
# Tables whose rows name a thing without a value.
NAMED_ONLY = {
    "emar": ("medication",), "medrecon": ("name", "gsn", "ndc"), "pyxis": ("name", "gsn", "ndc"),
    "procedures_icd": ("procedures", "CCS Type", "icd_code"),
}
HIDDEN_ALWAYS = ("admissions", "patients", "discharge", "radiology")
TEXT_COLUMNS = ("Item", "Value", "Unit", "Category")


def _get(attrs: Column, names: Sequence[str]) -> Column:
    return text.first_non_empty(*[F.try_element_at(attrs, F.lit(n)) for n in names])


def _row(item: Column, value: Column, unit: Column) -> Column:
    return F.struct(item.alias("item"), value.alias("value"), unit.alias("unit"))


def table_rules() -> dict[str, list[tuple]]:
    """Rows each table gives, as (item names, fixed item, item suffix, value names, unit names, fixed unit).

    Of several names the first known attribute counts; no value name means a row without a value.
    """
    rules = {t: [(item, "", "", value, unit, "")] for t, (item, value, unit) in ATTRIBUTES.items()}
    rules |= {t: [(item, "", "", (), (), "")] for t, item in NAMED_ONLY.items()}
    for t in ("inputevents", "ingredientevents"):
        rules[t] = [(("item_name",), "", "_Amount", ("amount",), ("amountuom",), ""), (("item_name",), "", "_Rate", ("rate",), ("rateuom",), "")]
    for t in ("triage", "vitalsign"):
        rules[t] = [((), name.capitalize(), "", (name,), (), unit) for name, unit in VITALS]
    rules["patients"] = [((), label, "", (name,), (), unit) for name, label, unit in DEMOGRAPHICS]
    return rules


def _rule_map() -> Column:
    """The rules as one constant map, so that a row only meets the rules of its own table."""
    def words(names: Sequence[str]) -> Column:
        return F.array(*[F.lit(n) for n in names]).cast("array<string>")

    entries = []
    for name, rules in table_rules().items():
        listed = F.array(*[
            F.struct(words(i).alias("items"), F.lit(fixed).alias("fixed"), F.lit(suffix).alias("suffix"), words(v).alias("vals"), words(u).alias("units"),
                     F.lit(unit).alias("unit"))
            for i, fixed, suffix, v, u, unit in rules
        ])
        entries += [F.lit(name), listed]
    return F.create_map(*entries)


def hospital_rows(file_name: Column, attrs: Column) -> Column:
    """(item, value, unit) rows of one hospital source row, by the rules of its table; missing spellings count as none."""
    def first(names: Column) -> Column:
        found = F.transform(names, lambda n: F.trim(F.try_element_at(attrs, n)))
        return F.try_element_at(F.filter(found, lambda x: ~F.lower(x).isin(*text.MISSING_TEXT)), F.lit(1))

    def by_rule(r: Column) -> Column:
        name = F.coalesce(first(r["items"]), F.when(r["suffix"] != "", F.lit("")))
        item = F.when(r["fixed"] != "", r["fixed"]).otherwise(F.concat(name, r["suffix"]))
        raw = F.when(F.size(r["vals"]) == 0, F.lit("")).otherwise(first(r["vals"]))
        sex = F.when(r["fixed"] == "Gender", F.coalesce(text.mapped(F.upper(raw), SEXES), raw)).otherwise(raw)
        return _row(item, sex, F.coalesce(first(r["units"]), r["unit"]))

    culture = F.concat_ws("_", *[F.coalesce(F.try_element_at(attrs, F.lit(n)), F.lit("Unknown")) for n in ("test_name", "org_name", "ab_name")])
    cultures = F.array(_row(culture, _get(attrs, ("dilution_value", "interpretation")), F.lit("")))
    parsed = values.item_and_unit(_get(attrs, ("result_name",)))
    observations = values.pressure_parts(parsed["item"], _get(attrs, ("result_value", "value")), parsed["unit"])
    ruled = F.transform(F.try_element_at(_rule_map(), file_name), by_rule)
    chain = F.when(file_name == "microbiologyevents", cultures).when(file_name == "omr", observations).when(
        ~file_name.isin(*EXCLUDED_TABLES), ruled
    )
    return F.filter(chain, lambda r: r["item"].isNotNull() & (r["item"] != "") & r["value"].isNotNull())


def hospital_table(rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Measurement rows of hospital source rows. `rows`: file_name, starttime, attrs and the `keep` columns."""
    categories = F.create_map(*[F.lit(x) for pair in CATEGORIES.items() for x in pair])
    known = rows.where(F.col("file_name").isin(*CATEGORIES))
    exploded = known.select(
        *keep, "file_name", "starttime", F.posexplode(hospital_rows(F.col("file_name"), F.col("attrs"))).alias("part", "r")
    )
    return exploded.select(
        *keep, "part", F.col("starttime").alias("Time"), F.col("r.item").alias("Item"), F.col("r.value").alias("Value"),
        F.col("r.unit").alias("Unit"), categories[F.col("file_name")].alias("Category"),
    )


def context_blocks(samples: DataFrame, blocks: DataFrame, width: int = 1024) -> DataFrame:
    """Blocks inside each sample's context [begin, end), less always-hidden and task-hidden tables.

    `samples`: sample_id, subject_id, context_begin, context_end, hidden_events; `blocks`: subject_id,
    event_idx, file_name and more.
    """
    ranges = samples.withColumns({"_low": F.col("context_begin"), "_high": F.col("context_end") - 1})
    inside = within_interval(ranges, blocks, ["subject_id"], "_low", "_high", "event_idx", width)
    shown = ~F.col("file_name").isin(*HIDDEN_ALWAYS) & ~F.coalesce(F.array_contains("hidden_events", F.col("file_name")), F.lit(False))
    return inside.where(shown).drop("_low", "_high")


def fill_person_time(table: DataFrame) -> DataFrame:
    """Person rows without a time take the first known time of their sample's table."""
    first = table.where(F.col("Time").isNotNull()).groupBy("sample_id").agg(F.min("Time").alias("_first"))
    joined = table.join(first, "sample_id", "left")
    missing = (F.col("Category") == "person") & F.col("Time").isNull()
    return joined.withColumn("Time", F.when(missing, F.col("_first")).otherwise(F.col("Time"))).drop("_first")


def with_position(table: DataFrame, order: Sequence[str], bucket_seconds: int = 28 * 86_400) -> DataFrame:
    """Row number per sample by time, missing times last, then by `order`."""
    placed = table.withColumn("_untimed", F.col("Time").isNull().cast("int"))
    bucket = F.when(F.col("Time").isNull(), F.lit(2**41).cast("bigint")).otherwise(time_bucket("Time", bucket_seconds))
    return position(placed, ["sample_id"], ["_untimed", "Time", *order], "pos", bucket).drop("_untimed")


def omop_table(
    samples: DataFrame, rows: DataFrame, descriptions: DataFrame, overrides: DataFrame | None = None, width: int = 1024
) -> DataFrame:
    """Person rows and the sample's slice [period_begin, period_end], both ends included, clipped to its visit.

    Notes and codes without a description are left out; `overrides` (code, description) win over `descriptions`.
    """
    sliced = within_interval(
        samples.withColumns({"_low": F.col("period_begin"), "_high": F.col("period_end")}), rows, ["subject_id"], "_low", "_high",
        "row_idx", width,
    ).drop("_low", "_high")
    in_visit = F.col("visit_start").isNull() | F.col("visit_end").isNull() | F.col("start").between(F.col("visit_start"), F.col("visit_end"))
    context = sliced.where(in_visit)
    persons = samples.join(rows.where(F.lower("omop_table") == "person"), "subject_id")
    both = context.select(*persons.columns).unionByName(persons).where(F.lower("omop_table") != "note")
    dictionary = descriptions.select("code", F.col("description").alias("_text"))
    if overrides is not None:
        dictionary = dictionary.join(overrides.select("code", F.col("description").alias("_over")), "code", "full").select(
            "code", F.coalesce("_over", "_text").alias("_text")
        )
    named = both.join(dictionary, "code")
    code, person = F.col("code"), F.lower("omop_table") == "person"
    item = (
        F.when(~person, F.col("_text")).when(code == "SNOMED/3950001", "Birth").when(code.startswith("Race/"), "Race")
        .when(code.startswith("Gender/"), "Gender").when(code.startswith("Ethnicity/"), "Ethnicity").otherwise(F.col("_text"))
    )
    value = (
        F.when(person & (code == "SNOMED/3950001"), "")
        .when(person & (code.startswith("Race/") | code.startswith("Ethnicity/")), F.col("description"))
        .when(person & F.upper(code).startswith("GENDER/F"), "Female").when(person & F.upper(code).startswith("GENDER/M"), "Male")
        .otherwise(F.coalesce(F.col("value").cast("string"), F.lit("")))
    )
    return named.select(
        "sample_id", "row_idx", F.col("start").alias("Time"), item.alias("Item"), value.alias("Value"),
        F.coalesce(F.col("unit").cast("string"), F.lit("")).alias("Unit"), F.col("omop_table").alias("Category"),
    )


def icu_table(samples: DataFrame, patients: DataFrame, labs: DataFrame, drugs: DataFrame, infusions: DataFrame) -> DataFrame:
    """Demographics at offset 0 and laboratory, drug and infusion rows up to the sample's observation hours."""
    limit = F.col("obs_hours") * 60
    who = samples.join(patients, "stay")
    age = F.when(F.col("age") == "> 89", ">89").otherwise(F.coalesce("age", F.lit("unknown")))
    person = F.array(
        _row(F.lit("Age"), age, F.lit("years")),
        _row(F.lit("Gender"), F.coalesce("gender", F.lit("unknown")), F.lit("")),
        _row(F.lit("Ethnicity"), F.nullif(F.coalesce("ethnicity", F.lit("unknown")), F.lit("unknown")), F.lit("")),
    )
    demographics = who.select("sample_id", F.lit(0).cast("double").alias("offset"), F.explode(person).alias("r"), F.lit("person").alias("Category"))
    parts = [demographics.where(F.coalesce(F.col("r.value"), F.lit("")) != "")]
    for rows, offset, item, value, unit, category in (
        (labs, "labresultoffset", "labname", "labresult", F.col("unit"), "measurement"),
        (drugs, "drugstartoffset", "drugname", "dosage", F.lit(""), "drug_exposure"),
        (infusions, "infusionoffset", "drugname", "infusionrate", F.lit("mL/hr"), "drug_exposure"),
    ):
        timed = samples.join(rows, "stay").where((F.col(offset) >= 0) & (F.col(offset) <= limit))
        parts.append(timed.select(
            "sample_id", F.col(offset).cast("double").alias("offset"),
            _row(F.coalesce(item, F.lit("unknown")), F.coalesce(F.col(value).cast("string"), F.lit("")), F.coalesce(unit, F.lit(""))).alias("r"),
            F.lit(category).alias("Category"),
        ))
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged.select(
        "sample_id", times.time_text(times.offset_time(F.col("offset"))).alias("Time"), F.col("r.item").alias("Item"),
        F.col("r.value").alias("Value"), F.col("r.unit").alias("Unit"), "Category",
    )


NESTED_TIME = "2000-01-01 00:00:00"


def nested_table(rows: DataFrame, lab_names: DataFrame, culture_names: DataFrame) -> DataFrame:
    """Rows of nested maps (item id to value), named by dictionary or by the id itself, at one fixed time.

    `rows`: sample_id, labs map, cultures map; dictionaries: item_id, name.
    """
    labs = rows.select("sample_id", F.explode("labs").alias("item_id", "raw")).join(lab_names, "item_id", "left").withColumn(
        "v", values.value_and_unit(F.col("raw"))
    ).select("sample_id", F.coalesce("name", "item_id").alias("Item"), F.col("v.value").alias("Value"), F.col("v.unit").alias("Unit"))
    cultures = rows.select("sample_id", F.explode("cultures").alias("item_id", "raw")).join(culture_names, "item_id", "left").select(
        "sample_id", F.coalesce("name", "item_id").alias("Item"), F.col("raw").alias("Value"), F.lit("").alias("Unit")
    )
    return labs.unionByName(cultures).withColumns({"Time": F.lit(NESTED_TIME).cast("timestamp_ntz"), "Category": F.lit("measurement")})


def followup_table(
    rows: DataFrame, static: DataFrame, static_names: Mapping[str, str], drugs: Mapping[str, tuple[str, str]],
    described: DataFrame, cutoff: str = "cutoff_day",
) -> DataFrame:
    """Static rows at the operation, drugs and described laboratory results up to the cutoff day.

    `rows`: sample_id, day, Time, cutoff and drug columns; `static`: sample_id, surgery_time and feature
    columns; `described`: sample_id, Time, Item, Value, Unit of laboratory results.
    """
    person = static.select("sample_id", "surgery_time", *[F.col(c).cast("string").alias(c) for c in static_names]).unpivot(
        ["sample_id", "surgery_time"], list(static_names), "column", "Value"
    ).where(F.col("Value").isNotNull())
    named = F.create_map(*[F.lit(x) for pair in static_names.items() for x in pair])[F.col("column")]
    split = values.item_and_unit(named)
    person_rows = person.withColumn("_s", split).select(
        "sample_id", F.col("surgery_time").alias("Time"), F.col("_s.item").alias("Item"), F.trim("Value").alias("Value"),
        F.col("_s.unit").alias("Unit"), F.lit("person").alias("Category"),
    )
    taken = rows.where(F.col("day") <= F.col(cutoff)).select("sample_id", "Time", *[F.col(c).cast("string").alias(c) for c in drugs]).unpivot(
        ["sample_id", "Time"], list(drugs), "column", "Value"
    ).where(F.col("Value").isNotNull())
    spec = F.create_map(*[x for c, (name, unit) in drugs.items() for x in (F.lit(c), F.struct(F.lit(name).alias("n"), F.lit(unit).alias("u")))])
    drug_rows = spread_results(taken.withColumns({"Item": spec[F.col("column")]["n"], "Unit": spec[F.col("column")]["u"]})).select(
        "sample_id", "Time", "Item", "Value", "Unit", F.lit("drug_exposure").alias("Category")
    )
    lab_rows = described.select("sample_id", "Time", "Item", "Value", "Unit", F.lit("measurement").alias("Category"))
    return person_rows.unionByName(drug_rows).unionByName(lab_rows)


def spread_results(rows: DataFrame, value: str = "Value", time: str = "Time") -> DataFrame:
    """Cells with several results become rows spread over the day after their time."""
    parts = values.multi_values(F.col(value))
    spread = rows.withColumn("_n", F.size(parts)).select("*", F.posexplode(parts).alias("_i", "_v"))
    shifted = times.add_hours(F.col(time), values.spread_hours(F.col("_i"), F.col("_n")))
    return spread.withColumns({value: F.col("_v"), time: F.when(F.col("_i") == 0, F.col(time)).otherwise(shifted)}).drop("_n", "_i", "_v")


def non_empty_samples(samples: DataFrame, table: DataFrame) -> DataFrame:
    return samples.join(table.select("sample_id").distinct(), "sample_id", "left_semi")


def table_lengths(table: DataFrame) -> DataFrame:
    return table.groupBy("sample_id").agg(F.count(F.lit(1)).alias("table_length"))


def text_columns(table: DataFrame, columns: Sequence[str] = TEXT_COLUMNS) -> DataFrame:
    """Text columns as non-null strings, as a stored table needs them."""
    return table.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns})


def cache_keys(samples: DataFrame, parts: Sequence[str]) -> DataFrame:
    return samples.withColumn("cache_key", text.row_digest(*[F.col(p) for p in parts]))
