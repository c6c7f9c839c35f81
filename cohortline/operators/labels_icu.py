"""Intensive-care cohort with minute offsets: cohort, labels, severity, diagnosis sets, sample and duration rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from cohortline.functions import numbers, text, times, values
from cohortline.operators.durations import with_duration
from cohortline.session import cut

# How a hospital discharge location reads; anything else is Other.
DISCHARGE_CLASSES = {
    "Home": "Home", "Death": "Death", "Nursing Home": "Other", "Other": "Other", "Other External": "Other",
    "Other Hospital": "Other", "Rehabilitation": "Rehabilitation",
    "Skilled Nursing Facility": "Skilled Nursing Facility",
}
# Laboratory names of each severity task, lower case.
LAB_NAMES = {
    "creatinine": ("creatinine", "creat"),
    "bilirubin": ("total bilirubin", "bilirubin", "t bili", "tbil"),
    "platelets": ("platelets x 1000", "platelets", "platelet count", "plt"),
    "wbc": ("wbc x 1000", "wbc", "white blood cell", "leukocytes"),
}
# Window lengths in hours.
OBS_HOURS, GAP_HOURS, PRED_HOURS = 12, 12, 24
MORTALITY_HOURS, DISCHARGE_HOURS, LONG_TERM_HOURS = 48, 48, 336
RARE_CLASS = 14


def cohort(
    patients: DataFrame, min_age: float = 18, max_age: float = 89, obs: int = OBS_HOURS, gap: int = GAP_HOURS,
    first_only: bool = True,
) -> DataFrame:
    """Adult stays long enough for observation and gap, with the readmission label.

    First and last stay of a hospital stay come from one aggregate (no window), joined back.
    """
    aged = patients.withColumn("age_years", numbers.parse_age(F.col("age"))).where(F.col("age_years").isNotNull())
    timed = aged.withColumns({
        "los": F.col("unitdischargeoffset") / 60 / 24,
        "out_minutes": F.col("unitdischargeoffset"),
        "discharge_minutes": F.col("hospitaldischargeoffset"),
        "died_in_unit": F.coalesce(F.col("unitdischargestatus") == "Expired", F.lit(False)),
        "discharge_class": text.mapped(F.col("hospitaldischargelocation"), DISCHARGE_CLASSES, "Other"),
    })
    kept = timed.where((F.col("los") >= (obs + gap) / 24) & F.col("age_years").between(min_age, max_age))
    visit = F.struct(F.col("unitvisitnumber"), F.col("patientunitstayid"))
    last_visit = F.struct(F.col("unitvisitnumber"), -F.col("patientunitstayid"))
    ends = kept.where(F.col("unitvisitnumber").isNotNull()).groupBy("patienthealthsystemstayid").agg(
        F.min_by("patientunitstayid", visit).alias("first_stay"),
        F.max_by("patientunitstayid", last_visit).alias("last_stay"),
    )
    labelled = kept.join(ends, "patienthealthsystemstayid", "left").withColumn(
        "readmission", F.when(F.col("patientunitstayid") == F.col("last_stay"), 0).otherwise(1)
    )
    if first_only:
        labelled = labelled.where(F.col("patientunitstayid") == F.col("first_stay"))
    return labelled.drop("first_stay", "last_stay")


def cohort_summary(stays: DataFrame) -> DataFrame:
    """Size, age and stay statistics, and counts by gender, mortality and discharge class, as rows."""
    classes = ("gender", "died_in_unit", "discharge_class")
    # stays alike are counted once, and the cohort is made once for all figures
    alike = cut(stays.groupBy("age_years", "los", *classes).agg(F.count(F.lit(1)).alias("n")))
    n = F.col("n")

    def mean(c: str) -> Column:
        return F.sum(F.col(c) * n) / F.sum(F.when(F.col(c).isNotNull(), n))

    numbers_rows = alike.agg(
        F.coalesce(F.sum(n), F.lit(0)).cast("double").alias("stays"), mean("age_years").alias("age_mean"),
        F.percentile("age_years", 0.5, n).alias("age_median"), F.min("age_years").alias("age_min"),
        F.max("age_years").alias("age_max"), mean("los").alias("los_mean"), F.percentile("los", 0.5, n).alias("los_median"),
    )
    wide = numbers_rows.unpivot([], list(numbers_rows.columns), "name", "value").withColumn("level", F.lit(""))
    groups = [
        alike.groupBy(F.coalesce(F.col(c).cast("string"), F.lit("")).alias("level")).agg(
            F.sum(n).cast("double").alias("value")
        ).withColumn("name", F.lit(c))
        for c in classes
    ]
    return reduce(lambda a, x: a.unionByName(x), groups, wide.select("name", "level", "value"))


def categorical_codes(df: DataFrame, column: str, code: str) -> tuple[DataFrame, DataFrame]:
    """Codes by sorted value, and the class table. The classes are few; they are ranked once and joined."""
    classes = df.select(column).where(F.col(column).isNotNull()).distinct().withColumn(
        code, F.dense_rank().over(Window.orderBy(column)) - 1
    )
    return df.join(classes, column, "left"), classes


def stay_labels(stays: DataFrame, obs: int = OBS_HOURS, gap: int = GAP_HOURS) -> DataFrame:
    """Mortality, length of stay, acuity and imminent discharge labels per stay."""
    end = F.col("discharge_minutes")
    start = (obs + gap) * 60
    died = F.col("died_in_unit") | (F.col("discharge_class") == "Death")
    in_hospital = ~F.col("died_in_unit") & (F.col("discharge_class") == "Death")

    def within(hours: int, closed: bool) -> Column:
        lower = (end >= start) if closed else (end > start)
        return F.coalesce(lower & (end <= start + hours * 60), F.lit(False))

    acuity = F.when(F.col("died_in_unit"), "IN_ICU_MORTALITY").when(in_hospital, "IN_HOSPITAL_MORTALITY").otherwise(
        F.col("discharge_class")
    )
    leaves = within(DISCHARGE_HOURS, True)
    imminent = F.when(leaves & (F.col("died_in_unit") | in_hospital), "Death").when(leaves, F.col("discharge_class")).otherwise(
        "No Discharge"
    )
    labelled = stays.withColumns({
        "mortality": (died & within(MORTALITY_HOURS, False)).cast("int"),
        "long_term_mortality": (died & within(LONG_TERM_HOURS, False)).cast("int"),
        "los_3day": (F.col("los") > 3).cast("int"),
        "los_7day": (F.col("los") > 7).cast("int"),
        "acuity_class": acuity,
        "imminent_class": imminent,
    })
    labelled, _ = categorical_codes(labelled, "acuity_class", "final_acuity")
    labelled, _ = categorical_codes(labelled, "imminent_class", "imminent_discharge")
    return labelled


def mean_labs_in_window(
    labs: DataFrame, stays: DataFrame, names: Mapping[str, Sequence[str]], obs: int = OBS_HOURS, gap: int = GAP_HOURS,
    pred: int = PRED_HOURS,
) -> DataFrame:
    """Mean numeric result per stay and task within [obs + gap, obs + pred] hours, both ends included.

    All tasks come from one pass over the laboratory rows.
    """
    task_of = F.create_map(*[F.lit(x) for task, spellings in names.items() for s in spellings for x in (s, task)])
    inside = F.col("labresultoffset").between((obs + gap) * 60, (obs + pred) * 60)
    rows = labs.where(inside).withColumns({
        "task": task_of[F.lower("labname")], "result_num": numbers.to_number(F.col("labresult")),
    }).where(F.col("task").isNotNull() & F.col("result_num").isNotNull())
    known = rows.join(stays.select("patientunitstayid"), "patientunitstayid", "left_semi")
    return known.groupBy("patientunitstayid", "task").agg(F.avg("result_num").alias("avg_value"))


def dialysis_patients(
    intake: DataFrame, stays: DataFrame, obs: int = OBS_HOURS, pred: int = PRED_HOURS
) -> DataFrame:
    """Patients with several hospital stays and a dialysis record up to the end of the prediction window.

    A missing dialysis total counts as a record.
    """
    record = (F.col("dialysistotal") != 0) | F.col("dialysistotal").isNull()
    early = intake.where(record & (F.col("intakeoutputoffset") <= (obs + pred) * 60))
    several = stays.groupBy("uniquepid").agg(F.count_distinct("patienthealthsystemstayid").alias("n")).where(F.col("n") > 1)
    return (
        stays.join(early.select("patientunitstayid").distinct(), "patientunitstayid", "left_semi")
        .select("uniquepid").distinct().join(several.select("uniquepid"), "uniquepid", "left_semi")
    )


def severity_labels(
    labs: DataFrame, intake: DataFrame, stays: DataFrame, tasks: Sequence[str] = tuple(LAB_NAMES)
) -> DataFrame:
    """Severity class per stay, one column per task; dialysis patients have none for creatinine."""
    means = mean_labs_in_window(labs, stays, {t: LAB_NAMES[t] for t in tasks})
    wide = means.groupBy("patientunitstayid").agg(
        *[values.severity(F.max(F.when(F.col("task") == t, F.col("avg_value"))), t).alias(t) for t in tasks]
    )
    labelled = stays.select("patientunitstayid", "uniquepid").join(wide, "patientunitstayid", "left")
    if "creatinine" in tasks:
        excluded = dialysis_patients(intake, stays).withColumn("_excluded", F.lit(True))
        labelled = labelled.join(excluded, "uniquepid", "left").withColumn(
            "creatinine", F.when(F.col("_excluded").isNull(), F.col("creatinine"))
        )
    return labelled.select("patientunitstayid", *tasks)


def prefixes(code: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(code)), lambda n: F.substring(code, F.lit(1), n))


def longest_prefix_map(codes: DataFrame, mapping: DataFrame) -> DataFrame:
    """Map codes by the longest prefix that is a mapped key or starts one.

    A key wins over keys that merely start with the prefix; among those the most frequent target wins, ties
    by the smallest. `mapping`: code, target. Prefix targets are counted before they meet the codes.
    """
    spread = mapping.select("target", "code", F.explode(prefixes(F.col("code"))).alias("prefix"))
    exact = mapping.groupBy(F.col("code").alias("prefix")).agg(F.max("target").alias("exact"))
    counted = spread.groupBy("prefix", "target").agg(F.count(F.lit(1)).alias("n"))
    majority = counted.groupBy("prefix").agg(F.min_by("target", F.struct(-F.col("n"), F.col("target"))).alias("usual"))
    targets = majority.join(exact, "prefix", "left").select("prefix", F.coalesce("exact", "usual").alias("mapped"))
    asked = codes.select("code").distinct().select("code", F.explode(prefixes(F.col("code"))).alias("prefix"))
    found = asked.join(targets, "prefix").groupBy("code").agg(F.max_by("mapped", F.length("prefix")).alias("target"))
    return found


def diagnosis_categories(strings: DataFrame, code_category: DataFrame, newer_to_older: DataFrame) -> DataFrame:
    """Category of each diagnosis string from its codes: directly, or over the longest-prefix map.

    `strings`: diagnosisstring, icd9code (comma list, first non-null per string); `code_category`: code,
    category; `newer_to_older`: code, target. With several codes the last one in the list that maps wins.
    """
    first = strings.where(F.col("icd9code").isNotNull()).groupBy("diagnosisstring").agg(F.min("icd9code").alias("codes"))
    listed = first.select("diagnosisstring", F.posexplode(F.split("codes", ",")).alias("place", "raw")).withColumn(
        "code", F.trim(F.regexp_replace("raw", r"\.", ""))
    )
    direct = listed.join(code_category, "code", "left")
    translated = longest_prefix_map(direct.where(F.col("category").isNull()), newer_to_older)
    over = translated.join(code_category.withColumnRenamed("code", "target").withColumnRenamed("category", "over"), "target").select("code", "over")
    both = direct.join(over, "code", "left").withColumn("category", F.coalesce("category", "over"))
    return both.where(F.col("category").isNotNull()).groupBy("diagnosisstring").agg(
        F.max_by("category", "place").alias("category")
    )


def roll_up_categories(known: DataFrame, strings: DataFrame, depth: int) -> DataFrame:
    """Give unmapped `a|b|c` strings the category of their nearest mapped or majority ancestor.

    Inner nodes take the most frequent category of their children, from the deepest level up: one small
    aggregate per level. The first level of the path is never used.
    """
    parts = lambda c: F.split(c, r"\|")
    nodes = known.select(F.col("diagnosisstring").alias("path"), "category").withColumn("level", F.size(parts(F.col("path"))))
    by_level = {level: nodes.where(F.col("level") == level).select("path", "category") for level in range(1, depth + 1)}
    rolled = by_level[depth]
    everything = rolled.withColumn("level", F.lit(depth))
    for level in range(depth - 1, 0, -1):
        parent = F.array_join(F.slice(parts(F.col("path")), 1, level), "|")
        votes = rolled.groupBy(parent.alias("path"), "category").agg(F.count(F.lit(1)).alias("n"))
        majority = votes.groupBy("path").agg(
            F.min_by("category", F.struct(-F.col("n"), F.col("category"))).alias("usual")
        )
        rolled = by_level[level].join(majority, "path", "full").select(
            "path", F.coalesce("category", "usual").alias("category")
        )
        everything = everything.unionByName(rolled.withColumn("level", F.lit(level)))
    unmapped = strings.select("diagnosisstring").distinct().join(known, "diagnosisstring", "left_anti")
    ancestors = unmapped.withColumn(
        "at", F.explode(F.sequence(F.least(F.size(parts(F.col("diagnosisstring"))), F.lit(depth)), F.lit(1), F.lit(-1)))
    ).where(F.col("at") >= 2).withColumn(
        "path", F.array_join(F.slice(parts(F.col("diagnosisstring")), F.lit(1), F.col("at")), "|")
    )
    inherited = ancestors.join(everything.select("path", "category"), "path").groupBy("diagnosisstring").agg(
        F.max_by("category", "at").alias("category")
    )
    return known.select("diagnosisstring", "category").unionByName(inherited)


def diagnosis_sets(diagnoses: DataFrame, categories: DataFrame, stays: DataFrame) -> DataFrame:
    """Sorted distinct categories per hospital stay; the rare class is dropped and later ones move down."""
    joined = diagnoses.join(stays.select("patientunitstayid", "patienthealthsystemstayid"), "patientunitstayid").join(
        categories, "diagnosisstring"
    ).where((F.col("category") != -1) & (F.col("category") != RARE_CLASS))
    shifted = F.when(F.col("category") > RARE_CLASS, F.col("category") - 1).otherwise(F.col("category"))
    sets = joined.groupBy("patienthealthsystemstayid").agg(F.array_sort(F.collect_set(shifted)).alias("diagnosis"))
    return stays.select("patientunitstayid", "patienthealthsystemstayid").join(
        sets, "patienthealthsystemstayid", "left"
    ).withColumn("diagnosis", F.coalesce("diagnosis", F.array().cast("array<int>")))


def sample_rows(labelled: DataFrame, tasks: Sequence[str], pred_hours: Mapping[str, int] | None = None) -> DataFrame:
    """One row per stay and enabled task with a label; the prediction window depends on the task."""
    special = {"mortality": MORTALITY_HOURS, "long_term_mortality": LONG_TERM_HOURS, "imminent_discharge": DISCHARGE_HOURS}
    special |= dict(pred_hours or {})
    present = [t for t in tasks if t in labelled.columns]
    long = labelled.select(
        "patientunitstayid", "uniquepid", "split", *[F.col(t).cast("string").alias(t) for t in present]
    ).unpivot(["patientunitstayid", "uniquepid", "split"], present, "task_name", "label")
    window = F.create_map(*[F.lit(x) for pair in special.items() for x in pair])[F.col("task_name")]
    return long.where(F.col("label").isNotNull() & ~F.col("label").isin("", "[]")).select(
        F.col("patientunitstayid").alias("icustay_id"), F.col("uniquepid").cast("string").alias("patient_id"), "task_name",
        "label", "split", F.lit(OBS_HOURS).alias("obs_hours"), F.lit(GAP_HOURS).alias("gap_hours"),
        F.coalesce(window, F.lit(PRED_HOURS)).alias("pred_hours"),
    )


def pretraining_rows(labelled: DataFrame) -> DataFrame:
    """One whole-stay context per stay with a positive end."""
    end = F.ceil(F.col("out_minutes").cast("double")).cast("int")
    return labelled.withColumn("context_end", end).where(F.col("context_end") > 0).select(
        F.concat_ws("|", F.lit("icu"), "uniquepid", "patientunitstayid", F.lit("0"), "context_end").alias("sample_id"),
        F.col("uniquepid").cast("string").alias("patient_id"), F.col("patientunitstayid").alias("icustay_id"),
        F.lit(0).alias("context_begin"), "context_end", F.ceil(F.col("context_end") / 60.0).cast("int").alias("obs_hours"),
        "split", F.lit("pretraining_context").alias("task"),
    )


def duration_rows(samples: DataFrame, stays: DataFrame) -> DataFrame:
    """Time to death (14 days) and to leaving the unit (seven days less the window), per stay."""
    known = samples.groupBy("icustay_id").agg(
        F.min("patient_id").alias("patient_id"), F.min("split").alias("split"), F.min("obs_hours").alias("obs_hours"),
        F.min("gap_hours").alias("gap_hours"),
        F.max(F.col("task_name").isin("mortality", "long_term_mortality")).alias("asks_death"),
        F.max(F.col("task_name").isin("los_3day", "los_7day")).alias("asks_stay"),
    )
    rows = known.join(
        stays.select(F.col("patientunitstayid").alias("icustay_id"), "out_minutes", "discharge_minutes", "died_in_unit",
                     "discharge_class"), "icustay_id",
    )
    window = (F.col("obs_hours") + F.col("gap_hours")).cast("double")
    prediction = times.offset_time(window * 60)
    end, out = times.offset_time(F.col("discharge_minutes")), times.offset_time(F.col("out_minutes"))
    died = F.col("died_in_unit") | (F.lower("discharge_class") == "death")
    keep = ["icustay_id", "patient_id", "split", "task_name", "source_binary_task"]
    death = with_duration(
        rows.where("asks_death").withColumn("task_name", F.lit("Time_to_Mortality")).withColumn(
            "source_binary_task", F.lit("mortality+long_term_mortality")),
        prediction, F.when(died, end), end, died, F.lit(14.0),
    )
    leaving = with_duration(
        rows.where("asks_stay").withColumn("task_name", F.lit("Time_to_ICU_Discharge")).withColumn(
            "source_binary_task", F.lit("los_3day+los_7day")),
        prediction, out, out, F.lit(True), F.greatest(F.lit(7.0) - window / 24.0, F.lit(1.0)),
    )
    duration = ["prediction_time", "event_time", "censor_time", "time_to_event", "event_observed", "horizon_days", "time_unit"]
    return death.select(*keep, *duration).unionByName(leaving.select(*keep, *duration))
