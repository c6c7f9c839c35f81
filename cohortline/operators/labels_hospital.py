"""Hospital task rows: emergency, admission, intensive care, discharge, decision and context tasks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from cohortline.functions import times
from cohortline.operators import context, task_catalog as catalog
from cohortline.operators.durations import with_duration
from cohortline.operators.ordered import Running, lookup
from cohortline.operators.timeline import idx_bucket, next_of_kind

ICU_DEATH_DAYS = (1, 2, 3, 7, 14)
KEYS = ["subject_id", "event_idx", "hadm_id", "file_name", "starttime", "end_time"]


def yes_no(condition: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), "yes").otherwise("no")


def task_rows(anchors: DataFrame, targets: Mapping[str, Column], begin: Column, end: Column) -> DataFrame:
    """One row per anchor and task; a null target leaves the row out. The context is [begin, end)."""
    pairs = F.array(*[F.struct(F.lit(t).alias("task"), c.alias("target")) for t, c in targets.items()])
    return (
        anchors.withColumn("_t", F.explode(pairs))
        .where(F.col("_t.target").isNotNull())
        .select(
            "subject_id", "hadm_id", F.col("_t.task").alias("task"), F.col("file_name").alias("event"),
            begin.alias("context_begin"), end.alias("context_end"), F.col("_t.target").alias("target"),
        )
    )


def with_neighbours(blocks: DataFrame) -> DataFrame:
    """Blocks with the next admission and ICU block of their admission and the next emergency and admission block at all.

    Two scans serve every task builder; each neighbour is a struct (event_idx, starttime), null when there is none.
    """
    kind, admitted = F.col("file_name"), F.col("hadm_id").isNotNull()
    same = next_of_kind(
        blocks, ["subject_id", "hadm_id"],
        {"next_admission_same": admitted & (kind == "admissions"), "next_icu_same": admitted & (kind == "icustays")},
        ["event_idx", "starttime"],
    )
    return next_of_kind(
        same, ["subject_id"], {"next_ed": kind == "edstays", "next_admission": kind == "admissions"}, ["event_idx", "starttime"]
    )



def anchors_of(blocks: DataFrame, kind: str, *neighbours: str) -> DataFrame:
    return blocks.where(F.col("file_name") == kind).select(*KEYS, *neighbours)


def emergency_tasks(blocks: DataFrame, subjects: DataFrame) -> DataFrame:
    """Hospitalisation, death in hospital, ICU within 12 h, re-attendance within 72 h, critical outcome.

    `blocks` of all task builders come from `with_neighbours`.
    """
    asked = anchors_of(blocks, "edstays", "next_admission_same", "next_icu_same", "next_ed")
    anchors = context.until_time(asked, blocks, F.col("end_time")).where(F.col("context_end").isNotNull())
    last = blocks.where(F.col("starttime").isNotNull()).groupBy("subject_id", "hadm_id").agg(
        F.max_by(F.struct("event_idx", "starttime"), "event_idx").alias("_last")
    )
    anchors = anchors.join(last, ["subject_id", "hadm_id"], "left").join(subjects, "subject_id", "left")
    last_time = F.when(F.col("_last.event_idx") > F.col("event_idx"), F.col("_last.starttime"))
    dead = F.col("death_time").isNotNull() & last_time.isNotNull() & ~(last_time < F.col("death_time"))
    moved = F.col("next_icu_same").isNotNull() & (times.gap_hours(F.col("end_time"), F.col("next_icu_same.starttime")) < 12)
    back = F.col("next_ed").isNotNull() & (times.gap_hours(F.col("end_time"), F.col("next_ed.starttime")) < 72)
    targets = {
        "ED_Hospitalization": yes_no(F.col("next_admission_same").isNotNull()),
        "ED_Inpatient_Mortality": yes_no(dead),
        "ED_ICU_Tranfer_12hour": yes_no(moved),
        "ED_Reattendance_3day": yes_no(back),
        "ED_Critical_Outcomes": yes_no(F.coalesce(moved, F.lit(False)) | F.coalesce(dead, F.lit(False))),
    }
    return task_rows(anchors, targets, F.col("event_idx"), F.col("context_end") + 1)


def admission_tasks(blocks: DataFrame, subjects: DataFrame) -> DataFrame:
    """Length of stay over 3 and 7 days (if the context ends before discharge) and death in hospital."""
    anchors = context.forward_context(anchors_of(blocks, "admissions"), blocks)
    anchors = anchors.where(F.col("context_end").isNotNull()).join(subjects, "subject_id", "left")
    stay = times.gap_hours(F.col("starttime"), F.col("end_time"))
    still_in = F.col("context_end_starttime") < F.col("end_time")
    dead = F.col("death_time").isNotNull() & ~(F.col("end_time") < F.col("death_time"))
    targets = {
        "LengthOfStay_3day": F.when(still_in, yes_no(stay > 3 * 24)),
        "LengthOfStay_7day": F.when(still_in, yes_no(stay > 7 * 24)),
        "Inpatient_Mortality": yes_no(dead),
    }
    return task_rows(anchors, targets, F.col("event_idx"), F.col("context_end") + 1)


def intensive_tasks(blocks: DataFrame, subjects: DataFrame) -> DataFrame:
    """Death within days of the context end, long stays, and return to intensive care."""
    anchors = context.forward_context(anchors_of(blocks, "icustays", "next_icu_same"), blocks)
    anchors = anchors.where(F.col("context_end").isNotNull()).join(subjects, "subject_id", "left")
    until_death = times.gap_hours(F.col("context_end_starttime"), F.col("death_time"))
    stay = times.gap_hours(F.col("starttime"), F.col("end_time"))
    targets = {
        f"ICU_Mortality_{d}day": yes_no(F.col("death_time").isNotNull() & (until_death < d * 24)) for d in ICU_DEATH_DAYS
    }
    targets |= {f"ICU_Stay_{d}day": yes_no(stay >= d * 24) for d in (7, 14)}
    targets["ICU_Readmission"] = yes_no(F.col("next_icu_same").isNotNull())
    return task_rows(anchors, targets, F.col("event_idx"), F.col("context_end") + 1)


def discharge_tasks(blocks: DataFrame) -> DataFrame:
    """Readmission within 30 and 60 days."""
    anchors = context.backward_context(anchors_of(blocks, "discharge", "next_admission"), blocks)
    anchors = anchors.where(F.col("context_begin").isNotNull())
    gap = times.gap_hours(F.col("starttime"), F.col("next_admission.starttime"))
    again = F.col("next_admission").isNotNull()
    targets = {f"Readmission_{d}day": yes_no(again & (gap < 24 * d)) for d in (30, 60)}
    return task_rows(anchors, targets, F.col("context_begin"), F.col("event_idx") + 1)


def decision_tasks(
    blocks: DataFrame, items: DataFrame, tasks: Sequence[tuple[str, str]], untimed: Sequence[str] = ("diagnoses_icd",)
) -> DataFrame:
    """Distinct mapped targets of the anchor block, with the 24 h before it as context.

    `items`: subject_id, event_idx, task, target (already mapped, null where the map has none);
    `tasks`: (task, anchor table). Untimed anchors take the time of the block before them. Targets are made
    distinct before they are put in a list, so the list is bounded by the vocabulary.
    """
    anchored = context.anchor_time_of_untimed(blocks, untimed)
    kinds = sorted({event for _, event in tasks})
    anchors = context.backward_context(anchored.where(F.col("file_name").isin(*kinds)).select(*KEYS), blocks)
    anchors = anchors.where(F.col("context_begin").isNotNull())
    named = items.withColumn("target", F.trim("target")).where(F.col("target") != "")
    listed = named.select("subject_id", "event_idx", "task", "target").distinct().groupBy(
        "subject_id", "event_idx", "task"
    ).agg(F.array_sort(F.collect_list("target")).alias("target_list"))
    return anchors.join(listed, ["subject_id", "event_idx"]).select(
        "subject_id", "hadm_id", "task", F.col("file_name").alias("event"), "context_begin",
        F.col("event_idx").alias("context_end"), "target_list",
    )


def transfer_target(careunit: Column, eventtype: Column) -> Column:
    """The care unit of a transfer, or its kind where no unit is given."""
    return F.when(F.coalesce(careunit, F.lit("nan")) != "nan", careunit).otherwise(eventtype)


def single_item_target(items: DataFrame) -> DataFrame:
    """Targets of tasks that allow one item only: blocks with several are left out."""
    single = items.where(F.col("target").isNotNull()).groupBy("subject_id", "event_idx", "task").agg(
        F.min("target").alias("target"), F.count(F.lit(1)).alias("_n")
    )
    return single.where(F.col("_n") == 1).drop("_n")


def next_event_targets(blocks: DataFrame) -> DataFrame:
    """Target of the next-event task: the table of every timed block."""
    return blocks.where(F.col("starttime").isNotNull()).select(
        "subject_id", "event_idx", F.lit("next_event").alias("task"), F.col("file_name").alias("target")
    )


def reconstruction_tasks(blocks: DataFrame, tabular: Sequence[str] = catalog.TABULAR_TABLES) -> DataFrame:
    """One sample per tabular block."""
    return blocks.where(F.col("file_name").isin(*tabular)).select(
        "subject_id", "hadm_id", F.lit(catalog.RECONSTRUCTION_TASK).alias("task"), F.col("file_name").alias("event"),
        F.col("event_idx").alias("anchor_event_id"), F.col("event_idx").alias("context_begin"),
        (F.col("event_idx") + 1).alias("context_end"), F.lit("__event_level_reconstruction__").alias("target"),
        F.lit("single_tabular_event").alias("sampling_mode"), F.lit(0).alias("window_id"),
    )


def first_diagnosis_block(contexts: DataFrame, blocks: DataFrame) -> DataFrame:
    """First diagnosis block of the admission at or after the context start, as `diagnosis_idx`."""
    points = blocks.where(F.col("file_name") == "diagnoses_icd").select(
        "subject_id", "hadm_id", F.col("event_idx").alias("at"), F.col("event_idx").alias("idx")
    )
    return lookup(
        contexts, points, ["subject_id", "hadm_id"], "context_begin", "at",
        [Running("diagnosis_idx", "min", F.col("_p_idx"))], after=True, bucket=idx_bucket("_at"),
    )


def context_samples(
    blocks: DataFrame, diagnoses: DataFrame, tabular: Sequence[str] = catalog.TABULAR_TABLES
) -> DataFrame:
    """Discharge-centred contexts with their primary diagnosis and its class.

    `diagnoses`: subject_id, event_idx, item_idx, icd_code, ccs. All codes of a sample are the rows of
    `context_diagnoses`; here they are counted only.
    """
    contexts = context.between_discharges(blocks, tabular)
    placed = first_diagnosis_block(contexts, blocks)
    codes = diagnoses.where(F.col("icd_code") != "").groupBy("subject_id", F.col("event_idx").alias("diagnosis_idx")).agg(
        F.min_by("icd_code", "item_idx").alias("primary_diagnosis_icd"),
        F.min_by("ccs", F.when(F.col("ccs").isNotNull(), F.col("item_idx"))).alias("primary_diagnosis_ccs"),
        F.count(F.lit(1)).alias("n_diagnoses"),
    )
    joined = placed.join(codes, ["subject_id", "diagnosis_idx"], "left")
    return joined.select(
        "subject_id", "hadm_id", F.lit("discharge").alias("event"), "admissions_id", "last_discharge_id", "context_begin",
        "context_end", F.coalesce("primary_diagnosis_icd", F.lit("")).alias("primary_diagnosis_icd"),
        F.coalesce("primary_diagnosis_ccs", F.lit("")).alias("primary_diagnosis_ccs"),
        F.coalesce("n_diagnoses", F.lit(0).cast("bigint")).alias("n_diagnoses"),
        F.lit("full_between_discharges").alias("sampling_mode"),
    )


def context_diagnoses(blocks: DataFrame, diagnoses: DataFrame, tabular=catalog.TABULAR_TABLES) -> DataFrame:
    """Every diagnosis of every context, one row each, in its order."""
    placed = first_diagnosis_block(context.between_discharges(blocks, tabular), blocks).select(
        "subject_id", "hadm_id", "context_begin", "context_end", "diagnosis_idx"
    )
    codes = diagnoses.where(F.col("icd_code") != "").withColumnRenamed("event_idx", "diagnosis_idx")
    return placed.join(codes, ["subject_id", "diagnosis_idx"])


def target_weights(samples: DataFrame, unweighted: Sequence[str] = ("contrastive_learning", "next_token_prediction", "bi_reconstruct", "radiology")) -> DataFrame:
    """Inverse of the target's frequency in its task; a list target takes the mean frequency of its entries.

    `samples`: sample_id, task, target_list. Frequencies are a small aggregate joined back on (task, target).
    """
    entries = samples.where(~F.col("task").isin(*unweighted)).select("sample_id", "task", F.explode("target_list").alias("target"))
    frequency = entries.groupBy("task", "target").agg(F.count(F.lit(1)).alias("n"))
    mean = entries.join(frequency, ["task", "target"]).groupBy("sample_id").agg(F.avg("n").alias("_mean"))
    weighted = samples.join(mean, "sample_id", "left")
    return weighted.withColumn("target_weight", F.lit(1.0) / F.coalesce("_mean", F.lit(1.0))).drop("_mean")


def duration_tasks(samples: DataFrame, blocks: DataFrame, subjects: DataFrame) -> DataFrame:
    """Time-to-event rows from the risk task rows they start from.

    The anchor block is the first of the context, or the last for discharge tasks. Equal rows by
    (subject, admission, task, prediction time, horizon) are kept once.
    """
    names = F.create_map(*[F.lit(x) for source, task, _, _ in catalog.DURATION_TASKS for x in (source, task)])
    source = samples.where(F.col("task").isin(*[s for s, *_ in catalog.DURATION_TASKS])).withColumn(
        "anchor_idx", F.when(F.col("event") == "discharge", F.col("context_end") - 1).otherwise(F.col("context_begin"))
    )
    slim = blocks.select("subject_id", "hadm_id", "event_idx", "file_name", "starttime", "end_time")
    anchor = blocks.select(
        "subject_id", F.col("event_idx").alias("anchor_idx"), F.col("starttime").alias("anchor_start"),
        F.col("end_time").alias("anchor_end"), F.col("next_icu_same.starttime").alias("next_icu"),
        F.col("next_admission.starttime").alias("next_admission"), F.col("next_ed.starttime").alias("next_ed"),
    )
    last = slim.select("subject_id", (F.col("event_idx") + 1).alias("context_end"), F.col("starttime").alias("context_time"))
    stay = slim.where(F.col("file_name") == "admissions").groupBy("subject_id", "hadm_id").agg(
        F.min_by(F.struct("starttime", "end_time"), "event_idx").alias("_stay")
    )
    rows = (
        source.join(anchor, ["subject_id", "anchor_idx"])
        .join(last, ["subject_id", "context_end"], "left")
        .join(stay, ["subject_id", "hadm_id"], "left")
        .join(subjects, "subject_id", "left")
        .withColumns({"_admitted": F.col("_stay.starttime"), "_discharged": F.col("_stay.end_time")})
    )
    task = F.col("task")
    prediction = (
        F.when(task.startswith("ED_"), F.col("anchor_end")).when(task.startswith("Readmission_"), F.col("anchor_start"))
        .otherwise(F.col("context_time"))
    )
    death, discharged = F.col("death_time"), F.col("_discharged")
    plus = lambda start, days: times.add_days(start, F.lit(float(days)))
    event = (
        F.when(task.isin("ED_Inpatient_Mortality", "Inpatient_Mortality", "ICU_Mortality_14day"), death)
        .when(task.isin("ED_ICU_Tranfer_12hour", "ICU_Readmission"), F.col("next_icu"))
        .when(task == "ED_Reattendance_3day", F.col("next_ed"))
        .when(task == "Readmission_60day", F.col("next_admission"))
        .otherwise(F.col("anchor_end"))
    )
    censor = (
        F.when(task == "ED_Inpatient_Mortality", discharged)
        .when(task == "ED_ICU_Tranfer_12hour", plus(prediction, 0.5))
        .when(task == "ED_Reattendance_3day", plus(prediction, 3))
        .when(task == "Readmission_60day", plus(prediction, 60))
        .when(task.isin("Inpatient_Mortality", "LengthOfStay_7day", "ICU_Stay_14day"), F.col("anchor_end"))
        .otherwise(discharged)
    )
    deadline = F.when(task == "Inpatient_Mortality", F.col("anchor_end")).otherwise(discharged)
    observed = F.when(
        task.isin("ED_Inpatient_Mortality", "Inpatient_Mortality", "ICU_Mortality_14day"),
        F.coalesce(death <= deadline, F.lit(False)),
    ).otherwise(event.isNotNull())
    horizon_end = (
        F.when(task == "ED_Inpatient_Mortality", discharged)
        .when(task == "Inpatient_Mortality", F.col("anchor_end"))
        .when(task == "LengthOfStay_7day", F.coalesce(plus(F.col("_admitted"), 7), F.col("anchor_end")))
        .when(task == "ICU_Stay_14day", plus(F.col("anchor_start"), 14))
        .when(task == "ICU_Readmission", discharged)
    )
    fixed = {s: h for s, _, _, h in catalog.DURATION_TASKS if h is not None}
    horizon = F.coalesce(
        F.create_map(*[F.lit(x) for pair in fixed.items() for x in pair])[task],
        times.horizon_between(prediction, horizon_end),
    )
    kept = rows.where((task != "ED_Inpatient_Mortality") | discharged.isNotNull())
    timed = with_duration(kept, prediction, event, censor, observed, horizon)
    result = timed.select(
        "subject_id", "hadm_id", names[task].alias("task"), task.alias("source_task"), "context_begin", "context_end",
        "prediction_time", "event_time", "censor_time", "time_to_event", "event_observed", "horizon_days", "time_unit",
    )
    same = Window.partitionBy("subject_id", "hadm_id", "task", "prediction_time", "horizon_days").orderBy(
        "context_begin", "context_end"
    )
    return result.withColumn("_n", F.row_number().over(same)).where(F.col("_n") == 1).drop("_n")
