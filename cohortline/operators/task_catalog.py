"""The task dimension: what can be asked, of which anchor event, with which kind of answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

BINARY, MULTI_CLASS, MULTI_LABEL = "binary_classification", "multi_class_classification", "multi_label_classification"
TIME_TO_EVENT, PRETRAINING, GENERATIVE = "time_to_event", "pretraining", "generative_task"

# Hospital decision tasks as (task, anchor event, target key, type, classes, hidden events).
DECISION_TASKS = (
    ("admissions", "admissions", "admission_type", MULTI_CLASS, 8, ()),
    ("transfers", "transfers", "eventtype", MULTI_CLASS, 39, ()),
    ("omr", "omr", "result_name", MULTI_CLASS, 11, ()),
    ("labevents", "labevents", "item_name", MULTI_CLASS, 698, ()),
    ("microbiologyevents", "microbiologyevents", "test_name", MULTI_CLASS, 165, ()),
    ("radiology", "radiology", "exam_name", MULTI_CLASS, 961, ()),
    ("diagnosis", "diagnosis", "icd_title", MULTI_LABEL, 13171, ("discharge",)),
    ("diagnosis_ccs", "diagnosis", "CCS Type", MULTI_LABEL, 271, ("discharge",)),
    ("diagnoses_icd", "diagnoses_icd", "diagnoses", MULTI_LABEL, 24467, ("discharge",)),
    ("diagnoses_ccs", "diagnoses_icd", "CCS Type", MULTI_LABEL, 279, ("discharge",)),
    ("procedures_icd", "procedures_icd", "procedures", MULTI_LABEL, 11098, ()),
    ("procedures_ccs", "procedures_icd", "CCS Type", MULTI_LABEL, 230, ()),
    ("services", "services", "curr_service", MULTI_CLASS, 18, ()),
    ("poe", "poe", "order_type", MULTI_CLASS, 15, ()),
    ("emar", "emar", "medication", MULTI_CLASS, 4153, ()),
    ("prescriptions", "prescriptions", "drug", MULTI_LABEL, 9233, ()),
    ("prescriptions_atc", "prescriptions", "ATC Type", MULTI_LABEL, 913, ()),
    ("medrecon", "medrecon", "name", MULTI_LABEL, 18641, ()),
    ("medrecon_atc", "medrecon", "ATC Type", MULTI_LABEL, 899, ()),
    ("ingredientevents", "ingredientevents", "item_name", MULTI_CLASS, 15, ()),
    ("datetimeevents", "datetimeevents", "item_name", MULTI_CLASS, 137, ()),
    ("procedureevents", "procedureevents", "item_name", MULTI_CLASS, 138, ()),
    ("inputevents", "inputevents", "item_name", MULTI_CLASS, 222, ()),
    ("outputevents", "outputevents", "item_name", MULTI_CLASS, 63, ()),
    ("chartevents", "chartevents", "item_name", MULTI_CLASS, None, ()),
    ("pyxis", "pyxis", "name", MULTI_CLASS, None, ()),
    ("next_event", "any", "file_name", MULTI_CLASS, None, ()),
    ("discharge", "discharge", "text", GENERATIVE, None, ()),
)
# Hospital risk tasks per anchor event.
RISK_TASKS = {
    "edstays": (
        "ED_Hospitalization", "ED_Inpatient_Mortality", "ED_ICU_Tranfer_12hour", "ED_Reattendance_3day",
        "ED_Critical_Outcomes",
    ),
    "discharge": ("Readmission_30day", "Readmission_60day"),
    "admissions": ("Inpatient_Mortality", "LengthOfStay_3day", "LengthOfStay_7day"),
    "icustays": (
        "ICU_Mortality_1day", "ICU_Mortality_2day", "ICU_Mortality_3day", "ICU_Mortality_7day", "ICU_Mortality_14day",
        "ICU_Stay_7day", "ICU_Stay_14day", "ICU_Readmission",
    ),
}
# Hospital time-to-event tasks as (source risk task, task, anchor event, fixed horizon in days).
DURATION_TASKS = (
    ("ED_Inpatient_Mortality", "Time_to_Inpatient_Mortality_after_ED", "edstays", None),
    ("ED_ICU_Tranfer_12hour", "Time_to_ICU_Transfer_after_ED", "edstays", 0.5),
    ("ED_Reattendance_3day", "Time_to_ED_Reattendance", "edstays", 3.0),
    ("Readmission_60day", "Time_to_Hospital_Readmission", "discharge", 60.0),
    ("Inpatient_Mortality", "Time_to_Inpatient_Mortality", "admissions", None),
    ("LengthOfStay_7day", "Time_to_Hospital_Discharge", "admissions", None),
    ("ICU_Mortality_14day", "Time_to_ICU_Mortality", "icustays", 14.0),
    ("ICU_Stay_14day", "Time_to_ICU_Discharge", "icustays", None),
    ("ICU_Readmission", "Time_to_ICU_Readmission", "icustays", None),
)
# Context tasks and the events hidden from them.
CONTEXT_TASKS = (
    ("contrastive_learning", "discharge", PRETRAINING, ("discharge", "radiology")),
    ("next_token_prediction", "discharge", PRETRAINING, ("discharge", "radiology")),
)
RECONSTRUCTION_TASK = "bi_reconstruct"
# Tables whose blocks are tabular, and note tables.
TABULAR_TABLES = (
    "labevents", "microbiologyevents", "omr", "emar", "triage", "vitalsign", "chartevents", "inputevents",
    "outputevents", "ingredientevents", "procedureevents",
)
NOTE_TABLES = ("discharge", "radiology")
# Tasks of the other centers as (task, type, classes).
ICU_TASKS = (
    ("mortality", BINARY, 2), ("long_term_mortality", BINARY, 2), ("readmission", BINARY, 2), ("los_3day", BINARY, 2),
    ("los_7day", BINARY, 2), ("Time_to_Mortality", TIME_TO_EVENT, None), ("Time_to_ICU_Discharge", TIME_TO_EVENT, None),
    ("Time_to_ICU_Readmission", TIME_TO_EVENT, None), ("final_acuity", MULTI_CLASS, 6),
    ("imminent_discharge", MULTI_CLASS, 6), ("diagnosis", MULTI_LABEL, 17), ("creatinine", MULTI_CLASS, 5),
    ("bilirubin", MULTI_CLASS, 5), ("platelets", MULTI_CLASS, 5), ("wbc", MULTI_CLASS, 3),
)
OMOP_TASKS = (
    ("guo_los", BINARY, 2), ("guo_readmission", BINARY, 2), ("guo_icu", BINARY, 2), ("lab_anemia", MULTI_CLASS, 4),
    ("lab_hyperkalemia", MULTI_CLASS, 4), ("lab_hyponatremia", MULTI_CLASS, 4), ("lab_hypoglycemia", MULTI_CLASS, 4),
    ("lab_thrombocytopenia", MULTI_CLASS, 4), ("new_acutemi", BINARY, 2), ("new_celiac", BINARY, 2),
    ("new_hyperlipidemia", BINARY, 2), ("new_hypertension", BINARY, 2), ("new_lupus", BINARY, 2),
    ("new_pancan", BINARY, 2),
)
TRIAL_TASKS = (("severe_outcome", BINARY, 2), ("adverse_event_next_visit", BINARY, 2))
NESTED_TASKS = (("single_diagnosis", MULTI_CLASS, 4), ("diagnosis_generation", GENERATIVE, 2352))
FOLLOWUP_TASKS = (
    ("single_metric_prediction", BINARY, 2), ("tacrolimus_abnormal_survival", TIME_TO_EVENT, None),
    ("death_survival", TIME_TO_EVENT, None),
)

SCHEMA = "center string, task string, event string, target_key string, task_type string, num_classes int, hidden_events array<string>"


def task_rows() -> list[tuple]:
    rows = [("hospital", t, e, k, kind, n, list(hidden)) for t, e, k, kind, n, hidden in DECISION_TASKS]
    rows += [("hospital", t, event, None, BINARY, 2, []) for event, tasks in RISK_TASKS.items() for t in tasks]
    rows += [("hospital", t, event, None, TIME_TO_EVENT, None, []) for _, t, event, _ in DURATION_TASKS]
    rows += [("hospital", t, event, None, kind, None, list(hidden)) for t, event, kind, hidden in CONTEXT_TASKS]
    rows.append(("hospital", RECONSTRUCTION_TASK, "tabular", None, GENERATIVE, None, []))
    for center, tasks in (
        ("icu", ICU_TASKS), ("omop", OMOP_TASKS), ("trial", TRIAL_TASKS), ("nested", NESTED_TASKS),
        ("followup", FOLLOWUP_TASKS),
    ):
        rows += [(center, t, None, None, kind, n, []) for t, kind, n in tasks]
    return rows


def task_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(task_rows(), SCHEMA)


def route_tasks(blocks: DataFrame, tasks: DataFrame, tabular=TABULAR_TABLES) -> DataFrame:
    """Each block with the tasks that anchor on its table; `any` reaches every table but demographics.

    The task table is a fixed catalogue, so it is the broadcast side.
    """
    tables = F.when(F.col("event") == "tabular", F.array(*[F.lit(t) for t in tabular])).otherwise(F.array("event"))
    anchored = tasks.where(F.col("event").isNotNull()).withColumn("file_name", F.explode(tables)).drop("event")
    exact = blocks.join(F.broadcast(anchored.where(F.col("file_name") != "any")), "file_name")
    everywhere = anchored.where(F.col("file_name") == "any").drop("file_name")
    per_block = blocks.where(F.col("file_name") != "patients")
    # the tasks of `any` are a few constants: attach them as one exploded array rather than a cross join
    listed = [r for r in task_rows() if r[2] == "any"]
    attached = per_block.withColumn("task", F.explode(F.array(*[F.lit(r[1]) for r in listed]))).join(
        F.broadcast(everywhere), "task"
    )
    return exact.unionByName(attached)
