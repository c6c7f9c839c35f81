"""Hospital task rows and time-to-event rows over the event timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortline.operators import durations, labels_hospital as lh, task_catalog as catalog
from cohortline.plans import bindings as b
from cohortline.plans.registry import query
from cohortline.plans.timelines import BLOCKS_SQL, ORDER, block_table
from cohortline.operators import timeline as tl
from cohortline.session import cut


def stored_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block table with its neighbours, written out once: the label builders read it several times."""
    return cut(lh.with_neighbours(block_table(spark, sf_dir)))


TASK_COLUMNS = ["subject_id", "hadm_id", "task", "event", "context_begin", "context_end", "target"]

BASE_SQL = BLOCKS_SQL + "," + b.SUBJECTS_SQL

ED_SQL = """
ed0 AS (
  SELECT a.*, death_time,
    (SELECT max(x.event_idx) FROM blocks x WHERE x.subject_id = a.subject_id AND x.event_idx > a.event_idx
      AND x.starttime < a.end_time) AS ce,
    (SELECT min(x.event_idx) FROM blocks x WHERE x.subject_id = a.subject_id AND x.hadm_id = a.hadm_id
      AND x.event_idx > a.event_idx AND x.file_name = 'admissions') AS adm,
    (SELECT arg_min(x.starttime, x.event_idx) FROM blocks x WHERE x.subject_id = a.subject_id AND x.hadm_id = a.hadm_id
      AND x.event_idx > a.event_idx AND x.file_name = 'icustays') AS icu,
    (SELECT arg_min(x.starttime, x.event_idx) FROM blocks x WHERE x.subject_id = a.subject_id
      AND x.event_idx > a.event_idx AND x.file_name = 'edstays') AS ed,
    (SELECT arg_max(x.starttime, x.event_idx) FROM blocks x WHERE x.subject_id = a.subject_id AND x.hadm_id = a.hadm_id
      AND x.event_idx > a.event_idx) AS lastt
  FROM blocks a JOIN subj USING (subject_id) WHERE a.file_name = 'edstays'),
ed1 AS (
  SELECT *, adm IS NOT NULL AS t1,
    coalesce(death_time IS NOT NULL AND lastt IS NOT NULL AND lastt >= death_time, FALSE) AS t2,
    coalesce(epoch(icu) - epoch(end_time) < 12 * 3600, FALSE) AS t3,
    coalesce(epoch(ed) - epoch(end_time) < 72 * 3600, FALSE) AS t4
  FROM ed0 WHERE ce IS NOT NULL),
ed_tasks AS (
  SELECT subject_id, hadm_id, t.task, file_name AS event, event_idx AS context_begin, ce + 1 AS context_end,
    CASE WHEN t.y THEN 'yes' ELSE 'no' END AS target
  FROM ed1, LATERAL (VALUES ('ED_Hospitalization', t1), ('ED_Inpatient_Mortality', t2), ('ED_ICU_Tranfer_12hour', t3),
    ('ED_Reattendance_3day', t4), ('ED_Critical_Outcomes', t2 OR t3)) t(task, y))"""

ADMISSION_SQL = """
ad0 AS (
  SELECT a.*, death_time,
    (SELECT max(x.event_idx) FROM blocks x WHERE x.subject_id = a.subject_id AND x.hadm_id = a.hadm_id
      AND x.event_idx > a.event_idx AND x.starttime < a.starttime + INTERVAL 24 HOUR) AS ce
  FROM blocks a JOIN subj USING (subject_id) WHERE a.file_name = 'admissions'),
ad1 AS (SELECT ad0.*, c.starttime AS ct FROM ad0 JOIN blocks c ON c.subject_id = ad0.subject_id AND c.event_idx = ce),
admission_tasks AS (
  SELECT subject_id, hadm_id, t.task, file_name AS event, event_idx AS context_begin, ce + 1 AS context_end,
    CASE WHEN t.y THEN 'yes' ELSE 'no' END AS target
  FROM ad1, LATERAL (VALUES ('LengthOfStay_3day', end_time - starttime > INTERVAL 3 DAY, ct < end_time),
    ('LengthOfStay_7day', end_time - starttime > INTERVAL 7 DAY, ct < end_time),
    ('Inpatient_Mortality', coalesce(end_time >= death_time, FALSE), TRUE)) t(task, y, keep) WHERE keep)"""

ICU_SQL = """
ic0 AS (
  SELECT a.*, death_time,
    (SELECT max(x.event_idx) FROM blocks x WHERE x.subject_id = a.subject_id AND x.hadm_id = a.hadm_id
      AND x.event_idx > a.event_idx AND x.starttime < a.starttime + INTERVAL 24 HOUR) AS ce,
    EXISTS (SELECT 1 FROM blocks x WHERE x.subject_id = a.subject_id AND x.hadm_id = a.hadm_id
      AND x.event_idx > a.event_idx AND x.file_name = 'icustays') AS again
  FROM blocks a JOIN subj USING (subject_id) WHERE a.file_name = 'icustays'),
ic1 AS (SELECT ic0.*, c.starttime AS ct FROM ic0 JOIN blocks c ON c.subject_id = ic0.subject_id AND c.event_idx = ce),
icu_tasks AS (
  SELECT subject_id, hadm_id, t.task, file_name AS event, event_idx AS context_begin, ce + 1 AS context_end,
    CASE WHEN coalesce(t.y, FALSE) THEN 'yes' ELSE 'no' END AS target
  FROM ic1, LATERAL (VALUES ('ICU_Mortality_1day', death_time < ct + INTERVAL 1 DAY),
    ('ICU_Mortality_2day', death_time < ct + INTERVAL 2 DAY), ('ICU_Mortality_3day', death_time < ct + INTERVAL 3 DAY),
    ('ICU_Mortality_7day', death_time < ct + INTERVAL 7 DAY), ('ICU_Mortality_14day', death_time < ct + INTERVAL 14 DAY),
    ('ICU_Stay_7day', end_time >= starttime + INTERVAL 7 DAY), ('ICU_Stay_14day', end_time >= starttime + INTERVAL 14 DAY),
    ('ICU_Readmission', again)) t(task, y))"""

DISCHARGE_SQL = """
di0 AS (
  SELECT a.*,
    (SELECT min(x.event_idx) FROM blocks x WHERE x.subject_id = a.subject_id AND x.hadm_id = a.hadm_id AND x.event_idx > 0
      AND x.event_idx < a.event_idx AND x.starttime > a.starttime - INTERVAL 24 HOUR) AS cb,
    (SELECT arg_min(x.starttime, x.event_idx) FROM blocks x WHERE x.subject_id = a.subject_id
      AND x.event_idx > a.event_idx AND x.file_name = 'admissions') AS nxt
  FROM blocks a WHERE a.file_name = 'discharge'),
discharge_tasks AS (
  SELECT subject_id, hadm_id, t.task, file_name AS event, cb AS context_begin, event_idx + 1 AS context_end,
    CASE WHEN coalesce(nxt < starttime + to_days(t.d), FALSE) THEN 'yes' ELSE 'no' END AS target
  FROM di0, (VALUES ('Readmission_30day', 30), ('Readmission_60day', 60)) t(task, d) WHERE cb IS NOT NULL)"""


@query("emergency_tasks", "L1 F12", f"WITH {BASE_SQL}, {ED_SQL} SELECT * FROM ed_tasks")
def emergency_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lh.emergency_tasks(stored_blocks(spark, sf_dir), b.subjects(spark, sf_dir))


@query("admission_tasks", "L2", f"WITH {BASE_SQL}, {ADMISSION_SQL} SELECT * FROM admission_tasks")
def admission_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lh.admission_tasks(stored_blocks(spark, sf_dir), b.subjects(spark, sf_dir))


@query("intensive_care_tasks", "L3", f"WITH {BASE_SQL}, {ICU_SQL} SELECT * FROM icu_tasks")
def intensive_care_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lh.intensive_tasks(stored_blocks(spark, sf_dir), b.subjects(spark, sf_dir))


@query("discharge_tasks", "L4", f"WITH {BASE_SQL}, {DISCHARGE_SQL} SELECT * FROM discharge_tasks")
def discharge_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lh.discharge_tasks(stored_blocks(spark, sf_dir))


# Item dictionary of the stream, by the number in an event's properties.
ITEM_NAMES = {0: "Creatinine", 1: "Glucose", 2: " Sodium ", 3: "Potassium", 4: ""}


def item_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of laboratory and admission blocks with their dictionary name."""
    rows = b.timeline_events(spark, sf_dir)
    numbered = tl.block_items(rows, ORDER, b.TIMELINE_BUCKET).where(F.col("file_name").isin("labevents", "admissions"))
    names = F.create_map(*[F.lit(x) for pair in ITEM_NAMES.items() for x in pair])
    return numbered.select(
        "subject_id", "event_idx", F.col("file_name").alias("task"), names[F.pmod(F.col("k"), F.lit(7))].alias("target")
    )


@query(
    "decision_tasks", "L5 J1 W7",
    f"""WITH {BASE_SQL},
    it AS (SELECT DISTINCT subject_id, event_idx, file_name AS task, trim(CASE k % 7 WHEN 0 THEN 'Creatinine'
        WHEN 1 THEN 'Glucose' WHEN 2 THEN ' Sodium ' WHEN 3 THEN 'Potassium' WHEN 4 THEN '' END) AS target
      FROM numbered WHERE file_name IN ('labevents', 'admissions')),
    li AS (SELECT subject_id, event_idx, task, string_agg(target, '|' ORDER BY target) AS targets FROM it
      WHERE target <> '' GROUP BY ALL),
    an AS (SELECT a.*, (SELECT min(x.event_idx) FROM blocks x WHERE x.subject_id = a.subject_id AND x.hadm_id = a.hadm_id
        AND x.event_idx > 0 AND x.event_idx < a.event_idx AND x.starttime > a.starttime - INTERVAL 24 HOUR) AS cb
      FROM blocks a WHERE file_name IN ('labevents', 'admissions'))
    SELECT subject_id, hadm_id, task, file_name AS event, cb AS context_begin, event_idx AS context_end, targets
    FROM an JOIN li USING (subject_id, event_idx) WHERE cb IS NOT NULL""",
)
def decision_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lh.decision_tasks(
        stored_blocks(spark, sf_dir), item_targets(spark, sf_dir), [("labevents", "labevents"), ("admissions", "admissions")]
    )
    return rows.withColumn("targets", F.concat_ws("|", "target_list")).drop("target_list")


@query(
    "next_event_targets", "L5 L8",
    f"""WITH {BLOCKS_SQL} SELECT subject_id, event_idx, 'next_event' AS task, file_name AS target FROM blocks""",
)
def next_event_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lh.next_event_targets(block_table(spark, sf_dir))


@query(
    "reconstruction_samples", "L7",
    f"""WITH {BLOCKS_SQL} SELECT subject_id, hadm_id, 'bi_reconstruct' AS task, file_name AS event,
      event_idx AS anchor_event_id, event_idx AS context_begin, event_idx + 1 AS context_end,
      '__event_level_reconstruction__' AS target, 'single_tabular_event' AS sampling_mode, 0 AS window_id
    FROM blocks WHERE file_name = 'labevents'""",
)
def reconstruction_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lh.reconstruction_tasks(block_table(spark, sf_dir))


def diagnosis_blocks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Blocks where laboratory blocks with an even first number read as diagnosis blocks, and their items."""
    rows = b.timeline_events(spark, sf_dir)
    is_diagnosis = (F.col("file_name") == "edstays")
    renamed = rows.withColumn("file_name", F.when(is_diagnosis, "diagnoses_icd").otherwise(F.col("file_name")))
    blocks = cut(tl.blocks(renamed, ORDER, b.TIMELINE_BUCKET, ["end_time"]))
    items = tl.block_items(renamed, ORDER, b.TIMELINE_BUCKET).where(F.col("file_name") == "diagnoses_icd").select(
        "subject_id", "event_idx", F.col("seq").alias("item_idx"),
        F.when(F.col("k") % 10 == 0, "").otherwise(F.concat(F.lit("D"), F.col("k"))).alias("icd_code"),
    )
    ccs = F.when(F.substring("icd_code", 2, 4).try_cast("int") < 50, F.concat(F.lit("C"), F.substring("icd_code", 2, 1)))
    return blocks, items.withColumn("ccs", ccs)


CONTEXT_SQL = BLOCKS_SQL + """,
cx AS (
  SELECT a.*, (SELECT max(x.event_idx) FROM blocks x WHERE x.subject_id = a.subject_id AND x.file_name = 'discharge'
           AND x.event_idx < a.event_idx) AS last_discharge_id,
         (SELECT max(x.event_idx) FROM blocks x WHERE x.subject_id = a.subject_id AND x.file_name = 'admissions'
           AND x.hadm_id = a.hadm_id AND x.event_idx < a.event_idx) AS admissions_id
  FROM blocks a WHERE a.file_name = 'discharge'),
cy AS (SELECT *, coalesce(last_discharge_id, admissions_id) + 1 AS context_begin FROM cx WHERE admissions_id IS NOT NULL),
cz AS (SELECT cy.*, (SELECT min(x.event_idx) FROM blocks x WHERE x.subject_id = cy.subject_id AND x.hadm_id = cy.hadm_id
         AND x.file_name = 'edstays' AND x.event_idx >= cy.context_begin) AS dx FROM cy
  WHERE EXISTS (SELECT 1 FROM blocks x WHERE x.subject_id = cy.subject_id AND x.file_name = 'labevents'
    AND x.event_idx >= cy.context_begin AND x.event_idx < cy.event_idx)),
dxi AS (SELECT subject_id, event_idx AS dx, seq, 'D' || k AS icd_code, CASE WHEN k < 50 THEN 'C' || substr('' || k, 1, 1) END AS ccs
  FROM numbered WHERE file_name = 'edstays' AND k % 10 <> 0)"""


@query(
    "context_samples", "L6 W10 J2",
    f"""WITH {CONTEXT_SQL},
    dg AS (SELECT subject_id, dx, arg_min(icd_code, seq) AS pi, arg_min(ccs, seq) FILTER (ccs IS NOT NULL) AS pc, count(*) AS n
      FROM dxi GROUP BY ALL)
    SELECT subject_id, hadm_id, 'discharge' AS event, admissions_id, last_discharge_id, context_begin,
      event_idx AS context_end, coalesce(pi, '') AS primary_diagnosis_icd, coalesce(pc, '') AS primary_diagnosis_ccs,
      coalesce(n, 0) AS n_diagnoses, 'full_between_discharges' AS sampling_mode
    FROM cz LEFT JOIN dg USING (subject_id, dx)""",
)
def context_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, items = diagnosis_blocks(spark, sf_dir)
    return lh.context_samples(blocks, items)


@query(
    "context_diagnoses", "L6",
    f"""WITH {CONTEXT_SQL} SELECT subject_id, hadm_id, context_begin, event_idx AS context_end, dx AS diagnosis_idx,
      seq AS item_idx, icd_code, ccs FROM cz JOIN dxi USING (subject_id, dx)""",
)
def context_diagnoses(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, items = diagnosis_blocks(spark, sf_dir)
    return lh.context_diagnoses(blocks, items)


@query(
    "task_routing", "L8 S11",
    f"""WITH {BLOCKS_SQL}, t(task, file_name) AS (VALUES
      {", ".join(f"('{t}', '{e}')" for t, e, *_ in catalog.DECISION_TASKS if e in b.EVENT_TABLES.values())},
      {", ".join(f"('{t}', '{e}')" for e, ts in catalog.RISK_TASKS.items() for t in ts)},
      {", ".join(f"('{t}', '{e}')" for _, t, e, _ in catalog.DURATION_TASKS)},
      {", ".join(f"('{t}', '{e}')" for t, e, _, _ in catalog.CONTEXT_TASKS)},
      ('bi_reconstruct', 'labevents'), {", ".join(f"('next_event', '{e}')" for e in b.EVENT_TABLES.values())})
    SELECT subject_id, event_idx, file_name, task FROM blocks JOIN t USING (file_name)""",
)
def task_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = block_table(spark, sf_dir).select("subject_id", "event_idx", "file_name")
    hospital = catalog.task_table(spark).where(F.col("center") == "hospital")
    return catalog.route_tasks(blocks, hospital).select("subject_id", "event_idx", "file_name", "task")


def risk_samples(spark: SparkSession, sf_dir: str, blocks: DataFrame) -> DataFrame:
    people = b.subjects(spark, sf_dir)
    parts = [
        lh.emergency_tasks(blocks, people), lh.admission_tasks(blocks, people), lh.intensive_tasks(blocks, people),
        lh.discharge_tasks(blocks),
    ]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged


RISK_SQL = f"""{BASE_SQL}, {ED_SQL}, {ADMISSION_SQL}, {ICU_SQL}, {DISCHARGE_SQL},
risk AS (SELECT * FROM ed_tasks UNION ALL SELECT * FROM admission_tasks UNION ALL SELECT * FROM icu_tasks
  UNION ALL SELECT * FROM discharge_tasks)"""


@query(
    "target_weights", "A18",
    f"""WITH {RISK_SQL}, f AS (SELECT task, target, count(*) AS n FROM risk GROUP BY ALL)
    SELECT subject_id, context_begin, task, target, round(1.0 / n, 10) AS target_weight FROM risk JOIN f USING (task, target)""",
)
def target_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = cut(risk_samples(spark, sf_dir, stored_blocks(spark, sf_dir)))
    keyed = samples.withColumn("sample_id", F.concat_ws("|", "subject_id", "task", "context_begin", "context_end"))
    weighted = lh.target_weights(keyed.withColumn("target_list", F.array("target")))
    return weighted.select(
        "subject_id", "context_begin", "task", "target", F.round("target_weight", 10).alias("target_weight")
    )


@query(
    "list_target_weights", "A18 L5",
    f"""WITH {BASE_SQL},
    it AS (SELECT DISTINCT subject_id, event_idx, file_name AS task, trim(CASE k % 7 WHEN 0 THEN 'Creatinine'
        WHEN 1 THEN 'Glucose' WHEN 2 THEN ' Sodium ' WHEN 3 THEN 'Potassium' WHEN 4 THEN '' END) AS target
      FROM numbered WHERE file_name IN ('labevents', 'admissions')),
    g AS (SELECT * FROM it WHERE target <> ''), f AS (SELECT task, target, count(*) AS n FROM g GROUP BY ALL)
    SELECT subject_id, event_idx, task, round(1.0 / avg(n), 10) AS target_weight FROM g JOIN f USING (task, target) GROUP BY ALL""",
)
def list_target_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = item_targets(spark, sf_dir).withColumn("target", F.trim("target")).where(F.col("target") != "").distinct()
    lists = items.groupBy("subject_id", "event_idx", "task").agg(F.collect_list("target").alias("target_list"))
    keyed = lists.withColumn("sample_id", F.concat_ws("|", "subject_id", "event_idx", "task"))
    return lh.target_weights(keyed).select(
        "subject_id", "event_idx", "task", F.round("target_weight", 10).alias("target_weight")
    )


@query(
    "hospital_durations", "L16 L17 F5 F11 W12 O7",
    f"""WITH {RISK_SQL},
    st AS (SELECT subject_id, hadm_id, arg_min(starttime, event_idx) AS adm, arg_min(end_time, event_idx) AS dis
      FROM blocks WHERE file_name = 'admissions' GROUP BY ALL),
    r AS (SELECT risk.*, CASE WHEN event = 'discharge' THEN context_end - 1 ELSE context_begin END AS ai FROM risk
      WHERE task IN ({", ".join(f"'{s}'" for s, *_ in catalog.DURATION_TASKS)})),
    j AS (
      SELECT r.*, a.starttime AS a_start, a.end_time AS a_end, c.starttime AS ct, adm, dis, death_time,
        (SELECT arg_min(x.starttime, x.event_idx) FROM blocks x WHERE x.subject_id = r.subject_id AND x.hadm_id = r.hadm_id
           AND x.event_idx > ai AND x.file_name = 'icustays') AS nicu,
        (SELECT arg_min(x.starttime, x.event_idx) FROM blocks x WHERE x.subject_id = r.subject_id
           AND x.event_idx > ai AND x.file_name = 'admissions') AS nadm,
        (SELECT arg_min(x.starttime, x.event_idx) FROM blocks x WHERE x.subject_id = r.subject_id
           AND x.event_idx > ai AND x.file_name = 'edstays') AS ned
      FROM r JOIN blocks a ON a.subject_id = r.subject_id AND a.event_idx = ai
        JOIN blocks c ON c.subject_id = r.subject_id AND c.event_idx = r.context_end - 1
        LEFT JOIN st ON st.subject_id = r.subject_id AND st.hadm_id = r.hadm_id JOIN subj ON subj.subject_id = r.subject_id),
    q AS (
      SELECT subject_id, hadm_id, context_begin, context_end, t.* FROM j, LATERAL (VALUES
        ('ED_Inpatient_Mortality', 'Time_to_Inpatient_Mortality_after_ED', a_end, death_time, dis,
          coalesce(death_time <= dis, FALSE), least(greatest(date_diff('microsecond', a_end, dis) / 86400e6, 1.0 / 1440.0), 365.0)),
        ('ED_ICU_Tranfer_12hour', 'Time_to_ICU_Transfer_after_ED', a_end, nicu, a_end + INTERVAL 12 HOUR, nicu IS NOT NULL, 0.5),
        ('ED_Reattendance_3day', 'Time_to_ED_Reattendance', a_end, ned, a_end + INTERVAL 3 DAY, ned IS NOT NULL, 3.0),
        ('Readmission_60day', 'Time_to_Hospital_Readmission', a_start, nadm, a_start + INTERVAL 60 DAY, nadm IS NOT NULL, 60.0),
        ('Inpatient_Mortality', 'Time_to_Inpatient_Mortality', ct, death_time, a_end, coalesce(death_time <= a_end, FALSE),
          least(greatest(date_diff('microsecond', ct, a_end) / 86400e6, 1.0 / 1440.0), 365.0)),
        ('LengthOfStay_7day', 'Time_to_Hospital_Discharge', ct, a_end, a_end, TRUE,
          least(greatest(date_diff('microsecond', ct, coalesce(adm + INTERVAL 7 DAY, a_end)) / 86400e6, 1.0 / 1440.0), 365.0)),
        ('ICU_Mortality_14day', 'Time_to_ICU_Mortality', ct, death_time, dis, coalesce(death_time <= dis, FALSE), 14.0),
        ('ICU_Stay_14day', 'Time_to_ICU_Discharge', ct, a_end, a_end, TRUE,
          least(greatest(date_diff('microsecond', ct, a_start + INTERVAL 14 DAY) / 86400e6, 1.0 / 1440.0), 365.0)),
        ('ICU_Readmission', 'Time_to_ICU_Readmission', ct, nicu, dis, nicu IS NOT NULL,
          least(greatest(date_diff('microsecond', ct, dis) / 86400e6, 1.0 / 1440.0), 365.0))
        ) t(src, task, p, e, c, o, h) WHERE t.src = j.task AND (t.src <> 'ED_Inpatient_Mortality' OR dis IS NOT NULL)
        AND h IS NOT NULL AND (dis IS NOT NULL OR t.src <> 'ICU_Readmission')),
    u AS (SELECT *, p + to_microseconds(CAST(round(h * 86400e6) AS BIGINT)) AS hz FROM q),
    v AS (SELECT *, o AND e <= hz AS hit, CASE WHEN o AND e <= hz THEN e ELSE least(c, hz) END AS until FROM u
      WHERE e IS NULL OR e > p),
    w AS (SELECT subject_id, hadm_id, task, src AS source_task, context_begin, context_end,
        strftime(p, '%Y-%m-%d %H:%M:%S') AS prediction_time,
        CASE WHEN hit THEN strftime(e, '%Y-%m-%d %H:%M:%S') ELSE '' END AS event_time,
        coalesce(strftime(CASE WHEN hit THEN c ELSE until END, '%Y-%m-%d %H:%M:%S'), '') AS censor_time,
        round(date_diff('microsecond', p, until) / 86400e6, 6) AS time_to_event,
        CAST(coalesce(hit, FALSE) AS INTEGER) AS event_observed, round(CAST(h AS DOUBLE), 6) AS horizon_days, 'day' AS time_unit
      FROM v WHERE until > p)
    SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY subject_id, hadm_id, task, prediction_time, horizon_days
      ORDER BY context_begin, context_end) = 1""",
)
def hospital_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = stored_blocks(spark, sf_dir)
    samples = cut(risk_samples(spark, sf_dir, blocks))
    return lh.duration_tasks(samples, blocks, b.subjects(spark, sf_dir))


@query(
    "piecewise_targets", "L21",
    """WITH o AS (SELECT o_orderkey, (o_orderkey % 97) / 8.0 AS t, o_orderkey % 3 = 0 AS e,
        greatest(1, least(CAST(ceil((o_orderkey % 11) * 0.9) AS INTEGER), 8)) AS bins FROM orders),
    h AS (SELECT *, least(t, bins) AS held FROM o), i AS (SELECT h.*, i FROM h, range(8) r(i))
    SELECT o_orderkey,
      string_agg(CASE WHEN i < bins THEN format('{:.3f}', least(greatest(held - i, 0), 1)) ELSE '0.000' END, ',' ORDER BY i) AS exposure,
      string_agg(CASE WHEN e AND held > 0 AND i = least(CAST(ceil(held) AS INTEGER) - 1, bins - 1) THEN '1' ELSE '0' END, ',' ORDER BY i) AS event_bins,
      string_agg(CASE WHEN i < bins THEN '1' ELSE '0' END, ',' ORDER BY i) AS stage_mask
    FROM i GROUP BY o_orderkey""",
)
def piecewise_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.table(spark, sf_dir, "orders").select("o_orderkey")
    target = durations.piecewise_target(
        (F.col("o_orderkey") % 97) / 8.0, F.col("o_orderkey") % 3 == 0, (F.col("o_orderkey") % 11) * 0.9, 8
    )
    exposure = F.transform(target["exposure"], lambda x: F.format_string("%.3f", x.cast("double")))
    plain = lambda name: F.concat_ws(",", F.transform(target[name], lambda x: x.cast("int").cast("string")))
    return rows.select(
        "o_orderkey", F.concat_ws(",", exposure).alias("exposure"), plain("event_bins").alias("event_bins"),
        plain("stage_mask").alias("stage_mask"),
    )
