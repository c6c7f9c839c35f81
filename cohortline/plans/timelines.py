"""Blocks of the event stream, context windows and neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortline.operators import context, timeline as tl
from cohortline.operators.ordered import Running, lookup, scan, time_bucket
from cohortline.plans import bindings as b
from cohortline.plans.registry import query

ORDER = ["time", "seq"]
FIRST = ["end_time", "value", "k"]


def block_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.blocks(b.timeline_events(spark, sf_dir), ORDER, b.TIMELINE_BUCKET, FIRST)


BLOCKS_SQL = b.TIMELINE_SQL + """,
marked AS (
  SELECT *, CASE WHEN lag(file_name) OVER w IS DISTINCT FROM file_name AND lag(file_name) OVER w IS NOT NULL
    THEN 1 ELSE 0 END AS change FROM tl WINDOW w AS (PARTITION BY subject_id ORDER BY time, seq)
),
numbered AS (
  SELECT *, CAST(sum(change) OVER (PARTITION BY subject_id ORDER BY time, seq) AS BIGINT) AS event_idx FROM marked
),
blocks AS (
  SELECT subject_id, event_idx, min(file_name) AS file_name, min(time) AS starttime, max(time) AS endtime,
         arg_min(hadm_id, (time, seq)) AS hadm_id, arg_min(end_time, (time, seq)) AS end_time,
         arg_min(value, (time, seq)) AS value, arg_min(k, (time, seq)) AS k, count(*) AS n_items
  FROM numbered GROUP BY subject_id, event_idx
)"""


@query("event_blocks", "W4 W5 S7", f"WITH {BLOCKS_SQL} SELECT * FROM blocks")
def event_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_table(spark, sf_dir)


@query(
    "block_items", "W4 S7",
    f"WITH {BLOCKS_SQL} SELECT subject_id, event_idx, seq, file_name, hadm_id FROM numbered",
)
def block_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.timeline_events(spark, sf_dir).select("subject_id", "hadm_id", "file_name", "time", "seq")
    return tl.block_items(rows, ORDER, b.TIMELINE_BUCKET).select("subject_id", "event_idx", "seq", "file_name", "hadm_id")


def clinical_sources(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Four sources per subject: demographics, timed events, untimed diagnoses and untimed DRG codes."""
    events = b.timeline_events(spark, sf_dir).select("subject_id", "hadm_id", "file_name", "time", "seq")
    people = b.subjects(spark, sf_dir).select("subject_id", F.lit("patients").alias("file_name"), F.lit(-1).cast("bigint").alias("seq"))
    coded = events.where(F.col("file_name") == "admissions").select("subject_id", "hadm_id", "seq")
    orphan = F.when(F.col("seq") % 5 == 0, -F.col("hadm_id")).otherwise(F.col("hadm_id"))
    diagnoses = coded.select("subject_id", orphan.alias("hadm_id"), F.lit("diagnoses_icd").alias("file_name"), "seq")
    drg = coded.select("subject_id", "hadm_id", F.lit("drgcodes").alias("file_name"), "seq")
    noise = coded.select("subject_id", "hadm_id", F.lit("hcpcsevents").alias("file_name"), "seq")
    return [events, people, diagnoses, drg, noise]


MERGED_SQL = b.TIMELINE_SQL + "," + b.SUBJECTS_SQL + """,
src AS (
  SELECT subject_id, hadm_id, file_name, time, seq FROM tl
  UNION ALL SELECT subject_id, NULL, 'patients', NULL, -1 FROM subj
  UNION ALL SELECT subject_id, CASE WHEN seq % 5 = 0 THEN -hadm_id ELSE hadm_id END, 'diagnoses_icd', NULL, seq
    FROM tl WHERE file_name = 'admissions'
  UNION ALL SELECT subject_id, hadm_id, 'drgcodes', NULL, seq FROM tl WHERE file_name = 'admissions'
),
lastt AS (SELECT subject_id, hadm_id, max(time) AS l FROM tl GROUP BY ALL),
placed AS (
  SELECT src.*, coalesce(time, l, TIMESTAMP '9999-12-31 00:00:00') AS st,
    CASE WHEN file_name = 'patients' THEN 0 ELSE 1 END AS sp,
    CASE WHEN time IS NOT NULL THEN 0 WHEN file_name = 'diagnoses_icd' THEN 1 WHEN file_name = 'drgcodes' THEN 2 ELSE 0 END AS su
  FROM src LEFT JOIN lastt USING (subject_id, hadm_id)
),
merged AS (
  SELECT subject_id, hadm_id, file_name, time, seq, sp, st, su,
    row_number() OVER (PARTITION BY subject_id ORDER BY sp, st, su, file_name, seq) - 1 AS position FROM placed
)"""


def merged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = tl.place_untimed(tl.merge_sources(clinical_sources(spark, sf_dir)))
    order = ["sort_person", "sort_time", "sort_untimed", "file_name", "seq"]
    return tl.number_events(placed, order, b.TIMELINE_BUCKET)


@query(
    "merged_timeline", "W3 W1 O4 S6",
    f"WITH {MERGED_SQL} SELECT subject_id, hadm_id, file_name, seq, position FROM merged",
)
def merged_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged_events(spark, sf_dir).select("subject_id", "hadm_id", "file_name", "seq", "position")


EMERGENCY = {"signup": "edstays", "purchase": "triage", "error": "medrecon", "view": "vitalsign", "click": "diagnosis"}


def emergency_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Emergency rows keyed by stay (the weekly episode) and the stays with arrival and departure."""
    kinds = F.create_map(*[F.lit(x) for pair in EMERGENCY.items() for x in pair])
    source = b.table(spark, sf_dir, "events").select("event_id", "event_type")
    rows = b.timeline_events(spark, sf_dir).drop("file_name").join(source, F.col("seq") == F.col("event_id")).select(
        F.col("hadm_id").alias("stay_id"), kinds[F.col("event_type")].alias("file_name"), "time", "seq"
    )
    stays = rows.groupBy("stay_id").agg(F.min("time").alias("intime"), F.max("time").alias("outtime"))
    untimed = F.col("file_name").isin("triage", "diagnosis")
    return rows.withColumn("time", F.when(~untimed, F.col("time"))), stays


@query(
    "emergency_order", "W1 W2",
    f"""WITH {b.TIMELINE_SQL},
    e AS (SELECT hadm_id AS stay_id, seq, time, CASE file_name WHEN 'admissions' THEN 'edstays' WHEN 'discharge' THEN 'triage'
            WHEN 'icustays' THEN 'medrecon' WHEN 'edstays' THEN 'vitalsign' ELSE 'diagnosis' END AS file_name FROM tl),
    s AS (SELECT stay_id, min(time) AS i, max(time) AS o FROM e GROUP BY stay_id),
    r AS (SELECT stay_id, seq, file_name,
            CASE file_name WHEN 'triage' THEN i + INTERVAL 1 SECOND WHEN 'diagnosis' THEN o ELSE time END AS time,
            CASE WHEN file_name IN ('edstays', 'triage') THEN TIMESTAMP '0001-01-01' WHEN file_name = 'diagnosis'
              THEN TIMESTAMP '9999-01-01' ELSE time END AS key,
            CASE file_name WHEN 'edstays' THEN 0 WHEN 'triage' THEN 1 WHEN 'medrecon' THEN 2 WHEN 'vitalsign' THEN 4 ELSE 5 END AS fr
          FROM e JOIN s USING (stay_id))
    SELECT stay_id, seq, file_name, time,
      row_number() OVER (PARTITION BY stay_id ORDER BY key, fr, seq) - 1 AS position FROM r""",
)
def emergency_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, stays = emergency_rows(spark, sf_dir)
    sorted_rows = tl.emergency_order(tl.emergency_times(rows, stays))
    ranked = scan(
        sorted_rows, ["stay_id"], ["sort_place", "sort_time", "sort_rank", "seq"],
        [Running("position", "sum", F.lit(1).cast("bigint"))],
        # place is part of the order, so it leads the bucket too
        F.col("sort_place").cast("bigint") * F.lit(2**40) + F.greatest(time_bucket("sort_time", 86_400), F.lit(0)),
    )
    return ranked.select("stay_id", "seq", "file_name", "time", (F.col("position") - 1).alias("position"))


@query(
    "intensive_order", "W1",
    f"""WITH {b.TIMELINE_SQL}
    SELECT subject_id, hadm_id, seq, file_name, row_number() OVER (PARTITION BY subject_id, hadm_id
      ORDER BY CASE WHEN file_name = 'icustays' THEN 0 ELSE 1 END,
               CASE WHEN file_name <> 'icustays' THEN time END NULLS FIRST, seq) - 1 AS position FROM tl""",
)
def intensive_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tl.intensive_order(b.timeline_events(spark, sf_dir).select("subject_id", "hadm_id", "file_name", "time", "seq"))
    ranked = scan(
        rows, ["subject_id", "hadm_id"], ["sort_place", "sort_time", "seq"],
        [Running("position", "sum", F.lit(1).cast("bigint"))],
        F.col("sort_place").cast("bigint") * F.lit(2**40) + F.greatest(time_bucket("sort_time", 86_400), F.lit(0)),
    )
    return ranked.select("subject_id", "hadm_id", "seq", "file_name", (F.col("position") - 1).alias("position"))


def anchor_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_table(spark, sf_dir).select("subject_id", "event_idx", "hadm_id", "starttime", "end_time", "file_name")


@query(
    "forward_context", "W6 W9 F9",
    f"""WITH {BLOCKS_SQL} SELECT a.subject_id, a.event_idx, max(x.event_idx) AS context_end
    FROM blocks a LEFT JOIN blocks x ON x.subject_id = a.subject_id AND x.hadm_id = a.hadm_id
      AND x.event_idx > a.event_idx AND x.starttime < a.starttime + INTERVAL 24 HOUR
    WHERE a.file_name IN ('admissions', 'icustays') GROUP BY ALL""",
)
def forward_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = context.forward_context(F.col("file_name").isin("admissions", "icustays"), anchor_blocks(spark, sf_dir))
    return found.select("subject_id", "event_idx", "context_end")


@query(
    "backward_context", "W7",
    f"""WITH {BLOCKS_SQL} SELECT a.subject_id, a.event_idx, min(x.event_idx) AS context_begin
    FROM blocks a LEFT JOIN blocks x ON x.subject_id = a.subject_id AND x.hadm_id = a.hadm_id
      AND x.event_idx < a.event_idx AND x.event_idx > 0 AND x.starttime > a.starttime - INTERVAL 24 HOUR
    WHERE a.file_name = 'discharge' GROUP BY ALL""",
)
def backward_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = context.backward_context(F.col("file_name") == "discharge", anchor_blocks(spark, sf_dir))
    return found.select("subject_id", "event_idx", "context_begin")


@query(
    "emergency_context", "W8",
    f"""WITH {BLOCKS_SQL} SELECT a.subject_id, a.event_idx, max(x.event_idx) AS context_end
    FROM blocks a LEFT JOIN blocks x ON x.subject_id = a.subject_id AND x.event_idx > a.event_idx
      AND x.starttime < a.end_time
    WHERE a.file_name = 'edstays' GROUP BY ALL""",
)
def emergency_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = context.until_time(F.col("file_name") == "edstays", anchor_blocks(spark, sf_dir), F.col("end_time"))
    return found.select("subject_id", "event_idx", "context_end")


@query(
    "between_discharges", "W10 W11",
    f"""WITH {BLOCKS_SQL},
    d AS (
      SELECT a.*, (SELECT max(x.event_idx) FROM blocks x WHERE x.subject_id = a.subject_id AND x.file_name = 'discharge'
               AND x.event_idx < a.event_idx) AS last_discharge_id,
             (SELECT max(x.event_idx) FROM blocks x WHERE x.subject_id = a.subject_id AND x.file_name = 'admissions'
               AND x.hadm_id = a.hadm_id AND x.event_idx < a.event_idx) AS admissions_id
      FROM blocks a WHERE a.file_name = 'discharge'),
    c AS (SELECT *, coalesce(last_discharge_id, admissions_id) + 1 AS context_begin FROM d WHERE admissions_id IS NOT NULL)
    SELECT subject_id, event_idx, admissions_id, last_discharge_id, context_begin, event_idx AS context_end FROM c
    WHERE EXISTS (SELECT 1 FROM blocks x WHERE x.subject_id = c.subject_id AND x.file_name = 'labevents'
      AND x.event_idx >= c.context_begin AND x.event_idx < c.event_idx)""",
)
def between_discharges(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = block_table(spark, sf_dir).select("subject_id", "event_idx", "hadm_id", "file_name")
    found = context.between_discharges(blocks, ["labevents", "omr", "chartevents"])
    return found.select("subject_id", "event_idx", "admissions_id", "last_discharge_id", "context_begin", "context_end")


@query(
    "last_admission_and_discharge", "W11",
    f"""WITH {BLOCKS_SQL} SELECT subject_id, event_idx,
      max(CASE WHEN file_name = 'admissions' THEN event_idx END) OVER w AS admission_idx,
      max(CASE WHEN file_name = 'discharge' THEN event_idx END) OVER w AS discharge_idx
    FROM blocks WINDOW w AS (PARTITION BY subject_id ORDER BY event_idx)""",
)
def last_admission_and_discharge(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = context.seen_so_far(block_table(spark, sf_dir))
    return seen.select(
        "subject_id", "event_idx", F.col("last_admission.event_idx").alias("admission_idx"),
        F.col("last_discharge.event_idx").alias("discharge_idx"),
    )


@query(
    "next_event_of_kind", "W12",
    f"""WITH {BLOCKS_SQL} SELECT subject_id, event_idx,
      min(CASE WHEN file_name = 'admissions' THEN event_idx END) OVER (PARTITION BY subject_id ORDER BY event_idx
        ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_admission,
      min(CASE WHEN file_name = 'icustays' THEN event_idx END) OVER (PARTITION BY subject_id, hadm_id ORDER BY event_idx
        ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_icu_same_admission
    FROM blocks""",
)
def next_event_of_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = block_table(spark, sf_dir).select("subject_id", "hadm_id", "event_idx", "file_name")
    any_admission = tl.next_of_kind(blocks, ["subject_id"], {"adm": F.col("file_name") == "admissions"}, ["event_idx"])
    both = tl.next_of_kind(
        any_admission, ["subject_id", "hadm_id"], {"icu": F.col("file_name") == "icustays"}, ["event_idx"]
    )
    return both.select(
        "subject_id", "event_idx", F.col("adm.event_idx").alias("next_admission"),
        F.col("icu.event_idx").alias("next_icu_same_admission"),
    )


def omop_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encounter rows numbered by start time per patient, with an OMOP-style table name."""
    kinds = F.element_at(
        F.array(*[F.lit(t) for t in ("person", "measurement", "note", "visit_occurrence", "measurement")]),
        F.pmod(F.col("encounter"), F.lit(5)).cast("int") + 1,
    )
    who = b.encounters(spark, sf_dir).select(
        F.col("patient").alias("subject_id"), "encounter", kinds.alias("omop_table"), F.col("admit_time").alias("start"),
        F.col("discharge_time").alias("end"),
    )
    ranked = scan(
        who, ["subject_id"], ["start", "encounter"], [Running("row_idx", "sum", F.lit(1).cast("bigint"))],
        time_bucket("start", 365 * 86_400),
    )
    return ranked.withColumn("row_idx", F.col("row_idx") - 1)


OMOP_SQL = b.ENCOUNTERS_SQL + """,
omop AS (
  SELECT patient AS subject_id, encounter, CASE encounter % 5 WHEN 0 THEN 'person' WHEN 2 THEN 'note'
      WHEN 3 THEN 'visit_occurrence' ELSE 'measurement' END AS omop_table,
    admit_time AS start, discharge_time AS "end",
    row_number() OVER (PARTITION BY patient ORDER BY admit_time, encounter) - 1 AS row_idx
  FROM encounters
)"""


@query(
    "label_period_range", "W13 J16",
    f"""WITH {OMOP_SQL},
    labels AS (SELECT subject_id, encounter, "end" AS prediction_time FROM omop WHERE omop_table = 'visit_occurrence')
    SELECT l.subject_id, l.encounter, (SELECT min(row_idx) FROM omop o WHERE o.subject_id = l.subject_id
        AND omop_table <> 'person') AS period_begin, max(o.row_idx) AS period_end
    FROM labels l JOIN omop o ON o.subject_id = l.subject_id AND o.omop_table <> 'person' AND o.start <= l.prediction_time
    GROUP BY ALL""",
)
def label_period_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = omop_rows(spark, sf_dir)
    labels = rows.where(F.col("omop_table") == "visit_occurrence").select(
        "subject_id", "encounter", F.col("end").alias("prediction_time")
    )
    return context.period_range(labels, rows).select("subject_id", "encounter", "period_begin", "period_end")


@query(
    "visit_slices", "W14",
    f"""WITH {OMOP_SQL},
    v AS (SELECT subject_id, encounter, start AS visit_start, start + INTERVAL 400 DAY AS visit_end
          FROM omop WHERE omop_table = 'visit_occurrence')
    SELECT v.subject_id, v.encounter, min(row_idx) AS period_begin, max(row_idx) AS period_end, count(*) AS n_rows
    FROM v JOIN omop o ON o.subject_id = v.subject_id AND omop_table NOT IN ('person', 'note')
      AND o.start BETWEEN visit_start AND visit_end
    GROUP BY ALL HAVING count(*) >= 2""",
)
def visit_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = omop_rows(spark, sf_dir)
    visits = rows.where(F.col("omop_table") == "visit_occurrence").select(
        "subject_id", "encounter", F.col("start").alias("visit_start"),
        (F.col("start") + F.expr("INTERVAL 400 DAYS")).alias("visit_end"),
    )
    return context.visit_slices(visits, rows, min_rows=2).select(
        "subject_id", "encounter", "period_begin", "period_end", "n_rows"
    )


@query(
    "step_function_lookup", "J15",
    """WITH c AS (SELECT o_orderdate AS t, CAST(count(*) AS DOUBLE) AS v FROM orders GROUP BY 1)
    SELECT event_id, coalesce((SELECT arg_max(v, t) FROM c WHERE t <= ts - INTERVAL 9000 DAY), 1.0) AS v FROM events""",
)
def step_function_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last value of a step curve at or before each time, 1 before its first step."""
    curve = b.table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").alias("at")).agg(
        F.count(F.lit(1)).cast("double").alias("v")
    ).withColumn("one", F.lit(1)).withColumn("t", F.col("at"))
    asked = b.table(spark, sf_dir, "events").select(
        "event_id", (F.col("ts") - F.expr("INTERVAL 9000 DAYS")).alias("asked_at"), F.lit(1).alias("one")
    )
    found = lookup(
        asked, curve, ["one"], "asked_at", "at",
        [Running("f", "last", F.when(F.col("_p_t").isNotNull(), F.struct(F.col("_p_v").alias("v"))))],
        bucket_seconds=86_400,
    )
    return found.select("event_id", F.coalesce(F.col("f.v"), F.lit(1.0)).alias("v"))
