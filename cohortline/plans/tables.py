"""Measurement tables of every source and the feature tables built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortline.functions import times
from cohortline.operators import context, features as ft, measurement as mt
from cohortline.operators.ordered import position
from cohortline.plans import bindings as b
from cohortline.plans.followup import FOLLOWUP_SQL, SURGERY_SQL, followups
from cohortline.operators import labels_followup as lf
from cohortline.plans.icu import labs, patients
from cohortline.plans.registry import query
from cohortline.plans.timelines import BLOCKS_SQL, ORDER, block_table, omop_rows, OMOP_SQL
from cohortline.operators import timeline as tl
from cohortline.session import cut

KINDS = ("labevents", "inputevents", "microbiologyevents", "omr", "emar", "vitalsign", "services", "transfers", "prescriptions",
         "medrecon", "patients", "poe", "chartevents", "procedures_icd")


def source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as source rows of fourteen tables, their attributes as a map of strings."""
    seq, k, value = F.col("event_id"), F.get_json_object("props", "$.k"), F.col("value")
    kind = F.element_at(F.array(*[F.lit(t) for t in KINDS]), (seq % len(KINDS) + 1).cast("int"))
    number = F.format_string("%.2f", value)
    blank = lambda every, c: F.when(seq % every == 0, F.lit("nan")).otherwise(c)
    attrs = F.create_map(*[x for name, c in {
        "item_name": F.concat(F.lit("Item "), k), "valuenum": blank(3, number), "value": F.when(seq % 6 != 0, F.lit("see note")),
        "valueuom": F.when(seq % 4 != 0, F.lit("mg/dL")), "amount": blank(5, number), "rate": F.when(seq % 2 == 0, k),
        "amountuom": F.lit("mL"), "test_name": F.concat(F.lit("Culture "), k), "org_name": F.when(seq % 3 == 0, F.lit("E. COLI")),
        "dilution_value": F.when(seq % 4 == 0, k), "interpretation": F.when(seq % 8 != 2, F.lit("S")),
        "result_name": F.when(seq % 2 == 0, F.lit("Blood Pressure")).otherwise(F.lit("Weight (Lbs)")),
        "result_value": F.when(seq % 4 == 0, F.concat(k, F.lit("/80"))).otherwise(k), "medication": F.concat(F.lit("Drug "), k),
        "temperature": number, "heartrate": F.when(seq % 3 == 0, k), "sbp": F.lit("None"),
        "curr_service": F.when(seq % 3 == 0, F.lit("MED")), "prev_service": F.lit("SURG"), "transfertime": F.lit("2024-01-02"),
        "careunit": blank(3, F.lit("MICU")), "eventtype": F.lit("admit"), "drug": F.concat(F.lit("Rx "), k),
        "dose_val_rx": F.when(seq % 3 == 0, k), "route": F.lit("IV"), "form_unit_disp": F.lit("TAB"),
        "name": F.when(seq % 4 != 1, F.concat(F.lit("Med "), k)), "ndc": k, "anchor_age": k, "gender": F.when(seq % 3 == 0, "M").otherwise("f"),
        "procedures": F.concat(F.lit("Proc "), k),
    }.items() for x in (F.lit(name), c.cast("string"))])
    return b.table(spark, sf_dir, "events").select(
        seq.alias("seq"), F.col("user_id").alias("subject_id"), kind.alias("file_name"), F.col("ts").alias("starttime"), attrs.alias("attrs")
    )


HOSPITAL_SQL = """
ev AS (SELECT event_id AS seq, event_id % 14 AS t, ts, user_id, json_extract_string(props, '$.k') AS k, printf('%.2f', value) AS num FROM events),
hosp AS (
  SELECT seq, user_id, ts, 0 AS part, 'Item ' || k AS item, CASE WHEN seq % 3 = 0 THEN CASE WHEN seq % 6 <> 0 THEN 'see note' END ELSE num END AS value,
    CASE WHEN seq % 4 <> 0 THEN 'mg/dL' ELSE '' END AS unit, 'measurement' AS cat FROM ev WHERE t IN (0, 12)
  UNION ALL SELECT seq, user_id, ts, 0, 'Item ' || k || '_Amount', num, 'mL', 'drug_exposure' FROM ev WHERE t = 1 AND seq % 5 <> 0
  UNION ALL SELECT seq, user_id, ts, CASE WHEN seq % 5 = 0 THEN 0 ELSE 1 END, 'Item ' || k || '_Rate', k, '', 'drug_exposure' FROM ev WHERE t = 1 AND seq % 2 = 0
  UNION ALL SELECT seq, user_id, ts, 0, 'Culture ' || k || '_' || CASE WHEN seq % 3 = 0 THEN 'E. COLI' ELSE 'Unknown' END || '_Unknown',
    CASE WHEN seq % 4 = 0 THEN k WHEN seq % 8 <> 2 THEN 'S' END, '', 'measurement' FROM ev WHERE t = 2
  UNION ALL SELECT seq, user_id, ts, 0, 'Weight', k, 'Lbs', 'observation' FROM ev WHERE t = 3 AND seq % 2 = 1
  UNION ALL SELECT seq, user_id, ts, 0, 'Blood Pressure', k, '', 'observation' FROM ev WHERE t = 3 AND seq % 4 = 2
  UNION ALL SELECT seq, user_id, ts, 0, 'Systolic Blood Pressure', k, 'mmHg', 'observation' FROM ev WHERE t = 3 AND seq % 4 = 0
  UNION ALL SELECT seq, user_id, ts, 1, 'Diastolic Blood Pressure', '80', 'mmHg', 'observation' FROM ev WHERE t = 3 AND seq % 4 = 0
  UNION ALL SELECT seq, user_id, ts, 0, 'Drug ' || k, '', '', 'drug_exposure' FROM ev WHERE t = 4
  UNION ALL SELECT seq, user_id, ts, 0, 'Temperature', num, 'F', 'measurement' FROM ev WHERE t = 5
  UNION ALL SELECT seq, user_id, ts, 1, 'Heartrate', k, 'bpm', 'measurement' FROM ev WHERE t = 5 AND seq % 3 = 0
  UNION ALL SELECT seq, user_id, ts, 0, CASE WHEN seq % 3 = 0 THEN 'MED' ELSE 'SURG' END, '2024-01-02', '', 'visit_detail' FROM ev WHERE t = 6
  UNION ALL SELECT seq, user_id, ts, 0, CASE WHEN seq % 3 = 0 THEN 'admit' ELSE 'MICU' END, 'admit', '', 'visit_detail' FROM ev WHERE t = 7
  UNION ALL SELECT seq, user_id, ts, 0, 'Rx ' || k, CASE WHEN seq % 3 = 0 THEN k ELSE 'IV' END, 'TAB', 'drug_exposure' FROM ev WHERE t = 8
  UNION ALL SELECT seq, user_id, ts, 0, CASE WHEN seq % 4 <> 1 THEN 'Med ' || k ELSE k END, '', '', 'drug_exposure' FROM ev WHERE t = 9
  UNION ALL SELECT seq, user_id, ts, 0, 'Age', k, 'years', 'person' FROM ev WHERE t = 10
  UNION ALL SELECT seq, user_id, ts, 1, 'Gender', CASE WHEN seq % 3 = 0 THEN 'Male' ELSE 'Female' END, '', 'person' FROM ev WHERE t = 10
  UNION ALL SELECT seq, user_id, ts, 0, 'Proc ' || k, '', '', 'procedure_occurrence' FROM ev WHERE t = 13)"""


@query(
    "hospital_measurements", "M1 F13 F18 F24 S6",
    f"""WITH {HOSPITAL_SQL} SELECT seq, part, strftime(ts, '%Y-%m-%d %H:%M:%S') AS "Time", item AS "Item", value AS "Value", unit AS "Unit",
      cat AS "Category" FROM hosp WHERE value IS NOT NULL""",
)
def hospital_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = mt.hospital_table(source_rows(spark, sf_dir), ["seq"])
    return table.withColumn("Time", times.time_text(F.col("Time")))


def context_samples(spark: SparkSession, sf_dir: str, blocks: DataFrame) -> DataFrame:
    """Samples of the 24 h after each admission block; laboratory blocks are hidden from every third."""
    anchors = blocks.where(F.col("file_name") == "admissions").select("subject_id", "event_idx", "hadm_id", "starttime", "end_time", "file_name")
    found = context.forward_context(anchors, blocks).where(F.col("context_end").isNotNull())
    hidden = F.when(F.col("event_idx") % 3 == 0, F.array(F.lit("labevents"))).otherwise(F.array().cast("array<string>"))
    return found.select(
        F.concat_ws("|", "subject_id", "event_idx").alias("sample_id"), "subject_id", F.col("event_idx").alias("context_begin"),
        (F.col("context_end") + 1).alias("context_end"), hidden.alias("hidden_events"),
    )


CONTEXT_SQL = BLOCKS_SQL + """,
cs AS (SELECT a.subject_id || '|' || a.event_idx AS sample_id, a.subject_id, a.event_idx AS b, max(x.event_idx) + 1 AS e, a.event_idx % 3 = 0 AS hide
  FROM blocks a JOIN blocks x ON x.subject_id = a.subject_id AND x.hadm_id = a.hadm_id AND x.event_idx > a.event_idx
    AND x.starttime < a.starttime + INTERVAL 24 HOUR WHERE a.file_name = 'admissions' GROUP BY ALL),
cb AS (SELECT sample_id, subject_id, x.event_idx, x.file_name FROM cs JOIN blocks x USING (subject_id)
  WHERE x.event_idx >= b AND x.event_idx < e AND x.file_name NOT IN ('admissions', 'discharge') AND NOT (hide AND x.file_name = 'labevents'))"""


@query("context_blocks", "M2 M8", f"WITH {CONTEXT_SQL} SELECT sample_id, event_idx, file_name FROM cb")
def context_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = cut(block_table(spark, sf_dir))
    inside = mt.context_blocks(context_samples(spark, sf_dir, blocks), blocks)
    return inside.select("sample_id", "event_idx", "file_name")


def sample_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurement tables of subjects: all their rows, plus an undated person row."""
    rows = mt.hospital_table(source_rows(spark, sf_dir), ["subject_id", "seq"])
    table = rows.withColumn("sample_id", F.col("subject_id").cast("string"))
    person = b.subjects(spark, sf_dir).select(
        F.col("subject_id").cast("string").alias("sample_id"), F.lit(-1).cast("bigint").alias("seq"), F.lit(0).alias("part"),
        F.lit(None).cast("timestamp_ntz").alias("Time"), F.lit("Race").alias("Item"),
        F.when(F.col("subject_id") % 2 == 0, "A").otherwise("B").alias("Value"), F.lit("").alias("Unit"), F.lit("person").alias("Category"),
    )
    both = table.select(*person.columns).unionByName(person)
    return mt.with_position(mt.fill_person_time(both), ["seq", "part"])


TABLE_SQL = HOSPITAL_SQL + """,
u0 AS (SELECT CAST(user_id AS VARCHAR) AS sample_id, seq, part, ts, item, value, unit, cat FROM hosp WHERE value IS NOT NULL),
u1 AS (SELECT sample_id, -1 AS seq, 0 AS part, min(ts) AS ts, 'Race' AS item, CASE WHEN CAST(sample_id AS BIGINT) % 2 = 0 THEN 'A' ELSE 'B' END AS value, '' AS unit, 'person' AS cat
  FROM u0 GROUP BY sample_id),
ut AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY ts, seq, part) - 1 AS pos FROM (SELECT * FROM u0 UNION ALL SELECT * FROM u1)),
ul AS (SELECT sample_id, count(*) AS n FROM ut GROUP BY sample_id)"""


@query(
    "subject_tables", "M1 W20 M8",
    f"""WITH {TABLE_SQL} SELECT sample_id, pos, strftime(ts, '%Y-%m-%d %H:%M:%S') AS "Time", item AS "Item", value AS "Value", unit AS "Unit", cat AS "Category" FROM ut""",
)
def subject_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_tables(spark, sf_dir).select("sample_id", "pos", times.time_text(F.col("Time")).alias("Time"), "Item", "Value", "Unit", "Category")


@query("table_lengths", "A25", f"WITH {TABLE_SQL} SELECT sample_id, n AS table_length FROM ul")
def table_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.table_lengths(sample_tables(spark, sf_dir))


@query(
    "sliding_windows", "W15",
    f"""WITH {TABLE_SQL}, w AS (SELECT sample_id, 0 AS start FROM ul WHERE n BETWEEN 2 AND 16
      UNION SELECT sample_id, s * 12 FROM ul, range(100000) r(s) WHERE n > 16 AND s * 12 <= n - 16
      UNION SELECT sample_id, n - 16 FROM ul WHERE n > 16) SELECT sample_id, CAST(start AS BIGINT) AS start FROM w""",
)
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.windows(mt.table_lengths(sample_tables(spark, sf_dir)), 16, 12)


@query(
    "thinned_rows", "W16",
    f"""WITH {TABLE_SQL}, a AS (SELECT ut.*, n FROM ut JOIN ul USING (sample_id)),
    o AS (SELECT sample_id, pos FROM a WHERE n > 20 AND pos < n - 15
      QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY md5(sample_id || '|' || pos || '|42'), pos) <= 5)
    SELECT sample_id, pos FROM a WHERE n <= 20 OR pos >= n - 15 UNION ALL SELECT * FROM o""",
)
def thinned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sample_tables(spark, sf_dir).select("sample_id", "pos")
    return ft.thinned_rows(rows, mt.table_lengths(rows), 20)


@query("tail_rows", "W17 O2", f"WITH {TABLE_SQL} SELECT sample_id, pos FROM ut JOIN ul USING (sample_id) WHERE pos >= n - 7")
def tail_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.tail_rows(sample_tables(spark, sf_dir).select("sample_id", "pos"), 7)


REL_SQL = TABLE_SQL + """,
rel AS (SELECT *, date_diff('microsecond', min(ts) OVER (PARTITION BY sample_id), ts) / 3600e6 + 1 AS rel_hours FROM ut)"""


@query("relative_hours", "W18", f"WITH {REL_SQL} SELECT sample_id, pos, round(rel_hours, 6) AS rel_hours FROM rel")
def relative_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.relative_hours(sample_tables(spark, sf_dir)).select("sample_id", "pos", F.round("rel_hours", 6).alias("rel_hours"))


@query(
    "next_row_targets", "W19 F27",
    f"""WITH {REL_SQL} SELECT sample_id, pos, lead(item) OVER w AS "next_Item", lead(cat) OVER w AS "next_Category",
      round(ln(1 + greatest(lead(rel_hours) OVER w - rel_hours, 0)), 6) AS time_delta FROM rel
    WINDOW w AS (PARTITION BY sample_id ORDER BY pos) QUALIFY lead(item) OVER w IS NOT NULL""",
)
def next_row_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ft.relative_hours(sample_tables(spark, sf_dir)).select("sample_id", "pos", "Item", "Category", "rel_hours")
    return ft.next_row_targets(rows, ["Item", "Category"]).withColumn("time_delta", F.round("time_delta", 6))


TEXTS_SQL = TABLE_SQL + """,
texts AS (SELECT DISTINCT x AS text FROM (SELECT item AS x FROM ut UNION ALL SELECT unit FROM ut UNION ALL SELECT value FROM ut WHERE TRY_CAST(value AS DOUBLE) IS NULL)
  WHERE trim(x) <> ''),
vocab AS (SELECT text, row_number() OVER (ORDER BY encode(text)) + 2 AS id FROM texts
  UNION ALL SELECT * FROM (VALUES ('[PAD]', 0), ('[UNK]', 1), ('[MASK]', 2)))"""


@query("harvested_texts", "A24 O5", f"WITH {TEXTS_SQL} SELECT text FROM texts")
def harvested_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.harvested_texts(sample_tables(spark, sf_dir))


@query("vocabulary", "E1", f"WITH {TEXTS_SQL} SELECT text, CAST(id AS BIGINT) AS id FROM vocab")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.vocabulary(ft.harvested_texts(sample_tables(spark, sf_dir)))


@query(
    "grown_vocabulary", "E1 E5",
    f"""WITH {TEXTS_SQL},
    old AS (SELECT DISTINCT x AS text FROM (SELECT item AS x FROM ut WHERE CAST(sample_id AS BIGINT) % 3 = 0 UNION ALL SELECT unit FROM ut WHERE CAST(sample_id AS BIGINT) % 3 = 0
      UNION ALL SELECT value FROM ut WHERE CAST(sample_id AS BIGINT) % 3 = 0 AND TRY_CAST(value AS DOUBLE) IS NULL) WHERE trim(x) <> ''),
    first AS (SELECT text, row_number() OVER (ORDER BY encode(text)) + 2 AS id FROM old UNION ALL SELECT * FROM (VALUES ('[PAD]', 0), ('[UNK]', 1), ('[MASK]', 2))),
    later AS (SELECT text, row_number() OVER (ORDER BY encode(text)) + (SELECT max(id) FROM first) AS id FROM texts ANTI JOIN first USING (text))
    SELECT text, CAST(id AS BIGINT) AS id FROM first UNION ALL SELECT text, CAST(id AS BIGINT) FROM later""",
)
def grown_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary of a third of the samples, then those of all: no id of the first step moves."""
    rows = cut(sample_tables(spark, sf_dir))
    first = cut(ft.vocabulary(ft.harvested_texts(rows.where(F.col("sample_id").cast("bigint") % 3 == 0))))
    return ft.grown_vocabulary(first, ft.harvested_texts(rows))


TYPES = ("person", "measurement", "drug_exposure")
TOKENS_SQL = TEXTS_SQL + """,
tk AS (SELECT ut.sample_id, ut.pos, coalesce(i.id, 0)::BIGINT AS item_id, coalesce(u.id, 0)::BIGINT AS unit_id,
    coalesce(v.id, 0)::BIGINT AS value_text_id, coalesce(TRY_CAST(value AS DOUBLE), 0.0) AS numeric_value,
    CAST(TRY_CAST(value AS DOUBLE) IS NOT NULL AS INTEGER) AS numeric_mask,
    CASE cat WHEN 'person' THEN 1 WHEN 'measurement' THEN 2 WHEN 'drug_exposure' THEN 3 ELSE 0 END AS type_id
  FROM ut LEFT JOIN vocab i ON i.text = item LEFT JOIN vocab u ON u.text = unit LEFT JOIN vocab v ON v.text = value AND TRY_CAST(value AS DOUBLE) IS NULL),
fe AS (SELECT item_id, unit_id, row_number() OVER (ORDER BY item_id, unit_id) AS feature_id FROM (SELECT DISTINCT item_id, unit_id FROM tk WHERE numeric_mask = 1))"""


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(sample_tables(spark, sf_dir))
    vocab = ft.vocabulary(ft.harvested_texts(rows))
    return ft.token_rows(rows, vocab, TYPES).select(
        "sample_id", "pos", "item_id", "unit_id", "value_text_id", "numeric_value", "numeric_mask", "type_id"
    )


@query("token_rows", "E2", f"WITH {TOKENS_SQL} SELECT * FROM tk")
def token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(spark, sf_dir)


@query(
    "token_windows", "E2",
    f"""WITH {TOKENS_SQL} SELECT sample_id, CAST(floor(pos / 32) AS BIGINT) AS chunk, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY pos) AS item_ids,
      string_agg(CAST(type_id AS VARCHAR), ',' ORDER BY pos) AS type_ids FROM tk GROUP BY ALL""",
)
def token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrays = ft.token_batches(tokens(spark, sf_dir), 32, ["item_id", "type_id"])
    plain = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return arrays.select("sample_id", "chunk", plain("item_id").alias("item_ids"), plain("type_id").alias("type_ids"))


@query(
    "numeric_feature_ids", "E4",
    f"WITH {TOKENS_SQL} SELECT sample_id, pos, coalesce(feature_id, 0) AS feature_id FROM tk LEFT JOIN fe USING (item_id, unit_id)",
)
def numeric_feature_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(tokens(spark, sf_dir))
    return ft.with_feature_ids(rows, ft.numeric_features(rows)).select("sample_id", "pos", "feature_id")


@query(
    "rows_of_kept_blocks", "E3",
    f"""WITH {BLOCKS_SQL} SELECT subject_id, event_idx, seq FROM numbered WHERE subject_id % 3 = 0 OR event_idx IN (1, 3, 4)""",
)
def rows_of_kept_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tl.block_items(b.timeline_events(spark, sf_dir).select("subject_id", "file_name", "time", "seq"), ORDER, b.TIMELINE_BUCKET).select(
        F.col("subject_id").alias("sample_id"), F.col("event_idx").alias("block_id"), "seq"
    )
    kept = rows.select("sample_id").distinct().withColumn(
        "block_ids", F.when(F.col("sample_id") % 3 != 0, F.array(F.lit("1"), F.lit("3"), F.lit("4"))).otherwise(F.array().cast("array<string>"))
    )
    found = ft.kept_blocks(rows, kept)
    return found.select(F.col("sample_id").alias("subject_id"), F.col("block_id").alias("event_idx"), "seq")


@query(
    "embedding_plan", "E5",
    """SELECT p_partkey AS key, p_name AS text, CASE WHEN p_type = 'PROMO' THEN 'missing' ELSE 'changed' END AS state FROM part
    WHERE p_type = 'PROMO' OR p_size % 7 = 0""",
)
def embedding_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = b.table(spark, sf_dir, "part")
    wanted = part.select(F.col("p_partkey").alias("key"), F.col("p_name").alias("text"))
    cached = part.where("p_type <> 'PROMO'").select(
        F.col("p_partkey").alias("key"), F.when(F.col("p_size") % 7 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("text")
    )
    return ft.embedding_plan(wanted, cached)


@query(
    "candidate_labels", "L22",
    """WITH s AS (SELECT DISTINCT l_orderkey AS sample_id, CAST(l_partkey AS VARCHAR) AS target FROM lineitem),
    v AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS idx, CAST(p_partkey AS VARCHAR) AS target, count(*) OVER () AS n FROM part),
    k AS (SELECT sample_id, count(*) AS own FROM s GROUP BY 1),
    r AS (SELECT sample_id, own, unnest(range(1, 2 * own + 16)) AS draw FROM k),
    d AS (SELECT sample_id, draw, ('0x' || substr(md5(sample_id || '|' || CASE WHEN draw <= own + 12 THEN draw ELSE 0 END || '|42'), 1, 15))::BIGINT
      + CASE WHEN draw <= own + 12 THEN 0 ELSE draw END AS h FROM r),
    p AS (SELECT sample_id, v.target, min(draw) AS draw FROM d JOIN v ON v.idx = h % v.n GROUP BY ALL),
    c AS (SELECT p.* FROM p LEFT JOIN s ON s.sample_id = p.sample_id AND s.target = p.target WHERE s.target IS NULL
      QUALIFY row_number() OVER (PARTITION BY p.sample_id ORDER BY draw) <= 3)
    SELECT sample_id, target, 1 AS label FROM s UNION ALL SELECT sample_id, target, 0 FROM c""",
)
def candidate_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = b.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sample_id"), F.col("l_partkey").cast("string").alias("target"))
    parts = b.table(spark, sf_dir, "part").select("p_partkey").withColumn("_all", F.lit(1))
    numbered = position(parts, ["_all"], ["p_partkey"], "idx", F.floor(F.col("p_partkey") / 65_536))
    return ft.candidate_labels(samples, numbered.select("idx", F.col("p_partkey").cast("string").alias("target")), 3)


@query(
    "multi_hot_labels", "L22 F28",
    """SELECT l_orderkey, string_agg(CASE WHEN hit THEN '1' ELSE '0' END, '' ORDER BY i) AS labels FROM (
      SELECT l_orderkey, i, bool_or(l_linenumber = i) AS hit FROM lineitem, range(8) r(i) GROUP BY ALL) GROUP BY 1""",
)
def multi_hot_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = b.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("classes"))
    return sets.select("l_orderkey", F.array_join(ft.multi_hot(F.col("classes"), 8).cast("array<string>"), "").alias("labels"))


def omop_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OMOP-style rows with codes, values and units; the person row is the earliest of each patient's."""
    rows = omop_rows(spark, sf_dir)
    key = F.col("encounter")
    code = (
        F.when(F.col("omop_table") == "person", F.element_at(F.array(F.lit("Gender/F"), F.lit("Race/2"), F.lit("SNOMED/3950001")), (key % 3 + 1).cast("int")))
        .otherwise(F.concat(F.lit("LOINC/"), (key % 9).cast("string")))
    )
    return rows.select(
        "subject_id", "row_idx", "omop_table", code.alias("code"), "start", F.concat(F.lit("desc "), (key % 3).cast("string")).alias("description"),
        F.when(key % 4 != 0, (key % 50).cast("string")).alias("value"), F.when(key % 2 == 0, "mg").alias("unit"), "encounter",
    )


OMOP_ROWS_SQL = OMOP_SQL + """,
oe AS (SELECT *, CASE WHEN omop_table = 'person' THEN ['Gender/F', 'Race/2', 'SNOMED/3950001'][encounter % 3 + 1] ELSE 'LOINC/' || (encounter % 9) END AS code,
    CASE WHEN encounter % 4 <> 0 THEN CAST(encounter % 50 AS VARCHAR) END AS value, CASE WHEN encounter % 2 = 0 THEN 'mg' END AS unit FROM omop),
dic AS (SELECT 'LOINC/' || i AS code, CASE WHEN i = 4 THEN 'Heart rate' ELSE 'Lab ' || i END AS d FROM range(8) r(i)
  UNION ALL SELECT * FROM (VALUES ('Gender/F', 'F'), ('Race/2', 'R'), ('SNOMED/3950001', 'B'))),
os AS (SELECT subject_id || '' AS sample_id, subject_id, max(row_idx) // 3 AS b, max(row_idx) - 1 AS e, TIMESTAMP '1996-01-01' AS vs,
    CASE WHEN subject_id % 2 = 0 THEN TIMESTAMP '2000-01-01' END AS ve FROM omop GROUP BY subject_id)"""


@query(
    "omop_measurements", "M3 J10",
    f"""WITH {OMOP_ROWS_SQL}, c AS (
      SELECT sample_id, oe.* FROM os JOIN oe USING (subject_id) WHERE row_idx BETWEEN b AND e AND (ve IS NULL OR start BETWEEN vs AND ve)
      UNION ALL SELECT sample_id, oe.* FROM os JOIN oe USING (subject_id) WHERE omop_table = 'person')
    SELECT sample_id, row_idx, strftime(start, '%Y-%m-%d %H:%M:%S') AS "Time",
      CASE code WHEN 'Gender/F' THEN 'Gender' WHEN 'Race/2' THEN 'Race' WHEN 'SNOMED/3950001' THEN 'Birth' ELSE d END AS "Item",
      CASE code WHEN 'Gender/F' THEN 'Female' WHEN 'Race/2' THEN 'desc 1' WHEN 'SNOMED/3950001' THEN '' ELSE coalesce(value, '') END AS "Value",
      coalesce(unit, '') AS "Unit", omop_table AS "Category" FROM c JOIN dic USING (code) WHERE omop_table <> 'note'""",
)
def omop_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(omop_events(spark, sf_dir))
    ends = rows.groupBy("subject_id").agg(F.max("row_idx").alias("m"))
    samples = ends.select(
        F.col("subject_id").cast("string").alias("sample_id"), "subject_id", F.floor(F.col("m") / 3).alias("period_begin"), (F.col("m") - 1).alias("period_end"),
        F.lit("1996-01-01").cast("timestamp_ntz").alias("visit_start"),
        F.when(F.col("subject_id") % 2 == 0, F.lit("2000-01-01").cast("timestamp_ntz")).alias("visit_end"),
    )
    dictionary = spark.createDataFrame(
        [(f"LOINC/{i}", f"Lab {i}") for i in range(8)] + [("Gender/F", "F"), ("Race/2", "R"), ("SNOMED/3950001", "B")], "code string, description string"
    )
    overrides = spark.createDataFrame([("LOINC/4", "Heart rate")], "code string, description string")
    table = mt.omop_table(samples, rows, dictionary, overrides)
    return table.withColumn("Time", times.time_text(F.col("Time")))


@query(
    "icu_measurements", "M4 F10",
    """WITH s AS (SELECT o_orderkey AS k, o_custkey, (6 + o_orderkey % 30) * 60 AS lim FROM orders),
    c AS (SELECT k, 0 AS off, 'Age' AS i, CASE WHEN k % 103 = 0 THEN 'unknown' WHEN k % 103 = 1 THEN 'old' WHEN k % 103 > 89 THEN '>89' ELSE CAST(k % 103 AS VARCHAR) END AS v, 'years' AS u, 'person' AS c FROM s
      UNION ALL SELECT k, 0, 'Gender', CASE WHEN k % 2 = 0 THEN 'Male' ELSE 'Female' END, '', 'person' FROM s
      UNION ALL SELECT k, 0, 'Ethnicity', 'E' || k % 4, '', 'person' FROM s WHERE k % 4 <> 0
      UNION ALL SELECT k, l_linenumber * 300, CASE p_type WHEN 'ECONOMY' THEN 'Creatinine' WHEN 'SMALL' THEN 'T Bili' WHEN 'MEDIUM' THEN 'PLT' WHEN 'PROMO' THEN 'WBC x 1000' WHEN 'STANDARD' THEN 'creat' ELSE 'K' END,
        CASE WHEN l_quantity = 13 THEN 'pending' ELSE CAST(l_quantity / 4 AS VARCHAR) END, 'mg/dL', 'measurement' FROM s JOIN lineitem ON l_orderkey = k JOIN part ON p_partkey = l_partkey WHERE l_linenumber * 300 <= lim
      UNION ALL SELECT k, l_linenumber * 400 - 800, 'Drug ' || l_returnflag, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), '', 'drug_exposure' FROM s JOIN lineitem ON l_orderkey = k WHERE l_linenumber * 400 - 800 BETWEEN 0 AND lim
      UNION ALL SELECT k, l_linenumber * 500, 'Infusion ' || l_linestatus, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), 'mL/hr', 'drug_exposure' FROM s JOIN lineitem ON l_orderkey = k WHERE l_linenumber * 500 <= lim)
    SELECT CAST(k AS VARCHAR) AS sample_id, strftime(TIMESTAMP '2000-01-01' + to_minutes(CAST(off AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS "Time", i AS "Item", v AS "Value", u AS "Unit", c AS "Category" FROM c""",
)
def icu_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    who = patients(spark, sf_dir).select(
        F.col("patientunitstayid").alias("stay"), "age", "gender",
        F.when(F.col("patientunitstayid") % 4 != 0, F.concat(F.lit("E"), (F.col("patientunitstayid") % 4).cast("string"))).alias("ethnicity"),
    )
    samples = who.select(F.col("stay").cast("string").alias("sample_id"), "stay", (F.lit(6) + F.col("stay") % 30).alias("obs_hours"))
    lab_rows = labs(spark, sf_dir).withColumnRenamed("patientunitstayid", "stay").withColumn("unit", F.lit("mg/dL"))
    lines = b.table(spark, sf_dir, "lineitem")
    amount = F.col("l_quantity").cast("int").cast("string")
    drugs = lines.select(F.col("l_orderkey").alias("stay"), (F.col("l_linenumber") * 400 - 800).alias("drugstartoffset"),
                         F.concat(F.lit("Drug "), "l_returnflag").alias("drugname"), amount.alias("dosage"))
    infusions = lines.select(F.col("l_orderkey").alias("stay"), (F.col("l_linenumber") * 500).alias("infusionoffset"),
                             F.concat(F.lit("Infusion "), "l_linestatus").alias("drugname"), amount.alias("infusionrate"))
    return mt.icu_table(samples, who, lab_rows, drugs, infusions)


@query(
    "nested_measurements", "M5 S14 F19",
    """WITH p AS (SELECT DISTINCT p_partkey AS id, p_name AS n FROM part WHERE p_type <> 'ECONOMY'),
    l AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS id, l_linenumber FROM lineitem),
    m AS (SELECT o, id, max(l_linenumber) AS k FROM l GROUP BY ALL)
    SELECT CAST(o AS VARCHAR) AS sample_id, '2000-01-01 00:00:00' AS "Time", coalesce(n, CAST(m.id AS VARCHAR)) AS "Item",
      CASE WHEN m.id % 2 = 0 THEN CAST(k AS VARCHAR) ELSE 'positive after ' || k END AS "Value", CASE WHEN m.id % 2 = 0 AND k < 6 THEN 'mg per dL' ELSE '' END AS "Unit",
      'measurement' AS "Category" FROM m LEFT JOIN p ON p.id = m.id""",
)
def nested_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested result maps per order, read back from their JSON text."""
    number = F.col("k").cast("string")
    cells = b.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.max("l_linenumber").alias("k")).select(
        F.col("l_orderkey").cast("string").alias("sample_id"), F.col("l_partkey").cast("string").alias("id"), (F.col("l_partkey") % 2 == 0).alias("lab"),
        F.when(F.col("l_partkey") % 2 != 0, F.concat(F.lit("positive after "), number)).when(F.col("k") < 6, F.concat(number, F.lit("  mg per dL"))).otherwise(number).alias("v"),
    )
    as_map = lambda of: F.to_json(F.map_from_entries(F.collect_list(F.when(of, F.struct("id", "v")))))
    nested = cells.groupBy("sample_id").agg(as_map(F.col("lab")).alias("lab_json"), as_map(~F.col("lab")).alias("culture_json"))
    rows = nested.select(
        "sample_id", F.from_json("lab_json", "map<string,string>").alias("labs"), F.from_json("culture_json", "map<string,string>").alias("cultures")
    )
    names = b.table(spark, sf_dir, "part").where("p_type <> 'ECONOMY'").select(F.col("p_partkey").cast("string").alias("item_id"), F.col("p_name").alias("name"))
    return mt.nested_table(rows, names, names).withColumn("Time", times.time_text(F.col("Time")))


STATIC = {"o_weight": "Recipient Weight (kg)", "o_blood": "Recipient Blood Type"}
DRUGS = {"dose_a": ("Tacrolimus", "mg"), "dose_b": ("Cyclosporine", "mg")}


@query(
    "followup_measurements", "M7 F20 F21",
    f"""WITH {FOLLOWUP_SQL}, {SURGERY_SQL},
    pr AS (SELECT CAST(subject AS VARCHAR) AS sample_id, surgery_time AS t, i, v, u, 'person' AS c FROM (
      SELECT subject, surgery_time, 'Recipient Weight' AS i, CAST(subject % 30 AS VARCHAR) AS v, 'kg' AS u FROM su UNION ALL
      SELECT subject, surgery_time, 'Recipient Blood Type', 'AB', '' FROM su WHERE subject % 4 = 0)),
    dr AS (SELECT CAST(subject AS VARCHAR) AS sample_id, report_time AS t, 'Tacrolimus' AS i, CASE WHEN visit % 6 = 0 THEN '0.5mg/0' ELSE '0' END AS v, 'mg' AS u, 'drug_exposure' AS c FROM fu
        WHERE visit % 6 IN (0, 1) AND day <= 365 UNION ALL
      SELECT CAST(subject AS VARCHAR), report_time, 'Cyclosporine', '2 mg', 'mg', 'drug_exposure' FROM fu WHERE visit % 10 = 0 AND day <= 365),
    la AS (SELECT CAST(subject AS VARCHAR) AS sample_id, report_time + to_hours(CAST(24 / n * i AS BIGINT)) AS t, 'Level' AS i, x AS v, 'ng/mL' AS u, 'measurement' AS c
      FROM (SELECT subject, report_time, 1 AS n, 0 AS i, '5.5' AS x FROM fu WHERE visit % 8 = 0 AND day <= 365 UNION ALL
        SELECT subject, report_time, 2, i, CASE i WHEN 0 THEN '100' ELSE '200' END FROM fu, range(2) r(i) WHERE visit % 8 = 2 AND day <= 365))
    SELECT sample_id, strftime(t, '%Y-%m-%d %H:%M:%S') AS "Time", i AS "Item", v AS "Value", u AS "Unit", c AS "Category" FROM (
      SELECT * FROM pr UNION ALL SELECT * FROM dr UNION ALL SELECT * FROM la)""",
)
def followup_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    visits = followups(spark, sf_dir)
    rows = visits.select(F.col("subject").cast("string").alias("sample_id"), "day", F.col("report_time").alias("Time"), F.lit(365).alias("cutoff_day"),
                         "dose_a", "dose_b", "visit")
    static = lf.surgery_dates(visits).select(
        F.col("subject").cast("string").alias("sample_id"), "surgery_time", (F.col("subject") % 30).alias("o_weight"),
        F.when(F.col("subject") % 4 == 0, " AB ").alias("o_blood"),
    )
    level = F.when(F.col("visit") % 8 == 0, "5.5").when(F.col("visit") % 8 == 2, "100-200")
    results = rows.where(F.col("day") <= F.col("cutoff_day")).withColumn("Value", level).where(F.col("Value").isNotNull()).select(
        "sample_id", "Time", F.lit("Level").alias("Item"), "Value", F.lit("ng/mL").alias("Unit")
    )
    table = mt.followup_table(rows, static, STATIC, DRUGS, mt.spread_results(results))
    return table.withColumn("Time", times.time_text(F.col("Time")))


@query(
    "text_columns_for_cache", "M9 F23",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(CASE WHEN l_linenumber <> 2 THEN l_returnflag END, '') AS "Item",
      md5('{"p0":"' || l_orderkey || '","p1":' || l_linenumber || '}') AS cache_key FROM lineitem""",
)
def text_columns_for_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_linenumber") != 2, F.col("l_returnflag")).alias("Item"),
        F.col("l_orderkey").cast("string").alias("order_text"),
    )
    keyed = mt.cache_keys(mt.text_columns(rows, ["Item"]), ["order_text", "l_linenumber"])
    return keyed.drop("order_text")


@query(
    "non_empty_samples", "M8 J8",
    f"""WITH {CONTEXT_SQL} SELECT DISTINCT sample_id FROM cb""",
)
def non_empty_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = cut(block_table(spark, sf_dir))
    samples = context_samples(spark, sf_dir, blocks)
    return mt.non_empty_samples(samples, mt.context_blocks(samples, blocks)).select("sample_id")
