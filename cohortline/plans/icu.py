"""Intensive-care cohort, labels, samples and durations over the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortline.functions import text
from cohortline.operators import labels_icu as li, splits
from cohortline.plans import bindings as b
from cohortline.plans.registry import query
from cohortline.session import cut


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as unit stays with minute offsets."""
    key, who = F.col("o_orderkey"), F.col("o_custkey")
    age = key % 103
    place = F.element_at(
        F.array(*[F.lit(x) for x in (
            "Home", "Death", "Nursing Home", "Other Hospital", "Rehabilitation", "Skilled Nursing Facility", "Moon")]),
        (key % 7 + 1).cast("int"),
    )
    out = key % 400 * 60
    return b.table(spark, sf_dir, "orders").select(
        key.alias("patientunitstayid"), (who * 10 + key % 3).alias("patienthealthsystemstayid"), who.alias("uniquepid"),
        F.when(age == 0, F.lit(None)).when(age == 1, "old").when(age > 89, "> 89").otherwise(age.cast("string")).alias("age"),
        F.when(key % 2 == 0, "Male").otherwise("Female").alias("gender"),
        (key % 5 + 1).cast("int").alias("unitvisitnumber"), out.cast("int").alias("unitdischargeoffset"),
        (out + key % 50 * 60).cast("int").alias("hospitaldischargeoffset"),
        F.when((F.col("o_orderstatus") == "F") & (key % 4 == 0), "Expired").otherwise("Alive").alias("unitdischargestatus"),
        F.when(key % 11 != 0, place).alias("hospitaldischargelocation"),
    )


PATIENTS_SQL = """
pat AS (
  SELECT o_orderkey AS stay, o_custkey * 10 + o_orderkey % 3 AS hosp, o_custkey AS pid,
    CASE WHEN o_orderkey % 103 <= 1 THEN NULL WHEN o_orderkey % 103 > 89 THEN 300 ELSE o_orderkey % 103 END AS age,
    CASE WHEN o_orderkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS gender,
    CAST(o_orderkey % 5 + 1 AS INTEGER) AS visit, CAST(o_orderkey % 400 * 60 AS INTEGER) AS out_minutes,
    CAST(o_orderkey % 400 * 60 + o_orderkey % 50 * 60 AS INTEGER) AS dis,
    o_orderstatus = 'F' AND o_orderkey % 4 = 0 AS died,
    CASE WHEN o_orderkey % 11 = 0 THEN 'Other' ELSE CASE o_orderkey % 7 WHEN 0 THEN 'Home' WHEN 1 THEN 'Death'
      WHEN 4 THEN 'Rehabilitation' WHEN 5 THEN 'Skilled Nursing Facility' ELSE 'Other' END END AS place
  FROM orders),
elig AS (SELECT *, out_minutes / 1440.0 AS los FROM pat WHERE age BETWEEN 18 AND 89 AND out_minutes >= 1440),
rk AS (SELECT *, row_number() OVER (PARTITION BY hosp ORDER BY visit, stay) AS rf,
    row_number() OVER (PARTITION BY hosp ORDER BY visit DESC, stay) AS rl FROM elig),
cohort AS (SELECT *, CASE WHEN rl = 1 THEN 0 ELSE 1 END AS readmission FROM rk WHERE rf = 1)"""


def stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return li.cohort(patients(spark, sf_dir))


@query(
    "icu_cohort", "L9 W22 F8 F13",
    f"""WITH {PATIENTS_SQL} SELECT stay AS patientunitstayid, hosp AS patienthealthsystemstayid, pid AS uniquepid,
      CAST(age AS DOUBLE) AS age_years, round(los, 6) AS los, out_minutes, dis AS discharge_minutes, died AS died_in_unit,
      place AS discharge_class, readmission FROM cohort""",
)
def icu_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stays(spark, sf_dir).select(
        "patientunitstayid", "patienthealthsystemstayid", "uniquepid", "age_years", F.round("los", 6).alias("los"),
        "out_minutes", "discharge_minutes", "died_in_unit", "discharge_class", "readmission",
    )


@query(
    "icu_cohort_summary", "A26",
    f"""WITH {PATIENTS_SQL}, s AS (SELECT * FROM cohort)
    SELECT 'stays' AS name, '' AS level, CAST(count(*) AS DOUBLE) AS value FROM s
    UNION ALL SELECT 'age_mean', '', round(avg(age), 6) FROM s UNION ALL SELECT 'age_median', '', round(quantile_cont(age, 0.5), 6) FROM s
    UNION ALL SELECT 'age_min', '', min(age) FROM s UNION ALL SELECT 'age_max', '', max(age) FROM s
    UNION ALL SELECT 'los_mean', '', round(avg(los), 6) FROM s UNION ALL SELECT 'los_median', '', round(quantile_cont(los, 0.5), 6) FROM s
    UNION ALL SELECT 'gender', gender, count(*) FROM s GROUP BY gender
    UNION ALL SELECT 'died_in_unit', CAST(died AS VARCHAR), count(*) FROM s GROUP BY died
    UNION ALL SELECT 'discharge_class', place, count(*) FROM s GROUP BY place""",
)
def icu_cohort_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return li.cohort_summary(stays(spark, sf_dir)).withColumn("value", F.round("value", 6))


LABELS_SQL = PATIENTS_SQL + """,
lab0 AS (SELECT *, died OR place = 'Death' AS dead, NOT died AND place = 'Death' AS inh,
    CASE WHEN died THEN 'IN_ICU_MORTALITY' WHEN place = 'Death' THEN 'IN_HOSPITAL_MORTALITY' ELSE place END AS acuity,
    CASE WHEN dis BETWEEN 1440 AND 72 * 60 THEN CASE WHEN died OR place = 'Death' THEN 'Death' ELSE place END
      ELSE 'No Discharge' END AS imminent FROM cohort),
labels_icu AS (SELECT *, CAST(dead AND dis > 1440 AND dis <= 72 * 60 AS INTEGER) AS mortality,
    CAST(dead AND dis > 1440 AND dis <= 360 * 60 AS INTEGER) AS long_term_mortality,
    CAST(los > 3 AS INTEGER) AS los_3day, CAST(los > 7 AS INTEGER) AS los_7day,
    CAST(dense_rank() OVER (ORDER BY acuity) - 1 AS INTEGER) AS final_acuity,
    CAST(dense_rank() OVER (ORDER BY imminent) - 1 AS INTEGER) AS imminent_discharge FROM lab0)"""


@query(
    "icu_stay_labels", "L10 F28",
    f"""WITH {LABELS_SQL} SELECT stay AS patientunitstayid, mortality, long_term_mortality, los_3day, los_7day,
      acuity AS acuity_class, final_acuity, imminent AS imminent_class, imminent_discharge FROM labels_icu""",
)
def icu_stay_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return li.stay_labels(stays(spark, sf_dir)).select(
        "patientunitstayid", "mortality", "long_term_mortality", "los_3day", "los_7day", "acuity_class", "final_acuity",
        "imminent_class", "imminent_discharge",
    )


LAB_LABELS = {"ECONOMY": "Creatinine", "SMALL": "T Bili", "MEDIUM": "PLT", "PROMO": "WBC x 1000", "STANDARD": "creat", "LARGE": "K"}


def labs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = b.table(spark, sf_dir, "part").select("p_partkey", "p_type")
    lines = b.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("patientunitstayid"), text.mapped(F.col("p_type"), LAB_LABELS).alias("labname"),
        (F.col("l_linenumber") * 300).alias("labresultoffset"),
        F.when(F.col("l_quantity") == 13, "pending").otherwise((F.col("l_quantity") / 4).cast("string")).alias("labresult"),
    )


def intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("patientunitstayid"), (F.col("l_linenumber") * 500).alias("intakeoutputoffset"),
        F.when(F.col("l_quantity") <= 44, 0.0).when(F.col("l_quantity") <= 47, F.col("l_quantity")).alias("dialysistotal"),
    )


LABS_SQL = PATIENTS_SQL + """,
labr AS (SELECT l_orderkey AS stay, CASE p_type WHEN 'ECONOMY' THEN 'creatinine' WHEN 'STANDARD' THEN 'creatinine'
    WHEN 'SMALL' THEN 'bilirubin' WHEN 'MEDIUM' THEN 'platelets' WHEN 'PROMO' THEN 'wbc' END AS task,
    l_linenumber * 300 AS off, l_quantity / 4 AS v, l_quantity
  FROM lineitem JOIN part ON l_partkey = p_partkey),
mean AS (SELECT stay, task, avg(v) AS v FROM labr JOIN cohort USING (stay)
  WHERE l_quantity <> 13 AND off BETWEEN 1440 AND 36 * 60 AND task IS NOT NULL GROUP BY ALL),
dia AS (SELECT DISTINCT pid FROM cohort WHERE stay IN (SELECT l_orderkey FROM lineitem
    WHERE l_quantity > 44 AND l_linenumber * 500 <= 36 * 60)
  AND pid IN (SELECT pid FROM cohort GROUP BY pid HAVING count(DISTINCT hosp) > 1)),
sev AS (SELECT stay, task, CASE task
    WHEN 'creatinine' THEN CASE WHEN v < 1.2 THEN 0 WHEN v < 2 THEN 1 WHEN v < 3.5 THEN 2 WHEN v < 5 THEN 3 ELSE 4 END
    WHEN 'bilirubin' THEN CASE WHEN v < 1.2 THEN 0 WHEN v < 2 THEN 1 WHEN v < 6 THEN 2 WHEN v < 12 THEN 3 ELSE 4 END
    WHEN 'platelets' THEN CASE WHEN v >= 150 THEN 0 WHEN v >= 100 THEN 1 WHEN v >= 50 THEN 2 WHEN v >= 20 THEN 3 ELSE 4 END
    ELSE CASE WHEN v < 4 THEN 0 WHEN v <= 12 THEN 1 ELSE 2 END END AS level
  FROM mean JOIN cohort USING (stay) WHERE task <> 'creatinine' OR pid NOT IN (SELECT pid FROM dia))"""


def severity_table(spark: SparkSession, sf_dir: str, cohort_stays: DataFrame) -> DataFrame:
    return li.severity_labels(labs(spark, sf_dir), intake(spark, sf_dir), cohort_stays)


@query(
    "icu_lab_severity", "L11 A14 A22 F16 J7 J9",
    f"""WITH {LABS_SQL} SELECT stay AS patientunitstayid, max(level) FILTER (task = 'creatinine') AS creatinine,
      max(level) FILTER (task = 'bilirubin') AS bilirubin, max(level) FILTER (task = 'platelets') AS platelets,
      max(level) FILTER (task = 'wbc') AS wbc FROM cohort LEFT JOIN sev USING (stay) GROUP BY stay""",
)
def icu_lab_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return severity_table(spark, sf_dir, stays(spark, sf_dir))


@query(
    "icu_dialysis_patients", "A22 J9", f"WITH {LABS_SQL} SELECT pid AS uniquepid FROM dia",
)
def icu_dialysis_patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return li.dialysis_patients(intake(spark, sf_dir), stays(spark, sf_dir))


def part_codes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Codes of all parts, and a map from those of two types, cut to differing lengths."""
    part = b.table(spark, sf_dir, "part")
    code = F.concat(F.col("p_size").cast("string"), F.lit("Z"), F.col("p_partkey").cast("string"))
    codes = part.select(code.alias("code"))
    cut_length = F.lit(2) + F.col("p_partkey") % 4
    mapping = part.where(F.col("p_type").isin("PROMO", "SMALL")).select(
        F.substring(code, F.lit(1), cut_length.cast("int")).alias("code"), F.col("p_type").alias("target")
    ).groupBy("code").agg(F.max("target").alias("target"))
    return codes, mapping


@query(
    "longest_prefix_codes", "J11",
    """WITH c AS (SELECT DISTINCT p_size || 'Z' || p_partkey AS code FROM part),
    m AS (SELECT substr(p_size || 'Z' || p_partkey, 1, 2 + p_partkey % 4) AS code, max(p_type) AS target FROM part
      WHERE p_type IN ('PROMO', 'SMALL') GROUP BY 1),
    p AS (SELECT code, i, substr(code, 1, i) AS pre FROM c, range(1, 20) r(i) WHERE i <= length(code)),
    hit AS (SELECT p.code, p.i, m.target, m.code = p.pre AS exact FROM p JOIN m ON starts_with(m.code, p.pre)),
    best AS (SELECT code, max(i) AS i FROM hit GROUP BY code),
    votes AS (SELECT h.code, h.target, max(CASE WHEN exact THEN 1 ELSE 0 END) AS ex, count(*) AS n
      FROM hit h JOIN best b ON h.code = b.code AND h.i = b.i GROUP BY ALL)
    SELECT code, target FROM votes QUALIFY row_number() OVER (PARTITION BY code ORDER BY ex DESC, n DESC, target) = 1""",
)
def longest_prefix_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return li.longest_prefix_map(*part_codes(spark, sf_dir))


def diagnosis_strings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Paths region|nation|segment|n per customer, and the categories of some of them."""
    region = F.broadcast(b.table(spark, sf_dir, "region"))
    nation = b.table(spark, sf_dir, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    rows = b.table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    path = F.concat_ws("|", "r_name", "n_name", "c_mktsegment", (F.col("c_custkey") % 4).cast("string"))
    strings = rows.select(F.col("c_custkey").alias("uniquepid"), path.alias("diagnosisstring"), "c_acctbal")
    known = strings.where(F.col("c_acctbal") < 1000).groupBy("diagnosisstring").agg(
        (F.min("uniquepid") % 18).cast("int").alias("category")
    )
    return strings.drop("c_acctbal"), known


ROLL_SQL = """
ds AS (SELECT c_custkey AS pid, c_acctbal AS bal, r_name AS p1, r_name || '|' || n_name AS p2, r_name || '|' || n_name || '|' || c_mktsegment AS p3,
    r_name || '|' || n_name || '|' || c_mktsegment || '|' || (c_custkey % 4) AS p4
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
kn AS (SELECT p4, any_value(p3) AS p3, any_value(p2) AS p2, CAST(min(pid) % 18 AS INTEGER) AS category FROM ds WHERE bal < 1000 GROUP BY p4),
v3 AS (SELECT p3, category, count(*) AS n, any_value(p2) AS p2 FROM kn GROUP BY p3, category
  QUALIFY row_number() OVER (PARTITION BY p3 ORDER BY n DESC, category) = 1),
v2 AS (SELECT p2, category, count(*) AS n2 FROM v3 GROUP BY p2, category
  QUALIFY row_number() OVER (PARTITION BY p2 ORDER BY n2 DESC, category) = 1),
cats AS (SELECT DISTINCT ds.p4 AS diagnosisstring, coalesce(kn.category, v3.category, v2.category) AS category
  FROM ds LEFT JOIN kn USING (p4) LEFT JOIN v3 ON v3.p3 = ds.p3 LEFT JOIN v2 ON v2.p2 = ds.p2
  WHERE coalesce(kn.category, v3.category, v2.category) IS NOT NULL)"""


@query("diagnosis_hierarchy", "J13", f"WITH {ROLL_SQL} SELECT * FROM cats")
def diagnosis_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    strings, known = diagnosis_strings(spark, sf_dir)
    return li.roll_up_categories(known, strings, depth=4)


@query(
    "diagnosis_code_categories", "J11 L11",
    """WITH s AS (SELECT p_name AS diagnosisstring, min(p_size || '.' || p_partkey % 9 || ',' || 'Q' || p_size % 10) AS codes
        FROM part WHERE p_partkey % 5 <> 0 GROUP BY p_name),
    l AS (SELECT diagnosisstring, replace(split_part(codes, ',', i), '.', '') AS code, i FROM s, range(1, 3) r(i)),
    cc AS (SELECT DISTINCT p_size || '' || p_partkey % 9 AS code, CAST(p_size % 18 AS INTEGER) AS category FROM part WHERE p_size <= 25),
    g AS (SELECT * FROM (VALUES ('Q1', '20'), ('Q2', '40'), ('Q3', '999')) v(code, target)),
    m AS (SELECT l.*, coalesce(d.category, t.category) AS category FROM l LEFT JOIN cc d USING (code)
      LEFT JOIN g ON g.code = l.code LEFT JOIN cc t ON t.code = coalesce(g.target, CASE WHEN l.code LIKE 'Q%' THEN '20' END))
    SELECT diagnosisstring, arg_max(category, i) AS category FROM m WHERE category IS NOT NULL GROUP BY 1""",
)
def diagnosis_code_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings (part names) to categories through their code lists, directly or over a code map."""
    part = b.table(spark, sf_dir, "part")
    code = F.concat(F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 9).cast("string"), F.lit(",Q"), (F.col("p_size") % 10).cast("string"))
    strings = part.select(F.col("p_name").alias("diagnosisstring"), F.when(F.col("p_partkey") % 5 != 0, code).alias("icd9code"))
    category = part.where(F.col("p_size") <= 25).select(
        F.concat(F.col("p_size").cast("string"), (F.col("p_partkey") % 9).cast("string")).alias("code"),
        (F.col("p_size") % 18).cast("int").alias("category"),
    ).distinct()
    newer = spark.createDataFrame([("Q1", "20"), ("Q2", "40"), ("Q3", "999")], "code string, target string")
    # sizes over 25 are in no table; Q0 and Q4..Q9 share their first letter with all three keys: the smallest target wins the tie
    return li.diagnosis_categories(strings, category, newer)


@query(
    "diagnosis_sets", "A15 L11",
    f"""WITH {PATIENTS_SQL}, {ROLL_SQL},
    x AS (SELECT DISTINCT hosp, CASE WHEN category > 14 THEN category - 1 ELSE category END AS c
      FROM cohort JOIN ds USING (pid) JOIN cats ON cats.diagnosisstring = ds.p4 WHERE category <> 14)
    SELECT stay AS patientunitstayid, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c), '') AS diagnosis
    FROM cohort LEFT JOIN x USING (hosp) GROUP BY stay""",
)
def diagnosis_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    strings, known = diagnosis_strings(spark, sf_dir)
    cohort_stays = stays(spark, sf_dir)
    rows = strings.join(cohort_stays.select("patientunitstayid", "uniquepid"), "uniquepid")
    sets = li.diagnosis_sets(
        rows.select("patientunitstayid", "diagnosisstring"), li.roll_up_categories(known, strings, 4), cohort_stays
    )
    return sets.select("patientunitstayid", F.array_join(F.col("diagnosis").cast("array<string>"), ",").alias("diagnosis"))


TASKS = ("mortality", "long_term_mortality", "readmission", "los_3day", "los_7day", "final_acuity", "imminent_discharge",
         "creatinine", "bilirubin", "platelets", "wbc", "not_enabled_here")

SPLIT_SQL = """
sp AS (SELECT pid, row_number() OVER (ORDER BY md5(CAST(pid AS VARCHAR) || '|42'), pid) - 1 AS r, count(*) OVER () AS n
  FROM (SELECT DISTINCT pid FROM cohort)),
spl AS (SELECT pid, CASE WHEN r < floor(n * 700 / 1000) THEN 'train' WHEN r < floor(n * 700 / 1000) + floor(n * 150 / 1000)
  THEN 'val' ELSE 'test' END AS split FROM sp)"""


def labelled_stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    cohort_stays = cut(stays(spark, sf_dir))
    split = splits.ratio_split(cohort_stays, "uniquepid", 700, 150)
    return li.stay_labels(cohort_stays).join(severity_table(spark, sf_dir, cohort_stays), "patientunitstayid").join(
        split, "uniquepid"
    )


@query(
    "patient_ratio_split", "P1", f"WITH {PATIENTS_SQL}, {SPLIT_SQL} SELECT pid AS uniquepid, split FROM spl",
)
def patient_ratio_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.ratio_split(stays(spark, sf_dir), "uniquepid", 700, 150)


SAMPLES_SQL = LABELS_SQL + "," + LABS_SQL.split(PATIENTS_SQL + ",")[1] + "," + SPLIT_SQL + """,
wide AS (SELECT l.*, split, (SELECT max(level) FROM sev s WHERE s.stay = l.stay AND task = 'creatinine') AS creatinine,
    (SELECT max(level) FROM sev s WHERE s.stay = l.stay AND task = 'bilirubin') AS bilirubin,
    (SELECT max(level) FROM sev s WHERE s.stay = l.stay AND task = 'platelets') AS platelets,
    (SELECT max(level) FROM sev s WHERE s.stay = l.stay AND task = 'wbc') AS wbc FROM labels_icu l JOIN spl USING (pid)),
smp AS (SELECT stay AS icustay_id, CAST(pid AS VARCHAR) AS patient_id, t.task_name, CAST(t.label AS VARCHAR) AS label, split,
    12 AS obs_hours, 12 AS gap_hours, t.pred_hours FROM wide, LATERAL (VALUES ('mortality', mortality, 48),
    ('long_term_mortality', long_term_mortality, 336), ('readmission', readmission, 24), ('los_3day', los_3day, 24),
    ('los_7day', los_7day, 24), ('final_acuity', final_acuity, 24), ('imminent_discharge', imminent_discharge, 48),
    ('creatinine', creatinine, 24), ('bilirubin', bilirubin, 24), ('platelets', platelets, 24), ('wbc', wbc, 24)
  ) t(task_name, label, pred_hours) WHERE t.label IS NOT NULL)"""


@query("icu_sample_rows", "L12 P1", f"WITH {SAMPLES_SQL} SELECT * FROM smp")
def icu_sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return li.sample_rows(labelled_stays(spark, sf_dir), TASKS)


@query(
    "icu_pretraining_rows", "L12",
    f"""WITH {PATIENTS_SQL}, {SPLIT_SQL} SELECT 'icu|' || pid || '|' || stay || '|0|' || out_minutes AS sample_id,
      CAST(pid AS VARCHAR) AS patient_id, stay AS icustay_id, 0 AS context_begin, out_minutes AS context_end,
      CAST(ceil(out_minutes / 60.0) AS INTEGER) AS obs_hours, split, 'pretraining_context' AS task
    FROM cohort JOIN spl USING (pid)""",
)
def icu_pretraining_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cohort_stays = stays(spark, sf_dir)
    return li.pretraining_rows(cohort_stays.join(splits.ratio_split(cohort_stays, "uniquepid", 700, 150), "uniquepid"))


@query(
    "icu_durations", "L18 L16 F10",
    f"""WITH {SAMPLES_SQL},
    q AS (SELECT stay AS icustay_id, CAST(pid AS VARCHAR) AS patient_id, split, t.* FROM wide, LATERAL (VALUES
        ('Time_to_Mortality', 'mortality+long_term_mortality', CASE WHEN dead THEN dis END, dis, dead, 14.0),
        ('Time_to_ICU_Discharge', 'los_3day+los_7day', out_minutes, out_minutes, TRUE, 6.0)) t(task_name, source_binary_task, e, c, o, h)),
    v AS (SELECT *, o AND e <= 1440 + h * 1440 AS hit, CASE WHEN o AND e <= 1440 + h * 1440 THEN e ELSE least(c, 1440 + h * 1440) END AS until
      FROM q WHERE e IS NULL OR e > 1440),
    t AS (SELECT *, TIMESTAMP '2000-01-01' AS z FROM v WHERE until > 1440)
    SELECT icustay_id, patient_id, split, task_name, source_binary_task, '2000-01-02 00:00:00' AS prediction_time,
      CASE WHEN hit THEN strftime(z + to_minutes(CAST(e AS BIGINT)), '%Y-%m-%d %H:%M:%S') ELSE '' END AS event_time,
      strftime(z + to_minutes(CAST(CASE WHEN hit THEN c ELSE until END AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS censor_time,
      round(CAST((until - 1440) / 1440.0 AS DOUBLE), 6) AS time_to_event, CAST(coalesce(hit, FALSE) AS INTEGER) AS event_observed,
      CAST(h AS DOUBLE) AS horizon_days, 'day' AS time_unit FROM t""",
)
def icu_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    cohort_stays = cut(stays(spark, sf_dir))
    split = splits.ratio_split(cohort_stays, "uniquepid", 700, 150)
    labelled = li.stay_labels(cohort_stays).join(split, "uniquepid")
    return li.duration_rows(li.sample_rows(labelled, TASKS), cohort_stays)
