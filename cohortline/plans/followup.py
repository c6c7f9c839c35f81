"""Follow-up labels and durations, dictionary joins and range joins over the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortline.functions import times, values
from cohortline.operators import joins, labels_followup as lf, splits
from cohortline.plans import bindings as b
from cohortline.plans.registry import query

DAY0 = "1996-01-01 00:00:00"


def followups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as follow-up visits: post-operative day, report time, three label columns, doses and levels as text."""
    key, who = F.col("o_orderkey"), F.col("o_custkey")
    operated = F.lit(DAY0).cast("timestamp_ntz") + F.make_dt_interval(days=(who % 300).cast("int"))
    day = F.floor(times.days_between(operated, F.col("o_orderdate"))).cast("double")
    return b.table(spark, sf_dir, "orders").select(
        who.alias("subject"), key.alias("visit"), F.when(key % 29 != 0, day).alias("day"),
        F.when(key % 31 != 0, F.col("o_orderdate")).alias("report_time"),
        F.when(key % 3 == 0, "1").when(key % 3 == 1, "0").otherwise("").alias("WBC_label"),
        F.when(key % 5 == 0, "2.0").when(key % 5 == 1, "0").when(key % 5 == 2, "pending").alias("ALB_label"),
        F.when(key % 4 == 0, "1").otherwise("0").alias("level_label"),
        F.when(key % 6 == 0, "0.5mg/0").when(key % 6 == 1, "0").alias("dose_a"),
        F.when(key % 10 == 0, "2 mg").alias("dose_b"),
        F.when(key % 8 == 0, "5.5").when(key % 8 == 1, " ").alias("level"),
    )


FOLLOWUP_SQL = f"""
fu AS (
  SELECT o_custkey AS subject, o_orderkey AS visit,
    CASE WHEN o_orderkey % 29 <> 0 THEN CAST(date_diff('day', TIMESTAMP '{DAY0}' + to_days(CAST(o_custkey % 300 AS INTEGER)), o_orderdate) AS DOUBLE) END AS day,
    CASE WHEN o_orderkey % 31 <> 0 THEN o_orderdate END AS report_time,
    CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS wbc,
    CASE o_orderkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS alb,
    o_orderkey % 4 = 0 AS lev, o_orderkey % 6 = 0 OR o_orderkey % 10 = 0 AS dosed, o_orderkey % 8 = 0 AS measured
  FROM orders),
fw AS (SELECT *, CASE WHEN day BETWEEN 0 AND 30 THEN '0-30d' WHEN day > 30 AND day <= 180 THEN '30-180d'
    WHEN day > 180 AND day <= 365 THEN '180-365d' WHEN day > 365 THEN '365d+' END AS win FROM fu),
wl AS (SELECT subject, win AS "window", metric, max(label) AS label FROM (
    SELECT subject, win, 'WBC' AS metric, wbc AS label FROM fw UNION ALL SELECT subject, win, 'ALB', alb FROM fw)
  WHERE win IS NOT NULL AND label IS NOT NULL GROUP BY ALL),
info AS (SELECT c_custkey AS subject, CASE c_custkey % 5 WHEN 0 THEN 'Yes' WHEN 1 THEN '死亡' WHEN 2 THEN 'no' WHEN 3 THEN '1' END AS is_deceased,
    c_custkey % 5 IN (0, 1, 3) AS dead,
    CASE WHEN c_custkey % 7 <> 0 THEN TIMESTAMP '{DAY0}' + to_days(CAST(c_custkey % 1500 AS INTEGER)) END AS death_time,
    CASE WHEN c_custkey % 9 <> 0 THEN TIMESTAMP '1994-06-01' + to_days(CAST(c_custkey % 1200 AS INTEGER)) END AS birth_time
  FROM customer)"""

LABELS = ("WBC_label", "ALB_label")


def patient_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    who = F.col("c_custkey")
    after = lambda start, days: F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(days=days.cast("int"))
    words = F.when(who % 5 == 0, "Yes").when(who % 5 == 1, "死亡").when(who % 5 == 2, "no").when(who % 5 == 3, "1")
    return b.table(spark, sf_dir, "customer").select(
        who.alias("subject"), words.alias("is_deceased"),
        F.when(who % 7 != 0, after(DAY0, who % 1500)).alias("death_time"),
        F.when(who % 9 != 0, after("1994-06-01 00:00:00", who % 1200)).alias("birth_time"),
    )


@query("window_labels", "A16 F17 S4", f"WITH {FOLLOWUP_SQL} SELECT * FROM wl")
def window_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = followups(spark, sf_dir)
    found, _ = lf.label_columns(rows.columns, (*LABELS, "PLT_label"))
    return lf.window_labels(rows, found)


@query(
    "window_labels_wide", "A16",
    f"""WITH {FOLLOWUP_SQL} SELECT subject, {", ".join(f'''max(label) FILTER ("window" = '{w}' AND metric = '{m}') AS "{w}_{m}"'''
      for w, *_ in values.DAY_WINDOWS for m in ("WBC", "ALB"))} FROM wl GROUP BY subject""",
)
def window_labels_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lf.wide_labels(lf.window_labels(followups(spark, sf_dir), LABELS), ("WBC", "ALB"))


@query(
    "death_and_level_labels", "A17 F12",
    f"""WITH {FOLLOWUP_SQL}, a AS (SELECT subject, max(CASE WHEN win IS NOT NULL THEN CAST(lev AS INTEGER) END) AS abnormal FROM fw GROUP BY 1)
    SELECT subject, abnormal, CAST(dead AS INTEGER) AS death_survival FROM a LEFT JOIN info USING (subject)""",
)
def death_and_level_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lf.death_labels(lf.any_positive(followups(spark, sf_dir), "level_label"), patient_info(spark, sf_dir))


@query(
    "followup_classification_index", "L14",
    f"""WITH {FOLLOWUP_SQL},
    p("window", prediction_point, cutoff_day) AS (VALUES ('30-180d', 'day30', 30), ('180-365d', 'day180', 180), ('365d+', 'day365', 365))
    SELECT subject, prediction_point, cutoff_day, wl."window" AS label_prefix, metric, wl."window" || '_' || metric AS label_col, label
    FROM wl JOIN p ON p."window" = wl."window" WHERE EXISTS (SELECT 1 FROM fu JOIN info USING (subject)
      WHERE fu.subject = wl.subject AND fu.day <= cutoff_day AND report_time >= birth_time)""",
)
def followup_classification_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, info = followups(spark, sf_dir), patient_info(spark, sf_dir)
    return lf.classification_index(
        lf.window_labels(rows, LABELS), rows.select("subject", "day", "report_time"), info.select("subject", "birth_time")
    )


SURGERY_SQL = """
su AS (SELECT subject, arg_min(report_time - to_days(CAST(day AS INTEGER)), (day, report_time)) AS surgery_time
  FROM fu WHERE day IS NOT NULL AND report_time IS NOT NULL GROUP BY subject)"""


@query(
    "surgery_and_first_drug_day", "W21 F25",
    f"""WITH {FOLLOWUP_SQL}, {SURGERY_SQL},
    d AS (SELECT subject, least(min(day) FILTER (dosed), min(day) FILTER (measured)) AS first_drug_day FROM fu GROUP BY 1)
    SELECT subject, strftime(surgery_time, '%Y-%m-%d %H:%M:%S') AS surgery_time, first_drug_day FROM d LEFT JOIN su USING (subject)""",
)
def surgery_and_first_drug_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = followups(spark, sf_dir)
    drug = lf.first_drug_days(rows, ["dose_a", "dose_b", "dose_missing"], "level")
    return drug.join(lf.surgery_dates(rows), "subject", "left").select(
        "subject", times.time_text(F.col("surgery_time")).alias("surgery_time"), "first_drug_day"
    )


DEATH_SQL = f"""{FOLLOWUP_SQL}, {SURGERY_SQL},
dy AS (SELECT subject, min(day) FILTER (day >= 0) AS p, max(day) AS l, count(day) AS n FROM fu GROUP BY subject),
dj AS (SELECT dy.*, surgery_time, dead, death_time,
    CASE WHEN dead THEN greatest(date_diff('day', surgery_time, death_time), 0) END AS dd, p + 1825 AS z
  FROM dy LEFT JOIN su USING (subject) LEFT JOIN info USING (subject)),
dk AS (SELECT *, coalesce(dd <= z, FALSE) AS hit, CASE WHEN coalesce(dd <= z, FALSE) THEN dd ELSE least(l, z) END AS o FROM dj),
dur AS (SELECT *, CASE WHEN n = 0 THEN 'no_followup_days' WHEN surgery_time IS NULL THEN 'no_report_date'
    WHEN dead AND death_time IS NULL THEN 'missing_death_time' WHEN p IS NULL THEN 'no_postoperative_followup'
    WHEN dd <= p THEN 'death_before_prediction' WHEN dd IS NULL AND l <= p THEN 'no_followup_after_prediction'
    WHEN o <= p THEN 'nonpositive_duration' END AS skipped FROM dk)"""


@query(
    "death_durations", "L19 W21",
    f"""WITH {DEATH_SQL} SELECT subject, 'death_survival' AS task, skipped, CASE WHEN skipped IS NULL THEN p END AS prediction_day,
      CASE WHEN skipped IS NULL THEN z END AS stage_end_day, CAST(CASE WHEN skipped IS NULL THEN o END AS DOUBLE) AS observed_day,
      CAST(CASE WHEN skipped IS NULL THEN o - p END AS DOUBLE) AS time_to_event,
      CASE WHEN skipped IS NULL THEN CAST(hit AS INTEGER) END AS event_observed, 1825 AS num_bins FROM dur""",
)
def death_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lf.death_durations(followups(spark, sf_dir), patient_info(spark, sf_dir), 1825)


@query(
    "death_duration_skips", "A26 L19",
    f"WITH {DEATH_SQL} SELECT skipped, count(*) AS subjects FROM dur WHERE skipped IS NOT NULL GROUP BY skipped",
)
def death_duration_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lf.skip_reasons(lf.death_durations(followups(spark, sf_dir), patient_info(spark, sf_dir), 1825))


@query(
    "drug_level_durations", "L20",
    f"""WITH {FOLLOWUP_SQL}, st(stage_id, a, z, num_bins) AS (VALUES (0, 0, 31, 31), (1, 31, 181, 150), (2, 181, 366, 185)),
    x AS (SELECT subject, day, lev, st.* FROM fu JOIN st ON day >= a AND day < z),
    p AS (SELECT subject, stage_id, a, z, num_bins, min(day) AS p, max(day) AS l FROM x GROUP BY ALL),
    e AS (SELECT p.*, (SELECT min(day) FROM x WHERE x.subject = p.subject AND x.stage_id = p.stage_id AND lev AND day > p.p) AS e FROM p)
    SELECT subject, 'tacrolimus_abnormal_survival' AS task, stage_id, CAST(a AS DOUBLE) AS start_day, CAST(z AS DOUBLE) AS end_day,
      p AS prediction_day, coalesce(e, l) AS observed_day, coalesce(e, l) - p AS time_to_event,
      CAST(e IS NOT NULL AS INTEGER) AS event_observed, CAST(z - p AS DOUBLE) AS stage_end_horizon, num_bins
    FROM e WHERE coalesce(e, l) > p""",
)
def drug_level_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lf.drug_level_durations(followups(spark, sf_dir), "level_label")


@query(
    "clean_labels", "L13",
    """WITH l AS (SELECT DISTINCT l_partkey AS subject, l_shipdate AS t, l_linestatus = 'F' AS value FROM lineitem)
    SELECT subject, strftime(t, '%Y-%m-%d %H:%M:%S') AS prediction_time, any_value(value) AS value FROM l
    GROUP BY subject, t HAVING count(*) = 1""",
)
def clean_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = b.table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("subject"), F.col("l_shipdate").alias("prediction_time"), (F.col("l_linestatus") == "F").alias("value")
    )
    cleaned = lf.clean_labels(labels, ["subject", "prediction_time"], "value")
    return cleaned.withColumn("prediction_time", times.time_text(F.col("prediction_time")))


@query(
    "primary_diagnosis", "J5 O7",
    """SELECT l_orderkey AS encounter, arg_min('icd' || (9 + l_partkey % 2) || ':' || p_brand, (l_partkey, l_suppkey)) AS diagnosis
    FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber = 1 GROUP BY 1""",
)
def primary_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First row with sequence number 1 per encounter."""
    part = b.table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    rows = b.table(spark, sf_dir, "lineitem").where(F.col("l_linenumber") == 1).select("l_orderkey", "l_partkey", "l_suppkey").join(
        part, F.col("l_partkey") == F.col("p_partkey")
    )
    named = rows.select(
        F.col("l_orderkey").alias("encounter"), "l_partkey", "l_suppkey",
        F.concat(F.lit("icd"), (F.lit(9) + F.col("l_partkey") % 2).cast("string"), F.lit(":"), F.col("p_brand")).alias("diagnosis"),
    )
    return joins.first_entry(named, ["encounter"], ["l_partkey", "l_suppkey"]).select("encounter", "diagnosis")


@query(
    "events_inside_stays", "J6",
    f"""WITH {b.ENCOUNTERS_SQL}
    SELECT s.encounter AS stay, e.l_orderkey, e.l_linenumber, e.l_partkey, e.l_suppkey
    FROM lineitem e JOIN orders o ON e.l_orderkey = o.o_orderkey
    JOIN encounters s ON s.patient = o.o_custkey AND e.l_shipdate BETWEEN s.admit_time AND s.discharge_time""",
)
def events_inside_stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line inside any stay of its patient: an equi join on (patient, week) with a range residual."""
    stays = b.encounters(spark, sf_dir).select(
        "patient", F.col("encounter").alias("stay"), F.unix_seconds(F.col("admit_time").cast("timestamp")).alias("low"),
        F.unix_seconds(F.col("discharge_time").cast("timestamp")).alias("high"),
    )
    owner = b.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("patient"))
    lines = b.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("at")
    ).join(owner, "l_orderkey")
    found = joins.within_interval(stays, lines, ["patient"], "low", "high", "at", 7 * 86_400)
    return found.select("stay", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


RANGES = (
    ("ECONOMY", 1, 0.0, 20.0, "M", 5.0, 20.0, "g/L"), ("ECONOMY", 2, 0.0, 40.0, None, 8.0, 30.0, "g/L"),
    ("SMALL", 1, 10.0, 30.0, None, 10.0, 15.0, "U/L"), ("SMALL", 2, 20.0, 99.0, "F", 1.0, 49.0, "U/L"),
    ("LARGE", 1, 0.0, 99.0, None, 25.0, 40.0, "s"),
)


@query(
    "reference_ranges", "J12 F21",
    f"""WITH r(item, place, a0, a1, g, low, high, unit) AS (VALUES {", ".join(
      "('%s', %d, %s, %s, %s, %s, %s, '%s')" % (i, p, a, z, f"'{g}'" if g else "NULL", lo, hi, u) for i, p, a, z, g, lo, hi, u in RANGES)}),
    x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_type AS item, l_partkey % 60 AS age,
        CASE WHEN l_orderkey % 2 = 0 THEN 'M' ELSE 'F' END AS gender, l_quantity AS q,
        CASE l_linenumber WHEN 1 THEN '阴性' WHEN 2 THEN 'Positive' WHEN 3 THEN '<' || CAST(l_quantity AS INTEGER)
          WHEN 4 THEN '> ' || CAST(l_quantity AS INTEGER) ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS v
      FROM lineitem JOIN part ON l_partkey = p_partkey),
    j AS (SELECT x.*, r.low, r.high, r.unit, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey ORDER BY r.place) AS n
      FROM x LEFT JOIN r ON r.item = x.item AND age >= a0 AND age < a1 AND (g IS NULL OR g = gender))
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high, unit AS range_unit,
      CASE l_linenumber WHEN 1 THEN 'Normal' WHEN 2 THEN 'Abnormal' ELSE v END AS value,
      CASE WHEN l_linenumber IN (1, 3) THEN 'Normal' WHEN l_linenumber IN (2, 4) THEN 'Abnormal'
        WHEN item = 'LARGE' AND q >= 45 THEN 'Very High' WHEN q < low OR q > high THEN 'Abnormal' ELSE 'Normal' END AS flag
    FROM j WHERE n = 1 AND low IS NOT NULL""",
)
def reference_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = b.table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("item"))
    number = F.col("l_quantity").cast("int").cast("string")
    written = (
        F.when(F.col("l_linenumber") == 1, "阴性").when(F.col("l_linenumber") == 2, "Positive")
        .when(F.col("l_linenumber") == 3, F.concat(F.lit("<"), number)).when(F.col("l_linenumber") == 4, F.concat(F.lit("> "), number))
        .otherwise(number)
    )
    rows = b.table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "item", (F.col("l_partkey") % 60).cast("double").alias("age"),
        F.when(F.col("l_orderkey") % 2 == 0, "M").otherwise("F").alias("gender"), written.alias("written"),
        F.when((F.col("item") == "LARGE") & (F.col("l_quantity") >= 45), "Very High").alias("band"),
    )
    ranges = spark.createDataFrame(
        RANGES, "item string, place int, age_min double, age_max double, range_gender string, low double, high double, unit string"
    )
    ranged = joins.reference_range(rows, ranges).where(F.col("low").isNotNull())
    told = values.described_value(F.col("written"), F.col("low"), F.col("high"), F.col("band"))
    return ranged.withColumn("_d", told).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "low", "high", "range_unit", F.col("_d.value").alias("value"),
        F.col("_d.flag").alias("flag"),
    )


@query(
    "drug_level_ranges", "J12 W21",
    f"""WITH {FOLLOWUP_SQL}, d AS (SELECT subject, least(min(day) FILTER (dosed), min(day) FILTER (measured)) AS f FROM fu GROUP BY 1),
    r(a, z, low, high) AS (VALUES (0, 31, 8.0, 12.0), (31, 181, 7.0, 10.0), (181, 366, 5.0, 8.0), (366, 1000000, 4.0, 6.0))
    SELECT fu.subject, visit, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high FROM fu JOIN d USING (subject)
    JOIN r ON day - f >= a AND day - f < z WHERE measured""",
)
def drug_level_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target range of a drug level by days since the first dose: the age axis of the range table is that number."""
    found = joins.reference_range(measured_levels(spark, sf_dir), level_ranges(spark, LEVEL_RANGES))
    return found.where(F.col("low").isNotNull()).select("subject", "visit", "low", "high")


# Days since the first dose and the target range of a level.
LEVEL_RANGES = ((0.0, 31.0, 8.0, 12.0), (31.0, 181.0, 7.0, 10.0), (181.0, 366.0, 5.0, 8.0), (366.0, 1e9, 4.0, 6.0))


def level_ranges(spark: SparkSession, days) -> DataFrame:
    return spark.createDataFrame(
        [("level", i, a, z, None, low, high, "ng/mL") for i, (a, z, low, high) in enumerate(days)],
        "item string, place int, age_min double, age_max double, range_gender string, low double, high double, unit string",
    )


def measured_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = followups(spark, sf_dir)
    first = lf.first_drug_days(rows, ["dose_a", "dose_b"], "level")
    return rows.where(F.trim(F.coalesce("level", F.lit(""))) != "").join(first, "subject").select(
        "subject", "visit", "day", "first_drug_day", F.lit("level").alias("item"), (F.col("day") - F.col("first_drug_day")).alias("age"), F.lit("").alias("gender")
    )


@query(
    "levels_without_range", "J12 W21",
    f"""WITH {FOLLOWUP_SQL}, d AS (SELECT subject, least(min(day) FILTER (dosed), min(day) FILTER (measured)) AS f FROM fu GROUP BY 1)
    SELECT fu.subject, visit, CASE WHEN f IS NULL THEN 'No first drug day for level' WHEN day IS NULL THEN 'No day of level'
      ELSE 'No drug concentration range for level at elapsed_days=' || CAST(day - f AS BIGINT) END AS reason
    FROM fu JOIN d USING (subject) WHERE measured AND NOT coalesce(day - f >= 0 AND day - f < 181, false)""",
)
def levels_without_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured levels that no range of the first half year covers, each with its reason."""
    found = joins.reference_range(measured_levels(spark, sf_dir), level_ranges(spark, LEVEL_RANGES[:2]))
    reason = F.when(F.col("first_drug_day").isNull(), "No first drug day for level").when(F.col("day").isNull(), "No day of level").otherwise(
        F.concat(F.lit("No drug concentration range for level at elapsed_days="), F.col("age").cast("bigint").cast("string")))
    return joins.unmatched(found, "low", reason).select("subject", "visit", "reason")


@query(
    "item_codes", "J3 S11",
    """WITH a AS (SELECT p_partkey AS k, CASE WHEN p_size % 5 = 0 THEN '' WHEN p_size % 5 = 1 THEN 'nan' ELSE 'V' || p_size % 5 END AS v,
        CASE WHEN p_size % 4 = 0 THEN '' ELSE p_brand END AS c FROM part WHERE p_size <= 30),
    z AS (SELECT p_partkey AS k, 'W' AS v, p_type AS c FROM part WHERE p_type = 'PROMO')
    SELECT p_partkey, coalesce(z.v || '/' || z.c, CASE WHEN a.c <> '' THEN CASE WHEN a.v IN ('', 'nan') THEN a.c ELSE a.v || '/' || a.c END END,
      'ITEMID/' || p_partkey) AS item_code FROM part LEFT JOIN a ON a.k = p_partkey LEFT JOIN z ON z.k = p_partkey""",
)
def item_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = b.table(spark, sf_dir, "part")
    size = F.col("p_size")
    vocabulary = F.when(size % 5 == 0, "").when(size % 5 == 1, "nan").otherwise(F.concat(F.lit("V"), (size % 5).cast("string")))
    low = part.where(size <= 30).select(
        "p_partkey", vocabulary.alias("vocabulary"), F.when(size % 4 == 0, "").otherwise(F.col("p_brand")).alias("code")
    )
    high = part.where(F.col("p_type") == "PROMO").select("p_partkey", F.lit("W").alias("vocabulary"), F.col("p_type").alias("code"))
    return joins.prioritised_codes(part.select("p_partkey"), [low, high], "p_partkey")


@query(
    "code_descriptions", "J10",
    """WITH c AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'CPT4/' WHEN 1 THEN 'ICD10PCS/' ELSE 'LOINC/' END || p_size AS code FROM part),
    d AS (SELECT p_size, max(p_name) AS n FROM part GROUP BY 1)
    SELECT p_partkey, code, CASE WHEN p_partkey % 3 = 2 AND CAST(split_part(code, '/', 2) AS INTEGER) <= 40 THEN 'main ' || n
      WHEN p_partkey % 3 = 2 THEN '' WHEN p_partkey % 3 = 0 AND p_size <= 10 THEN 'main ' || n
      WHEN p_partkey % 3 = 0 THEN 'cpt ' || n WHEN p_size <= 30 THEN 'pcs ' || n ELSE '' END AS description
    FROM c JOIN part USING (p_partkey) JOIN d USING (p_size)""",
)
def code_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = b.table(spark, sf_dir, "part")
    size = F.col("p_size").cast("string")
    prefix = F.when(F.col("p_partkey") % 3 == 0, "CPT4/").when(F.col("p_partkey") % 3 == 1, "ICD10PCS/").otherwise("LOINC/")
    codes = part.select("p_partkey", F.concat(prefix, size).alias("code"))
    names = part.groupBy("p_size").agg(F.max("p_name").alias("n"))
    said = lambda start: F.concat(F.lit(start), F.col("n"))
    text_of = lambda p: F.concat(F.lit(p), size)
    main = names.where("p_size <= 40").select(text_of("LOINC/").alias("code"), said("main ").alias("description")).unionByName(
        names.where("p_size <= 10").select(text_of("CPT4/").alias("code"), said("main ").alias("description")))
    cpt = names.select(size.alias("code"), said("cpt ").alias("description"))
    pcs = names.where("p_size <= 30").select(size.alias("code"), said("pcs ").alias("description"))
    return joins.code_descriptions(codes, main, {"CPT4": cpt, "ICD10PCS": pcs})


@query(
    "diagnosis_title_codes", "S13 J1",
    """WITH t AS (SELECT p_name AS title, p_partkey FROM part UNION ALL SELECT lower(p_name), p_partkey FROM part
        UNION ALL SELECT upper(p_name), p_partkey FROM part WHERE p_size <= 25
        UNION ALL SELECT lower(p_name), p_partkey FROM part WHERE p_size <= 25)
    SELECT title, 'C' || max(p_partkey) AS icd_code FROM t GROUP BY title""",
)
def diagnosis_title_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = b.table(spark, sf_dir, "part")
    rows = part.select(F.col("p_name").alias("long_title"), "p_partkey").unionByName(
        part.where("p_size <= 25").select(F.upper("p_name").alias("long_title"), "p_partkey"))
    coded = rows.withColumn("icd_code", F.concat(F.lit("C"), F.col("p_partkey").cast("string")))
    return joins.title_codes(coded, ["p_partkey"])


@query(
    "admission_subjects", "J18",
    "SELECT o_orderkey, CAST(c_custkey AS VARCHAR) AS subject_id, p AS label FROM orders JOIN customer ON o_custkey = c_custkey, "
    "LATERAL (SELECT o_orderpriority AS p)",
)
def admission_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subject of each admission; an admission without one fails the job."""
    customers = b.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_custkey").cast("string").alias("subject_id"))
    orders = b.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("label"))
    return joins.required(joins.map_values(orders, customers, ["o_custkey"], "subject_id"), "subject_id", "admission without subject").drop("o_custkey")


@query(
    "labels_by_context", "J17",
    """SELECT l_orderkey, string_agg(task || '=' || label, ';' ORDER BY task) AS labels FROM (
      SELECT l_orderkey, 'line' || l_linenumber AS task, CAST(max(l_quantity) AS INTEGER) AS label FROM lineitem GROUP BY ALL) GROUP BY 1""",
)
def labels_by_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = b.table(spark, sf_dir, "lineitem").groupBy(
        "l_orderkey", F.concat(F.lit("line"), F.col("l_linenumber").cast("string")).alias("task")
    ).agg(F.max("l_quantity").cast("int").cast("string").alias("label"))
    merged = joins.merge_by_context(parts, ["l_orderkey"])
    pairs = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return merged.select("l_orderkey", F.array_join(pairs, ";").alias("labels"))


@query(
    "trial_label_counts", "A20 F6",
    """SELECT CAST(o_custkey AS VARCHAR) AS patient_id, sum(CASE WHEN l = 0 THEN 1 ELSE 0 END)::BIGINT AS n0,
      sum(CASE WHEN l = 1 THEN 1 ELSE 0 END)::BIGINT AS n1 FROM (SELECT o_custkey, o_orderkey % 2 AS l FROM orders
      UNION ALL SELECT o_custkey, CAST(o_orderkey % 3 = 0 AS INTEGER) FROM orders) GROUP BY 1""",
)
def trial_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trial_counts(spark, sf_dir)


def trial_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortline.functions.numbers import id_text

    orders = b.table(spark, sf_dir, "orders")
    who = id_text(F.concat(F.col("o_custkey").cast("string"), F.lit(".0"))).alias("patient_id")
    first = orders.select(who, (F.col("o_orderkey") % 2).cast("int").alias("label"))
    second = orders.select(who, (F.col("o_orderkey") % 3 == 0).cast("int").alias("label"))
    return splits.label_counts([first, second], "patient_id", "label")


@query(
    "trial_rows_at_ranges", "F22 M6",
    """WITH o AS (SELECT o_custkey AS subject, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS i FROM orders)
    SELECT subject, i AS row_idx, o_orderkey, round(o_totalprice, 2) AS price FROM o
    WHERE subject % 4 <> 3 AND (i = 5 OR i BETWEEN 1 AND 3 OR (subject % 4 = 1 AND i = 0))""",
)
def trial_rows_at_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortline.operators.ordered import position, time_bucket

    orders = b.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("subject"), "o_orderkey", "o_orderdate", F.round("o_totalprice", 2).alias("price")
    )
    rows = position(orders, ["subject"], ["o_orderdate", "o_orderkey"], "row_idx", time_bucket("o_orderdate", 365 * 86_400))
    who = b.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject"))
    spelled = F.when(F.col("subject") % 4 == 3, "<NA>").when(F.col("subject") % 4 == 1, "5; 1-3;0;2").otherwise("1-3;5;9-7;3")
    labels = who.withColumn("input_idx_ranges", spelled)
    return lf.index_range_rows(labels, rows).select("subject", "row_idx", "o_orderkey", "price")


