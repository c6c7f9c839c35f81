"""Item counts, cross-center prevalence, encounter support, pair counts and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortline.functions import text
from cohortline.operators import concepts, phenotype as ph
from cohortline.plans import bindings as b
from cohortline.plans.registry import query

SCOPES = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
# Spellings of items and units as different sources write them.
UNIT_SPELLING = {"A": "μg", "N": " µ g", "R": "MG ( total )"}


def raw_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements as sources spell them: mixed case, both micro signs, some values that are no number."""
    return as_spelled(b.measurements(spark, sf_dir))


def as_spelled(rows: DataFrame) -> DataFrame:
    item = F.when(F.col("l_linenumber") % 2 == 0, F.col("item")).otherwise(F.concat(F.lit("  "), F.lower("item")))
    number = F.col("value").cast("int").cast("string")
    value = (
        F.when(F.col("l_linenumber") == 7, F.concat(number, F.lit("d")))
        .when(F.col("l_linenumber") == 6, F.lit("nan")).otherwise(number)
    )
    return rows.withColumn("item", item).withColumn("unit", text.mapped(F.col("unit"), UNIT_SPELLING)).withColumn(
        "value", value
    ).withColumn("dataset", F.lower("scope")).withColumn("table", F.lit("lines"))


RAW_SQL = b.MEASUREMENTS_SQL + """,
raw AS (
  SELECT scope, encounter, patient, diagnosis, time, lower(scope) AS dataset, 'lines' AS "table",
         CASE WHEN l_linenumber % 2 = 0 THEN item ELSE '  ' || lower(item) END AS item,
         CASE unit WHEN 'A' THEN 'μg' WHEN 'N' THEN ' µ g' ELSE 'MG ( total )' END AS unit,
         CAST(value AS INTEGER) AS value_num, l_linenumber, l_partkey, l_suppkey
  FROM measurements WHERE l_linenumber NOT IN (6, 7)
),
keyed AS (
  SELECT *, lower(trim(item)) AS item_key,
         CASE unit WHEN 'MG ( total )' THEN 'mg(total)' ELSE 'ug' END AS unit_key
  FROM raw
)"""

WIDE = {"o_totalprice": ("Total price", "usd"), "c_acctbal": ("Account balance", "usd"), "not_there": ("None", "")}


@query(
    "item_unit_counts", "A1 S1 S5 F4",
    f"""WITH {RAW_SQL} SELECT dataset, "table", item, unit, count(*) AS count FROM raw GROUP BY ALL""",
)
def item_unit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ph.item_unit_counts(raw_measurements(spark, sf_dir))


def wide_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = b.table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    wide = b.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice").join(
        customer, F.col("o_custkey") == F.col("c_custkey")
    )
    return ph.melt_wide(wide, ["o_orderkey", "o_custkey"], WIDE)


@query(
    "wide_columns_as_items", "A2 S5",
    """SELECT 'Total price' AS item, 'usd' AS unit, count(*) AS count, round(sum(o_totalprice), 2) AS total
       FROM orders JOIN customer ON o_custkey = c_custkey
       UNION ALL SELECT 'Account balance', 'usd', count(*), round(sum(c_acctbal), 2)
       FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def wide_columns_as_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide_rows(spark, sf_dir).groupBy("item", "unit").agg(
        F.count(F.lit(1)).alias("count"), F.round(F.sum("value"), 2).alias("total")
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = ph.item_unit_counts(raw_measurements(spark, sf_dir))
    return ph.merge_counts(counts, ["dataset", "table", "item", "unit"])


CANDIDATES_SQL = RAW_SQL + """,
counts AS (SELECT dataset, "table", item, unit, item_key, unit_key, count(*) AS n FROM keyed GROUP BY ALL),
candidates AS (
  SELECT first(item ORDER BY dataset, "table", item, unit) AS item,
         first(unit ORDER BY dataset, "table", item, unit) AS unit,
         CAST(sum(n) AS BIGINT) AS count, item_key, unit_key
  FROM counts GROUP BY item_key, unit_key
)"""


@query(
    "merged_item_unit_counts", "A3 F1 F2 F3a O1 O3 O4",
    f"WITH {CANDIDATES_SQL} SELECT * FROM candidates ORDER BY count DESC, item_key, unit_key",
)
def merged_item_unit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).orderBy(F.col("count").desc(), "item_key", "unit_key")


def keyed_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ph.numeric_rows(raw_measurements(spark, sf_dir)).withColumn(
        "item_key", text.item_key(F.col("item"))
    ).withColumn("unit_key", text.unit_key(F.col("unit")))


SUPPORT_SQL = RAW_SQL + """,
support AS (
  SELECT scope, encounter, item_key, unit_key, min(patient) AS patient, min(diagnosis) AS diagnosis,
         count(*) AS measurement_count, min(time) AS min_time, max(time) AS max_time
  FROM keyed GROUP BY scope, encounter, item_key, unit_key
)"""


@query("encounter_support", "A6 F1 F2 F3a F4 F6", f"WITH {SUPPORT_SQL} SELECT * FROM support")
def encounter_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ph.encounter_support(keyed_measurements(spark, sf_dir))


@query("encounter_support_merged", "A6 S15", f"WITH {SUPPORT_SQL} SELECT * FROM support")
def encounter_support_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supports of two halves of the rows, merged: must equal the support of the whole."""
    rows = keyed_measurements(spark, sf_dir)
    early = F.col("time") < F.lit("1998-01-01").cast("timestamp_ntz")
    return ph.merge_support(ph.encounter_support(rows.where(early)), ph.encounter_support(rows.where(~early)))


PAIRS_SQL = SUPPORT_SQL + "," + CANDIDATES_SQL.split(RAW_SQL + ",")[1] + """,
eligible AS (
  SELECT s.*, t.statistic FROM support s JOIN (VALUES
    ('latest', 1, FALSE), ('min', 1, FALSE), ('max', 1, FALSE), ('delta', 2, TRUE),
    ('time_weighted_mean', 2, TRUE), ('slope', 3, TRUE)) t(statistic, need, spread)
  ON measurement_count >= need AND (NOT spread OR min_time < max_time)
),
pairs AS (
  SELECT a.scope, a.item_key, a.unit_key, a.statistic, count(*) AS pair_count
  FROM eligible a JOIN eligible b ON a.scope = b.scope AND a.item_key = b.item_key AND a.unit_key = b.unit_key
    AND a.statistic = b.statistic AND a.diagnosis = b.diagnosis AND a.encounter < b.encounter AND a.patient <> b.patient
  GROUP BY ALL
),
sizes AS (
  SELECT scope, item_key, unit_key, statistic, count(*) AS eligible_encounters,
         count(DISTINCT diagnosis) AS diagnosis_clusters
  FROM eligible GROUP BY ALL
),
grid AS (
  SELECT r_name AS scope, c.*, statistic FROM candidates c, region,
    (VALUES ('latest'), ('delta'), ('slope'), ('min'), ('max'), ('time_weighted_mean')) t(statistic)
),
pair_grid AS (
  SELECT scope, item, unit, count, statistic, coalesce(eligible_encounters, 0) AS eligible_encounters,
         coalesce(diagnosis_clusters, 0) AS diagnosis_clusters, coalesce(pair_count, 0) AS pair_count
  FROM grid LEFT JOIN sizes USING (scope, item_key, unit_key, statistic)
       LEFT JOIN pairs USING (scope, item_key, unit_key, statistic)
)"""


def pair_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = ph.pair_counts(ph.encounter_support(keyed_measurements(spark, sf_dir)))
    return ph.pair_count_grid(pairs, candidates(spark, sf_dir), SCOPES)


@query("phenotype_pair_counts", "A7 A6 A3 J14 F1 F2 F3a F4", f"WITH {PAIRS_SQL} SELECT * FROM pair_grid")
def phenotype_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_grid(spark, sf_dir)


@query(
    "balanced_phenotype_specs", "A10 F23",
    f"""WITH {PAIRS_SQL},
    complete AS (
      SELECT item, unit FROM (SELECT item, unit, statistic, sum(pair_count) AS s FROM pair_grid GROUP BY ALL)
      GROUP BY item, unit HAVING count_if(s > 0) = 6)
    SELECT item, unit, statistic,
      'phenotype_' || substr(sha1(lower(trim(item)) || chr(0) ||
          CASE unit WHEN 'MG ( total )' THEN 'mg(total)' ELSE 'ug' END || chr(0) || statistic), 1, 12)
        || '_' || statistic AS key,
      'Continuous clinical measurement: ' || item || '. Unit: ' || unit ||
        '. Target statistic over one encounter: ' || replace(statistic, '_', ' ') || '.' AS query_text
    FROM complete,
      (VALUES ('latest'), ('delta'), ('slope'), ('min'), ('max'), ('time_weighted_mean')) t(statistic)""",
)
def balanced_phenotype_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ph.balanced_specs(pair_grid(spark, sf_dir))


STATS_SQL = RAW_SQL + """,
k AS (SELECT *, epoch(time) / 3600.0 AS h FROM keyed),
agg AS (
  SELECT encounter, item_key, unit_key, arg_max(value_num, (time, l_linenumber, l_partkey, l_suppkey)) AS latest,
         min(value_num) AS mn, max(value_num) AS mx, count(*) AS n, count(DISTINCT time) AS nt,
         regr_slope(value_num, h) AS slope
  FROM k GROUP BY encounter, item_key, unit_key
),
pt AS (SELECT encounter, item_key, unit_key, h, avg(value_num) AS v FROM k GROUP BY ALL),
st AS (
  SELECT *, lag(h) OVER w AS ph, lag(v) OVER w AS pv FROM pt
  WINDOW w AS (PARTITION BY encounter, item_key, unit_key ORDER BY h)
),
cv AS (
  SELECT encounter, item_key, unit_key, sum((h - ph) * (v + pv) / 2) / (max(h) - min(h)) AS twm,
         arg_max(v, h) - arg_min(v, h) AS delta
  FROM st GROUP BY encounter, item_key, unit_key
),
stats AS (
  SELECT encounter, item_key, unit_key, CAST(latest AS DOUBLE) AS latest,
         CASE WHEN nt >= 2 THEN delta END AS delta, CASE WHEN nt >= 2 AND n >= 3 THEN slope END AS slope,
         CAST(mn AS DOUBLE) AS mn, CAST(mx AS DOUBLE) AS mx, CASE WHEN nt >= 2 THEN twm END AS twm
  FROM agg JOIN cv USING (encounter, item_key, unit_key)
)"""


def encounter_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keyed_measurements(spark, sf_dir)
    return ph.six_statistics(
        rows, ["encounter", "item_key", "unit_key"], order=["l_linenumber", "l_partkey", "l_suppkey"]
    )


@query(
    "encounter_statistics", "A8",
    f"""WITH {STATS_SQL} SELECT encounter, item_key, unit_key, latest, round(delta, 6) AS delta,
        round(slope, 6) AS slope, mn AS "min", mx AS "max", round(twm, 6) AS time_weighted_mean FROM stats""",
)
def encounter_statistics_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = encounter_statistics(spark, sf_dir)
    rounded = [F.round(c, 6).alias(c) if c in ("delta", "slope", "time_weighted_mean") else F.col(c) for c in stats.columns]
    return stats.select(*rounded)


@query(
    "statistic_rows_of_specs", "A9 J8 O5",
    f"""WITH {STATS_SQL}, chosen AS (SELECT * FROM stats WHERE item_key IN ('economy', 'large'))
    SELECT encounter, item_key, unit_key, 'latest' AS statistic, round(latest, 6) AS value FROM chosen
    UNION ALL SELECT encounter, item_key, unit_key, 'delta', round(delta, 6) FROM chosen WHERE delta IS NOT NULL
    UNION ALL SELECT encounter, item_key, unit_key, 'slope', round(slope, 6) FROM chosen WHERE slope IS NOT NULL
    UNION ALL SELECT encounter, item_key, unit_key, 'min', round(mn, 6) FROM chosen
    UNION ALL SELECT encounter, item_key, unit_key, 'max', round(mx, 6) FROM chosen
    UNION ALL SELECT encounter, item_key, unit_key, 'time_weighted_mean', round(twm, 6) FROM chosen
    WHERE twm IS NOT NULL""",
)
def statistic_rows_of_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistic rows of selected items; the selection is a semi join before any statistic is computed."""
    selected = spark.createDataFrame([("economy",), ("large",)], "item_key string")
    rows = keyed_measurements(spark, sf_dir).join(F.broadcast(selected), "item_key", "left_semi")
    keys = ["encounter", "item_key", "unit_key"]
    stats = ph.six_statistics(rows, keys, order=["l_linenumber", "l_partkey", "l_suppkey"])
    return ph.statistic_rows(stats, keys).withColumn("value", F.round("value", 6))


CENTERS = ("hospital", "icu", "omop", "followup")
# Label and unit of each item as a center reports it.
CENTER_LABELS = {
    "ECONOMY": "Heart_Rate", "SMALL": "Creatinine", "MEDIUM": "Glucose, urine", "PROMO": "Hemoglobin A",
    "STANDARD": "WBC count", "LARGE": "Platelet-Count",
}
CENTER_UNITS = {"A": "mg/dL (adult)", "N": "K/µL", "R": "g/dL"}


def center_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements of four centers (by patient), labelled as sources label them."""
    number = F.pmod(F.col("patient"), F.lit(4)).cast("int")
    rows = b.measurements(spark, sf_dir).select(
        F.element_at(F.array(*[F.lit(c) for c in CENTERS]), number + 1).alias("center"),
        F.col("patient").alias("entity"),
        text.mapped(F.col("item"), CENTER_LABELS).alias("item"),
        text.mapped(F.col("unit"), CENTER_UNITS).alias("unit"),
    )
    return rows.where((F.col("center") != "followup") | (F.col("item") != "Creatinine"))


CENTER_SQL = b.MEASUREMENTS_SQL + """,
center_rows AS (
  SELECT * FROM (
    SELECT CASE patient % 4 WHEN 0 THEN 'hospital' WHEN 1 THEN 'icu' WHEN 2 THEN 'omop' ELSE 'followup' END AS center,
           patient AS entity,
           CASE item WHEN 'ECONOMY' THEN 'Heart_Rate' WHEN 'SMALL' THEN 'Creatinine' WHEN 'MEDIUM' THEN 'Glucose, urine'
             WHEN 'PROMO' THEN 'Hemoglobin A' WHEN 'STANDARD' THEN 'WBC count' ELSE 'Platelet-Count' END AS item,
           CASE unit WHEN 'A' THEN 'mg/dL (adult)' WHEN 'N' THEN 'K/µL' ELSE 'g/dL' END AS unit
    FROM measurements)
  WHERE center <> 'followup' OR item <> 'Creatinine'
),
conc AS (
  SELECT *, CASE item WHEN 'Creatinine' THEN 'creatinine' WHEN 'Hemoglobin A' THEN 'hemoglobin'
    WHEN 'WBC count' THEN 'white_blood_cell_count' WHEN 'Platelet-Count' THEN 'platelet_count'
    WHEN 'Heart_Rate' THEN 'heart_rate' END AS concept
  FROM center_rows
),
kept AS (
  SELECT * FROM conc WHERE (concept = 'creatinine' AND unit = 'mg/dL (adult)') OR (concept = 'hemoglobin' AND unit = 'g/dL')
    OR (concept IN ('white_blood_cell_count', 'platelet_count') AND unit = 'K/µL')
),
scanned AS (SELECT center, count(DISTINCT entity) AS scanned_entities FROM center_rows GROUP BY center),
prev AS (
  SELECT center, concept, count(*) AS event_count, count(DISTINCT entity) AS entity_count FROM kept GROUP BY ALL
),
prevalence AS (SELECT *, CAST(entity_count AS DOUBLE) / scanned_entities AS p FROM prev JOIN scanned USING (center))"""


def center_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    dictionary = b.table(spark, sf_dir, "part").select(text.mapped(F.col("p_type"), CENTER_LABELS).alias("item"))
    return concepts.with_compatible_unit(concepts.classify_labels(center_rows(spark, sf_dir), "item", dictionary), "unit")


def scanned_entities(rows: DataFrame) -> DataFrame:
    return rows.groupBy("center").agg(F.count_distinct("entity").alias("scanned_entities"))


@query(
    "concept_prevalence", "A4 F14 F15 F3b J1 J4",
    f"""WITH {CENTER_SQL} SELECT center, concept, event_count, entity_count, scanned_entities,
        round(p, 8) AS prevalence FROM prevalence""",
)
def concept_prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = scanned_entities(center_rows(spark, sf_dir))
    rows = ph.concept_prevalence(center_concepts(spark, sf_dir), scanned)
    return rows.withColumn("prevalence", F.round("prevalence", 8))


@query(
    "concept_variants", "A4 O2",
    f"""WITH {CENTER_SQL}, v AS (SELECT center, concept, item, unit, count(*) AS event_count FROM kept GROUP BY ALL)
        SELECT *, CAST(row_number() OVER (PARTITION BY center, concept ORDER BY event_count DESC, item, unit) AS INTEGER)
          AS variant_rank
        FROM v QUALIFY variant_rank <= 5""",
)
def concept_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ph.concept_variants(center_concepts(spark, sf_dir), keep=5)


@query(
    "cross_center_phenotypes", "A5 O3",
    f"""WITH {CENTER_SQL},
    units AS (SELECT center, concept, unit FROM kept GROUP BY ALL)
    SELECT concept, count(*) AS centers_present,
      CASE count(*) WHEN 4 THEN 'four_center_core' WHEN 3 THEN 'three_center_extension'
        ELSE 'two_center_auxiliary' END AS selection_tier,
      round(min(p), 8) AS minimum_prevalence, round(pow(product(p), 1.0 / count(*)), 8) AS geometric_mean_prevalence,
      {", ".join(f'''coalesce(max(entity_count) FILTER (center = '{c}'), 0) AS {c}_entities,
      coalesce(round(max(p) FILTER (center = '{c}'), 8), 0.0::DOUBLE) AS {c}_prevalence,
      coalesce(max(event_count) FILTER (center = '{c}'), 0) AS {c}_events,
      coalesce(max(unit) FILTER (center = '{c}'), '') AS {c}_top_units''' for c in CENTERS)}
    FROM prevalence JOIN units USING (center, concept) GROUP BY concept""",
)
def cross_center_phenotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = center_concepts(spark, sf_dir)
    prevalence = ph.concept_prevalence(rows, scanned_entities(center_rows(spark, sf_dir)))
    table = ph.cross_center_table(prevalence, ph.concept_variants(rows), CENTERS)
    rounded = [F.round(c, 8).alias(c) if c.endswith("prevalence") else F.col(c) for c in table.columns]
    return table.select(*rounded).orderBy(
        F.col("centers_present").desc(), F.col("minimum_prevalence").desc(), F.col("geometric_mean_prevalence").desc()
    )


@query(
    "drug_codes_and_units", "F7 F26",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, lpad(CAST(l_partkey AS VARCHAR), 11, '0') AS ndc,
      CASE WHEN l_linenumber <= 3 THEN 'if' || l_returnflag ELSE l_linestatus END AS unit FROM lineitem""",
)
def drug_codes_and_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padded drug codes, and the interface unit where there is one, else the system's."""
    from cohortline.functions.values import interface_or_system

    interface = F.when(F.col("l_linenumber") <= 3, F.concat(F.lit("if"), "l_returnflag")).otherwise("nan")
    return b.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        text.ndc_key(F.concat(F.col("l_partkey").cast("string"), F.lit(".0"))).alias("ndc"),
        interface_or_system(text.clean_text(interface), F.col("l_linestatus")).alias("unit"),
    )
