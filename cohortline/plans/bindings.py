"""The given tables seen as clinical ones, in Spark and as the matching SQL text.

Nothing is copied or sampled: every view reads its tables whole and stays lazy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: encounter, patient, scope, diagnosis, admission and discharge time.

    Region and nation have a fixed number of rows, so they are broadcast; customers grow with the
    data and are left to the optimizer.
    """
    region = table(spark, sf_dir, "region")
    nation = table(spark, sf_dir, "nation").join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    customer = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    orders = table(spark, sf_dir, "orders")
    joined = orders.join(
        customer.select("c_custkey", "c_mktsegment", "r_name"), F.col("o_custkey") == F.col("c_custkey")
    )
    return joined.select(
        F.col("o_orderkey").alias("encounter"),
        F.col("o_custkey").alias("patient"),
        F.col("r_name").alias("scope"),
        F.col("o_orderpriority").alias("diagnosis"),
        F.col("c_mktsegment").alias("segment"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("price"),
        F.col("o_orderdate").alias("admit_time"),
        (F.col("o_orderdate") + F.make_dt_interval(days=stay_days(F.col("o_orderkey")))).alias("discharge_time"),
    )


def stay_days(key: Column) -> Column:
    return (F.lit(1) + key % F.lit(14)).cast("int")


ENCOUNTERS_SQL = """
encounters AS (
  SELECT o_orderkey AS encounter, o_custkey AS patient, r_name AS scope, o_orderpriority AS diagnosis,
         c_mktsegment AS segment, o_orderstatus AS status, o_totalprice AS price, o_orderdate AS admit_time,
         o_orderdate + to_days(CAST(1 + o_orderkey % 14 AS INTEGER)) AS discharge_time
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
)"""


#: Measurements that one task joins and aggregates
TASK_LINES = 500_000


def spread_lines(rows: DataFrame, n_lines: int, key: str, task_lines: int = TASK_LINES) -> DataFrame:
    """Rows dealt by `key` so that a task gets about `task_lines`, where the session's shuffle partitions would hold more."""
    parts = -(-n_lines // task_lines)
    return rows.repartition(parts, key) if parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def item_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the type of their part."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate"
    )
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey"))


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item: who, what (item, unit), when and how much, with a total order in an encounter.

    Encounters are joined in as many parts as the lines need, so a task's memory doesn't grow with the tables.
    """
    n_lines = table(spark, sf_dir, "lineitem").count()
    who = encounters(spark, sf_dir).select("encounter", "patient", "scope", "diagnosis", "admit_time", "discharge_time")
    return (
        spread_lines(item_lines(spark, sf_dir), n_lines, "l_orderkey")
        .join(who, F.col("l_orderkey") == F.col("encounter"))
        .select(
            "encounter", "patient", "scope", "diagnosis", "admit_time", "discharge_time",
            F.col("p_type").alias("item"),
            F.col("l_returnflag").alias("unit"),
            F.col("l_quantity").alias("value"),
            F.col("l_shipdate").alias("time"),
            "l_linenumber", "l_partkey", "l_suppkey",
        )
    )


MEASUREMENTS_SQL = ENCOUNTERS_SQL + """,
measurements AS (
  SELECT encounter, patient, scope, diagnosis, admit_time, discharge_time, p_type AS item, l_returnflag AS unit,
         l_quantity AS value, l_shipdate AS time, l_linenumber, l_partkey, l_suppkey
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN encounters ON l_orderkey = encounter
)"""

# How an event type of the given stream reads as a source table.
EVENT_TABLES = {
    "signup": "admissions",
    "purchase": "discharge",
    "error": "icustays",
    "view": "edstays",
    "click": "labevents",
}
# Seconds of one admission episode (a week) and its origin, 2024-01-01 00:00:00.
EPISODE_SECONDS, EPISODE_ORIGIN = 604_800, 1_704_067_200
# Width of the time buckets that cut a long timeline, in seconds.
TIMELINE_BUCKET = 7 * 86_400


def timeline_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as source rows: subject, admission, table, time, and the end and note of a stay."""
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1_000_000))
    tables = F.create_map(*[F.lit(x) for pair in EVENT_TABLES.items() for x in pair])
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("subject_id"),
        (F.col("user_id") * 1000 + F.floor((seconds - EPISODE_ORIGIN) / EPISODE_SECONDS)).cast("bigint").alias("hadm_id"),
        tables[F.col("event_type")].alias("file_name"),
        F.col("ts").alias("time"),
        F.col("event_id").alias("seq"),
        F.col("value"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        (F.col("ts") + F.make_dt_interval(hours=(F.lit(1) + F.col("event_id") % 400).cast("int"))).alias("end_time"),
    )


TIMELINE_SQL = f"""
tl AS (
  SELECT user_id AS subject_id,
         user_id * 1000 + CAST(floor((floor(epoch_us(ts) / 1000000.0) - {EPISODE_ORIGIN}) / {EPISODE_SECONDS}.0) AS BIGINT)
           AS hadm_id,
         CASE event_type WHEN 'signup' THEN 'admissions' WHEN 'purchase' THEN 'discharge' WHEN 'error' THEN 'icustays'
              WHEN 'view' THEN 'edstays' WHEN 'click' THEN 'labevents' END AS file_name,
         ts AS time, event_id AS seq, value, CAST(json_extract(props, '$.k') AS INTEGER) AS k,
         ts + to_hours(CAST(1 + event_id % 400 AS INTEGER)) AS end_time
  FROM events
)"""


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per subject of the stream with a death time for one in four."""
    origin = F.lit("2024-01-03 00:00:00").cast("timestamp_ntz")
    seen = table(spark, sf_dir, "events").select(F.col("user_id").alias("subject_id")).distinct()
    died = F.when(
        F.col("subject_id") % 4 == 0, origin + F.make_dt_interval(days=(F.col("subject_id") % 28).cast("int"))
    )
    return seen.withColumn("death_time", died)


SUBJECTS_SQL = """
subj AS (
  SELECT user_id AS subject_id,
         CASE WHEN user_id % 4 = 0 THEN TIMESTAMP '2024-01-03 00:00:00' + to_days(CAST(user_id % 28 AS INTEGER)) END
           AS death_time
  FROM (SELECT DISTINCT user_id FROM events)
)"""
