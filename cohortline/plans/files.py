"""Sources, sinks, refresh and streams over data that Spark writes from the given tables."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from cohortline.operators import phenotype as ph
from cohortline.functions import text
from cohortline.plans import bindings as b
from cohortline.plans.counting import RAW_SQL, SUPPORT_SQL, as_spelled
from cohortline.plans.registry import query
from cohortline.plans.timelines import BLOCKS_SQL, block_table
from cohortline.sources import delimited, refresh, tables
from cohortline.session import scratch_path
from cohortline.streaming import jobs


@query(
    "csv_scan", "S1 S5",
    "SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS o_totalprice FROM orders",
)
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projected scan of a gzip CSV; a column that is not there is left out."""
    path = scratch_path(spark, "orders")
    orders = b.table(spark, sf_dir, "orders").withColumn("o_totalprice", F.round("o_totalprice", 2))
    orders.write.option("header", True).option("compression", "gzip").csv(path)
    return delimited.scan_csv(spark, path, "part-*", orders.schema, ["o_orderkey", "o_custkey", "o_totalprice", "not_there"])


@query(
    "tagged_table_union", "S6",
    """SELECT CAST(o_custkey AS VARCHAR) AS subject_id, CAST(o_orderkey AS VARCHAR) AS hadm_id, 'orders' AS file_name, 4 AS n_attrs, o_orderpriority AS label FROM orders
    UNION ALL SELECT CAST(c_custkey AS VARCHAR), NULL, 'customers', 2, c_mktsegment || ' x' FROM customer""",
)
def tagged_table_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = b.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("subject_id"), F.col("o_orderkey").alias("hadm_id"), F.col("o_orderpriority").alias("label"), "o_orderdate"
    )
    customers = b.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("subject_id"), F.concat("c_mktsegment", F.lit(" x")).alias("label")
    )
    sources = {"orders": orders, "customers": customers, "d_items": orders, "skipped": orders, "nation": b.table(spark, sf_dir, "nation")}
    merged = delimited.tagged_union(sources, ["subject_id", "hadm_id"], blacklist=["skipped"])
    return merged.select("subject_id", "hadm_id", "file_name", F.size("attrs").alias("n_attrs"), F.col("attrs")["label"].alias("label"))


@query(
    "mixed_encodings", "S3 S4",
    """SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 3 = 0 THEN '死亡' ELSE 'alive' END AS status,
      CASE WHEN c_custkey % 2 = 0 THEN CAST(c_nationkey AS VARCHAR) END AS "WBC_label", CASE WHEN c_custkey % 2 = 1 THEN c_mktsegment END AS "ALB_label",
      CASE WHEN c_custkey % 2 = 1 THEN '乗,"' || c_custkey END AS note FROM customer""",
)
def mixed_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in two encodings with different headers, a quoted comma among them, written by Spark, read back as one table."""
    path = scratch_path(spark, "mixed")
    key = F.col("c_custkey")
    status = F.when(key % 3 == 0, "死亡").otherwise("alive")
    rows = b.table(spark, sf_dir, "customer")
    even = rows.where(key % 2 == 0).select(key.cast("string").alias("id"), status.alias("status"), F.col("c_nationkey").cast("string").alias("WBC_label"))
    even.write.option("header", True).csv(f"{path}/utf8")
    odd = rows.where(key % 2 == 1).select(key.cast("string").alias("id"), status.alias("status"), F.col("c_mktsegment").alias("ALB_label"), F.concat(F.lit('乗,"'), key).alias("note, free"))
    encoded = odd.select("id", _as_gb18030(F.col("status")).alias("status"), "ALB_label", _as_gb18030(F.col("`note, free`")).alias("note, free"))
    encoded.write.option("header", True).option("encoding", "ISO-8859-1").option("escape", '"').csv(f"{path}/gb18030")
    merged = delimited.read_mixed(spark, f"{path}/*/*.csv")
    found, _ = tables_labels(merged)
    return merged.select("id", "status", *sorted(found, reverse=True), F.col("`note, free`").alias("note"))


def tables_labels(merged: DataFrame) -> tuple[list[str], list[str]]:
    from cohortline.operators.labels_followup import label_columns

    return label_columns(merged.columns)


@F.pandas_udf(T.StringType())
def _as_gb18030(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else v.encode("gb18030").decode("iso-8859-1"))


@query("timeline_files", "S7 S8", f"WITH {BLOCKS_SQL} SELECT subject_id, event_idx, file_name, n_items FROM blocks")
def timeline_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "blocks")
    blocks = block_table(spark, sf_dir).withColumn("part", F.floor(F.col("event_idx") / 4096))
    tables.write_timeline(blocks, path, "subject_id", ["event_idx"], 8, "part")
    return spark.read.parquet(path).select("subject_id", "event_idx", "file_name", "n_items")


def bucketed_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Blocks and subjects as tables bucketed by subject; a table's name tells its input, so a rerun replaces it."""
    tag = hashlib.md5(sf_dir.encode()).hexdigest()[:12]
    blocks = tables.bucketed(spark, block_table(spark, sf_dir).select("subject_id", "event_idx", "file_name", "n_items"),
                             f"timeline_{tag}_blocks", scratch_path(spark, "blocks"), "subject_id", ["event_idx"])
    people = tables.bucketed(spark, b.subjects(spark, sf_dir), f"timeline_{tag}_people", scratch_path(spark, "people"), "subject_id", ["subject_id"])
    return blocks, people


@query(
    "bucketed_timelines", "S7 S8",
    f"""WITH {BLOCKS_SQL}, {b.SUBJECTS_SQL}
    SELECT subject_id, any_value(death_time) AS death_time, count(*) AS n_blocks, CAST(sum(n_items) AS BIGINT) AS n_items, max(event_idx) AS last_idx
    FROM blocks JOIN subj USING (subject_id) GROUP BY subject_id""",
)
def bucketed_timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each subject's blocks with its own row: join and aggregate on the buckets as they lie, without a shuffle."""
    blocks, people = bucketed_pair(spark, sf_dir)
    return blocks.join(people, "subject_id").groupBy("subject_id").agg(
        F.first("death_time").alias("death_time"), F.count(F.lit(1)).alias("n_blocks"), F.sum("n_items").alias("n_items"), F.max("event_idx").alias("last_idx"))


@query(
    "task_index_files", "S9",
    """SELECT o_orderkey AS sample, o_orderpriority AS task, 'val' AS split, CAST(o_totalprice > 200000 AS INTEGER) AS label FROM orders
    WHERE o_custkey % 10 = 1 AND o_orderpriority IN ('1-URGENT', '5-LOW')""",
)
def task_index_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "index")
    who = F.col("o_custkey") % 10
    rows = b.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("sample"), (F.col("o_totalprice") > 200000).cast("int").alias("label"),
        F.when(who == 0, "test").when(who == 1, "val").otherwise("train").alias("split"), F.col("o_orderpriority").alias("task"),
    )
    tables.write_index(rows, path, "csv")
    found = tables.read_index(spark, path, "sample bigint, label int, split string, task string", ["val"], ["1-URGENT", "5-LOW"], "csv")
    return found.select("sample", "task", "split", "label")


@query(
    "record_files", "S10",
    """SELECT l_orderkey AS sample, string_agg(DISTINCT CAST(l_linenumber AS VARCHAR), ',' ORDER BY CAST(l_linenumber AS VARCHAR)) AS labels FROM lineitem GROUP BY 1""",
)
def record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List labels written as text in JSON records, parsed on reading."""
    path = scratch_path(spark, "records")
    sets = b.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("sample")).agg(
        F.to_json(F.array_sort(F.collect_set("l_linenumber"))).alias("label")
    )
    tables.write_records(sets, path)
    rows = tables.parsed_labels(tables.read_records(spark, path, "sample bigint, label string"))
    return rows.select("sample", F.array_join(F.col("labels").cast("array<string>"), ",").alias("labels"))


@query(
    "vocabulary_files", "S12",
    """SELECT p_partkey AS concept_id, trim(p_name) AS concept_name, p_brand AS domain_id, p_type AS vocabulary_id FROM part WHERE p_size % 9 <> 0""",
)
def vocabulary_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortline.operators.graph import clean_concepts

    path = scratch_path(spark, "concept")
    part = b.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("concept_id"), F.when(F.col("p_size") % 9 != 0, F.concat(F.lit(" "), "p_name")).otherwise("").alias("concept_name"),
        F.col("p_brand").alias("domain_id"), F.col("p_type").alias("vocabulary_id"),
    )
    part.write.option("header", True).option("sep", "\t").option("quote", "").option("emptyValue", "").csv(path)
    rows = delimited.read_vocabulary(spark, path, "concept_id string, concept_name string, domain_id string, vocabulary_id string")
    return clean_concepts(rows)


@query(
    "exam_lists", "S11",
    """SELECT l_orderkey AS note_id, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS exams FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1""",
)
def exam_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    details = b.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("note_id"), F.when(F.col("l_linestatus") == "F", "exam_name").otherwise("cpt").alias("field_name"),
        F.col("l_returnflag").alias("field_value"),
    )
    return delimited.exam_lists(details).withColumn("exams", F.array_join("exams", ","))


@query(
    "refreshed_counts", "S15",
    """SELECT l_returnflag, count(*) AS n, CAST(0 AS BIGINT) AS rebuilt_again FROM lineitem
    WHERE l_orderkey % 5 IN (0, 4) OR (l_orderkey % 5 = 1 AND l_linenumber = 1) GROUP BY 1""",
)
def refreshed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per source file after one part was replaced, one removed and one left without rows; a third run has nothing to do."""
    folder, output = scratch_path(spark, "parts"), scratch_path(spark, "refresh")
    lines = b.table(spark, sf_dir, "lineitem").withColumn("part", F.col("l_orderkey") % 5)
    lines.write.partitionBy("part").parquet(folder)
    count = lambda rows: rows.groupBy("source", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    refresh.refresh(spark, spark.read.parquet(folder), {"version": 1}, count, output)
    lines.where("part = 1 AND l_linenumber = 1").drop("part").write.mode("overwrite").parquet(f"{folder}/part=1")
    left = spark.read.parquet(folder).where("part <> 2")
    known = lambda rows: count(rows.where("part <> 3"))
    refresh.refresh(spark, left, {"version": 2}, known, output)
    again = refresh.refresh(spark, left, {"version": 2}, known, output)
    rows = refresh.current(spark, output).groupBy("l_returnflag").agg(F.sum("n").alias("n"))
    return rows.withColumn("rebuilt_again", F.lit(again).cast("bigint"))


#: Micro-batches that streamed lines come in, and lines of one of their files
BATCHES, FILE_LINES = 4, 500_000


def streamed_lines(spark: SparkSession, sf_dir: str, file_lines: int = FILE_LINES) -> DataFrame:
    """Measurement rows as a stream of four micro-batches, over which an encounter's lines are spread.

    The files of a micro-batch grow in number with the lines, not in size.
    """
    folder = scratch_path(spark, "stream")
    files = max(1, -(-b.table(spark, sf_dir, "lineitem").count() // (BATCHES * file_lines)))
    dealt = b.measurements(spark, sf_dir).repartition(BATCHES * files, "l_linenumber", "encounter")
    rows = as_spelled(dealt).withColumns({
        "item_key": text.item_key(F.col("item")), "unit_key": text.unit_key(F.col("unit")),
    })
    rows.write.parquet(folder)
    return jobs.file_stream(spark, folder, "*.parquet", rows.schema, files_per_batch=files)


@query("streamed_encounter_support", "X1 A6", f"WITH {SUPPORT_SQL} SELECT * FROM support")
def streamed_encounter_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    output, checkpoint = scratch_path(spark, "support"), scratch_path(spark, "support-state")
    rows = ph.numeric_rows(streamed_lines(spark, sf_dir))
    batch_rows = -(-b.table(spark, sf_dir, "lineitem").count() // BATCHES)
    jobs.support_stream(rows, output, checkpoint, batch_rows=batch_rows).awaitTermination()
    return jobs.supports(spark, output)


@query(
    "streamed_item_counts", "X2 A1",
    f"""WITH {RAW_SQL} SELECT dataset, "table", item, unit, count(*) AS count FROM raw GROUP BY ALL""",
)
def streamed_item_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    output, checkpoint = scratch_path(spark, "counts"), scratch_path(spark, "counts-state")
    keys = ["dataset", "table", "item", "unit"]
    jobs.keep_latest(jobs.count_stream(streamed_lines(spark, sf_dir)), output, checkpoint, keys).awaitTermination()
    return jobs.latest(spark, output, keys)


@query("streamed_new_texts", "X3 A24", "SELECT DISTINCT p_name AS text FROM part")
def streamed_new_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each name twice over four files, one per micro-batch: what an earlier batch had is known from the table."""
    output, checkpoint = scratch_path(spark, "texts"), scratch_path(spark, "texts-state")
    folder = scratch_path(spark, "names")
    parts = b.table(spark, sf_dir, "part").select(F.col("p_name").alias("text"))
    parts.union(parts).repartition(4, F.rand(1)).write.parquet(folder)
    stream = jobs.file_stream(spark, folder, "*.parquet", parts.schema, files_per_batch=1)
    jobs.harvest_texts(stream, "text", output, checkpoint).awaitTermination()
    return jobs.harvested(spark, output)
