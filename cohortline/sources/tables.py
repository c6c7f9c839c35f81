"""Sinks and scans of derived tables: timelines, task indexes, record files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_timeline(df: DataFrame, path: str, subject: str, order: Sequence[str], partitions: int, rows_per_bucket: str | None = None) -> None:
    """Timeline rows laid out by subject and sorted inside each file.

    `rows_per_bucket` names a column (a time or block bucket) that joins the subject in the partitioning, so
    a subject with most of the rows is spread over many files.
    """
    keys = [subject] if rows_per_bucket is None else [subject, rows_per_bucket]
    df.repartition(partitions, *keys).sortWithinPartitions(subject, *order).write.mode("overwrite").parquet(path)


def write_bucketed(df: DataFrame, table: str, path: str, subject: str, order: Sequence[str], buckets: int) -> None:
    """The same rows as a bucketed table: joins and groups on the subject then need no shuffle."""
    df.write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, subject).sortBy(*order).saveAsTable(table)


def bucketed(spark: SparkSession, df: DataFrame, table: str, path: str, subject: str, order: Sequence[str], buckets: int | None = None) -> DataFrame:
    """Write a bucketed, sorted table and read it: of two such tables with as many buckets, joins on the subject move no rows.

    The default number of buckets is that of shuffle partitions, so that tables of one session fit each other.
    """
    write_bucketed(df, table, path, subject, order, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
    return spark.table(table)


def write_index(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Task index under split=/task= folders; only the partitions that are written are replaced.

    Rows of a (split, task) meet in as few files as its size needs: adaptive execution splits a large one.
    """
    writer = df.hint("rebalance", F.col("split"), F.col("task")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("split", "task")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def read_index(spark: SparkSession, path: str, schema: str, splits: Sequence[str] = (), tasks: Sequence[str] = (), fmt: str = "parquet") -> DataFrame:
    """Index rows; splits and tasks asked for prune the folders read."""
    rows = spark.read.schema(schema).option("header", True).format(fmt).load(path)
    if splits:
        rows = rows.where(F.col("split").isin(*splits))
    return rows.where(F.col("task").isin(*tasks)) if tasks else rows


def write_records(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_records(spark: SparkSession, path: str, schema: str, array_file: bool = False) -> DataFrame:
    """Record files: one object per line, or (`array_file`) one JSON array per file."""
    return spark.read.schema(schema).option("multiLine", array_file).json(path)


def parsed_labels(df: DataFrame, column: str = "label", name: str = "labels") -> DataFrame:
    """Labels that are a number, a word or a list written as text, as an array of numbers (empty if none)."""
    text = F.trim(F.col(column).cast("string"))
    listed = F.from_json(text, "array<int>")
    single = F.array(text.try_cast("int"))
    return df.withColumn(
        name, F.filter(F.coalesce(F.when(text.startswith("["), listed).otherwise(single), F.array().cast("array<int>")), lambda x: x.isNotNull())
    )
