"""Streams that keep the incremental aggregates up to date; each equals its batch twin on the same rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from cohortline.operators import phenotype as ph
from cohortline.session import cut
from cohortline.sources.versions import Version, VersionedTable


def file_stream(spark: SparkSession, folder: str, pattern: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files that appear in a folder, as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def count_stream(rows: DataFrame, keys: Sequence[str] = ("dataset", "table", "item", "unit")) -> DataFrame:
    """Running item and unit counts."""
    return ph.item_unit_counts(rows, keys)


def _each_batch(stream: DataFrame, checkpoint: str, mode: str, table: VersionedTable, save: Callable[[DataFrame, Version], dict[str, int] | None]) -> StreamingQuery:
    """Give each micro-batch to `save`, which returns the next version's runs; a batch that a version has noted is not saved again."""

    def run(batch: DataFrame, number: int) -> None:
        now = table.version()
        if int(now.note.get("batch", -1)) >= number:
            batch.write.format("noop").mode("overwrite").save()  # the stream's own state still moves on
            return
        runs = save(batch, now)
        table.commit(now, now.runs if runs is None else runs, {**now.note, "batch": number})
        table.tidy()

    return (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(run).start()
    )


def newest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The row of the latest batch per key (one aggregate, no window)."""
    values = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("row")).select(*keys, *[F.col(f"row.{c}").alias(c) for c in values])


def keep_latest(stream: DataFrame, output: str, checkpoint: str, keys: Sequence[str]) -> StreamingQuery:
    """Run an updating aggregate over what is there, into a versioned table of runs.

    A micro-batch is one run; runs are folded by key as they grow in number, so few folders stand however many batches
    there were, and readers see whole batches only. One stream writes a table.
    """
    table, spark = VersionedTable(stream.sparkSession, output), stream.sparkSession
    schema = spark.createDataFrame([], stream.schema).withColumn("batch", F.lit(0).cast("bigint")).schema

    def save(batch: DataFrame, now: Version) -> dict[str, int] | None:
        run = table.new_run(batch.withColumn("batch", F.lit(now.number).cast("bigint")))
        if spark.read.schema(schema).parquet(f"{output}/{run}").isEmpty():
            return None
        return table.folded({**now.runs, run: 0}, lambda rows: newest(rows, keys), schema)

    return _each_batch(stream, checkpoint, "update", table, save)


def latest(spark: SparkSession, output: str, keys: Sequence[str]) -> DataFrame:
    """The newest row per key of the runs that count."""
    table = VersionedTable(spark, output)
    return newest(spark.read.parquet(*table.folders()), keys).drop("batch")


#: Rows that one task aggregates
TASK_ROWS = 500_000


def dealt(rows: DataFrame, n_rows: int, key: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """Rows shuffled by `key`, about `task_rows` for a task where the session's shuffle partitions would hold more."""
    parts = -(-n_rows // task_rows)
    return rows.repartition(parts, key) if parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows.repartition(key)


def support_stream(rows: DataFrame, output: str, checkpoint: str, keys: Sequence[str] = ("item_key", "unit_key"), batch_rows: int = 0) -> StreamingQuery:
    """Running encounter support of a stream's rows, into a versioned table of supports.

    Supports of two parts merge, so what is known is the table itself and the stream keeps no state: a micro-batch's own supports
    are a run, and runs are merged as they grow in number. An encounter's rows may come in any micro-batches. `batch_rows` is about
    how many rows one of them has, where that is known.
    """
    table, spark = VersionedTable(rows.sparkSession, output), rows.sparkSession

    def save(batch: DataFrame, now: Version) -> dict[str, int]:
        run = table.new_run(ph.encounter_support(dealt(batch, batch_rows, "encounter"), keys))
        schema = spark.read.parquet(f"{output}/{run}").schema
        return table.folded({**now.runs, run: 0}, lambda parts: merged(parts, keys), schema)

    return _each_batch(rows, checkpoint, "append", table, save)


def supports(spark: SparkSession, output: str, keys: Sequence[str] = ("item_key", "unit_key")) -> DataFrame:
    """The supports so far: those of the runs that count, merged."""
    return merged(spark.read.parquet(*VersionedTable(spark, output).folders()), keys)


def merged(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Supports in written runs, merged."""
    return ph.merged_support(dealt(parts, parts.count(), "encounter"), keys)


#: Hash prefixes by which the known texts lie on disk
TEXT_BUCKETS = 64


def harvest_texts(stream: DataFrame, column: str, output: str, checkpoint: str, buckets: int = TEXT_BUCKETS) -> StreamingQuery:
    """Texts of a stream that no earlier batch had, each once, into a versioned table of `column`, hash and bucket.

    What is known is the table itself, so the stream keeps no state: a batch's distinct texts are held against the hashes of
    their buckets, and only where a hash is known against the texts themselves.
    """
    table, spark = VersionedTable(stream.sparkSession, output), stream.sparkSession
    schema = T.StructType([T.StructField(column, T.StringType()), T.StructField("hash", T.LongType()), T.StructField("bucket", T.LongType())])

    def save(batch: DataFrame, now: Version) -> dict[str, int] | None:
        texts = batch.where(F.col(column).isNotNull()).select(column).distinct().withColumn("hash", F.xxhash64(column))
        texts = cut(texts.withColumn("bucket", F.pmod("hash", F.lit(buckets))))
        known = table.read(schema, now)
        seen = known.select("bucket", "hash").join(texts.select("bucket", "hash"), ["bucket", "hash"], "left_semi").distinct()
        met = texts.join(seen, ["bucket", "hash"], "left_semi").join(known, ["bucket", "hash", column], "left_anti")
        fresh = cut(texts.join(seen, ["bucket", "hash"], "left_anti").unionByName(met))
        if fresh.isEmpty():
            return None
        run = table.new_run(fresh.select(*schema.names).repartition("bucket").sortWithinPartitions("bucket", "hash"))
        return table.folded({**now.runs, run: 0}, lambda rows: rows.repartition("bucket").sortWithinPartitions("bucket", "hash"), schema)

    return _each_batch(stream.select(column), checkpoint, "append", table, save)


def harvested(spark: SparkSession, output: str) -> DataFrame:
    """The texts so far."""
    return spark.read.parquet(*VersionedTable(spark, output).folders()).drop("hash", "bucket")


def append_rows(stream: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .format("parquet").option("path", output).start()
    )
