"""Incremental refresh: finished sources are skipped, changed ones are rebuilt, and each change becomes valid at once."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from cohortline.session import cut
from cohortline.sources.versions import Version, VersionedTable


def source_manifest(files: DataFrame, parameters: Mapping[str, object]) -> DataFrame:
    """One row per source file: path, size, time and a fingerprint over them and the parameters.

    `files` is any file-based DataFrame; only its metadata columns are read.
    """
    meta = files.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_modification_time").alias("changed"),
    ).distinct()
    settings = hashlib.sha256(json.dumps(dict(parameters), sort_keys=True).encode()).hexdigest()
    print_of = F.sha2(F.concat_ws("|", "path", F.col("size").cast("string"), F.unix_micros("changed").cast("string"), F.lit(settings)), 256)
    return meta.withColumn("fingerprint", print_of)


def pending(manifest: DataFrame, done: DataFrame) -> DataFrame:
    """Sources whose fingerprint is not among the finished ones."""
    return manifest.join(done.select("path", "fingerprint"), ["path", "fingerprint"], "left_anti")


#: Runs of output that are folded into one when there are so many
MOST_RUNS = 24
MANIFEST = "path string, fingerprint string, source string, run string"


def _manifest(table: VersionedTable, version: Version) -> DataFrame:
    """One row per finished source: its file, fingerprint and the run that holds its output."""
    runs = [r for r in version.runs if r.startswith("manifest")]
    return table.spark.read.schema(MANIFEST).parquet(*[f"{table.path}/{r}" for r in runs]) if runs else table.spark.createDataFrame([], MANIFEST)


def finished(spark: SparkSession, path: str) -> DataFrame:
    """path, fingerprint of the sources whose output stands in the newest version."""
    table = VersionedTable(spark, path)
    return _manifest(table, table.version()).select("path", "fingerprint")


def _output(table: VersionedTable, version: Version, manifest: DataFrame) -> DataFrame | None:
    runs = [r for r in version.runs if r.startswith("data")]
    if not runs:
        return None
    schema = T.StructType.fromJson(version.note["schema"])
    rows = None
    for run in runs:
        # the folder names give the source, as text
        part = table.spark.read.schema(schema).parquet(f"{table.path}/{run}").withColumn("_run", F.lit(run))
        rows = part if rows is None else rows.unionByName(part)
    valid = manifest.select("source", F.col("run").alias("_run"))
    return rows.join(valid, ["source", "_run"], "left_semi").drop("_run")


def current(spark: SparkSession, output: str) -> DataFrame | None:
    """The rows of all sources as the newest version has them, with their `source`; None before the first build.

    Readers go through the manifest: a run that breaks off, or one under way, doesn't show.
    """
    table = VersionedTable(spark, output)
    version = table.version()
    return _output(table, version, _manifest(table, version))


def refresh(
    spark: SparkSession, files: DataFrame, parameters: Mapping[str, object], build: Callable[[DataFrame], DataFrame], output: str
) -> int:
    """Rebuild the output of changed sources; returns how many were rebuilt.

    `build` takes the rows of the pending files (with a `source` column) and gives rows with that column. Its rows go to a new run
    beside the old ones, the next version's manifest names for each source the run that counts, and with that version's file both
    become valid at once. So a source that now gives nothing, or is no more, has no rows from then on, and a run that breaks off
    anywhere changes nothing and is done again. Folders of older versions go afterwards, all but the last one's.
    """
    table = VersionedTable(spark, output)
    version = table.version()
    done = _manifest(table, version)
    now = cut(source_manifest(files, parameters))
    todo = cut(pending(now, done).select("path", "fingerprint"))
    kept = cut(done.join(now.select("path", "fingerprint"), ["path", "fingerprint"], "left_semi"))
    changed = todo.count()
    if not changed and kept.count() == done.count():
        return 0
    runs, note = {}, dict(version.note)
    listed = kept
    if changed:
        rows = files.withColumn("path", F.col("_metadata.file_path")).join(todo.select("path"), "path", "left_semi")
        built = build(rows.withColumn("source", F.md5("path")).drop("path"))
        note["schema"] = built.schema.jsonValue()
        run = table.new_run(built, "data", ["source"])
        runs[run] = 0
        listed = kept.select("path", "fingerprint", "source", "run").unionByName(todo.select("path", "fingerprint", F.md5("path").alias("source"), F.lit(run).alias("run")))
    runs |= {r["run"]: 0 for r in kept.select("run").distinct().collect()}
    if len(runs) > MOST_RUNS:
        whole = _output(table, Version(version.number, runs, note), listed)
        merged = table.new_run(whole, "data", ["source"])
        listed, runs = listed.withColumn("run", F.lit(merged)), {merged: 0}
    runs[table.new_run(listed.select("path", "fingerprint", "source", "run"), "manifest")] = 0
    table.commit(version, runs, note)
    table.tidy()
    return changed
