"""Timelines: source orderings, merging, blocks of equal source, and what comes before and after."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cohortline.functions import times
from cohortline.operators.ordered import Running, position, runs, scan, time_bucket

# Rank of the emergency tables within one stay.
EMERGENCY_RANK = {"edstays": 0, "triage": 1, "medrecon": 2, "pyxis": 3, "vitalsign": 4, "diagnosis": 5}
# Tables without a time of their own, in the order they are placed.
UNTIMED_TABLES = ("diagnoses_icd", "drgcodes")
# The time column of each source table.
TIME_COLUMN = {
    "omr": "chartdate", "pharmacy": "entertime", "poe": "ordertime", "procedures_icd": "chartdate",
    "prescriptions": "starttime", "services": "transfertime", "labevents": "charttime",
    "microbiologyevents": "charttime", "admissions": "admittime", "transfers": "intime", "emar": "charttime",
    "discharge": "charttime", "radiology": "charttime",
    "edstays": "intime", "triage": "charttime", "medrecon": "charttime", "pyxis": "charttime",
    "vitalsign": "charttime", "diagnosis": "charttime",
    "icustays": "intime", "chartevents": "charttime", "ingredientevents": "starttime",
    "datetimeevents": "charttime", "procedureevents": "starttime", "inputevents": "starttime",
    "outputevents": "charttime",
}
DROPPED_TABLES = ("hcpcsevents",)


def event_time(file_name: Column, attrs: Column) -> Column:
    """The time of a source row: the column its table names, read out of the attribute map."""
    names = F.create_map(*[F.lit(x) for pair in TIME_COLUMN.items() for x in pair])
    return times.parse_time(F.try_element_at(attrs, names[file_name]))


def emergency_times(df: DataFrame, stays: DataFrame) -> DataFrame:
    """Give emergency rows without time one: triage a second after arrival, diagnoses at departure.

    `df`: stay_id, file_name, time; `stays`: stay_id, intime, outtime.
    """
    joined = df.join(stays.select("stay_id", "intime", "outtime"), "stay_id", "left")
    synthetic = (
        F.when(F.col("file_name") == "triage", F.col("intime") + F.expr("INTERVAL 1 SECOND"))
        .when(F.col("file_name") == "diagnosis", F.col("outtime"))
        .otherwise(F.col("time"))
    )
    return joined.withColumn("time", synthetic).drop("intime", "outtime")


def emergency_order(df: DataFrame) -> DataFrame:
    """Sort keys of emergency rows: stay, then arrival and triage first, diagnoses last, table rank on ties."""
    name = F.col("file_name")
    place = F.when(name.isin("edstays", "triage"), 0).when(name == "diagnosis", 2).otherwise(1)
    rank = F.create_map(*[F.lit(x) for pair in EMERGENCY_RANK.items() for x in pair])
    return df.withColumn("sort_place", place).withColumn(
        "sort_time", F.when(place == 1, F.col("time"))
    ).withColumn("sort_rank", F.coalesce(rank[name], F.lit(999)))


def intensive_order(df: DataFrame) -> DataFrame:
    """Sort keys of intensive-care rows: admission, stay, the stay row first, then time."""
    return df.withColumn("sort_place", (F.col("file_name") != "icustays").cast("int")).withColumn(
        "sort_time", F.when(F.col("file_name") != "icustays", F.col("time"))
    )


def merge_sources(sources: Sequence[DataFrame]) -> DataFrame:
    """One table of all sources; columns a source lacks become null."""
    merged = sources[0]
    for other in sources[1:]:
        merged = merged.unionByName(other, allowMissingColumns=True)
    return merged.where(~F.col("file_name").isin(*DROPPED_TABLES))


def place_untimed(df: DataFrame) -> DataFrame:
    """Sort columns that put untimed rows after the last timed row of their admission.

    Demographic rows come first. Diagnoses follow the admission, DRG codes follow diagnoses; without a
    timed row of the same admission they go to the end. Needs subject_id, hadm_id, file_name, time.
    The last time per admission is a small aggregate, joined back.
    """
    last = df.where(F.col("time").isNotNull() & F.col("hadm_id").isNotNull()).groupBy("subject_id", "hadm_id").agg(
        F.max("time").alias("_last")
    )
    end = F.lit("9999-12-31 00:00:00").cast("timestamp_ntz")
    untimed = F.when(F.col("file_name") == UNTIMED_TABLES[0], 1).when(F.col("file_name") == UNTIMED_TABLES[1], 2).otherwise(3)
    placed = df.join(last, ["subject_id", "hadm_id"], "left")
    is_person = F.col("file_name") == "patients"
    return placed.select(
        *df.columns,
        F.when(is_person, 0).otherwise(1).alias("sort_person"),
        F.when(is_person, F.lit("0001-01-01 00:00:00").cast("timestamp_ntz"))
        .otherwise(F.coalesce("time", "_last", end)).alias("sort_time"),
        F.when(F.col("time").isNotNull() | is_person, 0).otherwise(untimed).alias("sort_untimed"),
    )


def number_events(df: DataFrame, order: Sequence[str], bucket_seconds: int, name: str = "position") -> DataFrame:
    """Position of each row in its subject's merged timeline, from 0."""
    return position(df, ["subject_id"], order, name, time_bucket(order[1], bucket_seconds), start=0)


def blocks(
    df: DataFrame, order: Sequence[str], bucket_seconds: int | None, first: Sequence[str] = (),
) -> DataFrame:
    """Consecutive rows of one source table as one block per subject.

    start is the first known time of the block, end its last, admission and the `first` columns are
    those of its first row. Blocks ignore admission limits. Items stay rows of their own (`block_items`),
    so a run of any length is never gathered in one cell. Without `bucket_seconds` timelines are cut by range.
    """
    place = F.struct(*order)
    numbered = block_items(df, order, bucket_seconds)
    return numbered.groupBy("subject_id", "event_idx").agg(
        F.min("file_name").alias("file_name"),
        F.min_by("time", F.when(F.col("time").isNotNull(), place)).alias("starttime"),
        F.max("time").alias("endtime"),
        F.min_by("hadm_id", place).alias("hadm_id"),
        *[F.min_by(c, place).alias(c) for c in first],
        F.count(F.lit(1)).alias("n_items"),
    )


def block_items(df: DataFrame, order: Sequence[str], bucket_seconds: int | None) -> DataFrame:
    """The rows with their block number."""
    bucket = None if bucket_seconds is None else time_bucket(order[0], bucket_seconds)
    return runs(df, ["subject_id"], order, "file_name", "event_idx", bucket)


IDX_BUCKET = 4096


def idx_bucket(column: str = "event_idx", width: int = IDX_BUCKET) -> Column:
    return F.floor(F.col(column) / F.lit(width))


def next_of_kind(
    blocks_df: DataFrame, keys: Sequence[str], kinds: Mapping[str, Column], values: Sequence[str]
) -> DataFrame:
    """For each block, the `values` of the next block (after it, same keys) where a condition holds.

    One descending scan for all kinds; each result is a struct column, null when there is none.
    """
    steps = [
        Running(name, "last", F.when(condition, F.struct(*values)), inclusive=False) for name, condition in kinds.items()
    ]
    return scan(blocks_df, keys, ["event_idx"], steps, idx_bucket(), descending=True)


def last_of_kind(
    blocks_df: DataFrame, keys: Sequence[str], kinds: Mapping[str, Column], values: Sequence[str], inclusive: bool = False
) -> DataFrame:
    """For each block, the `values` of the latest block so far where a condition holds."""
    steps = [
        Running(name, "last", F.when(condition, F.struct(*values)), inclusive=inclusive)
        for name, condition in kinds.items()
    ]
    return scan(blocks_df, keys, ["event_idx"], steps, idx_bucket())
