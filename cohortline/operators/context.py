"""Context windows around an anchor block, as ordered look-ups instead of self joins.

"Last block that starts before T" is a running maximum of the block number over blocks sorted by start
time, read at T. So no (anchor, block) pair is ever formed, however long a subject's timeline is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cohortline.operators.ordered import Running, lookup, scan
from cohortline.operators.timeline import idx_bucket

CONTEXT_HOURS = 24
LONG_BUCKET = 28 * 86_400


def last_starting_before(
    anchors: DataFrame | Column, blocks: DataFrame, keys: Sequence[str], limit: Column, name: str = "context_end",
    values: Sequence[str] = ("starttime",), bucket_seconds: int = LONG_BUCKET,
) -> DataFrame:
    """Latest block (largest number) with the anchor's keys that starts strictly before `limit` and follows the anchor.

    Anchors are a table, or a condition on the blocks, which are then read once. Adds `name` and `{name}_{value}`
    columns, null when no block qualifies.
    """
    best = Running("_found", "max", F.when(F.col("_p_event_idx").isNotNull(), F.struct(
        F.col("_p_event_idx").alias("idx"), *[F.col(f"_p_{v}").alias(v) for v in values])))
    held = ["event_idx", *values]
    if isinstance(anchors, DataFrame):
        columns = anchors.columns
        points = blocks.where(F.col("starttime").isNotNull()).select(*keys, *held, F.col("starttime").alias("_start"))
        found = lookup(anchors.withColumn("_limit", limit), points, keys, "_limit", "_start", [best], strict=True, bucket_seconds=bucket_seconds, held=held)
    else:
        columns = blocks.columns
        found = lookup(anchors, blocks, keys, limit, "starttime", [best], strict=True, bucket_seconds=bucket_seconds,
                       held=held, is_point=F.col("starttime").isNotNull())
    follows = F.col("_found.idx") > F.col("event_idx")
    return found.select(
        *columns, F.when(follows, F.col("_found.idx")).alias(name),
        *[F.when(follows, F.col(f"_found.{v}")).alias(f"{name}_{v}") for v in values],
    )


def forward_context(anchors: DataFrame | Column, blocks: DataFrame, hours: int = CONTEXT_HOURS) -> DataFrame:
    """Last same-admission block that starts less than `hours` after the anchor."""
    limit = F.col("starttime") + F.make_dt_interval(hours=F.lit(hours))
    return last_starting_before(anchors, blocks, ["subject_id", "hadm_id"], limit)


def until_time(anchors: DataFrame | Column, blocks: DataFrame, limit: Column) -> DataFrame:
    """Last block of the subject, any admission, that starts before a given time."""
    return last_starting_before(anchors, blocks, ["subject_id"], limit)


def backward_context(anchors: DataFrame | Column, blocks: DataFrame, hours: int = CONTEXT_HOURS) -> DataFrame:
    """Earliest same-admission block (not the first of all) that starts less than `hours` before the anchor."""
    keys, held = ["subject_id", "hadm_id"], ["event_idx"]
    able = (F.col("event_idx") > 0) & F.col("starttime").isNotNull()
    limit = F.col("starttime") - F.make_dt_interval(hours=F.lit(hours))
    first = Running("_found", "min", F.col("_p_event_idx"))
    if isinstance(anchors, DataFrame):
        columns = anchors.columns
        points = blocks.where(able).select(*keys, *held, F.col("starttime").alias("_start"))
        found = lookup(anchors.withColumn("_limit", limit), points, keys, "_limit", "_start", [first], strict=True, after=True,
                       bucket_seconds=LONG_BUCKET, held=held)
    else:
        columns = blocks.columns
        found = lookup(anchors, blocks, keys, limit, "starttime", [first], strict=True, after=True, bucket_seconds=LONG_BUCKET, held=held, is_point=able)
    return found.select(*columns, F.when(F.col("_found") < F.col("event_idx"), F.col("_found")).alias("context_begin"))


def anchor_time_of_untimed(blocks: DataFrame, untimed: Sequence[str]) -> DataFrame:
    """Blocks of untimed tables take the start time of the block before them, to anchor a context."""
    before = Running("_before", "last", F.struct("starttime"), inclusive=False)
    stepped = scan(blocks, ["subject_id"], ["event_idx"], [before], idx_bucket())
    taken = F.when(F.col("file_name").isin(*untimed), F.col("_before.starttime")).otherwise(F.col("starttime"))
    return stepped.withColumn("starttime", taken).drop("_before")


def between_discharges(blocks: DataFrame, tabular: Sequence[str]) -> DataFrame:
    """Context of each discharge: after the previous discharge, or after its admission if there is none.

    Kept only with an admission block of the same admission before it and at least one tabular block inside.
    Adds admissions_id, last_discharge_id, context_begin, context_end.
    """
    is_tabular = F.col("file_name").isin(*tabular).cast("bigint")
    seen = scan(
        blocks, ["subject_id"], ["event_idx"],
        [
            Running("_before", "sum", is_tabular, inclusive=False),
            Running("_until", "sum", is_tabular, inclusive=True),
        ],
        idx_bucket(),
        then=[Running("_discharge", "last", F.when(F.col("file_name") == "discharge", F.struct("event_idx", "_until")),
                      inclusive=False)],
    )
    # the admission is looked up within its own admission id, so its scan key is (subject, admission)
    admitted = scan(
        seen.where(F.col("file_name").isin("discharge", "admissions") & F.col("hadm_id").isNotNull()),
        ["subject_id", "hadm_id"], ["event_idx"],
        [Running("_admission", "last", F.when(F.col("file_name") == "admissions", F.struct("event_idx", "_until")),
                 inclusive=False)],
        idx_bucket(),
    )
    start = F.coalesce(F.col("_discharge"), F.col("_admission"))
    inside = F.col("_before") - start["_until"]
    return (
        admitted.where((F.col("file_name") == "discharge") & F.col("_admission").isNotNull() & (inside > 0))
        .select(
            *blocks.columns, F.col("_admission.event_idx").alias("admissions_id"),
            F.col("_discharge.event_idx").alias("last_discharge_id"),
            (start["event_idx"] + 1).alias("context_begin"), F.col("event_idx").alias("context_end"),
        )
    )


def seen_so_far(blocks: DataFrame) -> DataFrame:
    """Last admission and last discharge block up to each block, as (event_idx, hadm_id) structs."""
    steps = [
        Running("last_admission", "last", F.when(F.col("file_name") == "admissions", F.struct("event_idx", "hadm_id"))),
        Running("last_discharge", "last", F.when(F.col("file_name") == "discharge", F.struct("event_idx", "hadm_id"))),
    ]
    return scan(blocks, ["subject_id"], ["event_idx"], steps, idx_bucket())


def period_range(labels: DataFrame, rows: DataFrame, bucket_seconds: int = LONG_BUCKET) -> DataFrame:
    """Rows a label may use: the subject's first non-person row up to the last that starts at or before its time.

    `labels`: subject_id, prediction_time; `rows`: subject_id, row_idx, omop_table, start.
    """
    usable = rows.where(F.col("omop_table") != "person")
    first = usable.groupBy("subject_id").agg(F.min("row_idx").alias("period_begin"))
    points = usable.where(F.col("start").isNotNull()).select("subject_id", F.col("start").alias("at"), "row_idx")
    found = lookup(
        labels, points, ["subject_id"], "prediction_time", "at",
        [Running("period_end", "max", F.col("_p_row_idx"))], bucket_seconds=bucket_seconds,
    )
    return found.where(F.col("period_end").isNotNull()).join(first, "subject_id")


def visit_slices(
    visits: DataFrame, rows: DataFrame, min_rows: int, bucket_seconds: int = LONG_BUCKET
) -> DataFrame:
    """Rows that start inside each visit, as first and last row number and their count.

    Row numbers follow start time, so a visit's rows are those counted up to its end less those before its
    start: two look-ups, no join of visits with rows. `visits`: subject_id, visit_idx, visit_start, visit_end.
    """
    usable = rows.where(~F.col("omop_table").isin("person", "note") & F.col("start").isNotNull()).select(
        "subject_id", F.col("start").alias("at"), "row_idx", F.lit(1).cast("bigint").alias("one")
    )
    valid = visits.where(F.col("visit_start") <= F.col("visit_end"))
    ended = lookup(
        valid, usable, ["subject_id"], "visit_end", "at",
        [Running("period_end", "max", F.col("_p_row_idx")), Running("_until_end", "sum", F.col("_p_one"))],
        bucket_seconds=bucket_seconds,
    )
    begun = lookup(
        ended, usable, ["subject_id"], "visit_start", "at", [Running("_before_start", "sum", F.col("_p_one"))],
        strict=True, bucket_seconds=bucket_seconds,
    )
    first = lookup(
        begun, usable, ["subject_id"], "visit_start", "at", [Running("period_begin", "min", F.col("_p_row_idx"))],
        after=True, bucket_seconds=bucket_seconds,
    )
    counted = first.withColumn("n_rows", F.col("_until_end") - F.col("_before_start"))
    return counted.where(F.col("n_rows") >= min_rows).drop("_until_end", "_before_start")
