"""Follow-up center: window labels, death and drug-level durations, classification index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cohortline.functions import numbers, text, times, values

# Prediction points as (name, cutoff day, label window) and drug-level stages.
PREDICTION_POINTS = (("day30", 30, "30-180d"), ("day180", 180, "180-365d"), ("day365", 365, "365d+"))
DRUG_STAGES = ((0, 0, 31, 31), (1, 31, 181, 150), (2, 181, 366, 185))
# Metrics of the classification index.
METRICS = ("ALB", "ALP", "CR", "Glucose", "HB", "INR", "N_Percent", "PLT", "PT", "TP", "Uric_Acid", "WBC")


def label_columns(columns: Sequence[str], whitelist: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """Label columns by their suffix, and the whitelisted ones that are not there."""
    found = sorted(c for c in columns if c.endswith("_label"))
    if not whitelist:
        return found, []
    return [c for c in whitelist if c in found], [c for c in whitelist if c not in found]


def window_labels(rows: DataFrame, labels: Sequence[str], subject: str = "subject", day: str = "day") -> DataFrame:
    """Any-positive label per subject, day window and metric; unseen combinations have no row."""
    long = rows.select(subject, F.col(day), *[F.col(c).cast("string").alias(c) for c in labels]).unpivot(
        [subject, day], list(labels), "column", "raw"
    )
    known = long.withColumns({
        "window": values.day_window(F.col(day)), "number": numbers.to_number(F.col("raw")),
        "metric": F.regexp_replace("column", "_label$", ""),
    }).where(F.col("window").isNotNull() & F.col("number").isNotNull())
    return known.groupBy(subject, "window", "metric").agg(F.max((F.col("number") > 0).cast("int")).alias("label"))


def wide_labels(long: DataFrame, metrics: Sequence[str], subject: str = "subject") -> DataFrame:
    """One column per window and metric, null where unseen."""
    names = [(w, m) for w, _, _ in values.DAY_WINDOWS for m in metrics]
    return long.groupBy(subject).agg(
        *[F.max(F.when((F.col("window") == w) & (F.col("metric") == m), F.col("label"))).alias(f"{w}_{m}") for w, m in names]
    )


def any_positive(rows: DataFrame, column: str, subject: str = "subject", day: str = "day") -> DataFrame:
    """Whether a subject ever has a positive value on a day inside any window, null if never measured."""
    number = numbers.to_number(F.col(column))
    inside = values.day_window(F.col(day)).isNotNull()
    return rows.groupBy(subject).agg(F.max(F.when(inside & number.isNotNull(), (number > 0).cast("int"))).alias("abnormal"))


def death_labels(subjects: DataFrame, info: DataFrame, subject: str = "subject") -> DataFrame:
    """1 for deceased, 0 for known alive, null for subjects without an information row."""
    flags = info.select(subject, text.is_deceased(F.col("is_deceased")).cast("int").alias("death_survival"))
    return subjects.join(flags, subject, "left")


def classification_index(labels: DataFrame, rows: DataFrame, info: DataFrame) -> DataFrame:
    """One sample per subject, prediction point and metric with a label and a follow-up row after birth.

    `labels`: subject, window, metric, label; `rows`: subject, day, report_time; `info`: subject, birth_time.
    """
    per_window = {w: (n, c) for n, c, w in PREDICTION_POINTS}
    names = F.create_map(*[F.lit(x) for w, (n, _) in per_window.items() for x in (w, n)])
    cutoffs = F.create_map(*[F.lit(x) for w, (_, c) in per_window.items() for x in (w, c)])
    asked = labels.where(F.col("window").isin(*per_window) & F.col("label").isNotNull()).withColumns({
        "prediction_point": names[F.col("window")], "cutoff_day": cutoffs[F.col("window")],
    })
    born = rows.join(info.where(F.col("birth_time").isNotNull()), "subject").where(F.col("report_time") >= F.col("birth_time"))
    seen = born.groupBy("subject").agg(F.min("day").alias("first_valid_day"))
    valid = asked.join(seen, "subject").where(F.col("first_valid_day") <= F.col("cutoff_day"))
    return valid.select(
        "subject", "prediction_point", "cutoff_day", F.col("window").alias("label_prefix"), "metric",
        F.concat_ws("_", "window", "metric").alias("label_col"), F.col("label").cast("int").alias("label"),
    )


def surgery_dates(rows: DataFrame) -> DataFrame:
    """Operation time per subject: the first dated report less its post-operative day. Subjects without one are left out."""
    dated = rows.where(F.col("day").isNotNull() & F.col("report_time").isNotNull())
    first = dated.groupBy("subject").agg(F.min(F.struct("day", "report_time")).alias("_first"))
    return first.select(
        "subject", times.add_days(F.col("_first.report_time"), -F.col("_first.day").cast("double")).alias("surgery_time")
    )


def first_drug_days(rows: DataFrame, doses: Sequence[str], level: str) -> DataFrame:
    """First day with a positive dose of any of the drugs or with a measured level."""
    def positive(column: str) -> Column:
        return F.exists(F.regexp_extract_all(F.col(column).cast("string"), F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)), lambda x: x.cast("double") > 0)

    dosed = F.lit(False)
    for column in doses:
        if column in rows.columns:
            dosed = dosed | F.coalesce(positive(column), F.lit(False))
    measured = F.trim(F.coalesce(F.col(level).cast("string"), F.lit(""))) != "" if level in rows.columns else F.lit(False)
    return rows.groupBy("subject").agg(
        F.least(F.min(F.when(dosed, F.col("day"))), F.min(F.when(measured, F.col("day")))).alias("first_drug_day")
    )


def death_durations(rows: DataFrame, info: DataFrame, horizon_days: int) -> DataFrame:
    """Death duration per subject, or the reason why there is none.

    The prediction day is the first non-negative follow-up day. All day figures are one aggregate per subject.
    """
    days = rows.groupBy("subject").agg(
        F.min(F.when(F.col("day") >= 0, F.col("day"))).alias("prediction_day"), F.max("day").alias("last_day"),
        F.count("day").alias("n_days"),
    )
    joined = days.join(surgery_dates(rows), "subject", "left").join(info, "subject", "left")
    deceased = text.is_deceased(F.col("is_deceased"))
    death_day = F.when(
        deceased, F.greatest(times.days_between(F.col("surgery_time"), F.col("death_time")), F.lit(0.0))
    )
    staged = joined.withColumns({"deceased": deceased, "death_day": death_day}).withColumn(
        "stage_end_day", F.col("prediction_day") + F.lit(float(horizon_days))
    )
    happened = F.coalesce(F.col("death_day") <= F.col("stage_end_day"), F.lit(False))
    observed = F.when(happened, F.col("death_day")).otherwise(F.least("last_day", "stage_end_day"))
    reason = (
        F.when(F.col("n_days") == 0, "no_followup_days")
        .when(F.col("surgery_time").isNull(), "no_report_date")
        .when(F.col("deceased") & F.col("death_time").isNull(), "missing_death_time")
        .when(F.col("prediction_day").isNull(), "no_postoperative_followup")
        .when(F.col("death_day") <= F.col("prediction_day"), "death_before_prediction")
        .when(F.col("death_day").isNull() & (F.col("last_day") <= F.col("prediction_day")), "no_followup_after_prediction")
        .when(observed <= F.col("prediction_day"), "nonpositive_duration")
    )
    kept = reason.isNull()
    return staged.select(
        "subject", F.lit("death_survival").alias("task"), reason.alias("skipped"),
        F.when(kept, F.round("prediction_day", 6)).alias("prediction_day"), F.when(kept, F.round("stage_end_day", 6)).alias("stage_end_day"),
        F.when(kept, F.round(observed, 6)).alias("observed_day"),
        F.when(kept, F.round(observed - F.col("prediction_day"), 6)).alias("time_to_event"),
        F.when(kept, happened.cast("int")).alias("event_observed"), F.lit(horizon_days).alias("num_bins"),
    )


def drug_level_durations(rows: DataFrame, event_label: str, stages: Sequence[tuple[int, int, int, int]] = DRUG_STAGES) -> DataFrame:
    """Duration to the first abnormal level after the first day of each stage; stages without one are left out."""
    stage = F.explode(F.array(*[
        F.struct(F.lit(i).alias("stage_id"), F.lit(float(a)).alias("start_day"), F.lit(float(z)).alias("end_day"), F.lit(n).alias("num_bins"))
        for i, a, z, n in stages
    ]))
    staged = rows.where(F.col("day").isNotNull()).withColumn("s", stage).where(
        (F.col("day") >= F.col("s.start_day")) & (F.col("day") < F.col("s.end_day"))
    ).select("subject", "day", text.is_positive(F.col(event_label)).alias("event"), "s.*")
    ends = staged.groupBy("subject", "stage_id", "start_day", "end_day", "num_bins").agg(
        F.min("day").alias("prediction_day"), F.max("day").alias("last_day")
    )
    events = staged.where("event").select("subject", "stage_id", "day").join(
        ends.select("subject", "stage_id", "prediction_day"), ["subject", "stage_id"]
    ).where(F.col("day") > F.col("prediction_day")).groupBy("subject", "stage_id").agg(F.min("day").alias("event_day"))
    joined = ends.join(events, ["subject", "stage_id"], "left")
    observed = F.coalesce("event_day", "last_day")
    return joined.where(observed > F.col("prediction_day")).select(
        "subject", F.lit("tacrolimus_abnormal_survival").alias("task"), "stage_id", "start_day", "end_day",
        F.round("prediction_day", 6).alias("prediction_day"), F.round(observed, 6).alias("observed_day"),
        F.round(observed - F.col("prediction_day"), 6).alias("time_to_event"),
        F.col("event_day").isNotNull().cast("int").alias("event_observed"),
        F.round(F.col("end_day") - F.col("prediction_day"), 6).alias("stage_end_horizon"), "num_bins",
    )


def skip_reasons(durations: DataFrame) -> DataFrame:
    """How many subjects were left out, per reason."""
    return durations.where(F.col("skipped").isNotNull()).groupBy("skipped").agg(F.count(F.lit(1)).alias("subjects"))


def index_range_rows(labels: DataFrame, rows: DataFrame, ranges: str = "input_idx_ranges") -> DataFrame:
    """Rows of a trial timeline at the label's parsed index ranges."""
    known = text.clean_text(F.col(ranges), text.MISSING_RANGE)
    picked = labels.withColumn("row_idx", F.explode(values.index_ranges(known).cast("array<bigint>")))
    return picked.join(rows, ["subject", "row_idx"])


def clean_labels(labels: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Drop repeated labels, and all labels of a key whose values conflict: one aggregate, no window."""
    agreed = labels.groupBy(*keys).agg(F.min(value).alias(value), F.max(value).alias("_max"))
    return agreed.where(F.col(value) == F.col("_max")).drop("_max")
