"""Time-to-event targets: one duration rule, and its piecewise arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cohortline.functions import times


def with_duration(
    df: DataFrame, prediction: Column, event: Column, censor: Column, observed: Column, horizon_days: Column
) -> DataFrame:
    """Add the duration columns; drop rows whose event precedes the prediction or whose time is not positive.

    An event counts only up to the horizon. A censored row carries the time it was observed until as its
    censor time, an observed row the original one.
    """
    horizon = times.add_days(prediction, horizon_days.cast("double"))
    happened = F.coalesce(observed, F.lit(False)) & event.isNotNull() & (event <= horizon)
    staged = df.withColumns({
        "_prediction": prediction, "_event": event, "_censor": censor, "_horizon": horizon_days.cast("double"),
        "_happened": happened, "_until": F.when(happened, event).otherwise(F.least(censor, horizon)),
    })
    valid = staged.where(F.col("_prediction").isNotNull() & F.col("_horizon").isNotNull()).where(
        (F.col("_event").isNull() | (F.col("_event") > F.col("_prediction"))) & (F.col("_until") > F.col("_prediction"))
    )
    return valid.select(
        *df.columns,
        times.time_text(F.col("_prediction")).alias("prediction_time"),
        F.coalesce(times.time_text(F.when(F.col("_happened"), F.col("_event"))), F.lit("")).alias("event_time"),
        F.coalesce(times.time_text(F.when(F.col("_happened"), F.col("_censor")).otherwise(F.col("_until"))), F.lit(""))
        .alias("censor_time"),
        F.round(times.days_between(F.col("_prediction"), F.col("_until")), 6).alias("time_to_event"),
        F.col("_happened").cast("int").alias("event_observed"),
        F.round("_horizon", 6).alias("horizon_days"),
        F.lit("day").alias("time_unit"),
    )


def bin_count(horizon: Column, max_bins: int) -> Column:
    return F.greatest(F.lit(1), F.least(F.ceil(horizon).cast("int"), F.lit(max_bins)))


def piecewise_target(time: Column, event: Column, horizon: Column, max_bins: int) -> dict[str, Column]:
    """Exposure, event bin and mask arrays over unit bins (k, k + 1], `max_bins` long.

    The time is held to the row's own number of bins. Exposure of a bin is the part of it lived through;
    an event falls in the bin that holds the held time.
    """
    bins = bin_count(horizon, max_bins)
    held = F.least(F.greatest(time, F.lit(0.0)), bins.cast("double"))
    index = F.sequence(F.lit(0), F.lit(max_bins - 1))
    hit = F.when(F.coalesce(event, F.lit(False)) & (held > 0), F.least(F.ceil(held).cast("int") - 1, bins - 1))
    one, none = F.lit(1.0).cast("float"), F.lit(0.0).cast("float")
    return {
        "exposure": F.transform(
            index, lambda i: F.when(i < bins, F.least(F.greatest(held - i, F.lit(0.0)), F.lit(1.0))).otherwise(0.0).cast("float")
        ),
        "event_bins": F.transform(index, lambda i: F.when(F.coalesce(i == hit, F.lit(False)), one).otherwise(none)),
        "stage_mask": F.transform(index, lambda i: F.when(i < bins, one).otherwise(none)),
    }


def stage_metadata(stage_end: Column, stage_id: Column, max_bins: int) -> Column:
    """Metadata row of the query form: stage end in the first cell, stage number in the second."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(max_bins - 1)),
        lambda i: F.when(i == 0, stage_end.cast("float")).when(i == 1, stage_id.cast("float")).otherwise(
            F.lit(0.0).cast("float")
        ),
    )
