"""Survival metrics: curves, concordance, time-dependent AUC, Brier score and calibration.

Curves live on distinct times. Concordance counts pairs of lower risk and later time without forming them (`dominance`).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from cohortline.operators.dominance import PART_ROWS, by_key, lower_and_later
from cohortline.operators.ordered import Running, lookup, position, scan
from cohortline.session import cut

TIE = 1e-8


def hazard_until(hazards: Column, time: Column) -> Column:
    """Cumulative hazard of unit bins up to a time."""
    parts = F.transform(hazards, lambda h, i: h * F.least(F.greatest(time - i, F.lit(0.0)), F.lit(1.0)))
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)


def cumulative(hazards: Column) -> Column:
    """Sums of the hazards before each unit bin, and of all."""
    start = F.struct(F.lit(0.0).alias("sum"), F.array(F.lit(0.0)).alias("all"))
    step = lambda a, h: F.struct((a["sum"] + h).alias("sum"), F.concat(a["all"], F.array(a["sum"] + h)).alias("all"))
    return F.aggregate(hazards, start, step, lambda a: a["all"])


def risk_by(sums: Column, hazards: Column, time: Column) -> Column:
    """`risk_at` from the hazards' sums, whatever their number."""
    whole = F.floor(time).cast("int")
    inside = F.get(sums, whole) + F.get(hazards, whole) * (time - whole)
    return F.lit(1.0) - F.exp(-F.when(time <= 0, 0.0).when(whole >= F.size(hazards), F.get(sums, F.size(hazards))).otherwise(inside))


def risk_at(hazards: Column, time: Column) -> Column:
    return F.lit(1.0) - F.exp(-hazard_until(hazards, time))


def mean_hazard(hazards: Column, start: Column, end: Column) -> Column:
    return (hazard_until(hazards, end) - hazard_until(hazards, start)) / (end - start)


def _curve_counts(df: DataFrame, keys: Sequence[str], time: str, event: str) -> DataFrame:
    """Distinct times with events, censored, and rows at risk."""
    points = df.groupBy(*keys, F.col(time).alias("time")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(event) == 1).alias("events")
    )
    total = points.groupBy(*keys).agg(F.sum("n").alias("_total"))
    before = scan(points, keys, ["time"], [Running("_before", "sum", F.col("n"), inclusive=False)], F.floor(F.col("time")))
    return before.join(total, list(keys)).withColumn("at_risk", F.col("_total") - F.col("_before")).drop("_total", "_before")


def _running_product(curve: DataFrame, keys: Sequence[str], factor: Column) -> DataFrame:
    """Running product of factors in [0, 1]: a sum of logs, and zero from the first zero factor on."""
    steps = [
        Running("_log", "sum", F.when(factor > 0, F.ln(factor)).otherwise(0.0)),
        Running("_zero", "max", F.when(factor <= 0, 1).otherwise(0)),
    ]
    done = scan(curve, keys, ["time"], steps, F.floor(F.col("time")))
    return done.withColumn("survival", F.when(F.col("_zero") == 1, F.lit(0.0)).otherwise(F.exp("_log"))).drop("_log", "_zero")


def km_curve(df: DataFrame, keys: Sequence[str], time: str = "time", event: str = "event") -> DataFrame:
    """Kaplan-Meier survival at each distinct time."""
    curve = _curve_counts(df, keys, time, event)
    return _running_product(curve, keys, 1.0 - F.col("events") / F.col("at_risk"))


def censoring_curve(df: DataFrame, keys: Sequence[str], time: str = "time", event: str = "event") -> DataFrame:
    """Survival of staying uncensored; rows with an event at a time leave the risk set before its censored rows."""
    curve = _curve_counts(df, keys, time, event)
    left = F.col("at_risk") - F.col("events")
    return _running_product(curve, keys, F.when(left > 0, 1.0 - (F.col("n") - F.col("events")) / left).otherwise(1.0))


def step_value(queries: DataFrame, curve: DataFrame, keys: Sequence[str], at: str, name: str, before: bool = False) -> DataFrame:
    """Curve value at or (with `before`) strictly before each time; 1 ahead of the first step."""
    points = curve.select(*keys, F.col("time").alias("_t"), F.col("time").alias("t"), F.col("survival").alias("s"))
    found = lookup(
        queries, points, keys, at, "_t",
        [Running("_f", "max", F.when(F.col("_p_t").isNotNull(), F.struct(F.col("_p_t").alias("t"), F.col("_p_s").alias("s"))))],
        strict=before, bucket=F.floor(F.col("_at")),
    )
    return found.withColumn(name, F.coalesce(F.col("_f.s"), F.lit(1.0))).drop("_f")


def step_value_of_rows(rows: DataFrame, curve: DataFrame, keys: Sequence[str], at: str, name: str) -> DataFrame:
    """`step_value` for many wide rows: looked up once per distinct time, so that no row is ordered.

    The looked up values are written, so the optimizer knows whether they are few enough to be sent to the rows.
    """
    times = rows.select(*keys, F.col(at).alias("_at_row")).distinct()
    found = cut(step_value(times, curve, keys, "_at_row", name))
    marked = found.select(*[F.col(k).alias(f"_of_{k}") for k in keys], "_at_row", name)
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys] + [F.col(at).eqNullSafe(F.col("_at_row"))]
    return rows.join(marked, same).drop("_at_row", *[f"_of_{k}" for k in keys])


def concordance(
    df: DataFrame, keys: Sequence[str], time: str = "time", event: str = "event", risk: str = "risk", strict: bool = False,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Concordance index per key, over pairs of an event and a row that outlasts it.

    Default: a row censored at the event's time outlasts it, risks within 1e-8 tie. `strict`: only later
    times count and only equal risks tie. Rows alike in time, event and risk are counted once with a weight; rows
    without a time or a risk take no part.
    """
    tie = 0.0 if strict else TIE
    kind = F.lit(0) if strict else F.when(F.col(event) == 1, 0).otherwise(1)
    known = df.where(F.col(time).isNotNull() & F.col(risk).isNotNull())
    points = cut(known.groupBy(*keys, F.col(time).cast("double").alias("_t"), kind.alias("_k"), F.col(risk).cast("double").alias("_r")).agg(
        F.count(F.lit(1)).alias("_w"), F.count_if(F.col(event) == 1).alias("_q")))
    entry = lambda mark, value, weight: F.struct(F.lit(mark).alias("mark"), value.alias("_v"), weight.alias("_w"))
    point, asked = entry(1, F.col("_r"), F.col("_w")), F.col("_q") > 0
    marks = F.when(asked, F.array(point, entry(0, F.col("_r") - tie, F.col("_q")), entry(2, F.col("_r") + tie, F.col("_q")))).otherwise(F.array(point))
    entries = points.select(*keys, "_t", "_k", F.explode(marks).alias("m")).select(*keys, "m._v", "m.mark", "_t", "_k", "m._w")
    sums = lower_and_later(entries, keys, 3 * points.count(), part_rows)
    by_time = points.groupBy(*keys, "_t", "_k").agg(F.sum("_w").alias("_pw"), F.sum("_q").alias("_qw"))
    outlast = scan(by_time, keys, ["_t", "_k"], [Running("later", "sum", F.col("_pw"), inclusive=False)], F.floor(F.col("_t")), descending=True)
    comparable = outlast.where("_qw > 0").groupBy(*keys).agg(F.sum(F.col("_qw") * F.col("later")).alias("comparable"))
    joined = comparable.join(sums, list(keys), "left")
    lower = F.coalesce("lower", F.lit(0).cast("bigint"))
    tied = F.coalesce("upper", F.lit(0).cast("bigint")) - lower
    return joined.select(
        *keys, lower.alias("concordant"), tied.alias("tied"), "comparable",
        F.when(F.col("comparable") > 0, (lower + 0.5 * tied) / F.col("comparable")).alias("c_index"),
    )


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """Linear percentiles from counts of distinct values and their running sum; no group is held in memory."""
    points = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_vv")).agg(F.count(F.lit(1)).alias("_nn"))
    total = points.groupBy(*keys).agg(F.sum("_nn").alias("_n"))
    ranked = scan(points, keys, ["_vv"], [Running("upto", "sum", F.col("_nn"))], F.floor(F.col("_vv"))).join(total, list(keys))

    def value_at(place: Column) -> Column:
        return F.min(F.when(F.col("upto") > place, F.col("_vv")))

    columns = []
    for i, share in enumerate(shares):
        at = (F.col("_n") - 1) * F.lit(float(share))
        low, high = value_at(F.floor(at)), value_at(F.ceil(at))
        part = F.first(at - F.floor(at))
        columns.append((low + (high - low) * part).alias(f"p{i}"))
    return ranked.groupBy(*keys).agg(*columns)


def evaluation_grid(df: DataFrame, keys: Sequence[str], points: int = 256, time: str = "time", event: str = "event") -> DataFrame:
    """`points` evenly spaced times between the 10th and 90th percentile of positive event times, and the median."""
    events = df.where((F.col(event) == 1) & (F.col(time) > 0))
    ends = exact_percentiles(events, keys, time, (0.1, 0.9, 0.5)).where(F.col("p1") > F.col("p0"))
    width = (F.col("p1") - F.col("p0")) / F.lit(float(points - 1))
    return ends.select(*keys, F.col("p2").alias("median_time"), F.col("p0"), width.alias("_w"), F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("grid")).select(
        *keys, "grid", (F.col("p0") + F.col("grid") * F.col("_w")).alias("grid_time"), "median_time"
    )


def usable_grid(grid: DataFrame, train: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Grid times before the last time seen in both the reference and the evaluated rows; at least two must stay."""
    last_train = train.groupBy(*keys).agg(F.max("time").alias("_t"), F.count(F.lit(1)).alias("_nt"))
    last_rows = rows.groupBy(*keys).agg(F.max("time").alias("_e"), F.count(F.lit(1)).alias("_ne"))
    joined = grid.join(last_train, list(keys)).join(last_rows, list(keys)).where((F.col("_nt") >= 2) & (F.col("_ne") >= 2))
    kept = joined.where(F.col("grid_time") < F.least("_t", "_e")).drop("_t", "_e", "_nt", "_ne")
    enough = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("_g")).where(F.col("_g") >= 2)
    return kept.join(enough.drop("_g"), list(keys), "left_semi")


def _on_grid(rows: DataFrame, grid: DataFrame, keys: Sequence[str], each: Callable[[Column, Column], Column], more: Sequence[str] = ()) -> DataFrame:
    """The entries that a row gives at the points of its key's grid: `each` makes an array from a point and the row's risk there.

    Hazards are summed once per row, and only the entries leave it. A key's grid is one small array (it has a fixed number of points);
    the arrays are written, so the optimizer knows their size and need not deal the rows by key.
    """
    listed = cut(grid.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("grid", "grid_time", *more))).alias("_grid")))
    ready = rows.withColumn("_sums", cumulative(F.col("hazards"))).join(listed, list(keys))
    entries = F.transform("_grid", lambda g: each(g, risk_by(F.col("_sums"), F.col("hazards"), g["grid_time"])))
    return ready.select(*keys, F.explode(F.flatten(entries)).alias("_e")).select(*keys, "_e.*")


def _ranked_part(found: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    order = np.lexsort((found["mark"], found["value"]))
    mark, weight = found["mark"][order], found["weight"][order]
    before = np.cumsum(np.where(mark == 1, weight, 0.0))
    told = {"part": np.array([TaskContext.get().partitionId()]), "points": np.array([round(weight[mark == 1].sum())])}
    for name, m in (("low", 0), ("high", 2)):
        told[f"{name}_weight"] = np.array([weight[mark == m].sum()])
        told[name] = np.array([(weight * before)[mark == m].sum()])
    return told


def weighted_ranks(entries: DataFrame, keys: Sequence[str], rows: int, part_rows: int = PART_ROWS) -> DataFrame:
    """keys, points, weight, low, high: the sums over questions of their weight times the points before them.

    entries: keys, value, mark (0 question below points of its value, 1 point, 2 question above them), weight (a point's: how many
    it stands for); about `rows` of them.
    They are cut by range once; a part gives a row per key, and the points of earlier parts are added to those few.
    """
    keys = list(keys)
    parts = max(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // part_rows))
    names = ["part", "points", "low_weight", "low", "high_weight", "high"]
    kinds = "".join(f"`{k}` {entries.schema[k].dataType.simpleString()}, " for k in keys)
    told = entries.repartitionByRange(parts, *keys, "value", "mark").mapInArrow(
        lambda batches: by_key(batches, keys, _ranked_part, names), f"{kinds}part long, points long, low_weight double, low double, high_weight double, high double")
    earlier = F.coalesce(F.sum("points").over(Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    told = told.withColumn("_earlier", earlier)
    side = lambda name: F.sum(F.col(name) + F.col(f"{name}_weight") * F.col("_earlier")).alias(name)
    return told.groupBy(*keys).agg(F.sum("points").alias("points"), F.sum("low_weight").alias("weight"), side("low"), side("high"))


def cumulative_auc(rows: DataFrame, train: DataFrame, grid: DataFrame, keys: Sequence[str], part_rows: int = PART_ROWS) -> tuple[DataFrame, DataFrame]:
    """Weighted AUC of cases up to each grid time against rows that outlast it, and its survival-weighted mean.

    `rows`: keys, time, event, hazards. Case weights are 1 / G at the own time. Per grid time the share of
    controls below a case's risk is a count along the risks, which leave their row as numbers.
    """
    curve = censoring_curve(train, keys)
    weighted = step_value_of_rows(rows.select(*keys, "time", "event", "hazards"), curve, keys, "time", "g").select(
        *keys, "time", "hazards", F.when((F.col("event") == 1) & (F.col("g") > 0), 1.0 / F.col("g")).otherwise(0.0).alias("ipcw"))

    def compared(point: Column, risk: Column) -> Column:
        entry = lambda mark, value, weight: F.struct(point["grid"].alias("grid"), F.lit(mark).alias("mark"), value.alias("value"), weight.alias("weight"))
        case = (F.col("time") <= point["grid_time"]) & (F.col("ipcw") > 0)
        return F.when(F.col("time") > point["grid_time"], F.array(entry(1, risk, F.lit(1.0)))).when(
            case, F.array(entry(0, risk - TIE, F.col("ipcw")), entry(2, risk + TIE, F.col("ipcw")))).otherwise(F.array().cast(
                "array<struct<grid:int,mark:int,value:double,weight:double>>"))

    # ties count half: half the counts below the low bound and half of those up to the high bound
    entries = _on_grid(weighted, grid.withColumn("grid", F.col("grid").cast("int")), keys, compared)
    # entries alike are one with their weights' sum: no part holds more of them than it has places
    alike = cut(entries.groupBy(*keys, "grid", "mark", "value").agg(F.sum("weight").alias("weight")))
    ranks = weighted_ranks(alike, [*keys, "grid"], alike.count(), part_rows).where("points > 0 AND weight > 0")
    per_time = ranks.select(*keys, "grid", ((F.col("low") + F.col("high")) / 2 / (F.col("weight") * F.col("points"))).alias("auc"))
    per_time = cut(grid.select(*keys, "grid", "grid_time").join(per_time, [*keys, "grid"]))
    survival = step_value(per_time, km_curve(rows, keys), keys, "grid_time", "survival")
    # at most one row per grid point and key
    order = Window.partitionBy(*keys).orderBy("grid")
    dropped = survival.withColumn("_drop", F.coalesce(F.lag("survival").over(order), F.lit(1.0)) - F.col("survival"))
    mean = dropped.groupBy(*keys).agg(
        F.when(1.0 - F.min("survival") > 0, F.sum(F.col("auc") * F.col("_drop")) / (1.0 - F.min("survival"))).alias("mean_auc")
    )
    return per_time, mean


def integrated_brier(rows: DataFrame, train: DataFrame, grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inverse-censoring-weighted Brier score over the grid, by the trapezoid rule.

    A row's scores are made inside it and added up before they move: the shuffle holds a row per task and grid point.
    """
    curve = censoring_curve(train, keys)
    observed = step_value_of_rows(rows.select(*keys, "time", "event", "hazards"), curve, keys, "time", "g")
    timed = step_value(grid.select(*keys, "grid", "grid_time"), curve, keys, "grid_time", "g_time")

    def scored(point: Column, risk: Column) -> Column:
        happened = (F.col("time") <= point["grid_time"]) & (F.col("event") == 1) & (F.col("g") > 0)
        alive = (F.col("time") > point["grid_time"]) & (point["g_time"] > 0)
        lived = 1.0 - risk
        score = F.when(happened, lived * lived / F.col("g")).when(alive, (1.0 - lived) * (1.0 - lived) / point["g_time"]).otherwise(0.0)
        return F.array(F.struct(point["grid"].alias("grid"), point["grid_time"].alias("grid_time"), score.alias("score")))

    per_time = _on_grid(observed, timed, keys, scored, ("g_time",)).groupBy(*keys, "grid", "grid_time").agg(F.avg("score").alias("score"))
    return _trapezoid(per_time, keys)


def _trapezoid(per_time: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean height of a curve of at most one row per grid point."""
    order = Window.partitionBy(*keys).orderBy("grid_time")
    step = per_time.withColumns({"_t": F.lag("grid_time").over(order), "_s": F.lag("score").over(order)})
    area = F.sum((F.col("grid_time") - F.col("_t")) * (F.col("score") + F.col("_s")) / 2)
    span = F.max("grid_time") - F.min("grid_time")
    return step.groupBy(*keys).agg(F.when(span > 0, area / span).alias("ibs"))


def daily_brier(rows: DataFrame, keys: Sequence[str], horizon: int) -> DataFrame:
    """Mean Brier score over whole days; events are weighted by G just before their time, G is at least 1e-6."""
    censored = rows.where(F.col("event") != 1).select(*keys, "time").distinct()
    curve = _curve_counts(rows, keys, "time", "event")
    factor = 1.0 - (F.col("n") - F.col("events")) / F.col("at_risk")
    survival = _running_product(curve, keys, factor).join(censored, [*keys, "time"], "left_semi")
    own = step_value(rows, survival, keys, "time", "g_before", before=True)
    days = F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("day")
    grid = rows.select(*keys).distinct().select(*keys, days).withColumn("at", F.col("day").cast("double"))
    timed = step_value(grid, survival, keys, "at", "g_day").select(*keys, "day", F.greatest("g_day", F.lit(1e-6)).alias("g_day"))
    spread = own.select(*keys, "time", "event", "hazards", F.greatest("g_before", F.lit(1e-6)).alias("g_before"), days).join(
        timed, [*keys, "day"]
    )
    alive = F.col("time") > F.col("day")
    weight = F.when(alive, 1.0 / F.col("g_day")).when(F.col("event") == 1, 1.0 / F.col("g_before")).otherwise(0.0)
    lived = F.exp(-hazard_until(F.col("hazards"), F.col("day").cast("double")))
    error = alive.cast("double") - lived
    return spread.groupBy(*keys, "day").agg(F.avg(weight * error * error).alias("score")).groupBy(*keys).agg(
        F.avg("score").alias("ibs_daily")
    )


def calibration(rows: DataFrame, keys: Sequence[str], row_id: str, bins: int = 10, eps: float = 1e-6) -> DataFrame:
    """Nam-D'Agostino statistic: near-equal groups by predicted survival against the Kaplan-Meier value of each.

    `rows`: keys, row id, time, event, predicted (survival at `at`), at. A group whose last time is before
    `at` without an event counts no value.
    """
    held = rows.select(*keys, row_id, "time", "event", "predicted", "at").withColumn("predicted", F.least(F.greatest("predicted", F.lit(eps)), F.lit(1.0 - eps)))
    total = cut(held.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= 2))
    ranked = position(held.join(total, list(keys)), keys, ["predicted", row_id], "_rank")
    groups = F.greatest(F.lit(2), F.least(F.lit(bins), F.col("_n")))
    size, larger = F.floor(F.col("_n") / groups), F.col("_n") % groups
    edge = larger * (size + 1)
    binned = ranked.withColumn("bin", F.when(F.col("_rank") < edge, F.floor(F.col("_rank") / (size + 1))).otherwise(
        larger + F.floor((F.col("_rank") - edge) / size)))
    bkeys = [*keys, "bin"]
    stats = binned.groupBy(*bkeys).agg(
        F.avg("predicted").alias("mean"), F.max("time").alias("_last"), F.first("at").alias("at"),
        F.max((F.col("event") == 1) & (F.col("time") <= F.col("at"))).alias("_any"),
    )
    observed = step_value(stats, km_curve(binned, bkeys), bkeys, "at", "observed").where(
        (F.col("_last") >= F.col("at")) | F.col("_any")
    )
    mean = F.least(F.greatest("mean", F.lit(eps)), F.lit(1.0 - eps))
    gap = F.col("observed") - mean
    return observed.groupBy(*keys).agg(
        F.sum(gap * gap / (mean * (1.0 - mean))).alias("nd_calibration"), F.count(F.lit(1)).alias("nd_bins")
    )


def stage_report(rows: DataFrame, train: DataFrame, stage: str, row_id: str, points: int = 256, bins: int = 10) -> DataFrame:
    """All survival metrics per stage. `rows`: stage, row id, time, event, hazards; `train`: stage, time, event."""
    keys = [stage]
    base = rows.groupBy(stage).agg(
        F.count(F.lit(1)).alias("samples_total"), F.count_if(F.col("event") == 1).alias("events_total")
    )
    whole = evaluation_grid(rows, keys, points)
    grid = cut(usable_grid(whole, train, rows, keys))
    _, auc = cumulative_auc(rows, train, grid, keys)
    ends = cut(grid.groupBy(stage).agg(
        F.min("grid_time").alias("t_min"), F.max("grid_time").alias("t_max"), F.first("median_time").alias("t_median")
    ))
    scored = rows.join(ends, stage).withColumns({
        "risk": mean_hazard(F.col("hazards"), F.col("t_min"), F.col("t_max")),
        # rounded so that the bins of equal predictions don't hang on the last bit
        "predicted": F.round(1.0 - risk_at(F.col("hazards"), F.col("t_median")), 10), "at": F.col("t_median"),
    })
    parts = [
        auc.withColumnRenamed("mean_auc", "time_dependent_c"),
        concordance(scored, keys).select(stage, F.col("c_index").alias("harrell_c_index")),
        calibration(scored, keys, row_id, bins), integrated_brier(rows, train, grid, keys),
        ends.select(stage, "t_min", "t_max", "t_median"),
    ]
    for part in parts:
        base = base.join(part, stage, "left")
    return base


def mean_over_stages(report: DataFrame, names: Sequence[str] = ("time_dependent_c", "harrell_c_index", "nd_calibration", "ibs")) -> DataFrame:
    """Mean of each metric over the stages that have it, 0 if none has."""
    return report.agg(*[F.coalesce(F.avg(F.when(~F.isnan(c), F.col(c))), F.lit(0.0)).alias(c) for c in names])
