"""Counting and comparing phenotypes: item counts, prevalence, encounter support, exact pair counts, statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from cohortline.functions import numbers, text, times

STATISTICS = ("latest", "delta", "slope", "min", "max", "time_weighted_mean")
# Support a statistic asks of an encounter.
STATISTIC_TIER = {
    "latest": "one", "delta": "two_times", "slope": "three_values",
    "min": "one", "max": "one", "time_weighted_mean": "two_times",
}
TIERS = ("one", "two_times", "three_values")


def numeric_rows(df: DataFrame, value: str = "value") -> DataFrame:
    """Keep rows with a number as value, given as `value_num`."""
    return df.withColumn("value_num", numbers.to_number(F.col(value))).where(F.col("value_num").isNotNull())


def item_unit_counts(df: DataFrame, keys: Sequence[str] = ("dataset", "table", "item", "unit")) -> DataFrame:
    """Numeric rows per source table, item and unit."""
    return numeric_rows(df).groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def melt_wide(df: DataFrame, ids: Sequence[str], columns: dict[str, tuple[str, str]]) -> DataFrame:
    """Wide value columns as rows of (item, unit, value); only columns that are there are read."""
    present = {c: spec for c, spec in columns.items() if c in df.columns}
    long = df.select(*ids, *present).unpivot(list(ids), list(present), "source_column", "value")
    spec = F.create_map(
        *[x for c, (item, unit) in present.items()
          for x in (F.lit(c), F.struct(F.lit(item).alias("item"), F.lit(unit).alias("unit")))]
    )
    return long.where(F.col("value").isNotNull()).select(
        *ids, spec[F.col("source_column")]["item"].alias("item"), spec[F.col("source_column")]["unit"].alias("unit"),
        "value", "source_column",
    )


def merge_counts(counts: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add counts of one normalised (item, unit) up; the spelling met first in `order` is kept."""
    keyed = counts.withColumn("item_key", text.item_key(F.col("item"))).withColumn(
        "unit_key", text.unit_key(F.col("unit"))
    )
    first = F.min_by(F.struct("item", "unit"), F.struct(*order))
    merged = keyed.groupBy("item_key", "unit_key").agg(first.alias("first"), F.sum("count").alias("count"))
    return merged.select(
        F.col("first.item").alias("item"), F.col("first.unit").alias("unit"), "count", "item_key", "unit_key"
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once: a candidate list must give no row here."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def concept_prevalence(rows: DataFrame, scanned: DataFrame) -> DataFrame:
    """Events, distinct entities and prevalence per (center, concept).

    `rows`: center, entity, concept; `scanned`: center, scanned_entities.
    """
    counts = rows.groupBy("center", "concept").agg(
        F.count(F.lit(1)).alias("event_count"), F.count_distinct("entity").alias("entity_count")
    )
    return counts.join(scanned, "center").withColumn(
        "prevalence",
        F.when(F.col("scanned_entities") > 0, F.col("entity_count") / F.col("scanned_entities")).otherwise(0.0),
    )


def concept_variants(rows: DataFrame, keep: int | None = None) -> DataFrame:
    """Source spellings per (center, concept), most frequent first, with their rank."""
    counts = rows.groupBy("center", "concept", "item", "unit").agg(F.count(F.lit(1)).alias("event_count"))
    order = Window.partitionBy("center", "concept").orderBy(F.col("event_count").desc(), "item", "unit")
    ranked = counts.withColumn("variant_rank", F.row_number().over(order))
    return ranked if keep is None else ranked.where(F.col("variant_rank") <= keep)


def cross_center_table(prevalence: DataFrame, variants: DataFrame, centers: Sequence[str]) -> DataFrame:
    """One row per concept over all centers: presence, tier, lowest and geometric mean prevalence, top units."""
    top = (
        variants.where(F.col("variant_rank") <= 5)
        .groupBy("center", "concept")
        .agg(F.array_sort(F.collect_list(F.struct("variant_rank", "unit"))).alias("units"))
        .withColumn("top_units", F.concat_ws(",", F.transform("units", lambda u: u["unit"])))
        .drop("units")
    )
    rows = prevalence.join(top, ["center", "concept"], "left")
    per_center = []
    for center in centers:
        here = F.col("center") == center
        per_center += [
            F.coalesce(F.max(F.when(here, F.col("entity_count"))), F.lit(0).cast("bigint")).alias(f"{center}_entities"),
            F.coalesce(F.max(F.when(here, F.col("prevalence"))), F.lit(0.0)).alias(f"{center}_prevalence"),
            F.coalesce(F.max(F.when(here, F.col("event_count"))), F.lit(0).cast("bigint")).alias(f"{center}_events"),
            F.coalesce(F.max(F.when(here, F.col("top_units"))), F.lit("")).alias(f"{center}_top_units"),
        ]
    lowest = F.min("prevalence")
    geometric = F.when(lowest > 0, F.exp(F.avg(F.ln(F.when(F.col("prevalence") > 0, F.col("prevalence")))))).otherwise(0.0)
    present = F.count_distinct("center")
    tier = (
        F.when(present == 4, "four_center_core").when(present == 3, "three_center_extension")
        .otherwise("two_center_auxiliary")
    )
    return rows.groupBy("concept").agg(
        present.cast("bigint").alias("centers_present"), tier.alias("selection_tier"),
        lowest.alias("minimum_prevalence"), geometric.alias("geometric_mean_prevalence"), *per_center,
    )


def encounter_support(
    rows: DataFrame, keys: Sequence[str] = ("item_key", "unit_key"), time: str = "time", conflicts: bool = False
) -> DataFrame:
    """Rows, first and last time per (scope, encounter, phenotype): one partial and one final aggregate.

    Counts add and times take min/max, so supports of two parts merge by the same aggregate. Patient and
    diagnosis belong to the encounter, so they are group keys (a hash aggregate; a text minimum would need a
    sort). Where a source may contradict itself, `conflicts` keeps the smallest of each instead.
    """
    measures = [F.count(F.lit(1)).alias("measurement_count"), F.min(time).alias("min_time"), F.max(time).alias("max_time")]
    if conflicts:
        return rows.groupBy("scope", "encounter", *keys).agg(
            F.min("patient").alias("patient"), F.min("diagnosis").alias("diagnosis"), *measures
        )
    return rows.groupBy("scope", "encounter", *keys, "patient", "diagnosis").agg(*measures)


def merge_support(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("item_key", "unit_key")) -> DataFrame:
    """Upsert of supports: counts add up, a missing time never wins."""
    return merged_support(left.unionByName(right), keys)


def merged_support(parts: DataFrame, keys: Sequence[str] = ("item_key", "unit_key")) -> DataFrame:
    """One row per (scope, encounter, phenotype) of the supports of any number of parts."""
    return parts.groupBy("scope", "encounter", *keys).agg(
        F.min("patient").alias("patient"), F.min("diagnosis").alias("diagnosis"),
        F.sum("measurement_count").alias("measurement_count"),
        F.min("min_time").alias("min_time"), F.max("max_time").alias("max_time"),
    )


def pairs_among(n: Column) -> Column:
    """C(n, 2) of a bigint: the even factor is halved, so that no step is inexact."""
    return F.when(n % 2 == 0, F.shiftright(n, 1) * (n - 1)).otherwise(n * F.shiftright(n - 1, 1))


def pair_counts(support: DataFrame, keys: Sequence[str] = ("item_key", "unit_key")) -> DataFrame:
    """Exact pairs of encounters of different patients within (scope, phenotype, diagnosis), for all tiers at once.

    C(n, 2) less the same-patient pairs: two nested aggregates, no pair is ever built.
    """
    spread = F.col("min_time") < F.col("max_time")
    fits = {
        "one": F.col("measurement_count") >= 1,
        "two_times": (F.col("measurement_count") >= 2) & spread,
        "three_values": (F.col("measurement_count") >= 3) & spread,
    }
    by_patient = support.groupBy("scope", *keys, "diagnosis", "patient").agg(
        *[F.count(F.when(fits[t], 1)).alias(t) for t in TIERS]
    )

    by_diagnosis = by_patient.groupBy("scope", *keys, "diagnosis").agg(
        *[F.sum(t).alias(t) for t in TIERS], *[F.sum(pairs_among(F.col(t))).alias(f"{t}_same") for t in TIERS]
    )
    by_phenotype = by_diagnosis.groupBy("scope", *keys).agg(
        *[
            F.struct(
                F.sum(t).alias("eligible_encounters"),
                F.count(F.when(F.col(t) > 0, 1)).alias("diagnosis_clusters"),
                F.sum(pairs_among(F.col(t)) - F.col(f"{t}_same")).alias("pair_count"),
            ).alias(t)
            for t in TIERS
        ]
    )
    per_statistic = F.explode(
        F.array(*[
            F.struct(F.lit(s).alias("statistic"), *[F.col(STATISTIC_TIER[s])[f].alias(f) for f in PAIR_COLUMNS])
            for s in STATISTICS
        ])
    )
    return by_phenotype.select("scope", *keys, per_statistic.alias("p")).select("scope", *keys, "p.*")


PAIR_COLUMNS = ("eligible_encounters", "diagnosis_clusters", "pair_count")


def pair_count_grid(
    pairs: DataFrame, candidates: DataFrame, scopes: Sequence[str], keys: Sequence[str] = ("item_key", "unit_key")
) -> DataFrame:
    """Every (scope, candidate, statistic), zero where nothing was counted."""
    cells = candidates.withColumn("scope", F.explode(F.array(*[F.lit(s) for s in scopes]))).withColumn(
        "statistic", F.explode(F.array(*[F.lit(s) for s in STATISTICS]))
    )
    filled = cells.join(pairs, ["scope", *keys, "statistic"], "left")
    return filled.select(
        "scope", "item", "unit", "count", "statistic",
        *[F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c) for c in PAIR_COLUMNS],
    )


def balanced_specs(pairs: DataFrame) -> DataFrame:
    """Targets (item, unit, statistic) of every item whose six statistics all have pairs."""
    support = pairs.where(F.col("statistic").isin(*STATISTICS)).groupBy("item", "unit").agg(
        *[F.sum(F.when(F.col("statistic") == s, F.col("pair_count"))).alias(s) for s in STATISTICS]
    )
    complete = support.where(" AND ".join(f"coalesce(`{s}`, 0) > 0" for s in STATISTICS))
    rows = complete.select("item", "unit", F.explode(F.array(*[F.lit(s) for s in STATISTICS])).alias("statistic"))
    query = F.concat(
        F.lit("Continuous clinical measurement: "), F.col("item"), F.lit(". Unit: "),
        F.when(F.col("unit") == "", "none").otherwise(F.col("unit")),
        F.lit(". Target statistic over one encounter: "), F.translate("statistic", "_", " "), F.lit("."),
    )
    return rows.withColumn("key", text.phenotype_key(F.col("item"), F.col("unit"), F.col("statistic"))).withColumn(
        "query_text", query
    )


def six_statistics(
    rows: DataFrame, keys: Sequence[str], time: str = "time", value: str = "value_num",
    order: Sequence[str] = (), bucket_seconds: int | None = 90 * 86_400,
) -> DataFrame:
    """latest, delta, slope, min, max and time-weighted mean per key.

    A row without time counts for latest (it sorts last), min and max only. Slope is over raw points,
    delta and the time-weighted mean over the mean per time. Rows are read once: they are added up per time, times per
    time bucket and buckets per key, and only neighbours are linked, so a very long key is not one task's work. Where the
    rows are already dealt by some of the keys, one sort serves all three steps; `bucket_seconds` None leaves out the
    buckets, which then spread nothing. Sums for the slope are kept from the first time on, so that they stay small.
    """
    t, v = F.col(time), F.col(value)
    # sorted by numbers first: they compare faster than texts
    by = sorted(keys, key=lambda k: not isinstance(rows.schema[k].dataType, T.NumericType))
    # times are whole microseconds
    timed = rows.where(v.isNotNull()).withColumn("_at", times.micros(t))
    hours = lambda start, end: (F.col(end) - F.col(start)) / F.lit(3_600_000_000.0)
    upto = Window.unboundedPreceding, Window.currentRow
    part = list(by)
    if bucket_seconds is not None:
        timed = timed.withColumn("_bucket", F.floor(F.col("_at") / F.lit(1_000_000 * bucket_seconds)))
        part.append("_bucket")
    points = timed.groupBy(*part, "_at").agg(
        F.max_by(v, F.struct(F.lit(0).alias("_same"), *[F.col(c) for c in order])).alias("latest"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.count("_at").alias("n"), F.sum(F.when(F.col("_at").isNotNull(), v.cast("double"))).alias("total"),
    ).withColumn("mean", F.when(F.col("n") > 0, F.col("total") / F.col("n")))
    inside = Window.partitionBy(*part).orderBy("_at")
    stepped = points.select(
        "*", F.lag("_at").over(inside).alias("_before"), F.lag("mean").over(inside).alias("_mean_before"),
        F.first("_at", ignorenulls=True).over(inside.rowsBetween(*upto)).alias("_start"))
    x, n = hours("_start", "_at"), F.col("n")
    area = F.sum(hours("_before", "_at") * (F.col("mean") + F.col("_mean_before")) / 2)
    whole = stepped.groupBy(*part).agg(
        F.max_by("latest", F.struct(F.col("_at").isNull().alias("untimed"), "_at")).alias("latest"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.min("_at").alias("_from"), F.max("_at").alias("_to"), F.min_by("mean", "_at").alias("_first"), F.max_by("mean", "_at").alias("_last"),
        F.coalesce(area, F.lit(0.0)).alias("area"), F.sum("n").alias("n"), F.sum("total").alias("total"),
        F.sum(n * x).alias("x"), F.sum(n * x * x).alias("xx"), F.sum(x * F.col("total")).alias("xy"),
    )
    if bucket_seconds is not None:
        across = Window.partitionBy(*by).orderBy("_bucket")
        linked = whole.select(
            "*", F.lag("_to").over(across).alias("_before"), F.lag("_last").over(across).alias("_mean_before"),
            F.first("_from", ignorenulls=True).over(across.rowsBetween(*upto)).alias("_start"))
        off = hours("_start", "_from")
        between = hours("_before", "_from") * (F.col("_first") + F.col("_mean_before")) / 2
        whole = linked.groupBy(*by).agg(
            F.max_by("latest", F.struct(F.col("_from").isNull().alias("untimed"), "_bucket")).alias("latest"), F.min("min").alias("min"), F.max("max").alias("max"),
            F.min_by("_first", "_from").alias("_first"), F.max_by("_last", "_to").alias("_last"),
            F.sum(F.col("area") + F.coalesce(between, F.lit(0.0))).alias("area"), F.sum("n").alias("n"), F.sum("total").alias("total"),
            F.sum(F.col("x") + n * off).alias("x"), F.sum(F.col("xx") + 2 * off * F.col("x") + n * off * off).alias("xx"),
            F.sum(F.col("xy") + off * F.col("total")).alias("xy"), F.min("_from").alias("_from"), F.max("_to").alias("_to"),
        )
    spread = F.col("_from") < F.col("_to")
    slope = (F.col("xy") - F.col("x") * F.col("total") / n) / (F.col("xx") - F.col("x") * F.col("x") / n)
    return whole.select(
        *keys, "latest",
        F.when(spread, F.col("_last") - F.col("_first")).alias("delta"),
        F.when(spread & (n >= 3), slope).alias("slope"),
        "min", "max",
        F.when(spread, F.col("area") / hours("_from", "_to")).alias("time_weighted_mean"),
    )


def statistic_rows(stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Statistics as (keys, statistic, value) rows, finite values only."""
    long = stats.unpivot(list(keys), list(STATISTICS), "statistic", "value")
    return long.withColumn("value", numbers.finite(F.col("value"))).where(F.col("value").isNotNull())
