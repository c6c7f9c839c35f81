"""Small tables with known answers."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from cohortline.operators import batching, durations, features as ft, labels_followup as lf, metrics_classification as mc
from cohortline.operators import metrics_survival as ms, pairs as pr, phenotype as ph, splits

START = dt.datetime(2020, 1, 1)


def hourly(values, *keys):
    return [(*keys, START + dt.timedelta(hours=h), float(v), h) for h, v in enumerate(values)]


def test_six_statistics(spark):
    rows = spark.createDataFrame(hourly([1, 3, 5], "e"), "e string, time timestamp_ntz, value_num double, i int")
    got = ph.six_statistics(rows, ["e"], order=["i"]).first()
    want = {"latest": 5, "delta": 4, "slope": 2, "min": 1, "max": 5, "time_weighted_mean": 3}
    assert {s: got[s] for s in want} == pytest.approx(want)


def test_untimed_value_wins_latest_only(spark):
    data = hourly([1, 3, 5], "e") + [("e", None, 9.0, 9)]
    rows = spark.createDataFrame(data, "e string, time timestamp_ntz, value_num double, i int")
    got = ph.six_statistics(rows, ["e"], order=["i"]).first()
    assert (got["latest"], got["max"], got["delta"]) == (9.0, 9.0, 4.0)


def test_one_time_has_no_delta(spark):
    rows = spark.createDataFrame([("e", START, 1.0, 0), ("e", START, 2.0, 1)], "e string, time timestamp_ntz, value_num double, i int")
    got = ph.six_statistics(rows, ["e"], order=["i"]).first()
    assert (got["latest"], got["delta"], got["slope"], got["time_weighted_mean"]) == (2.0, None, None, None)


def three_patients(spark):
    data = [("icu", "dx", f"p{p}", p, "Heart rate", "bpm", *r) for p, add in enumerate((0, 10, 20)) for r in hourly([1 + add, 2 + add, 3 + add])]
    return spark.createDataFrame(
        data, "scope string, diagnosis string, patient string, encounter bigint, item string, unit string, time timestamp_ntz, value_num double, i int"
    )


def test_three_patients_give_three_pairs_per_statistic(spark):
    rows = three_patients(spark).withColumns({"item_key": F.lower("item"), "unit_key": F.col("unit")})
    pairs = ph.pair_counts(ph.encounter_support(rows))
    got = {r["statistic"]: (r["eligible_encounters"], r["diagnosis_clusters"], r["pair_count"]) for r in pairs.collect()}
    assert got == {s: (3, 1, 3) for s in ph.STATISTICS}
    specs = ph.balanced_specs(pairs.withColumnRenamed("item_key", "item").withColumnRenamed("unit_key", "unit"))
    assert specs.count() == 6


def test_same_patient_pairs_do_not_count(spark):
    rows = three_patients(spark).withColumns({"item_key": F.col("item"), "unit_key": F.col("unit"), "patient": F.lit("one")})
    assert {r["pair_count"] for r in ph.pair_counts(ph.encounter_support(rows)).collect()} == {0}


def test_pair_sampling_two_distinct_patients(spark):
    stats = ph.six_statistics(three_patients(spark), ["scope", "diagnosis", "patient", "encounter"], order=["i"])
    long = ph.statistic_rows(stats, ["scope", "diagnosis", "patient", "encounter"])
    values = long.select(
        F.lit("train").alias("split"), (F.array_position(F.array(*[F.lit(s) for s in ph.STATISTICS]), F.col("statistic")) - 1).cast("int").alias("query_id"),
        "scope", "diagnosis", "patient", F.col("encounter").alias("record_index"), "value",
    )
    groups = pr.pair_groups(values)
    specs = spark.createDataFrame([(i, "hr", "bpm", s) for i, s in enumerate(ph.STATISTICS)], "query_id int, item string, unit string, statistic string")
    queries = pr.complete_items(groups, specs, ph.STATISTICS)
    sample = pr.sample_pairs(values, groups, pr.query_scale(values, groups), queries, 2, "train").collect()
    assert len(sample) == 12
    assert all(r["left_patient"] != r["right_patient"] for r in sample)
    assert {r["query_id"] for r in sample} == set(range(6))
    again = pr.sample_pairs(values, groups, pr.query_scale(values, groups), queries, 2, "train").collect()
    assert sorted(map(str, again)) == sorted(map(str, sample))


@pytest.mark.parametrize("length,window,stride,want", [
    (10, 4, 3, [0, 3, 6]), (11, 4, 3, [0, 3, 6, 7]), (4, 4, 3, [0]), (1, 4, 3, []), (4, 3, 2, [0, 1]), (10, 4, None, [0, 3, 6]),
])
def test_windows(spark, length, window, stride, want):
    lengths = spark.createDataFrame([("a", length)], "sample_id string, table_length bigint")
    assert sorted(r["start"] for r in ft.windows(lengths, window, stride).collect()) == want


@pytest.mark.parametrize("length,limit,ratio", [(20, 7, 0.75), (20, 7, 1.0), (4, 8, 0.75)])
def test_thinning(spark, length, limit, ratio):
    rows = spark.range(length).select(F.lit("a").alias("sample_id"), F.col("id").alias("pos"))
    lengths = rows.groupBy("sample_id").agg(F.count(F.lit(1)).alias("table_length"))
    got = sorted(r["pos"] for r in ft.thinned_rows(rows, lengths, limit, ratio).collect())
    again = sorted(r["pos"] for r in ft.thinned_rows(rows, lengths, limit, ratio).collect())
    assert got == again and len(got) == min(length, limit)
    if length > limit:
        recent = round(limit * ratio)
        assert got[len(got) - recent:] == list(range(length - recent, length))


def test_binary_scores(spark):
    rows = spark.createDataFrame([("t", 0, 0.1), ("t", 0, 0.2), ("t", 1, 0.3), ("t", 1, 0.4)], "task string, label int, score double")
    got = mc.binary_report(rows, ["task"], threshold=None).first()
    assert got["best_threshold"] == 0.3 and got["f1"] == 1.0 and got["recall"] == 1.0 and got["auroc"] == 1.0


def test_one_class_scores(spark):
    rows = spark.createDataFrame([("t", 0, 0.1), ("t", 0, 0.2)], "task string, label int, score double")
    got = mc.ranking_metrics(rows, ["task"]).first()
    assert (got["auroc"], got["auprc"]) == (0.5, 0.0)


def test_class_weight(spark):
    rows = spark.createDataFrame([(0,), (0,), (0,), (1,)], "label int")
    assert splits.class_weight(rows, "label").first()[0] == 3.0
    with pytest.raises(Exception):
        splits.class_weight(rows.where("label = 0"), "label").collect()


def test_regression(spark):
    rows = spark.createDataFrame([("t", v, v) for v in (-2.0, -1.0, 1.0, 2.0)], "task string, predicted double, target double")
    got = mc.regression_report(rows, ["task"]).first()
    assert got["mae"] == 0 and got["pearson"] == pytest.approx(1.0) and got["spearman"] == pytest.approx(1.0)
    sums = spark.createDataFrame([("loss", 1.0, 1.0), ("loss", 3.0, 3.0), ("accuracy", 3.0, 4.0)], "name string, total double, weight double")
    assert {r["name"]: r["mean"] for r in mc.weighted_means(sums, ["name"]).collect()} == {"loss": 1.0, "accuracy": 0.75}


def test_kaplan_meier_reaches_zero(spark):
    rows = spark.createDataFrame([("a", 1.0, 1), ("a", 2.0, 1), ("a", 2.0, 0), ("a", 3.0, 0), ("a", 4.0, 1)], "k string, time double, event int")
    curve = {r["time"]: r["survival"] for r in ms.km_curve(rows, ["k"]).collect()}
    assert curve == pytest.approx({1.0: 0.8, 2.0: 0.6, 3.0: 0.6, 4.0: 0.0})


def test_concordance_brute_force(spark):
    rng = random.Random(3)
    data = [("a", float(rng.randrange(12)), rng.randrange(2), rng.randrange(9) / 8.0) for _ in range(160)]
    got = ms.concordance(spark.createDataFrame(data, "k string, time double, event int, risk double"), ["k"]).first()
    conc = ties = total = 0
    for _, t, e, r in data:
        for _, u, f, q in data:
            if e and (u > t or (u == t and not f)):
                total += 1
                conc += r - q > 1e-8
                ties += abs(r - q) <= 1e-8
    assert (got["concordant"], got["tied"], got["comparable"]) == (conc, ties, total)


def test_percentiles_are_linear(spark):
    rows = spark.createDataFrame([("a", float(v)) for v in (1, 2, 4, 8, 16, 16, 3)], "k string, v double")
    got = ms.exact_percentiles(rows, ["k"], "v", (0.1, 0.5, 0.9)).first()
    assert [got["p0"], got["p1"], got["p2"]] == pytest.approx([1.6, 4.0, 16.0])


@pytest.mark.parametrize("event,censor,observed,horizon,want", [
    (2.0, 9.0, True, 5.0, (2.0, 1)), (6.0, 9.0, True, 5.0, (5.0, 0)), (5.0, 9.0, True, 5.0, (5.0, 1)), (0.0, 9.0, True, 5.0, None),
    (None, 3.0, False, 5.0, (3.0, 0)), (-1.0, 3.0, False, 5.0, None), (None, 0.0, False, 5.0, None),
])
def test_durations(spark, event, censor, observed, horizon, want):
    at = lambda days: None if days is None else START + dt.timedelta(days=days)
    rows = spark.createDataFrame([(at(0), at(event), at(censor), observed, horizon)], "p timestamp_ntz, e timestamp_ntz, c timestamp_ntz, o boolean, h double")
    got = durations.with_duration(rows, F.col("p"), F.col("e"), F.col("c"), F.col("o"), F.col("h")).collect()
    assert [(r["time_to_event"], r["event_observed"]) for r in got] == ([] if want is None else [want])


def test_piecewise_target(spark):
    row = spark.createDataFrame([(2.5, True, 5.0)], "t double, e boolean, h double")
    target = durations.piecewise_target(F.col("t"), F.col("e"), F.col("h"), 6)
    got = row.select(*[c.alias(n) for n, c in target.items()]).first()
    assert got["exposure"] == [1, 1, 0.5, 0, 0, 0] and got["event_bins"] == [0, 0, 1, 0, 0, 0] and got["stage_mask"] == [1, 1, 1, 1, 1, 0]


def test_conflicting_labels_go(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 1, "x"), ("a", 2, "x"), ("a", 2, "y")], "s string, t int, value string")
    assert [tuple(r) for r in lf.clean_labels(rows, ["s", "t"], "value").collect()] == [("a", 1, "x")]


def sequential_batches(lengths, budget, max_batch):
    batches, current, longest = [], [], 0
    for i in sorted(range(len(lengths)), key=lambda k: (lengths[k], k)):
        peak = max(longest, lengths[i])
        if current and ((len(current) + 1) * peak > budget or len(current) >= max_batch):
            batches.append(current)
            current, longest = [], 0
        current.append(i)
        longest = max(longest, lengths[i])
    return batches + ([current] if current else [])


@pytest.mark.parametrize("budget,max_batch", [(40, 4), (12, 50), (200, 7)])
def test_token_batches_equal_sequential_cut(spark, budget, max_batch):
    rng = random.Random(budget)
    lengths = [rng.randrange(1, 30) for _ in range(150)]
    frame = spark.createDataFrame(list(enumerate(lengths)), "sample_idx bigint, table_length int")
    got = {r["sample_idx"]: r["batch"] for r in batching.token_batches(frame, budget, max_batch, 25).collect()}
    want = {i: n for n, batch in enumerate(sequential_batches([min(v, 25) for v in lengths], budget, max_batch)) for i in batch}
    assert got == want


def test_batches_go_to_the_least_loaded(spark):
    rng = random.Random(5)
    costs = [rng.choice([3, 5, 8, 8, 13]) for _ in range(60)]
    frame = spark.createDataFrame(list(enumerate(costs)), "batch bigint, cost bigint")
    shares = {r["batch"]: r["worker"] for r in batching.distribute_batches(frame, 4).collect()}
    loads = [0] * 4
    for cost in sorted(costs, reverse=True):
        loads[loads.index(min(loads))] += cost
    got = [0] * 4
    for i, cost in enumerate(costs):
        got[shares[i]] += cost
    assert sorted(got) == sorted(loads) and len(shares) == 60


def test_variable_batches(spark):
    rng = random.Random(9)
    lengths = [rng.randrange(1, 40) for _ in range(120)]
    frame = spark.createDataFrame(list(enumerate(lengths)), "sample_idx bigint, table_length int")
    got = {r["sample_idx"]: r["batch"] for r in batching.variable_batches(frame, 64, 5, 2, 64).collect()}
    order = sorted(range(120), key=lambda i: (-lengths[i], i))
    want, start, n = {}, 0, 0
    while start < len(order):
        size = max(1, min(5, 64 // lengths[order[start]])) * 2
        for i in order[start:start + size]:
            want[i] = n
        start, n = start + size, n + 1
    assert got == want


@pytest.mark.parametrize("total,sizes", [(10, {"a": 2, "b": 50, "c": 50}), (7, {"a": 3, "b": 3, "c": 90}), (500, {"a": 3, "b": 4}), (1, {"a": 5, "b": 5})])
def test_quota_is_fair_share(spark, total, sizes):
    rows = spark.createDataFrame([(k, i) for k, n in sizes.items() for i in range(n)], "k string, i int")
    got = {r["k"]: r["_quota"] for r in splits.quota_table(rows, ["k"], total).collect()}
    left, classes, want = total, len(sizes), {}
    for k in sorted(sizes, key=lambda c: (sizes[c], c)):
        want[k] = min(sizes[k], left // classes)
        left, classes = left - want[k], classes - 1
    assert got == want


def test_splits_are_disjoint_and_complete(spark):
    people = spark.range(503).select(F.col("id"), (F.col("id") % 3 == 0).cast("int").alias("a"), (F.col("id") % 50 == 0).cast("int").alias("b"))
    split = splits.stratified_split(splits.strata(people, "id", ["a", "b"]), "id", 100, 200)
    counts = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    assert split.select("id").distinct().count() == split.count() == 503
    assert counts == {"train": 503 - 150, "val": counts["val"], "test": counts["test"]} and abs(counts["test"] - 100) <= 1
    rates = {r["split"]: r["a"] for r in splits.split_label_rates(split, people, "id", ["a", "b"]).collect()}
    assert all(math.isclose(v, 1 / 3, abs_tol=0.05) for v in rates.values())


def test_holdout_covers_classes(spark):
    people = spark.range(200).select("id", (F.col("id") % 97 == 0).cast("int").alias("rare"), F.when(F.col("id") > 5, (F.col("id") % 2).cast("int")).alias("b"))
    split = splits.covering_holdout(people, "id", ["rare", "b"], 100).join(people, "id")
    seen = {(r["split"], r["rare"]) for r in split.collect()}
    assert {("holdout", 1), ("train", 1), ("holdout", 0), ("train", 0)} <= seen


def test_vocabulary_grows_without_moving_an_id(spark):
    from cohortline.operators import features as ft

    make = lambda *texts: spark.createDataFrame([(t,) for t in texts], "text string")
    first = ft.vocabulary(make("b", "d", "b", "[PAD]"))
    second = ft.grown_vocabulary(first, make("a", "d", "z", "c", "a", "[UNK]", None))
    third = ft.grown_vocabulary(second, make("d"))
    ids = {r["text"]: r["id"] for r in second.collect()}
    assert ids == {"[PAD]": 0, "[UNK]": 1, "[MASK]": 2, "b": 3, "d": 4, "a": 5, "c": 6, "z": 7}
    assert {r["text"]: r["id"] for r in third.collect()} == ids
    assert {r["text"]: r["id"] for r in ft.grown_vocabulary(first.limit(0), make("q")).collect()} == {"q": 3}


def test_subject_without_a_dated_report_has_no_operation(spark):
    rows = spark.createDataFrame(
        [("a", 3.0, START), ("a", 1.0, None), ("a", None, START), ("b", None, START), ("b", 2.0, None)], "subject string, day double, report_time timestamp_ntz"
    )
    assert [tuple(r) for r in lf.surgery_dates(rows).collect()] == [("a", START - dt.timedelta(days=3))]


def test_concept_patterns_stay_above_the_grouping_of_labels(spark):
    from cohortline.operators import concepts

    rows = spark.createDataFrame([("Hemoglobin A",), ("WBC count",), ("Glucose, urine",), (None,)] * 3, "item string")
    found = concepts.classify_labels(rows, "item")
    assert sorted(map(tuple, found.distinct().collect())) == [("Hemoglobin A", "hemoglobin"), ("WBC count", "white_blood_cell_count")]
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    patterns = [k for k, line in enumerate(plan) if "RLIKE" in line.upper()]
    grouped = [k for k, line in enumerate(plan) if "Aggregate [" in line]
    assert patterns and grouped and max(patterns) < min(grouped)


def test_encounters_of_drawn_subjects_alone_are_numbered(spark, monkeypatch):
    values = spark.range(400).selectExpr(
        "'train' AS split", "0 AS query_id", "'s' AS scope", "cast(id % 2 as string) AS diagnosis", "cast(id % 40 as string) AS patient", "id AS record_index", "id / 2.0D AS value")
    groups = pr.pair_groups(values)
    numbered, plain = {}, pr.position

    def counted(df, keys, order, name, *more, **named):
        numbered[name] = df.count()
        return plain(df, keys, order, name, *more, **named)

    monkeypatch.setattr(pr, "position", counted)
    queries = spark.createDataFrame([(0,)], "query_id int")
    assert len(pr.sample_pairs(values, groups, pr.query_scale(values, groups), queries, 1, "train").collect()) == 1
    assert numbered == {"patient_index": 20, "encounter_index": 20}


def statistic_cases(spark):
    """Keys with ties in time, gaps over many time buckets, untimed rows, one time only, and a null key."""
    rolled = random.Random(7)
    data = []
    for key in (*range(12), None):
        for i in range(rolled.randrange(1, 9)):
            at = None if rolled.random() < 0.15 else START + dt.timedelta(days=rolled.choice((0, 0, 1, 89, 90, 400)), seconds=rolled.choice((0, 1, 7000)))
            data.append((key, "x", at, float(rolled.randrange(-5, 50)) / 3, i))
    return data, spark.createDataFrame(data, "e long, s string, time timestamp_ntz, value_num double, i int")


def plain_statistics(rows):
    """The six statistics of one key's rows (time, value, place), one by one."""
    timed = sorted((t, i, v) for t, v, i in rows if t is not None)
    untimed = [(i, v) for t, v, i in rows if t is None]
    values = [v for _, v, _ in rows]
    found = {"latest": max(untimed)[1] if untimed else timed[-1][2], "min": min(values), "max": max(values), "delta": None, "slope": None, "time_weighted_mean": None}
    times = sorted({t for t, _, _ in timed})
    if len(times) > 1:
        h = [(t - times[0]).total_seconds() / 3600 for t in times]
        means = [sum(v for a, _, v in timed if a == t) / sum(a == t for a, _, _ in timed) for t in times]
        found["delta"] = means[-1] - means[0]
        found["time_weighted_mean"] = sum((h[k + 1] - h[k]) * (means[k] + means[k + 1]) / 2 for k in range(len(h) - 1)) / h[-1]
        if len(timed) > 2:
            x = [(t - times[0]).total_seconds() / 3600 for t, _, _ in timed]
            y = [v for _, _, v in timed]
            mx, my = sum(x) / len(x), sum(y) / len(y)
            found["slope"] = sum((a - mx) * (c - my) for a, c in zip(x, y, strict=True)) / sum((a - mx) ** 2 for a in x)
    return found


@pytest.mark.parametrize("bucket_seconds", [90 * 86_400, 1, None])
def test_six_statistics_are_those_of_plain_loops(spark, bucket_seconds):
    data, rows = statistic_cases(spark)
    got = {r["e"]: r for r in ph.six_statistics(rows, ["s", "e"], order=["i"], bucket_seconds=bucket_seconds).collect()}
    for key in {d[0] for d in data}:
        want = plain_statistics([d[2:] for d in data if d[0] == key])
        assert {s: got[key][s] for s in want} == {s: v if v is None else pytest.approx(v, rel=1e-9, abs=1e-12) for s, v in want.items()}


def test_slope_of_close_times_long_after_the_bucket_starts(spark):
    at = dt.datetime(2020, 2, 20, 12)
    rows = [("e", at + dt.timedelta(microseconds=k), 1e6 + 2.0 * k, k) for k in (0, 1, 2, 5)]
    got = ph.six_statistics(spark.createDataFrame(rows, "e string, time timestamp_ntz, value_num double, i int"), ["e"], order=["i"]).first()
    assert got["slope"] == pytest.approx(2.0 * 3.6e9, rel=1e-6)


def test_statistics_read_their_rows_once(spark):
    """F8 F12 F14: joined twice, once for the values and once for the curve, before."""
    _, rows = statistic_cases(spark)
    plan = ph.six_statistics(rows, ["s", "e"], order=["i"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("LogicalRDD") + plan.count("LocalRelation") == 1


def cell_stats(spark):
    rolled = random.Random(3)
    rows = []
    for k in range(300):
        values = [None if rolled.random() < 0.4 else float(rolled.randrange(20)) for _ in ph.STATISTICS]
        values[0] = float("nan") if k % 17 == 0 else values[0]
        patient = rolled.randrange(25)
        rows.append((("val", "train")[patient % 2], rolled.randrange(3), "s", rolled.choice(("a", "b", None)), str(patient), k, *values))
    rows.append(("train", 2, "s", "alone", "1", 900, *[5.0] * 6))
    names = ", ".join(f"{s} double" for s in ph.STATISTICS)
    return spark.createDataFrame(rows, f"split string, item int, scope string, diagnosis string, patient string, record_index long, {names}")


def test_cells_give_the_groups_scales_and_numbers_of_long_values(spark):
    from cohortline.plans.sampling import statistic_values

    def plain(df):
        return sorted(str(tuple(round(x, 9) if isinstance(x, float) else x for x in r)) for r in df.select(sorted(df.columns)).collect())

    stats = cell_stats(spark)
    values = statistic_values(stats)
    subjects = pr.cell_subjects(stats, ph.STATISTICS)
    groups = pr.pair_groups(values)
    assert plain(pr.cell_groups(subjects, ph.STATISTICS)) == plain(groups)
    assert plain(pr.group_scale(values)) == plain(pr.query_scale(values, groups))
    for width in (4, 65_536):
        assert plain(pr.cell_subject_index(subjects, groups, ph.STATISTICS, width)) == plain(pr.subject_index(values, groups))


def test_ranks_count_points_by_their_weight(spark):
    rows = [("a", 0, 1, 0.1, 2.0), ("a", 0, 1, 0.3, 3.0), ("a", 0, 0, 0.2, 0.5), ("a", 0, 2, 0.4, 0.5)]
    entries = spark.createDataFrame(rows, "k string, grid int, mark int, value double, weight double")
    got = ms.weighted_ranks(entries, ["k", "grid"], 4).first()
    assert (got["points"], got["weight"], got["low"], got["high"]) == (5, 0.5, 1.0, 2.5)


def test_rows_stay_where_they_are_for_step_values(spark):
    curve = spark.createDataFrame([("a", 1.0, 0.5), ("a", 2.0, 0.25)], "k string, time double, survival double")
    rows = spark.createDataFrame([("a", 0.5), ("a", 1.5), ("a", 1.5), ("a", None), (None, 2.0)], "k string, time double")
    found = ms.step_value_of_rows(rows, curve, ["k"], "time", "g")
    assert "BroadcastHashJoin" in found._jdf.queryExecution().toString()
    plain = ms.step_value(rows, curve, ["k"], "time", "g")
    assert sorted(map(str, found.select("k", "time", "g").collect())) == sorted(map(str, plain.select("k", "time", "g").collect()))
