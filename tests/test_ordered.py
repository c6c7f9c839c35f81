"""Bucketed scans must equal plain windows, with one key that holds most of the rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortline.operators.joins import dyadic_cover, reference_range, within_interval
from cohortline.operators.ordered import BUCKET, Running, lookup, position, range_buckets, runs, scan
from cohortline.plans.registry import load_all


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = [
        ("hot" if rng.random() < 0.6 else f"k{rng.randrange(5)}", rng.randrange(300), i, rng.choice("abc"),
         None if rng.random() < 0.4 else rng.randrange(50))
        for i in range(900)
    ]
    return spark.createDataFrame(data, "key string, t int, i int, kind string, v int").cache()


@pytest.mark.parametrize("bucket", [None, 40])
@pytest.mark.parametrize("descending", [False, True])
def test_scan_equals_window(rows, bucket, descending):
    steps = [
        Running("total", "sum", F.col("v")), Running("seen", "last", F.col("v"), inclusive=False),
        Running("top", "max", F.col("v")), Running("low", "min", F.col("v"), inclusive=False),
    ]
    cut = None if bucket is None else F.floor(F.col("t") / bucket)
    got = scan(rows, ["key"], ["t", "i"], steps, cut, descending)
    order = [F.desc("t"), F.desc("i")] if descending else ["t", "i"]
    w = Window.partitionBy("key").orderBy(*order)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    want = rows.select(
        "*", F.coalesce(F.sum("v").over(upto), F.lit(0)).alias("total"), F.last("v", True).over(before).alias("seen"),
        F.max("v").over(upto).alias("top"), F.min("v").over(before).alias("low"),
    )
    assert sorted(got.collect(), key=lambda r: r["i"]) == sorted(want.collect(), key=lambda r: r["i"])


def test_position_and_runs(rows):
    numbered = position(rows, ["key"], ["t", "i"], "p", F.floor(F.col("t") / 25))
    w = Window.partitionBy("key").orderBy("t", "i")
    assert numbered.where(F.col("p") < 0).count() == 0
    same = numbered.withColumn("w", F.row_number().over(w) - 1).where("p <> w").count()
    assert same == 0
    change = F.coalesce((F.lag("kind").over(w) != F.col("kind")).cast("int"), F.lit(0))
    for bucket in (F.floor(F.col("t") / 25), None):
        islands = runs(rows, ["key"], ["t", "i"], "kind", "run", bucket)
        want = islands.withColumn("c", change).withColumn("w", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        assert want.where("run <> w").count() == 0


def test_hot_key_is_spread(rows):
    spread = range_buckets(rows, ["key"], ["t", "i"]).where("key = 'hot'").groupBy(BUCKET).count()
    assert spread.count() > 1


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("after", [False, True])
def test_lookup_equals_join(spark, rows, strict, after):
    points = rows.where("v IS NOT NULL").select("key", F.col("t").alias("at"), "v")
    asked = rows.select("key", "i", (F.col("t") + 3).alias("q"))
    got = lookup(
        asked, points, ["key"], "q", "at", [Running("n", "sum", F.when(F.col("_p_v").isNotNull(), 1)), Running("m", "max", F.col("_p_v"))],
        strict=strict, after=after, bucket=F.floor(F.col("_at") / 30),
    )
    side = {(False, False): "at <= q", (True, False): "at < q", (False, True): "at >= q", (True, True): "at > q"}[(strict, after)]
    joined = asked.alias("a").join(points.alias("p"), "key").where(side).groupBy("key", "i").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("m"))
    want = {(r["key"], r["i"]): (r["n"], r["m"]) for r in joined.collect()}
    found = {(r["key"], r["i"]): (r["n"], r["m"]) for r in got.collect()}
    assert len(found) == asked.count()
    assert all(want.get(k, (0, None)) == v for k, v in found.items())


def test_interval_join_equals_range_join(spark, rows):
    stays = rows.where("i % 9 = 0").select("key", F.col("i").alias("stay"), F.col("t").alias("low"), (F.col("t") + F.col("i") % 40).alias("high"))
    points = rows.select("key", F.col("t").alias("at"), "i")
    got = within_interval(stays, points, ["key"], "low", "high", "at", 16).select("stay", "i")
    want = stays.join(points, "key").where("at BETWEEN low AND high").select("stay", "i")
    assert sorted(got.collect()) == sorted(want.collect())


def test_interval_join_plan_has_equi_key(spark, rows, capsys):
    stays = rows.select("key", F.col("t").alias("low"), (F.col("t") + 5).alias("high"))
    points = rows.select("key", F.col("t").alias("at"))
    within_interval(stays, points, ["key"], "low", "high", "at", 16).explain()
    plan = capsys.readouterr().out
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_null_keys_and_second_round(spark):
    data = [(None if i % 4 == 0 else i % 3, "a" if i % 5 else None, i % 17, i) for i in range(400)]
    rows = spark.createDataFrame(data, "k int, s string, t int, i int")
    first = [Running("n", "sum", F.lit(1).cast("bigint")), Running("x", "xor", F.xxhash64("i"))]
    then = [Running("best", "max", F.col("n") * 10 + F.col("t"), inclusive=False)]
    got = scan(rows, ["k", "s"], ["t", "i"], first, F.floor(F.col("t") / 4), then=then)
    w = Window.partitionBy("k", "s").orderBy("t", "i")
    want = rows.withColumn("n", F.row_number().over(w).cast("bigint")).withColumn("x", F.bit_xor(F.xxhash64("i")).over(w)).withColumn(
        "best", F.max(F.col("n") * 10 + F.col("t")).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    assert got.columns == want.columns
    assert sorted(got.collect(), key=lambda r: r["i"]) == sorted(want.collect(), key=lambda r: r["i"])


@pytest.mark.parametrize("strict,after", [(False, False), (True, False), (False, True), (True, True)])
def test_lookup_within_one_table(spark, strict, after):
    data = [(i % 3, (i * 7) % 50 if i % 6 else None, (i * 11) % 60, i) for i in range(240)]
    rows = spark.createDataFrame(data, "k int, at int, ask int, i int")
    steps = [Running("low", "min", F.col("_p_i")), Running("n", "sum", F.when(F.col("_p_i").isNotNull(), 1))]
    found = lookup(F.col("i") % 2 == 0, rows, ["k"], "ask", "at", steps, strict, after, bucket=F.floor(F.col("_at") / 8),
                   held=["i"], is_point=F.col("at").isNotNull())
    inside = {(False, False): lambda p, q: p <= q, (True, False): lambda p, q: p < q, (False, True): lambda p, q: p >= q, (True, True): lambda p, q: p > q}[strict, after]
    got = {r["i"]: (r["low"], r["n"]) for r in found.collect()}
    assert len(got) == 120
    for k, _, ask, i in data:
        if i % 2 == 0:
            hits = [j for key, at, _, j in data if key == k and at is not None and inside(at, ask)]
            assert got[i] == (min(hits, default=None), len(hits))


@pytest.mark.parametrize("name", ["event_blocks", "forward_context", "backward_context", "emergency_context", "between_discharges", "last_admission_and_discharge"])
def test_a_file_is_read_once(spark, sf_dir, name):
    """Bucket totals and local scans share one shuffle of the rows, so the events are scanned once however many scans there are."""
    df = load_all()[name].job(spark, sf_dir)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "isFinalPlan=true" in final and final.count("FileScan") == 1 and "ReusedExchange" in final


def test_long_and_short_intervals(spark):
    rng = random.Random(3)
    stays = []
    for i in range(120):
        low = rng.randrange(-2_000_000, 2_000_000)
        stays.append((i % 3 if i % 10 else None, i, low, low + int(10 ** rng.uniform(0, 6.3)) - (2 if i % 17 == 0 else 0)))
    points = [(i % 3, i, rng.randrange(-2_500_000, 4_500_000)) for i in range(600)] + [(i % 3, 1000 + i, x) for i in range(30) for x in stays[i][2:4]]
    a = spark.createDataFrame(stays, "key int, stay int, low long, high long")
    b = spark.createDataFrame(points, "key int, i int, at long")
    for width in (1, 7):
        got = sorted(tuple(r) for r in within_interval(a, b, ["key"], "low", "high", "at", width).select("stay", "i", "at").collect())
        assert got == sorted((s, i, x) for k, s, low, high in stays for key, i, x in points if k == key and low <= x <= high)
    covers = a.where("low <= high").select("low", "high", dyadic_cover(F.col("low"), F.col("high")).alias("n")).collect()
    for r in covers:
        held = sorted((n["node"] << n["level"], (n["node"] + 1) << n["level"]) for n in r["n"])
        assert len(held) <= 2 * (r["high"] - r["low"] + 1).bit_length() + 2
        assert held[0][0] == r["low"] and held[-1][1] == r["high"] + 1 and all(x[1] == y[0] for x, y in zip(held, held[1:]))


RANGE_KIND = "item string, place int, age_min double, age_max double, range_gender string, low double, high double, unit string"


def test_reference_ranges_against_all(spark):
    rng = random.Random(11)
    ranges = []
    for place in range(160):
        low = rng.randrange(0, 60) / 2
        ranges.append((f"i{place % 4}", place // 2, low, low + rng.choice([-1, 0, 0.5, 3, 20]), rng.choice([None, "M", "F", "X"]), float(place), None if place % 9 == 0 else place + 0.5, "u"))
    rows = [(n, rng.choice(["i0", "i1", "i2", "i3", "none", None]), rng.choice([None, *[k / 4 for k in range(-4, 140)]]), rng.choice(["M", "F", "Z", None])) for n in range(500)]
    got = reference_range(spark.createDataFrame(rows, "n int, item string, age double, gender string"), spark.createDataFrame(ranges, RANGE_KIND))
    assert got.columns == ["n", "item", "age", "gender", "low", "high", "range_unit"]
    found = {r["n"]: (r["low"], r["high"], r["range_unit"]) for r in got.collect()}
    assert len(found) == len(rows)
    for n, item, age, gender in rows:
        fits = [(p, lo, hi, u) for i, p, a, z, g, lo, hi, u in ranges if item == i and age is not None and a <= age < z and (g is None or g == gender)]
        first = min(fits, key=lambda f: (f[0], f[1]), default=None)
        assert found[n] == (first[1:] if first else (None, None, None))


def test_a_million_ranges(spark):
    ranges = spark.range(1_000_000).selectExpr(
        "concat('i', id % 20000) AS item", "cast(id div 20000 AS int) AS place", "cast(id div 20000 AS double) AS age_min", "cast(id div 20000 + 2 AS double) AS age_max",
        "cast(null AS string) AS range_gender", "cast(id AS double) AS low", "cast(id AS double) AS high", "'u' AS unit")
    rows = spark.range(2000).selectExpr("id", "concat('i', id * 7 % 20000) AS item", "cast(id % 50 + 0.5 AS double) AS age", "'M' AS gender")
    wrong = reference_range(rows, ranges).where("low IS NULL OR low <> cast((greatest(id % 50, 1) - 1) * 20000 + id * 7 % 20000 AS double)")
    assert wrong.count() == 0
