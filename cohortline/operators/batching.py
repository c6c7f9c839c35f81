"""Token-budget batches from table lengths.

A batch plan depends on the lengths only through their histogram, which has at most `max_len` rows. The
greedy cut is done on that histogram; the samples are then placed by their rank among equal lengths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortline.operators.ordered import position


def _ranked(lengths: DataFrame, max_len: int, width: int) -> DataFrame:
    held = lengths.withColumn("len", F.least(F.greatest(F.col("table_length").cast("int"), F.lit(1)), F.lit(max_len)))
    return position(held, ["len"], ["sample_idx"], "rank", F.floor(F.col("sample_idx") / width))


def _histogram(lengths: DataFrame, max_len: int) -> list[tuple[int, int]]:
    """(length, samples), shortest first: at most `max_len` rows reach the driver."""
    held = F.least(F.greatest(F.col("table_length").cast("int"), F.lit(1)), F.lit(max_len)).alias("len")
    return [(r["len"], r["n"]) for r in lengths.groupBy(held).agg(F.count(F.lit(1)).alias("n")).orderBy("len").collect()]


def shortest_first_plan(histogram: list[tuple[int, int]], budget: int, max_batch: int) -> list[tuple[int, int, int, int]]:
    """Per length: rows that still fit the open batch, that batch, the next batch, rows per further batch."""
    plan, batch, filled = [], 0, 0
    for length, n in histogram:
        cap = max(1, min(max_batch, budget // length))
        room = min(n, max(0, cap - filled)) if filled else 0
        current = batch
        if n > room:
            rest = n - room
            batch += 1 if filled else 0
            plan.append((length, room, current, batch, cap))
            full = -(-rest // cap)
            batch += full - 1
            filled = rest - (full - 1) * cap
        else:
            plan.append((length, room, current, current, cap))
            filled += n
    return plan


def token_batches(lengths: DataFrame, budget: int, max_batch: int, max_len: int, width: int = 65_536) -> DataFrame:
    """Batch of each sample: shortest first, a batch closes when one more row would break budget or size."""
    plan = shortest_first_plan(_histogram(lengths, max_len), budget, max_batch)
    table = lengths.sparkSession.createDataFrame(plan, "len int, room bigint, open bigint, next bigint, cap bigint")
    # at most max_len rows: safe to broadcast
    placed = _ranked(lengths, max_len, width).join(F.broadcast(table), "len")
    batch = F.when(F.col("rank") < F.col("room"), F.col("open")).otherwise(
        F.col("next") + F.floor((F.col("rank") - F.col("room")) / F.col("cap"))
    )
    return placed.select("sample_idx", F.col("len").alias("length"), batch.cast("bigint").alias("batch"))


def batch_costs(batches: DataFrame) -> DataFrame:
    """Rows, longest row and padded cost of each batch."""
    return batches.groupBy("batch").agg(F.count(F.lit(1)).alias("rows"), F.max("length").alias("longest")).withColumn(
        "cost", F.col("rows") * F.col("longest")
    )


def _least_loaded_shares(loads: list[int], cost: int, n: int) -> list[int]:
    """How many of `n` equal costs each worker gets when each goes to the least loaded, lowest number first."""
    def taken(level: int) -> list[int]:
        return [0 if level < load else (level - load) // cost + 1 for load in loads]

    low, high = min(loads), max(loads) + cost * n
    while low < high:
        middle = (low + high) // 2
        if sum(taken(middle)) >= n:
            high = middle
        else:
            low = middle + 1
    shares = taken(low - 1)
    rest = n - sum(shares)
    for i, load in enumerate(loads):
        if rest and load <= low and (low - load) % cost == 0:
            shares[i] += 1
            rest -= 1
    return shares


def distribute_batches(costs: DataFrame, workers: int) -> DataFrame:
    """Worker of each batch: the dearest first, always to the least loaded worker.

    Batches of one cost are alike, so only their number matters: the rule runs over the distinct costs
    (bounded by max batch size times max length), and batches find their worker by their rank in a cost.
    """
    histogram = costs.groupBy("cost").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("cost").desc()).collect()
    loads, rows = [0] * workers, []
    for row in histogram:
        cost, n = int(row["cost"]), int(row["n"])
        start = 0
        for worker, share in enumerate(_least_loaded_shares(loads, cost, n)):
            if share:
                rows.append((cost, start, start + share, worker))
                loads[worker] += share * cost
                start += share
    table = costs.sparkSession.createDataFrame(rows, "cost bigint, first bigint, stop bigint, worker int")
    shares = table.groupBy("cost").agg(F.collect_list(F.struct("first", "stop", "worker")).alias("shares"))
    ranked = position(costs, ["cost"], ["batch"], "rank", F.floor(F.col("batch") / 65_536))
    mine = F.filter("shares", lambda s: (s["first"] <= F.col("rank")) & (F.col("rank") < s["stop"]))
    return ranked.join(shares, "cost").select("batch", "cost", F.element_at(mine, 1)["worker"].alias("worker"))


def longest_first_plan(
    histogram: list[tuple[int, int]], budget: int, max_batch: int, workers: int
) -> list[tuple[int, int, int, int, int]]:
    """Per length, longest first: rows that fill the open batch, that batch, the next one, rows per batch."""
    plan, batch, room = [], -1, 0
    for length, n in sorted(histogram, reverse=True):
        size = max(1, min(max_batch, budget // length)) * workers
        into_open = min(n, room)
        rest = n - into_open
        plan.append((length, into_open, max(batch, 0), batch + 1, size))
        room -= into_open
        if rest:
            full = -(-rest // size)
            batch += full
            room = full * size - rest
    return plan


def variable_batches(lengths: DataFrame, budget: int, max_batch: int, workers: int, max_len: int, width: int = 65_536) -> DataFrame:
    """Batch of each sample, longest first; the longest row sets the size, which is the same on all workers."""
    plan = longest_first_plan(_histogram(lengths, max_len), budget, max_batch, workers)
    table = lengths.sparkSession.createDataFrame(plan, "len int, room bigint, open bigint, next bigint, size bigint")
    placed = _ranked(lengths, max_len, width).join(F.broadcast(table), "len")
    batch = F.when(F.col("rank") < F.col("room"), F.col("open")).otherwise(
        F.col("next") + F.floor((F.col("rank") - F.col("room")) / F.col("size"))
    )
    return placed.select("sample_idx", F.col("len").alias("length"), batch.cast("bigint").alias("batch"))
