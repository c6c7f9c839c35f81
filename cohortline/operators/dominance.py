"""Pairs of a question and a point that is lower in one order and later in another, counted without forming them.

Rows are cut by range along the first order. A task counts the pairs inside its part by merging digits of the second
order's ranks, and gives its rows, added up per place in the second order, with its part's number. These are cut by
range along the second order, where a task counts the pairs of different first parts inside its own; what is left are
pairs of different parts in both, which a table of parts by parts adds up. Each row is shuffled twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from cohortline.session import cut

#: Rows of a part, on average
PART_ROWS = 500_000
COUNTS = ["points", "low", "high"]


def above_before(rank: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each entry of a sequence, the weight of earlier entries with a higher rank.

    Two ranks differ first at some binary digit; per digit the entries that agree before it are a run, in which the weight of
    ones so far is counted at the zeros.
    """
    found = np.zeros(len(rank), np.int64)
    for bit in range(int(rank.max(initial=0)).bit_length()):
        order = np.argsort(rank >> (bit + 1), kind="stable")
        prefix, one = rank[order] >> (bit + 1), (rank[order] >> bit) & 1 == 1
        seen = np.cumsum(np.where(one, weight[order], 0))
        first = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]]))
        before = np.repeat(seen[first] - np.where(one[first], weight[order][first], 0), np.diff(np.append(first, len(order))))
        found[order[~one]] += (seen - before)[~one]
    return found


def _groups(table: pa.Table, keys: Sequence[str]) -> Iterator[tuple[dict[str, pa.Array], pa.Table]]:
    """The rows of each key, with the key's values as one-row arrays."""
    if not table.num_rows:
        return
    codes = np.zeros(table.num_rows, np.int64)
    for name in keys:
        held = table[name].combine_chunks().dictionary_encode()
        own = np.asarray(held.indices.fill_null(-1).to_numpy(zero_copy_only=False), np.int64) + 1
        codes = np.unique(codes * (len(held.dictionary) + 1) + own, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(codes, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], np.diff(codes[order]) > 0, [True]]))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        rows = table.take(pa.array(order[a:b]))
        yield {name: rows[name].combine_chunks().slice(0, 1) for name in keys}, rows


def by_key(batches: Iterator[pa.RecordBatch], keys: Sequence[str], each: Callable, names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """A task's rows, key by key, as arrays for `each`, which gives the columns `names`; a time that isn't a number is none."""
    held = list(batches)
    if not held:
        return
    for key, rows in _groups(pa.Table.from_batches(held), keys):
        told = each({c: rows[c].to_numpy() for c in rows.column_names if c not in keys})
        size = len(told[names[0]])
        columns = [pa.concat_arrays([key[k]] * size) if size else key[k].slice(0, 0) for k in keys]
        yield pa.RecordBatch.from_arrays([*columns, *[pa.array(told[n], mask=np.isnan(told[n]) if n == "_t" else None) for n in names]], names=[*keys, *names])


def _parts_along_first(found: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    order = np.lexsort((found["mark"], found["_v"]))
    t, k, mark, w = (found[c][order] for c in ("_t", "_k", "mark", "_w"))
    places, rank = np.unique(np.stack([t, k.astype(float)]), axis=1, return_inverse=True)
    rank = rank.reshape(-1).astype(np.int64)
    points = np.where(mark == 1, w, 0)
    seen = above_before(rank, points)
    sums = [np.bincount(rank, np.where(mark == m, w, 0), places.shape[1]).astype(np.int64) for m in (1, 0, 2)]
    part = TaskContext.get().partitionId()
    add = lambda column, last, kind: np.append(column, np.array([last], kind))
    return {
        "part": np.full(places.shape[1] + 1, part, np.int64), "_t": add(places[0], np.nan, float), "_k": add(places[1].astype(np.int64), 0, np.int64),
        **{c: add(s, 0, np.int64) for c, s in zip(COUNTS, sums, strict=True)},
        "lower": add(np.zeros(places.shape[1], np.int64), int((seen * w)[mark == 0].sum()), np.int64),
        "upper": add(np.zeros(places.shape[1], np.int64), int((seen * w)[mark == 2].sum()), np.int64),
    }


def _parts_along_second(found: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    _, rank = np.unique(np.stack([found["_t"], found["_k"].astype(float)]), axis=1, return_inverse=True)
    rank, size = rank.reshape(-1).astype(np.int64), len(found["part"])
    # of one part's rows the questions come first, so that only points of earlier parts count
    order = np.lexsort((np.repeat([0, 1], size), np.tile(found["part"], 2)))
    seen = np.zeros(2 * size, np.int64)
    seen[order] = above_before(np.tile(rank, 2)[order], np.concatenate([np.zeros(size, np.int64), found["points"]])[order])
    seen = seen[:size]
    firsts, own = np.unique(found["part"], return_inverse=True)
    cells = {c: np.bincount(own.reshape(-1), found[c], len(firsts)).astype(np.int64) for c in COUNTS}
    zero = np.zeros(len(firsts), np.int64)
    lower, upper = zero.copy(), zero.copy()
    lower[0], upper[0] = (seen * found["low"]).sum(), (seen * found["high"]).sum()
    return {"part": firsts.astype(np.int64), "second": np.full(len(firsts), TaskContext.get().partitionId(), np.int64), **cells, "lower": lower, "upper": upper}


def lower_and_later(entries: DataFrame, keys: Sequence[str], rows: int, part_rows: int = PART_ROWS) -> DataFrame:
    """keys, lower, upper: the weighted pairs of a question and a point below it in (_v, mark) and above it in (_t, _k).

    entries: keys, _v, mark (0 question of the lower sum, 1 point, 2 question of the upper one), _t, _k, _w, all but the keys not null;
    `rows` is about their number. Rows alike in one order may lie in different parts of it, whatever their number; those
    of one place in the second order are one row per part of the first.
    """
    keys = list(keys)
    parts = max(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // part_rows))
    kinds = "".join(f"`{k}` {entries.schema[k].dataType.simpleString()}, " for k in keys)
    sums = "points long, low long, high long, lower long, upper long"
    names = [*COUNTS, "lower", "upper"]
    first = entries.repartitionByRange(parts, *keys, "_v", "mark", "_t", "_k").mapInArrow(
        lambda batches: by_key(batches, keys, _parts_along_first, ["part", "_t", "_k", *names]), f"{kinds}part long, _t double, _k long, {sums}")
    first = cut(first)
    second = first.where("_t IS NOT NULL").repartitionByRange(parts, *keys, "_t", "_k").mapInArrow(
        lambda batches: by_key(batches, keys, _parts_along_second, ["part", "second", *names]), f"{kinds}part long, second long, {sums}")
    second = cut(second)
    # at most parts x parts cells, all of them, so that sums run along both
    group = [*keys, "_one"]
    listed = second.withColumn("_one", F.lit(1))
    cells = listed.groupBy(*group, "part", "second").agg(*[F.sum(c).alias(c) for c in COUNTS])
    sides = listed.groupBy(*group).agg(F.collect_set("part").alias("_p"), F.collect_set("second").alias("_s"))
    empty = sides.select(*group, F.explode("_p").alias("part"), "_s").select(*group, "part", F.explode("_s").alias("second"), *[F.lit(0).cast("bigint").alias(c) for c in COUNTS])
    grid = empty.unionByName(cells).groupBy(*group, "part", "second").agg(*[F.sum(c).alias(c) for c in COUNTS])
    before = lambda window: window.rowsBetween(Window.unboundedPreceding, -1)
    later = F.coalesce(F.sum("points").over(before(Window.partitionBy(*group, "part").orderBy(F.desc("second")))), F.lit(0))
    below = F.coalesce(F.sum("later").over(before(Window.partitionBy(*group, "second").orderBy("part"))), F.lit(0))
    far = grid.withColumn("later", later).withColumn("below", below).select(
        *keys, (F.col("below") * F.col("low")).alias("lower"), (F.col("below") * F.col("high")).alias("upper"))
    every = first.where("_t IS NULL").select(*keys, "lower", "upper").unionByName(second.select(*keys, "lower", "upper")).unionByName(far)
    return every.groupBy(*keys).agg(F.sum("lower").alias("lower"), F.sum("upper").alias("upper"))
