"""Packing token sequences by cutting stock: column generation over a histogram of lengths, patterns given to ranked pieces."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from cohortline.llm.common import row_function, utf8
from cohortline.llm.tokens import encoder
from cohortline.session import cut

LENGTH = 2048
#: Lengths are rounded up to whole units for the patterns, so the linear program has LENGTH / UNIT rows at most
UNIT = 8
END = 1
#: Pieces ranked together; a class has as many lots as it needs
LOT = 50_000
PIECES = T.StructType([
    T.StructField("doc_tokens", T.LongType()),
    T.StructField("pieces", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])))])


def price(duals: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern: how many pieces of each size 1..n fill at most `capacity`, by dynamic programming."""
    sizes = np.arange(1, len(duals) + 1)
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        worth = best[c - sizes[:c]] + duals[:c]
        k = int(worth.argmax())
        best[c], choice[c] = (worth[k], k + 1) if worth[k] > best[c - 1] else (best[c - 1], 0)
    pattern, c = np.zeros(len(duals), np.int64), capacity
    while c > 0:
        pattern[choice[c] - 1] += choice[c] > 0
        c -= max(1, int(choice[c]))
    return float(best[capacity]), pattern


def greedy(demand: np.ndarray, capacity: int) -> np.ndarray:
    """Patterns to begin with, one in each row: the largest sizes left that fit, used as long as their pieces last."""
    left, found = demand.astype(np.int64).copy(), []
    while left.any():
        column, room = np.zeros(len(left), np.int64), capacity
        for k in np.flatnonzero(left)[::-1].tolist():
            column[k] = n = min(int(left[k]), room // (k + 1))
            room -= n * (k + 1)
        has = column > 0
        left -= int((left[has] // column[has]).min()) * column
        found.append(column)
    return np.array(found)


def patterns(demand: np.ndarray, capacity: int, rounds: int = 5000, gap: float = 0.002) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values of the linear program: fewest sequences whose patterns hold the demanded pieces of each size.

    Revised simplex; each round prices one new column with the dual values and ends when none is worth more than 1 + gap, which
    proves the value to be within that share of the least. If the rounds run out the solution is whole, only not yet the best.
    """
    rows = np.flatnonzero(demand)
    exact = demand[rows].astype(float)
    wanted = exact + np.random.default_rng(0).random(len(rows)) * exact.mean() * 1e-3  # no two bases alike: no cycles
    basis = np.diag(capacity // (rows + 1)).astype(float)
    inverse = np.diag(1.0 / np.diag(basis))
    times = lambda matrix, vector: (matrix * vector).sum(axis=1)  # noqa: E731  small, and free of a linear algebra library's threads
    amounts = times(inverse, wanted)
    pool, pooled = greedy(demand, capacity), True
    for _ in range(rounds):
        duals = np.full(len(demand), -1.0)
        duals[rows] = inverse.sum(axis=0)
        if pooled:
            worth = times(pool, duals)
            value, pattern = worth.max(), pool[worth.argmax()]
            pooled = value > 1 + gap
        if not pooled:
            value, pattern = price(duals, capacity)
        if value <= 1 + gap:
            break
        entering = pattern[rows].astype(float)
        step = times(inverse, entering)
        able = np.flatnonzero(step > 1e-9)
        leaving = able[(amounts[able] / step[able]).argmin()]
        amount = amounts[leaving] / step[leaving]
        amounts -= amount * step
        amounts[leaving] = amount
        basis[:, leaving] = entering
        row = inverse[leaving] / step[leaving]
        inverse -= np.outer(step, row)
        inverse[leaving] = row
    whole = np.zeros((len(demand), len(rows)), np.int64)
    whole[rows] = basis.round().astype(np.int64)
    return whole, np.maximum(times(inverse, exact), 0)


def plan(demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns with how often each is used; together they hold each demanded piece just once.

    The linear program's values are rounded down; the few pieces left are put, largest first, where they fit best.
    """
    if not demand.any():
        return []
    columns, amounts = patterns(demand, capacity)
    left, used = demand.astype(np.int64).copy(), []
    for k in np.argsort(-amounts, kind="stable"):
        column = columns[:, k]
        has = column > 0
        n = min(int(amounts[k] + 1e-6), int((left[has] // column[has]).min()))
        if n > 0:
            left -= n * column
            used.append((column, n))
    bins: list[list[int]] = []
    room: list[int] = []
    for size in range(len(left), 0, -1):
        for _ in range(int(left[size - 1])):
            fit = min((r, b) for b, r in enumerate(room) if r >= size) if any(r >= size for r in room) else None
            if fit is None:
                bins.append([size])
                room.append(capacity - size)
            else:
                bins[fit[1]].append(size)
                room[fit[1]] -= size
    for held in bins:
        used.append((np.bincount(np.array(held) - 1, minlength=len(left)).astype(np.int64), 1))
    return used


def places(used: list[tuple[np.ndarray, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """For each class the ranges of ranks each pattern takes: (class, first, end, per sequence, first sequence, first slot)."""
    rows, sequence, rank = [], 0, {}
    for column, n in used:
        slot = 0
        for c in np.flatnonzero(column)[::-1].tolist():
            first, each = rank.get(c + 1, 0), int(column[c])
            rows.append((c + 1, first, first + each * n, each, sequence, slot))
            rank[c + 1], slot = first + each * n, slot + each
        sequence += n
    return rows


def pieces(path: str, length: int, end: int | None) -> Callable[[bytes], tuple]:
    """A function from a text to its number of ids and its pieces: full lengths from the start, then the rest."""
    encode, last = encoder(path), b"" if end is None else end.to_bytes(4, "little")

    def of(raw: bytes) -> tuple:
        ids = encode(raw) + last
        n = len(ids) // 4
        return n, [(a, min(length, n - a), zlib.crc32(ids[4 * a:4 * min(a + length, n)])) for a in range(0, n, length)]

    return of


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int | None = END, unit: int = UNIT, lot: int = LOT) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Documents are cut into full lengths and a rest. Null texts are empty and hold the end id alone; without one, a
    document without tokens has no piece. Null ids and repeated rows are documents of their own. Each text is read once;
    the pieces' table is written. Only the histogram of lengths, length / unit numbers, comes to the driver; the linear
    program and its plan grow with that alone. Pieces are ranked in lots by hash, and a sequence's pieces, at most
    length / unit, get their offsets in one window.
    """
    spark = docs.sparkSession
    told = row_function(lambda: pieces(path, length, end), PIECES, ("pieces", path, length, end))(utf8(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), told.alias("t")).select("doc_id", "t.doc_tokens", F.explode("t.pieces").alias("p"))
    rows = rows.select("doc_id", "doc_tokens", "p.*").withColumn("class", F.ceil(F.col("length") / unit).cast("int"))
    rows = cut(rows)
    counts = {r["class"]: r["n"] for r in rows.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}
    classes = -(-length // unit)
    demand = np.array([counts.get(c, 0) for c in range(1, classes + 1)], np.int64)
    where = spark.createDataFrame(places(plan(demand, length // unit)), "class int, first long, until long, each long, sequence long, slot long")
    lots = max(1, -(-int(demand.max(initial=0)) // lot))
    key = ("doc_id", "start", "doc_tokens", "ids_crc32")
    rows = rows.withColumn("lot", F.pmod(F.xxhash64(*key), F.lit(lots)))
    sizes = rows.groupBy("class", "lot").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("class").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(sizes.select("class", "lot", before.alias("before")), ["class", "lot"])
    rank = F.col("before") + F.row_number().over(Window.partitionBy("class", "lot").orderBy(*key)) - 1
    rows = rows.withColumn("rank", rank)
    put = rows.join(F.broadcast(where.withColumnRenamed("class", "_class")), (F.col("class") == F.col("_class")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("until")))
    at = F.col("rank") - F.col("first")
    put = put.withColumn("sequence_id", F.col("sequence") + F.expr("(rank - first) div each")).withColumn("slot", F.col("slot") + at % F.col("each"))
    order = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(order), F.lit(0)).cast("long")
    return put.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset.alias("offset"))
