"""Order-dependent operators that stay parallel when one key holds most of the rows.

A plain `Window.partitionBy(subject)` puts a whole subject in one task. Here each key is cut into
buckets that follow its order (a time bucket, a hash prefix or, by default, range partitions).
Every bucket is scanned on its own, the last row of a bucket has its total, the totals are combined in a
small second scan, and the carried total is joined back. All supported functions are associative, so the
result is exact. Local scan and totals come from one shuffle of the rows: see `_Parts`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window, WindowSpec

from cohortline.session import cut

BUCKET = "_bucket"


@dataclass(frozen=True)
class Running:
    """One running value: `kind` is sum, last (non-null), max, min or xor over the rows so far."""

    name: str
    kind: str
    value: Column
    inclusive: bool = True


def time_bucket(column: str | Column, seconds: int) -> Column:
    """Bucket number of a time, monotone in it; a missing time goes before all others."""
    stamp = F.unix_micros(F.col(column).cast("timestamp") if isinstance(column, str) else column.cast("timestamp"))
    return F.coalesce(F.floor(stamp / F.lit(1_000_000 * seconds)), F.lit(-(2**40)).cast("bigint"))


def hash_bucket(text: Column, digits: int = 2) -> Column:
    """Bucket from the leading hex digits of a hash; monotone in the hash text."""
    return F.conv(F.substring(text, 1, digits), 16, 10).cast("bigint")


def range_buckets(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Sort by (keys, order) over range partitions and keep the partition number as the bucket.

    Range bounds are sampled, so the rows are written out once: both uses of a bucket then agree.
    A key with very many rows is spread over as many partitions as it needs.
    """
    columns = [F.col(c) for c in (*keys, *order)]
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(partitions, *columns).withColumn(BUCKET, F.spark_partition_id().cast("bigint")))


_OVER = {
    "sum": F.sum,
    "max": F.max,
    "min": F.min,
    "xor": F.bit_xor,
    "last": lambda c: F.last(c, ignorenulls=True),
}


def _total(step: Running, local: Column, value: Column) -> Column:
    """What a bucket adds up to, from its last row."""
    if step.inclusive:
        return local
    return _combine(step, local, value)


def _combine(step: Running, carried: Column, local: Column) -> Column:
    if step.kind == "sum":
        return F.coalesce(carried, F.lit(0)) + F.coalesce(local, F.lit(0))
    if step.kind == "xor":
        return F.coalesce(carried, F.lit(0)).bitwiseXOR(F.coalesce(local, F.lit(0)))
    if step.kind == "last":
        return F.coalesce(local, carried)
    return (F.greatest if step.kind == "max" else F.least)(local, carried)


class _Parts:
    """Rows laid out by (keys, bucket) once, for their local scan and for the totals of the buckets.

    Both come from the same shuffle only if the optimizer asks the same of it for both. So the rows' columns travel
    as one struct that the totals carry along too (the last row's stands for its bucket), and the columns that
    rows and totals are joined on can't be null: no filter is derived for one side alone. The struct counts as nullable,
    so that `coalesce` of both sides' keeps both.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column | None, descending: bool):
        rows = range_buckets(df, keys, order) if bucket is None else df.withColumn(BUCKET, bucket)
        self.columns, self.descending = df.columns, descending
        self.made: list[str] = []
        flats, nulls = {}, F.lit(0)
        for i, name in enumerate(keys):
            column, kind = F.col(name), df.schema[name].dataType
            if df.schema[name].nullable:
                nulls = nulls + F.when(column.isNull(), 1 << i).otherwise(0)
            column = column if isinstance(kind, (T.NumericType, T.StringType)) else column.cast("string")
            flats[f"_k{i}"] = F.coalesce(column, F.lit(0).cast(kind) if isinstance(kind, T.NumericType) else F.lit(""))
        if any(df.schema[name].nullable for name in keys):
            flats["_nulls"] = nulls
        self.keys = [*flats]
        self.parts = [*self.keys, "_b"]
        self.order = [f"_o{i}" for i in range(len(order))]
        whole = F.col(BUCKET).cast("bigint")
        rows = rows.withColumn("_b", F.coalesce(whole, F.lit(-(2**63))))
        self.rows = rows.select(
            *[c.alias(n) for n, c in flats.items()], "_b", *[F.col(c).alias(o) for c, o in zip(order, self.order, strict=True)],
            F.when(F.bit_count("_b") >= 0, F.struct(*[F.col(f"`{c}`") for c in self.columns])).alias("_row"),
        )

    def _sorted(self, names: Sequence[str]) -> list[Column]:
        return [F.col(c).desc() if self.descending else F.col(c).asc() for c in names]

    @property
    def within(self) -> WindowSpec:
        return Window.partitionBy(*self.parts).orderBy(*self._sorted(self.order))

    @property
    def across(self) -> WindowSpec:
        """The buckets of a key, on one row each."""
        return Window.partitionBy(*self.keys).orderBy(*self._sorted(["_b"]))

    @property
    def is_last(self) -> Column:
        return F.lead(F.lit(1)).over(self.within).isNull()

    def values(self, columns: Mapping[str, Column]) -> DataFrame:
        """The rows with further columns, which are made from the rows' own and those made before."""
        fields = [F.col("_row").getField(c).alias(c) for c in self.columns if c not in self.made]
        return self.rows.select("*", *fields).select(*self.rows.columns, *[c.alias(n) for n, c in columns.items()])

    def carried(self, local: DataFrame, carry: DataFrame, named: Sequence[str], made: Mapping[str, Column]) -> None:
        """Join one row per bucket, with the columns `named`, to the rows; `made` are new columns of the result."""
        other = carry.select(*[F.col(c).alias(f"_c{c}") for c in self.parts], F.col("_row").alias("_other"), *named)
        joined = local.join(other, [F.col(c) == F.col(f"_c{c}") for c in self.parts], "left")
        before = [c for c in self.made if c not in made]
        self.made = [*before, *made]
        self.rows = joined.select(
            *self.parts, *self.order, F.coalesce("_row", "_other").alias("_row"), *before, *[c.alias(n) for n, c in made.items()])

    def run(self, steps: Sequence[Running]) -> None:
        local = self.values({f"_value_{s.name}": s.value for s in steps})
        frames = {
            True: self.within.rowsBetween(Window.unboundedPreceding, 0), False: self.within.rowsBetween(Window.unboundedPreceding, -1),
        }
        local = local.select(
            "*", *[_OVER[s.kind](F.col(f"_value_{s.name}")).over(frames[s.inclusive]).alias(f"_local_{s.name}") for s in steps],
            self.is_last.alias("_last"),
        )
        totals = local.where("_last").select(
            *self.parts, "_row", *[_total(s, F.col(f"_local_{s.name}"), F.col(f"_value_{s.name}")).alias(f"_total_{s.name}") for s in steps])
        earlier = self.across.rowsBetween(Window.unboundedPreceding, -1)
        carry = totals.select(
            *self.parts, "_row", *[_OVER[s.kind](F.col(f"_total_{s.name}")).over(earlier).alias(f"_carry_{s.name}") for s in steps])
        self.carried(local, carry, [f"_carry_{s.name}" for s in steps],
                     {s.name: _combine(s, F.col(f"_carry_{s.name}"), F.col(f"_local_{s.name}")) for s in steps})

    def result(self) -> DataFrame:
        return self.rows.select(*[F.col("_row").getField(c).alias(c) for c in self.columns if c not in self.made], *self.made)


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    steps: Sequence[Running],
    bucket: Column | None = None,
    descending: bool = False,
    then: Sequence[Running] = (),
) -> DataFrame:
    """Running values per key in `order` (all ascending, or all descending).

    `order` must be a total order within a key. Null keys are a key of their own. A given `bucket` must follow the
    order and costs no job of its own; without one the rows are cut by range, which also splits a key whose
    rows crowd into one bucket (many rows at one time, say). The steps of `then` may use the results of `steps`
    and share their shuffle. All columns of `df` travel, so select before.
    """
    parts = _Parts(df, keys, order, bucket, descending)
    parts.run(steps)
    if then:
        parts.run(then)
    return parts.result()


def position(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, bucket: Column | None = None,
    start: int = 0, descending: bool = False,
) -> DataFrame:
    """Row position within each key, counted from `start`."""
    ranked = scan(df, keys, order, [Running(name, "sum", F.lit(1).cast("bigint"))], bucket, descending)
    return ranked.withColumn(name, F.col(name) - F.lit(1 - start))


def runs(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], kind: str, name: str, bucket: Column | None = None
) -> DataFrame:
    """Number the runs of equal `kind` per key from 0 (gaps and islands), one shuffle of the rows."""
    parts = _Parts(df, keys, order, bucket, False)
    local = parts.values({"_kind": F.col(kind)})
    change = F.coalesce((F.col("_kind") != F.lag("_kind").over(parts.within)).cast("bigint"), F.lit(0).cast("bigint"))
    upto = parts.within.rowsBetween(Window.unboundedPreceding, 0)
    local = local.select("*", change.alias("_change"), F.first("_kind").over(upto).alias("_first"), parts.is_last.alias("_last"))
    local = local.withColumn("_inner", F.sum("_change").over(upto))
    edges = local.where("_last").withColumn(
        "_opened", F.coalesce((F.col("_first") != F.lag("_kind").over(parts.across)).cast("bigint"), F.lit(0).cast("bigint")))
    base = F.sum(F.col("_opened") + F.col("_inner")).over(parts.across.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_inner")
    parts.carried(local, edges.withColumn("_base", base), ["_base"], {name: F.col("_base") + F.col("_inner")})
    return parts.result()


def lookup(
    queries: DataFrame | Column,
    points: DataFrame,
    keys: Sequence[str],
    query_at: str | Column,
    point_at: str | Column,
    steps: Sequence[Running],
    strict: bool = False,
    after: bool = False,
    bucket_seconds: int | None = None,
    bucket: Column | None = None,
    held: Sequence[str] | None = None,
    is_point: Column | None = None,
) -> DataFrame:
    """As-of aggregate: for each query row, running values over the points at or before it.

    `strict` leaves out points at the same place; `after` looks at the points at or after it instead.
    Step values refer to columns of `points`, as `_p_<name>`. No pair of rows is ever formed: both sides are put in
    one ordered scan per key. Where `queries` is a condition, the rows of `points` that fulfil it are the queries (and keep
    all columns), those that fulfil `is_point` are the points; the table is then read once, each row as one or both.
    """
    point_rank, query_rank = (0, 1) if strict == after else (1, 0)
    place = lambda at: F.col(at) if isinstance(at, str) else at
    if isinstance(queries, DataFrame):
        kept = [c for c in queries.columns if c not in keys]
        held = [c for c in points.columns if c not in keys and c != point_at] if held is None else held
    else:
        kept = [c for c in points.columns if c not in keys]
    query, point = F.struct(*[F.col(f"`{c}`") for c in kept]), F.struct(*[F.col(f"`{c}`") for c in held])

    def entry(at: str | Column, rank: int, own: Column, other: Column, first: bool) -> Column:
        both = (own.alias("_query"), other.alias("_point")) if first else (other.alias("_query"), own.alias("_point"))
        return F.struct(place(at).alias("_at"), F.lit(rank).alias("_rank"), *both)

    none = lambda frame, column: F.lit(None).cast(frame.select(column).schema[0].dataType)
    if isinstance(queries, DataFrame):
        left = queries.select(*keys, entry(query_at, query_rank, query, none(points, point), True).alias("_e"))
        both = left.unionByName(points.select(*keys, entry(point_at, point_rank, point, none(queries, query), False).alias("_e")))
    else:
        asked = F.when(queries, entry(query_at, query_rank, query, none(points, point), True))
        given = entry(point_at, point_rank, point, none(points, query), False)
        given = given if is_point is None else F.when(is_point, given)
        both = points.select(*keys, F.explode(F.filter(F.array(asked, given), lambda e: e.isNotNull())).alias("_e"))
    ordered = both.select(*keys, "_e._at", "_e._rank", "_e._query", *[F.col(f"_e._point.{c}").alias(f"_p_{c}") for c in held])
    renamed = [Running(s.name, s.kind, s.value, True) for s in steps]
    if bucket_seconds is not None:
        bucket = time_bucket("_at", bucket_seconds)
    found = scan(ordered, keys, ["_at", "_rank"], renamed, bucket, descending=after)
    return found.where(F.col("_rank") == query_rank).where(F.col("_query").isNotNull()).select(
        *keys, *[F.col(f"_query.{c}").alias(c) for c in kept], *[s.name for s in steps]
    )
