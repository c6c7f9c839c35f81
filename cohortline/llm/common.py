"""Helpers shared by the operators: texts as bytes, words, per-row Arrow functions."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructType

#: Rows of an Arrow batch that become Python objects at a time, so that long texts don't pile up.
SLICE = 128


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(text: str | Column) -> Column:
    """A text as UTF-8 bytes; a null text is the empty one."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(column.cast("binary"), F.lit(b""))


def words(text: bytes) -> list[bytes]:
    """Runs of [^\\x20\\x09-\\x0D], which are just the characters that bytes.split() parts at."""
    return text.split()


def values(batch: pa.Array) -> Iterator:
    for start in range(0, len(batch), SLICE):
        yield from batch.slice(start, SLICE).to_pylist()


#: What the last kept function of this worker process made, by its name: the next task of the worker goes on with it
_KEPT: dict[object, Callable] = {}


def give_back() -> None:
    """What a worker process no longer uses goes back to the system, as far as its C library can do that."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def ready(make: Callable[[], Callable], kept: object) -> Callable:
    if kept not in _KEPT:
        _KEPT.clear()
        give_back()
        if kept is None:
            return make()
        _KEPT[kept] = make()
    return _KEPT[kept]


def row_function(make: Callable[[], Callable], kind: DataType, kept: object = None) -> Callable[..., Column]:
    """A column function: make() runs once in each task, its result maps one row's values to a value or a tuple.

    Values go through Arrow, a slice of each batch at a time. Under a name in `kept` what make() gives stays in the worker for its
    next tasks, until a function of another name comes; the name must tell all that make() depends on.
    """
    fields = kind.fields if isinstance(kind, StructType) else None

    def built(rows: list) -> pa.Array:
        if fields is None:
            return pa.array(rows, to_arrow_type(kind))
        columns = list(zip(*rows, strict=True)) if rows else [() for _ in fields]
        return pa.StructArray.from_arrays(
            [pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, fields, strict=True)], names=[f.name for f in fields])

    def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        each = ready(make, kept)
        for batch in batches:
            yield built([each(x) for x in values(batch)])

    def many(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        each = ready(make, kept)
        for columns in batches:
            yield built([each(*x) for x in zip(*map(values, columns), strict=True)])

    def call(*columns: Column) -> Column:
        if len(columns) == 1:
            one.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
            return F.arrow_udf(one, kind)(*columns)
        many.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
        return F.arrow_udf(many, kind)(*columns)

    return call


class Memo(dict):
    """A dict that computes what it lacks, in bounded memory.

    At `limit` entries or `room` bytes (by the length of keys and values) it starts anew, but keeps the entries so far as the
    older half: what is asked again comes back from there, and only what isn't is lost the next time.
    """

    def __init__(self, compute: Callable, limit: int = 150_000, room: int = 16 << 20):
        super().__init__()
        self.compute, self.limit, self.room, self.held, self.older = compute, limit, room, 0, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        self.held += len(key) + (len(value) if isinstance(value, (bytes, str)) else 8)
        if len(self) >= self.limit or self.held > self.room:
            self.older, self.held = dict(self), 0
            self.clear()
        self[key] = value
        return value


def unused(docs: DataFrame, name: str) -> str:
    """A column name that the documents don't have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Texts go to Python in batches of so many rows at most: documents are long, and a batch is held several times over."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)
