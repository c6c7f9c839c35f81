"""Document fingerprints: the k smallest hashes of a text's word shingles, mergeable across parts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from cohortline.llm.common import utf8, values, words

K = 128
SHINGLE = 5
#: Hashes keep 48 bits: 12 hex digits each in a fingerprint
BITS = 48
EMPTY = np.empty(0, np.int64)


def sketch(text: bytes, k: int = K, size: int = SHINGLE) -> np.ndarray:
    """The k smallest distinct hashes of the shingles of `size` words, ascending.

    A text with fewer words has one shingle, all of them; one without words has none.
    """
    parts = words(text)
    if not parts:
        return EMPTY
    joined, digest, shift = b" ".join(parts), xxhash.xxh64_intdigest, 64 - BITS
    if len(parts) <= size:
        return np.array([digest(joined) >> shift], np.int64)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: 1 - size].tolist()
    hashes = np.fromiter((digest(joined[a:b]) for a, b in zip(starts, ends[size - 1:].tolist(), strict=True)), np.uint64, len(starts))
    return np.unique((hashes >> np.uint64(shift)).astype(np.int64))[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of two parts together; parts must overlap by size - 1 words so that no shingle is lost."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of common hashes among the k smallest of both; two empty texts are alike, an empty and another are not."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = merge(a, b, k)
    return float(np.isin(both, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum() / len(both))


def distinct_shingles(a: np.ndarray, k: int = K) -> float:
    """Exact below k, else k - 1 over the k-th smallest hash as a share of all hashes."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[-1]) / 2.0**BITS)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has: from the resemblance and both counts."""
    if not len(a):
        return 1.0
    near, n_a, n_b = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return min(1.0, near / (1 + near) * (n_a + n_b) / n_a)


def as_text(a: np.ndarray) -> str:
    return "".join(f"{x:012x}" for x in a.tolist())


def from_text(text: str) -> np.ndarray:
    return np.array([int(text[k:k + 12], 16) for k in range(0, len(text), 12)], np.int64)


def merged(sketches: DataFrame, group_col: str, sketch_col: str = "fingerprint", k: int = K) -> DataFrame:
    """One sketch per group of parts: group, fingerprint. A group's parts are merged in salted lots, then the lots.

    Null sketches add nothing; a null group is a group. Rows stream in group order, so a task holds one sketch.
    """
    lots = sketches.select(F.col(group_col).alias("group"), F.coalesce(F.col(sketch_col), F.lit("")).alias("fingerprint"))
    lots = lots.withColumn("lot", F.pmod(F.xxhash64("fingerprint"), F.lit(64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None
        for batch in batches:
            out: list[tuple] = []
            for group, text, lot in zip(*(values(batch.column(c)) for c in ("group", "fingerprint", "lot")), strict=True):
                if held is not None and key == (group, lot):
                    held = merge(held, from_text(text), k)
                    continue
                if held is not None:
                    out.append((*key, as_text(held)))
                key, held = (group, lot), from_text(text)
            yield rows(out, batch.schema)
        if held is not None:
            yield rows([(*key, as_text(held))], None)

    kind = lots.schema["group"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    def rows(out: list[tuple], _schema) -> pa.RecordBatch:
        groups, salts, texts = zip(*out, strict=True) if out else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(groups, to_arrow_type(kind)), pa.array(texts, pa.string()), pa.array(salts, pa.int64())], names=["group", "fingerprint", "lot"])

    part = lots.repartition("group", "lot").sortWithinPartitions("group", "lot").mapInArrow(run, lots.schema)
    whole = part.withColumn("lot", F.lit(0).cast("long"))
    return whole.repartition("group").sortWithinPartitions("group").mapInArrow(run, lots.schema).select(F.col("group").alias(group_col), "fingerprint")


def _range_of(value: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds don't exceed the value, in two steps of about the root of their number."""
    step = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[k:k + step] for k in range(0, len(bounds), step)]
    if not blocks:
        return F.lit(0)

    def below(listed: Column) -> Column:
        return F.aggregate(listed, F.lit(0), lambda n, x: n + (x <= value).cast("int"))

    longs = lambda listed: F.array(*(F.lit(x).cast("long") for x in listed))
    block = below(longs(x[0] for x in blocks))
    return F.when(block == 0, 0).otherwise((block - 1) * step + below(F.get(F.array(*map(longs, blocks)), block - 1)))


OUT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, "
       "edited_contained double, n_shingles double")


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, size: int = SHINGLE) -> DataFrame:
    """Fingerprint each text and the text whose second half comes from the next document, by descending id.

    A row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    edited_contained, n_shingles. Null texts are empty. Rows with one id follow each other by the hash of their text, rows
    without an id come last; a single document is its own next. Other columns are not read.

    Ids are cut into ranges by quantiles. Each text is shuffled once, to its range; a range's first document also goes,
    as a guest, to the range before it, whose last document needs it. The table of first documents has one row per range.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = 4 * partitions
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    cuts = ids.agg(F.percentile_approx("doc_id", [x / ranges for x in range(1, ranges)], 10 * ranges).alias("c")).first()["c"]
    place = F.when(F.col("doc_id").isNull(), -1).otherwise(_range_of(F.col("doc_id"), sorted(set(cuts or []))))
    firsts = ids.groupBy(place.alias("range")).agg(F.max("doc_id").alias("first")).orderBy(F.desc("range")).collect()
    ends = [(x["range"], x["first"], firsts[n - 1]["range"]) for n, x in enumerate(firsts)]
    guests = spark.createDataFrame(ends, "range int, first long, host int")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text")).withColumn("range", place)
    rows = rows.join(F.broadcast(guests), "range", "left").withColumn(
        "homes", F.when(F.col("doc_id").eqNullSafe(F.col("first")), F.array(F.struct("range", F.lit(0).alias("guest")), F.struct(F.col("host").alias("range"), F.lit(1).alias("guest"))))
        .otherwise(F.array(F.struct("range", F.lit(0).alias("guest")))))
    rows = rows.select("doc_id", "text", F.explode("homes").alias("home")).select("home.range", "home.guest", "doc_id", "text")
    rows = rows.repartition(partitions, "range").sortWithinPartitions("range", "guest", F.desc_nulls_last("doc_id"), F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for batch in batches:
            out = []
            for where, guest, doc, raw in zip(*(values(batch.column(c)) for c in ("range", "guest", "doc_id", "text")), strict=True):
                if where != at:
                    at, held = where, None
                elif held is None:
                    continue  # more guests of one id: only the first is the next document
                text = raw.decode("utf-8", "replace")
                own = sketch(raw, k, size)
                if held is not None:
                    out.append(row(*held, text, own))
                held = None if guest else (doc, text, own)
            yield pa.RecordBatch.from_pylist(out, schema=shape)

    shape = pa.schema([(f.split()[0], {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[f.split()[1]]) for f in OUT.split(", ")])

    def row(doc, text: str, own: np.ndarray, after: str, other: np.ndarray) -> dict:
        half = len(text) // 2
        changed = (text[:len(text) - half] + after[:half]).encode()
        new = sketch(changed, k, size)
        return {
            "doc_id": doc, "n_chars": len(text), "edited_sha256": hashlib.sha256(changed).hexdigest(), "fingerprint": as_text(own),
            "edited_fingerprint": as_text(new), "near_edited": resemblance(own, new, k), "near_next": resemblance(own, other, k),
            "edited_contained": containment(new, own, k), "n_shingles": distinct_shingles(own, k),
        }

    return rows.mapInArrow(run, OUT)
