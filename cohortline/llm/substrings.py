"""Substring dedup: spans of words that occur elsewhere, found by suffix automata of reference shards.

The reference is what repeats. In a first pass, each window of MIN words has an anchor: the least hash of its ANCHOR-word
sequences. A window can only occur twice if its anchor does, so anchors are counted, and a bitmap of fixed size tells later passes
which windows may repeat. Those windows are counted by 96 bits; of each that repeats, the document with the smallest row
number gives its text to the reference. The reference is cut into shards of bounded size. Documents stream past the suffix automata
of the shards that hold a home of one of their windows; where the matching statistic reaches MIN words, the span goes.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from cohortline.llm.common import row_function, utf8, values, words
from cohortline.session import cut, scratch_path

MIN = 35
#: Words of an anchor
ANCHOR = 16
#: The bitmap of repeated anchors has 2 ** FILTER_BITS bits: 16 MB. It lets more through if it fills, never less.
FILTER_BITS = 27
BLOCK_BITS = 20
#: Windows in a shard, words that stream past one copy of a shard, windows of a document in one piece
SHARD, STREAM, PIECE = 40_000, 2_000_000, 20_000

P1, P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd number and of its inverse modulo 2 ** 64, as many as asked for so far."""

    def __init__(self, base: np.uint64):
        self.base = (int(base), pow(int(base), -1, 1 << 64))
        self.held = (np.ones(1, np.uint64), np.ones(1, np.uint64))

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.held[0]) < n:
            size = max(n, 2 * len(self.held[0]), 4096)
            self.held = tuple(np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)))) for b in self.base)
        return self.held[0][:n], self.held[1][:n]


#: Bytes that part words, and bytes of a text hashed at a time
SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
LOT = 1 << 22


def located(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of a text starts and ends."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~SPACE[np.frombuffer(raw, np.uint8)]
    steps = np.diff(inside)
    return np.flatnonzero(steps > 0), np.flatnonzero(steps < 0)


class Hashes:
    """Hashes of all words, and of all runs of n words, of a text."""

    def __init__(self):
        self.powers = (Powers(P1), Powers(P2))

    def words(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """One number for each word, wherever it stands; long texts in lots that end between words."""
        found, first = [], 0
        while first < len(starts):
            last = max(first + 1, int(np.searchsorted(ends, starts[first] + LOT)))
            low, high = int(starts[first]), int(ends[last - 1])
            up, down = self.powers[0](high - low + 1)
            total = np.zeros(high - low + 1, np.uint64)
            np.cumsum((np.frombuffer(raw, np.uint8, high - low, low).astype(np.uint64) + np.uint64(1)) * up[:high - low], out=total[1:])
            a, b = starts[first:last] - low, ends[first:last] - low
            found.append(mixed((total[b] - total[a]) * down[a]))
            first = last
        return np.concatenate(found) if found else np.empty(0, np.uint64)

    def runs(self, h: np.ndarray, n: int, which: int = 0) -> np.ndarray:
        """One number for each run of n words; equal runs have equal numbers wherever they stand."""
        up, down = self.powers[which](len(h) + 1)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up[:len(h)], dtype=np.uint64)))
        return mixed((total[n:] - total[:-n]) * down[:len(h) - n + 1])


def least(x: np.ndarray, width: int, pick=np.minimum) -> np.ndarray:
    """The least of every `width` neighbours, by doubling."""
    size = 1
    while 2 * size <= width:
        x = pick(x[:-size], x[size:])
        size *= 2
    return x if size == width else pick(x[:len(x) - (width - size)], x[width - size:])


def window_keys(hashes: Hashes, h: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For runs of n words, the least hash of their runs of `size` words; and all those hashes."""
    inner = hashes.runs(h, size)
    return least(inner, n - size + 1), inner


def anchors(text: bytes, hashes: Hashes, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchors of a text's windows and at how many places each stands."""
    starts, ends = located(text)
    if len(starts) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    keys, inner = window_keys(hashes, hashes.words(text, starts, ends), n, size)
    width = n - size + 1
    low = np.zeros(width - 1, np.uint64)
    highest = least(np.concatenate((low, keys, low)), width, np.maximum)
    return np.unique(inner[highest == inner], return_counts=True)


def spans_of(marked: np.ndarray, length: int) -> list[int]:
    """Starts and ends, in turn, of what the marked windows cover; windows that touch or overlap are one span."""
    at = np.flatnonzero(marked)
    if not len(at):
        return []
    first = np.flatnonzero(np.diff(at, prepend=-2 * length) > length)
    last = np.append(first[1:] - 1, len(at) - 1)
    return np.column_stack((at[first], at[last] + length)).ravel().tolist()


def cover(spans: list[int], n: int) -> np.ndarray:
    """For each of n words whether a span holds it; spans may overlap."""
    steps = np.zeros(n + 1, np.int64)
    pairs = np.array(spans, np.int64).reshape(-1, 2)
    np.add.at(steps, pairs[:, 0], 1)
    np.add.at(steps, pairs[:, 1], -1)
    return np.cumsum(steps[:-1]) > 0


class Automaton:
    """Suffix automaton of several word sequences: the smallest one whose paths are all their runs of words."""

    def __init__(self):
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, parts: list[bytes]) -> None:
        ids, last = self.ids, 0
        for part in parts:
            last = self._step(last, ids.setdefault(part, len(ids)))

    def _step(self, last: int, c: int) -> int:
        nexts, link, length = self.next, self.link, self.length
        old = nexts[last].get(c)
        if old is not None and length[old] == length[last] + 1:
            return old
        if old is not None:
            return self._clone(last, old, c)
        new = len(length)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nexts[p]:
            nexts[p][c] = new
            p = link[p]
        if p != -1:
            q = nexts[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
        return new

    def _clone(self, p: int, q: int, c: int) -> int:
        nexts, link, length = self.next, self.link, self.length
        copy = len(length)
        nexts.append(nexts[q].copy())
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p != -1 and nexts[p].get(c) == q:
            nexts[p][c] = copy
            p = link[p]
        return copy

    def matches(self, parts: list[bytes], least_length: int) -> list[int]:
        """Starts and ends, in turn, of the maximal spans that stand in a sequence and have `least_length` words or more."""
        nexts, link, length = self.next, self.link, self.length
        get, state, size, found = self.ids.get, 0, 0, []
        for end, part in enumerate(parts, 1):
            c = get(part, -1)
            if c < 0:
                state = size = 0
                continue
            to = nexts[state].get(c)
            if to is None:
                while state and to is None:
                    state = link[state]
                    to = nexts[state].get(c)
                size = length[state]
                if to is None:
                    state = size = 0
                    continue
            state, size = to, size + 1
            if size >= least_length:
                if found and end - size <= found[-1]:
                    found[-1] = end
                    found[-2] = min(found[-2], end - size)
                else:
                    found += (end - size, end)
        return found


def repeated_anchors(texts: DataFrame, n: int = MIN, size: int = ANCHOR) -> DataFrame:
    """anchor: those that stand at two places or more in the column `text` (bytes) of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            held: list = []
            for raw in values(batch.column("text")):
                held.append(anchors(raw, hashes, n, size))
                if sum(len(x[0]) for x in held[-64:]) > 500_000 or len(held) > 2000:
                    yield counted(held)
                    held = []
            yield counted(held)

    def counted(held: list) -> pa.RecordBatch:
        keys = np.concatenate([x[0] for x in held] or [np.empty(0, np.uint64)])
        distinct, where = np.unique(keys, return_inverse=True)
        n_places = np.bincount(where, np.concatenate([x[1] for x in held] or [np.empty(0, np.int64)]), len(distinct)) if len(distinct) else np.empty(0)
        return pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), pa.array(np.minimum(n_places, 2).astype(np.int8))], names=["anchor", "n"])

    found = texts.select("text").mapInArrow(run, "anchor long, n byte")
    return found.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")


def bitmap(found: DataFrame, bits: int = FILTER_BITS) -> bytes:
    """One bit for each value of the anchors' last bits: of the same size whatever the number of anchors."""
    block = min(BLOCK_BITS, bits)
    slots = found.select(F.col("anchor").bitwiseAND(F.lit((1 << bits) - 1)).alias("slot")).distinct()
    slots = slots.select(F.shiftright("slot", block).alias("block"), F.col("slot").bitwiseAND(F.lit((1 << block) - 1)).alias("bit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for batch in batches:
            blocks, places = batch.column("block").to_numpy(), batch.column("bit").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if at != blocks[a]:
                    if at is not None:
                        yield packed(at, held)
                    at, held = int(blocks[a]), np.zeros(1 << block, bool)
                held[places[a:b]] = True
        if at is not None:
            yield packed(at, held)

    def packed(at: int, held: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([np.packbits(held).tobytes()], pa.binary())], names=["block", "bits"])

    whole = np.zeros((1 << bits) // 8, np.uint8)
    size = (1 << block) // 8
    for r in slots.repartition("block").sortWithinPartitions("block").mapInArrow(run, "block long, bits binary").collect():
        whole[r["block"] * size:(r["block"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return whole.tobytes()


def is_set(bits: np.ndarray, keys: np.ndarray, n_bits: int) -> np.ndarray:
    slot = keys & np.uint64((1 << n_bits) - 1)
    return (bits[slot >> np.uint64(3)] >> (np.uint8(7) - (slot & np.uint64(7)).astype(np.uint8))) & np.uint8(1) > 0


SCANNED = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(T.IntegerType())), T.StructField("sha", T.StringType())])
GONE = T.StructType([T.StructField("n_removed", T.LongType()), T.StructField("sha", T.StringType()), T.StructField("text", T.BinaryType())])

PASSING = T.StructType([T.StructField("starts", T.ArrayType(T.IntegerType())), T.StructField("texts", T.ArrayType(T.BinaryType()))])


def pieces_of(raw: bytes, runs: list[int], wanted: list[int]) -> tuple[list[int], list[bytes]]:
    """The wanted ones of a text's runs: the word each starts at, and its words."""
    starts, ends = located(raw)
    wanted = sorted(wanted)
    return [runs[2 * k] for k in wanted], [raw[starts[runs[2 * k]]:ends[runs[2 * k + 1] - 1]] for k in wanted]


def digest(parts: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(parts)).hexdigest()


def without(raw: bytes, spans: list[int]) -> tuple[int, str, bytes]:
    """Words removed, digest of the kept ones, and the text without the removed words and the white space after them."""
    parts = words(raw)
    if not spans:
        return 0, digest(parts), raw
    gone = cover(spans, len(parts))
    starts = np.append(located(raw)[0], len(raw))
    edges = starts[np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))].tolist()
    left = [raw[a:b] for a, b in zip([0, *edges[1::2]], [*edges[::2], len(raw)], strict=True)]
    return int(gone.sum()), digest(list(compress(parts, (~gone).tolist()))), b"".join(left)


def repeats(docs: DataFrame, keep: list[str], text_col: str, whole: bool, n: int = MIN, filter_bits: int = FILTER_BITS, shard: int = SHARD, stream: int = STREAM) -> DataFrame:
    """One row per document: row (struct of the columns in `keep`), void (the text is null), n_words, n_removed, sha, text.

    text is what is left, as bytes: of every document if `whole`, else only of those that may lose something. sha is that
    of the kept words joined by blanks. Rows are told apart by a number of their own, so ids may be null or repeated.
    The documents' table and the steps on it share buckets of that number, so only what repeats moves again.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = spark.sparkContext.broadcast(bitmap(repeated_anchors(docs.select(utf8(text_col).alias("text")), n), filter_bits))

    def scan():
        hashes, bits = Hashes(), np.frombuffer(sent.value, np.uint8)

        def one(raw: bytes) -> tuple:
            starts, ends = located(raw)
            if len(starts) < n:
                return len(starts), [], digest(words(raw))
            keys, _ = window_keys(hashes, hashes.words(raw, starts, ends), n, ANCHOR)
            runs = spans_of(is_set(bits, keys, filter_bits), n)
            return len(starts), runs, None if runs else digest(words(raw))

        return one

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.col(text_col).isNull().alias("void"), utf8(text_col).alias("text"))
    rows = rows.withColumn("scan", row_function(scan, SCANNED)(F.col("text"))).select("rid", "row", "void", "text", "scan.*")
    if not whole:
        rows = rows.withColumn("text", F.when(F.size("runs") > 0, F.col("text")))
    name = f"repeats_{uuid.uuid4().hex}"
    rows.repartition(partitions, "rid").write.bucketBy(partitions, "rid").option("compression", "zstd").option("path", scratch_path(spark, name)).saveAsTable(name)
    rows = spark.table(name)
    able = rows.where(F.size("runs") > 0).select("rid", "text", "runs")
    n_windows = able.select(F.sum(F.expr(f"aggregate(sequence(0, size(runs) div 2 - 1), 0L, (s, k) -> s + runs[2 * k + 1] - runs[2 * k] - {n - 1})"))).first()[0] or 0
    shards = max(1, -(-n_windows // shard))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            held, size = [], 0
            for rid, raw, runs in zip(*(values(batch.column(c)) for c in ("rid", "text", "runs")), strict=True):
                starts, ends = located(raw)
                for k, (a, b) in enumerate(zip(runs[::2], runs[1::2], strict=True)):
                    h = hashes.words(raw, starts[a:b], ends[a:b])
                    keys = hashes.runs(h, n)
                    held.append((keys, (hashes.runs(h, n, 1) >> np.uint64(32)).astype(np.uint32), np.full(len(keys), rid, np.int64), np.full(len(keys), k, np.int32)))
                    size += len(keys)
                if size > 200_000:
                    yield put(held)
                    held, size = [], 0
            if held:
                yield put(held)

    def put(held: list) -> pa.RecordBatch:
        key, check, rid, run = (np.concatenate(x) for x in zip(*held, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(check.view(np.int32)), pa.array(rid), pa.array(run)], names=["key", "mark", "rid", "run"])

    every = able.mapInArrow(windows, "key long, mark int, rid long, run int")
    counted = every.groupBy("key", "mark").agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias("rid")).where("n > 1")
    counted = cut(counted.select("key", "rid"))
    homes = counted.groupBy("rid").agg(F.collect_list("key").alias("keys")).join(able, "rid").select("rid", "keys", "text", "runs")

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            for rid, own, raw, runs in zip(*(values(batch.column(c)) for c in ("rid", "keys", "text", "runs")), strict=True):
                starts, ends = located(raw)
                own, out = np.array(own, np.int64), []
                for a, b in zip(runs[::2], runs[1::2], strict=True):
                    hit = np.isin(hashes.runs(hashes.words(raw, starts[a:b], ends[a:b]), n).view(np.int64), own)
                    edges = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0)).tolist()
                    for first, last in zip(edges[::2], edges[1::2], strict=True):
                        for at in range(first, last, PIECE):
                            end = min(last, at + PIECE) + n - 2
                            place = xxhash.xxh64_intdigest(f"{rid}:{(a + at) // PIECE}") % shards
                            out.append((place, raw[starts[a + at]:ends[a + end]]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([rid] * len(out), pa.int64()), pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())],
                    names=["home", "shard", "passage"])

    path = scratch_path(spark, "reference")
    homes.mapInArrow(passages, "home long, shard int, passage binary").write.option("compression", "zstd").parquet(path)
    reference = spark.read.schema("home long, shard int, passage binary").parquet(path)
    near = every.select("key", "rid", "run").join(counted.withColumnRenamed("rid", "home"), "key").select("rid", "run", "home").distinct()
    pairs = near.join(reference.select("home", "shard").distinct(), "home").groupBy("rid", "shard").agg(F.collect_set("run").alias("wanted"))
    pairs = cut(pairs)
    spoken = F.expr("aggregate(wanted, 0L, (s, k) -> s + runs[2 * k + 1] - runs[2 * k])")
    loads = cut(pairs.join(able.select("rid", "runs"), "rid").groupBy("shard").agg(F.ceil(F.sum(spoken) / stream).cast("int").alias("salts")))
    salted = pairs.join(loads, "shard").select("rid", "shard", F.pmod(F.xxhash64("rid"), F.col("salts")).cast("int").alias("salt"), "wanted")
    passing = salted.join(able, "rid").select("shard", "salt", F.lit(1).alias("kind"), "rid", row_function(lambda: pieces_of, PASSING)(F.col("text"), F.col("runs"), F.col("wanted")).alias("p"))
    passing = passing.select("shard", "salt", "kind", "rid", "p.starts", "p.texts")
    copies = reference.join(loads, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"),
                                                   F.lit(None).cast("long").alias("rid"), F.array().cast("array<int>").alias("starts"), F.array("passage").alias("texts"))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, automaton = None, Automaton()
        for batch in batches:
            rids, found = [], []
            for place, salt, kind, rid, starts, texts in zip(*(values(batch.column(c)) for c in ("shard", "salt", "kind", "rid", "starts", "texts")), strict=True):
                if at != (place, salt):
                    at, automaton = (place, salt), Automaton()
                if kind == 0:
                    automaton.add(words(texts[0]))
                    continue
                spans = [x + a for a, raw in zip(starts, texts, strict=True) for x in automaton.matches(words(raw), n)]
                if spans:
                    rids.append(rid)
                    found.append(spans)
            yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(found, pa.list_(pa.int32()))], names=["rid", "spans"])

    dealt = copies.unionByName(passing).repartition(partitions, "shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    spans = dealt.mapInArrow(match, "rid long, spans array<int>").groupBy("rid").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    lost = row_function(lambda: without, GONE)
    joined = rows.join(spans, "rid", "left")
    changed = joined.where("size(runs) > 0").select("row", "void", "n_words", lost(F.col("text"), F.coalesce("spans", F.array().cast("array<int>"))).alias("g"))
    changed = changed.select("row", "void", "n_words", "g.n_removed", "g.sha", "g.text")
    same = rows.where("size(runs) = 0").select("row", "void", "n_words", F.lit(0).cast("long").alias("n_removed"), "sha", "text")
    return changed.unionByName(same)


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = MIN, **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256.

    Every word that a window of n words covers goes if the same window also starts elsewhere, in any document. Null texts
    have no words; texts with fewer than n lose none; equal texts lose the same; null ids and repeated rows stay, a repeated
    row being another document. Other columns are not read.
    """
    rows = repeats(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")), ["doc_id"], "_text", False, n, **options)
    return rows.select("row.doc_id", "n_words", "n_removed", F.col("sha").alias("kept_sha256"))


def cleaned(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", n: int = MIN, **options) -> DataFrame:
    """The documents with what repeats cut out of their text, all columns in place; untouched texts stay as they are.

    chars_col, if it is there, is set to the new text's length where something was removed.
    """
    others = [c for c in docs.columns if c != text_col]
    rows = repeats(docs, others, text_col, True, n, **options)
    return rows.select(*_columns(docs, text_col, chars_col))


def _columns(docs: DataFrame, text_col: str, chars_col: str | None) -> list[Column]:
    text = F.when(~F.col("void"), F.col("text").cast("string"))
    out = []
    for c in docs.columns:
        if c == text_col:
            out.append(text.alias(c))
        elif c == chars_col:
            out.append(F.when(F.col("n_removed") > 0, F.length(text).cast(docs.schema[c].dataType)).otherwise(F.col(f"row.`{c}`")).alias(c))
        else:
            out.append(F.col(f"row.`{c}`").alias(c))
    return out
