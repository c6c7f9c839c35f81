"""SimHash near-duplicates: 64-bit fingerprints, candidates by a ring of segments, components of links.

Fingerprints within `radius` bits are linked. The 64 bits are cut into more segments than the radius. Round the ring of
segments, if all segments together differ in at most `radius` bits, then from some start every chain of consecutive segments
differs in at most its share of them: l segments in floor(l * radius / segments) bits. At the start, a single segment, that
is none; and as at most `radius` segments differ, `segments - radius` are equal. So linked pairs meet under a key of that
many equal segments, one of which starts a chain that keeps all budgets. Chains are checked, longer and longer, before the
full distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType

from cohortline.llm.common import row_function, unused, utf8, words
from cohortline.llm.components import components
from cohortline.session import cut

RADIUS = 4
SEGMENTS = 6
SEED = 42
#: Fingerprints of one key compared in one piece; a larger key is cut into pieces, each pair of pieces is a group
PIECE = 4096
#: bytes.lower() changes A-Z only
UPPER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def hashes(text: bytes, size: int) -> np.ndarray:
    """The XXH64 hashes (seed 42) of the shingles of `size` lower-cased words, repeats included, as unsigned 64-bit numbers.

    A text with fewer words is one shingle; one without words has none.
    """
    parts = words(text.translate(UPPER))
    if not parts:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= size:
        return np.array([digest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[: 1 - size], ends[size - 1:]
    found = np.empty(len(starts), np.uint64)
    for k in range(0, len(starts), 65_536):  # very long texts in pieces
        some = zip(starts[k:k + 65_536].tolist(), ends[k:k + 65_536].tolist(), strict=True)
        found[k:k + 65_536] = np.fromiter((digest(joined[a:b], SEED) for a, b in some), np.uint64, min(65_536, len(starts) - k))
    return found


def vote(found: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as a signed 64-bit number."""
    total = np.zeros(64, np.int64)
    for k in range(0, len(found), 65_536):
        total += np.unpackbits(found[k:k + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(found)).view(">i8")[0])


def fingerprint(text: bytes, size: int) -> int:
    """SimHash of the shingles of `size` lower-cased words, repeats included, as a signed 64-bit number.

    A text with fewer words is one shingle; one without words is zero.
    """
    return vote(hashes(text, size))


def fingerprints(text: str | Column, size: int) -> Column:
    return row_function(lambda: lambda raw: fingerprint(raw, size), LongType())(utf8(text))


def segment_masks(segments: int = SEGMENTS) -> list[int]:
    edges = [round(k * 64 / segments) for k in range(segments + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def chain_filter(difference: np.ndarray, starts: tuple[int, ...], radius: int, masks: list[np.uint64]) -> np.ndarray:
    """Places in a flat array of differences where a chain from one of the starts keeps every budget.

    Chains grow by a segment at a time; what breaks a budget is left out of the longer ones.
    """
    m, found = len(masks), []
    for start in starts:
        at, chain = None, np.uint64(0)
        for n in range(1, m + 1):
            chain = chain | masks[(start + n - 1) % m]
            held = np.bitwise_count((difference if at is None else difference[at]) & chain) <= n * radius // m
            at = np.flatnonzero(held) if at is None else at[held]
            if not len(at):
                break
        found.append(at)
    return np.unique(np.concatenate(found)) if len(found) > 1 else found[0]


def forest(values: np.ndarray, n_left: int, starts: tuple[int, ...], radius: int, masks: list[np.uint64]) -> list[tuple[int, int]]:
    """Links that connect what the links of one group connect, at most one fewer than its members.

    values: distinct fingerprints. n_left: 0 to compare all with all, else the first n_left with the others.
    """
    n, label, links = len(values), np.arange(len(values)), []
    rows = n_left or n
    step = max(1, 1_000_000 // n)
    for top in range(0, rows, step):
        end = min(rows, top + step)
        first = n_left or top
        difference = values[top:end, None] ^ values[None, first:]
        close = chain_filter(difference.ravel(), starts, radius, masks)
        close = close[np.bitwise_count(difference.ravel()[close]) <= radius]
        i, j = close // (n - first) + top, close % (n - first) + first
        keep = i < j
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        edges = np.flatnonzero(np.diff(i, prepend=-1))
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(i)], strict=True):
            own, others = label[i[a]], label[j[a:b]]
            if (others == own).all():
                continue
            seen, where = np.unique(others, return_index=True)
            for was, at in zip(seen.tolist(), where.tolist(), strict=True):
                if was != own:
                    links.append((int(i[a]), int(j[a + at])))
            label[np.isin(label, seen)] = own
    return links


def links(prints: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS, piece: int = PIECE) -> DataFrame:
    """Links (a, b) among distinct fingerprints (`print`) with the same components as all pairs within the radius.

    Every fingerprint goes to one group per choice of equal segments. A group of more than `piece` members is cut by
    hash into pieces, and each pair of pieces becomes a group, so no task holds an unbounded one; nothing is left out.
    """
    if segments <= radius:
        raise ValueError("more segments than differing bits are needed")
    masks = segment_masks(segments)
    choices = list(combinations(range(segments), segments - radius))
    keys = F.array(*(F.struct(F.lit(k).alias("choice"), F.col("print").bitwiseAND(F.lit(_signed(sum(masks[s] for s in c)))).alias("key")) for k, c in enumerate(choices)))
    rows = prints.select("print", F.explode(keys).alias("at")).select("at.choice", "at.key", "print")
    large = rows.groupBy("choice", "key").count().where(F.col("count") > piece).withColumn("pieces", F.ceil(F.col("count") / piece).cast("int"))
    large = cut(large)  # mostly empty: its size is known before the rows are joined, so they don't move for it
    rows = rows.join(large.select("choice", "key", "pieces"), ["choice", "key"], "left")
    own = F.pmod(F.xxhash64("print"), F.coalesce("pieces", F.lit(1))).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1)))
    rows = rows.select("choice", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") != F.least("own", "other")).alias("right"), "print")
    keyed = ("choice", "key", "low", "high")
    dealt = rows.repartition(*keyed).sortWithinPartitions(*keyed, "right", "print")
    bits = [np.uint64(m) for m in masks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
            new = np.zeros(len(now[0]), bool)
            for k in range(4):
                new[1:] |= now[k][1:] != now[k][:-1]
            starts = np.flatnonzero(new)
            last = starts[-1] if len(starts) else 0
            yield table(now, [0, *starts[:-1].tolist()] if len(starts) else [], [*starts.tolist()])
            rest = [x[last:] for x in now]
        if rest is not None and len(rest[0]):
            yield table(rest, [0], [len(rest[0])])

    def table(now: list[np.ndarray], tops: list[int], ends: list[int]) -> pa.RecordBatch:
        a, b = [], []
        for top, end in zip(tops, ends, strict=True):
            if end - top < 2:
                continue
            group = now[5][top:end]
            n_left = 0 if now[2][top] == now[3][top] else int((~now[4][top:end].astype(bool)).sum())
            if n_left == end - top or (n_left == 0 and now[2][top] != now[3][top]):
                continue
            for i, j in forest(group.view(np.uint64), n_left, choices[int(now[0][top])], radius, bits):
                a.append(int(group[i]))
                b.append(int(group[j]))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, radius: int = RADIUS, segments: int = SEGMENTS, piece: int = PIECE) -> DataFrame:
    """One row per document: doc_id, print (signed 64-bit), component_id (the smallest id reachable over links).

    Null and empty texts have fingerprint zero and are linked like any other. Documents without an id take part and
    get their component's smallest id, null if it has none. Repeated rows stay. Other columns are not read. Equal
    fingerprints are one node; texts are read once, the fingerprints are written.
    """
    prints = cut(docs.select(F.col(id_col).alias("doc_id"), fingerprints(text_col, size).alias("print")))
    nodes = prints.groupBy("print").agg(F.min("doc_id").alias("least"))
    roots = components(links(nodes.select("print"), radius, segments, piece))
    placed = nodes.join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    placed = cut(placed)
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(least, "root").select("print", "component_id")
    return prints.join(named, "print").select("doc_id", "print", "component_id")


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that stay, one of each component: that with its smallest id. All columns stay as they are.

    Rows repeated under one id are one document. Documents without an id stay, since nothing tells them apart.
    """
    found = near_duplicates(docs, id_col, text_col, **options)
    own = unused(docs, "_gone")
    gone = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(own))
    return docs.join(gone, F.col(id_col) == F.col(own), "left_anti")
