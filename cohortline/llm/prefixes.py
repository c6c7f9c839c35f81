"""Prefix trie of conversations by whole sequences: identical ones are one weighted sequence, leaves are those that no other
one goes on from, and weighted prefixes are added up per node.

A sequence is known by its length and the exclusive or of hashes of (place, turn), 128 bits: running over ordered buckets, so a
conversation of any length is no single task's. Texts leave the data at the first step, as digests and lengths.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cohortline.llm.merkle import CRC_SQL
from cohortline.operators.ordered import Running, position, scan
from cohortline.operators.timeline import idx_bucket
from cohortline.session import cut

#: Every SPAN ids a first conversation stands, whose first turns, fewer than HEADS, the others take over
SPAN, HEADS = 100, 6
NODE = ["depth", "a", "b"]
#: Conversation ids, as a power of two, that are written out in one piece before they are digested
LOT_BITS = 12
NOTHING = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, place (from 1), mark, chars: the turns in order; the text is read once."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    mark = F.substr(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), F.lit(1), F.lit(32))
    rows = conversations.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), mark.alias("mark"), F.length(text).cast("long").alias("chars"))
    return position(cut(rows), ["conv"], ["turn", "mark"], "place", start=1).drop("turn")


def taken(conv: Column) -> Column:
    """How many first turns a conversation takes over."""
    return F.crc32(conv.cast("string").cast("binary")) % HEADS


def rebuilt(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conv, place, mark, chars of the rebuilt conversations, and all conv ids.

    A conversation has the first turns of the one that its span starts with, as many as there are, then its own after as many.
    """
    span = F.col("conv") - F.col("conv") % SPAN
    convs = placed.select("conv").distinct().withColumns({"first": span, "h": taken(F.col("conv"))})
    heads = placed.where((span == F.col("conv")) & (F.col("place") < HEADS)).select(F.col("conv").alias("first"), "place", "mark", "chars")
    sizes = heads.groupBy("first").agg(F.count(F.lit(1)).alias("there"))
    convs = cut(convs.join(sizes, "first", "left").select("conv", "first", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("had")))
    before = convs.join(heads, "first").where(F.col("place") <= F.col("h")).select("conv", "place", "mark", "chars")
    own = placed.where(F.col("place") > taken(F.col("conv"))).join(convs.select("conv", "h", "had"), "conv")
    own = own.select("conv", (F.col("place") - F.col("h") + F.col("had")).alias("place"), "mark", "chars")
    return before.unionByName(own), convs.select("conv")


def prints(rows: DataFrame) -> DataFrame:
    """The prefix up to each turn as (depth, a, b), and the one before it as (pa, pb)."""
    one, two = (F.xxhash64(F.lit(k), "place", "mark") for k in (1, 2))
    marked = rows.withColumns({"x": one, "y": two}).drop("mark")
    told = scan(marked, ["conv"], ["place"], [Running("a", "xor", F.col("x")), Running("b", "xor", F.col("y"))], idx_bucket("place"))
    return told.select("conv", F.col("place").alias("depth"), "a", "b", F.col("a").bitwiseXOR(F.col("x")).alias("pa"), F.col("b").bitwiseXOR(F.col("y")).alias("pb"), "chars")


def end_lists(ends: DataFrame) -> DataFrame:
    """depth, a, b, ends_sha256: the digest of each sequence's conversation ids, ascending and comma-joined.

    Ids are sorted and written out by lots of neighbouring ids; a digest takes the lots of its sequence one after the other, so it
    holds one at a time, however many conversations are alike.
    """
    told = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    lots = ends.groupBy(*NODE, F.shiftright("conv", LOT_BITS).alias("lot")).agg(told.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done = []
            for depth, a, b, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
                if key != (depth, a, b):
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = (depth, a, b), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield listed(done)
        if key is not None:
            yield listed([(*key, state.hexdigest())])

    def listed(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(dict(zip((*NODE, "ends_sha256"), map(list, zip(*done, strict=True)), strict=True)))

    return lots.repartition(*NODE).sortWithinPartitions(*NODE, "lot").mapInArrow(run, "depth long, a long, b long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, **columns: str) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by number, null first, turns of one number by the digest of role and text; repeated rows are turns of their
    own. A null role or text is empty. Rows without a conversation id belong to none and are left out. A table without
    conversations has no nodes, not even the root. Columns that aren't named are not read.

    A node's smallest member is the least id of the sequences through it, so a sequence owns the nodes from some depth on
    that carry its own id. What a node's subtree saves is what the sequences through it own, less what its owner has above
    it: two sums over weighted prefixes and one running sum, and no pair of a node and its ancestors.
    """
    rows, convs = rebuilt(cut(turns(conversations, **columns)))
    told = cut(prints(rows))
    last = told.groupBy("conv").agg(F.max_by(F.struct("depth", "a", "b"), "depth").alias("s"))
    at = lambda name: F.coalesce(F.col(f"s.{name}"), F.lit(0)).cast("long").alias(name)
    ends = cut(convs.join(last, "conv", "left").select("conv", *map(at, NODE)))
    sequences = cut(ends.groupBy(*NODE).agg(F.count(F.lit(1)).alias("weight"), F.min("conv").alias("conv")))
    whole = sequences.select("conv", "weight", F.col("depth").alias("length"))
    zero = F.lit(0).cast("long")
    roots = whole.select("conv", zero.alias("depth"), zero.alias("a"), zero.alias("b"), zero.alias("pa"), zero.alias("pb"), zero.alias("chars"), "weight", "length")
    passed = cut(told.join(whole, "conv").unionByName(roots))
    nodes = cut(passed.groupBy(*NODE).agg(
        F.min("conv").alias("conv"), F.sum("weight").alias("n_convs"), F.max("chars").alias("chars"), F.max("pa").alias("pa"), F.max("pb").alias("pb"),
        F.max(F.col("length") > F.col("depth")).alias("inner")))
    leaves = sequences.join(nodes.where("inner").select(*NODE), NODE, "left_anti").select("conv", F.lit(1).cast("long").alias("leaf"))
    saved = (F.col("n_convs") - 1) * F.col("chars")
    owned = nodes.groupBy("conv").agg(F.sum(saved).alias("owned"))
    weights = owned.join(leaves, "conv", "full").select("conv", F.coalesce("owned", F.lit(0)).alias("owned"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    sums = passed.join(weights, "conv").groupBy(*NODE).agg(F.sum("leaf").alias("n_leaves"), F.sum("owned").alias("below"))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    parts = sums.unionByName(children, allowMissingColumns=True).unionByName(end_lists(ends), allowMissingColumns=True)
    parts = parts.groupBy(*NODE).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("below").alias("below"), F.coalesce(F.sum("n_children"), F.lit(0)).alias("n_children"),
                                     F.coalesce(F.max("ends_sha256"), F.lit(NOTHING)).alias("ends_sha256"))
    above = scan(nodes, ["conv"], ["depth"], [Running("above", "sum", saved, inclusive=False)], idx_bucket("depth"))
    parents = nodes.select((F.col("depth") + 1).alias("under"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv").alias("parent_conv_id"))
    full = above.join(parts, NODE).withColumn("under", F.when(F.col("depth") > 0, F.col("depth")))
    return full.join(parents, ["under", "pa", "pb"], "left").select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("below") - F.col("above")).alias("saved_tokens"), "ends_sha256")


TRIE_SQL = f"""
WITH marked AS (
  SELECT conv_id AS c, turn, substr(sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS mark,
    length(coalesce(text, '')) AS chars FROM conversations WHERE conv_id IS NOT NULL),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, mark) AS p FROM marked),
convs AS MATERIALIZED (SELECT DISTINCT c, {CRC_SQL.format('(c::VARCHAR)')} % 6 AS h FROM placed),
turned AS (
  SELECT v.c, 0 AS part, p, mark, chars FROM convs v JOIN placed t ON t.c = v.c - v.c % 100 AND t.p <= v.h
  UNION ALL SELECT v.c, 1, p, mark, chars FROM convs v JOIN placed t ON t.c = v.c AND t.p > v.h),
lined AS (SELECT c, string_agg(mark, '' ORDER BY part, p) AS path, list(chars ORDER BY part, p) AS sizes FROM turned GROUP BY c),
whole AS MATERIALIZED (SELECT c, coalesce(path, '') AS path, coalesce(sizes, []) AS sizes FROM convs LEFT JOIN lined USING (c)),
spread AS (SELECT c, path, sizes, unnest(range(0, len(sizes) + 1)) AS d FROM whole),
nodes AS MATERIALIZED (
  SELECT left(path, 32 * d) AS k, d, min(c) AS conv, count(*) AS n, any_value(CASE WHEN d = 0 THEN 0 ELSE sizes[d] END) AS chars FROM spread GROUP BY ALL),
kids AS (SELECT left(k, 32 * (d - 1)) AS k, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
valued AS (SELECT m.*, (m.n - 1) * chars AS worth, CASE WHEN x.n IS NULL THEN 1 ELSE 0 END AS leaf, coalesce(x.n, 0) AS children FROM nodes m LEFT JOIN kids x USING (k, d)),
up AS (SELECT left(k, 32 * z) AS k, z AS d, sum(worth) AS saved, sum(leaf) AS leaves FROM (SELECT *, unnest(range(0, d + 1)) AS z FROM valued) GROUP BY 1, 2),
ends AS (SELECT path AS k, len(sizes) AS d, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM whole GROUP BY ALL)
SELECT v.conv AS conv_id, v.d::BIGINT AS depth, q.conv AS parent_conv_id, v.n::BIGINT AS n_convs, v.children::BIGINT AS n_children, u.leaves::BIGINT AS n_leaves,
  u.saved::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM valued v JOIN up u USING (k, d) LEFT JOIN ends e USING (k, d) LEFT JOIN nodes q ON q.d = v.d - 1 AND q.k = left(v.k, 32 * (v.d - 1))
"""
