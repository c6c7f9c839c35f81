"""Merkle manifest of a dataset: leaf coordinates from bitmap ranks, levels reduced in keyed slot arrays, proofs.

Each group's ids are a bitmap of 64-bit words of which only those with a bit are kept. Tasks build words of their own rows
and merge them by OR; a running popcount over the words is the directory. An id's rank is the count before its word plus
the bits below it, so no row is sorted to find its leaf's place. Leaves then go to blocks of consecutive ranks, whose arrays
are filled slot by slot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cohortline.operators.ordered import Running, hash_bucket, position, scan
from cohortline.session import cut

FAN = 8
#: Levels that are reduced in one block, and the nodes of a block
LEVELS = 4
WIDTH = FAN**LEVELS
#: The word of rows without an id; every 64 ids' word number is greater
NO_WORD = -(1 << 58) - 1
BLOCKS = "grp string, block long, m long, ids array<long>, nodes array<string>, others array<string>, node string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def levels_of(nodes: list[str], whole: bool) -> list[list[str]]:
    """The nodes and the levels over them: up to one node, or LEVELS of them in a block that isn't the whole tree."""
    found = [nodes]
    while len(found[-1]) > 1 if whole else len(found) <= LEVELS:
        last = found[-1]
        found.append([digest("".join(last[k:k + FAN])) for k in range(0, len(last), FAN)])
    return found


def siblings(levels: list[list[str]], slot: int) -> str:
    """The other nodes of the slot's run on each level but the last, left to right."""
    parts = []
    for nodes in levels[:-1]:
        first = slot - slot % FAN
        parts += nodes[first:slot] + nodes[slot + 1:first + FAN]
        slot //= FAN
    return "".join(parts)


def fold(node: str, rank: int, m: int, path: str) -> str:
    """The top of a tree of m nodes, from the node at a rank and its siblings' digests."""
    at, size = 0, len(node)
    while m > 1:
        slot, run = rank % FAN, min(FAN, m - (rank - rank % FAN))
        cut_at, end = at + slot * size, at + (run - 1) * size
        node = digest(path[at:cut_at] + node + path[cut_at:end])
        at, rank, m = end, rank // FAN, -(-m // FAN)
    return node


def leaf(columns: list[Column]) -> Column:
    """SHA-256 of each value as `-` if it is null, else its bytes in UTF-8, a colon and itself."""
    told = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*told), 256)


def words(ids: DataFrame) -> DataFrame:
    """grp, word, bits, more (copies beyond the first by bit), size, before: the bitmaps and the directory of (grp, word, low).

    A word's row holds 64 ids at most, whatever the number of copies.
    """
    each = ids.groupBy("grp", "word", "low").agg(F.count(F.lit(1)).alias("n"))
    more = F.collect_list(F.when(F.col("n") > 1, F.struct("low", (F.col("n") - 1).alias("n"))))
    held = each.groupBy("grp", "word").agg(F.expr("bit_or(shiftleft(1L, low))").alias("bits"), more.alias("more"), F.sum("n").alias("size"))
    return cut(scan(held, ["grp"], ["word"], [Running("before", "sum", F.col("size"), inclusive=False)]))


def ranked(rows: DataFrame, directory: DataFrame) -> DataFrame:
    """grp, rank, id, digest, other: each row's place in its group by (id, digest).

    The rank of an id is read off its word. Rows of one id follow their digests: equal ones are counted first, and the counts
    are summed by ordered buckets, so that an id with very many rows is no single task's.
    """
    below = F.expr("bit_count(bits & ~shiftleft(-1L, low))") + F.aggregate(F.filter("more", lambda x: x["low"] < F.col("low")), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    again = F.coalesce(F.get(F.filter("more", lambda x: x["low"] == F.col("low")), F.lit(0))["n"], F.lit(0))
    found = rows.join(directory, ["grp", "word"]).select("grp", "id", "digest", "other", (F.col("before") + below).alias("first"), again.alias("again"))
    found = cut(found)
    alone = found.where("again = 0").select("grp", F.col("first").alias("rank"), "id", "digest", "other")
    many = found.where("again > 0").groupBy("grp", "first", "digest").agg(F.count(F.lit(1)).alias("n"), F.first("id").alias("id"), F.first("other").alias("other"))
    many = scan(many, ["grp", "first"], ["digest"], [Running("before", "sum", F.col("n"), inclusive=False)], hash_bucket(F.col("digest")))
    many = many.withColumn("lot", F.explode(F.expr(f"sequence(0L, n - 1, {WIDTH}L)"))).withColumn("k", F.explode(F.expr(f"sequence(lot, least(n, lot + {WIDTH}) - 1)")))
    return alone.unionByName(many.select("grp", (F.col("first") + F.col("before") + F.col("k")).alias("rank"), "id", "digest", "other"))


def blocks(nodes: DataFrame) -> DataFrame:
    """One row per WIDTH consecutive ranks of a group: its nodes by slot and the node over them; nodes has grp, rank, m, id, digest, other."""

    def fill(found: pa.Table) -> pa.Table:
        size, first = found.num_rows, found["block"][0].as_py() * WIDTH
        ids, held, others = [None] * size, [""] * size, [None] * size
        for rank, own, node, other in zip(*(found[c].to_pylist() for c in ("rank", "id", "digest", "other")), strict=True):
            ids[rank - first], held[rank - first], others[rank - first] = own, node, other
        m = found["m"][0].as_py()
        return pa.table({"grp": [found["grp"][0].as_py()], "block": [first // WIDTH], "m": [m], "ids": pa.array([ids], pa.list_(pa.int64())), "nodes": [held],
                         "others": pa.array([others], pa.list_(pa.string())), "node": [levels_of(held, m <= WIDTH)[-1][0]]})

    return nodes.withColumn("block", F.floor(F.col("rank") / WIDTH)).groupBy("grp", "block").applyInArrow(fill, BLOCKS)


def climb(nodes: DataFrame) -> DataFrame:
    """The blocks of nodes with `above`, the siblings of their node up to the top, and `top`.

    Each round makes WIDTH nodes one, until every group is one block; only the largest group's size comes to the driver.
    """
    held = cut(blocks(nodes))
    most = held.agg(F.max("m")).first()[0] or 0
    if most <= WIDTH:
        return held.withColumns({"above": F.lit(""), "top": F.col("node")})
    over = held.select("grp", F.col("block").alias("rank"), F.ceil(F.col("m") / WIDTH).alias("m"), F.lit(None).cast("long").alias("id"),
                       F.col("node").alias("digest"), F.lit(None).cast("string").alias("other"))
    return held.join(paths(climb(over)).select("grp", F.col("rank").alias("block"), F.col("path").alias("above"), "top"), ["grp", "block"])


def paths(held: DataFrame) -> DataFrame:
    """grp, rank, m, other, path, top for every node of the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                b = batch.slice(k, 1).to_pylist()[0]
                tree, size = levels_of(b["nodes"], b["m"] <= WIDTH), len(b["nodes"])
                yield pa.RecordBatch.from_pydict({
                    "grp": [b["grp"]] * size, "rank": [b["block"] * WIDTH + s for s in range(size)], "m": [b["m"]] * size, "other": pa.array(b["others"], pa.string()),
                    "path": [siblings(tree, s) + b["above"] for s in range(size)], "top": [b["top"]] * size})

    return held.mapInArrow(run, "grp string, rank long, m long, other string, path string, top string")


def proofs(held: DataFrame) -> DataFrame:
    """One row per leaf of the blocks, which carry their group's place among all groups' tops and the path from there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                b = batch.slice(k, 1).to_pylist()[0]
                tree, first, size = levels_of(b["nodes"], b["m"] <= WIDTH), b["block"] * WIDTH, len(b["nodes"])
                proved, folded = [], []
                for slot in range(size):
                    own = siblings(tree, slot) + b["above"]
                    proved.append(digest(own + b["group_path"]))
                    top = fold(b["others"][slot] or b["nodes"][slot], first + slot, b["m"], own)
                    folded.append(fold(top, b["group_rank"], b["groups"], b["group_path"]))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(b["ids"], pa.int64()), "leaf": b["nodes"], "subroot": [b["top"]] * size, "root": [b["root"]] * size, "proof_sha256": proved,
                    "folded_root": folded, "verified": [f == b["root"] for f in folded]})

    return held.mapInArrow(run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def manifest(docs: DataFrame, tampered: Column | None = None, changed: Column | None = None, id_col: str = "doc_id", group_col: str = "lang",
             leaf_cols: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A group's leaves ascend by id, rows without one first; rows of one id by their leaf, so equal rows are alike. A null group is
    one of its own, before all others. Where `tampered` holds, the leaf that is folded has `changed` in place of the text; without
    them every leaf folds to the root. An empty table has no rows. Texts are read once, for their leaves; ids alone make the
    bitmaps; columns that aren't named are not read. A block holds WIDTH leaves and no task more than one at a time.
    """
    group = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    own = F.col(id_col).cast("long")
    place = {"grp": group, "word": F.coalesce(F.shiftright(own, 6), F.lit(NO_WORD)), "low": F.coalesce(own.bitwiseAND(63), F.lit(0)).cast("int")}
    directory = words(docs.select(*(c.alias(n) for n, c in place.items())))
    other = F.lit(None).cast("string")
    if tampered is not None:
        other = F.when(F.coalesce(tampered, F.lit(False)), leaf([changed if c == text_col else F.col(c) for c in leaf_cols]))
    rows = docs.select(*(c.alias(n) for n, c in place.items()), own.alias("id"), leaf([F.col(c) for c in leaf_cols]).alias("digest"), other.alias("other"))
    sizes = directory.groupBy("grp").agg(F.sum("size").alias("m"))
    held = cut(climb(ranked(rows, directory).join(sizes, "grp")))
    tops = cut(held.where("block = 0").select(F.lit("").alias("all"), "grp", "top"))
    tops = position(tops, ["all"], ["grp"], "rank").select(
        F.col("all").alias("grp"), "rank", F.lit(tops.count()).cast("long").alias("m"), F.lit(None).cast("long").alias("id"), F.col("top").alias("digest"), F.col("grp").alias("other"))
    groups = paths(climb(tops)).select(F.col("other").alias("grp"), F.col("rank").alias("group_rank"), F.col("m").alias("groups"), F.col("path").alias("group_path"), F.col("top").alias("root"))
    return proofs(held.join(groups, "grp"))


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of documents by lang, where tampering lower-cases A-Z of the texts whose id's CRC-32 is a multiple of three."""
    return manifest(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, lowered(F.col("text")))


#: CRC-32 of a short text in DuckDB, bit by bit
CRC_SQL = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length({0}) + 1), lambda i: ascii({0}[i])::BIGINT)),
  lambda c, b: list_reduce(list_concat([xor(c, b)], list_transform(range(8), lambda z: 0::BIGINT)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""
_TOLD = " || ".join("coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')".format(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}"))
MANIFEST_SQL = f"""
WITH RECURSIVE leaves AS MATERIALIZED (
  SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS g, sha256({_TOLD.format(text='text')}) AS leaf,
    CASE WHEN {CRC_SQL.format('(doc_id::VARCHAR)')} % 3 = 0
      THEN sha256({_TOLD.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) END AS other
  FROM documents),
placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank, count(*) OVER (PARTITION BY g) AS m FROM leaves),
nodes AS (
  SELECT 0 AS level, g, rank AS idx, leaf AS h, m FROM placed
  UNION ALL
  SELECT level + 1, g, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), (any_value(m) + 7) // 8 FROM nodes WHERE m > 1 GROUP BY level, g, idx // 8),
tops AS MATERIALIZED (
  SELECT g, h AS top, row_number() OVER (ORDER BY encode(g)) - 1 AS rank, count(*) OVER () AS m FROM nodes WHERE m = 1),
over AS (
  SELECT 0 AS level, rank AS idx, top AS h, m FROM tops
  UNION ALL
  SELECT level + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), (any_value(m) + 7) // 8 FROM over WHERE m > 1 GROUP BY level, idx // 8),
tree AS MATERIALIZED (
  SELECT level, g, idx, h, m FROM nodes
  UNION ALL SELECT 1000 + level, g.g, idx, h, o.m FROM over o CROSS JOIN (SELECT DISTINCT g FROM tops) g),
steps AS MATERIALIZED (
  SELECT p.doc_id, p.rank AS own, p.g, t.level, t.idx, t.h, CASE WHEN t.level < 1000 THEN p.rank ELSE s.rank END // (8 ** (t.level % 1000))::BIGINT AS spot
  FROM placed p JOIN tops s USING (g) JOIN tree t ON t.g = p.g AND t.m > 1
    AND t.idx // 8 = CASE WHEN t.level < 1000 THEN p.rank ELSE s.rank END // (8 ** (t.level % 1000 + 1))::BIGINT),
proofs AS (
  SELECT g, own, coalesce(string_agg(h, '' ORDER BY level, idx) FILTER (WHERE idx <> spot), '') AS proof FROM steps GROUP BY g, own),
numbered AS MATERIALIZED (
  SELECT g, own, spot, level, dense_rank() OVER (PARTITION BY g ORDER BY level) - 1 AS step, idx, h FROM steps),
folds AS (
  SELECT 0 AS step, g, rank AS own, coalesce(other, leaf) AS h FROM placed
  UNION ALL
  SELECT f.step + 1, f.g, f.own, sha256(string_agg(CASE WHEN n.idx = n.spot THEN f.h ELSE n.h END, '' ORDER BY n.idx))
  FROM folds f JOIN numbered n ON n.g = f.g AND n.own = f.own AND n.step = f.step GROUP BY f.step, f.g, f.own),
folded AS (SELECT g, own, arg_max(h, step) AS h FROM folds GROUP BY g, own)
SELECT p.doc_id, p.leaf, s.top AS subroot, o.h AS root, sha256(coalesce(q.proof, '')) AS proof_sha256, f.h AS folded_root, f.h = o.h AS verified
FROM placed p JOIN tops s USING (g) CROSS JOIN (SELECT h FROM over WHERE m = 1) o
LEFT JOIN proofs q ON q.g = p.g AND q.own = p.rank JOIN folded f ON f.g = p.g AND f.own = p.rank
"""
