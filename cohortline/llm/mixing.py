"""Mixing sources to target weights: repetition rates, whole copies and one seeded Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from cohortline.llm.common import utf8
from cohortline.session import cut

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
#: 13 hex digits of a hash, 52 bits, are exact in a double
DIGITS, RANGE = 13, 16.0**13


def n_words(text: str) -> Column:
    """Number of runs of [^\\x20\\x09-\\x0D]; null counts 0."""
    single = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " "))
    blanks = F.length(single) - F.length(F.replace(single, F.lit(" "), F.lit("")))
    return F.when(single == "", 0).otherwise(blanks + 1).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target: `share` of all sizes dealt by weight, no target above `most` times its source.

    Sources in order of code points, null last, take the weights in turn. Sources fill at a common level per weight:
    in order of limit per weight, the level is what is left over the weights left, and the first source whose limit
    reaches it ends the full ones (their levels rise up to there and fall after it). One row per source is ordered, whatever the number of documents.
    """
    listed = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    kinds = F.array(*map(F.lit, weights))
    listed = listed.withColumn("weight", F.get(kinds, ((F.row_number().over(by_name) - 1) % len(weights)).cast("int")).cast("double"))
    listed = listed.withColumn("limit", F.col("source_size") * F.lit(most)).withColumn("reach", F.col("limit") / F.col("weight"))
    order = Window.orderBy("reach", F.col("source").isNull(), F.col("source").cast("binary"))
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    listed = listed.withColumn("level", level)
    full = F.max(F.when(F.col("reach") >= F.col("level"), F.col("level"))).over(whole)
    return listed.select("source", "source_size", F.least("limit", F.coalesce(F.col("weight") * full, F.col("limit"))).alias("target"))


def copies(rate: Column, key: Column, seed: int) -> Column:
    """floor(rate) copies and one more with the fraction's probability, by the hash of the key: reruns agree."""
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))), 1, DIGITS), 16, 10).cast("double")
    return (F.floor(rate) + F.when(draw / F.lit(RANGE) < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7,
             weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, taken.

    Sizes are words; null texts and empty ones have size 0, a source without words has target 0. A null source is a
    source of its own, after all others. Repeated rows are drawn alike. Texts are read once; the sizes are written
    and used twice. The targets are one row per source; Spark chooses how to join them.
    """
    sizes = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(text_col).alias("size")))
    rows = sizes.join(targets(sizes, weights, share, most).withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("copies", copies(rate, F.col("doc_id"), seed))
    return rows.select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7,
          weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The documents themselves, each as often as the mix takes it; the columns stay as they are."""
    names = docs.columns
    sized = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col(id_col).alias("_id"), F.col(source_col).alias("_source"))
    sizes = docs.select(F.col(source_col).alias("source"), n_words(text_col).alias("size"))
    rows = sized.join(targets(sizes, weights, share, most), F.col("_source").eqNullSafe(F.col("source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.select("row", copies(rate, F.col("_id"), seed).alias("n")).where("n > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*")


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
listed AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
numbered AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS pos FROM listed),
weighed AS (SELECT *, CASE pos % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS cap FROM numbered),
levels AS (
  SELECT *, cap / weight AS reach,
    ((SELECT sum(source_size) FROM listed)::DOUBLE * 1.5::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY cap / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap / weight, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
aims AS (
  SELECT source, source_size, least(cap, coalesce(weight * (SELECT max(level) FROM levels WHERE reach >= level), cap)) AS target FROM levels),
rated AS (
  SELECT s.doc_id, s.size, a.source_size, a.target, CASE WHEN a.source_size > 0 THEN a.target / a.source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('7:' || coalesce(s.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS draw
  FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, size, source_size, target, (floor(rate)::BIGINT + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS copies,
  size * (floor(rate)::BIGINT + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS taken
FROM rated
"""
