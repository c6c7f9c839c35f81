"""Feature tables: windows over tables, thinning, tails, vocabularies, token rows and embedding plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from cohortline.functions import numbers, text, times
from cohortline.operators.ordered import Running, position, scan
from cohortline.session import cut

# The tokens that lead every vocabulary.
SPECIAL_TOKENS = ("[PAD]", "[UNK]", "[MASK]")
POSITION_BUCKET = 4096


def window_starts(length: Column, window: int, stride: int | None = None) -> Column:
    """Starts of overlapping windows with a last one flush right; tables shorter than two rows have none."""
    step = F.lit(stride or (window - 1))
    last = length - F.lit(window)
    moving = F.array_distinct(F.concat(F.sequence(F.lit(0).cast("bigint"), last, step.cast("bigint")), F.array(last)))
    none = F.array().cast("array<bigint>")
    return F.when(length < 2, none).when(length <= window, F.array(F.lit(0).cast("bigint"))).otherwise(moving)


def windows(lengths: DataFrame, window: int, stride: int | None = None) -> DataFrame:
    """One row per window of each sample."""
    starts = window_starts(F.col("table_length").cast("bigint"), window, stride)
    return lengths.select("sample_id", F.explode(starts).alias("start"))


def thinned_rows(rows: DataFrame, lengths: DataFrame, limit: int, recent_ratio: float = 0.75, seed: int = 42) -> DataFrame:
    """At most `limit` rows per sample: the newest part whole, older rows by hash, order kept.

    Older rows are a top-k by hash per sample, which Spark prunes before it shuffles.
    """
    recent = min(max(round(limit * recent_ratio), 0), limit)
    history = limit - recent
    joined = rows.join(lengths, "sample_id")
    from_recent = F.col("table_length") - recent
    whole = (F.col("table_length") <= limit) | (F.col("pos") >= from_recent)
    key = F.concat_ws("|", F.col("sample_id").cast("string"), F.col("pos").cast("string"))
    older = joined.where(~whole).withColumn("_hash", text.hash_order(key, seed))
    ranked = older.withColumn("_rank", F.row_number().over(Window.partitionBy("sample_id").orderBy("_hash", "pos")))
    return joined.where(whole).select(*rows.columns).unionByName(ranked.where(F.col("_rank") <= history).select(*rows.columns))


def tail_rows(rows: DataFrame, limit: int) -> DataFrame:
    """The last `limit` rows of each sample; a row limit per group is pruned before the shuffle."""
    last = Window.partitionBy("sample_id").orderBy(F.col("pos").desc())
    return rows.withColumn("_rank", F.row_number().over(last)).where(F.col("_rank") <= limit).drop("_rank")


def relative_hours(rows: DataFrame, time: str = "Time") -> DataFrame:
    """Hours from the first row's time plus one; 0 for a missing time, all 0 when the first row has none."""
    first = rows.groupBy("sample_id").agg(F.min_by(F.struct(F.col(time).alias("at")), "pos").alias("_first"))
    hours = times.hours_between(F.col("_first.at"), F.col(time)) + 1
    return rows.join(first, "sample_id").withColumn("rel_hours", F.coalesce(hours, F.lit(0.0))).drop("_first")


def next_row_targets(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Next row's fields and the log of the time to it, usable only if both relative times are positive."""
    ahead = Running("_next", "last", F.struct(*fields, "rel_hours"), inclusive=False)
    bucket = F.floor(F.col("pos") / F.lit(POSITION_BUCKET))
    stepped = scan(rows, ["sample_id"], ["pos"], [ahead], bucket, descending=True).where(F.col("_next").isNotNull())
    usable = (F.col("rel_hours") > 0) & (F.col("_next.rel_hours") > 0)
    delta = F.when(usable, numbers.log1p_delta(F.col("_next.rel_hours") - F.col("rel_hours")))
    return stepped.select(
        "sample_id", "pos", *[F.col(f"_next.{f}").alias(f"next_{f}") for f in fields], delta.alias("time_delta"),
    )


def harvested_texts(tables: DataFrame, context: Sequence[str] = ()) -> DataFrame:
    """Distinct texts of items, units and non-numeric values; equal contexts are read once."""
    rows = tables.dropDuplicates(list(context)) if context else tables
    value = F.col("Value").cast("string")
    worded = F.when(numbers.to_number(value).isNull(), value)
    texts = rows.select(F.explode(F.array(F.col("Item"), F.col("Unit"), worded)).alias("text"))
    return texts.where(F.col("text").isNotNull() & (text.clean_text(F.col("text")) != "")).distinct()


def vocabulary(texts: DataFrame) -> DataFrame:
    """Ids of texts in text order, after the special tokens; a distributed sort, no single-task ranking."""
    plain = texts.select("text").where(~F.col("text").isin(*SPECIAL_TOKENS)).distinct().withColumn("_all", F.lit(1))
    ranked = position(plain, ["_all"], ["text"], "id", start=len(SPECIAL_TOKENS))
    special = texts.sparkSession.createDataFrame(list(enumerate(SPECIAL_TOKENS)), "id bigint, text string")
    return special.select("text", "id").unionByName(ranked.select("text", "id"))


def grown_vocabulary(known: DataFrame, texts: DataFrame) -> DataFrame:
    """The known texts with their ids, and new ones numbered in text order from the highest id on.

    An id never moves, so cached embeddings and token rows stay right when texts are added. The new texts are found by one anti-join
    and ranked by a distributed sort; `known` is written first if it is made anew on each use.
    """
    last = known.agg(F.coalesce(F.max("id"), F.lit(len(SPECIAL_TOKENS) - 1).cast("bigint")).alias("_last"))
    fresh = texts.select("text").where(F.col("text").isNotNull() & ~F.col("text").isin(*SPECIAL_TOKENS)).distinct()
    fresh = fresh.join(known.select("text"), "text", "left_anti").withColumn("_all", F.lit(1))
    ranked = position(fresh, ["_all"], ["text"], "_rank", start=1)
    return known.select("text", "id").unionByName(ranked.select("text", (F.col("_rank") + last.scalar()).alias("id")))


def token_rows(rows: DataFrame, vocab: DataFrame, types: Sequence[str], pad: int = 0) -> DataFrame:
    """Ids of item, unit, worded value and category, numeric value with its mask, relative time.

    The three text look-ups are joins on text: whether the vocabulary is broadcast is Spark's choice by size.
    """
    number = numbers.to_number(F.col("Value"))
    prepared = rows.withColumns({
        "numeric_value": F.coalesce(number, F.lit(0.0)), "numeric_mask": number.isNotNull().cast("int"),
        "_worded": F.when(number.isNull(), F.col("Value").cast("string")),
        "type_id": F.coalesce(F.array_position(F.array(*[F.lit(t) for t in types]), F.col("Category")), F.lit(0)).cast("int"),
    })
    for column, name in (("Item", "item_id"), ("Unit", "unit_id"), ("_worded", "value_text_id")):
        ids = vocab.select(F.col("text").alias(column), F.col("id").alias(f"_{name}"))
        prepared = prepared.join(ids, column, "left").withColumn(name, F.coalesce(F.col(f"_{name}"), F.lit(pad).cast("bigint"))).drop(f"_{name}")
    return prepared.drop("_worded")


def token_batches(tokens: DataFrame, window: int, columns: Sequence[str]) -> DataFrame:
    """Token columns as arrays per window of at most `window` positions, so no array grows with a sample."""
    chunk = F.floor(F.col("pos") / F.lit(window)).alias("chunk")
    listed = F.array_sort(F.collect_list(F.struct("pos", *columns)))
    grouped = tokens.groupBy("sample_id", chunk).agg(listed.alias("_rows"))
    return grouped.select("sample_id", "chunk", *[F.col("_rows")[c].alias(c) for c in columns])


def kept_blocks(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows whose block is in the sample's kept list; an empty list keeps all. `kept`: sample_id, block_ids."""
    joined = rows.join(kept, "sample_id", "left")
    every = F.coalesce(F.size("block_ids"), F.lit(0)) <= 0
    return joined.where(every | F.array_contains("block_ids", F.col("block_id").cast("string"))).select(*rows.columns)


def numeric_features(tokens: DataFrame) -> DataFrame:
    """Dense ids from 1 of the (item, unit) pairs that carry numbers, in id order."""
    pairs = tokens.where(F.col("numeric_mask") == 1).select("item_id", "unit_id").distinct().withColumn("_all", F.lit(1))
    return position(pairs, ["_all"], ["item_id", "unit_id"], "feature_id", start=1).select("item_id", "unit_id", "feature_id")


def with_feature_ids(tokens: DataFrame, features: DataFrame) -> DataFrame:
    joined = tokens.join(features, ["item_id", "unit_id"], "left")
    return joined.withColumn("feature_id", F.coalesce("feature_id", F.lit(0).cast("bigint")))


def embedding_plan(wanted: DataFrame, cached: DataFrame) -> DataFrame:
    """Keys whose text is missing from the cache or differs there."""
    known = cached.select(F.col("key"), F.col("text").alias("cached_text"))
    joined = wanted.join(known, "key", "left").where(~F.col("text").eqNullSafe(F.col("cached_text")))
    return joined.select("key", "text", F.when(F.col("cached_text").isNull(), "missing").otherwise("changed").alias("state"))


def multi_hot(labels: Column, classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: F.array_contains(labels, i).cast("int"))


def candidate_labels(samples: DataFrame, vocabulary_rows: DataFrame, negatives: int, seed: int = 42) -> DataFrame:
    """Candidates per sample: its own targets and `negatives` hashed picks from the vocabulary that are none of them.

    `samples`: sample_id, target (one row per target); `vocabulary_rows`: idx (dense from 0), target. Each pick is a number
    from a hash; a few spare picks replace hits on own targets. After them come as many neighbours of one more hashed place
    as can be taken already plus `negatives`, so a sample gets all its negatives whenever the vocabulary has them. Places are
    drawn, made distinct and rid of the sample's own inside its row; only the chosen ones become rows and are looked up.
    """
    vocabulary_rows = cut(vocabulary_rows.select("idx", "target"))
    size, distinct = vocabulary_rows.agg(F.count(F.lit(1)), F.count_distinct("target")).first()
    if distinct < size:
        places = vocabulary_rows.groupBy("target").agg(F.collect_list("idx").alias("_places"))
    else:
        places = vocabulary_rows.select("target", F.array("idx").alias("_places"))
    own = samples.select("sample_id", "target").distinct()
    keys = own.join(places, "target", "left").groupBy("sample_id").agg(
        F.count(F.lit(1)).cast("int").alias("_own"), F.flatten(F.collect_list("_places")).alias("_taken"))

    def number(turn: Column) -> Column:
        text = F.concat(F.col("sample_id").cast("string"), F.lit("|"), turn.cast("string"), F.lit(f"|{seed}"))
        return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")

    held, spare = F.lit(max(size, 1)), F.col("_own") + F.lit(negatives * 4)
    hashed = F.transform(F.sequence(F.lit(1), spare), lambda draw: number(draw) % held)
    beside = F.transform(F.sequence(spare + 1, spare + F.col("_own") + negatives), lambda draw: (F.col("_beside") + draw) % held)
    drawn = keys.withColumn("_beside", number(F.lit(0))).withColumn("_fresh", F.array_except(F.concat(hashed, beside), F.col("_taken")))
    if distinct < size:
        found = drawn.select("sample_id", F.posexplode("_fresh").alias("draw", "idx")).join(vocabulary_rows, "idx")
        once = found.groupBy("sample_id", "target").agg(F.min("draw").alias("draw"))
        ranked = once.withColumn("_rank", F.row_number().over(Window.partitionBy("sample_id").orderBy("draw")))
        chosen = ranked.where(F.col("_rank") <= negatives)
    else:
        chosen = drawn.select("sample_id", F.explode(F.slice("_fresh", 1, negatives)).alias("idx")).join(vocabulary_rows, "idx")
    return own.withColumn("label", F.lit(1)).unionByName(chosen.select("sample_id", "target", F.lit(0).alias("label")))
