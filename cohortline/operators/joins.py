"""Joins that Spark has no operator for, as equi joins on (key, bucket)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from cohortline.operators.ordered import Running, lookup, position
from cohortline.session import cut


def dyadic_cover(first: Column, last: Column) -> Column:
    """The whole numbers from first to last as an array of nodes (level, node), each 2^level numbers: at most two per level.

    On each level the uncovered stretch [l, r) gives a node at an end that no node of the level above can hold.
    """
    def at(k: Column) -> Column:
        l, r = -F.call_function("shiftright", -first, k), F.call_function("shiftright", last + 1, k)
        node = lambda number: F.struct(k.alias("level"), number.alias("node"))
        ends = F.array(F.when(l % 2 != 0, node(l)), F.when(r % 2 != 0, node(r - 1)))
        return F.when(l < r, F.filter(ends, lambda n: n.isNotNull())).otherwise(F.array().cast("array<struct<level:int,node:bigint>>"))

    top = F.greatest(F.lit(0), F.floor(F.log2((last - first + 1).cast("double"))).cast("int")) + 1
    return F.flatten(F.transform(F.sequence(F.lit(0), top), at))


def ancestors(number: Column, levels: Sequence[int]) -> Column:
    """The nodes of the given levels that hold a number."""
    return F.array(*[F.struct(F.lit(k).cast("int").alias("level"), F.shiftright(number, k).alias("node")) for k in levels])


def used_levels(nodes: DataFrame) -> list[int]:
    """The levels that occur: at most 64 numbers, whatever the table."""
    return sorted(r["level"] for r in nodes.select("level").distinct().collect())


def within_interval(
    intervals: DataFrame, points: DataFrame, keys: Sequence[str], low: str, high: str, at: str, width: float,
) -> DataFrame:
    """Points with the interval's keys that lie in [low, high], both ends included.

    Numbers are counted in units of `width`. An interval of n units is covered by at most 2 log2(n) + 2 nodes of 2^level units each, a
    point lies in one node per level that occurs; the join is on (keys, level, node). So a long interval costs little more than a
    short one, a key with most of the rows is spread over its nodes, and only the ends leave pairs to drop. `low`, `high` and `at`
    are numbers.
    """
    def unit(column: str) -> Column:
        return F.floor(F.col(column) / F.lit(width)).cast("bigint")

    nodes = intervals.where(F.col(low) <= F.col(high)).withColumn("_n", F.explode(dyadic_cover(unit(low), unit(high))))
    spread = cut(nodes.select(*intervals.columns, F.col("_n.level").alias("level"), F.col("_n.node").alias("_node")).withColumnRenamed("level", "_level"))
    levels = used_levels(spread.select(F.col("_level").alias("level")))
    held = F.array().cast("array<struct<level:int,node:bigint>>") if not levels else ancestors(unit(at), levels)
    placed = points.withColumn("_n", F.explode(held)).withColumns({"_level": F.col("_n.level"), "_node": F.col("_n.node")}).drop("_n")
    joined = spread.join(placed, [*keys, "_level", "_node"])
    return joined.where((F.col(at) >= F.col(low)) & (F.col(at) <= F.col(high))).drop("_level", "_node")


def map_values(df: DataFrame, dictionary: DataFrame, on: Sequence[str], value: str, default: Column | None = None) -> DataFrame:
    """Left join of a dictionary; its size decides how Spark joins it. A missing entry gives `default`."""
    joined = df.join(dictionary.select(*on, value), list(on), "left")
    return joined if default is None else joined.withColumn(value, F.coalesce(F.col(value), default))


def last_entry(dictionary: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """One value per key; of several the last in `order` wins."""
    return dictionary.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def first_entry(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in `order`, as one aggregate (no sort of a whole key)."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def prioritised_codes(items: DataFrame, maps: Sequence[DataFrame], key: str) -> DataFrame:
    """Code of each item from several maps, a later map winning over an earlier one, else `ITEMID/<id>`.

    Each map: key, vocabulary, code; a blank vocabulary leaves the code bare, a blank code is no entry.
    """
    ranked = None
    for rank, entries in enumerate(maps):
        vocabulary = F.trim(F.coalesce("vocabulary", F.lit("")))
        code = F.trim(F.coalesce("code", F.lit("")))
        full = F.when(~F.lower(vocabulary).isin("", "nan", "none"), F.concat(vocabulary, F.lit("/"), code)).otherwise(code)
        rows = entries.where(~F.lower(code).isin("", "nan", "none")).select(
            F.col(key), full.alias("item_code"), F.lit(rank).alias("_rank")
        )
        ranked = rows if ranked is None else ranked.unionByName(rows)
    best = ranked.groupBy(key).agg(F.max_by("item_code", F.struct("_rank", "item_code")).alias("item_code"))
    return items.join(best, key, "left").withColumn(
        "item_code", F.coalesce("item_code", F.concat(F.lit("ITEMID/"), F.col(key).cast("string")))
    )


def code_descriptions(codes: DataFrame, main: DataFrame, by_prefix: dict[str, DataFrame]) -> DataFrame:
    """Description of `vocabulary/code`: the main dictionary, else that of its vocabulary on the bare code."""
    result = codes.join(main.withColumnRenamed("description", "_main"), "code", "left")
    found = [F.col("_main")]
    for i, (prefix, dictionary) in enumerate(by_prefix.items()):
        bare = F.when(F.col("code").startswith(f"{prefix}/"), F.substring_index("code", f"{prefix}/", -1))
        part = dictionary.select(F.col("code").alias(f"_code{i}"), F.col("description").alias(f"_text{i}"))
        result = result.withColumn("_bare", bare).join(part, F.col("_bare") == F.col(f"_code{i}"), "left").drop(f"_code{i}", "_bare")
        found.append(F.col(f"_text{i}"))
    return result.select(*codes.columns, F.coalesce(*found, F.lit("")).alias("description"))


RANGE = ("low", "high", "unit")


def range_pieces(ranges: DataFrame) -> DataFrame:
    """item, slot, start, hit: for each slot of an item the first fitting range from `start` to the next start, or none.

    An item's ranges are cut at all their ends into pieces that lie in them wholly or not at all. A range covers a run of
    pieces, that is at most two nodes per level of a binary tree over them; the least place per node is kept, and a piece takes the
    least of its own nodes. Slots are the genders that an item's ranges name, and one, null, for all others.
    """
    given = ranges.where(F.col("age_min") < F.col("age_max")).select("item", "place", "age_min", "age_max", "range_gender", *RANGE)
    ends = given.select("item", F.explode(F.array("age_min", "age_max")).alias("start")).distinct()
    ends = cut(position(ends, ["item"], ["start"], "k"))
    begin = ends.select("item", F.col("start").alias("age_min"), F.col("k").alias("first"))
    stop = ends.select("item", F.col("start").alias("age_max"), (F.col("k") - 1).alias("last"))
    nodes = given.join(begin, ["item", "age_min"]).join(stop, ["item", "age_max"])
    hit = F.struct("place", *RANGE)
    nodes = nodes.withColumn("n", F.explode(dyadic_cover(F.col("first"), F.col("last"))))
    nodes = cut(nodes.groupBy("item", "range_gender", F.col("n.level").alias("level"), F.col("n.node").alias("node")).agg(F.min(hit).alias("hit")))
    slots = given.select("item", "range_gender").distinct().unionByName(given.select("item", F.lit(None).cast("string").alias("range_gender")).distinct()).distinct()
    levels = used_levels(nodes)
    if not levels:
        return ends.join(slots, "item").select("item", F.col("range_gender").alias("slot"), "start", F.lit(None).cast(nodes.schema["hit"].dataType).alias("hit"))
    above = ends.select("item", "start", F.explode(ancestors(F.col("k"), levels)).alias("n")).select("item", "start", "n.level", "n.node")
    held = above.join(nodes, ["item", "level", "node"]).groupBy("item", "start", "range_gender").agg(F.min("hit").alias("hit"))
    # a slot's piece has the least of its own gender's hit and that of ranges for all
    own = held.where("range_gender IS NOT NULL").select("item", "start", F.col("range_gender").alias("slot"), "hit")
    for_all = held.where("range_gender IS NULL").join(slots, "item").select("item", "start", slots["range_gender"].alias("slot"), "hit")
    none = ends.join(slots, "item").select("item", "start", F.col("range_gender").alias("slot"), F.lit(None).cast(nodes.schema["hit"].dataType).alias("hit"))
    return own.unionByName(for_all).unionByName(none).groupBy("item", "slot", "start").agg(F.min("hit").alias("hit"))


def reference_range(
    rows: DataFrame, ranges: DataFrame, item: str = "item", age: str = "age", gender: str = "gender",
) -> DataFrame:
    """First matching range per row, by place: same item, age in [age_min, age_max), gender equal or unset.

    Rows find the piece of their item's ranges that holds their age in one ordered scan: no pair of a row and a range is
    formed, and neither side is sent to all tasks, whatever their sizes. Rows without a range, an item or an age keep nulls.
    """
    pieces = cut(range_pieces(ranges))
    slots = pieces.select(F.col("item").alias(item), F.col("slot").alias(gender)).where(F.col(gender).isNotNull()).distinct().withColumn("_slot", F.col(gender))
    asked = rows.join(slots, [item, gender], "left").select(*rows.columns, "_slot", F.col(item).alias("_item"))
    points = pieces.select(F.col("item").alias("_item"), F.col("slot").alias("_slot"), F.col("start").cast("double").alias("_start"), F.col("hit"), F.lit(True).alias("known"))
    # an age that isn't known comes before all pieces
    found = lookup(asked.withColumn("_age", F.col(age).cast("double")), points, ["_item", "_slot"], "_age", "_start",
                   [Running("_piece", "last", F.when(F.col("_p_known"), F.struct(F.col("_p_hit").alias("hit"))))], held=["hit", "known"])
    return found.select(*rows.columns, F.col("_piece.hit.low").alias("low"), F.col("_piece.hit.high").alias("high"), F.col("_piece.hit.unit").alias("range_unit"))


def unmatched(rows: DataFrame, column: str, reason: str | Column) -> DataFrame:
    """Rows whose look-up gave nothing, with a reason."""
    return rows.where(F.col(column).isNull()).withColumn("reason", F.lit(reason) if isinstance(reason, str) else reason)


def title_codes(dictionary: DataFrame, order: Sequence[str]) -> DataFrame:
    """Title to code, also under the lower-case title; of several codes the last wins."""
    both = dictionary.select(F.col("long_title").alias("title"), "icd_code", *order).unionByName(
        dictionary.select(F.lower("long_title").alias("title"), "icd_code", *order)
    )
    return last_entry(both, "title", "icd_code", order)


def required(df: DataFrame, column: str, message: str) -> DataFrame:
    """Fail the job where a look-up that must succeed did not."""
    checked = F.when(F.col(column).isNull(), F.raise_error(F.lit(message)).cast(df.schema[column].dataType)).otherwise(F.col(column))
    return df.withColumn(column, checked)


def merge_by_context(parts: DataFrame, keys: Sequence[str], task: str = "task", label: str = "label") -> DataFrame:
    """Labels of many tasks per context as a map; a task met twice in one context fails the job.

    Tasks per context are bounded by the task catalogue.
    """
    single = parts.groupBy(*keys, task).agg(F.min(label).alias(label), F.count(F.lit(1)).alias("_n"))
    checked = F.when(F.col("_n") > 1, F.raise_error(F.lit("a task occurs twice in one context")).cast("string")).otherwise(F.col(task))
    return single.withColumn(task, checked).groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(task, label)))).alias("labels")
    )


def distinct_rank_limit(df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int) -> DataFrame:
    """Top rows per key; Spark prunes each task to `limit` rows per key before the shuffle."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rank") <= limit).drop("_rank")
