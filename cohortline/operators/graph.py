"""Concept graph: clean triples, relation profiles and typed negative triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from cohortline.operators.ordered import position
from cohortline.operators.pairs import hashed_number

PROFILE_TOP = 3
SIDES = ("head", "tail")
KINDS = ("domain", "vocabulary")


def clean_concepts(raw: DataFrame) -> DataFrame:
    """Concepts with an id and a name; the last row of an id wins by its line order."""
    trimmed = raw.select(*[F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in ("concept_id", "concept_name", "domain_id", "vocabulary_id")])
    return trimmed.where((F.col("concept_id") != "") & (F.col("concept_name") != "")).select(
        F.col("concept_id").cast("bigint").alias("concept_id"), "concept_name", "domain_id", "vocabulary_id"
    )


def relation_ids(relationships: DataFrame) -> DataFrame:
    """Relation ids by name order; the distinct names are few."""
    names = relationships.select("relationship_id").where(F.col("relationship_id") != "").distinct()
    return names.withColumn("relation_id", (F.row_number().over(Window.orderBy("relationship_id")) - 1).cast("int"))


def triples(relationships: DataFrame, concepts: DataFrame, eval_thousandths: int = 0, seed: int = 42) -> DataFrame:
    """Triples between two known, different concepts, with relation ids and a hashed evaluation split."""
    known = concepts.select("concept_id")
    clean = relationships.where(
        F.col("concept_id_1").isNotNull() & F.col("concept_id_2").isNotNull() & (F.col("relationship_id") != "")
        & (F.col("concept_id_1") != F.col("concept_id_2"))
    )
    linked = clean.join(known.withColumnRenamed("concept_id", "concept_id_1"), "concept_id_1", "left_semi").join(
        known.withColumnRenamed("concept_id", "concept_id_2"), "concept_id_2", "left_semi"
    )
    numbered = linked.join(relation_ids(linked), "relationship_id")
    is_eval = hashed_number(F.lit(seed), F.col("concept_id_1"), F.col("relation_id"), F.col("concept_id_2")) % 1000 < eval_thousandths
    return numbered.select(
        F.col("concept_id_1").alias("head_id"), "relation_id", F.col("concept_id_2").alias("tail_id"),
        F.when(is_eval, "eval").otherwise("train").alias("split"),
    )


def limited(df: DataFrame, limit: int | None, seed: int = 42) -> DataFrame:
    """At most `limit` triples, by hash (a top-k)."""
    if limit is None:
        return df
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), "head_id", "relation_id", "tail_id"))
    return df.orderBy(key, "head_id", "relation_id", "tail_id").limit(limit)


def relation_profile(triple_rows: DataFrame, concepts: DataFrame, top: int = PROFILE_TOP) -> DataFrame:
    """Most frequent domains and vocabularies on each side of each relation, one row per entry."""
    parts = []
    for side in SIDES:
        typed = triple_rows.select("relation_id", F.col(f"{side}_id").alias("concept_id")).join(concepts, "concept_id")
        kinds = F.explode(F.array(
            F.struct(F.lit("domain").alias("kind"), F.col("domain_id").alias("name")),
            F.struct(F.lit("vocabulary").alias("kind"), F.col("vocabulary_id").alias("name")),
        ))
        parts.append(typed.select("relation_id", F.lit(side).alias("side"), kinds.alias("t")).select("relation_id", "side", "t.*"))
    counts = parts[0].unionByName(parts[1]).where(F.col("name") != "").groupBy("relation_id", "side", "kind", "name").agg(
        F.count(F.lit(1)).alias("n")
    )
    order = Window.partitionBy("relation_id", "side", "kind").orderBy(F.col("n").desc(), "name")
    return counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


def concept_pools(concepts: DataFrame, width: int = 65_536) -> DataFrame:
    """Members of every domain, every vocabulary and of the whole graph, numbered from 0 by concept id."""
    kinds = F.explode(F.array(
        F.struct(F.lit("domain").alias("kind"), F.col("domain_id").alias("name")),
        F.struct(F.lit("vocabulary").alias("kind"), F.col("vocabulary_id").alias("name")),
        F.struct(F.lit("all").alias("kind"), F.lit("*").alias("name")),
    ))
    members = concepts.select("concept_id", kinds.alias("t")).select("concept_id", "t.*").where(F.col("name") != "")
    return position(members, ["kind", "name"], ["concept_id"], "idx", F.floor(F.col("concept_id") / width))


def negative_triples(
    triple_rows: DataFrame, concepts: DataFrame, profile: DataFrame, pools: DataFrame, draws: int = 1, seed: int = 42
) -> DataFrame:
    """Typed corruptions of each triple: one side replaced by a concept that is neither its head nor its tail.

    The pool is the first of: the relation's domains of that side, the concept's own domain, the relation's
    vocabularies, its own vocabulary, all concepts - that has a member left. The pick skips head and tail by
    their place in the pool, so it is exact without retries; it is an equi join on (pool, number).
    """
    sizes = pools.groupBy("kind", "name").agg(F.count(F.lit(1)).alias("size"))
    listed = profile.join(sizes, ["kind", "name"]).groupBy("relation_id", "side").agg(
        *[_ordered_pools(kind).alias(f"{kind}_pools") for kind in KINDS]
    )
    places = pools.join(sizes, ["kind", "name"]).groupBy("concept_id").agg(
        *[F.max(F.when(F.col("kind") == k, F.struct("name", "idx", "size"))).alias(k) for k in (*KINDS, "all")]
    )
    drawn = triple_rows.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn(
        "corrupted", F.when(_roll(seed, "side") % 2 == 0, "head").otherwise("tail")
    )
    typed = drawn
    for side in SIDES:
        typed = typed.join(places.select(F.col("concept_id").alias(f"{side}_id"), *[F.col(k).alias(f"{side}_{k}") for k in (*KINDS, "all")]), f"{side}_id")
    typed = typed.join(listed.withColumnRenamed("side", "corrupted"), ["relation_id", "corrupted"], "left")
    at_head = F.col("corrupted") == "head"

    def own(kind: str) -> Column:
        mine = F.when(at_head, F.col(f"head_{kind}")).otherwise(F.col(f"tail_{kind}"))
        return F.filter(F.array(F.struct(F.lit(kind).alias("kind"), mine["name"].alias("name"), mine["size"].alias("size"))), lambda p: p["name"].isNotNull())

    none = F.array().cast("array<struct<kind:string,name:string,size:bigint>>")
    whole = F.array(F.struct(F.lit("all").alias("kind"), F.lit("*").alias("name"), F.col("head_all.size").alias("size")))
    every = F.concat(F.coalesce("domain_pools", none), own("domain"), F.coalesce("vocabulary_pools", none), own("vocabulary"), whole)
    # a pool of three always has a member left, so the relation's own domains usually settle it
    settled = F.exists(F.coalesce("domain_pools", none), lambda p: p["size"] > 2)

    def taken(p: Column, side: str) -> Column:
        return F.coalesce((p["kind"] == "all") | ((p["kind"] == "domain") & (p["name"] == F.col(f"{side}_domain.name")))
                          | ((p["kind"] == "vocabulary") & (p["name"] == F.col(f"{side}_vocabulary.name"))), F.lit(False)).cast("bigint")

    usable = F.filter(
        F.when(settled, F.col("domain_pools")).otherwise(every),
        lambda p: (p["size"] > 2) | (p["size"] - taken(p, "head") - taken(p, "tail") > 0),
    )
    # inline keeps the choice one expression; as a plain struct it would be evaluated once per field
    ids = ["head_id", "relation_id", "tail_id", "draw", "corrupted"]
    chosen = typed.select(*ids, *[f"{s}_{k}" for s in SIDES for k in (*KINDS, "all")], F.inline(F.slice(usable, 1, 1)))

    def place(side: str) -> Column:
        kind, name = F.col("kind"), F.col("name")
        return F.when(kind == "all", F.col(f"{side}_all.idx")).when(
            (kind == "domain") & (name == F.col(f"{side}_domain.name")), F.col(f"{side}_domain.idx")
        ).when((kind == "vocabulary") & (name == F.col(f"{side}_vocabulary.name")), F.col(f"{side}_vocabulary.idx"))

    placed = chosen.select(*ids, "kind", "name", "size", place("head").alias("head_idx"), place("tail").alias("tail_idx"))
    left = F.col("size") - F.col("head_idx").isNotNull().cast("bigint") - F.col("tail_idx").isNotNull().cast("bigint")
    picked = placed.select(*ids, "kind", "name", "head_idx", "tail_idx", F.inline(F.array(F.struct((_roll(seed, "pick") % left).alias("pick")))))
    low = F.least("head_idx", "tail_idx")
    high = F.when(F.col("head_idx").isNotNull() & F.col("tail_idx").isNotNull(), F.greatest("head_idx", "tail_idx"))
    once = picked.withColumn("_once", F.col("pick") + F.when(F.col("pick") >= low, 1).otherwise(0))
    idx = F.col("_once") + F.when(F.col("_once") >= high, 1).otherwise(0)
    return once.select(*ids, "kind", "name", idx.alias("idx")).join(pools, ["kind", "name", "idx"]).select(
        "head_id", "relation_id", "tail_id", "draw", "corrupted", "kind", F.col("concept_id").alias("negative_id")
    )


def _ordered_pools(kind: str) -> Column:
    """Pools of one kind in profile order; a profile has at most three per kind."""
    entries = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("place", "name", "size"))))
    return F.transform(entries, lambda x: F.struct(F.lit(kind).alias("kind"), x["name"].alias("name"), x["size"].alias("size")))


def _roll(seed: int, purpose: str) -> Column:
    return hashed_number(F.lit(seed), F.col("head_id"), F.col("relation_id"), F.col("tail_id"), F.col("draw"), F.lit(purpose))

