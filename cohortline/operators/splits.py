"""Leakage-free splits and balanced caps.

Random order is the order of a hash of the key, so it is repeatable on any cluster. Ranks inside a stratum
come from the bucketed scan (bucket = leading hash digits, which are even), so a stratum with most of the
subjects is ranked by many tasks. Ratios are given in thousandths: quotas are whole-number arithmetic.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from cohortline.functions.text import hash_order
from cohortline.operators.ordered import hash_bucket, position

SPLITS = ("train", "val", "test")


def hash_rank(df: DataFrame, keys: Sequence[str], key: str, seed: int | str, name: str = "rank") -> DataFrame:
    """Rank of `key` within `keys` in hash order, from 0."""
    hashed = df.withColumn("_hash", hash_order(F.col(key), seed))
    return position(hashed, keys, ["_hash", key], name, hash_bucket(F.col("_hash"))).drop("_hash")


def ratio_split(subjects: DataFrame, key: str, train: int, val: int, seed: int = 42) -> DataFrame:
    """Random split of distinct subjects: floor(n * ratio) for train and validation, the rest is test."""
    distinct = subjects.select(key).distinct()
    ranked = hash_rank(distinct.withColumn("_all", F.lit(1)), ["_all"], key, seed)
    sized = ranked.withColumn("_n", distinct.agg(F.count(F.lit(1))).scalar())
    n_train, n_val = F.floor(F.col("_n") * train / 1000), F.floor(F.col("_n") * val / 1000)
    split = F.when(F.col("rank") < n_train, "train").when(F.col("rank") < n_train + n_val, "val").otherwise("test")
    return sized.select(key, split.alias("split"))


def class_split(df: DataFrame, key: str, label: str, train: int, val: int, seed: int = 42) -> DataFrame:
    """Shuffled split within each class."""
    ranked = hash_rank(df.select(key, label), [label], key, seed)
    size = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    n_train, n_val = F.floor(F.col("_n") * train / 1000), F.floor(F.col("_n") * val / 1000)
    split = F.when(F.col("rank") < n_train, "train").when(F.col("rank") < n_train + n_val, "val").otherwise("test")
    return ranked.join(size, label).select(key, label, split.alias("split"))


def any_positive_matrix(samples: DataFrame, subjects: DataFrame, key: str, tasks: Sequence[str], positive: Column) -> DataFrame:
    """0/1 per subject and task: whether any sample of the subject is positive."""
    flags = samples.groupBy(key).agg(
        *[F.max(F.when((F.col("task") == t) & positive, 1).otherwise(0)).alias(t) for t in tasks]
    )
    return subjects.select(key).distinct().join(flags, key, "left").select(
        key, *[F.coalesce(F.col(t), F.lit(0)).alias(t) for t in tasks]
    )


def signature(labels: Sequence[str]) -> Column:
    """Label vector as text, a missing label as a dash."""
    return F.concat(*[F.coalesce(F.col(c).cast("int").cast("string"), F.lit("-")) for c in labels])


def strata(matrix: DataFrame, key: str, labels: Sequence[str], min_size: int = 10) -> DataFrame:
    """Stratum of each subject: its label signature, or for rare signatures its rarest positive label.

    Label totals are one row and signatures a small aggregate; only those meet the subjects again.
    """
    signed = matrix.withColumn("_signature", signature(labels))
    totals = matrix.agg(F.struct(*[F.sum(F.coalesce(F.col(c).cast("bigint"), F.lit(0).cast("bigint"))).alias(c) for c in labels])).scalar()
    candidates = [
        F.when(F.col(c) == 1, F.struct(F.col(f"_totals.{c}").alias("n"), F.lit(c).alias("label"))) for c in labels
    ]
    rarest = F.least(*candidates)["label"] if len(candidates) > 1 else candidates[0]["label"]
    sizes = signed.groupBy("_signature").agg(F.count(F.lit(1)).alias("_size"))
    joined = signed.withColumn("_totals", totals).join(sizes, "_signature")
    stratum = F.when(F.col("_size") >= min_size, F.concat(F.lit("s:"), "_signature")).otherwise(
        F.concat(F.lit("p:"), F.coalesce(rarest, F.lit("none")))
    )
    return joined.select(key, stratum.alias("stratum"))


def stratified_split(subject_strata: DataFrame, key: str, val: int, test: int, seed: int = 42) -> DataFrame:
    """Split so that every stratum gives its share, with running remainders so that totals come out right.

    Strata are laid one after the other; the holdout of a stratum is the whole numbers its stretch covers.
    """
    ranked = hash_rank(subject_strata.select(key, "stratum"), ["stratum"], key, seed)
    sizes = subject_strata.groupBy("stratum").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("stratum").rowsBetween(Window.unboundedPreceding, -1)
    laid = sizes.withColumn("_from", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("bigint")))
    held = val + test
    upto = lambda at: F.floor(at * held / 1000)
    tested = lambda at: F.floor(at * test / held)
    quota = laid.withColumns({"_h0": upto(F.col("_from")), "_h1": upto(F.col("_from") + F.col("_n"))}).select(
        "stratum", (F.col("_h1") - F.col("_h0")).alias("n_held"), (tested(F.col("_h1")) - tested(F.col("_h0"))).alias("n_test")
    )
    split = F.when(F.col("rank") < F.col("n_test"), "test").when(F.col("rank") < F.col("n_held"), "val").otherwise("train")
    return ranked.join(quota, "stratum").select(key, "stratum", split.alias("split"))


def split_label_rates(split: DataFrame, matrix: DataFrame, key: str, labels: Sequence[str]) -> DataFrame:
    """Subjects and label rates per split, to see how even it is."""
    return split.join(matrix, key).groupBy("split").agg(
        F.count(F.lit(1)).alias("subjects"), *[F.avg(F.col(c).cast("double")).alias(c) for c in labels]
    )


def balance_score(split: DataFrame, counts: DataFrame, key: str, ratios: dict[str, int]) -> DataFrame:
    """Sum over splits and labels of ((count - target) / target)^2 for two label counts n0, n1."""
    per_split = split.join(counts, key).groupBy("split").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    totals = counts.agg(F.struct(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"))).scalar()
    ratio = F.create_map(*[F.lit(x) for s, r in ratios.items() for x in (s, r / 1000)])[F.col("split")]
    joined = per_split.withColumn("_t", totals).select("*", "_t.*")

    def part(count: str, total: str) -> Column:
        target = F.greatest(F.col(total) * ratio, F.lit(1.0))
        return F.pow((F.col(count) - target) / target, F.lit(2.0))

    return joined.agg(F.sum(part("n0", "t0") + part("n1", "t1")).alias("score"))


def covering_holdout(
    matrix: DataFrame, key: str, labels: Sequence[str], size_thousandths: int, seed: int = 42
) -> DataFrame:
    """Holdout that keeps label rates and holds at least one subject of every class that has two or more.

    For every (label, class) the first subject in hash order must be held out and the last one must stay;
    both are plain min/max aggregates. The rest is the stratified split. Missing labels join no class.
    """
    hashed = matrix.withColumn("_hash", hash_order(F.col(key), seed))
    place = F.struct("_hash", key)
    picks = hashed.agg(
        *[F.min(F.when(F.col(c) == v, place)).alias(f"first_{c}_{v}") for c in labels for v in (0, 1)],
        *[F.max(F.when(F.col(c) == v, place)).alias(f"last_{c}_{v}") for c in labels for v in (0, 1)],
    )
    pairs = F.array(*[
        F.struct(F.col(f"first_{c}_{v}").alias("first"), F.col(f"last_{c}_{v}").alias("last")) for c in labels for v in (0, 1)
    ])
    kept = picks.select(F.explode(pairs).alias("p")).where(F.col("p.first").isNotNull() & (F.col("p.first") != F.col("p.last")))
    forced = kept.select(F.col(f"p.first.{key}").alias(key)).distinct().withColumn("_must", F.lit(1))
    stay = kept.select(F.col(f"p.last.{key}").alias(key)).distinct().withColumn("_stay", F.lit(1))
    base = stratified_split(strata(matrix, key, labels), key, size_thousandths, 0, seed)
    marked = base.join(F.broadcast(forced), key, "left").join(F.broadcast(stay), key, "left")
    split = (
        F.when(F.col("_must").isNotNull(), "holdout").when(F.col("_stay").isNotNull(), "train")
        .when(F.col("split") == "val", "holdout").otherwise("train")
    )
    return marked.select(key, split.alias("split"))


def validation_from_train(split: DataFrame, key: str, val: int, seed: int = 42) -> DataFrame:
    """Carve a validation part out of train where a split has none; other parts stay as they are."""
    train = split.where(F.col("split") == "train").select(key)
    carved = ratio_split(train, key, 1000 - val, val, seed).withColumn(
        "split", F.when(F.col("split") == "train", "train").otherwise("val")
    )
    return split.where(F.col("split") != "train").select(key, "split").unionByName(carved)


def label_counts(rows: Sequence[DataFrame], key: str, label: str) -> DataFrame:
    """0/1 label counts per subject over several task tables."""
    merged = reduce(lambda a, x: a.unionByName(x), [r.select(key, label) for r in rows])
    return merged.groupBy(key).agg(
        F.sum((F.col(label) == 0).cast("bigint")).alias("n0"), F.sum((F.col(label) == 1).cast("bigint")).alias("n1")
    )


def class_weight(df: DataFrame, label: str) -> DataFrame:
    """n0 / n1 of a binary label; a job on other labels or on one class only fails."""
    n0, n1 = F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)
    other = F.count_if(F.col(label).isNull() | ~F.col(label).isin(0, 1))
    checked = F.when((other == 0) & (n0 > 0) & (n1 > 0), n0 / n1).otherwise(
        F.raise_error(F.lit("class weight needs labels 0 and 1, both present")).cast("double")
    )
    return df.agg(checked.alias("pos_weight"))


def quota_table(df: DataFrame, keys: Sequence[str], total: int, extra_last: bool = True) -> DataFrame:
    """Rows each class may keep of `total`, as even as the class sizes allow.

    Classes are laid out by size. Those under their fair share keep everything; from the first one above
    it, the rest is shared evenly, the odd rows going to the largest classes (`extra_last`) or the smallest.
    The table has one row per class.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    order = Window.orderBy("_n", *keys)
    whole = Window.partitionBy(F.lit(1))
    laid = sizes.withColumns({
        "_i": F.row_number().over(order) - 1,
        "_before": F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint")),
        "_k": F.count(F.lit(1)).over(whole),
    })
    share = F.floor((F.lit(total) - F.col("_before")) / (F.col("_k") - F.col("_i")))
    marked = laid.withColumn("_first", F.min(F.when(F.col("_n") > share, F.struct("_i", "_before"))).over(whole))
    rest = F.greatest(F.lit(total) - F.col("_first._before"), F.lit(0))
    tail = F.col("_k") - F.col("_first._i")
    place = F.col("_i") - F.col("_first._i")
    odd = (place >= tail - rest % tail) if extra_last else (place < rest % tail)
    quota = F.when(F.col("_first").isNull() | (place < 0), F.col("_n")).otherwise(
        F.floor(rest / tail) + odd.cast("bigint")
    )
    return marked.select(*keys, quota.cast("bigint").alias("_quota"))


def balanced_cap(df: DataFrame, keys: Sequence[str], row_key: str, total: int, seed: int = 42) -> DataFrame:
    """At most `total` rows, spread evenly over classes, chosen in hash order."""
    ranked = hash_rank(df, keys, row_key, seed, "_rank")
    return ranked.join(quota_table(df, keys, total), list(keys)).where(F.col("_rank") < F.col("_quota")).select(*df.columns)


def shortest_first_cap(df: DataFrame, keys: Sequence[str], length: str, row_key: str, total: int) -> DataFrame:
    """At most `total` rows, spread evenly over classes, the shortest of each class first."""
    ranked = position(df, keys, [length, row_key], "_rank")
    quota = quota_table(df, keys, total, extra_last=False)
    return ranked.join(quota, list(keys)).where(F.col("_rank") < F.col("_quota")).select(*df.columns)


def subject_cap(df: DataFrame, key: str, limit: int, seed: int = 42) -> DataFrame:
    """Rows of `limit` subjects picked in hash order (top-k over distinct subjects, then a semi join)."""
    picked = df.select(key).distinct().orderBy(hash_order(F.col(key), seed), key).limit(limit)
    return df.join(picked, key, "left_semi")
