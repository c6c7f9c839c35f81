"""Classification and regression metrics over prediction tables.

Curves are built on distinct scores: equal scores are added up first, then summed along the score order by a
distributed scan. So one task with all predictions is still many tasks' work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from cohortline.operators.ordered import Running, scan

EPS = 2.220446049250313e-16


def score_curve(df: DataFrame, keys: Sequence[str], label: str = "label", score: str = "score") -> DataFrame:
    """Per distinct score, highest first: positives and negatives at it, and the counts at or above it."""
    points = df.groupBy(*keys, F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    steps = [Running("tp", "sum", F.col("pos")), Running("fp", "sum", F.col("neg"))]
    return scan(points, keys, ["score"], steps, descending=True)


def with_totals(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    totals = curve.groupBy(*keys).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return curve.join(totals, list(keys))


def ranking_metrics(df: DataFrame, keys: Sequence[str], label: str = "label", score: str = "score") -> DataFrame:
    """AUROC, AUPRC (average precision) and the score with the best F1 (the lowest of equals) per key.

    One class only gives AUROC 0.5; no positive gives AUPRC 0.
    """
    curve = with_totals(score_curve(df, keys, label, score), keys)
    below = F.col("N") - F.col("fp")
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    recall = F.when(F.col("P") > 0, F.col("tp") / F.col("P")).otherwise(1.0)
    f1 = 2.0 * precision * recall / F.greatest(precision + recall, F.lit(EPS))
    area = F.sum(F.col("pos") * (below + F.col("neg") / 2.0))
    average = F.sum(F.when(F.col("P") > 0, F.col("pos") / F.col("P") * precision))
    # compared after rounding to 12 digits, so that equal F1 values stay equal
    best = F.max_by(F.struct("score", f1.alias("f1")), F.struct(F.round(f1, 12).alias("f1"), -F.col("score")))
    return curve.groupBy(*keys).agg(
        F.when((F.first("P") > 0) & (F.first("N") > 0), area / (F.first("P") * F.first("N"))).otherwise(0.5).alias("auroc"),
        F.coalesce(average, F.lit(0.0)).alias("auprc"), best.alias("_best"),
    ).select(*keys, "auroc", "auprc", F.col("_best.score").alias("best_threshold"), F.col("_best.f1").alias("best_f1"))


def binary_at_threshold(df: DataFrame, keys: Sequence[str], threshold: Column, label: str = "label", score: str = "score") -> DataFrame:
    """Accuracy, F1 and recall of `score >= threshold`, with 0 for an empty denominator."""
    said = F.col(score) >= threshold
    true = F.col(label) == 1
    counted = df.groupBy(*keys).agg(
        F.count_if(said & true).alias("tp"), F.count_if(said & ~true).alias("fp"), F.count_if(~said & true).alias("fn"),
        F.count(F.lit(1)).alias("n"), F.count_if(said == true).alias("right"),
    )
    return counted.select(
        *keys, (F.col("right") / F.col("n")).alias("accuracy"),
        _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
        _ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
    )


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def binary_report(df: DataFrame, keys: Sequence[str], threshold: float | None = 0.5) -> DataFrame:
    """All binary metrics per key; without a threshold the best-F1 one of each key is used."""
    ranked = ranking_metrics(df, keys)
    if threshold is not None:
        return ranked.join(binary_at_threshold(df, keys, F.lit(threshold)), list(keys)).withColumn("threshold", F.lit(threshold))
    chosen = df.join(ranked.select(*keys, F.col("best_threshold").alias("threshold")), list(keys))
    return ranked.join(binary_at_threshold(chosen, keys, F.col("threshold")), list(keys)).withColumn(
        "threshold", F.col("best_threshold")
    )


def confusion(df: DataFrame, keys: Sequence[str], label: str = "label", predicted: str = "predicted") -> DataFrame:
    return df.groupBy(*keys, label, predicted).agg(F.count(F.lit(1)).alias("n"))


def class_scores(cells: DataFrame, keys: Sequence[str], label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Per class: hits, predicted and true counts, from a confusion table."""
    as_true = cells.groupBy(*keys, F.col(label).alias("class")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col(label) == F.col(predicted), F.col("n")).otherwise(0)).alias("hits")
    )
    as_said = cells.groupBy(*keys, F.col(predicted).alias("class")).agg(F.sum("n").alias("said"))
    zero = F.lit(0).cast("bigint")
    return as_true.join(as_said, [*keys, "class"], "full").select(
        *keys, "class", *[F.coalesce(F.col(c), zero).alias(c) for c in ("support", "hits", "said")]
    )


def multiclass_report(df: DataFrame, keys: Sequence[str], label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Accuracy, macro F1 and macro recall over the classes seen as label or prediction."""
    per_class = class_scores(confusion(df, keys, label, predicted), keys, label, predicted)
    return per_class.groupBy(*keys).agg(
        (F.sum("hits") / F.sum("support")).alias("accuracy"),
        F.avg(_ratio(2 * F.col("hits"), F.col("support") + F.col("said"))).alias("macro_f1"),
        F.avg(_ratio(F.col("hits"), F.col("support"))).alias("macro_recall"),
    )


def one_vs_rest(df: DataFrame, scores: str, label: str = "label") -> DataFrame:
    """One row per class: whether it is the label, and its score."""
    classes = F.posexplode(F.col(scores)).alias("class", "score")
    return df.select("*", classes).withColumn("hit", (F.col("class") == F.col(label)).cast("int"))


def multiclass_ranking(df: DataFrame, keys: Sequence[str], scores: str, label: str = "label") -> DataFrame:
    """Mean AUROC and AUPRC of each class against the rest."""
    per_class = ranking_metrics(one_vs_rest(df, scores, label), [*keys, "class"], "hit", "score")
    return per_class.groupBy(*keys).agg(F.avg("auroc").alias("auroc_ovr"), F.avg("auprc").alias("auprc_macro"))


def multilabel_report(df: DataFrame, keys: Sequence[str], labels: str, scores: str, threshold: float = 0.5) -> DataFrame:
    """Micro and macro AUROC, AUPRC and F1 of label vectors; macro ranking over classes with both labels."""
    pairs = F.posexplode(F.arrays_zip(F.col(labels), F.col(scores))).alias("class", "pair")
    cells = df.select(*keys, pairs).select(
        *keys, "class", F.col(f"pair.{labels}").cast("int").alias("label"), F.col(f"pair.{scores}").alias("score")
    )
    micro = ranking_metrics(cells, keys).select(*keys, F.col("auroc").alias("micro_auroc"), F.col("auprc").alias("micro_auprc"))
    per_class = ranking_metrics(cells, [*keys, "class"]).join(
        cells.groupBy(*keys, "class").agg(F.count_distinct("label").alias("kinds")), [*keys, "class"]
    )
    macro = per_class.where(F.col("kinds") == 2).groupBy(*keys).agg(
        F.avg("auroc").alias("macro_auroc"), F.avg("auprc").alias("macro_auprc")
    )
    said = F.col("score") >= threshold
    true = F.col("label") == 1
    counted = cells.groupBy(*keys, "class").agg(
        F.count_if(said & true).alias("tp"), F.count_if(said & ~true).alias("fp"), F.count_if(~said & true).alias("fn")
    )
    f1 = counted.groupBy(*keys).agg(
        _ratio(2 * F.sum("tp"), 2 * F.sum("tp") + F.sum("fp") + F.sum("fn")).alias("micro_f1"),
        F.avg(_ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("macro_f1"),
    )
    return micro.join(macro, list(keys), "left").join(f1, list(keys))


def candidate_ranking(df: DataFrame, keys: Sequence[str], group: str, order: str, cuts: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """MRR and recall at k over candidate lists; lists without a positive are left out.

    `df`: keys, list id, label, score and a position that breaks ties. The rank of the first positive is a
    count of the candidates before it; only the top of each list is ranked, and Spark prunes that early.
    """
    lists = [*keys, group]
    place = F.struct(F.col("score"), (-F.col(order)).alias("tie"))
    best = df.groupBy(*lists).agg(
        F.max(F.when(F.col("label") == 1, place)).alias("best"), F.sum("label").alias("positives")
    ).where(F.col("positives") > 0)
    ahead = df.join(best, lists).groupBy(*lists).agg(
        (F.count_if(place > F.col("best")) + 1).alias("first"), F.first("positives").alias("positives")
    )
    top = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*lists).orderBy(F.col("score").desc(), order)))
    found = top.where(F.col("_rank") <= max(cuts)).groupBy(*lists).agg(
        *[F.sum(F.when((F.col("_rank") <= k) & (F.col("label") == 1), 1).otherwise(0)).alias(f"_at_{k}") for k in cuts]
    )
    joined = ahead.join(found, lists)
    return joined.groupBy(*keys).agg(
        F.avg(1.0 / F.col("first")).alias("mrr"),
        *[F.avg(F.col(f"_at_{k}") / F.col("positives")).alias(f"recall_at_{k}") for k in cuts],
    )


def average_rank(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Rank from 1 of each row's value per key, ties sharing their mean rank."""
    points = df.groupBy(*keys, F.col(value)).agg(F.count(F.lit(1)).alias("_n"))
    ranked = scan(points, keys, [value], [Running("_before", "sum", F.col("_n"), inclusive=False)])
    mean = ranked.select(*keys, value, (F.col("_before") + (F.col("_n") + 1) / 2.0).alias(name))
    return df.join(mean, [*keys, value])


def regression_report(df: DataFrame, keys: Sequence[str], predicted: str = "predicted", target: str = "target") -> DataFrame:
    """MAE, RMSE, sign accuracy, Pearson and Spearman correlation."""
    error = F.col(predicted) - F.col(target)
    ranked = average_rank(average_rank(df, keys, predicted, "_rp"), keys, target, "_rt")
    return ranked.groupBy(*keys).agg(
        F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg((F.signum(predicted) == F.signum(target)).cast("double")).alias("sign_accuracy"),
        F.corr(predicted, target).alias("pearson"), F.corr("_rp", "_rt").alias("spearman"),
    )


def weighted_means(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sums over counts, added up over parts first. `sums`: keys, total, weight."""
    return sums.groupBy(*keys).agg(F.sum("total").alias("t"), F.sum("weight").alias("w")).where(F.col("w") != 0).select(
        *keys, (F.col("t") / F.col("w")).alias("mean")
    )
