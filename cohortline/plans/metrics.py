"""Evaluation metrics on prediction tables made from labels, documents and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortline.functions import numbers
from cohortline.operators import metrics_classification as mc, metrics_survival as ms
from cohortline.plans import bindings as b
from cohortline.plans.registry import query


def binary_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tasks: document quality and toxicity, scored by a function of the document's length."""
    documents = b.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    joined = b.table(spark, sf_dir, "labels").join(documents, "doc_id")
    score = (F.col("n_chars") % 37) / 37.0
    return joined.select(
        "doc_id", F.explode(F.array(
            F.struct(F.lit("quality").alias("task"), F.col("quality").alias("label"), score.alias("score")),
            F.struct(F.lit("toxic").alias("task"), F.col("toxic").alias("label"), (1.0 - score).alias("score")),
        )).alias("p"),
    ).select("doc_id", "p.*")


BINARY_SQL = """
bp AS (
  SELECT doc_id, 'quality' AS task, quality AS label, (n_chars % 37) / 37.0 AS score FROM labels JOIN documents USING (doc_id)
  UNION ALL SELECT doc_id, 'toxic', toxic, 1.0 - (n_chars % 37) / 37.0 FROM labels JOIN documents USING (doc_id)),
tot AS (SELECT task, sum(label) AS P, count(*) - sum(label) AS N FROM bp GROUP BY task),
auc AS (SELECT p.task, sum(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END) / count(*) AS auroc
  FROM bp p JOIN bp n ON p.task = n.task AND p.label = 1 AND n.label = 0 GROUP BY p.task),
cut AS (SELECT s.task, s.score, (SELECT count(*) FROM bp x WHERE x.task = s.task AND x.score >= s.score AND label = 1) AS tp,
    (SELECT count(*) FROM bp x WHERE x.task = s.task AND x.score >= s.score) AS said,
    (SELECT count(*) FROM bp x WHERE x.task = s.task AND x.score = s.score AND label = 1) AS pos
  FROM (SELECT DISTINCT task, score FROM bp) s),
ap AS (SELECT task, sum(pos / P * tp / said) AS auprc FROM cut JOIN tot USING (task) GROUP BY task),
bf AS (SELECT task, score AS best_threshold, 2.0 * tp / (P + said) AS best_f1 FROM cut JOIN tot USING (task)
  QUALIFY row_number() OVER (PARTITION BY task ORDER BY round(2.0 * tp / (P + said), 12) DESC, score) = 1)"""


@query(
    "ranking_metrics", "V1 V2 V4",
    f"""WITH {BINARY_SQL} SELECT task, round(auroc, 8) AS auroc, round(auprc, 8) AS auprc, round(best_threshold, 8) AS best_threshold,
      round(best_f1, 8) AS best_f1 FROM auc JOIN ap USING (task) JOIN bf USING (task)""",
)
def ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(mc.ranking_metrics(binary_predictions(spark, sf_dir), ["task"]))


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    return df.select(*[
        F.round(f.name, digits).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in df.schema
    ])


AT_SQL = """SELECT task, round(auroc, 8) AS auroc, round(auprc, 8) AS auprc, round(best_threshold, 8) AS best_threshold,
      round(best_f1, 8) AS best_f1, round(avg(CAST((score >= {t}) = (label = 1) AS DOUBLE)), 8) AS accuracy,
      round(coalesce(2.0 * count_if(score >= {t} AND label = 1) / nullif(count_if(score >= {t}) + count_if(label = 1), 0), 0), 8) AS f1,
      round(coalesce(1.0 * count_if(score >= {t} AND label = 1) / nullif(count_if(label = 1), 0), 0), 8) AS recall,
      round({t}, 8) AS threshold
    FROM bp JOIN auc USING (task) JOIN ap USING (task) JOIN bf USING (task) GROUP BY task, auroc, auprc, best_threshold, best_f1"""


@query("binary_report", "V1 V2 V3", f"WITH {BINARY_SQL} " + AT_SQL.format(t="0.5::DOUBLE"))
def binary_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(mc.binary_report(binary_predictions(spark, sf_dir), ["task"]))


@query("binary_report_best_threshold", "V3 V4", f"WITH {BINARY_SQL} " + AT_SQL.format(t="best_threshold"))
def binary_report_best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(mc.binary_report(binary_predictions(spark, sf_dir), ["task"], threshold=None))


def class_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order priority as the class, scores from softmax of a function of the order."""
    key = F.col("o_orderkey")
    logits = F.array(*[((key * (i + 3) + i) % 17).cast("double") / 4 for i in range(5)])
    return b.table(spark, sf_dir, "orders").select(
        F.lit("priority").alias("task"), (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("label"),
        numbers.softmax(logits).alias("scores"), logits.alias("logits"),
    )


CLASS_SQL = """
o5 AS (SELECT o_orderkey AS k, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS label,
  [((o_orderkey * 3) % 17) / 4.0, ((o_orderkey * 4 + 1) % 17) / 4.0, ((o_orderkey * 5 + 2) % 17) / 4.0,
   ((o_orderkey * 6 + 3) % 17) / 4.0, ((o_orderkey * 7 + 4) % 17) / 4.0] AS z FROM orders),
pr AS (SELECT k, label, list_position(z, list_max(z)) - 1 AS predicted, z FROM o5)"""


@query(
    "multiclass_report", "V3 F27",
    f"""WITH {CLASS_SQL}, c AS (SELECT i AS class, count_if(label = i) AS s, count_if(predicted = i) AS p, count_if(label = i AND predicted = i) AS h
      FROM pr, range(5) r(i) GROUP BY i)
    SELECT 'priority' AS task, round(sum(h) / sum(s), 8) AS accuracy, round(avg(CASE WHEN s + p > 0 THEN 2.0 * h / (s + p) ELSE 0 END), 8) AS macro_f1,
      round(avg(CASE WHEN s > 0 THEN 1.0 * h / s ELSE 0 END), 8) AS macro_recall FROM c""",
)
def multiclass_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = class_predictions(spark, sf_dir).withColumn(
        "predicted", (F.array_position("logits", F.array_max("logits")) - 1).cast("int")
    )
    return rounded(mc.multiclass_report(rows, ["task"]))


@query(
    "multiclass_ranking", "V1 V2 F27",
    f"""WITH {CLASS_SQL}, s AS (SELECT k, i AS class, label = i AS hit, round(exp(z[i + 1]) / list_sum(list_transform(z, lambda x: exp(x))), 9) AS score
      FROM o5, range(5) r(i)),
    g AS (SELECT class, score, count_if(hit) AS pos, count_if(NOT hit) AS neg FROM s GROUP BY ALL),
    c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY class) AS P, sum(neg) OVER (PARTITION BY class) AS N
      FROM g WINDOW w AS (PARTITION BY class ORDER BY score DESC)),
    m AS (SELECT class, sum(pos * (N - fp + neg / 2.0)) / (any_value(P) * any_value(N)) AS auroc, sum(pos / P * tp / (tp + fp)) AS auprc FROM c GROUP BY class)
    SELECT 'priority' AS task, round(avg(auroc), 6) AS auroc_ovr, round(avg(auprc), 6) AS auprc_macro FROM m""",
)
def multiclass_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    # scores are rounded so that ties are the same in any engine
    rows = class_predictions(spark, sf_dir).withColumn("scores", F.transform("scores", lambda x: F.round(x, 9)))
    return rounded(mc.multiclass_ranking(rows, ["task"], "scores"), 6)


def label_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    labels = F.array(*[(key % (i + 2) == 0).cast("int") for i in range(3)], F.lit(0))
    scores = F.array(*[((key * (2 * i + 3)) % 23) / 23.0 for i in range(4)])
    return b.table(spark, sf_dir, "orders").select(F.lit("vector").alias("task"), labels.alias("labels"), scores.alias("scores"))


@query(
    "multilabel_report", "V1 V2 V3 L22",
    """WITH s AS (SELECT i AS class, CASE WHEN i < 3 THEN CAST(o_orderkey % (i + 2) = 0 AS INTEGER) ELSE 0 END AS label,
        ((o_orderkey * (2 * i + 3)) % 23) / 23.0 AS score FROM orders, range(4) r(i)),
    x AS (SELECT -1 AS class, label, score FROM s UNION ALL SELECT class, label, score FROM s),
    g AS (SELECT class, score, count_if(label = 1) AS pos, count_if(label = 0) AS neg FROM x GROUP BY ALL),
    c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY class) AS P, sum(neg) OVER (PARTITION BY class) AS N
      FROM g WINDOW w AS (PARTITION BY class ORDER BY score DESC)),
    m AS (SELECT class, sum(pos * (N - fp + neg / 2.0)) / (any_value(P) * any_value(N)) AS auroc, sum(pos / P * tp / (tp + fp)) AS auprc
      FROM c WHERE P > 0 AND N > 0 GROUP BY class),
    f AS (SELECT class, 2.0 * count_if(score >= 0.5 AND label = 1) / (count_if(score >= 0.5) + count_if(label = 1)) AS f1 FROM x GROUP BY class)
    SELECT 'vector' AS task, (SELECT round(auroc, 8) FROM m WHERE class = -1) AS micro_auroc, (SELECT round(auprc, 8) FROM m WHERE class = -1) AS micro_auprc,
      (SELECT round(avg(auroc), 8) FROM m WHERE class >= 0) AS macro_auroc, (SELECT round(avg(auprc), 8) FROM m WHERE class >= 0) AS macro_auprc,
      (SELECT round(f1, 8) FROM f WHERE class = -1) AS micro_f1, (SELECT round(avg(f1), 8) FROM f WHERE class >= 0) AS macro_f1""",
)
def multilabel_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(mc.multilabel_report(label_vectors(spark, sf_dir), ["task"], "labels", "scores"))


@query(
    "candidate_ranking", "V5",
    """WITH c AS (SELECT l_orderkey AS q, l_returnflag = 'A' AS label, l_quantity AS score,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i FROM lineitem),
    r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, i) AS rk FROM c),
    m AS (SELECT q, 1.0 / min(rk) FILTER (label) AS rr, count_if(label AND rk <= 1) / count_if(label) AS r1,
        count_if(label AND rk <= 5) / count_if(label) AS r5, count_if(label AND rk <= 10) / count_if(label) AS r10
      FROM r GROUP BY q HAVING count_if(label) > 0)
    SELECT 'flag' AS task, round(avg(rr), 8) AS mrr, round(avg(r1), 8) AS recall_at_1, round(avg(r5), 8) AS recall_at_5,
      round(avg(r10), 8) AS recall_at_10 FROM m""",
)
def candidate_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.col("l_linenumber").cast("bigint") * F.lit(10**14) + F.col("l_partkey") * F.lit(10**7) + F.col("l_suppkey")
    rows = b.table(spark, sf_dir, "lineitem").select(
        F.lit("flag").alias("task"), F.col("l_orderkey").alias("list"), (F.col("l_returnflag") == "A").cast("int").alias("label"),
        F.col("l_quantity").alias("score"), order.alias("i"),
    )
    return rounded(mc.candidate_ranking(rows, ["task"], "list", "i"))


@query(
    "regression_report", "V6",
    """WITH p AS (SELECT l_returnflag AS task, l_quantity - 25 AS predicted, l_discount * 500 - 25 AS target FROM lineitem),
    r AS (SELECT *, rank() OVER (PARTITION BY task ORDER BY predicted) + (count(*) OVER (PARTITION BY task, predicted) - 1) / 2.0 AS rp,
        rank() OVER (PARTITION BY task ORDER BY target) + (count(*) OVER (PARTITION BY task, target) - 1) / 2.0 AS rt FROM p)
    SELECT task, round(avg(abs(predicted - target)), 6) AS mae, round(sqrt(avg((predicted - target) ** 2)), 6) AS rmse,
      round(avg(CAST(sign(predicted) = sign(target) AS DOUBLE)), 6) AS sign_accuracy, round(corr(predicted, target), 6) AS pearson,
      round(corr(rp, rt), 6) AS spearman FROM r GROUP BY task""",
)
def regression_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("task"), (F.col("l_quantity") - 25).alias("predicted"), (F.col("l_discount") * 500 - 25).alias("target")
    )
    return rounded(mc.regression_report(rows, ["task"]), 6)


@query(
    "weighted_scalar_means", "V6",
    "SELECT l_shipmode AS name, round(t / w, 6) AS mean FROM (SELECT l_linestatus AS l_shipmode, sum(l_extendedprice) AS t, sum(l_quantity) AS w FROM lineitem GROUP BY 1)",
)
def weighted_scalar_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = b.table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("name"), "l_returnflag").agg(
        F.sum("l_extendedprice").alias("total"), F.sum("l_quantity").alias("weight")
    )
    return rounded(mc.weighted_means(parts, ["name"]), 6)


@query(
    "class_weight", "A21",
    "SELECT round(count_if(quality = 0) / count_if(quality = 1), 8) AS pos_weight FROM labels",
)
def class_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortline.operators.splits import class_weight as weight

    return rounded(weight(b.table(spark, sf_dir, "labels"), "quality"))


BINS = 20


def survival_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as survival predictions in three stages: time, event and hazards of unit bins."""
    key = F.col("o_orderkey")
    hazards = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: ((key * 7 + i * 3) % 11) / 90.0 + (key % 5) / 100.0)
    return b.table(spark, sf_dir, "orders").select(
        key.alias("row_id"), (key % 3).cast("int").alias("stage"),
        (F.lit(0.25) + (key * 13 + F.col("o_custkey")) % 77 / 4.0).alias("time"),
        (F.col("o_orderstatus") != "O").cast("int").alias("event"), hazards.alias("hazards"),
    )


def train_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference rows of another key pattern."""
    key = F.col("o_orderkey")
    return b.table(spark, sf_dir, "orders").select(
        (key % 3).cast("int").alias("stage"), (F.lit(0.5) + (key * 11 + F.col("o_custkey") * 3) % 79 / 4.0).alias("time"),
        (F.col("o_orderstatus") == "F").cast("int").alias("event"),
    )


SURVIVAL_SQL = f"""
sv AS MATERIALIZED (SELECT o_orderkey AS row_id, CAST(o_orderkey % 3 AS INTEGER) AS stage, 0.25 + (o_orderkey * 13 + o_custkey) % 77 / 4.0 AS time,
    o_orderstatus <> 'O' AS event, list_transform(range({BINS}), lambda i: ((o_orderkey * 7 + i * 3) % 11) / 90.0 + (o_orderkey % 5) / 100.0) AS hz FROM orders),
tr AS MATERIALIZED (SELECT CAST(o_orderkey % 3 AS INTEGER) AS stage, 0.5 + (o_orderkey * 11 + o_custkey * 3) % 79 / 4.0 AS time, o_orderstatus = 'F' AS event FROM orders)"""

# at most ~80 distinct times per stage, so the curves are plain products over earlier steps
CURVES_SQL = """
kt AS MATERIALIZED (SELECT stage, time, count(*) AS n, count_if(event) AS d FROM sv GROUP BY ALL),
km AS MATERIALIZED (SELECT stage, time, d AS events, n, CAST(sum(n) OVER (PARTITION BY stage ORDER BY time DESC) AS BIGINT) AS at_risk FROM kt),
kms AS MATERIALIZED (SELECT a.stage, a.time, any_value(a.at_risk) AS at_risk, CAST(any_value(a.events) AS BIGINT) AS events, product(1.0 - x.events / x.at_risk) AS s
  FROM km a JOIN km x ON x.stage = a.stage AND x.time <= a.time GROUP BY a.stage, a.time),
ct AS MATERIALIZED (SELECT stage, time, count(*) AS n, count_if(event) AS d FROM tr GROUP BY ALL),
cm AS MATERIALIZED (SELECT *, sum(n) OVER (PARTITION BY stage ORDER BY time DESC) - d AS at_risk FROM ct),
cs AS MATERIALIZED (SELECT a.stage, a.time, product(CASE WHEN x.at_risk > 0 THEN 1.0 - (x.n - x.d) / x.at_risk ELSE 1.0 END) AS s
  FROM cm a JOIN cm x ON x.stage = a.stage AND x.time <= a.time GROUP BY a.stage, a.time)"""


@query(
    "kaplan_meier", "V8",
    f"WITH {SURVIVAL_SQL}, {CURVES_SQL} SELECT stage, time, at_risk, events, round(s, 8) AS survival FROM kms",
)
def kaplan_meier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ms.km_curve(survival_rows(spark, sf_dir), ["stage"]).select("stage", "time", "at_risk", "events", "survival"))


@query("censoring_survival", "V9", f"WITH {SURVIVAL_SQL}, {CURVES_SQL} SELECT stage, time, round(s, 8) AS survival FROM cs")
def censoring_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ms.censoring_curve(train_rows(spark, sf_dir), ["stage"]).select("stage", "time", "survival"))


@query(
    "hazard_functions", "V13",
    f"""WITH {SURVIVAL_SQL}, q AS (SELECT row_id, time, list_sum(list_transform(range({BINS}), lambda i: hz[i + 1] * least(greatest(time - i, 0), 1))) AS h,
      list_sum(list_transform(range({BINS}), lambda i: hz[i + 1] * least(greatest(9.5 - i, 0), 1))) AS h9,
      list_sum(list_transform(range({BINS}), lambda i: hz[i + 1] * least(greatest(2.25 - i, 0), 1))) AS h2 FROM sv)
    SELECT row_id, round(1.0 - exp(-h), 8) AS risk, round((h9 - h2) / 7.25, 8) AS mean_hazard FROM q""",
)
def hazard_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = survival_rows(spark, sf_dir)
    return rounded(rows.select(
        "row_id", ms.risk_at(F.col("hazards"), F.col("time")).alias("risk"),
        ms.mean_hazard(F.col("hazards"), F.lit(2.25), F.lit(9.5)).alias("mean_hazard"),
    ))


CONCORDANCE_SQL = """
pr AS MATERIALIZED (SELECT stage, time, event, round(list_sum(hz), 10) AS risk FROM sv),
gr AS MATERIALIZED (SELECT stage, time, event, risk, count(*) AS w FROM pr GROUP BY ALL)"""


@query(
    "concordance_index", "V7",
    f"""WITH {SURVIVAL_SQL}, {CONCORDANCE_SQL} SELECT i.stage, CAST(sum(CASE WHEN i.risk - j.risk > 1e-8 THEN i.w * j.w ELSE 0 END) AS BIGINT) AS concordant,
      CAST(sum(CASE WHEN abs(i.risk - j.risk) <= 1e-8 THEN i.w * j.w ELSE 0 END) AS BIGINT) AS tied, CAST(sum(i.w * j.w) AS BIGINT) AS comparable,
      round(sum(CASE WHEN i.risk - j.risk > 1e-8 THEN i.w * j.w WHEN abs(i.risk - j.risk) <= 1e-8 THEN 0.5 * i.w * j.w ELSE 0 END) / sum(i.w * j.w), 8) AS c_index
    FROM gr i JOIN gr j ON i.stage = j.stage AND i.event AND (j.time > i.time OR (j.time = i.time AND NOT j.event)) GROUP BY i.stage""",
)
def concordance_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ms.concordance(ranked_risks(spark, sf_dir), ["stage"]))


def ranked_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.aggregate("hazards", F.lit(0.0), lambda a, x: a + x)
    return survival_rows(spark, sf_dir).withColumn("risk", F.round(total, 10))


@query(
    "concordance_index_strict", "V7",
    f"""WITH {SURVIVAL_SQL}, {CONCORDANCE_SQL} SELECT i.stage, CAST(sum(CASE WHEN i.risk > j.risk THEN i.w * j.w ELSE 0 END) AS BIGINT) AS concordant,
      CAST(sum(CASE WHEN i.risk = j.risk THEN i.w * j.w ELSE 0 END) AS BIGINT) AS tied, CAST(sum(i.w * j.w) AS BIGINT) AS comparable,
      round(sum(CASE WHEN i.risk > j.risk THEN i.w * j.w WHEN i.risk = j.risk THEN 0.5 * i.w * j.w ELSE 0 END) / sum(i.w * j.w), 8) AS c_index
    FROM gr i JOIN gr j ON i.stage = j.stage AND i.event AND j.time > i.time GROUP BY i.stage""",
)
def concordance_index_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ms.concordance(ranked_risks(spark, sf_dir), ["stage"], strict=True))


GRID = 8
GRID_SQL = f"""
ev AS MATERIALIZED (SELECT stage, quantile_cont(time, 0.1) AS a, quantile_cont(time, 0.9) AS z, quantile_cont(time, 0.5) AS m FROM sv WHERE event AND time > 0 GROUP BY stage),
g0 AS MATERIALIZED (SELECT stage, CAST(i AS INTEGER) AS grid, a + i * ((z - a) / {GRID - 1}.0) AS t, m FROM ev, range({GRID}) r(i)),
gd AS MATERIALIZED (SELECT g0.* FROM g0 JOIN (SELECT stage, max(time) AS e FROM sv GROUP BY 1) USING (stage) JOIN (SELECT stage, max(time) AS f FROM tr GROUP BY 1) USING (stage)
  WHERE t < least(e, f))"""


@query(
    "evaluation_grid", "V14",
    f"WITH {SURVIVAL_SQL}, {GRID_SQL} SELECT stage, grid, round(t, 8) AS grid_time, round(m, 8) AS median_time FROM gd",
)
def evaluation_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = survival_rows(spark, sf_dir)
    grid = ms.evaluation_grid(rows, ["stage"], GRID)
    return rounded(ms.usable_grid(grid, train_rows(spark, sf_dir), rows, ["stage"]))


AUC_SQL = f"""
wt AS MATERIALIZED (SELECT sv.*, coalesce((SELECT arg_max(s, cs.time) FROM cs WHERE cs.stage = sv.stage AND cs.time <= sv.time), 1.0) AS g FROM sv),
rk AS MATERIALIZED (SELECT wt.stage, grid, t, time, event, g, 1.0 - exp(-list_sum(list_transform(range({BINS}), lambda i: hz[i + 1] * least(greatest(t - i, 0), 1)))) AS risk
  FROM wt JOIN gd ON gd.stage = wt.stage),
ca AS MATERIALIZED (SELECT stage, grid, risk, sum(1.0 / g) AS w FROM rk WHERE event AND g > 0 AND time <= t GROUP BY ALL),
co AS MATERIALIZED (SELECT stage, grid, risk, count(*) AS n FROM rk WHERE time > t GROUP BY ALL),
au AS MATERIALIZED (SELECT ca.stage, ca.grid, sum(CASE WHEN ca.risk - co.risk > 1e-8 THEN w * n WHEN abs(ca.risk - co.risk) <= 1e-8 THEN 0.5 * w * n ELSE 0 END) / sum(w * n) AS auc
  FROM ca JOIN co ON ca.stage = co.stage AND ca.grid = co.grid GROUP BY ALL),
as2 AS (SELECT au.*, t, coalesce((SELECT arg_max(s, kms.time) FROM kms WHERE kms.stage = au.stage AND kms.time <= t), 1.0) AS s FROM au JOIN gd USING (stage, grid)),
as3 AS (SELECT *, coalesce(lag(s) OVER (PARTITION BY stage ORDER BY grid), 1.0) - s AS dr FROM as2),
tdc AS (SELECT stage, sum(auc * dr) / (1.0 - min(s)) AS time_dependent_c FROM as3 GROUP BY stage)"""


@query(
    "cumulative_auc", "V10",
    f"WITH {SURVIVAL_SQL}, {CURVES_SQL}, {GRID_SQL}, {AUC_SQL} SELECT stage, grid, round(auc, 7) AS auc FROM au",
)
def cumulative_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, train = survival_rows(spark, sf_dir), train_rows(spark, sf_dir)
    grid = ms.usable_grid(ms.evaluation_grid(rows, ["stage"], GRID), train, rows, ["stage"])
    per_time, _ = ms.cumulative_auc(rows, train, grid, ["stage"])
    return rounded(per_time.select("stage", "grid", "auc"), 7)


BRIER_SQL = f"""
bs AS (SELECT stage, grid, any_value(t) AS t, avg(CASE WHEN time <= t AND event AND g > 0 THEN (1.0 - risk) ** 2 / g ELSE 0 END
    + CASE WHEN time > t AND gt > 0 THEN risk ** 2 / gt ELSE 0 END) AS score
  FROM rk JOIN (SELECT stage, grid, coalesce((SELECT arg_max(s, cs.time) FROM cs WHERE cs.stage = gd.stage AND cs.time <= gd.t), 1.0) AS gt FROM gd) USING (stage, grid)
  GROUP BY stage, grid),
bl AS (SELECT *, lag(t) OVER w AS pt, lag(score) OVER w AS ps FROM bs WINDOW w AS (PARTITION BY stage ORDER BY grid)),
ibs AS (SELECT stage, sum((t - pt) * (score + ps) / 2) / (max(t) - min(t)) AS ibs FROM bl GROUP BY stage)"""


@query(
    "integrated_brier", "V11",
    f"WITH {SURVIVAL_SQL}, {CURVES_SQL}, {GRID_SQL}, {AUC_SQL}, {BRIER_SQL} SELECT stage, round(ibs, 7) AS ibs FROM ibs",
)
def integrated_brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, train = survival_rows(spark, sf_dir), train_rows(spark, sf_dir)
    grid = ms.usable_grid(ms.evaluation_grid(rows, ["stage"], GRID), train, rows, ["stage"])
    return rounded(ms.integrated_brier(rows, train, grid, ["stage"]), 7)


@query(
    "daily_brier", "V11",
    f"""WITH {SURVIVAL_SQL},
    c0 AS MATERIALIZED (SELECT stage, time, count_if(NOT event) AS c, (SELECT count(*) FROM sv x WHERE x.stage = s.stage AND x.time >= s.time) AS n
      FROM sv s GROUP BY stage, time HAVING count_if(NOT event) > 0),
    gg AS MATERIALIZED (SELECT a.stage, a.time, product(1.0 - x.c / x.n) AS s FROM c0 a JOIN c0 x ON x.stage = a.stage AND x.time <= a.time GROUP BY ALL),
    r AS (SELECT sv.*, CAST(d AS DOUBLE) AS d, greatest(coalesce((SELECT arg_max(s, gg.time) FROM gg WHERE gg.stage = sv.stage AND gg.time < sv.time), 1.0), 1e-6) AS gb
      FROM sv, range(1, 11) t(d)),
    q AS (SELECT DISTINCT stage, CAST(d AS DOUBLE) AS d FROM sv, range(1, 11) t(d)),
    gq AS (SELECT q.*, greatest(coalesce((SELECT arg_max(s, gg.time) FROM gg WHERE gg.stage = q.stage AND gg.time <= q.d), 1.0), 1e-6) AS ga FROM q),
    e AS (SELECT stage, d, avg(CASE WHEN time > d THEN (1.0 - exp(-list_sum(hz[1:CAST(d AS INTEGER)]))) ** 2 / ga
        WHEN event THEN exp(-list_sum(hz[1:CAST(d AS INTEGER)])) ** 2 / gb ELSE 0 END) AS s FROM r JOIN gq USING (stage, d) GROUP BY ALL)
    SELECT stage, round(avg(s), 7) AS ibs_daily FROM e GROUP BY stage""",
)
def daily_brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ms.daily_brier(survival_rows(spark, sf_dir), ["stage"], 10), 7)


CALIBRATION_SQL = f"""
pd AS MATERIALIZED (SELECT sv.*, m, greatest(least(exp(-list_sum(list_transform(range({BINS}), lambda i: hz[i + 1] * least(greatest(m - i, 0), 1)))), 1.0 - 1e-6), 1e-6) AS p0
  FROM sv JOIN ev USING (stage)),
pb AS MATERIALIZED (SELECT *, ntile(10) OVER (PARTITION BY stage ORDER BY round(p0, 10), row_id) AS bin, round(p0, 10) AS p FROM pd),
bt AS MATERIALIZED (SELECT stage, bin, time, count(*) AS n, count_if(event) AS d, any_value(m) AS m FROM pb GROUP BY stage, bin, time),
br AS MATERIALIZED (SELECT *, sum(n) OVER (PARTITION BY stage, bin ORDER BY time DESC) AS at_risk FROM bt),
ob AS (SELECT stage, bin, coalesce(product(1.0 - d / at_risk) FILTER (time <= m), 1.0) AS o, max(time) AS l, sum(CASE WHEN time <= m THEN d ELSE 0 END) AS e, any_value(m) AS m
  FROM br GROUP BY stage, bin),
mn AS (SELECT stage, bin, avg(p) AS p FROM pb GROUP BY stage, bin),
nd AS (SELECT stage, sum((o - p) ** 2 / (p * (1 - p))) AS nd_calibration, count(*) AS nd_bins FROM ob JOIN mn USING (stage, bin) WHERE l >= m OR e > 0 GROUP BY stage)"""


def predicted_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = survival_rows(spark, sf_dir)
    events = rows.where("event = 1 AND time > 0")
    median = ms.exact_percentiles(events, ["stage"], "time", (0.5,)).withColumnRenamed("p0", "at")
    # rounded so that the order of equal predictions does not hang on the last bit
    return rows.join(median, "stage").withColumn("predicted", F.round(1.0 - ms.risk_at(F.col("hazards"), F.col("at")), 10))


@query(
    "calibration", "V12",
    f"WITH {SURVIVAL_SQL}, {GRID_SQL}, {CALIBRATION_SQL} SELECT stage, round(nd_calibration, 7) AS nd_calibration, nd_bins FROM nd",
)
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ms.calibration(predicted_survival(spark, sf_dir), ["stage"], "row_id"), 7)


@query(
    "stage_report", "V15 V7 V10 V11 V14",
    f"""WITH {SURVIVAL_SQL}, {CURVES_SQL}, {GRID_SQL}, {AUC_SQL}, {BRIER_SQL}
    SELECT stage, samples_total, events_total, round(time_dependent_c, 7) AS time_dependent_c, round(ibs, 7) AS ibs
    FROM tdc JOIN ibs USING (stage) JOIN (SELECT stage, count(*) AS samples_total, count_if(event)::BIGINT AS events_total FROM sv GROUP BY stage) USING (stage)""",
)
def stage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = ms.stage_report(survival_rows(spark, sf_dir), train_rows(spark, sf_dir), "stage", "row_id", GRID)
    return rounded(report.select("stage", "samples_total", "events_total", "time_dependent_c", "ibs"), 7)


@query(
    "stage_report_mean", "V15 V7 V10 V11 V12",
    f"""WITH {SURVIVAL_SQL}, {CURVES_SQL}, {GRID_SQL}, {AUC_SQL}, {BRIER_SQL}, {CALIBRATION_SQL},
    ge AS (SELECT stage, min(t) AS a, max(t) AS z FROM gd GROUP BY stage),
    hr AS MATERIALIZED (SELECT stage, time, event, list_sum(list_transform(range({BINS}), lambda i: hz[i + 1] * (least(greatest(z - i, 0), 1) - least(greatest(a - i, 0), 1)))) / (z - a) AS risk
      FROM sv JOIN ge USING (stage)),
    hg AS MATERIALIZED (SELECT stage, time, event, round(risk, 10) AS risk, count(*) AS w FROM hr GROUP BY ALL),
    hc AS (SELECT i.stage, sum(CASE WHEN i.risk - j.risk > 1e-8 THEN i.w * j.w WHEN abs(i.risk - j.risk) <= 1e-8 THEN 0.5 * i.w * j.w ELSE 0 END) / sum(i.w * j.w) AS harrell_c_index
      FROM hg i JOIN hg j ON i.stage = j.stage AND i.event AND (j.time > i.time OR (j.time = i.time AND NOT j.event)) GROUP BY i.stage)
    SELECT round(avg(time_dependent_c), 7) AS time_dependent_c, round(avg(harrell_c_index), 7) AS harrell_c_index, round(avg(nd_calibration), 7) AS nd_calibration, round(avg(ibs), 7) AS ibs
    FROM tdc JOIN hc USING (stage) JOIN nd USING (stage) JOIN ibs USING (stage)""",
)
def stage_report_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over stages of all metrics, concordance and calibration included."""
    report = ms.stage_report(survival_rows(spark, sf_dir), train_rows(spark, sf_dir), "stage", "row_id", GRID)
    return rounded(ms.mean_over_stages(report), 7)
