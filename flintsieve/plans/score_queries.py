"""Queries over model scores, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flintsieve.operators import ensemble, metrics
from flintsieve.plans import adapters

MODELS = ["rf", "xgb", "dt", "lr"]
CUTS = {"p_rf": 0.5, "p_xgb": 0.45, "p_dt": 0.55, "p_lr": 0.4}
SCORED = f"scores AS ({adapters.SCORES})"
THRESHOLDS = "thresholds AS (SELECT unnest([" + ", ".join(f"CAST({t!r} AS DOUBLE)" for t in metrics.THRESHOLDS) + "]) AS threshold)"
RATIO = lambda a, b: f"CASE WHEN {b} > 0 THEN ({a}) / ({b}) ELSE 0.0 END"
MEASURES = {
    "accuracy": RATIO("tp + tn", "tp + fp + fn + tn"), "balanced_accuracy": f"({RATIO('tp', 'tp + fn')} + {RATIO('tn', 'tn + fp')}) / 2", "precision": RATIO("tp", "tp + fp"), "recall": RATIO("tp", "tp + fn"),
    "f1": RATIO("2 * tp", "2 * tp + fp + fn"), "macro_f1": f"({RATIO('2 * tp', '2 * tp + fp + fn')} + {RATIO('2 * tn', '2 * tn + fp + fn')}) / 2",
}
COUNTED = """SELECT threshold, count(*) FILTER (p >= threshold AND y = 1) AS tp, count(*) FILTER (p >= threshold AND y = 0) AS fp, count(*) FILTER (p < threshold AND y = 1) AS fn, count(*) FILTER (p < threshold AND y = 0) AS tn"""
COUNTS = f"counts AS ({COUNTED} FROM (SELECT y, p_rf AS p FROM scores) CROSS JOIN thresholds GROUP BY threshold)"
MEASURED = "measured AS (SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in MEASURES.items()) + " FROM counts)"
SIX = list(MEASURES)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else c for c, t in df.dtypes])


def _rf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.scores(spark, sf_dir).select("y", F.col("p_rf").alias("p"))


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.with_metrics(metrics.threshold_counts(_rf(spark, sf_dir), []))


def threshold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_measured(spark, sf_dir))


def threshold_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.best_threshold(_measured(spark, sf_dir), []).drop("ok"))


def threshold_best_recall_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.best_threshold(_measured(spark, sf_dir), [], 0.95).drop("ok"))


def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.roc_auc(_rf(spark, sf_dir)))


def avg_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.average_precision(_rf(spark, sf_dir)))


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    on = F.col("p_rf") >= 0.5
    return adapters.scores(spark, sf_dir).agg(*[F.count_if(c).alias(k) for k, c in {"tp": on & (F.col("y") == 1), "fp": on & (F.col("y") == 0), "fn": ~on & (F.col("y") == 1), "tn": ~on & (F.col("y") == 0)}.items()])


def cross_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.cross_errors(adapters.scores(spark, sf_dir), CUTS)


def weight_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ensemble.weight_grid(spark, MODELS, most={"lr": 0.1}).drop("grid")


def weighted_vote_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = ["rf", "dt"]
    best = ensemble.best_vote(adapters.scores(spark, sf_dir), ensemble.weight_grid(spark, models), models, floor=0.95)
    return _rounded(best.select("w_rf", "w_dt", "threshold", "tp", "fp", "fn", "tn", "f1", "recall"))


def meta_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ensemble.meta_features(adapters.scores(spark, sf_dir).withColumn("risk", F.col("p_rf") * 10 - 5), MODELS, ["risk"])
    # Rows have no key of their own, so that sums are compared.
    return df.groupBy("grp").agg(*[F.round(F.sum(c), 5).alias(c) for c in df.columns if c.startswith(("u_", "diff_", "absdiff_", "slog_"))])


def pair_gate_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = adapters.scores(spark, sf_dir)
    rows = F.array(*[F.struct(F.lit(lo).alias("w_min"), F.lit(hi).alias("w_max"), ensemble.gated(F.col("p_rf"), F.col("p_xgb"), F.col("p_lr"), lo, hi).alias("p")) for lo, hi in ensemble.GATE_BOUNDS])
    return df.select("y", F.inline(rows)).groupBy("w_min", "w_max", "y").agg(F.round(F.sum("p"), 4).alias("sum_p"), F.count("*").alias("n"))


def softmax_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.scores(spark, sf_dir).groupBy(ensemble.closest_model(["rf", "xgb", "dt"]).cast("long").alias("target")).agg(F.count("*").alias("n"), F.sum("y").cast("long").alias("n_pos"))


QUERIES = {f.__name__: f for f in (threshold_metrics, threshold_best, threshold_best_recall_floor, roc_auc, avg_precision, confusion, cross_error, weight_grid, weighted_vote_best, meta_matrix, pair_gate_apply, softmax_target)}
_ROUND = ", ".join(f"round({k}, 9) AS {k}" for k in SIX)
_BEST = f"SELECT round(threshold, 9) AS threshold, tp, fp, fn, tn, {_ROUND} FROM measured ORDER BY {{}} f1 DESC, recall DESC, fp, precision DESC, threshold LIMIT 1"
_UNPIVOT = " UNION ALL ".join(
    f"SELECT '{a}' AS base_model, '{b}' AS helper_model, count(*) FILTER (y = 1 AND {a} < {CUTS[a]}) AS base_fn, count(*) FILTER (y = 1 AND {a} < {CUTS[a]} AND {b} >= {CUTS[b]}) AS fn_fixed, count(*) FILTER (y = 1 AND {a} < {CUTS[a]} AND {b} < {CUTS[b]}) AS both_fn,"
    f" count(*) FILTER (y = 0 AND {a} >= {CUTS[a]}) AS base_fp, count(*) FILTER (y = 0 AND {a} >= {CUTS[a]} AND {b} < {CUTS[b]}) AS fp_fixed, count(*) FILTER (y = 0 AND {a} >= {CUTS[a]} AND {b} >= {CUTS[b]}) AS both_fp FROM scores"
    for a in CUTS for b in CUTS if a != b)
_PAIRS = [(a, b) for i, a in enumerate(MODELS) for b in MODELS[i + 1 :]]
_META = ", ".join([f"round(sum(1 - 2 * abs(p_{m} - 0.5)), 5) AS u_{m}" for m in MODELS] + [f"round(sum(p_{a} - p_{b}), 5) AS diff_{a}_{b}, round(sum(abs(p_{a} - p_{b})), 5) AS absdiff_{a}_{b}" for a, b in _PAIRS] + ["round(sum(sign(p_rf * 10 - 5) * ln(1 + abs(p_rf * 10 - 5))), 5) AS slog_risk"])
SQL = {
    "threshold_metrics": f"WITH {SCORED}, {THRESHOLDS}, {COUNTS}, {MEASURED} SELECT round(threshold, 9) AS threshold, tp, fp, fn, tn, {_ROUND} FROM measured",
    "threshold_best": f"WITH {SCORED}, {THRESHOLDS}, {COUNTS}, {MEASURED} {_BEST.format('')}",
    "threshold_best_recall_floor": f"WITH {SCORED}, {THRESHOLDS}, {COUNTS}, {MEASURED} {_BEST.format('recall >= 0.95 DESC,')}",
    "roc_auc": f"""WITH {SCORED}, ranked AS (SELECT y, rank() OVER (ORDER BY p_rf) + (count(*) OVER (PARTITION BY p_rf) - 1) / 2 AS r FROM scores)
SELECT round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 9) AS roc_auc FROM ranked""",
    "avg_precision": f"""WITH {SCORED}, each AS (SELECT p_rf AS p, count(*) FILTER (y = 1) AS pos, count(*) AS n FROM scores GROUP BY p_rf),
run AS (SELECT pos, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(n) OVER (ORDER BY p DESC) AS seen, sum(pos) OVER () AS total FROM each) SELECT round(sum(pos / total * tp / seen), 9) AS average_precision FROM run""",
    "confusion": f"WITH {SCORED} SELECT count(*) FILTER (p_rf >= 0.5 AND y = 1) AS tp, count(*) FILTER (p_rf >= 0.5 AND y = 0) AS fp, count(*) FILTER (p_rf < 0.5 AND y = 1) AS fn, count(*) FILTER (p_rf < 0.5 AND y = 0) AS tn FROM scores",
    "cross_error": f"WITH {SCORED} {_UNPIVOT}",
    "weight_grid": "SELECT a / 20 AS w_rf, b / 20 AS w_xgb, c / 20 AS w_dt, (20 - a - b - c) / 20 AS w_lr FROM range(21) x(a), range(21) y(b), range(21) z(c) WHERE 20 - a - b - c BETWEEN 0 AND 2",
    "weighted_vote_best": f"""WITH {SCORED}, {THRESHOLDS}, grid AS (SELECT a / 20 AS w_rf, (20 - a) / 20 AS w_dt FROM range(21) x(a)),
voted AS (SELECT w_rf, w_dt, y, round(w_rf * p_rf + w_dt * p_dt, 9) AS p FROM scores CROSS JOIN grid),
grouped AS (SELECT w_rf, w_dt, p, count(*) FILTER (y = 1) AS a, count(*) FILTER (y = 0) AS b FROM voted GROUP BY ALL),
counts AS (SELECT w_rf, w_dt, threshold, sum(a) FILTER (p >= threshold) AS tp, sum(b) FILTER (p >= threshold) AS fp, sum(a) FILTER (p < threshold) AS fn, sum(b) FILTER (p < threshold) AS tn FROM grouped CROSS JOIN thresholds GROUP BY ALL),
filled AS (SELECT w_rf, w_dt, threshold, CAST(coalesce(tp, 0) AS BIGINT) AS tp, CAST(coalesce(fp, 0) AS BIGINT) AS fp, CAST(coalesce(fn, 0) AS BIGINT) AS fn, CAST(coalesce(tn, 0) AS BIGINT) AS tn FROM counts),
measured AS (SELECT *, {", ".join(f"{v} AS {k}" for k, v in MEASURES.items())} FROM filled)
SELECT w_rf, w_dt, round(threshold, 9) AS threshold, tp, fp, fn, tn, round(f1, 9) AS f1, round(recall, 9) AS recall FROM measured ORDER BY recall >= 0.95 DESC, f1 DESC, recall DESC, fp, precision DESC, w_rf, threshold LIMIT 1""",
    "meta_matrix": f"WITH {SCORED} SELECT grp, {_META} FROM scores GROUP BY grp",
    "pair_gate_apply": f"WITH {SCORED}, bounds(w_min, w_max) AS (VALUES " + ", ".join(f"(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for a, b in ensemble.GATE_BOUNDS) + ") SELECT w_min, w_max, y, round(sum((w_min + (w_max - w_min) * p_lr) * p_xgb + (1 - (w_min + (w_max - w_min) * p_lr)) * p_rf), 4) AS sum_p, count(*) AS n FROM scores CROSS JOIN bounds GROUP BY ALL",
    "softmax_target": f"WITH {SCORED} SELECT CAST(CASE WHEN abs(p_rf - y) <= least(abs(p_xgb - y), abs(p_dt - y)) THEN 0 WHEN abs(p_xgb - y) <= abs(p_dt - y) THEN 1 ELSE 2 END AS BIGINT) AS target, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos FROM scores GROUP BY ALL",
}
