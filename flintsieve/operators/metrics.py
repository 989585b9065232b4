"""Classification metrics and threshold search on tables of scores (y 0/1, p from 0 to 1)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: 181 thresholds with the rounding of a floating-point range, as stored results have it.
THRESHOLDS = np.arange(0.05, 0.951, 0.005).tolist()[:181]
#: Score ranges that running totals are made within, before those of the ranges.
RANGES = 1024


def threshold_counts(scores: DataFrame, keys: list[str], p: str = "p", y: str = "y", n_rows: str | None = None) -> DataFrame:
    """tp, fp, fn and tn at every threshold, for each key: one pass and one shuffle of at most 182 rows a key. Each row
    counts once, or as often as n_rows says.

    A row counts for all thresholds up to its score, so it is put in the bucket of the last one and buckets are summed
    from the end. The bucket is guessed by division and put right against the exact thresholds.
    """
    cuts = F.array(*map(F.lit, THRESHOLDS))
    n = len(THRESHOLDS)
    guess = F.greatest(F.lit(0), F.least(F.lit(n), F.floor((F.col(p) - THRESHOLDS[0]) / 0.005).cast("int") + 1))
    at = lambda k: F.get(cuts, k)
    bucket = guess + F.when((guess < n) & (at(guess) <= F.col(p)), 1).when((guess > 0) & (at(guess - 1) > F.col(p)), -1).otherwise(0)
    of = lambda v: F.count_if(F.col(y) == v) if n_rows is None else F.sum(F.when(F.col(y) == v, F.col(n_rows)).otherwise(0))
    held = scores.groupBy(*keys, bucket.alias("bucket")).agg(of(1).alias("pos"), of(0).alias("neg"))
    # All buckets of a key in one row: 182 numbers, so suffix sums need no window.
    row = held.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bucket", F.struct("pos", "neg").alias("c")))).alias("m"), F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    suffix = lambda k, name: F.aggregate(F.sequence(k, F.lit(n)), F.lit(0).cast("long"), lambda a, i: a + F.coalesce(F.try_element_at("m", i)[name], F.lit(0)))
    out = row.select(*keys, "m", "all_pos", "all_neg", F.posexplode(cuts).alias("k", "threshold"))
    out = out.withColumns({"tp": suffix(F.col("k") + 1, "pos"), "fp": suffix(F.col("k") + 1, "neg")})
    return out.select(*keys, "threshold", "tp", "fp", (F.col("all_pos") - F.col("tp")).alias("fn"), (F.col("all_neg") - F.col("fp")).alias("tn"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def with_metrics(counts: DataFrame) -> DataFrame:
    """counts with accuracy, balanced accuracy, precision, recall, F1 and macro F1; 0 where a denominator is 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    recall, specificity = _ratio(tp, tp + fn), _ratio(tn, tn + fp)
    f1, f0 = _ratio(2 * tp, 2 * tp + fp + fn), _ratio(2 * tn, 2 * tn + fp + fn)
    return counts.withColumns({
        "accuracy": _ratio(tp + tn, tp + fp + fn + tn), "balanced_accuracy": (recall + specificity) / 2, "precision": _ratio(tp, tp + fp), "recall": recall, "f1": f1, "macro_f1": (f1 + f0) / 2,
    })


def best_threshold(measured: DataFrame, keys: list[str], floor: float | None = None, ties: list[str] = ["threshold"]) -> DataFrame:  # noqa: B006
    """The best row of each key: recall at the floor first (if any), then F1, recall, fewer fp, precision, smallest tie."""
    ok = F.lit(True) if floor is None else F.col("recall") >= floor
    order = [F.desc("ok"), F.desc("f1"), F.desc("recall"), F.asc("fp"), F.desc("precision"), *map(F.asc, ties)]
    by = [F.col(k) for k in keys] or [F.lit(0)]
    return measured.withColumn("ok", ok).withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("k = 1").drop("k")


def _running(scores: DataFrame, p: str, y: str) -> DataFrame:
    """For each distinct score: pos, neg, and how many of both score less; in ranges, so no task holds all scores."""
    each = scores.groupBy(F.col(p).alias("p")).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg")).withColumn("range", F.least(F.lit(RANGES - 1), F.floor(F.col("p") * RANGES)).cast("int"))
    sums = each.groupBy("range").agg(F.sum("pos").alias("rp"), F.sum("neg").alias("rn"))
    whole = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # at most RANGES rows
    sums = sums.select("range", F.coalesce(F.sum("rp").over(whole), F.lit(0)).alias("bp"), F.coalesce(F.sum("rn").over(whole), F.lit(0)).alias("bn"))
    inside = Window.partitionBy("range").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    return each.join(F.broadcast(sums), "range").select("p", "pos", "neg", (F.col("bp") + F.coalesce(F.sum("pos").over(inside), F.lit(0))).alias("pos_below"), (F.col("bn") + F.coalesce(F.sum("neg").over(inside), F.lit(0))).alias("neg_below"))


def roc_auc(scores: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """Area under the ROC curve with ties counted half; null if a class is missing."""
    r = _running(scores, p, y).agg(F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("n1"), F.sum("neg").alias("n0"))
    return r.select(F.when((F.col("n1") > 0) & (F.col("n0") > 0), F.col("u") / (F.col("n1") * F.col("n0").cast("double"))).alias("roc_auc"))


def average_precision(scores: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """Sum over distinct scores of the gain in recall times precision; no interpolation."""
    r = _running(scores, p, y)
    total = r.agg(F.sum("pos").alias("n1"), F.sum("neg").alias("n0"))
    r = r.crossJoin(F.broadcast(total))  # one row
    above = F.col("n1") - F.col("pos_below"), F.col("n0") - F.col("neg_below")
    return r.agg(F.sum(F.try_divide(F.col("pos"), F.col("n1")) * above[0] / (above[0] + above[1])).alias("average_precision"))


def cross_errors(scores: DataFrame, models: dict[str, float], y: str = "y") -> DataFrame:
    """For each ordered pair of models (column: threshold): errors of both and corrections, by one aggregate over the rows."""
    wrong = {m: (F.col(m) >= t) != (F.col(y) == 1) for m, t in models.items()}
    pos = F.col(y) == 1

    def pair(a: str, b: str) -> Column:
        kinds = {
            "base_fn": wrong[a] & pos, "fn_fixed": wrong[a] & pos & ~wrong[b], "both_fn": wrong[a] & wrong[b] & pos,
            "base_fp": wrong[a] & ~pos, "fp_fixed": wrong[a] & ~pos & ~wrong[b], "both_fp": wrong[a] & wrong[b] & ~pos,
        }
        return F.struct(F.lit(a).alias("base_model"), F.lit(b).alias("helper_model"), *[F.count_if(c).alias(k) for k, c in kinds.items()])

    return scores.agg(F.array(*[pair(a, b) for a in models for b in models if a != b]).alias("pairs")).select(F.inline("pairs"))
