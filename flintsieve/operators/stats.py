"""Feature statistics, ranking and selection. Statistics work on the long form: one shuffle of partial sums."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flintsieve.functions import constants as C
from flintsieve.operators.vectorize import finite


def long_form(df: DataFrame, features: list[str], label: str) -> DataFrame:
    return df.select(F.col(label).alias("label"), *[finite(F.col(c)).alias(c) for c in features]).unpivot("label", features, "feature", "value")


def feature_stats(long: DataFrame) -> DataFrame:
    """Moments by label, sample and population deviation, separation, correlation with the label, non-zero share, distinct count."""
    v, y = F.col("value"), F.col("label").cast("double")
    df = long.groupBy("feature").agg(
        F.avg(v).alias("mean_all"), F.avg(F.when(y == 0, v)).alias("mean_safe"), F.avg(F.when(y == 1, v)).alias("mean_vulnerable"), F.stddev_samp(v).alias("std_sample"), F.stddev_pop(v).alias("std_pop"),
        F.avg(F.when(v != 0, 1.0).otherwise(0.0)).alias("nonzero_rate"), F.count_distinct(v).alias("nunique"), F.covar_pop(v, y).alias("cov"), F.stddev_pop(y).alias("std_label"),
    )
    diff = F.abs(F.col("mean_vulnerable") - F.col("mean_safe"))
    return df.select(
        "feature", "mean_all", "mean_safe", "mean_vulnerable", "std_sample", "std_pop", "nonzero_rate", "nunique", F.coalesce(F.try_divide(diff, F.col("std_sample")), F.lit(0.0)).alias("separation"),
        (diff / (F.col("std_pop") + 1e-12)).alias("separation_pop"), F.when(F.col("std_pop") <= 1e-12, 0.0).otherwise(F.col("cov") / ((F.col("std_pop") + 1e-12) * (F.col("std_label") + 1e-12))).alias("corr_label"),
    )


def binned_information(long: DataFrame, bins: int = 10) -> DataFrame:
    """Mutual information of the label and each feature cut into equal-width bins, in nats: an approximation of the
    nearest-neighbour estimate that needs no sample."""
    edges = long.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    b = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))).otherwise(0)
    cell = long.join(F.broadcast(edges), "feature").groupBy("feature", b.alias("bin"), "label").agg(F.count("*").alias("n"))  # a row for each feature
    n, of_bin, of_label = (F.sum("n").over(Window.partitionBy("feature", *k)) for k in ([], ["bin"], ["label"]))
    part = cell.select("feature", F.col("n") / n * F.ln(F.col("n") * n / (of_bin.cast("double") * of_label)))
    return part.toDF("feature", "part").groupBy("feature").agg(F.sum("part").alias("mutual_info"))


def scaled(c: str, keys: list[str] | None = None) -> Column:
    """A column scaled to 0..1 over all rows of a small table (or of each key); constant ones are 0."""
    w = Window.partitionBy(*[F.col(k) for k in keys or []] or [F.lit(0)])
    lo, hi = F.min(c).over(w), F.max(c).over(w)
    return F.when(hi - lo > 1e-12, (F.col(c) - lo) / (hi - lo)).otherwise(0.0)


def audited(stats: DataFrame) -> DataFrame:
    """Audit score of a feature table (abs_corr, mutual_info, separation, importance) and a hint for review.

    Weights and cut-offs are fixed values. The table has a row for each feature.
    """
    df = stats.withColumn("audit_score", 0.35 * scaled("abs_corr") + 0.25 * scaled("mutual_info") + 0.20 * scaled("separation") + 0.20 * scaled("importance"))
    s, core, proxy = F.col("audit_score"), F.col("group").isin(*C.CORE_GROUPS), F.col("proxy_flags") != ""
    return df.withColumn("review_hint", F.when(core & (s >= 0.25), "strong_keep").when(core & (s >= 0.12), "keep").when(proxy & (s < 0.25), "proxy_review").when(s < 0.08, "low_signal").otherwise("neutral"))


def correlations(df: DataFrame, features: list[str]) -> np.ndarray:
    """Pearson matrix of the features; undefined ones (constant columns) are 0. Its size is that of the feature list squared."""
    vec = VectorAssembler(inputCols=features, outputCol="v").transform(df.select(*[finite(F.col(c)).alias(c) for c in features]))
    m = Correlation.corr(vec, "v").first()[0].toArray()
    return np.nan_to_num(m, nan=0.0)


def prune_correlated(ranked: list[str], features: list[str], matrix: np.ndarray, limit: float = 0.995) -> list[str]:
    """Names in ranked order that correlate less than the limit with every one accepted before."""
    at, kept = {f: i for i, f in enumerate(features)}, []
    for name in ranked:
        if not kept or np.abs(matrix[at[name], [at[k] for k in kept]]).max() < limit:
            kept.append(name)
    return kept


def quotas(k: int) -> dict[str, int]:
    """How many of k features each group gets: rounded shares, put right one by one over the eight leading groups."""
    share = {g: round(k * r) for g, r in C.QUOTAS.items()}
    leading = list(share)[:8]
    each, first = divmod(max(0, k - sum(share.values())), len(leading))
    for i, g in enumerate(leading):
        share[g] += each + (i < first)
    while (over := sum(share.values()) - k) > 0:
        for g in [g for g in leading if share[g] > 0][:over]:
            share[g] -= 1
    return share


def top_by_group(ranked: DataFrame, limits: dict[str, int], score: str = "score") -> DataFrame:
    """The best features of each group up to its limit; ties by name."""
    w = Window.partitionBy("group").orderBy(F.desc(score), "feature")
    limit = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]), F.col("group")), F.lit(0))
    return ranked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
