"""Choice of columns and features: cleaning, groups, scores, quotas with correlations, variants and ablations.

Feature tables have a row for each feature; data tables are read once, by one aggregate over all columns.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flintsieve.functions import constants as C
from flintsieve.functions import names
from flintsieve.operators import trees
from flintsieve.operators.vectorize import finite

# Weights of groups and of the parts of a base score; words of risk columns and how many are taken; the least
# group of an ablation and its combinations; limits of correlation.
GROUP_WEIGHTS = {"opcode_like": 0.90, "raw_buffer_alias": 0.88, "v6_summary": 1.08, "v6_sink": 1.08, "risk_safe": 1.08, "sink_buffer_summary": 1.03, "program_static": 1.03}
PARTS = {"rf_importance": 0.42, "et_importance": 0.32, "mutual_info": 0.16, "class_separation": 0.10}
RISK_TOKENS = [
    "vuln_signal", "safe_signal", "risk_score", "safe_score", "risk_minus_safe", "rule_", "strict_", "txt_", "interproc", "ip_",
    "loop", "alias", "alloca", "high_quality_guard", "literal_stack", "bounded_stack", "external_source", "size_overflow", "unbounded_stack",
]
RISK_COLUMNS = 160
CLEAN_PREFIXES = ("pcode_", "mnemonic_", "local_buffers_", "v6_aliases_")
ABLATION_LEAST = 8
ABLATIONS = {
    "drop_opcode_raw_alias": ["opcode_like", "raw_buffer_alias"], "drop_other": ["other"],
    "drop_raw_alias_other": ["raw_buffer_alias", "other"], "drop_opcode_other": ["opcode_like", "other"],
}
QUOTA_CORRELATION, FILL_CORRELATION = 0.965, 0.985
GROUP_COLUMNS = ["source_core", "binary_norm", "binary", "program_name", "json_file"]


def labelled(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows whose label is 0 or 1, as an integer."""
    value = F.col(label).cast("string").try_cast("double")
    return df.withColumn(label, value).where(F.col(label).isin(0.0, 1.0)).withColumn(label, F.col(label).cast("int"))


def column_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """For each column: how many of its values are numbers, its least and largest (others count as 0), and whether it is kept:
    neither without a number nor constant. One pass; the report has a row for each column."""
    number = lambda c: F.col(c).cast("string").try_cast("double")
    one = df.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.count(number(c)).alias("n_numbers"), F.min(finite(number(c))).alias("lo"), F.max(finite(number(c))).alias("hi")) for c in columns]).alias("r"))
    return one.select(F.inline("r")).withColumn("kept", F.coalesce((F.col("n_numbers") > 0) & (F.col("lo") < F.col("hi")), F.lit(False)))


def clean(df: DataFrame, columns: list[str]) -> DataFrame:
    """df without those of the columns that column_report does not keep."""
    return df.drop(*[r["column"] for r in column_report(df, columns).where("NOT kept").collect()])


def group_column(columns: list[str]) -> str | None:
    return next((c for c in GROUP_COLUMNS if c in columns), None)


def risk_columns(columns: list[str]) -> list[str]:
    return [c for c in columns if any(t in c for t in RISK_TOKENS)][:RISK_COLUMNS]


def without_prefixes(columns: list[str], prefixes: tuple[str, ...] = CLEAN_PREFIXES) -> list[str]:
    return [c for c in columns if not c.startswith(prefixes)]


def _scaled(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with each column scaled to 0..1; constant ones are 0. Bounds are one row, so nothing meets in one task."""
    bounds = df.agg(*[f(c).alias(f"_{k}_{c}") for c in columns for k, f in (("lo", F.min), ("hi", F.max))])
    width = lambda c: F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
    out = df.crossJoin(F.broadcast(bounds))  # a single row
    return out.withColumns({c: F.when(width(c) > 1e-12, (F.col(c) - F.col(f"_lo_{c}")) / width(c)).otherwise(0.0) for c in columns}).select(df.columns)


def group_weight(group: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in GROUP_WEIGHTS.items() for x in kv]), group), F.lit(1.0))


def ranked_features(stats: DataFrame) -> DataFrame:
    """Features (feature and PARTS) with group, base_score and score: the scaled parts by weight, times the group's weight."""
    base = sum(F.col(c) * w for c, w in PARTS.items())
    out = _scaled(stats, list(PARTS)).withColumn("base_score", base).withColumn("group", names.feature_group_column(F.col("feature"), "selector"))
    return out.withColumn("score", F.col("base_score") * group_weight(F.col("group")))


def importances(df: DataFrame, features: list[str], label: str = "label", count: int = 500, seed: int = 42, key: list[str] | None = None) -> DataFrame:
    """(feature, rf_importance, et_importance) of a random forest, balanced in each bootstrap, and of extremely random trees on
    balanced rows, both with the square root of the features at a split and without a limit of depth."""
    found = [trees.fit_forest(df, features, label, count, key=key, seed=seed).importances(), trees.fit_forest(df, features, label, count, random=True, bootstrap=False, key=key, seed=seed + 17).importances()]
    return df.sparkSession.createDataFrame(list(zip(features, *found)), "feature string, rf_importance double, et_importance double")


def model_importances(spark: SparkSession, models: dict[str, PipelineModel], order: tuple[str, ...] = ("RandomForest", "XGBoost", "DecisionTree")) -> DataFrame:
    """(feature, rf_importance) of fitted models; a later model of the order takes the place of earlier ones."""
    last: dict[str, float] = {}
    for name in [n for n in order if n in models]:
        fitted = next((s for s in models[name].stages if hasattr(s, "featureImportances")), None)
        inputs = next((s.getInputCols() for s in models[name].stages if isinstance(s, VectorAssembler)), [])
        if fitted is not None:
            last |= dict(zip(inputs, fitted.featureImportances.toArray().tolist()))
    return spark.createDataFrame(list(last.items()), "feature string, rf_importance double")


def composition(audit: DataFrame) -> DataFrame:
    """For each group of audited features (group, score, class_separation, nonzero_ratio): how many, mean and best score, mean separation and share of
    non-zero values; largest groups first."""
    out = audit.groupBy("group").agg(
        F.count("*").alias("feature_count"), F.avg("score").alias("mean_score"), F.max("score").alias("max_score"), F.avg("class_separation").alias("mean_separation"), F.avg("nonzero_ratio").alias("mean_nonzero"))
    return out.orderBy(F.desc("feature_count"), F.desc("mean_score"), "group")


def only_known(table: DataFrame, known: DataFrame, name: str = "feature") -> DataFrame:
    """Rows of a feature table whose feature another table, or the columns of a data set, has."""
    return table.join(known.select(name).distinct(), name, "left_semi")


def lacking(wanted: DataFrame, have: DataFrame, name: str = "feature") -> DataFrame:
    """The wanted features that another table does not have, each once."""
    return wanted.select(name).distinct().join(have.select(name), name, "left_anti")


def columns_of(df: DataFrame, name: str = "feature") -> DataFrame:
    """The columns of a data set as a feature table."""
    return df.sparkSession.createDataFrame([(c,) for c in df.columns], f"{name} string")


def select_score(audit: DataFrame) -> DataFrame:
    """Audited features (audit_score, group, proxy_flags) with their final score: a bonus for the group, less a penalty for
    each mark of a stand-in."""
    bonus = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in C.BONUSES.items() for x in kv]), F.col("group")), F.lit(0.0))
    penalty = sum((F.when(F.array_contains(F.split("proxy_flags", ","), flag), v).otherwise(0.0) for flag, v in names.PENALTIES.items()), F.lit(0.0))
    return audit.withColumn("final_score", F.col("audit_score") + bonus - penalty)


def quota_greedy(ranked: list[tuple[str, str]], limits: dict[str, int], features: list[str], matrix: np.ndarray, deviations: np.ndarray, k: int) -> list[str]:
    """Of (feature, group) in ranked order: for each group up to its limit those that correlate little with all taken before
    in any group, then others up to k. A constant feature counts as correlated with everything."""
    at, taken = {f: i for i, f in enumerate(features)}, []

    def free(name: str, limit: float) -> bool:
        if not taken:
            return True
        i, js = at[name], [at[t] for t in taken]
        flat = deviations[i] < 1e-12 or (deviations[js] < 1e-12).any()
        return not flat and np.abs(matrix[i, js]).max() < limit

    for group, most in limits.items():
        left = most
        for name, g in ranked:
            if g == group and left > 0 and name not in taken and free(name, QUOTA_CORRELATION):
                taken.append(name)
                left -= 1
    for name, _ in ranked:
        if len(taken) < k and name not in taken and free(name, FILL_CORRELATION):
            taken.append(name)
    return taken[:k]


def grouped_columns(features: DataFrame, variant: str = "analysis") -> DataFrame:
    """group and its features (feature), in order of name."""
    return features.groupBy(names.feature_group_column(F.col("feature"), variant).alias("group")).agg(F.array_sort(F.collect_list("feature")).alias("features"))


def ablations(columns: list[str], variant: str = "analysis") -> dict[str, list[str]]:
    """Columns that are left by variant: all, without each group that is large enough, and without combinations that drop any."""
    groups: dict[str, list[str]] = {}
    for c in columns:
        groups.setdefault(names.feature_group(c, variant), []).append(c)
    dropped = {"full": []} | {f"drop_{g}": cs for g, cs in groups.items() if len(cs) >= ABLATION_LEAST}
    dropped |= {name: cs for name, gs in ABLATIONS.items() if (cs := [c for g in gs for c in groups.get(g, [])])}
    return {name: [c for c in columns if c not in set(cs)] for name, cs in dropped.items()}


def variants(ranked: list[str], columns: list[str], kept: list[str], tops: tuple[int, ...] = (220, 260, 300, 340)) -> dict[str, list[str]]:
    """Feature lists by variant. ranked: all by score; kept: those of them that correlate little."""
    bare = without_prefixes(columns)
    out = {"group_clean": bare, "semantic_clean": bare}
    out |= {f"score_top{k}": ranked[:k] for k in tops} | {f"score_corr_top{k}": kept[:k] for k in tops}
    return out
