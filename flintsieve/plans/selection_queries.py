"""Queries on the result table, selection, cleaning and split manifests, and their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flintsieve.functions import names
from flintsieve.operators import manifest, results, select, stats
from flintsieve.plans.adapters import bound, table

SCORED = """
SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'main' WHEN 1 THEN 'printf' WHEN 2 THEN '_start' WHEN 3 THEN 'puts@plt' WHEN 4 THEN concat('FUN_', CAST(p_partkey AS STRING))
  WHEN 5 THEN concat('sub_', CAST(p_partkey AS STRING)) WHEN 6 THEN '' ELSE concat('fn_', CAST(p_partkey AS STRING)) END AS function,
  CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END AS sink_count, CASE WHEN p_partkey % 10 = 0 THEN 2 ELSE 0 END AS local_buffer_n,
  CASE WHEN p_partkey % 5 = 0 THEN -3 ELSE 0 END AS overflow_margin_max, p_size % 2 AS guard_n, p_partkey % 101 / 100.0e0 AS prob_vulnerable FROM part
"""
FEATURES = """
SELECT concat(CASE p_partkey % 8 WHEN 0 THEN 'pcode_' WHEN 1 THEN 'sinks_v6_' WHEN 2 THEN 'v6_summary_' WHEN 3 THEN 'local_buffers_' WHEN 4 THEN 'stack_' WHEN 5 THEN 'x_risk_' WHEN 6 THEN 'sink_summary_' ELSE 'misc_line_index_' END,
    CAST(p_partkey AS STRING)) AS feature,
  p_partkey % 17 / 16.0e0 AS rf_importance, p_partkey % 13 / 12.0e0 AS et_importance, p_partkey % 11 / 10.0e0 AS mutual_info, p_size * 1.0e0 AS class_separation, p_partkey % 97 / 97.0e0 AS audit_score FROM part
"""
_RESULT = ["p_partkey", "function", "source_kind", "ignored_runtime", "pred_label", "prediction", "risk_level", "top_reason"]


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.function_results(bound(spark, sf_dir, SCORED, "part"))


def function_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir).select(*_RESULT)


def shown_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.shown(_results(spark, sf_dir), flagged_only=True).select("p_partkey", results.risk_ordinal(F.col("risk_level")).cast("long").alias("risk_ordinal"))


def result_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.summary(_results(spark, sf_dir))


def final_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 150).cast("string").alias("function"), (F.col("p_size") / 100).alias("function_probability"))
    finals = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 90).cast("string").alias("function"), "s_suppkey", (F.col("s_suppkey") % 101 / 100).alias("prob_vulnerable"))
    return results.with_final_scores(found, finals, "s_suppkey").select("p_partkey", F.round("function_probability", 6).alias("function_probability"))


def clean_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select("l_quantity", "l_tax", "l_returnflag", "l_linestatus", F.lit(7.0).alias("constant"), F.lit(None).cast("double").alias("nothing"))
    out = select.column_report(df, df.columns)
    return out.select("column", "n_numbers", F.round(F.col("lo") + 0.0, 6).alias("lo"), F.round(F.col("hi") + 0.0, 6).alias("hi"), "kept")


def labelled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, ["0", "1", "1.0", "2", "x"])), (F.col("p_partkey") % 5 + 1).cast("int")).alias("label"))
    return select.labelled(df).groupBy("label").agg(F.count("*").alias("n"))


def feature_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = select.ranked_features(bound(spark, sf_dir, FEATURES, "part"))
    return df.select("feature", "group", F.round("base_score", 9).alias("base_score"), F.round("score", 9).alias("score"))


def select_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bound(spark, sf_dir, FEATURES, "part").withColumn("group", names.feature_group_column(F.col("feature"))).withColumn("proxy_flags", names.proxy_flags_column(F.col("feature")))
    return select.select_score(df).select("feature", "group", "proxy_flags", F.round("final_score", 9).alias("final_score"))


def feature_groups_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = select.grouped_columns(bound(spark, sf_dir, FEATURES, "part"))
    return out.select("group", F.size("features").cast("long").alias("n"), F.array_join("features", ",").alias("features"))


def quota_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select("l_quantity", (F.col("l_quantity") * 2 + 1).alias("twice"), "l_discount", "l_tax", F.lit(1.0).alias("flat"), "l_linenumber")
    features = df.columns
    matrix = stats.correlations(df, features)
    deviations = np.array(df.agg(*[F.stddev_pop(c) for c in features]).first(), float)
    ranked = [("l_quantity", "a"), ("twice", "a"), ("l_discount", "b"), ("flat", "b"), ("l_tax", "b"), ("l_linenumber", "c")]
    taken = select.quota_greedy(ranked, {"a": 2, "b": 2}, features, matrix, deviations, 4)
    return spark.createDataFrame(list(enumerate(taken, 1)), "place long, feature string")


def split_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_totalprice") > 150_000).cast("int").alias("label"))
    part = F.element_at(F.array(*map(F.lit, ["train"] * 6 + ["meta", "select", "test", "test"])), (F.col("o_custkey") % 10 + 1).cast("int"))
    saved = manifest.make_manifest(df.withColumn("partition", part), "o_orderkey", "o_custkey", "partition")
    sizes = manifest.loaded(saved, df, "o_orderkey", "label").groupBy("partition").agg(F.count("*").alias("n"), F.sum("label").alias("n_one"))
    return sizes.crossJoin(manifest.manifest_report(saved, df, "o_orderkey", "label"))


QUERIES = {f.__name__: f for f in (function_results, shown_results, result_summary, final_scores, clean_columns, labelled_rows, feature_rank, select_score, feature_groups_listed, quota_greedy, split_manifest)}

_KINDS = f"""
WITH s AS ({SCORED.replace("AS STRING", "AS VARCHAR")}),
t AS (SELECT *, CASE WHEN function = 'printf' OR function = 'puts@plt' THEN 'import_or_plt_api' WHEN function = '_start' THEN 'compiler_runtime' WHEN function = '' THEN 'unknown'
    WHEN p_partkey % 9 IN (4, 5) AND prob_vulnerable < 0.5 AND sink_count = 0 AND local_buffer_n = 0 AND overflow_margin_max = 0 THEN 'unknown_low_signal_or_stub' ELSE 'user_candidate' END AS source_kind FROM s),
u AS (SELECT *, source_kind NOT IN ('user_candidate', 'unknown') AS ignored_runtime, CASE WHEN prob_vulnerable >= 0.5 THEN 1 ELSE 0 END AS pred_label,
    CASE WHEN prob_vulnerable >= 0.85 THEN 'HIGH' WHEN prob_vulnerable >= 0.65 THEN 'MEDIUM' WHEN prob_vulnerable >= 0.5 THEN 'LOW' ELSE 'SAFE' END AS risk_level,
    list_filter([CASE WHEN sink_count <> 0 THEN 'dangerous sink/copy-like call' END, CASE WHEN local_buffer_n <> 0 THEN 'stack/local buffer evidence' END,
      CASE WHEN overflow_margin_max <> 0 THEN 'size-vs-buffer risk' END, CASE WHEN guard_n <> 0 THEN 'safe/guard-related signal' END], lambda x: x IS NOT NULL) AS rs FROM t)
"""
_GROUPS = """CASE p_partkey % 8 WHEN 0 THEN 'opcode_like' WHEN 1 THEN 'v6_sink' WHEN 2 THEN 'v6_summary' WHEN 3 THEN 'raw_buffer_alias' WHEN 4 THEN '{stack}' WHEN 5 THEN 'risk_safe' WHEN 6 THEN 'sink_buffer_summary' ELSE '{rest}' END"""
_FEATURES = FEATURES.replace("AS STRING", "AS VARCHAR").replace("SELECT concat", "SELECT p_partkey, concat")
_PARTITIONS = "CASE WHEN o_custkey % 10 < 6 THEN 'train' WHEN o_custkey % 10 = 6 THEN 'meta' WHEN o_custkey % 10 = 7 THEN 'select' ELSE 'test' END"
SQL = {
    "function_results": _KINDS + """SELECT p_partkey, function, source_kind, ignored_runtime, pred_label, CASE WHEN pred_label = 1 THEN 'VULNERABLE' ELSE 'SAFE' END AS prediction, risk_level,
        CASE WHEN ignored_runtime THEN source_kind || ', hidden by default' WHEN len(rs) = 0 THEN 'model pattern from binary features' ELSE array_to_string(rs[1:3], '; ') END AS top_reason FROM u""",
    "shown_results": _KINDS + "SELECT p_partkey, CASE risk_level WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'LOW' THEN 2 ELSE 4 END::BIGINT AS risk_ordinal FROM u WHERE NOT ignored_runtime AND pred_label = 1",
    "result_summary": _KINDS + "SELECT count(*) AS n_functions, sum(pred_label)::BIGINT AS n_vulnerable, count(*) FILTER (risk_level = 'HIGH') AS n_high, max(prob_vulnerable) AS max_probability FROM u",
    "final_scores": """WITH f AS (SELECT CAST(s_suppkey % 90 AS VARCHAR) AS fn, max_by(s_suppkey % 101 / 100.0, s_suppkey) AS p FROM supplier GROUP BY 1)
        SELECT p_partkey, round(coalesce(p, p_size / 100.0), 6) AS function_probability FROM part LEFT JOIN f ON fn = CAST(p_partkey % 150 AS VARCHAR)""",
    "clean_columns": """SELECT 'l_quantity' AS "column", count(l_quantity) AS n_numbers, round(min(l_quantity)::DOUBLE, 6) + 0.0 AS lo, round(max(l_quantity)::DOUBLE, 6) AS hi, min(l_quantity) < max(l_quantity) AS kept FROM lineitem
        UNION ALL SELECT 'l_tax', count(l_tax), round(min(l_tax)::DOUBLE, 6) + 0.0, round(max(l_tax)::DOUBLE, 6), min(l_tax) < max(l_tax) FROM lineitem
        UNION ALL SELECT 'l_returnflag', 0, 0.0, 0.0, false UNION ALL SELECT 'l_linestatus', 0, 0.0, 0.0, false
        UNION ALL SELECT 'constant', count(*), 7.0, 7.0, false FROM lineitem UNION ALL SELECT 'nothing', 0, 0.0, 0.0, false""",
    "labelled_rows": "SELECT CASE p_partkey % 5 WHEN 0 THEN 0 ELSE 1 END AS label, count(*) AS n FROM part WHERE p_partkey % 5 < 3 GROUP BY 1",
    "feature_rank": f"""WITH f AS ({_FEATURES}), b AS (SELECT min(rf_importance) r0, max(rf_importance) r1, min(et_importance) e0, max(et_importance) e1, min(mutual_info) m0, max(mutual_info) m1, min(class_separation) c0, max(class_separation) c1 FROM f),
        g AS (SELECT feature, {_GROUPS.format(stack="program_static", rest="other")} AS "group", 0.42 * (rf_importance - r0) / (r1 - r0) + 0.32 * (et_importance - e0) / (e1 - e0) + 0.16 * (mutual_info - m0) / (m1 - m0) + 0.10 * (class_separation - c0) / (c1 - c0) AS base FROM f, b)
        SELECT feature, "group", round(base, 9) AS base_score, round(base * CASE "group" WHEN 'opcode_like' THEN 0.90 WHEN 'raw_buffer_alias' THEN 0.88 WHEN 'v6_summary' THEN 1.08 WHEN 'v6_sink' THEN 1.08 WHEN 'risk_safe' THEN 1.08 WHEN 'sink_buffer_summary' THEN 1.03 WHEN 'program_static' THEN 1.03 ELSE 1.0 END, 9) AS score FROM g""",
    "select_score": f"""WITH f AS ({_FEATURES}), g AS (SELECT *, {_GROUPS.format(stack="stack_memory", rest="dataflow_sink_size")} AS "group", CASE WHEN p_partkey % 8 = 7 THEN 'line_index' ELSE '' END AS proxy_flags FROM f)
        SELECT feature, "group", proxy_flags, round(audit_score + CASE "group" WHEN 'v6_sink' THEN 0.08 WHEN 'risk_safe' THEN 0.07 WHEN 'sink_buffer_summary' THEN 0.07 WHEN 'v6_summary' THEN 0.06 WHEN 'raw_buffer_alias' THEN 0.06
          WHEN 'stack_memory' THEN 0.06 WHEN 'dataflow_sink_size' THEN 0.02 ELSE 0.0 END - CASE WHEN proxy_flags = 'line_index' THEN 0.10 ELSE 0.0 END, 9) AS final_score FROM g""",
    "feature_groups_listed": f"""WITH f AS ({_FEATURES}) SELECT {_GROUPS.format(stack="program_static", rest="other")} AS "group", count(*) AS n, string_agg(feature, ',' ORDER BY feature) AS features FROM f GROUP BY 1""",
    "quota_greedy": """WITH c AS (SELECT abs(corr(l_quantity, l_quantity * 2 + 1)) AS qt, greatest(abs(corr(l_discount, l_quantity)), 0) AS dq, greatest(abs(corr(l_tax, l_quantity)), abs(corr(l_tax, l_discount))) AS t,
        greatest(abs(corr(l_linenumber, l_quantity)), abs(corr(l_linenumber, l_discount)), abs(corr(l_linenumber, l_tax))) AS n FROM lineitem)
        SELECT row_number() OVER (ORDER BY pl) AS place, feature FROM (SELECT 1 AS pl, 'l_quantity' AS feature FROM c UNION ALL SELECT 2, 'twice' FROM c WHERE qt < 0.965 UNION ALL SELECT 3, 'l_discount' FROM c WHERE dq < 0.965
        UNION ALL SELECT 4, 'l_tax' FROM c WHERE t < 0.965 UNION ALL SELECT 5, 'l_linenumber' FROM c WHERE n < 0.985)""",
    "split_manifest": f"""SELECT {_PARTITIONS} AS "partition", count(*) AS n, sum(CASE WHEN o_totalprice > 150000 THEN 1 ELSE 0 END)::BIGINT AS n_one, 0::BIGINT AS n_missing, 0::BIGINT AS n_beyond,
        (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1))::BIGINT AS n_repeated_rows, 0::BIGINT AS n_split_groups, 0::BIGINT AS n_one_label, 0::BIGINT AS n_no_group, 0::BIGINT AS n_bad_labels, 0::BIGINT AS n_lacking_partitions, 0::BIGINT AS n_other_partitions, 0 AS n_hash_differs FROM orders GROUP BY 1""",
}
