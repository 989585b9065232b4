"""Queries over feature tables, names, findings and splits, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flintsieve.functions import constants as C
from flintsieve.functions import names, text
from flintsieve.operators import findings, infer, program, scoring, split, stats, vectorize
from flintsieve.plans import adapters, code_queries
from flintsieve.plans.adapters import table
from flintsieve.sources import readers

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
NAMES = [
    "pcode_COPY", "mnemonic_mov", "local_buffers_byte_size_max", "v6_aliases_count", "v6_alias_summary_alias_count", "v6_summary_count", "v6_loop_summary_loops", "sinks_v6_risk_sum", "sink_summary_sink_count",
    "buffer_summary_total", "v4_summary_risk", "stack_offsets_count", "cfg_edge_count", "summary_instruction_count", "callgraph_callee_count", "callgraph_caller_names_count", "sinks_guard_quality_mean", "sinks_Overflow_margin_max",
    "sinks_size_value_max", "sinks_line_index_mean", "decompiled_line_count", "sinks_bound_check_count", "summary_guard_count", "misc", "dst_stack_offset_min",
]
SYMBOLS = ["main", "_start", "__libc_csu_init", "printf", "foo@plt", "strcpy@@GLIBC", "FUN_00101", "_ITM_x", "__x86.get_pc_thunk.bx", "registerTMCloneTable_", "", "__cxa_throw", "x.plt", "my_itm_y"]
AS_LABEL = "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END"


def _values(spark: SparkSession, values: list[str], name: str) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def _sql_values(values: list[str]) -> str:
    return ", ".join("('" + v.replace("'", "''") + "')" for v in values)


def _r(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else c for c, t in df.dtypes])


def scan_project_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorize.align(table(spark, sf_dir, "lineitem").drop("l_comment"), ["l_orderkey", "l_returnflag"], ["l_tax", "absent", "l_discount", "l_linestatus", "l_quantity"])


def nested_json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long, absent double").alias("props"), F.struct(F.col("value"), (F.col("value") > 50).alias("high")).alias("features"))
    flat = vectorize.flatten(T.StructType([df.schema["props"], df.schema["features"]]))
    return df.select("event_id", *[F.round(c, 6).alias(k) for k, c in flat.items()])


def count_map_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = program.histogram(table(spark, sf_dir, "events"), ["user_id"], "event_type").withColumnRenamed("counts", "mnemonic_counts")
    keys = ["click", "purchase", "signup", "view", "error", "absent"]
    return df.select("user_id", *[c.alias(k) for k, c in vectorize.flatten(T.StructType([df.schema["mnemonic_counts"]]), maps={"mnemonic": keys}).items()])


def array_struct_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_quantity").alias("size"), (F.col("l_discount") > 0.05).alias("flag"))).alias("sinks"))
    return df.select("l_orderkey", *[F.round(c, 6).alias(k) for k, c in vectorize.flatten(T.StructType([df.schema["sinks"]]), nonzero=True).items()])


def numeric_list_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", *[F.round(c, 4).alias(k) for k, c in vectorize.number_stats(F.col("embedding"), nonzero=True).items()])


def nonzero_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(vectorize.nonzero_report(table(spark, sf_dir, "lineitem"), FEATURES))


def safe_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", names.safe_name(F.col("url")).alias("safe"))


def id_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", vectorize.first_present(F.when(F.col("c_custkey") % 3 == 0, ""), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")), F.col("c_name")).alias("name"))


def magic_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a file is a binary, and its short name, of pages of which every other one has a binary's first bytes."""
    made = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("\x7fELF"), F.col("html"))).otherwise(F.col("html")).cast("binary")
    return table(spark, sf_dir, "pages").select("page_id", made.alias("content")).select("page_id", readers.is_elf(F.col("content")).alias("match"), F.left(F.sha2("content", 256), F.lit(12)).alias("sha"))


def instr_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.element_at(F.array(*map(F.lit, ["mov", "CALL", "jmp", "jne", "cmp", "lea", "test", "b"])), (F.col("event_id") % 8 + 1).cast("int"))
    return program.instruction_counts(table(spark, sf_dir, "events").withColumn("mnemonic", m), ["user_id"])


def distinct_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = program.distinct_offsets(table(spark, sf_dir, "lineitem"), ["l_suppkey"], F.col("l_linenumber") * -8)
    return df.select("l_suppkey", F.array_join(F.transform("offsets", lambda x: x.cast("string")), ",").alias("offsets"), "n_offsets")


def cyclomatic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return program.cyclomatic(table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "k"), table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "k"), "k")


def callgraph_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 150).alias("dst"))
    return _r(program.call_degrees(edges, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"))))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumn("y", F.when(F.col("l_returnflag") == "R", 1).otherwise(0))


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.long_form(_labelled(spark, sf_dir), FEATURES, "y")


def feature_stats_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(stats.feature_stats(_long(spark, sf_dir)), 5)


def binned_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(stats.binned_information(_long(spark, sf_dir)), 9)


def feature_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, NAMES, "feature").select("feature", *[names.feature_group_column(F.col("feature"), v).alias(v) for v in names.VARIANTS])


def proxy_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, NAMES, "feature").select("feature", names.proxy_flags_column(F.col("feature")).alias("flags"))


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stats.feature_stats(_long(spark, sf_dir)).select("feature", F.abs("corr_label").alias("abs_corr"), F.col("separation_pop").alias("separation"), F.col("nonzero_rate").alias("mutual_info"), F.col("mean_all").alias("importance"))
    return stats.audited(s.withColumns({"group": F.when(F.col("feature") == "l_quantity", "risk_safe").otherwise("other"), "proxy_flags": F.when(F.col("feature") == "l_tax", "size_proxy").otherwise("")}))


def audit_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(_audit(spark, sf_dir).select("feature", "audit_score", "review_hint"), 5)


def topk_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(_audit(spark, sf_dir).select("feature", "audit_score").orderBy(F.desc("audit_score"), "feature").limit(3), 5)


def group_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _audit(spark, sf_dir).groupBy("group").agg(F.count("*").alias("n"), F.avg("audit_score").alias("mean_score"), F.max("audit_score").alias("max_score"), F.count_if(F.col("proxy_flags") != "").alias("n_proxy"))
    return _r(df, 5)


def stats_left_join_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = spark.createDataFrame([("l_quantity", 0.9), ("l_tax", 0.2)], "feature string, score double")
    s = stats.feature_stats(_long(spark, sf_dir)).select("feature", "separation")
    return _r(s.join(F.broadcast(ranks), "feature", "left").select("feature", F.coalesce("score", "separation").alias("score"), F.col("score").isNotNull().alias("has_rank")), 5)


def corr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = stats.correlations(table(spark, sf_dir, "lineitem"), FEATURES)
    return spark.createDataFrame([(a, b, round(float(m[i, j]), 6)) for i, a in enumerate(FEATURES) for j, b in enumerate(FEATURES) if i < j], "a string, b string, r double")


def corr_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = stats.correlations(table(spark, sf_dir, "lineitem"), FEATURES)
    return _values(spark, stats.prune_correlated(FEATURES, FEATURES, m, 0.5), "feature")


def quota_alloc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(stats.quotas(160).items()), "grp string, n long")


def quota_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select(F.col("p_brand").alias("group"), F.col("p_partkey").cast("string").alias("feature"), F.col("p_retailprice").alias("score"))
    return stats.top_by_group(df, {"Brand#1": 5, "Brand#2": 3, "Brand#3": 1, "Brand#4": 7}).select("group", "feature", F.col("rank").cast("long").alias("rank"))


def label_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.group_split(_labelled(spark, sf_dir), "l_suppkey", "y").select("l_orderkey", "l_suppkey", "y", "partition")


def group_split_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _labelled(spark, sf_dir).withColumn("partition", F.when(F.col("l_suppkey") % 10 < 6, "train").when(F.col("l_suppkey") % 10 < 8, "val").otherwise("test"))
    return split.split_report(df, "l_suppkey", "y")


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.sample_by_label(table(spark, sf_dir, "labels"), "quality", ["doc_id"], 30).select("doc_id", "quality")


def weighted_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = infer.predict(adapters.scores(spark, sf_dir), {"RandomForest": "p_rf", "XGBoost": "p_xgb", "DecisionTree": "p_dt"}, "WEIGHT_RF_XGB_DT", {"RandomForest": 0.65, "XGBoost": 0.05, "DecisionTree": 0.3})
    return df.groupBy("prediction", "risk_level").agg(F.count("*").alias("n"), F.round(F.sum("prob_vulnerable"), 4).alias("sum_p"))


def recipe_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    recipes = {"RandomForest": {}, "XGBoost": {}, "WEIGHT_RF_DT": {"RandomForest": 0.95, "DecisionTree": 0.05}, "WEIGHT_RF_XGB": {"RandomForest": 1.0, "XGBoost": 0.0}, "STACK_LOGISTIC_PROB_RISK": {}}
    return _values(spark, infer.available(recipes, {"RandomForest", "DecisionTree"}), "recipe")


def func_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, SYMBOLS, "name").select("name", names.function_kind(F.col("name")).alias("kind"))


def risk_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.scores(spark, sf_dir).groupBy(names.risk_level(F.col("p_rf")).alias("risk_level")).agg(F.count("*").alias("n"))


def line_window_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", text.lines(F.col("text")).alias("ls"))
    d = d.select("doc_id", F.posexplode(F.transform("ls", lambda _, i: F.length(text.window(F.col("ls"), i, 8)).cast("long"))).alias("i", "n_before"))
    return d.select("doc_id", F.col("i").cast("long").alias("i"), "n_before")


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.concat(F.lit("fn_"), F.col("p_partkey").cast("string")).alias("function"), F.lower(F.hex("p_partkey")).alias("entry"), (F.col("p_partkey") % 101 / 100).alias("prob_vulnerable"))


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = scoring.call_sites(adapters.functions(spark, sf_dir)).withColumn("entry", F.lower(F.hex("fn")))
    return findings.findings(sites, _results(spark, sf_dir))


def finding_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).select("function", "sink_api", "dst_buffer", "src", "finding_risk", F.round("function_probability", 6).alias("function_probability"), "line_index", "dst_stack_size", "size_value", "overflow_margin")


def finding_probability_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(findings.with_probability(adapters.functions(spark, sf_dir).select("function", F.lower(F.hex("fn")).alias("entry")), _results(spark, sf_dir)).select("function", "function_probability"))


def static_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(findings.static_scores(_found(spark, sf_dir)).select("function", "static_finding_score", "explicit_findings"))


def hybrid_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = findings.hybrid(_results(spark, sf_dir), findings.static_scores(_found(spark, sf_dir)))
    return _r(df.select("function", "model_prob", "static_finding_score", "explicit_findings", "prob_vulnerable", "pred_label", "risk_level"))


QUERIES = {f.__name__: f for f in (
    scan_project_align, nested_json_flatten, count_map_pivot, array_struct_stats, numeric_list_stats, nonzero_report, safe_name, id_coalesce, magic_bytes, instr_class_counts, distinct_offsets, cyclomatic, callgraph_degree,
    feature_stats_long, binned_information, feature_groups, proxy_flags, audit_score, topk_features, group_summary, stats_left_join_rank, corr_matrix, corr_prune, quota_alloc, quota_topk, label_balance, group_split, group_split_check,
    stratified_sample, weighted_predict, recipe_available, func_classify, risk_level, line_window_text, finding_table, finding_probability_lookup, static_score, hybrid_rank)}

_UNPIVOTED = f"long AS (SELECT feature, value, y FROM (UNPIVOT (SELECT {AS_LABEL} AS y, {', '.join(f'CAST({f} AS DOUBLE) AS {f}' for f in FEATURES)} FROM lineitem) ON {', '.join(FEATURES)} INTO NAME feature VALUE value))"
_STATS = f"""{_UNPIVOTED}, moments AS (SELECT feature, avg(value) AS mean_all, avg(value) FILTER (y = 0) AS mean_safe, avg(value) FILTER (y = 1) AS mean_vulnerable, stddev_samp(value) AS std_sample, stddev_pop(value) AS std_pop,
  avg(CASE WHEN value <> 0 THEN 1.0 ELSE 0.0 END) AS nonzero_rate, count(DISTINCT value) AS nunique, covar_pop(value, y) AS cov, stddev_pop(y) AS sy FROM long GROUP BY feature),
stats AS (SELECT feature, mean_all, mean_safe, mean_vulnerable, std_sample, std_pop, nonzero_rate, nunique, abs(mean_vulnerable - mean_safe) / std_sample AS separation, abs(mean_vulnerable - mean_safe) / (std_pop + 1e-12) AS separation_pop, cov / ((std_pop + 1e-12) * (sy + 1e-12)) AS corr_label FROM moments)"""
_SCALED = lambda c: f"(({c}) - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ())"
_AUDIT = f"""{_STATS}, scored AS (SELECT feature, 0.35 * {_SCALED('abs(corr_label)')} + 0.25 * {_SCALED('nonzero_rate')} + 0.20 * {_SCALED('separation_pop')} + 0.20 * {_SCALED('mean_all')} AS s,
  CASE WHEN feature = 'l_quantity' THEN 'risk_safe' ELSE 'other' END AS grp, feature = 'l_tax' AS proxy FROM stats)"""
_STARTS = lambda xs: " OR ".join(f"starts_with(feature, '{x}')" for x in xs)
_HAS = lambda xs, c="lower(feature)": " OR ".join(f"contains({c}, '{x}')" for x in xs)


def _group_sql(variant: str) -> str:
    begins, words = names.VARIANTS[variant]
    return "CASE " + " ".join(f"WHEN {_STARTS(s)} THEN '{g}'" for g, s in begins) + " " + " ".join(f"WHEN {_HAS(w, 'feature' if exact else 'lower(feature)')} THEN '{g}'" for g, w, exact in words) + (" WHEN starts_with(feature, 'summary_') THEN 'program_static'" if variant == "audit" else "") + " ELSE 'other' END"


_LEVEL = "CASE WHEN {0} >= 0.85 THEN 'HIGH' WHEN {0} >= 0.65 THEN 'MEDIUM' WHEN {0} >= 0.5 THEN 'LOW' ELSE 'SAFE' END"
_IN = code_queries._listed

_RES = "results AS (SELECT 'fn_' || p_partkey AS function, p_partkey AS fn, p_partkey % 101 / 100 AS p FROM part)"
_FOUND = f"""{code_queries.WITH_SITES}, {_RES}, located AS (SELECT s.*, coalesce(r.p, 0.0) AS fp FROM sites s LEFT JOIN results r ON s.fn = r.fn),
hits AS (SELECT *, CASE WHEN overflow_margin > 0 OR size_to_dst_ratio > 1 THEN 'HIGH' WHEN api IN {_IN(C.ALWAYS_UNBOUNDED)} THEN CASE WHEN fp >= 0.5 THEN 'HIGH' ELSE 'MEDIUM' END WHEN api IN {_IN(C.FINDABLE)} AND fp >= 0.65 THEN 'MEDIUM' ELSE {_LEVEL.format('fp')} END AS risk
  FROM located WHERE api IN {_IN(C.FINDABLE)} OR fp >= 0.5 OR overflow_margin > 0 OR size_to_dst_ratio > 1)"""
_STATIC = f"""{_FOUND}, evident AS (SELECT *, api IN {_IN(C.ALWAYS_UNBOUNDED)} AS unbounded, regexp_matches(lower(concat_ws(' ', function, api, dst_var, src_var, CASE WHEN api IN {_IN(C.ALWAYS_UNBOUNDED)} THEN 'unbounded' END, left(line, 120))), 'sizeof|guard|bound|check') AS safe FROM hits),
based AS (SELECT *, CASE WHEN unbounded THEN CASE WHEN safe THEN 0.68 ELSE 0.90 END WHEN overflow_margin > 0 OR size_to_dst_ratio > 1 THEN CASE WHEN safe AND fp < 0.5 THEN 0.55 WHEN safe THEN 0.70 ELSE 0.92 END
  WHEN api IN {_IN(C.COPIES)} THEN CASE WHEN safe AND fp < 0.5 THEN 0.35 WHEN safe THEN 0.55 ELSE 0.72 END WHEN risk = 'HIGH' THEN CASE WHEN safe THEN 0.75 ELSE 0.88 END WHEN risk = 'MEDIUM' THEN CASE WHEN safe THEN 0.60 ELSE 0.70 END ELSE 0.0 END AS base FROM evident),
eachs AS (SELECT function, CASE WHEN base > 0 AND NOT safe AND (dst_buffer_size > 0 OR size_value > 0) THEN least(0.99, base + 0.02) ELSE base END AS e FROM based),
static AS (SELECT function, CASE WHEN count(*) >= 2 AND max(e) > 0 THEN least(0.99, max(e) + 0.02 * (count(*) - 1)) ELSE max(e) END AS score, count(*) AS n FROM eachs GROUP BY function)"""
_NUM = lambda x: f"round(CAST({x} AS DOUBLE), 6)"
SQL = {
    "scan_project_align": "SELECT l_orderkey, l_returnflag, l_tax, CAST(0 AS DOUBLE) AS absent, l_discount, CAST(0 AS DOUBLE) AS l_linestatus, l_quantity FROM lineitem",
    "nested_json_flatten": "SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS props_k, CAST(0 AS DOUBLE) AS props_absent, round(value, 6) AS value, CAST(CASE WHEN value > 50 THEN 1 ELSE 0 END AS DOUBLE) AS high FROM events",
    "count_map_pivot": "SELECT user_id, " + ", ".join(f"CAST(count(*) FILTER (lower(event_type) = '{k}') AS DOUBLE) AS mnemonic_{k}" for k in ["click", "purchase", "signup", "view", "error", "absent"]) + " FROM events GROUP BY user_id",
    "array_struct_stats": "SELECT l_orderkey, CAST(count(*) AS DOUBLE) AS sinks_count, CAST(count(*) AS DOUBLE) AS sinks_dict_count, " + ", ".join(
        f"CAST(count({e}) AS DOUBLE) AS {n}_count, {_NUM(f'sum({e})')} AS {n}_sum, {_NUM(f'avg({e})')} AS {n}_mean, {_NUM(f'max({e})')} AS {n}_max, {_NUM(f'min({e})')} AS {n}_min, {_NUM(f'avg(CASE WHEN {e} <> 0 THEN 1.0 ELSE 0 END)')} AS {n}_nonzero"
        for n, e in (("sinks_size", "l_quantity"), ("sinks_flag", "CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END"))) + " FROM lineitem GROUP BY l_orderkey",
    "numeric_list_stats": "SELECT vec_id, CAST(len(e) AS DOUBLE) AS count, round(list_sum(e), 4) AS sum, round(list_avg(e), 4) AS mean, round(list_max(e), 4) AS max, round(list_min(e), 4) AS min, round(len(list_filter(e, lambda x: x <> 0)) / len(e), 4) AS nonzero FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)",
    "nonzero_report": f"SELECT count(*) AS rows, CAST({len(FEATURES)} AS BIGINT) AS features, round(avg(n), 6) AS mean_nonzero, CAST(sum(n) AS BIGINT) AS total_nonzero FROM (SELECT " + " + ".join(f"CASE WHEN {f} <> 0 THEN 1 ELSE 0 END" for f in FEATURES) + " AS n FROM lineitem)",
    "safe_name": "SELECT page_id, CASE WHEN s = '' THEN 'unknown' ELSE s END AS safe FROM (SELECT page_id, left(regexp_replace(regexp_replace(coalesce(url, ''), '[^A-Za-z0-9_.+-]+', '_', 'g'), '^_+|_+$', '', 'g'), 120) AS s FROM pages)",
    "id_coalesce": "SELECT c_custkey, coalesce(nullif(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, ''), nullif(c_name, ''), '') AS name FROM customer",
    "magic_bytes": "SELECT page_id, starts_with(c, chr(127) || 'ELF') AS match, left(sha256(c), 12) AS sha FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN chr(127) || 'ELF' || html ELSE html END AS c FROM pages)",
    "instr_class_counts": "SELECT user_id, count(*) AS instruction_count, count(*) FILTER (k = 1) AS call_instruction_count, count(*) FILTER (k IN (2, 3, 7)) AS branch_count, count(*) FILTER (k = 3) AS conditional_branch_count, count(*) FILTER (k IN (4, 6)) AS compare_count, count(*) FILTER (k = 5) AS lea_count FROM (SELECT user_id, event_id % 8 AS k FROM events) GROUP BY user_id",
    "distinct_offsets": "SELECT l_suppkey, array_to_string(list_sort(list(DISTINCT l_linenumber * -8)), ',') AS offsets, count(DISTINCT l_linenumber) AS n_offsets FROM lineitem GROUP BY l_suppkey",
    "cyclomatic": "WITH b AS (SELECT o_orderkey AS k, count(*) AS blocks FROM orders GROUP BY 1), e AS (SELECT l_orderkey AS k, count(*) AS edges FROM lineitem GROUP BY 1) SELECT b.k, blocks, coalesce(edges, 0) AS edges, greatest(1, coalesce(edges, 0) - blocks + 2) AS cyclomatic FROM b LEFT JOIN e ON b.k = e.k",
    "callgraph_degree": """WITH e AS (SELECT DISTINCT l_suppkey AS src, l_partkey % 150 AS dst FROM lineitem), o AS (SELECT src, count(*) AS n, count(s_suppkey) AS i FROM e LEFT JOIN supplier ON dst = s_suppkey GROUP BY src), c AS (SELECT dst, count(*) AS n FROM e GROUP BY dst)
SELECT s_suppkey AS node, coalesce(o.n, 0) AS callee_count, coalesce(o.i, 0) AS internal_callee_count, coalesce(c.n, 0) AS caller_count, coalesce(o.n - o.i, 0) AS external_callee_count, round(CASE WHEN o.n > 0 THEN (o.n - o.i) / o.n ELSE 0.0 END, 6) AS external_callee_ratio FROM supplier LEFT JOIN o ON s_suppkey = src LEFT JOIN c ON s_suppkey = dst""",
    "feature_stats_long": f"WITH {_STATS} SELECT feature, nunique, " + ", ".join(f"round({c}, 5) AS {c}" for c in "mean_all mean_safe mean_vulnerable std_sample std_pop nonzero_rate separation separation_pop corr_label".split()) + " FROM stats",
    "binned_information": f"""WITH {_UNPIVOTED}, e AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM long GROUP BY feature),
cell AS (SELECT feature, CASE WHEN hi > lo THEN least(9, floor((value - lo) / (hi - lo) * 10)) ELSE 0 END AS bin, y, count(*) AS n FROM long JOIN e USING (feature) GROUP BY ALL),
t AS (SELECT feature, n, sum(n) OVER (PARTITION BY feature) AS a, sum(n) OVER (PARTITION BY feature, bin) AS b, sum(n) OVER (PARTITION BY feature, y) AS c FROM cell) SELECT feature, round(sum(n / a * ln(n * a / (b * c))), 9) AS mutual_info FROM t GROUP BY feature""",
    "feature_groups": f"WITH n(feature) AS (VALUES {_sql_values(NAMES)}) SELECT feature, " + ", ".join(f"{_group_sql(v)} AS {v}" for v in names.VARIANTS) + " FROM n",
    "proxy_flags": f"WITH n(feature) AS (VALUES {_sql_values(NAMES)}) SELECT feature, concat_ws(',', " + ", ".join(f"CASE WHEN {_HAS(w)} THEN '{k}' END" for k, w in names.PROXIES.items()) + ") AS flags FROM n",
    "audit_score": f"WITH {_AUDIT} SELECT feature, round(s, 5) AS audit_score, CASE WHEN grp = 'risk_safe' AND s >= 0.25 THEN 'strong_keep' WHEN grp = 'risk_safe' AND s >= 0.12 THEN 'keep' WHEN proxy AND s < 0.25 THEN 'proxy_review' WHEN s < 0.08 THEN 'low_signal' ELSE 'neutral' END AS review_hint FROM scored",
    "topk_features": f"WITH {_AUDIT} SELECT feature, round(s, 5) AS audit_score FROM scored ORDER BY s DESC, feature LIMIT 3",
    "group_summary": f'WITH {_AUDIT} SELECT grp AS "group", count(*) AS n, round(avg(s), 5) AS mean_score, round(max(s), 5) AS max_score, count(*) FILTER (proxy) AS n_proxy FROM scored GROUP BY grp',
    "stats_left_join_rank": f"WITH {_STATS}, r(feature, score) AS (VALUES ('l_quantity', 0.9), ('l_tax', 0.2)) SELECT s.feature, round(coalesce(r.score, s.separation), 5) AS score, r.score IS NOT NULL AS has_rank FROM stats s LEFT JOIN r ON s.feature = r.feature",
    "corr_matrix": " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]),
    "corr_prune": """WITH m AS (SELECT abs(corr(l_quantity, l_extendedprice)) AS qe FROM lineitem) SELECT unnest(CASE WHEN qe < 0.5 THEN ['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax', 'l_linenumber'] ELSE ['l_quantity', 'l_discount', 'l_tax', 'l_linenumber'] END) AS feature FROM m""",
    "quota_alloc": "SELECT * FROM (VALUES " + ", ".join(f"('{g}', CAST({n} AS BIGINT))" for g, n in zip(C.QUOTAS, [43, 32, 19, 19, 16, 13, 10, 6, 2, 0, 0])) + ") t(grp, n)",
    "quota_topk": """SELECT p_brand AS "group", CAST(p_partkey AS VARCHAR) AS feature, rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, CAST(p_partkey AS VARCHAR)) AS rank FROM part) JOIN (VALUES ('Brand#1', 5), ('Brand#2', 3), ('Brand#3', 1), ('Brand#4', 7)) q(b, n) ON p_brand = b WHERE rank <= n""",
    "label_balance": "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL",
    "group_split_check": f"WITH p AS (SELECT l_suppkey AS g, {AS_LABEL} AS y, CASE WHEN l_suppkey % 10 < 6 THEN 'train' WHEN l_suppkey % 10 < 8 THEN 'val' ELSE 'test' END AS partition FROM lineitem) SELECT partition, count(*) AS n_rows, count(DISTINCT g) AS n_groups, count(*) FILTER (y = 0) AS n_safe, count(*) FILTER (y = 1) AS n_vulnerable, CAST(0 AS BIGINT) AS n_leaking FROM p GROUP BY partition",
    "stratified_sample": "SELECT doc_id, quality FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5('1337:' || doc_id), doc_id) AS k FROM labels) WHERE k <= 30",
    "weighted_predict": f"WITH {{s}}, v AS (SELECT 0.65 * p_rf + 0.05 * p_xgb + 0.3 * p_dt AS p FROM scores) SELECT CASE WHEN p >= 0.5 THEN 'FLAGGED' ELSE 'NOT_FLAGGED' END AS prediction, {_LEVEL.format('p')} AS risk_level, count(*) AS n, round(sum(p), 4) AS sum_p FROM v GROUP BY ALL".replace("{s}", f"scores AS ({adapters.SCORES})"),
    "recipe_available": "SELECT * FROM (VALUES ('RandomForest'), ('WEIGHT_RF_DT'), ('WEIGHT_RF_XGB')) t(recipe)",
    "func_classify": f"WITH n(name) AS (VALUES {_sql_values(SYMBOLS)}), b AS (SELECT name, trim(split_part(regexp_replace(trim(name), '(@plt|\\.plt|_plt)', '', 'g'), '@', 1)) AS bare FROM n) SELECT name, CASE WHEN bare = '' THEN 'unknown' WHEN bare IN {_IN(names.RUNTIME)} THEN 'compiler_runtime' WHEN bare IN {_IN(names.IMPORTED)} OR regexp_matches(name, '(@plt|\\.plt|_plt)$') THEN 'import_or_plt_api' WHEN {' OR '.join(f'''starts_with(bare, '{p}')''' for p in C.RUNTIME_PREFIXES)} OR regexp_matches(regexp_replace(lower(bare), '[_.]', '', 'g'), 'tm_clone|registertmclonetable') OR contains(lower(bare), 'itm_') THEN 'compiler_runtime' ELSE 'user_candidate' END AS kind FROM b",
    "risk_level": f"WITH scores AS ({adapters.SCORES}) SELECT {_LEVEL.format('p_rf')} AS risk_level, count(*) AS n FROM scores GROUP BY ALL",
    "line_window_text": r"""WITH l AS (SELECT doc_id, string_split_regex(regexp_replace(text, '[\n\x0b\f\r\x{85}\x{2028}\x{2029}]+$', ''), '\r\n|[\n\x0b\f\r\x{85}\x{2028}\x{2029}]') AS ls FROM documents WHERE text <> ''),
e AS (SELECT doc_id, ls, unnest(generate_series(0, len(ls) - 1)) AS i FROM l) SELECT doc_id, i, CAST(coalesce(list_sum(list_transform(ls[greatest(i - 8, 0) + 1 : i], lambda x: length(x) + 1)), 0) AS BIGINT) AS n_before FROM e""",
    "finding_table": f"{_FOUND} SELECT function, api AS sink_api, dst_var AS dst_buffer, src_var AS src, risk AS finding_risk, round(fp, 6) AS function_probability, CAST(line_index AS INTEGER) AS line_index, dst_buffer_size AS dst_stack_size, size_value, CAST(overflow_margin AS BIGINT) AS overflow_margin FROM hits",
    "finding_probability_lookup": f"WITH code AS ({adapters.PSEUDO_C}), {_RES} SELECT code.function, round(coalesce(p, 0.0), 6) AS function_probability FROM code LEFT JOIN results ON code.fn = results.fn",
    "static_score": f"{_STATIC} SELECT function, round(CAST(score AS DOUBLE), 6) AS static_finding_score, n AS explicit_findings FROM static",
    "hybrid_rank": f"{_STATIC}, h AS (SELECT r.function, r.p AS model_prob, CAST(coalesce(score, 0) AS DOUBLE) AS s, coalesce(n, 0) AS n, greatest(r.p, CAST(coalesce(score, 0) AS DOUBLE)) AS q FROM results r LEFT JOIN static USING (function)) SELECT function, round(model_prob, 6) AS model_prob, round(s, 6) AS static_finding_score, n AS explicit_findings, round(q, 6) AS prob_vulnerable, CASE WHEN q >= 0.5 THEN 1 ELSE 0 END AS pred_label, {_LEVEL.format('q')} AS risk_level FROM h",
}
