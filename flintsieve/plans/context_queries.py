"""Queries on aliases, loops, roles and the second look at call sites, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flintsieve.functions import constants as C
from flintsieve.functions import text as T
from flintsieve.operators import context, scoring
from flintsieve.plans import adapters
from flintsieve.plans import code_queries as code

SHOWN = ["c_dst_stack", "c_size_known", "c_sizeof_dst", "c_gt", "c_eq", "c_lt", "c_literal_gt", "c_literal_le", "c_size_guard", "c_strong", "c_weak", "c_external", "c_reaches", "c_chk", "c_proof", "c_vulnerable", "c_safe_site"]


def alias_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = adapters.functions(spark, sf_dir)
    return df.select("fn", F.inline(context.aliases(T.lines(F.col("text")), T.buffers(F.col("text"))))).select("fn", "alias", "target", F.col("line_index").cast("long").alias("line_index"), "target_size")


def loop_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = adapters.functions(spark, sf_dir)
    return df.select("fn", context.loops(T.lines(F.col("text")), T.buffers(F.col("text"))).alias("x")).select("fn", "x.*")


def function_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = adapters.functions(spark, sf_dir)
    return context.roles(df, scoring.call_sites(df).groupBy("fn").agg(F.count("*").alias("sink_count")))


def source_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.enriched_sites(adapters.functions(spark, sf_dir)).select("fn", F.col("line_index").cast("long").alias("line_index"), F.col("c_distance").cast("long").alias("distance"))


def v6_callsite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.enriched_sites(adapters.functions(spark, sf_dir)).select("fn", "line_index", "api", F.col("c_size").alias("c_size"), "c_risk", "c_safe", *SHOWN)


def v6_function_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = context.context_roll_up(context.enriched_sites(adapters.functions(spark, sf_dir)), ["fn"])
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in df.dtypes])


QUERIES = {f.__name__: f for f in (alias_map, loop_summary, function_role, source_distance, v6_callsite, v6_function_rollup)}
_SOURCES = r"\b(" + "|".join(C.INPUT_SOURCES) + r")\b"
_IN = code._listed
_FIT = "(l AND (c_lt OR c_eq OR c_sizeof_dst))"
_ON = code.ON
SEEN = rf"""sized2 AS (SELECT *, l AS c_dst_stack, is_literal AS lit, contains(lower(size_arg), 'sizeof(' || lower(dst_var) || ')') AND dst_var <> '' AS c_sizeof_dst, size_value AS c_size, dst_buffer_size AS c_dst_size FROM scored),
known2 AS (SELECT *, size_expr_known OR c_sizeof_dst AS c_size_known, l AND dst_buffer_size > 0 AS c_dst_known FROM sized2),
cmp2 AS (SELECT *, c_dst_known AND c_size_known AND c_size > c_dst_size AS c_gt, c_dst_known AND c_size_known AND c_size = c_dst_size AS c_eq, c_dst_known AND c_size_known AND c_size < c_dst_size AS c_lt,
    c_dst_known AND is_literal AND literal_length > c_dst_size AS c_literal_gt, c_dst_known AND is_literal AND literal_length <= c_dst_size AS c_literal_le,
    has_guard_before AND regexp_matches(low, 'len|size|count') AND regexp_matches(low, '[<>]|==|!=') AS c_size_guard FROM known2),
strong2 AS (SELECT *, high_guard OR (c_size_guard AND (m_dst OR m_src OR contains(low, 'sizeof') OR regexp_matches(low, 'strlen|wcslen|strnlen|wcsnlen'))) AS c_strong,
    {code.EXTERNAL} OR regexp_matches(low, '{_SOURCES}') AS c_external FROM cmp2),
proof2 AS (SELECT *, has_guard_before AND NOT c_strong AS c_weak, l AND c_external AS c_reaches, ends_with(api, '_chk') AS c_chk, l AND c_literal_le AS c_literal_safe,
    (api IN {_IN(context.SNPRINTF + context.STRNCPY + context.MEMCPY)} AND {_FIT}) OR (l AND c_literal_le) OR ends_with(api, '_chk') OR c_strong AS c_proof FROM strong2),
weighed2 AS (SELECT *, CAST({_ON('l AND is_dangerous', 3)} + {_ON('l AND is_unbounded', 4)} + {_ON('l AND is_input', 3)} + {_ON('l AND c_external', 2)} + {_ON('l AND is_dangerous AND NOT has_guard_before', 2)} + {_ON('l AND is_unbounded AND NOT c_strong', 2.5)}
    + {_ON('l AND NOT c_size_known AND (is_bounded OR is_dangerous)', 1.5)} + {_ON('c_gt', 5)} + {_ON('c_literal_gt', 4)} + {_ON('c_reaches AND NOT c_strong', 2)} + {_ON('c_weak AND is_unbounded', 1)} AS DOUBLE) AS c_risk,
    CAST({_ON('c_proof', 3)} + {_ON('c_strong', 3)} + {_ON('c_lt OR c_eq', 2)} + {_ON('c_literal_safe', 2)} + {_ON('c_chk', 2)} + {_ON('is_bounded AND l AND NOT c_gt', 1)} + {_ON('NOT l AND is_dangerous', 1)} AS DOUBLE) AS c_safe FROM proof2),
seen AS (SELECT *, c_risk >= 6 AND c_risk > c_safe AS c_vulnerable, c_safe >= 4 AND c_safe >= c_risk AS c_safe_site FROM weighed2)"""
_COUNT = {**context.COUNTS, "src_literal": "is_literal", "dst_alias": "false"}
_LOOP = r"regexp_matches(line, '\b(for|while)\s*\(')"
SQL = {
    "alias_map": rf"""WITH {code.FUNCTIONS}, {code.LINES}, {code.BUFFERS} SELECT lines.fn, regexp_extract(line, '\b([A-Za-z_]\w*)\s*=\s*&?\s*local_a\b\s*;', 1) AS alias, 'local_a' AS target, line_index, byte_size AS target_size
  FROM lines JOIN buffers ON lines.fn = buffers.fn AND name = 'local_a' WHERE regexp_matches(line, '\b([A-Za-z_]\w*)\s*=\s*&?\s*local_a\b\s*;')""",
    "loop_summary": rf"""WITH {code.FUNCTIONS}, {code.LINES}, hit AS (SELECT a.fn, a.line_index, any_value(a.line) AS line, string_agg(lower(b.line), chr(10) ORDER BY b.line_index) AS w FROM lines a JOIN lines b ON a.fn = b.fn AND b.line_index BETWEEN a.line_index AND a.line_index + 10 WHERE {_LOOP.replace('line', 'a.line')} GROUP BY a.fn, a.line_index),
t AS (SELECT fn, regexp_matches(w, '\b(local_a|local_1c)\s*\[[^\]]+\]\s*=') AS ws, regexp_matches(w, '{_SOURCES}') AS rd, regexp_matches(line, '\d') AS k, regexp_matches(w, '<|len|size') AS g FROM hit),
s AS (SELECT fn, count(*) AS n, count(*) FILTER (ws) AS a, count(*) FILTER (rd) AS b, count(*) FILTER (k) AS c, count(*) FILTER (NOT k) AS d, count(*) FILTER (g) AS e, count(*) FILTER (ws AND (rd OR NOT g OR NOT k)) AS r FROM t GROUP BY fn)
SELECT code.fn, coalesce(n, 0) AS loop_count, coalesce(a, 0) AS loop_writes_stack, coalesce(b, 0) AS loop_reads_external, coalesce(c, 0) AS loop_bound_const, coalesce(d, 0) AS loop_bound_unknown, coalesce(e, 0) AS loop_has_index_guard, coalesce(r, 0) AS loop_copy_risk, CAST(coalesce(r * 3 + a + b, 0) AS DOUBLE) AS loop_copy_risk_score FROM code LEFT JOIN s ON code.fn = s.fn""",
    "function_role": f"""{code.WITH_SITES}, n AS (SELECT fn, count(*) AS n FROM sites GROUP BY fn), k AS (SELECT fn, count(*) AS k FROM lines GROUP BY fn)
SELECT code.fn, true AS decompile_success, false AS is_external, false AS is_thunk, k <= 12 AND coalesce(n, 0) > 0 AND contains(text, function || '(') AS is_wrapper_like, NOT (k <= 12 AND coalesce(n, 0) > 0 AND contains(text, function || '(')) AND k > 3 AS has_real_body, k AS line_count, coalesce(n, 0) AS sink_count
FROM code JOIN k ON code.fn = k.fn LEFT JOIN n ON code.fn = n.fn""",
    "source_distance": f"{code.WITH_SITES} SELECT s.fn, s.line_index, coalesce(min(s.line_index - l.line_index), 0) AS distance FROM sites s LEFT JOIN lines l ON s.fn = l.fn AND l.line_index < s.line_index AND l.line_index >= s.line_index - 40 AND regexp_matches(lower(l.line), '{_SOURCES}') GROUP BY s.fn, s.line_index",
    "v6_callsite": f"{code.WITH_SCORED}, {SEEN} SELECT fn, line_index, api, c_size, c_risk, c_safe, {', '.join(SHOWN)} FROM seen",
    "v6_function_rollup": f"""{code.WITH_SCORED}, {SEEN}, r AS (SELECT fn, count(*) AS n_sites, {', '.join(f"count(*) FILTER ({v}) AS {k}_count" for k, v in _COUNT.items())}, greatest(max(c_dst_size), 0) AS dst_size_max, greatest(max(c_size), 0) AS size_value_max,
  sum(c_risk) AS risk_total, sum(c_safe) AS safe_total, max(c_risk - c_safe) AS risk_minus_safe_max FROM seen GROUP BY fn)
SELECT *, {', '.join(f"round({k}_count / (n_sites + 1), 6) AS {k}_ratio" for k in ("dst_stack", "source_reaches", "strong_guard", "safe_proof", "likely_vulnerable", "likely_safe"))},
  CAST(risk_total + likely_vulnerable_count * 3 + size_gt_dst_count * 4 + source_reaches_count * 2 + no_guard_count * 1.5 - safe_proof_count * 2 - strong_guard_count * 2 AS DOUBLE) AS strict_risk_score,
  CAST(safe_total + safe_proof_count * 3 + strong_guard_count * 2 + literal_le_dst_count * 2 - size_gt_dst_count * 3 - no_guard_count AS DOUBLE) AS fp_suppression_score FROM r""",
}
