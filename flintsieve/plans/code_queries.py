"""Queries over generated C-like functions, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flintsieve.functions import constants as C
from flintsieve.functions import text as T
from flintsieve.operators import scoring
from flintsieve.plans import adapters


def _listed(names: list[str]) -> str:
    return "(" + ", ".join(f"'{x}'" for x in names) + ")"


def _role(k: int) -> str:
    return "CASE " + " ".join(f"WHEN api IN {_listed(v)} THEN {p[k]}" for p, v in C.ROLES.items()) + " ELSE -1 END"


KNOWN = sorted({*C.DANGEROUS, *C.BOUNDED, *C.INPUT, *C.LENGTH, *C.INIT})
BYTES = "CASE " + " ".join(f"WHEN contains(lower(datatype), '{w}') THEN {n}" for w, n in C.TYPE_BYTES) + " ELSE 1 END"
VAR = r"regexp_extract(split_part(split_part(regexp_replace(regexp_replace(trim({0}), '[&*]', '', 'g'), '\[[^\]]+\]', '', 'g'), '.', 1), '->', 1), '\b([A-Za-z_]\w*)\b', 1)"
NUMBER = "CASE WHEN starts_with(lower({0}), '0x') THEN CAST({0} AS BIGINT) ELSE CAST({0} AS BIGINT) END"
FUNCTIONS = f"code AS ({adapters.PSEUDO_C})"
LINES = """lines AS (SELECT fn, function, text, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_index
  FROM (SELECT *, string_split(rtrim(text, chr(10)), chr(10)) AS ls FROM code))"""
BUFFERS = rf"""found AS (SELECT fn, unnest(regexp_extract_all(text, '{C.BUFFER}', 0)) AS decl FROM code),
parts AS (SELECT fn, regexp_extract(decl, '{C.BUFFER}', 1) AS datatype, regexp_extract(decl, '{C.BUFFER}', 2) AS name, regexp_extract(decl, '{C.BUFFER}', 3) AS digits FROM found),
buffers AS (SELECT fn, name, trim(datatype) AS datatype, CAST(digits AS BIGINT) AS element_count, CAST({BYTES} AS BIGINT) AS element_size, CAST(digits AS BIGINT) * {BYTES} AS byte_size,
  CASE WHEN regexp_matches(name, '^local_[0-9a-f]+') THEN -CAST('0x' || regexp_extract(name, '^local_([0-9a-f]+)', 1) AS BIGINT) END AS stack_offset FROM parts WHERE CAST(digits AS BIGINT) > 0)"""
# Arguments hold at most one level of parentheses here, so a pattern can split them.
SITES = rf"""calls AS (SELECT fn, function, line_index, trim(line) AS line, split_part(regexp_replace(replace(trim(regexp_extract(line, '{C.CALL}', 1)), 'j_', ''), '^_+', ''), '@', 1) AS api,
    list_transform(regexp_extract_all(regexp_extract(line, '{C.CALL}', 2), '(?:"(?:\\.|[^"\\])*"|\([^()]*\)|[^,"()])+'), lambda x: trim(x)) AS args
  FROM lines WHERE regexp_matches(line, '{C.CALL}')),
named AS (SELECT *, coalesce(args[{_role(0)} + 1], '') AS dst_arg, coalesce(args[nullif({_role(1)}, -1) + 1], '') AS src_arg, coalesce(args[nullif({_role(2)}, -1) + 1], '') AS size_arg,
    {_role(0)} AS at0 FROM calls WHERE api IN {_listed(KNOWN)}),
vars AS (SELECT * REPLACE (CASE WHEN at0 < 0 THEN '' ELSE dst_arg END AS dst_arg), {VAR.format("CASE WHEN at0 < 0 THEN '' ELSE dst_arg END")} AS dst_var, {VAR.format('src_arg')} AS src_var FROM named),
sized AS (SELECT v.*, d.name IS NOT NULL AS dst_is_local_buffer, coalesce(d.byte_size, 0) AS dst_buffer_size, s.name IS NOT NULL AS src_local,
    regexp_matches(src_arg, '"') AS is_literal, length(regexp_extract(src_arg, '"([^"]*)"', 1)) AS literal_length,
    regexp_replace(regexp_replace(regexp_replace(size_arg, '^\(size_t\)', ''), 'sizeof\((\w+)\)', CASE WHEN d.name IS NOT NULL AND contains(size_arg, 'sizeof(' || d.name || ')') THEN CAST(d.byte_size AS VARCHAR) ELSE '\0' END), '\s+', '', 'g') AS bare
  FROM vars v LEFT JOIN buffers d ON v.fn = d.fn AND v.dst_var = d.name LEFT JOIN buffers s ON v.fn = s.fn AND v.src_var = s.name),
valued AS (SELECT *, CASE WHEN regexp_matches(bare, '{C.SUM}') THEN list_sum(list_transform(regexp_extract_all(bare, '[+-]?(0x[0-9a-fA-F]+|\d+)'),
    lambda t: CASE WHEN t[1] = '-' THEN -1 ELSE 1 END * CAST(ltrim(t, '+-') AS BIGINT))) END AS total,
    CASE WHEN is_literal THEN literal_length ELSE 0 END AS literal_size,
    CASE WHEN is_literal THEN 'literal' WHEN src_var = 'param_1' THEN 'parameter' WHEN src_local THEN 'local_buffer' WHEN src_var <> '' THEN 'local_or_unknown' ELSE 'unknown' END AS src_origin FROM sized),
guards AS (SELECT v.fn, v.line_index, coalesce(string_agg(lower(l.line) || chr(10), '' ORDER BY l.line_index), '') AS low
  FROM valued v LEFT JOIN lines l ON l.fn = v.fn AND l.line_index BETWEEN v.line_index - 8 AND v.line_index - 1 GROUP BY v.fn, v.line_index),
tests AS (SELECT v.* EXCLUDE (total), low, CAST(coalesce(CASE WHEN total >= 0 THEN total END, 0) AS BIGINT) AS size_value, total IS NOT NULL AND total >= 0 AS size_expr_known,
    contains(low, 'if') AS has_if, regexp_matches(low, '[<>]|==|!=') AS has_cmp, regexp_matches(low, 'strlen|wcslen|strnlen|wcsnlen|sizeof') AS has_len, regexp_matches(low, 'len|size|count|bound') AS has_word,
    dst_var <> '' AND contains(low, lower(dst_var)) AS m_dst, src_var <> '' AND contains(low, lower(src_var)) AS m_src, size_arg <> '' AND contains(low, lower(size_arg)) AS m_size,
    src_var <> '' AND contains(low, 'strlen(' || lower(src_var) || ')') AS u_len, dst_var <> '' AND contains(low, 'sizeof(' || lower(dst_var) || ')') AS u_size
  FROM valued v JOIN guards g ON v.fn = g.fn AND v.line_index = g.line_index),
sites AS (SELECT *, literal_size AS src_size_est, has_if AND (has_cmp OR has_len OR has_word) AS has_guard_before,
    CASE WHEN has_if AND (has_cmp OR has_len OR has_word) THEN 1.0 ELSE 0 END + CASE WHEN has_cmp THEN 1.0 ELSE 0 END + CASE WHEN m_dst THEN 1.5 ELSE 0 END + CASE WHEN m_src THEN 1.5 ELSE 0 END
    + CASE WHEN m_size THEN 1.0 ELSE 0 END + CASE WHEN has_len THEN 1.0 ELSE 0 END + CASE WHEN u_len THEN 1.5 ELSE 0 END + CASE WHEN u_size THEN 1.5 ELSE 0 END + CASE WHEN has_word THEN 0.5 ELSE 0 END AS guard_quality,
    size_expr_known AND dst_buffer_size > 0 AND size_value > dst_buffer_size AS size_gt_dst, dst_buffer_size > 0 AND literal_size > dst_buffer_size AS src_gt_dst,
    CASE WHEN dst_buffer_size > 0 THEN size_value - dst_buffer_size ELSE 0 END AS overflow_margin, CASE WHEN dst_buffer_size > 0 THEN size_value / dst_buffer_size ELSE 0.0 END AS size_to_dst_ratio FROM tests)"""
ON = lambda c, w: f"CASE WHEN {c} THEN {w} ELSE 0 END"
KNOWN_SIZE = "(size_expr_known AND size_value > 0)"
EXTERNAL = "src_origin IN ('parameter', 'input_like', 'local_or_unknown', 'unknown')"
SIZE_FITS, SRC_FITS = f"(dst_buffer_size > 0 AND {KNOWN_SIZE} AND size_value <= dst_buffer_size)", "(dst_buffer_size > 0 AND src_size_est > 0 AND src_size_est <= dst_buffer_size)"
SCORED = f"""flags AS (SELECT *, guard_quality >= 4 AND (m_dst OR m_src OR m_size OR u_len OR u_size) AS high_guard, dst_is_local_buffer AS l, api IN {_listed(C.DANGEROUS)} AS is_dangerous,
    api IN {_listed(C.BOUNDED)} AS is_bounded, api IN {_listed(C.UNBOUNDED)} AS is_unbounded, api IN {_listed(C.INPUT)} AS is_input, api IN {_listed(C.FORMAT)} AS is_format, api IN {_listed(C.INIT)} AS is_buffer_init FROM sites),
weighed AS (SELECT *, CAST({ON('l AND is_dangerous', 3)} + {ON('l AND is_unbounded', 4)} + {ON('l AND is_input', 3)} + {ON(f'l AND {EXTERNAL}', 2)} + {ON('l AND is_dangerous AND NOT has_guard_before', 2)}
    + {ON('l AND is_unbounded AND NOT high_guard', 2.5)} + {ON(f'l AND is_unbounded AND NOT {KNOWN_SIZE}', 1.5)} + {ON('size_gt_dst', 5)} + {ON('src_gt_dst', 3)} AS DOUBLE) AS risk_score,
    CAST({ON("src_origin = 'literal'", 2.5)} + {ON(f"src_origin = 'literal' AND {SRC_FITS}", 2)} + {ON('l AND is_bounded', 1)} + {ON(SIZE_FITS, 2)} + {ON('high_guard', 3)} + {ON('guard_quality >= 5', 1)}
    + {ON('NOT l AND is_dangerous', 1.5)} AS DOUBLE) AS safe_score FROM flags),
scored AS (SELECT *, risk_score - safe_score AS risk_minus_safe, l AND (is_dangerous OR is_bounded OR is_input OR is_format) AS direct_stack, l AND is_dangerous AS dangerous_stack, l AND is_unbounded AS unbounded_stack,
    l AND is_bounded AS bounded_stack, l AND is_input AS input_stack, l AND is_format AS format_stack, l AND {EXTERNAL} AS external_stack, l AND src_origin = 'literal' AS literal_stack, l AND src_origin = 'unknown' AS unknown_stack,
    l AND is_unbounded AND NOT {KNOWN_SIZE} AS size_unknown_unbounded_stack, l AND is_unbounded AND NOT has_guard_before AS unbounded_stack_no_guard, l AND is_unbounded AND has_guard_before AND NOT high_guard AS unbounded_stack_weak_guard,
    l AND is_dangerous AND NOT has_guard_before AS dangerous_stack_no_guard, size_gt_dst OR src_gt_dst AS stack_overflow, {SIZE_FITS} OR {SRC_FITS} AS stack_size_safe,
    risk_score >= 6 AND risk_score > safe_score AS likely_vulnerable, safe_score >= 4 AND safe_score >= risk_score AS likely_safe FROM weighed)"""
ROLLED = """rolled AS (SELECT function, count(*) AS n_sites, """ + ", ".join(f"count(*) FILTER ({k}) AS {k}_count" for k in scoring.FLAGS) + """, sum(risk_score) AS risk_total, sum(safe_score) AS safe_total,
    max(risk_minus_safe) AS risk_minus_safe_max, CAST(sum(guard_quality) AS DOUBLE) AS guard_quality_total, CAST(max(guard_quality) AS DOUBLE) AS guard_quality_max FROM scored GROUP BY function)"""
WITH_SITES = f"WITH {FUNCTIONS}, {LINES}, {BUFFERS}, {SITES}"
WITH_SCORED = f"{WITH_SITES}, {SCORED}"


def local_buffers(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = adapters.functions(spark, sf_dir).select("fn", F.inline(T.buffers(F.col("text"))))
    return df.select("fn", "name", "datatype", "element_count", F.col("element_size").cast("long").alias("element_size"), "byte_size", "stack_offset")


def call_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.call_sites(adapters.functions(spark, sf_dir)).select("fn", "line_index", "line", "api", F.size("args").cast("long").alias("n_args"), "dst_arg", "src_arg", "size_arg", "dst_var", "src_var")


def size_expr_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.call_sites(adapters.functions(spark, sf_dir)).select(
        "fn", "line_index", "api", "size_arg", "size_value", "size_expr_known", "dst_buffer_size", "src_size_est", "src_origin", "size_gt_dst", "src_gt_dst", "overflow_margin", F.round("size_to_dst_ratio", 6).alias("size_to_dst_ratio"))


def guard_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.call_sites(adapters.functions(spark, sf_dir)).select(
        "fn", "line_index", "has_if_before", "has_compare_before", "has_len_check_before", "guard_mentions_dst", "guard_mentions_src", "guard_mentions_size_arg", "guard_uses_strlen_src", "guard_uses_sizeof_dst", "has_guard_before", "guard_quality")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_sites(scoring.call_sites(adapters.functions(spark, sf_dir)))


SHOWN = ["fn", "line_index", "api", "risk_score", "safe_score", "risk_minus_safe", *scoring.FLAGS]


def v4_callsite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select(*SHOWN)


ROLL = ["function", "n_sites", *[f"{k}_count" for k in scoring.FLAGS], "risk_total", "safe_total", "risk_minus_safe_total", "risk_minus_safe_max", "guard_quality_total", "guard_quality_max", "fp_suppression_score", "strict_risk_score"]
RATIOS = ["direct_stack_ratio", "likely_vulnerable_ratio", "likely_safe_ratio"]


def v4_function_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.roll_up(_scored(spark, sf_dir), ["function"]).select(*ROLL, *[F.round(k, 6).alias(k) for k in RATIOS])


def sink_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.sink_summary(_scored(spark, sf_dir), ["fn"]).withColumn("max_size_to_dst_ratio", F.round("max_size_to_dst_ratio", 6))


def buffer_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.buffer_summary(adapters.functions(spark, sf_dir))


def ranked_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: from code text to functions ranked by risk, with a level."""
    df = scoring.roll_up(_scored(spark, sf_dir), ["function"])
    p = F.col("risk_total") / (F.col("risk_total") + F.col("safe_total") + 1)
    level = F.when(F.col("p") >= C.HIGH, "HIGH").when(F.col("p") >= C.MEDIUM, "MEDIUM").when(F.col("p") >= 0.5, "LOW").otherwise("SAFE")
    return df.select("function", "n_sites", "risk_total", "safe_total", F.round(p, 6).alias("p")).withColumn("risk_level", level).orderBy(F.desc("p"), "function")


QUERIES = {
    "local_buffers": local_buffers, "call_sites": call_sites, "size_expr_eval": size_expr_eval, "guard_quality": guard_quality, "v4_callsite": v4_callsite, "v4_function_rollup": v4_function_rollup,
    "sink_summary": sink_summary, "buffer_summary": buffer_summary, "ranked_functions": ranked_functions,
}
_COUNTS = {
    "dangerous_sink_count": "is_dangerous", "bounded_sink_count": "is_bounded", "unbounded_sink_count": "is_unbounded", "input_api_count": "is_input", "buffer_init_count": "is_buffer_init", "dst_local_buffer_count": "l",
    "dst_size_known_count": "dst_buffer_size > 0", "size_const_count": "size_value > 0", "size_gt_dst_count": "size_gt_dst", "src_gt_dst_count": "src_gt_dst", "guarded_sink_count": "has_guard_before",
    "unguarded_sink_count": "NOT has_guard_before AND (is_dangerous OR is_bounded)", "unbounded_stack_sink_count": "is_unbounded AND l", "safe_api_misuse_count": "is_bounded AND size_gt_dst",
    "source_parameter_count": "src_origin = 'parameter'", "source_literal_count": "src_origin = 'literal'", "source_local_buffer_count": "src_origin = 'local_buffer'", "source_unknown_count": "src_origin IN ('unknown', 'local_or_unknown')",
}
SQL = {
    "local_buffers": f"WITH {FUNCTIONS}, {BUFFERS} SELECT * FROM buffers",
    "call_sites": f"{WITH_SITES} SELECT fn, line_index, line, api, len(args) AS n_args, dst_arg, src_arg, size_arg, dst_var, src_var FROM sites",
    "size_expr_eval": f"{WITH_SITES} SELECT fn, line_index, api, size_arg, size_value, size_expr_known, dst_buffer_size, src_size_est, src_origin, size_gt_dst, src_gt_dst, overflow_margin, round(size_to_dst_ratio, 6) AS size_to_dst_ratio FROM sites",
    "guard_quality": f"{WITH_SITES} SELECT fn, line_index, has_if AS has_if_before, has_cmp AS has_compare_before, has_len AS has_len_check_before, m_dst AS guard_mentions_dst, m_src AS guard_mentions_src, m_size AS guard_mentions_size_arg, u_len AS guard_uses_strlen_src, u_size AS guard_uses_sizeof_dst, has_guard_before, CAST(guard_quality AS DOUBLE) AS guard_quality FROM sites",
    "v4_callsite": f"{WITH_SCORED} SELECT {', '.join(SHOWN)} FROM scored",
    "v4_function_rollup": f"""{WITH_SCORED}, {ROLLED} SELECT * EXCLUDE (risk_minus_safe_max), risk_minus_safe_max, risk_total - safe_total AS risk_minus_safe_total,
  CAST(safe_total + high_guard_count * 2 + literal_stack_count * 2 + bounded_stack_count - unbounded_stack_no_guard_count * 2 - stack_overflow_count * 3 AS DOUBLE) AS fp_suppression_score,
  CAST(risk_total + likely_vulnerable_count * 3 + stack_overflow_count * 4 + unbounded_stack_no_guard_count * 2 AS DOUBLE) AS strict_risk_score,
  round(direct_stack_count / (n_sites + 1), 6) AS direct_stack_ratio, round(likely_vulnerable_count / (n_sites + 1), 6) AS likely_vulnerable_ratio, round(likely_safe_count / (n_sites + 1), 6) AS likely_safe_ratio FROM rolled""",
    "sink_summary": f"{WITH_SCORED} SELECT fn, count(*) AS sink_count, " + ", ".join(f"count(*) FILTER ({v}) AS {k}" for k, v in _COUNTS.items()) + ", greatest(max(size_value), 0) AS max_size_value, greatest(max(dst_buffer_size), 0) AS max_dst_buffer_size, greatest(max(overflow_margin), 0) AS max_overflow_margin, round(greatest(max(size_to_dst_ratio), 0), 6) AS max_size_to_dst_ratio FROM scored GROUP BY fn",
    "buffer_summary": f"WITH {FUNCTIONS}, {BUFFERS} SELECT code.fn, count(name) AS local_buffer_count, count(name) FILTER (byte_size > 0) AS known_size_count, coalesce(min(byte_size), 0) AS min_size, coalesce(max(byte_size), 0) AS max_size, CAST(coalesce(sum(byte_size), 0) AS BIGINT) AS total_size, count(stack_offset) AS offset_known_count FROM code LEFT JOIN buffers ON code.fn = buffers.fn GROUP BY code.fn",
    "ranked_functions": f"{WITH_SCORED}, {ROLLED} SELECT function, n_sites, risk_total, safe_total, round(risk_total / (risk_total + safe_total + 1), 6) AS p, CASE WHEN round(risk_total / (risk_total + safe_total + 1), 6) >= 0.85 THEN 'HIGH' WHEN round(risk_total / (risk_total + safe_total + 1), 6) >= 0.65 THEN 'MEDIUM' WHEN round(risk_total / (risk_total + safe_total + 1), 6) >= 0.5 THEN 'LOW' ELSE 'SAFE' END AS risk_level FROM rolled",
}
