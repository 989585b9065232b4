"""Call sites of functions, their transparent scores, and roll-ups to functions.

A functions table has fn (a unique key), function (its name), params (array of names) and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flintsieve.functions import constants as C
from flintsieve.functions import text as T


def call_sites(functions: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row for each line of a function that calls a known name: arguments, sizes, source and guard.

    keep: of ls (lines) and buffers, what stays beside them.

    Narrow: lines are exploded where the function lies, after lines without a call are dropped.
    """
    known = sorted({*C.DANGEROUS, *C.BOUNDED, *C.INPUT, *C.LENGTH, *C.INIT})
    df = functions.select("fn", "function", "params", T.buffers(F.col("text")).alias("buffers"), T.lines(F.col("text")).alias("ls"))
    # Outer, as the filter of empty lists that Spark adds else would make all texts where the file is read, by few tasks.
    df = df.select("*", F.posexplode_outer("ls").alias("line_index", "line")).where(F.col("line").rlike(C.CALL))
    df = df.withColumn("api", T.symbol(F.regexp_extract("line", C.CALL, 1))).where(T.in_list(F.col("api"), known))
    df = df.withColumn("args", T.arguments(F.regexp_extract("line", C.CALL, 2)))
    places = {"dst_arg": 0, "src_arg": 1, "size_arg": 2}
    df = df.withColumns({k: T.argument_at(F.col("args"), T.role(F.col("api"), i)) for k, i in places.items()})
    df = df.withColumns({"dst_var": T.variable(F.col("dst_arg")), "src_var": T.variable(F.col("src_arg"))})
    df = df.withColumns({"dst": T.buffer_of(F.col("buffers"), F.col("dst_var")), "src": T.buffer_of(F.col("buffers"), F.col("src_var"))})
    df = df.withColumns({
        "dst_is_local_buffer": F.col("dst").isNotNull(), "dst_buffer_size": F.coalesce("dst.byte_size", F.lit(0).cast("long")),
        "src_size_est": F.coalesce(T.literal_length(F.col("src_arg")), "src.byte_size", F.lit(0).cast("long")),
        "src_origin": T.source_origin(F.col("src_arg"), F.col("buffers"), F.col("params")),
        "guard": T.guard(T.window(F.col("ls"), F.col("line_index"), 8), F.col("dst_var"), F.col("src_var"), F.col("size_arg")),
    })
    df = df.withColumn("known_size", T.size_value(F.col("size_arg"), F.col("dst_var"), F.col("dst_buffer_size")))
    df = df.withColumns({"size_value": F.coalesce("known_size", F.lit(0).cast("long")), "size_expr_known": F.col("known_size").isNotNull()})
    sized = F.col("dst_buffer_size") > 0
    return df.withColumns({
        "size_gt_dst": F.col("size_expr_known") & sized & (F.col("size_value") > F.col("dst_buffer_size")),
        "src_gt_dst": sized & (F.col("src_size_est") > F.col("dst_buffer_size")),
        "overflow_margin": F.when(sized, F.col("size_value") - F.col("dst_buffer_size")).otherwise(0).cast("long"),
        "size_to_dst_ratio": F.when(sized, F.col("size_value") / F.col("dst_buffer_size")).otherwise(0.0),
    }).select(
        "fn", "function", "line_index", F.trim("line").alias("line"), "api", "args", *places, "dst_var", "src_var", "dst_is_local_buffer", "dst_buffer_size", "src_size_est",
        "src_origin", "size_value", "size_expr_known", "size_gt_dst", "src_gt_dst", "overflow_margin", "size_to_dst_ratio", "guard.*", *(keep or []),
    )


def _sum(rules: list[tuple[Column, float]]) -> Column:
    return sum((F.when(c, F.lit(float(w))).otherwise(0.0) for c, w in rules), F.lit(0.0))


def score_sites(sites: DataFrame) -> DataFrame:
    """Call sites with class flags, risk, safe score and verdicts. Weights are fixed values."""
    api, local = F.col("api"), F.col("dst_is_local_buffer")
    df = sites.withColumns({f"is_{k}": T.in_list(api, v) for k, v in {"dangerous": C.DANGEROUS, "bounded": C.BOUNDED, "unbounded": C.UNBOUNDED, "input": C.INPUT, "format": C.FORMAT, "buffer_init": C.INIT}.items()})
    d, b, u, i, f = (F.col(f"is_{k}") for k in ("dangerous", "bounded", "unbounded", "input", "format"))
    dst, size, src, guarded, high = F.col("dst_buffer_size"), F.col("size_value"), F.col("src_size_est"), F.col("has_guard_before"), F.col("high_guard")
    known = F.col("size_expr_known") & (size > 0)
    size_fits, src_fits = (dst > 0) & known & (size <= dst), (dst > 0) & (src > 0) & (src <= dst)
    literal, external = F.col("src_origin") == "literal", F.col("src_origin").isin("parameter", "input_like", "local_or_unknown", "unknown")
    risk = _sum([
        (local & d, 3), (local & u, 4), (local & i, 3), (local & external, 2), (local & d & ~guarded, 2), (local & u & ~high, 2.5), (local & u & ~known, 1.5),
        (F.col("size_gt_dst"), 5), (F.col("src_gt_dst"), 3),
    ])
    safe = _sum([(literal, 2.5), (literal & src_fits, 2), (b & local, 1), (size_fits, 2), (high, 3), (F.col("guard_quality") >= 5, 1), (~local & d, 1.5)])
    df = df.withColumns({"risk_score": risk, "safe_score": safe})
    r, s = F.col("risk_score"), F.col("safe_score")
    return df.withColumns({
        "risk_minus_safe": r - s, "direct_stack": local & (d | b | i | f), "dangerous_stack": local & d, "unbounded_stack": local & u, "bounded_stack": local & b, "input_stack": local & i,
        "format_stack": local & f, "external_stack": local & external, "literal_stack": local & literal, "unknown_stack": local & (F.col("src_origin") == "unknown"),
        "size_unknown_unbounded_stack": local & u & ~known, "unbounded_stack_no_guard": local & u & ~guarded, "unbounded_stack_weak_guard": local & u & guarded & ~high,
        "dangerous_stack_no_guard": local & d & ~guarded, "stack_overflow": F.col("size_gt_dst") | F.col("src_gt_dst"), "stack_size_safe": size_fits | src_fits,
        "likely_vulnerable": (r >= 6) & (r > s), "likely_safe": (s >= 4) & (s >= r),
    })


#: Flags of a scored call site that a roll-up counts.
FLAGS = [
    "direct_stack", "dangerous_stack", "unbounded_stack", "bounded_stack", "input_stack", "format_stack", "external_stack", "literal_stack", "unknown_stack", "size_unknown_unbounded_stack",
    "unbounded_stack_no_guard", "unbounded_stack_weak_guard", "dangerous_stack_no_guard", "stack_overflow", "stack_size_safe", "high_guard", "likely_vulnerable", "likely_safe",
]


def roll_up(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, totals, ratios (over n + 1) and composite scores of the scored call sites of a key."""
    n = F.count("*")
    df = scored.groupBy(*keys).agg(
        n.alias("n_sites"), *[F.count_if(F.col(k)).alias(f"{k}_count") for k in FLAGS], F.sum("risk_score").alias("risk_total"), F.sum("safe_score").alias("safe_total"),
        F.max("risk_minus_safe").alias("risk_minus_safe_max"), F.sum("guard_quality").alias("guard_quality_total"), F.max("guard_quality").alias("guard_quality_max"),
    )
    ratios = ["direct_stack", "unbounded_stack", "external_stack", "literal_stack", "high_guard", "likely_vulnerable", "likely_safe"]
    return df.withColumns({f"{k}_ratio": F.col(f"{k}_count") / (F.col("n_sites") + 1.0) for k in ratios} | {
        "risk_minus_safe_total": F.col("risk_total") - F.col("safe_total"),
        "fp_suppression_score": F.expr("safe_total + high_guard_count * 2.0D + literal_stack_count * 2.0D + bounded_stack_count - unbounded_stack_no_guard_count * 2.0D - stack_overflow_count * 3.0D"),
        "strict_risk_score": F.expr("risk_total + likely_vulnerable_count * 3.0D + stack_overflow_count * 4.0D + unbounded_stack_no_guard_count * 2.0D"),
    })


def sink_summary(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and maxima of the call sites of a key; maxima are 0 at least."""
    c = F.col
    count = lambda **kinds: [F.count_if(v).alias(k) for k, v in kinds.items()]
    return scored.groupBy(*keys).agg(
        F.count("*").alias("sink_count"),
        *count(
            dangerous_sink_count=c("is_dangerous"), bounded_sink_count=c("is_bounded"), unbounded_sink_count=c("is_unbounded"), input_api_count=c("is_input"), buffer_init_count=c("is_buffer_init"),
            dst_local_buffer_count=c("dst_is_local_buffer"), dst_size_known_count=c("dst_buffer_size") > 0, size_const_count=c("size_value") > 0, size_gt_dst_count=c("size_gt_dst"),
            src_gt_dst_count=c("src_gt_dst"), guarded_sink_count=c("has_guard_before"), unguarded_sink_count=~c("has_guard_before") & (c("is_dangerous") | c("is_bounded")),
            unbounded_stack_sink_count=c("is_unbounded") & c("dst_is_local_buffer"), safe_api_misuse_count=c("is_bounded") & c("size_gt_dst"),
            source_parameter_count=c("src_origin") == "parameter", source_literal_count=c("src_origin") == "literal", source_local_buffer_count=c("src_origin") == "local_buffer",
            source_unknown_count=c("src_origin").isin("unknown", "local_or_unknown"),
        ),
        *[F.greatest(F.max(v), F.lit(0)).alias(k) for k, v in {"max_size_value": "size_value", "max_dst_buffer_size": "dst_buffer_size", "max_overflow_margin": "overflow_margin", "max_size_to_dst_ratio": "size_to_dst_ratio"}.items()],
    )


def buffer_summary(functions: DataFrame) -> DataFrame:
    """Number, known sizes, least, most and total bytes, and known offsets of each function's buffers."""
    b = T.buffers(F.col("text"))
    df = functions.select("fn", b.alias("b"))
    sizes = F.filter(F.transform("b", lambda x: x["byte_size"]), lambda x: x > 0)
    return df.select(
        "fn", F.size("b").cast("long").alias("local_buffer_count"), F.size(sizes).cast("long").alias("known_size_count"), F.coalesce(F.array_min(sizes), F.lit(0)).alias("min_size"),
        F.coalesce(F.array_max(sizes), F.lit(0)).alias("max_size"), F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x).alias("total_size"),
        F.size(F.filter("b", lambda x: x["stack_offset"].isNotNull())).cast("long").alias("offset_known_count"),
    )
