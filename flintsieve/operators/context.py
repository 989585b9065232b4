"""Aliases, loops, roles, and the second, alias-aware look at call sites with their roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flintsieve.functions import constants as C
from flintsieve.functions import text as T
from flintsieve.operators.scoring import _sum, call_sites, score_sites

ALIAS = r"\b([A-Za-z_]\w*)\s*=\s*&?\s*([A-Za-z_]\w*)\b\s*;"
# Words of loop guards, of size guards and of comparisons.
LOOP_GUARDS, SIZE_GUARDS, COMPARED = ["<", "len", "size"], ["strlen", "wcslen", "strnlen", "sizeof", "len", "size", "count"], ["<", ">", "==", "!="]
SOURCES = r"\b(" + "|".join(C.INPUT_SOURCES) + r")\b"
ASSIGNED = r"\E\b\s*=\s*.*\b(argv|envp|getenv|stdin|scanf|sscanf|fgets|gets|read|recv|recvfrom|getchar)\b"
SNPRINTF, STRNCPY, MEMCPY = ["snprintf", "vsnprintf", "snprintf_chk", "vsnprintf_chk"], ["strncpy", "strncat", "strncpy_chk", "strncat_chk"], ["memcpy", "memmove", "memcpy_chk", "memmove_chk"]


def _has(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def aliases(ls: Column, found: Column) -> Column:
    """array<struct<alias, target, line_index, target_size>>: names that a line sets to a buffer, each pair once. A
    pointer declaration with a value has the same form after its type, so one pattern finds both."""
    def paired(s: Column) -> Column:
        pairs = F.flatten(F.transform(s["ls"], lambda x, i: F.transform(
            F.arrays_zip(F.regexp_extract_all(x, F.lit(ALIAS), F.lit(1)).alias("a"), F.regexp_extract_all(x, F.lit(ALIAS), F.lit(2)).alias("b")),
            lambda p: F.struct(p["a"].alias("alias"), p["b"].alias("b"), i.alias("line_index")))))
        # Names of buffers are compared without case, as the texts are; the buffer's own spelling is the target.
        named = F.transform(pairs, lambda p: F.struct(p["alias"].alias("alias"), F.get(F.filter(s["found"], lambda b: F.lower(b["name"]) == F.lower(p["b"])), 0).alias("t"), p["line_index"].alias("line_index")))
        return F.transform(F.filter(named, lambda p: p["t"].isNotNull() & (p["alias"] != p["t"]["name"])), lambda p: F.struct(p["alias"].alias("alias"), p["t"]["name"].alias("target"), p["line_index"].alias("line_index"), p["t"]["byte_size"].alias("target_size")))

    def first(s: Column) -> Column:
        return F.filter(s["kept"], lambda p, i: F.array_position(s["keys"], F.concat_ws("->", p["alias"], p["target"])) == i + 1)

    kept = T.once(F.struct(ls.alias("ls"), found.alias("found")), paired)
    keyed = T.once(kept, lambda k: F.struct(k.alias("kept"), F.transform(k, lambda p: F.concat_ws("->", p["alias"], p["target"])).alias("keys")))
    return T.once(keyed, first)


def alias_summary(found: Column) -> Column:
    """struct of the number of aliases, how many name a buffer of the stack (all that aliases() gives), and the largest one."""
    n = F.coalesce(F.size(found), F.lit(0)).cast("long")
    largest = F.coalesce(F.array_max(F.transform(found, lambda a: a["target_size"])), F.lit(0)).cast("long")
    return F.struct(n.alias("v6_alias_count"), n.alias("v6_stack_buffer_alias_count"), F.greatest(largest, F.lit(0)).alias("v6_alias_target_size_max"))


def resolved(name: Column, found: Column) -> Column:
    """The target of a name's first alias, or the name."""
    return F.coalesce(F.get(F.filter(found, lambda a: a["alias"] == name), 0)["target"], name)


def loops(ls: Column, found: Column) -> Column:
    """struct of loop counts and of the score of loops that copy to the stack; the window is the loop's line and ten more. Lines
    without a loop are dropped first, and each step works on what the last one named, so none is done twice."""
    def seen(s: Column, loop: Column) -> Column:
        def looked(w: Column) -> Column:
            writes = F.exists(s["found"], lambda b: F.regexp_like(w, F.concat(F.lit(r"(?i)\b\Q"), b["name"], F.lit(r"\E\s*\[[^\]]+\]\s*="))))
            return F.struct(writes.alias("writes"), w.rlike(SOURCES).alias("reads"), loop["line"].rlike(r"\d").alias("const"), _has(w, LOOP_GUARDS).alias("guard"))

        return T.once(F.lower(F.array_join(F.slice(s["ls"], loop["at"] + 1, 11), "\n")), looked)

    def met(s: Column) -> Column:
        lines = F.transform(s["ls"], lambda x, i: F.struct(x.alias("line"), i.alias("at")))
        return F.transform(F.filter(lines, lambda x: F.lower(x["line"]).rlike(C.LOOP)), lambda x: seen(s, x))

    def counted(met: Column) -> Column:
        count = lambda test: F.size(F.filter(met, test)).cast("long")
        return F.struct(
            F.size(met).cast("long").alias("loop_count"), count(lambda x: x["writes"]).alias("loop_writes_stack"), count(lambda x: x["reads"]).alias("loop_reads_external"), count(lambda x: x["const"]).alias("loop_bound_const"),
            count(lambda x: ~x["const"]).alias("loop_bound_unknown"), count(lambda x: x["guard"]).alias("loop_has_index_guard"), count(lambda x: x["writes"] & (x["reads"] | ~x["guard"] | ~x["const"])).alias("loop_copy_risk"),
        )

    names = ["loop_count", "loop_writes_stack", "loop_reads_external", "loop_bound_const", "loop_bound_unknown", "loop_has_index_guard", "loop_copy_risk"]
    scored = lambda n: F.struct(*[n[k].alias(k) for k in names], (n["loop_copy_risk"] * 3.0 + n["loop_writes_stack"] + n["loop_reads_external"]).alias("loop_copy_risk_score"))
    return T.once(T.once(T.once(F.struct(ls.alias("ls"), found.alias("found")), met), counted), scored)


def source_distance(ls: Column, at: Column) -> Column:
    """Lines back to the nearest input source among the previous forty; 0 if there is none."""
    first = F.greatest(at - 40, F.lit(0))
    hits = F.filter(F.transform(F.slice(ls, first + 1, at - first), lambda x, i: F.when(F.lower(x).rlike(SOURCES), at - first - i)), lambda d: d.isNotNull())
    return F.coalesce(F.array_min(hits), F.lit(0))


def roles(functions: DataFrame, sink_counts: DataFrame) -> DataFrame:
    """Whether each function was decompiled, wraps a library call, or has a real body. sink_counts: fn, sink_count."""
    body = F.trim(F.coalesce("text", F.lit("")))
    n = F.size(T.lines(body)).cast("long")
    flag = lambda c: F.col(c) if c in functions.columns else F.lit(False)
    df = functions.join(sink_counts, "fn", "left").withColumns({"n_lines": n, "ok": body != "", "sink_count": F.coalesce("sink_count", F.lit(0).cast("long"))})
    own = F.lower(T.symbol(F.col("function")))
    wrapper = (F.col("n_lines") <= 12) & (F.col("sink_count") > 0) & (own != "") & F.contains(F.lower(body), F.concat(own, F.lit("(")))
    df = df.withColumn("is_wrapper_like", wrapper)
    return df.select("fn", F.col("ok").alias("decompile_success"), flag("is_external").alias("is_external"), flag("is_thunk").alias("is_thunk"), "is_wrapper_like",
        (F.col("ok") & ~flag("is_external") & ~flag("is_thunk") & ~F.col("is_wrapper_like") & (F.col("n_lines") > 3)).alias("has_real_body"), F.col("n_lines").alias("line_count"), "sink_count")


def enriched_sites(functions: DataFrame) -> DataFrame:
    """Scored call sites seen again through aliases: sizes, guards, sources, proofs of safety, and new scores (all c_*)."""
    df = score_sites(call_sites(functions, keep=["ls", "buffers"])).withColumn("al", aliases(F.col("ls"), F.col("buffers")))
    c = F.col
    df = df.withColumns({"c_dst_var": resolved(c("dst_var"), c("al")), "c_src_var": resolved(c("src_var"), c("al"))})
    df = df.withColumns({"cd": T.buffer_of(c("buffers"), c("c_dst_var")), "cs": T.buffer_of(c("buffers"), c("c_src_var")), "lit": T.literal_length(c("src_arg"))})
    df = df.withColumns({"c_dst_size": F.coalesce("cd.byte_size", "dst_buffer_size"), "c_dst_stack": c("cd").isNotNull() | c("dst_is_local_buffer"), "c_src_stack": c("cs").isNotNull()})
    uses = lambda v: (v != "") & F.regexp_like(F.lower("size_arg"), F.concat(F.lit(r"\bsizeof\s*\(\s*&?\s*\Q"), F.lower(v), F.lit(r"\E\s*\)")))
    df = df.withColumns({"parsed": T.size_value(c("size_arg"), c("c_dst_var"), c("c_dst_size")), "c_sizeof_dst": F.coalesce(uses(c("dst_var")) | uses(c("c_dst_var")), F.lit(False))})
    known = c("parsed").isNotNull() | c("size_expr_known")
    by_sizeof = c("c_sizeof_dst") & (c("c_dst_size") > 0) & ~known
    df = df.withColumns({"c_size": F.when(by_sizeof, c("c_dst_size")).otherwise(F.coalesce("parsed", F.when(c("size_expr_known"), c("size_value")), F.lit(0).cast("long"))), "c_size_expr_known": known | by_sizeof})
    df = df.withColumns({"c_size_known": c("c_size_expr_known") | c("c_sizeof_dst"), "c_dst_known": c("c_dst_stack") & (c("c_dst_size") > 0)})
    sized = c("c_dst_known") & c("c_size_known")
    low = F.lower("guard_text")
    df = df.withColumns({
        "c_gt": sized & (c("c_size") > c("c_dst_size")), "c_eq": sized & (c("c_size") == c("c_dst_size")), "c_lt": sized & (c("c_size") < c("c_dst_size")),
        "c_literal_gt": F.coalesce(c("c_dst_known") & (c("lit") > c("c_dst_size")), F.lit(False)), "c_literal_le": F.coalesce(c("c_dst_known") & (c("lit") <= c("c_dst_size")), F.lit(False)),
        "c_size_guard": c("has_guard_before") & _has(low, SIZE_GUARDS) & _has(low, COMPARED), "c_strlen_guard": _has(low, C.LENGTH_WORDS[:4]), "c_sizeof_guard": F.contains(low, F.lit("sizeof")),
        "c_mentions_dst": c("guard_mentions_dst") | ((c("c_dst_var") != "") & F.contains(low, F.lower("c_dst_var"))), "c_mentions_src": c("guard_mentions_src") | ((c("c_src_var") != "") & F.contains(low, F.lower("c_src_var"))),
    })
    df = df.withColumn("c_strong", c("high_guard") | (c("c_size_guard") & (c("c_mentions_dst") | c("c_mentions_src") | c("c_sizeof_guard") | c("c_strlen_guard"))))
    # At the first line the window is that line itself.
    before = F.when(c("line_index") == 0, F.concat(F.get("ls", F.lit(0)), F.lit("\n"))).otherwise(T.window(c("ls"), c("line_index"), 20))
    df = df.withColumn("before", F.lower(before)).withColumn("c_source_before", c("before").rlike(SOURCES))
    external = c("src_origin").isin("parameter", "input_like", "local_or_unknown", "unknown") | c("c_source_before")
    assigned = lambda v: F.coalesce((v != "") & F.regexp_like("before", F.concat(F.lit(r"\b\Q"), F.lower(v), F.lit(ASSIGNED))), F.lit(False))
    fits = c("c_dst_stack") & (c("c_lt") | c("c_eq") | c("c_sizeof_dst"))
    df = df.withColumns({
        "c_external": external, "c_reaches": c("c_dst_stack") & (external | assigned(c("src_var")) | assigned(c("c_src_var"))), "c_distance": source_distance(c("ls"), c("line_index")), "c_chk": c("api").endswith("_chk"),
        "c_snprintf_safe": c("api").isin(*SNPRINTF) & fits, "c_strncpy_safe": c("api").isin(*STRNCPY) & fits, "c_memcpy_safe": c("api").isin(*MEMCPY) & fits, "c_literal_safe": c("c_dst_stack") & c("c_literal_le"),
        "c_weak": c("has_guard_before") & ~c("c_strong"),
    })
    df = df.withColumn("c_proof", c("c_snprintf_safe") | c("c_strncpy_safe") | c("c_memcpy_safe") | c("c_literal_safe") | c("c_chk") | c("c_strong"))
    st, d, b, u = c("c_dst_stack"), c("is_dangerous"), c("is_bounded"), c("is_unbounded")
    df = df.withColumns({
        "c_risk": _sum([
            (st & d, 3), (st & u, 4), (st & c("is_input"), 3), (st & c("c_external"), 2), (st & d & ~c("has_guard_before"), 2), (st & u & ~c("c_strong"), 2.5), (st & ~c("c_size_known") & (b | d), 1.5),
            (c("c_gt"), 5), (c("c_literal_gt"), 4), (c("c_reaches") & ~c("c_strong"), 2), (c("c_weak") & u, 1),
        ]),
        "c_safe": _sum([(c("c_proof"), 3), (c("c_strong"), 3), (c("c_lt") | c("c_eq"), 2), (c("c_literal_safe"), 2), (c("c_chk"), 2), (b & st & ~c("c_gt"), 1), (~st & d, 1)]),
    })
    return df.withColumns({"c_vulnerable": (c("c_risk") >= 6) & (c("c_risk") > c("c_safe")), "c_safe_site": (c("c_safe") >= 4) & (c("c_safe") >= c("c_risk"))}).drop("ls", "buffers", "al", "cd", "cs", "before", "parsed")


#: What the second roll-up counts, by the flag.
COUNTS = {
    "dst_stack": "c_dst_stack", "dst_size_known": "c_dst_known", "dst_alias": "c_dst_var <> dst_var AND c_dst_var <> ''", "size_const": "c_size_known AND NOT c_sizeof_dst", "size_unknown": "NOT c_size_known", "size_gt_dst": "c_gt",
    "size_eq_dst": "c_eq", "size_lt_dst": "c_lt", "src_literal": "lit IS NOT NULL", "src_external": "c_external", "source_reaches": "c_reaches", "guard": "has_guard_before", "size_guard": "c_size_guard", "strong_guard": "c_strong",
    "weak_guard": "c_weak", "no_guard": "NOT has_guard_before", "safe_proof": "c_proof", "likely_vulnerable": "c_vulnerable", "likely_safe": "c_safe_site", "literal_gt_dst": "c_literal_gt", "literal_le_dst": "c_literal_le",
}


def context_roll_up(sites: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, maxima, totals, ratios (over n + 1) and composites of the enriched call sites of a key."""
    df = sites.groupBy(*keys).agg(
        F.count("*").alias("n_sites"), *[F.count_if(F.expr(v)).alias(f"{k}_count") for k, v in COUNTS.items()], F.greatest(F.max("c_dst_size"), F.lit(0)).alias("dst_size_max"), F.greatest(F.max("c_size"), F.lit(0)).alias("size_value_max"),
        F.sum("c_risk").alias("risk_total"), F.sum("c_safe").alias("safe_total"), F.max(F.col("c_risk") - F.col("c_safe")).alias("risk_minus_safe_max"),
    )
    ratios = {f"{k}_ratio": F.col(f"{k}_count") / (F.col("n_sites") + 1.0) for k in ("dst_stack", "source_reaches", "strong_guard", "safe_proof", "likely_vulnerable", "likely_safe")}
    return df.withColumns(ratios | {
        "strict_risk_score": F.expr("risk_total + likely_vulnerable_count * 3.0D + size_gt_dst_count * 4.0D + source_reaches_count * 2.0D + no_guard_count * 1.5D - safe_proof_count * 2.0D - strong_guard_count * 2.0D"),
        "fp_suppression_score": F.expr("safe_total + safe_proof_count * 3.0D + strong_guard_count * 2.0D + literal_le_dst_count * 2.0D - size_gt_dst_count * 3.0D - no_guard_count"),
    })
