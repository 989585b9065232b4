"""Findings at call sites, their static scores, and the merge with model scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flintsieve.functions import constants as C
from flintsieve.functions.names import function_kind, risk_level
from flintsieve.functions.text import in_list

THRESHOLD = 0.5


def probabilities(results: DataFrame, key: str) -> DataFrame:
    """One probability for each name: the lowest, as the last row of a list in descending order is the one that counts."""
    return results.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(F.min("prob_vulnerable").alias("p"))


def with_probability(sites: DataFrame, results: DataFrame) -> DataFrame:
    """sites with function_probability: by function name, else by entry, else 0."""
    by_name, by_entry = probabilities(results, "function").withColumnRenamed("p", "p_name"), probabilities(results, "entry").withColumnRenamed("p", "p_entry")
    return sites.join(by_name, "function", "left").join(by_entry, "entry", "left").withColumn("function_probability", F.coalesce("p_name", "p_entry", F.lit(0.0))).drop("p_name", "p_entry")


def finding_risk(api: Column, p: Column, margin: Column, ratio: Column, threshold: float = THRESHOLD) -> Column:
    return (
        F.when((margin > 0) | (ratio > 1), "HIGH").when(api.isin(*C.ALWAYS_UNBOUNDED), F.when(p >= threshold, "HIGH").otherwise("MEDIUM"))
        .when(in_list(api, C.FINDABLE) & (p >= 0.65), "MEDIUM").otherwise(risk_level(p, threshold))
    )


def finding_reason(local: Column) -> Column:
    """Parts of a reason that hold, joined by semicolons; lines over 120 characters are cut."""
    api, dst, size, margin, ratio, line = (F.col(c) for c in ("sink_api", "dst_stack_size", "size_value", "overflow_margin", "size_to_dst_ratio", "line"))
    number = lambda text, v: F.concat(F.lit(text), v.cast("long").cast("string"))
    short = F.when(F.length(line) > 120, F.concat(F.left(line, F.lit(117)), F.lit("..."))).otherwise(line)
    parts = [
        F.when(api.isin(*C.ALWAYS_UNBOUNDED), "unbounded dangerous sink").when(in_list(api, C.FINDABLE), "dangerous copy/input sink"), F.when(local, "stack/local buffer exists"),
        F.when(dst > 0, number("dst buffer size≈", dst)), F.when(size > 0, number("copy/input size≈", size)), F.when(margin > 0, number("overflow margin≈", margin)),
        F.when(ratio > 1, F.concat(F.lit("size/dst ratio≈"), F.format_string("%.2f", ratio))), F.when(line != "", F.concat(F.lit("line: "), short)),
    ]
    text = F.concat_ws("; ", *parts)
    return F.when(text == "", "function-level ML risk").otherwise(text)


def findings(sites: DataFrame, results: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Call sites of shown functions that are dangerous, probable or too large, with risk and reason.

    sites: call_sites() with entry; results: function, entry, prob_vulnerable, ignored_runtime.
    """
    shown = with_probability(sites, results).where(~function_kind(F.col("function")).isin("compiler_runtime", "import_or_plt_api"))
    p, margin, ratio = F.col("function_probability"), F.col("overflow_margin"), F.col("size_to_dst_ratio")
    df = shown.withColumnsRenamed({"api": "sink_api", "dst_buffer_size": "dst_stack_size"}).where(in_list(F.col("sink_api"), C.FINDABLE) | (p >= threshold) | (margin > 0) | (ratio > 1))
    return df.withColumns({"finding_risk": finding_risk(F.col("sink_api"), p, margin, ratio, threshold), "reason": finding_reason(F.col("dst_is_local_buffer"))}).select(
        "function", "entry", "sink_api", F.col("dst_var").alias("dst_buffer"), F.col("src_var").alias("src"), "finding_risk", "reason", "function_probability", "line_index", "dst_stack_size", "size_value", "overflow_margin", "size_to_dst_ratio")


def static_scores(found: DataFrame, threshold: float = THRESHOLD, own_reason_is_evidence: bool = True) -> DataFrame:
    """function, static_finding_score, explicit_findings, static_reason.

    Words of safe evidence are looked for in the whole row. The reason `unbounded dangerous sink` holds one of them,
    which is kept for equal results; own_reason_is_evidence=False leaves the reason's own words out.
    """
    words = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in found.columns]))
    if not own_reason_is_evidence:
        words = F.replace(words, F.lit("unbounded dangerous sink"), F.lit(""))
    safe = F.exists(F.array(*map(F.lit, C.SAFE_WORDS)), lambda w: F.contains(words, w))
    api, p = F.col("sink_api"), F.col("function_probability")
    over = (F.col("overflow_margin") > 0) | (F.col("size_to_dst_ratio") > 1)
    doubt = safe & (p < 0.5)
    cases = [
        (api.isin(*C.ALWAYS_UNBOUNDED), F.when(safe, 0.68).otherwise(0.90), F.concat(F.when(safe, "unbounded sink but safe/guard evidence exists: ").otherwise("unbounded dangerous sink: "), api)),
        (over, F.when(doubt, 0.55).when(safe, 0.70).otherwise(0.92), F.when(doubt, "possible size overflow, but safe/guard evidence and low model probability").when(safe, "possible size overflow, but safe/guard evidence exists").otherwise("explicit size overflow evidence")),
        (in_list(api, C.COPIES), F.when(doubt, 0.35).when(safe, 0.55).otherwise(0.72), F.concat(F.when(doubt, "bounded sink with safe evidence: ").when(safe, "bounded sink with guard/safe evidence: ").otherwise("dangerous bounded sink: "), api)),
        (F.col("finding_risk") == "HIGH", F.when(safe, 0.75).otherwise(0.88), F.lit("high-risk static finding")),
        (F.col("finding_risk") == "MEDIUM", F.when(safe, 0.60).otherwise(0.70), F.lit("medium-risk static finding")),
    ]
    score, why = F, F
    for on, value, text in cases:
        score, why = score.when(on, value), why.when(on, text)
    known = ~safe & ((F.col("dst_stack_size") > 0) | (F.col("size_value") > 0))
    df = found.withColumns({"base": score.otherwise(0.0), "why": why, "known": known})
    df = df.withColumn("each", F.when((F.col("base") > 0) & F.col("known"), F.least(F.lit(0.99), F.col("base") + 0.02)).otherwise(F.col("base")))
    g = df.groupBy("function").agg(F.max("each").alias("top"), F.count("*").alias("explicit_findings"), F.sort_array(F.collect_list(F.struct("line_index", "why"))).alias("r"))
    n = F.col("explicit_findings")
    return g.select(
        "function", F.when((n >= 2) & (F.col("top") > 0), F.least(F.lit(0.99), F.col("top") + 0.02 * (n - 1))).otherwise(F.col("top")).alias("static_finding_score"), "explicit_findings",
        F.array_join(F.array_distinct(F.array_compact(F.transform("r", lambda x: x["why"]))), "; ").alias("static_reason"))


def hybrid(results: DataFrame, static: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """results with the larger of the model's and the static score, its prediction and level; all rows of a name are updated."""
    df = results.withColumnRenamed("prob_vulnerable", "model_prob").join(static, "function", "left")
    df = df.withColumns({"static_finding_score": F.coalesce("static_finding_score", F.lit(0.0)), "explicit_findings": F.coalesce("explicit_findings", F.lit(0).cast("long"))})
    df = df.withColumn("prob_vulnerable", F.greatest("model_prob", "static_finding_score"))
    return df.withColumns({"pred_label": (F.col("prob_vulnerable") >= threshold).cast("int"), "risk_level": risk_level(F.col("prob_vulnerable"), threshold)})


def ranked(results: DataFrame) -> DataFrame:
    """Functions with findings first, then by probability; ties by name."""
    return results.orderBy((F.col("explicit_findings") > 0).desc(), F.desc("prob_vulnerable"), "function")


def rank_numbers(results: DataFrame, keys: list[str]) -> DataFrame:
    return results.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy((F.col("explicit_findings") > 0).desc(), F.desc("prob_vulnerable"), "function")))
