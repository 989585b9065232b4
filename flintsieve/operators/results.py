"""The result table of functions: kinds, hidden rows, reasons, risk; its summary, order and final scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flintsieve.functions import names
from flintsieve.operators.vectorize import finite

# Words of feature names that tell whether a function has a sign of a risk, and reasons with theirs.
SIGNALS = [
    "sink", "dangerous", "strcpy", "strcat", "memcpy", "memmove", "sprintf", "gets", "scanf", "read", "recv",
    "local_buffer", "buffer_summary", "stack_", "dst_stack", "overflow_margin", "size_to_dst_ratio",
]
REASONS = {
    "dangerous sink/copy-like call": ["sink", "dangerous", "strcpy", "strcat", "memcpy", "memmove", "sprintf", "gets", "scanf"],
    "stack/local buffer evidence": ["local_buffer", "buffer_summary", "stack_"],
    "size-vs-buffer risk": ["overflow_margin", "size_to_dst_ratio", "dst_stack_size", "size_value"],
    "safe/guard-related signal": ["safe", "guard", "bound", "check"],
}
NO_REASON, STUB = "model pattern from binary features", "unknown_low_signal_or_stub"
RISK_ORDER = {"HIGH": 0, "MEDIUM": 1, "LOW": 2, "INFO": 3, "SAFE": 4}
LAST = 9


def has_signal(columns: list[str], words: list[str]) -> Column:
    """Whether any column whose name has one of the words is a number other than 0."""
    out = F.lit(False)
    for c in columns:
        if any(w in c.lower() for w in words):
            out = out | (finite(F.col(c)) != 0)
    return out


def reasons(columns: list[str], kind: Column, ignored: Column, most: int = 3) -> Column:
    """The first reasons that hold, joined; for hidden rows their kind."""
    found = F.array_compact(F.array(*[F.when(has_signal(columns, words), text) for text, words in REASONS.items()]))
    listed = F.when(F.size(found) == 0, NO_REASON).otherwise(F.array_join(F.slice(found, 1, most), "; "))
    return F.when(ignored, F.concat(kind, F.lit(", hidden by default"))).otherwise(listed)


def risk_ordinal(risk: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in RISK_ORDER.items() for x in kv]), risk), F.lit(LAST))


def function_results(df: DataFrame, probability: str = "prob_vulnerable", threshold: float = 0.5, name: str = "function") -> DataFrame:
    """df with source_kind, ignored_runtime, pred_label, prediction, risk_level and top_reason of each function.

    Functions of the runtime and imports are hidden always, `main` never, nameless FUN_ and SUB_ ones if they are below
    the threshold and show no sign. A projection: no shuffle, any number of rows.
    """
    p, text = F.col(probability), F.coalesce(F.col(name).cast("string"), F.lit(""))
    columns = [c for c in df.columns if c not in (probability, name)]
    kind = F.when(text == "main", "user_candidate").otherwise(names.function_kind(F.col(name)))
    stub = F.upper(text).rlike("^(FUN_|SUB_)") & (p < threshold) & ~has_signal(columns, SIGNALS)
    df = df.withColumn("source_kind", F.when(stub, STUB).otherwise(kind))
    df = df.withColumn("ignored_runtime", F.col("source_kind").isin("compiler_runtime", "import_or_plt_api", STUB))
    label = (p >= threshold).cast("int")
    return df.withColumns({
        "pred_label": label, "prediction": F.when(label == 1, "VULNERABLE").otherwise("SAFE"), "risk_level": names.risk_level(p, threshold),
        "top_reason": reasons(columns, F.col("source_kind"), F.col("ignored_runtime")),
    })


def shown(results: DataFrame, flagged_only: bool = False) -> DataFrame:
    """Rows that are not hidden, or of these the flagged ones alone."""
    out = results.where("NOT ignored_runtime")
    return out.where("pred_label = 1") if flagged_only else out


def summary(results: DataFrame, probability: str = "prob_vulnerable") -> DataFrame:
    return results.agg(
        F.count("*").alias("n_functions"), F.coalesce(F.sum("pred_label"), F.lit(0)).alias("n_vulnerable"), F.count_if(F.col("risk_level") == "HIGH").alias("n_high"), F.max(probability).alias("max_probability"),
    )


def ordered_findings(findings: DataFrame) -> DataFrame:
    """Findings by risk, then by the probability of their function, highest first."""
    return findings.orderBy(risk_ordinal(F.col("finding_risk")), F.desc("function_probability"))


def with_final_scores(findings: DataFrame, finals: DataFrame, order: str) -> DataFrame:
    """Findings with the final probability of their function (function, prob_vulnerable; the last by order, where several
    stand); others keep the one they have."""
    last = finals.where("function IS NOT NULL").groupBy("function").agg(F.max_by("prob_vulnerable", order).alias("final"))
    return findings.join(last, "function", "left").withColumn("function_probability", F.coalesce("final", "function_probability")).drop("final")
