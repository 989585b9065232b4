"""Aggregates of instructions, control flow and calls of functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of operands that refer to the stack, and beginnings of mnemonics that write.
STACK_WORDS = ["rbp", "rsp", "ebp", "esp", "local_", "stack_", "austack", "acstack", "aistack"]
WRITING = ["mov", "stos", "rep"]

def histogram(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A map of counts of the lower-cased values of each key."""
    each = df.groupBy(*keys, F.lower(value).alias("k")).agg(F.count("*").alias("n"))
    return each.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "n")))).alias("counts"))


def instruction_counts(instructions: DataFrame, keys: list[str], mnemonic: str = "mnemonic") -> DataFrame:
    m = F.lower(mnemonic)
    kinds = {
        "instruction_count": F.lit(True), "call_instruction_count": F.contains(m, F.lit("call")), "branch_count": m.startswith("j") | m.isin("b", "bl"),
        "conditional_branch_count": m.startswith("j") & (m != "jmp"), "compare_count": m.isin("cmp", "test"), "lea_count": m == "lea",
    }
    return instructions.groupBy(*keys).agg(*[F.count_if(c).alias(k) for k, c in kinds.items()])


def stack_accesses(instructions: DataFrame, keys: list[str], mnemonic: str = "mnemonic", operands: str = "operands") -> DataFrame:
    """For each key: instructions whose operands refer to the stack, and those of them that look like writes."""
    text, m = F.lower(F.coalesce(operands, F.lit(""))), F.lower(mnemonic)
    any_of = lambda test, words: F.exists(F.array(*map(F.lit, words)), test)
    stack = any_of(lambda w: F.contains(text, w), STACK_WORDS)
    writes = any_of(lambda w: F.startswith(m, w), WRITING)
    return instructions.groupBy(*keys).agg(F.count_if(stack).alias("stack_mem_access_count"), F.count_if(stack & writes).alias("stack_write_like_count"))


def distinct_offsets(accesses: DataFrame, keys: list[str], offset: Column) -> DataFrame:
    """Ascending distinct offsets of each key, and how many there are."""
    return accesses.groupBy(*keys).agg(F.sort_array(F.collect_set(offset)).alias("offsets")).withColumn("n_offsets", F.size("offsets").cast("long"))


def cyclomatic(blocks: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Blocks, edges and max(1, edges - blocks + 2) of each key of blocks."""
    b, e = blocks.groupBy(key).agg(F.count("*").alias("blocks")), edges.groupBy(key).agg(F.count("*").alias("edges"))
    df = b.join(e, key, "left").withColumn("edges", F.coalesce("edges", F.lit(0)))
    return df.withColumn("cyclomatic", F.greatest(F.lit(1), F.col("edges") - F.col("blocks") + 2))


def call_degrees(edges: DataFrame, internal: DataFrame) -> DataFrame:
    """For each node of internal (column node): distinct callees and callers, internal and external callees, and the
    share of external ones. edges: src, dst; targets that are no node are external."""
    e = edges.select("src", "dst").distinct().join(internal.select(F.col("node").alias("dst"), F.lit(True).alias("inside")), "dst", "left")
    out = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("callee_count"), F.count_if("inside").alias("internal_callee_count"))
    into = e.where("inside").groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("caller_count"))
    df = internal.select("node").join(out, "node", "left").join(into, "node", "left").fillna(0)
    df = df.withColumn("external_callee_count", F.col("callee_count") - F.col("internal_callee_count"))
    return df.withColumn("external_callee_ratio", F.when(F.col("callee_count") > 0, F.col("external_callee_count") / F.col("callee_count")).otherwise(0.0))
