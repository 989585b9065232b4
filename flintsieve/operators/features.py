"""From program documents to feature rows, and members of nested rows by name."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flintsieve.operators import unnest
from flintsieve.operators.vectorize import flatten


def one_kind(kind: T.DataType) -> bool:
    """Whether a type holds no variant, and no two names that differ in case only."""
    if isinstance(kind, T.ArrayType):
        return one_kind(kind.elementType)
    if isinstance(kind, T.StructType):
        return len({f.name.lower() for f in kind.fields}) == len(kind.fields) and all(one_kind(f.dataType) for f in kind.fields)
    return not isinstance(kind, T.VariantType)


def merged_schema(programs: DataFrame, column: str) -> str:
    """All members that any row's variant has; names that differ in case only stay apart, whatever the session's rule is."""
    conf = programs.sparkSession.conf
    before = conf.get("spark.sql.caseSensitive")
    conf.set("spark.sql.caseSensitive", "true")
    try:
        return programs.agg(F.schema_of_variant_agg(column)).first()[0] or ""
    finally:
        conf.set("spark.sql.caseSensitive", before)


def program_features(programs: DataFrame, ids: list[str], features: list[str] | None = None) -> DataFrame:
    """The ids and the features of each function f of programs, absent ones 0; features named like an id are left out.

    features: the wanted ones in order, or None for all that any function has. The schema of all functions comes from one
    partial aggregation. Members of one kind in all functions are flattened by it, where they lie. Members whose kinds, or
    the kinds of what they hold, differ between functions or within a list are taken apart row by row instead, so that each
    function's features follow from that function alone; where none is such, nothing is shuffled."""
    found = merged_schema(programs, "f")
    df = programs.withColumn("typed", F.try_variant_get("f", "$", found.replace("OBJECT<", "STRUCT<").replace("VOID", "STRING")) if found.startswith("OBJECT<") else F.struct())
    kinds = df.schema["typed"].dataType
    often = Counter(f.name.lower() for f in kinds.fields)
    same = [f for f in kinds.fields if often[f.name.lower()] == 1 and one_kind(f.dataType)]
    odd = [f.name for f in kinds.fields if f not in same]
    flat = {k: c for k, c in flatten(T.StructType(same), F.col("typed")).items() if k not in ids}
    if not odd:
        return df.select(*ids, *[flat.get(k, F.lit(0.0)).alias(k) for k in (flat if features is None else features)])
    found = unnest.numbers(df.select(*ids, *[c.alias(k) for k, c in flat.items()], "f"), "f", [*ids, *flat], odd)
    names = unnest.feature_names(found.persist()) if features is None else features
    out = unnest.wide(found, ids, list(flat), [k for k in names if k not in ids])
    return out if features is None else out.select(*ids, *features)


def strings_and_numbers(schema: T.StructType, at: Column | None = None, path: tuple[str, ...] = ()) -> dict[str, Column]:
    """Members of a nested schema by their joined names, as they are: text, numbers, flags and lists; structs are opened."""
    out: dict[str, Column] = {}
    for f in schema.fields:
        c = F.col(f"`{f.name}`") if at is None else at[f.name]
        if isinstance(f.dataType, T.StructType):
            out |= strings_and_numbers(f.dataType, c, (*path, f.name))
        else:
            out["_".join((*path, f.name))] = c
    return out


def first_match(members: dict[str, Column], wanted: list[str]) -> Column:
    """The first member that is neither null nor empty text: those of the wanted names in their order, then those whose name
    has a wanted name in it, in the order of the members. 0 and false are values. As text."""
    lower = {k.lower(): c for k, c in members.items()}
    exact = [lower[w.lower()] for w in wanted if w.lower() in lower]
    part = [c for w in wanted for k, c in lower.items() if w.lower() in k]
    picked = [F.nullif(c.cast("string"), F.lit("")) for c in exact + part]
    return F.coalesce(*picked) if picked else F.lit(None).cast("string")
