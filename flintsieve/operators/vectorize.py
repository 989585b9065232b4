"""From nested evidence to flat numeric features. Flattening follows the schema, so it is one projection without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flintsieve.functions.names import key_name

#: Containers whose name is no part of a feature's name; maps whose keys follow a fixed beginning.
TRANSPARENT = {"features", "feature_vector", "numeric_features"}
COUNT_MAPS = dict.fromkeys(["pcode", "pcode_counts", "pcode_count"], "pcode") | dict.fromkeys(["mnemonic", "mnemonics", "mnemonic_counts", "opcode", "opcode_counts"], "mnemonic")
STATS = ["count", "sum", "mean", "max", "min"]


def finite(c: Column) -> Column:
    """A double; null, NaN, infinite and non-numeric values are 0."""
    x = c.try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def number_stats(values: Column, nonzero: bool = False) -> dict[str, Column]:
    """Statistics over the present elements of an array of numbers; all are 0 if there is none."""
    x = F.filter(F.transform(values, lambda v: v.cast("double")), lambda v: v.isNotNull() & ~F.isnan(v))
    n, total = F.coalesce(F.size(x), F.lit(0)), F.coalesce(F.aggregate(x, F.lit(0.0), lambda a, v: a + v), F.lit(0.0))
    out = {"count": n.cast("double"), "sum": total, "mean": F.when(n > 0, total / n).otherwise(0.0), "max": F.coalesce(F.array_max(x), F.lit(0.0)), "min": F.coalesce(F.array_min(x), F.lit(0.0))}
    if nonzero:  # share of elements that are not 0: an assumption, as the name alone is given
        out["nonzero"] = F.when(n > 0, F.size(F.filter(x, lambda v: v != 0)) / n).otherwise(0.0)
    return out


def number(c: Column) -> Column:
    """A variant's number or flag as a double; text and other kinds are null."""
    kind = F.schema_of_variant(c)
    return F.when(kind == "BOOLEAN", F.try_variant_get(c, "$", "boolean").cast("double")).when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(c, "$", "double"))


def flatten(schema: T.StructType, at: Column | None = None, path: tuple[str, ...] = (), maps: dict[str, list[str]] | None = None, nonzero: bool = False, leaf=finite) -> dict[str, Column]:
    """Feature columns of a nested schema: numbers and flags as doubles, arrays as statistics (members of their structs at
    any depth), keys of count maps; text is ignored, and of variants all but numbers. maps names the wanted keys of maps
    by the beginning of the feature's name; count maps that are structs have their keys in the schema."""
    out: dict[str, Column] = {}
    for f in schema.fields:
        c = F.col(f"`{f.name}`") if at is None else at[f.name]
        here = path if f.name in TRANSPARENT else (*path, key_name(f.name))
        name, kind, counts = "_".join(here), f.dataType, COUNT_MAPS.get(f.name.lower())
        if _numeric(kind):
            out[name] = leaf(_number_of(c, kind))
        elif isinstance(kind, T.StructType) and counts:
            out |= {f"{counts}_{key_name(g.name)}": leaf(_number_of(c[g.name], g.dataType)) for g in kind.fields if _numeric(g.dataType)}
        elif isinstance(kind, T.StructType):
            out |= flatten(kind, c, here, maps, nonzero, leaf)
        elif isinstance(kind, T.MapType) and counts:
            out |= {f"{counts}_{key_name(k)}": leaf(F.try_element_at(c, F.lit(k))) for k in (maps or {}).get(counts, [])}
        elif isinstance(kind, T.ArrayType):
            out |= {f"{name}_{k}": v if leaf is finite else F.when(c.isNotNull(), v) for k, v in _list_features(c, kind.elementType, nonzero).items()}
    return out


def _list_features(c: Column, e: T.DataType, nonzero: bool) -> dict[str, Column]:
    """Statistics of an array: of its numbers, or of each number within its structs; of others their count."""
    count = F.coalesce(F.size(c), F.lit(0)).cast("double")
    if _numeric(e):
        return number_stats(F.transform(c, lambda v: _number_of(v, e)), nonzero)
    if not isinstance(e, T.StructType):
        return {"count": count}
    out = {"count": count}
    within = lambda v: flatten(e, v, (), None, False, _present)
    member = lambda name: lambda v: within(v)[name]
    names = list(within(F.col("x")))
    for name in names:
        out |= {f"{name}_{k}": s for k, s in number_stats(F.transform(c, member(name)), nonzero).items()}
    # Objects are counted only where one of them has a number.
    objects = F.coalesce(F.size(F.filter(c, lambda v: v.isNotNull())), F.lit(0)).cast("double")
    any_ = [v for k, v in out.items() if k.endswith("_count") and k[: -len("_count")] in names]
    return out | ({"dict_count": F.when(F.greatest(F.lit(0.0), *any_) > 0, objects).otherwise(0.0)} if any_ else {})


def _numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType | T.BooleanType | T.VariantType)


def _number_of(c: Column, kind: T.DataType) -> Column:
    return number(c) if isinstance(kind, T.VariantType) else c.cast("int") if isinstance(kind, T.BooleanType) else c


def _present(c: Column) -> Column:
    """A finite double, or null."""
    x = c.try_cast("double")
    return F.when(F.abs(x) < float("inf"), x)


def align(df: DataFrame, ids: list[str], features: list[str]) -> DataFrame:
    """Ids, then exactly the features in their order: missing ones are 0, others are dropped, values made finite."""
    have = {c for c in df.columns}
    return df.select(*[c for c in ids if c in have], *[(finite(F.col(f"`{c}`")) if c in have else F.lit(0.0)).alias(c) for c in features])


def nonzero_report(df: DataFrame, features: list[str]) -> DataFrame:
    """Rows, features, and mean and total number of values that are not 0."""
    per = sum((F.when(finite(F.col(c)) != 0, 1).otherwise(0) for c in features), F.lit(0))
    return df.select(per.alias("n")).agg(F.count("*").alias("rows"), F.lit(len(features)).cast("long").alias("features"), F.avg("n").alias("mean_nonzero"), F.sum("n").alias("total_nonzero"))


def first_present(*names: Column) -> Column:
    """The first name that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in names], F.lit(""))
