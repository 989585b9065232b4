"""Nested documents as rows of named numbers, each by its own kinds: what one document holds never changes another's.

A document starts as one node. Each step replaces objects by their members and lists by their statistics or the objects in
them; there are as many steps as containers stand in each other, and all of them are one projection. Numbers found inside
objects of lists are then folded, innermost lists first, into statistics over the list's objects. Everything after the
projection works on partitions of whole documents, so rows are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flintsieve.functions.names import key_column
from flintsieve.operators.vectorize import COUNT_MAPS, TRANSPARENT, number

_NODE = "struct<kind:string,ctx:array<struct<list:string,at:int>>,name:string,v:variant,x:double,y:double>"


def _node(kind: str, ctx: Column, name: Column, v: Column | None = None, x: Column | None = None, y: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(F.lit(kind), ctx, name, none if v is None else v, none if x is None else x, none if y is None else y).cast(_NODE)


def _finite(v: Column) -> Column:
    x = number(v)
    return F.when(F.abs(x) < float("inf"), x)


def _joined(prefix: Column, name: Column) -> Column:
    return F.when(prefix == "", name).otherwise(F.concat(prefix, F.lit("_"), name))


def _object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _list(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _members(n: Column, members: Column) -> Column:
    """Nodes of an object's members (a map); text and empty names are left out."""

    def member(e: Column) -> Column:
        key, v = key_column(e["key"]), e["value"]
        name = _joined(n["name"], key)
        counts = F.try_element_at(F.create_map(*[F.lit(x) for kv in COUNT_MAPS.items() for x in kv]), F.lower(key))
        inner = F.when(key.isin(*TRANSPARENT), _node("object", n["ctx"], n["name"], v)).when(counts.isNotNull(), _node("map", n["ctx"], counts, v)).otherwise(_node("object", n["ctx"], name, v))
        return F.when(key == "", None).when(_list(v).isNotNull(), _node("list", n["ctx"], name, v)).when(_object(v).isNotNull(), inner).otherwise(_value(n, name, v))

    return F.filter(F.transform(F.map_entries(members), member), lambda x: x.isNotNull())


def _value(n: Column, name: Column, v: Column) -> Column:
    return F.when(_finite(v).isNotNull(), _node("value", n["ctx"], name, None, _finite(v)))


def _counts(n: Column) -> Column:
    """Values of a count map: its numbers, by the map's fixed beginning."""
    one = lambda e: _value(n, F.concat(n["name"], F.lit("_"), key_column(e["key"])), e["value"])
    return F.filter(F.transform(F.map_entries(_object(n["v"])), one), lambda x: x.isNotNull())


def _stats(ctx: Column, name: Column, n: Column, total: Column, high: Column, low: Column) -> list[Column]:
    return [_node("value", ctx, F.concat(name, F.lit(f"_{k}")), None, x) for k, x in (("count", n), ("sum", total), ("mean", total / n), ("max", high), ("min", low))]


def _items(n: Column) -> Column:
    """Of a list with a number: statistics of its numbers. Of others: how many elements, how many objects, and these."""
    all_, name, ctx = _list(n["v"]), n["name"], n["ctx"]
    xs = F.filter(F.transform(all_, _finite), lambda x: x.isNotNull())
    objects = F.filter(F.transform(all_, lambda v, i: F.when(_object(v).isNotNull(), _node("object", F.array_append(ctx, F.struct(name.alias("list"), i.alias("at"))), F.lit(""), v))), lambda x: x.isNotNull())
    numbers = F.array(*_stats(ctx, name, F.size(xs), F.aggregate(xs, F.lit(0.0), lambda a, x: a + x), F.array_max(xs), F.array_min(xs)))
    return F.when(F.size(xs) > 0, numbers).otherwise(F.concat(F.array(_node("items", ctx, name, None, F.size(all_), F.size(objects))), objects))


def depths(documents: DataFrame, column: str) -> tuple[int, int]:
    """How deep containers, and lists alone, stand in each other in any document."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.to_json(column), r"\\.", ""), '"[^"]*"', ""), r"[^\[\]{}]+", "")
    zero = F.lit(0)

    def step(s: Column, c: Column) -> Column:
        all_ = s["all"] + F.when(c.isin("[", "{"), 1).otherwise(-1)
        lists = s["lists"] + F.when(c == "[", 1).when(c == "]", -1).otherwise(0)
        return F.struct(all_.alias("all"), lists.alias("lists"), F.greatest(s["deep"], all_).alias("deep"), F.greatest(s["deep_lists"], lists).alias("deep_lists"))

    start = F.struct(zero.alias("all"), zero.alias("lists"), zero.alias("deep"), zero.alias("deep_lists"))
    most = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), start, step)
    row = documents.select(most.alias("d")).agg(F.max("d.deep"), F.max("d.deep_lists")).first()
    return row[0] or 0, row[1] or 0


def _folded(rows: DataFrame, depth: int) -> DataFrame:
    """Values inside the objects of lists at one depth become statistics over these objects, values of what the list is in."""
    here = F.size("ctx")
    inside, head = (F.col("kind") == "value") & (here == depth), (F.col("kind") == "items") & (here == depth - 1)
    once = rows.groupBy("row", "ids", "kind", "ctx", "name").agg(F.max("x").alias("x"), F.max("y").alias("y"))
    key = {
        "role": F.when(inside, "stat").when(head, "head").otherwise(F.col("kind")), "up": F.when(inside, F.slice("ctx", 1, depth - 1)).otherwise(F.col("ctx")),
        "list": F.when(inside, F.element_at("ctx", -1)["list"]).when(head, F.col("name")), "of": F.when(~head, F.col("name")),
    }
    g = once.groupBy("row", "ids", *[v.alias(k) for k, v in key.items()]).agg(F.count("x").alias("n"), F.sum("x").alias("sum"), F.max("x").alias("hi"), F.min("x").alias("lo"), F.max("y").alias("y"))
    any_ = F.max((F.col("role") == "stat").cast("int")).over(Window.partitionBy("row", "up", "list"))
    up, low = F.col("up"), F.col("list")
    stats = F.array(*_stats(up, F.concat(low, F.lit("_"), F.col("of")), F.col("n"), F.col("sum"), F.col("hi"), F.col("lo")))
    count = _node("value", up, F.concat(low, F.lit("_count")), None, F.col("hi"))
    heads = F.when(F.col("any") == 1, F.array(count, _node("value", up, F.concat(low, F.lit("_dict_count")), None, F.col("y")))).otherwise(F.array(count))
    same = F.array(F.struct(F.col("role"), up, F.col("of"), F.lit(None), F.col("hi"), F.col("y")).cast(_NODE))
    out = g.withColumn("any", any_).select("row", "ids", F.explode(F.when(F.col("role") == "stat", stats).when(F.col("role") == "head", heads).otherwise(same)).alias("n"))
    return out.select("row", "ids", "n.kind", "n.ctx", "n.name", "n.x", "n.y")


def numbers(documents: DataFrame, column: str, ids: list[str], members: list[str]) -> DataFrame:
    """(row, ids, name, x): every named number in these members of each document, and one row with its ids alone.

    A row's number is that of the input's partition and place, so the input has to come in a fixed order, as files do."""
    named = F.array(*map(F.lit, members))
    documents = documents.withColumn(column, F.map_filter(F.try_variant_get(column, "$", "map<string,variant>"), lambda k, _: F.array_contains(named, k)))
    deep, lists = depths(documents, column)
    no_ctx = F.array().cast("array<struct<list:string,at:int>>")
    root = F.concat(_members(_node("root", no_ctx, F.lit("")), F.col(column)), F.array(_node("ids", no_ctx, F.lit(None))))
    rows = documents.withColumn("row", F.monotonically_increasing_id()).select("row", F.struct(*[F.col(f"`{c}`") for c in ids]).alias("ids"), F.explode(root).alias("n"))
    rows = rows.withColumn("ids", F.when(F.col("n.kind") == "ids", F.col("ids")))
    n = F.col("n")
    for _ in range(deep - 1):
        step = F.when(n["kind"] == "object", _members(n, _object(n["v"]))).when(n["kind"] == "map", _counts(n)).when(n["kind"] == "list", _items(n)).otherwise(F.array(n))
        rows = rows.select("row", "ids", F.explode(step).alias("n"))
    rows = rows.where(n["kind"].isin("value", "items", "ids")).select("row", "ids", "n.kind", "n.ctx", "n.name", "n.x", "n.y").repartition("row")
    for depth in range(lists, 0, -1):
        rows = _folded(rows, depth)
    # Heads of lists without a number inside are counts of their own; names that meet keep the larger number.
    name = F.when(F.col("kind") == "items", F.concat("name", F.lit("_count"))).otherwise(F.col("name"))
    return rows.groupBy("row", "ids", name.alias("name")).agg(F.max("x").alias("x"))


def feature_names(found: DataFrame) -> list[str]:
    """All names, in order; their number is that of the features."""
    return [r["name"] for r in found.where("name IS NOT NULL").select("name").distinct().orderBy("name").collect()]


def wide(found: DataFrame, ids: list[str], known: list[str], features: list[str]) -> DataFrame:
    """A row for each document: its ids, then the known features (kept beside the ids) and the others, absent ones 0; a name in
    both has the larger number."""
    each = found.groupBy("row").agg(F.max("ids").alias("ids"), F.map_from_entries(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("name", "x")))).alias("m"))
    more = {f: F.coalesce(F.try_element_at("m", F.lit(f)), F.lit(0.0)) for f in features}
    both = {f: F.greatest(F.col(f"ids.`{f}`"), more.pop(f)) if f in more else F.col(f"ids.`{f}`") for f in known}
    return each.select(*[F.col(f"ids.`{c}`") for c in ids], *[c.alias(k) for k, c in (both | more).items()])
