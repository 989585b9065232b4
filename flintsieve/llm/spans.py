"""Spans of regular-expression matches as arrays, in SQL functions alone; positions are code points, ends exclusive.

An array that grows inside a fold is copied at each step. So folds run over blocks of BLOCK elements, and over what the
blocks come to; a text may have very many matches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<kind: string, start: int, end: int, value: string>>"
BLOCK = 256


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def blocks(values: Column) -> Column:
    """The array, which should be a bound one, in parts of BLOCK elements; an empty one has one empty part."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(values) - 1, F.lit(0)) / BLOCK).cast("int")), lambda r: F.slice(values, r * BLOCK + 1, F.lit(BLOCK)))


def running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """For each of an array of integers, what step makes of 0 and all before it (step must be associative)."""
    start = lambda kind: F.struct(F.lit(0).alias("end"), F.array().cast(kind).alias("out"))
    one = lambda part: F.aggregate(part, start("array<int>"), lambda a, x: F.struct(step(a["end"], x).alias("end"), F.concat(a["out"], F.array(a["end"])).alias("out")))
    whole = lambda v: F.aggregate(
        F.transform(blocks(v), one), start("array<array<int>>"),
        lambda a, b: F.struct(step(a["end"], b["end"]).alias("end"), F.concat(a["out"], F.array(F.transform(b["out"], lambda x: step(a["end"], x)))).alias("out")),
        lambda a: F.flatten(a["out"]),
    )
    return bound(values, whole)


def starts(sizes: Column) -> Column:
    """Sums of the sizes before each place."""
    return running(sizes, lambda a, x: a + x)


def find_all(text: Column, pattern: str, kind: str) -> Column:
    """Leftmost non-overlapping matches in order, as SPANS; empty where there are none.

    Spark gives the matches and the texts between them, but no positions: these are running sums of lengths. Texts
    without a match cost one search.
    """
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("n"), m.alias("m")))
    placed = lambda p: F.zip_with(p, starts(F.transform(p, lambda x: x["g"] + x["n"])), lambda x, s: F.struct(
        F.lit(kind).alias("kind"), (s + x["g"]).alias("start"), (s + x["g"] + x["n"]).alias("end"), x["m"].alias("value")))
    return F.when(text.rlike(pattern), bound(F.filter(pairs, lambda x: x["m"].isNotNull()), placed)).otherwise(F.array().cast(SPANS)).cast(SPANS)


def apart(spans: Column, others: Column) -> Column:
    """Those of the spans, ordered by start and apart from each other, that touch none of the others."""

    def one(part: Column, every: Column) -> Column:
        near = F.filter(every, lambda o: (o["start"] < F.element_at(part, -1)["end"]) & (F.element_at(part, 1)["start"] < o["end"]))
        return bound(near, lambda n: F.filter(part, lambda s: ~F.exists(n, lambda o: (s["start"] < o["end"]) & (o["start"] < s["end"]))))

    kept = lambda s, every: F.when((F.size(s) == 0) | (F.size(every) == 0), s).otherwise(F.flatten(F.transform(blocks(s), lambda part: one(part, every))))
    return bound(spans, lambda s: bound(others, lambda every: kept(s, every)))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def by_start(spans: Column, kinds: list[str]) -> Column:
    """Spans by start, then by the place of their kind in a list."""
    return F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), F.array_position(F.array(*map(F.lit, kinds)), s["kind"]).alias("b"), s.alias("s")))), lambda x: x["s"])


def by_kind(spans: Column, kinds: list[str]) -> Column:
    """Spans by the place of their kind in a list, then by start."""
    return F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(F.array_position(F.array(*map(F.lit, kinds)), s["kind"]).alias("b"), s["start"].alias("a"), s.alias("s")))), lambda x: x["s"])


def of_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def replaced(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; spans that overlap become one, of the first's kind."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("e"), s["kind"].alias("kind"))))
    # Each span with the end of all before it; the first of those that overlap stands for all.
    reached = lambda v: F.zip_with(v, running(F.transform(v, lambda s: -s["e"]), lambda a, x: F.greatest(a, x)), lambda s, at: F.struct(at.alias("at"), s["start"].alias("start"), s["kind"].alias("kind")))
    heads = F.filter(bound(ordered, reached), lambda s: s["start"] >= s["at"])
    cut = lambda begin, end: F.substring(text, begin + 1, end - begin)

    def one(part: Column) -> Column:
        begin = F.element_at(part, 1)["at"]
        piece = lambda t: F.array_join(F.transform(part, lambda s: F.concat(F.substring(t, s["at"] - begin + 1, s["start"] - s["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))), "")
        return bound(cut(begin, F.element_at(part, -1)["start"]), piece)

    tail = F.substring(text, F.array_max(F.transform(spans, lambda s: s["end"])) + 1, F.length(text))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(bound(heads, lambda h: F.array_join(F.transform(blocks(h), one), "")), tail))
