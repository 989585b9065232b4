"""Evidence from decompiled C text as column expressions: no row leaves its partition and nothing is exploded here."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from flintsieve.functions import constants as C


def lines(text: Column) -> Column:
    """Lines of a text without empty ones at the end; an empty or null text has none."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"\R+\z", "")
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, r"\R"))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value made once however often it is used, also within functions of elements."""
    return F.element_at(F.transform(F.array(value), use), 1)


def in_list(api: Column, names: list[str]) -> Column:
    return F.coalesce(api.isin(*names), F.lit(False))


def symbol(name: Column) -> Column:
    """A call's name without stub marks, leading underscores and version."""
    bare = F.regexp_replace(F.replace(F.trim(F.coalesce(name, F.lit(""))), F.lit("j_"), F.lit("")), "^_+", "")
    return F.substring_index(F.substring_index(bare, "@@", 1), "@", 1)


def type_bytes(name: Column) -> Column:
    low, out = F.lower(name), F
    for word, n in C.TYPE_BYTES:
        out = out.when(F.contains(low, F.lit(word)), n)
    return out.otherwise(1).cast("long")


def hex_or_decimal(digits: Column) -> Column:
    hexadecimal = F.lower(digits).startswith("0x")
    return F.when(hexadecimal, F.try_to_number(F.conv(F.substring(digits, 3, 64), 16, 10), F.lit("99999999999999999999")).cast("long")).otherwise(digits.try_cast("long"))


def stack_offset(name: Column) -> Column:
    """Offset from a frame register, or the negative hexadecimal part of a stack name; null if there is neither."""
    low = F.replace(F.lower(F.coalesce(name, F.lit(""))), F.lit(" "), F.lit(""))
    filled = lambda c: once(c, lambda v: F.nullif(v, F.lit("")))
    signed = F.coalesce(filled(F.regexp_extract(low, r"\b(?:r|e)?bp([+-](?:0x[0-9a-f]+|\d+))", 1)), filled(F.regexp_extract(low, r"\b(?:r|e)?sp([+-](?:0x[0-9a-f]+|\d+))", 1)))
    named = filled(F.regexp_extract(low, r"(?:local|stack|austack|acstack|aistack)_([0-9a-f]+)", 1))
    size = lambda v: hex_or_decimal(F.substring(v, 2, 64))
    return F.coalesce(once(signed, lambda v: F.when(v.startswith("-"), -size(v)).otherwise(size(v))), -once(named, lambda v: hex_or_decimal(F.concat(F.lit("0x"), v))))


def buffers(text: Column) -> Column:
    """array<struct<name, datatype, element_count, element_size, byte_size, stack_offset>> of local array declarations
    of positive size; of equal names the first."""
    get = lambda g: F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(C.BUFFER), F.lit(g))
    zipped = F.arrays_zip(get(1).alias("t"), get(2).alias("n"), get(3).alias("c"))
    made = F.transform(
        zipped,
        lambda x: F.struct(
            x["n"].alias("name"), F.trim(F.regexp_replace(x["t"], r"\s+", " ")).alias("datatype"), hex_or_decimal(x["c"]).alias("element_count"),
            type_bytes(x["t"]).alias("element_size"), (hex_or_decimal(x["c"]) * type_bytes(x["t"])).alias("byte_size"), stack_offset(x["n"]).alias("stack_offset"),
        ),
    )
    kept = F.filter(made, lambda x: x["element_count"] > 0)
    named = once(kept, lambda k: F.struct(k.alias("kept"), F.transform(k, lambda y: y["name"]).alias("names")))
    return once(named, lambda s: F.filter(s["kept"], lambda x, i: F.array_position(s["names"], x["name"]) == i + 1))


def buffer_of(found: Column, name: Column) -> Column:
    """The buffer of a name, or null."""
    return F.get(F.filter(found, lambda b: b["name"] == name), 0)


def arguments(inside: Column) -> Column:
    """Arguments between the parentheses of a call: split at commas outside parentheses and quotes, trimmed; a last
    empty piece is none."""
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("quote"), F.lit(False).alias("esc"), F.lit("").alias("now"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, c: Column) -> Column:
        quoted = s["quote"] != ""
        cut = ~quoted & (c == ",") & (s["depth"] == 0)
        quote = F.when(s["esc"], s["quote"]).when(quoted & (c == s["quote"]), F.lit("")).when(~quoted & c.isin('"', "'"), c).otherwise(s["quote"])
        depth = F.when(quoted, s["depth"]).when(c == "(", s["depth"] + 1).when(c == ")", F.greatest(s["depth"] - 1, F.lit(0))).otherwise(s["depth"])
        return F.struct(
            depth.alias("depth"), quote.alias("quote"), (quoted & (c == "\\") & ~s["esc"]).alias("esc"), F.when(cut, F.lit("")).otherwise(F.concat(s["now"], c)).alias("now"),
            F.when(cut, F.array_append(s["out"], F.trim(s["now"]))).otherwise(s["out"]).alias("out"),
        )

    chars = F.filter(F.split(inside, ""), lambda c: c != "")
    return F.aggregate(chars, start, step, lambda s: F.when(F.trim(s["now"]) == "", s["out"]).otherwise(F.array_append(s["out"], F.trim(s["now"]))))


def argument_at(args: Column, at: Column) -> Column:
    """The argument at a place from 0; empty where there is none or the place is -1."""
    return F.when(at >= 0, F.coalesce(F.get(args, at), F.lit(""))).otherwise("")


def role(api: Column, k: int) -> Column:
    """Place of the destination (0), source (1) or size (2) argument of a call; -1 if it has none."""
    out = F
    for places, names in C.ROLES.items():
        out = out.when(api.isin(*names), places[k])
    return out.otherwise(-1)


def variable(expr: Column) -> Column:
    """The first name of an expression, without address, index and member parts."""
    x = F.regexp_replace(F.trim(F.coalesce(expr, F.lit(""))), r"[&*]", "")
    x = F.substring_index(F.substring_index(F.regexp_replace(x, r"\[[^\]]+\]", ""), ".", 1), "->", 1)
    return F.regexp_extract(x, r"\b([A-Za-z_]\w*)\b", 1)


def literal_length(expr: Column) -> Column:
    """Length of the first string literal as written; null if there is none."""
    e = F.coalesce(expr, F.lit(""))
    return F.when(e.rlike(C.LITERAL), F.length(F.regexp_extract(e, C.LITERAL, 1)).cast("long"))


def source_origin(expr: Column, found: Column, params: Column) -> Column:
    """What a source argument is: literal, parameter, input_like, local_buffer, macro_or_global, local_or_unknown or unknown."""
    e = F.trim(F.coalesce(expr, F.lit("")))
    v = variable(e)
    any_word = F.exists(F.array(*map(F.lit, C.INPUT_WORDS)), lambda w: F.contains(F.lower(e), w))
    return (
        F.when(literal_length(e).isNotNull(), "literal").when(F.array_contains(params, v), "parameter").when(any_word, "input_like")
        .when(F.exists(found, lambda b: b["name"] == v), "local_buffer").when(v.rlike(r"^[A-Z_][A-Z0-9_]*$"), "macro_or_global")
        .when(v != "", "local_or_unknown").otherwise("unknown")
    )


def within_brackets(expr: Column) -> Column:
    """An expression without the casts before it and the pairs of parentheses around it, in any number and order.

    One pass: what opens at the beginning and what closes at the end are counted, and of the pairs as many stand around the
    whole as the depth in between never falls below."""
    count = lambda x, c: F.length(x) - F.length(F.replace(x, F.lit(c)))

    def step(s: Column, c: Column) -> Column:
        now = s["now"] + F.when(c == "(", 1).otherwise(-1)
        return F.struct(now.alias("now"), F.least(s["low"], now).alias("low"))

    def parted(e: Column) -> Column:
        head = F.regexp_extract(e, "^[\\s(\u0001]*", 0)
        return F.struct(head.alias("head"), F.substring(e, F.length(head) + 1, F.length(e)).alias("rest"))

    def counted(s: Column) -> Column:
        tail = F.regexp_extract(F.reverse(s["rest"]), r"^[\s)]*", 0)
        return F.struct(s["head"].alias("head"), F.left(s["rest"], F.length(s["rest"]) - F.length(tail)).alias("core"), count(s["head"], "(").alias("opened"), count(tail, ")").alias("closed"))

    def deep(s: Column) -> Column:
        brackets = F.filter(F.split(F.regexp_replace(s["core"], "[^()]+", ""), ""), lambda c: c != "")
        depth = F.aggregate(brackets, F.struct(s["opened"].alias("now"), s["opened"].alias("low")), step)
        return F.struct(*[s[k].alias(k) for k in ("head", "core", "opened", "closed")], depth.alias("depth"))

    def stripped(s: Column) -> Column:
        opened, closed, depth = s["opened"], s["closed"], s["depth"]
        pairs = F.when(depth["now"] == closed, F.greatest(F.lit(0), F.least(opened, closed, depth["low"]))).otherwise(0)
        left = F.when(opened > pairs, F.concat(F.lit("("), F.call_function("substring_index", s["head"], F.lit("("), pairs - opened))).otherwise("")
        return F.trim(F.concat(left, s["core"], F.repeat(F.lit(")"), closed - pairs)))

    # A cast becomes one character, which no expression has. Each step works on what the last one named, so none is done twice.
    out = F.array(F.regexp_replace(F.coalesce(expr, F.lit("")), C.CAST, "\u0001"))
    for part in (parted, counted, deep, stripped):
        out = F.transform(out, part)
    return F.element_at(out, 1)


def size_value(expr: Column, dst: Column, dst_size: Column) -> Column:
    """Value of a size expression that is a signed sum of numbers, sizeof(dst) being dst_size; else, or below 0, null. Casts
    before it and parentheses around it do not matter."""
    sized = lambda e: F.when((dst != "") & (dst_size > 0), F.regexp_replace(e, F.concat(F.lit(r"(?i)\bsizeof\s*(?:\(\s*&?\s*"), dst, F.lit(r"\s*\)|\s+"), dst, F.lit(r"\b)")), dst_size.cast("string"))).otherwise(e)
    number = lambda t: hex_or_decimal(F.regexp_replace(t, "^[+-]", ""))
    value = lambda t: F.when(t.startswith("-"), -number(t)).otherwise(number(t))
    terms = lambda bare: F.regexp_extract_all(bare, F.lit(r"[+-]?(?:0[xX][0-9a-fA-F]+|\d+)"), F.lit(0))
    total = lambda bare: F.aggregate(F.transform(terms(bare), value), F.lit(0).cast("long"), lambda a, x: a + x)
    bare = F.regexp_replace(once(within_brackets(expr), sized), r"\s+", "")
    return once(bare, lambda b: F.when(b.rlike(C.SUM), once(total(b), lambda t: F.when(t >= 0, t))))


def window(ls: Column, at: Column, before: int) -> Column:
    """Up to so many lines before a place (from 0), joined, each with a line end."""
    first = F.greatest(at - before, F.lit(0))
    return F.array_join(F.transform(F.slice(ls, first + 1, at - first), lambda x: F.concat(x, F.lit("\n"))), "")


def guard(text: Column, dst: Column, src: Column, size: Column) -> Column:
    """struct of guard flags and quality of the text before a call."""
    low = F.lower(text)
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    mentions = lambda v: F.coalesce((v != "") & F.contains(low, F.lower(v)), F.lit(False))
    quoted = lambda v: F.concat(F.lit(r"\s*\(\s*\Q"), F.lower(v), F.lit(r"\E\s*\)"))
    tests = {
        "has_if_before": F.contains(low, F.lit("if")), "has_compare_before": has(["<", ">", "==", "!="]), "has_len_check_before": has(C.LENGTH_WORDS), "bound_word": has(C.BOUND_WORDS),
        "guard_mentions_dst": mentions(dst), "guard_mentions_src": mentions(src), "guard_mentions_size_arg": mentions(size),
        "guard_uses_strlen_src": F.coalesce((src != "") & F.regexp_like(low, F.concat(F.lit(r"\b(?:strlen|wcslen|strnlen|wcsnlen)"), quoted(src))), F.lit(False)),
        "guard_uses_sizeof_dst": F.coalesce((dst != "") & F.regexp_like(low, F.concat(F.lit(r"\bsizeof"), quoted(dst))), F.lit(False)),
    }
    t = tests
    checked = t["has_if_before"] & (t["has_compare_before"] | t["has_len_check_before"] | t["bound_word"])
    weight = lambda c, w: F.when(c, F.lit(w)).otherwise(F.lit(0.0))
    quality = (
        weight(checked, 1.0) + weight(t["has_compare_before"], 1.0) + weight(t["guard_mentions_dst"], 1.5) + weight(t["guard_mentions_src"], 1.5) + weight(t["guard_mentions_size_arg"], 1.0)
        + weight(t["has_len_check_before"], 1.0) + weight(t["guard_uses_strlen_src"], 1.5) + weight(t["guard_uses_sizeof_dst"], 1.5) + weight(t["bound_word"], 0.5)
    )
    named = t["guard_mentions_dst"] | t["guard_mentions_src"] | t["guard_mentions_size_arg"] | t["guard_uses_strlen_src"] | t["guard_uses_sizeof_dst"]
    return F.struct(*[v.alias(k) for k, v in tests.items() if k != "bound_word"], checked.alias("has_guard_before"), quality.alias("guard_quality"), ((quality >= 4) & named).alias("high_guard"), F.right(text, F.lit(400)).alias("guard_text"))
