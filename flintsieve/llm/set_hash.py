"""Document fingerprints by a homomorphic multiset hash, in DataFrame functions alone.

A document is the multiset of its paragraphs (lines). Each paragraph gives a wide vector, and a fingerprint is the sum
of its paragraphs' vectors, each component modulo a power of two. So the order of paragraphs plays no part, equal
multisets have equal fingerprints, and a paragraph is inserted or deleted by adding or subtracting its vector.

A vector has EXACT components modulo 2^32, hashed from the whole paragraph, which tell different multisets apart, and
2 * WORDS components modulo 2^31, which count 0/1 bits hashed from the paragraph's phrases (four words
each, counted from its beginning). No text has 2^31 phrases, so these counts are whole. The bits are fair and independent, so the squared distance of two sums estimates how many
phrases the documents do not share; likeness() is that estimate against the documents' own lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flintsieve.llm.common import partitions, range_bounds, range_of

#: 64-bit words of counts, of two components 32 bits apart: 30 from each of two hashes.
WORDS = 60
#: Ranges of doc_id for each partition of a shuffle.
RANGES = 8
#: Components of 32 bits hashed from whole paragraphs.
EXACT = 4
_BITS = sum(1 << 15 * i for i in range(4))
_COUNT = 0x7FFFFFFF
#: Hashes that are summed in four lanes of 15 bits before their counts are widened.
_RUN = 32_767
_PHRASE = r"(?:\S{1,64}+[ \t]*+){1,4}+"


def _lane_sums(hashes: str) -> Column:
    """30 words of counts over the hashes. A run of hashes fits four narrow lanes; the lanes of all runs are added in wide ones."""
    runs = f"transform(sequence(0, greatest(size({hashes}) - 1, 0) div {_RUN}), r -> slice({hashes}, cast(r * {_RUN} + 1 AS int), {_RUN}))"
    sums = f"transform({runs}, run -> transform(sequence(0, 14), k -> aggregate(run, 0L, (a, h) -> a + (shiftrightunsigned(h, k) & {_BITS}L))))"
    wide = lambda low: f"transform(s, w -> (shiftrightunsigned(w, {low}) & 32767L) + shiftleft(shiftrightunsigned(w, {low + 15}) & 32767L, 32))"
    return F.expr(f"aggregate({sums}, array_repeat(0L, 30), (t, s) -> zip_with(t, concat({wide(0)}, {wide(30)}), (x, y) -> x + y))")


def with_vector(df: DataFrame, text: Column, out: str = "vector") -> DataFrame:
    """df with the vector of a text: array<bigint> of the phrase count, EXACT and WORDS words; null counts as empty."""
    # explode keeps the optimiser from copying the hashes into each of the sums.
    one = F.struct(
        F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_PHRASE), F.lit(0)), lambda p: F.xxhash64(p)).alias("a"),
        F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda p: F.xxhash64(p)).alias("p"),
    )
    # The caller's columns stay inside one struct, so that none can clash with those made here.
    df = df.select(F.struct(*[c for c in df.columns if c.lower() != out.lower()]).alias("row"), F.explode(F.array(one)).alias("m"))
    two = F.struct(F.col("m.a").alias("a"), F.expr("transform(m.a, h -> xxhash64(h, 1))").alias("b"), F.col("m.p").alias("p"), F.expr("transform(m.p, h -> xxhash64(h, 2))").alias("q"))
    df = df.select("row", F.explode(F.array(two)).alias("m"))
    half = lambda x, shift: F.expr(f"aggregate({x}, 0L, (a, h) -> (a + (shiftrightunsigned(h, {shift}) & 4294967295L)) & 4294967295L)")
    vector = F.concat(F.array(F.size("m.a").cast("long"), half("m.p", 0), half("m.p", 32), half("m.q", 0), half("m.q", 32)), _lane_sums("m.a"), _lane_sums("m.b"))
    return df.select("row.*", vector.alias(out))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The vector of both multisets together, or with sign -1 of a without b."""
    add = lambda x, y, lanes: sum((((F.shiftrightunsigned(x, 32 * i).bitwiseAND(F.lit(_COUNT)) + F.lit(sign) * F.shiftrightunsigned(y, 32 * i).bitwiseAND(F.lit(_COUNT))).bitwiseAND(F.lit(_COUNT)) * F.lit(1 << 32 * i)) for i in range(2)), F.lit(0)) if lanes else (x + F.lit(sign) * y).bitwiseAND(F.lit(0xFFFFFFFF))
    at = lambda k, n: (F.slice(a, k, n), F.slice(b, k, n))
    return F.concat(
        F.zip_with(*at(1, 1), lambda x, y: x + F.lit(sign) * y),
        F.zip_with(*at(2, EXACT), lambda x, y: add(x, y, False)),
        F.zip_with(*at(2 + EXACT, WORDS), lambda x, y: add(x, y, True)),
    )


def fingerprint(vector: Column) -> Column:
    """The vector as hexadecimal text: the count and 32-bit components of 8 digits, then words of 16."""
    return F.concat(
        F.array_join(F.transform(F.slice(vector, 1, 1 + EXACT), lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), ""),
        F.array_join(F.transform(F.slice(vector, 2 + EXACT, WORDS), lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), ""),
    )


def _square(a: str, b: str | None = None) -> str:
    """SQL of the mean squared component of a (or of a - b), components being bits counted as -1 and 1."""
    n = f"element_at({a}, 1)" + (f" - element_at({b}, 1)" if b else "")
    # Components are known modulo 2^31, so twice one less n is known modulo 2^32; it is taken as the one nearest to 0.
    lane = lambda i: f"(shiftrightunsigned(x, {32 * i}) & {_COUNT}L)" + (f" - (shiftrightunsigned(y, {32 * i}) & {_COUNT}L)" if b else "")
    other = b or a
    return f"aggregate(zip_with(slice({a}, {2 + EXACT}, {WORDS}), slice({other}, {2 + EXACT}, {WORDS}), (x, y) -> " + " + ".join(f"pow(((2 * ({lane(i)}) - ({n}) + 2147483648L) & 4294967295L) - 2147483648L, 2)" for i in range(2)) + f"), 0D, (s, v) -> s + v) / {2 * WORDS}"


def likeness(a: str, b: str) -> Column:
    """0 to 1 from two vector columns: 1 less the squared distance against both squared lengths; 1 if both are equal."""
    return F.expr(f"CASE WHEN {a} = {b} THEN 1D ELSE greatest(0D, least(1D, coalesce(1 - try_divide({_square(a, b)}, {_square(a)} + {_square(b)}), 0D))) END")


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of docs (doc_id and the columns named) with a struct `next` of the following row's columns, in ascending
    order of doc_id and then of the columns; after the last row follows the first.

    Rows are dealt by ranges of doc_id, once; there are RANGES for each partition, which evens the partitions out. Each
    range also gets a copy of the row that begins the next one, so no window reaches over ranges, and no text passes the
    driver. Null ids come first.
    """
    bounds = range_bounds(docs, "doc_id", RANGES * partitions(docs.sparkSession))
    rows = docs.select("doc_id", *columns).withColumn("block", range_of(F.col("doc_id"), bounds))
    full = sorted(r["block"] for r in rows.select("block").distinct().collect())
    before = {b: full[i - 1] for i, b in enumerate(full)}
    first = rows.groupBy("block").agg(F.min(F.struct("doc_id", *columns)).alias("r")).select("r.*", F.element_at(F.create_map(*(F.lit(x) for kv in before.items() for x in kv)), F.col("block")).alias("block")) if full else rows.limit(0)
    both = rows.withColumn("copy", F.lit(0)).unionByName(first.withColumn("copy", F.lit(1)))
    order = Window.partitionBy("block").orderBy("copy", "doc_id", *columns)
    return both.withColumn("next", F.lead(F.struct(*columns)).over(order)).where("copy = 0").drop("copy", "block")


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """For each document: its length and fingerprint; those of its edited text, whose last half is replaced by the
    beginning of the next document; and the likeness to the edited text and to the next document.

    Defined results: null texts count as empty; repeated rows are fingerprinted each, and rows of one doc_id follow each
    other by their texts; null ids come first; an empty table gives no rows; other columns are not read. Texts may have
    any length.
    """
    rows = with_next(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("t")), ["t"])
    n = F.length("t")
    cut = (n / 2).cast("int")
    rows = rows.select("doc_id", "t", F.col("next.t").alias("u"), n.cast("long").alias("n_chars")).withColumn("e", F.concat(F.left("t", n - cut), F.left("u", cut)))
    rows = with_vector(rows.withColumn("edited_sha256", F.sha2("e", 256)), F.col("e"), "ve").drop("e")
    rows = with_vector(with_vector(rows, F.col("t"), "vt").drop("t"), F.col("u"), "vu").drop("u")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("vt")).alias("fingerprint"), fingerprint(F.col("ve")).alias("edited_fingerprint"),
        likeness("vt", "ve").alias("near_edited"), likeness("vt", "vu").alias("near_next"),
    )
