"""Personal data: base patterns, and information-theoretic sanitisation of terms that reveal it. DataFrame functions only.

Protected entities are the values that the base patterns find. For each entity e and each word t of a line with it, the
corpus tells how much of the entity's information the word discloses: PMI(t; e) / IC(e), where IC(e) = -log2 p(e) and
probabilities are shares of all lines of all documents (a very long line counts as several). It is 1 if every line with
t has e, and 0 if both are
independent. A word that discloses at least DISCLOSED, seen with the entity in at least SUPPORT different lines, is a
span of kind `term` wherever it shares a line with the entity. Sanitising generalises each span to its kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flintsieve.llm.common import fresh, written
from flintsieve.llm.spans import SPANS, apart, by_kind, find_all, listed, of_kind, replaced

KINDS = ["email", "ip", "card", "phone", "term"]
#: The share of an entity's information from which a term is removed, and the different lines that must show it.
DISCLOSED, SUPPORT = 0.8, 3
#: Terms: words of so many letters at least.
TERM = r"\p{L}{4,}+"
#: Lines, those of over 2,000 characters in stretches, cut at white space where there is any.
LINE = r"[^\n]{1,2000}(?=\s|$)|[^\n]{1,2000}"
# Each is the plain pattern with possessive parts, which changes no match: a run that fails at its beginning fails at
# any later place, so it is tried once and the time stays in proportion to the text.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9]){15,}+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    at = lambda i: F.substring(_digits(value), -i, F.lit(1)).cast("int")
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    return F.aggregate(F.sequence(F.lit(1), F.length(_digits(value))), F.lit(0), lambda a, i: a + F.when(i % 2 == 0, twice(at(i))).otherwise(at(i))) % 10 == 0


def _small(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+", "")
    return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))


def base_spans(text: Column) -> Column:
    """Spans of the four base kinds, by kind and start; matches that fail their test are dropped."""
    email = find_all(text, EMAIL, "email")
    ip = F.filter(find_all(text, IP, "ip"), lambda s: F.forall(F.split(s["value"], r"\."), _small))
    card = F.filter(find_all(text, CARD, "card"), lambda s: F.when(F.length(_digits(s["value"])).between(16, 19), _luhn(s["value"])).otherwise(False))
    phone = F.filter(find_all(text, PHONE, "phone"), lambda s: F.length(_digits(s["value"])).between(8, 15))
    return F.concat(email, ip, card, phone)


def find_personal(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `spans`: the base spans and the terms that the corpus shows to reveal them.

    Defined results: a null text has none; repeated rows get the same spans each; an empty table stays empty; a column
    named spans is replaced, other names cannot clash; null ids and ties play no part; a very long text costs time in
    proportion. Base spans are found in one pass and written to the shared folder with the rows; all counting works on
    the few lines that have an entity, but for the terms' own frequencies, which are counted over all lines of all
    documents.
    """
    columns = [c for c in docs.columns if c.lower() != "spans"]
    # The caller's columns stay inside one struct, so that none can clash with those made here.
    rows = written(docs.select(F.struct(*columns).alias("row"), base_spans(F.coalesce(text, F.lit(""))).alias("base"), F.monotonically_increasing_id().alias("id")), "personal")
    own = F.coalesce(F.col("row")[text], F.lit(""))
    near = (
        rows.where("size(base) > 0").select("id", F.explode(find_all(own, LINE, "line")).alias("x")).select("id", "x.start", F.col("x.value").alias("line"), base_spans(F.col("x.value")).alias("inside")).where("size(inside) > 0")
        .select("id", "line", "start", F.transform("inside", lambda s: s["value"]).alias("values"), apart(find_all(F.col("line"), TERM, "term"), F.col("inside")).alias("words"))
        .select("id", "line", F.array_distinct("values").alias("entities"), F.expr("transform(words, w -> struct('term' AS kind, w.start + start AS start, w.end + start AS end, lower(w.value) AS value))").alias("words"))
    )
    terms = disclosing_terms(rows.select(own.alias("text")), near)
    hits = (
        near.select("id", F.explode("entities").alias("entity"), "words").join(terms.groupBy("entity").agg(F.collect_set("term").alias("terms")), "entity")
        .select("id", F.explode(F.filter("words", lambda w: F.array_contains("terms", w["value"]))).alias("w"))
        .groupBy("id").agg(F.array_sort(F.collect_set("w")).cast(SPANS).alias("terms"))
    )
    # Rows without an entity have nothing to join; they are not shuffled.
    none = F.array().cast(SPANS)
    plain = rows.where("size(base) = 0").select("row.*", none.alias("spans"))
    found = rows.where("size(base) > 0").join(hits, "id", "left").select("row.*", by_kind(F.concat("base", F.coalesce("terms", none)), KINDS).alias("spans"))
    return plain.unionByName(found)


def disclosing_terms(texts: DataFrame, near: DataFrame) -> DataFrame:
    """(entity, term) whose disclosure and support suffice. texts: all texts; near: lines with `entities` and `words`."""
    shown = near.select(F.xxhash64("line").alias("h"), "words", F.explode("entities").alias("entity"))
    entities = shown.groupBy("entity").agg(F.count("*").alias("n_e"), F.count_distinct("h").alias("d_e")).where(F.col("d_e") >= SUPPORT)
    together = (
        shown.join(entities.select("entity"), "entity", "left_semi")
        .select("entity", "h", F.explode(F.array_distinct("words.value")).alias("term"))
        .groupBy("entity", "term").agg(F.count("*").alias("n_te"), F.count_distinct("h").alias("d_te")).where(F.col("d_te") >= SUPPORT)
        .join(entities, "entity")
    )
    together = written(together, "together")
    if together.isEmpty():
        return together.select("entity", "term")
    # Each task sends a count for each of its words, and nothing for each line.
    each = F.regexp_extract_all("text", F.lit(LINE), F.lit(0))
    words = F.array_distinct(F.regexp_extract_all(F.lower("line"), F.lit(TERM), F.lit(0)))
    counts = texts.select(F.explode(each).alias("line")).select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    total = texts.select(F.sum(F.size(each)).alias("n")).first()["n"] or 1
    pmi = F.log2(F.col("n_te") * F.lit(float(total)) / (F.col("n_t") * F.col("n_e")))
    return together.join(counts, "term").where(pmi >= DISCLOSED * -F.log2(F.col("n_e") / F.lit(float(total)))).select("entity", "term")


def sanitised(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each span of a text generalised to its kind, like [EMAIL]; other columns and null texts are kept, but for a
    column named spans, which comes back as it was."""
    (kept,) = fresh(docs, "kept")
    renamed = [c for c in docs.columns if c.lower() == "spans"]
    found = find_personal(docs.withColumnsRenamed({c: kept for c in renamed}), text)
    found = found.withColumn(text, replaced(F.col(text), F.col("spans")))
    return found.drop("spans").withColumnsRenamed({kept: c for c in renamed}).select(docs.columns)


def digests(docs: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["kind"] != "term")
    return find_personal(docs.select("doc_id", "text")).select(
        "doc_id", *[of_kind(F.col("spans"), k).alias(f"n_{k}") for k in KINDS[:4]], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), of_kind(F.col("spans"), "term").alias("n_term"),
    )
