"""Secrets: base patterns, and tokens that look random to character Markov models. DataFrame functions only.

Two first-order Markov models over the characters of ALPHABET are trained: one from the values that the base patterns
found in all documents (random strings), one from ordinary words and identifiers of a bounded sample of documents,
outside those spans. A long token with both letters and digits is a span of kind `random` if its mean log-likelihood
ratio for each step is at least RATIO.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flintsieve.llm.common import written
from flintsieve.llm.spans import apart, by_start, find_all, listed, of_kind

KINDS = ["assign", "access", "hex", "random"]
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)"""
# The lengths stand in the patterns: a run that is too short at its beginning is shorter at any later place.
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
#: What may be a random token, and the characters of the models; others end a token.
TOKEN = r"[A-Za-z0-9+/_-]{20,}+"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
#: Documents that the model of ordinary tokens is trained on, about; the least mean log-likelihood ratio of a step, between
#: what held-out random tokens and held-out identifiers have.
SAMPLE, RATIO = 2000, 0.55
#: Pairs seen of a first character from which its own counts weigh more than the second character's share.
PRIOR = 20


def base_spans(text: Column) -> Column:
    assign = F.filter(find_all(text, ASSIGN, "assign"), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 1)) >= 6)
    return F.concat(assign, find_all(text, ACCESS, "access"), find_all(text, HEX, "hex"))


def _steps(token: str) -> str:
    return f"transform(sequence(1, greatest(length({token}) - 1, 1)), i -> substring({token}, i, 2))"


def markov_ratios(random: DataFrame, ordinary: DataFrame) -> list[float] | None:
    """Log-likelihood ratios of each pair of ALPHABET, row by row, from two tables with a column token.

    Rare pairs lean on how common their second character is. None if either sample has no step.
    """
    both = random.select(F.lit(1).alias("label"), "token").unionByName(ordinary.select(F.lit(0).alias("label"), "token")).where("length(token) > 1")
    inside = F.col("pair").rlike(r"^[A-Za-z0-9+/_-]{2}$")
    # At most two counts for each pair of characters of a fixed alphabet.
    rows = both.select("label", F.explode(F.expr(_steps("token"))).alias("pair")).where(inside).groupBy("label", "pair").agg(F.count("*").alias("n")).collect()
    n, size = {(r["label"], r["pair"]): r["n"] for r in rows}, len(ALPHABET)
    if len({r["label"] for r in rows}) < 2:
        return None
    row = {(k, a): sum(n.get((k, a + b), 0) for b in ALPHABET) for k in (0, 1) for a in ALPHABET}
    whole = {k: sum(row[k, a] for a in ALPHABET) for k in (0, 1)}
    alone = {(k, b): (sum(n.get((k, a + b), 0) for a in ALPHABET) + 1) / (whole[k] + size) for k in (0, 1) for b in ALPHABET}
    p = lambda k, a, b: (n.get((k, a + b), 0) + PRIOR * alone[k, b]) / (row[k, a] + PRIOR)
    return [math.log(p(1, a, b) / p(0, a, b)) for a in ALPHABET for b in ALPHABET]


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `spans`: the base spans and random-looking tokens that touch none of them.

    Defined results: a null text has none; repeated rows get the same spans each; where either sample is empty, as in
    an empty table, only base spans are found; a column named spans is replaced, other names cannot clash; null ids and
    ties play no part; a very long text costs time in proportion.
    """
    columns = [c for c in docs.columns if c.lower() != "spans"]
    clean = F.coalesce(text, F.lit(""))
    long = F.filter(find_all(clean, TOKEN, "random"), lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]"))
    # The caller's columns stay inside one struct, so that none can clash with those made here.
    rows = written(docs.select(F.struct(*columns).alias("row"), base_spans(clean).alias("base"), long.alias("long")), "secrets")
    values = rows.select(F.explode("base").alias("s")).select(F.when(F.col("s.kind") == "assign", F.regexp_extract("s.value", ASSIGN, 1)).otherwise(F.col("s.value")).alias("token"))
    n, own = rows.count(), F.col("row")[text]
    some = rows.where(F.pmod(F.xxhash64(own), F.lit(1 << 20)) < math.ceil(min(1.0, SAMPLE / max(n, 1)) * (1 << 20)))
    words = some.where("size(base) = 0").select(F.explode(F.regexp_extract_all(F.coalesce(own, F.lit("")), F.lit(r"[A-Za-z0-9+/_-]{4,}+"), F.lit(0))).alias("token"))
    # Long tokens with a digit before a letter are what is to be judged, and no sample of ordinary ones.
    words = words.where(~((F.length("token") >= 20) & F.col("token").rlike("[0-9].*[A-Za-z]")))
    ratios = markov_ratios(values.where(F.col("token").rlike("[0-9]")), words)
    base = F.col("base")
    spans = base if ratios is None else F.concat(base, F.filter(apart(F.col("long"), F.array_sort(F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))), lambda s: likely_random(s["value"], ratios)))
    return rows.select("row.*", by_start(spans, KINDS).alias("spans"))


def likely_random(token: Column, ratios: list[float]) -> Column:
    # Sixteenth parts as whole numbers in one literal text keep the plan small: four characters for each pair.
    table = F.lit("".join(f"{max(-999, min(999, round(16 * x))) + 1000:04d}" for x in ratios))
    size = len(ALPHABET)
    place = lambda i: F.call_function("locate", F.substring(token, i, F.lit(1)), F.lit(ALPHABET)) - 1
    value = lambda i: F.substring(table, (place(i) * size + place(i + 1)) * 4 + 1, F.lit(4)).cast("int") - 1000
    total = F.aggregate(F.sequence(F.lit(1), F.length(token) - 1), F.lit(0), lambda a, i: a + value(i))
    return total / (16 * (F.length(token) - 1)) >= RATIO


def digests(docs: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return find_secrets(docs.select("doc_id", "text")).select(
        "doc_id", *[of_kind(F.col("spans"), k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), of_kind(F.col("spans"), "random").alias("n_random"),
    )
