"""URL filters by hashed host-suffix and path-prefix expressions.

Each url is expanded into expressions (a suffix of its host at a label boundary, a prefix of its path); the
expressions meet the rules in an equi-join on a short hash prefix, full SHA-256 digests confirm each meeting, and the
longest rule wins. Only the label counts and path lengths that occur among the rules are expanded, so any rule path
(also one that ends inside a path segment) is found exactly and a url gives few expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hexadecimal digits of a digest that the join compares; the rest is compared afterwards.
SHORT = 8
#: Up to so many rules the rule side is broadcast (their number is counted first); beyond it the join shuffles.
BROADCAST_RULES = 20_000


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    """What follows the first ://; empty for null or where there is none."""
    at = F.locate("://", url)
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\x00"), path), 256)


def prepare_rules(rules: DataFrame) -> DataFrame:
    """(host, path, action) with digests; rules without a host or action are left out, a null path is empty.

    Where several rules name the same host and path, block wins.
    """
    return (
        rules.where("host IS NOT NULL AND host <> '' AND action IN ('allow', 'block')")
        .select(F.translate("host", UPPER, LOWER).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), "action")
        .groupBy("r_host", "r_path").agg(F.max("action").alias("action"))
        .withColumn("full", digest(F.col("r_host"), F.col("r_path"))).withColumn("short", F.left("full", F.lit(SHORT)))
    )


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict.

    Defined results: null urls and those without :// have empty host and path, no rule and the default verdict;
    repeated rows are judged each; an empty rule table gives the default everywhere. Columns of pages that are named
    host, path, rule or verdict are replaced.
    """
    pages = pages.drop("host", "path", "rule", "verdict").withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    ruled = prepare_rules(rules)
    shape = ruled.agg(
        F.count("*").alias("n"), F.collect_set(F.size(F.split("r_host", r"\."))).alias("labels"), F.collect_set(F.length("r_path")).alias("lengths"),
    ).first()
    # One row for each pair of host and path however many pages share it, so that a common host is expanded once.
    pairs = pages.select("host", "path").where("host <> ''").distinct()
    suffixes = [F.when(F.size(F.split("host", r"\.")) >= k, F.substring_index("host", ".", -k)) for k in sorted(shape["labels"])]
    prefixes = [F.when(F.length("path") >= n, F.left("path", F.lit(n))) for n in sorted(shape["lengths"])]
    if not suffixes or not prefixes:
        return pages.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    terms = (
        pairs.withColumn("suffix", F.explode(F.array_compact(F.array(*suffixes))))
        .withColumn("prefix", F.explode(F.array_compact(F.array(*prefixes))))
        .withColumn("t_full", digest(F.col("suffix"), F.col("prefix"))).withColumn("short", F.left("t_full", F.lit(SHORT)))
    )
    met = terms.join(F.broadcast(ruled) if shape["n"] <= BROADCAST_RULES else ruled, "short").where("t_full = full")
    best = met.groupBy("host", "path").agg(
        F.max(F.struct((F.length("r_host") + F.length("r_path")).alias("size"), F.length("r_host").alias("h"), F.concat("r_host", "r_path").alias("rule"), "action")).alias("best")
    ).select("host", "path", F.col("best.rule").alias("rule"), F.col("best.action").alias("verdict"))
    return pages.join(best, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))
