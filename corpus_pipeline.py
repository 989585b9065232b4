"""From raw documents to token ids: five stages, each written as Parquet and read again before the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flintsieve.llm import bpe, decontaminate, jaccard_join, language_id, pii
from flintsieve.llm.common import documents, fresh, written
from flintsieve.llm.queries import vocabulary


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language cannot be told: without text or without a letter.

    Null ids and ties play no part, repeated rows fare alike, an empty table stays empty, further columns are kept (also
    such as are named lang_pred or score)."""
    models = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"))), vocabulary("piece_bpe_32k.model"))
    if not models:  # no labelled row: there is nothing to reject by but the letters
        return docs.where(F.col("text").rlike(r"\p{L}"))
    # A column of docs that identify() would replace is set aside.
    aside = dict(zip(clash := [c for c in docs.columns if c.lower() in ("lang_pred", "score")], fresh(docs, *[f"kept_{c}" for c in clash])))
    found = language_id.identify(docs.withColumnsRenamed(aside), models).where(F.col("lang_pred") != language_id.UNDETERMINED)
    return found.drop("lang_pred", "score").withColumnsRenamed({v: k for k, v in aside.items()}).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies (five words, similarity 0.8): that of the smallest doc_id, null ids last.

    Of repeated rows one stays; texts without a word, and null ones, stay; an empty table stays empty."""
    return jaccard_join.without_near_copies(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a benchmark item stands. Null and empty texts stay, repeated rows fare alike, ids and
    further columns play no part, an empty table of either side drops nothing."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Generalises personal data in every text to its kind; n_chars follows the text, where there is such a column.

    No row goes: null and empty texts stay as they are, repeated rows are changed alike, and ids play no part."""
    out = pii.sanitised(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether decoding gives the text back; null and empty texts have none, rows stay in number."""
    out = bpe.encode_checked(docs, vocabulary("byte_bpe_50k.json"))
    return out.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), "whole")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language), ("near copies", near_copies), ("leaks", leaks), ("personal data", personal_data), ("token ids", token_ids),
]
#: Fitted models, groups of near copies and BPE are not for SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
