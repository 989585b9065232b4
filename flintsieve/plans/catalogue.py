"""Registered queries for the library's own operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flintsieve.plans import choice_queries, code_queries, context_queries, feature_queries, model_queries, program_queries, score_queries, selection_queries

_MODULES = (code_queries, context_queries, score_queries, feature_queries, model_queries, selection_queries, program_queries, choice_queries)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_queries.ranked_functions(spark, sf_dir)
