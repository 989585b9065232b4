"""Checked inputs and weighted predictions of named recipes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flintsieve.functions.names import risk_level
from flintsieve.operators.vectorize import finite

#: Models by the name in a recipe, in the order in which recipes are offered.
ORDER = ["RandomForest", "DecisionTree", "XGBoost", "LogisticRegression"]


def prepare(df: DataFrame, features: list[str]) -> DataFrame:
    """The features in order as finite doubles. Errors: no feature, a name twice, a missing column, text that is no number."""
    if not features or len(set(features)) < len(features):
        raise ValueError("features are empty or repeated")
    if len(set(df.columns)) < len(df.columns):
        raise ValueError("column names are repeated")
    if lost := [c for c in features if c not in df.columns]:
        raise ValueError(f"missing: {', '.join(lost)}")
    text = [c for c, t in df.select(features).dtypes if t == "string"]
    if text:
        odd = df.agg(*[F.count_if(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()).alias(c) for c in text]).first()
        if names := [c for c in text if odd[c]]:
            raise ValueError(f"nonnumeric: {', '.join(names)}")
    return df.select(*[finite(F.col(c)).alias(c) for c in features])


def components(recipe: str, weights: dict[str, float] | None = None) -> dict[str, float]:
    """Weights by model: a base model has weight 1, a WEIGHT_ recipe its positive finite weights; others are an error."""
    if recipe in ORDER:
        return {recipe: 1.0}
    if recipe.startswith("WEIGHT_") and (out := {k: float(v) for k, v in (weights or {}).items() if v is not None and math.isfinite(v) and v > 0}):
        return out
    raise ValueError(f"Unsupported recipe: {recipe}")


def available(recipes: dict[str, dict[str, float]], loaded: set[str]) -> list[str]:
    """Recipes all of whose models are loaded; base models first, in ORDER."""
    def usable(name: str) -> bool:
        try:
            return components(name, recipes[name]).keys() <= loaded
        except ValueError:
            return False

    return sorted((n for n in recipes if usable(n)), key=lambda n: (ORDER.index(n) if n in ORDER else len(ORDER), n))


def predict(df: DataFrame, columns: dict[str, str], recipe: str, weights: dict[str, float] | None = None, threshold: float = 0.5) -> DataFrame:
    """df with the recipe's probability (weights are normalised), label 0/1, prediction and risk level. columns: score column of each loaded model."""
    parts = components(recipe, weights)
    if lost := [m for m in parts if m not in columns]:
        raise ValueError(f"Missing required: {', '.join(lost)}")
    total = sum(parts.values())
    p = sum((F.lit(w / total) * F.col(columns[m]) for m, w in parts.items()), F.lit(0.0))
    df = df.withColumn("prob_vulnerable", p)
    on = F.col("prob_vulnerable") >= threshold
    return df.withColumns({"pred_label": on.cast("int"), "prediction": F.when(on, "FLAGGED").otherwise("NOT_FLAGGED"), "risk_level": risk_level(F.col("prob_vulnerable"), threshold)})


def prediction_table(predicted: DataFrame, ids: list[str]) -> DataFrame:
    """The ids, probability and label of predictions, highest probability first, ties by the ids."""
    return predicted.select(*ids, "prob_vulnerable", "pred_label").orderBy(F.desc("prob_vulnerable"), *ids)
