"""Training of the base models and stacking, with Spark ML.

Trees use histogram bins and at most 30 levels, and boosting has no L1/L2 terms: learned scores differ from those of
other libraries, and are compared by their range only.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flintsieve.operators import metrics

SEED = 42
#: Trees of a random forest, as trained.
TREES = 300


def balanced(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """Weights that give both classes the same total."""
    r = df.agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("p")).first()
    pos, neg = max(r["p"], 1), max(r["n"] - r["p"], 1)
    return df.withColumn(out, F.when(F.col(label) == 1, r["n"] / (2 * pos)).otherwise(r["n"] / (2 * neg)))


def base_models(n_rows: int, trees: int = TREES, rounds: int = 450) -> dict[str, object]:
    """Untrained classifiers by name, on `features`, `label` and `weight`."""
    common = {"featuresCol": "features", "labelCol": "label", "weightCol": "weight"}
    return {
        "LogisticRegression": LogisticRegression(maxIter=3000, regParam=1 / max(n_rows, 1), standardization=False, **common),
        "DecisionTree": DecisionTreeClassifier(maxDepth=20, minInstancesPerNode=2, maxBins=64, seed=SEED, **common),
        "RandomForest": RandomForestClassifier(numTrees=trees, maxDepth=15, featureSubsetStrategy="sqrt", maxBins=64, seed=SEED, **common),
        "XGBoost": GBTClassifier(maxIter=rounds, maxDepth=5, stepSize=0.035, subsamplingRate=0.9, maxBins=64, seed=SEED, **common),
    }


def checkpoints(spark: SparkSession) -> None:
    """Lets boosting cut its lineage, as each round's errors follow from the round's before: without a folder every task of a
    round names all rounds. Where none is set, and Spark runs in one process, it is a folder of our own."""
    context, named = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if not context.getCheckpointDir() and (named or re.match(r"local($|\[)", context.master)):
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="flintsieve-"))


def train(df: DataFrame, features: list[str], name: str, label: str = "label", **size: int) -> PipelineModel:
    """One base model with its assembler (and scaler), trained on balanced rows."""
    df = balanced(df.withColumn("label", F.col(label).cast("double")))
    checkpoints(df.sparkSession)
    stages = [VectorAssembler(inputCols=features, outputCol="raw" if name == "LogisticRegression" else "features", handleInvalid="error")]
    if name == "LogisticRegression":
        stages.append(StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True))
    return Pipeline(stages=[*stages, base_models(df.count(), **size)[name]]).fit(df)


def scored(model: PipelineModel, df: DataFrame, out: str) -> DataFrame:
    """df with the probability of class 1."""
    return model.transform(df).withColumn(out, vector_to_array("probability")[1]).select(*df.columns, out)


def stack(meta: DataFrame, inputs: list[str], c: float = 0.5) -> PipelineModel:
    """Logistic regression over base scores (and risk columns), fitted on the meta partition."""
    df = balanced(meta.withColumn("label", F.col("y").cast("double")))
    n = max(df.count(), 1)
    return Pipeline(stages=[
        VectorAssembler(inputCols=inputs, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True),
        LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", regParam=1 / (c * n), standardization=False),
    ]).fit(df)


def best_stacks(meta: DataFrame, select: DataFrame, inputs: list[str], risks: list[str], floor: float = 0.95) -> DataFrame:
    """recipe, threshold, counts and metrics of stacks with and without risk columns: fitted on the meta rows, thresholds chosen
    on the select rows. A stack that no threshold brings to the recall floor is refused (`ok` is false)."""
    found = []
    for recipe, columns in (("STACK_LOGISTIC_PROB_ONLY", inputs), ("STACK_LOGISTIC_PROB_RISK", [*inputs, *risks])):
        rows = scored(stack(meta, columns), select, "p").select("y", F.round("p", 9).alias("p"))
        best = metrics.best_threshold(metrics.with_metrics(metrics.threshold_counts(rows, [])), [], floor)
        found.append(best.select(F.lit(recipe).alias("recipe"), *best.columns))
    return found[0].unionByName(found[1])
