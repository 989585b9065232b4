"""Ensembles of model scores: weight grids, voting, meta features and gates."""

from __future__ import annotations

import functools
import itertools

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flintsieve.operators import metrics


def compositions(parts: int, steps: int) -> list[tuple[int, ...]]:
    """All ways to write steps as a sum of so many parts from 0, in ascending order."""
    return [c for c in itertools.product(range(steps + 1), repeat=parts - 1) if sum(c) <= steps for c in [(*c, steps - sum(c))]]


def weight_grid(spark: SparkSession, models: list[str], steps: int = 20, most: dict[str, float] | None = None) -> DataFrame:
    """(grid, w_<model>...) of all weights that are multiples of 1 / steps and sum to 1; most caps a model's weight."""
    rows = [c for c in compositions(len(models), steps) if all(c[models.index(m)] <= w * steps + 1e-9 for m, w in (most or {}).items())]
    names = ", ".join(f"w_{m} double" for m in models)
    return spark.createDataFrame([(i, *[x / steps for x in c]) for i, c in enumerate(rows)], f"grid long, {names}")


def vote(models: list[str]) -> Column:
    """Weighted sum of the models' scores p_<model> with the weights w_<model>."""
    return sum((F.col(f"w_{m}") * F.col(f"p_{m}") for m in models), F.lit(0.0))


def best_vote(scores: DataFrame, grid: DataFrame, models: list[str], floor: float | None = 0.95) -> DataFrame:
    """The best weights and threshold: rows that are alike in label and scores are counted first, each of these meets every
    weight (a fixed set of at most 1,771 rows, broadcast) and adds to a count of 182 buckets a weight before the shuffle."""
    alike = scores.groupBy("y", *[f"p_{m}" for m in models]).agg(F.count("*").alias("n_rows"))
    met = alike.crossJoin(F.broadcast(grid)).select("grid", "y", "n_rows", F.round(vote(models), 9).alias("p"))
    best = metrics.best_threshold(metrics.with_metrics(metrics.threshold_counts(met, ["grid"], n_rows="n_rows")), [], floor, ["grid", "threshold"])
    return best.join(grid, "grid")


# Votes that are searched, and the most that a model may weigh in any of them.
VOTES = {
    "WEIGHT_RF_XGB": ["rf", "xgb"], "WEIGHT_RF_DT": ["rf", "dt"], "WEIGHT_XGB_DT": ["xgb", "dt"], "WEIGHT_RF_XGB_DT": ["rf", "xgb", "dt"], "WEIGHT_ALL4": ["rf", "xgb", "dt", "lr"],
}
MOST_WEIGHT = {"lr": 0.10}


def best_votes(scores: DataFrame, votes: dict[str, list[str]] = VOTES, steps: int = 20, floor: float | None = 0.95) -> DataFrame:
    """recipe, weights (model to weight), threshold and counts of the best vote of each recipe."""
    parts = []
    for name, models in votes.items():
        grid = weight_grid(scores.sparkSession, models, steps, {m: w for m, w in MOST_WEIGHT.items() if m in models})
        best = best_vote(scores, grid, models, floor)
        weights = F.create_map(*[x for m in models for x in (F.lit(m), F.col(f"w_{m}"))])
        parts.append(best.select(F.lit(name).alias("recipe"), weights.alias("weights"), "threshold", "tp", "fp", "fn", "tn", "f1", "recall"))
    return functools.reduce(DataFrame.unionByName, parts)


def meta_features(scores: DataFrame, models: list[str], risks: list[str] = []) -> DataFrame:  # noqa: B006
    """scores with uncertainty of each model, difference and absolute difference of each pair, and signed logarithms."""
    p = {m: F.col(f"p_{m}") for m in models}
    out = {f"u_{m}": 1 - 2 * F.abs(c - 0.5) for m, c in p.items()}
    for a, b in itertools.combinations(models, 2):
        out |= {f"diff_{a}_{b}": p[a] - p[b], f"absdiff_{a}_{b}": F.abs(p[a] - p[b])}
    return scores.withColumns(out | {f"slog_{r}": F.signum(r) * F.log1p(F.abs(r)) for r in risks})


def closest_model(models: list[str], y: str = "y") -> Column:
    """Index of the model whose score is nearest to y; of equal ones the first."""
    d = [F.abs(F.col(f"p_{m}") - F.col(y)) for m in models]
    out = F
    for i in range(len(models)):
        out = out.when(d[i] <= F.least(*d), i)
    return out.otherwise(0)


def softmax_gate(meta: DataFrame, models: list[str], inputs: list[str], c: float = 0.35, y: str = "y"):
    """A multinomial model of which model is closest to y, on scaled inputs and with classes of equal weight; where only
    one model ever is, its index."""
    df = meta.withColumn("label", closest_model(models, y).cast("double"))
    sizes = {r["label"]: r["n"] for r in df.groupBy("label").agg(F.count("*").alias("n")).collect()}  # a row for each model
    if len(sizes) < 2:
        return int(next(iter(sizes), 0))
    n = sum(sizes.values())
    weight = F.coalesce(*[F.when(F.col("label") == k, n / (len(sizes) * v)) for k, v in sizes.items()])
    return Pipeline(stages=[
        VectorAssembler(inputCols=inputs, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True),
        LogisticRegression(labelCol="label", weightCol="weight", family="multinomial", maxIter=3000, regParam=1 / (c * n), standardization=False),
    ]).fit(df.withColumn("weight", weight))


def apply_softmax_gate(df: DataFrame, gate, models: list[str], out: str = "p") -> DataFrame:
    """df with the models' scores p_<model>, weighted by the gate's probability of each; classes it has not met weigh 0."""
    if isinstance(gate, int):
        return df.withColumn(out, F.col(f"p_{models[gate]}"))
    scored = gate.transform(df).withColumn("_w", vector_to_array("probability"))
    weights = [F.coalesce(F.get("_w", F.lit(i)), F.lit(0.0)) for i in range(len(models))]
    total = sum(weights, F.lit(0.0))
    p = sum((w * F.col(f"p_{m}") for w, m in zip(weights, models)), F.lit(0.0)) / F.when(total > 0, total).otherwise(1.0)
    return scored.withColumn(out, p).select(*df.columns, out)


def gated(a: Column, b: Column, gate: Column, least: float, most: float) -> Column:
    """Score of a pair: the gate's probability moves the weight of b between two bounds."""
    w = least + (most - least) * gate
    return w * b + (1 - w) * a


def fit_gate(train: DataFrame, a: str, b: str, inputs: list[str]):
    """A logistic model of whether b is closer to y than a; a number where only one answer occurs."""
    df = train.withColumn("label", (F.abs(F.col(b) - F.col("y")) < F.abs(F.col(a) - F.col("y"))).cast("double"))
    r = df.agg(F.min("label").alias("lo"), F.max("label").alias("hi")).first()
    if r["lo"] == r["hi"]:
        return float(r["lo"] or 0.0)
    return LogisticRegression(maxIter=50, regParam=0.001).fit(VectorAssembler(inputCols=inputs, outputCol="features").transform(df))


def apply_gate(df: DataFrame, gate, inputs: list[str], a: str, b: str, least: float, most: float, out: str = "p") -> DataFrame:
    if isinstance(gate, float):
        return df.withColumn(out, gated(F.col(a), F.col(b), F.lit(gate), least, most))
    scored = gate.transform(VectorAssembler(inputCols=inputs, outputCol="features").transform(df))
    return scored.withColumn(out, gated(F.col(a), F.col(b), vector_to_array("probability")[1], least, most)).select(*df.columns, out)


#: Pairs of least and most weight that gates are tried with.
GATE_BOUNDS = [(lo, hi) for lo in (0.0, 0.02, 0.05) for hi in (0.20, 0.35, 0.50, 0.65) if hi > lo]


def best_gate(scores: DataFrame, a: str, b: str, gate: Column, floor: float | None = 0.95, bounds: list[tuple[float, float]] = GATE_BOUNDS) -> DataFrame:
    """least, most and threshold of the best gated score of a pair on rows with label y, and its counts and metrics; `ok` says
    whether the recall reaches the floor. All bounds and thresholds are counted in one pass; ties go to the first bounds."""
    options = F.array(*[F.struct(F.lit(lo).alias("least"), F.lit(hi).alias("most")) for lo, hi in bounds])
    met = scores.select("y", F.col(a).alias("a"), F.col(b).alias("b"), gate.alias("g"), F.explode(options).alias("o"))
    p = F.round(F.col("o.least") + (F.col("o.most") - F.col("o.least")) * F.col("g"), 12)
    met = met.select("y", "o.least", "o.most", F.round(p * F.col("b") + (1 - p) * F.col("a"), 9).alias("p"))
    return metrics.best_threshold(metrics.with_metrics(metrics.threshold_counts(met, ["least", "most"])), [], floor, ["least", "most", "threshold"])
