"""Queries that train, stack and stream. Learned scores have no SQL; windows do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flintsieve.operators import boosting, ensemble, models, split, trees
from flintsieve.plans import adapters
from flintsieve.plans.adapters import table
from flintsieve.streaming import screen

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
KEY = ["l_orderkey", "l_linenumber"]


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").withColumn("label", F.when(F.col("l_returnflag") == "R", 1).otherwise(0))
    return split.group_split(df, "l_suppkey", "label")


def _dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows' keys, labels, partitions and features, dealt out to all tasks and kept: models read them many times."""
    columns = dict.fromkeys([*KEY, "label", "partition", *FEATURES])
    return _rows(spark, sf_dir).select(*columns).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *KEY).persist()


def _trained(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _dealt(spark, sf_dir)
        model = models.train(df.where("partition = 'train'"), FEATURES, name)
        return models.scored(model, df.where("partition = 'test'"), "p").select(*KEY, "label", "p")

    return query


def train_rf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """300 trees, each on a bootstrap balanced by itself."""
    df = _dealt(spark, sf_dir)
    forest = trees.fit_forest(df.where("partition = 'train'"), FEATURES, "label", models.TREES, depth=15, key=KEY)
    return forest.score(df.where("partition = 'test'")).select(*KEY, "label", "p")


def train_dt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tree of 20 levels with two rows in a leaf at least, on all features and rows."""
    df = _dealt(spark, sf_dir)
    tree = trees.fit_forest(df.where("partition = 'train'"), FEATURES, "label", 1, per_split=len(FEATURES), bootstrap=False, depth=20, key=KEY, least=2)
    return tree.score(df.where("partition = 'test'")).select(*KEY, "label", "p")


def train_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """450 rounds of second-order boosting, trees of 5 levels."""
    df = _dealt(spark, sf_dir)
    model = models.Pipeline(stages=[boosting.Boosting(FEATURES, key=KEY)]).fit(df.where("partition = 'train'"))
    return model.transform(df.where("partition = 'test'")).select(*KEY, "label", "p")


def stack_lr(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = split.group_split(adapters.scores(spark, sf_dir), "grp", "y")
    inputs = ["p_rf", "p_xgb", "p_dt", "p_lr"]
    model = models.stack(df.where("partition = 'meta'"), inputs)
    return models.scored(model, df.where("partition = 'select'"), "p").select("l_orderkey", "l_linenumber", "y", "p")


def gate_lr(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = split.group_split(adapters.scores(spark, sf_dir), "grp", "y")
    inputs = ["p_rf", "p_xgb"]
    gate = ensemble.fit_gate(df.where("partition = 'meta'"), "p_rf", "p_xgb", inputs)
    return ensemble.apply_gate(df.where("partition = 'select'"), gate, inputs, "p_rf", "p_xgb", 0.0, 0.5).select("l_orderkey", "l_linenumber", "y", "p")


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screen.window_counts(table(spark, sf_dir, "events"))


QUERIES = {
    "train_lr": _trained("LogisticRegression"), "train_dt": train_dt, "train_rf": train_rf, "train_gbt": train_gbt,
    "stack_lr": stack_lr, "gate_lr": gate_lr, "event_windows": event_windows,
}
SQL = {"event_windows": "SELECT time_bucket(INTERVAL '10 minutes', ts) AS start, count(*) AS n, count(*) FILTER (value >= 80) AS n_high FROM events GROUP BY ALL"}
