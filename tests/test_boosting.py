"""Second-order boosting against a plain NumPy version, round by round."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flintsieve.operators import boosting, trees


def plain(x, y, ids, rounds, rule, positive):
    margin = np.full(len(y), math.log(positive * (y == 1).sum() / (y == 0).sum()))
    soft = lambda g: math.copysign(max(abs(g) - rule.l1, 0), g)
    for t in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        w = np.where(y == 1, positive, 1.0)
        g, h = w * (p - y), w * p * (1 - p)
        seen = boosting.sees(t, ids, rule)
        columns = boosting.columns_of(t, x.shape[1], rule).tolist()

        def grow(all_, level):
            m = all_ & seen  # noqa: B023
            score = lambda q: soft(g[q].sum()) ** 2 / (h[q].sum() + rule.l2)  # noqa: E731, B023
            best = (1e-9, None, None)
            if level < rule.depth:
                for f in columns:  # noqa: B023
                    for c in np.unique(x[:, f])[:-1]:
                        a, b = m & (x[:, f] <= c), m & (x[:, f] > c)
                        if h[a].sum() >= rule.least and h[b].sum() >= rule.least and (gain := (score(a) + score(b) - score(m)) / 2) > best[0] + 1e-12:  # noqa: B023
                            best = (gain, f, c)
            if best[1] is None:
                step[all_] = -rule.step * soft(g[m].sum()) / (h[m].sum() + rule.l2)  # noqa: B023
            else:
                grow(all_ & (x[:, best[1]] <= best[2]), level + 1)
                grow(all_ & (x[:, best[1]] > best[2]), level + 1)

        step = np.zeros(len(y))
        grow(np.ones(len(y), bool), 0)
        margin = margin + step
    return 1 / (1 + np.exp(-margin))


@pytest.mark.parametrize("kept", [20, 1])
def test_equals_numpy_for_three_rounds(spark, monkeypatch, kept):
    monkeypatch.setattr(boosting, "KEPT", kept)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1000, 5)).round(1)
    y = (x[:, 0] * x[:, 1] + 0.4 * x[:, 2] > rng.normal(size=1000) * 0.5 + 0.3).astype(int)
    df = spark.createDataFrame([(i, int(t), *map(float, r)) for i, (t, r) in enumerate(zip(y, x))], "id long, label int, a double, b double, c double, d double, e double").repartition(3)
    rule = boosting.Boost(depth=3, step=0.3, columns=0.8)
    model = boosting.fit_boosted(df, list("abcde"), rounds=3, rule=rule, bins=128, key=["id"])
    rows = model.score(df.withColumn("hash", F.xxhash64("id"))).orderBy("id").collect()
    bins = trees.binned(x, model.edges).astype(int)
    want = plain(bins, y, np.array([r["hash"] for r in rows]), 3, rule, (y == 0).sum() / (y == 1).sum())
    assert [r["p"] for r in rows] == pytest.approx(want, abs=1e-9)
    assert len({len(t.feature) for t in model.trees} | {1}) > 1


def test_learns_and_odd_input(spark):
    df = spark.range(600).select("id", (F.col("id") % 7).cast("double").alias("x"), F.when(F.col("id") % 7 > 3, 1).otherwise(0).alias("label"))
    model = boosting.fit_boosted(df, ["x"], rounds=15, rule=boosting.Boost(step=0.3), key=["id"])
    assert model.score(df).where("(p > 0.5) <> (label = 1)").isEmpty()
    one = boosting.fit_boosted(df.where("label = 1"), ["x"], rounds=2)
    assert not one.trees and {r["p"] for r in one.score(df.limit(3)).collect()} == {1.0}
    assert boosting.fit_boosted(df.where("false"), ["x"], rounds=2).score(df.limit(3)).where("p = 0.5").count() == 3


def test_few_jobs_for_each_round_and_pairs_give_the_same_trees(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 4)).round(1)
    y = (x[:, 0] * x[:, 1] + x[:, 2] > rng.normal(size=900) * 0.5).astype(int)
    df = spark.createDataFrame([(i, int(t), *map(float, r)) for i, (t, r) in enumerate(zip(y, x))], "id long, label int, a double, b double, c double, d double")
    rule, jobs, models = boosting.Boost(step=0.3, least=0.1), [], []
    for rounds in (2, 6):
        group = f"boosting {rounds}"
        spark.sparkContext.setJobGroup(group, group)
        models.append(boosting.fit_boosted(df, list("abcd"), rounds=rounds, rule=rule, bins=16, key=["id"]))
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
    spark.sparkContext.setJobGroup("", "")
    # Five levels of a tree are three jobs.
    assert jobs[1] - jobs[0] <= 4 * 3 and max(len(t.feature) for t in models[1].trees) > 31
    monkeypatch.setattr(boosting, "SENT_BYTES", 0)
    alone = boosting.fit_boosted(df, list("abcd"), rounds=6, rule=rule, bins=16, key=["id"])
    assert [[getattr(t, n).tolist() for n in ("feature", "cut", "left", "weights")] for t in alone.trees] == [[getattr(t, n).tolist() for n in ("feature", "cut", "left", "weights")] for t in models[1].trees]
