"""Own trees: against a plain recursion, whatever the number of rows that a task grows alone, and on planted features."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flintsieve.operators import select, trees


def gini(w):
    return 2 * w[0] * w[1] / sum(w) if sum(w) else 0.0


def plain(x, y, own):
    """The best tree on whole bins by recursion: nested (feature, cut, low, high), or the weights of a leaf."""
    weight = lambda m: (own[0] * (m & (y == 0)).sum(), own[1] * (m & (y == 1)).sum())

    def below(m):
        w = weight(m)
        best = None
        if min(w) > 0:
            for f in range(x.shape[1]):
                for c in sorted(set(x[m, f]))[:-1]:
                    g = gini(w) - gini(weight(m & (x[:, f] <= c))) - gini(weight(m & (x[:, f] > c)))
                    if best is None or g > best[0] + 1e-9:
                        best = (g, f, c)
        if best is None:
            return w
        _, f, c = best
        return f, c, below(m & (x[:, f] <= c)), below(m & (x[:, f] > c))

    return below(np.ones(len(x), bool))


def share(tree, row):
    while len(tree) == 4:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[1] / sum(tree)


def table(spark, n=600, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)).round(2)
    y = (x[:, 0] + 0.5 * x[:, 1] * x[:, 0] > rng.normal(size=n) * 0.3).astype(int)
    return spark.createDataFrame([(k, int(t), *map(float, r)) for k, (t, r) in enumerate(zip(y, x))], "id long, label int, a double, b double, c double, d double").repartition(3), x, y


NAMES = ["a", "b", "c", "d"]


@pytest.mark.parametrize("local", [10_000, 50])
def test_one_tree_equals_a_plain_recursion(spark, local):
    df, x, y = table(spark, 250)
    forest = trees.fit_forest(df, NAMES, trees=1, per_split=4, bootstrap=False, bins=16, local=local)
    bins = trees.binned(x, forest.edges)
    own = [len(y) / 2 / (y == k).sum() for k in (0, 1)]
    # Equal gains leave the choice open, so what counts is the gain at the root and that leaves are pure where they can be.
    want = plain(bins.astype(int), y, own)
    t = forest.trees[0]
    assert (t.feature[0], t.cut[0]) == want[:2]
    pure = [share(want, r) for r in bins.astype(int)]
    assert forest.probabilities(bins) == pytest.approx(pure)


@pytest.mark.parametrize("random", [False, True])
def test_trees_do_not_depend_on_who_grows_them(spark, random):
    df, x, _ = table(spark)
    grown = [trees.fit_forest(df, NAMES, trees=5, random=random, bins=32, key=["id"], local=local) for local in (10_000, 40)]
    bins = trees.binned(x, grown[0].edges)
    assert grown[0].probabilities(bins) == pytest.approx(grown[1].probabilities(bins))
    assert grown[0].importances() == pytest.approx(grown[1].importances())
    assert len({len(t.feature) for t in grown[0].trees}) > 1


@pytest.mark.parametrize("local", [10_000, 50])
def test_leaves_have_their_least_rows(spark, local):
    df, x, y = table(spark, 400)
    for least in (2, 9):
        forest = trees.fit_forest(df, NAMES, trees=1, per_split=4, bootstrap=False, bins=32, local=local, least=least)
        leaf = forest.trees[0].leaf(trees.binned(x, forest.edges))
        rows = np.unique(leaf, return_counts=True)[1]
        # A cut is refused only where it leaves too few rows, so that some leaves are as small as they may be.
        assert rows.min() == least and len(rows) > 3


def test_small_nodes_are_grown_by_all_tasks_at_once(spark, monkeypatch):
    df, _, _ = table(spark)
    fetch, held = type(df).toLocalIterator, []

    def fetched(self, *more):
        # Rows that are not kept would be made while they are fetched, one partition after the other.
        held.append(self.storageLevel.useDisk)
        return fetch(self, *more)

    monkeypatch.setattr(type(df), "toLocalIterator", fetched)
    forest = trees.fit_forest(df, NAMES, trees=3, key=["id"], local=200)
    assert held == [True] and all(len(t.feature) > 3 for t in forest.trees)


def test_many_parts_are_put_as_one_by_one():
    part = (np.array([0, -1, -1]), np.array([3, 0, 0]), np.array([1, -1, -1]), np.arange(6.0).reshape(3, 2), np.ones(3))
    one, all_ = trees.Tree(), trees.Tree()
    for t in (one, all_):
        t.put(0, part)
    for at in (1, 2):
        one.put(at, part)
    all_.put_all([(1, part), (2, part)])
    for name in ("feature", "cut", "left", "weights", "gain"):
        assert getattr(one, name).tolist() == getattr(all_, name).tolist()


def test_bootstraps_are_drawn_and_balanced(spark):
    n = trees.times_drawn(1, 2, np.arange(100_000))
    assert n.mean() == pytest.approx(1, abs=0.02) and (n == 0).mean() == pytest.approx(np.exp(-1), abs=0.01)
    df, _, _ = table(spark)
    for t in trees.fit_forest(df.where("label = 1 OR id % 7 = 0"), NAMES, trees=3, key=["id"]).trees:
        assert t.weights[0][0] == pytest.approx(t.weights[0][1])


def test_importances_of_planted_features(spark):
    df, _, _ = table(spark, 2000)
    found = {r["feature"]: r for r in select.importances(df, NAMES, count=20, key=["id"]).collect()}
    for kind in ("rf_importance", "et_importance"):
        assert max(found, key=lambda f: found[f][kind]) == "a" and sum(r[kind] for r in found.values()) == pytest.approx(1)
        assert found["b"][kind] > max(found["c"][kind], found["d"][kind])


def test_scores_and_odd_input(spark):
    df, _, y = table(spark)
    scored = trees.fit_forest(df, NAMES, trees=10, depth=6, key=["id"]).score(df.withColumn("_0", F.lit("x")).withColumn("p2", F.col("a")))
    rows = scored.collect()
    assert scored.columns == [*df.columns, "_0", "p2", "p"] and np.mean([(r["p"] > 0.5) == r["label"] for r in rows]) > 0.85
    one = df.where("label = 1")
    assert {r["p"] for r in trees.fit_forest(one, NAMES, trees=2).score(df).collect()} == {1.0}
    assert {r["p"] for r in trees.fit_forest(one.where("false"), NAMES, trees=2).score(df).collect()} == {0.0}
    odd = df.withColumn("a", F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("a"))).withColumn("c", F.lit(5.0)).withColumn("label", F.when(F.col("id") % 5 == 0, None).otherwise(F.col("label")))
    assert trees.fit_forest(odd, NAMES, trees=2).score(odd).where("p BETWEEN 0 AND 1").count() == len(y)
    deep = trees.fit_forest(df, NAMES, trees=1, depth=1, key=["id"]).trees[0]
    assert len(deep.feature) == 3


def test_copies_of_few_rows_need_no_pass_by_all_tasks(spark, monkeypatch):
    """A tree needs no more of equal rows than how often it draws them: it is grown by one task, however many they are."""
    few = spark.range(60).select((F.col("id") % 10).cast("double").alias("a"), F.floor(F.col("id") / 10).cast("double").alias("b"), (F.hash("id") % 2 == 0).cast("int").alias("label"))
    df = few.crossJoin(spark.range(100).withColumnRenamed("id", "copy"))
    want = trees.fit_forest(df, ["a", "b"], trees=3, key=["a", "b", "copy"], local=10)
    monkeypatch.delattr(trees, "_split_pass")
    found = trees.fit_forest(df, ["a", "b"], trees=3, key=["a", "b", "copy"], local=1000)
    x = np.array([(a, b) for a in range(10) for b in range(6)])
    assert found.probabilities(x) == pytest.approx(want.probabilities(x)) and len({len(t.feature) for t in found.trees}) > 1
