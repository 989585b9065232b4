"""The join where grams have many posts: against all pairs, and without looking at every two posts."""

import random

import pytest
from pyspark.sql import functions as F

from flintsieve.llm import jaccard_join


def expected(docs, n, percent):
    sets = {i: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or {tuple(w)} for i, w in docs}
    up = {i: i for i in sets}

    def find(v):
        while up[v] != v:
            v = up[v]
        return v

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return {i: find(i) for i in ids}


@pytest.mark.parametrize(("words", "percent", "exact"), [(1, 85, 4), (1, 60, 32), (2, 80, 8)])
def test_hot_grams_equal_all_pairs(spark, monkeypatch, words, percent, exact):
    monkeypatch.setattr(jaccard_join, "HOT", 2)
    monkeypatch.setattr(jaccard_join, "EXACT", exact)
    rnd = random.Random(words * percent)
    docs = []
    for k in range(400):
        base = docs[rnd.randrange(len(docs))][1] if docs and rnd.random() < 0.6 else [f"w{rnd.randrange(60)}" for _ in range(rnd.randrange(2, 60))]
        w = [x if rnd.random() > 0.08 else f"w{rnd.randrange(90)}" for x in base if rnd.random() > 0.04] or ["z"]
        docs.append((k, w))
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in docs], "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_groups(df, words, percent).collect()}
    want = expected(docs, words, percent)
    assert found == want and len(set(want.values())) < len(want)


def test_hot_posts_of_one_size_that_cannot_link_do_not_meet(spark):
    posts = spark.range(20_000).select(F.lit(1).alias("gram"), F.lit(20_000).alias("seen"), "id", F.col("id").alias("root"), F.lit(7 * 8 + 1).alias("m"), F.lit(1).alias("pos"))
    met = jaccard_join._met_hot(posts, 85)
    assert met.isEmpty()
    # Both sides have no class in common, so no two posts were compared.
    smaller = posts.where("((m div 8 - pos) * 185) div 85 - m div 8 >= m div 8")
    assert smaller.isEmpty()
