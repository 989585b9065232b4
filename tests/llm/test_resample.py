"""The draw of operator 13 against plain Python, whatever the size of its ranges, and its tournament tree."""

import hashlib
import math
import random
import re
import zlib

import pytest

from flintsieve.llm import target_sampling as T

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x or "")


def expected(docs, target, percent, runs, buckets, least, seed):
    def features(x):
        w = WORD.findall(lower(x))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, runs + 1) for i in range(len(w) - n + 1)]

    s, t = [0] * buckets, [0] * buckets
    for side, rows in ((s, [x for _, x in docs]), (t, target)):
        for x in rows:
            for b in features(x)[1]:
                side[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    out = []
    for i, x in docs:
        words, found = features(x)
        weight = math.floor(sum(gain[b] for b in found) / len(found)) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, words])
    ranked = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(ranked[: percent * len(ranked) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


def texts(n, seed=1):
    rnd = random.Random(seed)
    words = ["alpha", "Beta", "g7", "été", "日本語", "x", "delta-epsilon", "ÀB"]
    return [" ".join(rnd.choices(words, k=rnd.randrange(0, 40))) for _ in range(n)]


@pytest.mark.parametrize(("runs", "most"), [(1, 100_000), (1, 7), (2, 3)])
def test_every_document_is_scored_and_ranked(spark, runs, most):
    docs = [*enumerate(texts(300)), (300, None), (301, ""), (302, "word " * 200_000), (None, "alpha " * 25)]
    target = ["alpha alpha été", None, "", "g7 x"]
    rows = spark.createDataFrame([(i, x, 0.5, 1) for i, x in docs], "doc_id long, text string, score double, row int").repartition(5)
    found = T.resample(rows, spark.createDataFrame([(x,) for x in target], "text string"), percent=35, runs=runs, buckets=97, least_words=5, seed=7, most=most)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected(docs, target, 35, runs, 97, 5, 7), key=repr)


@pytest.mark.parametrize("ids", [lambda k: None, lambda k: 7, lambda k: k % 3 or None])
def test_many_rows_of_one_score_and_id(spark, ids):
    docs = [(ids(k), "one two three") for k in range(200)]
    found = T.resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame([("one",)], "text string"), percent=50, least_words=1, most=10).collect()
    ranked = sorted((r for r in found if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, 101))
    best = sorted(((-r["score"], r["doc_id"] is None, r["doc_id"] or 0) for r in found))[:100]
    assert [(-r["score"], r["doc_id"] is None, r["doc_id"] or 0) for r in ranked] == best


def test_empty_tables(spark):
    none, one = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert T.resample(none, one).count() == 0
    assert [tuple(r)[0] for r in T.resample(one, none).collect()] == [1]


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16])
def test_tournament_merges_sorted_runs(k):
    rnd = random.Random(k)
    runs = [sorted((rnd.randrange(50),) for _ in range(rnd.randrange(20))) for _ in range(k)]
    assert list(T.Tournament(runs)) == sorted(x for r in runs for x in r)
