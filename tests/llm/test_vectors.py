"""Links of vectors against all pairs, with copies, odd vectors, one hot group and several levels of intervals."""

import math
import random

import pytest

from flintsieve.llm import vector_join


def usable(x):
    return bool(x) and None not in x and all(map(math.isfinite, x)) and any(x)


def expected(rows, cosine):
    n = len(rows)
    up = list(range(n))

    def find(v):
        while up[v] != v:
            v = up[v]
        return v

    links = [0] * n
    for i in range(n):
        for j in range(i):
            (_, a, x), (_, b, y) = rows[i], rows[j]
            if a is None or a != b or not usable(x) or not usable(y) or len(x) != len(y):
                continue
            if sum(p * q for p, q in zip(x, y)) / math.sqrt(sum(p * p for p in x)) / math.sqrt(sum(q * q for q in y)) >= cosine:
                links[i], links[j] = links[i] + 1, links[j] + 1
                up[find(i)] = find(j)
    low = {}
    for i in range(n):
        if rows[i][0] is not None:
            r = find(i)
            low[r] = min(low.get(r, rows[i][0]), rows[i][0])
    return [(rows[i][0], links[i], c := low.get(find(i)), rows[i][0] == c) for i in range(n)]


def made(seed, n, size, spread):
    rnd = random.Random(seed)
    gauss = lambda: [rnd.gauss(0, 1) for _ in range(size)]
    rows, hub = [], gauss()
    for k in range(n):
        base = hub if rnd.random() < 0.3 else rnd.choice(rows)[2] if rows and rnd.random() < 0.5 else gauss()
        rows.append((k, rnd.choice([0, 0, 1, 2]), [p + spread * rnd.gauss(0, 1) for p in base] if rnd.random() < 0.8 else list(base)))
    return rows


@pytest.mark.parametrize(("block", "fan", "size", "spread"), [(256, 4, 16, 0.1), (4, 1, 16, 0.08), (3, 1, 3, 0.05), (16, 2, 12, 0.005)])
def test_links_equal_all_pairs(spark, monkeypatch, block, fan, size, spread):
    monkeypatch.setattr(vector_join, "BLOCK", block)
    monkeypatch.setattr(vector_join, "FAN", fan)
    rows = made(block, 240, size, spread)
    one = rows[5][2]
    odd = [(900, 1, None), (901, 1, []), (902, 1, [0.0] * size), (903, 1, [1.0, None, *[0.0] * (size - 2)]), (904, 1, [float("nan"), *[1.0] * (size - 1)]), (905, 1, [float("inf"), *[1.0] * (size - 1)]), (906, None, one), (907, 1, one[: size - 1])]
    odd += [(908, rows[5][1], one), (908, rows[5][1], one), (909, rows[5][1], [3 * v for v in one]), (910, 1, [1e-200 * v for v in one]), (911, 1, [-v for v in one]), (912, 2, [-0.0, *one[1:]]), (913, 2, [0.0, *one[1:]])]
    rows += odd
    table = spark.createDataFrame([(*r, 1.0, "x") for r in rows], "vec_id long, label int, embedding array<double>, size double, unit string").repartition(3)
    found = vector_join.near_vectors(table, 0.98)
    want = expected([(i, a, [v * 1e200 for v in x] if i == 910 else x) for i, a, x in rows], 0.98)
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert sum(w[1] for w in want) > 100


def test_null_ids_and_text_labels(spark):
    rows = [(None, "a", [1.0, 0.0]), (None, "a", [1.0, 0.0]), (4, "b", [1.0, 0.0]), (None, "b", [1.0, 0.001]), (None, "c", [1.0])]
    found = vector_join.near_vectors(spark.createDataFrame(rows, "vec_id long, label string, embedding array<float>"), 0.98)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([(None, 1, None, True), (None, 1, None, True), (4, 1, 4, True), (None, 1, 4, False), (None, 0, None, True)], key=repr)


def test_empty_tables(spark):
    kind = "vec_id long, label int, embedding array<float>"
    assert vector_join.near_vectors(spark.createDataFrame([], kind)).count() == 0
    assert [tuple(r) for r in vector_join.near_vectors(spark.createDataFrame([(1, 1, None)], kind)).collect()] == [(1, 0, 1, True)]


def test_intervals_drop_what_is_far(spark):
    rows = [(k, 0, [math.cos(k / 100), math.sin(k / 100)]) for k in range(600)]
    units = vector_join.unit_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"))
    classes = units.selectExpr("label", "size", "k1", "k2", "1L AS copies", "vec_id AS first", "unit")
    blocks = vector_join.blocks_in_order(classes, 600, 0.2, 2).cache()
    n = blocks.count()
    assert vector_join.near_blocks(blocks, 0.2, 2).count() < n * (n + 1) / 2
