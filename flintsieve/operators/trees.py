"""Forests grown level by level: random forests with bootstraps balanced tree by tree, and extremely random trees.

Rows are cut into bins once and go to the task of their cell, which is all rows with the same bins: a tree needs no more of a
cell than how often it draws either label there. While a node may have more cells than a task holds (LOCAL), each task adds up
counts by node, feature and bin for several trees in one pass, and one row for each node and task is shuffled to find its split.
Smaller nodes, whole trees where cells are few, are sent to one task each, which grows all that is below them. Which rows a tree draws, which features a node
looks at and where a random cut falls follow from hashes of the seed, the tree, the row and the node, so a task that is run
again gives the same. There is no limit of depth but the caller's.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flintsieve.operators.vectorize import finite

#: Bytes of bins, and cells at least and at most, from which a node is split by all tasks together; bytes of counts that a task
#: holds in one pass, about; rows of a chunk, and of a chunk of cells.
LOCAL, PASS_BYTES, CHUNK, CELLS = (64 << 20, 16_384, 1 << 20), 64 << 20, 8192, 65_536
#: How often a row is drawn into a bootstrap: the distribution of a count of mean 1.
_DRAWN = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash(*parts: np.ndarray | int) -> np.ndarray:
    out = np.zeros(1, np.uint64)
    for p in parts:
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + np.asarray(p).astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return out


def _uniform(*parts: np.ndarray | int) -> np.ndarray:
    return (_hash(*parts) >> np.uint64(11)).astype(np.float64) / (1 << 53)


def times_drawn(seed: int, tree: int, rows: np.ndarray) -> np.ndarray:
    """How often a tree's bootstrap has each row."""
    return np.searchsorted(_DRAWN, _uniform(seed, tree, rows), side="right")


@dataclass(frozen=True)
class Rule:
    """How trees are grown. per_split: features that a node looks at; more only until one can be split. random: one random cut
    for each of them instead of the best one. depth: levels at most, or None. least: rows (as drawn) of either side of a cut."""

    per_split: int
    random: bool = False
    bootstrap: bool = True
    depth: int | None = None
    seed: int = 42
    least: int = 1


def splits(rows, tree: np.ndarray, node: np.ndarray, own: np.ndarray, edges: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, cut, gain) for each node; feature -1 where none can be split. rows(which, feature) gives the rows of nodes
    (places) with one feature of each: the node's place in which, the bin, how often it counts for either label (a line for each). own: weights of
    the labels. Counts are whole numbers, so gains do not depend on the order of the rows."""
    n, k = len(node), len(edges)
    order = np.argsort(np.stack([_hash(rule.seed, tree, node, f) for f in range(k)], axis=1), axis=1, kind="stable")
    best_f, best_c, best = np.full(n, -1), np.zeros(n, np.int64), np.full(n, -np.inf)
    bins = edges.shape[1] + 1
    gini = lambda w: 2 * w[:, 0] * w[:, 1] / np.maximum(w.sum(axis=1), 1e-300)  # noqa: E731  times the weight
    for j in range(k):
        look = np.flatnonzero(best_f < 0) if j >= rule.per_split else np.arange(n)
        if not len(look):
            break
        f = order[look, j]
        of, x, w = rows(look, f)
        code, span = of * bins + x, len(look) * bins
        if span <= 4 * len(code):
            h = np.stack([np.bincount(code, w[y], span) for y in (0, 1)], axis=1).astype(np.int64)
            code = np.flatnonzero(h.any(axis=1))
            of, x, sums = code // bins, code % bins, np.cumsum(h[code], axis=0)
        else:
            by = np.argsort(code)
            code, of, x, sums = code[by], of[by], x[by].astype(np.int64), np.cumsum(w[:, by].T, axis=0)
        # A cut lies behind the last row of a bin, if the node has more.
        at = np.flatnonzero((code[1:] != code[:-1]) & (of[1:] == of[:-1]))
        first = np.searchsorted(of, np.arange(len(look)))
        last = np.searchsorted(of, np.arange(len(look)), side="right") - 1
        if rule.random and len(at):
            e = edges[f]
            bound = lambda b: np.take_along_axis(e, np.minimum(b, e.shape[1] - 1)[:, None], 1)[:, 0]  # noqa: E731, B023
            low, high = x[np.minimum(first, len(x) - 1)], x[last]
            value = bound(low) + (bound(high) - bound(low)) * _uniform(rule.seed + 1, tree[look], node[look], f)
            cut = np.clip((e < value[:, None]).sum(axis=1), low, np.maximum(low, high - 1))
            at = at[(x[at] <= cut[of[at]]) & (x[at + 1] > cut[of[at]])]
        start = np.where((first > 0)[:, None], sums[first - 1], 0)
        whole = sums[last] - start
        if rule.least > 1:
            low = (sums[at] - start[of[at]]).sum(axis=1)
            at = at[(low >= rule.least) & (whole[of[at]].sum(axis=1) - low >= rule.least)]
        if not len(at):
            continue
        holder = of[at]
        left = sums[at] - start[holder]
        gain = gini(whole * own)[holder] - gini(left * own) - gini((whole[holder] - left) * own)
        groups = np.flatnonzero(np.append(True, holder[1:] != holder[:-1]))
        most = np.maximum.reduceat(gain, groups)
        hit = np.flatnonzero(gain >= np.repeat(most, np.diff(np.append(groups, len(holder)))))
        nodes, one = np.unique(holder[hit], return_index=True)
        chosen = at[hit[one]]
        better = most > best[look[nodes]]
        to = look[nodes[better]]
        best_f[to], best[to] = f[nodes[better]], most[better]
        best_c[to] = cut[nodes[better]] if rule.random else x[chosen[better]]
    return best_f, best_c, best


def _child(node: np.ndarray, side: int) -> np.ndarray:
    return _hash(node, side + 1).view(np.int64)


def grow(x: np.ndarray, w: np.ndarray, own: np.ndarray, tree: int, node: int, level: int, edges: np.ndarray, rule: Rule) -> tuple[np.ndarray, ...]:
    """(feature, cut, left, weights of both labels, gain) of the nodes below one node, itself first; the right child follows the
    left. All nodes of a level are split at once. w: how often each row counts for either label; own: the labels' weights."""
    ids, k = np.array([node]), x.shape[1]
    out_f, out_c, out_l, out_w, out_g = [], [], [], [], []
    # Rows that are in a node of this level, where each begins in all bins, its node, and how often it counts.
    flat, first = x.ravel(), 0
    begin, at, held = np.arange(len(x)) * k, np.zeros(len(x), np.int64), np.ascontiguousarray(w.T, np.float64)
    now = w.sum(axis=0)[None]
    while True:
        n = len(ids)
        can = (now > 0).all(axis=1)
        if rule.depth is not None and level >= rule.depth:
            can[:] = False
        f, c, g = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n)
        if can.any():
            open_ = np.flatnonzero(can)
            if len(open_) < n:
                stay = np.flatnonzero(can[at])
                begin, at, held = begin[stay], at[stay], held[:, stay]
            place = (np.cumsum(can) - 1)[at]

            def rows(which: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                if len(which) == len(open_):  # noqa: B023
                    return place, flat[begin + features[place]], held  # noqa: B023
                chosen = np.full(len(open_), -1)  # noqa: B023
                chosen[which] = np.arange(len(which))
                some = np.flatnonzero(chosen[place] >= 0)  # noqa: B023
                of = chosen[place[some]]  # noqa: B023
                return of, flat[begin[some] + features[of]], held[:, some]  # noqa: B023

            f[open_], c[open_], g[open_] = splits(rows, np.full(len(open_), tree), ids[open_], own, edges, rule)
        split = np.flatnonzero(f >= 0)
        child = np.full(n, -1)
        child[split] = first + n + 2 * np.arange(len(split))
        for o, v in ((out_f, f), (out_c, c), (out_l, child), (out_w, now * own), (out_g, np.where(f >= 0, g, 0.0))):
            o.append(v)
        if not len(split):
            break
        if len(split) < n:
            stay = np.flatnonzero(f[at] >= 0)
            begin, at, held = begin[stay], at[stay], held[:, stay]
        right = flat[begin + f[at]] > c[at]
        at = (child - (first + n))[at] + right
        ids = np.stack([_child(ids[split], 0), _child(ids[split], 1)], axis=1).ravel()
        now = np.stack([np.bincount(at, v, 2 * len(split)) for v in held], axis=1).astype(np.int64)
        first, level = first + n, level + 1
    return tuple(np.concatenate(o) for o in (out_f, out_c, out_l, out_w, out_g))


class Tree:
    """Nodes of one tree as arrays; a node that is still to be split or grown is a leaf until then."""

    def __init__(self) -> None:
        self.feature, self.cut, self.left = np.full(1, -1), np.zeros(1, np.int64), np.full(1, -1)
        self.weights, self.gain = np.zeros((1, 2)), np.zeros(1)

    def put(self, at: int, nodes: tuple[np.ndarray, ...]) -> int:
        """Puts nodes (as grow() gives them) in the place of one leaf; the place of their second."""
        second = len(self.feature)
        self.put_all([(at, nodes)])
        return second

    def put_all(self, parts: list[tuple[int, tuple[np.ndarray, ...]]]) -> None:
        """Puts nodes in the places of several leaves, with one copy of the tree."""
        base, more = len(self.feature) - 1, []
        for at, (f, c, left, w, g) in parts:
            left = np.where(left >= 0, left + base, -1)
            self.feature[at], self.cut[at], self.left[at], self.weights[at], self.gain[at] = f[0], c[0], left[0], w[0], g[0]
            more.append((f[1:], c[1:], left[1:], w[1:], g[1:]))
            base += len(f) - 1
        names = ("feature", "cut", "left", "weights", "gain")
        for name, values in zip(names, zip(*more)):
            setattr(self, name, np.concatenate([getattr(self, name), *values]))

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins."""
        return leaf_of(self.feature, self.cut, self.left, x)

    def shares(self) -> tuple[np.ndarray, ...]:
        """(feature, cut, left, label 1's share of the weight) of all nodes, in as few bytes as scoring needs."""
        share = self.weights[:, 1] / np.maximum(self.weights.sum(axis=1), 1e-300)
        return self.feature.astype(np.int32), self.cut.astype(np.uint16), self.left.astype(np.int32), share


def leaf_of(feature: np.ndarray, cut: np.ndarray, left: np.ndarray, x: np.ndarray) -> np.ndarray:
    at, live = np.zeros(len(x), np.int64), np.arange(len(x))
    while len(live):
        live = live[feature[at[live]] >= 0]
        now = at[live]
        at[live] = left[now] + (x[live, feature[now]] > cut[now])
    return at


def mean_share(trees: list[tuple[np.ndarray, ...]], x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    for feature, cut, left, share in trees:
        out += share[leaf_of(feature, cut, left, x)]
    return out / max(1, len(trees))


@dataclass
class Forest:
    features: list[str]
    edges: np.ndarray
    trees: list[Tree]

    def importances(self) -> list[float]:
        """Mean over trees of each feature's share of the gain."""
        total = np.zeros(len(self.features))
        for t in self.trees:
            own = np.bincount(t.feature[t.feature >= 0], t.gain[t.feature >= 0], len(self.features))
            total += own / own.sum() if own.sum() > 0 else 0
        return (total / max(1, len(self.trees))).tolist()

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Mean over trees of label 1's share of the leaf's weight, by bins."""
        return mean_share([t.shares() for t in self.trees], x)

    def score(self, df: DataFrame, out: str = "p") -> DataFrame:
        """df with the probability of label 1. The forest is broadcast once: its size is that of its nodes, which the depth and
        the number of trees bound."""
        names = fresh_names(df, self.features)
        sent = df.sparkSession.sparkContext.broadcast((self.edges, [t.shares() for t in self.trees]))
        prepared = df.withColumns({n: finite(F.col(f"`{f}`")) for f, n in zip(self.features, names)})
        kept = df.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            edges, shares = sent.value
            for b in batches:
                x = binned(np.stack([b.column(n).to_numpy() for n in names], axis=1), edges)
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(mean_share(shares, x))], names=[*kept, out])

        return prepared.mapInArrow(run, df.withColumn(out, F.lit(0.0)).schema)


def fresh_names(df: DataFrame, features: list[str]) -> list[str]:
    have = {c.lower() for c in df.columns}
    mark = "_"
    while any(f"{mark}{k}" in have for k in range(len(features))):
        mark += "_"
    return [f"{mark}{k}" for k in range(len(features))]


def binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The bin of each value: how many edges of its feature are below it."""
    return np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], axis=1).astype(np.uint16) if len(edges) else np.zeros(x.shape, np.uint16)


def bin_edges(df: DataFrame, features: list[str], bins: int) -> np.ndarray:
    """Upper edges of all bins but the last, by feature: values at even ranks, the largest repeated where there are fewer."""
    found = df.approxQuantile(features, [k / bins for k in range(bins)], 0.5 / bins) if features else []
    out = np.full((len(features), bins - 1), np.inf)
    for k, e in enumerate(found):
        e = np.unique(e)[: bins - 1]
        out[k, : len(e)] = e
        out[k, len(e) :] = e[-1] if len(e) else np.inf
    return out


def chunked(df: DataFrame, features: list[str], label: str, key: list[str] | None, edges: np.ndarray) -> DataFrame:
    """(ids, y, x) of up to CHUNK rows each: 64-bit names of the rows, labels and bins. Rows of one key draw alike."""
    names = [f"f{k}" for k in range(len(features))]
    rows = df.select(F.xxhash64(*[F.col(f"`{c}`") for c in key or [*features, label]]).alias("id"), F.col(label).cast("int").alias("y"), *[finite(F.col(f"`{f}`")).alias(n) for f, n in zip(features, names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, CHUNK):
                p = b.slice(at, CHUNK)
                x = binned(np.stack([p.column(n).to_numpy() for n in names], axis=1), edges)
                parts = (p.column("id").to_numpy().astype(np.int64), p.column("y").to_numpy().astype(np.uint8), x)
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in parts], names=["ids", "y", "x"])

    return rows.mapInArrow(run, "ids binary, y binary, x binary")


def cells(df: DataFrame, features: list[str], label: str, key: list[str] | None, edges: np.ndarray) -> tuple[DataFrame, DataFrame, int]:
    """(ids, y, sizes, x) of up to CELLS rows each: names and labels of rows in the order of their cells, the cells' numbers of
    rows, and their bins; the rows that they are made of, which are kept until then; about how many cells there are. Rows of one
    key draw alike."""
    k = len(features)

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, y, x in _opened(b, k):
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(y.astype(np.int8)), _cut(x, np.arange(1, len(y) + 1)) if k else pa.array([b""] * len(y), pa.binary())], names=["id", "y", "x"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= CELLS:
                yield merged(held)
                held, n = [], 0
        if n:
            yield merged(held)

    def merged(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids, y = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("id", "y"))
        x = np.frombuffer(b"".join(v for b in held for v in b.column("x").to_pylist()), np.uint16).reshape(len(y), k)
        by = np.lexsort(x.T) if k else np.arange(len(y))
        x = x[by]
        first = np.append(0, np.flatnonzero((x[1:] != x[:-1]).any(axis=1)) + 1)
        sizes = np.diff(np.append(first, len(y))).astype(np.int32)
        parts = (ids[by], y[by].astype(np.uint8), sizes, np.ascontiguousarray(x[first]))
        return pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in parts], names=["ids", "y", "sizes", "x"])

    rows = chunked(df, features, label, key, edges).mapInArrow(apart, "id long, y byte, x binary").persist()
    n, different = rows.agg(F.count("*"), F.approx_count_distinct("x", 0.02)).first()
    # Cells of very many rows are dealt out in parts.
    parts = max(1, min(64, n // (16 * max(1, different))))
    dealt = rows.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "x", F.pmod("id", F.lit(parts)))
    return dealt.mapInArrow(together, "ids binary, y binary, sizes binary, x binary").persist(), rows, different * parts


def _cells(batch: pa.RecordBatch, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, place of the cell and label, cells' bins) of chunks of cells."""
    for i, y, n, x in zip(*(batch.column(c) for c in ("ids", "y", "sizes", "x"))):
        sizes = np.frombuffer(n.as_buffer(), np.int32)
        of = np.repeat(2 * np.arange(len(sizes)), sizes) + np.frombuffer(y.as_buffer(), np.uint8)
        yield np.frombuffer(i.as_buffer(), np.int64), of, np.frombuffer(x.as_buffer(), np.uint16).reshape(len(sizes), k)


def _times(times: np.ndarray, of: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How often each cell counts for either label."""
    return np.bincount(of, times, 2 * len(x)).astype(np.int64).reshape(-1, 2)


def _opened(batch: pa.RecordBatch, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for i, y, x in zip(*(batch.column(c) for c in ("ids", "y", "x"))):
        yield np.frombuffer(i.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.uint8), np.frombuffer(x.as_buffer(), np.uint16).reshape(-1, k)


def _places(tree: Tree, places: dict[int, int]) -> np.ndarray:
    """The place of each node of a tree, -1 for those that have none."""
    of = np.full(len(tree.feature), -1)
    of[list(places)] = list(places.values())
    return of


def _cut(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of rows as one element for each end."""
    data = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer((np.append(0, ends) * (data.nbytes // len(data))).astype(np.int32)), pa.py_buffer(data)])


def fit_forest(df: DataFrame, features: list[str], label: str = "label", trees: int = 300, per_split: int | None = None, random: bool = False, bootstrap: bool = True, depth: int | None = None, bins: int = 64, seed: int = 42, key: list[str] | None = None, local: int | None = None, least: int = 1) -> Forest:
    """A forest on rows with label 0 or 1; both classes weigh the same in each tree, counted in its own bootstrap.

    per_split: features at a node, the square root of all if None. random: extremely random trees. key: columns that name a
    row, for the draw. local: cells from which a node is split by all tasks together, what LOCAL says if None. least: rows of a leaf."""
    rule = Rule(per_split or max(1, math.isqrt(len(features))), random, bootstrap, depth, seed, least)
    edges = bin_edges(df, features, bins)
    k, spark = len(features), df.sparkSession
    chunks, rows, different = cells(df.where(F.col(label).isin(0, 1)), features, label, key, edges)
    local = local or min(max(LOCAL[0] // (2 * max(1, k)), LOCAL[1]), LOCAL[2])
    # About so many cells there are; no node has more of them.
    alone = 1.1 * different <= local
    drawn = lambda t, ids: times_drawn(seed, t, ids) if bootstrap else np.ones(len(ids), np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((trees, 3), np.int64)
        for b in batches:
            for ids, of, x in _cells(b, k):
                for t in range(trees):
                    w = _times(drawn(t, ids), of, x)
                    n[t] += (*w.sum(axis=0), np.count_nonzero(w.any(axis=1)))
        yield pa.RecordBatch.from_arrays([pa.array(range(trees), pa.int32()), *[pa.array(c) for c in n.T]], names=["tree", "n0", "n1", "rows"])

    totals = chunks.mapInArrow(count, "tree int, n0 long, n1 long, rows long").groupBy("tree").agg(F.sum("n0"), F.sum("n1"), F.sum("rows")).collect()
    rows.unpersist()
    of = {r[0]: r[1:] for r in totals}
    weight = np.array([[sum(of[t][:2]) / (2 * max(1, of[t][y])) for y in (0, 1)] for t in range(trees)]) if of else np.ones((trees, 2))
    grown = [Tree() for _ in range(trees)]
    # Nodes that are open, by tree: place, name and level.
    large = [(t, 0, 1, 0) for t in range(trees) if of and of[t][2] > local and not alone]
    small = [(t, 0, 1, 0) for t in range(trees) if of and of[t][2] > 0 and (alone or of[t][2] <= local)]
    each = 8 * 3 * k * bins
    while large:
        take, large = large[: max(1, PASS_BYTES // each)], large[max(1, PASS_BYTES // each) :]
        for t, at, node, level, f, c, g, low, high, n_low, n_high in _split_pass(spark, chunks, take, grown, weight, drawn, edges, bins, rule):
            both = np.array([np.array(low) + np.array(high), low, high])
            if f < 0:
                grown[t].weights[at] = both[0]
                continue
            first = grown[t].put(at, (np.array([f, -1, -1]), np.array([c, 0, 0]), np.array([1, -1, -1]), both, np.array([g, 0.0, 0.0])))
            for side, (n, w) in enumerate(((n_low, low), (n_high, high))):
                below = (t, first + side, int(_child(np.array([node]), side)[0]), level + 1)
                if min(w) > 0 and (depth is None or level + 1 < depth):
                    (large if n > local else small).append(below)
    below_of: list[list] = [[] for _ in range(trees)]
    for t, at, nodes in _grown_pass(spark, chunks, small, grown, weight, drawn, edges, rule):
        below_of[t].append((at, nodes))
    for t, parts in enumerate(below_of):
        if parts:
            grown[t].put_all(parts)
    chunks.unpersist()
    return Forest(features, edges, grown)


def _split_pass(spark, chunks: DataFrame, take: list[tuple], grown: list[Tree], weight: np.ndarray, drawn, edges: np.ndarray, bins: int, rule: Rule) -> list[tuple]:
    """One pass over the rows for some nodes: each one's split, and what both sides have."""
    k = len(edges)
    take = sorted(take)
    sent = spark.sparkContext.broadcast({t: grown[t] for t, *_ in take})
    nodes: dict[int, dict[int, int]] = {}
    for place, (t, at, *_) in enumerate(take):
        nodes.setdefault(t, {})[at] = place

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = sent.value
        of = {t: _places(trees[t], p) for t, p in nodes.items()}
        # How often rows count for a label by node, feature and bin, and from the 33rd bit how many cells these are.
        sums = np.zeros(len(take) * k * bins * 2, np.int64)
        for b in batches:
            for ids, of_, x in _cells(b, k):
                for t, places in nodes.items():
                    w, at = _times(drawn(t, ids), of_, x), of[t][trees[t].leaf(x)]
                    here = np.flatnonzero((at >= 0) & w.any(axis=1))
                    # A tree's nodes stand beside each other, from the first one's place.
                    first = min(places.values())
                    code = ((((at[here] - first)[:, None] * k + np.arange(k)) * bins + x[here])[:, :, None] * 2 + np.arange(2)).ravel()
                    value, own = np.repeat(w[here] + [1 << 32, 0], k, axis=0).ravel(), sums[first * k * bins * 2 : (first + len(places)) * k * bins * 2]
                    if len(own) <= 4 * len(code):
                        own += np.bincount(code, value, len(own)).astype(np.int64)
                    else:
                        np.add.at(own, code, value)
        sums = sums.reshape(len(take), k, bins, 2)
        parts = (np.concatenate([s & 0xFFFFFFFF, (s >> 32).sum(axis=-1, keepdims=True)], axis=-1).tobytes() for s in sums)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(take)), pa.int32()), pa.array(parts, pa.binary())], names=["place", "sums"])

    def choose(key: tuple[pa.Scalar, ...], parts: pa.Table) -> pa.Table:
        place = key[0].as_py()
        h = sum(np.frombuffer(s.as_buffer(), np.int64) for s in parts.column("sums")).reshape(k, bins, 3)
        t, _, node, _ = take[place]
        # The bins with rows stand for rows.
        held = lambda _, f: (np.zeros(len(b := np.flatnonzero(h[f[0], :, 2])), np.int64), b, h[f[0], b, :2].T)
        f, c, g = (v[0] for v in splits(held, np.array([t]), np.array([node]), weight[t], edges, rule))
        side = h[max(f, 0)]
        low, high = side[: c + 1].sum(axis=0), side[c + 1 :].sum(axis=0)
        return pa.table({"place": pa.array([place], pa.int32()), "f": pa.array([int(f)]), "c": pa.array([int(c)]), "g": [float(g)], "low": [(low * np.append(weight[t], 1)).tolist()], "high": [(high * np.append(weight[t], 1)).tolist()]})

    found = chunks.mapInArrow(add, "place int, sums binary").groupBy("place").applyInArrow(choose, "place int, f long, c long, g double, low array<double>, high array<double>").collect()
    return [(*take[r["place"]], r["f"], r["c"], r["g"], r["low"][:2], r["high"][:2], r["low"][2], r["high"][2]) for r in found]


def _grown_pass(spark, chunks: DataFrame, small: list[tuple], grown: list[Tree], weight: np.ndarray, drawn, edges: np.ndarray, rule: Rule) -> Iterator[tuple]:
    """All that is below small nodes, each grown by one task from its cells."""
    if not small:
        return
    k, kind = len(edges), np.uint8 if edges.shape[1] < 256 else np.uint16
    sent = spark.sparkContext.broadcast((grown, weight))
    nodes: dict[int, dict[int, int]] = {}
    for place, (t, at, *_) in enumerate(small):
        nodes.setdefault(t, {})[at] = place

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, _ = sent.value
        of = {t: _places(trees[t], p) for t, p in nodes.items()}
        for b in batches:
            for ids, of_, x in _cells(b, k):
                for t in nodes:
                    w = _times(drawn(t, ids), of_, x)
                    at = np.where(w.any(axis=1), of[t][trees[t].leaf(x)], -1)
                    r = np.argsort(at, kind="stable")[np.count_nonzero(at < 0) :]
                    if len(r):
                        at = at[r]
                        ends = np.append(np.flatnonzero(at[1:] != at[:-1]) + 1, len(at))
                        yield pa.RecordBatch.from_arrays([pa.array(at[ends - 1], pa.int32()), _cut(w[r].astype(np.uint32), ends), _cut(x[r].astype(kind), ends)], names=["place", "times", "x"])

    def below(key: tuple[pa.Scalar, ...], parts: pa.Table) -> pa.Table:
        place = key[0].as_py()
        t, _, node, level = small[place]
        own = sent.value[1][t]
        w, x = (np.frombuffer(b"".join(parts.column(c).to_pylist()), t) for c, t in (("times", np.uint32), ("x", kind)))
        f, c, left, weights, gain = grow(x.reshape(-1, k), w.reshape(-1, 2).astype(np.int64), own, t, node, level, edges, rule)
        out = (f.astype(np.int32), c.astype(np.int32), left.astype(np.int32), weights, gain)
        return pa.table({"place": pa.array([place], pa.int32()), **{n: pa.array([v.tobytes()], pa.binary()) for n, v in zip("fclwg", out)}})

    # A task holds the nodes of its part one by one.
    dealt = chunks.mapInArrow(deal, "place int, times binary, x binary").repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(len(small) // 4, 1000)), "place")
    found = dealt.groupBy("place").applyInArrow(below, "place int, f binary, c binary, l binary, w binary, g binary")
    # All tasks grow at once; the driver then fetches what they grew, part by part.
    found = found.persist(StorageLevel.DISK_ONLY)
    found.count()
    for r in found.toLocalIterator():
        t, at, *_ = small[r["place"]]
        i = lambda c: np.frombuffer(r[c], np.int32).astype(np.int64)  # noqa: E731, B023
        yield t, at, (i("f"), i("c"), i("l"), np.frombuffer(r["w"]).reshape(-1, 2), np.frombuffer(r["g"]))
    found.unpersist()
