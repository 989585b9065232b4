"""Second-order boosting of trees for labels 0 and 1: gradient and hessian sums by node, feature and bin, L1 and L2 terms.

Rows stay where they are: tasks add up gradients and hessians of open nodes, and only sums are sent, in one job for each two
levels of a tree: sums by pairs of features also tell what the children of a node have. Where pairs have too many bins for that,
and for a last odd level, a job adds up each level. Of two children the one with less hessian is added up, the other is what its parent has besides. Margins
and slopes of all rows are kept beside them, brought up to date as the first level of the next tree is added up; every KEPT trees
they are made anew from those kept before, so that no row's history grows long. Sums are whole numbers of a small unit, so
that they are exact and no result depends on how rows are dealt out. Sampling of rows and features follows from hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.ml.param.shared import HasMaxIter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flintsieve.operators import trees as T
from flintsieve.operators.vectorize import finite

#: Trees after which margins are made anew; rows of a block; bytes of sums that the driver adds up itself, at most.
KEPT, BLOCK, SENT_BYTES = 30, 65_536, 32 << 20


@dataclass(frozen=True)
class Boost:
    """How trees are grown: levels, step, L1 and L2 terms of leaf values, least hessian of a leaf, shares of rows and of features
    that a tree sees, weight of label 1 (None: what makes both labels alike)."""

    depth: int = 5
    step: float = 0.035
    l1: float = 0.05
    l2: float = 2.0
    least: float = 1.0
    rows: float = 0.9
    columns: float = 0.9
    positive: float | None = None
    seed: int = 42


def _soft(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0)


def best_split(sums: np.ndarray, features: np.ndarray, rule: Boost) -> tuple[int, int, float]:
    """(feature, cut, gain) of a node's sums by feature and bin (gradient, hessian); feature -1 where no cut gains."""
    left = np.cumsum(sums, axis=1)[:, :-1]
    whole = sums[features[0]].sum(axis=0)
    right = whole - left
    score = lambda s: _soft(s[..., 0], rule.l1) ** 2 / (s[..., 1] + rule.l2)
    gain = (score(left) + score(right) - score(whole)) / 2
    allowed = (left[..., 1] >= rule.least) & (right[..., 1] >= rule.least)
    allowed &= np.isin(np.arange(len(sums)), features)[:, None]
    gain = np.where(allowed, gain, -np.inf)
    f, c = np.unravel_index(int(gain.argmax()), gain.shape) if gain.size else (0, 0)
    return (int(f), int(c), float(gain[f, c])) if gain.size and gain[f, c] > 1e-9 else (-1, 0, 0.0)


def value(sums: np.ndarray, rule: Boost) -> float:
    """A leaf's addition to the margin."""
    return float(-rule.step * _soft(sums[0], rule.l1) / (sums[1] + rule.l2)) if sums[1] + rule.l2 > 0 else 0.0


def columns_of(tree: int, k: int, rule: Boost) -> np.ndarray:
    """The features that a tree sees."""
    return np.sort(np.argsort(T._uniform(rule.seed, tree, np.arange(k)), kind="stable")[: max(1, math.floor(rule.columns * k))])


def sees(tree: int, ids: np.ndarray, rule: Boost) -> np.ndarray:
    """Which rows a tree sees."""
    return T._uniform(rule.seed + 1, tree, ids) < rule.rows


def slopes(margin: np.ndarray, y: np.ndarray, positive: float) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and hessian of the logistic loss."""
    p = 1 / (1 + np.exp(-margin))
    w = np.where(y == 1, positive, 1.0)
    return w * (p - y), w * np.maximum(p * (1 - p), 1e-16)


@dataclass
class Boosted:
    features: list[str]
    edges: np.ndarray
    base: float
    trees: list[T.Tree] = field(default_factory=list)

    def margins(self, x: np.ndarray, first: int = 0) -> np.ndarray:
        out = np.zeros(len(x))
        for t in self.trees[first:]:
            out += t.weights[t.leaf(x), 0]
        return out

    def score(self, df: DataFrame, out: str = "p") -> DataFrame:
        """df with the probability of label 1; the trees are broadcast, their number and depth bound them."""
        names = T.fresh_names(df, self.features)
        sent, kept = df.sparkSession.sparkContext.broadcast(self), df.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = sent.value
            for b in batches:
                x = T.binned(np.stack([b.column(n).to_numpy() for n in names], axis=1), model.edges)
                p = 1 / (1 + np.exp(-(model.base + model.margins(x))))
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(p)], names=[*kept, out])

        prepared = df.withColumns({n: finite(F.col(f"`{f}`")) for f, n in zip(self.features, names)})
        return prepared.mapInArrow(run, df.withColumn(out, F.lit(0.0)).schema)


def fit_boosted(df: DataFrame, features: list[str], label: str = "label", rounds: int = 450, rule: Boost = Boost(), bins: int = 256, key: list[str] | None = None) -> Boosted:  # noqa: B008
    """A boosted model on rows with label 0 or 1, beginning at the weighted share of label 1. key: columns that name a row.

    Defined results: values that are no finite numbers are 0; rows with another label are left out; with one label, or without
    a row, there are no trees."""
    spark = df.sparkSession
    rows = df.where(F.col(label).isin(0, 1))
    n = {r[0]: r[1] for r in rows.groupBy(F.col(label).cast("int")).count().collect()}
    edges = T.bin_edges(rows, features, bins)
    if len(n) < 2:
        return Boosted(features, edges, 0.0 if not n else math.inf if 1 in n else -math.inf)
    positive = rule.positive if rule.positive is not None else n[0] / n[1]
    unit = 2.0 ** (math.ceil(math.log2(n[0] + positive * n[1])) - 52)
    model = Boosted(features, edges, math.log(positive * n[1] / n[0]))
    widths = np.array([len(np.unique(e)) + 1 for e in edges], np.int64)
    chunks = T.chunked(rows.repartition(spark.sparkContext.defaultParallelism), features, label, key, edges)
    # What the trees until now make of all rows, and the rows as the tree that grows sees them.
    kept = now = _Block.of(chunks, widths, model.base).persist(StorageLevel.MEMORY_AND_DISK)
    for tree in range(rounds if features else 0):
        last, before = model.trees[-1:], now
        if tree and tree % KEPT == 0:
            since, before, last = model.trees[tree - KEPT :], kept, []
            kept = _each(before, lambda b, since=since: b.after(since)).persist(StorageLevel.MEMORY_AND_DISK)
            now.unpersist()
            now = kept
        now = _each(now, lambda b, tree=tree, last=last: b.after(last).sloped(tree, positive, unit, rule)).persist(StorageLevel.MEMORY_AND_DISK)
        model.trees.append(_grown(now, tree, widths, unit, rule))
        if before is not kept:
            before.unpersist()
    now.unpersist()
    kept.unpersist()
    return model


def _each(blocks: RDD, change) -> RDD:
    return blocks.mapPartitions(lambda held: map(change, held), preservesPartitioning=True)


@dataclass
class _Block:
    """Rows of a task: names, labels, bins by feature, margins, and gradients and hessians in units."""

    ids: np.ndarray
    y: np.ndarray
    x: np.ndarray
    margin: np.ndarray
    slopes: tuple[np.ndarray, np.ndarray] | None = None

    @classmethod
    def of(cls, chunks: DataFrame, widths: np.ndarray, base: float) -> RDD:
        """Blocks of about BLOCK rows from chunks."""
        top = widths - 1

        def joined(parts: list) -> _Block:
            ids, y, x = (np.concatenate([np.frombuffer(r[c], kind) for r in parts]) for c, kind in (("ids", np.int64), ("y", np.uint8), ("x", np.uint16)))
            # What is above a feature's last edge is its last bin, however often that edge is repeated.
            x = np.minimum(x.reshape(len(y), len(top)), top).T
            return cls(ids, y, np.ascontiguousarray(x.astype(np.uint8 if max(top, default=0) < 256 else np.uint16)), np.full(len(y), base))

        def run(rows: Iterator) -> Iterator[_Block]:
            parts, n = [], 0
            for r in rows:
                parts.append(r)
                n += len(r["y"])
                if n >= BLOCK:
                    yield joined(parts)
                    parts, n = [], 0
            if n:
                yield joined(parts)

        return chunks.rdd.mapPartitions(run)

    def after(self, trees: list[T.Tree]) -> _Block:
        """The block when trees have been added."""
        margin = self.margin
        for t in trees:
            margin = margin + t.weights[self.places(t), 0]
        return _Block(self.ids, self.y, self.x, margin)

    def sloped(self, tree: int, positive: float, unit: float, rule: Boost) -> _Block:
        seen = sees(tree, self.ids, rule)
        return _Block(self.ids, self.y, self.x, self.margin, tuple(np.where(seen, np.rint(s / unit), 0.0) for s in slopes(self.margin, self.y, positive)))

    def places(self, tree: T.Tree) -> np.ndarray:
        """The leaf of each row."""
        own = np.arange(len(tree.feature))
        inner = tree.feature >= 0
        # A leaf leads to itself.
        start, cut, left = np.maximum(tree.feature, 0) * len(self.y), np.where(inner, tree.cut, 1 << 16), np.where(inner, tree.left, own)
        at, rows, flat = np.zeros(len(self.y), np.int64), np.arange(len(self.y)), self.x.ravel()
        edge = np.zeros(1, np.int64)
        while inner[edge].any():
            at = left[at] + (flat[start[at] + rows] > cut[at])
            edge = np.concatenate([tree.left[edge[inner[edge]]], tree.left[edge[inner[edge]]] + 1])
        return at

    def add(self, sums: np.ndarray, tree: T.Tree, slot: np.ndarray, groups: list[tuple[int, ...]], widths: np.ndarray) -> None:
        """Adds gradients and hessians of the nodes with a slot to sums by slot, bins (of groups of features in turn) and kind."""
        n, of, values, start = len(sums), slot[self.places(tree)], self.slopes, 0
        rows = np.flatnonzero(of >= 0)
        if len(rows) < len(of):
            of, values = of[rows], [s[rows] for s in values]
        x = {f: self.x[f][rows] if len(rows) < len(self.y) else self.x[f] for f in {f for g in groups for f in g}}
        for group in groups:
            code, size = of, int(widths[list(group)].prod())
            for f in group:
                code = code * widths[f] + x[f]
            for kind, v in enumerate(values):
                sums[:, start : start + size, kind] += np.bincount(code, v, n * size).reshape(n, size)
            start += size


def _size(groups: list[tuple[int, ...]], widths: np.ndarray) -> int:
    return sum(int(widths[list(g)].prod()) for g in groups)


def _sums(blocks: RDD, tree: T.Tree, places: list[int], groups: list[tuple[int, ...]], widths: np.ndarray) -> dict[int, np.ndarray]:
    """Gradients and hessians of nodes by bins of groups of features in turn, over all rows."""
    slot, size = np.full(len(tree.feature), -1), _size(groups, widths)
    slot[places] = np.arange(len(places))

    def run(held: Iterator[_Block]) -> Iterator[tuple[int, np.ndarray]]:
        sums = np.zeros((len(places), size, 2))
        for b in held:
            b.add(sums, tree, slot, groups, widths)
        return zip(places, sums)

    found = blocks.mapPartitions(run)
    if blocks.getNumPartitions() * len(places) * size * 16 > SENT_BYTES:
        found = found.reduceByKey(np.add)
    out = dict.fromkeys(places, 0.0)
    for place, s in found.collect():
        out[place] = out[place] + s
    return out


def _parts(flat: np.ndarray, groups: list[tuple[int, ...]], widths: np.ndarray) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
    start = 0
    for g in groups:
        size = int(widths[list(g)].prod())
        yield g, flat[start : start + size].reshape(*widths[list(g)], 2)
        start += size


def _by_feature(flat: np.ndarray, groups: list[tuple[int, ...]], widths: np.ndarray) -> np.ndarray:
    """A node's sums by feature and bin."""
    out = np.zeros((len(widths), int(widths.max()), 2))
    for g, part in _parts(flat, groups, widths):
        for axis, f in enumerate(g):
            out[f, : widths[f]] = part if len(g) == 1 else part.sum(axis=1 - axis)
    return out


def _low(flat: np.ndarray, pairs: list[tuple[int, ...]], widths: np.ndarray, whole: np.ndarray, f: int, c: int) -> np.ndarray:
    """The sums by feature and bin of a node's lower child, from its sums by pairs."""
    out = np.zeros_like(whole)
    out[f, : c + 1] = whole[f, : c + 1]
    for (a, b), part in _parts(flat, pairs, widths):
        if a == f:
            out[b, : widths[b]] = part[: c + 1].sum(axis=0)
        elif b == f:
            out[a, : widths[a]] = part[:, : c + 1].sum(axis=1)
    return out


def _split(tree: T.Tree, found: dict[int, np.ndarray], chosen: np.ndarray, unit: float, rule: Boost) -> list[tuple[int, int, int, int, int]]:
    """Splits nodes by their sums, or makes leaves of them: (node, first child, feature, cut, child with less hessian)."""
    out = []
    for place in sorted(found):
        s = found[place] * unit
        whole = s[chosen[0]].sum(axis=0)
        f, c, g = best_split(s, chosen, rule)
        if f < 0:
            tree.weights[place] = (value(whole, rule), whole[1])
            continue
        at = tree.put(place, (np.array([f, -1, -1]), np.array([c, 0, 0]), np.array([1, -1, -1]), np.zeros((3, 2)), np.array([g, 0.0, 0.0])))
        low = s[f, : c + 1].sum(axis=0)
        for side, own in enumerate((low, whole - low)):
            tree.weights[at + side] = (value(own, rule), own[1])
        out.append((place, at, f, c, at + int(low[1] > whole[1] - low[1])))
    return out


def _grown(blocks: RDD, number: int, widths: np.ndarray, unit: float, rule: Boost) -> T.Tree:
    """One tree."""
    tree, chosen = T.Tree(), columns_of(number, len(widths), rule)
    singles, pairs = [(int(f),) for f in chosen], [(int(f), int(g)) for i, f in enumerate(chosen) for g in chosen[i + 1 :]]
    # Nodes to be added up; those that are what their parent has besides; the parents' sums.
    counted, besides, held, level = [0], {}, {}, 0
    while counted and level < rule.depth:
        both = [*counted, *besides]
        if level + 1 < rule.depth and pairs and blocks.getNumPartitions() * len(both) * _size(pairs, widths) * 16 <= SENT_BYTES:
            joint = _sums(blocks, tree, both, pairs, widths)
            whole, found = {p: _by_feature(j, pairs, widths) for p, j in joint.items()}, {}
            for place, at, f, c, _ in _split(tree, whole, chosen, unit, rule):
                found[at] = _low(joint[place], pairs, widths, whole[place], f, c)
                found[at + 1] = whole[place] - found[at]
            level += 1
        else:
            found = {p: _by_feature(s, singles, widths) for p, s in _sums(blocks, tree, counted, singles, widths).items()}
            found |= {other: held[parent] - found[one] for other, (parent, one) in besides.items()}
        done = _split(tree, found, chosen, unit, rule)
        counted, held = [less for *_, less in done], found
        besides = {2 * at + 1 - less: (place, less) for place, at, _, _, less in done}
        level += 1
    return tree


class Boosting(Estimator, HasMaxIter):
    """fit_boosted() as a stage of a pipeline; maxIter is the number of rounds."""

    def __init__(self, features: list[str], label: str = "label", rounds: int = 450, rule: Boost = Boost(), bins: int = 256, key: list[str] | None = None, out: str = "p") -> None:  # noqa: B008
        super().__init__()
        self.given, self.out = {"features": features, "label": label, "rule": rule, "bins": bins, "key": key}, out
        self._set(maxIter=rounds)

    def _fit(self, dataset: DataFrame) -> BoostedStage:
        return BoostedStage(fit_boosted(dataset, rounds=self.getMaxIter(), **self.given), self.out)


class BoostedStage(Model):
    """Adds the probability of label 1."""

    def __init__(self, model: Boosted, out: str) -> None:
        super().__init__()
        self.model, self.out = model, out

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.model.score(dataset, self.out)
