"""Exact near-duplicate join of vectors by cosine within labels: an epsilon grid order over leading principal dimensions.

Two unit vectors of cosine c lie sqrt(2 - 2c) apart, so vectors that link are at most epsilon apart, and so are their
projections. Vectors are sorted by label and by the grid cells, of side epsilon, of their leading principal dimensions, and
cut into blocks. A run of blocks is an interval of the sequence with a box: least and largest value of each of these
dimensions and of the length of what is left of the vector. Intervals are joined recursively: an interval with itself at
first, then the parts of each pair that is left, and a pair whose boxes are farther apart than epsilon is dropped with all
that is in it. Each level is one join of tables. Pairs of blocks that are left are compared in double precision, those
that must be near as a whole (by centre and radius) at once.

Equal vectors are one class, compared once and counted as often as they are there. Links are counted, not listed: a task
gives for each vector of its tile the number of partners and one of the vectors that it hangs together with.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flintsieve.llm.common import discard, partitions, small_batches, written
from flintsieve.llm.components import components

#: Leading dimensions; vectors that they are fitted on, about, and numbers of these at most. They only order and prune.
DIMENSIONS, SAMPLE, SAMPLE_NUMBERS = 8, 20_000, 4_000_000
#: Vectors of a block, numbers of a block at most; blocks of an interval, and intervals of the next one, as powers of two.
BLOCK, BLOCK_NUMBERS, FAN = 256, 1 << 18, 4
#: Room for rounding in squared distances.
SLACK = 1e-9
_SHIFT = 32


def _usable(x: list | None) -> np.ndarray | None:
    """A vector as doubles of length 1, or None if it is null, empty, zero, or holds what is no finite number."""
    if not x or None in x:
        return None
    v = np.array(x, np.float64)
    if not np.isfinite(v).all() or not v.any():
        return None
    v = v / np.abs(v).max()
    return v / np.sqrt(v @ v)


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, size, k1, k2, unit) of vectors (vec_id, label, embedding): 128 bits that name the vector, and its doubles
    scaled to length 1; nulls where it links with nothing."""
    small_batches(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x, label in zip(b.column("embedding").to_pylist(), b.column("label")):
                if not label.is_valid or (u := _usable(x)) is None:
                    rows.append((None,) * 4)
                    continue
                d = hashlib.blake2b((np.array(x, np.float64) + 0.0).tobytes(), digest_size=16).digest()
                rows.append((len(u), int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), u.tobytes()))
            found = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), *found], names=["vec_id", "label", "size", "k1", "k2", "unit"])

    return vectors.mapInArrow(run, f"vec_id long, label {vectors.schema['label'].dataType.simpleString()}, size long, k1 long, k2 long, unit binary")


def leading(classes: DataFrame, n: int, dimensions: int) -> np.ndarray:
    """Orthonormal columns: principal dimensions of a sample of about SAMPLE vectors of the most frequent length, by hash."""
    size = classes.groupBy("size").count().orderBy(F.desc("count"), "size").first()["size"]
    want = max(1, min(SAMPLE, SAMPLE_NUMBERS // size))
    some = classes.where((F.col("size") == size) & (F.pmod("k2", F.lit(1 << 20)) < max(1, math.ceil((1 << 20) * min(1.0, want / n))))).select("unit").limit(2 * want).toArrow().column("unit")
    x = np.array([np.frombuffer(u.as_buffer(), np.float64) for u in some]).reshape(-1, size)
    x = x - x.mean(axis=0) if len(x) else np.zeros((1, size))
    return np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :dimensions]


def _names(side: str, dimensions: int) -> list[str]:
    return [f"{side}{k}" for k in range(dimensions + 1)]


def blocks_in_order(classes: DataFrame, n: int, epsilon: float, dimensions: int) -> DataFrame:
    """Blocks of classes in epsilon grid order: (block, label, size, lo0.., hi0.., k1, k2, copies, first, units). The block's
    number goes up with the order; its upper bits are the partition."""
    basis = classes.sparkSession.sparkContext.broadcast(leading(classes, n, dimensions))  # vector length times dimensions
    label = classes.schema["label"].dataType.simpleString()
    cells, places = [f"c{k}" for k in range(dimensions)], [f"p{k}" for k in range(dimensions + 1)]
    kept = ["label", "size", "k1", "k2", "copies", "first", "unit"]
    kinds = f"label {label}, size long, k1 long, k2 long, copies long, first long, unit binary"

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes = basis.value
        for b in batches:
            p = np.zeros((b.num_rows, dimensions + 1))
            for k, u in enumerate(b.column("unit")):
                x = np.frombuffer(u.as_buffer(), np.float64)
                # Of vectors of another length, the first numbers.
                near = x @ axes if len(x) == len(axes) else x[:dimensions]
                p[k, : len(near)] = near
                p[k, dimensions] = math.sqrt(max(0.0, x @ x - near @ near))
            cell = np.floor(p[:, :dimensions] / epsilon).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], *[pa.array(c) for c in cell.T], *[pa.array(np.ascontiguousarray(c)) for c in p.T]], names=[*kept, *cells, *places])

    order = ["label", "size", *cells, "k1", "k2"]
    tasks = max(1, min(partitions(classes.sparkSession), n // BLOCK), n // 100_000)
    placed = classes.select(kept).mapInArrow(project, ", ".join([kinds, *[f"{c} long" for c in cells], *[f"{p} double" for p in places]]))
    placed = placed.repartitionByRange(tasks, *order).sortWithinPartitions(*order).drop(*cells)
    low, high = _names("lo", dimensions), _names("hi", dimensions)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows, of = TaskContext.get().partitionId() << _SHIFT, [], None

        def made() -> pa.RecordBatch:
            nonlocal block, rows
            lists = list(zip(*rows))
            p = np.array(lists[7:])
            many = pa.list_(pa.int64())
            out = pa.RecordBatch.from_arrays(
                [pa.array([block]), pa.array([of[0]], kind), pa.array([of[1]]), *[pa.array([v]) for v in (*p.min(axis=1).tolist(), *p.max(axis=1).tolist())], *[pa.array([lists[k]], many) for k in (2, 3, 4, 5)], pa.array([b"".join(lists[6])], pa.binary())],
                names=["block", "label", "size", *low, *high, "k1", "k2", "copies", "first", "units"],
            )
            block, rows = block + 1, []
            return out

        for b in batches:
            kind = b.schema.field("label").type
            for row in zip(*[c.to_pylist() for c in b.columns]):
                if rows and (row[:2] != of or len(rows) >= max(1, min(BLOCK, BLOCK_NUMBERS // of[1]))):
                    yield made()
                of = row[:2]
                rows.append(row)
        if rows:
            yield made()

    return placed.mapInArrow(cut, ", ".join([f"block long, label {label}, size long", *[f"{c} double" for c in (*low, *high)], *[f"{c} array<long>" for c in ("k1", "k2", "copies", "first")], "units binary"]))


def _interval(level: int) -> Column:
    """The interval of a block: itself, 2^FAN neighbours, its partition, 2^FAN partitions, and so on."""
    block = F.col("block")
    if level == 0:
        return block
    partition = F.shiftright(block, _SHIFT)
    if level == 1:
        return F.shiftleft(partition, _SHIFT).bitwiseOR(F.shiftright(block.bitwiseAND(F.lit((1 << _SHIFT) - 1)), FAN))
    return F.shiftright(partition, FAN * (level - 2))


def near_blocks(blocks: DataFrame, epsilon: float, dimensions: int) -> DataFrame:
    """(a, b, tile_a, tile_b) of the pairs of blocks (a <= b) whose boxes, and those of all intervals around them, are within epsilon."""
    low, high = _names("lo", dimensions), _names("hi", dimensions)
    boxes = blocks.select("block", "label", "size", *low, *high)
    last = boxes.agg(F.max(F.shiftright("block", _SHIFT))).first()[0]
    top = 2
    while last >> (FAN * (top - 2)):
        top += 1
    least = [F.min(c).alias(c) for c in low] + [F.max(c).alias(c) for c in high]
    pairs = boxes.select("label", "size").distinct().select("label", "size", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    for level in range(top - 1, -1, -1):
        parts = boxes.groupBy("label", "size", _interval(level + 1).alias("up"), _interval(level).alias("at")).agg(*least)
        x, y = (parts.withColumnsRenamed({"up": s, "at": f"at_{s}"} | {c: f"{c}_{s}" for c in (*low, *high)}) for s in "ab")
        gap = lambda k: F.greatest(F.lit(0.0), F.col(f"lo{k}_a") - F.col(f"hi{k}_b"), F.col(f"lo{k}_b") - F.col(f"hi{k}_a"))
        apart = sum((gap(k) * gap(k) for k in range(dimensions + 1)), F.lit(0.0))
        left = pairs.join(x, ["label", "size", "a"]).join(y, ["label", "size", "b"]).where((F.col("at_a") <= F.col("at_b")) & (apart <= epsilon * epsilon + SLACK))
        tiles = [F.col("a").alias("tile_a"), F.col("b").alias("tile_b")] if level == 0 else []
        pairs = left.select("label", "size", F.col("at_a").alias("a"), F.col("at_b").alias("b"), *tiles)
    return pairs.drop("label", "size")


def _parts(linked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and columns of each connected part of a table of links between two blocks."""
    rows = linked.any(axis=1)
    while rows.any():
        own = np.zeros(len(rows), bool)
        own[int(rows.argmax())] = True
        while True:
            columns = linked[own].any(axis=0)
            more = linked[:, columns].any(axis=1)
            if (more == own).all():
                break
            own = more
        rows &= ~own
        yield np.flatnonzero(own), np.flatnonzero(columns)


def compared(pairs: DataFrame, blocks: DataFrame, cosine: float) -> DataFrame:
    """(id, n, root) of each vector that has partners in a tile: how many, copies counted, and one that it hangs together
    with. An id is the block and the place in it."""
    on = ["tile_a", "tile_b"]
    members = pairs.select(*on, F.col("a").alias("block")).unionByName(pairs.select(*on, F.col("b").alias("block"))).distinct().join(blocks.select("block", "size", "copies", "units"), "block")
    members = members.withColumnsRenamed({"tile_a": "of_a", "tile_b": "of_b"})
    within = math.sqrt(max(0.0, 2 - 2 * cosine - SLACK))

    def run(frame: pa.Table, held: pa.Table) -> pa.Table:
        at = {k: j for j, k in enumerate(held.column("block").to_pylist())}
        units = [np.frombuffer(u.as_buffer(), np.float64).reshape(-1, n) for u, n in zip(held.column("units"), held.column("size").to_pylist())]
        copies = [np.array(c, np.int64) for c in held.column("copies").to_pylist()]
        centre = [u.mean(axis=0) for u in units]
        radius = [float(np.sqrt(((u - c) ** 2).sum(axis=1).max())) for u, c in zip(units, centre)]
        counts = [np.zeros(len(u), np.int64) for u in units]
        up: dict[tuple[int, int], tuple[int, int]] = {}

        def find(v: tuple[int, int]) -> tuple[int, int]:
            while (w := up.get(v, v)) != v:
                up[v] = v = up.get(w, w)
            return v

        def join(i: int, rows: Iterator[int], j: int, columns: Iterator[int]) -> None:
            nodes = [(i, r) for r in rows] + [(j, c) for c in columns]
            root = find(nodes[0])
            for v in nodes[1:]:
                if (w := find(v)) != root:
                    up[w] = root

        for a, b in zip(frame.column("a").to_pylist(), frame.column("b").to_pylist()):
            i, j = at[a], at[b]
            if float(np.sqrt(((centre[i] - centre[j]) ** 2).sum())) + radius[i] + radius[j] <= within:
                counts[i] += copies[j].sum() - (copies[i] if i == j else 0)
                if i != j:
                    counts[j] += copies[i].sum()
                if i != j or len(copies[i]) > 1:
                    join(i, range(len(copies[i])), j, range(len(copies[j])))
                continue
            linked = units[i] @ units[j].T >= cosine
            if i == j:
                np.fill_diagonal(linked, False)
            if not linked.any():
                continue
            counts[i] += linked @ copies[j]
            if i != j:
                counts[j] += linked.T @ copies[i]
            for rows, columns in _parts(linked):
                join(i, rows.tolist(), j, columns.tolist())
        out = []
        names = list(at)
        for i, n in enumerate(counts):
            for r in np.flatnonzero(n).tolist():
                k, c = find((i, r))
                out.append(((names[i] << 8) + r, int(n[r]), (names[k] << 8) + c))
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*out) if out else [()] * 3)], names=["id", "n", "root"])

    return pairs.groupBy(*on).cogroup(members.groupBy("of_a", "of_b")).applyInArrow(run, "id long, n long, root long")


def near_vectors(vectors: DataFrame, cosine: float = 0.98, dimensions: int = DIMENSIONS, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector.

    Vectors of equal labels link if their cosine, in double precision, is `cosine` (over 0) or more. Defined results: null
    labels, and vectors that are null, empty, zero or hold a null or what is no finite number, link with nothing and are
    alone; vectors of different length do not link; equal vectors link, repeated rows and ids included; a null vec_id takes
    part, is nobody's smallest, and is kept only where its component has no other id; an empty table gives no rows; vectors
    may have any length; other columns are not read.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(embedding).alias("embedding"))
    rows = written(unit_vectors(rows), "units")
    key = ["label", "size", "k1", "k2"]
    classes = written(rows.where("unit IS NOT NULL").groupBy(*key).agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"), F.first("unit").alias("unit")), "classes")
    n = classes.count()
    alone = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not n:
        return alone
    epsilon = math.sqrt(max(0.0, 2 - 2 * cosine))
    blocks = written(blocks_in_order(classes, n, max(epsilon, 1e-6), dimensions), "blocks")
    found = written(compared(written(near_blocks(blocks, epsilon, dimensions), "pairs"), blocks, cosine), "linked")
    discard(classes)
    named = blocks.select("block", "label", "size", F.posexplode(F.arrays_zip("k1", "k2", "copies", "first")).alias("at", "x")).select((F.shiftleft("block", 8) + F.col("at")).alias("id"), "label", "size", "x.*")
    partners = found.groupBy("id").agg(F.sum("n").alias("n"))
    groups = components(found.select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "id")
    linked = named.join(partners, "id").join(groups, "id", "left").withColumn("root", F.coalesce("root", "id"))
    low = linked.groupBy("root").agg(F.min("first").alias("low"))
    told = linked.join(low, "root").select(*key, (F.col("n") + F.col("copies") - 1).alias("n"), "low")
    single = named.join(partners, "id", "left_anti").where("copies > 1").select(*key, (F.col("copies") - 1).alias("n"), F.col("first").alias("low"))
    out = rows.drop("unit").join(told.unionByName(single), key, "left")
    component = F.when(F.col("n").isNull(), F.col("vec_id")).otherwise(F.col("low"))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
