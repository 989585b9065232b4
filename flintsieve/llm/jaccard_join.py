"""Exact n-gram Jaccard self-join with adaptive multi-match prefixes, and the groups that its links make.

A document is its set of distinct word n-grams (as 64-bit hashes). Equal sets, told by 128-bit digests, become one class
at once. All classes order their grams alike, common ones last. If two sets overlap enough, their prefixes of n - t + l
grams share at least l grams, where t is the overlap that the pair needs. So each class picks its own l by estimated
cost: a prefix whose grams are common is lengthened, and in return a partner must share as many more of them before the
pair is verified on the whole sets. Where two classes pick different l, the smaller one holds for both. Pairs are found
by the shortest part of the prefixes, in which any linked pair shares a gram, and become candidates only if they share
as many grams as they ask for in the lengthened prefixes.

Very common grams would still pair every member of a large group of near copies with every other. So classes that
share them are first compared with one central class of the gram, and linked ones count as one group; only pairs of
different groups become candidates. This loses no link between groups, and so changes no component. Links inside a group
that hangs together already are not looked for.

The order comes from bounded tables of common grams and common words, counted over all documents: grams of the first
table come last, others by how frequent their words make them. The prefixes of this order are counted in turn, and what
is still common in them (passages that many documents share) joins the table. Any order is exact; this one puts grams
first that hardly any two different texts share.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flintsieve.llm.common import discard, fresh, released, small_batches, written
from flintsieve.llm.components import components

#: Grams and words of the tables of common ones; each task reports so many of its own; what a task counts at a time.
COMMON, REPORTED, AT_ONCE = 100_000, 20_000, 1_000_000
WORDS, REPORTED_WORDS = 20_000, 5_000
#: Bits of a hash by which words and grams are looked up at first.
PLACE_BITS = 20
#: Sets from which a gram counts as common in prefixes.
STILL = 4
#: Most shared grams that are asked for, and the cost of verifying a candidate in rows of the index.
MOST_MATCHES, VERIFY = 6, 100
#: Bits of the filter that spares sending the sets of documents without candidates; exact joins follow it.
FILTER_BITS = 1 << 24
#: Sets that a task knows to be counted, and bytes of a text that are read together.
KNOWN, PIECE = 100_000, 1 << 20
#: Classes of one side of a tile, in which pairs are verified, and of a bundle of small tiles, about.
TILE, BUNDLE = 256, 128
#: Rows to drop that are broadcast (24 bytes each); more are shuffled.
BROADCAST_ROWS = 500_000
#: Posts from which a gram's pairs are looked for by sizes and groups; sizes up to which each is a class, and the growth of
#: classes beyond.
HOT, EXACT, CLASS = 64, 32, 1.04
KEY = ["k1", "k2"]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A pseudo-random number for each byte, an odd base and its inverse modulo 2^64, and which bytes part words.
_BYTES, _BASE = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)), 0xD1342543DE82EF95
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


class _Powers:
    """Powers of the base and of its inverse, as many as the longest piece so far needs."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if n > len(self.up):
            power = lambda base: np.cumprod(np.append(np.ones(1, np.uint64), np.full(2 * n - 1, base, np.uint64)))
            self.up, self.down = power(_BASE), power(pow(_BASE, -1, 1 << 64))


_POWERS = _Powers()


def _word_hashes(raw: bytes) -> np.ndarray:
    """Hashes of the words of a piece: a polynomial of its bytes, from running sums over the whole piece."""
    data = np.frombuffer(raw, np.uint8)
    edge = np.flatnonzero(np.diff(_SPACE[data], prepend=True, append=True))
    begin, end = edge[::2], edge[1::2]
    _POWERS.grow(len(data))
    sums = np.append(np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * _POWERS.up[: len(data)]))
    return _mixed((sums[end] - sums[begin]) * _POWERS.down[begin] + (end - begin).astype(np.uint64))


def _hashes(text: str) -> np.ndarray:
    """Hashes of the words of a text; A-Z count as a-z, ASCII white space parts words. Long texts are read in pieces."""
    raw = text.encode().lower()
    if len(raw) <= PIECE:
        return _word_hashes(raw)
    out, at = [], 0
    while at < len(raw):
        end = at + PIECE
        while end < len(raw) and not _SPACE[raw[end]]:
            end += 1
        out.append(_word_hashes(raw[at:end]))
        at = end
    return np.concatenate(out)


def _windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of words, in order; of shorter texts of all words."""
    size = min(n, len(h))
    out = np.full(len(h) - size + 1 if size else 0, size, np.uint64)
    for i in range(size):
        out = (out ^ h[i : len(h) - size + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _first(ordered: np.ndarray) -> np.ndarray:
    return np.append(True, ordered[1:] != ordered[:-1]) if len(ordered) else np.zeros(0, bool)


def grams(text: str, n: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of a text."""
    out = _windows(_hashes(text), n)
    out.sort()
    return out[_first(out)]


def _keys(s: np.ndarray) -> tuple[int, int]:
    """The 128-bit digest of a set, which names its class."""
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _text_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _longs(*columns: list[int]) -> list[pa.Array]:
    return [pa.array(c, pa.int64()) for c in columns]


class _Counts:
    """The most frequent of many hashes, counted so many at a time."""

    def __init__(self, reported: int):
        self.reported, self.waiting, self.room, self.values, self.counts = reported, [], 0, [], []

    def add(self, hashes: np.ndarray) -> None:
        self.waiting.append(hashes)
        self.room += len(hashes)
        if self.room > AT_ONCE:
            self.count()

    def count(self) -> None:
        if self.waiting:
            v, c = np.unique(np.concatenate(self.waiting), return_counts=True)
            self.values.append(v[c > 1])
            self.counts.append(c[c > 1])
            self.waiting, self.room = [], 0

    def most(self) -> tuple[np.ndarray, np.ndarray]:
        self.count()
        if not self.values:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        v, at = np.unique(np.concatenate(self.values), return_inverse=True)
        c = np.bincount(at, np.concatenate(self.counts), len(v)).astype(np.int64)
        best = np.argsort(-c, kind="stable")[: self.reported]
        return v[best].view(np.int64), c[best]


def _described(docs: DataFrame, n: int) -> DataFrame:
    """A row for each document (its columns but the text, size and KEY), and rows of common grams and words of each task
    (gram or word, seen). Each set of a task is counted once, so that large groups of copies count little."""
    own = [c for c in docs.columns if c != "text"]
    fields = [f for f in docs.schema if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        counts, known, schema = (_Counts(REPORTED), _Counts(REPORTED_WORDS)), set(), None
        for b in batches:
            rows = []
            for x in b.column("text").to_pylist():
                h = _hashes(x or "")
                s = _windows(h, n)
                s.sort()
                s = s[_first(s)]
                key = _keys(s)
                rows.append((len(s), *key))
                if len(s) and key[0] not in known:
                    if len(known) < KNOWN:
                        known.add(key[0])
                    counts[0].add(s)
                    counts[1].add(h)
            none = [pa.nulls(len(rows), pa.int64())] * 3
            out = pa.RecordBatch.from_arrays([*[b.column(c) for c in own], *_longs(*(zip(*rows) if rows else ((),) * 3)), *none], names=[*own, "size", *KEY, "gram", "word", "seen"])
            schema = out.schema
            yield out
        for place, (v, c) in enumerate(x.most() for x in counts):
            if len(v):
                none = [pa.nulls(len(v), f.type) for f in schema][:-3]
                two = [pa.nulls(len(v), pa.int64())] * 2
                two[place] = pa.array(v)
                yield pa.RecordBatch.from_arrays([*none, *two, pa.array(c)], names=schema.names)

    return docs.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], "size long, k1 long, k2 long, gram long, word long, seen long"]))


def _table(described: DataFrame, kind: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The most common grams or words and their counts, ordered by hash: a table of bounded size, which only orders grams."""
    found = described.where(f"{kind} IS NOT NULL").groupBy(kind).agg(F.sum("seen").alias("n")).orderBy(F.desc("n"), kind).limit(most).toArrow()
    values, counts = found.column(kind).to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(values)
    return values[order], counts[order]


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    values, at = np.unique(np.concatenate((a[0], b[0])), return_inverse=True)
    counts = np.zeros(len(values), np.int64)
    np.maximum.at(counts, at, np.concatenate((a[1], b[1])))
    return values, counts


def _looked_up(table: np.ndarray, values: np.ndarray, keys: np.ndarray, other: float) -> np.ndarray:
    if not len(table):
        return np.full(len(keys), other)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, values[at], other)


def choose_matches(weights: np.ndarray, size: int, least: int, n: int) -> int:
    """How many shared grams to ask for: the cheapest l by the rows of the index that the prefix meets, and by the cost of
    verifying the candidates among n sets that share l of its grams by chance."""
    sums, best, cost = np.cumsum(weights), 1, float("inf")
    for k in range(1, min(MOST_MATCHES, least) + 1):
        met = float(sums[size - least + k - 1])
        if (c := met + (size - least + k) + VERIFY * n * min(1.0, met / n) ** k / math.factorial(k)) < cost:
            best, cost = k, c
    return best


def _prefixes(docs: DataFrame, n: int, percent: int, common: tuple, words: tuple, sets: int, shortest: bool = False) -> DataFrame:
    """(KEY, h, size, matches, rare, plain, prefix) of documents with grams. Of the prefix, all after `plain` are common.
    shortest: the prefix alone, for one shared gram, and of each set of a task once."""
    total = max(1, int(words[1].sum()))
    # Of a word that is not in the table we know that it is no more frequent than those that are.
    levels, unknown = np.log2(np.maximum(words[1], 1)).round(2), round(math.log2(max(1, int(words[1].min(initial=total)) / 2)), 2)
    # Levels lie by the low bits of the words' hashes. Words that share a place share a level, which is as good an order.
    places = np.full(1 << PLACE_BITS, unknown)
    places[words[0] & np.uint64((1 << PLACE_BITS) - 1)] = levels
    sent = docs.sparkSession.sparkContext.broadcast((*common, (100 * places).round().astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        table, seen, level = sent.value
        low, known = np.uint64((1 << PLACE_BITS) - 1), set()
        maybe = np.zeros(1 << PLACE_BITS, bool)  # tells most grams that are not in the table
        maybe[table & low] = True
        for b in batches:
            rows, ends, prefixes = [], [0], []
            for x in b.column("text").to_pylist():
                h = _hashes(x or "")
                if not len(h):
                    continue
                s = _windows(h, n)
                order = np.argsort(s)
                s = s[order]
                once = _first(s)
                width = min(n, len(h))
                sums = np.cumsum(np.append(0, level[h & low]))
                s, e = s[once], (sums[width:] - sums[:-width])[order[once]]
                w = np.zeros(len(s), np.int64)
                hot = np.flatnonzero(maybe[s & low])
                w[hot] = _looked_up(table, seen, s[hot], 0)
                size, least = len(s), -(-percent * len(s) // 100)
                # What comes first by (w, e, s): only so many places are put in order.
                place, most = (w << 32) + e, min(size, size - least + (1 if shortest else MOST_MATCHES))
                first = np.flatnonzero(place <= np.partition(place, most - 1)[most - 1])
                first = first[np.argsort(place[first], kind="stable")][:most]
                if shortest:
                    if (key := _keys(s)[0]) not in known:
                        if len(known) < KNOWN:
                            known.add(key)
                        prefixes.append(s[first].view(np.int64))
                    continue
                chance = np.exp2(np.minimum(60, e[first] / 100 - (width - 1) * math.log2(total)))
                k = choose_matches(np.maximum(w[first], chance), size, least, sets)
                prefix = s[first[: size - least + k]].view(np.int64)
                rare = size - int(np.count_nonzero(w))
                rows.append((*_keys(s), _text_hash(x), size, k, rare, min(rare, len(prefix))))
                prefixes.append(prefix)
                ends.append(ends[-1] + len(prefix))
            grams = pa.array(np.concatenate([*prefixes, np.zeros(0, np.int64)]))
            if shortest:
                yield pa.RecordBatch.from_arrays([grams], names=["gram"])
                continue
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), grams)
            yield pa.RecordBatch.from_arrays([*_longs(*(zip(*rows) if rows else ((),) * 7)), listed], names=[*KEY, "h", "size", "matches", "rare", "plain", "prefix"])

    return docs.mapInArrow(run, "gram long" if shortest else "k1 long, k2 long, h long, size long, matches long, rare long, plain long, prefix array<long>")


def _slot(key: Column) -> Column:
    return F.pmod(key, F.lit(FILTER_BITS)).cast("int")


def _sets(docs: DataFrame, n: int, nodes: DataFrame) -> DataFrame:
    """(KEY, grams) of the classes in nodes, and of a few others. A bit field of a fixed 2 MB, on the hash of one text of each
    class, tells most others before they are parted into words."""
    words = nodes.select(_slot(F.col("h")).alias("s")).distinct().groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, s & 63)")).alias("m"))
    field = np.zeros(FILTER_BITS // 64, np.int64)
    found = words.toArrow()
    field[found.column("w").to_numpy()] = found.column("m").to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        on = np.unpackbits(sent.value.view(np.uint8), bitorder="little").astype(bool)
        for b in batches:
            keys, sets = [], []
            for x in b.column("text").to_pylist():
                if x and on[_text_hash(x) % FILTER_BITS] and len(s := grams(x, n)):
                    keys.append(_keys(s))
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([*_longs(*(zip(*keys) if keys else ((), ()))), pa.array(sets, pa.binary())], names=[*KEY, "grams"])

    return docs.mapInArrow(run, "k1 long, k2 long, grams binary").groupBy(*KEY).agg(F.first("grams").alias("grams"))


def _linked(docs: DataFrame, n: int, percent: int, indexed: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b) of links that connect whatever the linked ones of the pairs (a, b, lead) connect, written.

    Pairs with one lead meet in tiles of at most about TILE classes a side, so a set is sent once for each tile, not for
    each pair, and no tile is large whatever the group is; small tiles share a bundle. Inside a tile a pair that is
    connected already is passed over.
    """
    ends = pairs.select("lead", F.col("a").alias("id")).unionByName(pairs.select("lead", F.col("b").alias("id"))).distinct()
    parts = ends.groupBy("lead").agg(F.ceil(F.count("*") / TILE).cast("int").alias("k"))
    nodes = written(ends.select("id").distinct().join(indexed.select("id", *KEY, "h"), "id"), "nodes")
    bundles = max(1, nodes.count() // BUNDLE)
    block = lambda c: F.pmod(F.xxhash64(c), F.col("k")).cast("int")
    alone = F.col("k") == 1
    tile = [F.when(alone, F.pmod(F.xxhash64("lead"), F.lit(bundles))).otherwise(F.col("lead")).alias("tile"), F.when(alone, F.lit(-1)).otherwise(block("a")).alias("i"), F.when(alone, F.lit(-1)).otherwise(block("b")).alias("j")]
    tiled = written(pairs.join(parts, "lead").select(*tile, "a", "b"), "tiles")
    on = ["tile", "i", "j"]
    members = tiled.select(*on, F.col("a").alias("id")).unionByName(tiled.select(*on, F.col("b").alias("id"))).distinct().join(nodes.drop("h"), "id")
    held_by = ["r", "p", "q"]
    members = members.join(_sets(docs, n, nodes), KEY).select(*[F.col(c).alias(x) for c, x in zip(on, held_by)], "id", "grams")

    def run(frame: pa.Table, sets: pa.Table) -> pa.Table:
        grams_of = {k: np.frombuffer(g.as_buffer(), np.uint64) for k, g in zip(sets.column("id").to_pylist(), sets.column("grams"))}
        up: dict[int, int] = {}

        def find(v: int) -> int:
            while (w := up.get(v, v)) != v:
                up[v] = v = up.get(w, w)
            return v

        out = []
        for a, b in zip(frame.column("a").to_pylist(), frame.column("b").to_pylist()):
            if (x := find(a)) == (y := find(b)):
                continue
            s, t = grams_of[a], grams_of[b]
            both = np.concatenate((s, t))
            both.sort(kind="stable")
            if int((both[1:] == both[:-1]).sum()) >= -(-percent * (len(s) + len(t)) // (100 + percent)):
                up[x] = y
                out.append((a, b))
        return pa.table(_longs(*(zip(*out) if out else ((), ()))), names=["a", "b"])

    links = written(tiled.groupBy(*on).cogroup(members.groupBy(*held_by)).applyInArrow(run, "a long, b long"), "links")
    discard(nodes, tiled)
    return links


def _need(x: str, y: str, percent: int) -> str:
    """SQL of the grams that sets of two sizes have to share."""
    return f"(({percent} * ({x} + {y}) + {99 + percent}) div {100 + percent})"


def _inside(percent: int) -> str:
    """SQL of whether the posts x and y can be the first shared ones of a pair that links: enough grams follow."""
    need = _need("x.m div 8", "y.m div 8", percent)
    return f"x.pos <= x.m div 8 - {need} AND y.pos <= y.m div 8 - {need}"


def _met(posts: DataFrame, on: list[str], percent: int) -> DataFrame:
    """(a, b, k) of the posts' pairs of different groups, and how many grams they ask for."""
    met = posts.alias("x").join(posts.alias("y"), on).where(f"x.id < y.id AND x.root <> y.root AND {_inside(percent)}")
    return met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.expr("least(x.m % 8, y.m % 8)").alias("k"))


def _met_hot(posts: DataFrame, percent: int) -> DataFrame:
    """The same of grams with many posts, without looking at every two of them.

    A place and a size leave only some sizes for a partner. So posts meet by gram and classes of both sizes, each post in
    the few classes that its partners may have, once as the smaller and once as the larger side; there groups meet first,
    and posts of different groups only."""
    kind = lambda c: f"IF({c} < {EXACT}, {c}, CAST(floor({EXACT} + ln({c} / {EXACT}) / ln({CLASS})) AS BIGINT))"
    # The most that a partner may have for `size - pos` grams to be enough, and the least that it must have.
    rows = posts.withColumn("size", F.expr("m div 8")).withColumn("high", F.expr(f"((size - pos) * {100 + percent}) div {percent} - size")).withColumn("low", F.expr(f"({percent} * size + 99) div 100"))
    smaller = rows.where("high >= size").withColumn("large", F.expr(f"explode(sequence({kind('size')}, {kind('least(high, size * 100 div ' + str(percent) + ')')}))")).withColumn("small", F.expr(kind("size")))
    larger = rows.where("least(size, high) >= low").withColumn("small", F.expr(f"explode(sequence({kind('low')}, {kind('least(size, high)')}))")).withColumn("large", F.expr(kind("size")))
    on = ["gram", "small", "large"]
    # Of each group its best post: the most grams that follow, and the smallest size.
    best = lambda side, t: side.groupBy(*on, F.col("root").alias(f"root_{t}")).agg(F.expr(f"max(size - pos) AS left_{t}"), F.expr(f"min(size) AS size_{t}"))
    enough = " AND ".join(f"{percent} * (size_x + size_y) <= {100 + percent} * left_{t}" for t in "xy")
    groups = best(smaller, "x").join(best(larger, "y"), on).where(f"root_x <> root_y AND {enough}").select(*on, "root_x", "root_y", "size_y", "left_y")
    columns = [*on, "id", "root", "m", "pos"]
    x = smaller.select(columns).withColumnRenamed("root", "root_x").alias("x")
    y = larger.select(columns).withColumnRenamed("root", "root_y").alias("y")
    # Then each post of one side that can link with the other group's best, and only then the posts of that group.
    able = " AND ".join(f"{percent} * (x.m div 8 + size_y) <= {100 + percent} * {left}" for left in ("(x.m div 8 - x.pos)", "left_y"))
    met = groups.join(x, [*on, "root_x"]).where(able).join(y, [*on, "root_y"]).where(f"(x.m div 8 < y.m div 8 OR (x.m div 8 = y.m div 8 AND x.id < y.id)) AND {_inside(percent)}")
    return met.select(F.expr("least(x.id, y.id)").alias("a"), F.expr("greatest(x.id, y.id)").alias("b"), F.expr("least(x.m % 8, y.m % 8)").alias("k"))


def _classes(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of docs (text and other columns): a row for each with size and KEY instead of the text, and (KEY, root) of the
    classes that links connect to others. Classes that are alone have no root."""
    small_batches(docs.sparkSession)
    described = written(_described(docs, words), "described")
    rows = described.where("k1 IS NOT NULL").drop("gram", "word", "seen")
    # One row for each class, however many equal copies it has.
    one = ["h", "size", "matches", "rare", "plain", "prefix"]
    common, frequent, n = _table(described, "gram", COMMON), _table(described, "word", WORDS), max(1, rows.count())
    still = _prefixes(docs, words, percent, common, frequent, n, shortest=True).groupBy("gram").agg(F.count("*").alias("seen")).where(f"seen >= {STILL}")
    found = _prefixes(docs, words, percent, _merged(common, _table(still, "gram", COMMON)), frequent, n)
    indexed = written(found.groupBy(*KEY).agg(*[F.first(c).alias(c) for c in one]).withColumn("id", F.monotonically_increasing_id()), "prefixes")

    # Stars: each class with common grams is compared with the central class of most of them. Centres are COMMON at most.
    hot = indexed.select("id", "size", "rare", F.explode(F.expr("slice(prefix, CAST(plain + 1 AS INT), size(prefix))")).alias("gram"))
    centre = hot.groupBy("gram").agg(F.min(F.struct("rare", "id", "size")).alias("c"))
    star = (
        hot.join(F.broadcast(centre), "gram").where(f"c.id <> id AND 100 * least(size, c.size) >= {percent} * greatest(size, c.size)")
        .groupBy(F.col("id").alias("a"), F.col("c.id").alias("b")).agg(F.count("*").alias("n"))
    )
    star = written(star.groupBy("a").agg(F.max(F.struct("n", "b")).alias("m")).select("a", "m.b", F.col("m.b").alias("lead")), "stars")
    links = _linked(docs, words, percent, indexed, star)
    near = links.select(F.col("a").alias("id"), F.col("b").alias("centre"))
    # A centre may have a centre of its own.
    far = near.select(F.col("id").alias("centre"), F.col("centre").alias("further"))
    groups = near.join(far, "centre", "left").groupBy("id").agg(F.min(F.coalesce("further", "centre")).alias("root"))

    # The index: the shortest prefixes, in which any linked pair shares a gram.
    least = f"({percent} * size + 99) div 100"
    posts = indexed.join(groups, "id", "left").select("id", F.coalesce("root", "id").alias("root"), F.expr("size * 8 + matches").alias("m"), F.posexplode(F.expr(f"slice(prefix, 1, CAST(size - {least} + 1 AS INT))")).alias("pos", "gram"))
    # A gram that one group alone has brings no two groups together.
    shared = posts.groupBy("gram").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("seen")).where("low <> high").select("gram", "seen")
    posts = written(posts.join(shared, "gram"), "posts")
    met = _met(posts.where(f"seen < {HOT}"), ["gram"], percent).unionByName(_met_hot(posts.where(f"seen >= {HOT}"), percent))
    met = written(met.distinct(), "met")
    # Of those that ask for more, the lengthened prefixes must share as many grams.
    more = indexed.where("matches > 1").select("id", "size", "prefix")
    both = met.where("k > 1").join(more.toDF("a", "n_a", "p_a"), "a").join(more.toDF("b", "n_b", "p_b"), "b")
    need = _need("n_a", "n_b", percent)
    part = lambda t: f"slice(p_{t}, 1, CAST(n_{t} - {need} + k AS INT))"
    enough = both.where(f"size(array_intersect({part('a')}, {part('b')})) >= k")
    pairs = written(met.where("k = 1").select("a", "b").unionByName(enough.select("a", "b")), "pairs")
    # The lead of a pair: the least partner of its smaller class.
    least = pairs.groupBy(F.col("b").alias("a")).agg(F.min("a").alias("m"))
    more = _linked(docs, words, percent, indexed, pairs.join(least, "a", "left").select("a", "b", F.coalesce("m", "a").alias("lead")))
    discard(star, posts, met, pairs)
    groups = components(links.unionByName(more))
    named = written(groups.withColumnRenamed("node", "id").join(indexed.select("id", *KEY), "id").select(*KEY, "root"), "classes")
    discard(indexed, links, more)
    return rows, named


def _with_least(rows: DataFrame, named: DataFrame, value: Column) -> DataFrame:
    """rows with grams, with the least value of all that hang together as `best`."""
    classes = rows.where("size > 0").groupBy(*KEY).agg(F.min(value).alias("first")).join(named, KEY, "left")
    linked = classes.where("root IS NOT NULL")
    low = linked.groupBy("root").agg(F.min("first").alias("low"))
    best = linked.join(low, "root").select(*KEY, F.col("low").alias("best")).unionByName(classes.where("root IS NULL").select(*KEY, F.col("first").alias("best")))
    return rows.where("size > 0").join(best, KEY)


def near_groups(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) of every document.

    Two documents link if their sets' Jaccard similarity is percent / 100 or more. Defined results: texts without a
    word (or null) have no set and are alone; shorter texts than an n-gram are one gram; equal sets link, repeated rows
    included; rows of one doc_id with different texts are compared as different documents; a null doc_id takes part,
    and is nobody's smallest; an empty table gives no rows; other columns are not read, so none can clash; texts may
    have any length.
    """
    rows, named = _classes(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), words, percent)
    return (
        _with_least(rows, named, F.col("doc_id")).select("doc_id", F.col("size").alias("n_shingles"), F.col("best").alias("component_id"))
        .unionByName(rows.where("size = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id")))
    )


def without_near_copies(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with one row of each group of near copies: that of the smallest doc_id, null ids last.

    Rows count, not ids: of rows that are alike in everything one stays, and rows of one doc_id with texts that are not
    near copies all stay. Texts without a word, and null ones, are copies of nothing and stay. All columns are kept.
    """
    file, at = fresh(docs, "file_key", "row_key")
    placed = lambda d: d.withColumns({file: F.xxhash64("_metadata.file_path"), at: F.col("_metadata.row_index")})
    try:
        docs, columns = placed(docs), docs.columns
        docs.schema
    except AnalysisException:  # no rows of files, so they are written once, to have places
        docs, columns = placed(written(docs, "rows")), docs.columns
    place = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("doc_id"), F.col(file).alias("file"), F.col(at).alias("at"))
    rows, named = _classes(docs.select(place.alias("place"), F.col(text).alias("text")), words, percent)
    lost = written(_with_least(rows, named, F.col("place")).where("place <> best").select(F.col("place.file").alias(file), F.col("place.at").alias(at)), "lost")
    if lost.count() <= BROADCAST_ROWS:
        lost = F.broadcast(lost)
    return docs.join(lost, [file, at], "left_anti").select(columns)
