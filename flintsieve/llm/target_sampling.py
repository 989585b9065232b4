"""Importance resampling towards a target set: documents whose words look like the target's are drawn more often.

Words (or runs of words) fall into buckets by hash. Counts of both sides give each bucket a gain, the log ratio of its
target and corpus shares, and a document's weight is the mean gain of its features, looked up in one array. A Gumbel
number hashed from the document's id is added, so taking the highest scores is a draw without replacement by weight.

The draw is a merge, not a global sort. Each task sorts its eligible rows into runs and cuts them at bounds of
(score, doc_id, row) that a histogram of scores gives; the pieces of one range meet in one task, which merges its runs by
a tournament tree and stops when the draw is complete. Ranges beyond the draw are never sent. The histogram also tells how
many rows stand before a range, so ranks need no pass over all rows. Scores that very many rows share are cut further by
doc_id, and ids that very many rows share by row, so no range is larger than RANGE, about.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flintsieve.llm.common import range_bounds, range_of, small_batches, written

#: Rows of a range of the merge, about, and of a run at most.
RANGE, RUN = 100_000, 100_000
#: Words whose buckets a task keeps.
KEPT = 500_000
#: What becomes of each byte: A-Z turn small, digits, a-z and bytes of other letters stay, all else parts words.
_SEEN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class _Buckets(dict):
    """The bucket of each word, of a bounded number of words."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, word: bytes) -> int:
        out = zlib.crc32(word) % self.buckets
        if len(self) < KEPT:
            self[word] = out
        return out


def features(text: str, runs: int, known: _Buckets) -> tuple[int, np.ndarray]:
    """The number of words of a text, and the bucket of each run of 1 to so many consecutive words."""
    words = text.encode().translate(_SEEN).split()
    out = list(map(known.__getitem__, words))
    for n in range(2, runs + 1):
        out += [zlib.crc32(b" ".join(words[i : i + n])) % known.buckets for i in range(len(words) - n + 1)]
    return len(words), np.array(out, np.int64)


def bucket_counts(docs: DataFrame, runs: int, buckets: int, text: str = "text") -> np.ndarray:
    """Features of all rows by bucket. Each task sends one row for each bucket at most."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = _Buckets(buckets), np.zeros(buckets, np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                counts += np.bincount(features(x or "", runs, known)[1], minlength=buckets)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    found = docs.select(text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's shares, one added to every bucket, rounded down."""
    n, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def noise(seed: int, doc_id: int | None) -> int:
    """Thousandths of a Gumbel number that the seed and the id fix; a null id counts as an empty one."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, runs: int, seed: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, doc_id, n_words, n_features, weight, score) of every document; row is unique."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(gain)  # one number for each bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain, row = sent.value, TaskContext.get().partitionId() << 40
        known = _Buckets(len(gain))
        for b in batches:
            out = []
            for i, x in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                words, found = features(x or "", runs, known)
                weight = int(gain[found].sum()) // len(found) if len(found) else 0
                out.append((row, i, words, len(found), weight, weight + noise(seed, i)))
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [()] * 6)], names=["row", "doc_id", "n_words", "n_features", "weight", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "row long, doc_id long, n_words long, n_features long, weight long, score long")


def _parted(rows: DataFrame, start: tuple, keys: list[str], most: int) -> list[tuple[tuple, int]]:
    """(first place, rows) of ranges of rows that share what stands in start, ascending; cut by the first key, and where many
    share that, by the next."""
    out = []
    n, absent = rows.agg(F.count("*"), F.count_if(F.col(keys[0]).isNull())).first()
    there = rows.where(F.col(keys[0]).isNotNull())
    bounds = range_bounds(there, keys[0], math.ceil((n - absent) / most)) if n - absent > most else []
    # A key that many rows share is a range of its own.
    bounds = sorted({*bounds, *(b + 1 for b in bounds if b < (1 << 63) - 1)})
    found = dict(there.groupBy(range_of(F.col(keys[0]), bounds)).count().collect()) if n > absent else {}
    places = [(start + (False, -(1 << 63) if not k else bounds[k - 1]), found[k], None if not k or k == len(bounds) or bounds[k] != bounds[k - 1] + 1 else bounds[k - 1]) for k in sorted(found)]
    for at, count, only in places:
        if count > most and only is not None and keys[1:]:
            out += _parted(there.where(F.col(keys[0]) == only), at, keys[1:], most)
        else:
            out.append((at, count))
    if absent > most and keys[1:]:
        out += _parted(rows.where(F.col(keys[0]).isNull()), start + (True, 0), keys[1:], most)
    elif absent:
        out.append((start + (True, 0), absent))
    return out


def ranges(eligible: DataFrame, draw: int, most: int = RANGE) -> tuple[list[tuple[tuple, int]], int]:
    """(first place, rows) of ranges that hold the first `draw` rows by (score descending, doc_id, row), and the lowest score.

    A place is (-score, id is null, id, False, row), or the beginning of one. Scores are whole numbers between fixed bounds
    (the log ratios of 64-bit counts and the noise are under 10^5 thousandths), so their histogram is bounded."""
    found = eligible.groupBy("score").count().toArrow()
    out: list[tuple[tuple, int]] = []
    taken, open_, low = 0, False, 0
    for score, n in sorted(zip(found.column(0).to_pylist(), found.column(1).to_pylist()), reverse=True):
        if taken >= draw:
            break
        if n > most:
            out += _parted(eligible.where(F.col("score") == score), (-score,), ["doc_id", "row"], most)
            open_ = False
        elif open_ and out[-1][1] + n <= most:
            out[-1] = (out[-1][0], out[-1][1] + n)
        else:
            out.append(((-score,), n))
            open_ = True
        taken, low = taken + n, score
    return out, low


class Tournament:
    """A tree of losers over k sorted runs: the next row costs one comparison for each level."""

    def __init__(self, runs: Iterable[Iterable[tuple]]):
        self.runs = [iter(r) for r in runs]
        self.k = max(1, len(self.runs))
        self.heads: list[tuple | None] = [next(r, None) for r in self.runs] or [None]
        self.losers = [-1] * self.k
        winners = [-1] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.winner = winners[1] if self.k > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and x <= y)

    def __iter__(self) -> Iterator[tuple]:
        while (head := self.heads[self.winner]) is not None:
            yield head
            at = self.winner
            self.heads[at] = next(self.runs[at], None)
            node = (at + self.k) // 2
            while node:
                if self._before(self.losers[node], at):
                    self.losers[node], at = at, self.losers[node]
                node //= 2
            self.winner = at


def _place(score: int, doc_id: int | None, row: int) -> tuple:
    return (-score, doc_id is None, doc_id or 0, False, row)


def _pieces(rows: DataFrame, starts: list[tuple], needed: int) -> DataFrame:
    """Runs of each task's rows in order, cut at the first places of ranges: (part, run, scores, ids, rows) of needed parts."""
    kind = "part long, run long, score array<long>, doc_id array<long>, row array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, waiting = TaskContext.get().partitionId() << 32, []

        def cut() -> pa.RecordBatch:
            nonlocal number, waiting
            places, out, at = sorted(waiting), [], 0
            while at < len(places):
                part = max(0, bisect_right(starts, places[at]) - 1)
                if part >= needed:
                    break
                end = bisect_left(places, starts[part + 1], at + 1) if part + 1 < len(starts) else len(places)
                out.append((part, number, [-p[0] for p in places[at:end]], [None if p[1] else p[2] for p in places[at:end]], [p[4] for p in places[at:end]]))
                at = end
            number, waiting = number + 1, []
            long, many = pa.int64(), pa.list_(pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, (long, long, many, many, many))], names=["part", "run", "score", "doc_id", "row"])

        for b in batches:
            waiting += map(_place, *(b.column(c).to_pylist() for c in ("score", "doc_id", "row")))
            if len(waiting) >= RUN:
                yield cut()
        if waiting:
            yield cut()

    return rows.select("score", "doc_id", "row").mapInArrow(run, kind)


def ranked(eligible: DataFrame, draw: int, most: int = RANGE) -> DataFrame:
    """(row, rank) of the first `draw` rows of eligible (score, doc_id, row) by (score descending, doc_id, row), null ids last."""
    parts, low = ranges(eligible, draw, most)
    if not parts:
        return eligible.sparkSession.createDataFrame([], "row long, rank long")
    starts, before = [p for p, _ in parts], np.cumsum([0, *(n for _, n in parts)]).tolist()
    needed = sum(b < draw for b in before[:-1])

    def merge(key: tuple[pa.Scalar, ...], pieces: pa.Table) -> pa.Table:
        first = before[key[0].as_py()]
        runs = [map(_place, s, i, r) for s, i, r in zip(*(pieces.column(c).to_pylist() for c in ("score", "doc_id", "row")))]
        rows = []
        for place in Tournament(runs):
            if first + len(rows) >= draw:
                break
            rows.append(place[4])
        return pa.table({"row": pa.array(rows, pa.int64()), "rank": pa.array(range(first + 1, first + len(rows) + 1), pa.int64())})

    return _pieces(eligible.where(F.col("score") >= low), starts, needed).groupBy("part").applyInArrow(merge, "row long, rank long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, runs: int = 1, buckets: int = 10_000, least_words: int = 20, seed: int = 2024, doc_id: str = "doc_id", text: str = "text", most: int = RANGE) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; undrawn ones have no rank.

    Of the N documents with least_words words or more, the percent * N / 100 (rounded down) with the highest scores are
    drawn; ties go to the smaller doc_id, null ids last, rows of one id in the order of the table. Defined results: null and
    empty texts have no feature and weight 0; a null doc_id's noise is that of an empty one; repeated rows count and score
    each; empty tables of either side are counts of 0; texts may have any length; other columns are not read.
    """
    counts = bucket_counts(docs, runs, buckets, text), bucket_counts(target, runs, buckets, text)
    rows = written(scored(docs, gains(*counts), runs, seed, doc_id, text), "scored")
    eligible = rows.where(F.col("n_words") >= least_words)
    drawn = ranked(eligible, eligible.count() * percent // 100, most)
    return rows.join(drawn, "row", "left").select("doc_id", "n_features", "weight", "score", "rank")
