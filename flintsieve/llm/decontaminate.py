"""Benchmark decontamination: a BM25 index of test items that every training passage queries by block-max WAND.

The items are the indexed side: they are few beside the training texts. A document is cut into overlapping passages,
long enough that any item that stands in it lies whole in one. Each passage asks for all items whose BM25 score
reaches MIN_SCORE of the score that the item gives itself; what is found is verified: enough word 5-grams of the whole
item, enough of its question (all sentences but the last) and enough words of its answer (the last) must be in the passage.

Block maxima of the postings bound each group of neighbouring items. A passage sums the bounds of all groups at once,
and block-max WAND visits only what can reach the threshold. All bounds are rounded up, so nothing that reaches it is lost.
"""

from __future__ import annotations

import math
import re
import uuid
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flintsieve.llm.common import held, small_batches, written

K1, B = 1.2, 0.75
#: Share of an item's own score that a passage must reach; words of a gram; share of the item's grams, of its question's
#: grams, and of its answer's words, that the passage must have.
MIN_SCORE, GRAM, MIN_GRAMS, MIN_QUESTION, MIN_ANSWER = 0.5, 5, 0.8, 0.5, 0.5
#: Room for rounding in sums of scores, below which none is compared.
SLACK = 1e-9
#: Postings of a block, items whose bounds are summed together first, and items that are broadcast at a time.
BLOCK, TOGETHER, ITEMS = 16, 4, 50_000
#: Bytes of the table of bounds: rows of the terms that are in most groups. Other terms have short lists.
DENSE = 32 << 20
KEPT, KEPT_CHARS = 300_000, 40
_WORD = re.compile(r"\w+")
_END = re.compile(r"[.!?]+\s+")
_HITS = "item_id long, score double, gram_overlap double, question_overlap double, answer_overlap double"


class Index:
    """Normalised BM25 postings of items: a passage with all words of an item scores 1.

    Where the items are a block of more, `whole` has what depends on all: their number, words, longest length, and in how
    many of them each term of the block is.
    """

    def __init__(self, items: list[tuple[int | None, str]], whole: tuple[int, int, int, dict[str, int]] | None = None):
        split = [(i, _WORD.findall(x.lower()), len(_WORD.findall(_END.split(x.strip())[-1]))) for i, x in items if x]
        split = [(i, w, a) for i, w, a in split if w]
        self.items = [i for i, _, _ in split]
        self.terms: dict[str, int] = {}
        for _, w, _ in split:
            for t in w:
                self.terms.setdefault(t, len(self.terms))
        words = [[self.terms[t] for t in w] for _, w, _ in split]
        n, total, longest, df = whole or (len(words), sum(map(len, words)), max(map(len, words), default=1), Counter(t for _, w, _ in split for t in set(w)))
        mean = total / max(1, n)
        idf = {k: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) for t, k in self.terms.items()}
        self.at, self.weights = [array("i") for _ in self.terms], [array("d") for _ in self.terms]
        self.longest, self.answers, self.words = longest, [a or len(w) for _, w, a in split], [array("i", w) for w in words]
        for k, w in enumerate(words):
            tf = Counter(w)
            part = {t: idf[t] * f * (K1 + 1) / (f + K1 * (1 - B + B * len(w) / mean)) for t, f in tf.items()}
            own = sum(part.values())
            for t, v in part.items():
                self.at[t].append(k)
                self.weights[t].append(v / own)
        self.most = [max(p, default=0.0) for p in self.weights]
        self.blocks = [array("d", [max(p[i : i + BLOCK]) for i in range(0, len(p), BLOCK)]) for p in self.weights]
        self._bound(-(-max(1, len(words)) // TOGETHER))
        self.kept: dict[str, int] = {}

    @property
    def postings(self) -> list[list[tuple[int, float]]]:
        """By term: item and weight."""
        return [list(zip(a, w)) for a, w in zip(self.at, self.weights)]

    def _bound(self, groups: int) -> None:
        """By term, its largest weight among each TOGETHER neighbouring items, rounded up to 32 bits: in a row of a table of
        bounded size for terms that are in most groups, and as groups and weights for others."""
        self.few: list[tuple[np.ndarray, np.ndarray]] = []
        for at, weights in zip(self.at, self.weights):
            group, begin = np.unique(np.frombuffer(at, np.int32) // TOGETHER, return_index=True)
            most = np.maximum.reduceat(np.frombuffer(weights, np.float64), begin)
            self.few.append((group, np.nextafter(most.astype(np.float32), np.float32(2))))
        self.row, self.groups = np.full(len(self.terms), -1, np.int32), groups
        often = sorted(range(len(self.terms)), key=lambda t: -len(self.few[t][0]))[: DENSE // (4 * groups)]
        self.table, self.whole = np.zeros((len(often), groups), np.float32), len(often) == len(self.terms)
        for k, t in enumerate(often):
            self.row[t] = k
            self.table[k, self.few[t][0]] = self.few[t][1]

    def can_reach(self, terms: np.ndarray) -> bool:
        """Whether the bound of any group of items reaches MIN_SCORE."""
        rows = self.row[terms]
        bound = self.table[rows if self.whole else rows[rows >= 0]].sum(axis=0)
        if not self.whole and (rest := [self.few[t] for t in terms[rows < 0].tolist()]):
            bound = bound + np.bincount(np.concatenate([g for g, _ in rest]), np.concatenate([m for _, m in rest]), self.groups)
        # A sum of n numbers of 32 bits is at most n * 2^-24 of itself too small.
        return bound.max() * (1 + 1.2e-7 * len(terms)) >= MIN_SCORE - SLACK

    def ids(self, text: str) -> np.ndarray:
        """Term ids of the words of a text, -1 for words that no item has."""
        chunks, kept = text.lower().split(), self.kept
        for c in {c for c in chunks if c not in kept}:
            words = _WORD.findall(c)
            if len(words) > 1 or len(c) > KEPT_CHARS or len(kept) >= KEPT:
                if len(kept) >= KEPT:
                    kept.clear()
                return np.array([self.terms.get(w, -1) for w in _WORD.findall(text.lower())], np.int32)
            kept[c] = self.terms.get(words[0], -1) if words else -2
        out = np.fromiter(map(kept.__getitem__, chunks), np.int32, len(chunks))
        return out[out != -2] if (out == -2).any() else out

    def above(self, terms: list[int]) -> list[tuple[int, float]]:
        """All items that the distinct terms score MIN_SCORE or more, by block-max WAND."""
        least = MIN_SCORE - SLACK
        lists = [[0, t] for t in terms if self.at[t]]
        out = []
        while lists:
            lists.sort(key=lambda c: self.at[c[1]][c[0]])
            total, pivot = 0.0, -1
            for k, (_, t) in enumerate(lists):
                total += self.most[t]
                if total >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = self.at[lists[pivot][1]][lists[pivot][0]]
            while pivot + 1 < len(lists) and self.at[lists[pivot + 1][1]][lists[pivot + 1][0]] == item:
                pivot += 1
            head = lists[: pivot + 1]
            bound, ends = 0.0, [self.at[t][c] for c, t in lists[pivot + 1 : pivot + 2]]
            for c, t in head:
                k = bisect_left(self.at[t], item, c) // BLOCK
                if k < len(self.blocks[t]):
                    bound += self.blocks[t][k]
                    if (k + 1) * BLOCK < len(self.at[t]):
                        ends.append(self.at[t][(k + 1) * BLOCK])
            if bound >= least:
                score, to = 0.0, item + 1
                for c, t in head:
                    k = bisect_left(self.at[t], item, c)
                    if k < len(self.at[t]) and self.at[t][k] == item:
                        score += self.weights[t][k]
                if score >= least:
                    out.append((item, score))
            else:  # no item before the end of these blocks, or before the next list begins, can reach it
                to = max(item + 1, min(ends, default=len(self.items)))
            for x in head:
                x[0] = bisect_left(self.at[x[1]], to, x[0])
            lists = [x for x in lists if x[0] < len(self.at[x[1]])]
        return out

    def hits(self, text: str) -> dict[int, tuple[float, float, float, float]]:
        """item index: (score, overlaps of grams, question and answer) of the verified items of a whole text."""
        ids, found = self.ids(text), {}
        n, step = len(ids), self.longest
        for at in range(0, max(1, n - step), step) if n else ():
            part = ids[at : at + 2 * step]
            known = np.sort(part[part >= 0])
            known = known[np.append(known[1:] != known[:-1], True)] if len(known) else known
            if not len(known) or not self.can_reach(known):
                continue
            words = part.tolist()
            for k, score in self.above(known.tolist()):
                item = self.words[k].tolist()
                cut = len(item) - self.answers[k]
                whole, question, answer = _shared(item, words), _shared(item[:cut] or item, words), set(item[cut:])
                answered = len(answer & set(words)) / len(answer)
                if whole >= MIN_GRAMS and question >= MIN_QUESTION and answered >= MIN_ANSWER and (score, whole) > found.get(k, (0.0, 0.0))[:2]:
                    found[k] = (score, whole, question, answered)
        return found


def _shared(item: list[int], words: list[int]) -> float:
    """Share of the distinct grams of an item (of one as long as the item, if it is short) that the words have."""
    size = min(GRAM, len(item))
    grams = {tuple(item[i : i + size]) for i in range(len(item) - size + 1)}
    return len(grams & {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}) / len(grams)


def _words(items: DataFrame) -> DataFrame:
    """The words of each item that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            split = (_WORD.findall(x.lower()) for x in b.column("t").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([w for w in split if w], pa.list_(pa.string()))], names=["w"])

    return items.select("t").mapInArrow(run, "w array<string>")


def _ordered(items: DataFrame) -> list[tuple[int | None, str]]:
    """The items of one broadcast by id, null ids last."""
    return sorted(map(tuple, items.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def _blocks(docs: DataFrame, items: DataFrame, item_id: str, text: str) -> Iterator[tuple[object, str]]:
    """The items in broadcasts of at most about ITEMS, however many there are (none: one empty broadcast).

    With more than one, each also has the figures that depend on all items, so a score does not depend on the blocks.
    """
    spark = docs.sparkSession
    rows = items.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).where("t IS NOT NULL")
    n = -(-rows.count() // ITEMS) or 1
    if n == 1:
        yield spark.sparkContext.broadcast((_ordered(rows), None)), uuid.uuid4().hex
        return
    each = lambda x: _words(x).select(F.explode(F.array_distinct("w")).alias("term"))
    whole = _words(rows).agg(F.count("*"), F.coalesce(F.sum(F.size("w")), F.lit(0)), F.coalesce(F.max(F.size("w")), F.lit(1))).first()
    found_in = written(each(rows).groupBy("term").count(), "item-terms")
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        df = dict(map(tuple, found_in.join(each(part).distinct(), "term", "left_semi").select("term", "count").collect()))
        yield spark.sparkContext.broadcast((_ordered(part), (*whole, df))), uuid.uuid4().hex


def _index(sent: object, key: str) -> Index:
    return held(("items", key), lambda: Index(*sent.value))


def contaminated(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, score, overlaps of grams, question and answer) of each document and test item that stands in it.

    Defined results: null and empty texts of either side have no hits, items of a null id have theirs with a null item_id,
    repeated rows have each their own, of an item's equally good passages any stands for it, a null doc_id stays null, an empty table on either
    side gives no rows; other columns are not read; texts may have any length. No shuffle of documents.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = None
    for sent, key in _blocks(docs, items, item_id, item_text):

        def run(batches: Iterator[pa.RecordBatch], sent=sent, key=key) -> Iterator[pa.RecordBatch]:
            index = _index(sent, key)
            for b in batches:
                found = [(i, index.items[k], *v) for i, x in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()) if x for k, v in sorted(index.hits(x).items())]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.int64(), *[pa.float64()] * 4))], names=["doc_id", "item_id", "score", "gram_overlap", "question_overlap", "answer_overlap"])

        part = rows.mapInArrow(run, f"doc_id long, {_HITS}")
        out = part if out is None else out.unionByName(part)
    return out


def without_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs in whose text no test item stands; all columns are kept, and rows stay where they are.

    Defined results: null and empty texts stay, repeated rows fare alike, ids of either side play no part, an empty table on
    either side drops nothing."""
    small_batches(docs.sparkSession)
    for sent, key in _blocks(docs, items, item_id, item_text):

        def run(batches: Iterator[pa.RecordBatch], sent=sent, key=key) -> Iterator[pa.RecordBatch]:
            index = _index(sent, key)
            for b in batches:
                yield b.filter(pa.array([not x or not index.hits(x) for x in b.column(text).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
