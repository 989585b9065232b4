"""Byte-level BPE encoding and decoding with a contiguous rank array.

A short word is held as an array of part boundaries with the rank of each adjacent pair beside it. The smallest rank
is looked for again and again; its boundary is deleted and the ranks of the two neighbours are refreshed. Words beyond
SHORT bytes take a heap over a linked list instead, as repeated scans are quadratic. Each worker keeps the ids of the
chunks it has seen in a bounded table.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flintsieve.llm.common import held, small_batches

#: Bytes up to which a word is short.
SHORT = 96
#: Chunks that a worker keeps, and the longest chunk it keeps.
KEPT, KEPT_CHARS = 400_000, 48
_SPACE = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
#: Bits of an id, and what stands for the rank of a pair that is never merged.
_BITS = 20
_NONE = 1 << 60
_MASK = (1 << _BITS) - 1
#: After a word of letters alone, each of these is a word of its own.
_MARKS = frozenset(".,;:!?|")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """A vocabulary file of the tokenizers library with a byte-level pre-tokenizer, read without that library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            t = json.load(f)
        letters = byte_letters()
        to_bytes = lambda s: bytes(letters[c] for c in s)
        vocab = t["model"]["vocab"]
        self.ids = {to_bytes(k): v for k, v in vocab.items()}
        # By the two ids of a pair: its rank, and in the low bits the id it becomes.
        self.pairs: dict[int, int] = {}
        for rank, m in enumerate(t["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.pairs.setdefault(vocab[a] << _BITS | vocab[b], rank << _BITS | vocab[a + b])
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]
        self.special = {x["content"]: x["id"] for x in t["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        size = max([*vocab.values(), *self.special.values()]) + 1
        table = [b""] * size
        for k, v in self.ids.items():
            table[v] = k
        for k, v in self.special.items():
            table[v] = k.encode()
        self.blob = np.frombuffer(b"".join(table), np.uint8)
        self.sizes = np.array([len(x) for x in table], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))
        self.names = [str(i) for i in range(size)]
        self.words = regex.compile(PATTERN)
        self.kept: dict[str, bytes] = {}

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word of the pre-tokenizer."""
        if len(word) > SHORT:
            return self.merge_long(word)
        parts = [self.byte_ids[b] for b in word]
        rank = self.pairs.get
        ranks = [rank(a << _BITS | b, _NONE) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            i = ranks.index(least)
            parts[i] = new = least & _MASK
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] << _BITS | new, _NONE)
            if i < len(ranks):
                ranks[i] = rank(new << _BITS | parts[i + 1], _NONE)
        return parts

    def merge_long(self, word: bytes) -> list[int]:
        parts = [self.byte_ids[b] for b in word]
        n, rank = len(parts), self.pairs.get
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(p, i, parts[i], parts[i + 1]) for i in range(n - 1) if (p := rank(parts[i] << _BITS | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            p, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j], after[i] = p & _MASK, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (p := rank(parts[x] << _BITS | parts[y])) is not None:
                    heapq.heappush(heap, (p, x, parts[x], parts[y]))
        return [p for p, live in zip(parts, alive) if live]

    def _slow(self, text: str) -> bytes:
        merge = self.merge
        return array("I", [i for w in self.words.findall(text) for i in merge(w.encode())]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a space and the chunk after it."""
        if chunk.isalpha():
            return array("I", self.merge(b" " + chunk.encode())).tobytes()
        if chunk[-1] in _MARKS and (word := chunk[:-1]).isalpha():
            return (self.kept.get(word) or self._chunk(word)) + array("I", [self.byte_ids[ord(chunk[-1])]]).tobytes()
        return self._slow(" " + chunk)

    def _plain(self, text: str) -> bytes:
        """Ids of text without special tokens. A lone space between two other characters always begins a word of the
        pre-tokenizer, so chunks between such spaces are encoded on their own; other texts take the slow way."""
        if not text:
            return b""
        first, *chunks = text.split(" ")
        kept = self.kept
        if not chunks or not first or first[-1].isspace():
            return self._slow(text)
        try:
            return self._slow(first) + b"".join(map(kept.__getitem__, chunks))
        except KeyError:
            pass
        new = {c for c in chunks if c not in kept}
        if any(not c or c[0].isspace() or c[-1].isspace() for c in new):
            return self._slow(text)
        if len(kept) + len(new) > KEPT:
            kept.clear()
            new = set(chunks)
        rare = {}
        for c in new:
            (kept if len(c) <= KEPT_CHARS else rare)[c] = self._chunk(c)
        return self._slow(first) + b"".join([kept[c] if c in kept else rare[c] for c in chunks])

    def encode(self, text: str) -> np.ndarray:
        if self.cut is None or not any(s in text for s in self.special):
            return np.frombuffer(self._plain(text), np.uint32)
        out = b"".join(np.uint32(self.special[x]).tobytes() if x in self.special else self._plain(x) for x in self.cut.split(text) if x)
        return np.frombuffer(out, np.uint32)

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        ids = ids[ids < len(self.sizes)].astype(np.int64)
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        if not len(ids):
            return b""
        at = np.arange(ends[-1]) + np.repeat(self.starts[ids] - (ends - sizes), sizes)
        return self.blob[at].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def listed(self, ids: np.ndarray) -> str:
        return ",".join(map(self.names.__getitem__, ids.tolist()))


def loaded(path: str) -> ByteBpe:
    """One vocabulary for each worker and path."""
    return held(("byte bpe", path), lambda: ByteBpe(path))


def _lists(found: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, found)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*found, np.zeros(0, np.uint32)]).astype(np.int32)))


def encode_texts(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with the ids of each whole text as array<int>, as the tokenizers library gives without adding special tokens of
    its own; special tokens that stand in a text become their ids.

    Defined results: null and empty texts have no ids, repeated rows are encoded each, an empty table stays empty, texts
    may have any length, ids of documents play no part; a column named as out is replaced. No shuffle: rows stay where
    they are."""
    small_batches(docs.sparkSession)
    docs = docs.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for b in batches:
            found = [bpe.encode(x or "") for x in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, _lists(found)], names=[*b.schema.names, out])

    return docs.mapInArrow(run, docs.withColumn(out, F.array(F.lit(0))).schema)


def encode_checked(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """What encode_texts gives as `ids`, and in `whole` whether decoding them gives the text back (null: the empty one).

    Both are done in one worker, so the vocabulary is loaded once. Columns named ids or whole are replaced."""
    small_batches(docs.sparkSession)
    docs = docs.drop("ids", "whole")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for b in batches:
            texts = [x or "" for x in b.column(text).to_pylist()]
            found = [bpe.encode(x) for x in texts]
            same = [bpe.decode(i) == x for i, x in zip(found, texts)]
            yield pa.RecordBatch.from_arrays([*b.columns, _lists(found), pa.array(same, pa.bool_())], names=[*b.schema.names, "ids", "whole"])

    return docs.mapInArrow(run, docs.withColumns({"ids": F.array(F.lit(0)), "whole": F.lit(True)}).schema)


def decode_ids(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """docs with the text of each id array, bytes that are no UTF-8 replaced; null arrays give an empty text, null or
    unknown ids none. Repeated rows are decoded each, an empty table stays empty; a column named as out is replaced."""
    small_batches(docs.sparkSession)
    docs = docs.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for b in batches:
            col = b.column(ids)
            rows = [bpe.decode(np.array([i for i in x if i is not None and i >= 0], np.int64)) if (x := v.as_py()) else "" for v in col]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, pa.string())], names=[*b.schema.names, out])

    return docs.mapInArrow(run, docs.withColumn(out, F.lit("")).schema)


def round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the decoded text, and whether the decoded text is the text.

    Encoding and decoding follow each other inside one batch, so the ids are never shipped. Null texts count as empty,
    repeated rows are encoded each, a null doc_id stays null, an empty table gives no rows, texts may have any length;
    other columns are not read.
    """
    import hashlib

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for b in batches:
            rows: list[tuple] = []
            for x in b.column("text").to_pylist():
                ids = bpe.encode(x or "")
                back = bpe.decode(ids)
                rows.append((len(ids), hashlib.sha256(bpe.listed(ids).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back == (x or "")))
            n, a, d, same = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string()), pa.array(same, pa.bool_())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "whole"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, whole boolean")
