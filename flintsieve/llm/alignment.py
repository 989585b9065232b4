"""Alignment of two tokenizers over a corpus: which tokens of one stand for which of the other, and how often.

Each text is encoded by both, and where tokens of both end at one byte, a group ends. All pairs of tokens of a group are
links. For each document the links' pairs and their multiplicities become postings. Postings are shuffled by the id of
the first side: a group of ids (a slot) meets its pairs' counts in one task, which finds the most frequent partners of
each id and tells each document what its links come to; these contributions are summed by document.

Postings travel packed, sorted by pair, a row for each block of documents and slot. Counts are summed within tasks before
they are shuffled. A slot with very many postings is dealt out by blocks, each part with the same counts, so a frequent id
loads no single task. Pairs of a slot are bounded by the vocabularies, parts by PART postings and blocks by an Arrow batch.

Both encoders split at a lone space between two other characters, which is never inside a token, so the pieces between such
spaces are encoded and aligned once and kept in a bounded table of each worker.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flintsieve.llm.bpe import byte_letters
from flintsieve.llm.common import held, small_batches, written

#: Slots of the first side's ids, and postings of a part of a slot, about.
SLOTS, PART = 128, 4_000_000
#: Segments that a worker keeps, the longest it finds again, and pairs of segments from which it starts anew.
KEPT, KEPT_CHARS, PAIRS = 400_000, 48, 6_000_000
#: Links of one group that are listed; those of larger ones are counted by pair.
LISTED = 4096
#: Pairs that a task counts before it passes them on.
AT_ONCE = 1_500_000
_LONE = re.compile(r"(?<=\S) (?=\S)")
_B_BITS = 24
_ALIGNED = (
    "block long, slot int, size long, keys binary, lens binary, docs binary, times binary, "
    "doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>"
)


class Aligner:
    """Aligned segments of texts: ids, groups and pairs of both vocabularies."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a_library, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_library.encode_special_tokens = True  # their strings in a text are plain text
        self.a_library.no_truncation()
        self.a_library.no_padding()
        n = self.b.get_piece_size()
        self.b_bytes = []
        for i in range(n):
            p = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode())
        letters = byte_letters()
        tokens = self.a_library.get_vocab()
        self.a_bytes = [b""] * (max(tokens.values()) + 1)
        for t, i in tokens.items():
            self.a_bytes[i] = bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode()
        self.a_sizes, self.b_sizes = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.a_spaced, self.b_spaced = (np.array([x[:1] == b" " for x in y]) for y in (self.a_bytes, self.b_bytes))
        self.marked = [f"{i}{m}" for i in range(max(len(self.a_bytes), n)) for m in ",|;"]
        self.marked_sizes = np.array(list(map(len, self.marked)), np.int64)
        self.width = -(-len(self.a_bytes) // SLOTS)
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.listed: list[str] = []
        self.stats, self.starts = np.zeros((0, 5), np.int64), np.zeros(1, np.int64)
        self.keys, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def key(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Pairs by slot, then by the ids: a slot has each SLOTS-th id of the first side."""
        return ((a % SLOTS) * self.width + a // SLOTS) << _B_BITS | b

    def _ids(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides of each segment, with the space before it. Words alone are encoded as one text: of each of them just
        the first token begins with a space."""
        plain = [k for k, s in enumerate(segments) if "\u2581" not in s and s.split() == [s]]
        one = " ".join([segments[k] for k in plain])
        a, b = ([], []) if not one else (self.a_library.encode(f" {one}", add_special_tokens=False).ids, self.b.encode(one, num_threads=1))
        out = []
        for ids, spaced, alone in ((a, self.a_spaced, lambda s: self.a_library.encode(f" {s}", add_special_tokens=False).ids), (b, self.b_spaced, lambda s: self.b.encode(s, num_threads=1))):
            starts = np.append(np.flatnonzero(spaced[np.array(ids, np.int64)]), len(ids)).tolist()
            parts: list[list[int]] = [[]] * len(segments)
            known = set(plain) if len(starts) == len(plain) + 1 else set()
            for k, x, y in zip(plain if known else (), starts, starts[1:]):
                parts[k] = ids[x:y]
            out.append([parts[k] if k in known else alone(s) for k, s in enumerate(segments)])
        return out[0], out[1]

    def add(self, segments: list[str]) -> list[int]:
        """Places of new segments in the table. Long ones are not found again.

        All segments are aligned at once: bytes, ends of tokens and groups of one after the other are one sequence."""
        a, b = self._ids(segments)
        raw = [f" {s}".encode() for s in segments]
        joined = lambda table, ids: b"".join(map(table.__getitem__, ids))
        odd = np.zeros(len(segments), np.int64)
        flat_a, flat_b = list(chain.from_iterable(a)), list(chain.from_iterable(b))
        if not joined(self.a_bytes, flat_a) == joined(self.b_bytes, flat_b) == b"".join(raw):
            for k, r in enumerate(raw):
                if not joined(self.a_bytes, a[k]) == joined(self.b_bytes, b[k]) == r:
                    odd[k], a[k], b[k], raw[k] = 1, [], [], b""
            flat_a, flat_b = list(chain.from_iterable(a)), list(chain.from_iterable(b))
        ia, ib = np.array(flat_a, np.int64), np.array(flat_b, np.int64)
        end_a, end_b = np.cumsum(self.a_sizes[ia]), np.cumsum(self.b_sizes[ib])
        common = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        many_a, many_b = np.bincount(group_a, minlength=len(common)), np.bincount(group_b, minlength=len(common))
        to_a, to_b = np.cumsum(many_a), np.cumsum(many_b)
        of = np.searchsorted(np.cumsum(list(map(len, raw))), common)
        n = len(segments)
        count = lambda at, w=None: np.bincount(at, w, n).astype(np.int64)
        n_a, n_b = count(of[group_a]), count(of[group_b])
        stats = np.stack([n_a, n_b, count(of), count(of, many_a * many_b), odd], axis=1)
        # Pairs: of small groups all links, of large ones each pair once.
        large = many_a * many_b > LISTED
        use = np.flatnonzero(~large[group_a])
        each = many_b[group_a[use]]
        ends = np.cumsum(each)
        place = np.arange(ends[-1] if len(ends) else 0) + np.repeat((to_b - many_b)[group_a[use]] - (ends - each), each)
        owner, keys, times = [np.repeat(of[group_a[use]], each)], [self.key(np.repeat(ia[use], each), ib[place])], [np.ones(len(place), np.int64)]
        for g in np.flatnonzero(large).tolist():
            (x, n_x), (y, n_y) = (np.unique(i[t - m : t], return_counts=True) for i, t, m in ((ia, int(to_a[g]), int(many_a[g])), (ib, int(to_b[g]), int(many_b[g]))))
            keys.append(self.key(np.repeat(x, len(y)), np.tile(y, len(x))))
            times.append(np.repeat(n_x, len(y)) * np.tile(n_y, len(x)))
            owner.append(np.full(len(x) * len(y), of[g]))
        owner, keys, times = np.concatenate(owner), np.concatenate(keys), np.concatenate(times)
        if large.any():
            order = np.argsort(owner, kind="stable")
            owner, keys, times = owner[order], keys[order], times[order]
        # Groups as text: each id with the mark after it, in the order of groups, the first side before the second.
        text = np.empty(len(ia) + len(ib), np.int64)
        at_a, at_b = np.arange(len(ia)) + (to_b - many_b)[group_a], np.arange(len(ib)) + to_a[group_b]
        text[at_a] = 3 * ia + (np.arange(len(ia)) == to_a[group_a] - 1)
        text[at_b] = 3 * ib + 2 * (np.arange(len(ib)) == to_b[group_b] - 1)
        whole = "".join(map(self.marked.__getitem__, text.tolist()))
        cuts = np.append(0, np.cumsum(self.marked_sizes[text]))[np.append(0, np.cumsum(n_a + n_b))].tolist()
        first = len(self.listed)
        self.listed += [whole[x : y - 1] if y > x else "" for x, y in zip(cuts, cuts[1:])]
        self.index |= {s: first + k for k, s in enumerate(segments) if len(s) <= KEPT_CHARS}
        self.stats = np.concatenate([self.stats, stats])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.bincount(owner, minlength=n))])
        self.keys, self.times = np.concatenate([self.keys, keys]), np.concatenate([self.times, times])
        return list(range(first, len(self.listed)))

    def places(self, texts: list[str]) -> list[list[int]]:
        """The places of each text's segments in the table, which takes up those it does not have."""
        if len(self.listed) > KEPT or len(self.keys) > PAIRS:
            self.clear()
        found, missed = [], {}
        for k, x in enumerate(texts):
            if not x:
                found.append([])
                continue
            try:
                found.append(list(map(self.index.__getitem__, x.split(" "))))
            except KeyError:
                found.append(s := _LONE.split(x))
                missed[k] = None
                for y in s:
                    if y not in self.index:
                        missed.setdefault(y)
        new = [y for y in missed if isinstance(y, str)]
        if new:
            own = dict(zip(new, self.add(new)))
            for k in missed:
                if not isinstance(k, str):
                    found[k] = [own[y] if y in own else self.index[y] for y in found[k]]
        return found

    def batch(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of each text n_a, n_b, n_groups, n_links and the digest of its groups; postings of all: key, text and times, ascending."""
        found = self.places(texts)
        lens = np.array(list(map(len, found)), np.int64)
        doc = np.repeat(np.arange(len(texts)), lens)
        at = np.array([i for f in found for i in f], np.int64)
        sums = np.concatenate([np.zeros((1, 5), np.int64), np.cumsum(self.stats[at], axis=0)])
        figures = sums[np.cumsum(lens)] - sums[np.cumsum(lens) - lens]
        odd = figures[:, 4] > 0
        figures[odd] = 0
        digests = ["" if not len(f) or bad else hashlib.sha256(";".join(map(self.listed.__getitem__, f)).encode()).hexdigest() for f, bad in zip(found, odd.tolist())]
        # Segments by text, each once, then their pairs.
        n = max(1, len(self.listed))
        use = ~odd[doc]
        seg, often = np.unique(doc[use] * n + at[use], return_counts=True)
        doc, at = seg // n, seg % n
        sizes = self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(sizes)
        place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[at] - (ends - sizes), sizes)
        bits = max(1, len(texts)).bit_length()
        both, times = self.keys[place] << bits | np.repeat(doc, sizes), self.times[place] * np.repeat(often, sizes)
        order = np.argsort(both, kind="stable")
        both = both[order]
        first = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.zeros(0, np.int64)
        times = np.add.reduceat(times[order], first) if len(first) else times
        both = both[first]
        return figures[:, :4], digests, both >> bits, both & ((1 << bits) - 1), times


def loaded(a_path: str, b_path: str) -> Aligner:
    return held(("aligner", a_path, b_path), lambda: Aligner(a_path, b_path))


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Of docs (doc_id, text): a row for each block of documents with their figures, and one for each block and slot with
    postings: keys ascending, how many documents have each, these documents' places in the block, and times."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, block = loaded(a_path, b_path), TaskContext.get().partitionId() << 32
        schema = pa.schema([("block", pa.int64()), ("slot", pa.int32()), ("size", pa.int64()), *[(c, pa.binary()) for c in ("keys", "lens", "docs", "times")], *[(c, pa.list_(pa.int64())) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.list_(pa.string()))])
        for b in batches:
            if not b.num_rows:
                continue
            figures, digests, keys, docs, times = aligner.batch([x or "" for x in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((block, None, None, None, None, None, None, b.column("doc_id").to_pylist(), *figures.T.tolist(), digests), schema)], schema=schema)
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
            own, ends = keys[first], np.append(first, len(keys))
            slots = (own >> _B_BITS) // aligner.width
            cuts = np.append(np.flatnonzero(np.append(True, slots[1:] != slots[:-1])) if len(slots) else np.zeros(0, np.int64), len(slots))
            rows = []
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                p, q = int(ends[x]), int(ends[y])
                rows.append((block, int(slots[x]), q - p, own[x:y].tobytes(), np.diff(ends[x : y + 1]).astype(np.uint32).tobytes(), docs[p:q].astype(np.uint16).tobytes(), times[p:q].astype(np.uint32 if times[p:q].max() < 1 << 32 else np.uint64).tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([*[pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], *[pa.nulls(len(rows), f.type) for f in list(schema)[7:]]], schema=schema)
            block += 1

    return docs.mapInArrow(run, _ALIGNED)


def pair_counts(postings: DataFrame) -> DataFrame:
    """(slot, keys, counts, best): in how many documents each pair is linked, and whether that is the most of its first id.

    A row for each slot; it has at most the slot's ids times the second vocabulary."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots: dict[int, list] = {}
        waiting = 0

        def passed(limit: int) -> Iterator[pa.RecordBatch]:
            nonlocal waiting
            waiting = 0
            for slot, parts in slots.items():
                keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                counts = np.bincount(at, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)
                slots[slot] = [(keys, counts)]
                waiting += len(keys)
            if waiting > limit:
                for slot, parts in slots.items():
                    keys, counts = parts[0]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), slot, np.int32)), pa.array(keys), pa.array(counts)], names=["slot", "key", "n"])
                slots.clear()
                waiting = 0

        for b in batches:
            for slot, k, n in zip(b.column("slot").to_pylist(), b.column("keys"), b.column("lens")):
                keys = np.frombuffer(k.as_buffer(), np.int64)
                slots.setdefault(slot, []).append((keys, np.frombuffer(n.as_buffer(), np.uint32)))
                waiting += len(keys)
            if waiting > AT_ONCE:
                yield from passed(AT_ONCE // 2)
        yield from passed(0)

    def pack(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        keys, n = rows.column("key").to_numpy(), rows.column("n").to_numpy()
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.append(True, (keys[1:] >> _B_BITS) != (keys[:-1] >> _B_BITS)))
        most = np.repeat(np.maximum.reduceat(n, first), np.diff(np.append(first, len(n))))
        return pa.table({"slot": pa.array([key[0].as_py()], pa.int32()), "keys": [keys.tobytes()], "counts": [n.tobytes()], "best": [(n == most).tobytes()]})

    summed = postings.select("slot", "keys", "lens").mapInArrow(add, "slot int, key long, n long").groupBy("slot", "key").agg(F.sum("n").alias("n"))
    return summed.groupBy("slot").applyInArrow(pack, "slot int, keys binary, counts binary, best binary")


def contributions(postings: DataFrame, counts: DataFrame) -> DataFrame:
    """(block, docs, best, sums): what the links of a slot come to for documents of a block: how many have their first id's
    highest count, and the sum of their counts."""
    spark = postings.sparkSession
    volume = postings.groupBy("slot").agg(F.sum("size").alias("n")).collect()  # a row for each slot
    parts = spark.createDataFrame([(r["slot"], -(-r["n"] // PART)) for r in volume] or [(0, 1)], "slot int, parts long")
    dealt = postings.join(F.broadcast(parts), "slot").withColumn("part", F.pmod(F.xxhash64("block"), F.col("parts"))).drop("parts")
    copied = counts.join(F.broadcast(parts), "slot").select("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "keys", "counts", "best")

    def tell(rows: pa.Table, known: pa.Table) -> pa.Table:
        out = []
        if known.num_rows:
            keys, counts, best = (np.frombuffer(known.column(c)[0].as_buffer(), t) for c, t in (("keys", np.int64), ("counts", np.int64), ("best", np.bool_)))
            for block, size, k, n, d, t in zip(*(rows.column(c) for c in ("block", "size", "keys", "lens", "docs", "times"))):
                at = np.repeat(np.searchsorted(keys, np.frombuffer(k.as_buffer(), np.int64)), np.frombuffer(n.as_buffer(), np.uint32))
                docs, raw = np.frombuffer(d.as_buffer(), np.uint16), t.as_buffer()
                times = np.frombuffer(raw, np.uint32 if raw.size == 4 * size.as_py() else np.uint64).astype(np.int64)
                order = np.argsort(docs, kind="stable")
                first = np.flatnonzero(np.append(True, docs[order][1:] != docs[order][:-1]))
                sums = np.add.reduceat((times * counts[at])[order], first)
                most = np.add.reduceat((times * best[at])[order], first)
                out.append((block.as_py(), docs[order][first].tobytes(), most.tobytes(), sums.tobytes()))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 4, (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["block", "docs", "best", "sums"])

    return dealt.select("slot", "part", "block", "size", "keys", "lens", "docs", "times").groupBy("slot", "part").cogroup(copied.groupBy("slot", "part")).applyInArrow(tell, "block long, docs binary, best binary, sums binary")


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Of every document doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256, of a byte-level vocabulary
    over space and text and a piece vocabulary over the text.

    Defined results: null and empty texts, and texts that the joined bytes of either side do not give back, have no tokens;
    special tokens in a text are plain text; repeated rows and rows of one doc_id count each as a document, a null doc_id
    stays null; a pair's ties for the highest count all count; an empty table gives no rows; texts may have any length;
    other columns are not read.
    """
    table = written(aligned(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), a_path, b_path), "aligned")
    postings = table.where("slot IS NOT NULL").select("block", "slot", "size", "keys", "lens", "docs", "times")
    told = contributions(postings, written(pair_counts(postings), "pair-counts"))
    blocks = table.where("slot IS NULL").select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")

    def total(block: pa.Table, parts: pa.Table) -> pa.Table:
        columns = {c: block.column(c).combine_chunks().flatten() for c in block.column_names if c != "block"}
        best, sums = np.zeros((2, len(columns["doc_id"])), np.int64)
        for d, m, s in zip(*(parts.column(c) for c in ("docs", "best", "sums"))):
            docs = np.frombuffer(d.as_buffer(), np.uint16)
            best[docs] += np.frombuffer(m.as_buffer(), np.int64)
            sums[docs] += np.frombuffer(s.as_buffer(), np.int64)
        columns |= {"n_best": pa.array(best), "count_sum": pa.array(sums)}
        return pa.table({c: columns[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")})

    kind = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(total, kind)
