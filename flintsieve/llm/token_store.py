"""A content-addressed store of token ids.

Each document's id stream is cut where a rolling hash of the last WINDOW ids says so, equal chunks are stored once
under their digest, and a document is a recipe: the digests of its chunks in order. Files, all Parquet below one
folder of the shared store:

- chunks/    digest, n, width (bytes of an id), ids (little-endian), one row for each distinct chunk
- recipes/   block=N/, ascending in doc_id over and within the blocks: doc_id, start, n_tokens, digests, sizes, root
- manifest/  a row for each leaf of LEAF documents of a block, one for each block and one for the whole: Merkle roots
             and counts

A document's root hashes its digests, a leaf's root its documents' roots, a block's root its leaves' roots, and the
store's root its blocks' roots. Reading back compares all of them, both ways.
"""

from __future__ import annotations

import hashlib
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from flintsieve.llm.bpe import byte_letters
from flintsieve.llm.common import discard, held, new_path, partitions, range_bounds, range_of, small_batches, written

#: Ids that the rolling hash sees; a cut where its top CUT_BITS bits are 0; least and most ids of a chunk.
WINDOW, CUT_BITS, LEAST, MOST = 16, 9, 128, 4096
#: Documents of a leaf of the manifest.
LEAF = 1024
#: Pieces of text that a worker keeps, and the longest it keeps.
KEPT, KEPT_CHARS = 700_000, 40
#: Documents of a block, about; there are as many blocks as partitions at least.
BLOCK = 1_000_000


class PieceEncoder:
    """Encodes with the tokenizers library; valid where white space separates words and is never part of a token, so
    that pieces between spaces or line ends can be encoded on their own and remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.width = 2 if self.tok.get_vocab_size() <= 1 << 16 else 4
        self.kept: dict[str, bytes] = {}
        self.marks = {m: self._whole(m) for m in ".,;:!?|"}
        self.quick = True
        # The short way below is taken only if it agrees with the library's long one on these.
        self.quick = all(self._word(w) == self._whole(w) for w in ("a", "word", "words.", "straße", "élan,", "слово", "x|", "don't", "a1", "Ab", "日本"))

    def _whole(self, piece: str) -> bytes:
        return np.array(self.tok.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, piece: str) -> bytes:
        """Ids of a piece: of lower-case letters, or such and one mark, from the library's model directly."""
        word, mark = (piece[:-1], self.marks[piece[-1]]) if piece[-1:] in self.marks else (piece, b"")
        if not self.quick or not word.isalpha():
            return self._whole(piece)
        if not word.isascii():
            if word != word.lower() or not unicodedata.is_normalized("NFC", word):
                return self._whole(piece)
            word = "".join(map(_LETTERS.__getitem__, word.encode()))
        elif not word.islower():
            return self._whole(piece)
        return array("I", [t.id for t in self.tok.model.tokenize(word)]).tobytes() + mark

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.quick and "<|" not in text and "Σ" not in text:
            # The library composes letters and marks before it takes lower case. Where that changes nothing, lower case
            # is taken first, so that fewer pieces are different; other texts go to the library as they are.
            low = text.lower()
            if text.isascii() or (unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low)):
                text = low
        pieces = text.replace("\n", " ").split(" ")
        kept = self.kept
        try:
            return b"".join(map(kept.__getitem__, pieces))
        except KeyError:
            pass
        new = {p for p in pieces if p not in kept}
        if len(kept) + len(new) > KEPT:
            kept.clear()
            new = set(pieces)
        rare: dict[str, bytes] = {}
        for p in new:
            (kept if len(p) <= KEPT_CHARS else rare)[p] = self._word(p)
        return b"".join([kept[p] if p in kept else rare[p] for p in pieces])


#: The letter that stands for each byte in byte-level vocabularies.
_LETTERS = [k for k, _ in sorted(byte_letters().items(), key=lambda x: x[1])]


def encoder(path: str) -> PieceEncoder:
    return held(("pieces", path), lambda: PieceEncoder(path))


def _gear() -> np.ndarray:
    """A fixed pseudo-random 64-bit word for each of 2^16 ids (larger ids take their low bits)."""
    x = np.arange(1, (1 << 16) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_GEAR = _gear()


def marks(ids: np.ndarray) -> np.ndarray:
    """Where the rolling hash of an id stream asks for a cut."""
    if not len(ids):
        return np.zeros(0, np.int64)
    h, step = _GEAR[ids & 0xFFFF], 1
    while step < WINDOW:
        more = h.copy()
        more[step:] += h[:-step] << np.uint64(step)
        h, step = more, 2 * step
    return np.flatnonzero(h >> np.uint64(64 - CUT_BITS) == 0) + 1


def _ends(n: int, marked: list[int]) -> list[int]:
    out, last = [], 0
    for c in marked:
        while c - last > MOST:
            last += MOST
            out.append(last)
        if c - last >= LEAST and c < n:
            out.append(c)
            last = c
    while n - last > MOST:
        last += MOST
        out.append(last)
    return [*out, n]


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of an id stream. They depend on near ids only, so an edit moves few of them."""
    return _ends(len(ids), marks(ids).tolist()) if len(ids) else []


def digest(ids: bytes) -> bytes:
    return hashlib.blake2b(ids, digest_size=16).digest()


#: Powers of the linear map that appends zero bytes to a CRC-32, as four tables of 256 entries for each power of two.
def _zero_tables(bits: int = 40) -> list[np.ndarray]:
    table = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint64)
    column = lambda v: int(table[v & 255]) ^ v >> 8  # noqa: E731  one zero byte appended
    columns = [column(1 << i) for i in range(32)]
    out = []
    for _ in range(bits):
        apply = lambda v, m=columns: _xor(m[i] for i in range(32) if v >> i & 1)
        out.append(np.array([[apply(b << 8 * k) for b in range(256)] for k in range(4)], np.uint32))
        columns = [apply(x) for x in columns]
    return out


def _xor(xs: Iterator[int]) -> int:
    total = 0
    for x in xs:
        total ^= x
    return total


_ZEROS: list[np.ndarray] = []


def shift_crc(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """What each CRC-32 adds to that of a longer string in which so many bytes follow."""
    if not _ZEROS:
        _ZEROS.extend(_zero_tables())
    crc, zeros = crc.astype(np.uint32), zeros.astype(np.int64)
    for k in range(int(zeros.max(initial=0)).bit_length()):
        on, t = (zeros >> k & 1).astype(bool), _ZEROS[k]
        v = crc[on]
        crc[on] = t[0][v & 255] ^ t[1][v >> 8 & 255] ^ t[2][v >> 16 & 255] ^ t[3][v >> 24]
    return crc


@F.pandas_udf(LongType())
def _shifted(crc: pd.Series, zeros: pd.Series) -> pd.Series:
    return pd.Series(shift_crc(crc.to_numpy(), zeros.to_numpy()).astype(np.int64))


def _root(digests: Column) -> Column:
    """SHA-256 of binary digests in order, as hexadecimal."""
    return F.sha2(F.unhex(F.array_join(F.transform(digests, F.hex), "")), 256)


#: Columns of the parts, as an empty table leaves folders without a file.
PARTS = {
    "chunks": "digest binary, n int, width int, ids binary",
    "recipes": "doc_id long, start long, n_tokens long, digests array<binary>, sizes array<int>, root string, leaf int, block int",
    "manifest": "block int, leaf int, n_docs long, n_tokens long, start long, root string",
}


@dataclass
class Store:
    path: str

    def read(self, spark: SparkSession, part: str) -> DataFrame:
        return spark.read.schema(PARTS[part]).parquet(f"{self.path}/{part}")


def encoded(docs: DataFrame, path: str, end_id: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens and the chunks of each document; a null text has the end id alone."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path), np.array([end_id], "<u4").tobytes()
        for b in batches:
            raws = [enc.encode(x) + end if x else end for x in b.column("text").to_pylist()]
            raw = b"".join(raws)
            ids = np.frombuffer(raw, "<u4")
            packed = ids.astype("<u2").tobytes() if enc.width == 2 else raw
            # One rolling hash for the batch: a chunk has LEAST ids, so none of a document's cuts can see the one before.
            total = [len(x) // 4 for x in raws]
            marked = marks(ids)
            begins = np.cumsum([0, *total])
            upto = np.searchsorted(marked, begins, side="right").tolist()
            marked, sizes, keys, counts, bodies = marked.tolist(), [0], [], [], []
            for k, (at, n) in enumerate(zip(begins.tolist(), total)):
                last = 0
                for c in _ends(n, [m - at for m in marked[upto[k] : upto[k + 1]]]) if n > LEAST else (n,):
                    keys.append(digest(raw[4 * (at + last) : 4 * (at + c)]))
                    counts.append(c - last)
                    bodies.append(packed[enc.width * (at + last) : enc.width * (at + c)])
                    last = c
                sizes.append(len(keys))
            chunks = pa.StructArray.from_arrays([pa.array(keys, pa.binary()), pa.array(counts, pa.int32()), pa.array([enc.width] * len(keys), pa.int32()), pa.array(bodies, pa.binary())], names=["digest", "n", "width", "ids"])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(total, pa.int64()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), chunks)], names=["doc_id", "n_tokens", "chunks"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, chunks array<struct<digest: binary, n: int, width: int, ids: binary>>")


def write_store(docs: DataFrame, path: str, end_id: int, text: str = "text") -> Store:
    """Encodes every whole text and writes the three parts below a new folder of the shared store.

    Defined results: null and empty texts are the end id alone, documents of one doc_id (repeated rows too) stand in order
    of their size and root, null ids come first, an empty table gives empty parts; other columns are not read; texts may
    have any length.
    """
    spark = docs.sparkSession
    store = Store(new_path(spark, "token-store"))
    done = written(encoded(docs, path, end_id, text), "encoded")
    (done.select(F.explode("chunks").alias("c")).select("c.*").groupBy("digest").agg(F.first("n").alias("n"), F.first("width").alias("width"), F.first("ids").alias("ids"))
        .write.option("compression", "zstd").parquet(f"{store.path}/chunks"))
    n = max(partitions(spark), done.count() // BLOCK)
    bounds = range_bounds(done, "doc_id", n)
    rows = done.select("doc_id", "n_tokens", F.col("chunks.digest").alias("digests"), F.col("chunks.n").alias("sizes")).withColumn("block", range_of(F.col("doc_id"), bounds))
    # One number for each block, to begin its running total with.
    sums = {r["block"]: r["n"] for r in rows.groupBy("block").agg(F.sum("n_tokens").alias("n")).collect()}
    begin, offsets = 0, []
    for b in range(len(bounds) + 1):
        offsets.append(begin)
        begin += sums.get(b, 0)
    order = Window.partitionBy("block").orderBy("doc_id", "n_tokens", "root")
    rows = (
        rows.withColumn("root", _root(F.col("digests")))
        .withColumn("start", F.element_at(F.lit(offsets), F.col("block") + 1).cast("long") + F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens"))
        .withColumn("leaf", ((F.row_number().over(order) - 1) / LEAF).cast("int"))
    )
    rows.select("doc_id", "start", "n_tokens", "digests", "sizes", "root", "leaf", "block").write.option("compression", "zstd").partitionBy("block").parquet(f"{store.path}/recipes")
    manifest_of(store.read(spark, "recipes")).write.parquet(f"{store.path}/manifest")
    discard(done)
    return store


def manifest_of(recipes: DataFrame) -> DataFrame:
    """Merkle roots: of each leaf (at most LEAF documents), of each block (leaf is null) over its leaves, and of all blocks
    (both are null), which is there for an empty store too."""
    in_order = lambda key: _root_hex(F.transform(F.array_sort(F.collect_list(F.struct(key, "root"))), lambda x: x["root"]))
    leaves = recipes.groupBy("block", "leaf").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.min("start").alias("start"), in_order("start").alias("root"))
    blocks = leaves.groupBy("block").agg(F.lit(None).cast("int").alias("leaf"), F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.min("start").alias("start"), in_order("leaf").alias("root"))
    whole = blocks.agg(F.lit(None).cast("int").alias("block"), F.lit(None).cast("int").alias("leaf"), F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"), F.min("start").alias("start"), in_order("block").alias("root"))
    return leaves.unionByName(blocks).unionByName(whole)


def _root_hex(roots: Column) -> Column:
    return F.sha2(F.array_join(roots, ""), 256)


def read_chunks(spark: SparkSession, store: Store) -> DataFrame:
    """digest, n and CRC-32 of each stored chunk, from its bytes; a chunk that does not have its digest is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, width, ids in zip(b.column("digest").to_pylist(), b.column("width").to_pylist(), b.column("ids").to_pylist()):
                raw = np.frombuffer(ids, "<u2").astype("<u4").tobytes() if width == 2 else ids
                if digest(raw) != key:
                    raise ValueError(f"chunk {key.hex()} is damaged")
                rows.append((len(raw) // 4, zlib.crc32(raw)))
            n, crc = zip(*rows) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["digest", "n", "crc"])

    return store.read(spark, "chunks").mapInArrow(run, "digest binary, n long, crc long")


def read_back(spark: SparkSession, store: Store) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and n_chunks of each document, from the files alone.

    Chunk bytes are read once, where they lie; only digests and checksums move. A document's CRC-32 is the exclusive or
    of its chunks' checksums, each shifted by the bytes that follow it. Damaged, missing or short parts are errors: of
    recipes and the manifest before anything is read, as all counts and Merkle roots are compared both ways; of chunks
    when the result is read. A chunk of very many documents is a skewed key of the join, which Spark splits at run time.
    """
    if wrong := verify(spark, store).limit(5).collect():
        raise ValueError(f"manifest and recipes differ, as at {[(r['block'], r['leaf']) for r in wrong]}")
    recipes = store.read(spark, "recipes").where(F.assert_true(F.col("root") == _root(F.col("digests")), F.lit("a recipe is damaged")).isNull())
    parts = (
        recipes.select("doc_id", "start", "n_tokens", F.posexplode("digests").alias("k", "digest"), "sizes")
        .withColumn("after", F.col("n_tokens") - F.aggregate(F.slice("sizes", 1, F.col("k") + 1), F.lit(0).cast("long"), lambda a, x: a + x))
        .drop("sizes")
    )
    met = parts.join(read_chunks(spark, store), "digest", "left").withColumn("shifted", _shifted(F.coalesce("crc", F.lit(0)), F.col("after") * 4))
    whole = met.groupBy("start").agg(F.first("doc_id").alias("doc_id"), F.first("n_tokens").alias("n_tokens"), F.bit_xor("shifted").alias("ids_crc32"), F.sum("n").alias("found"), F.count("*").alias("n_chunks"))
    whole = whole.where(F.assert_true(F.col("found") == F.col("n_tokens"), F.lit("a chunk is missing")).isNull())
    return whole.select("doc_id", "start", "n_tokens", "ids_crc32", "n_chunks")


def documents_of(spark: SparkSession, store: Store) -> DataFrame:
    """doc_id, start and the ids of each document, put together from its chunks."""
    parts = store.read(spark, "recipes").select("doc_id", "start", F.posexplode("digests").alias("k", "digest"))
    met = parts.join(store.read(spark, "chunks"), "digest")

    @F.pandas_udf("array<long>")
    def unpack(width: pd.Series, ids: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(x, f"<u{w}").astype(np.int64) for w, x in zip(width, ids)])

    return met.groupBy("start").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("k", unpack("width", "ids").alias("ids")))).alias("c")).select("doc_id", "start", F.flatten("c.ids").alias("ids"))


def verify(spark: SparkSession, store: Store) -> DataFrame:
    """Rows of the manifest that the recipes do not confirm, and rows that they ask for beside it; none if both are whole."""
    again = manifest_of(store.read(spark, "recipes"))
    kept = store.read(spark, "manifest").select(again.columns)
    # Equal rows meet in pairs, one of each side; a row of one side alone stands out.
    both = again.withColumn("side", F.lit(1)).unionByName(kept.withColumn("side", F.lit(-1)))
    return both.groupBy(again.columns).agg(F.sum("side").alias("side")).where("side <> 0").drop("side")
