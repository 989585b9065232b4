"""Token counts by a linear longest-match automaton.

The vocabulary is a trie. Each node has a failure link and the number of tokens that are complete when it is followed,
both made once in advance, so a word is counted in one pass over its characters: no piece is built and no character is
looked at again. A character that begins no piece counts as its UTF-8 bytes, as the vocabulary's byte pieces would.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flintsieve.llm.common import held, small_batches

#: Begins each word in the vocabulary.
MARK = "▁"
#: Words that a worker keeps, and the longest it keeps.
KEPT, KEPT_CHARS = 300_000, 40


class Automaton:
    def __init__(self, pieces: Iterable[str]):
        vocabulary = {p for p in pieces if p}
        self.next: list[dict[str, int]] = [{}]
        depth, token, char = [0], [False], [""]
        for p in vocabulary:
            at = 0
            for c in p:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    depth.append(depth[at] + 1)
                    token.append(False)
                    char.append(c)
                at = self.next[at][c]
            token[at] = True
        self.link, self.popped = [0] * len(self.next), [0] * len(self.next)
        todo = deque([0])
        while todo:
            u = todo.popleft()
            for c, v in self.next[u].items():
                if token[v]:
                    self.popped[v] = 1
                elif u == 0:
                    self.popped[v] = len(c.encode())
                else:
                    z, n = self.link[u], self.popped[u]
                    while z and c not in self.next[z]:
                        n += self.popped[z]
                        z = self.link[z]
                    if c in self.next[z]:
                        z = self.next[z][c]
                    else:
                        n += len(c.encode())
                    self.link[v], self.popped[v] = z, n
                todo.append(v)
        self.kept: dict[str, int] = {}

    def count(self, word: str) -> int:
        """Tokens of one word, its mark included."""
        follow, link, popped, at, n = self.next, self.link, self.popped, 0, 0
        for c in word:
            while c not in follow[at]:
                if not at:
                    n += len(c.encode())
                    break
                n += popped[at]
                at = link[at]
            else:
                at = follow[at][c]
        while at:
            n += popped[at]
            at = link[at]
        return n

    def count_text(self, text: str) -> tuple[int, int]:
        """Words and tokens of a whole text."""
        words, kept = text.split(), self.kept
        try:
            return len(words), sum(map(kept.__getitem__, words))
        except KeyError:
            pass
        new, rare = {w for w in words if w not in kept}, {}
        if len(kept) + len(new) > KEPT:
            kept.clear()
            new = set(words)
        for w in new:
            (kept if len(w) <= KEPT_CHARS else rare)[w] = self.count(MARK + w)
        return len(words), sum([kept[w] if w in kept else rare[w] for w in words])


def piece_list(path: str) -> list[str]:
    """Ordinary pieces of a sentencepiece file; the mark stands at their beginning only."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    odd = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)
    return [p for i in range(sp.get_piece_size()) if not odd(i) and MARK not in (p := sp.id_to_piece(i))[1:]]


def loaded(path: str) -> Automaton:
    return held(("word pieces", path), lambda: Automaton(piece_list(path)))


def count_tokens(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs with n_words (between white space) and n_tokens of each whole text; null and empty texts have 0 of both.

    No shuffle; columns of docs that are named n_words or n_tokens are replaced, repeated rows are counted each, an empty
    table stays empty, texts may have any length, and ids play no part.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("n_words", "n_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = loaded(path)
        for b in batches:
            found = [automaton.count_text(x or "") for x in b.column(text).to_pylist()]
            words, tokens = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=[*b.schema.names, "n_words", "n_tokens"])

    return docs.mapInArrow(run, docs.withColumns({"n_words": F.lit(0).cast("long"), "n_tokens": F.lit(0).cast("long")}).schema)
