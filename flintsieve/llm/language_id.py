"""Language identification by unigram models over word pieces, summed over all segmentations.

For each language the pieces of a fixed public vocabulary have probabilities. A word's probability in a language is the
sum over all its segmentations of the product of their pieces' probabilities (a forward algorithm), a text's is the
product over its words. The piece probabilities are fitted by expectation and maximisation on counts of words of
labelled texts, a group of rows for each language.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flintsieve.llm.common import held, small_batches
from flintsieve.llm.word_pieces import MARK, piece_list

#: Labelled texts of a language that the models are fitted on, about; rounds of fitting.
TEXTS, ROUNDS = 1500, 3
#: Probability of a character that begins no piece, and share kept for unseen pieces.
UNKNOWN, UNSEEN = 1e-9, 1e-3
#: Letters of a word from which it is fitted by logarithms, as products would become 0; what is scaled up when it is small.
LONG, SMALL, SCALE = 24, 1e-100, 1e100
UNDETERMINED = "und"
#: Chunks that a worker keeps, and the longest it keeps.
KEPT, KEPT_CHARS = 600_000, 40


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training; one of a null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def letters(word: str) -> str:
    if word.isalpha():
        return word
    return word[:-1] if word[:-1].isalpha() else "".join(filter(str.isalpha, word))


def matches(word: str, known: dict[str, object]) -> list[tuple[int, int, object]]:
    """(begin, end, value) of each piece in a word, by begin. known has every beginning of a piece too, with None."""
    out = []
    for i in range(len(word)):
        for j in range(i + 1, len(word) + 1):
            if (sub := word[i:j]) not in known:
                break
            if (v := known[sub]) is not None:
                out.append((i, j, v))
    return out


def with_beginnings(pieces: dict[str, object]) -> dict[str, object]:
    out: dict[str, object] = {k[:i]: None for k in pieces for i in range(1, len(k))}
    return out | pieces


def _expected(n: int, spans: list[tuple[int, int, str, float]]) -> list[tuple[str, float]]:
    """How often each piece (begin, end, piece, probability; by begin) is expected in the segmentations of n letters."""
    a, b = [1.0] + [0.0] * n, [0.0] * n + [1.0]
    for i, j, _, q in spans:
        a[j] += a[i] * q
    if a[-1] <= 0:
        return []
    for i, j, _, q in reversed(spans):
        b[i] += q * b[j]
    return [(piece, v / a[-1]) for i, j, piece, q in spans if (v := a[i] * q * b[j])]


def _plus(x: float, y: float) -> float:
    """Logarithm of the sum of two numbers given by their logarithms."""
    if x < y:
        x, y = y, x
    return x if y == -math.inf else x + math.log1p(math.exp(y - x))


def _expected_long(n: int, spans: list[tuple[int, int, str, float]]) -> list[tuple[str, float]]:
    """The same by logarithms."""
    a, b = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
    spans = [(i, j, piece, math.log(q)) for i, j, piece, q in spans]
    for i, j, _, q in spans:
        a[j] = _plus(a[j], a[i] + q)
    if a[-1] == -math.inf:
        return []
    for i, j, _, q in reversed(spans):
        b[i] = _plus(b[i], q + b[j])
    return [(piece, math.exp(a[i] + q + b[j] - a[-1])) for i, j, piece, q in spans]


def fit(words: dict[str, float], pieces: list[str]) -> dict[str, float]:
    """Piece probabilities that make the counted words likely: ROUNDS of expected counts over all segmentations."""
    known = with_beginnings({p: p for p in pieces})
    found = {w: matches(w, known) for w in words}
    more: dict[str, float] = {}
    for w, n in words.items():
        for i, j, piece in found[w]:
            more[piece] = more.get(piece, 0) + n * (j - i) ** 2
    for k in range(ROUNDS + 1):
        total = sum(more.values()) or 1
        p = {piece: v / total for piece, v in more.items() if v / total > 1e-12}
        if k == ROUNDS:
            break
        more = {}
        for w, n in words.items():
            spans = [(i, j, piece, q) for i, j, piece in found[w] if (q := p.get(piece))]
            for piece, v in (_expected if len(w) <= LONG else _expected_long)(len(w), spans):
                more[piece] = more.get(piece, 0) + n * v
    return p


def train(docs: DataFrame, vocabulary: str, text: str = "text", lang: str = "lang") -> dict[str, dict[str, float]]:
    """Models by language from all rows given, of which about TEXTS a language are used, chosen by a hash of the text.

    All words of these texts count, and each language is fitted in a task of its own; what the driver gets are the models:
    the vocabulary's size times the number of languages at most. Each has all pieces of the vocabulary, unseen ones with
    probability 0. The held-out rows must be left out by the caller. Repeated rows count each; rows without a text or a
    language are not used, and without any other there is no model.
    """
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    share = {r["lang"]: min(1.0, TEXTS / r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not share:
        return {}
    limit = F.element_at(F.create_map(*(F.lit(x) for k, v in share.items() for x in (k, math.ceil(v * (1 << 20))))), F.col("lang"))
    some = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < limit)
    counts = (
        some.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
        .groupBy("lang", "word").agg(F.count("*").alias("n"))
    )

    def fitted(frame: pd.DataFrame) -> pd.DataFrame:
        p = fit({MARK + w: float(n) for w, n in zip(frame["word"], frame["n"])}, piece_list(vocabulary))
        return pd.DataFrame({"lang": frame["lang"].iloc[0], "piece": list(p), "p": list(p.values())})

    found = counts.groupBy("lang").applyInPandas(fitted, "lang string, piece string, p double").collect()
    models: dict[str, dict[str, float]] = {k: dict.fromkeys(piece_list(vocabulary), 0.0) for k in sorted(share)}
    for r in found:
        models[r["lang"]][r["piece"]] = r["p"]
    return models


class Scorer:
    def __init__(self, models: dict[str, dict[str, float]]):
        self.langs = sorted(models)
        every = sorted({k for m in models.values() for k in m})
        # A piece that a language never had keeps a small share, so that every language can segment every word.
        least = UNSEEN / max(1, len(every))
        self.known = with_beginnings({k: tuple((1 - UNSEEN) * models[x].get(k, 0.0) + least for x in self.langs) for k in every})
        self.kept: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.langs) + 1))
        self.used = 0

    def word(self, chunk: str) -> list[float]:
        """Log-probabilities of the letters of a chunk by language, and 1 if it has any."""
        w = letters(chunk)
        if not w:
            return [0.0] * (len(self.langs) + 1)
        return [*self.logs(MARK + w), 1.0]

    def forward(self, word: str) -> list[float]:
        """Probability of a word in each language, summed over its segmentations."""
        return [math.exp(x) for x in self.logs(word)]

    def logs(self, word: str) -> list[float]:
        """Logarithms of these probabilities. Sums over segmentations go from left to right; whenever a language's get
        small, they are scaled up together, so words of any length are summed whole."""
        n, get, scaled = len(word), self.known.get, [0] * len(self.langs)
        a: list[list[float] | None] = [None] * (n + 1)
        a[0] = [1.0] * len(self.langs)
        far = 0  # the last place that has a sum
        for i in range(n):
            x = a[i]
            if x is None:  # a character that begins no piece is passed alone
                x = a[i] = [v * UNKNOWN for v in a[i - 1]]
            if min(x) < SMALL:
                up = [SCALE if v < SMALL else 1.0 for v in x]
                scaled = [t + (u > 1) for t, u in zip(scaled, up)]
                for j in range(i, max(far, i) + 1):
                    if (y := a[j]) is not None:
                        a[j] = [v * u for v, u in zip(y, up)]
                x = a[i]
            for j in range(i + 1, n + 1):
                q = get(word[i:j], False)
                if q:
                    y = a[j]
                    a[j] = [u * v for u, v in zip(x, q)] if y is None else [w + u * v for w, u, v in zip(y, x, q)]
                    far = max(far, j)
                elif q is False:  # no piece begins so
                    break
        last = a[n] or [v * UNKNOWN for v in a[n - 1]]
        return [math.log(max(p, 1e-300)) - t * math.log(SCALE) for p, t in zip(last, scaled)]

    def _add(self, chunk: str) -> int:
        if self.used == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[self.used] = self.word(chunk)
        self.used += 1
        return self.used - 1

    def sums(self, text: str) -> np.ndarray:
        chunks, kept = text.lower().split(), self.kept
        extra = np.zeros(self.table.shape[1])
        if new := {c for c in chunks if c not in kept}:
            if self.used + len(new) > KEPT:
                kept.clear()
                self.used, new = 0, set(chunks)
            for c in new:
                if len(c) <= KEPT_CHARS and self.used < KEPT:
                    w = letters(c)  # with other marks around it, a word scores the same
                    kept[c] = self._add(c) if w == c or w not in kept else kept[w]
            rare = {c for c in new if c not in kept}
            if rare:
                for c in chunks:
                    if c in rare:
                        extra += self.word(c)
                chunks = [c for c in chunks if c not in rare]
        return self.table[np.fromiter(map(kept.__getitem__, chunks), np.int64, len(chunks))].sum(axis=0) + extra

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs:
            return UNDETERMINED, 0.0
        s = self.sums(text)
        if not s[-1]:
            return UNDETERMINED, 0.0
        best = int(s[:-1].argmax())
        d = (s[:-1] - s[best]) / s[-1]  # the mean word's evidence, whatever the length
        return self.langs[best], float(1 / np.exp(np.maximum(d, -700)).sum())


def identify(docs: DataFrame, models: dict[str, dict[str, float]], text: str = "text") -> DataFrame:
    """docs with lang_pred and score (0 to 1) of each whole text.

    Defined results: a null text, one without a letter, or no model at all gives `und` with score 0; of equally likely
    languages the first by name is taken; repeated rows are scored each, an empty table stays empty, ids play no part;
    columns named lang_pred or score are replaced; texts and words may have any length. No shuffle. The models are broadcast: their size is
    bounded by the vocabulary and the number of languages, whatever the number of documents.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop("lang_pred", "score")
    sent, key = spark.sparkContext.broadcast(models), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held(("language", key), lambda: Scorer(sent.value))
        for b in batches:
            found = [scorer.predict(x) for x in b.column(text).to_pylist()]
            langs, scores = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, docs.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema)
