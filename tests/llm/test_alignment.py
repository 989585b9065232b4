"""Alignment of tokenizers against the libraries on whole texts and counts of pairs by plain Python."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from flintsieve.llm import alignment

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    a.no_truncation()
    a.no_padding()
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def byte_letters():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def expected(texts, libraries):
    """Rows of figures, by whole texts: ends of tokens, groups between common ends, all links written out."""
    a_lib, b_lib = libraries
    letters, docs = byte_letters(), []
    for x in texts:
        if not x:
            docs.append(None)
            continue
        a, b = a_lib.encode(" " + x, add_special_tokens=False).ids, b_lib.encode(x)
        a_bytes = [bytes(letters[c] for c in a_lib.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + x).encode():
            docs.append(None)
            continue
        sides = []
        for ids, parts in ((a, a_bytes), (b, b_bytes)):
            at, ends = 0, []
            for p in parts:
                ends.append(at := at + len(p))
            sides.append((ids, ends))
        common = sorted({*sides[0][1]} & {*sides[1][1]})
        groups = []
        for low, high in zip([0, *common], common):
            groups.append(tuple([i for i, e in zip(*s) if low < e <= high] for s in sides))
        docs.append((a, b, groups, Counter((i, j) for g in groups for i in g[0] for j in g[1])))
    counts = Counter(p for d in docs if d for p in d[3])
    most = defaultdict(int)
    for (i, _), n in counts.items():
        most[i] = max(most[i], n)
    out = []
    for d in docs:
        if not d:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = d
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append((len(a), len(b), len(groups), sum(links.values()), sum(n for p, n in links.items() if counts[p] == most[p[0]]), sum(n * counts[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest()))
    return out


ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "\n", "a\nb", "a \n b", "a\tb  c", "▁ a", "x ▁", "<s> x </s> <|endoftext|> <unk>", "<0x41> a", "\x00 a\x00b", "日本語 テスト です", "x　y z", "é é ö", "👩‍👩‍👧 ok 👍🏽", "don't won't I'll",
    "a" * 5000, "ab " * 3000, " " * 300, "\n" * 300, "1234567890 " * 20, "\x1c a \x1f b", "\x85a \xa0b", "word▁word", "The The The the", "The The The the",
]


@pytest.mark.parametrize("part", [10_000_000, 5])
def test_figures_equal_whole_texts(spark, libraries, monkeypatch, part):
    monkeypatch.setattr(alignment, "PART", part)
    rnd = random.Random(3)
    alphabet = "abcdefgh THE the in of  \n\t.,'-0123éßж語👍▁\xa0"
    texts = [*ODD, *("".join(rnd.choices(alphabet, k=rnd.randrange(200))) for _ in range(150)), *(" ".join(rnd.choices(["the", "Cat,", "tokenizer", "über", "don't", "x1", "日本"], k=rnd.randrange(60))) for _ in range(100))]
    rows = spark.createDataFrame([(None if k == 7 else k, x, 1, "s") for k, x in enumerate(texts)], "doc_id long, text string, block int, slot string").repartition(3)
    found = alignment.align_tokenizers(rows, A, B)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(((None if k == 7 else k, *e) for k, e in enumerate(expected(texts, libraries))), key=repr)


def test_empty_table(spark):
    assert alignment.align_tokenizers(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0


def test_table_of_segments_starts_anew(libraries, monkeypatch):
    monkeypatch.setattr(alignment, "KEPT", 3)
    aligner = alignment.Aligner(A, B)
    for texts in (["one two three four", "five"], ["six one", "two two"], ["seven"]):
        figures = aligner.batch(texts)[0].tolist()
        assert [tuple(f) for f in figures] == [e[:4] for e in expected(texts, libraries)]
        assert aligner.batch(texts)[1] == [e[6] for e in expected(texts, libraries)]
