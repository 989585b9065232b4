"""The operators beyond former limits: marks, lost files, many items, long words, very long texts, clashing columns."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flintsieve.llm import decontaminate, jaccard_join, language_id, pii, secrets, set_hash, spans, token_store
from flintsieve.llm.queries import vocabulary

NAMES = ["_base", "_row", "_lines", "_terms", "_long", "_m", "row", "base", "id", "long", "m", "size", "k1"]


def test_ids_of_odd_marks_are_the_library_s():
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    tok, own, rng = Tokenizer.from_file(path), token_store.PieceEncoder(path), random.Random(1)
    letters = [*"aAbJHTWw iIσΣß.,!1|<>'", *map(chr, (0x331, 0x307, 0x30C, 0x308, 0x301, 0x30A, 0x130, 0x1100, 0x1161)), "é", "Å", "\n", "  "]
    for _ in range(3000):
        x = "".join(rng.choice(letters) for _ in range(rng.randint(1, 14)))
        assert np.frombuffer(own.encode(x), "<u4").tolist() == tok.encode(x, add_special_tokens=False).ids, x


@pytest.mark.parametrize("part", ["recipes", "manifest", "chunks"])
def test_a_lost_file_is_noticed(spark, part):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    store = token_store.write_store(docs, vocabulary("word_bpe_49k.json"), 2)
    folder = store.path.removeprefix("file://") + f"/{part}"
    # The largest, as some parts have files without a row.
    files = sorted((os.path.getsize(os.path.join(d, f)), os.path.join(d, f)) for d, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet"))
    os.remove(files[-1][1])
    with pytest.raises(Exception, match="missing|differ"):
        token_store.read_back(spark, store).collect()


def test_many_items_take_little_memory():
    rng = random.Random(3)
    items = [(i, " ".join(f"w{min(29_999, int(rng.paretovariate(0.6)))}" for _ in range(30)) + f". Answer a{i}.") for i in range(20_000)]
    index = decontaminate.Index(items)
    assert index.table.nbytes <= decontaminate.DENSE and not index.whole
    assert sum(g.nbytes + m.nbytes for g, m in index.few) < 100 << 20
    for i in range(0, 20_000, 4_000):
        assert i in {index.items[k] for k in index.hits("before it " + items[i][1] + " after it")}
    question = items[7][1].split(". Answer")[0]
    assert not index.hits(f"{question[: len(question) // 4]} Answer a7.") and not index.hits("Answer a7.")


def test_long_pieces_and_words_count():
    long = max(language_id.piece_list(vocabulary("piece_bpe_32k.model")), key=len)
    assert len(long) > 12
    p = {c: 0.01 for c in set(long)} | {long: 0.5}
    assert language_id.Scorer({"x": p}).forward(long)[0] > 0.4
    scorer = language_id.Scorer({"x": {"▁": 0.1, "a": 0.5}, "y": {"▁": 0.1, "a": 0.25}})
    x, y = scorer.logs("▁" + "a" * 5000)
    assert x - y == pytest.approx(5000 * np.log(2), rel=1e-2) and scorer.predict("a" * 5000)[0] == "x"
    spans_ = [(i, j, w, q) for i in range(30) for j, w, q in ((i + 1, "a", 0.3), (i + 2, "aa", 0.1)) if j <= 30]
    add = lambda rows: {w: sum(v for k, v in rows if k == w) for w in ("a", "aa")}
    assert add(language_id._expected(30, spans_)) == pytest.approx(add(language_id._expected_long(30, spans_)))


def test_very_long_texts_take_seconds(spark):
    mails = " ".join(f"user{i}@mail{i % 7}.example.org" for i in range(20_000))
    lines = "\n".join(f"line {i} from 10.0.0.{i % 256} here password=abc{i}def" for i in range(20_000))
    df = spark.createDataFrame([(1, mails), (2, lines)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.digests(df).collect()}
    assert (got[1]["n_email"], got[2]["n_ip"]) == (20_000, 20_000)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(df).collect()}
    assert clean[1] == " ".join(["[EMAIL]"] * 20_000) and clean[2].count("[IP]") == 20_000
    assert {r["doc_id"]: r["n_assign"] for r in secrets.digests(df).collect()} == {1: 0, 2: 20_000}
    groups = {r["doc_id"]: r["n_shingles"] for r in jaccard_join.near_groups(spark.createDataFrame([(1, mails * 3), (2, mails * 3)], "doc_id long, text string")).collect()}
    assert groups[1] == groups[2] > 19_000


def test_running_sums_and_overlaps(spark):
    xs = [random.Random(4).randint(0, 9) for _ in range(700)]
    got = spark.createDataFrame([(xs,), ([],)], "x array<int>").select(spans.starts(F.col("x")).alias("s")).collect()
    assert list(got[0]["s"]) == [sum(xs[:k]) for k in range(700)] and list(got[1]["s"]) == []
    a = [(3 * k, 3 * k + 2) for k in range(600)]
    b = [(30 * k, 30 * k + 7) for k in range(60)]
    df = spark.createDataFrame([(a, b)], "a array<struct<start:int,end:int>>, b array<struct<start:int,end:int>>")
    want = [s for s in a if not any(s[0] < y and x < s[1] for x, y in b)]
    assert [tuple(s) for s in df.select(spans.apart(F.col("a"), F.col("b")).alias("r")).first()["r"]] == want


def test_no_column_name_clashes(spark):
    df = spark.createDataFrame([(1, "mail a@b.cc token=abcdefgh"), (2, None)], "doc_id long, text string").withColumns({c: F.lit(c) for c in NAMES})
    for f in (pii.find_personal, secrets.find_secrets, lambda d: set_hash.with_vector(d, F.col("text"), "vector")):
        out = f(df)
        assert out.columns[:-1] == df.columns and all(out.where(f"`{c}` <> '{c}'").isEmpty() for c in NAMES) and out.count() == 2
    assert pii.sanitised(df).columns == df.columns and jaccard_join.without_near_copies(df).columns == df.columns


def test_word_hashes_do_not_depend_on_place():
    text = "A b c\x1cd  é\tb a\x0bB"
    words = text.encode().lower().split()
    h = jaccard_join._hashes(text)
    assert len(h) == len(words) and len(set(h.tolist())) == len(set(words))
    assert h[1] == h[4] == h[6] and h[0] == h[5]
    long = " ".join(f"w{i}" for i in range(300_000))
    assert len(long) > jaccard_join.PIECE and (jaccard_join._hashes(long)[-3:] == jaccard_join._hashes("w299997 w299998 w299999")).all()
