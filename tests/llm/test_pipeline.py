"""Each stage of the pipeline against a brute-force version, on the smallest documents and on odd rows."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from flintsieve.llm import decontaminate, pii
from flintsieve.llm.queries import vocabulary
from tests.llm.test_operators import ODD, PII, brute_groups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    """Real documents with odd rows: null ids, repeated rows, one id with two texts, clashing columns."""
    real = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(i if i != 3 else None, x, "en", "s", 1) for i, x in enumerate(ODD, 100_000)] + [(None, "same words in the same order here", "de", "s", 1)] * 2 + [(100_001, "another text of this id", "de", "s", 1)]
    frame = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")
    both = real.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars")).unionByName(frame)
    return both.withColumns({c: F.lit(c) for c in ("score", "lang_pred", "spans", "row", "base", "place", "file_key", "size", "k1")}).repartition(3)


def rows(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_language_drops_what_has_no_letter(spark, docs):
    got = P.language(spark, docs, SF)
    assert got.columns == docs.columns and got.where("score <> 'score' OR lang_pred <> 'lang_pred'").isEmpty()
    assert rows(got) == [r for r in rows(docs) if any(c.isalpha() for c in r[1] or "")]
    assert P.language(spark, docs.limit(0), SF).isEmpty()


def test_near_copies_keep_one_row_of_each_group(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "d"))
    for df in (docs, spark.read.parquet(str(tmp_path / "d"))):  # rows without and with a place in a file
        got = P.near_copies(spark, df, SF)
        every = rows(df)
        group = {k: g for k, (_, _, g) in enumerate(brute_groups_of_rows(every))}
        want = []
        for g in set(group.values()):
            members = [every[k] for k, h in group.items() if h == g]
            want.append(min((r[0] is None, r[0] or 0) for r in members) if members[0][1] and members[0][1].split() else None)
        alone = [r for r in every if not (r[1] or "").encode().split()]
        assert got.columns == df.columns and got.count() == len([w for w in want if w]) + len(alone)
        assert sorted([(r[0] is None, r[0] or 0) for r in rows(got) if (r[1] or "").encode().split()]) == sorted(w for w in want if w)
    assert P.near_copies(spark, docs.limit(0), SF).isEmpty()


def brute_groups_of_rows(every):
    """(row, size, smallest row of its group), rows standing for ids, so that rows of one id are told apart."""
    return sorted(brute_groups([(k, x or "") for k, (_, x) in enumerate(every)], 5, 80))


def test_leaks_drop_documents_with_items(spark, docs):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    some = items.limit(3).select(F.lit(900_000).cast("long").alias("doc_id"), F.concat(F.lit("Before. "), "text", F.lit(" After.")).alias("text"))
    df = docs.unionByName(some, allowMissingColumns=True)
    bench = [re.findall(r"\w+", r["text"].lower()) for r in items.collect()]
    five = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    hit = lambda x: any(len(five(b) & five(re.findall(r"\w+", (x or "").lower()))) >= decontaminate.MIN_GRAMS * len(five(b)) for b in bench)
    got = P.leaks(spark, df, SF)
    assert rows(got) == [r for r in rows(df) if not hit(r[1])] and got.where("doc_id = 900000").isEmpty()
    assert P.leaks(spark, docs.limit(0), SF).isEmpty()


def test_personal_data_is_generalised(spark, docs):
    lines = [(800_000 + i, f"mail me{i}@corp.example or +49 30 1234567{i} from 10.0.0.{i}", "en", "s", 1) for i in range(5)]
    df = docs.unionByName(spark.createDataFrame(lines, "doc_id long, text string, lang string, source string, n_chars long"), allowMissingColumns=True)
    got = P.personal_data(spark, df, SF)
    assert got.columns == df.columns and got.where("n_chars <> length(text)").isEmpty() and got.where("spans <> 'spans'").isEmpty()
    terms = {(r["doc_id"], r["text"]): [s for s in r["spans"] if s["kind"] == "term"] for r in pii.find_personal(df).collect()}

    def clean(i, x):
        spans = sorted([(m.start(), -m.end(), k) for k, p, ok in PII for m in re.finditer(p, x or "") if ok(m)] + [(s["start"], -s["end"], "term") for s in terms[i, x]])
        out, at = "", 0
        for a, b, k in spans:
            if a >= at:
                out += x[at:a] + f"[{k.upper()}]"
            at = max(at, -b)
        return None if x is None else out + x[at:]

    assert rows(got) == sorted(((i, clean(i, x)) for i, x in rows(df)), key=str)
    assert got.where("doc_id = 800001").first()["text"] == "mail [EMAIL] or [PHONE] from [IP]"
    assert P.personal_data(spark, docs.limit(0), SF).isEmpty()


def test_token_ids_are_the_library_s(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    got = sorted(((r["doc_id"], list(r["ids"]), r["n_tokens"], r["whole"]) for r in P.token_ids(spark, docs, SF).collect()), key=str)
    want = [(i, tok.encode(x or "", add_special_tokens=False).ids) for i, x in rows(docs)]
    assert got == sorted(((i, ids, len(ids), True) for i, ids in want), key=str)
    assert P.token_ids(spark, docs.limit(0), SF).isEmpty()


def test_all_stages_run_in_order(spark):
    out = P.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert 0 < out.count() < docs.count() and out.where("NOT whole").isEmpty()
    assert out.join(docs, "doc_id", "left_anti").isEmpty() and out.count() == out.select("doc_id").distinct().count()
