"""Queries of operators that have SQL give what DuckDB gives for it, on tables with nulls, empty texts and copies."""

import duckdb
import pytest

from flintsieve.llm import queries

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
LONG = " ".join(f"{a}{b}" for a in WORDS for b in range(20))
ITEM = "Which river runs past the old mill at the northern end of the valley? It is the Silver Brook river."
DOCUMENTS = [
    (1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  TWO"), (6, "one two three four"), (7, LONG), (8, LONG.upper()), (9, LONG + " tail of some words"),
    (10, LONG.replace("mu7", "other")), (11, LONG + " " + LONG[::-1]), (12, "Élan ÉLAN a b c"), (13, "Élan élan a b c"), (14, f"Before it. {ITEM} After it."), (15, f"{LONG} {ITEM} {LONG}"),
    (16, ITEM.split("?")[0]), (17, "The answer is Silver Brook river."), (19, "a which word has no number? Ruritania. b"), (18, ITEM.lower().replace("?", "").replace(".", "")),
]
BENCHMARK = [(1, ITEM), (2, "What is the capital of the made up land of Ruritania? Strelsau."), (3, None), (4, ""), (5, "..."), (None, "Which word has no number? Ruritania.")]
PAGES = [(1, None), (2, "no scheme"), (3, "https://A.Example.NET/en/x?q#f"), (4, "http://example.net/de/"), (5, "ftp://shop.example.com/de/a"), (6, "http://example.com"), (7, "x://b.org/fr/#"), (8, "x://notnet/"), (9, "")]
EMBEDDINGS = [(1, [1.0, 0.0], 1), (2, [1.0, 0.1], 1), (3, [1.0, 0.25], 1), (4, [1.0, 0.0], 2), (5, None, 1), (6, [0.0, 0.0], 1), (7, [1.0, 0.0], None), (8, [float("nan"), 0.0], 1), (9, [-1.0, 0.0], 1)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    for name, rows, schema in (("documents", DOCUMENTS, "doc_id long, text string"), ("benchmark", BENCHMARK, "item_id long, text string"), ("pages", PAGES, "page_id long, url string"), ("embeddings", EMBEDDINGS, "vec_id long, embedding array<float>, label int")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, folder, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    found = queries.QUERIES[name](spark, folder)
    cursor = db.execute(queries.SQL[name])
    order = [[c[0] for c in cursor.description].index(c) for c in found.columns]
    assert len(order) == len(cursor.description)
    expected = [tuple(r[k] for k in order) for r in cursor.fetchall()]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)
    assert expected
