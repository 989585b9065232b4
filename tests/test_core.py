"""Behaviour of the library's own operators: names, text, metrics, splits, inference, statistics, sources, streams."""

import json

import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flintsieve.functions import names, text
from flintsieve.operators import ensemble, findings, infer, metrics, models, program, scoring, split, stats, vectorize
from flintsieve.plans import model_queries
from flintsieve.plans.feature_queries import NAMES, line_window_text
from flintsieve.sources import readers
from flintsieve.streaming import screen

CODE = '''void f(char *param_1) {
  char local_18 [0x10];
  wchar_t w [4];
  char local_18 [99];
  char z [0];
  if (strlen(param_1) < 16) {
    __strcpy_chk(local_18, param_1, (size_t)(0x10 - 1));
  }
  memcpy(&local_18[2], "a,\\"b", sizeof(local_18)+4);
  foo(local_18);
  gets(local_18);
}

'''


def one(spark, column, **values):
    schema = T.StructType([T.StructField(k, T.LongType() if isinstance(v, int) else T.StringType()) for k, v in values.items()])
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def test_lines_and_buffers(spark):
    assert one(spark, text.lines(F.col("t")), t="a\nb\n\n") == ["a", "b"] and one(spark, text.lines(F.col("t")), t="") == [] and one(spark, text.lines(F.col("t")), t=None) == []
    got = [tuple(b) for b in one(spark, text.buffers(F.col("t")), t=CODE)]
    assert got == [("local_18", "char", 16, 1, 16, -24), ("w", "wchar_t", 4, 4, 16, None)]


def test_every_line_has_its_window(spark, tmp_path):
    docs = [(1, "\n".join("x" * (k % 7) + "y" for k in range(23)) + "\n\n"), (2, ""), (3, None), (4, "one"), (5, "a\r\n\nb")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for k, t in docs:
        ls = (t or "").rstrip("\n").replace("\r\n", "\n").split("\n") if t else []
        want += [(k, i, sum(len(x) + 1 for x in ls[max(0, i - 8) : i])) for i in range(len(ls))]
    assert sorted(map(tuple, line_window_text(spark, str(tmp_path)).collect())) == want


@pytest.mark.parametrize(("inside", "want"), [("a, b", ["a", "b"]), ("f(x, y), \"p,q\", 'c'", ["f(x, y)", '"p,q"', "'c'"]), ("", []), ("a,,b", ["a", "", "b"]), ("a, ", ["a"]), (r'"x\",y", 2', [r'"x\",y"', "2"])])
def test_arguments(spark, inside, want):
    assert one(spark, text.arguments(F.col("t")), t=inside) == want


@pytest.mark.parametrize(("expr", "want"), [
    ("32", 32), ("0x20-1", 31), ("(size_t)0x20", 32), ("((int)(4 + 4))", 8), ("sizeof(buf)-1", 63), ("sizeof buf", 64), ("sizeof(other)", None), ("n", None), ("strlen(s)+1", None), ("3-4", None), ("", None), ("-2+5", 3),
    ("(" * 200 + "5" + ")" * 200, 5), ("(size_t) (" * 50 + " 7 " + ")" * 50, 7), ("((4)+(4))", None), ("(4", None), ("4)", None), ("()", None), ("((int))", None), ("(int)(long)(uint)(ulong)(size_t)9", 9), (" ( ( (int) 0x10 ) ) ", 16), ("(1)-(2)", None), ("(((((((5)))))))", 5),
])
def test_sizes(spark, expr, want):
    assert one(spark, text.size_value(F.col("e"), F.lit("buf"), F.lit(64)), e=expr) == want


def test_brackets_are_taken_off_to_the_end(spark):
    cast = re.compile(r"^\s*\(\s*(?:size_t|int|unsigned\s+long)\s*\)\s*")

    def wraps(e):
        depth = 0
        for i, c in enumerate(e):
            depth += (c == "(") - (c == ")")
            if depth < 0 or (depth == 0 and i < len(e) - 1):
                return False
        return depth == 0

    def plain(e):
        e, before = e.strip(" "), None
        while e != before:
            before, e = e, cast.sub("", e, count=1).strip(" ")
            while e.startswith("(") and e.endswith(")") and wraps(e):
                e = e[1:-1].strip(" ")
        return e

    rnd = random.Random(2)
    exprs = ["".join(rnd.choices(["(", ")", "(int)", "( size_t )", "(unsigned long)", "5", "+", " "], [6, 6, 2, 1, 1, 3, 1, 1], k=rnd.randrange(12))) for _ in range(3000)]
    exprs += ["(" * k + e + ")" * k for k in (1, 2, 5) for e in exprs[:500]]
    found = {r[0]: r[1] for r in spark.createDataFrame([(e,) for e in set(exprs)], "e string").select("e", text.size_value(F.col("e"), F.lit(""), F.lit(0))).collect()}
    number = re.compile(r"[+]?\d+([+]\d+)*")
    for e in set(exprs):
        bare = re.sub(r"\s+", "", plain(e))
        assert found[e] == (sum(map(int, re.findall(r"\d+", bare))) if number.fullmatch(bare) else None), (e, bare)


@pytest.mark.parametrize(("name", "want"), [("__strcpy_chk", "strcpy_chk"), ("j_memcpy@@GLIBC_2.2", "memcpy"), ("gets@plt", "gets"), (None, "")])
def test_symbols(spark, name, want):
    assert one(spark, text.symbol(F.col("n")), n=name) == want


def test_variables_and_literals(spark):
    for e, want in {"&buf[3]": "buf", "*p->next": "p", "a.b": "a", "(char *)x": "char", "": ""}.items():
        assert one(spark, text.variable(F.col("e")), e=e) == want
    assert one(spark, text.literal_length(F.col("e")), e=r'L"a\"b"') == 4 and one(spark, text.literal_length(F.col("e")), e="x") is None
    assert one(spark, text.stack_offset(F.col("e")), e="rbp-0x10") == -16 and one(spark, text.stack_offset(F.col("e")), e="local_1c") == -28 and one(spark, text.stack_offset(F.col("e")), e="x") is None


def test_call_sites_and_scores(spark):
    df = spark.createDataFrame([(1, "f", ["param_1"], CODE), (2, "g", [], None)], "fn long, function string, params array<string>, text string")
    rows = scoring.score_sites(scoring.call_sites(df)).orderBy("line_index").collect()
    assert [r["api"] for r in rows] == ["strcpy_chk", "memcpy", "gets"]
    a, b, c = rows
    assert (a["size_value"], a["dst_buffer_size"], a["src_origin"], a["has_guard_before"], a["high_guard"]) == (15, 16, "parameter", True, True)
    assert (b["size_value"], b["size_gt_dst"], b["overflow_margin"], b["src_origin"]) == (20, True, 4, "literal")
    assert not c["dst_is_local_buffer"] and c["risk_score"] == 0 and c["safe_score"] >= 1.5
    assert b["risk_score"] == 3 + 5 and b["safe_score"] == 9.5 and b["likely_safe"]
    assert scoring.roll_up(scoring.score_sites(scoring.call_sites(df)), ["fn"]).first()["n_sites"] == 3


def test_feature_groups_have_the_known_variants(spark):
    assert names.feature_group("v6_alias_summary_x") == "raw_buffer_alias" and names.feature_group("v6_alias_summary_x", "selector") == "other"
    got = {r["f"]: r["g"] for r in spark.createDataFrame([(n,) for n in NAMES], "f string").select("f", names.feature_group_column(F.col("f")).alias("g")).collect()}
    assert got == {n: names.feature_group(n) for n in NAMES}
    assert stats.quotas(160) == dict(zip(stats.C.QUOTAS, [43, 32, 19, 19, 16, 13, 10, 6, 2, 0, 0]))
    assert sum(stats.quotas(97).values()) == 97


def test_thresholds_equal_a_plain_sweep(spark):
    rows = [(i % 3 == 0, (i * 37 % 101) / 100) for i in range(400)] + [(True, metrics.THRESHOLDS[90]), (False, 0.0), (True, 1.0)]
    df = spark.createDataFrame([(int(a), float(b)) for a, b in rows], "y int, p double")
    for r in metrics.threshold_counts(df, []).collect():
        on = [(y, p >= r["threshold"]) for y, p in rows]
        assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (sum(y and k for y, k in on), sum(not y and k for y, k in on), sum(y and not k for y, k in on), sum(not y and not k for y, k in on))
    assert len(metrics.THRESHOLDS) == 181 and metrics.THRESHOLDS[90] == 0.4999999999999998 or metrics.THRESHOLDS[90] == pytest.approx(0.5)
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    assert metrics.roc_auc(df).first()[0] == pytest.approx(want)
    assert metrics.roc_auc(df.where("y = 1")).first()[0] is None
    best = metrics.best_threshold(metrics.with_metrics(metrics.threshold_counts(df, [])), [], 0.95).first()
    assert best["recall"] >= 0.95


METRICS = [  # published confusion counts (tn, fp, fn, tp) with accuracy, precision, recall and F1
    ((3839, 825, 76, 2706), (0.8790, 0.7664, 0.9727, 0.8573)), ((3889, 775, 117, 2665), (0.8802, 0.7747, 0.9579, 0.8566)), ((3810, 854, 145, 2637), (0.8658, 0.7554, 0.9479, 0.8407)),
    ((3159, 1505, 353, 2429), (0.7505, 0.6174, 0.8731, 0.7233)), ((3848, 816, 108, 2674), (0.8759, 0.7662, 0.9612, 0.8527)),
]


def test_metric_identities(spark):
    df = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(METRICS)], "i int, tn long, fp long, fn long, tp long")
    for r in metrics.with_metrics(df).collect():
        assert [r["accuracy"], r["precision"], r["recall"], r["f1"]] == pytest.approx(METRICS[r["i"]][1], abs=6e-5)


def test_votes_and_gates(spark):
    df = spark.createDataFrame([(1, 0.8, 0.2)], "y int, p_a double, p_b double")
    assert infer.predict(df, {"RandomForest": "p_a", "XGBoost": "p_b"}, "WEIGHT_X", {"RandomForest": 0.75, "XGBoost": 0.25}).first()["prob_vulnerable"] == pytest.approx(0.65)
    assert len(ensemble.compositions(3, 20)) == 231 and len(ensemble.compositions(4, 20)) == 1771
    assert ensemble.weight_grid(spark, ["rf", "xgb", "dt", "lr"], most={"lr": 0.1}).count() == 631
    assert df.select(ensemble.closest_model(["a", "b"])).first()[0] == 0
    assert ensemble.fit_gate(df, "p_a", "p_b", ["p_a"]) == 0.0


def test_recipes_and_inputs(spark):
    with pytest.raises(ValueError, match="Missing required"):
        infer.predict(spark.range(1), {"RandomForest": "id"}, "WEIGHT_RF_XGB", {"RandomForest": 0.5, "XGBoost": 0.5})
    with pytest.raises(ValueError, match="Unsupported"):
        infer.components("STACK_LOGISTIC_PROB_RISK")
    assert infer.available({"RandomForest": {}, "STACK_X": {}, "WEIGHT_A": {"XGBoost": 1.0}}, {"RandomForest"}) == ["RandomForest"]
    df = spark.createDataFrame([(None, "1"), (float("inf"), "x"), (2.0, "3")], "a double, b string")
    assert sorted(r["a"] for r in infer.prepare(df, ["a"]).collect()) == [0, 0, 2]
    with pytest.raises(ValueError, match="nonnumeric"):
        infer.prepare(df, ["a", "b"])
    with pytest.raises(ValueError, match="missing"):
        infer.prepare(df, ["absent"])


def test_group_split(spark):
    df = spark.createDataFrame([(i, f"group_{i // 4}", i % 2) for i in range(400)], "i int, g string, y int")
    a, b = (sorted(map(tuple, split.group_split(df, "g", "y").collect())) for _ in range(2))
    assert a == b and len(a) == 400
    parted = split.group_split(df, "g", "y")
    split.check_split(parted, "g", "y")
    assert {r["partition"]: r["n_rows"] for r in split.split_report(parted, "g", "y").collect()} == {"train": 240, "meta": 40, "select": 40, "test": 80}
    with pytest.raises(ValueError, match="overlap by group"):
        split.check_split(parted.withColumn("partition", F.when(F.col("i") == 0, "other").otherwise(F.col("partition"))), "g", "y")
    with pytest.raises(ValueError, match="groups cannot fill"):
        split.group_split(df.where("g = 'group_1'"), "g", "y")
    with pytest.raises(ValueError, match="no group"):
        split.group_split(df.withColumn("g", F.when(F.col("i") > 4, F.col("g"))), "g", "y")


@pytest.mark.parametrize("seed", [1, 2])
def test_group_split_keeps_shares_with_one_large_group_among_many(spark, seed):
    # One group has a third of the rows, and 40 of the 30,000 small ones have almost all rows of class 1.
    one = spark.range(15_000).select(F.lit(-1).cast("long").alias("g"), F.lit(0).alias("y"))
    df = spark.range(30_000).select(F.col("id").alias("g"), (F.col("id") < 40).cast("int").alias("y")).unionByName(one)
    parted = split.group_split(df, "g", "y", seed)
    split.check_split(parted, "g", "y")
    got = {r["partition"]: r for r in split.split_report(parted, "g", "y").collect()}
    for name, share in split.PARTS.items():
        assert got[name]["n_rows"] == pytest.approx(45.0 * share, rel=0.02) and got[name]["n_vulnerable"] == pytest.approx(0.04 * share, abs=1)
    assert sorted(map(tuple, parted.collect())) == sorted(map(tuple, split.group_split(df.repartition(7), "g", "y", seed).collect()))


def test_flatten_and_align(spark):
    df = spark.createDataFrame(
        [({"n": 2}, [(1.0, True), (3.0, None)], {"COPY": 4}, [1, 0], ["x"], "t"), (None, None, None, None, None, None)],
        "summary struct<n: long>, sinks array<struct<size: double, flag: boolean>>, pcode_counts map<string, long>, stack_offsets array<long>, names array<string>, note string",
    )
    flat = vectorize.flatten(df.schema, maps={"pcode": ["COPY", "ADD"]}, nonzero=True)
    a, b = df.select(*[c.alias(k) for k, c in flat.items()]).collect()
    assert (a["summary_n"], a["sinks_count"], a["sinks_size_mean"], a["sinks_flag_count"], a["pcode_COPY"], a["pcode_ADD"], a["stack_offsets_nonzero"], a["names_count"]) == (2, 2, 2, 1, 4, 0, 0.5, 1)
    assert set(b) == {0.0} and "note" not in flat
    out = vectorize.align(spark.createDataFrame([("f", "1.5", float("nan"), 9)], "function string, b string, a double, extra int"), ["function", "entry"], ["a", "b", "c"])
    assert out.columns == ["function", "a", "b", "c"] and tuple(out.first()) == ("f", 0.0, 1.5, 0.0)
    assert vectorize.key_name("a.b -c$") == "a_b_c"


def test_program_aggregates(spark):
    e = spark.createDataFrame([(1, 2), (1, 2), (1, 9), (2, 1)], "src long, dst long")
    got = {r["node"]: (r["callee_count"], r["caller_count"], r["external_callee_ratio"]) for r in program.call_degrees(e, spark.createDataFrame([(1,), (2,), (3,)], "node long")).collect()}
    assert got == {1: (2, 1, 0.5), 2: (1, 1, 0.0), 3: (0, 0, 0.0)}


def test_findings_keep_known_quirks(spark):
    results = spark.createDataFrame([("f", "e1", 0.9), ("f", "e2", 0.2), ("g", "e3", 0.4)], "function string, entry string, prob_vulnerable double")
    sites = spark.createDataFrame([("f", "e1"), ("x", "e3"), ("y", "e9")], "function string, entry string")
    assert {r["function"]: r["function_probability"] for r in findings.with_probability(sites, results).collect()} == {"f": 0.2, "x": 0.4, "y": 0.0}
    row = ("f", "e", "strcpy", "b", "s", "HIGH", "unbounded dangerous sink", 0.9, 1, 10, 0, 0, 0.0)
    found = spark.createDataFrame([row], "function string, entry string, sink_api string, dst_buffer string, src string, finding_risk string, reason string, function_probability double, line_index int, dst_stack_size long, size_value long, overflow_margin long, size_to_dst_ratio double")
    assert findings.static_scores(found).first()["static_finding_score"] == 0.68
    assert findings.static_scores(found, own_reason_is_evidence=False).first()["static_finding_score"] == pytest.approx(0.92)


def test_correlated_features_are_pruned(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, float(i % 7), 1.0) for i in range(50)], "a double, b double, c double, d double")
    m = stats.correlations(df, ["a", "b", "c", "d"])
    assert stats.prune_correlated(["b", "a", "c", "d"], ["a", "b", "c", "d"], m) == ["b", "c", "d"]


def test_sources(spark, tmp_path):
    docs = {"a.json": {"schema": "s", "program": {"program_name": "p"}, "functions": [{"name": "f", "entry": "1"}, {"name": "", "function": "g"}]}, "b.json": [{"name": "h"}], "c.json": {"name": "solo"}, "d.info.json": {"funcs": [{"name": "i"}]}}
    for k, v in docs.items():
        (tmp_path / k).write_text(json.dumps(v))
    (tmp_path / "bad.json").write_text("{")
    rows = readers.with_ids(readers.read_programs(spark, str(tmp_path), skip_info=True)).collect()
    assert sorted((r["json_file"], r["function"], r["binary"]) for r in rows) == [("a.json", "f", "p"), ("a.json", "g", "p"), ("b.json", "h", "b"), ("c.json", "solo", "c")]
    (tmp_path / "x").mkdir()
    with pytest.raises(ValueError, match="no function"):
        readers.read_programs(spark, str(tmp_path / "x"))
    (tmp_path / "l.txt").write_text("a # first\n\nb\n")
    (tmp_path / "l.json").write_text('{"features": ["c", "d"]}')
    (tmp_path / "l.csv").write_text("e,f\n1,2\n")
    assert [readers.read_feature_list(spark, str(tmp_path / f"l.{k}")) for k in ("txt", "json", "csv")] == [["a", "b"], ["c", "d"], ["e", "f"]]
    (tmp_path / "t.csv").write_text("a,b\n1,x\n")
    assert readers.read_table(spark, str(tmp_path / "t.csv")).dtypes == [("a", "string"), ("b", "string")]
    (tmp_path / "bin").mkdir()
    (tmp_path / "bin/elf").write_bytes(b"\x7fELF123")
    (tmp_path / "bin/txt").write_bytes(b"no")
    assert sorted(r["is_elf"] for r in readers.read_binaries(spark, str(tmp_path / "bin")).collect()) == [False, True]
    readers.write_table(spark.createDataFrame([(1,)], "q int").coalesce(1), str(tmp_path / "out"))
    assert [tuple(r) for r in readers.read_table(spark, str(tmp_path / "out")).collect()] == [("1",)]


def test_streams_give_the_batch_result(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "value")
    df.repartition(2).write.parquet(str(tmp_path / "in"))
    q = screen.window_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, screen.window_counts(df).collect()))


def test_models_learn(spark):
    df = spark.createDataFrame([(float(i % 10), float(i % 3), int(i % 10 > 6)) for i in range(300)], "a double, b double, y int")
    for name in ("LogisticRegression", "DecisionTree", "RandomForest", "XGBoost"):
        m = models.train(df, ["a", "b"], name, "y", trees=5, rounds=5)
        assert metrics.roc_auc(models.scored(m, df, "p")).first()[0] > 0.95


def test_registered_models_have_their_full_size(spark, monkeypatch):
    class Stop(Exception):
        pass

    def fit(pipeline, df):
        assert pipeline.getStages()[-1].getMaxIter() == 450
        raise Stop

    def forest(df, features, label, trees, **more):
        assert trees == 300
        raise Stop

    monkeypatch.setattr(models.Pipeline, "fit", fit)
    monkeypatch.setattr(model_queries.trees, "fit_forest", forest)
    for query in ("train_gbt", "train_rf"):
        with pytest.raises(Stop):
            model_queries.QUERIES[query](spark, "/root/testdata/sf0.001")
