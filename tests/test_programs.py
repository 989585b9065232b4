import json

import pytest
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import functions as F

from flintsieve.functions import text as T
from flintsieve.operators import context, ensemble, features, models, program, select, split
from flintsieve.sources import readers


def _programs(spark, docs):
    return readers.parse_programs(spark.createDataFrame([(f"{i}.json", d) for i, d in enumerate(docs)], "json_file string, value string"))


def test_documents_become_features(spark):
    one = {"name": "f", "entry": "1", "features": {"n": 2, "ok": True, "text": "x"}, "Pcode": {"COPY": 3, "x": "y"}, "l": [1, True, "s"], "m": 4, "o": [{"a": 1, "b": {"c": [1, 2]}}, {"a": 3}, None], "none": None, "deep": {"x.y": 1.5}}
    docs = [json.dumps([one, 5]), json.dumps({"funcs": [{"m": "text", "o": []}]}), "no json", None, "7", json.dumps({"functions": []})]
    df = features.program_features(_programs(spark, docs), ["json_file"])
    a, b = [r.asDict() for r in df.orderBy("json_file").collect()]
    want = {"n": 2, "ok": 1, "pcode_COPY": 3, "l_count": 2, "l_sum": 2, "m": 4, "o_count": 3, "o_dict_count": 2, "o_a_count": 2, "o_a_mean": 2, "o_b_c_sum_count": 1, "o_b_c_sum_max": 3, "deep_x_y": 1.5}
    assert {k: a[k] for k in want} == want and not {"text", "none", "name", "entry"} & set(a)
    assert b["json_file"] == "1.json" and set(v for k, v in b.items() if k != "json_file") == {0.0}
    texts = spark.createDataFrame([("a", "{}"), ("b", "{"), ("c", None)], "json_file string, value string")
    assert {r[0] for r in readers.unreadable(texts).collect()} == {"b", "c"}


def test_members_are_matched_by_name(spark):
    df = spark.createDataFrame([(("", "s", False), 0)], "sink struct<API: string, src: string, is_on: boolean>, n int")
    members = features.strings_and_numbers(df.schema)
    got = df.select(features.first_match(members, ["sink_api", "src"]).alias("a"), features.first_match(members, ["is_on"]).alias("b"), features.first_match(members, ["N"]).alias("c"), features.first_match(members, ["zz"]).alias("d")).first()
    assert tuple(got) == ("s", "false", "0", None)


def test_stack_accesses(spark):
    df = spark.createDataFrame([(1, "MOV", "[RBP-8]"), (1, "lea", "local_8"), (1, "movs", None), (2, "rep stos", "eax")], "f int, mnemonic string, operands string")
    assert {tuple(r) for r in program.stack_accesses(df, ["f"]).collect()} == {(1, 2, 1), (2, 0, 0)}


def test_softmax_gate_weighs_the_closest_model(spark):
    rows = [(i % 2, 0.9 if (i // 2) % 2 == i % 2 else 0.1, 0.2 + 0.6 * (i % 2), float(i // 2 % 2)) for i in range(200)]
    df = spark.createDataFrame(rows, "y int, p_a double, p_b double, x double")
    gate = ensemble.softmax_gate(df, ["a", "b", "c"][:2], ["p_a", "p_b"])
    out = ensemble.apply_softmax_gate(df, gate, ["a", "b"])
    assert out.columns == [*df.columns, "p"] and out.where("p < least(p_a, p_b) - 1e-9 OR p > greatest(p_a, p_b) + 1e-9").isEmpty()
    assert isinstance(gate.stages[-1], LogisticRegressionModel)
    alone = ensemble.softmax_gate(df.where("y = 1 AND p_a > 0.5"), ["a", "b"], ["p_a", "p_b"])
    assert alone == 0 and ensemble.apply_softmax_gate(df, alone, ["a", "b"]).where("p <> p_a").isEmpty()


def test_holdout_keeps_groups_or_deals_rows(spark):
    df = spark.range(2000).select("id", (F.col("id") % 40).alias("g"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    out = split.holdout(df, "g", "label")
    assert out.groupBy("g").agg(F.count_distinct("partition").alias("k")).where("k > 1").isEmpty()
    assert 0.15 < out.where("partition = 'held'").count() / 2000 < 0.25
    few = split.holdout(df.withColumn("g", F.lit(1)), "g", "label")
    assert 0.2 < few.where("partition = 'held'").count() / 2000 < 0.3
    rows = split.row_split(df, ["id"], "label")
    shares = {r["partition"]: r["n"] / 2000 for r in rows.groupBy("partition").agg(F.count("*").alias("n")).collect()}
    assert shares == pytest.approx({k: v / 1000 for k, v in split.PARTS.items()}, abs=0.04)


def test_importances_and_saved_models(spark, tmp_path):
    df = spark.range(300).select((F.col("id") % 2).cast("double").alias("good"), (F.col("id") % 7).cast("double").alias("noise"), (F.col("id") % 2).cast("int").alias("label"))
    got = {r["feature"]: r for r in select.importances(df, ["noise", "good"], count=10).collect()}
    assert got["good"]["rf_importance"] > 0.8 and got["good"]["et_importance"] > got["noise"]["et_importance"]
    model = models.train(df, ["noise", "good"], "DecisionTree")
    ranks = {r["feature"]: r["rf_importance"] for r in select.model_importances(spark, {"DecisionTree": model, "LogisticRegression": models.train(df, ["noise", "good"], "LogisticRegression")}).collect()}
    assert ranks == {"noise": 0.0, "good": 1.0}
    folder = f"{tmp_path}/m"
    readers.save_models({"DecisionTree": model}, folder, ["noise", "good"])
    loaded, errors = readers.load_models(folder, ["DecisionTree", "absent"])
    assert list(loaded) == ["DecisionTree"] and list(errors) == ["absent"]
    assert readers.infer_features(spark, [f"{folder}/none.txt", f"{folder}/feature_columns.json"], {}) == ["noise", "good"]
    assert readers.infer_features(spark, [], loaded) == ["noise", "good"]
    with pytest.raises(ValueError):
        readers.infer_features(spark, [], {})


def test_reports_and_json_are_written(spark, tmp_path):
    a = spark.createDataFrame([("x", 1.5), (None, 2.0)], "name string, v double")
    readers.write_report({"first": a, "second": a.select("name").limit(0)}, f"{tmp_path}/r")
    assert [r[0] for r in spark.read.text(f"{tmp_path}/r").collect()] == ["== first", "name, v", "x, 1.500000", ", 2.000000", "== second", "name"]
    readers.write_json(a, f"{tmp_path}/j")
    assert sorted(r[0] for r in spark.read.text(f"{tmp_path}/j").collect()) == ['{"name":"x","v":1.5}', '{"name":null,"v":2.0}']


def test_loops_are_looked_at_once(spark):
    """Neither lines, buffers nor windows are made again for each count or line."""
    df = spark.createDataFrame([(1, "char a [4];\nfor (i = 0; i < 3; i++) {\n  a[i] = getenv(x);\n}\nwhile (1) ;")], "fn long, text string")
    df = df.select(context.loops(T.lines(F.col("text")), T.buffers(F.col("text"))).alias("x")).select("x.*")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(for|while)") == 1 and plan.count("11), ") == 1
    assert tuple(df.first()) == (2, 1, 1, 2, 0, 1, 1, 5.0)


def test_documents_are_made_by_all_tasks(spark, monkeypatch):
    from flintsieve.plans import program_queries

    seen = []
    monkeypatch.setattr(program_queries.features, "program_features", lambda programs, ids: seen.append(programs) or programs)
    program_queries.program_features(spark, "/root/testdata/sf0.001")
    assert seen[0].select(F.spark_partition_id()).distinct().count() == 4


def test_texts_of_calls_are_made_after_parts_are_dealt_out(spark):
    from flintsieve.plans import feature_queries

    plan = feature_queries.static_score(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Repartition ", 1)
    assert "void fn_" in above and "void fn_" not in below


def test_training_cuts_the_lineage_of_rounds(spark):
    df = spark.range(40).select((F.col("id") % 5).cast("double").alias("a"), (F.col("id") % 2).cast("int").alias("y"))
    models.train(df, ["a"], "XGBoost", "y", rounds=2)
    assert spark.sparkContext.getCheckpointDir()
