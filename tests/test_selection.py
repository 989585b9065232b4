import pytest
from pyspark.sql import functions as F

from flintsieve.operators import manifest, results, select, split


def test_result_table_hides_and_explains(spark):
    rows = [("main", 0.1, 0, 0), ("printf", 0.99, 1, 0), ("_start", 0.1, 0, 0), ("FUN_1", 0.2, 0, 0), ("FUN_2", 0.2, 1, 0), ("fun_3", 0.7, 0, 0), (None, 0.2, 0, 0), ("f", 0.9, 1, 2)]
    df = spark.createDataFrame(rows, "function string, prob_vulnerable double, sink_count int, overflow_margin int")
    got = {r["function"]: r for r in results.function_results(df).collect()}
    assert {k for k, r in got.items() if r["ignored_runtime"]} == {"printf", "_start", "FUN_1"}
    assert got["FUN_1"]["source_kind"] == results.STUB and got["FUN_1"]["top_reason"] == f"{results.STUB}, hidden by default"
    assert got["f"]["top_reason"] == "dangerous sink/copy-like call; size-vs-buffer risk" and got["main"]["top_reason"] == results.NO_REASON
    assert results.shown(results.function_results(df), flagged_only=True).count() == 2
    assert results.function_results(df.limit(0)).isEmpty()


def test_findings_are_ordered_and_rescored(spark):
    found = spark.createDataFrame([("a", "LOW", 0.9), ("b", "HIGH", 0.1), ("c", "odd", 1.0), (None, "HIGH", 0.2)], "function string, finding_risk string, function_probability double")
    assert [r["function"] for r in results.ordered_findings(found).collect()] == [None, "b", "a", "c"]
    finals = spark.createDataFrame([("a", 1, 0.3), ("a", 2, 0.4), (None, 1, 0.5)], "function string, at int, prob_vulnerable double")
    assert {r["function"]: r["function_probability"] for r in results.with_final_scores(found, finals, "at").collect()} == {"a": 0.4, "b": 0.1, "c": 1.0, None: 0.2}


def test_columns_are_cleaned_and_listed(spark):
    df = spark.createDataFrame([(1.0, None, "x", 2.0, 0), (2.0, None, "y", 2.0, 1)], "a double, b double, c string, d double, label int")
    assert select.clean(df, ["a", "b", "c", "d"]).columns == ["a", "label"]
    assert select.labelled(spark.createDataFrame([("1",), ("x",), (None,), ("2",), ("0.0",)], "label string")).count() == 2
    assert select.without_prefixes(["pcode_x", "a", "v6_aliases_b"]) == ["a"] and select.group_column(["x", "binary", "json_file"]) == "binary"
    assert select.risk_columns(["a", "rule_1", "x_loop"]) == ["rule_1", "x_loop"]
    columns = [f"pcode_{i}" for i in range(8)] + ["zzz"]
    left = select.ablations(columns)
    assert left["full"] == columns and left["drop_opcode_like"] == ["zzz"] and left["drop_other"] == columns[:-1]
    assert select.variants(["b", "a"], ["a", "b", "pcode_c"], ["b"], (1,)) == {"group_clean": ["a", "b"], "semantic_clean": ["a", "b"], "score_top1": ["b"], "score_corr_top1": ["b"]}


def test_manifest_fits_its_data_alone(spark):
    df = spark.createDataFrame([(i, i // 4, i % 2) for i in range(40)], "row long, grp long, label int")
    split = df.withColumn("partition", F.element_at(F.array(*map(F.lit, manifest.PARTITIONS)), (F.col("grp") % 4 + 1).cast("int")))
    saved = manifest.make_manifest(split, "row", "grp", "partition")
    assert manifest.loaded(saved, df.repartition(3), "row", "label").count() == 40 and manifest.validation(split).count() == split.where("grp % 4 IN (1, 2)").count()
    for wrong, frame in ((saved.where("row_id <> 3"), df), (saved, df.where("row <> 3")), (saved, df.withColumn("label", F.lit(1))), (saved.withColumn("partition", F.when(F.col("row_id") == 1, "test").otherwise(F.col("partition"))), df), (saved.unionAll(saved.limit(1)), df)):
        with pytest.raises(ValueError, match="does not fit"):
            manifest.loaded(wrong, frame, "row", "label")


def test_manifest_names_all_partitions_and_labels(spark):
    df = spark.createDataFrame([(i, i // 4, i % 2) for i in range(40)], "row long, grp long, label int")
    split = df.withColumn("partition", F.element_at(F.array(*map(F.lit, manifest.PARTITIONS)), (F.col("grp") % 4 + 1).cast("int")))
    of = lambda s, d: manifest.manifest_report(manifest.make_manifest(s, "row", "grp", "partition"), d, "row", "label").first().asDict()
    assert not any(of(split, df).values())
    alone = of(split.withColumn("partition", F.lit("train")), df)
    assert {k: v for k, v in alone.items() if v} == {"n_lacking_partitions": 3}
    other = of(split.withColumn("partition", F.when(F.col("partition") == "test", "held").otherwise(F.col("partition"))), df)
    assert {k: v for k, v in other.items() if v} == {"n_lacking_partitions": 1, "n_other_partitions": 1}
    no_labels = split.withColumn("label", F.when(F.col("partition") == "meta", None).otherwise(F.col("label")))
    found = of(no_labels, no_labels.drop("partition"))
    assert found["n_one_label"] == 1 and found["n_bad_labels"] == no_labels.where("label IS NULL").count()
    no_group = split.withColumn("grp", F.when(F.col("row") == 5, None).otherwise(F.col("grp")))
    assert of(no_group, no_group.drop("partition"))["n_no_group"] == 1
    apart = split.withColumn("partition", F.when(F.col("row") == 5, "test").otherwise(F.col("partition")))
    assert of(apart, df)["n_split_groups"] == (1 if apart.where("row = 4").first()["partition"] != "test" else 0)
    empty = manifest.make_manifest(split.where("false"), "row", "grp", "partition")
    assert manifest.manifest_report(empty, df, "row", "label").first()["n_lacking_partitions"] == 4


def test_folds_are_whole_groups_of_like_labels(spark):
    df = spark.range(6000).select("id", (F.col("id") % 83).alias("g"), (F.xxhash64("id") % 10 < F.col("id") % 83 % 5).cast("int").alias("label"))
    folds = split.group_folds(df, "g", "label", 5, 7)
    assert folds.groupBy("g").agg(F.count_distinct("fold").alias("k")).where("k > 1").isEmpty() and folds.count() == 6000
    for r in folds.groupBy("fold").agg(F.count("*").alias("n"), F.avg("label").alias("share")).collect():
        assert abs(r["n"] / 6000 - 0.2) < 0.03 and abs(r["share"] - df.agg(F.avg("label")).first()[0]) < 0.03
    # A group with a third of all rows fills a fold, and the others stay even.
    hot = df.withColumn("g", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("g")))
    sizes = sorted(r["count"] for r in split.group_folds(hot, "g", "label", 3, 7).groupBy("fold").count().collect())
    assert sum(sizes) == 6000 and sizes[0] > 1700
    staged = split.staged_split(df, "g", "label", 7)
    split.check_split(staged, "g", "label")
    assert {r["partition"] for r in staged.select("partition").distinct().collect()} == {"train", "meta", "select", "test"}
    assert sorted(map(tuple, staged.select("id", "partition").collect())) == sorted(map(tuple, split.staged_split(df.repartition(7), "g", "label", 7).select("id", "partition").collect()))
    with pytest.raises(ValueError, match="cannot fill"):
        split.group_folds(df.where("g < 3"), "g", "label", 5)
    with pytest.raises(ValueError, match="no group"):
        split.group_folds(df.withColumn("g", F.when(F.col("id") > 5, F.col("g"))), "g", "label", 5)


def test_staged_split_reads_its_rows_once_more(spark):
    """Stages choose among counted groups: the rows are not read again for each stage's branch."""
    df = spark.range(4000).select("id", (F.col("id") % 97).alias("g"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    out = split.staged_split(df, "g", "label")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
    assert out.count() == 4000 and out.select("g", "partition").distinct().count() == 97
