"""Saved splits: a manifest of row, group and partition that is bound to the data by a hash, and its checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTITIONS = ["train", "meta", "select", "test"]


def data_hash(df: DataFrame) -> DataFrame:
    """One row with n_rows and a hash of all rows, whatever their order: row hashes of SHA-256 are summed in four parts."""
    whole = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]
    return df.select(whole.alias("h")).agg(F.count("*").alias("n_rows"), F.sha2(F.concat_ws(":", F.count("*").cast("string"), *parts), 256).alias("data_sha256"))


def make_manifest(df: DataFrame, row_id: str, group: str, partition: str) -> DataFrame:
    """row_id, group, partition and data_sha256 of each row."""
    digest = data_hash(df.drop(partition)).first()["data_sha256"]
    return df.select(F.col(row_id).alias("row_id"), F.col(group).alias("group"), F.col(partition).alias("partition"), F.lit(digest).alias("data_sha256"))


def manifest_report(manifest: DataFrame, df: DataFrame, row_id: str, label: str) -> DataFrame:
    """One row of counts that are all 0 for a sound manifest: rows of the data that it lacks, rows that it has beyond them,
    rows that it has twice, groups in several partitions, rows without a group, partitions without both labels, labels other
    than 0 and 1, wanted partitions that have no row and others that have, and whether the hash differs.

    Manifest and data meet once by row; rows of a row_id are counted before, groups after."""
    own = manifest.groupBy("row_id").agg(F.count("*").alias("n"), F.first("group").alias("group"), F.first("partition").alias("partition"), F.min("data_sha256").alias("lo"), F.max("data_sha256").alias("hi"))
    rows = df.select(F.col(row_id).alias("row_id"), F.col(label).alias("label"), F.lit(True).alias("in_data"))
    both = own.join(rows, "row_id", "full")
    known = F.coalesce(F.col("label").isin(0, 1), F.lit(False))
    rest = ["n_missing", "n_beyond", "n_repeated_rows", "n_no_group", "n_bad_labels"]
    each = both.groupBy("group", "partition").agg(
        F.count_if(F.col("n").isNull()).alias("n_missing"), F.count_if(F.col("in_data").isNull()).alias("n_beyond"), F.count_if(F.col("n") > 1).alias("n_repeated_rows"), F.count_if(F.col("n").isNotNull() & F.col("group").isNull()).alias("n_no_group"),
        F.count_if(F.col("in_data") & ~known).alias("n_bad_labels"), F.max((F.col("label") == 0).cast("int")).alias("has0"), F.max((F.col("label") == 1).cast("int")).alias("has1"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("n").alias("listed"))
    groups = each.groupBy("group").agg(F.count_distinct(F.when(F.col("listed") > 0, F.coalesce("partition", F.lit("")))).alias("k")).agg(F.count_if((F.col("k") > 1) & F.col("group").isNotNull()).alias("n_split_groups"))
    parts = each.groupBy("partition").agg(*[F.sum(c).alias(c) for c in rest], F.max("has0").alias("has0"), F.max("has1").alias("has1"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("listed").alias("listed"))
    met, listed = F.col("partition").isin(*PARTITIONS) & (F.col("listed") > 0), F.col("listed") > 0
    one = parts.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in rest], F.count_if(listed & ((F.coalesce("has0", F.lit(0)) == 0) | (F.coalesce("has1", F.lit(0)) == 0))).alias("n_one_label"),
        (F.lit(len(PARTITIONS)) - F.count_if(met)).cast("long").alias("n_lacking_partitions"), F.count_if(listed & ~F.coalesce(F.col("partition").isin(*PARTITIONS), F.lit(False))).alias("n_other_partitions"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    out = one.crossJoin(groups).crossJoin(data_hash(df).select("data_sha256"))  # a single row each
    same = (F.col("lo") == F.col("data_sha256")) & (F.col("hi") == F.col("data_sha256"))
    return out.withColumn("n_hash_differs", F.when(same, 0).otherwise(1)).drop("lo", "hi", "data_sha256")


def loaded(manifest: DataFrame, df: DataFrame, row_id: str, label: str) -> DataFrame:
    """df with the partition of each row; a manifest that is not sound for these data is an error."""
    wrong = {k: v for k, v in manifest_report(manifest, df, row_id, label).first().asDict().items() if v}
    if wrong:
        raise ValueError(f"the split manifest does not fit the data: {wrong}")
    return df.join(manifest.select(F.col("row_id").alias(row_id), "partition"), row_id)


def validation(split: DataFrame) -> DataFrame:
    """The rows that models are chosen by: meta and select together."""
    return split.where(F.col("partition").isin("meta", "select"))
