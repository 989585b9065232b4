"""Bindings of the supplied tables to the library's inputs, as SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: One C-like function for each part; calls, sizes and variants follow from the key.
PSEUDO_C = """
SELECT p_partkey AS fn, concat('fn_', CAST(p_partkey AS STRING)) AS function,
  concat('void fn_', CAST(p_partkey AS STRING), '(char *param_1) {', chr(10),
    '  char local_a [', CAST(p_size AS STRING), '];', chr(10),
    CASE WHEN p_partkey % 5 = 0 THEN concat('  int local_1c [0x4];', chr(10)) ELSE '' END,
    CASE WHEN p_partkey % 7 = 0 THEN concat('  p = local_a;', chr(10)) ELSE '' END,
    CASE WHEN p_partkey % 11 = 0 THEN concat('  for (i = 0; i < 8; i++) local_a[i] = param_1[i];', chr(10)) ELSE '' END,
    CASE WHEN p_partkey % 4 = 0 THEN concat('  n = read(0, local_a, 0x20);', chr(10)) ELSE '' END,
    CASE WHEN p_partkey % 3 <> 0 THEN concat('  if (strlen(param_1) < ', CAST(p_size AS STRING), ') {', chr(10)) ELSE '' END,
    '    ', CASE p_partkey % 6
      WHEN 0 THEN 'strcpy(local_a, param_1)'
      WHEN 1 THEN concat('memcpy(local_a, param_1, ', CAST(p_size + p_partkey % 7 - 3 AS STRING), ')')
      WHEN 2 THEN concat('__strcpy_chk(local_a, param_1, (size_t)', CAST(p_size AS STRING), ')')
      WHEN 3 THEN 'snprintf(local_a, sizeof(local_a) - 1, "%s, %s", param_1, "x")'
      WHEN 4 THEN 'gets(local_a)'
      ELSE 'strncpy(local_a, "literal, text", 0x10)' END, ';', chr(10),
    CASE WHEN p_partkey % 3 <> 0 THEN concat('  }', chr(10)) ELSE '' END, '}', chr(10)) AS text
FROM part"""

#: Scores of four models from fixed arithmetic, with a label and a group.
SCORES = """
SELECT l_orderkey, l_linenumber, l_suppkey AS grp, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y,
  least(1.0, greatest(0.0, round(l_discount * 8 + (CASE WHEN l_returnflag = 'R' THEN 0.1 ELSE 0.0 END), 4))) AS p_rf,
  least(1.0, greatest(0.0, round(l_tax * 10, 4))) AS p_xgb,
  least(1.0, greatest(0.0, round(l_quantity / 50, 4))) AS p_dt,
  least(1.0, greatest(0.0, round((l_discount + l_tax) * 5, 4))) AS p_lr
FROM lineitem"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df in one part for each core at least: a small file is read by few tasks."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def bound(spark: SparkSession, sf_dir: str, sql: str, name: str) -> DataFrame:
    """The query over one table, without registering a view."""
    return spark.sql(sql.replace("{", "{{").replace("}", "}}").replace(f"FROM {name}", "FROM {t}"), t=table(spark, sf_dir, name))


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    # The table is a small file of narrow rows, from which long texts are made: it is dealt out before that.
    dealt = table(spark, sf_dir, "part").select("p_partkey", "p_size").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    sql = PSEUDO_C.replace("{", "{{").replace("}", "}}").replace("FROM part", "FROM {t}")
    return spark.sql(sql, t=dealt).withColumn("params", F.array(F.lit("param_1")))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(spark, sf_dir, SCORES, "lineitem")
