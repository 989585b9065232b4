"""Queries from program documents to feature rows, on aliases, the stack and votes, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flintsieve.functions import text as T
from flintsieve.operators import context, ensemble, features, program, select, split
from flintsieve.plans import adapters
from flintsieve.plans.adapters import bound, table
from flintsieve.sources import readers

#: A document with two functions for each part; members come and go with the key.
DOCUMENTS = """
SELECT concat('p', CAST(p_partkey AS STRING), '.json') AS json_file, concat('{"program": {"program_name": "prog ', CAST(p_partkey % 3 AS STRING), '"}, "functions": [',
  '{"name": "a", "entry": "', CAST(p_partkey AS STRING), '", "note": "text", "features": {"n_lines": ', CAST(p_size AS STRING), ', "ok": ', CASE WHEN p_partkey % 2 = 0 THEN 'true' ELSE 'false' END, '},',
  '"pcode_counts": {"COPY": ', CAST(p_partkey % 4 AS STRING), CASE WHEN p_partkey % 5 = 0 THEN ', "INT_ADD": 2' ELSE '' END, '}, "mixed": ', CASE WHEN p_partkey % 2 = 0 THEN '"x"' ELSE '3' END,
  ', "offsets": [', CAST(p_size AS STRING), ', -8], "empty": [], "sinks": [{"api": "gets", "risk": {"score": ', CAST(p_partkey % 7 AS STRING), '}, "args": [1, 2]}, {"api": "x"}]},',
  '{"name": "b", "entry": "0", "features": {"n_lines": 1}}]}') AS value FROM part
"""
INSTRUCTIONS = """
SELECT l_orderkey, CASE l_linenumber % 4 WHEN 0 THEN 'MOV' WHEN 1 THEN 'lea' WHEN 2 THEN 'REP.MOVSB' ELSE 'cmp' END AS mnemonic,
  CASE l_suppkey % 4 WHEN 0 THEN 'RAX,[RBP + -0x20]' WHEN 1 THEN 'Stack_10,RDX' WHEN 2 THEN 'EAX,0x10' END AS operands FROM lineitem
"""


def program_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    # As in adapters.functions: long texts are made of a small file's narrow rows, which are dealt out before that. The
    # order is fixed, as unnest numbers rows by their place.
    dealt = table(spark, sf_dir, "part").select("p_partkey", "p_size").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey").sortWithinPartitions("p_partkey")
    texts = spark.sql(DOCUMENTS.replace("{", "{{").replace("}", "}}").replace("FROM part", "FROM {t}"), t=dealt)
    programs = readers.with_ids(readers.parse_programs(texts))
    return features.program_features(programs, ["json_file", "program_name", "function", "entry"])


def stack_accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return program.stack_accesses(bound(spark, sf_dir, INSTRUCTIONS, "lineitem"), ["l_orderkey"])


def alias_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = adapters.functions(spark, sf_dir)
    return df.select("fn", context.alias_summary(context.aliases(T.lines(F.col("text")), T.buffers(F.col("text")))).alias("x")).select("fn", "x.*")


def group_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    audit = table(spark, sf_dir, "part").select(F.col("p_brand").alias("group"), (F.col("p_partkey") % 97).cast("double").alias("score"), F.col("p_size").cast("double").alias("class_separation"), (F.col("p_partkey") % 5 / 4).alias("nonzero_ratio"))
    out = select.composition(audit)
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in out.dtypes])


def selector_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the split keeps its promises; which group falls where is not for SQL."""
    df = table(spark, sf_dir, "lineitem").select("l_suppkey", F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"))
    parts = split.holdout(df, "l_suppkey", "label")
    each = parts.groupBy("l_suppkey").agg(F.count_distinct("partition").alias("k"))
    shares = parts.agg(F.count("*").alias("n_rows"), (F.count_if(F.col("partition") == "held") / F.count("*")).alias("held"))
    return shares.crossJoin(each.agg(F.count("*").alias("n_groups"), F.count_if(F.col("k") > 1).alias("n_split"))).select("n_rows", "n_groups", "n_split", F.col("held").between(0.15, 0.25).alias("about_a_fifth"))


def best_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The votes of two models; larger grids are the operator's own, and too large for SQL."""
    pairs = {k: v for k, v in ensemble.VOTES.items() if len(v) == 2}
    best = ensemble.best_votes(adapters.scores(spark, sf_dir), pairs)
    return best.select("recipe", F.round(F.element_at(F.map_values("weights"), 1), 9).alias("w_first"), F.round("threshold", 9).alias("threshold"), "tp", "fp", "fn", "tn", F.round("f1", 9).alias("f1"))


QUERIES = {f.__name__: f for f in (program_features, stack_accesses, alias_summary, group_composition, selector_holdout, best_votes)}

_ZERO = "0.0::DOUBLE"
_STATS = ["count", "sum", "mean", "max", "min"]


def _listed(name: str, values: list[str]) -> str:
    return ", ".join(f"CASE WHEN a THEN ({v})::DOUBLE ELSE {_ZERO} END AS {name}_{k}" for k, v in zip(_STATS, values))


def _vote(name: str, a: str, b: str) -> str:
    from flintsieve.plans import score_queries as S

    return f"(SELECT '{name}' AS recipe, * FROM (" + S.SQL["weighted_vote_best"].replace("w_rf", f"w_{a}").replace("w_dt", f"w_{b}").replace("* p_rf", f"* p_{a}").replace("* p_dt", f"* p_{b}") + f"))", f"w_{a}"


def _votes() -> str:
    parts = [_vote(k, *v) for k, v in ensemble.VOTES.items() if len(v) == 2]
    return " UNION ALL ".join(f"SELECT recipe, round({w}, 9) AS w_first, threshold, tp, fp, fn, tn, f1 FROM {q}" for q, w in parts)


SQL = {
    "program_features": f"""WITH d AS (SELECT *, unnest([true, false]) AS a FROM part)
SELECT 'p' || p_partkey || '.json' AS json_file, 'prog ' || p_partkey % 3 AS program_name, CASE WHEN a THEN 'a' ELSE 'b' END AS function, CASE WHEN a THEN p_partkey ELSE 0 END::VARCHAR AS entry,
  CASE WHEN a THEN p_size ELSE 1 END::DOUBLE AS n_lines, CASE WHEN a AND p_partkey % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS ok, CASE WHEN a THEN p_partkey % 4 ELSE 0 END::DOUBLE AS "pcode_COPY",
  CASE WHEN a AND p_partkey % 5 = 0 THEN 2 ELSE 0 END::DOUBLE AS "pcode_INT_ADD", CASE WHEN a AND p_partkey % 2 = 1 THEN 3 ELSE 0 END::DOUBLE AS mixed, {_ZERO} AS empty_count,
  {_listed("offsets", ["2", "p_size - 8", "(p_size - 8) / 2", "greatest(p_size, -8)", "least(p_size, -8)"])},
  CASE WHEN a THEN 2 ELSE 0 END::DOUBLE AS sinks_count, CASE WHEN a THEN 2 ELSE 0 END::DOUBLE AS sinks_dict_count, {_listed("sinks_risk_score", ["1", *["p_partkey % 7"] * 4])},
  {", ".join(_listed(f"sinks_args_{k}", ["1", *[v] * 4]) for k, v in zip(_STATS, ["2", "3", "1.5", "2", "1"]))} FROM d""",
    "stack_accesses": f"""WITH i AS ({INSTRUCTIONS}), s AS (SELECT l_orderkey, lower(mnemonic) AS m, coalesce(regexp_matches(lower(operands), 'rbp|stack_'), false) AS st FROM i)
SELECT l_orderkey, count(*) FILTER (st) AS stack_mem_access_count, count(*) FILTER (st AND (starts_with(m, 'mov') OR starts_with(m, 'rep'))) AS stack_write_like_count FROM s GROUP BY 1""",
    "alias_summary": """SELECT p_partkey AS fn, CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END::BIGINT AS v6_alias_count, CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END::BIGINT AS v6_stack_buffer_alias_count,
  CASE WHEN p_partkey % 7 = 0 THEN p_size ELSE 0 END::BIGINT AS v6_alias_target_size_max FROM part""",
    "group_composition": """SELECT p_brand AS "group", count(*) AS feature_count, round(avg((p_partkey % 97)::DOUBLE), 6) AS mean_score, max(p_partkey % 97)::DOUBLE AS max_score, round(avg(p_size::DOUBLE), 6) AS mean_separation,
  round(avg(p_partkey % 5 / 4.0::DOUBLE), 6) AS mean_nonzero FROM part GROUP BY 1""",
    "selector_holdout": "SELECT count(*) AS n_rows, count(DISTINCT l_suppkey) AS n_groups, 0::BIGINT AS n_split, true AS about_a_fifth FROM lineitem",
    "best_votes": _votes(),
}
