"""Splits by source group without leakage, their checks, and repeatable samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Share of rows of each partition in thousandths.
PARTS = {"train": 600, "meta": 100, "select": 100, "test": 200}
#: A group with more than 1 / WEIGHTY of the rows of a class is placed by itself; the rest are placed in so many hashed lots.
WEIGHTY = 10_000


def group_split(df: DataFrame, group: str, label: str, seed: int = 42, parts: dict[str, int] = PARTS) -> DataFrame:
    """df with `partition`: whole groups, so that rows and both classes have about the wanted shares.

    Groups are taken by size (ties by a seeded hash) and each goes to the partition that most lacks its rows. Groups too
    small to matter alone are first dealt into WEIGHTY lots by the hash, and a lot is placed like a group; so the driver
    sees at most 3 * WEIGHTY rows, however many groups there are. Fewer groups than partitions, and rows without a
    group, are errors; there is no split by row.
    """
    rows, total, lot = _units(_counted(df, group, label), group, seed, len(parts))
    names, shares = list(parts), list(parts.values())
    want = [[t * s / sum(shares) for t in total] for s in shares]
    have, chosen = [[0, 0] for _ in shares], []
    for r in sorted(rows, key=lambda r: (-(r["n0"] + r["n1"]), r["h"])):
        lack = [sum((w[c] - h[c]) / max(w[c], 1) * (r["n1"] if c else r["n0"]) for c in (0, 1)) for w, h in zip(want, have)]
        k = max(range(len(shares)), key=lambda i: (lack[i], -i))
        have[k][0] += r["n0"]
        have[k][1] += r["n1"]
        chosen.append((r, names[k]))
    return _assigned(df, group, chosen, lot, "partition")


def _counted(df: DataFrame, group: str, label: str) -> DataFrame:
    """Rows of both labels by group."""
    return df.groupBy(group).agg(F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1"))


def _units(each: DataFrame, group: str, seed: int, least: int) -> tuple[list, list[int], Column]:
    """What is placed as one: groups that weigh, and lots of those that do not, with their labels; both totals; the lot of a row."""
    mixed = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(group).cast("string")))
    lot = F.pmod(F.conv(F.left(mixed, F.lit(8)), 16, 10).cast("long"), F.lit(WEIGHTY))
    every = each.agg(F.count("*").alias("n"), F.count_if(F.col(group).isNull()).alias("none"), F.coalesce(F.sum("n0"), F.lit(0)).alias("n0"), F.coalesce(F.sum("n1"), F.lit(0)).alias("n1")).first()
    if every["n"] < least:
        raise ValueError(f"{every['n']} groups cannot fill {least} partitions")
    if every["none"]:
        raise ValueError("a row has no group")
    total = [every["n0"], every["n1"]]
    alone = (F.col("n0") * WEIGHTY > total[0]) | (F.col("n1") * WEIGHTY > total[1])
    large = each.where(alone).select(F.col(group).alias("g"), F.lit(None).cast("long").alias("lot"), mixed.alias("h"), "n0", "n1")
    lots = each.where(~alone).groupBy(lot.alias("lot")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    return large.unionByName(lots.withColumn("h", F.lpad(F.col("lot").cast("string"), 8, "0")), allowMissingColumns=True).collect(), total, lot


def _assigned(df: DataFrame, group: str, chosen: list[tuple], lot: Column, out: str) -> DataFrame:
    """df with what its group, or its group's lot, was given; at most 3 * WEIGHTY rows are broadcast."""
    spark, kind = df.sparkSession, "int" if chosen and isinstance(chosen[0][1], int) else "string"
    groups, of_lot = [(r["g"], k) for r, k in chosen if r["lot"] is None], [(r["lot"], k) for r, k in chosen if r["lot"] is not None]
    done = df.join(F.broadcast(spark.createDataFrame(groups, df.select(F.col(group).alias("_group"), F.lit(None).cast(kind).alias("_alone")).schema)), F.col(group) == F.col("_group"), "left")
    if not of_lot:
        return done.withColumn(out, F.col("_alone")).drop("_group", "_alone")
    done = done.join(F.broadcast(spark.createDataFrame(of_lot, f"_lot long, _gathered {kind}")), lot == F.col("_lot"), "left")
    return done.withColumn(out, F.coalesce("_alone", "_gathered")).drop("_group", "_alone", "_lot", "_gathered")


def group_folds(df: DataFrame, group: str, label: str, folds: int, seed: int = 42) -> DataFrame:
    """df with `fold` from 0: whole groups, placed one by one where the folds' shares of both labels spread least.

    Groups whose labels differ most in number come first, in an order shuffled by the seed; of folds that do equally well the
    one with fewer rows is taken. Fewer groups than folds, and rows without a group, are errors. Small groups are placed by
    lots, as in group_split."""
    chosen, lot = _folded(_counted(df, group, label), group, folds, seed)
    return _assigned(df, group, chosen, lot, "fold")


def _folded(each: DataFrame, group: str, folds: int, seed: int) -> tuple[list[tuple], Column]:
    """The fold of each unit of counted groups, and the lot of a row."""
    rows, total, lot = _units(each, group, seed, folds)
    have, chosen = [[0, 0] for _ in range(folds)], []
    spread = lambda xs: (sum((x - sum(xs) / len(xs)) ** 2 for x in xs) / len(xs)) ** 0.5
    for r in sorted(rows, key=lambda r: (-abs(r["n0"] - r["n1"]), r["h"])):
        own = (r["n0"], r["n1"])

        def cost(k: int) -> tuple[float, int]:
            shares = [[(h[c] + (own[c] if i == k else 0)) / max(1, total[c]) for i, h in enumerate(have)] for c in (0, 1)]  # noqa: B023
            return round(sum(map(spread, shares)), 12), sum(have[k])

        k = min(range(folds), key=cost)
        have[k] = [have[k][0] + own[0], have[k][1] + own[1]]
        chosen.append((r, k))
    return chosen, lot


def staged_split(df: DataFrame, group: str, label: str, seed: int = 42) -> DataFrame:
    """df with `partition` in three stages of whole groups: one fold of five is test, one of four of the rest is for choosing,
    and of that one of two is select and the other meta; what is left is train. Seeds of the stages: seed, + 1, + 77."""
    # Rows are counted by group once, and read once more for their places; stages choose among the counted groups.
    each, done, names = _counted(df, group, label).persist(), df, ["_first", "_second", "_third"]
    left = each
    for name, folds, of_stage, kept in zip(names, (5, 4, 2), (seed, seed + 1, seed + 77), ("_first <> 0", "_second = 0", None)):
        chosen, lot = _folded(left, group, folds, of_stage)
        done = _assigned(done, group, chosen, lot, name)
        left = _assigned(left, group, chosen, lot, name).where(kept).drop(name) if kept else left
    each.unpersist()
    place = F.when(F.col("_first") == 0, "test").when(F.col("_second") != 0, "train").when(F.col("_third") == 0, "select").otherwise("meta")
    return done.withColumn("partition", place).drop(*names)


def holdout(df: DataFrame, group: str | None, label: str, seed: int = 42) -> DataFrame:
    """df with `partition` fit or held, for choosing features: a fifth of the rows by whole groups; without a group column,
    or with fewer than five groups, a quarter of the rows by a seeded hash of the row within each label."""
    if group and df.where(F.col(group).isNotNull()).select(group).distinct().limit(5).count() == 5:
        return group_split(df, group, label, seed, {"fit": 800, "held": 200})
    mixed = F.pmod(F.xxhash64(F.lit(seed), *[F.col(c) for c in sorted(df.columns)]), F.lit(4))
    return df.withColumn("partition", F.when(mixed == 0, "held").otherwise("fit"))


def row_split(df: DataFrame, key: list[str], label: str, seed: int = 42, parts: dict[str, int] = PARTS) -> DataFrame:
    """df with `partition` by rows, for data without groups: a seeded hash of the key within each label, so that shares hold
    for both labels as far as their rows are many. Leaks between rows of one origin are not prevented; group_split does."""
    place = F.pmod(F.xxhash64(F.lit(seed), F.col(label).cast("string"), *[F.col(k) for k in key]), F.lit(sum(parts.values())))
    out, end = F, 0
    for name, share in parts.items():
        end += share
        out = out.when(place < end, name)
    return df.withColumn("partition", out)


def split_report(df: DataFrame, group: str, label: str) -> DataFrame:
    """For each partition: rows, groups, rows of both labels, and groups that another partition has too (should be 0)."""
    shared = df.groupBy(group).agg(F.count_distinct("partition").alias("k"))
    met = df.join(shared, group, "left")
    return met.groupBy("partition").agg(F.count("*").alias("n_rows"), F.count_distinct(group).alias("n_groups"), F.count_if(F.col(label) == 0).alias("n_safe"), F.count_if(F.col(label) == 1).alias("n_vulnerable"), F.count_if(F.col("k") > 1).alias("n_leaking"))


def check_split(df: DataFrame, group: str, label: str) -> None:
    """Raises ValueError for a missing group, a label other than 0 and 1, groups in two partitions, or a partition with one class."""
    bad = df.agg(F.count_if(F.col(group).isNull()).alias("g"), F.count_if(~F.coalesce(F.col(label).isin(0, 1), F.lit(False))).alias("y")).first()
    if bad["g"] or bad["y"]:
        raise ValueError("a row has no group" if bad["g"] else "labels must be 0 or 1")
    for r in split_report(df, group, label).collect():
        if r["n_leaking"]:
            raise ValueError("partitions overlap by group")
        if not r["n_safe"] or not r["n_vulnerable"]:
            raise ValueError(f"{r['partition']} has one class only")


def sample_by_label(df: DataFrame, label: str, key: list[str], most: int, seed: int = 1337) -> DataFrame:
    """At most so many rows of each label, in order of a seeded hash of the key."""
    mixed = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    return df.withColumn("h", mixed).withColumn("k", F.row_number().over(Window.partitionBy(label).orderBy("h", *key))).where(F.col("k") <= most).drop("h", "k")
