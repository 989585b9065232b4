"""What several text operators share: the shared folder, ranges of a key, and small batches for Python workers."""

from __future__ import annotations

import gc
import math
import re
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_HELD: dict[Any, Any] = {}
#: Bytes of an Arrow batch, about, as one text can be long.
BATCH_BYTES = 8 << 20


def held(key: Any, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps from task to task: one operator's tables at a time. Workers serve one operator after the
    other, so whatever the last one kept goes before the next one's is made."""
    if key not in _HELD:
        _HELD.clear()
        gc.collect()
        _HELD[key] = make()
    return _HELD[key]


def released() -> None:
    """Lets go what this Python worker kept for another operator; for operators that keep nothing themselves."""
    if _HELD:
        _HELD.clear()
        gc.collect()


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only where it is unset and Spark runs in one process, as in tests, a folder of
    our own; on a cluster a local folder would lose data, so that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="flintsieve-")
    return _OWN[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to the shared folder and read again: lost executors cannot lose them."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that written() made and nothing reads any more, and lets Spark drop the shuffles of what is done."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        gc.collect()
        spark._jvm.System.gc()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it no column of df."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n = "_" + n
        out.append(n)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Arrow batches of few rows and bytes, as texts can be long. Plans are run later, so the settings stay; lower ones of
    the caller's are kept. They change the speed and memory of a session only, never a result."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(name).lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def range_bounds(df: DataFrame, key: str, n: int) -> list[int]:
    """At most n - 1 cut points that deal the rows of df out evenly by an integer key."""
    if n < 2:
        return []
    points = [i / n for i in range(1, n)]
    row = df.agg(F.percentile_approx(key, points, 20000).alias("p")).first()
    return sorted(set(row["p"] or []))


def range_of(key: Column, bounds: list[int]) -> Column:
    """Index of the range that holds the key (ascending with it); null keys are in the first.

    Bounds are looked through in two steps, of about the square root of their number each."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    below = lambda cuts: F.size(F.filter(cuts, lambda b: b <= key))
    coarse, cuts = F.lit(bounds[::step]), F.lit(bounds)
    found = F.transform(F.array(below(coarse)), lambda k: F.when(k == 0, F.lit(0)).otherwise((k - 1) * step + below(F.slice(cuts, (k - 1) * step + 1, F.lit(step)))))
    return F.when(key.isNull(), F.lit(0)).otherwise(F.element_at(found, 1))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
