"""Readers and writers: program documents as JSON, feature tables as CSV, feature lists, binaries, models."""

from __future__ import annotations

import json
import os
import re

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flintsieve.functions.names import safe_name
from flintsieve.operators.vectorize import first_present

# Members that hold the functions of a document, and names of feature lists in a JSON object.
FUNCTION_KEYS = ["functions", "function_features", "funcs"]
LIST_KEYS = ["feature_columns", "features", "feature_names", "columns"]


def read_programs(spark: SparkSession, paths: str | list[str], skip_info: bool = False) -> DataFrame:
    """json_file and each function (variant) of JSON documents below the paths; unreadable documents are left out.

    The root may be a list of functions, an object with one of FUNCTION_KEYS, or one function. Files are read whole by
    Spark, recursively, from any store. No function at all is an error.
    """
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(paths, wholetext=True)
    df = df.select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("json_file"), "value")
    if skip_info:
        df = df.where(~F.col("json_file").endswith(".info.json"))
    out = parse_programs(df)
    if out.isEmpty():
        raise ValueError(f"no function in {paths}")
    return out


def parse_programs(texts: DataFrame) -> DataFrame:
    """json_file, the document v and each of its functions f (variants) of (json_file, value); a projection without a shuffle."""
    df = texts.select("json_file", F.try_parse_json("value").alias("v")).where("v IS NOT NULL")
    listed = [F.try_variant_get("v", "$", "array<variant>"), *[F.try_variant_get("v", f"$.{k}", "array<variant>") for k in FUNCTION_KEYS]]
    return df.select("json_file", "v", F.explode(F.coalesce(*listed, F.array("v"))).alias("f")).where(F.schema_of_variant("f").startswith("OBJECT"))


def unreadable(texts: DataFrame) -> DataFrame:
    """json_file of the documents (json_file, value) that parse_programs leaves out as no JSON."""
    return texts.where(F.try_parse_json("value").isNull()).select("json_file")


def with_ids(programs: DataFrame) -> DataFrame:
    """Id columns of each function: names fall back to others, and empty ones count as missing."""
    get = lambda c, *keys: [F.try_variant_get(c, f"$.{k}", "string") for k in keys]
    stem = F.regexp_replace("json_file", r"\.json$", "")
    return programs.select(
        safe_name(first_present(*get("f", "binary"), *get("v", "program.program_name", "binary"), stem)).alias("binary"), first_present(*get("v", "program.program_name"), stem).alias("program_name"), "json_file",
        first_present(*get("f", "name", "function", "function_name")).alias("function"), first_present(*get("f", "entry", "address", "entry_point")).alias("entry"), first_present(*get("v", "schema")).alias("schema"), "f",
    )


def read_table(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """A CSV table with a header, all columns as text: numbers are made where they are needed, so that no scan infers types."""
    return spark.read.option("header", True).option("inferSchema", False).csv(paths)


def write_table(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """A JSON object a line, null members included."""
    df.write.option("ignoreNullFields", False).json(path)


def write_report(sections: dict[str, DataFrame], path: str) -> None:
    """A text report: the title of each section, then its rows as comma-separated text below a line of column names.

    For tables of a bounded size (features, groups): rows come in the order of their frame, so one task writes each."""
    whole = None
    for i, (title, df) in enumerate(sections.items()):
        head = df.sparkSession.createDataFrame([(i, -2, f"== {title}"), (i, -1, ", ".join(df.columns))], "part int, row long, value string")
        values = [F.when(F.col(c).isNull(), "").otherwise(F.format_string("%.6f", c) if t in ("double", "float") else F.col(c).cast("string")) for c, t in df.dtypes]
        rows = df.coalesce(1).select(F.lit(i).alias("part"), F.monotonically_increasing_id().alias("row"), F.concat_ws(", ", *values).alias("value"))
        whole = head.unionByName(rows) if whole is None else whole.unionByName(head).unionByName(rows)
    whole.coalesce(1).sortWithinPartitions("part", "row").select("value").write.text(path)


def read_feature_list(spark: SparkSession, path: str) -> list[str]:
    """Names of features in order: a JSON list, a JSON object with one of LIST_KEYS, text lines with # comments, or CSV
    (one column of names, else the header)."""
    body = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())  # a list of column names
    if path.endswith(".json"):
        data = json.loads(body)
        if isinstance(data, dict):
            data = next((data[k] for k in LIST_KEYS if isinstance(data.get(k), list)), None)
        if not isinstance(data, list):
            raise ValueError(f"no feature list in {path}")
        return [str(x) for x in data]
    lines = [x.strip() for x in body.splitlines()]
    if path.endswith(".csv") and lines and "," in lines[0]:
        return [x.strip() for x in lines[0].split(",")]
    names = [x.split("#")[0].strip() for x in lines]
    return [x for x in (names[1:] if path.endswith(".csv") and names and names[0] in ("feature", "features", "name") else names) if x]


def is_elf(content: Column) -> Column:
    return F.substring(content, 1, 4) == F.lit(b"\x7fELF")


def read_binaries(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, length, the first twelve digits of SHA-256, and whether a file is an ELF."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).select("path", "length", F.left(F.sha2("content", 256), F.lit(12)).alias("sha"), is_elf(F.col("content")).alias("is_elf"))


def load_models(folder: str, names: list[str]) -> tuple[dict[str, PipelineModel], dict[str, str]]:
    """Models that load, and the errors of those that do not; none at all is an error, and so is a file that is not as it was
    saved, where the folder has digests."""
    try:
        check_manifest(SparkSession.active(), folder)
    except AnalysisException:
        pass  # saved without digests
    models, errors = {}, {}
    for n in names:
        try:
            models[n] = PipelineModel.load(os.path.join(folder, n))
        except Exception as e:
            errors[n] = str(e)[:200]
    if not models:
        raise ValueError(f"no model in {folder}: {errors}")
    return models, errors


def save_models(models: dict[str, PipelineModel], folder: str, features: list[str]) -> None:
    """Each model in a folder of its name, the features in their order beside them, and digests of all files."""
    for name, model in models.items():
        model.write().overwrite().save(os.path.join(folder, name))
    spark = SparkSession.active()
    spark.createDataFrame([(json.dumps({"feature_columns": features}),)], "value string").coalesce(1).write.mode("overwrite").text(os.path.join(folder, "feature_columns.json"))
    write_manifest(spark, folder)


def _listing(spark: SparkSession, folder: str) -> DataFrame:
    """Files below a folder in any store that Spark reads; contents are read only where a query uses them."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)


def discover(spark: SparkSession, folder: str, patterns: list[str], parts: list[str], beside: str | None = None) -> DataFrame:
    """(path, place) of the files below a folder whose path, or of the folders of a file named `beside` whose path, matches one
    of the patterns (regular expressions on what follows the folder). The first place is the one to take: paths with the
    earliest of the parts in them come first, then shorter ones. No file's content is read. None is an empty table."""
    files = _listing(spark, folder).select("path", "length")
    if beside is not None:
        files = files.where(F.element_at(F.split("path", "/"), -1) == beside).select(F.regexp_replace("path", "/[^/]*$", "").alias("path"))
    root = folder.rstrip("/").split(":", 1)[-1].lstrip("/")
    own = F.element_at(F.split("path", f"/{re.escape(root)}/", 2), -1)
    first = F.coalesce(*[F.when(F.contains("path", F.lit(t)), F.lit(k)) for k, t in enumerate(parts)], F.lit(len(parts)))
    found = files.where(F.exists(F.array(*map(F.lit, patterns)), lambda p: F.regexp_like(own, p))).select("path", first.alias("first"), F.length("path").alias("size")).distinct()
    # Files that match are few; their order is a list to choose from.
    order = Window.orderBy("first", "size", "path")
    return found.withColumn("place", F.row_number().over(order)).select("path", "place").orderBy("place")


MANIFEST = "MANIFEST.sha256"


def folder_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(file, length, sha256) of all files below a folder, names from the folder on; files of over 2 GB cannot be read."""
    root = folder.rstrip("/").split(":", 1)[-1].lstrip("/")
    own = F.element_at(F.split("path", f"/{re.escape(root)}/", 2), -1)
    kept = _listing(spark, folder).withColumn("file", own).where(~F.contains("file", F.lit(MANIFEST)))
    return kept.select("file", "length", F.sha2("content", 256).alias("sha256"))


def write_manifest(spark: SparkSession, folder: str) -> None:
    """Writes the digests of a saved folder beside its files."""
    folder_digests(spark, folder).coalesce(1).write.mode("overwrite").json(f"{folder}/{MANIFEST}")


def check_manifest(spark: SparkSession, folder: str) -> None:
    """Raises ValueError if any file below the folder is changed, lost or new since write_manifest."""
    saved = spark.read.schema("file string, length long, sha256 string").json(f"{folder}/{MANIFEST}")
    both = saved.join(folder_digests(spark, folder).toDF("file", "now", "digest"), "file", "full")
    odd = [r["file"] for r in both.where("NOT (sha256 <=> digest AND length <=> now)").select("file").orderBy("file").limit(5).collect()]
    if odd:
        raise ValueError(f"not as they were saved: {', '.join(odd)}")


def model_features(model: object) -> list[str] | None:
    """The features that a model was fitted on: those of its first assembler, however deep pipelines are nested."""
    for stage in getattr(model, "stages", []):
        if isinstance(stage, VectorAssembler):
            return list(stage.getInputCols())
        if found := model_features(stage):
            return found
    return None


def infer_features(spark: SparkSession, files: list[str], models: dict[str, PipelineModel]) -> list[str]:
    """The first feature list that can be read and is not empty, else the features of the first model that knows them."""
    for path in files:
        try:
            if found := read_feature_list(spark, path):
                return found
        except (ValueError, AnalysisException):
            continue
    for model in models.values():
        if found := model_features(model):
            return found
    raise ValueError("no list of features, and no model that names its own")
