"""Readers for rubrics, settings, inventories, answers, scores, manifests, ratings and images."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from scenequality.functions.geometry import png_size
from scenequality.operators.answers import parse_inventories
from scenequality.schemas import BEAUTY, CORRECTNESS, SCORE_KEYS
from scenequality.session import cut_lineage

LEAF_HASHES = 64  # row hashes that one leaf of the version's hash tree joins, on average


def _stop(condition: Column, message: Column | str, value: Column) -> Column:
    """``value``, unless ``condition`` holds: then the job fails with ``message``."""
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(condition, F.raise_error(text).cast("string")).otherwise(value)


def _unique(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    """Fail when a key occurs twice (one partial aggregation, then a join on the repeats only)."""
    repeats = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    marked = df.join(repeats, keys, "left")
    text = F.concat(F.lit(f"duplicate {what}: "), F.concat_ws("/", *(F.col(k).cast("string") for k in keys)))
    return marked.withColumn(keys[0], _stop(F.col("_n").isNotNull(), text, F.col(keys[0]).cast("string"))).drop("_n").select(*df.columns)


def _file_key(pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), pattern, group)


# --- S1, S2, S3 ---
def read_rubric(spark: SparkSession, path: str) -> DataFrame:
    schema = "criteria array<struct<id:string,dimension:string,description:string,severity:string,deterministic_metric:string>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.inline("criteria"))
    rows = rows.select(F.col("id").alias("criterion_id"), "dimension", "description", "severity", F.col("deterministic_metric").alias("metric"))
    known = rows.withColumn("dimension", _stop(~F.col("dimension").isin(*CORRECTNESS), "unknown dimension in the rubric", F.col("dimension")))
    return _unique(known, ["criterion_id"], "criterion id")


def read_settings(spark: SparkSession, path: str) -> dict:
    """The evaluator settings: one small configuration document."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def read_issue_history(spark: SparkSession, path: str) -> DataFrame:
    schema = "issues array<struct<dimension:string,severity:string,count:double>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.inline("issues"))


# --- S4, S5 ---
def read_inventories(spark: SparkSession, path: str, key: str = r"([^/]+)\.json$") -> DataFrame:
    """Frozen expectation documents, one JSON file per drawing."""
    raw = spark.read.text(path, wholetext=True).select(_file_key(key).alias("diagram_id"), F.col("value").alias("inventory"))
    return parse_inventories(raw)


def read_inventory_lines(spark: SparkSession, path: str) -> DataFrame:
    """Expectation documents as JSON lines (diagram_id, inventory document), for very many drawings."""
    doc = F.col("_d")  # a line is parsed once, in a step of its own
    return parse_inventories(spark.read.text(path).select(F.parse_json("value").alias("_d")).select(
        F.try_variant_get(doc, "$.diagram_id", "string").alias("diagram_id"),
        F.to_json(F.variant_get(doc, "$.inventory", "variant")).alias("inventory")))


def read_judge_answers(spark: SparkSession, path: str) -> DataFrame:
    """Raw judge answers from JSON lines (diagram_id, judge, sample_no, answer document as text)."""
    doc = F.col("_d")  # a line is parsed once, in a step of its own
    get = lambda field, kind: F.try_variant_get(doc, f"$.{field}", kind)
    return spark.read.text(path).select(F.parse_json("value").alias("_d")).select(
        get("diagram_id", "string").alias("diagram_id"), get("judge", "string").alias("judge"),
        F.coalesce(get("sample_no", "int"), F.lit(0)).alias("sample_no"),
        F.to_json(F.variant_get(doc, "$.answer", "variant")).alias("answer"))


# --- S6 ---
def read_scores(spark: SparkSession, path: str, low: int, high: int, texts: tuple[str, ...] = ("reasoning",)) -> tuple[DataFrame, DataFrame]:
    """(valid, rejects) of JSON-lines scores: a real JSON integer in range, and non-blank texts."""
    return check_scores(spark.read.text(path), low, high, texts)


def check_scores(lines: DataFrame, low: int, high: int, texts: tuple[str, ...] = ("reasoning",)) -> tuple[DataFrame, DataFrame]:
    doc = F.try_parse_json("value")
    get = lambda field, kind: F.try_variant_get(F.col("_d"), f"$.{field}", kind)
    rows = lines.select("value", doc.alias("_d"))
    kind = F.schema_of_variant(F.try_variant_get(F.col("_d"), "$.score", "variant"))
    score = get("score", "bigint")
    problem = (F.when(F.col("_d").isNull(), F.lit("unreadable"))
               .when(~F.coalesce(kind == "BIGINT", F.lit(False)), F.lit("score is not an integer"))
               .when(~score.between(low, high), F.lit("score out of range")))
    for t in texts:
        problem = problem.when(F.trim(F.coalesce(get(t, "string"), F.lit(""))) == "", F.lit(f"blank {t}"))
    rows = rows.withColumn("problem", problem)
    valid = rows.filter(F.col("problem").isNull()).select(
        get("id", "string").alias("id"), get("version", "string").alias("version"), get("dimension", "string").alias("dimension"),
        score.cast("int").alias("score"), F.try_variant_get(F.col("_d"), "$.problems", "array<string>").alias("problems"),
        get("observation", "string").alias("observation"), get("reasoning", "string").alias("reasoning"))
    return valid, rows.filter(F.col("problem").isNotNull()).select(F.col("value").alias("line"), "problem")


def read_direct_scores(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return read_scores(spark, path, 1, 10, ())


def read_beauty_scores(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return read_scores(spark, path, 0, 100, ("observation", "reasoning"))


# --- S8 ---
def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest rows with their row number; the header is trimmed and case-folded.

    Missing required columns, a ragged row and an open quote stop the read, with the row number
    where there is one.
    """
    options = dict(header=False, multiLine=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False,
                   ignoreTrailingWhiteSpace=False, nullValue="\u0000", emptyValue="")
    quotes = spark.read.text(path, wholetext=True).select(F.length(F.regexp_replace("value", '[^"]', "")).alias("n")).first()
    if quotes is None or quotes.n % 2:
        raise ValueError("the manifest has an unterminated quoted field" if quotes else "the manifest is empty")
    first = spark.read.csv(path, **options).first()
    if first is None:
        raise ValueError("the manifest is empty")
    header = [str(name or "").replace("﻿", "").strip().lower() for name in first]
    for required in ("file", "difficulty"):
        if required not in header:
            raise ValueError(f'the manifest needs a "{required}" column')
    if not {"caption", "caption_file"} & set(header):
        raise ValueError('the manifest needs a "caption" or "caption_file" column')
    schema = T.StructType([T.StructField(n, T.StringType()) for n in header] + [T.StructField("_bad", T.StringType())])
    rows = spark.read.schema(schema).csv(path, columnNameOfCorruptRecord="_bad", mode="PERMISSIVE", **{**options, "header": True, "enforceSchema": True})
    blank = F.concat_ws("", *(F.trim(F.coalesce(F.col(n), F.lit(""))) for n in header)) == ""
    kept = rows.withColumn("_at", F.monotonically_increasing_id()).filter(~blank)
    # a manifest is one file read by one task: a window without keys is the file order
    from pyspark.sql import Window
    numbered = kept.withColumn("row", F.row_number().over(Window.orderBy("_at"))).drop("_at")
    text = F.concat(F.lit("manifest row "), F.col("row").cast("string"), F.lit(f" does not have {len(header)} columns"))
    return numbered.withColumn(header[0], _stop(F.col("_bad").isNotNull(), text, F.col(header[0]))).select("row", *header)


# --- S9 ---
def content_version(rows: DataFrame, ident: str) -> DataFrame:
    """``ident`` plus 12 hex digits over all rows, whatever their order.

    Row hashes are combined in a tree, so no task holds more than a small part of the catalog; repeated rows
    travel once, with their count.
    """
    row = rows.select(F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256).alias("h"))
    return combine_hashes(row, ident)


def combine_hashes(row: DataFrame, ident: str) -> DataFrame:
    """One version from row hashes ``h``, by a hash tree: a node is the digest of what follows its leading digits.

    The leaves are as deep as the count of different hashes asks for, so a node joins about ``LEAF_HASHES`` hashes, and
    16 nodes above, however large the catalog is.
    """
    level = cut_lineage(row.groupBy("h").agg(F.count(F.lit(1)).alias("n")).select("h", F.concat("h", F.lit(":"), F.col("n").cast("string")).alias("entry")))
    depth, reach = 0, LEAF_HASHES
    size = level.count()
    while reach < size:
        depth, reach = depth + 1, reach * 16
    for digits in range(depth, -1, -1):
        node = F.substring("h", 1, digits) if digits else F.lit("")
        digest = F.sha2(F.array_join(F.array_sort(F.collect_list("entry")), ","), 256)
        level = level.groupBy(node.alias("h")).agg(digest.alias("v")).select("h", F.concat("h", F.lit(":"), "v").alias("entry"))
    return level.select(F.concat(F.lit(f"{ident}-"), F.substring("entry", 2, 12)).alias("study_version"))


def read_catalog(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(diagrams, one-row study version) of a catalog document, or of many parts of one as JSON ``lines``."""
    schema = ("id string, diagrams array<struct<id:string,image:string,caption:string,difficulty:string,"
              "source:string,sha256:string,set:int,label:string,defects:string>>")
    doc = spark.read.schema(schema).json(path, multiLine=not lines)
    rows = doc.select(F.inline("diagrams"))
    name = doc.agg(F.min("id")).first()[0]
    return rows, content_version(rows, name)


# --- S10, S11, S12, S13 ---
def read_result_files(spark: SparkSession, path: str, name: str = r"([^/]+)/direct_([^_/]+)_([^_/.]+)\.json$",
                      dimensions: int = 5) -> DataFrame:
    """Scores from one JSON file per job, keyed by path; drawings without all dimensions are left out."""
    rows = spark.read.schema("score int, reasoning string").json(path, multiLine=True).select(
        _file_key(name, 1).alias("id"), _file_key(name, 2).alias("version"), _file_key(name, 3).alias("dimension"), "score", "reasoning")
    full = rows.filter("score is not null").groupBy("id", "version").agg(F.count_distinct("dimension").alias("_n")).filter(F.col("_n") == dimensions)
    return rows.join(full.drop("_n"), ["id", "version"], "left_semi")


def read_score_log(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("id string, version string, dimension string, score int, observation string, reasoning string").json(path)
    return _unique(rows, ["id", "dimension"], "saved score")


def read_human_ratings(spark: SparkSession, path: str, corrected: str | None = None, lines: bool = False) -> DataFrame:
    """Long human scores; corrected ratings replace the originals they cover. ``lines``: many documents as JSON lines."""
    scores = ",".join(f"{k}:double" for k in SCORE_KEYS)
    schema = (f"diagrams array<struct<id:string,image:string,caption:string,difficulty:string,label:string,rater:string,"
              f"defects:array<struct<defect:string,criterion:string>>,scores:struct<{scores}>>>")
    load = lambda p: spark.read.schema(schema).json(p, multiLine=not lines).select(F.inline("diagrams"))
    rows = load(path)
    if corrected is not None:
        newer = load(corrected)
        rows = rows.join(newer.select("id"), "id", "left_anti").unionByName(newer)
    wide = rows.select("id", "difficulty", "label", "rater", "defects", "scores.*")
    return wide.unpivot(["id", "difficulty", "label", "rater", "defects"], list(SCORE_KEYS), "dimension", "human").filter("human is not null")


def read_dataset_index(spark: SparkSession, path: str) -> DataFrame:
    schema = "id string, image string, label string, difficulty string, human_study_id string, source_id string, caption string"
    return spark.read.csv(path, header=True, schema=schema, multiLine=True, quote='"', escape='"', enforceSchema=False)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """(diagram_id, report JSON) as ``write_reports`` leaves them."""
    return spark.read.schema("diagram_id string, report string").json(path)


# --- S14 ---
def read_image_sizes(spark: SparkSession, path: str) -> DataFrame:
    """Width and height of PNG files from their header bytes; null for anything else."""
    size = png_size(F.col("content"))
    return spark.read.format("binaryFile").load(path).select("path", size["width"].alias("width"), size["height"].alias("height"))
