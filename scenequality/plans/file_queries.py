"""Queries that write files from the given tables with the library's writers and read them back with its readers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from scenequality.operators import judging as J, validate as V
from scenequality.plans.bindings import rating_events, view
from scenequality.plans.registry import query, r6, sql6
from scenequality.schemas import CORRECTNESS, SCORE_KEYS
from scenequality.session import checkpoint_folder
from scenequality.sources import readers as R, sinks as K


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_folder(spark)}/scenequality/files-{uuid.uuid4().hex}"


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "scored").select(
        F.col("id").cast("string").alias("id"), F.lit("v1").alias("version"), "dimension", F.col("judge").cast("int").alias("score"),
        F.concat(F.lit("seen "), "dimension").alias("observation"), F.lit("because").alias("reasoning"))


@query("score_log", ("scored",), "SELECT CAST(id AS VARCHAR) AS id, dimension, CAST(judge AS INTEGER) AS score, 'seen ' || dimension AS observation FROM scored")
def score_log(spark, sf):
    """A log of two appended parts, read back with its check against repeats."""
    rows, path = _scores(spark, sf), _folder(spark)
    early = F.col("dimension").isin("presence", "layout")
    K.append_scores(rows.filter(early), path)
    K.append_scores(rows.filter(~early), path)
    return R.read_score_log(spark, path).select("id", "dimension", "score", "observation")


_BAD = "CASE WHEN id % 11 = 0 THEN 'score is not an integer' WHEN id % 7 = 0 THEN 'score out of range' END"


@query("direct_score_lines", ("scored",), f"SELECT dimension, {_BAD} AS problem, count(*) AS lines, CAST(sum(CASE WHEN {_BAD} IS NULL THEN judge ELSE 0 END) AS BIGINT) AS total FROM scored GROUP BY ALL")
def direct_score_lines(spark, sf):
    """JSON lines of scores, some of them text or out of range: valid scores and rejects, counted by problem."""
    path = _folder(spark)
    number = F.col("id").cast("bigint")
    line = (F.when(number % 11 == 0, F.to_json(F.struct("id", "version", "dimension", F.col("score").cast("string").alias("score"))))
            .when(number % 7 == 0, F.to_json(F.struct("id", "version", "dimension", (F.col("score") + 10).alias("score"))))
            .otherwise(F.to_json(F.struct("id", "version", "dimension", "score"))))
    _scores(spark, sf).select(line.alias("value")).write.text(path)
    valid, rejects = R.read_direct_scores(spark, path)
    refused = rejects.select(F.get_json_object("line", "$.dimension").alias("dimension"), "problem", F.lit(0).alias("score"))
    rows = valid.select("dimension", F.lit(None).cast("string").alias("problem"), "score").unionByName(refused)
    return rows.groupBy("dimension", "problem").agg(F.count(F.lit(1)).alias("lines"), F.sum("score").alias("total"))


@query("score_matrix", ("variant_scores",), """
    , w AS (SELECT variant, """ + ", ".join(f"max(score) FILTER (dimension = '{d}') AS {d}" for d in CORRECTNESS) + """ FROM variant_scores GROUP BY ALL),
    b AS (SELECT * FROM w WHERE variant = (SELECT min(variant) FROM w))
    SELECT CASE WHEN w.variant = b.variant THEN 'baseline' ELSE CAST(w.variant AS VARCHAR) END AS variant, """ + ", ".join(
    f"{sql6(f'w.{d}', d)}, {sql6(f'w.{d} - b.{d}', f'delta_{d}')}" for d in CORRECTNESS) + " FROM w, b")
def score_matrix(spark, sf):
    """Variant by dimension with the change against the baseline, written as CSV and read back."""
    rows, path = view(spark, sf, "variant_scores"), _folder(spark)
    first = rows.agg(F.min("variant")).scalar()
    named = rows.withColumn("variant", F.when(F.col("variant") == first, F.lit("baseline")).otherwise(F.col("variant").cast("string")))
    K.write_score_matrix(K.score_matrix(named, "baseline"), path)
    names = [*CORRECTNESS, *(f"delta_{d}" for d in CORRECTNESS)]
    found = spark.read.csv(path, header=True, schema=", ".join(["variant string", *(f"{n} double" for n in names)]))
    return found.select("variant", *(r6(F.col(n), n) for n in names))


@query("regenerated_kinds", ("variant_scores",), f"""
    SELECT kind, count(*) AS n, {sql6("sum(CASE WHEN kind = 'click' THEN score + 1 ELSE score END)", 'total')} FROM variant_scores GROUP BY ALL""")
def regenerated_kinds(spark, sf):
    """One kind made anew replaces its own files only, and the rows of a table only."""
    rows, path = view(spark, sf, "variant_scores").select("variant", "dimension", "score", "kind"), _folder(spark)
    K.overwrite_kinds(rows, path)
    again = rows.filter("kind = 'click'").withColumn("score", F.col("score") + 1)
    K.overwrite_kinds(again, path)
    stored = spark.read.parquet(path).select(*rows.columns)
    whole = J.replace_kinds(rows, stored, ["click"])
    return whole.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("score"), "total"))


@query("guarded_cache", (), """
    SELECT diagram_id, CASE WHEN stale THEN 'rejected' ELSE 'reused' END AS outcome
    FROM (SELECT doc_id AS diagram_id, doc_id % 5 = 0 OR doc_id % 7 = 0 AS stale FROM documents)""")
def guarded_cache(spark, sf):
    """Cached results are reused only under the same protocol and the same input."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    now = docs.select(F.col("doc_id").alias("diagram_id"), F.sha2(F.lit("protocol 2"), 256).alias("protocol_sha"), F.sha2("text", 256).alias("input_sha"))
    old = now.withColumn("protocol_sha", F.when(F.col("diagram_id") % 5 == 0, F.sha2(F.lit("protocol 1"), 256)).otherwise(F.col("protocol_sha")))
    old = old.withColumn("input_sha", F.when(F.col("diagram_id") % 7 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.col("input_sha")))
    reused, rejected = J.guard_protocol(old, now)
    name = lambda rows, outcome: rows.select("diagram_id", F.lit(outcome).alias("outcome"))
    return name(reused, "reused").unionByName(name(rejected, "rejected"))


@query("approval_open", ("writes",), """
    SELECT DISTINCT diagram_id AS id FROM writes WHERE diagram_id NOT IN (SELECT diagram_id FROM writes WHERE NOT too_high AND NOT unfinished AND event_id % 3 = 0)""")
def approval_open(spark, sf):
    """Drawings that no reviewer has given all thirteen scores; every third write is a review."""
    writes = view(spark, sf, "writes")
    reviews = rating_events(writes.filter("event_id % 3 = 0")).select(F.col("diagram_id").alias("id"), "scores")
    return V.approval_open(writes.select(F.col("diagram_id").alias("id")).distinct(), reviews, SCORE_KEYS)


@query("dataset_index", (), """
    SELECT CAST(doc_id AS VARCHAR) AS id, 'i' || CAST(doc_id AS VARCHAR) || '.png' AS image, lang AS difficulty, 'a "quoted" one, ' || source AS label, text AS caption FROM documents""")
def dataset_index(spark, sf):
    """An index as quoted CSV with line breaks and quotes in its cells, read back."""
    docs, path = spark.read.parquet(f"{sf}/documents.parquet"), _folder(spark)
    rows = docs.select(
        F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("i"), F.col("doc_id").cast("string"), F.lit(".png")).alias("image"),
        F.concat(F.lit('a "quoted" one, '), "source").alias("label"), F.col("lang").alias("difficulty"), F.lit("h").alias("human_study_id"),
        F.lit("s").alias("source_id"), F.col("text").alias("caption"))
    rows.write.csv(path, header=True, quoteAll=True, escape='"')
    return R.read_dataset_index(spark, path).select("id", "image", "difficulty", "label", "caption")
