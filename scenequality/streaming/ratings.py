"""Incremental ratings: upsert, submit lock, progress, resumable and duplicate-free score logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from scenequality.operators.validate import rating_complete, rating_valid

KEYS = ["session_id", "diagram_id"]


# --- E2, V2 ---
def review_events(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """Rating events with ``reason``: null when accepted, else why the write is refused.

    ``sessions`` (static side): (session_id, assignment, submitted_at). Works on batch and stream.
    """
    known = sessions.select("session_id", "assignment", "submitted_at")
    rows = events.join(known, "session_id", "left")
    reason = (F.when(F.col("assignment").isNull(), F.lit("unknown session"))
              .when(F.coalesce(F.col("updated_at") > F.col("submitted_at"), F.lit(False)), F.lit("locked"))
              .when(~F.array_contains("assignment", F.col("diagram_id")), F.lit("not assigned"))
              .when(~rating_valid(F.col("scores"), F.col("comment"), F.col("duration_ms")), F.lit("invalid")))
    return rows.withColumn("reason", reason).drop("assignment", "submitted_at")


# --- E1 ---
def upsert_ratings(accepted: DataFrame) -> DataFrame:
    """Current rating per (session, drawing): latest write wins, active time never shrinks.

    One built-in aggregation: a batch plan combines map-side, a stream keeps one row of state per
    key (output mode ``update`` or ``complete``).
    """
    last = F.max(F.struct("updated_at", "event_id", "scores", "comment"))
    rows = accepted.groupBy(*KEYS).agg(last.alias("_l"), F.max("duration_ms").alias("duration_ms"))
    return rows.select(*KEYS, F.col("_l.scores").alias("scores"), F.col("_l.comment").alias("comment"), "duration_ms",
                       F.col("_l.updated_at").alias("updated_at"))


def ordered_writes(events: DataFrame) -> DataFrame:
    """Events with their scores as sorted entries (a map cannot be compared inside a max)."""
    return events.withColumn("scores", F.array_sort(F.map_entries("scores")))


def current_ratings(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """Accepted events folded to the current ratings, with completeness."""
    good = review_events(events, sessions).filter(F.col("reason").isNull())
    rows = upsert_ratings(ordered_writes(good)).withColumn("scores", F.map_from_entries("scores"))
    return rows.withColumn("complete", rating_complete(F.col("scores")))


def write_latest(rows: DataFrame, path: str, checkpoint: str):
    """Write each batch's changed rows under its batch number; a repeated batch overwrites itself."""

    def save(changed, batch):
        changed.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return rows.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(
        availableNow=True).foreachBatch(save).start()


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Last saved row of each key."""
    rows = spark.read.option("recursiveFileLookup", "true").parquet(path).dropna(subset=keys)
    others = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("_l"))
    return newest.select(*keys, *(F.col(f"_l.{c}").alias(c) for c in others))


def write_upserts(current: DataFrame, path: str, checkpoint: str):
    return write_latest(current, path, checkpoint)


def saved_ratings(spark: SparkSession, path: str) -> DataFrame:
    """Latest saved state per rating."""
    return latest(spark, path, KEYS)


# --- E3 ---
def submit(sessions: DataFrame, current: DataFrame, requests: DataFrame) -> DataFrame:
    """Sessions after submit requests: all assigned drawings must be complete; repeats change nothing.

    ``requests``: (session_id, requested_at). The earliest request counts.
    """
    asked = requests.groupBy("session_id").agg(F.min("requested_at").alias("_at"))
    slots = sessions.select("session_id", F.explode("assignment").alias("diagram_id"))
    open_ = slots.join(current.filter("complete"), KEYS, "left_anti").select("session_id").distinct().withColumn("_open", F.lit(True))
    rows = sessions.join(asked, "session_id", "left").join(open_, "session_id", "left")
    at = F.coalesce(F.col("submitted_at"), F.when(F.col("_open").isNull(), F.col("_at")))
    return rows.withColumn("submitted_at", at).drop("_at", "_open")


def progress(events: DataFrame) -> DataFrame:
    """Live counters per session over accepted events (stream output mode ``update``)."""
    return events.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("writes"), F.count_if(rating_complete(F.col("scores"))).alias("complete_writes"),
        F.max("updated_at").alias("last_write"))


# --- E4, E5 ---
def write_unique_scores(stream: DataFrame, path: str, checkpoint: str):
    """Append the earliest score per (id, dimension) that the log at ``path`` does not hold yet.

    Every batch is checked against the whole saved log, so a repeat is refused however late it comes. A
    repeated batch reads the log without itself and overwrites itself.
    """
    keys = ["id", "dimension"]

    def save(rows, batch):
        rest = [c for c in rows.columns if c not in keys]
        first = rows.groupBy(*keys).agg(F.min(F.struct("scored_at", *(c for c in rest if c != "scored_at"))).alias("_f"))
        fresh = first.select(*keys, *(F.col(f"_f.{c}").alias(c) for c in rest))
        if batch:
            log = rows.sparkSession.read.parquet(path).filter(F.col("batch") < batch)
            fresh = fresh.join(log.select(*keys), keys, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(
        availableNow=True).foreachBatch(save).start()


def score_resumably(jobs: DataFrame, path: str, checkpoint: str, score: Callable[[DataFrame], DataFrame], attempts: int = 3) -> None:
    """One start of a resumable scorer: failed items of earlier starts first, then what is new in the stream ``jobs``.

    ``jobs`` has a column ``id``; ``score`` adds ``score`` and ``error`` (null where it worked) to rows that carry their
    ``attempt``. The checkpoint remembers which jobs were taken, the log at ``path`` how each attempt ended, so a job
    that failed stays pending over any number of starts until it works or has had ``attempts`` tries.
    """
    spark = jobs.sparkSession
    failed = pending_scores(spark, path, attempts)
    if failed is not None:
        again = failed.withColumn("attempt", F.col("attempt") + 1).drop("score", "error")
        score(again).write.mode("append").parquet(path)

    def save(rows, batch):
        # a repeated batch leaves out what its first try wrote
        done = _scored(spark, path)
        fresh = rows.withColumn("attempt", F.lit(1))
        score(fresh if done is None else fresh.join(done.select("id"), "id", "left_anti")).write.mode("append").parquet(path)

    jobs.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start().awaitTermination()


def _scored(spark: SparkSession, path: str) -> DataFrame | None:
    """The log of attempts; None before the first."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def last_attempts(spark: SparkSession, path: str) -> DataFrame:
    """The last attempt of every scored job."""
    rows = spark.read.parquet(path)
    last = rows.groupBy("id").agg(F.max("attempt").alias("attempt"))
    return rows.join(last, ["id", "attempt"], "left_semi").dropDuplicates(["id"])


def pending_scores(spark: SparkSession, path: str, attempts: int = 3) -> DataFrame | None:
    """Jobs whose last attempt failed and that have tries left; None before the first start."""
    if _scored(spark, path) is None:
        return None
    return last_attempts(spark, path).filter(F.col("error").isNotNull() & (F.col("attempt") < attempts))
