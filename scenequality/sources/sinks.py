"""Writers: study export, reports, score matrices, summaries and append-only score logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scenequality.schemas import CORRECTNESS


def guarded(df: DataFrame) -> DataFrame:
    """String cells that a spreadsheet could run get a leading apostrophe (K2, before quoting)."""
    text = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    cell = lambda c: F.when(F.col(c).rlike(r"^\s*[=+\-@]"), F.concat(F.lit("'"), F.col(c))).otherwise(F.col(c))
    return df.select(*(cell(c).alias(c) if c in text else F.col(c) for c in df.columns))


def write_export(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """K1: quoted CSV with formula guards; lines end in LF, as Spark's writer takes a single character."""
    guarded(rows).write.mode(mode).csv(path, header=True, quoteAll=True, escape='"', lineSep="\n", emptyValue="", nullValue="")


# --- K3, K5 ---
def weight_formula(weights: DataFrame) -> DataFrame:
    """One row: '0.200000*presence + ...' in the fixed dimension order (five rows at most)."""
    value = lambda d: F.coalesce(F.max(F.when(F.col("dimension") == d, F.col("weight"))), F.lit(0.0))
    parts = [F.format_string(f"%.6f*{d}", value(d)) for d in CORRECTNESS]
    return weights.agg(F.concat_ws(" + ", *parts).alias("formula"))


def report_documents(overall: DataFrame, dimensions: DataFrame, metrics: DataFrame, weights: DataFrame) -> DataFrame:
    """(diagram_id, report JSON). A report holds one drawing's rubric rows, so its lists are rubric-sized."""
    from scenequality.operators.running import _join_keys
    dims = dimensions.groupBy("diagram_id").agg(F.array_sort(F.collect_list(F.struct("dimension", "score"))).alias("dimensions"))
    rows = metrics.groupBy("diagram_id").agg(F.array_sort(F.collect_list(F.struct(
        "criterion_id", "judge", "expected_count", "detected_issues"))).alias("metrics"))
    joined = overall.select("diagram_id", "overall").join(dims, "diagram_id").join(rows, "diagram_id", "left")
    whole = _join_keys(joined, weight_formula(weights), [])
    return whole.select("diagram_id", F.to_json(F.struct(F.col("overall").alias("correctness"), "formula", "dimensions", "metrics")).alias("report"))


def write_reports(reports: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Report documents as JSON lines (diagram_id, report)."""
    reports.select(F.to_json(F.struct(F.col("diagram_id").cast("string").alias("diagram_id"), "report")).alias("value")).write.mode(mode).text(path)


def explode_reports(reports: DataFrame) -> DataFrame:
    """P4: metric rows back out of report documents."""
    schema = ("correctness double, formula string, dimensions array<struct<dimension:string,score:double>>, "
              "metrics array<struct<criterion_id:string,judge:string,expected_count:bigint,detected_issues:bigint>>")
    return reports.select("diagram_id", F.from_json("report", schema).alias("r")).select("diagram_id", F.inline("r.metrics"))


def summary_document(stats: DataFrame, by: list[str]) -> DataFrame:
    """One JSON line per group of a statistics table."""
    rest = [c for c in stats.columns if c not in by]
    return stats.select(F.to_json(F.struct(F.struct(*by).alias("group"), F.struct(*rest).alias("values"))).alias("value"))


# --- K4 ---
def score_matrix(scores: DataFrame, baseline: str, dimensions=CORRECTNESS) -> DataFrame:
    """Variant x dimension scores with their change against the baseline variant."""
    wide = scores.groupBy("variant").pivot("dimension", list(dimensions)).agg(
        F.when(F.count("score") > 1, F.raise_error(F.lit("a variant has two scores for a dimension")).cast("double"))
        .otherwise(F.max("score").cast("double")))
    base = wide.filter(F.col("variant") == baseline).select(*(F.col(d).alias(f"_{d}") for d in dimensions))
    from scenequality.operators.running import _join_keys
    both = _join_keys(wide, base, [])
    return both.select("variant", *dimensions, *((F.col(d) - F.col(f"_{d}")).alias(f"delta_{d}") for d in dimensions))


def write_score_matrix(matrix: DataFrame, path: str, mode: str = "errorifexists") -> None:
    matrix.write.mode(mode).csv(path, header=True)


# --- K6, E7 ---
def append_scores(scores: DataFrame, path: str) -> None:
    scores.write.mode("append").json(path)


def overwrite_kinds(rows: DataFrame, path: str) -> None:
    """Replace only the partitions (kinds) present in ``rows``."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kind").parquet(path)
