"""Ablation and isolation analytics: drops against a baseline, leaks, and noise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scenequality.functions.geometry import half_even
from scenequality.schemas import CORRECTNESS, MIN_CHANGED_PIXELS, MIN_SENSITIVITY


# --- T14 (with J20) ---
def drops(baseline: DataFrame, variants: DataFrame, decimals: int = 1) -> DataFrame:
    """Baseline mean minus variant, in points, per (variant, dimension).

    ``baseline``: (id, run, dimension, score in 0-1); ``variants``: (id, kind, variant, target,
    changed_px, dimension, score). Baseline runs collapse map-side before the join.
    """
    means = baseline.groupBy("id", "dimension").agg(F.avg("score").alias("_base"))
    return variants.join(means, ["id", "dimension"]).withColumn(
        "drop", half_even(100 * F.col("_base") - 100 * F.col("score"), decimals)).drop("_base", "score")


# --- V8 ---
def fixture_status(target: Column, changed: Column) -> Column:
    """'control', 'invalid' (an error that changed too few pixels) or 'error'; -1 means resized and valid."""
    return (F.when(target.isNull(), F.lit("control"))
            .when((changed >= 0) & (changed < MIN_CHANGED_PIXELS), F.lit("invalid")).otherwise(F.lit("error")))


# --- T15 ---
def isolation_rows(dropped: DataFrame, keys: list[str] = ("id", "kind", "variant"),
                   min_sensitivity: float = MIN_SENSITIVITY) -> DataFrame:
    """Sensitivity, worst leak, specificity and isolation per variant."""
    own = F.col("dimension") == F.col("target")
    positive = F.greatest(F.lit(0.0), F.col("drop"))
    per = dropped.groupBy(*keys).agg(
        F.max("target").alias("target"), F.max("changed_px").alias("changed_px"),
        F.coalesce(F.max(F.when(own, positive)), F.lit(0.0)).alias("sensitivity"),
        F.coalesce(F.max(F.when(~own, positive)), F.lit(0.0)).alias("_leak"),
        F.coalesce(F.sum(F.when(~own, positive)), F.lit(0.0)).alias("_leaks"),
        F.max("drop").alias("_top"))
    status = fixture_status(F.col("target"), F.col("changed_px"))
    error = status == "error"
    total = F.col("sensitivity") + F.col("_leaks")
    specificity = F.when(total > 0, 100 * F.col("sensitivity") / total).otherwise(F.lit(0.0))
    isolation = specificity * F.least(F.lit(1.0), F.col("sensitivity") / min_sensitivity)
    return per.select(
        *keys, F.when(status == "invalid", F.lit("invalid")).otherwise(F.coalesce("target", F.lit(""))).alias("target"),
        F.when(error, half_even(F.col("sensitivity"), 1)).alias("sensitivity"),
        F.when(error, half_even(F.col("_leak"), 1)).when(status == "control", half_even(F.col("_top"), 1)).alias("worst_leak"),
        F.when(error, half_even(specificity, 1)).alias("specificity"),
        F.when(error, half_even(isolation, 1)).alias("isolation"), "changed_px")


# --- T16 ---
def isolation_matrix(dropped: DataFrame, by: str = "target", dimensions=CORRECTNESS) -> DataFrame:
    """Mean drop per dimension for each target (or kind) of the valid error variants."""
    valid = dropped.filter(fixture_status(F.col("target"), F.col("changed_px")) == "error")
    return valid.groupBy(by).pivot("dimension", list(dimensions)).agg(half_even(F.avg("drop"), 1))


def isolation_summary(dropped: DataFrame, keys: list[str] = ("id", "kind", "variant"),
                      min_sensitivity: float = MIN_SENSITIVITY, by: list[str] = ()) -> DataFrame:
    """Isolation, caught share, off-target movement and variants missed by every dimension."""
    valid = dropped.filter(fixture_status(F.col("target"), F.col("changed_px")) == "error")
    off = F.col("dimension") != F.col("target")
    off_target = valid.groupBy(*by).agg(half_even(F.avg(F.when(off, F.abs("drop"))), 1).alias("off_target_mean_abs"))
    per = valid.groupBy(*keys, *[b for b in by if b not in keys]).agg(F.max("drop").alias("_top"))
    rows = isolation_rows(valid, keys).select(*keys, "isolation", "sensitivity")
    scored = per.join(rows, list(keys)).groupBy(*by).agg(
        F.count(F.lit(1)).alias("variants"), half_even(F.avg("isolation"), 1).alias("isolation"),
        half_even(100 * F.count_if(F.col("sensitivity") >= min_sensitivity) / F.count(F.lit(1)), 0).alias("caught_pct"),
        F.count_if(F.col("_top") < min_sensitivity).alias("missed"))
    if by:
        return scored.join(off_target, list(by))
    from scenequality.operators.running import _join_keys
    return _join_keys(scored, off_target, [])


def control_drops(dropped: DataFrame) -> DataFrame:
    return dropped.filter(F.col("target").isNull()).groupBy("kind", "dimension").agg(
        half_even(F.avg("drop"), 1).alias("mean_drop"))


def baseline_noise(baseline: DataFrame) -> DataFrame:
    """Mean over drawings of the population deviation between baseline repeats, in points."""
    per = baseline.groupBy("id", "dimension").agg(F.stddev_pop("score").alias("_sd"), F.count(F.lit(1)).alias("_n"))
    return per.filter(F.col("_n") > 1).groupBy("dimension").agg(half_even(F.avg(100 * F.col("_sd")), 1).alias("noise_sd"))


# --- T17 ---
def isolation_warnings(dropped: DataFrame, keys: list[str] = ("id", "kind", "variant"), limit: float = MIN_SENSITIVITY) -> DataFrame:
    """WEAK: the target moved too little. LEAK: another dimension moved too much."""
    own = F.col("dimension") == F.col("target")
    weak, leak = own & (F.col("drop") < limit), ~own & (F.col("drop") >= limit)
    kind = F.when(weak, F.lit("WEAK")).when(leak, F.lit("LEAK"))
    return dropped.filter(F.col("target").isNotNull()).select(
        *keys, "target", "dimension", "drop", kind.alias("warning")).filter(F.col("warning").isNotNull())


def controls_pass(scores: DataFrame, keys: list[str], floor: float = 85) -> DataFrame:
    return scores.groupBy(*keys).agg((F.min("score") >= floor).alias("passes"))


# --- T18 ---
def delta_table(scores: DataFrame, overall: DataFrame, baseline: str = "baseline") -> DataFrame:
    """Change of each dimension and of the weighted overall against the baseline variant."""
    rows = scores.select("id", "variant", "dimension", "score").unionByName(
        overall.select("id", "variant", F.lit("overall").alias("dimension"), F.col("overall").alias("score")))
    base = rows.filter(F.col("variant") == baseline).select("id", "dimension", F.col("score").alias("_base"))
    return rows.join(base, ["id", "dimension"], "left").withColumn("delta", F.col("score") - F.col("_base")).drop("_base")


# --- W9 ---
def extremes(rows: DataFrame, by: str, tie: list[str]) -> DataFrame:
    """Most sensitive and least isolated example per kind, both by partial aggregation."""
    best = F.min(F.struct((-F.col("sensitivity")).alias("s"), *tie))
    worst = F.min(F.struct(F.col("isolation").alias("s"), *tie))
    per = rows.filter(F.col("isolation").isNotNull()).groupBy(by).agg(best.alias("b"), worst.alias("w"))
    return per.select(by, *(F.col(f"b.{t}").alias(f"best_{t}") for t in tie), *(F.col(f"w.{t}").alias(f"worst_{t}") for t in tie))
