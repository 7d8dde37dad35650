"""Agreement, separation, resampling and isolation."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from scenequality.operators import agreement as A, isolation as I
from scenequality.operators.running import positions, running_before
from tests.conftest import rows


def pairs(spark, data):
    return spark.createDataFrame([("k", float(h), float(j)) for h, j in data], "dimension string, human double, judge double")


def test_two_pairs_report_only_n(spark):
    out = A.agreement(A.score_cells(pairs(spark, [(1, 2), (3, 4)]), ["dimension"]), ["dimension"]).first()
    assert out.n == 2 and out.mae is None and out.pearson is None


def test_constant_side_is_null(spark):
    cells = A.score_cells(pairs(spark, [(5, 2), (5, 4), (5, 9)]), ["dimension"])
    assert A.agreement(cells, ["dimension"]).first().pearson is None
    assert A.spearman(cells, ["dimension"]).first().spearman is None
    assert A.kendall_tau_b(cells, ["dimension"]).first().kendall is None


def tau_b(data):
    s = sum(((a > c) - (a < c)) * ((b > d) - (b < d)) for (a, b), (c, d) in itertools.combinations(data, 2))
    n0 = len(data) * (len(data) - 1) / 2
    tie = lambda k: sum(x[k] == y[k] for x, y in itertools.combinations(data, 2))
    return s / math.sqrt((n0 - tie(0)) * (n0 - tie(1)))


def test_kendall_matches_brute_force(spark):
    rng = random.Random(1)
    data = [(rng.randint(1, 25) / 2, rng.randint(0, 30) / 3) for _ in range(200)]
    got = A.kendall_tau_b(A.score_cells(pairs(spark, data), ["dimension"]), ["dimension"]).first().kendall
    assert got == pytest.approx(tau_b(data))


def test_auc(spark):
    df = spark.createDataFrame([("k", 9.0, True), ("k", 8.0, True), ("k", 8.0, False), ("k", 3.0, False)], "dimension string, score double, positive boolean")
    assert A.auc(df, ["dimension"]).first().auc == pytest.approx(0.875)
    assert A.auc(df.withColumn("score", -F.col("score")), ["dimension"]).first().auc == pytest.approx(0.125)
    assert A.auc(df.filter("positive"), ["dimension"]).first().auc is None


def test_crowded_groups_rank_alike(spark):
    df = spark.range(3000).select(F.lit("g").alias("k"), (F.col("id") * 7919 % 3001).cast("double").alias("v"), (F.col("id") % 5).alias("w"))
    assert rows(running_before(df, ["k"], "v", "w", "b")) == rows(running_before(df, ["k"], "v", "w", "b", crowded=100))
    assert rows(positions(df, ["k"], ["v"])) == rows(positions(df, ["k"], ["v"], crowded=100))


def test_resampling_is_repeatable(spark):
    errors = spark.range(60).select("id", (F.col("id") % 7).cast("double").alias("error_a"), (F.col("id") % 5).cast("double").alias("error_b"))
    one, two = (A.paired_bootstrap(errors, draws=500, seed=4).first() for _ in range(2))
    assert one == two and one.ci_low < one.rmse_change < one.ci_high
    p = A.paired_permutation(errors, draws=500, seed=4).first()
    assert 0 < p.p_value < 0.05 and p.p_bonferroni == pytest.approx(min(1, 5 * p.p_value))
    same = A.paired_permutation(errors.withColumn("error_b", F.col("error_a")), draws=100, seed=4).first()
    assert same.p_value == 1.0


def dropped(spark, *data):
    return spark.createDataFrame(data, "id string, kind string, variant long, target string, changed_px long, dimension string, drop double")


def test_isolation_rows(spark):
    names = ("layout", "connectivity", "presence", "details", "legibility")
    make = lambda i, kind, target, px, drops: [(i, kind, 1, target, px, d, x) for d, x in zip(names, drops)]
    out = {r.kind: r for r in I.isolation_rows(dropped(
        spark, *make("D", "through", "layout", 16724, (0.0, -3.3, 43.8, 0.0, 0.0)), *make("D", "crop", "layout", -1, (25.0, -6.7, 68.4, 0.0, 0.0)),
        *make("D", "enlarge", "legibility", 12091, (43.8, 0.0, 0.0, 0.0, 43.8)), *make("D", "tiny", "details", 10, (0.0, 0.0, 0.0, 30.0, 0.0)),
        *make("D", "gray", None, 0, (0.0, 0.0, 2.0, 0.0, 0.0)))).collect()}
    pick = lambda k: (out[k].sensitivity, out[k].worst_leak, out[k].specificity, out[k].isolation)
    assert pick("through") == (0.0, 43.8, 0.0, 0.0)
    assert pick("crop") == (25.0, 68.4, 26.8, 26.8)
    assert pick("enlarge") == (43.8, 43.8, 50.0, 50.0)
    assert out["tiny"].target == "invalid" and out["tiny"].isolation is None
    assert out["gray"].target == "" and out["gray"].worst_leak == 2.0


def test_warnings_and_delta(spark):
    warn = I.isolation_warnings(dropped(spark, ("D", "k", 1, "layout", 99, "layout", 3.0), ("D", "k", 1, "layout", 99, "details", 15.0)))
    assert rows(warn, "dimension", "warning") == [("details", "LEAK"), ("layout", "WEAK")]
    scores = spark.createDataFrame([("D", v, d, s) for v, d, s in (("baseline", "layout", 0.9), ("edit", "layout", 0.8), ("edit", "details", 0.5))], "id string, variant string, dimension string, score double")
    overall = spark.createDataFrame([("D", "baseline", 0.9), ("D", "edit", 0.65)], "id string, variant string, overall double")
    got = {(r.variant, r.dimension): r.delta for r in I.delta_table(scores, overall).collect()}
    assert got["edit", "layout"] == pytest.approx(-0.1) and got["edit", "overall"] == pytest.approx(-0.25) and got["edit", "details"] is None


def test_incomplete_validation_is_null(spark):
    ids = spark.createDataFrame([("a",), ("b",)], "id string")
    humans = spark.createDataFrame([(i, d, 5.0) for i in "ab" for d in ("x", "y")], "id string, dimension string, human double")
    judged = spark.createDataFrame([(i, d, 6.0) for i in "ab" for d in ("x", "y")], "id string, dimension string, judge double")
    whole = A.validation_metrics(ids, humans, judged, ("x", "y"))
    assert {r.dimension: r.n for r in whole.collect()} == {"x": 2, "y": 2, "overall": 4}
    part = A.validation_metrics(ids, humans, judged.filter("not (id = 'b' and dimension = 'y')"), ("x", "y"))
    assert all(r.rmse is None for r in part.collect())
