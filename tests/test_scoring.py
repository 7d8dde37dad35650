"""Scores, panels, weights, votes and disagreement on the fixture numbers."""

import pytest
from pyspark.sql import functions as F

from scenequality.functions.geometry import half_even
from scenequality.operators import panel as P
from scenequality.schemas import METRIC_SCORES, criteria_table
from tests.conftest import rows


def metrics(spark, *data):
    return spark.createDataFrame([("d", c, c.split(".")[0], j, e, i) for c, j, e, i in data], METRIC_SCORES)


def test_metric_score(spark):
    df = spark.createDataFrame([(10, 3), (2, 8), (0, 0)], "e long, i long")
    assert [r[0] for r in df.select(P.metric_score(F.col("e"), F.col("i"))).collect()] == [0.7, 0.0, None]


def test_panel_median_hides_an_outlier(spark):
    scores = metrics(spark, *[("presence.elements", f"j{k}", 10, i) for k, i in enumerate((1, 2, 9, 2))])
    out = P.aggregate_panel(scores, criteria_table(spark)).first()
    assert out.score == pytest.approx(0.8)


def test_error_factor_and_zero_means_none(spark):
    scores = metrics(spark, ("presence.elements", "j", 10, 1))
    rubric = criteria_table(spark)
    assert P.aggregate_panel(scores, rubric, "minimum", 0.75).first().score == pytest.approx(0.75)
    assert P.aggregate_panel(scores, rubric, "minimum", 0).first().score == pytest.approx(0.9)
    with pytest.raises(ValueError):
        P.aggregate_panel(scores, rubric, "sum")


def test_missing_is_not_perfect(spark):
    scores = metrics(spark, ("presence.elements", "j", 0, 0), ("layout.order", "j", 4, 1))
    assert rows(P.aggregate_panel(scores, criteria_table(spark)), "dimension", "score") == [("layout", 0.75)]


def test_weights(spark):
    rubric = criteria_table(spark)
    weights = dict(rows(P.severity_weights(rubric), "dimension", "weight"))
    assert weights["connectivity"] == pytest.approx(1 / 3) and weights["presence"] == pytest.approx(1 / 6)
    history = spark.createDataFrame([("presence", "medium", 2.0), ("connectivity", "critical", 1.0)], "dimension string, severity string, count double")
    found = dict(rows(P.history_weights(history, rubric), "dimension", "weight"))
    assert found["presence"] == pytest.approx(1 / 3) and found["connectivity"] == pytest.approx(2 / 3) and found["layout"] == 0
    empty = history.filter("1 = 0")
    assert dict(rows(P.history_weights(empty, rubric), "dimension", "weight"))["layout"] == pytest.approx(0.2)
    assert dict(rows(P.resolve_weights("auto", rubric, empty), "dimension", "weight")) == pytest.approx(weights)
    with pytest.raises(Exception, match="unknown severity"):
        P.history_weights(history.withColumn("severity", F.lit("awful")), rubric).collect()


def test_disagreement_and_overall(spark):
    scores = metrics(spark, ("p.x", "a", 10, 0), ("p.x", "b", 10, 5), ("c.x", "a", 10, 0), ("c.x", "b", 10, 5))
    numbered = scores.withColumn("n", F.monotonically_increasing_id())
    assert len(rows(P.criterion_disagreements(numbered, "n"))) == 2
    rubric = spark.createDataFrame([("p.x", "p", "high", ""), ("c.x", "c", "critical", "")], "criterion_id string, dimension string, severity string, metric string")
    weights = P.severity_weights(rubric)
    assert dict(rows(weights, "dimension", "weight"))["c"] == pytest.approx(2 / 3)
    overall = P.weighted_overall(P.aggregate_panel(scores, rubric), weights).first()
    assert overall.overall == pytest.approx(0.75)


def samples(spark, *verdicts):
    return spark.createDataFrame([("d", "k", i, v, i % 2 == 0) for i, v in enumerate(verdicts)],
                                 "diagram_id string, component_id string, sample_no int, verdict string, label_legible boolean")


@pytest.mark.parametrize("verdicts, winner, carrier", [
    (("present", "absent", "present"), "present", 0),
    (("absent", "present"), "present", 1),          # tie of two: lower median of the order
    (("absent", "uncertain", "mislabeled"), "uncertain", 1),
])
def test_vote(spark, verdicts, winner, carrier):
    out = P.merge_verdicts(samples(spark, *verdicts), ["diagram_id", "component_id"], "verdict").first()
    assert (out.verdict, out.sample_no) == (winner, carrier)


def test_median_low(spark):
    df = spark.createDataFrame([("d", i, v) for i, v in enumerate((0, 2, 1, 2))], "diagram_id string, sample_no int, detected_issues long")
    out = P.median_low_counts(df, ["diagram_id"]).first()
    assert (out.detected_issues, out.carrier) == (1, 2)


def test_minimum_never_above_mean(spark):
    scores = metrics(spark, *[(c, f"j{k}", 10, (k * 7 + len(c)) % 11) for c, _, _, _ in __import__("scenequality.schemas", fromlist=["RUBRIC"]).RUBRIC for k in range(3)])
    rubric = criteria_table(spark)
    low = dict(rows(P.aggregate_panel(scores, rubric, "minimum"), "dimension", "score"))
    mean = dict(rows(P.aggregate_panel(scores, rubric, "mean"), "dimension", "score"))
    assert all(low[d] <= mean[d] + 1e-12 for d in mean)


def test_half_even_equals_python(spark):
    values = [0.35, 1.275, 2.675, 0.5, 1.5, 2.5, -0.5, -1.5, 56.65, 43.75, 0.125, 1e6 + 0.05, -2.345, 0.0]
    for digits in (0, 1, 2, 4):
        got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(half_even(F.col("v"), digits)).collect()]
        assert got == [round(v, digits) for v in values]
