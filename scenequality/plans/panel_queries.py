"""Panel, vote and weighting queries over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenequality.operators import panel as P
from scenequality.plans.bindings import view
from scenequality.plans.registry import query, r6, sql6

_SEVERITY = "CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END"
_POINTS = "CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 8 END"
_SCORE = "greatest(0, least(1, (expected_count - greatest(detected_issues, 0)) / expected_count))"
_DIMENSION = "split_part(criterion_id, '.', 1)"


def _panel(spark, sf):
    return view(spark, sf, "panel")


def _criteria(panel):
    """The rubric as found in the answers: criterion ids with their dimension."""
    return panel.select("criterion_id").distinct().withColumn("dimension", F.substring_index("criterion_id", ".", 1))


def _severities(panel):
    return panel.select("criterion_id", F.substring_index("criterion_id", ".", 1).alias("dimension"),
                        F.expr(_SEVERITY).alias("severity")).distinct()


@query("panel_median", ("panel",), f"""
    , c AS (SELECT diagram_id, criterion_id, median({_SCORE}) AS score FROM panel GROUP BY ALL)
    SELECT diagram_id, {_DIMENSION} AS dimension, {sql6('avg(score)', 'score')}, count(*) AS criteria FROM c GROUP BY ALL""")
def panel_median(spark, sf):
    p = _panel(spark, sf)
    out = P.aggregate_panel(p, _criteria(p), "mean")
    return out.select("diagram_id", "dimension", r6(F.col("score"), "score"), "criteria")


@query("panel_minimum_penalised", ("panel",), f"""
    , c AS (SELECT diagram_id, criterion_id, median(least({_SCORE}, power(75e-2, detected_issues))) AS score FROM panel GROUP BY ALL)
    SELECT diagram_id, {_DIMENSION} AS dimension, {sql6('min(score)', 'score')}, count(*) AS criteria FROM c GROUP BY ALL""")
def panel_minimum_penalised(spark, sf):
    p = _panel(spark, sf)
    out = P.aggregate_panel(p, _criteria(p), "minimum", 0.75)
    return out.select("diagram_id", "dimension", r6(F.col("score"), "score"), "criteria")


@query("panel_judges", ("panel",), f"SELECT DISTINCT diagram_id, {_DIMENSION} AS dimension, judge FROM panel")
def panel_judges(spark, sf):
    p = _panel(spark, sf)
    return P.panel_judges(p, _criteria(p))


@query("criterion_disagreements", ("panel",), f"""
    , l AS (SELECT diagram_id, criterion_id, judge, arg_max({_SCORE}, event_id) AS score FROM panel GROUP BY ALL)
    SELECT diagram_id, criterion_id, count(*) AS judges, {sql6('min(score)', 'lowest')}, {sql6('max(score)', 'highest')},
           half_even(max(score) - min(score), 4) AS spread
    FROM l GROUP BY ALL HAVING count(*) >= 2 AND max(score) - min(score) >= 0.25""")
def criterion_disagreements(spark, sf):
    out = P.criterion_disagreements(_panel(spark, sf), order="event_id")
    return out.select("diagram_id", "criterion_id", "judges", r6(F.col("lowest"), "lowest"), r6(F.col("highest"), "highest"), "spread")


@query("verdict_agreement", ("samples",), """
    , l AS (SELECT diagram_id, component_id, sample_no % 5 AS judge, arg_max(verdict, sample_no) AS verdict FROM samples GROUP BY ALL)
    SELECT diagram_id, component_id, count(*) AS judges, count(*) FILTER (verdict = 'present') AS present,
           count(*) FILTER (verdict = 'mislabeled') AS mislabeled, count(*) FILTER (verdict = 'uncertain') AS uncertain,
           count(*) FILTER (verdict = 'absent') AS absent, count(DISTINCT verdict) <= 1 AS agree
    FROM l GROUP BY ALL""")
def verdict_agreement(spark, sf):
    return P.component_agreement(view(spark, sf, "samples").withColumn("judge", F.col("sample_no") % 5), order="sample_no")


@query("majority_vote", ("samples",), """
    , c AS (SELECT diagram_id, component_id, verdict, count(*) AS n, min(sample_no) AS first_no FROM samples GROUP BY ALL),
    o AS (SELECT *, CASE verdict WHEN 'present' THEN 0 WHEN 'mislabeled' THEN 1 WHEN 'uncertain' THEN 2 ELSE 3 END AS o,
                 max(n) OVER (PARTITION BY diagram_id, component_id) AS top,
                 sum(n) OVER (PARTITION BY diagram_id, component_id) AS total FROM c),
    w AS (SELECT *, sum(CASE WHEN n = top THEN 1 ELSE 0 END) OVER (PARTITION BY diagram_id, component_id) AS winners,
                 sum(n) OVER (PARTITION BY diagram_id, component_id ORDER BY o) AS upto FROM o),
    v AS (SELECT diagram_id, component_id, any_value(total) AS total,
                 CASE WHEN any_value(winners) = 1 THEN arg_max(verdict, n)
                      ELSE arg_min(verdict, o) FILTER (upto > (total - 1) // 2) END AS verdict FROM w GROUP BY ALL),
    f AS (SELECT v.*, c.first_no FROM v JOIN c USING (diagram_id, component_id, verdict)),
    g AS (SELECT diagram_id, component_id, count(*) FILTER (label_legible) AS yes, count(*) FILTER (NOT label_legible) AS no
          FROM samples GROUP BY ALL)
    SELECT f.diagram_id, f.component_id, f.verdict, CAST(f.total AS BIGINT) AS samples, f.first_no AS sample_no,
           CASE WHEN yes <> no THEN yes > no ELSE s.label_legible END AS label_legible
    FROM f JOIN g USING (diagram_id, component_id)
    JOIN samples s ON s.diagram_id = f.diagram_id AND s.component_id = f.component_id AND s.sample_no = f.first_no""")
def majority_vote(spark, sf):
    return P.merge_verdicts(view(spark, sf, "samples"), ["diagram_id", "component_id"], "verdict")


@query("median_low_counts", ("samples",), """
    , m AS (SELECT diagram_id, component_id, quantile_disc(detected_issues, 0.5) AS detected_issues FROM samples GROUP BY ALL)
    SELECT diagram_id, component_id, detected_issues, min(sample_no) AS carrier
    FROM samples JOIN m USING (diagram_id, component_id, detected_issues) GROUP BY ALL""")
def median_low_counts(spark, sf):
    return P.median_low_counts(view(spark, sf, "samples"), ["diagram_id", "component_id"])


@query("median_sample", ("samples",), """
    , l AS (SELECT diagram_id, component_id, sample_no % 5 AS sample_no, count(*) AS length FROM samples GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY diagram_id, component_id ORDER BY length, sample_no) AS k,
                 count(*) OVER (PARTITION BY diagram_id, component_id) AS n FROM l)
    SELECT diagram_id, component_id, sample_no, length FROM r WHERE k = (n + 1) // 2""")
def median_sample(spark, sf):
    lengths = view(spark, sf, "samples").groupBy("diagram_id", "component_id", (F.col("sample_no") % 5).alias("sample_no")).agg(
        F.count(F.lit(1)).alias("length"))
    return P.median_sample(lengths, ["diagram_id", "component_id"])


@query("repeat_noise", ("baseline_scores",), """
    SELECT id, dimension, half_even(avg(100 * score), 0) AS score, half_even(stddev_pop(100 * score), 1) AS std, count(*) AS runs
    FROM baseline_scores GROUP BY ALL""")
def repeat_noise(spark, sf):
    return P.repeat_summary(view(spark, sf, "baseline_scores").withColumn("score", 100 * F.col("score")), ["id", "dimension"])


@query("run_noise", ("scored",), """
    SELECT dimension, count(*) AS n, count(*) FILTER (human = judge) AS identical, count(*) FILTER (abs(human - judge) <= 1) AS within_1
    FROM scored GROUP BY ALL""")
def run_noise(spark, sf):
    s = view(spark, sf, "scored")
    return P.run_noise(s.select("id", "dimension", F.col("human").alias("score")),
                       s.select("id", "dimension", F.col("judge").alias("score")), ["id", "dimension"], ["dimension"])


@query("usage_totals", (), """
    SELECT event_type AS backend, CAST(sum(1) AS BIGINT) AS calls, CAST(sum(CAST(floor(value * 10) AS BIGINT)) AS BIGINT) AS input_tokens,
           CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS output_tokens FROM events GROUP BY ALL""")
def usage_totals(spark, sf):
    rows = spark.read.parquet(f"{sf}/events.parquet").select(
        F.col("event_type").alias("backend"), F.lit(1).cast("bigint").alias("calls"),
        F.floor(F.col("value") * 10).alias("input_tokens"), F.floor("value").alias("output_tokens"))
    return P.usage_totals(rows, ["backend"])


@query("severity_weights", ("panel",), f"""
    , m AS (SELECT {_DIMENSION} AS dimension, max({_POINTS}) AS total FROM panel GROUP BY ALL)
    SELECT dimension, {sql6('total / sum(total) OVER ()', 'weight')} FROM m""")
def severity_weights(spark, sf):
    return P.severity_weights(_severities(_panel(spark, sf))).select("dimension", r6(F.col("weight"), "weight"))


@query("history_weights", ("panel",), f"""
    , m AS (SELECT {_DIMENSION} AS dimension, sum(detected_issues * {_POINTS}) AS total FROM panel GROUP BY ALL)
    SELECT dimension, {sql6('total / sum(total) OVER ()', 'weight')} FROM m""")
def history_weights(spark, sf):
    p = _panel(spark, sf)
    history = p.select(F.substring_index("criterion_id", ".", 1).alias("dimension"), F.expr(_SEVERITY).alias("severity"),
                       F.col("detected_issues").alias("count"))
    return P.history_weights(history, _criteria(p)).select("dimension", r6(F.col("weight"), "weight"))


@query("weighted_overall", ("panel",), f"""
    , c AS (SELECT diagram_id, criterion_id, median({_SCORE}) AS score FROM panel GROUP BY ALL),
    d AS (SELECT diagram_id, {_DIMENSION} AS dimension, avg(score) AS score FROM c GROUP BY ALL),
    m AS (SELECT {_DIMENSION} AS dimension, sum(detected_issues * {_POINTS}) AS weight FROM panel GROUP BY ALL)
    SELECT diagram_id, {sql6('sum(weight * score) / sum(weight)', 'overall')}, count(*) AS dimensions
    FROM d JOIN m USING (dimension) GROUP BY ALL""")
def weighted_overall(spark, sf):
    p = _panel(spark, sf)
    history = p.select(F.substring_index("criterion_id", ".", 1).alias("dimension"), F.expr(_SEVERITY).alias("severity"),
                       F.col("detected_issues").alias("count"))
    weights = P.history_weights(history, _criteria(p))
    out = P.weighted_overall(P.aggregate_panel(p, _criteria(p)), weights)
    return out.select("diagram_id", r6(F.col("overall"), "overall"), "dimensions")


@query("direct_overall", ("scored",), f"""
    SELECT id, {sql6('avg(judge)', 'overall')} FROM scored GROUP BY ALL HAVING count(DISTINCT dimension) = 5""")
def direct_overall(spark, sf):
    rows = view(spark, sf, "scored").select("id", "dimension", F.col("judge").alias("score"))
    return P.direct_overall(rows, ["id"]).select("id", r6(F.col("overall"), "overall"))
