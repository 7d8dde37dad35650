"""Judge-versus-human and ablation queries over documents, labels and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenequality.functions.geometry import hundred_to_human
from scenequality.operators import agreement as A, isolation as I
from scenequality.plans.bindings import view, with_defects
from scenequality.plans.registry import mix_items, query, r6, sql6
from scenequality.schemas import CORRECTNESS

SETS = [["dimension"], ["dimension", "difficulty"], ["dimension", "rater"]]
BY = ["dimension", "difficulty", "rater"]
_GROUPS = "GROUPING SETS ((dimension), (dimension, difficulty), (dimension, rater))"


def _scored(spark, sf):
    return view(spark, sf, "scored")


def _cells(spark, sf):
    return A.grouped_cells(A.score_cells(_scored(spark, sf), BY), SETS)


@query("agreement_by_group", ("scored",), f"""
    SELECT dimension, difficulty, rater, count(*) AS n,
           CASE WHEN count(*) >= 3 THEN round(avg(human), 6) + 0.0e0 END AS human_mean,
           CASE WHEN count(*) >= 3 THEN round(avg(judge), 6) + 0.0e0 END AS judge_mean,
           CASE WHEN count(*) >= 3 THEN round(avg(abs(judge - human)), 6) + 0.0e0 END AS mae,
           CASE WHEN count(*) >= 3 THEN round(sqrt(avg((judge - human) * (judge - human))), 6) + 0.0e0 END AS rmse,
           CASE WHEN count(*) >= 3 THEN round(avg(judge - human), 6) + 0.0e0 END AS bias,
           CASE WHEN count(*) >= 3 THEN round(avg(CASE WHEN abs(judge - human) <= 1 THEN 1 ELSE 0 END), 6) + 0.0e0 END AS within_1,
           CASE WHEN count(*) >= 3 THEN round(stddev_pop(human), 6) + 0.0e0 END AS human_sd
    FROM scored GROUP BY {_GROUPS}""")
def agreement_by_group(spark, sf):
    out = A.agreement(_cells(spark, sf), [*BY, "grouping"])
    names = ("human_mean", "judge_mean", "mae", "rmse", "bias", "within_1", "human_sd")
    return out.select(*BY, "n", *(r6(F.col(c), c) for c in names))


@query("pearson_ci", ("scored",), f"""
    , r AS (SELECT dimension, difficulty, rater, count(*) AS n,
                   CASE WHEN count(*) >= 3 AND count(DISTINCT human) > 1 AND count(DISTINCT judge) > 1 THEN corr(human, judge) END AS r
            FROM scored GROUP BY {_GROUPS})
    SELECT dimension, difficulty, rater, n, {sql6('r', 'pearson')},
           CASE WHEN n > 3 AND abs(r) < 1 THEN round(tanh(atanh(r) - 196e-2 / sqrt(n - 3)), 6) + 0.0e0 END AS pearson_low,
           CASE WHEN n > 3 AND abs(r) < 1 THEN round(tanh(atanh(r) + 196e-2 / sqrt(n - 3)), 6) + 0.0e0 END AS pearson_high FROM r""")
def pearson_ci(spark, sf):
    out = A.agreement(_cells(spark, sf), [*BY, "grouping"])
    return out.select(*BY, "n", *(r6(F.col(c), c) for c in ("pearson", "pearson_low", "pearson_high")))


@query("spearman", ("scored",), f"""
    , g AS (SELECT s.dimension, s.difficulty, CAST(NULL AS VARCHAR) AS rater, human, judge FROM scored s
            UNION ALL SELECT dimension, NULL, rater, human, judge FROM scored
            UNION ALL SELECT dimension, NULL, NULL, human, judge FROM scored),
    k AS (SELECT *, rank() OVER (PARTITION BY dimension, difficulty, rater ORDER BY human)
                    + (count(*) OVER (PARTITION BY dimension, difficulty, rater, human) - 1) / 2 AS a,
                 rank() OVER (PARTITION BY dimension, difficulty, rater ORDER BY judge)
                    + (count(*) OVER (PARTITION BY dimension, difficulty, rater, judge) - 1) / 2 AS b FROM g)
    SELECT dimension, difficulty, rater, count(*) AS n,
           CASE WHEN count(*) >= 3 AND count(DISTINCT human) > 1 AND count(DISTINCT judge) > 1
                THEN round(corr(a, b), 6) + 0.0e0 END AS spearman FROM k GROUP BY dimension, difficulty, rater""")
def spearman(spark, sf):
    return A.spearman(_cells(spark, sf), [*BY, "grouping"]).select(*BY, "n", r6(F.col("spearman"), "spearman"))


@query("kendall_tau_b", ("scored",), """
    , c AS (SELECT dimension, difficulty, human, judge, count(*) AS n FROM scored GROUP BY ALL),
    p AS (SELECT a.dimension, a.difficulty, sum(a.n * b.n * sign(a.human - b.human) * sign(a.judge - b.judge)) / 2e0 AS s
          FROM c a JOIN c b USING (dimension, difficulty) GROUP BY ALL),
    t AS (SELECT dimension, difficulty, sum(n) AS n FROM c GROUP BY ALL),
    h AS (SELECT dimension, difficulty, sum(m * (m - 1) / 2) AS t FROM (SELECT dimension, difficulty, human, sum(n) AS m FROM c GROUP BY ALL) GROUP BY ALL),
    j AS (SELECT dimension, difficulty, sum(m * (m - 1) / 2) AS t FROM (SELECT dimension, difficulty, judge, sum(n) AS m FROM c GROUP BY ALL) GROUP BY ALL)
    SELECT t.dimension, t.difficulty, CAST(t.n AS BIGINT) AS n,
           CASE WHEN t.n >= 3 AND (t.n * (t.n - 1) / 2 - h.t) * (t.n * (t.n - 1) / 2 - j.t) > 0
                THEN round(p.s / sqrt((t.n * (t.n - 1) / 2 - h.t) * (t.n * (t.n - 1) / 2 - j.t)), 6) + 0.0e0 END AS kendall
    FROM t JOIN p USING (dimension, difficulty) JOIN h USING (dimension, difficulty) JOIN j USING (dimension, difficulty)""")
def kendall(spark, sf):
    cells = A.score_cells(_scored(spark, sf), ["dimension", "difficulty"])
    return A.kendall_tau_b(cells, ["dimension", "difficulty"]).select("dimension", "difficulty", "n", r6(F.col("kendall"), "kendall"))


@query("auc", ("scored",), """
    , l AS (SELECT dimension, 'human' AS who, human AS v, label FROM scored UNION ALL SELECT dimension, 'judge', judge, label FROM scored),
    c AS (SELECT dimension, who, v, count(*) FILTER (label = 'positive') AS p, count(*) FILTER (label <> 'positive') AS q FROM l GROUP BY ALL)
    SELECT a.dimension, a.who, CAST(any_value(t.p) AS BIGINT) AS positives, CAST(any_value(t.q) AS BIGINT) AS negatives,
           round(sum(a.p * b.q * CASE WHEN a.v > b.v THEN 1e0 WHEN a.v = b.v THEN 5e-1 ELSE 0e0 END) / (any_value(t.p) * any_value(t.q)), 6) + 0.0e0 AS auc
    FROM c a JOIN c b USING (dimension, who)
    JOIN (SELECT dimension, who, sum(p) AS p, sum(q) AS q FROM c GROUP BY ALL) t USING (dimension, who) GROUP BY a.dimension, a.who""")
def auc(spark, sf):
    s = _scored(spark, sf)
    rows = s.select("dimension", (F.col("label") == "positive").alias("positive"), F.inline(F.array(
        F.struct(F.lit("human").alias("who"), F.col("human").alias("score")), F.struct(F.lit("judge").alias("who"), F.col("judge").alias("score")))))
    return A.auc(rows, ["dimension", "who"]).select("dimension", "who", "positives", "negatives", r6(F.col("auc"), "auc"))


_DIMS = "[" + ", ".join(f"'{d}'" for d in CORRECTNESS) + "]"


@query("errors_caught", ("scored",), f"""
    , e AS (SELECT id, dimension, human, judge, 'd' || CAST(id % 4 AS VARCHAR) AS defect, {_DIMS}[id % 5 + 1] AS hit FROM scored WHERE label = 'negative'
            UNION ALL SELECT id, dimension, human, judge, 'extra', {_DIMS}[(id + 2) % 5 + 1] FROM scored WHERE label = 'negative' AND id % 3 = 0),
    f AS (SELECT * FROM e WHERE hit = dimension)
    SELECT coalesce(dimension, 'all') AS dimension, coalesce(defect, 'all') AS defect, count(*) AS n,
           count(*) FILTER (human < 8) AS human_caught, count(*) FILTER (judge < 8) AS judge_caught
    FROM f GROUP BY GROUPING SETS ((dimension, defect), ())""")
def errors_caught(spark, sf):
    return A.errors_caught(with_defects(_scored(spark, sf)))


@query("false_alarms", ("scored",), """
    SELECT dimension, count(*) FILTER (label = 'positive' AND human >= 9 AND judge < 8) AS false_alarms FROM scored GROUP BY ALL""")
def false_alarms(spark, sf):
    return A.false_alarms(_scored(spark, sf))


@query("overall_dimensions", ("scored",), f"""
    , o AS (SELECT id, avg(human) AS human, avg(judge) AS judge FROM scored GROUP BY ALL)
    SELECT id, dimension, {sql6('CAST(human AS DOUBLE)', 'human')}, {sql6('CAST(judge AS DOUBLE)', 'judge')} FROM scored
    UNION ALL SELECT id, 'correctness_overall', {sql6('human', 'human')}, {sql6('judge', 'judge')} FROM o
    UNION ALL SELECT id, 'overall', {sql6('human', 'human')}, {sql6('judge', 'judge')} FROM o""")
def overall_dimensions(spark, sf):
    s = _scored(spark, sf).select("id", "dimension", F.col("human").cast("double"), F.col("judge").cast("double"))
    return A.with_overall(s, ["id"]).select("id", "dimension", r6(F.col("human"), "human"), r6(F.col("judge"), "judge"))


@query("validation_metrics", ("scored",), f"""
    , p AS (SELECT dimension, human, 1 + 9 * (n_chars % 101) / 1e2 AS judge FROM scored),
    q AS (SELECT * FROM p UNION ALL SELECT 'overall', human, judge FROM p)
    SELECT dimension, count(*) AS n, {sql6('sqrt(avg((judge - human) * (judge - human)))', 'rmse')},
           {sql6('avg(abs(judge - human))', 'mae')}, {sql6('corr(human, judge)', 'pearson')} FROM q GROUP BY ALL""")
def validation_metrics(spark, sf):
    s = _scored(spark, sf)
    judged = s.select("id", "dimension", hundred_to_human(F.col("n_chars") % 101).alias("judge"))
    out = A.validation_metrics(s.select("id").distinct(), s.select("id", "dimension", "human"), judged, CORRECTNESS)
    return out.select("dimension", "n", *(r6(F.col(c), c) for c in ("rmse", "mae", "pearson")))


@query("worst_disagreements", ("scored",), """
    , d AS (SELECT id, position, dimension, abs(judge - human) AS d FROM scored)
    SELECT id, max(d) AS largest_delta, arg_min(dimension, position) FILTER (d = m) AS worst_dimension
    FROM (SELECT *, max(d) OVER (PARTITION BY id) AS m FROM d) GROUP BY ALL ORDER BY largest_delta DESC, id LIMIT 20""")
def worst_disagreements(spark, sf):
    return A.worst_errors(_scored(spark, sf))


@query("label_corrections", ("scored",), """
    SELECT id, dimension, human AS original, judge AS corrected FROM scored WHERE human <> judge""")
def label_corrections(spark, sf):
    s = _scored(spark, sf)
    return A.corrections(s.select("id", "dimension", F.col("human").alias("score")), s.select("id", "dimension", F.col("judge").alias("score")))


@query("version_side_by_side", ("scored",), """
    , m AS (SELECT dimension AS metric, avg(abs(judge - human)) AS mae_a, avg(abs(1 + n_chars % 10 - human)) AS mae_b FROM scored GROUP BY ALL)
    SELECT metric, round(mae_a, 6) + 0.0e0 AS first, round(mae_b, 6) + 0.0e0 AS second, round(least(mae_a, mae_b), 6) + 0.0e0 AS best FROM m""")
def version_side_by_side(spark, sf):
    s = _scored(spark, sf)
    rows = s.select(F.col("dimension").alias("metric"), "human", F.inline(F.array(
        F.struct(F.lit("first").alias("version"), F.col("judge").cast("bigint").alias("j")),
        F.struct(F.lit("second").alias("version"), (1 + F.col("n_chars") % 10).cast("bigint").alias("j")))))
    metrics = rows.groupBy("metric", "version").agg(F.avg(F.abs(F.col("j") - F.col("human"))).alias("value"))
    out = A.side_by_side(metrics, ["first", "second"], [])
    return out.select("metric", *(r6(F.col(c), c) for c in ("first", "second", "best")))


@query("candidate_ranking", ("scored",), """
    , o AS (SELECT id AS diagram_id, avg(judge) AS overall FROM scored GROUP BY ALL)
    SELECT diagram_id, round(overall, 6) + 0.0e0 AS overall, CAST(row_number() OVER (ORDER BY overall DESC, diagram_id) AS INTEGER) AS rank
    FROM o""")
def candidate_ranking(spark, sf):
    o = _scored(spark, sf).groupBy(F.col("id").alias("diagram_id")).agg(F.avg("judge").alias("overall"))
    return A.rank_candidates(o).select("diagram_id", r6(F.col("overall"), "overall"), "rank")


_SEED = 20261112


@query("paired_bootstrap_ci", ("errors",), f"""
    , e AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS i FROM errors), n AS (SELECT count(*) AS n FROM e),
    u AS (SELECT rep, i, {mix_items('hi', ['rep', 'i'], _SEED)}, {mix_items('lo', ['rep', 'i'], _SEED + 1)}
          FROM e, (SELECT unnest(range(1, 10001)) AS rep)),
    s AS (SELECT rep, sqrt(avg(error_b)) - sqrt(avg(error_a)) AS change
          FROM (SELECT rep, (hi * 2147483647 + lo) % n AS pick FROM u, n) x JOIN e ON e.i = x.pick GROUP BY rep),
    p AS (SELECT count(*) AS drawings, sqrt(avg(error_a)) AS a, sqrt(avg(error_b)) AS b FROM errors)
    SELECT any_value(drawings) AS drawings, {sql6('any_value(a)', 'rmse_a')}, {sql6('any_value(b)', 'rmse_b')},
           {sql6('any_value(b) - any_value(a)', 'rmse_change')}, {sql6('quantile_cont(change, 0.025)', 'ci_low')},
           {sql6('quantile_cont(change, 0.975)', 'ci_high')}, count(*) AS resamples FROM s, p""")
def paired_bootstrap_ci(spark, sf):
    out = A.paired_bootstrap(view(spark, sf, "errors"), seed=_SEED)
    return out.select("drawings", *(r6(F.col(c), c) for c in ("rmse_a", "rmse_b", "rmse_change", "ci_low", "ci_high")), "resamples")


@query("paired_permutation_p", ("errors",), f"""
    , d AS (SELECT id, error_b - error_a AS d FROM errors), o AS (SELECT abs(sum(d)) AS o, count(*) AS n, avg(d) AS m FROM d),
    u AS (SELECT rep, d, {mix_items('coin', ['rep', 'id'], _SEED)} FROM d, (SELECT unnest(range(1, 10001)) AS rep)),
    s AS (SELECT rep, sum(CASE WHEN (coin // 1024) % 2 = 0 THEN d ELSE -d END) AS s FROM u GROUP BY rep)
    SELECT any_value(n) AS drawings, {sql6('any_value(m)', 'mse_change')},
           {sql6('(count(*) FILTER (abs(s) >= o - 1e-12) + 1) / (count(*) + 1)', 'p_value')},
           {sql6('least(1, 5 * (count(*) FILTER (abs(s) >= o - 1e-12) + 1) / (count(*) + 1))', 'p_bonferroni')} FROM s, o""")
def paired_permutation_p(spark, sf):
    out = A.paired_permutation(view(spark, sf, "errors"), seed=_SEED)
    return out.select("drawings", *(r6(F.col(c), c) for c in ("mse_change", "p_value", "p_bonferroni")))


# --- isolation ---
_DROPS = """
    m AS (SELECT id, dimension, avg(score) AS base FROM baseline_scores GROUP BY ALL),
    d AS (SELECT v.*, half_even(100 * base - 100 * score, 1) AS dropped,
                 CASE WHEN target IS NULL THEN 'control' WHEN changed_px >= 0 AND changed_px < 60 THEN 'invalid' ELSE 'error' END AS status
          FROM variant_scores v JOIN m USING (id, dimension)),
    g AS (SELECT id, kind, variant, any_value(target) AS target, any_value(status) AS status, any_value(changed_px) AS changed_px,
                 coalesce(max(CASE WHEN dimension = target THEN greatest(0, dropped) END), 0) AS sens,
                 coalesce(max(CASE WHEN dimension <> target THEN greatest(0, dropped) END), 0) AS leak,
                 coalesce(sum(CASE WHEN dimension <> target THEN greatest(0, dropped) END), 0) AS leaks, max(dropped) AS top
          FROM d GROUP BY id, kind, variant),
    iso AS (SELECT *, CASE WHEN sens + leaks > 0 THEN 100 * sens / (sens + leaks) ELSE 0 END AS spec FROM g)"""
_VIEWS = ("baseline_scores", "variant_scores")


def _drops(spark, sf):
    return I.drops(view(spark, sf, "baseline_scores"), view(spark, sf, "variant_scores"))


@query("isolation_rows", _VIEWS, """
    SELECT id, kind, variant, CASE WHEN status = 'invalid' THEN 'invalid' ELSE coalesce(target, '') END AS target,
           CASE WHEN status = 'error' THEN half_even(sens, 1) END AS sensitivity,
           CASE WHEN status = 'error' THEN half_even(leak, 1) WHEN status = 'control' THEN half_even(top, 1) END AS worst_leak,
           CASE WHEN status = 'error' THEN half_even(spec, 1) END AS specificity,
           CASE WHEN status = 'error' THEN half_even(spec * least(1, sens / 15), 1) END AS isolation, changed_px FROM iso""", _DROPS)
def isolation_rows(spark, sf):
    return I.isolation_rows(_drops(spark, sf))


@query("isolation_matrix", _VIEWS, "SELECT target, " + ", ".join(
    f"half_even(avg(dropped) FILTER (dimension = '{d}'), 1) AS {d}" for d in CORRECTNESS) + " FROM d WHERE status = 'error' GROUP BY ALL", _DROPS)
def isolation_matrix(spark, sf):
    return I.isolation_matrix(_drops(spark, sf))


@query("isolation_summary", _VIEWS, """
    , off AS (SELECT target, half_even(avg(abs(dropped)) FILTER (dimension <> target), 1) AS off_target_mean_abs FROM d WHERE status = 'error' GROUP BY ALL)
    SELECT target, count(*) AS variants, half_even(avg(half_even(spec * least(1, sens / 15), 1)), 1) AS isolation,
           half_even(100 * count(*) FILTER (sens >= 15) / count(*), 0) AS caught_pct, count(*) FILTER (top < 15) AS missed,
           any_value(off_target_mean_abs) AS off_target_mean_abs
    FROM iso JOIN off USING (target) WHERE status = 'error' GROUP BY ALL""", _DROPS)
def isolation_summary(spark, sf):
    return I.isolation_summary(_drops(spark, sf), by=["target"])


@query("isolation_warnings", _VIEWS, """
    SELECT id, kind, variant, target, dimension, dropped AS drop,
           CASE WHEN dimension = target THEN 'WEAK' ELSE 'LEAK' END AS warning
    FROM d WHERE target IS NOT NULL AND ((dimension = target AND dropped < 15) OR (dimension <> target AND dropped >= 15))""", _DROPS)
def isolation_warnings(spark, sf):
    return I.isolation_warnings(_drops(spark, sf))


@query("control_drops", _VIEWS, """
    SELECT kind, dimension, half_even(avg(dropped), 1) AS mean_drop FROM d WHERE target IS NULL GROUP BY ALL""", _DROPS)
def control_drops(spark, sf):
    return I.control_drops(_drops(spark, sf))


@query("controls_pass", _VIEWS, "SELECT id, kind, min(100 * score) >= 85 AS passes FROM variant_scores WHERE target IS NULL GROUP BY ALL")
def controls_pass(spark, sf):
    rows = view(spark, sf, "variant_scores").filter("target is null").withColumn("score", 100 * F.col("score"))
    return I.controls_pass(rows, ["id", "kind"])


@query("baseline_noise", _VIEWS, """
    , n AS (SELECT id, dimension, stddev_pop(score) AS sd FROM baseline_scores GROUP BY ALL HAVING count(*) > 1)
    SELECT dimension, half_even(avg(100 * sd), 1) AS noise_sd FROM n GROUP BY ALL""")
def baseline_noise(spark, sf):
    return I.baseline_noise(view(spark, sf, "baseline_scores"))


@query("isolation_examples", _VIEWS, """
    , e AS (SELECT kind, id, variant, half_even(sens, 1) AS s, half_even(spec * least(1, sens / 15), 1) AS i FROM iso WHERE status = 'error'),
    r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY s DESC, id, variant) AS b, row_number() OVER (PARTITION BY kind ORDER BY i, id, variant) AS w FROM e)
    SELECT kind, max(id) FILTER (b = 1) AS best_id, max(variant) FILTER (b = 1) AS best_variant,
           max(id) FILTER (w = 1) AS worst_id, max(variant) FILTER (w = 1) AS worst_variant FROM r GROUP BY ALL""", _DROPS)
def isolation_examples(spark, sf):
    return I.extremes(I.isolation_rows(_drops(spark, sf)), "kind", ["id", "variant"])


@query("delta_table", _VIEWS, f"""
    , s AS (SELECT id, kind AS variant, dimension, avg(score) AS score FROM variant_scores GROUP BY ALL
            UNION ALL SELECT id, 'baseline', dimension, avg(score) FROM baseline_scores GROUP BY ALL),
    a AS (SELECT * FROM s UNION ALL SELECT id, variant, 'overall', avg(score) FROM s GROUP BY ALL)
    SELECT a.id, a.variant, a.dimension, {sql6('a.score', 'score')}, {sql6('a.score - b.score', 'delta')}
    FROM a LEFT JOIN a b ON a.id = b.id AND a.dimension = b.dimension AND b.variant = 'baseline'""")
def delta_table(spark, sf):
    rows = view(spark, sf, "variant_scores").select("id", F.col("kind").alias("variant"), "dimension", "score").unionByName(
        view(spark, sf, "baseline_scores").select("id", F.lit("baseline").alias("variant"), "dimension", "score"))
    scores = rows.groupBy("id", "variant", "dimension").agg(F.avg("score").alias("score"))
    overall = scores.groupBy("id", "variant").agg(F.avg("score").alias("overall"))
    return I.delta_table(scores, overall).select("id", "variant", "dimension", r6(F.col("score"), "score"), r6(F.col("delta"), "delta"))
