"""Judge-versus-human statistics.

Everything starts from *cells*: one partial aggregation of the pairs to (group, human, judge, n).
Scores live on short scales, so cells are far fewer than pairs, and every later step (moments,
ranks, tau, separation, grouping sets) runs on cells with weights. Rank-like statistics use
bucketed running totals, so even a group with very many distinct scores is never one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scenequality.operators.running import CROWDED, PRIME, _join_keys, positions, running_before, top_n, with_mix
from scenequality.schemas import BEAUTY, CAUGHT_BELOW, CORRECTNESS
from scenequality.session import cut_lineage


def score_cells(pairs: DataFrame, by: list[str], human: str = "human", judge: str = "judge") -> DataFrame:
    """Distinct (group, human, judge) cells with counts; incomplete pairs are left out."""
    return (pairs.filter(F.col(human).isNotNull() & F.col(judge).isNotNull())
            .groupBy(*by, F.col(human).cast("double").alias("human"), F.col(judge).cast("double").alias("judge"))
            .agg(F.count(F.lit(1)).alias("n")))


def grouped_cells(cells: DataFrame, sets: list[list[str]]) -> DataFrame:
    """T6: grouping sets over the cells; a column outside the set is null."""
    every = list(dict.fromkeys(c for s in sets for c in s))
    rolled = cells.groupingSets(
        [[F.col(c) for c in [*s, "human", "judge"]] for s in sets],
        *[F.col(c) for c in [*every, "human", "judge"]],
    ).agg(F.sum("n").alias("n"), F.grouping_id().alias("grouping"))
    return rolled


# --- T1, T2 ---
def agreement(cells: DataFrame, by: list[str]) -> DataFrame:
    """n, means, MAE, RMSE, bias, within-1 and Pearson with a 95 % interval; only n below three pairs."""
    n, h, j = F.col("n").cast("double"), F.col("human"), F.col("judge")
    d = j - h
    sums = cells.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum(n * h).alias("_h"), F.sum(n * j).alias("_j"),
        F.sum(n * h * h).alias("_hh"), F.sum(n * j * j).alias("_jj"), F.sum(n * h * j).alias("_hj"),
        F.sum(n * F.abs(d)).alias("_ad"), F.sum(n * d * d).alias("_dd"), F.sum(n * d).alias("_d"),
        F.sum(F.when(F.abs(d) <= 1, F.col("n")).otherwise(0)).alias("_w"),
        (F.min("human") == F.max("human")).alias("_ch"), (F.min("judge") == F.max("judge")).alias("_cj"))
    total = F.col("n").cast("double")
    enough = F.col("n") >= 3
    cov = F.col("_hj") - F.col("_h") * F.col("_j") / total
    var = (F.col("_hh") - F.col("_h") * F.col("_h") / total) * (F.col("_jj") - F.col("_j") * F.col("_j") / total)
    r = F.when(enough & ~F.col("_ch") & ~F.col("_cj"), cov / F.sqrt(var))
    out = sums.select(
        *by, "n", *(F.when(enough, v).alias(name) for name, v in (
            ("human_mean", F.col("_h") / total), ("judge_mean", F.col("_j") / total), ("mae", F.col("_ad") / total),
            ("rmse", F.sqrt(F.col("_dd") / total)), ("bias", F.col("_d") / total), ("within_1", F.col("_w") / total),
            ("human_sd", F.sqrt(F.greatest(F.lit(0.0), F.col("_hh") / total - F.pow(F.col("_h") / total, F.lit(2.0)))))
        )), r.alias("pearson"))
    return with_fisher_interval(out)


def with_fisher_interval(df: DataFrame, r: str = "pearson", n: str = "n") -> DataFrame:
    usable = (F.col(n) > 3) & (F.abs(F.col(r)) < 1)
    half = 1.96 / F.sqrt(F.col(n) - 3)
    return (df.withColumn("pearson_low", F.when(usable, F.tanh(F.atanh(F.col(r)) - half)))
            .withColumn("pearson_high", F.when(usable, F.tanh(F.atanh(F.col(r)) + half))))


# --- T3 ---
def settled(cells: DataFrame) -> tuple[DataFrame, int | None]:
    """Cells written once (they are read several times), and the crowding limit for their windows.

    Cells are tiny next to the pairs, so the pairs are read once. The count decides the plan: up to
    CROWDED cells in all, no group can be crowded and plain windows do.
    """
    cells = cut_lineage(cells)
    return cells, (None if cells.count() <= CROWDED else CROWDED)


def average_ranks(cells: DataFrame, by: list[str], value: str, weight: str = "n", crowded: int | None = CROWDED) -> DataFrame:
    """One row per distinct value of each group, with its average rank."""
    margin = cells.groupBy(*by, value).agg(F.sum(weight).alias("_w"))
    ranked = running_before(margin, by, value, "_w", "_before", crowded)
    return ranked.select(*by, value, (F.col("_before") + (F.col("_w") + 1) / 2).alias(f"{value}_rank"))


def spearman(cells: DataFrame, by: list[str]) -> DataFrame:
    """Pearson of average ranks; null below three pairs or when a side is constant."""
    cells, crowded = settled(cells)
    joined = _join_keys(cells, average_ranks(cells, by, "human", crowded=crowded), [*by, "human"])
    joined = _join_keys(joined, average_ranks(cells, by, "judge", crowded=crowded), [*by, "judge"])
    totals = cells.groupBy(*by).agg(F.sum("n").alias("_n"))
    joined = _join_keys(joined, totals, by)
    centre = (F.col("_n") + 1) / 2
    a, b, n = F.col("human_rank") - centre, F.col("judge_rank") - centre, F.col("n")
    sums = joined.groupBy(*by).agg(F.sum(n * a * b).alias("_ab"), F.sum(n * a * a).alias("_aa"),
                                   F.sum(n * b * b).alias("_bb"), F.sum("n").alias("n"))
    value = F.when((F.col("n") >= 3) & (F.col("_aa") > 0) & (F.col("_bb") > 0),
                   F.col("_ab") / F.sqrt(F.col("_aa") * F.col("_bb")))
    return sums.select(*by, "n", value.alias("spearman"))


# --- T4 ---
def kendall_tau_b(cells: DataFrame, by: list[str]) -> DataFrame:
    """Tau-b with ties in O(cells * log cells), without pairing cells.

    Human values become dense ranks. Two cells differ in human score exactly when their ranks
    share a binary prefix and then split at one level; at that level the lower half has bit 0.
    Per (group, level, prefix) a running total of bit-0 weight in judge order therefore counts
    concordant minus discordant pairs, each pair of cells at one level only.
    """
    cells, crowded = settled(cells)
    marks = cells.groupBy(*by, "human").agg(F.lit(1).alias("_one"))
    dense = running_before(marks, by, "human", "_one", "_dense", crowded).drop("_one")
    coded = _join_keys(cells, dense, [*by, "human"])
    span = coded.groupBy(*by).agg(F.max("_dense").alias("_max"))
    coded = _join_keys(coded, span, by)
    levels = F.sequence(F.lit(0), F.length(F.bin(F.col("_max"))) - 1)
    split = coded.withColumn("_level", F.explode(levels)).select(
        *by, "_level", F.call_function("shiftright", F.col("_dense"), F.col("_level") + 1).alias("_prefix"),
        F.call_function("shiftright", F.col("_dense"), F.col("_level")).bitwiseAND(F.lit(1)).alias("_bit"), "judge", "n")
    keys = [*by, "_level", "_prefix"]
    n = F.col("n")
    halves = split.groupBy(*keys, "judge").agg(
        F.sum(F.when(F.col("_bit") == 0, n).otherwise(0)).alias("_w0"),
        F.sum(F.when(F.col("_bit") == 1, n).otherwise(0)).alias("_w1"))
    running = running_before(halves, keys, "judge", "_w0", "_less", crowded)
    totals = halves.groupBy(*keys).agg(F.sum("_w0").alias("_all"))
    running = _join_keys(running, totals, keys)
    less, more = F.col("_less").cast("double"), F.col("_all") - F.col("_less") - F.col("_w0")
    score = running.groupBy(*by).agg(F.sum(F.col("_w1").cast("double") * (less - more)).alias("_s"))

    def tied(value, name):
        margin = cells.groupBy(*by, value).agg(F.sum("n").cast("double").alias("_m"))
        return margin.groupBy(*by).agg(F.sum(F.col("_m") * (F.col("_m") - 1) / 2).alias(name), F.sum("_m").alias(f"{name}_n"))

    out = _join_keys(_join_keys(score, tied("human", "_th"), by), tied("judge", "_tj"), by)
    total = F.col("_th_n") * (F.col("_th_n") - 1) / 2
    base = (total - F.col("_th")) * (total - F.col("_tj"))
    value = F.when((F.col("_th_n") >= 3) & (base > 0), F.col("_s") / F.sqrt(base))
    return out.select(*by, F.col("_th_n").cast("bigint").alias("n"), value.alias("kendall"))


# --- T5 ---
def auc(df: DataFrame, by: list[str], score: str = "score", positive: str = "positive") -> DataFrame:
    """How often a positive outscores a negative (ties count half); null if a class is empty."""
    cells = (df.filter(F.col(score).isNotNull()).groupBy(*by, F.col(score).cast("double").alias("_v"))
             .agg(F.count_if(F.col(positive)).alias("_p"), F.count_if(~F.col(positive)).alias("_q")))
    cells, crowded = settled(cells)
    ranked = running_before(cells, by, "_v", "_q", "_below", crowded)
    wins = F.col("_p").cast("double") * (F.col("_below") + F.col("_q") / 2)
    sums = ranked.groupBy(*by).agg(F.sum("_p").alias("positives"), F.sum("_q").alias("negatives"), F.sum(wins).alias("_wins"))
    value = F.when((F.col("positives") > 0) & (F.col("negatives") > 0),
                   F.col("_wins") / (F.col("positives").cast("double") * F.col("negatives")))
    return sums.select(*by, "positives", "negatives", value.alias("auc"))


# --- T7, T8 ---
def errors_caught(rows: DataFrame, cut: int = CAUGHT_BELOW) -> DataFrame:
    """Inserted errors of negative drawings whose dimension falls below ``cut``, with a total row.

    ``rows``: long scores (dimension, label, human, judge) with ``defects`` array of
    (defect, criterion); the dimension of a defect is the text before the first dot (P5).
    """
    defects = rows.filter((F.col("label") == "negative") & F.col("judge").isNotNull()).select(
        "dimension", "human", "judge", F.inline("defects"))
    hit = defects.filter(F.substring_index("criterion", ".", 1) == F.col("dimension"))
    out = hit.groupingSets(
        [[F.col("dimension"), F.col("defect")], []], F.col("dimension"), F.col("defect")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("human") < cut).alias("human_caught"),
        F.count_if(F.col("judge") < cut).alias("judge_caught"))
    return out.fillna("all", ["dimension", "defect"])


def false_alarms(rows: DataFrame, cut: int = CAUGHT_BELOW, clean: int = 9) -> DataFrame:
    alarm = (F.col("label") == "positive") & (F.col("human") >= clean) & (F.col("judge") < cut)
    return rows.groupBy("dimension").agg(F.count_if(alarm).alias("false_alarms"))


# --- P3 ---
def with_overall(rows: DataFrame, keys: list[str], sides: tuple[str, ...] = ("human", "judge")) -> DataFrame:
    """Append correctness_overall, beauty_overall and overall to long scores (null scores skipped)."""
    axis = F.when(F.col("dimension").isin(*CORRECTNESS), "correctness_overall").when(
        F.col("dimension").isin(*BEAUTY), "beauty_overall")
    axes = rows.groupBy(*keys, axis.alias("dimension")).agg(*(F.avg(s).alias(s) for s in sides))
    total = axes.groupBy(*keys).agg(*(F.avg(s).alias(s) for s in sides)).withColumn("dimension", F.lit("overall"))
    return rows.select(*keys, "dimension", *sides).unionByName(axes).unionByName(total)


# --- T9 ---
def validation_metrics(ids: DataFrame, humans: DataFrame, judged: DataFrame, dimensions: tuple[str, ...] = BEAUTY) -> DataFrame:
    """Pooled and per-dimension error, with every figure null unless each (id, dimension) was judged."""
    wanted = ids.select("id", F.explode(F.array(*map(F.lit, dimensions))).alias("dimension"))
    pairs = wanted.join(humans, ["id", "dimension"]).join(judged, ["id", "dimension"], "left")
    missing = pairs.filter(F.col("judge").isNull()).agg(F.count(F.lit(1)).alias("missing"))
    pooled = pairs.withColumn("dimension", F.lit("overall"))
    cells = score_cells(pairs.unionByName(pooled), ["dimension"])
    stats = _join_keys(agreement(cells, ["dimension"]), missing, [])
    whole = F.col("missing") == 0
    return stats.select("dimension", *(F.when(whole, F.col(c)).alias(c) for c in ("n", "rmse", "mae", "pearson")))


# --- T10, T11 ---
def numbered(errors: DataFrame, order: str = "id") -> DataFrame:
    """Dense 0-based position of each drawing (ordered by a numeric id)."""
    return positions(errors, [], [order])


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Few rows that each expand into many: hash them over all shuffle partitions first."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def paired_bootstrap(errors: DataFrame, draws: int = 10000, seed: int = 20261112) -> DataFrame:
    """Interval of the RMSE change over resampled drawings.

    ``errors``: one row per drawing (id, error_a, error_b) with mean squared errors. Draw ``i`` of
    replicate ``r`` picks a position mixed from (r, i): no state, so any task can be re-run.
    Replicate sums are combined map-side; only (task, replicate) partials are shuffled.
    """
    rows = cut_lineage(numbered(errors))
    n = rows.count()
    slots = spread(rows.select(F.col("position").alias("_i")), "_i")
    drawn = with_mix(slots.withColumn("_rep", F.explode(F.sequence(F.lit(1), F.lit(draws)))),
                     {"_hi": seed, "_lo": seed + 1}, "_rep", "_i")
    wide = F.col("_hi") * F.lit(PRIME).cast("bigint") + F.col("_lo")
    # never null, so the join adds no null check that would repeat the whole expression
    picks = drawn.select("_rep", F.coalesce(wide % n, F.lit(0)).alias("position"))
    sampled = picks.join(rows.select("position", "error_a", "error_b"), "position")
    per = sampled.groupBy("_rep").agg((F.sqrt(F.avg("error_b")) - F.sqrt(F.avg("error_a"))).alias("_change"))
    interval = per.agg(F.percentile("_change", F.lit(0.025)).alias("ci_low"),
                       F.percentile("_change", F.lit(0.975)).alias("ci_high"), F.count(F.lit(1)).alias("resamples"))
    point = rows.agg(F.count(F.lit(1)).alias("drawings"), F.sqrt(F.avg("error_a")).alias("rmse_a"),
                     F.sqrt(F.avg("error_b")).alias("rmse_b"))
    return _join_keys(point.withColumn("rmse_change", F.col("rmse_b") - F.col("rmse_a")), interval, [])


def paired_permutation(errors: DataFrame, draws: int = 10000, seed: int = 20261112, candidates: int = 5) -> DataFrame:
    """Two-sided sign-flip test of the summed error change, with a Bonferroni bound."""
    diff = errors.select("id", (F.col("error_b") - F.col("error_a")).alias("_d"))
    observed = diff.agg(F.abs(F.sum("_d")).alias("_observed"), F.count(F.lit(1)).alias("drawings"),
                        F.avg("_d").alias("mse_change"))
    flips = with_mix(spread(diff, "id").withColumn("_rep", F.explode(F.sequence(F.lit(1), F.lit(draws)))),
                     {"_coin": seed}, "_rep", "id")
    coin = F.floor(F.col("_coin") / 1024) % 2 == 0
    sums = flips.groupBy("_rep").agg(F.sum(F.when(coin, F.col("_d")).otherwise(-F.col("_d"))).alias("_sum"))
    tested = _join_keys(sums, observed, [])
    extreme = F.count_if(F.abs("_sum") >= F.col("_observed") - 1e-12)
    p = (extreme + 1) / (F.count(F.lit(1)) + 1)
    return tested.agg(F.max("drawings").alias("drawings"), F.max("mse_change").alias("mse_change"), p.alias("p_value"),
                      F.least(F.lit(1.0), p * candidates).alias("p_bonferroni"))


# --- T12, T13 ---
def worst_errors(rows: DataFrame, n: int = 20) -> DataFrame:
    """Drawings with the largest absolute difference; the earliest dimension wins a tie."""
    delta = F.abs(F.col("judge") - F.col("human"))
    per = rows.groupBy("id").agg(
        F.max(delta).alias("largest_delta"),
        F.min(F.struct((-delta).alias("d"), "position", "dimension")).alias("_w"))
    return (per.select("id", "largest_delta", F.col("_w.dimension").alias("worst_dimension"))
            .orderBy(F.desc("largest_delta"), "id").limit(n))


def corrections(original: DataFrame, corrected: DataFrame) -> DataFrame:
    both = original.withColumnRenamed("score", "original").join(
        corrected.withColumnRenamed("score", "corrected"), ["id", "dimension"])
    return both.filter(~F.col("original").eqNullSafe(F.col("corrected"))).select("id", "dimension", "original", "corrected")


# --- T19, T20 ---
def side_by_side(metrics: DataFrame, versions: list[str], higher: list[str]) -> DataFrame:
    """Metric rows by version columns, with the best value; ``higher`` names larger-is-better metrics."""
    wide = metrics.groupBy("metric").pivot("version", versions).agg(F.max("value"))
    columns = [F.col(f"`{v}`") for v in versions]
    pick = lambda f: f(*columns) if len(columns) > 1 else columns[0]
    return wide.withColumn("best", F.when(F.col("metric").isin(*higher), pick(F.greatest)).otherwise(pick(F.least)))


def rank_candidates(overall: DataFrame, n: int | None = None) -> DataFrame:
    """Rank of every candidate by overall score, ties by id; the best ``n`` if a caller wants a report of them."""
    order = [F.desc("overall"), F.asc("diagram_id")]
    if n is not None:
        return top_n(overall, [], order, n)
    return positions(overall, [], order, "rank").withColumn("rank", (F.col("rank") + 1).cast("int"))
