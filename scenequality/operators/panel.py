"""Panel scoring: criterion scores, medians over judges, weights, votes and disagreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from scenequality.functions.geometry import half_even
from scenequality.functions.labels import labels_match
from scenequality.schemas import DRAWN, LINKED, SEVERITY_MULTIPLIERS, STATUSES, VERDICTS


# --- A1 ---
def metric_score(expected: Column, issues: Column, measurable: Column | None = None) -> Column:
    """Share of opportunities without an issue, in [0, 1]; null when nothing could be measured."""
    usable = expected > 0 if measurable is None else (expected > 0) & measurable
    share = (expected - F.greatest(issues, F.lit(0))) / expected
    return F.when(usable, F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))


def penalised(score: Column, issues: Column, error_factor: float | None) -> Column:
    """Each issue also multiplies the score by ``error_factor``; null or 0 means no penalty."""
    if not error_factor:
        return score
    return F.least(score, F.pow(F.lit(float(error_factor)), issues.cast("double")))


# --- A9 ---
def criterion_panel(scores: DataFrame, criteria: DataFrame, error_factor: float | None = None,
                    key: str = "diagram_id") -> DataFrame:
    """Median over judges per criterion.

    Judges are first counted per distinct score, so the median sees (score, count) cells and a
    criterion answered by very many judges never travels row by row.
    """
    rubric = criteria.select("criterion_id", "dimension")
    measured = (
        scores.withColumn("score", metric_score(F.col("expected_count"), F.col("detected_issues")))
        .filter(F.col("score").isNotNull())
        .withColumn("score", penalised(F.col("score"), F.col("detected_issues"), error_factor))
    )
    cells = measured.groupBy(key, "criterion_id", "score").agg(F.count(F.lit(1)).alias("n"))
    medians = cells.groupBy(key, "criterion_id").agg(F.percentile("score", F.lit(0.5), F.col("n")).alias("score"))
    return medians.join(rubric, "criterion_id").select(key, "dimension", "criterion_id", "score")


def aggregate_panel(scores: DataFrame, criteria: DataFrame, reducer: str = "mean",
                    error_factor: float | None = None, key: str = "diagram_id") -> DataFrame:
    """Criterion medians reduced to one score per dimension (mean or minimum)."""
    if reducer not in ("mean", "minimum"):
        raise ValueError(f"unknown dimension reducer: {reducer}")
    by_criterion = criterion_panel(scores, criteria, error_factor, key)
    reduce = F.avg if reducer == "mean" else F.min
    return by_criterion.groupBy(key, "dimension").agg(
        reduce("score").alias("score"), F.count(F.lit(1)).alias("criteria"))


def panel_judges(scores: DataFrame, criteria: DataFrame, key: str = "diagram_id") -> DataFrame:
    """The judges behind each dimension score, one row each."""
    measured = scores.filter(F.col("expected_count") > 0).select(key, "criterion_id", "judge")
    return measured.join(criteria.select("criterion_id", "dimension"), "criterion_id").select(
        key, "dimension", "judge").distinct()


# --- A10, A11, A12 ---
def _multiplier(severity: Column, multipliers: dict[str, float]) -> Column:
    table = F.create_map(*[F.lit(v) for pair in multipliers.items() for v in pair])
    known = table[severity]
    return F.when(known.isNull(), F.raise_error(F.concat(F.lit("unknown severity: "), severity))).otherwise(known)


def _normalised(totals: DataFrame) -> DataFrame:
    """Weights over a dimension-sized table (one row per dimension, at most a handful)."""
    everything = Window.partitionBy(F.lit(1))
    total = F.sum("total").over(everything)
    checked = F.when(total > 0, F.col("total") / total).otherwise(
        F.raise_error(F.lit("no dimension has a positive weight")).cast("double"))
    return totals.select("dimension", checked.alias("weight"))


def severity_weights(criteria: DataFrame, multipliers: dict[str, float] = SEVERITY_MULTIPLIERS) -> DataFrame:
    value = _multiplier(F.col("severity"), multipliers)
    return _normalised(criteria.groupBy("dimension").agg(F.max(value).alias("total")))


def history_weights(history: DataFrame, dimensions: DataFrame, multipliers: dict[str, float] = SEVERITY_MULTIPLIERS,
                    fallback: dict[str, float] | None = None) -> DataFrame:
    """Issue counts times severity; the fallback frequencies when the history adds up to nothing."""
    count = F.greatest(F.lit(0.0), F.coalesce(F.col("count").cast("double"), F.lit(1.0)))
    value = count * _multiplier(F.coalesce(F.col("severity"), F.lit("medium")), multipliers)
    seen = history.groupBy("dimension").agg(F.sum(value).alias("seen"))
    every = dimensions.select("dimension").distinct().join(seen, "dimension", "left")
    if fallback is None:
        spare = F.lit(1.0)
    else:
        spare = F.coalesce(F.create_map(*[F.lit(v) for pair in fallback.items() for v in pair])[F.col("dimension")], F.lit(0.0))
    grand = F.coalesce(F.sum("seen").over(Window.partitionBy(F.lit(1))), F.lit(0.0))
    total = F.when(grand > 0, F.coalesce("seen", F.lit(0.0))).otherwise(F.greatest(F.lit(0.0), spare))
    return _normalised(every.select("dimension", total.alias("total")))


def equal_weights(criteria: DataFrame) -> DataFrame:
    return _normalised(criteria.select("dimension").distinct().withColumn("total", F.lit(1.0)))


def resolve_weights(scheme: str, criteria: DataFrame, history: DataFrame | None = None, **options) -> DataFrame:
    if scheme == "auto":
        scheme = "severity" if history is None or history.isEmpty() else "history"
    if scheme == "severity":
        return severity_weights(criteria, options.get("multipliers", SEVERITY_MULTIPLIERS))
    if scheme == "history":
        return history_weights(history, criteria, options.get("multipliers", SEVERITY_MULTIPLIERS), options.get("fallback"))
    if scheme == "equal":
        return equal_weights(criteria)
    raise ValueError(f"unknown weighting: {scheme}")


def weighted_overall(dimension_scores: DataFrame, weights: DataFrame, key: str = "diagram_id") -> DataFrame:
    """Weighted mean over the dimensions that have a score (weights renormalised over those)."""
    joined = dimension_scores.join(weights, "dimension")
    return joined.groupBy(key).agg(
        (F.sum(F.col("weight") * F.col("score")) / F.sum("weight")).alias("overall"),
        F.count(F.lit(1)).alias("dimensions"))


# --- A13 ---
def direct_overall(scores: DataFrame, key: list[str], dimensions: int = 5) -> DataFrame:
    """Mean of the direct scores, only where every dimension was answered."""
    per = scores.groupBy(*key, "dimension").agg(F.max("score").alias("score"))
    return (per.groupBy(*key).agg(F.avg("score").alias("overall"), F.count(F.lit(1)).alias("_n"))
            .filter(F.col("_n") == dimensions).drop("_n"))


# --- A2, A3, A4, A5 ---
def component_metrics(verdicts: DataFrame, typical: DataFrame | None = None, key: list[str] = ("diagram_id", "judge")) -> DataFrame:
    """Presence (fails when absent) and details (fails when mislabeled) counts per judge."""
    key = list(key)
    tagged = _typical(verdicts, typical, "component_id")
    drawn = F.col("verdict").isin(*DRAWN) & F.col("label_legible")
    scored = (F.col("verdict") != "uncertain") & ~F.col("typical")
    counts = tagged.groupBy(*key).agg(
        F.count_if(scored).alias("presence_expected"),
        F.count_if(scored & (F.col("verdict") == "absent")).alias("presence_issues"),
        F.count_if(drawn).alias("details_expected"),
        F.count_if(drawn & (F.col("verdict") == "mislabeled")).alias("details_issues"))
    return _long(counts, key, {
        ("presence.elements", "presence"): ("presence_expected", "presence_issues"),
        ("details.labels", "details"): ("details_expected", "details_issues")})


def _typical(df: DataFrame, typical: DataFrame | None, item: str) -> DataFrame:
    if typical is None:
        return df if "typical" in df.columns else df.withColumn("typical", F.lit(False))
    marks = typical.select("diagram_id", item, F.lit(True).alias("_typical")).distinct()
    return (df.join(marks, ["diagram_id", item], "left")
            .withColumn("typical", F.coalesce("_typical", F.lit(False))).drop("_typical"))


def _long(counts: DataFrame, key: list[str], layout: dict) -> DataFrame:
    """Wide (expected, issues) pairs to metric rows."""
    rows = F.array(*(F.struct(
        F.lit(criterion).alias("criterion_id"), F.lit(dimension).alias("dimension"),
        F.col(expected).cast("bigint").alias("expected_count"), F.col(issues).cast("bigint").alias("detected_issues"))
        for (criterion, dimension), (expected, issues) in layout.items()))
    return counts.select(*key, F.inline(rows))


def drawn_connections(connections: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Connections whose two components are both drawn (R4)."""
    drawn = verdicts.filter(F.col("verdict").isin(*DRAWN)).select("diagram_id", "judge", "component_id").distinct()
    both = connections.join(drawn.withColumnRenamed("component_id", "source"), ["diagram_id", "judge", "source"], "left_semi")
    return both.join(drawn.withColumnRenamed("component_id", "target"), ["diagram_id", "judge", "target"], "left_semi")


def connection_metrics(connections: DataFrame, verdicts: DataFrame, extras: DataFrame | None = None,
                       others: DataFrame | None = None, typical: DataFrame | None = None,
                       accept_abbreviations: bool = False) -> DataFrame:
    """Recall, precision and label counts from per-connection verdicts.

    ``extras`` and ``others`` hold one row per extra arrow and per fitting arrow off the list.
    Labels are compared on ``expected_norm`` / ``visible_norm`` (normalised beforehand).
    """
    key = ["diagram_id", "judge"]
    rows = _typical(drawn_connections(connections, verdicts), typical, "connection_id")
    status = F.col("status")
    linked = status.isin(*LINKED)
    labeled = linked & (F.trim("expected_label") != "") & F.col("label_legible")
    wrong = ~labels_match(F.col("visible_norm"), F.col("expected_norm"), accept_abbreviations)
    per = rows.groupBy(*key).agg(
        F.count_if(~F.col("typical")).alias("recall_expected"),
        F.count_if(~F.col("typical") & status.isin("absent", "uncertain")).alias("recall_issues"),
        F.count_if(linked).alias("drawn"),
        F.count_if((status == "reversed") & ~F.col("typical")).alias("reversed"),
        F.count_if(labeled).alias("label_expected"),
        F.count_if(labeled & wrong).alias("label_issues"))
    for frame, name in ((extras, "extra"), (others, "other")):
        if frame is None:
            per = per.withColumn(name, F.lit(0))
        else:
            per = per.join(frame.groupBy(*key).agg(F.count(F.lit(1)).alias(name)), key, "full")
    zero = {c: 0 for c in per.columns if c not in key}
    per = (per.fillna(zero).withColumn("precision_expected", F.col("drawn") + F.col("other") + F.col("extra"))
           .withColumn("precision_issues", F.col("reversed") + F.col("extra")))
    return _long(per, key, {
        ("connectivity.connections", "connectivity"): ("recall_expected", "recall_issues"),
        ("connectivity.endpoints", "connectivity"): ("precision_expected", "precision_issues"),
        ("details.connection_labels", "details"): ("label_expected", "label_issues")})


def legibility_metric(verdicts: DataFrame, connections: DataFrame) -> DataFrame:
    """Readable-text rate over drawn labels, plus components too blurred to decide."""
    key = ["diagram_id", "judge"]
    shown = F.col("verdict").isin(*DRAWN) & (F.trim("visible_text") != "")
    blurred = F.col("verdict") == "uncertain"
    texts = verdicts.filter(shown | blurred).select(*key, (blurred | ~F.col("label_legible")).alias("bad"))
    arrows = drawn_connections(connections, verdicts).filter(
        F.col("status").isin(*LINKED) & ((F.trim("visible_label") != "") | (F.trim("expected_label") != "")))
    items = texts.unionByName(arrows.select(*key, (~F.col("label_legible")).alias("bad")))
    per = items.groupBy(*key).agg(F.count(F.lit(1)).alias("expected"), F.count_if("bad").alias("issues"))
    return _long(per, key, {("legibility.minimum_font", "legibility"): ("expected", "issues")})


def unexpected_metric(verdicts: DataFrame, extras: DataFrame, others: DataFrame) -> DataFrame:
    """Precision over drawn components: drawn, fitting detail and extra ones; extras fail."""
    key = ["diagram_id", "judge"]
    drawn = verdicts.filter(F.col("verdict").isin(*DRAWN)).select(*key, "component_id").distinct()
    tagged = (drawn.select(*key, F.lit(0).alias("extra"))
              .unionByName(others.select(*key, F.lit(0).alias("extra")))
              .unionByName(extras.select(*key, F.lit(1).alias("extra"))))
    per = tagged.groupBy(*key).agg(F.count(F.lit(1)).alias("expected"), F.sum("extra").alias("issues"))
    return _long(per, key, {("presence.unexpected", "presence"): ("expected", "issues")})


# --- A6 ---
def counted_metrics(counted: DataFrame, verdicts: DataFrame, connections: DataFrame, criteria: DataFrame,
                    extra_components: DataFrame, other_components: DataFrame, extra_arrows: DataFrame,
                    other_arrows: DataFrame, order_links: DataFrame) -> DataFrame:
    """Counted criteria over denominators taken from the verdicts; issues never exceed them.

    ``order_links``: expected connections (diagram_id, source, target) that count for order, i.e.
    required, not a loop back, and not a self link.
    """
    key = ["diagram_id", "judge"]
    drawn = verdicts.filter(F.col("verdict").isin(*DRAWN))
    links = drawn_connections(connections, verdicts).filter(F.col("status").isin(*LINKED))
    judges = verdicts.select(*key).distinct()
    ordered = drawn_connections(order_links.join(judges, "diagram_id"), verdicts)
    one = lambda flag, name: F.lit(1 if flag else 0).alias(name)
    kinds = ("box", "arrow", "text", "order")

    def part(df, *on, text=None):
        cols = [one(k in on, k) for k in kinds if k != "text" or text is None]
        if text is not None:
            cols.append(text.cast("int").alias("text"))
        return df.select(*key, *cols)

    parts = [
        part(drawn, "box", text=F.trim("visible_text") != ""),
        part(other_components, "box", text=F.col("visible_text") != ""),
        part(extra_components, "box"),
        part(links, "arrow", text=F.trim("visible_label") != ""),
        part(other_arrows, "arrow"), part(extra_arrows, "arrow"), part(ordered, "order"),
    ]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    sums = union.groupBy(*key).agg(*(F.sum(k).alias(k) for k in kinds))
    opportunity = (
        F.when(F.col("metric") == "description_order", F.col("order"))
        .when(F.col("metric") == "canvas_bounds", F.col("box") + F.col("arrow"))
        .when(F.col("metric") == "unintended_overlap", F.col("box"))
        .when(F.col("metric") == "connector_routing", F.col("arrow"))
        .when(F.col("metric").isin("text_overflow", "text_contrast"), F.col("text")))
    rows = counted.join(criteria.select("criterion_id", "dimension", "metric"), "criterion_id").join(sums, key, "left")
    expected = F.coalesce(opportunity, F.lit(0)).cast("bigint")
    return rows.select(*key, "criterion_id", "dimension", expected.alias("expected_count"),
                       F.least(F.col("detected_issues").cast("bigint"), expected).alias("detected_issues"))


# --- A14 ---
def vote(samples: DataFrame, keys: list[str], value: str, order: tuple[str, ...] = VERDICTS,
         sample: str = "sample_no", carried: list[str] = ()) -> DataFrame:
    """Most common value per item; a tie takes the lower median on ``order``.

    The first sample with the winning value is the carrier: its ``carried`` columns go along.
    Two partial aggregations; the second one sees at most ``len(order)`` rows per item.
    """
    carrier = F.struct(F.col(sample).alias("sample_no"), *carried)
    cells = samples.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(carrier).alias("carrier"))
    pick = lambda v, what: F.max(F.when(F.col(value) == v, F.col(what)))
    counts = {v: F.coalesce(pick(v, "n"), F.lit(0)) for v in order}
    wide = cells.groupBy(*keys).agg(
        *(counts[v].alias(f"n_{v}") for v in order), *(pick(v, "carrier").alias(f"c_{v}") for v in order))
    top = F.greatest(*(F.col(f"n_{v}") for v in order))
    winners = sum((F.when(F.col(f"n_{v}") == top, 1).otherwise(0) for v in order), F.lit(0))
    total = sum((F.col(f"n_{v}") for v in order), F.lit(0))
    middle = F.floor((total - 1) / 2)
    seen, lower = F.lit(0), None
    for v in order:
        seen = seen + F.col(f"n_{v}")
        lower = F.when(seen > middle, F.lit(v)) if lower is None else lower.when(seen > middle, F.lit(v))
    single = None
    for v in order:
        single = F.when(F.col(f"n_{v}") == top, F.lit(v)) if single is None else single.when(F.col(f"n_{v}") == top, F.lit(v))
    result = wide.withColumn(value, F.when(winners == 1, single).otherwise(lower)).withColumn("samples", total)
    chosen = None
    for v in order:
        chosen = F.when(F.col(value) == v, F.col(f"c_{v}")) if chosen is None else chosen.when(F.col(value) == v, F.col(f"c_{v}"))
    return result.withColumn("_c", chosen).select(*keys, value, "samples", "_c.*")


def majority_flag(yes: Column, no: Column, carrier: Column) -> Column:
    """Majority of a flag; a tie keeps the carrier's own."""
    return F.when(yes != no, yes > no).otherwise(carrier)


def merge_verdicts(samples: DataFrame, keys: list[str], value: str, order=VERDICTS, carried: list[str] = ()) -> DataFrame:
    """A14 in full: voted value, carrier columns and the legible majority."""
    voted = vote(samples, keys, value, order, carried=[*carried, "label_legible"])
    legible = samples.groupBy(*keys).agg(
        F.count_if("label_legible").alias("_yes"), F.count_if(~F.col("label_legible")).alias("_no"))
    return (voted.join(legible, keys)
            .withColumn("label_legible", majority_flag(F.col("_yes"), F.col("_no"), F.col("label_legible")))
            .drop("_yes", "_no"))


# --- A15 ---
def median_low_counts(samples: DataFrame, keys: list[str], value: str = "detected_issues",
                      sample: str = "sample_no") -> DataFrame:
    """Lower median of a count per item, with the first sample that reported it."""
    middle = samples.groupBy(*keys).agg(
        F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value})").cast("bigint").alias("_middle"))
    hit = samples.join(middle, keys).filter(F.col(value) == F.col("_middle"))
    return hit.groupBy(*keys).agg(F.max("_middle").alias(value), F.min(sample).alias("carrier"))


def median_sample(lengths: DataFrame, keys: list[str], length: str = "length", sample: str = "sample_no") -> DataFrame:
    """The sample of lower-median length; ``lengths`` has one row per sample of one question."""
    whole = Window.partitionBy(*keys)
    ranked = lengths.withColumn("_rank", F.row_number().over(whole.orderBy(length, sample)))
    return (ranked.withColumn("_n", F.count(F.lit(1)).over(whole))
            .filter(F.col("_rank") == F.floor((F.col("_n") + 1) / 2)).select(*keys, sample, length))


# --- A16, A17 ---
def criterion_disagreements(scores: DataFrame, order: str, threshold: float = 0.25, key: str = "diagram_id") -> DataFrame:
    """Criteria on which two judges differ by at least ``threshold``; a judge's later row wins."""
    measured = scores.withColumn("score", metric_score(F.col("expected_count"), F.col("detected_issues")))
    last = measured.filter(F.col("score").isNotNull()).groupBy(key, "criterion_id", "judge").agg(
        F.max_by("score", order).alias("score"))
    spread = F.max("score") - F.min("score")
    rows = last.groupBy(key, "criterion_id").agg(
        F.count(F.lit(1)).alias("judges"), F.min("score").alias("lowest"), F.max("score").alias("highest"),
        spread.alias("spread"))
    return rows.filter((F.col("judges") >= 2) & (F.col("spread") >= threshold)).withColumn(
        "spread", half_even(F.col("spread"), 4))


def component_agreement(verdicts: DataFrame, keys: list[str] = ("diagram_id", "component_id"), order: str | None = None) -> DataFrame:
    """How many judges gave each verdict to a component, and whether they all agree."""
    keys = list(keys)
    if order is not None:
        verdicts = verdicts.groupBy(*keys, "judge").agg(F.max_by("verdict", order).alias("verdict"))
    votes = verdicts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("judges"), *(F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS))
    kinds = sum((F.when(F.col(v) > 0, 1).otherwise(0) for v in VERDICTS), F.lit(0))
    return votes.withColumn("agree", kinds <= 1)


# --- A20, A21, A22 ---
def repeat_summary(runs: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Rounded mean and population deviation over repeated runs."""
    return runs.groupBy(*keys).agg(
        half_even(F.avg(score), 0).alias("score"), half_even(F.stddev_pop(score), 1).alias("std"),
        F.count(F.lit(1)).alias("runs"))


def usage_totals(usage: DataFrame, by: list[str] = ()) -> DataFrame:
    return usage.groupBy(*by).agg(F.sum("calls").alias("calls"), F.sum("input_tokens").alias("input_tokens"),
                                  F.sum("output_tokens").alias("output_tokens"))


def run_noise(first: DataFrame, second: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Identical and within-one counts between two runs of the same questions."""
    pairs = first.withColumnRenamed("score", "a").join(second.withColumnRenamed("score", "b"), keys)
    return pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") == F.col("b")).alias("identical"),
        F.count_if(F.abs(F.col("a") - F.col("b")) <= 1).alias("within_1"))


# --- A23 ---
def sketch_check(items: DataFrame, drawings: DataFrame, by: str = "group") -> DataFrame:
    """Items per sketch, share shown, and drawings missing a component or a connection."""
    per = items.groupBy("diagram_id").agg(
        F.count(F.lit(1)).alias("items"), F.count_if("shown").alias("shown"),
        F.max((~F.col("shown") & (F.col("kind") == "C")).cast("int")).alias("component_missing"),
        F.max((~F.col("shown") & (F.col("kind") == "E")).cast("int")).alias("connection_missing"))
    return per.join(drawings.select("diagram_id", by), "diagram_id").groupBy(by).agg(
        F.count(F.lit(1)).alias("drawings"), (F.sum("items") / F.count(F.lit(1))).alias("items_per_sketch"),
        (F.sum("shown") / F.sum("items")).alias("share_shown"),
        F.sum("component_missing").alias("component_not_shown"),
        F.sum("connection_missing").alias("connection_not_shown"))
