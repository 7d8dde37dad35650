"""Rating-study data work: balanced assignment, sets, leases, export and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scenequality.operators.running import _join_keys, mix, positions, top_n
from scenequality.schemas import LEVELS, SCORE_KEYS


# --- D7 ---
def seeded_position(df: DataFrame, keys: list[str], seed: int, ident: Column, out: str = "position") -> DataFrame:
    """Position of each row in a repeatable shuffle of its group."""
    drawn = df.withColumn("_u", mix(ident, seed=seed)).withColumn("_i", ident)
    return positions(drawn, keys, ["_u", "_i"], out).drop("_u", "_i")


# --- D1 ---
def balanced_assignment(items: DataFrame, participants: DataFrame, count: int, seed: int = 0,
                        levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """``count`` (20-30) distinct items per participant, balanced over difficulty, in shuffled order.

    ``items``: (item_no, id, difficulty); ``participants``: (participant_no, ...), numeric keys.
    Items are shuffled once per level. A participant draws a random start per level and takes the
    following items of that circular order, so the cost is participants x count rows, never
    participants x items. The remainder of ``count / 3`` goes to levels that have an item to spare.
    """
    if not 20 <= count <= 30:
        raise ValueError("assign between 20 and 30 items")
    base, extra = divmod(count, len(levels))
    known = items.filter(F.col("difficulty").isin(*levels))
    order = seeded_position(known, ["difficulty"], seed, F.col("item_no"))
    per = known.groupBy("difficulty").agg(F.count(F.lit(1)).alias("n"))
    # one row with the pool sizes; the feasibility rule stops the job here
    size = per.agg(*(F.coalesce(F.max(F.when(F.col("difficulty") == v, F.col("n"))), F.lit(0)).alias(v) for v in levels))
    spare = sum((F.when(F.col(v) > base, 1).otherwise(0) for v in levels), F.lit(0))
    enough = (F.least(*levels) >= base) & (spare >= extra)
    text = F.concat_ws(" ", F.lit(f"a {count}-item assignment needs at least {base} per difficulty"
                                  + (f", with {extra} of the groups having {base + 1} or more;" if extra else ";")),
                       *(F.concat(F.lit(f"{v}="), F.col(v).cast("string")) for v in levels))
    size = size.withColumn("_ok", F.when(enough, F.lit(True)).otherwise(F.raise_error(text).cast("boolean")))
    people = _join_keys(participants, size.filter("_ok"), [])
    # levels with a spare item, in a per-participant order; the first ``extra`` of them get one more
    number = F.col("participant_no")
    ranked = F.array_sort(F.filter(F.array(*(F.struct(
        mix(number, F.lit(k), seed=seed + 1).alias("u"), F.lit(v).alias("level"), F.col(v).alias("n"))
        for k, v in enumerate(levels))), lambda s: s["n"] > base))
    lucky = F.transform(F.slice(ranked, 1, extra), lambda s: s["level"]) if extra else F.array().cast("array<string>")
    draws = F.array(*(F.struct(
        F.lit(v).alias("difficulty"), F.col(v).alias("n"),
        (mix(number, F.lit(k), seed=seed + 2) % F.greatest(F.col(v), F.lit(1))).alias("start"),
        (F.lit(base) + F.array_contains(F.col("_lucky"), v).cast("int")).alias("quota")) for k, v in enumerate(levels)))
    slots = people.withColumn("_lucky", lucky).select(*participants.columns, F.inline(draws))
    wanted = slots.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("quota") - 1))).select(
        *participants.columns, "difficulty", ((F.col("start") + F.col("_j")) % F.col("n")).alias("position"))
    given = wanted.join(order.select("difficulty", "position", "id", "item_no"), ["difficulty", "position"]).drop("position")
    shuffled = given.withColumn("_u", mix(number, F.col("item_no"), seed=seed + 3))
    # at most 30 rows per participant
    from pyspark.sql import Window
    place = F.row_number().over(Window.partitionBy("participant_no").orderBy("_u", "item_no"))
    return shuffled.withColumn("presentation_order", place).drop("_u")


# --- D2, A19 ---
def balance_check(items: DataFrame, count: int, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """One row: items per level and whether a balanced assignment of ``count`` is feasible."""
    base, extra = divmod(count, len(levels))
    size = items.agg(*(F.count_if(F.col("difficulty") == v).alias(v) for v in levels))
    spare = sum((F.when(F.col(v) > base, 1).otherwise(0) for v in levels), F.lit(0))
    return size.withColumn("feasible", F.lit(20 <= count <= 30) & (F.least(*levels) >= base) & (spare >= extra))


def level_counts(items: DataFrame, by: list[str]) -> DataFrame:
    return items.groupBy(*by).agg(F.count(F.lit(1)).alias("items"), *(F.count_if(F.col("difficulty") == v).alias(v) for v in LEVELS))


# --- D3 ---
def deal_sets(items: DataFrame, sets: int, strata: list[str] = ("difficulty", "label"), row: str = "row") -> DataFrame:
    """Set number 1..``sets`` dealt in row order inside each stratum."""
    placed = positions(items, list(strata), [row], "_k")
    return placed.withColumn("set", (F.col("_k") % sets + 1).cast("int")).drop("_k")


def uneven_strata(items: DataFrame, sets: int, strata: list[str] = ("difficulty", "label")) -> DataFrame:
    """Strata whose size is no multiple of ``sets`` (dealing would not be fair)."""
    return items.groupBy(*strata).agg(F.count(F.lit(1)).alias("items")).filter(F.col("items") % sets != 0)


# --- D4 ---
def lease_sets(free: DataFrame, waiting: DataFrame) -> DataFrame:
    """Lowest free set to the earliest waiting participant; null when the sets run out.

    ``free``: (set_number); ``waiting``: (participant_no, waiting_since as a number).
    """
    sets = positions(free, [], ["set_number"], "_k")
    people = positions(waiting, [], ["waiting_since", "participant_no"], "_k")
    return people.join(sets, "_k", "left").drop("_k")


def release_sets(sessions: DataFrame) -> DataFrame:
    """Sessions that keep their set: the submitted ones."""
    return sessions.filter(F.col("submitted_at").isNotNull())


def free_sets(spark, sets: int, sessions: DataFrame) -> DataFrame:
    return spark.range(1, sets + 1).select(F.col("id").alias("set_number")).join(sessions.select("set_number"), "set_number", "left_anti")


# --- D5 ---
def fixed_split(ids: DataFrame, seed: int, mini: int = 20) -> DataFrame:
    """1-100 training, 101-200 validation, 201-300 test, and a seeded mini sample of validation."""
    number = F.substring("id", 3, 20).cast("bigint")
    name = (F.when(number <= 100, F.lit("training")).when(number <= 200, F.lit("validation")).otherwise(F.lit("test")))
    split = ids.withColumn("split", name).withColumn("_u", mix(number, seed=seed))
    chosen = top_n(split.filter("split = 'validation'"), [], ["_u", "id"], mini).select("id", F.lit(True).alias("mini"))
    return split.join(chosen, "id", "left").select("id", "split", F.coalesce("mini", F.lit(False)).alias("mini"))


# --- D6 ---
def stratified_pick(items: DataFrame, per_level: int, seed: int, min_boxes: dict[str, int] | None = None, min_size: int = 600) -> DataFrame:
    """Per level, the first ``per_level`` eligible articles of a seeded order, one drawing per article.

    ``items``: (item_no, id, article, difficulty, label, in_study, boxes, size). Articles in the study
    are excluded. An article counts once over all levels, for its earliest level.
    """
    study = items.filter("in_study").select("article").distinct()
    need = F.lit(0)
    if min_boxes:
        need = F.create_map(*[F.lit(v) for pair in min_boxes.items() for v in pair])[F.col("difficulty")]
    good = items.filter((F.col("label") == "positive") & ~F.col("in_study") & (F.col("size") >= min_size)
                        & (F.col("boxes") >= need)).join(study, "article", "left_anti")
    level = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("difficulty"))
    keyed = good.withColumn("_u", mix(F.col("item_no"), seed=seed)).withColumn("_l", level).filter("_l > 0")
    one = keyed.groupBy("article").agg(F.min(F.struct("_l", "_u", "item_no", "id", "difficulty")).alias("_p")).select("article", "_p.*")
    return top_n(one, ["difficulty"], ["_u", "item_no"], per_level).select("id", "article", "difficulty", "rank")


def first_per_level(items: DataFrame, n: int) -> DataFrame:
    """W8: first ``n`` ids of each difficulty."""
    return top_n(items, ["difficulty"], ["id"], n)


# --- K1, J21, W6 ---
def export_rows(sessions: DataFrame, ratings: DataFrame, catalog: DataFrame, scope: str = "completed") -> DataFrame:
    """One row per session and assigned drawing, blanks where unrated.

    ``sessions`` may hold study_version, mode, participant_code, participant_name, set_number and started_at, and
    ``catalog`` source, sha256, label and defects; what they lack is blank in the export.
    """
    kept = sessions if scope == "all" else sessions.filter(F.col("submitted_at").isNotNull())
    given = lambda df, names: {out: F.col(c) if c in df.columns else F.lit(None).cast("string") for out, c in names.items()}
    who = given(kept, {c: c for c in ("study_version", "mode", "participant_code", "participant_name", "set_number")}
                | {"session_started_at": "started_at", "session_submitted_at": "submitted_at"})
    what = given(catalog, {"diagram_source": "source", "image_sha256": "sha256", "label": "label", "defects": "defects"})
    people = kept.select("session_id", *(c.alias(n) for n, c in who.items()), F.posexplode("assignment").alias("_k", "diagram_id"))
    shown = catalog.select("diagram_id", "difficulty", *(c.alias(n) for n, c in what.items()))
    rated = people.join(ratings, ["session_id", "diagram_id"], "left").join(shown, "diagram_id", "left")
    status = F.when(F.col("session_submitted_at").isNotNull(), F.lit("completed")).otherwise(F.lit("in_progress"))
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return rated.select(
        "session_id", *map(blank, ("study_version", "mode", "participant_code", "participant_name", "set_number")), status.alias("session_status"),
        "diagram_id", *map(blank, ("diagram_source", "image_sha256")), "difficulty", *map(blank, ("label", "defects")),
        (F.col("_k") + 1).alias("presentation_order"), *(F.col("scores")[k].alias(k) for k in SCORE_KEYS),
        F.coalesce(F.col("complete").cast("int"), F.lit(0)).alias("rating_complete"), F.coalesce("comment", F.lit("")).alias("comment"),
        F.col("duration_ms").alias("active_duration_ms"), "session_started_at", F.col("updated_at").alias("rating_updated_at"), "session_submitted_at")


# --- A18 ---
def study_progress(sessions: DataFrame, ratings: DataFrame) -> DataFrame:
    """Participants, completed sessions, saved and complete ratings, in one row."""
    people = sessions.agg(F.count(F.lit(1)).alias("participants"), F.count("submitted_at").alias("completed"))
    saved = ratings.join(sessions.select("session_id"), "session_id", "left_semi").agg(
        F.count(F.lit(1)).alias("saved"), F.count_if("complete").alias("rated"))
    return _join_keys(people, saved, [])


def newest_sessions(sessions: DataFrame, ratings: DataFrame, n: int = 200) -> DataFrame:
    """W7: latest sessions with their totals."""
    per = ratings.groupBy("session_id").agg(F.count(F.lit(1)).alias("saved"), F.count_if("complete").alias("rated"))
    return (sessions.join(per, "session_id", "left").select(
        "session_id", "started_at", "submitted_at", F.size("assignment").alias("total"),
        F.coalesce("saved", F.lit(0)).alias("saved"), F.coalesce("rated", F.lit(0)).alias("rated"))
        .orderBy(F.desc("started_at"), "session_id").limit(n))


# --- P1 ---
def public_view(catalog: DataFrame) -> DataFrame:
    return catalog.select("id", "image", "caption")


# --- D8 ---
def expand_scenarios(scenarios: DataFrame, themes: list[str], patterns: list[str]) -> DataFrame:
    """Scenario x theme x pattern manifest rows; the caption is written from the scenario's edges.

    ``scenarios``: (scenario, nodes array<string>, edges array<struct<source,target>>).
    """
    variants = F.array(*(F.struct(F.lit(t).alias("theme"), F.lit(p).alias("pattern")) for t in themes for p in patterns))
    steps = F.transform("edges", lambda e: F.concat(e["source"], F.lit(" leads to "), e["target"]))
    rows = scenarios.withColumn("caption", F.concat(F.array_join(steps, "; "), F.lit("."))).select("*", F.inline(variants))
    clean = F.col("pattern") == "clean"
    return rows.select(
        F.concat_ws("-", "scenario", "theme", "pattern").alias("id"), "scenario", "theme", "pattern", "caption",
        F.when(clean, F.lit("positive")).otherwise(F.lit("negative")).alias("label"),
        F.when(clean, F.lit("")).otherwise(F.col("pattern")).alias("defects"))
