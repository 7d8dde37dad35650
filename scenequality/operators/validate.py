"""Row rules. Each check returns columns or rejects; nothing is silently dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scenequality.schemas import IMAGE_TYPES, LEVELS, SCORE_KEYS


# --- V2, V3 ---
def rating_valid(scores: Column, comment: Column, duration: Column) -> Column:
    """Known keys with integers 1-10, a comment of at most 2000 characters, active time within a day."""
    ok = F.forall(F.map_entries(scores), lambda e: e["key"].isin(*SCORE_KEYS) & e["value"].between(1, 10))
    return F.coalesce(ok & (F.length(comment) <= 2000) & duration.between(0, 86_400_000), F.lit(False))


def rating_complete(scores: Column) -> Column:
    keys = F.array(*map(F.lit, SCORE_KEYS))
    return F.coalesce(F.forall(keys, lambda k: F.coalesce(scores[k].between(1, 10), F.lit(False))), F.lit(False))


def direct_score_problem(score: Column) -> Column:
    """S6: null when a JSON score text is an integer 1-10 (a JSON true is not an integer)."""
    ok = F.coalesce(score.rlike(r"^-?\d+$"), F.lit(False))
    return F.when(~ok | ~F.try_to_number(score, F.lit("S999999999")).between(1, 10), F.lit("invalid score"))


def failed_rules(rules: dict[str, Column]) -> Column:
    """Names of the rules that failed, in order; an unknown outcome counts as failed."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))


def split(df: DataFrame, rules: dict[str, Column], row: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejects(row, rule)): one reject line per broken rule."""
    marked = df.withColumn("_failed", failed_rules(rules))
    valid = marked.filter(F.size("_failed") == 0).drop("_failed")
    return valid, marked.filter(F.size("_failed") > 0).select(row, F.explode("_failed").alias("rule"))


# --- V1, V13, U3 ---
def id_problems(got: DataFrame, expected: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Unknown, repeated and missing items of a table against its expected ids."""
    on = [*keys, item]
    counts = got.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    both = counts.join(expected.select(*on, F.lit(1).alias("_known")).distinct(), on, "full")
    problem = (F.when(F.col("_known").isNull(), F.lit("unknown")).when(F.col("_n").isNull(), F.lit("missing"))
               .when(F.col("_n") > 1, F.lit("repeated")))
    return both.select(*on, problem.alias("problem")).filter(F.col("problem").isNotNull())


def numbered_ids(spark, prefix: str, count: int, width: int = 3) -> DataFrame:
    """Expected ids prefix001..prefixNNN."""
    return spark.range(1, count + 1).select(F.concat(F.lit(prefix), F.lpad(F.col("id").cast("string"), width, "0")).alias("id"))


# --- V5, V6 ---
def manifest_problems(rows: DataFrame) -> DataFrame:
    """One line per broken manifest rule, with the row number.

    ``rows``: (row, file, found, sha256, difficulty, caption, caption_file, caption_text, id, label).
    First owners of contents and ids come from partial minima, so copies never gather in one task.
    """
    trim = lambda c: F.coalesce(F.trim(F.col(c)), F.lit(""))
    file = trim("file")
    extension = F.lower(F.regexp_extract(file, r"(\.[^./\\]+)$", 1))
    caption = F.when(trim("caption_file") != "", trim("caption_text")).otherwise(trim("caption"))
    ident = F.when(trim("id") != "", trim("id")).otherwise(F.concat(F.lit("D-"), F.substring("sha256", 1, 10)))
    marked = rows.withColumn("_id", ident)
    content = marked.filter("sha256 is not null").groupBy("sha256").agg(F.min("row").alias("_content_row"))
    owner = marked.filter("_id is not null").groupBy("_id").agg(F.min("row").alias("_id_row"))
    joined = marked.join(content, "sha256", "left").join(owner, "_id", "left")
    label = F.lower(trim("label"))
    rules = {
        "file is empty": file != "",
        "not an image": (file == "") | extension.isin(*IMAGE_TYPES),
        "image not found": F.col("found"),
        "same content as an earlier row": F.coalesce(F.col("_content_row") == F.col("row"), F.lit(True)),
        "unknown difficulty": F.lower(trim("difficulty")).isin(*LEVELS),
        "two captions": ~((trim("caption") != "") & (trim("caption_file") != "")),
        "caption is empty": caption != "",
        "invalid id": F.coalesce(F.col("_id").rlike(r"^[A-Za-z0-9._-]{1,64}$"), F.lit(True)),
        "id already used": F.coalesce(F.col("_id_row") == F.col("row"), F.lit(True)),
        "unknown label": (label == "") | label.isin("positive", "negative"),
    }
    return split(joined, rules, "row")[1]


def duplicate_content(rows: DataFrame, content: str = "sha256", row: str = "row") -> DataFrame:
    """Rows whose content appeared in an earlier row."""
    first = rows.groupBy(content).agg(F.min(row).alias("first_row"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return rows.join(first.drop("_n"), content).filter(F.col(row) > F.col("first_row")).select(row, "first_row", content)


# --- V7, V12, V14 ---
def in_range(ident: Column, first: int | None, start: int = 1) -> Column:
    number = F.substring(ident, 3, 20).cast("bigint")
    return number >= start if first is None else number.between(start, first)


def approval_open(listed: DataFrame, reviews: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Items that still block approval: no review, or one without exactly the keys at 1-10."""
    scores = F.col("scores")
    exact = F.array_sort(F.map_keys(scores)) == F.array_sort(F.array(*map(F.lit, keys)))
    good = reviews.filter(exact & F.forall(F.map_values(scores), lambda v: v.between(1, 10)))
    return listed.join(good, "id", "left_anti").select("id")


def catalog_problems(catalog: DataFrame, contents: DataFrame, sets: int | None = None) -> DataFrame:
    """Stored hashes that no longer match, and sets of uneven size or balance."""
    changed = catalog.join(contents, "image", "left").filter(
        ~F.col("sha256").eqNullSafe(F.sha2("content", 256))).select(F.col("id").alias("item"), F.lit("content changed").alias("problem"))
    if sets is None:
        return changed
    level = [F.count_if(F.col("difficulty") == v).alias(v) for v in LEVELS]
    per = catalog.groupBy("set").agg(F.count(F.lit(1)).alias("_n"), *level)
    total = catalog.agg((F.count(F.lit(1)) / sets).alias("_size"))
    from scenequality.operators.running import _join_keys
    spread = F.greatest(*LEVELS) - F.least(*LEVELS)
    problem = (F.when(F.coalesce(~F.col("set").between(1, sets), F.lit(True)), F.lit("set out of range"))
               .when(F.col("_n") != F.col("_size"), F.lit("set size")).when(spread > 1, F.lit("unbalanced")))
    uneven = _join_keys(per, total, []).select(F.concat(F.lit("set "), F.coalesce(F.col("set").cast("string"), F.lit("none"))).alias("item"),
                                              problem.alias("problem")).filter(F.col("problem").isNotNull())
    return changed.unionByName(uneven)
