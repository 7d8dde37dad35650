"""Queries over stored records: result files, human ratings, reports, catalogs, settings and images, written and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from scenequality.functions import geometry as G
from scenequality.operators import agreement as A, judging as J, panel as P, validate as V
from scenequality.plans.bindings import view
from scenequality.plans.file_queries import _folder
from scenequality.plans.registry import query, r6, sql6
from scenequality.plans.study_queries import hash_tree_sql
from scenequality.schemas import BEAUTY, CORRECTNESS, SCORE_KEYS, criteria_table
from scenequality.sources import readers as R, sinks as K
from scenequality.streaming import ratings as S


# --- S10, V3: one result file per job, keyed by its path ---
_JOBS = """jobs AS (SELECT lang || '-' || source AS id, 'v' || CAST(1 + id % 2 AS VARCHAR) AS version, dimension, CAST(max(judge) AS INTEGER) AS score
        FROM (SELECT id, difficulty AS lang, rater AS source, dimension, judge FROM scored) GROUP BY ALL),
    files AS (SELECT id, version, dimension, CASE WHEN hash_of % 7 = 0 AND dimension = 'details' THEN NULL ELSE score END AS score
        FROM (SELECT *, length(id) + score AS hash_of FROM jobs) WHERE NOT (hash_of % 5 = 0 AND dimension = 'layout'))"""


@query("result_files", ("scored",), """
    SELECT id, version, dimension, score FROM files
    WHERE (id, version) IN (SELECT id, version FROM files WHERE score IS NOT NULL GROUP BY ALL HAVING count(DISTINCT dimension) = 5)""", _JOBS)
def result_files(spark, sf):
    """Results in one JSON file per job; jobs without all five dimensions are left out."""
    rows = view(spark, sf, "scored").select(
        F.concat_ws("-", "difficulty", "rater").alias("id"), F.concat(F.lit("v"), (1 + F.col("id") % 2).cast("string")).alias("version"), "dimension", "judge")
    jobs = rows.groupBy("id", "version", "dimension").agg(F.max("judge").cast("int").alias("score"))
    kind = F.length("id") + F.col("score")
    jobs = jobs.filter(~((kind % 5 == 0) & (F.col("dimension") == "layout")))
    jobs = jobs.withColumn("score", F.when(~((kind % 7 == 0) & (F.col("dimension") == "details")), F.col("score")))
    path = _folder(spark)
    jobs.withColumn("reasoning", F.lit("because")).repartition("id", "version", "dimension").write.partitionBy("id", "version", "dimension").json(path)
    return R.read_result_files(spark, path, r"id=([^/]+)/version=([^/]+)/dimension=([^/]+)/[^/]+\.json$").select("id", "version", "dimension", "score")


# --- S12, P2, P3, T9: nested human ratings with corrections ---
def _points(at: str, quality: str, i: int, corrected: bool = False) -> str:
    """Score ``i`` of a drawing; null where the rater left it out."""
    return f"CASE WHEN ({at} + {i}) % 29 = 0 THEN NULL ELSE 1 + ({at} * 7 + {i * 3 + (5 if corrected else 0)} + {quality} * 4) % 10 END"


_RATED = f"""base AS (SELECT doc_id AS n, CAST(doc_id AS VARCHAR) AS id, lang AS difficulty, source AS rater, quality FROM documents JOIN labels USING (doc_id)),
    rated AS (SELECT n, id, difficulty, rater, unnest([{', '.join(f"{{'dimension': '{k}', 'human': CAST(CASE WHEN n % 9 = 0 THEN {_points('n', 'quality', i, True)} ELSE {_points('n', 'quality', i)} END AS DOUBLE)}}"
        for i, k in enumerate(SCORE_KEYS))}], recursive := true) FROM base),
    given AS (SELECT * FROM rated WHERE human IS NOT NULL)"""


def _ratings(spark: SparkSession, sf: str) -> DataFrame:
    """Nested documents of up to a hundred drawings each, and corrections of every ninth drawing."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    score = lambda corrected: F.struct(*(F.expr(_points("doc_id", "quality", i, corrected)).cast("double").alias(k) for i, k in enumerate(SCORE_KEYS)))
    item = lambda corrected: F.struct(
        F.col("doc_id").cast("string").alias("id"), F.concat("doc_id", F.lit(".png")).alias("image"), F.lit("").alias("caption"), F.col("lang").alias("difficulty"),
        F.when(F.col("quality") == 1, F.lit("positive")).otherwise(F.lit("negative")).alias("label"), F.col("source").alias("rater"), score(corrected).alias("scores"))
    folders = []
    for corrected in (False, True):
        rows = docs.filter("doc_id % 9 = 0") if corrected else docs
        listed = rows.groupBy("source", F.floor(F.col("doc_id") / 2000).alias("part")).agg(F.collect_list(item(corrected)).alias("diagrams"))
        path = _folder(spark)
        listed.select(F.to_json(F.struct("diagrams")).alias("value")).write.text(path)
        folders.append(path)
    return R.read_human_ratings(spark, *folders, lines=True)


@query("human_ratings", (), "SELECT id, dimension, human, rater FROM given", _RATED)
def human_ratings(spark, sf):
    """Thirteen scores per drawing in long form; corrected drawings replace the originals."""
    return _ratings(spark, sf).select("id", "dimension", "human", "rater")


_AXES = f"""axes AS (SELECT id, CASE WHEN dimension IN ({', '.join(f"'{c}'" for c in CORRECTNESS)}) THEN 'correctness_overall' ELSE 'beauty_overall' END AS dimension, avg(human) AS human
        FROM given GROUP BY ALL)"""


@query("human_overall", (), f"""
    SELECT id, dimension, {sql6('human', 'human')} FROM axes UNION ALL SELECT id, 'overall', {sql6('avg(human)', 'human')} FROM axes GROUP BY id""", f"{_RATED}, {_AXES}")
def human_overall(spark, sf):
    """Correctness, beauty and overall scores of people."""
    rows = A.with_overall(_ratings(spark, sf).select("id", "dimension", "human"), ["id"], ("human",))
    return rows.filter(F.col("dimension").endswith("overall")).select("id", "dimension", r6(F.col("human"), "human"))


@query("beauty_validation", (), f"""
    , j AS (SELECT id, dimension, human, 1 + 9 * ((n * 13 + length(dimension)) % 101) / 1e2 AS judge FROM given
            WHERE dimension IN ({', '.join(f"'{b}'" for b in BEAUTY)})),
    q AS (SELECT * FROM j UNION ALL SELECT id, 'overall', human, judge FROM j)
    SELECT dimension, count(*) AS n, {sql6('sqrt(avg((judge - human) * (judge - human)))', 'rmse')},
           {sql6('avg(abs(judge - human))', 'mae')}, {sql6('corr(human, judge)', 'pearson')} FROM q GROUP BY ALL""", _RATED)
def beauty_validation(spark, sf):
    """Judge against people over the eight beauty dimensions, read from nested files."""
    people = _ratings(spark, sf).filter(F.col("dimension").isin(*BEAUTY))
    number = F.col("id").cast("bigint")
    judged = people.select("id", "dimension", G.hundred_to_human((number * 13 + F.length("dimension")) % 101).alias("judge"))
    out = A.validation_metrics(people.select("id").distinct(), people.select("id", "dimension", "human"), judged)
    return out.select("dimension", "n", *(r6(F.col(c), c) for c in ("rmse", "mae", "pearson")))


# --- K3, P4, K5 ---
_RUBRIC_ROWS = """kinds AS (SELECT id AS diagram_id, dimension || '.a' AS criterion_id, dimension, 10 AS e, CAST(10 - judge AS BIGINT) AS i FROM scored)"""


def _reports(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Reports of every scored drawing, written and read back, and what was written."""
    rows = view(spark, sf, "scored").select(
        F.col("id").cast("string").alias("diagram_id"), F.concat("dimension", F.lit(".a")).alias("criterion_id"), "dimension", F.lit("model").alias("judge"),
        F.lit(10).cast("bigint").alias("expected_count"), (10 - F.col("judge")).cast("bigint").alias("detected_issues"))
    rubric = rows.select("criterion_id", "dimension").distinct()
    dims = P.aggregate_panel(rows, rubric)
    weights = P.equal_weights(rubric)
    overall = P.weighted_overall(dims, weights)
    path = _folder(spark)
    K.write_reports(K.report_documents(overall, dims.select("diagram_id", "dimension", "score"), rows, weights), path)
    return R.read_reports(spark, path), rows


@query("report_metrics", ("scored",), "SELECT diagram_id, criterion_id, 'model' AS judge, CAST(e AS BIGINT) AS expected_count, i AS detected_issues FROM kinds", _RUBRIC_ROWS)
def report_metrics(spark, sf):
    """Metric rows aggregated into one report per drawing, written, read back and exploded again."""
    return K.explode_reports(_reports(spark, sf)[0]).withColumn("diagram_id", F.col("diagram_id").cast("bigint"))


@query("report_scores", ("scored",), f"""
    , p AS (SELECT diagram_id, avg((e - i) / e) AS s FROM kinds GROUP BY ALL)
    SELECT diagram_id, {sql6('s', 'correctness')}, '0.200000*presence + 0.200000*layout + 0.200000*connectivity + 0.200000*details + 0.200000*legibility' AS formula FROM p""", _RUBRIC_ROWS)
def report_scores(spark, sf):
    """Overall score and weight formula out of the stored reports."""
    rows = _reports(spark, sf)[0]
    score = F.get_json_object("report", "$.correctness").cast("double")
    return rows.select(F.col("diagram_id").cast("bigint").alias("diagram_id"), r6(score, "correctness"), F.get_json_object("report", "$.formula").alias("formula"))


@query("summary_lines", ("scored",), f"""
    SELECT difficulty, dimension, count(*) AS n, {sql6('avg(abs(judge - human))', 'mae')} FROM scored GROUP BY ALL""")
def summary_lines(spark, sf):
    """A statistics table as JSON lines, one per group, read back."""
    stats = view(spark, sf, "scored").groupBy("difficulty", "dimension").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("judge") - F.col("human"))).alias("mae"))
    path = _folder(spark)
    K.summary_document(stats, ["difficulty", "dimension"]).write.text(path)
    found = spark.read.schema("group struct<difficulty:string,dimension:string>, values struct<n:bigint,mae:double>").json(path)
    return found.select("group.difficulty", "group.dimension", "values.n", r6(F.col("values.mae"), "mae"))


# --- S2, S3, A11: settings and issue history from files ---
_HISTORY = """seen AS (SELECT CASE event_type WHEN 'view' THEN 'presence' WHEN 'click' THEN 'layout' WHEN 'error' THEN 'connectivity' WHEN 'signup' THEN 'details' ELSE 'legibility' END AS dimension,
        CASE event_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'high' ELSE 'medium' END AS severity, count(*) AS n FROM events GROUP BY ALL)"""


@query("history_file_weights", (), f"""
    , w AS (SELECT dimension, sum(n * CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 3 ELSE 5 END) AS t FROM seen GROUP BY dimension)
    SELECT dimension, {sql6('t / sum(t) OVER ()', 'weight')} FROM w""", _HISTORY)
def history_file_weights(spark, sf):
    """Weights from an issue history and the multipliers of a settings file, both read from JSON."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    names = {"view": "presence", "click": "layout", "error": "connectivity", "signup": "details"}
    dimension = F.lit("legibility")
    for kind, name in names.items():
        dimension = F.when(F.col("event_type") == kind, F.lit(name)).otherwise(dimension)
    severity = F.element_at(F.array(*map(F.lit, ("low", "high", "medium"))), (F.col("event_id") % 3 + 1).cast("int"))
    issues = events.groupBy(dimension.alias("dimension"), severity.alias("severity")).agg(F.count(F.lit(1)).cast("double").alias("count"))
    history, settings = _folder(spark), _folder(spark)
    # five dimensions and three severities at most: one small document
    issues.agg(F.to_json(F.struct(F.collect_list(F.struct("dimension", "severity", "count")).alias("issues"))).alias("value")).coalesce(1).write.text(history)
    spark.range(1).select(F.to_json(F.struct(F.struct(*(F.lit(v).alias(k) for k, v in (("low", 1.0), ("medium", 3.0), ("high", 5.0)))).alias("severity"))).alias("value")).coalesce(1).write.text(settings)
    multipliers = R.read_settings(spark, settings)["severity"]
    rubric = criteria_table(spark)
    out = P.history_weights(R.read_issue_history(spark, history), rubric, multipliers)
    return out.select("dimension", r6(F.col("weight"), "weight"))


# --- S9, V14: a catalog from files, its version, and what no longer holds ---
_FILED = """filed AS (SELECT item_no, id, sha256, difficulty, caption, 1 + item_no % 4 AS set FROM catalog)"""


def _stored_catalog(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = view(spark, sf, "catalog")
    item = F.struct("id", F.concat("id", F.lit(".png")).alias("image"), F.lit("a caption").alias("caption"), "difficulty", F.col("article").alias("source"), "sha256",
                    (1 + F.col("item_no") % 4).cast("int").alias("set"), "label", F.lit("").alias("defects"))
    parts = rows.groupBy(F.floor(F.col("item_no") / 500).alias("part")).agg(F.collect_list(item).alias("diagrams"))
    path = _folder(spark)
    parts.select(F.to_json(F.struct(F.lit("study").alias("id"), "diagrams")).alias("value")).write.text(path)
    return R.read_catalog(spark, path, lines=True)


@query("stored_catalog", ("catalog",), f"""
    , rj AS (SELECT sha256('{{"caption":"a caption","defects":"","difficulty":"' || difficulty || '","id":"' || id || '","image":"' || id || '.png","label":"' || label
            || '","set":' || CAST(1 + item_no % 4 AS VARCHAR) || ',"sha256":"' || sha256 || '","source":"' || article || '"}}') AS h FROM catalog), {hash_tree_sql('rj')}
    SELECT 'study-' || substr(entry, 2, 12) AS study_version, (SELECT count(*) FROM catalog) AS items, (SELECT count(DISTINCT article) FROM catalog) AS articles FROM t0""")
def stored_catalog(spark, sf):
    """A catalog stored in parts, read back with its version."""
    rows, version = _stored_catalog(spark, sf)
    counts = rows.agg(F.count(F.lit(1)).alias("items"), F.count_distinct("source").alias("articles"))
    return version.join(counts)


@query("catalog_recheck", ("catalog",), f"""
    , {_FILED},
    s AS (SELECT set, count(*) AS n, count(*) FILTER (difficulty = 'easy') AS a, count(*) FILTER (difficulty = 'medium') AS b, count(*) FILTER (difficulty = 'hard') AS c FROM filed GROUP BY set)
    SELECT id AS item, 'content changed' AS problem FROM filed WHERE item_no % 13 IN (3, 7)
    UNION ALL SELECT 'set ' || CAST(set AS VARCHAR), CASE WHEN n <> (SELECT count(*) / 4 FROM filed) THEN 'set size' ELSE 'unbalanced' END FROM s
        WHERE n <> (SELECT count(*) / 4 FROM filed) OR greatest(a, b, c) - least(a, b, c) > 1""")
def catalog_recheck(spark, sf):
    """Stored hashes against the contents as they are now (some changed, some gone), and the balance of the sets."""
    rows, _ = _stored_catalog(spark, sf)
    now = view(spark, sf, "catalog").filter("item_no % 13 <> 7").select(
        F.concat("id", F.lit(".png")).alias("image"), F.when(F.col("item_no") % 13 == 3, F.concat(F.lit("new "), "caption")).otherwise(F.col("caption")).cast("binary").alias("content"))
    return V.catalog_problems(rows, now, 4)


# --- V13, U3: the id contract ---
@query("id_contract", (), """
    , l AS (SELECT max(doc_id) AS m FROM documents),
    got AS (SELECT 'G' || lpad(CAST(CASE WHEN doc_id % 19 = 4 THEN doc_id + 1 ELSE doc_id END AS VARCHAR), 12, '0') AS id FROM documents
            UNION ALL SELECT 'X' || CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id % 31 = 2),
    c AS (SELECT id, count(*) AS n FROM got GROUP BY id),
    e AS (SELECT 'G' || lpad(CAST(k AS VARCHAR), 12, '0') AS id FROM (SELECT unnest(range(1, (SELECT m + 1 FROM l))) AS k))
    SELECT coalesce(c.id, e.id) AS id, CASE WHEN e.id IS NULL THEN 'unknown' WHEN c.id IS NULL THEN 'missing' ELSE 'repeated' END AS problem
    FROM c FULL JOIN e ON c.id = e.id WHERE e.id IS NULL OR c.id IS NULL OR n > 1""".replace("\n    , l AS", "\n    WITH l AS"))
def id_contract(spark, sf):
    """Unknown, missing and repeated ids against a numbered range."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id")
    last = docs.agg(F.max("doc_id")).first()[0] or 0
    moved = F.when(F.col("doc_id") % 19 == 4, F.col("doc_id") + 1).otherwise(F.col("doc_id"))
    got = docs.select(F.concat(F.lit("G"), F.lpad(moved.cast("string"), 12, "0")).alias("id")).unionByName(
        docs.filter("doc_id % 31 = 2").select(F.concat(F.lit("X"), F.col("doc_id").cast("string")).alias("id")))
    return V.id_problems(got, V.numbered_ids(spark, "G", last, 12), [], "id")


# --- A23 ---
@query("sketch_coverage", ("components", "connections", "slots"), f"""
    , i AS (SELECT diagram_id, 'C' AS kind, (diagram_id + idx) % 7 <> 0 AS shown FROM components UNION ALL SELECT diagram_id, 'E', (diagram_id + idx) % 5 <> 0 FROM connections),
    d AS (SELECT diagram_id, count(*) AS items, count(*) FILTER (shown) AS shown, max(CASE WHEN NOT shown AND kind = 'C' THEN 1 ELSE 0 END) AS c,
                 max(CASE WHEN NOT shown AND kind = 'E' THEN 1 ELSE 0 END) AS e FROM i GROUP BY diagram_id)
    SELECT CASE diagram_id % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS "group", count(*) AS drawings, {sql6('sum(items) / count(*)', 'items_per_sketch')},
           {sql6('sum(shown) / sum(items)', 'share_shown')}, CAST(sum(c) AS BIGINT) AS component_not_shown, CAST(sum(e) AS BIGINT) AS connection_not_shown FROM d GROUP BY ALL""")
def sketch_coverage(spark, sf):
    """How much of the expected items sketches show, per level."""
    parts, links = view(spark, sf, "components"), view(spark, sf, "connections")
    item = lambda df, kind, k: df.select("diagram_id", F.lit(kind).alias("kind"), ((F.col("diagram_id") + F.col("idx")) % k != 0).alias("shown"))
    level = F.element_at(F.array(*map(F.lit, ("easy", "medium", "hard"))), (F.col("diagram_id") % 3 + 1).cast("int"))
    out = P.sketch_check(item(parts, "C", 7).unionByName(item(links, "E", 5)), parts.select("diagram_id").distinct().withColumn("group", level))
    return out.select("group", "drawings", r6(F.col("items_per_sketch"), "items_per_sketch"), r6(F.col("share_shown"), "share_shown"), "component_not_shown", "connection_not_shown")


# --- E8 ---
@query("pending_panels", ("scored",), f"""
    , g AS (SELECT id, avg(human) AS g FROM scored GROUP BY id), m AS (SELECT id, avg(judge) AS m FROM scored WHERE id % 4 <> 1 GROUP BY id),
    c AS (SELECT id, avg((human + judge) / 2) AS c FROM scored GROUP BY id)
    SELECT id, {sql6('g', 'geometry')}, {sql6('m', 'model')}, {sql6('CASE WHEN m IS NOT NULL THEN c END', 'combined')}, CASE WHEN m IS NULL THEN 'pending' ELSE 'complete' END AS status
    FROM g LEFT JOIN m USING (id) LEFT JOIN c USING (id)""")
def pending_panels(spark, sf):
    """Geometry, model and combined scores side by side; items without the model's stay pending."""
    rows = view(spark, sf, "scored")
    mean = lambda df, value: df.groupBy("id").agg(F.avg(value).alias("overall"))
    out = J.panels_side_by_side(rows.select("id").distinct(), mean(rows, F.col("human")), mean(rows.filter("id % 4 <> 1"), F.col("judge")),
                                mean(rows, (F.col("human") + F.col("judge")) / 2), "id")
    return out.select("id", *(r6(F.col(c), c) for c in ("geometry", "model", "combined")), "status")


# --- S14, G15: images as bytes ---
def _header(width, height):
    number = lambda v: F.lpad(F.hex(v.cast("bigint")), 8, "0")
    return F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), number(width), number(height), F.lit("0800000000")))


@query("image_headers", (), """
    SELECT doc_id, CASE WHEN doc_id % 11 <> 3 AND doc_id % 17 <> 5 THEN CAST(1 + n_chars % 4000 AS INTEGER) END AS width,
           CASE WHEN doc_id % 11 <> 3 AND doc_id % 17 <> 5 THEN CAST(1 + doc_id % 3000 AS INTEGER) END AS height FROM documents""")
def image_headers(spark, sf):
    """Sizes out of image header bytes; other formats and headers cut short have none."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    content = _header(1 + F.col("n_chars") % 4000, 1 + F.col("doc_id") % 3000)
    content = F.when(F.col("doc_id") % 11 == 3, F.unhex(F.concat(F.lit("FFD8FFE0"), F.hex(content)))).when(
        F.col("doc_id") % 17 == 5, F.substring(content, 1, 20)).otherwise(content)
    size = G.png_size(content)
    return docs.select("doc_id", size["width"].alias("width"), size["height"].alias("height"))


@query("changed_pixels", (), """
    , p AS (SELECT doc_id, doc_id % 10 = 4 AS resized, sha256(coalesce(text, '')) AS a, sha256('next' || coalesce(text, '')) AS b FROM documents),
    v AS (SELECT doc_id, resized, list_transform(range(0, 32), lambda i: abs(CAST('0x' || substr(a, CAST(1 + 2 * i AS BIGINT), 2) AS INTEGER) - CAST('0x' || substr(b, CAST(1 + 2 * i AS BIGINT), 2) AS INTEGER))) AS d FROM p)
    SELECT doc_id, CAST(CASE WHEN resized THEN -1 ELSE len(list_filter(d, lambda x: x > 60)) END AS INTEGER) AS changed FROM v""".replace("\n    , p AS", "\n    WITH p AS"))
def changed_pixels(spark, sf):
    """Gray values that differ by more than 60 between two images of the same size, from their raw bytes."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = F.coalesce("text", F.lit(""))
    before, after = (G.gray_values(F.unhex(F.sha2(t, 256))) for t in (text, F.concat(F.lit("next"), text)))
    return docs.select("doc_id", G.changed_pixels(before, after, F.col("doc_id") % 10 != 4).alias("changed"))


# --- E4 ---
@query("resumed_scoring", (), """
    SELECT event_id AS id, CAST(CASE WHEN event_id % 5 = 0 THEN least(3, 1 + event_id % 4) ELSE 1 END AS INTEGER) AS attempt,
           CASE WHEN event_id % 5 = 0 AND event_id % 4 = 3 THEN NULL ELSE CAST(floor(value) AS BIGINT) % 10 + 1 END AS score FROM events""")
def resumed_scoring(spark, sf):
    """A stream scored over four starts; failed items are tried again at each start, three times at most."""
    events, folder = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("id"), "value"), _folder(spark)

    def score(rows):
        works = (F.col("id") % 5 != 0) | (F.col("attempt") >= 1 + F.col("id") % 4)
        return rows.withColumn("score", F.when(works, F.floor("value").cast("bigint") % 10 + 1)).withColumn("error", F.when(~works, F.lit("timeout")))

    for start in range(4):
        if start < 2:
            events.filter(F.col("id") % 2 == start).write.mode("append").parquet(f"{folder}/arriving")
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/arriving")
        S.score_resumably(stream, f"{folder}/log", f"{folder}/checkpoint", score)
    return S.last_attempts(spark, f"{folder}/log").select("id", "attempt", "score")
