"""Study, rating and judging queries over documents, labels, customers and events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from scenequality.functions import labels as L
from scenequality.operators import judging as J, study as D, validate as V
from scenequality.plans.bindings import components_of_chain, rating_events, sessions, share, view
from scenequality.plans.registry import mix_items, query, r6, sql6
from scenequality.schemas import SCORE_KEYS
from scenequality.session import checkpoint_folder, cut_lineage
from scenequality.sources.readers import combine_hashes
from scenequality.streaming import ratings as E

LEVELS = "['easy', 'medium', 'hard']"


def _catalog(spark, sf):
    return view(spark, sf, "catalog")


# --- manifest and catalog ---
@query("duplicate_content", ("catalog",), """
    SELECT row, min(row) OVER (PARTITION BY sha256) AS first_row, sha256 FROM catalog QUALIFY row > min(row) OVER (PARTITION BY sha256)""")
def duplicate_content(spark, sf):
    return V.duplicate_content(_catalog(spark, sf))


@query("manifest_rejects", ("catalog",), """
    , m AS (SELECT row, file, sha256, row % 83 <> 5 AS found, CASE WHEN row % 61 = 3 THEN 'tricky' ELSE difficulty END AS difficulty,
            CASE WHEN row % 97 = 4 THEN '  ' ELSE caption END AS caption, CASE WHEN row % 89 = 6 THEN 'long.md' ELSE '' END AS caption_file,
            CASE WHEN row % 53 = 1 THEN 'has space' WHEN row % 59 = 2 THEN 'X' || CAST(row % 7 AS VARCHAR) ELSE '' END AS id, label FROM catalog),
    k AS (SELECT *, CASE WHEN id <> '' THEN id ELSE 'D-' || substr(sha256, 1, 10) END AS ident FROM m),
    r AS (SELECT *, min(row) OVER (PARTITION BY sha256) AS c, min(row) OVER (PARTITION BY ident) AS o FROM k)
    SELECT row, 'not an image' AS rule FROM r WHERE file LIKE '%.txt' UNION ALL SELECT row, 'image not found' FROM r WHERE NOT found
    UNION ALL SELECT row, 'same content as an earlier row' FROM r WHERE c <> row UNION ALL SELECT row, 'unknown difficulty' FROM r WHERE difficulty = 'tricky'
    UNION ALL SELECT row, 'two captions' FROM r WHERE trim(caption, ' ') <> '' AND caption_file <> ''
    UNION ALL SELECT row, 'caption is empty' FROM r WHERE caption_file = '' AND trim(caption, ' ') = ''
    UNION ALL SELECT row, 'invalid id' FROM r WHERE id = 'has space' UNION ALL SELECT row, 'id already used' FROM r WHERE o <> row""")
def manifest_rejects(spark, sf):
    row = F.col("row")
    rows = _catalog(spark, sf).select(
        "row", "file", "sha256", (row % 83 != 5).alias("found"),
        F.when(row % 61 == 3, F.lit("tricky")).otherwise(F.col("difficulty")).alias("difficulty"),
        F.when(row % 97 == 4, F.lit("  ")).otherwise(F.col("caption")).alias("caption"),
        F.when(row % 89 == 6, F.lit("long.md")).otherwise(F.lit("")).alias("caption_file"), F.lit("a text file's caption").alias("caption_text"),
        F.when(row % 53 == 1, F.lit("has space")).when(row % 59 == 2, F.concat(F.lit("X"), (row % 7).cast("string"))).otherwise(F.lit("")).alias("id"), "label")
    return V.manifest_problems(rows)


def hash_tree_sql(source: str, levels: int = 9) -> str:
    """The version's hash tree over hashes ``h`` of ``source``; levels below the leaves pass through unchanged."""
    steps = [f"""hc AS (SELECT h, h || ':' || CAST(count(*) AS VARCHAR) AS entry FROM {source} GROUP BY h),
    hd AS (SELECT CAST(greatest(0, ceil(log2(greatest(count(*), 1) / 64e0) / 4)) AS BIGINT) AS depth FROM hc),
    t{levels} AS (SELECT h, entry FROM hc)"""]
    for k in range(levels - 1, -1, -1):
        steps.append(f"""t{k} AS (SELECT CASE WHEN {k} <= depth THEN substr(h, 1, {k}) ELSE h END AS h,
        CASE WHEN {k} <= any_value(depth) THEN substr(any_value(h), 1, {k}) || ':' || sha256(string_agg(entry, ',' ORDER BY entry)) ELSE any_value(entry) END AS entry
        FROM t{k + 1}, hd GROUP BY CASE WHEN {k} <= depth THEN substr(h, 1, {k}) ELSE h END)""")
    return ",\n    ".join(steps)


@query("catalog_version", ("catalog",), f"""
    , hh AS (SELECT sha256(id || '|' || sha256 || '|' || difficulty) AS h FROM catalog), {hash_tree_sql('hh')}
    SELECT 'study-' || substr(entry, 2, 12) AS study_version FROM t0""")
def catalog_version(spark, sf):
    h = _catalog(spark, sf).select(F.sha2(F.concat_ws("|", "id", "sha256", "difficulty"), 256).alias("h"))
    return combine_hashes(h, "study")


@query("content_names", ("catalog",), """
    SELECT row, 'D-' || substr(sha256, 1, 10) AS content_id, substr(sha256, 1, 20) || regexp_extract(file, '\\.[a-z]+$') AS image FROM catalog""")
def content_names(spark, sf):
    return _catalog(spark, sf).select("row", L.content_id(F.col("caption")).alias("content_id"), L.image_name(F.col("caption"), F.col("file")).alias("image"))


@query("level_counts", ("catalog",), """
    SELECT label, count(*) AS items, count(*) FILTER (difficulty = 'easy') AS easy, count(*) FILTER (difficulty = 'medium') AS medium,
           count(*) FILTER (difficulty = 'hard') AS hard FROM catalog GROUP BY ALL""")
def level_counts(spark, sf):
    return D.level_counts(_catalog(spark, sf), ["label"])


@query("balance_check", ("catalog",), """
    , c AS (SELECT count(*) FILTER (difficulty = 'easy') AS easy, count(*) FILTER (difficulty = 'medium') AS medium, count(*) FILTER (difficulty = 'hard') AS hard FROM catalog)
    SELECT *, least(easy, medium, hard) >= 8 AS feasible FROM c""")
def balance_check(spark, sf):
    return D.balance_check(_catalog(spark, sf), 24)


@query("public_view", ("catalog",), "SELECT id, file AS image, caption FROM catalog")
def public_view(spark, sf):
    return D.public_view(_catalog(spark, sf).withColumnRenamed("file", "image"))


# --- assignment ---
@query("balanced_assignment", ("catalog",), f"""
    , it AS (SELECT item_no, id, difficulty, {mix_items('u', ['item_no'], 7)} FROM catalog),
    o AS (SELECT *, row_number() OVER (PARTITION BY difficulty ORDER BY u, item_no) - 1 AS position FROM it),
    n AS (SELECT difficulty, count(*) AS n FROM catalog GROUP BY ALL),
    p AS (SELECT DISTINCT user_id AS participant_no FROM events),
    lv AS (SELECT unnest({LEVELS}) AS difficulty, unnest([0, 1, 2]) AS k),
    s AS (SELECT participant_no, difficulty, n, {mix_items('a', ['participant_no', 'k'], 8)}, {mix_items('b', ['participant_no', 'k'], 9)} FROM p, lv JOIN n USING (difficulty)),
    q AS (SELECT *, 8 + CASE WHEN row_number() OVER (PARTITION BY participant_no ORDER BY a, difficulty) <= 1 THEN 1 ELSE 0 END AS quota FROM s),
    w AS (SELECT participant_no, difficulty, (b % n + unnest(range(0, quota))) % n AS position FROM q),
    g AS (SELECT participant_no, o.difficulty, o.id, o.item_no FROM w JOIN o USING (difficulty, position)),
    z AS (SELECT *, {mix_items('c', ['participant_no', 'item_no'], 10)} FROM g)
    SELECT participant_no, difficulty, id, CAST(row_number() OVER (PARTITION BY participant_no ORDER BY c, item_no) AS INTEGER) AS presentation_order FROM z""")
def balanced_assignment(spark, sf):
    people = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("participant_no")).distinct()
    out = D.balanced_assignment(_catalog(spark, sf).select("item_no", "id", "difficulty"), people, 25, seed=7)
    return out.select("participant_no", "difficulty", "id", "presentation_order")


@query("deal_sets", ("catalog",), """
    SELECT id, difficulty, label, CAST((row_number() OVER (PARTITION BY difficulty, label ORDER BY row) - 1) % 5 + 1 AS INTEGER) AS set FROM catalog""")
def deal_sets(spark, sf):
    return D.deal_sets(_catalog(spark, sf), 5).select("id", "difficulty", "label", "set")


@query("uneven_strata", ("catalog",), "SELECT difficulty, label, count(*) AS items FROM catalog GROUP BY ALL HAVING count(*) % 5 <> 0")
def uneven_strata(spark, sf):
    return D.uneven_strata(_catalog(spark, sf), 5)


@query("lease_sets", (), """
    WITH s AS (SELECT o_orderkey AS set_number, row_number() OVER (ORDER BY o_orderkey) AS k FROM orders WHERE o_orderstatus = 'F'),
    p AS (SELECT c_custkey AS participant_no, row_number() OVER (ORDER BY c_nationkey, c_custkey) AS k FROM customer)
    SELECT participant_no, set_number FROM p LEFT JOIN s USING (k)""")
def lease_sets(spark, sf):
    free = spark.read.parquet(f"{sf}/orders.parquet").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("set_number"))
    waiting = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("participant_no"), F.col("c_nationkey").alias("waiting_since"))
    return D.lease_sets(free, waiting).select("participant_no", "set_number")


_PICK = f"""ok AS (SELECT * FROM catalog WHERE label = 'positive' AND n_chars >= 600),
    u AS (SELECT article || CAST(item_no % 40 AS VARCHAR) AS art, id, item_no, difficulty, list_position({LEVELS}, difficulty) AS l, {mix_items('u', ['item_no'], 11)} FROM ok),
    f AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY art ORDER BY l, u, item_no) = 1)"""


@query("stratified_pick", ("catalog",), """
    SELECT id, art AS article, difficulty, CAST(row_number() OVER (PARTITION BY difficulty ORDER BY u, item_no) AS INTEGER) AS rank FROM f
    QUALIFY row_number() OVER (PARTITION BY difficulty ORDER BY u, item_no) <= 10""", _PICK)
def stratified_pick(spark, sf):
    items = _catalog(spark, sf).select(
        "item_no", "id", F.concat("article", (F.col("item_no") % 40).cast("string")).alias("article"), "difficulty", "label",
        F.lit(False).alias("in_study"), F.lit(9).alias("boxes"), F.col("n_chars").alias("size"))
    return D.stratified_pick(items, 10, seed=11)


@query("first_per_level", ("catalog",), """
    SELECT id, difficulty, CAST(row_number() OVER (PARTITION BY difficulty ORDER BY id) AS INTEGER) AS rank FROM catalog
    QUALIFY row_number() OVER (PARTITION BY difficulty ORDER BY id) <= 5""")
def first_per_level(spark, sf):
    return D.first_per_level(_catalog(spark, sf), 5).select("id", "difficulty", "rank")


@query("fixed_split", ("catalog",), f"""
    , s AS (SELECT 'HS' || lpad(CAST(row AS VARCHAR), 9, '0') AS id, CASE WHEN row <= 100 THEN 'training' WHEN row <= 200 THEN 'validation' ELSE 'test' END AS split,
                   {mix_items('u', ['row'], 5)} FROM catalog)
    SELECT id, split, split = 'validation' AND row_number() OVER (PARTITION BY split ORDER BY u, id) <= 20 AS mini FROM s""")
def fixed_split(spark, sf):
    ids = _catalog(spark, sf).select(F.concat(F.lit("HS"), F.lpad(F.col("row").cast("string"), 9, "0")).alias("id"))
    return D.fixed_split(ids, seed=5)


@query("scenario_manifest", ("slots",), """
    , n AS (SELECT diagram_id, array_agg(p_name ORDER BY slot) AS nodes FROM slots GROUP BY ALL HAVING count(*) > 1),
    c AS (SELECT CAST(diagram_id AS VARCHAR) AS scenario, array_to_string(list_transform(range(1, len(nodes)), lambda i: nodes[i] || ' leads to ' || nodes[i + 1]), '; ') || '.' AS caption FROM n),
    v AS (SELECT unnest(['light', 'light', 'dark', 'dark']) AS theme, unnest(['clean', 'missing_arrow', 'clean', 'missing_arrow']) AS pattern)
    SELECT scenario || '-' || theme || '-' || pattern AS id, scenario, theme, pattern, caption, CASE WHEN pattern = 'clean' THEN 'positive' ELSE 'negative' END AS label,
           CASE WHEN pattern = 'clean' THEN '' ELSE pattern END AS defects FROM c, v""")
def scenario_manifest(spark, sf):
    return D.expand_scenarios(components_of_chain(spark, sf), ["light", "dark"], ["clean", "missing_arrow"])


# --- ratings ---
_SUBMITTED = "TIMESTAMP '2024-01-20 00:00:00'"
_REVIEW = f"""rv AS (SELECT *, CASE WHEN session_id % 3 = 0 AND updated_at > {_SUBMITTED} THEN 'locked' WHEN (diagram_id + session_id) % 4 <> 0 THEN 'not assigned'
    WHEN too_high OR duration_ms > 86400000 THEN 'invalid' END AS reason FROM writes),
    cur AS (SELECT session_id, diagram_id, max(duration_ms) AS duration_ms, arg_max(v, (updated_at, event_id)) AS v, NOT arg_max(unfinished, (updated_at, event_id)) AS complete,
            max(updated_at) AS updated_at FROM rv WHERE reason IS NULL GROUP BY ALL)"""


def _study(spark, sf):
    w = view(spark, sf, "writes")
    return rating_events(w), sessions(w)


@query("rating_rejects", ("writes",), "SELECT reason, count(*) AS writes FROM rv GROUP BY ALL", _REVIEW)
def rating_rejects(spark, sf):
    events, people = _study(spark, sf)
    return E.review_events(events, people).groupBy("reason").agg(F.count(F.lit(1)).alias("writes"))


@query("rating_upsert", ("writes",), """
    SELECT session_id, diagram_id, CAST(v % 10 + 1 AS INTEGER) AS layout, duration_ms, complete FROM cur""", _REVIEW)
def rating_upsert(spark, sf):
    current = E.current_ratings(*_study(spark, sf))
    return current.select("session_id", "diagram_id", F.col("scores")["layout"].alias("layout"), "duration_ms", "complete")


def _streamed(spark, sf):
    """The writes as a stream of several batches, and a fresh folder for a stream's results and checkpoint."""
    folder = f"{checkpoint_folder(spark)}/scenequality/stream-{uuid.uuid4().hex}"
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3, "event_id").write.parquet(f"{folder}/arriving")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/arriving")
    writes = stream.selectExpr(
        "event_id", "user_id AS session_id", "CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS diagram_id",
        "CAST(floor(value) AS BIGINT) AS v", "CAST(floor(value * 1000) AS BIGINT) AS duration_ms", "ts AS updated_at",
        "event_id % 37 = 0 AS too_high", "event_id % 41 = 0 AS unfinished")
    return writes, folder


@query("streamed_rating_upsert", ("writes",), """
    SELECT session_id, diagram_id, CAST(v % 10 + 1 AS INTEGER) AS layout, duration_ms, complete FROM cur""", _REVIEW)
def streamed_rating_upsert(spark, sf):
    """rating_upsert as a stream: reviewed, folded with one state row per key, saved batch by batch, read back."""
    writes, folder = _streamed(spark, sf)
    people = cut_lineage(sessions(view(spark, sf, "writes")))  # every batch reads it
    E.write_upserts(E.current_ratings(rating_events(writes), people), f"{folder}/ratings", f"{folder}/checkpoint").awaitTermination()
    current = E.saved_ratings(spark, f"{folder}/ratings")
    return current.select("session_id", "diagram_id", F.col("scores")["layout"].alias("layout"), "duration_ms", "complete")


@query("streamed_unique_scores", ("writes",), """
    SELECT DISTINCT session_id AS id, CAST(v % 5 AS VARCHAR) AS dimension, CAST(1 AS BIGINT) AS scores FROM writes""")
def streamed_unique_scores(spark, sf):
    """How often each (id, dimension) stands in an appended log that refuses repeats of earlier batches."""
    writes, folder = _streamed(spark, sf)
    scores = writes.select(F.col("session_id").alias("id"), (F.col("v") % 5).cast("string").alias("dimension"),
                           F.col("v").alias("score"), F.col("updated_at").alias("scored_at"))
    E.write_unique_scores(scores, f"{folder}/log", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/log").groupBy("id", "dimension").agg(F.count(F.lit(1)).alias("scores"))


@query("streamed_progress", ("writes",), f"""
    SELECT session_id, count(*) AS writes, count(*) FILTER (NOT unfinished) AS complete_writes, CAST(CAST(max(updated_at) AS DATE) AS VARCHAR) AS last_day
    FROM rv WHERE reason IS NULL GROUP BY ALL""", _REVIEW)
def streamed_progress(spark, sf):
    """Live counters per session over the accepted writes of a stream."""
    writes, folder = _streamed(spark, sf)
    people = cut_lineage(sessions(view(spark, sf, "writes")))
    good = E.review_events(rating_events(writes), people).filter(F.col("reason").isNull())
    E.write_latest(E.progress(good), f"{folder}/progress", f"{folder}/checkpoint").awaitTermination()
    last = F.to_date("last_write").cast("string").alias("last_day")
    return E.latest(spark, f"{folder}/progress", ["session_id"]).select("session_id", "writes", "complete_writes", last)


@query("study_progress", ("writes",), """
    , p AS (SELECT count(DISTINCT session_id) AS participants, count(DISTINCT CASE WHEN session_id % 3 = 0 THEN session_id END) AS completed FROM writes)
    SELECT any_value(participants) AS participants, any_value(completed) AS completed, count(*) AS saved, count(*) FILTER (complete) AS rated FROM cur, p""", _REVIEW)
def study_progress(spark, sf):
    events, people = _study(spark, sf)
    return D.study_progress(people, E.current_ratings(events, people))


_ASSIGNED = """asg AS (SELECT session_id, k AS diagram_id, row_number() OVER (PARTITION BY session_id ORDER BY k) AS presentation_order
    FROM (SELECT DISTINCT session_id FROM writes), (SELECT unnest(range(0, (SELECT max(diagram_id) + 1 FROM writes))) AS k) WHERE (k + session_id) % 4 = 0)"""


@query("ratings_export", ("writes",), """
    SELECT a.session_id, a.diagram_id, CASE WHEN a.session_id % 3 = 0 THEN 'completed' ELSE 'in_progress' END AS session_status,
           CAST(a.presentation_order AS INTEGER) AS presentation_order, CAST(c.v % 10 + 1 AS INTEGER) AS layout,
           CASE WHEN c.complete THEN CAST((c.v + 12) % 10 + 1 AS INTEGER) END AS canvas_fill,
           CASE WHEN c.complete THEN 1 ELSE 0 END AS rating_complete, c.duration_ms AS active_duration_ms
    FROM asg a LEFT JOIN cur c ON a.session_id = c.session_id AND a.diagram_id = c.diagram_id""", f"{_REVIEW}, {_ASSIGNED}")
def ratings_export(spark, sf):
    events, people = _study(spark, sf)
    current = E.current_ratings(events, people)
    shown = view(spark, sf, "catalog").select(F.col("item_no").alias("diagram_id"), "difficulty")
    out = D.export_rows(people, current, shown, scope="all")
    return out.select("session_id", "diagram_id", "session_status", "presentation_order", "layout", "canvas_fill", "rating_complete", "active_duration_ms")


@query("newest_sessions", ("writes",), """
    , s AS (SELECT session_id, min(updated_at) AS started_at FROM writes GROUP BY ALL), a AS (SELECT session_id, count(*) AS total FROM asg GROUP BY ALL),
    c AS (SELECT session_id, count(*) AS saved, count(*) FILTER (complete) AS rated FROM cur GROUP BY ALL)
    SELECT s.session_id, CAST(a.total AS INTEGER) AS total, coalesce(saved, 0) AS saved, coalesce(rated, 0) AS rated FROM s JOIN a USING (session_id) LEFT JOIN c USING (session_id)
    ORDER BY started_at DESC, s.session_id LIMIT 200""", f"{_REVIEW}, {_ASSIGNED}")
def newest_sessions(spark, sf):
    events, people = _study(spark, sf)
    return D.newest_sessions(people, E.current_ratings(events, people)).select("session_id", "total", "saved", "rated")


@query("submit_requests", ("writes",), """
    , o AS (SELECT DISTINCT a.session_id FROM asg a LEFT JOIN cur c ON a.session_id = c.session_id AND a.diagram_id = c.diagram_id WHERE coalesce(c.complete, false) = false)
    SELECT DISTINCT w.session_id, w.session_id % 3 = 0 OR o.session_id IS NULL AS submitted FROM writes w LEFT JOIN o ON w.session_id = o.session_id""", f"{_REVIEW}, {_ASSIGNED}")
def submit_requests(spark, sf):
    events, people = _study(spark, sf)
    asked = people.select("session_id", F.to_timestamp(F.lit("2024-02-01 00:00:00")).alias("requested_at"))
    out = E.submit(people, E.current_ratings(events, people), asked)
    return out.select("session_id", F.col("submitted_at").isNotNull().alias("submitted"))


@query("csv_cells", (), """
    SELECT doc_id, '"' || CASE WHEN regexp_matches(t, '^\\s*[=+@-]') THEN '''' ELSE '' END || replace(t, '"', '""') || '"' AS cell
    FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '=' || text WHEN 1 THEN text || ' "q"' ELSE text END AS t FROM documents)""")
def csv_cells(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("="), "text")).when(F.col("doc_id") % 3 == 1, F.concat("text", F.lit(' "q"'))).otherwise(F.col("text"))
    return d.select("doc_id", L.csv_safe(text).alias("cell"))


# --- judging ---
_TEMPLATES = {d: f"Rate {d} from 1 to 10." for d in ("presence", "layout", "connectivity", "details", "legibility")}
_DIMS = "(SELECT unnest([" + ", ".join(f"'{d}'" for d in _TEMPLATES) + "]) AS dimension) t"
_REQUESTS = f"""rq AS (SELECT doc_id AS diagram_id, dimension, sha256('Rate ' || dimension || ' from 1 to 10.' || chr(10) || 'Caption:' || chr(10) || text) AS request_key FROM documents, {_DIMS}),
    dn AS (SELECT diagram_id, dimension FROM rq WHERE (diagram_id + length(dimension)) % 3 = 0)"""


def _requests(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("diagram_id"), F.col("text").alias("caption"))
    return J.judge_requests(d, _TEMPLATES)


@query("judge_requests", (), "SELECT * FROM rq", _REQUESTS)
def judge_requests(spark, sf):
    return _requests(spark, sf).select("diagram_id", "dimension", "request_key")


@query("pending_jobs", (), "SELECT diagram_id, dimension FROM rq WHERE (diagram_id, dimension) NOT IN (SELECT diagram_id, dimension FROM dn)", _REQUESTS)
def pending_jobs(spark, sf):
    jobs = _requests(spark, sf).select("diagram_id", "dimension")
    done = jobs.filter((F.col("diagram_id") + F.length("dimension")) % 3 == 0)
    return J.pending(jobs, done, ["diagram_id", "dimension"])


@query("request_reuse", (), """
    , c AS (SELECT request_key, count(*) AS n FROM rq GROUP BY ALL)
    SELECT dimension, count(*) AS requests, count(DISTINCT request_key) AS calls FROM rq GROUP BY ALL""", _REQUESTS)
def request_reuse(spark, sf):
    rq = _requests(spark, sf)
    calls = J.distinct_requests(rq).select("request_key")
    per = rq.groupBy("dimension", "request_key").agg(F.count(F.lit(1)).alias("n"))
    return J.fan_out(per, calls).groupBy("dimension").agg(F.sum("n").alias("requests"), F.count(F.lit(1)).alias("calls"))


@query("scripted_judging", (), """
    , s AS (SELECT dimension, length('Rate ' || dimension || ' from 1 to 10.' || chr(10) || 'Caption:' || chr(10) || text) % 10 + 1 AS score FROM documents, """ + _DIMS + """)
    SELECT dimension, count(*) AS requests, """ + sql6("avg(score)", "mean_score") + """ FROM s GROUP BY ALL""", _REQUESTS)
def scripted_judging(spark, sf):
    """Answers of a fixed rule over the distinct prompts, as JSON text, parsed and copied to every request."""
    rq = _requests(spark, sf)
    answer = F.to_json(F.struct((F.char_length("prompt") % 10 + 1).alias("score"))).alias("answer")
    answers = J.distinct_requests(rq).select("request_key", answer)
    scores = answers.select("request_key", F.get_json_object("answer", "$.score").cast("int").alias("score"))
    return J.fan_out(rq.select("diagram_id", "dimension", "request_key"), scores).groupBy("dimension").agg(
        F.count(F.lit(1)).alias("requests"), r6(F.avg("score"), "mean_score"))


@query("component_checklist", ("components", "connections"), """
    , r AS (SELECT *, count(*) OVER (PARTITION BY diagram_id, lower(trim(label))) AS n FROM components),
    nm AS (SELECT *, CASE WHEN n > 1 THEN label || ' [' || component_id || ']' ELSE label END AS name FROM r),
    i AS (SELECT c.diagram_id, c.target AS component_id, string_agg(m.name, ', ' ORDER BY c.idx) AS s FROM connections c JOIN nm m ON c.diagram_id = m.diagram_id AND c.source = m.component_id GROUP BY ALL),
    o AS (SELECT c.diagram_id, c.source AS component_id, string_agg(m.name, ', ' ORDER BY c.idx) AS s FROM connections c JOIN nm m ON c.diagram_id = m.diagram_id AND c.target = m.component_id GROUP BY ALL)
    SELECT nm.diagram_id, nm.component_id, concat_ws('; ', 'receives from ' || i.s, 'feeds ' || o.s, CASE WHEN n > 1 THEN 'one of ' || CAST(n AS VARCHAR) || ' components with this label' END) AS context
    FROM nm LEFT JOIN i ON nm.diagram_id = i.diagram_id AND nm.component_id = i.component_id LEFT JOIN o ON nm.diagram_id = o.diagram_id AND nm.component_id = o.component_id""")
def component_checklist(spark, sf):
    share(spark, sf, "slots")  # both views read it
    out = J.component_checklist(view(spark, sf, "components"), view(spark, sf, "connections"))
    return out.select("diagram_id", "component_id", "context")


@query("sketch_lines", ("components", "connections"), """
    , a AS (SELECT c.*, s.label || ' -> ' || t.label || CASE WHEN c.label <> '' THEN ' (labeled ''' || c.label || ''')' ELSE '' END AS arrow
            FROM connections c JOIN components s ON c.diagram_id = s.diagram_id AND c.source = s.component_id JOIN components t ON c.diagram_id = t.diagram_id AND c.target = t.component_id)
    SELECT diagram_id, 'presence' AS dimension, 0 AS part, idx, '- [' || tier || '] ' || label AS line FROM components
    UNION ALL SELECT diagram_id, 'details', 0, idx, '- [' || tier || '] ' || label FROM components
    UNION ALL SELECT diagram_id, 'connectivity', 0, idx, '- [' || tier || '] ' || arrow FROM a UNION ALL SELECT diagram_id, 'layout', 0, idx, '- [' || tier || '] ' || arrow FROM a
    UNION ALL SELECT diagram_id, 'details', 1, idx, '- [' || tier || '] arrow ' || arrow FROM a WHERE label <> ''""")
def sketch_lines(spark, sf):
    return J.sketch_lines(view(spark, sf, "components"), view(spark, sf, "connections"))
