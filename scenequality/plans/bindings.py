"""Views that let the operators run on the driver tables.

The tables hold no drawings, so each view derives some with integer arithmetic that any SQL engine
repeats exactly: an order is a drawing, a line item is a labelled box, consecutive line numbers are
joined by arrows, and so on. The text is plain SQL for both Spark and the oracle engine; only the
few functions in ``_dialect`` differ. Elements are numbered inside their own order, so no number
depends on how large a key can get. To stage drawings with missing arrows, ``links`` leaves out every
sixth part, and ``arrow_texts`` labels every fifth link; these are fixtures, not samples.
"""

from __future__ import annotations

import re
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, functions as F

from scenequality.schemas import CORRECTNESS, SCORE_KEYS
from scenequality.session import cut_lineage

TABLES = ("lineitem", "part", "orders", "events", "documents", "labels", "pages", "benchmark", "conversations", "embeddings")


def _dialect(engine: str) -> dict:
    spark = engine == "spark"
    return {
        "div": (lambda a, b: f"({a} div {b})") if spark else (lambda a, b: f"({a} // {b})"),
        "sha_text": "sha2(text, 256)" if spark else "sha256(text)",
        "each_k": "LATERAL VIEW explode(sequence(0, 4)) kk AS k" if spark else ", (SELECT unnest(range(0, 5)) AS k) kk",
    }


_K_NAME = "CASE k " + " ".join(f"WHEN {i} THEN '{d}'" for i, d in enumerate(CORRECTNESS)) + " END"


def _views(engine: str) -> dict[str, tuple[str, tuple[str, ...]]]:
    """name -> (SQL, views it needs)."""
    d = _dialect(engine)
    return {
        # --- drawings from lineitem ---
        "box": ("""
            SELECT l_orderkey AS diagram_id, l_linenumber AS slot, l_partkey AS pk, l_suppkey AS sk,
                   CAST(8 * row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)
                     AS BIGINT) AS seq,
                   row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) AS nth,
                   CAST((37 * l_partkey) % 400 AS DOUBLE) AS x,
                   CAST((53 * l_suppkey + 97 * l_linenumber) % 300 AS DOUBLE) AS y,
                   20 + l_quantity AS w, CAST(20 + 5 * l_linenumber AS DOUBLE) AS h,
                   CASE WHEN l_partkey % 13 = 0 THEN 'TBD' WHEN l_partkey % 17 = 0 THEN upper(p_name)
                        ELSE p_name END AS text,
                   p_name, p_type, CAST(6 + l_linenumber AS DOUBLE) AS font
            FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""", ()),
        # the first box of each slot
        "slots": ("""
            SELECT diagram_id, slot, seq, pk, x, y, w, h, text, p_name, p_type, font FROM box WHERE nth = 1""", ("box",)),
        "rects": ("""
            SELECT diagram_id, seq, 'r' || CAST(seq AS STRING) AS element_id, 'rect' AS tag, x, y, w, h,
                   '' AS text, CAST(0 AS DOUBLE) AS font_size FROM box""", ("box",)),
        "backgrounds": ("""
            SELECT o_orderkey AS diagram_id, CAST(0 AS BIGINT) AS seq, 'bg' AS element_id, 'rect' AS tag,
                   CAST(0 AS DOUBLE) AS x, CAST(0 AS DOUBLE) AS y, CAST(400 AS DOUBLE) AS w, CAST(300 AS DOUBLE) AS h,
                   '' AS text, CAST(0 AS DOUBLE) AS font_size FROM {orders} WHERE o_orderkey % 10 = 0""", ()),
        "texts": ("""
            SELECT diagram_id, seq + 1 AS seq, 't' || CAST(seq AS STRING) AS element_id, 'text' AS tag,
                   x + w / 2 - tw / 2 + CASE WHEN pk % 9 = 0 THEN 45 ELSE 0 END AS x,
                   y + h / 2 - 6e-1 * font + CASE WHEN pk % 9 = 0 THEN 30 ELSE 0 END AS y,
                   tw AS w, 12e-1 * font AS h, text, font AS font_size
            FROM (SELECT *, greatest(font * 6e-1 * length(text), font * 4e-1) AS tw FROM box) b""", ("box",)),
        "links": ("""
            SELECT a.diagram_id, a.slot AS s_slot, b.slot AS t_slot, a.seq AS base, a.pk,
                   a.x + a.w / 2 AS x1, a.y + a.h / 2 AS y1,
                   b.x + b.w / 2 + (a.pk % 5) * 4 AS x2, b.y + b.h / 2 AS y2,
                   CASE WHEN a.pk % 5 = 0 THEN 'arrow' ELSE '' END AS marker_start,
                   CASE WHEN a.pk % 5 <> 0 AND a.pk % 8 <> 7 THEN 'arrow' ELSE '' END AS marker_end
            FROM slots a JOIN slots b ON a.diagram_id = b.diagram_id AND b.slot = a.slot + 1
            WHERE a.pk % 6 <> 0""", ("slots",)),
        "lines": ("""
            SELECT diagram_id, base + 2 AS seq, 'l' || CAST(base AS STRING) AS element_id, s_slot, t_slot,
                   x1, y1, x2, y2, marker_start, marker_end FROM links
            UNION ALL
            SELECT diagram_id, base + 3, 'd' || CAST(base AS STRING), s_slot, t_slot,
                   x1, y1 + 3, x2, y2 + 3, marker_start, marker_end FROM links WHERE pk % 11 = 3""", ("links",)),
        "arrow_texts": ("""
            SELECT diagram_id, base + 4 AS seq, 'a' || CAST(base AS STRING) AS element_id, 'text' AS tag,
                   (x1 + x2) / 2 - 8 AS x, (y1 + y2) / 2 - 5 AS y, CAST(16 AS DOUBLE) AS w, CAST(10 AS DOUBLE) AS h,
                   CASE WHEN (diagram_id + s_slot) % 10 = 0 THEN 'YES' ELSE 'NO' END AS text, CAST(12 AS DOUBLE) AS font_size
            FROM links WHERE (diagram_id + s_slot) % 5 = 0""", ("links",)),
        "canvas": ("""
            SELECT o_orderkey AS diagram_id, CAST(400 AS DOUBLE) AS width, CAST(300 AS DOUBLE) AS height,
                   CASE WHEN o_orderkey % 4 = 0 THEN CAST(5e-1 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS render_scale
            FROM {orders}""", ()),
        "components": ("""
            SELECT diagram_id, CAST(slot - 1 AS INT) AS idx, 'K' || CAST(slot AS STRING) AS component_id,
                   CASE WHEN slot % 4 = 0 THEN p_type ELSE p_name END AS label,
                   CASE WHEN slot = 7 THEN 'group' ELSE 'box' END AS kind,
                   CASE WHEN slot = 6 THEN 'typical' ELSE 'required' END AS tier FROM slots""", ("slots",)),
        "chain": ("""
            SELECT a.diagram_id, CAST(a.slot - 1 AS INT) AS idx, 'C' || CAST(a.slot AS STRING) AS connection_id,
                   'K' || CAST(a.slot AS STRING) AS source, 'K' || CAST(b.slot AS STRING) AS target,
                   CASE WHEN (a.diagram_id + a.slot) % 5 = 0 THEN 'YES' ELSE '' END AS label,
                   CASE WHEN a.slot = 5 THEN 'typical' ELSE 'required' END AS tier
            FROM slots a JOIN slots b ON a.diagram_id = b.diagram_id AND b.slot = a.slot + 1""", ("slots",)),
        "connections": ("""
            SELECT * FROM chain
            UNION ALL
            SELECT diagram_id, CAST(99 AS INT), 'C100', 'K' || CAST(hi AS STRING), 'K' || CAST(lo AS STRING), '', 'required'
            FROM (SELECT diagram_id, max(slot) AS hi, min(slot) AS lo FROM slots GROUP BY diagram_id) s
            WHERE hi > lo AND diagram_id % 3 = 0""", ("slots", "chain")),
        # each component is played by the first box of its slot, labelled by that box's text
        "slot_matches": ("""
            SELECT s.diagram_id, 'K' || CAST(s.slot AS STRING) AS component_id, CAST(s.slot - 1 AS INT) AS idx,
                   'label' AS method, 1e0 AS similarity, CAST(s.slot AS BIGINT) AS match_order, s.seq AS shape_seq, 'r' || CAST(s.seq AS STRING) AS shape_id,
                   s.x AS shape_x, s.y AS shape_y, s.w AS shape_w, s.h AS shape_h,
                   s.seq + 1 AS text_seq, 't' || CAST(s.seq AS STRING) AS text_id, s.text,
                   s.x + s.w / 2 - tw / 2 + CASE WHEN s.pk % 9 = 0 THEN 45 ELSE 0 END AS text_x,
                   s.y + s.h / 2 - 6e-1 * s.font + CASE WHEN s.pk % 9 = 0 THEN 30 ELSE 0 END AS text_y,
                   tw AS text_w, 12e-1 * s.font AS text_h
            FROM (SELECT *, greatest(font * 6e-1 * length(text), font * 4e-1) AS tw FROM slots) s""", ("slots",)),
        # --- a judge's answer about each drawing: components, connections, and what it says besides ---
        "said": ("""
            SELECT diagram_id, idx, component_id, label, kind, tier, verdict, visible_text, legible, pixels,
                   x0 / 1e2 AS x0, y0 / 1e2 AS y0, CASE WHEN empty THEN x0 ELSE x0 + 20 + base % 20 END / 1e2 AS x1, (y0 + 15 + base % 7) / 1e2 AS y1
            FROM (SELECT diagram_id, CAST(slot - 1 AS INT) AS idx, 'K' || CAST(slot AS STRING) AS component_id, pk % 13 = 5 AS empty, base, pk % 6 = 1 AS pixels,
                         CASE WHEN diagram_id % 5 = 0 THEN 'Stage' ELSE p_name END AS label, 'box' AS kind,
                         CASE WHEN slot = 6 THEN 'typical' ELSE 'required' END AS tier,
                         CASE pk % 9 WHEN 0 THEN 'absent' WHEN 1 THEN 'mislabeled' WHEN 2 THEN 'uncertain' ELSE 'present' END AS verdict,
                         CASE WHEN pk % 11 = 3 THEN ' ' ELSE text END AS visible_text, pk % 7 <> 2 AS legible,
                         base % 50 AS x0, base % 40 AS y0
                  FROM (SELECT *, CASE WHEN diagram_id % 4 = 0 THEN diagram_id ELSE pk END AS base FROM slots) s) t""", ("slots",)),
        "told": ("""
            SELECT diagram_id, pos, 'C' || CAST(pos + 1 AS STRING) AS connection_id, source, target, label, tier,
                   CASE (diagram_id + pos) % 6 WHEN 0 THEN 'reversed' WHEN 1 THEN 'absent' WHEN 2 THEN 'uncertain' ELSE 'present' END AS verdict,
                   CASE WHEN label = '' THEN '' WHEN (diagram_id + pos) % 3 = 0 THEN ' yes ' ELSE 'No' END AS visible_label, (diagram_id + pos) % 8 <> 3 AS legible
            FROM (SELECT *, CAST(row_number() OVER (PARTITION BY diagram_id ORDER BY idx) - 1 AS BIGINT) AS pos FROM chain) c""", ("chain",)),
        # --- judges' counts from events ---
        "panel": ("""
            SELECT CAST(CAST(ts AS DATE) AS STRING) AS diagram_id, event_id, user_id AS judge,
                   CASE event_type WHEN 'view' THEN 'presence' WHEN 'click' THEN 'layout' WHEN 'error' THEN 'connectivity'
                        WHEN 'signup' THEN 'details' ELSE 'legibility' END
                     || CASE WHEN event_id % 2 = 0 THEN '.a' ELSE '.b' END AS criterion_id,
                   4 + event_id % 7 AS expected_count, CAST(floor(value) AS BIGINT) % 9 AS detected_issues
            FROM {events}""", ()),
        "samples": ("""
            SELECT user_id AS diagram_id, event_type AS component_id, event_id AS sample_no,
                   CASE CAST(floor(value) AS BIGINT) % 4 WHEN 0 THEN 'present' WHEN 1 THEN 'mislabeled'
                        WHEN 2 THEN 'uncertain' ELSE 'absent' END AS verdict,
                   CAST(floor(value) AS BIGINT) % 7 AS detected_issues,
                   CAST(floor(value * 10) AS BIGINT) % 3 <> 0 AS label_legible
            FROM {events}""", ()),
        # --- human and judge scores from documents and labels ---
        "scored": (f"""
            SELECT doc_id AS id, lang AS difficulty, source AS rater, quality, n_chars, k AS position, {_K_NAME} AS dimension,
                   CASE WHEN quality = 1 THEN 'positive' ELSE 'negative' END AS label,
                   1 + (doc_id * 7 + k * 3 + quality * 4) % 10 AS human,
                   1 + (doc_id * 7 + k * 3 + quality * 4 + n_chars % 3) % 10 AS judge
            FROM (SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality FROM {{documents}} d
                  JOIN {{labels}} l ON d.doc_id = l.doc_id) b {d['each_k']}""", ()),
        "errors": ("""
            SELECT d.doc_id AS id,
                   power(1 + (d.doc_id * 7 + l.quality * 4) % 10 - (1 + 9 * (d.n_chars % 101) / 1e2), 2) AS error_a,
                   power(1 + (d.doc_id * 7 + l.quality * 4) % 10
                         - (1 + 9 * ((d.doc_id * 7 + l.quality * 4 + d.n_chars % 5) % 11) / 1e1), 2) AS error_b
            FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id""", ()),
        # --- ablation variants from events ---
        "variant_scores": (f"""
            SELECT user_id AS id, event_type AS kind, event_id AS variant,
                   CASE event_type WHEN 'click' THEN 'presence' WHEN 'error' THEN 'layout'
                        WHEN 'purchase' THEN 'connectivity' END AS target,
                   CAST(floor(value * 13) AS BIGINT) % 2000 - 1 AS changed_px, {_K_NAME} AS dimension,
                   (CAST(floor(value * 100) AS BIGINT) * (3 + k) % 101) / 1e2 AS score
            FROM {{events}} {d['each_k']} WHERE event_type <> 'view'""", ()),
        "baseline_scores": (f"""
            SELECT user_id AS id, event_id AS run, {_K_NAME} AS dimension,
                   (60 + CAST(floor(value * 100) AS BIGINT) * (3 + k) % 41) / 1e2 AS score
            FROM {{events}} {d['each_k']} WHERE event_type = 'view'""", ()),
        # --- catalog from documents ---
        "catalog": (f"""
            SELECT d.doc_id + 1 AS row, d.doc_id AS item_no, {d['sha_text']} AS sha256, d.source AS article,
                   'D' || CAST(d.doc_id AS STRING) AS id,
                   'figure' || CAST(d.doc_id AS STRING) || CASE WHEN d.doc_id % 50 = 7 THEN '.txt' ELSE '.png' END AS file,
                   CASE d.n_chars % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty,
                   CASE WHEN l.quality = 1 THEN 'positive' WHEN l.quality = 0 THEN 'negative' ELSE '' END AS label,
                   d.text AS caption, d.n_chars
            FROM {{documents}} d LEFT JOIN {{labels}} l ON d.doc_id = l.doc_id""", ()),
        # --- rating writes from events ---
        "writes": ("""
            SELECT event_id, user_id AS session_id, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS diagram_id,
                   CAST(floor(value) AS BIGINT) AS v, CAST(floor(value * 1000) AS BIGINT) AS duration_ms, ts AS updated_at,
                   event_id % 37 = 0 AS too_high, event_id % 41 = 0 AS unfinished
            FROM {events}""", ()),
    }


def _closure(views: dict, name: str, seen: list[str]) -> list[str]:
    for need in views[name][1]:
        _closure(views, need, seen)
    if name not in seen:
        seen.append(name)
    return seen


def _readings(views: dict, name: str, target: str) -> int:
    """How often the text of a view reads ``target``, itself or through the views it needs."""
    text, needs = views[name]
    used = lambda need: len(re.findall(rf"\b(?:FROM|JOIN) {need}\b", text))
    return sum(used(need) * (1 if need == target else _readings(views, need, target)) for need in needs)


def oracle_with(*names: str) -> str:
    """WITH clause (oracle dialect) defining the named views over the registered tables."""
    views = _views("duck")
    order: list[str] = []
    for name in names:
        _closure(views, name, order)
    body = ",\n".join(f"{n} AS ({views[n][0]})" for n in order)
    for t in TABLES:
        body = body.replace("{%s}" % t, t)
    return f"WITH {body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Views that one query may read many times; from the second reading on they are written once and shared.
SHARED = ("arrow_texts", "links", "slots", "box")
_scope: ContextVar[dict | None] = ContextVar("shared views of the running query", default=None)


@contextmanager
def sharing():
    """Share views inside one call of a query; nothing outlives the call, so later calls see changed tables."""
    token = _scope.set({})
    try:
        yield
    finally:
        _scope.reset(token)


def _shared(spark: SparkSession, sf_dir: str, name: str) -> DataFrame | None:
    scope = _scope.get()
    if scope is None:
        return None
    if name not in scope:
        scope[name] = None
        return None
    if scope[name] is None:
        _share_needs(spark, sf_dir, name)
        scope[name] = cut_lineage(_view(spark, sf_dir, name))
    return scope[name]


def _share_needs(spark: SparkSession, sf_dir: str, name: str) -> None:
    """Share what the text of a view reads more than once."""
    for shared in SHARED:
        if shared != name and _readings(_views("spark"), name, shared) > 1:
            share(spark, sf_dir, shared)
            return


def share(spark: SparkSession, sf_dir: str, name: str) -> None:
    """Write a shared view before its first reading, where it is known that more follow."""
    for _ in range(2):
        _shared(spark, sf_dir, name)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the derived views as a DataFrame."""
    _share_needs(spark, sf_dir, name)
    found = _shared(spark, sf_dir, name) if name in SHARED else None
    return _view(spark, sf_dir, name) if found is None else found


def _view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    views = dict(_views("spark"))
    used = {}
    for shared in SHARED:  # the widest first, as what it needs is then no longer read
        if shared != name and shared in _closure(views, name, []):
            found = _shared(spark, sf_dir, shared)
            if found is not None:
                views[shared] = ("SELECT * FROM {_%s}" % shared, ())
                used[f"_{shared}"] = found
    order = _closure(views, name, [])
    body = ",\n".join(f"{n} AS ({views[n][0]})" for n in order)
    used |= {t: table(spark, sf_dir, t) for t in TABLES if "{%s}" % t in body}
    return spark.sql(f"WITH {body} SELECT * FROM {name}", **{k: v for k, v in used.items() if "{%s}" % k in body})


# --- typed tables for the operators ---
_PLAIN = ["diagram_id", "seq", "element_id", "tag", "x", "y", "w", "h", "text", "font_size"]


def elements(spark: SparkSession, sf_dir: str, parts: tuple[str, ...] = ("rects", "texts", "lines", "arrow_texts", "backgrounds")) -> DataFrame:
    """The elements table of the derived drawings."""
    if len(set(parts) - {"backgrounds"}) > 1:
        share(spark, sf_dir, "box")
    if "arrow_texts" in parts and "rects" in parts:  # texts are read several times where they meet shapes
        share(spark, sf_dir, "arrow_texts")
    out = None
    for name in parts:
        rows = view(spark, sf_dir, name)
        point = lambda a, b: F.struct(F.col(a).alias("x"), F.col(b).alias("y"))
        if name == "lines":
            rows = rows.select(
                "diagram_id", "seq", "element_id", F.lit("line").alias("tag"), F.least("x1", "x2").alias("x"), F.least("y1", "y2").alias("y"),
                F.abs(F.col("x2") - F.col("x1")).alias("w"), F.abs(F.col("y2") - F.col("y1")).alias("h"), F.lit("").alias("text"),
                F.lit(0.0).alias("font_size"), "marker_start", "marker_end", F.array(point("x1", "y1"), point("x2", "y2")).alias("points"))
        else:
            rows = rows.select(*_PLAIN, F.lit("").alias("marker_start"), F.lit("").alias("marker_end"),
                               F.array().cast("array<struct<x:double,y:double>>").alias("points"))
        rows = rows.withColumn("fill", F.lit("")).withColumn("stroke", F.lit(""))
        out = rows if out is None else out.unionByName(rows)
    return out


def with_defects(rows: DataFrame) -> DataFrame:
    """Inserted defects of negative documents."""
    names = F.array(*map(F.lit, CORRECTNESS))
    pick = lambda n: F.element_at(names, (n % 5 + 1).cast("int"))
    first = F.struct(F.concat(F.lit("d"), (F.col("id") % 4).cast("string")).alias("defect"), F.concat(pick(F.col("id")), F.lit(".x")).alias("criterion"))
    second = F.struct(F.lit("extra").alias("defect"), F.concat(pick(F.col("id") + 2), F.lit(".y")).alias("criterion"))
    return rows.withColumn("defects", F.when(F.col("id") % 3 == 0, F.array(first, second)).otherwise(F.array(first)))


def rating_events(writes: DataFrame) -> DataFrame:
    """Writes with the thirteen-key score map (one key too high, or one missing, on marked rows)."""
    entries = [F.struct(F.lit(k).alias("key"), F.when(F.col("too_high") & F.lit(i == 0), F.lit(11)).otherwise(
        ((F.col("v") + i) % 10 + 1).cast("int")).alias("value")) for i, k in enumerate(SCORE_KEYS)]
    full = F.map_from_entries(F.array(*entries))
    part = F.map_from_entries(F.array(*entries[:-1]))
    return writes.select("event_id", "session_id", "diagram_id", F.when(F.col("unfinished"), part).otherwise(full).alias("scores"),
                         F.lit("").alias("comment"), "duration_ms", "updated_at")


def sessions(writes: DataFrame) -> DataFrame:
    """A session per user: every fourth drawing up to the largest rated one assigned, every third session submitted."""
    last = F.coalesce(writes.agg(F.max("diagram_id")).scalar(), F.lit(0)).cast("bigint")
    per = writes.groupBy("session_id").agg(F.min("updated_at").alias("started_at")).withColumn("_last", last)
    drawings = F.filter(F.sequence(F.lit(0).cast("bigint"), F.col("_last")), lambda k: (k + F.col("session_id")) % 4 == 0)
    done = F.when(F.col("session_id") % 3 == 0, F.to_timestamp(F.lit("2024-01-20 00:00:00")))
    return per.withColumn("assignment", drawings).withColumn("submitted_at", done).drop("_last")


def components_of_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scenario per drawing with at least two slots: its labels in slot order follow one another."""
    rows = view(spark, sf_dir, "slots").groupBy(F.col("diagram_id").cast("string").alias("scenario")).agg(
        F.array_sort(F.collect_list(F.struct("slot", "p_name"))).alias("_n")).filter(F.size("_n") > 1)
    nodes = F.transform("_n", lambda s: s["p_name"])
    edges = F.transform(F.sequence(F.lit(1), F.size("_n") - 1), lambda i: F.struct(
        F.element_at(nodes, i).alias("source"), F.element_at(nodes, i + 1).alias("target")))
    return rows.select("scenario", nodes.alias("nodes"), edges.alias("edges"))
