"""Drawing queries over line items: geometry, arrows, labels, matching, graphs, measurements, markup."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenequality.functions import geometry as G
from scenequality.functions import labels as L
from scenequality.operators import beauty as Y, connectors as C, evaluation as E, graph as R, matching as M, panel as P, scene as S, spatial_rules as Q
from scenequality.operators.agreement import spread
from scenequality.plans.bindings import elements, share, view
from scenequality.plans.registry import query, r6, sql6
from scenequality.schemas import RUBRIC, criteria_table
from scenequality.session import cut_lineage
from scenequality.sources import markup

# --- oracle fragments ---
_SHAPES = "shapes AS (SELECT * FROM rects UNION ALL SELECT * FROM backgrounds)"
_TEXTS = "alltexts AS (SELECT * FROM texts UNION ALL SELECT * FROM arrow_texts)"
_TEXT_VIEWS = ("texts", "arrow_texts")
_SHAPE_VIEWS = ("rects", "backgrounds")


def _contains(o: str, i: str, t: str = "0") -> str:
    return (f"{o}.x - {t} <= {i}.x AND {o}.y - {t} <= {i}.y AND {o}.x + {o}.w + {t} >= {i}.x + {i}.w "
            f"AND {o}.y + {o}.h + {t} >= {i}.y + {i}.h")


def _overlap(a: str, b: str) -> str:
    return (f"greatest(0, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x)) * "
            f"greatest(0, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y)) / least({a}.w * {a}.h, {b}.w * {b}.h)")


_CONTAINERS = f"""holders AS (SELECT DISTINCT a.diagram_id, a.element_id FROM shapes a JOIN shapes b
    ON a.diagram_id = b.diagram_id AND a.element_id <> b.element_id AND {_contains('a', 'b', '1e-1')})"""
_LEAVES = "leaves AS (SELECT * FROM shapes WHERE (diagram_id, element_id) NOT IN (SELECT diagram_id, element_id FROM holders))"
_COLLIDE = f"""collide AS (SELECT a.diagram_id, a.element_id, arg_min(b.element_id, b.seq) AS partner_id FROM leaves a JOIN leaves b
    ON a.diagram_id = b.diagram_id AND a.seq <> b.seq AND {_overlap('a', 'b')} > 1e-2 GROUP BY a.diagram_id, a.element_id)"""
_PLACED = """placed AS (SELECT t.diagram_id, t.seq AS text_seq, t.element_id AS text_id, t.text, t.x, t.y, t.w, t.h,
    s.seq AS shape_seq, s.element_id AS shape_id, s.x AS sx, s.y AS sy, s.w AS sw, s.h AS sh
    FROM alltexts t LEFT JOIN shapes s ON t.diagram_id = s.diagram_id AND s.x <= t.x + t.w / 2 AND t.x + t.w / 2 <= s.x + s.w
         AND s.y <= t.y + t.h / 2 AND t.y + t.h / 2 <= s.y + s.h
    QUALIFY row_number() OVER (PARTITION BY t.diagram_id, t.seq ORDER BY s.w * s.h, s.seq) = 1)"""
_OVERFLOW = f"""overflow AS (SELECT p.diagram_id, text_id, shape_id AS other_id,
        CASE WHEN NOT (sx <= x AND sy <= y AND sx + sw >= x + w AND sy + sh >= y + h) THEN 'overflow' END AS issue
    FROM placed p WHERE shape_seq IS NOT NULL
    UNION ALL
    SELECT p.diagram_id, p.text_id, any_value(q.other), CASE WHEN any_value(q.other) IS NOT NULL THEN 'collision' END
    FROM placed p LEFT JOIN (SELECT a.diagram_id, a.text_seq, arg_min(b.element_id, b.seq) AS other FROM placed a JOIN alltexts b
        ON a.diagram_id = b.diagram_id AND a.text_seq <> b.seq AND a.shape_seq IS NULL AND {_overlap('a', 'b')} > 2e-1
        GROUP BY a.diagram_id, a.text_seq) q ON p.diagram_id = q.diagram_id AND p.text_seq = q.text_seq
    WHERE p.shape_seq IS NULL GROUP BY p.diagram_id, p.text_id, p.text_seq)"""
_FONTS = """fonts AS (SELECT t.diagram_id, t.element_id, t.font_size * c.render_scale AS rendered, t.font_size * c.render_scale < 12 AS small
    FROM alltexts t JOIN canvas c ON t.diagram_id = c.diagram_id)"""
_ELS = """els AS (SELECT diagram_id, seq, element_id, tag, x, y, w, h FROM shapes UNION ALL SELECT diagram_id, seq, element_id, tag, x, y, w, h FROM alltexts
    UNION ALL SELECT diagram_id, seq, element_id, 'line', least(x1, x2), least(y1, y2), abs(x2 - x1), abs(y2 - y1) FROM lines)"""
_OUTSIDE = "NOT (-5e-1 <= x AND -5e-1 <= y AND 4005e-1 >= x + w AND 3005e-1 >= y + h)"
_COVERS = "(tag = 'rect' AND x - 5e-1 <= 0 AND y - 5e-1 <= 0 AND x + w + 5e-1 >= 400 AND y + h + 5e-1 >= 300)"
_UNITS = f"""units AS (SELECT diagram_id, element_id AS unit_id, {_OUTSIDE} AS outside FROM els e
        WHERE NOT {_COVERS} AND (diagram_id, seq) NOT IN (SELECT diagram_id, shape_seq FROM slot_matches UNION ALL SELECT diagram_id, text_seq FROM slot_matches)
    UNION ALL SELECT diagram_id, component_id, {_OUTSIDE} FROM (SELECT diagram_id, component_id, least(shape_x, text_x) AS x, least(shape_y, text_y) AS y,
        greatest(shape_x + shape_w, text_x + text_w) - least(shape_x, text_x) AS w, greatest(shape_y + shape_h, text_y + text_h) - least(shape_y, text_y) AS h FROM slot_matches))"""


def _els(spark, sf, *parts):
    return elements(spark, sf, parts) if parts else elements(spark, sf)


def _v(name):
    return lambda spark, sf: view(spark, sf, name)


canvas, matches, components, connections = _v("canvas"), _v("slot_matches"), _v("components"), _v("connections")


# --- geometry ---
@query("shape_containers", _SHAPE_VIEWS, "SELECT * FROM holders", f"{_SHAPES}, {_CONTAINERS}")
def shape_containers(spark, sf):
    return S.containers(S.shapes_of(_els(spark, sf, "rects", "backgrounds")))


@query("shape_collisions", _SHAPE_VIEWS, "SELECT * FROM collide", f"{_SHAPES}, {_CONTAINERS}, {_LEAVES}, {_COLLIDE}")
def shape_collisions(spark, sf):
    return S.shape_collisions(_els(spark, sf, "rects", "backgrounds"))


@query("declared_collisions", (*_SHAPE_VIEWS, "components", "slot_matches"), f"""
    , fg AS (SELECT * FROM shapes WHERE NOT (x <= 0 AND y <= 0 AND x + w >= 400 AND y + h >= 300)),
    free AS (SELECT * FROM fg WHERE (diagram_id, element_id) NOT IN (SELECT m.diagram_id, m.shape_id FROM slot_matches m JOIN components c
             USING (diagram_id, component_id) WHERE c.kind IN ('group', 'container')))
    SELECT a.diagram_id, a.element_id, arg_min(b.element_id, b.seq) AS partner_id FROM free a JOIN free b
    ON a.diagram_id = b.diagram_id AND a.seq <> b.seq AND {_overlap('a', 'b')} > 1e-2 GROUP BY ALL""", _SHAPES)
def declared_collisions(spark, sf):
    els = _els(spark, sf, "rects", "backgrounds")
    no_groups = components(spark, sf).select("diagram_id", F.col("component_id").alias("container")).filter("1 = 0")
    pool = S.declared_leaves(els, canvas(spark, sf), components(spark, sf), no_groups, matches(spark, sf))
    return S.shape_collisions(els, shapes=pool)


@query("smallest_container", (*_SHAPE_VIEWS, *_TEXT_VIEWS), "SELECT diagram_id, text_id, text, shape_id FROM placed", f"{_SHAPES}, {_TEXTS}, {_PLACED}")
def smallest_container(spark, sf):
    return S.smallest_container(_els(spark, sf, "rects", "backgrounds", "texts", "arrow_texts")).select("diagram_id", "text_id", "text", "shape_id")


@query("text_overflow", (*_SHAPE_VIEWS, *_TEXT_VIEWS), "SELECT * FROM overflow", f"{_SHAPES}, {_TEXTS}, {_PLACED}, {_OVERFLOW}")
def text_overflow(spark, sf):
    return S.text_overflow(_els(spark, sf, "rects", "backgrounds", "texts", "arrow_texts"))


@query("min_font", (*_TEXT_VIEWS, "canvas"), "SELECT * FROM fonts", f"{_TEXTS}, {_FONTS}")
def min_font(spark, sf):
    return S.font_checks(_els(spark, sf, "texts", "arrow_texts"), canvas(spark, sf))


_CANVAS_VIEWS = (*_SHAPE_VIEWS, *_TEXT_VIEWS, "lines", "slot_matches")


@query("outside_canvas", _CANVAS_VIEWS, "SELECT * FROM units", f"{_SHAPES}, {_TEXTS}, {_ELS}, {_UNITS}")
def outside_canvas(spark, sf):
    return S.canvas_units(_els(spark, sf), canvas(spark, sf), matches(spark, sf))


_UNEXPECTED = """unexpected AS (SELECT diagram_id, shape_id, arg_min(text, text_seq) AS text FROM placed p WHERE shape_seq IS NOT NULL
        AND (diagram_id, shape_seq) NOT IN (SELECT diagram_id, shape_seq FROM slot_matches) AND (diagram_id, text_seq) NOT IN (SELECT diagram_id, text_seq FROM slot_matches)
        AND NOT EXISTS (SELECT 1 FROM slot_matches m WHERE m.diagram_id = p.diagram_id AND sx <= shape_x AND sy <= shape_y
                        AND sx + sw >= shape_x + shape_w AND sy + sh >= shape_y + shape_h) GROUP BY ALL)"""


@query("unexpected_boxes", (*_SHAPE_VIEWS, *_TEXT_VIEWS, "slot_matches"), "SELECT * FROM unexpected", f"{_SHAPES}, {_TEXTS}, {_PLACED}, {_UNEXPECTED}")
def unexpected_boxes(spark, sf):
    return S.unexpected_boxes(_els(spark, sf, "rects", "backgrounds", "texts", "arrow_texts"), matches(spark, sf))


@query("stray_placeholders", (*_TEXT_VIEWS, "slot_matches"), """
    SELECT diagram_id, element_id, text FROM alltexts WHERE lower(text) IN ('tbd', 'todo', 'placeholder', 'thing', 'thing 1', 'layer', 'unknown')
    AND (diagram_id, seq) NOT IN (SELECT diagram_id, text_seq FROM slot_matches)""", _TEXTS)
def stray_placeholders(spark, sf):
    return S.stray_placeholders(_els(spark, sf, "texts", "arrow_texts"), matches(spark, sf), ascii_only=True)


@query("scene_diff", ("rects",), """
    SELECT diagram_id, element_id, CASE WHEN h = 30 THEN 'removed' ELSE 'changed' END AS change FROM rects WHERE h = 30 OR w = 25""")
def scene_diff(spark, sf):
    before = _els(spark, sf, "rects")
    after = before.filter("h <> 30").withColumn("w", F.when(F.col("w") == 25, F.lit(26.0)).otherwise(F.col("w")))
    return S.scene_diff(before, after)


# --- arrows ---
def _dist(px, py, m):
    return (f"sqrt(power(greatest({m}.shape_x - {px}, 0, {px} - ({m}.shape_x + {m}.shape_w)), 2) + "
            f"power(greatest({m}.shape_y - {py}, 0, {py} - ({m}.shape_y + {m}.shape_h)), 2))")


_DIRECTED = """ends AS (SELECT diagram_id, seq, element_id, x1, y1, x2, y2, marker_start <> '' OR marker_end <> '' AS has_head,
    CASE WHEN marker_start <> '' AND marker_end = '' THEN x2 ELSE x1 END AS tx, CASE WHEN marker_start <> '' AND marker_end = '' THEN y2 ELSE y1 END AS ty,
    CASE WHEN marker_start <> '' AND marker_end = '' THEN x1 ELSE x2 END AS hx, CASE WHEN marker_start <> '' AND marker_end = '' THEN y1 ELSE y2 END AS hy FROM lines)"""


# distances of both ends to every matched shape of the drawing, computed once; the nearest in reach wins
_ARROWS = f"""{_DIRECTED},
    reached AS MATERIALIZED (SELECT e.diagram_id, e.seq, m.component_id, m.shape_w * m.shape_h AS area, m.match_order,
        {_dist('e.tx', 'e.ty', 'm')} AS dt, {_dist('e.hx', 'e.hy', 'm')} AS dh FROM ends e JOIN slot_matches m ON e.diagram_id = m.diagram_id),
    nearest AS (SELECT diagram_id, seq,
        arg_min(component_id, {{'d': dt, 'a': area, 'o': match_order}}) FILTER (dt <= 175e-1) AS source,
        arg_min(component_id, {{'d': dh, 'a': area, 'o': match_order}}) FILTER (dh <= 175e-1) AS target FROM reached GROUP BY ALL),
    attached AS MATERIALIZED (SELECT e.diagram_id, e.seq, e.element_id, e.x1, e.y1, e.x2, e.y2, e.has_head, n.source, n.target FROM ends e
        LEFT JOIN nearest n ON e.diagram_id = n.diagram_id AND e.seq = n.seq),
    arrows AS (SELECT * FROM attached WHERE has_head OR source IS DISTINCT FROM target)"""
_ARROW_VIEWS = ("lines", "slot_matches", "connections")
# the k-th expected edge of a pair takes the k-th arrow; leftovers meet in the opposite direction
_RECONCILE = """ex AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY diagram_id, source, target ORDER BY idx) AS k FROM connections),
    ar AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY diagram_id, source, target ORDER BY seq) AS k FROM arrows WHERE source IS NOT NULL AND target IS NOT NULL),
    p1 AS MATERIALIZED (SELECT ex.diagram_id, ex.connection_id, ar.seq, ar.element_id FROM ex JOIN ar USING (diagram_id, source, target, k)),
    ex2 AS (SELECT *, row_number() OVER (PARTITION BY diagram_id, source, target ORDER BY idx) AS k2 FROM ex ANTI JOIN p1 USING (diagram_id, connection_id)),
    ar2 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY diagram_id, source, target ORDER BY seq) AS k2 FROM ar ANTI JOIN p1 USING (diagram_id, seq)),
    p2 AS MATERIALIZED (SELECT a.diagram_id, a.connection_id, b.seq, b.element_id FROM ex2 a JOIN ar2 b ON a.diagram_id = b.diagram_id AND a.source = b.target AND a.target = b.source AND a.k2 = b.k2),
    verdicts AS (SELECT c.diagram_id, c.connection_id, c.source, c.target, c.label, c.tier, coalesce(p1.seq, p2.seq) AS arrow_seq,
            CASE WHEN p1.seq IS NOT NULL THEN 'present' WHEN p2.seq IS NOT NULL THEN 'reversed' ELSE 'absent' END AS status, coalesce(p1.element_id, p2.element_id) AS arrow_id
        FROM connections c LEFT JOIN p1 ON c.diagram_id = p1.diagram_id AND c.connection_id = p1.connection_id
        LEFT JOIN p2 ON c.diagram_id = p2.diagram_id AND c.connection_id = p2.connection_id),
    extras AS (SELECT diagram_id, element_id, 'unmatched' AS reason FROM ar2 ANTI JOIN p2 USING (diagram_id, seq)
        UNION ALL SELECT diagram_id, element_id, CASE WHEN source IS NULL AND target IS NULL THEN 'both ends loose' ELSE 'one end loose' END
        FROM arrows WHERE source IS NULL OR target IS NULL)"""


def _arrows(spark, sf):
    return C.drawn_arrows(_els(spark, sf, "lines"), matches(spark, sf), canvas(spark, sf))


@query("nearest_shape", _ARROW_VIEWS, "SELECT diagram_id, element_id, source, target FROM attached WHERE source IS NOT NULL OR target IS NOT NULL", _ARROWS)
def nearest_shape(spark, sf):
    lines = C.connectors_of(_els(spark, sf, "lines"))
    ends = C.attach_endpoints(lines, C.match_pool(matches(spark, sf)), canvas(spark, sf))
    return ends.join(lines.select("diagram_id", "seq", "element_id"), ["diagram_id", "seq"]).select("diagram_id", "element_id", "source", "target")


@query("drawn_arrows", _ARROW_VIEWS, "SELECT diagram_id, element_id, source, target FROM arrows", _ARROWS)
def drawn_arrows(spark, sf):
    return _arrows(spark, sf).select("diagram_id", "element_id", "source", "target")


@query("edge_reconciliation", _ARROW_VIEWS, "SELECT diagram_id, connection_id, status, arrow_id FROM verdicts", f"{_ARROWS}, {_RECONCILE}")
def edge_reconciliation(spark, sf):
    return C.reconcile(connections(spark, sf), _arrows(spark, sf))[0].select("diagram_id", "connection_id", "status", "arrow_id")


@query("extra_arrows", _ARROW_VIEWS, "SELECT * FROM extras", f"{_ARROWS}, {_RECONCILE}")
def extra_arrows(spark, sf):
    return C.reconcile(connections(spark, sf), _arrows(spark, sf))[1].select("diagram_id", "element_id", "reason")


@query("duplicate_arrows", _ARROW_VIEWS, """
    , w AS (SELECT DISTINCT diagram_id, source, target FROM connections)
    SELECT a.diagram_id, a.element_id, CASE WHEN w.diagram_id IS NULL THEN 'unexpected'
           WHEN row_number() OVER (PARTITION BY a.diagram_id, a.source, a.target ORDER BY a.seq) > 1 THEN 'duplicate' END AS issue
    FROM arrows a LEFT JOIN w ON a.diagram_id = w.diagram_id AND a.source = w.source AND a.target = w.target""", _ARROWS)
def duplicate_arrows(spark, sf):
    return C.attachment_issues(connections(spark, sf), _arrows(spark, sf)).select("diagram_id", "element_id", "issue")


_SEG = ("CASE WHEN a.x1 = a.x2 AND a.y1 = a.y2 THEN 0 ELSE greatest(0, least(1, ((f.px - a.x1) * (a.x2 - a.x1) + (f.py - a.y1) * (a.y2 - a.y1)) / "
        "((a.x2 - a.x1) * (a.x2 - a.x1) + (a.y2 - a.y1) * (a.y2 - a.y1)))) END")
_ARROW_LABELS = f"""freetext AS (SELECT diagram_id, seq, text, x + w / 2 AS px, y + h / 2 AS py FROM alltexts t WHERE (diagram_id, seq) NOT IN (SELECT diagram_id, text_seq FROM slot_matches)
        AND NOT EXISTS (SELECT 1 FROM slot_matches m WHERE m.diagram_id = t.diagram_id AND m.shape_x <= t.x + t.w / 2 AND t.x + t.w / 2 <= m.shape_x + m.shape_w
                        AND m.shape_y <= t.y + t.h / 2 AND t.y + t.h / 2 <= m.shape_y + m.shape_h)),
    gap AS (SELECT f.diagram_id, f.seq, f.text, a.seq AS arrow_seq, sqrt(power(px - (x1 + u * (x2 - x1)), 2) + power(py - (y1 + u * (y2 - y1)), 2)) AS d
        FROM (SELECT f.*, a.seq AS aseq, {_SEG} AS u FROM freetext f JOIN arrows a ON f.diagram_id = a.diagram_id) f JOIN arrows a ON f.diagram_id = a.diagram_id AND f.aseq = a.seq),
    near1 AS (SELECT * FROM gap WHERE d <= 175e-1 QUALIFY row_number() OVER (PARTITION BY diagram_id, seq ORDER BY d, arrow_seq) = 1),
    arrowlabels AS (SELECT diagram_id, arrow_seq, text AS visible_label FROM near1 QUALIFY row_number() OVER (PARTITION BY diagram_id, arrow_seq ORDER BY d, seq) = 1)"""


@query("arrow_labels", (*_ARROW_VIEWS, *_TEXT_VIEWS), "SELECT * FROM arrowlabels", f"{_TEXTS}, {_ARROWS}, {_ARROW_LABELS}")
def arrow_labels(spark, sf):
    share(spark, sf, "box")
    arrows = _arrows(spark, sf)  # first, as the links it writes hold the places of the texts too
    return C.arrow_labels(_els(spark, sf, "texts", "arrow_texts"), arrows, matches(spark, sf), canvas(spark, sf))


# --- verdicts and counts from geometry ---
_KEPT = "kept AS (SELECT * FROM slot_matches WHERE shape_x <> 37 AND match_order + diagram_id % 7 <> 5)"
_VERDICTS = """cv AS (SELECT c.diagram_id, c.component_id, c.tier, CASE WHEN m.component_id IS NULL THEN 'absent'
    WHEN lower(m.text) = lower(c.label) THEN 'present' ELSE 'mislabeled' END AS verdict, coalesce(m.text, '') AS visible_text
    FROM components c LEFT JOIN kept m USING (diagram_id, component_id))"""


def _kept(spark, sf):
    return matches(spark, sf).filter("shape_x <> 37 and match_order + diagram_id % 7 <> 5")


def _verdicts(spark, sf):
    return M.match_verdicts(components(spark, sf), _kept(spark, sf), canvas(spark, sf), ascii_only=True)


@query("component_verdicts", ("slot_matches", "components"), "SELECT diagram_id, component_id, verdict, visible_text FROM cv", f"{_KEPT}, {_VERDICTS}")
def component_verdicts(spark, sf):
    return _verdicts(spark, sf).select("diagram_id", "component_id", "verdict", "visible_text")


@query("component_metrics", ("slot_matches", "components"), """
    SELECT diagram_id, 'presence.elements' AS criterion_id, count(*) FILTER (tier <> 'typical') AS expected_count,
           count(*) FILTER (tier <> 'typical' AND verdict = 'absent') AS detected_issues FROM cv GROUP BY ALL
    UNION ALL SELECT diagram_id, 'details.labels', count(*) FILTER (verdict <> 'absent'), count(*) FILTER (verdict = 'mislabeled') FROM cv GROUP BY ALL""",
    f"{_KEPT}, {_VERDICTS}")
def component_metrics(spark, sf):
    typical = components(spark, sf).filter("tier = 'typical'")
    return P.component_metrics(_verdicts(spark, sf), typical).select("diagram_id", "criterion_id", "expected_count", "detected_issues")


_APP = """app AS (SELECT v.*, l.visible_label FROM verdicts v LEFT JOIN arrowlabels l ON v.diagram_id = l.diagram_id AND v.arrow_seq = l.arrow_seq
              WHERE (v.diagram_id, source) IN (SELECT diagram_id, component_id FROM cv WHERE verdict <> 'absent')
                AND (v.diagram_id, target) IN (SELECT diagram_id, component_id FROM cv WHERE verdict <> 'absent'))"""


@query("connection_metrics", (*_ARROW_VIEWS, *_TEXT_VIEWS, "components"), """
    , q AS (SELECT diagram_id, count(*) FILTER (tier <> 'typical') AS re, count(*) FILTER (tier <> 'typical' AND status = 'absent') AS ri,
                 count(*) FILTER (status <> 'absent') AS pe, count(*) FILTER (status = 'reversed' AND tier <> 'typical') AS pi,
                 count(*) FILTER (status <> 'absent' AND label <> '') AS le,
                 count(*) FILTER (status <> 'absent' AND label <> '' AND coalesce(lower(visible_label), '') <> 'yes') AS li FROM app GROUP BY ALL),
    x AS (SELECT diagram_id, count(*) AS n FROM extras GROUP BY ALL),
    z AS (SELECT coalesce(q.diagram_id, x.diagram_id) AS diagram_id, coalesce(re, 0) AS re, coalesce(ri, 0) AS ri, coalesce(pe, 0) + coalesce(n, 0) AS pe,
                 coalesce(pi, 0) + coalesce(n, 0) AS pi, coalesce(le, 0) AS le, coalesce(li, 0) AS li FROM q FULL JOIN x ON q.diagram_id = x.diagram_id)
    SELECT diagram_id, 'connectivity.connections' AS criterion_id, re AS expected_count, ri AS detected_issues FROM z
    UNION ALL SELECT diagram_id, 'connectivity.endpoints', pe, pi FROM z UNION ALL SELECT diagram_id, 'details.connection_labels', le, li FROM z""",
    f"{_KEPT}, {_VERDICTS}, {_TEXTS}, {_ARROWS}, {_RECONCILE}, {_ARROW_LABELS}, {_APP}")
def connection_metrics(spark, sf):
    share(spark, sf, "box")
    arrows = _arrows(spark, sf)  # first, as the links it writes hold the places of the texts too
    expected = cut_lineage(connections(spark, sf))
    links, extras = C.reconcile(expected, arrows)
    shown = C.arrow_labels(_els(spark, sf, "texts", "arrow_texts"), arrows, matches(spark, sf), canvas(spark, sf))
    rows = links.join(shown, ["diagram_id", "arrow_seq"], "left").select(
        "diagram_id", F.lit("geometry").alias("judge"), "connection_id", "source", "target", "status", F.col("label").alias("expected_label"),
        L.normalize_label(F.col("label"), True).alias("expected_norm"), L.normalize_label(F.col("visible_label"), True).alias("visible_norm"),
        F.lit(True).alias("label_legible"))
    typical = expected.filter("tier = 'typical'").select("diagram_id", "connection_id")
    judged = extras.select("diagram_id", F.lit("geometry").alias("judge"))
    verdicts = cut_lineage(_verdicts(spark, sf).select("diagram_id", "judge", "component_id", "verdict"))  # for either end of a connection
    out = P.connection_metrics(cut_lineage(rows), verdicts, judged, typical=typical)
    return out.select("diagram_id", "criterion_id", "expected_count", "detected_issues")


# --- labels ---
_DRAWN = """drawn AS (SELECT diagram_id, component_id, label, CASE WHEN diagram_id % 19 = 0 THEN left(p_name, 1) || left(split_part(p_name, ' ', 2), 1) ELSE text END AS text,
    component_id AS ident FROM components JOIN slots USING (diagram_id) WHERE component_id = 'K' || CAST(slot AS VARCHAR)),
    tok AS (SELECT *, array_to_string(regexp_extract_all(lower(label), '[\\p{L}\\p{N}]+'), ' ') AS e, array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), ' ') AS a,
            array_to_string(regexp_extract_all(lower(ident), '[\\p{L}\\p{N}]+'), ' ') AS i FROM drawn),
    lst AS (SELECT *, list_distinct(string_split(e, ' ')) AS et, list_distinct(string_split(a, ' ')) AS tt, list_distinct(string_split(i, ' ')) AS it,
            array_to_string(list_transform(string_split(e, ' '), lambda t: left(t, 1)), '') AS acr FROM tok),
    sim AS (SELECT *, len(list_intersect(et, tt)) / len(list_distinct(list_concat(et, tt))) AS j,
            length(a) >= 2 AND NOT contains(a, ' ') AND contains(e, ' ') AND contains(acr, a) AS abbr FROM lst)"""


@query("label_scores", ("components", "slots"), f"""
    SELECT diagram_id, component_id, text, abbr AS abbreviation,
           CASE WHEN a = '' THEN 0e0 WHEN a = e OR a = i THEN 1e0 WHEN list_has_all(et, tt) OR list_has_all(tt, et) THEN 8e-1 WHEN list_has_all(it, tt) THEN 8e-1
                WHEN abbr THEN greatest(round(j, 6), 75e-2) ELSE round(j, 6) END AS similarity,
           CASE WHEN a = e THEN true WHEN list_sort(list_filter(tt, lambda t: regexp_full_match(t, '[0-9]+'))) <> list_sort(list_filter(et, lambda t: regexp_full_match(t, '[0-9]+'))) THEN false
                ELSE j >= 5e-1 END AS matches,
           a IN ('tbd', 'todo', 'placeholder', 'thing', 'thing 1', 'layer', 'unknown') OR contains(text, '???') AS placeholder FROM sim""", _DRAWN)
def label_scores(spark, sf):
    slots = view(spark, sf, "slots").select("diagram_id", F.concat(F.lit("K"), F.col("slot").cast("string")).alias("component_id"), "text", "p_name")
    initials = F.concat(F.left("p_name", F.lit(1)), F.left(F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit(1)))
    rows = components(spark, sf).join(slots, ["diagram_id", "component_id"]).withColumn(
        "text", F.when(F.col("diagram_id") % 19 == 0, initials).otherwise(F.col("text")))
    rows = rows.withColumns({"e": L.normalize_label(F.col("label"), True), "a": L.normalize_label(F.col("text"), True),
                             "i": L.normalize_label(L.identifier_text(F.col("component_id")), True)})
    e, a = F.col("e"), F.col("a")
    return rows.select(
        "diagram_id", "component_id", "text", L.is_abbreviation(a, e).alias("abbreviation"),
        F.round(L.label_similarity(e, F.col("i"), a), 6).alias("similarity"), L.labels_match(a, e).alias("matches"),
        L.is_placeholder(F.col("text"), a).alias("placeholder"))


_ASSIGNED = """cand AS (SELECT p.diagram_id, c.idx, c.component_id, p.text_seq, p.text_id, p.shape_seq, p.shape_id, p.sy, p.sx,
            array_to_string(regexp_extract_all(lower(c.label), '[a-z0-9]+'), ' ') AS e, array_to_string(regexp_extract_all(lower(p.text), '[a-z0-9]+'), ' ') AS a, lower(c.component_id) AS i
            FROM placed p JOIN components c ON p.diagram_id = c.diagram_id WHERE p.shape_seq IS NOT NULL),
    l AS (SELECT *, list_distinct(string_split(e, ' ')) AS et, list_distinct(string_split(a, ' ')) AS tt FROM cand),
    s AS (SELECT *, CASE WHEN a = e OR a = i THEN 1e0 WHEN list_has_all(et, tt) OR list_has_all(tt, et) THEN 8e-1
            ELSE len(list_intersect(et, tt)) / len(list_distinct(list_concat(et, tt))) END AS sim FROM l),
    o AS (SELECT *, row_number() OVER (PARTITION BY diagram_id ORDER BY sim DESC, idx, sy, sx, text_seq) AS r FROM s WHERE sim >= 45e-2),
    g AS (SELECT diagram_id, list_reduce(list_prepend({'n': [0], 'c': [-1], 't': [CAST(-1 AS BIGINT)]}, list({'n': [CAST(r AS INTEGER)], 'c': [idx], 't': [text_seq]} ORDER BY r)),
            lambda x, y: CASE WHEN list_contains(x.c, y.c[1]) OR list_contains(x.t, y.t[1]) THEN x
                         ELSE {'n': list_concat(x.n, y.n), 'c': list_concat(x.c, y.c), 't': list_concat(x.t, y.t)} END) AS won FROM o GROUP BY diagram_id),
    w AS (SELECT diagram_id, unnest(won.n) AS r FROM g),
    assigned AS MATERIALIZED (SELECT o.* FROM o JOIN w ON o.diagram_id = w.diagram_id AND o.r = w.r)"""


@query("label_assignment", (*_SHAPE_VIEWS, "texts", "components"), """
    SELECT diagram_id, component_id, text_id, shape_id, round(sim, 6) + 0.0e0 AS similarity FROM assigned""",
    f"{_SHAPES}, alltexts AS (SELECT * FROM texts), {_PLACED}, {_ASSIGNED}")
def label_assignment(spark, sf):
    els = _els(spark, sf, "rects", "backgrounds", "texts")
    return M.match_labels(els, components(spark, sf), ascii_only=True).select(
        "diagram_id", "component_id", "text_id", "shape_id", r6(F.col("similarity"), "similarity"))


# one component per drawing and step: the one with most drawn links to matched parts, if a single unused element has them
_ROLES = f"""ends2 AS (SELECT diagram_id, seq, 'tail' AS side, tx AS px, ty AS py FROM ends UNION ALL SELECT diagram_id, seq, 'head', hx, hy FROM ends),
    near AS MATERIALIZED (SELECT e.diagram_id, e.seq, e.side, s.seq AS shape, s.w * s.h AS area,
        sqrt(power(greatest(s.x - px, 0, px - (s.x + s.w)), 2) + power(greatest(s.y - py, 0, py - (s.y + s.h)), 2)) AS d
        FROM ends2 e JOIN shapes s ON e.diagram_id = s.diagram_id
        WHERE sqrt(power(greatest(s.x - px, 0, px - (s.x + s.w)), 2) + power(greatest(s.y - py, 0, py - (s.y + s.h)), 2)) <= 175e-1),
    holds AS MATERIALIZED (SELECT a.diagram_id, a.seq AS outer_, b.seq AS inner_ FROM shapes a JOIN shapes b ON a.diagram_id = b.diagram_id AND {_contains('a', 'b')}),
    sides AS MATERIALIZED (SELECT DISTINCT diagram_id, target AS component_id, source AS other, 'in' AS way FROM connections
        UNION SELECT DISTINCT diagram_id, source, target, 'out' FROM connections)"""
_RECOVERED = """SELECT DISTINCT f.diagram_id, f.c AS component_id, CASE WHEN f.k < f.n THEN 'label' ELSE 'role' END AS method, s.element_id AS shape_id FROM (
    WITH RECURSIVE rec AS (
        SELECT diagram_id, count(*) AS n, list({'c': component_id, 's': shape_seq, 'k': k} ORDER BY k) AS ms FROM (
            SELECT *, row_number() OVER (PARTITION BY diagram_id ORDER BY r) - 1 AS k FROM assigned) GROUP BY diagram_id
        UNION ALL
        (WITH m AS (SELECT diagram_id, u.c AS component_id, u.s AS shape, u.k AS k FROM (SELECT diagram_id, unnest(ms) AS u FROM rec)),
        blocked AS (SELECT DISTINCT h.diagram_id, h.outer_ AS shape FROM m JOIN holds h ON h.diagram_id = m.diagram_id AND h.inner_ = m.shape),
        own AS (SELECT diagram_id, shape, arg_min(component_id, k) AS component_id, min(k) AS k FROM m GROUP BY ALL),
        pool AS (SELECT n.diagram_id, n.seq, n.side, arg_min({'c': o.component_id, 's': n.shape}, {'d': d, 'a': area, 'l': o.k IS NULL, 'o': coalesce(o.k, n.shape)}) AS hit
            FROM near n JOIN (SELECT DISTINCT diagram_id FROM m) USING (diagram_id)
            LEFT JOIN own o ON o.diagram_id = n.diagram_id AND o.shape = n.shape LEFT JOIN blocked b ON b.diagram_id = n.diagram_id AND b.shape = n.shape
            WHERE o.k IS NOT NULL OR b.shape IS NULL GROUP BY ALL),
        links AS (SELECT a.diagram_id, a.hit.c AS ac, a.hit.s AS sa, b.hit.c AS bc, b.hit.s AS sb FROM pool a JOIN pool b
            ON a.diagram_id = b.diagram_id AND a.seq = b.seq AND a.side = 'tail' AND b.side = 'head'),
        drawn AS (SELECT diagram_id, ac AS other, sb AS shape, 'in' AS way FROM links WHERE ac IS NOT NULL AND bc IS NULL
            UNION SELECT diagram_id, bc, sa, 'out' FROM links WHERE bc IS NOT NULL AND ac IS NULL),
        support AS (SELECT c.diagram_id, c.component_id, c.idx, d.shape, count(*) AS links FROM components c JOIN sides e USING (diagram_id, component_id)
            JOIN drawn d ON d.diagram_id = c.diagram_id AND d.other = e.other AND d.way = e.way ANTI JOIN m ON m.diagram_id = c.diagram_id AND m.component_id = c.component_id GROUP BY ALL),
        top AS (SELECT diagram_id, component_id, idx, max(links) AS links, arg_max(shape, links) AS shape, list(links) AS every FROM support GROUP BY ALL),
        chosen AS (SELECT diagram_id, arg_min({'c': component_id, 's': shape}, {'l': -links, 'i': idx}) AS pick FROM top
            WHERE links >= 2 AND len(list_filter(every, lambda v: v = links)) = 1 GROUP BY diagram_id)
        SELECT r.diagram_id, r.n, list_append(r.ms, {'c': pick.c, 's': pick.s, 'k': CAST(len(r.ms) AS BIGINT)}) FROM rec r JOIN chosen USING (diagram_id)))
    SELECT diagram_id, n, u.c AS c, u.s AS s, u.k AS k FROM (SELECT diagram_id, n, unnest(ms) AS u FROM rec)) f
    JOIN shapes s ON s.diagram_id = f.diagram_id AND s.seq = f.s"""


@query("role_recovery", (*_SHAPE_VIEWS, *_TEXT_VIEWS, "lines", "components", "connections"), _RECOVERED,
       f"{_SHAPES}, {_TEXTS}, {_PLACED}, {_ASSIGNED}, {_DIRECTED}, {_ROLES}")
def role_recovery(spark, sf):
    """Label matches completed by connection evidence."""
    els = cut_lineage(_els(spark, sf))  # read for labels, shapes and connectors
    found = M.match_labels(els, components(spark, sf), ascii_only=True)
    out = M.recover_roles(els, components(spark, sf), connections(spark, sf), found, canvas(spark, sf), ascii_only=True)
    return out.select("diagram_id", "component_id", "method", "shape_id")


# every way to lay the expected graph over the drawn one, component by component; a drawing counts if there is exactly one
_LAID = f"""gnodes AS MATERIALIZED (SELECT * FROM shapes a WHERE NOT EXISTS (SELECT 1 FROM shapes b WHERE a.diagram_id = b.diagram_id AND a.seq <> b.seq
        AND a.w * a.h > b.w * b.h AND {_contains('a', 'b', '1e-1')})),
    gends AS (SELECT diagram_id, seq, 's' AS side, tx AS px, ty AS py FROM ends UNION ALL SELECT diagram_id, seq, 't', hx, hy FROM ends),
    gdist AS (SELECT e.diagram_id, e.seq, e.side, n.element_id, n.seq AS o, n.w * n.h AS area,
        sqrt(power(greatest(n.x - px, 0, px - (n.x + n.w)), 2) + power(greatest(n.y - py, 0, py - (n.y + n.h)), 2)) AS d FROM gends e JOIN gnodes n ON e.diagram_id = n.diagram_id),
    gnear AS (SELECT diagram_id, seq, arg_min(element_id, {{'d': d, 'a': area, 'o': o}}) FILTER (side = 's') AS s, arg_min(element_id, {{'d': d, 'a': area, 'o': o}}) FILTER (side = 't') AS t
        FROM gdist WHERE d <= 175e-1 GROUP BY ALL),
    gat AS MATERIALIZED (SELECT l.diagram_id, l.seq, s, t FROM ends l LEFT JOIN gnear n ON l.diagram_id = n.diagram_id AND l.seq = n.seq),
    gexp AS MATERIALIZED (SELECT DISTINCT diagram_id, source AS s, target AS t FROM connections),
    gcid AS MATERIALIZED (SELECT diagram_id, s AS node FROM gexp UNION SELECT diagram_id, t FROM gexp),
    gtouch AS MATERIALIZED (SELECT diagram_id, s AS node FROM gat WHERE s IS NOT NULL AND t IS NOT NULL UNION SELECT diagram_id, t FROM gat WHERE s IS NOT NULL AND t IS NOT NULL),
    gfit AS MATERIALIZED (SELECT diagram_id FROM (SELECT diagram_id, count(*) AS n, count(*) FILTER (s IS NULL OR t IS NULL) AS loose FROM gat GROUP BY diagram_id)
        JOIN (SELECT diagram_id, count(*) AS e FROM gexp GROUP BY diagram_id) USING (diagram_id) JOIN (SELECT diagram_id, count(*) AS c FROM gcid GROUP BY diagram_id) USING (diagram_id)
        JOIN (SELECT diagram_id, count(*) AS u FROM gtouch GROUP BY diagram_id) USING (diagram_id) WHERE loose = 0 AND n = e AND c = u),
    ganchor AS (SELECT m.diagram_id, m.component_id, m.shape_id FROM slot_matches m JOIN components c USING (diagram_id, component_id) JOIN gcid k ON k.diagram_id = m.diagram_id AND k.node = m.component_id
        WHERE lower(m.text) = lower(c.label) AND (SELECT count(*) FROM components o WHERE o.diagram_id = c.diagram_id AND lower(o.label) = lower(c.label)) = 1),
    gleft AS MATERIALIZED (SELECT k.diagram_id, k.node, a.component_id AS anchor, row_number() OVER (PARTITION BY k.diagram_id ORDER BY k.node) AS i FROM gcid k JOIN gfit USING (diagram_id)
        LEFT JOIN ganchor a ON a.diagram_id = k.diagram_id AND a.component_id = k.node),
    gright AS MATERIALIZED (SELECT k.diagram_id, k.node, min(a.component_id) AS anchor FROM gtouch k JOIN gfit USING (diagram_id)
        LEFT JOIN ganchor a ON a.diagram_id = k.diagram_id AND a.shape_id = k.node GROUP BY ALL),
    gsets AS MATERIALIZED (SELECT diagram_id, (SELECT list(s || '>' || t) FROM gexp e WHERE e.diagram_id = f.diagram_id) AS es,
        (SELECT list(DISTINCT s || '>' || t) FROM gat e WHERE e.diagram_id = f.diagram_id) AS ds FROM gfit f)"""
_UNIQUE = """, sol AS MATERIALIZED (SELECT * FROM (WITH RECURSIVE rec AS (
        SELECT diagram_id, CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS cids, CAST([] AS VARCHAR[]) AS nodes FROM gfit
        UNION ALL
        SELECT r.diagram_id, r.k + 1, list_append(cids, l.node), list_append(nodes, g.node) FROM rec r JOIN gleft l ON l.diagram_id = r.diagram_id AND l.i = r.k + 1
            JOIN gright g ON g.diagram_id = r.diagram_id AND coalesce(g.anchor, '') = coalesce(l.anchor, '') JOIN gsets x ON x.diagram_id = r.diagram_id
        WHERE NOT list_contains(nodes, g.node) AND list_contains(es, l.node || '>' || l.node) = list_contains(ds, g.node || '>' || g.node)
            AND len(list_filter(range(1, len(cids) + 1), lambda j: list_contains(es, cids[j] || '>' || l.node) <> list_contains(ds, nodes[j] || '>' || g.node)
                OR list_contains(es, l.node || '>' || cids[j]) <> list_contains(ds, g.node || '>' || nodes[j]))) = 0)
        SELECT * FROM rec) z WHERE k > 0 AND k = (SELECT count(*) FROM gleft l WHERE l.diagram_id = z.diagram_id)),
    laid AS (SELECT diagram_id, unnest(cids) AS component_id, unnest(nodes) AS shape_id FROM sol WHERE diagram_id IN (SELECT diagram_id FROM sol GROUP BY diagram_id HAVING count(*) = 1)),
    named AS (SELECT diagram_id, shape_id, arg_max(text, text_seq) AS text FROM placed WHERE shape_id IS NOT NULL GROUP BY ALL)
    SELECT m.diagram_id, m.component_id, m.method, m.shape_id FROM slot_matches m ANTI JOIN laid USING (diagram_id, component_id)
    UNION ALL SELECT l.diagram_id, l.component_id, CASE WHEN lower(t.text) = lower(c.label) THEN 'label' ELSE 'role' END, l.shape_id FROM laid l JOIN components c USING (diagram_id, component_id)
        LEFT JOIN named t ON t.diagram_id = l.diagram_id AND t.shape_id = l.shape_id"""


@query("unique_graph", (*_SHAPE_VIEWS, *_TEXT_VIEWS, "lines", "slot_matches", "components", "connections"), _UNIQUE,
       f"{_SHAPES}, {_TEXTS}, {_PLACED}, {_DIRECTED}, {_LAID}")
def unique_graph(spark, sf):
    """Whole-graph correspondence on top of the slot matches."""
    els = cut_lineage(_els(spark, sf))  # read for shapes, connectors and labels
    out = R.match_unique_graph(els, components(spark, sf), connections(spark, sf), matches(spark, sf), canvas(spark, sf), ascii_only=True)
    return out.select("diagram_id", "component_id", "method", "shape_id")


# --- reading direction and required placement ---
_BOTH = """mv AS (SELECT c.diagram_id, c.connection_id, (b.shape_x + b.shape_w / 2) - (a.shape_x + a.shape_w / 2) AS dx, (b.shape_y + b.shape_h / 2) - (a.shape_y + a.shape_h / 2) AS dy
    FROM connections c JOIN slot_matches a ON c.diagram_id = a.diagram_id AND c.source = a.component_id JOIN slot_matches b ON c.diagram_id = b.diagram_id AND c.target = b.component_id
    WHERE c.connection_id <> 'C100' OR NOT EXISTS (SELECT 1 FROM lp WHERE lp.diagram_id = c.diagram_id)),
    ax AS (SELECT diagram_id, sum(abs(dy)) >= sum(abs(dx)) AS vert, sum(dx) AS sx, sum(dy) AS sy FROM mv GROUP BY ALL)"""
_LOOPS = """lp AS (SELECT diagram_id FROM slots GROUP BY diagram_id HAVING count(*) = max(slot) - min(slot) + 1 AND max(slot) > min(slot) AND diagram_id % 3 = 0)"""


@query("reading_direction", ("connections", "slot_matches", "slots"), """
    SELECT diagram_id, connection_id, CASE WHEN vert AND sy >= 0 THEN 'top-to-bottom' WHEN vert THEN 'bottom-to-top' WHEN sx >= 0 THEN 'left-to-right' ELSE 'right-to-left' END AS direction,
           CASE WHEN vert THEN CASE WHEN sy >= 0 THEN dy ELSE -dy END ELSE CASE WHEN sx >= 0 THEN dx ELSE -dx END END < -5 AS against FROM mv JOIN ax USING (diagram_id)""",
    f"{_LOOPS}, {_BOTH}")
def reading_direction(spark, sf):
    share(spark, sf, "slots")
    links = cut_lineage(connections(spark, sf))  # read for the loops and for the moves
    loops = R.feedback_edges(components(spark, sf), links)
    return Q.reading_direction(links, matches(spark, sf), loops).select("diagram_id", "connection_id", "direction", "against")


# --- all criteria of a drawing at once ---
_PLAYED = ", ".join(f.replace("slot_matches", "kept") for f in (
    _SHAPES, _TEXTS, _CONTAINERS, _LEAVES, _COLLIDE, _PLACED, _OVERFLOW, _FONTS, _ELS, _UNITS, _UNEXPECTED, _ARROWS, _RECONCILE, _ARROW_LABELS,
    _APP, _LOOPS, _BOTH))
_METRICS = """metrics AS (
    SELECT diagram_id, 'presence.elements' AS criterion_id, count(*) AS e, count(*) FILTER (verdict = 'absent') AS i FROM cv WHERE tier <> 'typical' GROUP BY diagram_id
    UNION ALL SELECT diagram_id, 'presence.unexpected', count(*), CAST(sum(i) AS BIGINT) FROM (SELECT diagram_id, 0 AS i FROM cv WHERE verdict <> 'absent'
        UNION ALL SELECT diagram_id, 1 FROM unexpected) GROUP BY diagram_id
    UNION ALL SELECT diagram_id, 'layout.order', count(*), count(*) FILTER (CASE WHEN vert THEN CASE WHEN sy >= 0 THEN dy ELSE -dy END ELSE CASE WHEN sx >= 0 THEN dx ELSE -dx END END < -5)
        FROM mv JOIN ax USING (diagram_id) GROUP BY diagram_id
    UNION ALL SELECT diagram_id, 'layout.canvas', count(*), count(*) FILTER (outside) FROM units GROUP BY diagram_id
    UNION ALL SELECT diagram_id, 'layout.overlap', count(*), count(*) FILTER ((diagram_id, element_id) IN (SELECT diagram_id, element_id FROM collide)) FROM leaves GROUP BY diagram_id
    UNION ALL SELECT diagram_id, 'connectivity.connections', count(*), count(*) FILTER (status = 'absent') FROM app WHERE tier <> 'typical' GROUP BY diagram_id
    UNION ALL SELECT diagram_id, 'connectivity.endpoints', count(*), CAST(sum(i) AS BIGINT) FROM (SELECT diagram_id, CASE WHEN status = 'reversed' AND tier <> 'typical' THEN 1 ELSE 0 END AS i
        FROM app WHERE status <> 'absent' UNION ALL SELECT diagram_id, 1 FROM extras) GROUP BY diagram_id
    UNION ALL SELECT diagram_id, 'details.labels', count(*), count(*) FILTER (verdict = 'mislabeled') FROM cv WHERE verdict <> 'absent' GROUP BY diagram_id
    UNION ALL SELECT diagram_id, 'details.connection_labels', count(*), count(*) FILTER (coalesce(lower(visible_label), '') <> 'yes') FROM app
        WHERE status <> 'absent' AND label <> '' GROUP BY diagram_id
    UNION ALL SELECT diagram_id, 'legibility.overflow', count(*), count(issue) FROM overflow GROUP BY diagram_id
    UNION ALL SELECT diagram_id, 'legibility.minimum_font', count(*), count(*) FILTER (small) FROM fonts GROUP BY diagram_id)"""
EVALUATION_VIEWS = (*_CANVAS_VIEWS, "canvas", "components", "connections")
EVALUATION_CTES = f"{_KEPT}, {_VERDICTS}, {_PLAYED}, {_METRICS}"


def scene(spark, sf, **options):
    return E.Scene(_els(spark, sf), canvas(spark, sf), components(spark, sf), connections(spark, sf), _kept(spark, sf), ascii_only=True, **options)


@query("scene_metrics", EVALUATION_VIEWS, "SELECT diagram_id, criterion_id, e AS expected_count, i AS detected_issues FROM metrics", EVALUATION_CTES)
def scene_metrics(spark, sf):
    """Opportunities and issues of every criterion that geometry can answer."""
    return E.evaluate_metrics(scene(spark, sf), RUBRIC).select("diagram_id", "criterion_id", "expected_count", "detected_issues")


@query("scene_overall_score", EVALUATION_VIEWS, f"""
    , d AS (SELECT diagram_id, split_part(criterion_id, '.', 1) AS dimension, min(least(greatest(0, least(1, (e - i) / e)), power(75e-2, i))) AS score
            FROM metrics WHERE e > 0 GROUP BY ALL)
    SELECT diagram_id, {sql6('round(avg(score), 9)', 'overall')}, count(*) AS dimensions FROM d GROUP BY diagram_id""", EVALUATION_CTES)
def scene_overall_score(spark, sf):
    """All geometry criteria of every drawing to one weighted score over its dimensions."""
    rubric = criteria_table(spark)
    panel = P.aggregate_panel(E.evaluate_metrics(scene(spark, sf), RUBRIC), rubric, "minimum", 0.75)
    out = P.weighted_overall(panel, P.equal_weights(rubric))
    return out.select("diagram_id", r6(F.round("overall", 9), "overall"), "dimensions")


@query("feedback_edges", ("slots",), "SELECT diagram_id, 'C100' AS connection_id FROM lp", _LOOPS)
def feedback_edges(spark, sf):
    return R.feedback_edges(components(spark, sf), connections(spark, sf))


@query("cycle_edges", ("slots", "connections"), "SELECT diagram_id, connection_id FROM connections WHERE diagram_id IN (SELECT diagram_id FROM lp)", _LOOPS)
def cycle_edges(spark, sf):
    return R.cycle_edges(connections(spark, sf)).select("diagram_id", "connection_id")


@query("node_degrees", ("connections",), """
    , e AS (SELECT diagram_id, source AS node, 0 AS i, 1 AS o FROM connections UNION ALL SELECT diagram_id, target, 1, 0 FROM connections)
    SELECT diagram_id, node, CAST(sum(i) AS BIGINT) AS indegree, CAST(sum(o) AS BIGINT) AS outdegree FROM e GROUP BY ALL""")
def node_degrees(spark, sf):
    return R.degrees(connections(spark, sf))


_AXIS = "CASE diagram_id % 4 WHEN 0 THEN 'top_to_bottom' WHEN 1 THEN 'bottom_to_top' WHEN 2 THEN 'left_to_right' ELSE 'right_to_left' END"
_CX, _CY = "shape_x + {0}.shape_w / 2", "shape_y + {0}.shape_h / 2"
_PAIRS = """pr AS (SELECT a.diagram_id, a.component_id AS first, b.component_id AS second, a.diagram_id % 4 AS k, a.shape_x + a.shape_w / 2 AS ax, a.shape_y + a.shape_h / 2 AS ay,
    b.shape_x + b.shape_w / 2 AS bx, b.shape_y + b.shape_h / 2 AS by_, least(a.shape_h, b.shape_h) AS mh, least(a.shape_w, b.shape_w) AS mw, a.match_order AS ma, b.match_order AS mb
    FROM slot_matches a JOIN slot_matches b ON a.diagram_id = b.diagram_id AND a.match_order < b.match_order)"""


def _listed(spark, sf):
    """Components of a drawing in slot order (at most seven slots)."""
    return matches(spark, sf).groupBy("diagram_id").agg(F.array_sort(F.collect_set("component_id")).alias("components"))


@query("required_sequences", ("slot_matches",), """
    SELECT diagram_id, first, second, CASE k WHEN 0 THEN by_ - ay WHEN 1 THEN ay - by_ WHEN 2 THEN bx - ax ELSE ax - bx END <= 5 AS issue FROM pr""", _PAIRS)
def required_sequences(spark, sf):
    rows = _listed(spark, sf).select("diagram_id", F.lit(0).alias("seq_no"), F.expr(_AXIS).alias("axis"), "components")
    return Q.check_sequences(rows, matches(spark, sf)).select("diagram_id", "first", "second", "issue")


@query("required_relations", ("slot_matches",), """
    SELECT diagram_id, first, CASE k WHEN 0 THEN 'above' WHEN 1 THEN 'left_of' WHEN 2 THEN 'same_row' ELSE 'same_column' END AS relation, second,
           NOT CASE k WHEN 0 THEN ay + 5 < by_ WHEN 1 THEN ax + 5 < bx WHEN 2 THEN abs(ay - by_) <= mh / 2 ELSE abs(ax - bx) <= mw / 2 END AS issue FROM pr WHERE mb = ma + 1""", _PAIRS)
def required_relations(spark, sf):
    kind = F.element_at(F.array(*map(F.lit, ("above", "left_of", "same_row", "same_column"))), (F.col("diagram_id") % 4 + 1).cast("int"))
    rows = view(spark, sf, "chain").select("diagram_id", F.col("source").alias("first"), kind.alias("relation"), F.col("target").alias("second"))
    return Q.check_relations(rows, matches(spark, sf)).select("diagram_id", "first", "relation", "second", "issue")


@query("required_containment", ("slot_matches",), """
    , f AS (SELECT diagram_id, arg_min(component_id, match_order) AS container FROM slot_matches GROUP BY ALL)
    SELECT f.diagram_id, container, m.component_id AS member, NOT (c.shape_x - 5e-1 <= m.shape_x AND c.shape_y - 5e-1 <= m.shape_y
        AND c.shape_x + c.shape_w + 5e-1 >= m.shape_x + m.shape_w AND c.shape_y + c.shape_h + 5e-1 >= m.shape_y + m.shape_h) AS issue
    FROM f JOIN slot_matches c ON f.diagram_id = c.diagram_id AND c.component_id = container JOIN slot_matches m ON m.diagram_id = f.diagram_id AND m.component_id <> container""")
def required_containment(spark, sf):
    groups = _listed(spark, sf).select("diagram_id", F.col("components")[0].alias("container"), F.slice("components", F.lit(2), F.size("components")).alias("members"))
    return Q.check_containment(groups, matches(spark, sf)).select("diagram_id", "container", "member", "issue")


# --- measurements ---
@query("margins", ("rects", "canvas"), """
    , g AS (SELECT diagram_id, min(x) AS l, min(y) AS t, 400 - max(x + w) AS r, 300 - max(y + h) AS b FROM rects GROUP BY ALL)
    SELECT diagram_id, half_even(greatest(greatest(l, r) / nullif(least(l, r), 0), greatest(t, b) / nullif(least(t, b), 0)), 2) + 0.0e0 AS worst_margin_ratio,
           half_even(least(100 * (1 - abs(l - r) / 400), 100 * (1 - abs(t - b) / 300)), 0) + 0.0e0 AS centering FROM g""")
def margins(spark, sf):
    m = Y.margins(_els(spark, sf, "rects"), canvas(spark, sf))
    score = G.centering_score(*(F.col(c) for c in ("left", "right", "top", "bottom", "width", "height")))
    return m.select("diagram_id", (F.col("worst_margin_ratio") + F.lit(0.0)).alias("worst_margin_ratio"), (score + F.lit(0.0)).alias("centering"))


def _nodes(spark, sf):
    return matches(spark, sf).select("diagram_id", F.col("component_id").alias("node"), F.floor(F.col("shape_y") / 100).alias("row_no"),
                                     F.floor(F.col("shape_x") / 100).alias("col_no"), *(F.col(f"shape_{c}").alias(c) for c in "xywh"))


@query("min_gap", ("chain", "slot_matches"), """
    , p AS (SELECT c.diagram_id, a.shape_x AS ax, a.shape_y AS ay, a.shape_w AS aw, a.shape_h AS ah, b.shape_x AS bx, b.shape_y AS by_, b.shape_w AS bw, b.shape_h AS bh
            FROM chain c JOIN slot_matches a ON c.diagram_id = a.diagram_id AND c.source = a.component_id JOIN slot_matches b ON c.diagram_id = b.diagram_id AND c.target = b.component_id)
    SELECT diagram_id, half_even(100 * min(CASE WHEN abs(ax + aw / 2 - (bx + bw / 2)) >= abs(ay + ah / 2 - (by_ + bh / 2)) THEN (greatest(ax, bx) - least(ax + aw, bx + bw)) / ((aw + bw) / 2)
           ELSE (greatest(ay, by_) - least(ay + ah, by_ + bh)) / ((ah + bh) / 2) END), 1) + 0.0e0 AS min_gap_to_node_pct FROM p GROUP BY ALL""")
def min_gap(spark, sf):
    out = Y.min_gap_pct(view(spark, sf, "chain"), _nodes(spark, sf))
    return out.select("diagram_id", (F.col("min_gap_to_node_pct") + F.lit(0.0)).alias("min_gap_to_node_pct"))


@query("row_alignment", ("slot_matches",), """
    , n AS (SELECT diagram_id, floor(shape_y / 100) AS r, shape_y + shape_h / 2 AS c, shape_h AS h, shape_x AS x, shape_w AS w, component_id FROM slot_matches),
    o AS (SELECT diagram_id, r, (max(c) - min(c)) / avg(h) AS o FROM n GROUP BY ALL),
    g AS (SELECT diagram_id, r, lead(x) OVER (PARTITION BY diagram_id, r ORDER BY x, component_id) - (x + w) AS g FROM n),
    q AS (SELECT diagram_id, r, max(g) / nullif(min(g), 0) AS q FROM g WHERE g IS NOT NULL GROUP BY ALL),
    z AS (SELECT diagram_id, half_even(max(q), 2) + 0.0e0 AS row_gap_ratio FROM q GROUP BY ALL)
    SELECT o.diagram_id, half_even(100 * max(o), 1) + 0.0e0 AS max_offset_pct, any_value(row_gap_ratio) AS row_gap_ratio FROM o LEFT JOIN z USING (diagram_id) GROUP BY ALL""")
def row_alignment(spark, sf):
    n = _nodes(spark, sf)
    out = Y.line_offsets(n, "row_no", "y").join(Y.row_gap_ratio(n), "diagram_id", "left")
    return out.select("diagram_id", *((F.col(c) + F.lit(0.0)).alias(c) for c in ("max_offset_pct", "row_gap_ratio")))


@query("diagonal_connectors", ("lines",), """
    SELECT diagram_id, count(*) FILTER (abs(x1 - x2) > 1 AND abs(y1 - y2) > 1) AS diagonal_connectors FROM lines GROUP BY ALL""")
def diagonal_connectors(spark, sf):
    return Y.diagonal_connectors(C.connectors_of(_els(spark, sf, "lines")))


@query("style_variants", ("rects",), "SELECT diagram_id, tag, count(DISTINCT (w, h)) AS styles FROM rects GROUP BY ALL")
def style_variants(spark, sf):
    return Y.style_variants(_els(spark, sf, "rects"), "tag", ["w", "h"])


_FILL = "'#' || lower(printf('%02x', CAST(x * 7 AS INTEGER) % 256)) || lower(printf('%02x', CAST(y * 11 AS INTEGER) % 256)) || lower(printf('%02x', CAST(w * 5 AS INTEGER) % 256))"
_LUM = "(21260000e-8 * {r} + 71520000e-8 * {g} + 7220000e-8 * {b})"


def _channel(v):
    return f"(CASE WHEN {v} / 255e0 <= 4045e-5 THEN {v} / 255e0 / 1292e-2 ELSE power(({v} / 255e0 + 55e-3) / 1055e-3, 24e-1) END)"


_LUMS = f"""lum AS (SELECT diagram_id, {_channel('CAST(x * 7 AS INTEGER) % 256')} * 2126e-4 + {_channel('CAST(y * 11 AS INTEGER) % 256')} * 7152e-4
    + {_channel('CAST(w * 5 AS INTEGER) % 256')} * 722e-4 AS l FROM rects)"""


@query("box_contrast", ("rects",), "SELECT diagram_id, half_even(min(105e-2 / (l + 5e-2)), 2) AS min_box_contrast FROM lum GROUP BY ALL", _LUMS)
def box_contrast(spark, sf):
    hx = lambda v: F.lpad(F.lower(F.hex((v.cast("int") % 256).cast("bigint"))), 2, "0")
    fills = _els(spark, sf, "rects").select("diagram_id", "seq", F.concat(
        F.lit("#"), hx(F.col("x") * 7), hx(F.col("y") * 11), hx(F.col("w") * 5)).alias("fill"))
    return Y.colour_facts(fills, F.lit("#ffffff")).select("diagram_id", "min_box_contrast")


@query("colour_families", ("rects",), """
    , q AS (SELECT diagram_id, min(seq) AS first, CAST(trunc(x * 7) AS BIGINT) % 256 / 255e0 AS r, CAST(trunc(y * 11) AS BIGINT) % 256 / 255e0 AS g,
                   CAST(trunc(w * 5) AS BIGINT) % 256 / 255e0 AS b FROM rects GROUP BY ALL),
    t AS (SELECT *, greatest(r, g, b) AS top, least(r, g, b) AS low FROM q),
    u AS (SELECT diagram_id, first, CASE WHEN top = low THEN 0e0 WHEN top + low <= 1 THEN (top - low) / (top + low) ELSE (top - low) / (2 - top - low) END AS sat,
                 60 * CASE WHEN top = low THEN 0e0 WHEN r = top THEN (g - b) / (top - low) WHEN g = top THEN 2 + (b - r) / (top - low) ELSE 4 + (r - g) / (top - low) END AS turn FROM t),
    o AS (SELECT diagram_id, coalesce(list([CASE WHEN turn < 0 THEN turn + 360 ELSE turn END] ORDER BY first) FILTER (sat >= 25e-2), []) AS hues FROM u GROUP BY diagram_id)
    SELECT diagram_id, CAST(len(list_reduce(list_prepend(CAST([] AS DOUBLE[]), hues), lambda x, y: CASE WHEN len(list_filter(x, lambda k: least(abs(k - y[1]), 360 - abs(k - y[1])) <= 20)) > 0
                    THEN x ELSE list_concat(x, y) END)) AS INTEGER) AS hue_families FROM o""")
def colour_families(spark, sf):
    """First-seen hue clusters per drawing."""
    hx = lambda v: F.lpad(F.lower(F.hex((v.cast("int") % 256).cast("bigint"))), 2, "0")
    fills = _els(spark, sf, "rects").select("diagram_id", "seq", F.concat(
        F.lit("#"), hx(F.col("x") * 7), hx(F.col("y") * 11), hx(F.col("w") * 5)).alias("fill"))
    return Y.colour_facts(fills, F.lit("#ffffff")).select("diagram_id", "hue_families")


@query("display_scale", ("rects",), f"""
    , s AS (SELECT diagram_id, element_id, least(660e0 / (w * 20), 360e0 / (h * 20)) AS s FROM rects)
    SELECT diagram_id, element_id, {sql6('s', 'scale')}, CASE WHEN s BETWEEN 95e-2 AND 105e-2 THEN 'full size' WHEN s < 45e-2 THEN 'much smaller' ELSE 'scaled' END AS shown FROM s""")
def display_scale(spark, sf):
    s = G.display_scale(F.col("w") * 20, F.col("h") * 20)
    return _els(spark, sf, "rects").select("diagram_id", "element_id", r6(s, "scale"), G.display_bucket(s).alias("shown"))


@query("canvas_fill", ("rects",), """
    SELECT diagram_id, greatest(0, least(100, half_even(100 * (100 * sum(w * h) / 120000 - 3) / 3, 0))) + 0.0e0 AS score FROM rects GROUP BY ALL""")
def canvas_fill(spark, sf):
    share = _els(spark, sf, "rects").groupBy("diagram_id").agg((F.sum(F.col("w") * F.col("h")) / 120000).alias("share"))
    return share.select("diagram_id", (G.canvas_fill_score(F.col("share")) + F.lit(0.0)).alias("score"))


# --- markup ---
def _markup_documents(spark, sf):
    """One small vector document per box: a translated group with a box and its label."""
    b = spread(view(spark, sf, "box"), "diagram_id", "seq")  # few input files: use every core for parsing
    text = lambda c: F.col(c).cast("string")
    return b.select(F.col("seq").cast("string").alias("key"), F.concat(F.col("diagram_id").cast("string"), F.lit("/"), F.col("seq").cast("string")).alias("diagram_id"), F.concat(
        F.lit('<svg xmlns="http://www.w3.org/2000/svg" width="800" height="600" viewBox="0 0 400 300"><g font-size="'), text("font"),
        F.lit('" transform="translate('), text("x"), F.lit(" "), text("y"), F.lit(')"><rect id="b" width="'), text("w"), F.lit('" height="'), text("h"),
        F.lit('"/><text id="t" x="4" y="20">'), F.col("text"), F.lit("</text></g></svg>")).alias("document"))


@query("markup_elements", ("box",), f"""
    SELECT CAST(diagram_id AS VARCHAR) || '/' || CAST(seq AS VARCHAR) AS diagram_id, 'b' AS element_id, 'rect' AS tag, x, y, w, h, font AS font_size FROM box
    UNION ALL SELECT CAST(diagram_id AS VARCHAR) || '/' || CAST(seq AS VARCHAR), 't', 'text', {sql6('x + 4', 'x').replace(' AS x', '')}, {sql6('y + 20 - font', 'y').replace(' AS y', '')},
        {sql6("greatest(font * 6e-1 * length(text), font * 4e-1)", 'w').replace(' AS w', '')}, {sql6('12e-1 * font', 'h').replace(' AS h', '')}, font FROM box""")
def markup_elements(spark, sf):
    found, _, _ = markup.scan_markup(_markup_documents(spark, sf))
    return found.select("diagram_id", "element_id", "tag", *(r6(F.col(c), c) for c in ("x", "y", "w", "h")), "font_size")


@query("page_tags", (), """
    WITH t AS (SELECT page_id, unnest(regexp_extract_all(lower(html), '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages)
    SELECT page_id, tag, count(*) AS n FROM t GROUP BY ALL""")
def page_tags(spark, sf):
    return markup.tag_counts(spark.read.parquet(f"{sf}/pages.parquet"), "page_id", "html")
