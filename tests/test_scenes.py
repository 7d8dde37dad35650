"""Scene checks on small vector drawings, and the crowded paths against the ordinary ones."""

import pytest
from pyspark.sql import functions as F

from scenequality.operators import connectors as C, graph as R, matching as M, scene as S, spatial_rules as Q
from scenequality.session import cut_lineage
from scenequality.sources.markup import scan_markup
from tests.conftest import rows

COMPONENTS = "diagram_id string, idx int, component_id string, label string, kind string, tier string"
CONNECTIONS = "diagram_id string, idx int, connection_id string, source string, target string, label string, tier string"


def box(name, x, y):
    return (f'<rect id="{name}" x="{x}" y="{y}" width="80" height="40"/>'
            f'<text id="{name}-t" x="{x + 40}" y="{y + 25}" font-size="14" text-anchor="middle">{name}</text>')


ROW = box("Alpha", 20, 20) + box("Beta", 160, 20) + box("Gamma", 300, 20)


def arrow(ident, points, end='marker-end="url(#a)"'):
    return f'<polyline id="{ident}" points="{points}" fill="none" {end}/>'


def drawing(spark, body, size='width="400" height="400"'):
    doc = spark.createDataFrame([("d", f'<svg xmlns="http://www.w3.org/2000/svg" {size}>{body}</svg>')], "diagram_id string, document string")
    elements, canvases, rejects = scan_markup(doc)
    assert rejects.count() == 0
    return elements, canvases


def inventory(spark, labels, links):
    parts = spark.createDataFrame([("d", i, l.lower(), l, "box", "required") for i, l in enumerate(labels)], COMPONENTS)
    edges = spark.createDataFrame([("d", i, f"C{i + 1}", a, b, "", "required") for i, (a, b) in enumerate(links)], CONNECTIONS)
    return parts, edges


def judged(spark, body, labels, links):
    elements, canvases = drawing(spark, body)
    parts, edges = inventory(spark, labels, links)
    matches = M.match_labels(elements, parts)
    arrows = C.drawn_arrows(elements, matches, canvases)
    verdicts, extras = C.reconcile(edges, arrows)
    return dict(rows(verdicts, "connection_id", "status")), rows(extras, "element_id"), matches, parts, edges


def test_connections_and_extra(spark):
    body = ROW + arrow("ab", "100,40 160,40") + arrow("cb", "300,40 240,40") + arrow("ac", "60,60 60,120 340,120 340,60")
    status, extras, *_ = judged(spark, body, ["Alpha", "Beta", "Gamma"], [("alpha", "beta"), ("beta", "gamma")])
    assert status == {"C1": "present", "C2": "reversed"} and extras == [("ac",)]


def test_marker_start_only_points_back(spark):
    body = box("Alpha", 20, 20) + box("Beta", 160, 20) + arrow("ba", "160,40 100,40", 'marker-start="url(#a)"')
    status, extras, *_ = judged(spark, body, ["Alpha", "Beta"], [("alpha", "beta")])
    assert status == {"C1": "present"} and extras == []


def test_loop_is_no_order_violation(spark):
    links = [("alpha", "beta"), ("beta", "gamma"), ("gamma", "alpha")]
    _, _, matches, parts, edges = judged(spark, ROW, ["Alpha", "Beta", "Gamma"], links)
    loops = R.feedback_edges(parts, edges)
    assert rows(loops, "connection_id") == [("C3",)]
    order = Q.reading_direction(edges, matches, loops)
    assert rows(order, "direction", "against") == [("left-to-right", False)] * 2


def test_order_violation(spark):
    links = [("alpha", "beta"), ("beta", "gamma"), ("gamma", "delta")]
    _, _, matches, _, edges = judged(spark, ROW + box("Delta", 160, 200), ["Alpha", "Beta", "Gamma", "Delta"], links)
    assert sum(r.against for r in Q.reading_direction(edges, matches).collect()) == 1


def test_overlap_counts_shapes_once(spark):
    boxes = [(100, 100, 100, 100), (180, 100, 60, 40), (180, 160, 60, 40), (60, 180, 60, 40), (300, 300, 40, 40), (20, 20, 40, 40)]
    body = "".join(f'<rect x="{x}" y="{y}" width="{w}" height="{h}"/>' for x, y, w, h in boxes) + '<polygon points="300,320 290,315 290,325"/>'
    elements, _ = drawing(spark, body)
    pool = S.leaves(elements)
    counts = S.overlap_metric(S.shape_collisions(elements), pool).first()
    assert (counts.detected_issues, counts.expected_count) == (4, 6)


@pytest.mark.parametrize("body, size, small", [
    ('<g font-size="8"><text>A</text></g><text font-size="14">B</text>', 'width="400" height="400"', [False, True]),
    ('<text font-size="14">A</text>', 'width="400" height="200" viewBox="0 0 800 400"', [True]),
    ('<text font-size="8">A</text>', 'width="1600" height="800" viewBox="0 0 800 400"', [False])])
def test_fonts(spark, body, size, small):
    elements, canvases = drawing(spark, body, size)
    assert sorted(r.small for r in S.font_checks(elements, canvases).collect()) == small


def test_free_texts_collide(spark):
    elements, _ = drawing(spark, '<text font-size="14" x="100" y="100">label one</text><text font-size="14" x="105" y="102">label two</text>')
    out = S.overflow_metric(S.text_overflow(elements)).first()
    assert (out.detected_issues, out.expected_count) == (2, 2)


def test_transforms_and_styles(spark):
    body = ('<g transform="translate(10 20) scale(2)" style="fill: red; font-size: 10px"><rect id="r" x="1" y="2" width="3" height="4"/>'
            '<g font-size="150%"><text id="t">Hi</text></g></g><circle id="c" cx="5" cy="5" r="2" transform="rotate(90 5 5)"/><path id="p" d="M 0 0 L 10 0" stroke="#000" fill="none"/>')
    elements, _ = drawing(spark, body)
    found = {r.element_id: r for r in elements.collect()}
    assert (found["r"].x, found["r"].y, found["r"].w, found["r"].h, found["r"].fill) == (12, 24, 6, 8, "red")
    assert found["t"].font_size == pytest.approx(30)
    assert found["c"].x == pytest.approx(3) and found["c"].w == pytest.approx(4)
    assert C.connectors_of(elements).count() == 1


def test_bad_markup_is_rejected(spark):
    doc = spark.createDataFrame([("bad", "<svg><rect></svg>"), ("ok", "<svg width='1' height='1'/>")], "diagram_id string, document string")
    elements, canvases, rejects = scan_markup(doc)
    assert rows(rejects, "diagram_id") == [("bad",)] and rows(canvases, "diagram_id") == [("ok",)] and elements.count() == 0


def test_role_recovery_and_unique_graph(spark):
    body = ROW.replace(">Beta<", ">Layer<") + arrow("ab", "100,40 160,40") + arrow("bc", "240,40 300,40")
    elements, canvases = drawing(spark, body)
    parts, edges = inventory(spark, ["Alpha", "Beta", "Gamma"], [("alpha", "beta"), ("beta", "gamma")])
    matches = M.match_labels(elements, parts)
    assert rows(matches, "component_id") == [("alpha",), ("gamma",)]
    full = M.recover_roles(elements, parts, edges, matches, canvases)
    assert rows(full, "component_id", "method", "shape_id") == [("alpha", "label", "Alpha"), ("beta", "role", "Beta"), ("gamma", "label", "Gamma")]
    verdicts = dict(rows(M.match_verdicts(parts, full, canvases), "component_id", "verdict"))
    assert verdicts == {"alpha": "present", "beta": "mislabeled", "gamma": "present"}
    strict = M.recover_roles(elements, parts, edges, matches, canvases, placeholder_counts=False)
    assert rows(strict, "component_id") == [("alpha",), ("gamma",)]
    nameless = body.replace(">Alpha<", ">One<").replace(">Gamma<", ">Three<")
    elements, canvases = drawing(spark, nameless)
    solved = R.match_unique_graph(elements, parts, edges, M.match_labels(elements, parts), canvases)
    assert rows(solved, "component_id", "shape_id") == [("alpha", "Alpha"), ("beta", "Beta"), ("gamma", "Gamma")]


def test_symmetric_graph_is_not_guessed(spark):
    body = (box("A", 20, 20) + box("B", 160, 20)).replace(">A<", ">TBD<").replace(">B<", ">TBD<") + arrow("x", "100,35 160,35") + arrow("y", "160,45 100,45")
    elements, canvases = drawing(spark, body)
    parts, edges = inventory(spark, ["First", "Second"], [("first", "second"), ("second", "first")])
    matches = M.match_labels(elements, parts)
    assert R.match_unique_graph(elements, parts, edges, matches, canvases).count() == 0


def scatter(spark, n=400):
    """One drawing of many boxes, with copies."""
    data = []
    for i in range(n):
        k = i % 150
        data.append(("big", i, f"e{i}", "rect", float(k * 37 % 500), float(k * 53 % 300), float(10 + k % 30), float(8 + k % 17), "", 0.0, "", "", "", "", []))
        data.append(("big", n + i, f"t{i}", "text", float(k * 41 % 500), float(k * 59 % 300), 12.0, 6.0, f"w{k}", 9.0, "", "", "", "", []))
    from scenequality.schemas import ELEMENTS
    return spark.createDataFrame(data, ELEMENTS)


def test_crowded_drawings_give_the_same_results(spark):
    from scenequality.operators.spatial_index import drawing_grid
    elements = scatter(spark)
    grid = drawing_grid(elements, limit=50)
    assert grid is not None
    shapes = S.shapes_of(elements)
    for plain, cut in (
        (S.containers(shapes, grid=None), S.containers(shapes, grid=grid)),
        (S.first_overlaps(shapes, shapes, 0.01, None), S.first_overlaps(shapes, shapes, 0.01, grid)),
        (S.text_overflow(elements, None), S.text_overflow(elements, grid)),
        (S.smallest_container(elements, None), S.smallest_container(elements, grid)),
    ):
        assert rows(plain) == rows(cut)


def crowd(spark, n=60):
    """A crowded drawing with arrows: a background, a few large boxes, many small ones, long diagonal lines and free texts."""
    from scenequality.schemas import ELEMENTS
    data = [("big", 0, "back", "rect", 0.0, 0.0, 4000.0, 3000.0, "", 0.0, "", "", "", "", [])]
    for i in range(n):
        x, y = float(i * 373 % 3900), float(i * 541 % 2900)
        w, h = (700.0, 500.0) if i % 40 == 7 else (20.0 + i % 9, 12.0 + i % 5)
        data.append(("big", 4 * i + 1, f"e{i}", "rect", x, y, w, h, "", 0.0, "", "", "", "", []))
        data.append(("big", 4 * i + 2, f"t{i}", "text", x + 4, y + 2, 9.0, 6.0, f"w{i}", 9.0, "", "", "", "", []))
        if i % 10 == 3:
            data.append(("big", 4 * n + i + 10, f"g{i}", "rect", x + 15, y + 9, w, h, "", 0.0, "", "", "", "", []))
        j = (i * 7 + 1) % n
        ends = [(x + w / 2, y + h / 2), (float(j * 373 % 3900) + 15, float(j * 541 % 2900) + 8)]
        if i % 3 == 0:
            ends.insert(1, (x, ends[1][1]))
        data.append(("big", 4 * i + 3, f"l{i}", "polyline", 0.0, 0.0, 0.0, 0.0, "", 0.0, "none", "#000", "", "a" if i % 5 else "", ends))
        data.append(("big", 4 * i + 4, f"f{i}", "text", (ends[0][0] + ends[-1][0]) / 2 + i % 11, (ends[0][1] + ends[-1][1]) / 2, 8.0, 5.0, f"on {i}", 9.0, "", "", "", "", []))
    elements = spark.createDataFrame(data, ELEMENTS)
    canvases = spark.createDataFrame([("big", 4000.0, 3000.0, 1.0)], "diagram_id string, width double, height double, render_scale double")
    labels = [f"w{i}" if i % 20 != 4 else f"nobody {i}" for i in range(n)]
    parts = spark.createDataFrame([("big", i, f"c{i}", l, "box", "required") for i, l in enumerate(labels)], COMPONENTS)
    edges = spark.createDataFrame([("big", i, f"C{i + 1}", f"c{i}", f"c{(i * 7 + 1) % n}", "", "required") for i in range(n)], CONNECTIONS)
    return elements, canvases, parts, edges


def test_crowded_drawings_keep_arrows_labels_and_roles(spark):
    from scenequality.operators.spatial_index import drawing_grid
    elements, canvases, parts, edges = crowd(spark)
    grid = drawing_grid(elements.filter("tag <> 'polyline'"), limit=50)
    assert grid is not None
    results = []
    for g in (None, grid):
        matches = cut_lineage(M.match_labels(elements, parts, grid=g))
        arrows = cut_lineage(C.drawn_arrows(elements, matches, canvases, g))
        ends = C.attach_endpoints(C.connectors_of(elements), C.match_pool(matches), canvases, g)
        roles = M.recover_roles(elements, parts, edges, matches, canvases, grid=g)
        results.append([rows(matches, "component_id", "shape_id"), rows(ends), rows(arrows, "element_id", "source", "target"),
                        rows(C.arrow_labels(elements, arrows, matches, canvases, g)), rows(roles, "component_id", "shape_id", "method"),
                        rows(S.unexpected_boxes(elements, matches, g)), rows(S.shape_collisions(elements, grid=g)), rows(S.leaves(elements, g), "element_id")])
    for plain, cut in zip(*results):
        assert plain and plain == cut


def test_a_background_over_many_boxes_stays_linear(spark):
    """No box takes more than four cells, however much larger than the others it is."""
    from scenequality.operators.spatial_index import at_cell, drawing_grid, with_cells
    from scenequality.functions.geometry import box as b
    elements, *_ = crowd(spark, 640)
    shapes = S.shapes_of(elements)
    grid = drawing_grid(shapes)
    per = with_cells(shapes, b(), grid).groupBy("seq").count()
    assert per.agg(F.max("count")).first()[0] <= 4
    levels = at_cell(shapes, F.col("x"), F.col("y"), grid).groupBy("seq").count().agg(F.max("count")).first()[0]
    assert levels <= 10


def test_fold_and_rounds_assign_alike(spark):
    elements = scatter(spark, 60)
    parts = spark.createDataFrame([("big", i, f"c{i}", f"w{i % 40} w{(i + 1) % 40}", "box", "required") for i in range(60)], COMPONENTS)
    pick = ("component_id", "text_seq", "similarity", "match_order")
    assert rows(M.match_labels(elements, parts), *pick) == rows(M.match_labels(elements, parts, fold_limit=0), *pick)


def test_cycles_against_brute_force(spark):
    import itertools
    import random
    rng, data, want = random.Random(3), [], set()
    for d in range(30):
        nodes = range(rng.randint(2, 6))
        edges = sorted({(a, b) for a, b in itertools.product(nodes, nodes) if rng.random() < 0.3})
        reach = {(a, b) for a, b in edges}
        for k in nodes:
            reach |= {(a, b) for a in nodes for b in nodes if (a, k) in reach and (k, b) in reach}
        want |= {(str(d), f"C{i + 1}") for i, (a, b) in enumerate(edges) if (b, a) in reach or a == b}
        data += [(str(d), i, f"C{i + 1}", f"n{a}", f"n{b}", "", "required") for i, (a, b) in enumerate(edges)]
    edges = spark.createDataFrame(data, CONNECTIONS)
    assert set(rows(R.cycle_edges(edges), "diagram_id", "connection_id")) == want
    parts = spark.createDataFrame([(str(d), i, f"n{i}", "", "box", "required") for d in range(30) for i in range(6)], COMPONENTS)
    loops = R.feedback_edges(parts, edges)
    assert set(rows(loops, "diagram_id", "connection_id")) <= want
    # without its feedback edges no drawing has a cycle left
    assert R.cycle_edges(edges.join(loops, ["diagram_id", "connection_id"], "left_anti")).count() == 0


def test_feedback_of_a_long_loop(spark):
    n = 60_000
    edges = spark.range(n).select(F.lit("d").alias("diagram_id"), F.col("id").cast("int").alias("idx"), F.concat(F.lit("C"), "id").alias("connection_id"),
                                  F.concat(F.lit("n"), "id").alias("source"), F.concat(F.lit("n"), (F.col("id") + 1) % n).alias("target"))
    parts = spark.range(n).select(F.lit("d").alias("diagram_id"), F.col("id").cast("int").alias("idx"), F.concat(F.lit("n"), "id").alias("component_id"))
    assert rows(R.feedback_edges(parts, edges)) == [("d", f"C{n - 1}")]


def test_repeated_arrows_reconcile_in_order(spark):
    edges = spark.createDataFrame([("d", i, f"C{i + 1}", "a", "b", "", "required") for i in range(3)] + [("d", 3, "C4", "b", "a", "", "required")], CONNECTIONS)
    arrows = spark.createDataFrame([("d", 1, "x1", "a", "b"), ("d", 2, "x2", "b", "a"), ("d", 3, "x3", "b", "a"), ("d", 4, "x4", "b", "a"), ("d", 5, "x5", None, "a")],
                                   "diagram_id string, seq long, element_id string, source string, target string")
    verdicts, extras = C.reconcile(edges, arrows)
    assert rows(verdicts, "connection_id", "status", "arrow_id") == [
        ("C1", "present", "x1"), ("C2", "reversed", "x3"), ("C3", "reversed", "x4"), ("C4", "present", "x2")]
    assert rows(extras, "element_id", "reason") == [("x5", "one end loose")]


def test_unknown_axis_stops(spark):
    seqs = spark.createDataFrame([("d", 0, "sideways", ["alpha", "beta"])], "diagram_id string, seq_no int, axis string, components array<string>")
    matches = M.match_labels(drawing(spark, ROW)[0], inventory(spark, ["Alpha", "Beta"], [("alpha", "beta")])[0])
    with pytest.raises(Exception, match="unsupported spatial axis"):
        Q.check_sequences(seqs, matches).collect()
