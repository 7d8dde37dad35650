"""What is computed once: plans must not name costly steps again for every reader."""

import json

from pyspark.sql import functions as F

from scenequality.operators import answers, beauty, connectors, graph, isomorphism, judging, matching, scene, spatial_rules
from scenequality.sources import readers
from scenequality.sources.markup import scan_markup
from scenequality.streaming import ratings
from tests.test_scenes import ROW, arrow, drawing, inventory


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_markup_reads_font_sizes_once(spark):
    text = ('<svg viewBox="0 0 9 9"><g font-size="10px" transform="translate(1 2) scale(2)"><text x="3" y="20" font-size="2em">ab</text>'
            '<path d="M 7"/><path d="M 1 2 L 5 9" stroke="#000000"/></g></svg>')
    elements, canvases, rejects = scan_markup(spark.createDataFrame([("a", text), ("b", "<svg>")], "diagram_id string, document string"))
    assert plan(elements).count("aggregate(") == 1
    rows = {r.tag: r for r in elements.collect()}
    assert (rows["text"].font_size, rows["text"].x, rows["text"].y, rows["text"].h) == (40.0, 7.0, 2.0, 48.0)
    assert set(rows) == {"text", "path"} and (rows["path"].x, rows["path"].y, rows["path"].w, rows["path"].h) == (3.0, 6.0, 8.0, 14.0)
    assert [r.diagram_id for r in canvases.collect()] == ["a"] and [r.diagram_id for r in rejects.collect()] == ["b"]


def test_colours_are_read_once(spark):
    fills = spark.createDataFrame([(1, 2, "#ff0000"), (1, 1, "#00ff00"), (1, 3, "#f00a00"), (1, 4, "#808080")], "diagram_id int, seq int, fill string")
    facts = beauty.colour_facts(fills, F.lit("#ffffff"))
    assert plan(facts.select("diagram_id", "hue_families")).count("conv(") == 3
    assert [(r.hue_families, r.min_box_contrast) for r in facts.collect()] == [(2, 1.37)]


def test_moves_are_joined_once(spark):
    links = spark.createDataFrame([(1, "c", "a", "b"), (1, "d", "b", "a")], "diagram_id int, connection_id string, source string, target string")
    boxes = spark.createDataFrame([(1, "a", 0.0, 0.0, 2.0, 2.0), (1, "b", 50.0, 0.0, 2.0, 2.0)],
                                  "diagram_id int, component_id string, shape_x double, shape_y double, shape_w double, shape_h double")
    found = spatial_rules.reading_direction(links, boxes)
    assert plan(found).count("Join ") == 1
    assert sorted((r.connection_id, r.direction, r.against) for r in found.collect()) == [("c", "left-to-right", False), ("d", "left-to-right", True)]


def test_unexpected_boxes_are_sought_once(spark):
    box = "x double, y double, w double, h double"
    elements = spark.createDataFrame(
        [(1, 1, "r", "rect", 0.0, 0.0, 9.0, 9.0, ""), (1, 2, "t", "text", 1.0, 1.0, 2.0, 2.0, "one"), (1, 3, "s", "rect", 20.0, 0.0, 9.0, 9.0, ""),
         (1, 4, "u", "text", 21.0, 1.0, 2.0, 2.0, "two")], f"diagram_id int, seq long, element_id string, tag string, {box}, text string")
    matches = spark.createDataFrame([(1, 1, 2, 0.0, 0.0, 9.0, 9.0)], "diagram_id int, shape_seq long, text_seq long, shape_x double, shape_y double, shape_w double, shape_h double")
    found = scene.unexpected_boxes(elements, matches)
    assert plan(found).count("Join ") == 2
    assert [(r.shape_id, r.text) for r in found.collect()] == [("s", "two")]


def test_latest_reads_a_log_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, {"a": 1}, 0), (1, 1, {"a": 2}, 1), (1, 2, None, 0), (1, None, {"a": 3}, 0)], "session_id int, diagram_id int, scores map<string,int>, batch int")
    rows.write.parquet(f"{tmp_path}/log")
    last = ratings.latest(spark, f"{tmp_path}/log", ratings.KEYS)
    assert "Join " not in plan(last)
    assert sorted((r.diagram_id, r.scores) for r in last.collect()) == [(1, {"a": 2}), (2, None)]


def test_answer_lines_are_parsed_once_and_only_what_is_read_is_judged(spark, tmp_path):
    item = lambda i, v: {"component_id": i, "verdict": v, "visible_text": i, "location": {"x0": 0.1, "y0": 0.1, "x1": 0.4, "y1": 0.4}}
    documents = {"one": [item("a", "present"), item("b", "present")], "two": [item("a", "present")]}
    parts = [{"id": i, "label": "Same", "kind": "box", "tier": "required"} for i in "ab"]
    lines = lambda rows, name: (spark.createDataFrame([(json.dumps(r),) for r in rows], "value string").write.text(f"{tmp_path}/{name}"), f"{tmp_path}/{name}")[1]
    raw = readers.read_judge_answers(spark, lines([{"diagram_id": d, "judge": "m", "answer": {"components": c}} for d, c in documents.items()], "answers"))
    inventories = readers.read_inventory_lines(spark, lines([{"diagram_id": d, "inventory": {"components": parts}} for d in documents], "inventories"))
    assert plan(raw).lower().count("parsejson") == 1 and plan(inventories).lower().count("parsejson") == 1
    good, bad = answers.split_answers(answers.read_answers(raw, inventories))
    assert "aggregate(" in plan(answers.component_rows(good)) and "aggregate(" not in plan(bad)
    assert [(r.diagram_id, r.problem) for r in bad.collect()] == [("two", "missing component")]
    assert sorted((r.component_id, r.verdict, r.notes) for r in answers.component_rows(good).collect()) == [
        ("a", "present", ""), ("b", "absent", "downgraded: same drawn element as an earlier component")]


def test_components_are_named_once(spark):
    parts = spark.createDataFrame([(1, 0, "a", "One", "box", "required"), (1, 1, "b", "Two", "box", "required"), (1, 2, "c", " two", "box", "required")],
                                  "diagram_id int, idx int, component_id string, label string, kind string, tier string")
    links = spark.createDataFrame([(1, 0, "C1", "a", "b", "", "required"), (1, 1, "C2", "a", "x", "", "required")],
                                  "diagram_id int, idx int, connection_id string, source string, target string, label string, tier string")
    found = judging.component_checklist(parts, links)
    assert "lower(" not in plan(found)
    assert sorted((r.component_id, r.context) for r in found.collect()) == [
        ("a", "feeds Two [b], x"), ("b", "receives from One; one of 2 components with this label"), ("c", "one of 2 components with this label")]


def written(df):
    """Whether the plan reads written tables only."""
    return not any(name in plan(df) for name in ("LocalRelation", "LogicalRDD", "Join ", "Union"))


def test_rounds_read_written_tables(spark, monkeypatch):
    seen = []
    one_round, refined = matching._one_round, isomorphism._refined
    monkeypatch.setattr(matching, "_one_round", lambda near, shapes, state, blocked, parts, edges, n: (
        seen.append((state, parts, edges)), one_round(near, shapes, state, blocked, parts, edges, n))[1])
    monkeypatch.setattr(isomorphism, "_refined", lambda state, edges: (seen.append((state, edges)), refined(state, edges))[1])
    body = ROW.replace(">Beta<", ">Layer<") + arrow("ab", "100,40 160,40") + arrow("bc", "240,40 300,40")
    elements, canvases = drawing(spark, body)
    parts, edges = inventory(spark, ["Alpha", "Beta", "Gamma"], [("alpha", "beta"), ("beta", "gamma")])
    matches = matching.match_labels(elements, parts)
    assert "LogicalRDD" not in plan(matches) and "LocalRelation" not in plan(matches)
    full = matching.recover_roles(elements, parts, edges, matches, canvases)
    assert sorted((r.component_id, r.method) for r in full.collect()) == [("alpha", "label"), ("beta", "role"), ("gamma", "label")]
    assert seen and all(written(df) for df in seen[0])
    seen.clear()
    assert graph.match_unique_graph(elements, parts, edges, matches, canvases).count() == 3
    assert seen and all(written(df) for df in seen[0])


def test_pairs_are_tallied_once(spark):
    expected = spark.createDataFrame([(1, 0, "C1", "a", "b"), (1, 1, "C2", "b", "c")], "diagram_id int, idx int, connection_id string, source string, target string")
    arrows = spark.createDataFrame([(1, 5, "x", "a", "b"), (1, 6, "y", "c", "b"), (1, 7, "z", "a", "b")],
                                   "diagram_id int, seq long, element_id string, source string, target string")
    verdicts, extras = connectors.reconcile(expected, arrows)
    assert "Union" not in plan(verdicts)
    assert sorted((r.connection_id, r.status, r.arrow_id) for r in verdicts.collect()) == [("C1", "present", "x"), ("C2", "reversed", "y")]
    assert [(r.element_id, r.reason) for r in extras.collect()] == [("z", "unmatched")]
