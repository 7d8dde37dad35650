"""Assignment, sets, validation, export, judging, streaming and readers."""

import json

import pytest
from pyspark.sql import functions as F

from scenequality.operators import judging as J, study as D, validate as V
from scenequality.schemas import SCORE_KEYS
from scenequality.sources import readers as R, sinks as K
from scenequality.streaming import ratings as E
from tests.conftest import rows


def pool(spark, easy=15, medium=15, hard=15):
    levels = ["easy"] * easy + ["medium"] * medium + ["hard"] * hard
    return spark.createDataFrame([(i, f"D{i}", lv) for i, lv in enumerate(levels)], "item_no long, id string, difficulty string")


@pytest.mark.parametrize("count", [20, 24, 25, 30])
def test_assignment_is_balanced_and_unique(spark, count):
    people = spark.range(40).withColumnRenamed("id", "participant_no")
    got = D.balanced_assignment(pool(spark), people, count, seed=count).collect()
    for p in range(40):
        own = [r for r in got if r.participant_no == p]
        sizes = [sum(r.difficulty == lv for r in own) for lv in ("easy", "medium", "hard")]
        assert len({r.id for r in own}) == len(own) == count and max(sizes) - min(sizes) <= 1
        assert sorted(r.presentation_order for r in own) == list(range(1, count + 1))


def test_infeasible_pool(spark):
    people = spark.range(1).withColumnRenamed("id", "participant_no")
    with pytest.raises(Exception, match="at least 8 per difficulty"):
        D.balanced_assignment(pool(spark, 12, 10, 6), people, 24).collect()
    assert D.balance_check(pool(spark, 12, 10, 6), 20).first().feasible
    with pytest.raises(ValueError):
        D.balanced_assignment(pool(spark), people, 31)


def test_sets_and_leases(spark):
    items = spark.createDataFrame([(i, "easy" if i % 2 else "hard", "positive") for i in range(12)], "row long, difficulty string, label string")
    dealt = D.deal_sets(items, 3)
    assert [r["count"] for r in dealt.groupBy("set", "difficulty").count().collect()] == [2] * 6
    free = spark.createDataFrame([(3,), (1,)], "set_number long")
    waiting = spark.createDataFrame([("p1", 10), ("p2", 5), ("p3", 20)], "participant_no string, waiting_since long")
    assert rows(D.lease_sets(free, waiting), "participant_no", "set_number") == [("p1", 3), ("p2", 1), ("p3", None)]


def full(value=5, **changes):
    return {**{k: value for k in SCORE_KEYS}, **changes}


def study(spark):
    ts = lambda minute: f"2024-01-01 10:{minute:02d}:00"
    people = spark.createDataFrame([("s1", ["a", "b"], None), ("s2", ["a"], ts(5))], "session_id string, assignment array<string>, submitted_at string").withColumn(
        "submitted_at", F.to_timestamp("submitted_at"))
    data = [(1, "s1", "a", full(3), "", 900, ts(1)), (2, "s1", "a", full(7), "", 100, ts(2)), (3, "s1", "b", full(5, layout=11), "", 10, ts(3)),
            (4, "s1", "z", full(5), "", 10, ts(3)), (5, "s2", "a", full(4), "", 10, ts(4)), (6, "s2", "a", full(9), "", 10, ts(6)), (7, "s1", "b", {"layout": 4}, "", 10, ts(7))]
    events = spark.createDataFrame(data, "event_id long, session_id string, diagram_id string, scores map<string,int>, comment string, duration_ms long, updated_at string").withColumn(
        "updated_at", F.to_timestamp("updated_at"))
    return events, people


def test_upsert_lock_and_export(spark, tmp_path):
    events, people = study(spark)
    reasons = dict(rows(E.review_events(events, people), "event_id", "reason"))
    assert reasons == {1: None, 2: None, 3: "invalid", 4: "not assigned", 5: None, 6: "locked", 7: None}
    current = E.current_ratings(events, people)
    assert rows(current.select("session_id", "diagram_id", F.col("scores")["layout"], "duration_ms", "complete")) == [
        ("s1", "a", 7, 900, True), ("s1", "b", 4, 10, False), ("s2", "a", 4, 10, True)]
    assert tuple(D.study_progress(people, current).first()) == (2, 1, 3, 2)
    catalog = spark.createDataFrame([("a", "easy"), ("b", "hard")], "diagram_id string, difficulty string")
    assert D.export_rows(people, current, catalog).count() == 1
    whole = D.export_rows(people, current, catalog, scope="all")
    assert rows(whole, "session_id", "diagram_id", "rating_complete", "canvas_fill") == [("s1", "a", 1, 7), ("s1", "b", 0, None), ("s2", "a", 1, 4)]
    K.write_export(whole.withColumn("comment", F.lit("=1+1")), str(tmp_path / "out"))
    text = spark.read.text(str(tmp_path / "out")).collect()
    assert any('"\'=1+1"' in r[0] for r in text)
    asked = spark.createDataFrame([("s1", "2024-01-02 00:00:00"), ("s2", "2024-01-02 00:00:00")], "session_id string, requested_at string").withColumn(
        "requested_at", F.to_timestamp("requested_at"))
    done = dict(rows(E.submit(people, current, asked).select("session_id", F.col("submitted_at").cast("string"))))
    assert done == {"s1": None, "s2": "2024-01-01 10:05:00"}


def test_streamed_upserts_equal_the_batch(spark, tmp_path):
    events, people = study(spark)
    source = str(tmp_path / "events")
    events.filter("event_id <= 3").coalesce(1).write.parquet(source)

    def run():
        stream = spark.readStream.schema(events.schema).parquet(source)
        good = E.review_events(stream, people).filter(F.col("reason").isNull())
        E.write_upserts(E.upsert_ratings(E.ordered_writes(good)), str(tmp_path / "state"), str(tmp_path / "check")).awaitTermination()

    run()
    events.filter("event_id > 3").coalesce(1).write.mode("append").parquet(source)
    run()
    pick = ("session_id", "diagram_id", "duration_ms")
    assert rows(E.saved_ratings(spark, str(tmp_path / "state")), *pick) == rows(E.current_ratings(events, people), *pick)


def test_manifest_reader(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_bytes('﻿id,file,Difficulty ,caption\r\nA1,a.svg,easy,"Start, then ""Validate""\nthen End"\r\nA2,b.png,Hard,Plain\r\n\r\n'.encode())
    got = R.read_manifest(spark, str(path)).orderBy("row").collect()
    assert [r.caption for r in got] == ['Start, then "Validate"\nthen End', "Plain"] and got[1].difficulty == "Hard"
    path.write_text("file,caption\na.svg,x\n")
    with pytest.raises(ValueError, match="difficulty"):
        R.read_manifest(spark, str(path))
    path.write_text('file,difficulty,caption\na.svg,easy,"open\n')
    with pytest.raises(ValueError, match="unterminated"):
        R.read_manifest(spark, str(path))
    path.write_text("file,difficulty,caption\na.svg,easy\n")
    with pytest.raises(Exception, match="row 1 does not have 3 columns"):
        R.read_manifest(spark, str(path)).collect()


def test_score_readers(spark, tmp_path):
    lines = [{"id": "a", "dimension": "x", "score": 7, "reasoning": "r", "observation": "o"}, {"id": "b", "dimension": "x", "score": True, "reasoning": "r", "observation": "o"},
             {"id": "c", "dimension": "x", "score": 11, "reasoning": "r", "observation": "o"}, {"id": "d", "dimension": "x", "score": 7.5, "reasoning": "r", "observation": "o"},
             {"id": "e", "dimension": "x", "score": 50, "reasoning": " ", "observation": "o"}]
    path = str(tmp_path / "s.jsonl")
    (tmp_path / "s.jsonl").write_text("\n".join(json.dumps(l) for l in lines) + "\nnot json\n")
    good, bad = R.read_direct_scores(spark, path)
    assert rows(good, "id", "score") == [("a", 7)] and bad.count() == 5
    assert rows(R.read_beauty_scores(spark, path)[0], "id") == [("a",), ("c",)]
    (tmp_path / "dup.jsonl").write_text("\n".join(json.dumps(lines[0]) for _ in range(2)))
    with pytest.raises(Exception, match="duplicate saved score"):
        R.read_score_log(spark, str(tmp_path / "dup.jsonl")).collect()


def test_rubric_and_images(spark, tmp_path):
    rule = {"id": "presence.elements", "dimension": "presence", "description": "d", "severity": "high", "deterministic_metric": "m"}
    (tmp_path / "r.json").write_text(json.dumps({"criteria": [rule, {**rule, "id": "x.y"}]}))
    assert R.read_rubric(spark, str(tmp_path / "r.json")).count() == 2
    (tmp_path / "r2.json").write_text(json.dumps({"criteria": [rule, rule]}))
    with pytest.raises(Exception, match="duplicate criterion id"):
        R.read_rubric(spark, str(tmp_path / "r2.json")).collect()
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (640).to_bytes(4, "big") + (360).to_bytes(4, "big") + b"\0" * 8)
    (tmp_path / "img" / "b.png").write_bytes(b"nope")
    assert rows(R.read_image_sizes(spark, str(tmp_path / "img")), "width", "height") == [(640, 360), (None, None)]


def test_judging_reuses_and_retries(spark):
    drawings = spark.createDataFrame([("a", "same"), ("b", "same"), ("c", "other")], "diagram_id string, caption string")
    requests = J.judge_requests(drawings, {"layout": "Rate."})
    assert J.distinct_requests(requests).count() == 2

    def flaky(prompt):
        if "other" in prompt:
            raise RuntimeError("down")
        return '{"score": 7}'

    answers = J.judge(J.distinct_requests(requests), flaky)
    got = {r.diagram_id: (r.answer, r.error) for r in J.fan_out(requests, answers).collect()}
    assert got == {"a": ('{"score": 7}', None), "b": ('{"score": 7}', None), "c": (None, "down")}
    assert rows(J.pending(requests, requests.filter("diagram_id = 'a'"), ["diagram_id", "dimension"]), "diagram_id") == [("b",), ("c",)]


def test_prompt_versions_are_frozen(spark):
    columns = "version string, parent string, dimension string, text string, edits string, evidence_ids array<string>"
    versions = spark.createDataFrame([("v1", None, "contrast", "Head ## RULES old", "", ["a"])], columns)
    edits = spark.createDataFrame([("contrast", " new", "one edit", ["b"])], "dimension string, body string, edits string, evidence_ids array<string>")
    new = J.new_prompt_version(versions, "v1", "v2", "## RULES", edits)
    assert new.first().text == "Head ## RULES new"
    assert J.new_prompt_version(versions, "v1", "v1", "## RULES", edits).count() == 0


def test_manifest_rules(spark):
    base = dict(file="a.svg", found=True, difficulty=" EASY ", caption="c", caption_file="", caption_text="", id="", label="")
    data = [{**base, "row": 1, "sha256": "aa"}, {**base, "row": 2, "sha256": "aa"}, {**base, "row": 3, "sha256": "bb", "difficulty": "tricky"},
            {**base, "row": 4, "sha256": "cc", "id": "has space"}, {**base, "row": 5, "sha256": "dd", "caption": "  "}, {**base, "row": 6, "sha256": "ee", "file": "n.txt"},
            {**base, "row": 7, "sha256": "ff", "id": "X"}, {**base, "row": 8, "sha256": "gg", "id": "X"}, {**base, "row": 9, "sha256": "hh", "caption_file": "f.md", "caption_text": "t"}]
    df = spark.createDataFrame(data, "row long, file string, found boolean, sha256 string, difficulty string, caption string, caption_file string, caption_text string, id string, label string")
    assert rows(V.manifest_problems(df)) == [
        (2, "id already used"), (2, "same content as an earlier row"), (3, "unknown difficulty"), (4, "invalid id"), (5, "caption is empty"),
        (6, "not an image"), (8, "id already used"), (9, "two captions")]
