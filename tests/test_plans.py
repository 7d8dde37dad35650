"""What queries write and share on the way to their results."""

import glob
import gzip

import pytest
from pyspark.sql import functions as F

from scenequality.operators import evaluation as E
from scenequality.plans import answer_queries as A, bindings as B
from scenequality.session import checkpoint_folder, cut_lineage
from tests.conftest import rows


class Few:
    """A scene of which the handlers below read one table."""

    def __init__(self, spark):
        self.rows = spark.createDataFrame([(1, True), (1, False), (2, False)], "diagram_id long, bad boolean")


@pytest.fixture
def tables(spark, tmp_path):
    spark.createDataFrame([(7, n, n, 1, 10.0 + n) for n in (1, 2, 3)] + [(8, 1, 1, 1, 11.0)],
                          "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").withColumn(
        "l_linenumber", F.col("l_partkey").cast("int")).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(n, f"part {n}", "TYPE") for n in (1, 2, 3)], "p_partkey long, p_name string, p_type string").write.parquet(
        f"{tmp_path}/part.parquet")
    spark.createDataFrame([(7,), (8,)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    return str(tmp_path)


def test_criteria_are_added_up_one_by_one(spark, capsys):
    handlers = {"a": lambda s: E.counted(s.rows, F.col("bad")), "b": lambda s: E.only_issues(s.rows)}
    criteria = [("x.one", "x", "low", "a"), ("x.two", "x", "low", "b"), ("x.one", "x", "low", "b"), ("x.none", "x", "low", "c")]
    out = E.evaluate_metrics(Few(spark), criteria, handlers=handlers)
    assert rows(out, "diagram_id", "criterion_id", "judge", "expected_count", "detected_issues") == sorted([
        (1, "x.one", "geometry", 2, 3), (2, "x.one", "geometry", 1, 1), (1, "x.two", "geometry", 0, 2), (2, "x.two", "geometry", 0, 1)], key=repr)
    out.explain()
    assert not any(step in capsys.readouterr().out for step in ("Exchange", "Aggregate", "Join"))


def test_no_criterion_has_a_handler(spark):
    with pytest.raises(ValueError):
        E.evaluate_metrics(Few(spark), [("x.none", "x", "low", "c")], handlers={})


@pytest.mark.parametrize("name, shared", [("connections", "slots"), ("lines", "slots"), ("links", "slots")])
def test_a_view_read_again_is_computed_once(spark, tables, name, shared):
    alone = rows(B.view(spark, tables, name))
    with B.sharing():
        found = B.view(spark, tables, name)
        assert B._scope.get()[shared] is not None
        assert rows(found) == alone and alone
        assert not any("lineitem" in f for f in found.inputFiles())


def test_elements_of_several_parts_share_their_boxes(spark, tables):
    alone = rows(B.elements(spark, tables))
    with B.sharing():
        found = B.elements(spark, tables)
        assert rows(found) == alone
        assert not any("lineitem" in f for f in found.inputFiles())
    with B.sharing():  # a single reading needs no copy
        assert any("lineitem" in f for f in B.elements(spark, tables, ("rects",)).inputFiles())


def test_written_tables_are_zstd(spark):
    import pyarrow.parquet as pq
    files = [f.removeprefix("file://").removeprefix("file:") for f in cut_lineage(spark.range(10)).inputFiles()]
    assert {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in files if pq.ParquetFile(f).metadata.num_rows} == {"ZSTD"}


def test_answers_are_written_compressed(spark, tables):
    folder = checkpoint_folder(spark).removeprefix("file:")
    before = set(glob.glob(f"{folder}/scenequality/answers-*/part-*"))
    parsed, inventories = A._parsed(spark, tables)
    written = set(glob.glob(f"{folder}/scenequality/answers-*/part-*")) - before
    assert written and all(f.endswith(".gz") for f in written)
    assert any(gzip.open(f, "rt").readline() for f in written)
    assert sorted(r.diagram_id for r in parsed.collect()) == ["7", "8"] == sorted(r.diagram_id for r in inventories.collect())


def test_metrics_of_answers_are_written_one_by_one(spark, tables, capsys):
    out = A._answer_metrics(spark, tables)
    assert {r.criterion_id for r in out.collect()} >= {"presence.elements", "details.labels"}
    out.explain()
    assert not any(step in capsys.readouterr().out for step in ("Exchange", "Aggregate", "Join"))
