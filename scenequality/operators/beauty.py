"""G11: measurements of margins, gaps, alignment, style and connectors per drawing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from scenequality.functions.geometry import box, channel_hue, channels, half_even, hue_families, luminance, luminance_ratio, relative_luminance


def margins(boxes: DataFrame, canvases: DataFrame) -> DataFrame:
    """Group bounds against the canvas: four margins and the worst opposite-side ratio."""
    b = box()
    group = boxes.groupBy("diagram_id").agg(F.min(b.x).alias("left"), F.min(b.y).alias("top"),
                                            F.max(b.right).alias("_r"), F.max(b.bottom).alias("_b"))
    rows = group.join(canvases.select("diagram_id", "width", "height"), "diagram_id").select(
        "diagram_id", "left", (F.col("width") - F.col("_r")).alias("right"), "top", (F.col("height") - F.col("_b")).alias("bottom"), "width", "height")
    ratio = lambda a, c: F.greatest(F.col(a), F.col(c)) / F.nullif(F.least(F.col(a), F.col(c)), F.lit(0.0))
    return rows.withColumn("worst_margin_ratio", half_even(F.greatest(ratio("left", "right"), ratio("top", "bottom")), 2))


def min_gap_pct(edges: DataFrame, boxes: DataFrame) -> DataFrame:
    """Smallest gap between linked boxes along their dominant axis, in percent of their mean size."""
    put = lambda p, end: boxes.select("diagram_id", F.col("node").alias(end), *(F.col(c).alias(f"{p}{c}") for c in ("x", "y", "w", "h")))
    both = edges.select("diagram_id", "source", "target").join(put("a_", "source"), ["diagram_id", "source"]).join(
        put("b_", "target"), ["diagram_id", "target"])
    a, b = box(prefix="a_"), box(prefix="b_")
    across = F.abs(a.cx - b.cx) >= F.abs(a.cy - b.cy)
    gap = F.when(across, (F.greatest(a.x, b.x) - F.least(a.right, b.right)) / ((a.w + b.w) / 2)).otherwise(
        (F.greatest(a.y, b.y) - F.least(a.bottom, b.bottom)) / ((a.h + b.h) / 2))
    return both.groupBy("diagram_id").agg(half_even(100 * F.min(gap), 1).alias("min_gap_to_node_pct"))


def line_offsets(boxes: DataFrame, line: str, axis: str) -> DataFrame:
    """Largest centre offset inside any row (axis 'y') or column (axis 'x'), in percent of node size."""
    b = box()
    centre, size = (b.cx, b.w) if axis == "x" else (b.cy, b.h)
    per = boxes.groupBy("diagram_id", line).agg(((F.max(centre) - F.min(centre)) / F.avg(size)).alias("_o"))
    return per.groupBy("diagram_id").agg(half_even(100 * F.max("_o"), 1).alias("max_offset_pct"))


def row_gap_ratio(boxes: DataFrame, line: str = "row_no") -> DataFrame:
    """W5: largest over smallest gap between neighbours of one row, worst row per drawing."""
    along = Window.partitionBy("diagram_id", line).orderBy("x", "node")
    gap = F.lead("x").over(along) - (F.col("x") + F.col("w"))
    gaps = boxes.withColumn("_g", gap).filter(F.col("_g").isNotNull())
    per = gaps.groupBy("diagram_id", line).agg((F.max("_g") / F.nullif(F.min("_g"), F.lit(0.0))).alias("_r"))
    return per.groupBy("diagram_id").agg(half_even(F.max("_r"), 2).alias("row_gap_ratio"))


def diagonal_connectors(connectors: DataFrame) -> DataFrame:
    a, b = F.col("points")[0], F.element_at("points", -1)
    slanted = (F.abs(a["x"] - b["x"]) > 1) & (F.abs(a["y"] - b["y"]) > 1)
    return connectors.groupBy("diagram_id").agg(F.count_if(slanted).alias("diagonal_connectors"))


def style_variants(elements: DataFrame, by: str, signature: list[str]) -> DataFrame:
    """Distinct style signatures per role (or arrow kind): distinct first, then count."""
    return elements.select("diagram_id", by, *signature).distinct().groupBy("diagram_id", by).agg(
        F.count(F.lit(1)).alias("styles"))


def colour_facts(fills: DataFrame, background: Column) -> DataFrame:
    """Hue families and the weakest box contrast per drawing.

    Only distinct colours of a drawing are ordered (first use first), never its elements. The text of a colour is read
    once: everything else is arithmetic on its channels.
    """
    distinct = fills.groupBy("diagram_id", "fill").agg(F.min("seq").alias("_first"))
    r, g, b = (F.col(c) for c in ("_r", "_g", "_b"))
    read = distinct.withColumns(dict(zip(("_r", "_g", "_b"), channels(F.col("fill")))))
    hue, saturation = channel_hue(r, g, b)
    rows = read.withColumns({"_hue": hue, "_sat": saturation, "_light": luminance(r, g, b)}).withColumn(
        "_contrast", luminance_ratio(F.col("_light"), relative_luminance(background)))
    ordered = F.sort_array(F.collect_list(F.when(F.col("_sat") >= 0.25, F.struct("_first", "_hue"))))
    return rows.groupBy("diagram_id").agg(
        F.size(hue_families(F.transform(ordered, lambda s: s["_hue"]))).alias("hue_families"),
        half_even(F.min("_contrast"), 2).alias("min_box_contrast"))
