"""Drawing geometry: containers, labels inside shapes, collisions, overflow, canvas and font checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scenequality.functions import geometry as G
from scenequality.functions.geometry import Box, box
from scenequality.operators.spatial_index import AUTO, CELL, at_cell, cell_join, pair_cells, resolve_grid, with_cells
from scenequality.schemas import GEOMETRY
from scenequality.session import cut_lineage

BOX = ["x", "y", "w", "h"]


def shapes_of(elements: DataFrame) -> DataFrame:
    return elements.filter(G.is_shape(F.col("tag"))).select("diagram_id", "seq", "element_id", "tag", *BOX)


def texts_of(elements: DataFrame) -> DataFrame:
    return elements.filter(G.is_text(F.col("tag"), F.col("text"))).select("diagram_id", "seq", "element_id", "text", *BOX)


def _renamed(df: DataFrame, prefix: str, keep: tuple[str, ...] = ("diagram_id", *CELL)) -> DataFrame:
    return df.select(*(F.col(c) if c in keep else F.col(c).alias(f"{prefix}{c}") for c in df.columns))


# --- J1 ---
def smallest_container(elements: DataFrame, grid=AUTO) -> DataFrame:
    """Each text with the smallest shape holding its centre (first in document order on a tie).

    The argmin is a partial aggregation, so pairs never leave the task that made them. With a grid,
    identical shapes first collapse to their first copy. Texts outside every shape keep null.
    """
    shapes, texts = shapes_of(elements), texts_of(elements)
    grid = resolve_grid(grid, shapes)
    first = F.struct("seq", "element_id", "tag")
    if grid is None:
        unique = shapes.select("diagram_id", *BOX, first.alias("first"))
    else:
        unique = shapes.groupBy("diagram_id", *BOX).agg(F.min(first).alias("first"))
    t, s = box(prefix="t_"), box(prefix="s_")
    left = at_cell(_renamed(texts, "t_"), t.cx, t.cy, grid)
    right = _renamed(with_cells(unique, box(), grid), "s_")
    hit = cell_join(left, right, G.contains_point(s, t.cx, t.cy), "left")
    best = F.min(F.when(F.col("s_first").isNotNull(), F.struct(
        G.area(s).alias("area"), F.col("s_first.seq").alias("seq"), F.col("s_first.element_id").alias("element_id"),
        F.col("s_first.tag").alias("tag"), s.x.alias("x"), s.y.alias("y"), s.w.alias("w"), s.h.alias("h"))))
    own = [F.first(f"t_{c}").alias(f"t_{c}") for c in ("element_id", "text", *BOX)]  # one text per (drawing, seq)
    per = hit.groupBy("diagram_id", "t_seq").agg(*own, best.alias("_s"))
    return per.select(
        "diagram_id", F.col("t_seq").alias("text_seq"), F.col("t_element_id").alias("text_id"), F.col("t_text").alias("text"),
        *(F.col(f"t_{c}").alias(f"text_{c}") for c in BOX),
        F.col("_s.seq").alias("shape_seq"), F.col("_s.element_id").alias("shape_id"), F.col("_s.tag").alias("shape_tag"),
        *(F.col(f"_s.{c}").alias(f"shape_{c}") for c in BOX))


def labeled_shapes(elements: DataFrame, grid=AUTO) -> DataFrame:
    return smallest_container(elements, grid).filter(F.col("shape_seq").isNotNull())


# --- J9 ---
def containers(shapes: DataFrame, tolerance: float = 0.1, grid=AUTO) -> DataFrame:
    """Ids of shapes that hold another shape (another id); a semi-join, so no pairs are produced."""
    grid = resolve_grid(grid, shapes)
    outer = _renamed(with_cells(shapes, box(), grid, tolerance), "o_")
    inner = _renamed(at_cell(shapes, F.col("x"), F.col("y"), grid), "i_")
    o, i = box(prefix="o_"), box(prefix="i_")
    on = (F.col("o_element_id") != F.col("i_element_id")) & G.contains_box(o, i, tolerance)
    return cell_join(outer, inner, on, "left_semi").select("diagram_id", F.col("o_element_id").alias("element_id")).distinct()


def leaves(elements: DataFrame, grid=AUTO, texts: DataFrame | None = None) -> DataFrame:
    """Shapes that are neither containers nor arrowheads (polygons without a label).

    ``texts``: the result of ``smallest_container``, where it is there already.
    """
    shapes = shapes_of(elements)
    grid = resolve_grid(grid, shapes)
    kept = shapes.join(containers(shapes, grid=grid), ["diagram_id", "element_id"], "left_anti")
    polygons = kept.filter(F.col("tag") == "polygon").select("diagram_id", "seq")
    texts = smallest_container(elements, grid) if texts is None else texts
    named = texts.filter(F.col("shape_tag") == "polygon").select(
        "diagram_id", F.col("shape_seq").alias("seq"))
    bare = polygons.join(named, ["diagram_id", "seq"], "left_anti")
    return kept.join(bare, ["diagram_id", "seq"], "left_anti")


# --- J8, J11 ---
def _two_first(df: DataFrame) -> DataFrame:
    """Distinct boxes with their first and second copy in document order."""
    keys = ["diagram_id", *BOX]
    copy = F.struct("seq", "element_id")
    base = df.groupBy(*keys).agg(F.min(copy).alias("first"), F.count(F.lit(1)).alias("copies"))
    repeated = base.filter(F.col("copies") > 1).select(*keys, "first")
    later = df.join(repeated, keys).filter(F.col("seq") > F.col("first.seq")).groupBy(*keys).agg(F.min(copy).alias("second"))
    return base.join(later, keys, "left").select(*keys, "first", "second")


def first_overlaps(left: DataFrame, right: DataFrame, threshold: float, grid=AUTO) -> DataFrame:
    """For each left element the first right element (not itself) it overlaps by more than ``threshold``.

    Only the running minimum per left element is shuffled. Crowded drawings take the gridded way.
    """
    grid = resolve_grid(grid, right)
    if grid is None:
        return _first_in_drawing(left, right, threshold)
    crowded = grid.select("diagram_id")
    small = lambda d: d.join(crowded, "diagram_id", "left_anti")
    large = lambda d: d.join(crowded, "diagram_id", "left_semi")
    return _first_in_drawing(small(left), small(right), threshold).unionByName(
        _first_in_grid(large(left), large(right), threshold, grid))


def _first_in_drawing(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    a, b = box(prefix="a_"), box(prefix="b_")
    la = _renamed(left.select("diagram_id", "seq", *BOX), "a_")
    rb = _renamed(right.select("diagram_id", "seq", *BOX), "b_")
    pairs = cell_join(la, rb, (F.col("a_seq") != F.col("b_seq")) & G.intersects(a, b) & (G.overlap_fraction(a, b) > threshold))
    best = pairs.groupBy("diagram_id", F.col("a_seq").alias("seq")).agg(F.min("b_seq").alias("partner_seq"))
    names = right.select("diagram_id", F.col("seq").alias("partner_seq"), F.col("element_id").alias("partner_id"))
    return left.join(best, ["diagram_id", "seq"]).join(names, ["diagram_id", "partner_seq"]).select(*left.columns, "partner_seq", "partner_id")


def _first_in_grid(left: DataFrame, right: DataFrame, threshold: float, grid: DataFrame) -> DataFrame:
    """Copies of a box collapse to one row with its first two owners; distinct boxes join per cell."""
    keys = ["diagram_id", *BOX]
    owners = _two_first(right)
    spots = left.select(*keys).distinct()
    a, b = box(prefix="a_"), box(prefix="b_")
    spots, held = pair_cells(spots, box(), owners.drop("second"), box(), grid)
    la, rb = _renamed(spots, "a_"), _renamed(held, "b_")
    differs = (a.x != b.x) | (a.y != b.y) | (a.w != b.w) | (a.h != b.h)
    pairs = cell_join(la, rb, G.intersects(a, b) & differs & (G.overlap_fraction(a, b) > threshold))
    other = pairs.groupBy("diagram_id", *(f"a_{c}" for c in BOX)).agg(F.min("b_first").alias("other"))
    other = other.select("diagram_id", *(F.col(f"a_{c}").alias(c) for c in BOX), "other")
    own = F.when(F.col("first.seq") != F.col("seq"), F.col("first")).otherwise(F.col("second"))
    joined = left.join(owners, keys, "left").join(other, keys, "left")
    partner = F.least(F.col("other"), F.when((G.area(box()) > 0) & F.lit(threshold < 1), own))
    return (joined.withColumn("_p", partner).filter(F.col("_p").isNotNull())
            .select(*left.columns, F.col("_p.seq").alias("partner_seq"), F.col("_p.element_id").alias("partner_id")))


def shape_collisions(elements: DataFrame, threshold: float = GEOMETRY["overlap_area_threshold"],
                     shapes: DataFrame | None = None, grid=AUTO) -> DataFrame:
    """Colliding leaf shapes, one row per shape id, with the first shape each collides with."""
    grid = resolve_grid(grid, shapes_of(elements))
    pool = leaves(elements, grid) if shapes is None else shapes
    pool = cut_lineage(pool)  # both sides of the pair join and the name lookups
    hits = first_overlaps(pool, pool, threshold, grid)
    return hits.groupBy("diagram_id", "element_id").agg(
        F.min(F.struct("partner_seq", "partner_id")).alias("_p")).select(
        "diagram_id", "element_id", F.col("_p.partner_id").alias("partner_id"))


def foreground(elements: DataFrame, canvases: DataFrame) -> DataFrame:
    """Elements without shapes that cover the whole canvas; where no canvas is known, nothing is known to cover it."""
    size = canvases.select("diagram_id", "width", "height")
    covered = G.is_shape(F.col("tag")) & G.covers_canvas(box(), F.col("width"), F.col("height"))
    return elements.join(size, "diagram_id", "left").filter(~F.coalesce(covered, F.lit(False))).drop("width", "height")


def declared_leaves(elements: DataFrame, canvases: DataFrame, components: DataFrame, groups: DataFrame, matches: DataFrame) -> DataFrame:
    """v2 leaves: only declared groups and full-canvas backgrounds are exempt from collisions."""
    declared = groups.select("diagram_id", F.col("container").alias("component_id")).unionByName(
        components.filter(F.col("kind").isin("group", "container")).select("diagram_id", "component_id")).distinct()
    holders = matches.join(declared, ["diagram_id", "component_id"], "left_semi").select(
        "diagram_id", F.col("shape_id").alias("element_id"))
    return shapes_of(foreground(elements, canvases)).join(holders, ["diagram_id", "element_id"], "left_anti")


def overlap_metric(collisions: DataFrame, pool: DataFrame) -> DataFrame:
    """Expected and failing shape counts per drawing (A1 inputs)."""
    total = pool.groupBy("diagram_id").agg(F.count(F.lit(1)).alias("expected_count"))
    bad = collisions.groupBy("diagram_id").agg(F.count(F.lit(1)).alias("detected_issues"))
    return total.join(bad, "diagram_id", "left").fillna(0, ["detected_issues"])


# --- J11 ---
def text_overflow(elements: DataFrame, grid=AUTO, texts: DataFrame | None = None) -> DataFrame:
    """Every text with ``issue``: 'overflow' (leaves its box), 'collision' (free text on another text) or null.

    ``texts``: the written result of ``smallest_container``, where it is there already.
    """
    grid = resolve_grid(grid, elements)
    placed = cut_lineage(smallest_container(elements, grid)) if texts is None else texts  # the inside and the free texts
    t, s = box(prefix="text_"), box(prefix="shape_")
    inside = placed.filter(F.col("shape_seq").isNotNull()).select(
        "diagram_id", "text_id", F.col("shape_id").alias("other_id"),
        F.when(~G.contains_box(s, t), F.lit("overflow")).alias("issue"))
    free = placed.filter(F.col("shape_seq").isNull()).select(
        "diagram_id", F.col("text_seq").alias("seq"), F.col("text_id").alias("element_id"),
        *(F.col(f"text_{c}").alias(c) for c in BOX))
    hits = first_overlaps(free, texts_of(elements).drop("text"), 0.2, grid).select("diagram_id", "seq", "partner_id")
    loose = free.join(hits, ["diagram_id", "seq"], "left").select(
        "diagram_id", F.col("element_id").alias("text_id"), F.col("partner_id").alias("other_id"),
        F.when(F.col("partner_id").isNotNull(), F.lit("collision")).alias("issue"))
    return inside.unionByName(loose)


def overflow_metric(overflow: DataFrame) -> DataFrame:
    return overflow.groupBy("diagram_id").agg(
        F.count(F.lit(1)).alias("expected_count"), F.count("issue").alias("detected_issues"))


# --- J12 ---
def canvas_units(elements: DataFrame, canvases: DataFrame, matches: DataFrame | None = None,
                 tolerance: float = GEOMETRY["canvas_tolerance"]) -> DataFrame:
    """Units (matched component with its label, or a lone element) and whether each leaves the canvas."""
    size = canvases.select("diagram_id", "width", "height")
    canvas = Box(F.lit(0.0), F.lit(0.0), F.col("width"), F.col("height"))
    lone = elements.select("diagram_id", "seq", "element_id", "tag", *BOX)
    if matches is not None:
        used = matches.select("diagram_id", F.explode(F.array("shape_seq", "text_seq")).alias("seq")).filter("seq is not null")
        lone = lone.join(used, ["diagram_id", "seq"], "left_anti")
    lone = lone.join(size, "diagram_id")
    background = G.is_shape(F.col("tag")) & G.contains_box(box(), canvas, tolerance)
    units = lone.filter(~background).select(
        "diagram_id", F.col("element_id").alias("unit_id"), (~G.contains_box(canvas, box(), tolerance)).alias("outside"))
    if matches is None:
        return units
    s, t = box(prefix="shape_"), box(prefix="text_")
    whole = G.union_box(s, t)
    pick = lambda joined, alone: F.when(F.col("text_seq").isNotNull(), joined).otherwise(alone)
    unit = Box(pick(whole.x, s.x), pick(whole.y, s.y), pick(whole.w, s.w), pick(whole.h, s.h))
    parts = matches.join(size, "diagram_id").select(
        "diagram_id", F.col("component_id").alias("unit_id"), (~G.contains_box(canvas, unit, tolerance)).alias("outside"))
    return parts.unionByName(units)


def flag_metric(rows: DataFrame, flag: str) -> DataFrame:
    return rows.groupBy("diagram_id").agg(
        F.count(F.lit(1)).alias("expected_count"), F.count_if(F.col(flag)).alias("detected_issues"))


# --- A8 ---
def font_checks(elements: DataFrame, canvases: DataFrame, minimum: float = GEOMETRY["minimum_font_size"]) -> DataFrame:
    """Every text with its rendered size and whether it is below the minimum."""
    texts = elements.filter(F.col("tag") == "text").select("diagram_id", "element_id", "font_size")
    sized = texts.join(canvases.select("diagram_id", "render_scale"), "diagram_id")
    rendered = F.col("font_size") * F.col("render_scale")
    return sized.select("diagram_id", "element_id", rendered.alias("rendered"), (rendered < minimum).alias("small"))


# --- J10 ---
def unexpected_boxes(elements: DataFrame, matches: DataFrame, grid=AUTO, texts: DataFrame | None = None) -> DataFrame:
    """Labelled shapes that are no match and enclose none; one row per shape with its first text.

    ``texts``: the result of ``smallest_container``, where it is there already.
    """
    grid = resolve_grid(grid, shapes_of(elements))
    items = labeled_shapes(elements, grid) if texts is None else texts.filter(F.col("shape_seq").isNotNull())
    shapes = matches.select("diagram_id", "shape_seq").distinct()
    texts = matches.filter("text_seq is not null").select("diagram_id", "text_seq").distinct()
    rest = items.join(shapes, ["diagram_id", "shape_seq"], "left_anti").join(texts, ["diagram_id", "text_seq"], "left_anti")
    rest = cut_lineage(rest.select("diagram_id", "shape_seq", "shape_id", "text_seq", "text", *(f"shape_{c}" for c in BOX)))  # read twice
    outer = with_cells(rest, box(prefix="shape_"), grid)
    inner = at_cell(matches.select("diagram_id", *(F.col(f"shape_{c}").alias(f"m_{c}") for c in BOX)),
                    F.col("m_x"), F.col("m_y"), grid)
    holding = cell_join(outer, inner, G.contains_box(box(prefix="shape_"), box(prefix="m_")), "left_semi").select(
        "diagram_id", "shape_seq").distinct()
    return rest.join(holding, ["diagram_id", "shape_seq"], "left_anti").groupBy("diagram_id", "shape_seq", "shape_id").agg(
        F.min(F.struct("text_seq", "text")).alias("_t")).select("diagram_id", "shape_id", F.col("_t.text").alias("text"))


# --- V10 ---
def stray_placeholders(elements: DataFrame, matches: DataFrame, listed: DataFrame | None = None, ascii_only: bool = False) -> DataFrame:
    """Placeholder texts that are nobody's label."""
    from scenequality.functions.labels import is_placeholder, normalize_label
    texts = elements.filter(F.col("tag") == "text").select("diagram_id", "seq", "element_id", "text")
    used = matches.filter("text_seq is not null").select("diagram_id", F.col("text_seq").alias("seq"))
    rest = texts.join(used, ["diagram_id", "seq"], "left_anti").withColumn("norm", normalize_label(F.col("text"), ascii_only))
    fixed = rest.filter(is_placeholder(F.col("text"), F.col("norm")))
    if listed is not None:
        phrases = listed.select("diagram_id", normalize_label(F.col("text"), ascii_only).alias("norm")).filter("norm <> ''").distinct()
        fixed = fixed.unionByName(rest.filter(~is_placeholder(F.col("text"), F.col("norm"))).join(phrases, ["diagram_id", "norm"], "left_semi").select(*fixed.columns))
    return fixed.select("diagram_id", "element_id", "text")


# --- U4 ---
def scene_diff(before: DataFrame, after: DataFrame, columns: list[str] = (*BOX, "text", "font_size")) -> DataFrame:
    """Elements changed or removed between two states of the same drawings."""
    state = lambda df, name: df.select("diagram_id", "element_id", F.struct(*columns).alias(name))
    both = state(before, "before").join(state(after, "after"), ["diagram_id", "element_id"], "left")
    return both.filter(~F.col("before").eqNullSafe(F.col("after"))).select(
        "diagram_id", "element_id", F.when(F.col("after").isNull(), F.lit("removed")).otherwise(F.lit("changed")).alias("change"))
