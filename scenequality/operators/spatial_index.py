"""Levelled grid cells for spatial joins.

Ordinary drawings join on ``diagram_id`` alone: with at most ``CROWDED_DRAWING`` elements their pairs
are few and never leave the task. In drawings above that every box belongs to the level whose cells (a power of two
wide) are as large as itself, so it touches four cells at most, whether it is a small box or the background. A point
looks up its one cell at each level of the drawing. Every spatial predicate is local, hence results do not depend on
the grid. One partial count (``drawing_grid``) decides the plan; pass its result to several operators to count only once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scenequality.functions.geometry import Box, box
from scenequality.session import cut_lineage

CROWDED_DRAWING = 512
AUTO = "auto"
CELL = ("_cl", "_cx", "_cy")  # level, column and row of a cell
_CELLS = "array<struct<_cl:int,_cx:bigint,_cy:bigint>>"


def _level(extent: Column) -> Column:
    """Number of the smallest cell side (a power of two) that is at least ``extent``."""
    return F.when(extent > 0, F.ceil(F.log2(extent))).cast("int")


def drawing_grid(shapes: DataFrame, limit: int = CROWDED_DRAWING) -> DataFrame | None:
    """(diagram_id, _low, _high) levels of the drawings with more than ``limit`` boxes, or None when there are none.

    Boxes below the average size share the lowest level; the highest leaves room for margins around the largest box.
    """
    b = box()
    size = F.greatest(b.w, b.h)
    per = shapes.groupBy("diagram_id").agg(F.count(F.lit(1)).alias("_n"), F.avg(size).alias("_mean"), F.max(size).alias("_most"))
    crowded = per.filter((F.col("_n") > limit) & (F.col("_mean") > 0)).select(
        "diagram_id", _level(F.col("_mean")).alias("_low"), (_level(F.col("_most")) + 1).alias("_high"))
    crowded = cut_lineage(crowded)
    return None if crowded.isEmpty() else crowded


def resolve_grid(grid: DataFrame | None | str, shapes: DataFrame) -> DataFrame | None:
    return drawing_grid(shapes) if isinstance(grid, str) else grid


def _own_level(b: Box, margin: Column) -> Column:
    """The box's level within those of its drawing."""
    return F.least(F.col("_high"), F.greatest(F.col("_low"), F.coalesce(_level(F.greatest(b.w, b.h) + 2 * margin), F.col("_low"))))


def _touched(b: Box, margin: Column, level: Column, tag: Column) -> Column:
    """Cells of ``level`` that the box touches, as structs numbered by ``tag``."""
    cell = lambda v: F.floor(v / F.pow(F.lit(2.0), level)).cast("bigint")
    columns = F.sequence(cell(b.x - margin), cell(b.right + margin))
    lines = F.sequence(cell(b.y - margin), cell(b.bottom + margin))
    return F.flatten(F.transform(columns, lambda i: F.transform(lines, lambda j: F.struct(
        tag.cast("int").alias("_cl"), i.alias("_cx"), j.alias("_cy")))))


def _placed(df: DataFrame, grid: DataFrame, cells: Column) -> DataFrame:
    """One row per cell; drawings without a grid have a single one."""
    origin = F.array(F.struct(F.lit(0).alias("_cl"), F.lit(0).cast("bigint").alias("_cx"), F.lit(0).cast("bigint").alias("_cy")))
    return df.join(grid, "diagram_id", "left").select(*df.columns, F.inline(F.when(F.col("_low").isNull(), origin).otherwise(cells)))


def with_cells(df: DataFrame, b: Box, grid: DataFrame | None, margin: Column | float = 0.0) -> DataFrame:
    """One row per cell of its own level that ``b`` (grown by ``margin``) touches; unchanged without a grid."""
    if grid is None:
        return df
    m = margin if isinstance(margin, Column) else F.lit(float(margin))
    return _placed(df, grid, F.flatten(F.transform(F.array(_own_level(b, m)), lambda level: _touched(b, m, level, level))))


def at_cell(df: DataFrame, px: Column, py: Column, grid: DataFrame | None) -> DataFrame:
    """One row per level of the drawing: the cell of a point there."""
    if grid is None:
        return df
    cell = lambda v, level: F.floor(v / F.pow(F.lit(2.0), level)).cast("bigint")
    return _placed(df, grid, F.transform(F.sequence(F.col("_low"), F.col("_high")), lambda level: F.struct(
        level.alias("_cl"), cell(px, level).alias("_cx"), cell(py, level).alias("_cy"))))


def pair_cells(left: DataFrame, a: Box, right: DataFrame, b: Box, grid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join between boxes of any size, celled so that touching boxes meet.

    Each box is entered at its own level. A box of the left side looks for right ones at its own level and above, a
    box of the right side for left ones above its own; even and odd cell numbers keep the two searches apart.
    """
    zero = F.lit(0.0)

    def cells(c: Box, entered: int, above: int, first: int) -> Column:
        own = F.array(_own_level(c, zero))
        here = F.transform(own, lambda level: _touched(c, zero, level, level * 2 + entered))
        levels = F.filter(F.sequence(F.col("_low"), F.col("_high") + 1), lambda k: (k >= own[0] + first) & (k <= F.col("_high")))
        return F.flatten(F.concat(here, F.transform(levels, lambda level: _touched(c, zero, level, level * 2 + above))))

    return _placed(left, grid, cells(a, 1, 0, 0)), _placed(right, grid, cells(b, 0, 1, 1))


def cell_join(left: DataFrame, right: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    """Join two celled frames (their other columns must not clash) on drawing, cell and ``on``."""
    names = {"diagram_id": "_rd", "_cl": "_rl", "_cx": "_rx", "_cy": "_ry"}
    shared = {k: v for k, v in names.items() if k in right.columns}
    keyed = right.withColumnsRenamed(shared)
    same = on
    for k, v in shared.items():
        same = (F.col(k) == F.col(v)) & same
    joined = left.join(keyed, same, how)
    return joined.drop(*names.values()) if how in ("left_semi", "left_anti") else joined.drop(*names.values(), *CELL)
