"""Boxes, polylines, transforms, colour and score-scale arithmetic."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, functions as F

from scenequality.schemas import DISPLAY_PANEL, SHAPE_TAGS


def half_even(value: Column, digits: int = 0, snap: bool = True) -> Column:
    """Round to ``digits`` decimals, exact ties to even, judging the binary value itself.

    The product with 10^digits is split into its rounded part and its error, so a value a hair below
    a tie (1.275) is not mistaken for one. ``snap`` first removes summation noise beyond the ninth
    decimal: the order in which a mean was added up cannot move a result.
    """
    v = F.round(value.cast("double"), 9) if snap else value.cast("double")
    scale = float(10 ** digits)
    wide = v * 134217729.0
    high = wide - (wide - v)
    product = v * scale
    error = (high * scale - product) + (v - high) * scale
    low = F.floor(product)
    beyond = (product - (low + 0.5)) + error
    up = F.when(beyond > 0, 1).when(beyond < 0, 0).otherwise(F.pmod(low, F.lit(2)))
    return (low + up) / scale


class Box(NamedTuple):
    x: Column
    y: Column
    w: Column
    h: Column

    @property
    def right(self) -> Column:
        return self.x + self.w

    @property
    def bottom(self) -> Column:
        return self.y + self.h

    @property
    def cx(self) -> Column:
        return self.x + self.w / 2

    @property
    def cy(self) -> Column:
        return self.y + self.h / 2


def box(alias: str = "", prefix: str = "") -> Box:
    dot = f"{alias}." if alias else ""
    return Box(*(F.col(f"{dot}{prefix}{name}") for name in ("x", "y", "w", "h")))


# --- G1, G2 ---
def contains_point(b: Box, px: Column, py: Column) -> Column:
    return (b.x <= px) & (px <= b.right) & (b.y <= py) & (py <= b.bottom)


def intersects(a: Box, b: Box) -> Column:
    return (a.right > b.x) & (b.right > a.x) & (a.bottom > b.y) & (b.bottom > a.y)


def area(b: Box) -> Column:
    return F.greatest(F.lit(0.0), b.w) * F.greatest(F.lit(0.0), b.h)


def contains_box(outer: Box, inner: Box, tolerance: float = 0.0) -> Column:
    t = F.lit(float(tolerance))
    return (
        (outer.x - t <= inner.x) & (outer.y - t <= inner.y)
        & (outer.right + t >= inner.right) & (outer.bottom + t >= inner.bottom)
    )


def intersection_area(a: Box, b: Box) -> Column:
    width = F.greatest(F.lit(0.0), F.least(a.right, b.right) - F.greatest(a.x, b.x))
    height = F.greatest(F.lit(0.0), F.least(a.bottom, b.bottom) - F.greatest(a.y, b.y))
    return width * height


def overlap_fraction(a: Box, b: Box) -> Column:
    smaller = F.least(area(a), area(b))
    return F.when(smaller > 0, intersection_area(a, b) / smaller).otherwise(F.lit(0.0))


def union_box(a: Box, b: Box) -> Box:
    x, y = F.least(a.x, b.x), F.least(a.y, b.y)
    return Box(x, y, F.greatest(a.right, b.right) - x, F.greatest(a.bottom, b.bottom) - y)


def covers_canvas(b: Box, width: Column, height: Column) -> Column:
    return (b.x <= 0) & (b.y <= 0) & (b.right >= width) & (b.bottom >= height)


# --- G3 ---
def distance_point_box(px: Column, py: Column, b: Box) -> Column:
    dx = F.greatest(b.x - px, F.lit(0.0), px - b.right)
    dy = F.greatest(b.y - py, F.lit(0.0), py - b.bottom)
    return F.sqrt(dx * dx + dy * dy)


def distance_point_segment(px, py, x1, y1, x2, y2) -> Column:
    dx, dy = x2 - x1, y2 - y1
    length = dx * dx + dy * dy
    along = ((px - x1) * dx + (py - y1) * dy) / F.nullif(length, F.lit(0.0))
    t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), along)), F.lit(0.0))
    ex, ey = px - (x1 + t * dx), py - (y1 + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def distance_point_polyline(px: Column, py: Column, points: Column) -> Column:
    """Distance to the nearest segment; null when there is no segment."""
    ends = F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0)))
    starts = F.slice(points, F.lit(1), F.greatest(F.size(points) - 1, F.lit(0)))
    return F.array_min(F.zip_with(
        starts, ends, lambda a, b: distance_point_segment(px, py, a["x"], a["y"], b["x"], b["y"])))


# --- G4 ---
def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two (x0, y0, x1, y1) structs."""
    width = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    height = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    inter = width * height
    size = lambda r: (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
    union = size(a) + size(b) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def normalized_box(location: Column, width: Column, height: Column) -> Column:
    """A usable box in [0, 1], or null; pixel coordinates are scaled when the size is known."""
    raw = F.array(*(location[name].cast("double") for name in ("x0", "y0", "x1", "y1")))
    pixels = F.array_max(raw) > 1.5
    size = lambda i: F.when(i % 2 == 0, width).otherwise(height).cast("double")
    clamp = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    scaled = F.transform(raw, lambda c, i: clamp(F.when(pixels, c / size(i)).otherwise(c)))
    unknown = F.coalesce(pixels, F.lit(False)) & (width.isNull() | height.isNull())

    def settle(corners):  # bound once: the corners are named several times below
        rounded = F.transform(corners, lambda v: half_even(v, 4, False))
        usable = ~unknown & (F.get(corners, F.lit(2)) > F.get(corners, F.lit(0))) & (F.get(corners, F.lit(3)) > F.get(corners, F.lit(1)))
        return F.when(usable, F.struct(*(F.get(rounded, F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1")))))

    return F.get(F.transform(F.array(scaled), settle), F.lit(0))


def normalized_location(b: Box, width: Column, height: Column) -> Column:
    """G17: element corners as fractions of the canvas."""
    w = F.coalesce(F.nullif(width, F.lit(0.0)), F.lit(1.0))
    h = F.coalesce(F.nullif(height, F.lit(0.0)), F.lit(1.0))
    return F.struct(half_even(b.x / w, 4, False).alias("x0"), half_even(b.y / h, 4, False).alias("y0"),
                    half_even(b.right / w, 4, False).alias("x1"), half_even(b.bottom / h, 4, False).alias("y1"))


# --- G5, G6, G7 ---
def bounds_from_points(points: Column) -> Box:
    return extent(F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"]))


def extent(xs: Column, ys: Column) -> Box:
    return Box(F.array_min(xs), F.array_min(ys), F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys))


def text_box(x: Column, baseline: Column, text: Column, font: Column, anchor: Column) -> Box:
    """Conservative text extent: 0.6 em per character, shifted by the anchor."""
    width = F.greatest(font * 0.6 * F.length(text), font * 0.4)
    left = x - F.when(anchor == "middle", width / 2).when(anchor == "end", width).otherwise(F.lit(0.0))
    return Box(left, baseline - font, width, font * 1.2)


def apply_affine(m: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """Apply a six-number matrix (a, b, c, d, e, f) held in an array column."""
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def compose_affine(left: Column, right: Column) -> Column:
    return F.array(
        left[0] * right[0] + left[2] * right[1],
        left[1] * right[0] + left[3] * right[1],
        left[0] * right[2] + left[2] * right[3],
        left[1] * right[2] + left[3] * right[3],
        left[0] * right[4] + left[2] * right[5] + left[4],
        left[1] * right[4] + left[3] * right[5] + left[5])


def render_scale(root_w: Column, root_h: Column, view_w: Column, view_h: Column) -> Column:
    """Pixels per drawing unit: the smaller of the two known ratios, 1 when neither is known."""
    ok = (view_w > 0) & (view_h > 0)
    ratio = lambda size, view: F.when(size != 0, size / view)
    return F.when(ok, F.coalesce(F.least(ratio(root_w, view_w), ratio(root_h, view_h)), F.lit(1.0))).otherwise(F.lit(1.0))


# --- G8 ---
def is_shape(tag: Column) -> Column:
    return tag.isin(*SHAPE_TAGS)


def is_text(tag: Column, text: Column) -> Column:
    return (tag == "text") & (F.trim(text) != "")


def has_arrowhead(start: Column, end: Column) -> Column:
    return (F.coalesce(start, F.lit("")) != "") | (F.coalesce(end, F.lit("")) != "")


def is_connector(tag: Column, fill: Column, stroke: Column, start: Column, end: Column) -> Column:
    open_fill = F.lower(fill).isin("none", "transparent")
    inked = ~F.lower(stroke).isin("", "none", "transparent")
    return tag.isin("line", "polyline") | ((tag == "path") & (has_arrowhead(start, end) | (open_fill & inked)))


def directed_points(points: Column, start: Column, end: Column) -> Column:
    """Tail-to-head order: reversed when the only arrowhead sits at the start."""
    backwards = (F.coalesce(start, F.lit("")) != "") & (F.coalesce(end, F.lit("")) == "")
    return F.when(backwards, F.reverse(points)).otherwise(points)


# --- G9, G10 ---
def channels(colour: Column) -> tuple[Column, Column, Column]:
    return tuple(F.conv(F.substring(colour, i, 2), 16, 10).cast("double") / 255 for i in (2, 4, 6))


def relative_luminance(colour: Column) -> Column:
    return luminance(*channels(colour))


def luminance(r: Column, g: Column, b: Column) -> Column:
    linear = lambda v: F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))
    return 0.2126 * linear(r) + 0.7152 * linear(g) + 0.0722 * linear(b)


def contrast_ratio(first: Column, second: Column) -> Column:
    return luminance_ratio(relative_luminance(first), relative_luminance(second))


def luminance_ratio(a: Column, b: Column) -> Column:
    return (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)


def hue_saturation(colour: Column) -> tuple[Column, Column]:
    """Hue in degrees and HLS saturation; both 0 for greys."""
    return channel_hue(*channels(colour))


def channel_hue(r: Column, g: Column, b: Column) -> tuple[Column, Column]:
    """``hue_saturation`` of channels; as they are named many times, give columns that hold them."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = F.nullif(top - low, F.lit(0.0))
    lightness = (top + low) / 2
    saturation = span / F.when(lightness <= 0.5, top + low).otherwise(2 - top - low)
    sixth = F.when(r == top, (g - b) / span).when(g == top, 2 + (b - r) / span).otherwise(4 + (r - g) / span)
    return F.coalesce(F.pmod(sixth * 60, F.lit(360.0)), F.lit(0.0)), F.coalesce(saturation, F.lit(0.0))


def hue_families(hues: Column, tolerance: float = 20.0) -> Column:
    """First-seen hue clusters on the colour circle; ``hues`` is an ordered array of degrees."""
    near = lambda h, k: F.least(F.abs(h - k), 360 - F.abs(h - k)) <= tolerance
    return F.aggregate(
        hues, F.array().cast("array<double>"),
        lambda seen, h: F.when(F.exists(seen, lambda k: near(h, k)), seen).otherwise(F.array_append(seen, h)))


# --- G12, G13, G14, G16 ---
def centering_score(left: Column, right: Column, top: Column, bottom: Column, width: Column, height: Column) -> Column:
    axis = lambda a, b, size: 100 * (1 - F.abs(a - b) / size)
    return half_even(F.least(axis(left, right, width), axis(top, bottom, height)), 0)


def canvas_fill_score(share: Column) -> Column:
    """0 up to 3 % of the canvas, 100 from 6 %, linear between."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), half_even(100 * (100 * share - 3) / 3, 0)))


def hundred_to_human(score: Column) -> Column:
    return 1 + 9 * score / 100


def unit_to_ten(score: Column) -> Column:
    return 10 * score


def hundred_to_ten(score: Column) -> Column:
    return score / 10


def display_scale(width: Column, height: Column) -> Column:
    return F.least(F.lit(float(DISPLAY_PANEL[0])) / width, F.lit(float(DISPLAY_PANEL[1])) / height)


def display_bucket(scale: Column) -> Column:
    return (F.when((scale >= 0.95) & (scale <= 1.05), F.lit("full size"))
            .when(scale < 0.45, F.lit("much smaller")).otherwise(F.lit("scaled")))


def gray_values(pixels: Column) -> Column:
    """Bytes of an 8-bit gray image as an array of numbers."""
    digits = F.hex(pixels)
    places = F.filter(F.sequence(F.lit(0), F.octet_length(pixels)), lambda i: i < F.octet_length(pixels))
    return F.transform(places, lambda i: F.conv(F.substr(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("int"))


def changed_pixels(a: Column, b: Column, same_size: Column, threshold: int = 60) -> Column:
    """G15 on gray-value arrays; -1 when the two images differ in size."""
    differing = F.size(F.filter(F.zip_with(a, b, lambda p, q: F.abs(p - q) > threshold), lambda v: v))
    return F.when(same_size, differing).otherwise(F.lit(-1))


def png_size(content: Column) -> Column:
    """Width and height from a PNG header as a struct, or null."""
    number = lambda start: F.conv(F.hex(F.substring(content, start, 4)), 16, 10).cast("int")
    width, height = number(17), number(21)
    ok = (F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A") & (F.length(content) >= 24) & (width > 0) & (height > 0)
    return F.when(ok, F.struct(width.alias("width"), height.alias("height")))
