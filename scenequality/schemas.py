"""Closed value sets, default settings and table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
CORRECTNESS = ("presence", "layout", "connectivity", "details", "legibility")
BEAUTY = ("centering", "space_use", "color_consistency", "contrast", "alignment",
          "style_uniformity", "resolution", "canvas_fill")
# Order of the thirteen score columns in the study export.
SCORE_KEYS = ("layout", "connectivity", "presence", "details", "legibility") + BEAUTY
LEVELS = ("easy", "medium", "hard")
SEVERITY_MULTIPLIERS = {"low": 1.0, "medium": 2.0, "high": 4.0, "critical": 8.0}
VERDICTS = ("present", "mislabeled", "uncertain", "absent")      # tie order of the vote
STATUSES = ("present", "reversed", "uncertain", "absent")        # tie order of the vote
DRAWN = ("present", "mislabeled")
LINKED = ("present", "reversed")
PLACEHOLDERS = ("tbd", "todo", "placeholder", "thing", "thing 1", "layer", "unknown")
SHAPE_TAGS = ("rect", "circle", "ellipse", "polygon")
MARKUP_TAGS = ("rect", "circle", "ellipse", "line", "polyline", "polygon", "path", "text")
SKIPPED_TAGS = ("defs", "marker", "clipPath", "mask", "pattern", "style", "metadata", "title", "desc")
AXES = ("top_to_bottom", "bottom_to_top", "left_to_right", "right_to_left")
RELATIONS = ("above", "left_of", "same_row", "same_column")
IMAGE_TYPES = (".svg", ".png", ".jpg", ".jpeg", ".webp")
SAME_ELEMENT_IOU = 0.7
MIN_SENSITIVITY = 15.0
CAUGHT_BELOW = 8
MIN_CHANGED_PIXELS = 60
DISPLAY_PANEL = (660, 360)

GEOMETRY = {
    "endpoint_tolerance": 0.035,
    "minimum_font_size": 12.0,
    "overlap_area_threshold": 0.01,
    "label_similarity_threshold": 0.45,
    "canvas_tolerance": 0.5,
    "min_role_links": 2,
}

# criterion id, dimension, severity, metric
RUBRIC = (
    ("presence.elements", "presence", "high", "description_presence"),
    ("presence.unexpected", "presence", "medium", "unexpected_components"),
    ("layout.order", "layout", "medium", "description_order"),
    ("layout.canvas", "layout", "high", "canvas_bounds"),
    ("layout.overlap", "layout", "high", "unintended_overlap"),
    ("layout.routing", "layout", "medium", "connector_routing"),
    ("connectivity.connections", "connectivity", "critical", "description_connections"),
    ("connectivity.endpoints", "connectivity", "critical", "connector_attachment"),
    ("details.labels", "details", "high", "meaningful_labels"),
    ("details.connection_labels", "details", "high", "connection_labels"),
    ("legibility.overflow", "legibility", "high", "text_overflow"),
    ("legibility.minimum_font", "legibility", "high", "minimum_font_size"),
    ("legibility.contrast", "legibility", "medium", "text_contrast"),
)

# --- table schemas ----------------------------------------------------------
POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])

CRITERIA = "criterion_id string, dimension string, severity string, metric string"
ELEMENTS = ("diagram_id string, seq bigint, element_id string, tag string, "
            "x double, y double, w double, h double, text string, font_size double, "
            "fill string, stroke string, marker_start string, marker_end string, "
            "points array<struct<x:double,y:double>>")
METRIC_SCORES = ("diagram_id string, criterion_id string, dimension string, judge string, "
                 "expected_count bigint, detected_issues bigint")
INVENTORY = ("inventory map<string,array<string>>, "
             "components array<struct<id:string,label:string,kind:string,tier:string>>, "
             "connections array<struct<source:string,target:string,label:string,tier:string>>, "
             "forbidden_placeholders array<string>")
_LOCATION = "struct<x0:double,y0:double,x1:double,y1:double>"
JUDGE_ANSWER = (
    f"components array<struct<component_id:string,verdict:string,visible_text:string,"
    f"location:{_LOCATION},label_legible:boolean,evidence:string>>, "
    "connections array<struct<connection_id:string,verdict:string,visible_label:string,"
    "label_legible:boolean,evidence:string>>, "
    f"extra_components array<struct<visible_text:string,location:{_LOCATION}>>, "
    "extra_connections array<struct<from_text:string,to_text:string>>, "
    f"other_components array<struct<visible_text:string,location:{_LOCATION}>>, "
    "other_connections array<struct<from_text:string,to_text:string>>, "
    "metrics array<struct<criterion_id:string,detected_issues:bigint,"
    "issues:array<struct<description:string,severity:string,element_ids:array<string>>>,notes:string>>"
)


def criteria_table(spark, rows=RUBRIC):
    """The rubric as a DataFrame (configuration-sized)."""
    return spark.createDataFrame(list(rows), CRITERIA)
