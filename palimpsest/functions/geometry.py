"""Box geometry as column expressions: everything stays inside whole-stage code generation.

A box is given by a prefix: ``box("a")`` reads the columns a_x1, a_y1, a_x2, a_y2; ``box("")`` reads x1, y1, x2, y2.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.strings import let, places

Box = Mapping[str, Column]
#: Points per inch of the extractors that give PDF points; pages are 300 DPI pixels.
POINTS = 72.0


def box(prefix: str = "") -> Box:
    return {c: F.col(f"{prefix}_{c}" if prefix else c) for c in ("x1", "y1", "x2", "y2")}


def unit_or_own() -> list[Column]:
    """The unit box where there is one, else the pixel box, as ux1..uy2."""
    return [F.coalesce(f"n{c}", c).alias(f"u{c}") for c in ("x1", "y1", "x2", "y2")]


def area(b: Box) -> Column:
    return (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])


def overlap(a: Box, b: Box) -> Column:
    """Area of the intersection, 0 where the boxes don't meet."""
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))


def iou(a: Box, b: Box) -> Column:
    shared = overlap(a, b)
    union = area(a) + area(b) - shared
    return F.when((shared > 0) & (union > 0), shared / union).otherwise(F.lit(0.0))


def containment(a: Box, b: Box) -> Column:
    """Share of the smaller box that lies in the other."""
    shared, least = overlap(a, b), F.least(area(a), area(b))
    return F.when((shared > 0) & (least > 0), shared / least).otherwise(F.lit(0.0))


def centre_distance(a: Box, b: Box) -> Column:
    dx = (a["x1"] + a["x2"]) / 2 - (b["x1"] + b["x2"]) / 2
    dy = (a["y1"] + a["y2"]) / 2 - (b["y1"] + b["y2"]) / 2
    return F.sqrt(dx * dx + dy * dy)


def meets(a: Box, b: Box) -> Column:
    """Open overlap in both axes: the cheap range test before any area is computed."""
    return (a["x1"] < b["x2"]) & (b["x1"] < a["x2"]) & (a["y1"] < b["y2"]) & (b["y1"] < a["y2"])


def to_unit(b: Box, width: Column, height: Column) -> Box:
    """Fractions of the page; null where the page has no size."""
    ok = lambda v, n: F.when((width > 0) & (height > 0), v / n)
    return {"x1": ok(b["x1"], width), "y1": ok(b["y1"], height), "x2": ok(b["x2"], width), "y2": ok(b["y2"], height)}


def to_pixels(unit: Box, width: Column, height: Column) -> Box:
    """Whole pixels, rounded half to even."""
    return {c: F.bround(v * (width if c[0] == "x" else height)).cast("double") for c, v in unit.items()}


def from_source(b: Box, system: Column, dpi: Column, page_height: Column) -> Box:
    """300-DPI top-left pixels from PDF points, from pixels, or from bottom-left points given as left, bottom, right, top.

    Rounded to two places by the exact binary value; an unknown system or a missing height gives null."""
    s = dpi / F.lit(POINTS)
    flipped = {"x1": b["x1"] * s, "y1": page_height - b["y2"] * s, "x2": b["x2"] * s, "y2": page_height - b["y1"] * s}
    return {c: two_places(F.when(system == "pdf_points_topleft", v * s).when(system == "pixel_topleft", v).when(system == "docling_bottomleft", flipped[c])) for c, v in b.items()}


def two_places(c: Column) -> Column:
    """A number rounded to two places by its exact binary value, ties to even."""
    return let(c, lambda v: places(F.abs(v), 2).cast("double") * F.when(v < 0, -1.0).otherwise(1.0))


def handwriting_position(x1: Column, x2: Column, width: Column) -> Column:
    return F.when((x1 < width * 0.15) | (x2 > width * 0.85), F.lit("marginal")).otherwise(F.lit("inline"))


def as_columns(b: Box, prefix: str) -> list[Column]:
    return [v.alias(f"{prefix}{c}") for c, v in b.items()]
