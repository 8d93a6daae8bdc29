"""Geometry as column expressions: all of it stays inside generated code or array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def corners(cx="cx", cy="cy", w="w", h="h") -> dict[str, Column]:
    """x1, y1, x2, y2 of a centre box; a box without geometry is all zero."""
    cx, cy, w, h = (F.coalesce(F.col(c), F.lit(0.0)) for c in (cx, cy, w, h))
    return {"x1": cx - w / 2, "y1": cy - h / 2, "x2": cx + w / 2, "y2": cy + h / 2}


def to_centre(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> dict[str, Column]:
    """Pixel corners to a normalised centre box."""
    return {"cx": (x1 + x2) / 2 / width, "cy": (y1 + y2) / 2 / height, "w": (x2 - x1) / width, "h": (y2 - y1) / height}


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union of two corner boxes; 0 where the union is empty."""
    width = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    height = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    inter = width * height
    union = (a["x2"] - a["x1"]) * (a["y2"] - a["y1"]) + (b["x2"] - b["x1"]) * (b["y2"] - b["y1"]) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def may_overlap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """False only where ``iou`` is 0: a short test before it, inside lambdas, which are interpreted."""
    return (b["x2"] - a["x1"] > 0) & (a["x2"] - b["x1"] > 0) & (b["y2"] - a["y1"] > 0) & (a["y2"] - b["y1"] > 0)


def box_of(prefix_or_struct) -> dict[str, Column]:
    """Corners named ``<prefix>x1`` and so on, or fields of a struct column."""
    if isinstance(prefix_or_struct, Column):
        return {k: prefix_or_struct[k] for k in ("x1", "y1", "x2", "y2")}
    return {k: F.col(f"{prefix_or_struct}{k}") for k in ("x1", "y1", "x2", "y2")}


def polygon_box(polygon: Column | str) -> dict[str, Column]:
    """Centre box around a polygon (array of x, y); null for none."""
    p = F.col(polygon) if isinstance(polygon, str) else polygon
    x, y = F.transform(p, lambda q: q["x"]), F.transform(p, lambda q: q["y"])
    return {"cx": (F.array_min(x) + F.array_max(x)) / 2, "cy": (F.array_min(y) + F.array_max(y)) / 2, "w": F.array_max(x) - F.array_min(x), "h": F.array_max(y) - F.array_min(y)}


def polygon_area(polygon: Column | str) -> Column:
    """Shoelace area; fewer than three points have none."""
    p = F.col(polygon) if isinstance(polygon, str) else polygon
    rolled = F.concat(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 1, 1))
    cross = F.zip_with(p, rolled, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.when(F.size(p) < 3, F.lit(0.0)).otherwise(F.abs(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v)) / 2)


def polygon_crosses_itself(polygon: Column | str) -> Column:
    """Whether two edges that do not touch in the ring cross strictly."""
    p = F.col(polygon) if isinstance(polygon, str) else polygon
    n = F.size(p)
    at = lambda i: F.get(p, i % n)
    turn = lambda a, b, c: F.signum((b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"]))

    def crosses(i: Column, j: Column) -> Column:
        a, b, c, d = at(i), at(i + 1), at(j), at(j + 1)
        return (turn(a, b, c) * turn(a, b, d) < 0) & (turn(c, d, a) * turn(c, d, b) < 0)

    apart = lambda i, j: (j > i + 1) & ~((i == 0) & (j == n - 1))
    edges = F.sequence(F.lit(0), n - 1)
    return F.when(n < 4, F.lit(False)).otherwise(F.exists(edges, lambda i: F.exists(edges, lambda j: apart(i, j) & crosses(i, j))))


def pixel_points(polygon: Column | str, width: Column, height: Column) -> Column:
    p = F.col(polygon) if isinstance(polygon, str) else polygon
    return F.transform(p, lambda q: F.struct((q["x"] * width).alias("x"), (q["y"] * height).alias("y")))


def circle(cx: Column, cy: Column, ex: Column, ey: Column, count: int = 24) -> Column:
    """Polygon of ``count`` points around a centre through an edge point."""
    radius = F.hypot(ex - cx, ey - cy)
    angle = lambda k: 2 * F.pi() * k / count
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.struct((cx + radius * F.cos(angle(k))).alias("x"), (cy + radius * F.sin(angle(k))).alias("y")))


#: Sides in pixels below whose squares a box is small or medium.
SMALL_SIDE, MEDIUM_SIDE = 32, 96


def size_bucket(w: Column, h: Column, width: Column, height: Column) -> Column:
    """small, medium or large by pixel area; null where the image size is unknown."""
    area = w * width * h * height
    known = (width > 0) & (height > 0)
    return F.when(known & (area < SMALL_SIDE**2), "small").when(known & (area < MEDIUM_SIDE**2), "medium").when(known, "large")


def pixel_box(width: Column, height: Column) -> dict[str, Column]:
    """Integer pixel corners of x1..y2: half-even rounding, inside the image, one pixel at least."""
    side = lambda c, most: F.least(F.greatest(F.bround(c), F.lit(0)), most)
    x1, y1 = F.least(side(F.col("x1") * width, width), width - 1), F.least(side(F.col("y1") * height, height), height - 1)
    return {"px1": x1.cast("int"), "py1": y1.cast("int"), "px2": F.greatest(side(F.col("x2") * width, width), x1 + 1).cast("int"), "py2": F.greatest(side(F.col("y2") * height, height), y1 + 1).cast("int")}


def letterbox(width: Column, height: Column, to_width, to_height) -> dict[str, Column]:
    """Scale and offsets of an image that is fitted into a canvas with its aspect kept."""
    scale = F.least(F.lit(to_width) / width, F.lit(to_height) / height)
    new_w, new_h = F.greatest(F.lit(1), F.bround(width * scale)), F.greatest(F.lit(1), F.bround(height * scale))
    return {"sx": new_w / to_width, "sy": new_h / to_height, "ox": F.floor((F.lit(to_width) - new_w) / 2) / to_width, "oy": F.floor((F.lit(to_height) - new_h) / 2) / to_height}
