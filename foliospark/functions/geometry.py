"""Box geometry as column arithmetic. A box is four double columns named by prefix: x0, y0, x1, y1."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F


def _num(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


@dataclass(frozen=True)
class Box:
    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @staticmethod
    def of(prefix: str = "") -> Box:
        return Box(*(F.col(f"{prefix}{k}") for k in ("x0", "y0", "x1", "y1")))

    def cols(self, prefix: str = "") -> list[Column]:
        return [getattr(self, k).alias(f"{prefix}{k}") for k in ("x0", "y0", "x1", "y1")]

    @property
    def width(self) -> Column:
        return self.x1 - self.x0

    @property
    def height(self) -> Column:
        return self.y1 - self.y0

    @property
    def area(self) -> Column:
        return self.width * self.height

    @property
    def center_x(self) -> Column:
        return (self.x0 + self.x1) / 2

    @property
    def center_y(self) -> Column:
        return (self.y0 + self.y1) / 2


def poly_validate(polygon: Column) -> Column:
    """Four corners of two numbers; no corner 2 or 3 above the first, none of 1 or 2 left of the first corner's x."""
    y, x = F.transform(polygon, lambda p: p[1]), F.transform(polygon, lambda p: p[0])
    shape = (F.size(polygon) == 4) & F.forall(polygon, lambda p: F.size(p) == 2)
    placed = (F.get(y, F.lit(2)) >= F.array_min(y)) & (F.get(y, F.lit(3)) >= F.array_min(y)) & (F.get(x, F.lit(1)) >= F.array_min(x)) & (F.get(x, F.lit(2)) >= F.array_min(x))
    return F.coalesce(shape & placed, F.lit(False))


def poly_bbox(polygon: Column) -> Box:
    x, y = F.transform(polygon, lambda p: p[0]), F.transform(polygon, lambda p: p[1])
    return Box(F.array_min(x), F.array_min(y), F.array_max(x), F.array_max(y))


def bbox_from(b: Box) -> Box:
    """At least one unit wide and high."""
    return Box(b.x0, b.y0, F.greatest(b.x1, b.x0 + 1), F.greatest(b.y1, b.y0 + 1))


def bbox_expand(b: Box, x_margin, y_margin) -> Box:
    """Margins are fractions of width and height, on both sides."""
    dx, dy = b.width * _num(x_margin), b.height * _num(y_margin)
    return Box(b.x0 - dx, b.y0 - dy, b.x1 + dx, b.y1 + dy)


def bbox_expand_y(b: Box, margin, side: str) -> Box:
    dy = b.height * _num(margin)
    return Box(b.x0, b.y0 - dy, b.x1, b.y1) if side == "top" else Box(b.x0, b.y0, b.x1, b.y1 + dy)


def overlap_x(a: Box, b: Box) -> Column:
    return F.greatest(F.lit(0.0), F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0))


def overlap_y(a: Box, b: Box) -> Column:
    return F.greatest(F.lit(0.0), F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0))


def intersection_area(a: Box, b: Box) -> Column:
    return overlap_x(a, b) * overlap_y(a, b)


def intersection_pct(a: Box, b: Box) -> Column:
    return F.when(a.area == 0, F.lit(0.0)).otherwise(intersection_area(a, b) / a.area)


def bbox_gap(a: Box, b: Box) -> Column:
    """0 where the boxes overlap, the corner distance where b lies diagonally, else the gap on one axis."""
    left, right, above, below = b.x1 < a.x0, a.x1 < b.x0, b.y1 < a.y0, a.y1 < b.y0
    gx = F.when(left, a.x0 - b.x1).when(right, b.x0 - a.x1).otherwise(F.lit(0.0))
    gy = F.when(above, a.y0 - b.y1).when(below, b.y0 - a.y1).otherwise(F.lit(0.0))
    return F.when(intersection_pct(a, b) > 0, F.lit(0.0)).when((left | right) & (above | below), F.sqrt(gx * gx + gy * gy)).when(left | right, gx).when(above | below, gy).otherwise(F.lit(0.0))


def center_distance(a: Box, b: Box, x_weight=1.0, y_weight=1.0, absolute: bool = False) -> Column:
    dx, dy = b.center_x - a.center_x, b.center_y - a.center_y
    if absolute:
        return F.abs(dx) * _num(x_weight) + F.abs(dy) * _num(y_weight)
    return F.sqrt(dx * dx * _num(x_weight) + dy * dy * _num(y_weight))


def tl_distance(a: Box, b: Box) -> Column:
    return F.sqrt((b.x0 - a.x0) * (b.x0 - a.x0) + (b.y0 - a.y0) * (b.y0 - a.y0))


def bbox_rescale(b: Box, old: tuple, new: tuple) -> Box:
    sx, sy = _num(new[0]) / _num(old[0]), _num(new[1]) / _num(old[1])
    return Box(b.x0 * sx, b.y0 * sy, b.x1 * sx, b.y1 * sy)


def bbox_clip(b: Box, bounds: Box) -> Box:
    x = lambda v: F.least(F.greatest(v, bounds.x0), bounds.x1)
    y = lambda v: F.least(F.greatest(v, bounds.y0), bounds.y1)
    return Box(x(b.x0), y(b.y0), x(b.x1), y(b.y1))


def bbox_union_agg(b: Box) -> list[Column]:
    """Aggregates of the outer box."""
    return [F.min(b.x0).alias("x0"), F.min(b.y0).alias("y0"), F.max(b.x1).alias("x1"), F.max(b.y1).alias("y1")]


def bbox_norm1000(b: Box, width: Column, height: Column) -> Column:
    """JSON of the coordinates in thousandths of the page."""
    part = lambda v, size: F.floor(v * 1000 / size).cast("long")
    return F.to_json(F.struct(part(b.x0, width).alias("x0"), part(b.y0, height).alias("y0"), part(b.x1, width).alias("x1"), part(b.y1, height).alias("y1")))


def block_ref(page_id: Column, block_type: Column, block_id: Column) -> Column:
    """/page/p/Type/b; the page alone where type or block is null."""
    page = F.concat(F.lit("/page/"), page_id.cast("string"))
    return F.when(block_type.isNull() | block_id.isNull(), page).otherwise(F.concat(page, F.lit("/"), block_type, F.lit("/"), block_id.cast("string")))


def parse_block_ref(ref: Column) -> list[Column]:
    part = lambda i: F.nullif(F.get(F.split(ref, "/"), F.lit(i)), F.lit(""))
    return [part(2).cast("int").alias("page_id"), part(3).alias("block_type"), part(4).cast("int").alias("block_id")]


def to_path(ref: Column) -> Column:
    return F.replace(ref, F.lit("/"), F.lit("_"))


def orientation(width: Column, height: Column) -> Column:
    return F.when(width > height, "landscape").otherwise("portrait")


# The notes area of a drawing as fractions (left, right, top, bottom).
NOTES_AREA = {"landscape": (0.62, 0.92, 0.09, 0.53), "portrait": (0.08, 0.73, 0.05, 0.40)}


def notes_crop(width: Column, height: Column) -> list[Column]:
    """Left, top, right, bottom of the notes area in whole pixels."""
    def edge(i: int, size: Column) -> Column:
        share = F.when(width > height, NOTES_AREA["landscape"][i]).otherwise(NOTES_AREA["portrait"][i])
        return (size * share).cast("int")

    return [edge(0, width).alias("left"), edge(2, height).alias("top"), edge(1, width).alias("right"), edge(3, height).alias("bottom")]


def fit_max_pixels(width: Column, height: Column, most: int = 1200) -> list[Column]:
    """Unchanged when both sides fit, else scaled down to fit, at least one pixel."""
    scale = F.least(F.lit(float(most)) / width, F.lit(float(most)) / height)
    fit = (width <= most) & (height <= most)
    size = lambda v: F.when(fit, v.cast("int")).otherwise(F.greatest(F.lit(1), (v * scale).cast("int")))
    return [size(width).alias("fit_width"), size(height).alias("fit_height")]
