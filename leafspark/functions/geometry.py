"""Boxes and page frames, column to column. A box is x0, y0, x1, y1; a page box has a rotation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Page sizes in points.
A4, LETTER = (595.28, 841.89), (612.0, 792.0)


def quarter_turns(degrees: Column) -> Column:
    """To the nearest multiple of 90, from 0 to 270."""
    return F.pmod(F.floor(degrees / 90 + 0.5) * 90, F.lit(360)).cast("int")


def rounded(x: Column) -> Column:
    """To the nearest whole number, halves upwards."""
    return F.floor(x + 0.5)


def overlap(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """The area that two boxes share."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def intersects(a: tuple[Column, ...], b: tuple[Column, ...], eps: float = 0.0) -> Column:
    """More than touching by ``eps``."""
    return (a[0] < b[2] - eps) & (b[0] < a[2] - eps) & (a[1] < b[3] - eps) & (b[1] < a[3] - eps)


def contains(outer: tuple[Column, ...], inner: tuple[Column, ...], eps: float = 0.5) -> Column:
    return (inner[0] >= outer[0] - eps) & (inner[1] >= outer[1] - eps) & (inner[2] <= outer[2] + eps) & (inner[3] <= outer[3] + eps)


def area(box: tuple[Column, ...]) -> Column:
    return F.greatest(box[2] - box[0], F.lit(0.0)) * F.greatest(box[3] - box[1], F.lit(0.0))


def display_size(box: tuple[Column, ...], rotation: Column) -> tuple[Column, Column]:
    w, h = box[2] - box[0], box[3] - box[1]
    turned = rotation.isin(90, 270)
    return F.when(turned, h).otherwise(w), F.when(turned, w).otherwise(h)


def to_page(x: Column, y: Column, box: tuple[Column, ...], rotation: Column) -> tuple[Column, Column]:
    """A point of the display (from the top left, down) in the page's frame (from the bottom left, up)."""
    x0, y0, x1, y1 = box
    px = F.when(rotation == 90, x0 + y).when(rotation == 180, x1 - x).when(rotation == 270, x1 - y).otherwise(x0 + x)
    py = F.when(rotation == 90, y0 + x).when(rotation == 180, y0 + y).when(rotation == 270, y1 - x).otherwise(y1 - y)
    return px, py


def to_display(px: Column, py: Column, box: tuple[Column, ...], rotation: Column) -> tuple[Column, Column]:
    """The inverse of ``to_page``."""
    x0, y0, x1, y1 = box
    x = F.when(rotation == 90, py - y0).when(rotation == 180, x1 - px).when(rotation == 270, y1 - py).otherwise(px - x0)
    y = F.when(rotation == 90, px - x0).when(rotation == 180, py - y0).when(rotation == 270, x1 - px).otherwise(y1 - py)
    return x, y


def fit(width: Column, height: Column, to_width: Column, to_height: Column) -> Column:
    """The scale that fits one size into another, in proportion."""
    return F.least(to_width / width, to_height / height)


def render_scale(width: Column, height: Column, wanted: Column, edge: float = 8192.0, pixels: float = 16777216.0) -> Column:
    """A scale held within the longest edge and the area of a bitmap."""
    return F.least(wanted, F.lit(edge) / F.greatest(width, height), F.sqrt(F.lit(pixels) / (width * height)))


def luma(r: Column, g: Column, b: Column) -> Column:
    """BT.601, to the nearest whole number."""
    return F.least(rounded(0.299 * r + 0.587 * g + 0.114 * b), F.lit(255)).cast("int")


def visible_box(crop: tuple, media: tuple) -> tuple:
    """What of the crop box the media box holds, or the media box if nothing; corners may be in any order."""
    sides = lambda b: (F.least(b[0], b[2]), F.least(b[1], b[3]), F.greatest(b[0], b[2]), F.greatest(b[1], b[3]))
    c, m = sides(crop), sides(media)
    both = (F.greatest(c[0], m[0]), F.greatest(c[1], m[1]), F.least(c[2], m[2]), F.least(c[3], m[3]))
    some = (both[2] > both[0]) & (both[3] > both[1])
    return tuple(F.when(some, x).otherwise(y) for x, y in zip(both, m, strict=True))


def rotation_bucket(degrees: Column) -> Column:
    """To the nearest five degrees, 0 to 355."""
    return F.pmod(rounded(degrees / 5).cast("int") * 5, F.lit(360))


def is_override(degrees: Column) -> Column:
    """Whether an angle may stand for a measured skew: 45 degrees at most, either way."""
    return F.coalesce(F.abs(degrees) <= 45, F.lit(False))
