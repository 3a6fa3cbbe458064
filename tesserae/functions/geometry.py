"""Column functions over boxes [x0, y0, x1, y1] in points, and over vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Signed area that a usable box has at least.
MIN_AREA = 50.0


def _at(box: Column, k: int) -> Column:
    return F.get(box, F.lit(k))


def is_valid(box: Column) -> Column:
    """Four numbers and a signed area of MIN_AREA or more; null counts as no box."""
    area = (_at(box, 2) - _at(box, 0)) * (_at(box, 3) - _at(box, 1))
    return F.coalesce((F.size(box) == 4) & (area >= F.lit(MIN_AREA)), F.lit(False))


def is_placed(box: Column) -> Column:
    """Whether a box is neither empty nor all zeros."""
    return F.coalesce((F.size(box) > 0) & F.exists(box, lambda x: x != 0), F.lit(False))


def valid_boxes(boxes: Column) -> Column:
    return F.filter(boxes, is_valid)


def _hull(boxes: Column) -> Column:
    side = lambda k: F.transform(boxes, lambda b: F.get(b, F.lit(k)))
    return F.array(F.array_min(side(0)), F.array_min(side(1)), F.array_max(side(2)), F.array_max(side(3)))


def union_boxes(a: Column, b: Column) -> Column:
    """One box around the valid boxes of both lists; with none valid a, or b where a is empty."""
    good = valid_boxes(F.concat(a, b))
    return F.when(F.size(good) > 0, F.array(_hull(good))).otherwise(F.when(F.size(a) > 0, a).otherwise(b))


def hull_of_placed(boxes: Column) -> Column:
    """The box around all boxes that are neither empty nor all zeros; zeros if there are none."""
    good = F.filter(boxes, is_placed)
    return F.when(F.size(good) > 0, _hull(good)).otherwise(F.array(*[F.lit(0.0)] * 4))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union, 0 for boxes apart or without area."""
    width = F.least(_at(a, 2), _at(b, 2)) - F.greatest(_at(a, 0), _at(b, 0))
    height = F.least(_at(a, 3), _at(b, 3)) - F.greatest(_at(a, 1), _at(b, 1))
    shared = F.greatest(width, F.lit(0.0)) * F.greatest(height, F.lit(0.0))
    area = lambda x: (_at(x, 2) - _at(x, 0)) * (_at(x, 3) - _at(x, 1))
    whole = area(a) + area(b) - shared
    return F.when(whole > 0, F.coalesce(F.try_divide(shared, whole), F.lit(0.0))).otherwise(0.0)


def scaled(box: Column, dpi: float = 150.0, base: float = 72.0) -> Column:
    """A box in the pixels of a page drawn at dpi."""
    return F.transform(box, lambda x: x * F.lit(float(dpi)) / F.lit(float(base)))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """v at length one; a zero vector stays zero."""
    n = norm(v)
    return F.transform(v, lambda x: F.coalesce(F.try_divide(x.cast("double"), n), F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, 0 if either is zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))
