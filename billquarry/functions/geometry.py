"""Boxes as four numbers; pixels or page fractions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def normalised_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> list[Column]:
    return [
        F.round(clamp01(x1 / width), 6).alias("nx1"),
        F.round(clamp01(y1 / height), 6).alias("ny1"),
        F.round(clamp01(x2 / width), 6).alias("nx2"),
        F.round(clamp01(y2 / height), 6).alias("ny2"),
        F.round(F.greatest(F.lit(0.0), x2 - x1), 2).alias("box_width"),
        F.round(F.greatest(F.lit(0.0), y2 - y1), 2).alias("box_height"),
        F.round(x1 + (x2 - x1) / 2, 2).alias("center_x"),
        F.round(y1 + (y2 - y1) / 2, 2).alias("center_y"),
    ]


def valid_box(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Four finite values, positive size, inside the page up to a thousandth."""
    finite = F.lit(True)
    for value in (x, y, w, h):
        finite = finite & value.isNotNull() & ~F.isnan(value)
    return F.coalesce(
        finite & (x >= 0) & (y >= 0) & (w > 0) & (h > 0) & (x + w <= 1.001) & (y + h <= 1.001), F.lit(False)
    )
