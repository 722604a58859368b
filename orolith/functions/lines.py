"""Raster lines as expressions: pixels of a segment in order, without a Python loop."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def line_pixels(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """array<struct<seq, x, y>> of the integer line from (x0, y0) to (x1, y1).

    The longer axis advances by one pixel; the other stands at floor((2 i s + l) / (2 l)) after i of l steps of a slope
    s / l, so ties go forward and the way back may use other pixels."""
    dx, dy = F.abs(x1 - x0), F.abs(y1 - y0)
    longer, shorter = F.greatest(dx, dy), F.least(dx, dy)

    def pixel(i: Column) -> Column:
        minor = F.when(longer == 0, F.lit(0)).otherwise(F.floor((2 * i * shorter + longer) / F.greatest(2 * longer, F.lit(1)))).cast("int")
        steep = dy > dx
        return F.struct(i.cast("int").alias("seq"), (x0 + F.signum(x1 - x0).cast("int") * F.when(steep, minor).otherwise(i)).cast("int").alias("x"), (y0 + F.signum(y1 - y0).cast("int") * F.when(steep, i).otherwise(minor)).cast("int").alias("y"))

    return F.transform(F.sequence(F.lit(0), longer.cast("int")), pixel)


def sight_pixels(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """array<struct<seq, x, y>> of the points a line of sight is tested at: as many as the longer axis has steps (one at
    least), evenly from start to end and truncated towards zero; the end only counts from two points on."""
    n = F.greatest(F.abs(x1 - x0), F.abs(y1 - y0), F.lit(1)).cast("int")

    def point(i: Column) -> Column:
        along = lambda a, b: F.when(n == 1, a.cast("double")).when(i == n - 1, b.cast("double")).otherwise(a + i * (b - a).cast("double") / F.greatest(n - 1, F.lit(1))).cast("int")
        return F.struct(i.cast("int").alias("seq"), along(x0, x1).alias("x"), along(y0, y1).alias("y"))

    return F.transform(F.sequence(F.lit(0), n - 1), point)
