"""Neighbourhood operators on cells. Rectangular windows are separable: a frame along each row, then along each column, so
a window of any size costs two shuffles of the cells and no explosion. Edges are the frame's own (inside), or the raster
is padded with mirrored or repeated border strips first."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.store import stable
from ..sources.cells import extent


def row() -> WindowSpec:
    """A raster row in order."""
    return W.partitionBy("y").orderBy("x")


def column() -> WindowSpec:
    """A raster column in order."""
    return W.partitionBy("x").orderBy("y")



def padded(cells: DataFrame, radius: int, mode: str) -> DataFrame:
    """cells with radius more rows and columns on each side: `reflect` (c b a | a b c) or `clamp` (a a a | a b c)."""
    dims = F.broadcast(extent(cells))

    def strip(df: DataFrame, axis: str, length: str) -> DataFrame:
        sized = df.crossJoin(dims)
        v = F.col(axis)
        if mode == "reflect":
            low, high = F.when(v < radius, -v - 1), F.when(v >= F.col(length) - radius, 2 * F.col(length) - 1 - v)
            copies = F.array(v, low, high)
        else:
            before, after = F.sequence(F.lit(-radius), F.lit(-1)), F.sequence(F.col(length), F.col(length) + radius - 1)
            none = F.array().cast("array<int>")
            copies = F.concat(F.array(v), F.when(v == 0, before).otherwise(none), F.when(v == F.col(length) - 1, after).otherwise(none))
        return sized.withColumn(axis, F.explode(F.array_compact(copies))).withColumn(axis, F.col(axis).cast("int")).drop("width", "height")

    return strip(strip(cells, "x", "width"), "y", "height")


def inside(df: DataFrame, cells: DataFrame) -> DataFrame:
    """The rows of a padded raster that are cells."""
    return df.crossJoin(F.broadcast(extent(cells))).where("x >= 0 AND y >= 0 AND x < width AND y < height").drop("width", "height")


def box(df: DataFrame, value: Column, radius: int, along: Callable[[Column], Column], name: str) -> DataFrame:
    """Adds name: `along` (an aggregate) of value over the square of radius around each cell, by rows, then columns."""
    rows = df.withColumn(name, along(value).over(row().rowsBetween(-radius, radius)))
    return rows.withColumn(name, along(F.col(name)).over(column().rowsBetween(-radius, radius)))


def boundary_mask(cells: DataFrame, label: str = "landcover") -> DataFrame:
    """cells with is_boundary: a cell in the 8-neighbourhood has another label."""
    low = box(cells, F.col(label), 1, F.min, "low")
    return box(low, F.col(label), 1, F.max, "high").withColumn("is_boundary", (F.col("low") != F.col("high")).cast("int")).drop("low", "high")


def boundary_mask4(cells: DataFrame, label: str = "landcover") -> DataFrame:
    """cells with is_boundary4: a cell above, below, left or right has another label."""
    differs = [F.coalesce(step(label).over(w) != F.col(label), F.lit(False)) for w in (row(), column()) for step in (F.lag, F.lead)]
    return cells.withColumn("across", differs[0] | differs[1]).withColumn("is_boundary4", (F.col("across") | differs[2] | differs[3]).cast("int")).drop("across")


def elevation_bin(bins: int, per: list[str] | None = None) -> Column:
    """Which of equal bins between least and greatest elevation (of each `per` group) holds a cell, upper edges
    included; the least falls in bin 0, as do all cells of a flat group."""
    w = W.partitionBy(*(per or []))
    low, high, v = F.min("elevation").over(w), F.max("elevation").over(w), F.col("elevation")
    return F.when((v == low) | (high == low), 0).otherwise(F.ceil((v - low) * bins / F.nullif((high - low).cast("double"), F.lit(0.0)))).cast("int")


def elevation_bins(cells: DataFrame, bins: int = 5) -> DataFrame:
    """cells with elev_bin over the whole raster; its range is one broadcast row."""
    dims = cells.agg(F.min("elevation").alias("low"), F.max("elevation").alias("high"))
    v, low, high = F.col("elevation"), F.col("low"), F.col("high")
    of = F.when((v == low) | (high == low), 0).otherwise(F.ceil((v - low) * bins / F.nullif((high - low).cast("double"), F.lit(0.0)))).cast("int")
    return cells.crossJoin(F.broadcast(dims)).withColumn("elev_bin", of).drop("low", "high")


def mixed_boundary(cells: DataFrame, bins: int = 5) -> DataFrame:
    """boundary_mask of the label landcover * (bins + 1) + elevation bin."""
    return boundary_mask(elevation_bins(cells, bins).withColumn("mixed", F.col("landcover") * (bins + 1) + F.col("elev_bin")), "mixed")


def local_std(cells: DataFrame, size: int = 5, truncate: bool = True) -> DataFrame:
    """cells with local_std: the population standard deviation of elevation over a square, mirrored at edges. truncate
    gives whole numbers, as on integer rasters."""
    z = F.col("elevation").cast("double")
    wide = padded(cells.select("x", "y", "elevation"), size // 2, "reflect")
    sums = box(box(wide, z, size // 2, F.sum, "s1"), z * z, size // 2, F.sum, "s2")
    n = float(size * size)
    std = F.round(F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / n - (F.col("s1") / n) ** 2)), 6)
    value = F.floor(std).cast("double") if truncate else std
    return cells.join(inside(sums, cells).select("x", "y", value.alias("local_std")), ["x", "y"])


def local_entropy(cells: DataFrame, size: int = 3, label: str = "landcover") -> DataFrame:
    """cells with entropy (base 2) of the labels in a square, edges repeated. The square's labels are gathered as one
    array per cell; each adds log2 of how often its label occurs there."""
    r = size // 2
    wide = padded(cells.select("x", "y", F.col(label).alias("label")), r, "clamp")
    rows = wide.withColumn("labels", F.collect_list("label").over(row().rowsBetween(-r, r)))
    square = inside(rows.withColumn("labels", F.flatten(F.collect_list("labels").over(column().rowsBetween(-r, r)))), cells)
    n = float(size * size)
    logs = F.aggregate(F.array_distinct("labels"), F.lit(0.0), lambda s, v: s + F.size(F.filter("labels", lambda u: u == v)) * F.log2(F.size(F.filter("labels", lambda u: u == v)).cast("double")))
    return cells.join(square.select("x", "y", F.round(F.log2(F.lit(n)) - logs / n, 9).alias("entropy")), ["x", "y"])


def sobel(cells: DataFrame) -> DataFrame:
    """cells with gradient: the Sobel magnitude of elevation, mirrored at edges."""
    z = F.col("elevation").cast("double")

    def side(step, value: Column, w) -> Column:
        return F.coalesce(step(value).over(w), value)

    rows = cells.withColumn("smooth", side(F.lag, z, row()) + 2 * z + side(F.lead, z, row())).withColumn("across", side(F.lead, z, row()) - side(F.lag, z, row()))
    s, a = F.col("smooth"), F.col("across")
    gy = side(F.lead, s, column()) - side(F.lag, s, column())
    gx = side(F.lag, a, column()) + 2 * a + side(F.lead, a, column())
    return rows.withColumn("gradient", F.sqrt(gx**2 + gy**2)).drop("smooth", "across")


def distance_transform(marked: DataFrame, mark: str = "is_boundary") -> DataFrame:
    """marked with edt: Euclidean distance to the nearest marked cell, null if none is. Per column the nearest mark above
    and below by frames, then per row the lower envelope of parabolas."""
    at = F.when(F.col(mark) == 1, F.col("y"))
    above = F.last(at, True).over(column().rowsBetween(W.unboundedPreceding, 0))
    below = F.first(at, True).over(column().rowsBetween(0, W.unboundedFollowing))
    near = F.least(F.col("y") - above, below - F.col("y"))
    columns = marked.select("x", "y", near.cast("double").alias("g"))

    def envelope(line: pd.DataFrame) -> pd.DataFrame:
        line = line.sort_values("x")
        x, g = line["x"].to_numpy(), line["g"].to_numpy() ** 2
        sites = np.flatnonzero(~np.isnan(g))
        if not len(sites):
            return line.assign(edt=np.nan)[["x", "y", "edt"]]
        hull: list[int] = []
        starts: list[float] = []
        for q in sites.tolist():
            s = -np.inf
            while hull:
                p = hull[-1]
                s = (g[q] + x[q] ** 2 - g[p] - x[p] ** 2) / (2.0 * (x[q] - x[p]))
                if s > starts[-1]:
                    break
                hull.pop()
                starts.pop()
                s = -np.inf
            hull.append(q)
            starts.append(s)
        own = np.array(hull)[np.searchsorted(np.array(starts), x, side="right") - 1]
        return line.assign(edt=np.sqrt((x - x[own]) ** 2 + g[own]))[["x", "y", "edt"]]

    distances = columns.groupBy("y").applyInPandas(envelope, "x int, y int, edt double")
    return marked.join(distances.withColumn("edt", F.nanvl("edt", F.lit(None).cast("double"))), ["x", "y"])


def sides(cells: DataFrame) -> DataFrame:
    """cells with is_inner and is_outer: next to (or at) an interior boundary cell of the same, of another class."""
    marked = boundary_mask(cells)
    core = marked.crossJoin(F.broadcast(extent(cells))).where("is_boundary = 1 AND x > 0 AND y > 0 AND x < width - 1 AND y < height - 1")
    around = core.select(F.explode(F.expr("transform(sequence(0, 8), i -> struct(x + i % 3 - 1 AS x, y + i div 3 - 1 AS y))")).alias("p"), F.col("landcover").alias("label")).select(F.col("p.x").cast("int").alias("x"), F.col("p.y").cast("int").alias("y"), "label").distinct()
    met = around.join(cells, ["x", "y"]).groupBy("x", "y").agg(F.max((F.col("label") == F.col("landcover")).cast("int")).alias("is_inner"), F.max((F.col("label") != F.col("landcover")).cast("int")).alias("is_outer"))
    return cells.join(met, ["x", "y"], "left").fillna(0, ["is_inner", "is_outer"])


def dilate(points: DataFrame, size: int) -> DataFrame:
    """(x, y) of the cells in squares of `size` (odd) around points."""
    r = size // 2
    return points.select(F.explode(F.sequence(F.col("x") - r, F.col("x") + r)).alias("x"), "y").distinct().select("x", F.explode(F.sequence(F.col("y") - r, F.col("y") + r)).alias("y")).distinct()


def components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, root): the least node that each node of links (a, b) reaches, by alternating large and small stars; rounds
    grow with the logarithm of the longest chain."""
    links = stable(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(most_rounds):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        small = large.groupBy("b").agg(F.min("a").alias("m"))
        links = stable(large.join(small, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a <> b").distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return links.select(F.col("b").alias("node"), F.col("a").alias("root"))
        seen = now
    raise RuntimeError("components did not settle")


def flat_components(cells: DataFrame, flat: str = "is_flat") -> DataFrame:
    """(x, y, landcover, component): 8-connected components of flat cells of one class, named by their first cell in
    row-major order (y * 2^31 + x). Only runs of cells along rows are linked, not cells."""
    chosen = cells.where(F.col(flat)).select("x", "y", "landcover")
    start = F.col("x") - F.row_number().over(W.partitionBy("y", "landcover").orderBy("x"))
    runs = chosen.withColumn("start", start)
    runs = runs.withColumn("run", F.min("x").over(W.partitionBy("y", "landcover", "start"))).withColumn("node", F.col("y").cast("long") * (1 << 31) + F.col("run")).drop("start", "run")
    below = runs.select((F.col("y") + 1).alias("y"), F.explode(F.array(F.col("x") - 1, F.col("x"), F.col("x") + 1)).alias("x"), "landcover", F.col("node").alias("upper"))
    links = runs.join(below, ["x", "y", "landcover"]).select(F.col("upper").alias("a"), F.col("node").alias("b")).distinct()
    roots = components(links)
    return runs.join(roots, "node", "left").select("x", "y", "landcover", F.coalesce("root", "node").alias("component"))


def percentile(df: DataFrame, column: str, share: float) -> DataFrame:
    """One row: the exact percentile, interpolated."""
    return df.agg(F.percentile(column, F.lit(share)).alias("threshold"))


def flat_cells(cells: DataFrame, share: float = 0.25) -> DataFrame:
    """cells with is_flat: local_std up to its percentile."""
    return cells.crossJoin(F.broadcast(percentile(cells, "local_std", share))).withColumn("is_flat", F.col("local_std") <= F.col("threshold")).drop("threshold")


def blob_centroids(cells: DataFrame) -> DataFrame:
    """(x, y, landcover, component): rounded centroids (half to even) of the flat components."""
    return flat_components(cells).groupBy("landcover", "component").agg(F.rint(F.avg("x")).cast("int").alias("x"), F.rint(F.avg("y")).cast("int").alias("y"))
