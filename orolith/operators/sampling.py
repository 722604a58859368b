"""Seed samplers: content-aware choices of cells, as sorts, limits, distincts and a greedy selection in rounds."""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.store import stable
from ..sources.cells import size
from . import stencil


def grid_seeds(cells: DataFrame, count: int) -> DataFrame:
    """(x, y): a square grid of about count seeds."""
    width, height = size(cells)
    step = max(1, round(math.sqrt(width * height / count)))
    return cells.where((F.col("x") % step == 0) & (F.col("y") % step == 0)).select("x", "y")


def hex_seeds(spark: SparkSession, width: int, height: int, count: int) -> DataFrame:
    """(x, y): a hexagonal grid of about count seeds, odd rows half a step on, rounded half to even."""
    step = math.sqrt(2 / (math.sqrt(3) * (count / (width * height))))
    rise = step * math.sqrt(3) / 2
    rows = spark.range(math.ceil(height / rise)).select(F.col("id").alias("row"), (F.col("id") * rise).alias("fy"))
    spots = rows.select("fy", F.explode(F.sequence(F.lit(0), F.lit(math.ceil(width / step)))).alias("k"), ((F.col("row") % 2) * step / 2).alias("shift"))
    placed = spots.select((F.col("shift") + F.col("k") * step).alias("fx"), "fy").where((F.col("fx") < width) & (F.col("fy") < height))
    return placed.select(F.rint("fx").cast("int").alias("x"), F.rint("fy").cast("int").alias("y")).where((F.col("x") < width) & (F.col("y") < height)).distinct()


def strided(points: DataFrame, count: int) -> DataFrame:
    """Every (n div count)-th of n points in row-major order; may give more than count. Places are counted row by row
    from totals per raster row, so no task sorts all points."""
    totals = points.groupBy("y").agg(F.count("*").alias("n"))
    starts = totals.select("y", (F.sum("n").over(W.orderBy("y")) - F.col("n")).alias("before"), F.greatest(F.lit(1), F.floor(F.sum("n").over(W.partitionBy()) / count)).alias("step"))  # a row for each raster row
    ranked = points.withColumn("nth", F.row_number().over(W.partitionBy("y").orderBy("x"))).join(starts, "y")
    return ranked.where((F.col("before") + F.col("nth") - 1) % F.col("step") == 0).select("x", "y")


def boundary_stride(cells: DataFrame, count: int) -> DataFrame:
    """Boundary cells, strided."""
    return strided(stencil.boundary_mask(cells).where("is_boundary = 1").select("x", "y"), count)


def mixed_stride(cells: DataFrame, count: int, bins: int = 5) -> DataFrame:
    """Cells on boundaries of class and elevation bin together, strided."""
    return strided(stencil.mixed_boundary(cells, bins).where("is_boundary = 1").select("x", "y"), count)


def entropy_top(cells: DataFrame, count: int, window: int = 3) -> DataFrame:
    """(x, y, entropy): boundary cells of highest local entropy, ties in row-major order."""
    marked = stencil.boundary_mask(stencil.local_entropy(cells, window)).where("is_boundary = 1")
    return marked.orderBy(F.desc("entropy"), "y", "x").limit(count).select("x", "y", "entropy")


def boundary_scores(cells: DataFrame, lam: float = 0.5, window: int = 3) -> DataFrame:
    """(x, y, score) of the 8-connected boundary: lam * entropy + (1 - lam) * (1 - distance to the 4-connected boundary
    over its greatest anywhere), rounded to 9 places."""
    marked = stencil.distance_transform(stencil.boundary_mask4(stencil.boundary_mask(cells)), "is_boundary4")
    scored = stencil.local_entropy(marked, window).crossJoin(F.broadcast(marked.agg(F.max("edt").alias("most"))))
    near = 1 - F.coalesce(F.col("edt") / F.nullif("most", F.lit(0.0)), F.lit(0.0))
    return scored.where("is_boundary = 1").select("x", "y", F.round(lam * F.col("entropy") + (1 - lam) * near, 9).alias("score"))


def score_top(cells: DataFrame, count: int, lam: float = 0.5, window: int = 3) -> DataFrame:
    """(x, y, score): the best boundary cells, ties by x, then y, descending."""
    return boundary_scores(cells, lam, window).orderBy(F.desc("score"), F.desc("x"), F.desc("y")).limit(count)


def draw(seed: int = 0) -> Column:
    """A fixed scattered order of cells, the same in any engine; equal draws are told apart by place."""
    return F.pmod(F.col("x").cast("long") * 73856093 + F.col("y").cast("long") * 19349663 + F.lit(seed * 83492791).cast("long"), F.lit(1000003).cast("long"))


def refill(cells: DataFrame, used: DataFrame, count: int, bins: int = 5, seed: int = 0) -> DataFrame:
    """(x, y): count unused cells on boundaries of elevation bins within classes, larger classes first (then by class),
    bins 1 and up in order, in fixed random order within a bin."""
    areas = cells.groupBy("landcover").agg(F.count("*").alias("area"), F.min("elevation").alias("low"), F.max("elevation").alias("high"))
    v = F.col("elevation")
    of = F.when((v == F.col("low")) | (F.col("high") == F.col("low")), 0).otherwise(F.ceil((v - F.col("low")) * bins / F.nullif((F.col("high") - F.col("low")).cast("double"), F.lit(0.0)))).cast("int")
    binned = cells.join(F.broadcast(areas), "landcover").withColumn("bin", of)  # a row for each class
    marked = stencil.boundary_mask(binned.withColumn("both", F.col("landcover") * (bins + 1) + F.col("bin")), "both").where("is_boundary = 1 AND bin >= 1")
    return marked.join(used.select("x", "y"), ["x", "y"], "left_anti").orderBy(F.desc("area"), "landcover", "bin", draw(seed), "y", "x").limit(count).select("x", "y")


def boundary_sampler(cells: DataFrame, count: int, bins: int = 5, seed: int = 0) -> DataFrame:
    """(x, y): the best boundary cells if there are more than count, else all of them and a refill."""
    coarse = stable(stencil.boundary_mask(cells).where("is_boundary = 1").select("x", "y"))
    n = coarse.count()
    if n > count:
        return score_top(cells, count).select("x", "y")
    return coarse.unionByName(refill(cells, coarse, count - n, bins, seed)) if n < count else coarse


#: Sides of the tiles in which cells are chosen one after the other.
TILE = 256
#: The best cells are found by a sort of up to so many.
MOST_BEST = 100_000


def spaced(ranked: DataFrame, radius: int, metric: str = "chebyshev", most_rounds: int = 10_000, count: int | None = None) -> DataFrame:
    """(x, y, rank): greedy choice in the order of rank (unique, not null) such that no two chosen cells lie within radius.
    With count, those beyond the first count may be missing: a chosen cell keeps off others of its square only, so the
    best count squares' worth of cells hold the first count of the choice.

    Rounds of tiles: a tile's cells are taken or left in order, as long as it holds all that bears on them; a cell that
    hangs on one beyond the rim waits. The tiles of the next round lie across the rims of this one's. This gives the same
    set as the sequential choice; rounds grow with the tiles that a chain of ranks crosses, not with its cells."""
    square = (2 * radius + 1) ** 2
    if count is not None and count * square <= MOST_BEST:
        ranked = ranked.orderBy("rank").limit(count * square)
    parts = [f.name for f in ranked.schema["rank"].dataType.fields] if isinstance(ranked.schema["rank"].dataType, T.StructType) else []
    keys = [F.col(f"rank.{p}").alias(f"r{i}") for i, p in enumerate(parts)] if parts else [F.col("rank").alias("r0")]
    names = [f"r{i}" for i in range(len(keys))]
    rank = F.struct(*[F.col(n).alias(p) for n, p in zip(names, parts, strict=True)]) if parts else F.col("r0")
    left = stable(ranked.select("x", "y", *keys, F.lit(0).alias("state")))
    schema = T.StructType(left.schema.fields)
    offsets = np.arange(-radius, radius + 1)
    disc = np.add.outer(offsets**2, offsets**2) <= radius * radius if metric == "euclidean" else np.ones((2 * radius + 1,) * 2, bool)

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        """state: 0 waits, 1 taken; cells that are not to be taken go."""
        x0, y0 = int(group["x"].min()) - radius, int(group["y"].min()) - radius
        group = group.iloc[np.lexsort([group[n].to_numpy() for n in reversed(names)])]
        x, y, own, state = (group["x"].to_numpy() - x0).tolist(), (group["y"].to_numpy() - y0).tolist(), group["own"].tolist(), group["state"].to_numpy().copy()
        blocked, unsure = (np.zeros((max(y) + radius + 1, max(x) + radius + 1), bool) for _ in range(2))

        def near(i: int) -> tuple[slice, slice]:
            return slice(y[i] - radius, y[i] + radius + 1), slice(x[i] - radius, x[i] + radius + 1)

        for i in np.flatnonzero(state == 1).tolist():
            blocked[near(i)] |= disc
        keep = np.zeros(len(x), bool)
        for i in np.flatnonzero(state == 0).tolist():
            if blocked[y[i], x[i]]:
                continue
            if own[i] and not unsure[y[i], x[i]]:
                blocked[near(i)] |= disc
                state[i] = 1
            else:
                unsure[near(i)] |= disc
            keep[i] = own[i]
        return group.assign(state=state)[keep][["x", "y", *names, "state"]]

    taken: list[DataFrame] = []
    side = max(TILE, 4 * radius)
    for turn in range(most_rounds):
        shift = turn % 2 * (side // 2)
        waiting = left.where("state = 0")
        if not waiting.take(1):
            return functools.reduce(DataFrame.unionByName, [t.select("x", "y", rank.alias("rank")) for t in taken]) if taken else ranked.select("x", "y", "rank")
        at = lambda c, d: F.floor((F.col(c) + shift + d) / side)
        reach = [F.array_distinct(F.array(at(c, -radius), at(c, 0), at(c, radius))) for c in "xy"]
        dealt = left.withColumn("tx", F.explode(reach[0])).withColumn("ty", F.explode(reach[1])).withColumn("own", (F.col("tx") == at("x", 0)) & (F.col("ty") == at("y", 0)))
        if turn:  # taken cells matter to those that wait
            dealt = dealt.join(waiting.select(at("x", 0).alias("tx"), at("y", 0).alias("ty")).distinct(), ["tx", "ty"], "left_semi")
        left = stable(dealt.groupBy("tx", "ty").applyInPandas(choose, schema))
        taken.append(left.where("state = 1"))
    raise RuntimeError("spacing did not settle")


def flat_first(cells: DataFrame, count: int, radius: int, seed: int = 0) -> DataFrame:
    """(x, y, rank): cells in order of local_std, spaced by radius, at most count. Ties in a fixed random order."""
    order = F.struct(F.col("local_std"), draw(seed).alias("h"), F.col("y"), F.col("x"))
    return spaced(cells.withColumn("rank", order), radius, count=count).orderBy("rank").limit(count)


def flat_sampler(cells: DataFrame, count: int, radius: int, seed: int = 0) -> DataFrame:
    """(x, y, step, nth): spaced flat cells, then centroids of flat blobs, then flat boundary cells, up to count."""
    measured = stable(stencil.local_std(cells))
    first = stable(flat_first(measured, count, radius, seed).select("x", "y", F.lit(1).alias("step"), F.col("rank.local_std").alias("k1"), F.col("rank.h").cast("double").alias("k2")))
    need = count - first.count()
    if need <= 0:
        return first.select("x", "y", "step")
    blobs = stencil.blob_centroids(stencil.flat_cells(measured)).groupBy("x", "y").agg(F.min(F.struct("landcover", "component")).alias("o"))
    second = stable(blobs.join(first, ["x", "y"], "left_anti").orderBy("o").limit(need).select("x", "y", F.lit(2).alias("step")))
    need -= second.count()
    chosen = first.select("x", "y", "step").unionByName(second)
    if need <= 0:
        return chosen
    edge = stencil.boundary_mask(measured).where("is_boundary = 1").join(chosen, ["x", "y"], "left_anti")
    return chosen.unionByName(edge.orderBy("local_std", "y", "x").limit(need).select("x", "y", F.lit(3).alias("step")))


def hybrid(cells: DataFrame, count: int, alpha: float = 0.5, bins: int = 5, radius: int = 10, seed: int = 0) -> DataFrame:
    """(x, y): flat seeds and boundary seeds by alpha (1: boundary only), distinct, topped up from the boundary once."""
    if alpha == 1:
        return boundary_sampler(cells, count, bins, seed).distinct()
    n_flat = count - int(count * alpha)
    flat = stable(flat_sampler(cells, n_flat, radius, seed).select("x", "y").limit(count))
    need = count - flat.count()
    if need <= 0:
        return flat
    both = stable(flat.unionByName(boundary_sampler(cells, need, bins, seed).limit(need)).distinct())
    short = count - both.count()
    return both.unionByName(boundary_sampler(cells, short, bins, seed)).distinct() if short > 0 else both


def unified(cells: DataFrame, count: int, alpha: float = 0.5, bins: int = 5, radius: int = 10, seed: int = 0) -> DataFrame:
    """(x, y): rounded quotas with one shared set of used cells: round(alpha * count) boundary cells first, flat after."""
    n_edge = round(alpha * count)
    edge = stable(boundary_sampler(cells, n_edge, bins, seed).limit(n_edge)) if n_edge else cells.select("x", "y").limit(0)
    flat = flat_sampler(cells, count, radius, seed).select("x", "y").join(edge, ["x", "y"], "left_anti")
    return edge.unionByName(flat.limit(count - n_edge))


def inner_outer(cells: DataFrame, count: int, bins: int = 5, stride: int = 2) -> DataFrame:
    """(x, y): cells on either side of boundaries, on a grid of stride, in elevation bins 1 and up, every n-th of them."""
    marked = stencil.elevation_bins(stencil.sides(cells), bins)
    chosen = marked.where(f"(is_inner = 1 OR is_outer = 1) AND x % {stride} = 0 AND y % {stride} = 0 AND elev_bin >= 1")
    return strided(chosen.select("x", "y"), count)


def flat_fill(cells: DataFrame, count: int, radius: int, threshold: float, seed: int = 0) -> DataFrame:
    """(x, y): cells of gradient below threshold in random order, spaced by a Euclidean radius, at most count."""
    chosen = stencil.sobel(cells).where(F.col("gradient") < threshold)
    return spaced(chosen.withColumn("rank", F.struct(draw(seed).alias("h"), F.col("y"), F.col("x"))), radius, "euclidean", count=count).orderBy("rank").limit(count).select("x", "y")


def ratio(cells: DataFrame, count: int, share: float = 0.5, radius: int = 4, threshold: float = 10.0) -> DataFrame:
    """(x, y, kind): strided boundary cells and spaced fill cells in a given share."""
    n = int(count * share)
    return boundary_stride(cells, n).withColumn("kind", F.lit("boundary")).unionByName(flat_fill(cells, count - n, radius, threshold).withColumn("kind", F.lit("fill")))


def score_spaced(cells: DataFrame, count: int, radius: int) -> DataFrame:
    """(x, y): boundary cells in order of score, spaced by radius throughout."""
    ranked = boundary_scores(cells).withColumn("rank", F.struct((-F.col("score")).alias("s"), (-F.col("x")).alias("a"), (-F.col("y")).alias("b")))
    return spaced(ranked, radius, "euclidean", count=count).orderBy("rank").limit(count).select("x", "y")


def peaks(cells: DataFrame, count: int, radius: int) -> DataFrame:
    """(x, y): cells farthest from boundaries first, spaced by radius."""
    far = stencil.distance_transform(stencil.boundary_mask(cells)).where("edt IS NOT NULL")
    return spaced(far.withColumn("rank", F.struct((-F.round("edt", 9)).alias("d"), draw().alias("h"), F.col("y"), F.col("x"))), radius, count=count).orderBy("rank").limit(count).select("x", "y")


#: Samplers by name, each (cells, count) -> (x, y).
SAMPLERS = {
    "grid": grid_seeds,
    "hex": lambda cells, count: hex_seeds(cells.sparkSession, *size(cells), count),
    "boundary": boundary_stride,
    "mixed": mixed_stride,
    "entropy": lambda cells, count: entropy_top(cells, count).select("x", "y"),
    "score": lambda cells, count: score_top(cells, count).select("x", "y"),
    "bins": boundary_sampler,
    "hybrid": hybrid,
    "unified": unified,
    "inner_outer": inner_outer,
    "fill": lambda cells, count: flat_fill(cells, count, 4, 10.0),
    "ratio": lambda cells, count: ratio(cells, count).select("x", "y").distinct(),
    "flat": lambda cells, count: flat_sampler(cells, count, 10).select("x", "y"),
    "spaced": lambda cells, count: score_spaced(cells, count, 2),
    "peaks": lambda cells, count: peaks(cells, count, 4),
}
