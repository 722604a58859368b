"""Decomposition into regions: nearest-seed membership by tiles, exact Voronoi polygons, adjacency, quadtrees."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.store import stable
from ..sources.cells import extent, size

#: A table of seeds or queries is broadcast up to so many rows.
MOST_BROADCAST = 500_000


def numbered(seeds: DataFrame) -> DataFrame:
    """(seed_id, x, y): distinct seeds numbered from 0 in order of x, then y, by totals per x."""
    seeds = seeds.select("x", "y").distinct()
    totals = seeds.groupBy("x").agg(F.count("*").alias("n"))
    starts = totals.select("x", (F.sum("n").over(W.orderBy("x")) - F.col("n")).alias("before"))  # a row for each raster column
    return seeds.join(starts, "x").select((F.col("before") + F.row_number().over(W.partitionBy("x").orderBy("y")) - 1).alias("seed_id"), "x", "y")


def tile_side(cells: DataFrame, seeds: DataFrame) -> int:
    """A side such that tiles hold a few seeds on average."""
    width, height = size(cells)
    return max(1, math.ceil(math.sqrt(3 * max(1, width * height) / max(1, seeds.count()))))


def nearest(points: DataFrame, seeds: DataFrame, side: int, ties: bool, keys: list[str]) -> DataFrame:
    """points (keys, x, y, ...) with seed_id and d2 of the nearest seed; with ties, a row for each seed at that distance,
    else the least seed_id.

    Points meet the seeds of their own and neighbouring tiles by an equi-join; a point whose nearest seed lies no nearer
    than the ring reaches is tried again with a ring twice as wide, so sparse areas are exact too."""
    seeds = stable(seeds.select("seed_id", F.col("x").alias("sx"), F.col("y").alias("sy")))
    left, done, ring = points, None, 1
    if not seeds.take(1):
        return points.withColumn("seed_id", F.lit(None).cast("long")).withColumn("d2", F.lit(None).cast("double")).limit(0)
    rank = F.rank if ties else F.row_number
    while True:
        step = side * ring
        tiles = seeds.select("seed_id", "sx", "sy", F.explode(F.expr(f"transform(sequence(0, 8), i -> struct(floor(sx / {step}) + i % 3 - 1 AS tx, floor(sy / {step}) + i div 3 - 1 AS ty))")).alias("t")).select("seed_id", "sx", "sy", "t.tx", "t.ty")
        at = left.withColumn("tx", F.floor(F.col("x") / step)).withColumn("ty", F.floor(F.col("y") / step))
        met = at.join(tiles, ["tx", "ty"], "left").withColumn("d2", (F.col("x") - F.col("sx")).cast("double") ** 2 + (F.col("y") - F.col("sy")).cast("double") ** 2)
        order = W.partitionBy(*keys).orderBy("d2", *([] if ties else ["seed_id"]))
        best = met.withColumn("nth", rank().over(order)).where("nth = 1")
        x, y = F.col("x"), F.col("y")
        margin = F.least(x - (F.col("tx") - 1) * step, (F.col("tx") + 2) * step - x, y - (F.col("ty") - 1) * step, (F.col("ty") + 2) * step - y).cast("double")
        found = stable(best.withColumn("sure", F.coalesce(F.col("d2") < margin**2, F.lit(False))).drop("tx", "ty", "sx", "sy", "nth"))
        sure = found.where("sure").drop("sure")
        done = sure if done is None else done.unionByName(sure)
        left = found.where("NOT sure").drop("sure", "seed_id", "d2").distinct()
        if not left.take(1):
            return done
        ring *= 2


def members(cells: DataFrame, seeds: DataFrame, ties: bool = True) -> DataFrame:
    """(region_id, x, y, elevation, landcover): each cell with its nearest seed's region, tied cells in each."""
    placed = nearest(cells, seeds, tile_side(cells, seeds), ties, ["x", "y"])
    return placed.select(F.col("seed_id").alias("region_id"), "x", "y", "elevation", "landcover")


def _exact(value: float) -> int | Fraction:
    """The number itself, as one that does not round."""
    return int(value) if value == int(value) else Fraction(value)


def _meet(p: tuple, q: tuple) -> tuple:
    """Where two lines (a, b, c) of a x + b y = c cross: x, y and their common divisor."""
    return p[2] * q[1] - q[2] * p[1], p[0] * q[2] - q[0] * p[2], p[0] * q[1] - q[0] * p[1]


def _clip(polygon: list[tuple], line: tuple, tag: int) -> list[tuple]:
    """The part of a convex polygon with a x + b y <= c. An edge is (vertex where it starts, its line, its tag); signs are
    exact, so that a line which only touches a vertex leaves the polygon as it is."""
    out = []
    n = len(polygon)
    a, b, c = line
    values = [a * p[0][0] + b * p[0][1] - c * p[0][2] for p in polygon]
    if n and max(values) <= 0:
        return polygon
    for i in range(n):
        p, v, w = polygon[i], values[i], values[(i + 1) % n]
        if v <= 0:
            out.append(p)
        if v < 0 < w:
            out.append((_meet(p[1], line), line, tag))
        elif w < 0 < v:
            out.append((_meet(line, p[1]), p[1], p[2]))
        elif v == 0 and w > 0:
            out[-1] = (p[0], line, tag)
    return out


def _around(polygon: list[tuple]) -> list[tuple[float, float]]:
    """A polygon's vertices, as seen from its seed."""
    return [(p[0][0] / p[0][2], p[0][1] / p[0][2]) for p in polygon]


def _cell(seed: tuple, others: list[tuple], box: tuple[float, float, float, float]) -> list[tuple]:
    """The Voronoi cell of a seed (x, y) among others (id, x, y), sorted by distance, in a box; as seen from the seed."""
    sx, sy = map(_exact, seed)
    x0, y0, x1, y1 = map(_exact, box)
    lines = [(0, -1, sy - y0), (1, 0, x1 - sx), (0, 1, y1 - sy), (-1, 0, sx - x0)]
    polygon = [(_meet(lines[i - 1], lines[i]), lines[i], -1) for i in range(4)]
    reach = None
    for other, ox, oy in others:
        dx, dy = _exact(ox) - sx, _exact(oy) - sy
        d2 = dx * dx + dy * dy
        if reach is None:
            reach = max((x * x + y * y for x, y in _around(polygon)), default=0.0)
        if d2 > 4.000001 * reach:
            break
        cut = _clip(polygon, (2 * dx, 2 * dy, d2), int(other))
        if cut is not polygon:
            polygon, reach = cut, None
    return polygon


POLYGONS = "seed_id long, polygon array<struct<x: double, y: double>>, neighbours array<long>, is_bounded boolean"

#: What a seed's cell is so far: those that bound it, and whether no other seed can cut it.
CELLS = f"{POLYGONS}, x double, y double, around array<struct<seed_id: long, x: double, y: double>>, settled boolean"

#: Seeds that may cut a cell meet it so many at a time, nearest first; four times as many each time.
AT_ONCE = 64


def _row(seed: tuple, others: list[tuple], bounds: tuple[float, float, float, float], settled: Callable[[float], bool]) -> tuple:
    """A row of CELLS, of a seed (id, x, y) among others (id, x, y), sorted by distance; settled takes the square of the
    distance of the cell's farthest vertex."""
    polygon = _cell(seed[1:], others, bounds)
    spots = _around(polygon)
    tags = {p[2] for p in polygon if p[2] >= 0}
    far = max((x * x + y * y for x, y in spots), default=0.0)
    around = [{"seed_id": int(o[0]), "x": o[1], "y": o[2]} for o in others if o[0] in tags]
    return (seed[0], [{"x": float(seed[1] + x), "y": float(seed[2] + y)} for x, y in spots], sorted(tags), all(p[2] >= 0 for p in polygon), seed[1], seed[2], around, bool(settled(far)))


def voronoi(seeds: DataFrame, box: tuple[float, float, float, float] | None = None, side: int | None = None) -> DataFrame:
    """(seed_id, polygon, neighbours, is_bounded) of each seed: its Voronoi cell clipped to a box (by default far outside
    the seeds, so that unbounded cells are those that touch it).

    A seed meets the seeds of the tiles around it and is clipped by their bisectors, nearest first. Cells that others may
    still reach, such as those on the rim, go on: a seed cuts a cell only if it is nearer to one of its vertices than the
    cell's own, so they meet seeds only of the tiles that come near enough to a vertex, until none cuts them."""
    seeds = stable(seeds.select("seed_id", "x", "y"))
    spread = seeds.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count("*")).first()
    if not spread[4]:
        return seeds.sparkSession.createDataFrame([], POLYGONS)
    reach = 64.0 * max(1, spread[1] - spread[0], spread[3] - spread[2])
    bounds = box or (spread[0] - reach, spread[2] - reach, spread[1] + reach, spread[3] + reach)
    area = (spread[1] - spread[0] + 1) * (spread[3] - spread[2] + 1)
    step = side or max(1, math.ceil(math.sqrt(area / spread[4]) * 4))
    columns = [f.split(" ")[0] for f in CELLS.replace("struct<seed_id: long, x: double, y: double>", "").replace("struct<x: double, y: double>", "").split(", ")]

    def near(group: pd.DataFrame) -> pd.DataFrame:
        own, rows = group[group["own"]], group.loc[~group["own"], ["seed_id", "x", "y"]].to_numpy(float)
        out = []
        for seed_id, x, y in own[["seed_id", "x", "y"]].itertuples(index=False):
            d = (rows[:, 1] - x) ** 2 + (rows[:, 2] - y) ** 2
            order = np.argsort(d, kind="stable")
            tx, ty = x // step, y // step
            margin = min(x - (tx - 1) * step, (tx + 2) * step - x, y - (ty - 1) * step, (ty + 2) * step - y)
            out.append(_row((seed_id, float(x), float(y)), rows[order][d[order] > 0].tolist(), bounds, lambda far, margin=margin: 4 * far <= margin**2))
        return pd.DataFrame(out, columns=columns)

    def cut(most: int):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                out = []
                for r in frame.itertuples(index=False):
                    known = {o["seed_id"]: (o["seed_id"], o["x"], o["y"]) for o in r.around}
                    others = known | {o["seed_id"]: (o["seed_id"], o["x"], o["y"]) for o in r.others}
                    ranked = sorted(others.values(), key=lambda o: ((o[1] - r.x) ** 2 + (o[2] - r.y) ** 2, o[0]))
                    row = _row((r.seed_id, r.x, r.y), ranked, bounds, lambda far: False)
                    all_met = len(r.others) < most and set(row[2]) == set(known)
                    out.append((*row[:-1], all_met))
                yield pd.DataFrame(out, columns=columns)

        return run

    own = seeds.select("seed_id", "x", "y", F.floor(F.col("x") / step).alias("tx"), F.floor(F.col("y") / step).alias("ty"), F.lit(True).alias("own"))
    around = seeds.select("seed_id", "x", "y", F.explode(F.expr(f"transform(sequence(0, 8), i -> struct(floor(x / {step}) + i % 3 - 1 AS tx, floor(y / {step}) + i div 3 - 1 AS ty))")).alias("t")).select("seed_id", "x", "y", "t.tx", "t.ty", F.lit(False).alias("own"))
    wanted = own.select("tx", "ty").distinct()
    found = stable(own.unionByName(around.join(wanted, ["tx", "ty"], "left_semi")).groupBy("tx", "ty").applyInPandas(near, CELLS))
    done = [found.where("settled")]
    left, most = found.where("NOT settled"), 0
    wide = math.ceil(math.sqrt(area / math.sqrt(spread[4])))  # as many tiles as a tile has seeds
    placed = seeds.select("seed_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.floor(F.col("x") / wide).alias("tx"), F.floor(F.col("y") / wide).alias("ty"))
    tiles = stable(placed.groupBy("tx", "ty").agg(*[f(c).alias(f"{c}{k}") for c in "xy" for k, f in (("0", F.min), ("1", F.max))], F.min(F.struct("seed_id", "x", "y")).alias("o")))
    slack = "1e-11 * (1 + abs(v.x - x) + abs(v.y - y))"
    reaches = f"exists(polygon, v -> pow(greatest(x0 - x, least(x1 - x, v.x - x)), 2) - 2 * (v.x - x) * greatest(x0 - x, least(x1 - x, v.x - x)) + pow(greatest(y0 - y, least(y1 - y, v.y - y)), 2) - 2 * (v.y - y) * greatest(y0 - y, least(y1 - y, v.y - y)) < {slack} * (1 + abs(x0 - x) + abs(x1 - x) + abs(y0 - y) + abs(y1 - y)))"
    cuts = f"(o.x <> x OR o.y <> y) AND exists(polygon, v -> (o.x - x) * (o.x - x - 2 * (v.x - x)) + (o.y - y) * (o.y - y - 2 * (v.y - y)) < {slack} * (1 + abs(o.x - x) + abs(o.y - y)))"
    while left.take(1):
        open_ = left.select("seed_id", "x", "y", "polygon")
        met = open_.join(tiles).where(reaches)
        if most:  # the first time each tile's first seed, so that few tiles are left
            met = met.drop("o").join(placed.select("tx", "ty", F.struct("seed_id", "x", "y").alias("o")).hint("merge"), ["tx", "ty"])
        nearest_first = W.partitionBy("seed_id").orderBy((F.col("o.x") - F.col("x")) ** 2 + (F.col("o.y") - F.col("y")) ** 2, "o.seed_id")
        ranked = met.where(cuts).select("seed_id", "o", F.row_number().over(nearest_first).alias("nth"))
        lists = (ranked.where(F.col("nth") <= most) if most else ranked).groupBy("seed_id").agg(F.collect_list("o").alias("others"))
        joined = left.join(lists, "seed_id", "left").withColumn("others", F.coalesce("others", F.array().cast("array<struct<seed_id: bigint, x: double, y: double>>")))
        found = stable(joined.mapInPandas(cut(most), CELLS))
        done.append(found.where("settled"))
        left, most = found.where("NOT settled"), max(AT_ONCE, 4 * most)
    return functools.reduce(DataFrame.unionByName, done).select("seed_id", "polygon", "neighbours", "is_bounded")


def ridge_adjacency(cells_of: DataFrame, bounded: bool = True) -> DataFrame:
    """(src, dst), both directions: seeds whose Voronoi cells share an edge; unbounded cells are left out."""
    kept = cells_of.where("is_bounded") if bounded else cells_of
    pairs = kept.select(F.col("seed_id").alias("src"), F.explode("neighbours").alias("dst"))
    both = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    ids = kept.select(F.col("seed_id").alias("dst"))
    return both.join(ids, "dst", "left_semi").join(ids.withColumnRenamed("dst", "src"), "src", "left_semi")


def raster_adjacency(membership: DataFrame) -> DataFrame:
    """(src, dst), both directions: regions with side-by-side cells. Frames along rows and columns, no join; tied cells
    count for their least region."""
    one = membership.groupBy("x", "y").agg(F.min("region_id").alias("region_id"))
    right = one.select(F.col("region_id").alias("src"), F.lead("region_id").over(W.partitionBy("y").orderBy("x")).alias("dst"))
    below = one.select(F.col("region_id").alias("src"), F.lead("region_id").over(W.partitionBy("x").orderBy("y")).alias("dst"))
    pairs = right.unionByName(below).where("dst IS NOT NULL AND src <> dst").distinct()
    return pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def locate(queries: DataFrame, seeds: DataFrame, x: str, y: str, k: int = 1) -> DataFrame:
    """queries with seed_id, d2 and nth of the k nearest seeds, ties by seed_id. The seeds are grouped per query by an
    aggregate over a broadcast of the queries, whose number is checked."""
    if queries.count() > 10_000:
        raise ValueError("more than 10,000 points to locate: use nearest")
    named = queries.withColumn("q", F.struct(*queries.columns))
    d2 = ((F.col("x") - F.col(f"q.{x}")).cast("double") ** 2 + (F.col("y") - F.col(f"q.{y}")).cast("double") ** 2).alias("d2")
    pairs = seeds.select("seed_id", "x", "y").join(F.broadcast(named.select("q"))).select("q", d2, "seed_id")
    best = pairs
    for i in range(k):
        rest = pairs if i == 0 else pairs.join(F.broadcast(taken), ["q", "seed_id"], "left_anti")  # noqa: F821  k rows a query
        least = rest.groupBy("q").agg(F.min(F.struct("d2", "seed_id")).alias("m")).select("q", "m.d2", "m.seed_id", F.lit(i + 1).alias("nth"))
        best = least if i == 0 else best.unionByName(least)
        taken = best.select("q", "seed_id")  # noqa: F841
    return best.select("q.*", "seed_id", "d2", "nth")


def quadtree(cells: DataFrame, min_size: int = 1) -> DataFrame:
    """(x, y, w, h): leaves of the recursive split in four (halves rounded down, the rest right and below) until a block
    has one class or neither side is over min_size. Level by level: cells carry their block, an aggregate per block says
    whether it splits."""
    dims = F.broadcast(extent(cells))
    here = cells.crossJoin(dims).select("x", "y", "landcover", F.lit(0).alias("bx"), F.lit(0).alias("by"), F.col("width").cast("int").alias("w"), F.col("height").cast("int").alias("h"))
    done = None
    while True:
        here = stable(here)
        blocks = here.groupBy("bx", "by", "w", "h").agg((F.min("landcover") == F.max("landcover")).alias("same"))
        blocks = blocks.withColumn("leaf", F.col("same") | ((F.col("w") <= min_size) & (F.col("h") <= min_size)))
        blocks = stable(blocks)
        leaves = blocks.where("leaf").select(F.col("bx").alias("x"), F.col("by").alias("y"), "w", "h")
        done = leaves if done is None else done.unionByName(leaves)
        if not blocks.where("NOT leaf").take(1):
            return done
        split = here.join(blocks.where("NOT leaf").select("bx", "by", "w", "h").hint("merge"), ["bx", "by", "w", "h"])  # files of blocks are far smaller than their rows
        hw, hh = F.greatest(F.floor(F.col("w") / 2), F.least(F.col("w"), F.lit(1))), F.greatest(F.floor(F.col("h") / 2), F.least(F.col("h"), F.lit(1)))
        right, low = F.col("x") >= F.col("bx") + hw, F.col("y") >= F.col("by") + hh
        here = split.select("x", "y", "landcover", (F.col("bx") + F.when(right, hw).otherwise(0)).cast("int").alias("bx"), (F.col("by") + F.when(low, hh).otherwise(0)).cast("int").alias("by"), F.when(right, F.col("w") - hw).otherwise(hw).cast("int").alias("w"), F.when(low, F.col("h") - hh).otherwise(hh).cast("int").alias("h"))


def rectangle_cells(rectangles: DataFrame) -> DataFrame:
    """rectangles (x, y, w, h, ...) with px, py: a row for each of their cells."""
    rows = rectangles.withColumn("py", F.explode(F.expr("sequence(y, y + h - 1)")))
    return rows.withColumn("px", F.explode(F.expr("sequence(x, x + w - 1)")))


def describe_patches(cells: DataFrame, rectangles: DataFrame) -> DataFrame:
    """(x, y, w, h, landcover, avg_elevation): the most frequent class (least on ties) and mean elevation. A row of
    rectangles stands for many cells, so neither side is broadcast, whatever its estimated size."""
    inner = rectangle_cells(rectangles).hint("merge").join(cells.select(F.col("x").alias("px"), F.col("y").alias("py"), "elevation", "landcover"), ["px", "py"])
    return inner.groupBy("x", "y", "w", "h").agg(F.mode("landcover", True).alias("landcover"), F.avg("elevation").alias("avg_elevation"))


def rectangle_adjacency(rectangles: DataFrame, diagonal: bool = True, tile: int = 32) -> DataFrame:
    """(patch_id, other), both directions, of rectangles (patch_id, x, y, w, h) that touch; without diagonal, those that
    share a stretch of side. Both sides are dealt to the tiles they reach and met by an equi-join on tiles."""
    reach = F.expr(f"flatten(transform(sequence(floor((x - 1) / {tile}), floor((x + w) / {tile})), i -> transform(sequence(floor((y - 1) / {tile}), floor((y + h) / {tile})), j -> struct(i AS tx, j AS ty))))")
    dealt = rectangles.withColumn("t", F.explode(reach)).select("patch_id", "x", "y", "w", "h", "t.tx", "t.ty")
    other = dealt.select(F.col("patch_id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("w").alias("ow"), F.col("h").alias("oh"), "tx", "ty")
    met = dealt.hint("merge").join(other, ["tx", "ty"]).where("patch_id <> other AND x <= ox + ow AND ox <= x + w AND y <= oy + oh AND oy <= y + h")
    if not diagonal:
        met = met.where("least(x + w, ox + ow) > greatest(x, ox) OR least(y + h, oy + oh) > greatest(y, oy)")
    return met.select("patch_id", "other").distinct()


def inside_polygon(x: float, y: float, polygon: list[tuple[float, float]], radius: float = 0.71) -> bool:
    """Whether a point lies in a convex or simple polygon or within radius of it; one vertex is a disc, two or collinear
    ones a line."""
    n = len(polygon)
    if n == 0:
        return False
    least, within = math.inf, False
    for i in range(n):
        (ax, ay), (bx, by) = polygon[i], polygon[(i + 1) % n]
        dx, dy = bx - ax, by - ay
        s = 0.0 if dx == dy == 0 else min(1.0, max(0.0, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy)))
        least = min(least, math.hypot(x - ax - s * dx, y - ay - s * dy))
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            within = not within
    return within or least <= radius


def collinear(polygon: Column) -> Column:
    """Whether the first three vertices of an array<struct<x, y>> lie on a line; fewer do."""
    a, b, c = (F.get(polygon, i) for i in range(3))
    return (F.size(polygon) < 3) | (F.abs((b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])) <= 1e-8)


def polygon_cells(polygons: DataFrame, key: str, radius: float = 0.71) -> DataFrame:
    """(key, x, y): the cells whose centres lie in or within radius of each polygon."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k, polygon in zip(frame[key], frame["polygon"], strict=True):
                points = [(p["x"], p["y"]) for p in polygon]
                if points:
                    xs, ys = [p[0] for p in points], [p[1] for p in points]
                    found = [(k, x, y) for y in range(math.floor(min(ys) - radius), math.ceil(max(ys) + radius) + 1) for x in range(math.floor(min(xs) - radius), math.ceil(max(xs) + radius) + 1) if inside_polygon(x, y, points, radius)]
                    yield pd.DataFrame(found, columns=[key, "x", "y"])

    return polygons.select(key, "polygon").mapInPandas(run, f"{key} long, x int, y int")
