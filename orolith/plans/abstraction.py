"""Whole plans: build a region graph, answer path queries, evaluate a decomposition, compare decompositions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.store import stable
from ..operators import fitting, graph, regions, sampling
from ..sources.cells import extent, size


@dataclass(frozen=True)
class Settings:
    """What a build takes; alpha is 0 for flat areas, 1 for boundaries."""

    budget: int = 1000
    alpha: float = 0.5
    min_area: int = 2
    elevation_bins: int = 5
    tolerance: float = 10.0
    max_planes: int | None = None
    model: str = "vehicle"
    decomposition: str = "hybrid"
    seed: int = 0


@dataclass
class Abstraction:
    """Stage tables of a build; nodes keep bounded regions only."""

    cells: DataFrame
    seeds: DataFrame
    polygons: DataFrame
    membership: DataFrame
    patches: DataFrame
    nodes: DataFrame
    edges: DataFrame


def choose_seeds(cells: DataFrame, settings: Settings) -> DataFrame:
    if settings.decomposition in ("hybrid", "unified"):
        sampler = sampling.SAMPLERS[settings.decomposition]
        return sampler(cells, settings.budget, settings.alpha, settings.elevation_bins, settings.min_area, settings.seed)
    return sampling.SAMPLERS[settings.decomposition](cells, settings.budget)


def without_gaps(membership: DataFrame) -> DataFrame:
    """Regions without missing elevation or class."""
    bad = membership.where("elevation IS NULL OR isnan(CAST(elevation AS DOUBLE)) OR landcover IS NULL").select("region_id").distinct()
    return membership.join(bad, "region_id", "left_anti")


def build(cells: DataFrame, settings: Settings = Settings()) -> Abstraction:  # noqa: B008
    """Seeds, Voronoi regions, plane patches, attributes and priced edges of a raster."""
    seeds = stable(regions.numbered(choose_seeds(cells, settings)))
    polygons = stable(regions.voronoi(seeds))
    kept = polygons.where("is_bounded").select(F.col("seed_id").alias("region_id"))
    membership = stable(without_gaps(regions.members(cells, seeds).join(kept, "region_id", "left_semi")))
    patches = fitting.fit_patches(membership, settings.tolerance, most=settings.max_planes)
    nodes = stable(fitting.region_attributes(membership).join(fitting.grade_direction(fitting.plane_moments(membership)).select("region_id", "grade", "direction"), "region_id"))
    live = nodes.select(F.col("region_id").alias("seed_id"))
    adjacency = regions.ridge_adjacency(polygons.join(live, "seed_id", "left_semi"))
    priced = graph.edges(adjacency, seeds.join(live, "seed_id", "left_semi"), cells, settings.model)
    return Abstraction(cells, seeds, polygons, membership, stable(patches), nodes, stable(priced))


def locate_queries(queries: DataFrame, seeds: DataFrame) -> DataFrame:
    """queries with src and dst: the nearest of the given (retained) seeds to start and goal."""
    start = regions.locate(queries, seeds, "sx", "sy").select("query_id", F.col("seed_id").alias("src"))
    goal = regions.locate(queries, seeds, "gx", "gy").select("query_id", F.col("seed_id").alias("dst"))
    return queries.join(start, "query_id").join(goal, "query_id")


def answer(edges: DataFrame, seeds: DataFrame, queries: DataFrame, k: int = 1, every: int = 10, rise: float | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(routes, points, report) of queries (query_id, sx, sy, gx, gy)."""
    found = stable(graph.routes(edges, locate_queries(queries, seeds), k, every, rise))
    points = stable(graph.path_points(found, queries, seeds))
    return found, points, graph.report(found, points, queries)


def retained(abstraction: Abstraction) -> DataFrame:
    return abstraction.seeds.join(abstraction.nodes.select(F.col("region_id").alias("seed_id")), "seed_id", "left_semi")


def evaluate(abstraction: Abstraction, fill: int = 0) -> DataFrame:
    """One row: reconstruction quality over all cells of the raster (uncovered cells count as class fill)."""
    rebuilt = stable(fitting.reconstruct(abstraction.membership, abstraction.patches))
    painted = rebuilt.groupBy("x", "y").agg(F.max_by(F.struct("z_fit", "landcover_fit"), "region_id").alias("v"))
    every = abstraction.cells.join(painted, ["x", "y"], "left").select("x", "y", "elevation", "landcover", F.col("v.z_fit").alias("z_fit"), F.col("v.landcover_fit").alias("landcover_fit"))
    r = F.col("elevation") - F.col("z_fit")
    quality = every.agg(F.sqrt(F.avg(r * r)).alias("elevation_rmse"), (100.0 * F.count("z_fit") / F.count("*")).alias("coverage"))
    return quality.crossJoin(fitting.accuracy(every, fill).select("accuracy")).crossJoin(fitting.mean_iou(every, fill)).crossJoin(abstraction.nodes.agg(F.count("*").alias("region_count"))).crossJoin(abstraction.patches.agg(F.count("*").alias("plane_count")))


def quadtree_graph(cells: DataFrame, min_size: int = 2, model: str = "vehicle", diagonal: bool = True) -> tuple[DataFrame, DataFrame]:
    """(patches, edges) of the quadtree: patches with ids in row-major order and floored centres as seeds."""
    from pyspark.sql import Window as W

    leaves = stable(regions.describe_patches(cells, regions.quadtree(cells, min_size)))
    rows = leaves.groupBy("y").agg(F.count("*").alias("n"))
    starts = rows.select("y", (F.sum("n").over(W.orderBy("y")) - F.col("n")).alias("before"))  # a row for each raster row
    patches = stable(leaves.join(starts, "y").withColumn("patch_id", F.col("before") + F.row_number().over(W.partitionBy("y").orderBy("x")) - 1).drop("before"))
    centre: list[Column] = [F.col("patch_id").alias("seed_id"), F.floor((2 * F.col("x") + F.col("w") - 1) / 2).cast("int").alias("x"), F.floor((2 * F.col("y") + F.col("h") - 1) / 2).cast("int").alias("y")]
    adjacency = regions.rectangle_adjacency(patches, diagonal).select(F.col("patch_id").alias("src"), F.col("other").alias("dst"))
    return patches, stable(graph.edges(adjacency, patches.select(*centre), cells, model))


def compare(cells: DataFrame, queries: DataFrame, decompositions: list[str], budgets: list[int], smooth: bool = False) -> DataFrame:
    """Reports of the queries for each decomposition and seed budget, raw and, if asked, smoothed."""
    out = None
    for decomposition in decompositions:
        for budget in budgets:
            built = build(cells, Settings(budget=budget, decomposition=decomposition))
            found, points, reported = answer(built.edges, retained(built), queries)
            rows = reported.withColumn("smoothed", F.lit(False))
            if smooth:
                cut = stable(graph.smooth(points, cells))
                rows = rows.unionByName(graph.report(found, cut, queries).withColumn("smoothed", F.lit(True)))
            rows = rows.withColumn("decomposition", F.lit(decomposition)).withColumn("budget", F.lit(budget)).crossJoin(F.broadcast(built.nodes.agg(F.count("*").alias("region_count"))))
            out = rows if out is None else out.unionByName(rows)
    return out


def sample_queries(cells: DataFrame) -> DataFrame:
    """Ten legs over six points in proportion to the raster."""
    from ..sources.cells import path_queries

    width, height = size(cells)
    points = [(width * a // 10, height * b // 10) for a, b in ((1, 1), (8, 2), (3, 6), (8, 8), (1, 8), (5, 5))]
    return path_queries(cells.sparkSession, points)


__all__ = ["Abstraction", "Settings", "answer", "build", "compare", "evaluate", "extent", "quadtree_graph", "retained", "sample_queries"]
