"""Registered queries of the terrain operators over the derived raster, with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import costs
from .functions.lines import line_pixels
from .functions.store import stable
from .operators import fitting, graph, regions, sampling, stencil
from .plans import abstraction as plans
from .sources import cells as sources

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: Tables that many oracles share; each is a CTE, taken with those it needs.
CTES = {
    "cells": sources.CELLS,
    "dims": "SELECT max(x) + 1 AS w, max(y) + 1 AS h FROM cells",
    "nine": "SELECT dx, dy FROM (SELECT unnest(range(-1, 2)) AS dx), (SELECT unnest(range(-1, 2)) AS dy)",
    "edge": "SELECT a.x, a.y, max(CASE WHEN b.landcover <> a.landcover THEN 1 ELSE 0 END) AS is_boundary FROM cells a, nine n, cells b WHERE b.x = a.x + n.dx AND b.y = a.y + n.dy GROUP BY a.x, a.y",
    "edge4": "SELECT a.x, a.y, max(CASE WHEN b.landcover <> a.landcover THEN 1 ELSE 0 END) AS is_boundary4 FROM cells a, nine n, cells b WHERE abs(n.dx) + abs(n.dy) <= 1 AND b.x = a.x + n.dx AND b.y = a.y + n.dy GROUP BY a.x, a.y",
    "bins": "SELECT x, y, landcover, CAST(CASE WHEN elevation = lo THEN 0 ELSE ceil((elevation - lo) * 5.0 / (hi - lo)) END AS INT) AS elev_bin FROM cells, (SELECT min(elevation) AS lo, max(elevation) AS hi FROM cells)",
    "wide": "SELECT unnest(range(-2, 3)) AS d",
    "std5": """SELECT a.x, a.y, CAST(floor(round(sqrt(greatest(0, avg(CAST(b.elevation AS DOUBLE) * b.elevation) - avg(b.elevation) * avg(b.elevation))), 6)) AS DOUBLE) AS local_std
        FROM cells a, dims, wide p, wide q, cells b
        WHERE b.x = CASE WHEN a.x + p.d < 0 THEN -a.x - p.d - 1 WHEN a.x + p.d >= w THEN 2 * w - 1 - a.x - p.d ELSE a.x + p.d END
          AND b.y = CASE WHEN a.y + q.d < 0 THEN -a.y - q.d - 1 WHEN a.y + q.d >= h THEN 2 * h - 1 - a.y - q.d ELSE a.y + q.d END
        GROUP BY a.x, a.y""",
    "entropy": """SELECT x, y, round(sum(-n / 9.0 * log2(n / 9.0)), 9) AS entropy FROM (
          SELECT a.x, a.y, b.landcover, count(*) AS n FROM cells a, dims, nine o, cells b
          WHERE b.x = least(greatest(a.x + o.dx, 0), w - 1) AND b.y = least(greatest(a.y + o.dy, 0), h - 1) GROUP BY a.x, a.y, b.landcover) GROUP BY x, y""",
    "edt4": "SELECT a.x, a.y, sqrt(min((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS edt FROM cells a, (SELECT x, y FROM edge4 WHERE is_boundary4 = 1) b GROUP BY a.x, a.y",
    "score": "SELECT x, y, round(0.5 * entropy + 0.5 * (1 - edt / (SELECT max(edt) FROM edt4)), 9) AS score FROM edge JOIN entropy USING (x, y) JOIN edt4 USING (x, y) WHERE is_boundary = 1",
    "gradient": """SELECT a.x, a.y, sqrt(pow(sum(CAST(b.elevation AS DOUBLE) * o.dx * (2 - abs(o.dy))), 2) + pow(sum(CAST(b.elevation AS DOUBLE) * o.dy * (2 - abs(o.dx))), 2)) AS gradient
        FROM cells a, dims, nine o, cells b WHERE b.x = least(greatest(a.x + o.dx, 0), w - 1) AND b.y = least(greatest(a.y + o.dy, 0), h - 1) GROUP BY a.x, a.y""",
    "seeds": "SELECT row_number() OVER (ORDER BY x, y) - 1 AS seed_id, x, y FROM cells WHERE x % 10 = 0 AND y % 10 = 0",
    "tied": "SELECT seed_id AS region_id, x, y, elevation, landcover FROM (SELECT c.*, s.seed_id, rank() OVER (PARTITION BY c.x, c.y ORDER BY (c.x - s.x) ** 2 + (c.y - s.y) ** 2) AS r FROM cells c, seeds s WHERE abs(c.x - s.x) <= 10 AND abs(c.y - s.y) <= 10) WHERE r = 1",
    "members": "SELECT min(region_id) AS region_id, x, y, elevation, landcover FROM tied GROUP BY x, y, elevation, landcover",
    "adjacent": """SELECT DISTINCT src, dst FROM (SELECT a.region_id AS src, b.region_id AS dst FROM members a, members b WHERE abs(a.x - b.x) + abs(a.y - b.y) = 1
        AND b.x IN (a.x - 1, a.x, a.x + 1) AND b.y IN (a.y - 1, a.y, a.y + 1)) WHERE src <> dst""",
    "planes": """SELECT region_id, regr_count(z, x) AS n, CASE WHEN det > 1e-9 THEN (cyy * cxz - cxy * cyz) / det ELSE 0 END AS a1, CASE WHEN det > 1e-9 THEN (cxx * cyz - cxy * cxz) / det ELSE 0 END AS b1 FROM (SELECT 1)""",
    "material": "SELECT * FROM (VALUES " + ", ".join(f"({i}, {m!r}, {r!r}, {costs.TERRAIN[i - 1] if 1 <= i <= 18 else 'NULL'})" for i, (m, r) in enumerate(zip(costs.FRICTION, costs.ROUGHNESS, strict=True))) + ") t(landcover, mu, rough, tf)",
    "east": "SELECT a.x, a.y, CAST(a.elevation AS DOUBLE) AS z1, CAST(b.elevation AS DOUBLE) AS z2, 30.0 AS d, 0.0 AS heading, mu, rough, tf FROM cells a JOIN cells b ON b.x = a.x + 1 AND b.y = a.y JOIN material m ON m.landcover = a.landcover",
    "fit": """SELECT region_id, n, a1 / 30 AS a, b1 / 30 AS b, (sz - a1 * sx - b1 * sy) / n AS d, sqrt(greatest(0, czz - a1 * cxz - b1 * cyz) / n) AS rmse FROM (
        SELECT *, CASE WHEN det > 1e-9 THEN (cyy * cxz - cxy * cyz) / det WHEN cxx + cyy > 0 THEN cxz / (cxx + cyy) ELSE 0 END AS a1, CASE WHEN det > 1e-9 THEN (cxx * cyz - cxy * cxz) / det WHEN cxx + cyy > 0 THEN cyz / (cxx + cyy) ELSE 0 END AS b1 FROM (
        SELECT *, cxx * cyy - cxy * cxy AS det FROM (
        SELECT region_id, CAST(count(*) AS DOUBLE) AS n, CAST(sum(x) AS DOUBLE) AS sx, CAST(sum(y) AS DOUBLE) AS sy, CAST(sum(elevation) AS DOUBLE) AS sz, regr_sxx(y, x) AS cxx, regr_sxx(x, y) AS cyy, regr_sxy(y, x) AS cxy,
          regr_sxy(elevation, x) AS cxz, regr_sxy(elevation, y) AS cyz, regr_syy(elevation, x) AS czz FROM tied GROUP BY region_id)))""",
    "modes": "SELECT region_id, landcover FROM (SELECT region_id, landcover, row_number() OVER (PARTITION BY region_id ORDER BY count(*) DESC, landcover) AS r FROM tied GROUP BY region_id, landcover) WHERE r = 1",
    "rebuilt": "SELECT m.*, -(f.a * m.x * 30 + f.b * m.y * 30 + f.d) / -1.0 AS z_fit, k.landcover AS landcover_fit FROM members m JOIN fit f USING (region_id) JOIN modes k USING (region_id)",
    "trips": """SELECT query_id, sx, sy, gx, gy FROM (SELECT i - 1 AS query_id, px AS sx, py AS sy, lead(px) OVER (ORDER BY i) AS gx, lead(py) OVER (ORDER BY i) AS gy FROM (
        SELECT i, w * a // 10 AS px, h * b // 10 AS py FROM dims, (VALUES (1, 1, 1), (2, 8, 2), (3, 3, 6), (4, 8, 8), (5, 1, 8), (6, 5, 5), (7, 1, 8), (8, 8, 8), (9, 3, 6), (10, 8, 2), (11, 1, 1)) t(i, a, b))) WHERE gx IS NOT NULL""",
    "rook": "SELECT a.seed_id AS src, b.seed_id AS dst, a.x AS x0, a.y AS y0, sign(b.x - a.x) AS ux, sign(b.y - a.y) AS uy FROM seeds a, seeds b WHERE abs(a.x - b.x) + abs(a.y - b.y) = 10",
    "walk": """SELECT src, dst, CAST(p.elevation AS DOUBLE) AS z1, CAST(q.elevation AS DOUBLE) AS z2, 30.0 AS d, (degrees(atan2(uy, ux)) + 360) % 360 AS heading, mu, rough, tf FROM rook, (SELECT unnest(range(0, 10)) AS i) s, cells p, cells q, material m
        WHERE p.x = x0 + i * ux AND p.y = y0 + i * uy AND q.x = p.x + ux AND q.y = p.y + uy AND m.landcover = p.landcover""",
}
del CTES["planes"]

VEHICLE = """CASE WHEN mu <= 0 OR rough <= 0 THEN CAST('Infinity' AS DOUBLE) WHEN abs(100 * (z2 - z1) / d) > 35 THEN 1e6 ELSE
  CASE WHEN z2 > z1 THEN (exp(5 * abs((z2 - z1) / d) / mu) - 1) / 10 ELSE 0 END + (1 / mu - 1) / 2 + d + 0.1 * rough
  + 1 - cos(radians(least(abs(heading - (degrees(atan2(z2 - z1, d)) + 360) % 360), 360 - abs(heading - (degrees(atan2(z2 - z1, d)) + 360) % 360)))) END"""
CTES["edges"] = f"SELECT src, dst, sum({VEHICLE}) AS weight FROM walk GROUP BY src, dst"
CTES["ends"] = """SELECT query_id, arg_min(s.seed_id, (s.x - sx) ** 2 + (s.y - sy) ** 2 + s.seed_id * 1e-7) AS src, arg_min(s.seed_id, (s.x - gx) ** 2 + (s.y - gy) ** 2 + s.seed_id * 1e-7) AS dst FROM trips, seeds s GROUP BY query_id"""


def with_ctes(body: str) -> str:
    """body after the CTEs that it names, directly or through others, in order of need."""
    import re

    need: dict[str, None] = {}

    def visit(text: str) -> None:
        for name in CTES:
            if re.search(rf"\b(?:FROM|JOIN|,)\s*\(?\s*{name}\b", text) and name not in need:
                visit(CTES[name])
                need.setdefault(name)

    visit(body)
    head = ", ".join(f"{n} AS ({CTES[n]})" for n in need)
    if body.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {body.removeprefix('WITH RECURSIVE ')}"
    return f"WITH {head} {body}" if need else body


def query(name: str, sql: str | None = None) -> Callable[[Callable[[DataFrame], DataFrame]], Callable]:
    """Registers an operator's query over cells."""

    def register(f: Callable[[DataFrame], DataFrame]) -> Callable:
        _QUERIES[name] = lambda spark, sf_dir: f(sources.load_cells(spark, sf_dir))
        if sql:
            _SQL[name] = with_ctes(sql)
        return f

    return register


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


query("cells_scan", "SELECT x, y, elevation, landcover FROM cells")(lambda c: c)
query("obstacle_mask", "SELECT x, y, elevation > 400 AS obstacle FROM cells")(lambda c: sources.with_obstacles(c).select("x", "y", "obstacle"))
query("class_area", "SELECT landcover, count(*) AS n FROM cells GROUP BY landcover")(lambda c: c.groupBy("landcover").agg(F.count("*").alias("n")))
query("distinct_classes", "SELECT DISTINCT landcover FROM cells")(lambda c: c.select("landcover").distinct())
query("boundary_mask", "SELECT x, y, is_boundary FROM edge")(lambda c: stencil.boundary_mask(c).select("x", "y", "is_boundary"))
query("boundary_mask4", "SELECT x, y, is_boundary4 FROM edge4")(lambda c: stencil.boundary_mask4(c).select("x", "y", "is_boundary4"))
query("elev_bins", "SELECT x, y, elev_bin FROM bins")(lambda c: stencil.elevation_bins(c).select("x", "y", "elev_bin"))
MIXED = "SELECT a.x, a.y, max(CASE WHEN b.landcover * 6 + b.elev_bin <> a.landcover * 6 + a.elev_bin THEN 1 ELSE 0 END) AS is_boundary FROM bins a, nine n, bins b WHERE b.x = a.x + n.dx AND b.y = a.y + n.dy GROUP BY a.x, a.y"
query("mixed_label_boundary", MIXED)(lambda c: stencil.mixed_boundary(c).select("x", "y", "is_boundary"))
query("local_std5", "SELECT x, y, local_std FROM std5")(lambda c: stencil.local_std(c).select("x", "y", "local_std"))
query("entropy3", "SELECT x, y, round(entropy, 6) AS entropy FROM entropy")(lambda c: stencil.local_entropy(c).select("x", "y", *r6("entropy")))
query("sobel", "SELECT x, y, round(gradient, 6) AS gradient FROM gradient")(lambda c: stencil.sobel(c).select("x", "y", *r6("gradient")))
query("flat_by_gradient", "SELECT x, y FROM gradient WHERE gradient < 30")(lambda c: stencil.sobel(c).where("gradient < 30").select("x", "y"))
query("flat_by_percentile", "SELECT x, y, local_std <= (SELECT quantile_cont(local_std, 0.25) FROM std5) AS is_flat FROM std5")(lambda c: stencil.flat_cells(stencil.local_std(c)).select("x", "y", "is_flat"))
query("edt", "SELECT x, y, round(edt, 6) AS edt FROM edt4")(lambda c: stencil.distance_transform(stencil.boundary_mask4(c), "is_boundary4").select("x", "y", *r6("edt")))
SIDES = """SELECT c.x, c.y, CAST(coalesce(i, 0) AS INT) AS is_inner, CAST(coalesce(o, 0) AS INT) AS is_outer FROM cells c LEFT JOIN (
  SELECT b.x, b.y, max(CASE WHEN a.landcover = b.landcover THEN 1 ELSE 0 END) AS i, max(CASE WHEN a.landcover <> b.landcover THEN 1 ELSE 0 END) AS o FROM cells a JOIN edge e ON e.x = a.x AND e.y = a.y, dims, nine n, cells b
  WHERE e.is_boundary = 1 AND a.x > 0 AND a.y > 0 AND a.x < w - 1 AND a.y < h - 1 AND b.x = a.x + n.dx AND b.y = a.y + n.dy GROUP BY b.x, b.y) t ON t.x = c.x AND t.y = c.y"""
query("inner_outer", SIDES)(lambda c: stencil.sides(c).select("x", "y", "is_inner", "is_outer"))
query("dilate_seeds", "SELECT DISTINCT CAST(s.x + p.d AS INT) AS x, CAST(s.y + q.d AS INT) AS y FROM seeds s, wide p, wide q")(lambda c: stencil.dilate(_grid(c).select("x", "y"), 5))
FLAT = "SELECT c.x, c.y, c.landcover FROM cells c JOIN std5 s ON s.x = c.x AND s.y = c.y WHERE local_std <= (SELECT quantile_cont(local_std, 0.25) FROM std5)"
COMPONENTS = f"""WITH RECURSIVE flat AS ({FLAT}), pairs AS (SELECT a.y * 2147483648 + a.x AS a, b.y * 2147483648 + b.x AS b FROM flat a, nine n, flat b WHERE b.x = a.x + n.dx AND b.y = a.y + n.dy AND b.landcover = a.landcover),
  comp(node, root) USING KEY (node) AS (SELECT y * 2147483648 + x, y * 2147483648 + x FROM flat UNION
    SELECT p.b, min(c.root) FROM comp c JOIN pairs p ON p.a = c.node JOIN recurring.comp k ON k.node = p.b WHERE c.root < k.root GROUP BY p.b)"""
query("flat_components", f"{COMPONENTS} SELECT f.x, f.y, f.landcover, CAST(root AS BIGINT) AS component FROM flat f JOIN comp ON node = f.y * 2147483648 + f.x")(lambda c: stencil.flat_components(stencil.flat_cells(stencil.local_std(c))))
query("blob_centroids", f"{COMPONENTS} SELECT f.landcover, CAST(root AS BIGINT) AS component, CAST(round_even(avg(f.x), 0) AS INT) AS x, CAST(round_even(avg(f.y), 0) AS INT) AS y FROM flat f JOIN comp ON node = f.y * 2147483648 + f.x GROUP BY 1, 2")(
    lambda c: stencil.blob_centroids(stencil.flat_cells(stencil.local_std(c)))
)


def _grid(cells: DataFrame) -> DataFrame:
    return regions.numbered(cells.where("x % 10 = 0 AND y % 10 = 0").select("x", "y"))


def _one(cells: DataFrame) -> DataFrame:
    """Each cell with its least nearest region."""
    return regions.members(cells, _grid(cells)).groupBy("x", "y", "elevation", "landcover").agg(F.min("region_id").alias("region_id"))


# samplers
GRID_SQL = "SELECT x, y FROM cells, (SELECT greatest(1, CAST(round_even(sqrt(w * h / 150.0), 0) AS INT)) AS s FROM dims) WHERE x % s = 0 AND y % s = 0"
query("grid_seeds", GRID_SQL)(lambda c: sampling.grid_seeds(c, 150))
HEX_SQL = """SELECT DISTINCT CAST(round_even(fx, 0) AS INT) AS x, CAST(round_even(fy, 0) AS INT) AS y FROM (SELECT (r % 2) * s / 2 + k * s AS fx, r * (s * sqrt(3) / 2) AS fy, w, h FROM
  (SELECT w, h, sqrt(2 / (sqrt(3) * (150 / CAST(w * h AS DOUBLE)))) AS s FROM dims), range(0, 2000) a(r), range(0, 2000) b(k) WHERE r * (s * sqrt(3) / 2) < h AND k * s < w)
  WHERE fx < w AND fy < h AND round_even(fx, 0) < w AND round_even(fy, 0) < h"""
query("hex_seeds", HEX_SQL)(lambda c: sampling.hex_seeds(c.sparkSession, *sources.size(c), 150))
STRIDE = "SELECT x, y FROM (SELECT x, y, row_number() OVER (ORDER BY y, x) - 1 AS i, count(*) OVER () AS n FROM {0}) WHERE i % greatest(1, n // 200) = 0"
query("stride_sample", STRIDE.format("edge WHERE is_boundary = 1"))(lambda c: sampling.boundary_stride(c, 200))
query("mixed_stride", STRIDE.format(f"({MIXED}) WHERE is_boundary = 1"))(lambda c: sampling.mixed_stride(c, 200))
query("entropy_topk", "SELECT x, y, round(entropy, 6) AS entropy FROM entropy JOIN edge USING (x, y) WHERE is_boundary = 1 ORDER BY entropy.entropy DESC, y, x LIMIT 200")(lambda c: sampling.entropy_top(c, 200).select("x", "y", *r6("entropy")))
query("score_topk", "SELECT x, y, round(score, 6) AS score FROM score ORDER BY score.score DESC, x DESC, y DESC LIMIT 200")(lambda c: sampling.score_top(c, 200).select("x", "y", *r6("score")))
REFILL = """WITH area AS (SELECT landcover, count(*) AS area, min(elevation) AS lo, max(elevation) AS hi FROM cells GROUP BY landcover),
  b AS (SELECT x, y, landcover, area, CASE WHEN elevation = lo OR hi = lo THEN 0 ELSE CAST(ceil((elevation - lo) * 5.0 / (hi - lo)) AS INT) END AS bin FROM cells JOIN area USING (landcover)),
  m AS (SELECT p.x, p.y, any_value(p.landcover) AS landcover, any_value(p.area) AS area, any_value(p.bin) AS bin FROM b p, nine n, b q WHERE q.x = p.x + n.dx AND q.y = p.y + n.dy GROUP BY p.x, p.y HAVING max(CASE WHEN q.landcover * 6 + q.bin <> p.landcover * 6 + p.bin THEN 1 ELSE 0 END) = 1)
  SELECT m.x, m.y FROM m LEFT JOIN edge e ON e.x = m.x AND e.y = m.y WHERE bin >= 1 AND is_boundary = 0 ORDER BY area DESC, landcover, bin, (CAST(m.x AS BIGINT) * 73856093 + CAST(m.y AS BIGINT) * 19349663) % 1000003, m.y, m.x LIMIT 300"""


def _with(sql: str) -> str:
    """SQL with CTEs of its own after the shared ones."""
    body = with_ctes(sql.replace("WITH ", "", 1))
    head, rest = body.split(sql.replace("WITH ", "", 1)[:20], 1)
    return head.rstrip() + ", " + sql.replace("WITH ", "", 1)[:20] + rest


query("bin_refill")(lambda c: sampling.refill(c, stencil.boundary_mask(c).where("is_boundary = 1"), 300))
_SQL["bin_refill"] = _with(REFILL)
SIDE_SAMPLE = f"SELECT t.x, t.y FROM ({SIDES}) t JOIN bins b ON b.x = t.x AND b.y = t.y WHERE (is_inner = 1 OR is_outer = 1) AND t.x % 2 = 0 AND t.y % 2 = 0 AND elev_bin >= 1"
query("inner_outer_sample", STRIDE.format(f"({SIDE_SAMPLE})"))(lambda c: sampling.inner_outer(c, 200))
query("greedy_flat")(lambda c: sampling.flat_first(stencil.local_std(c), 200, 4).select("x", "y"))
query("flat_sampler")(lambda c: sampling.flat_sampler(c, 600, 4))
query("hybrid_flat")(lambda c: sampling.hybrid(c, 300, 0.0, radius=2))
query("hybrid_mixed")(lambda c: sampling.hybrid(c, 300, 0.7, radius=4))
query("hybrid_boundary", "SELECT x, y FROM score ORDER BY score.score DESC, x DESC, y DESC LIMIT 300")(lambda c: sampling.hybrid(c, 300, 1.0))
query("unified_sampler")(lambda c: sampling.unified(c, 300, 0.5, radius=4))
query("fill_sampler")(lambda c: sampling.flat_fill(c, 200, 4, 30.0))
query("ratio_sampler")(lambda c: sampling.ratio(c, 200, 0.5, 4, 30.0))
query("score_spaced")(lambda c: sampling.score_spaced(c, 200, 2))
query("edt_peaks")(lambda c: sampling.peaks(c, 200, 4))

# regions
query("region_members", "SELECT region_id, x, y, elevation, landcover FROM tied")(lambda c: regions.members(c, _grid(c)))
ATTRIBUTES = """SELECT t.region_id, round(avg(elevation), 6) AS mean_elevation, CAST(min(elevation) AS DOUBLE) AS min_elevation, CAST(max(elevation) AS DOUBLE) AS max_elevation,
  arg_min(x, elevation * 1e9 + y * 1e4 + x) AS min_x, arg_min(y, elevation * 1e9 + y * 1e4 + x) AS min_y, arg_min(x, -elevation * 1e9 + y * 1e4 + x) AS max_x, arg_min(y, -elevation * 1e9 + y * 1e4 + x) AS max_y,
  any_value(k.landcover) AS landcover, count(*) AS region_size, round(max(sqrt((x - mx) ** 2 + (y - my) ** 2)), 6) AS max_distance, round(max(abs(elevation - mz)), 6) AS max_z_distance
  FROM tied t JOIN (SELECT region_id, avg(x) AS mx, avg(y) AS my, avg(elevation) AS mz FROM tied GROUP BY region_id) g USING (region_id) JOIN modes k USING (region_id) GROUP BY t.region_id"""
query("region_attributes", ATTRIBUTES)(lambda c: fitting.region_attributes(regions.members(c, _grid(c))).select("region_id", *r6("mean_elevation"), "min_elevation", "max_elevation", "min_x", "min_y", "max_x", "max_y", "landcover", "region_size", *r6("max_distance", "max_z_distance")))
query("class_first_point", "SELECT region_id, landcover, arg_min(x, y * 1e6 + x) AS x, arg_min(y, y * 1e6 + x) AS y, CAST(arg_min(elevation, y * 1e6 + x) AS DOUBLE) AS z FROM tied GROUP BY region_id, landcover")(
    lambda c: fitting.class_points(regions.members(c, _grid(c))).select("region_id", F.explode("points").alias("landcover", "p")).select("region_id", "landcover", "p.x", "p.y", "p.z")
)
query("adjacency", "SELECT src, dst FROM adjacent")(lambda c: regions.raster_adjacency(regions.members(c, _grid(c))))
query("voronoi_bounded")(lambda c: regions.voronoi(_grid(c)).select("seed_id", "is_bounded", F.size("neighbours").alias("n")))
query("voronoi_clipped")(lambda c: regions.voronoi(_grid(c), (0.0, 0.0, float(sources.size(c)[0] - 1), float(sources.size(c)[1] - 1))).select("seed_id", F.size("polygon").alias("vertices"), F.size("neighbours").alias("n")))
query("ridge_adjacency", "SELECT a.seed_id AS src, b.seed_id AS dst FROM seeds a, seeds b, (SELECT max(x) AS mx, max(y) AS my FROM seeds) WHERE abs(a.x - b.x) + abs(a.y - b.y) = 10 AND a.x > 0 AND a.y > 0 AND b.x > 0 AND b.y > 0 AND a.x < mx AND a.y < my AND b.x < mx AND b.y < my")(
    lambda c: regions.ridge_adjacency(regions.voronoi(_grid(c)))
)
query("polygon_cells", "SELECT DISTINCT seed_id AS region_id, c.x, c.y FROM seeds s, cells c WHERE abs(c.x - s.x) <= 5 AND abs(c.y - s.y) <= 5")(
    lambda c: regions.polygon_cells(_grid(c).select(F.col("seed_id").alias("region_id"), F.expr("transform(array(array(-5, -5), array(5, -5), array(5, 5), array(-5, 5)), v -> struct(CAST(x + v[0] AS DOUBLE) AS x, CAST(y + v[1] AS DOUBLE) AS y))").alias("polygon")), "region_id").join(c.select("x", "y"), ["x", "y"], "left_semi").select("region_id", "x", "y")
)
QUADTREE = """WITH RECURSIVE t(path, x, y, w, h, level) AS (SELECT '', 0, 0, CAST(w AS INT), CAST(h AS INT), 0 FROM dims UNION ALL
    SELECT path || q, x + CASE WHEN q IN (1, 3) THEN hw ELSE 0 END, y + CASE WHEN q IN (2, 3) THEN hh ELSE 0 END, CASE WHEN q IN (1, 3) THEN w - hw ELSE hw END, CASE WHEN q IN (2, 3) THEN h - hh ELSE hh END, level + 1
    FROM (SELECT *, greatest(w // 2, least(w, 1)) AS hw, greatest(h // 2, least(h, 1)) AS hh FROM t WHERE w > 2 OR h > 2), range(0, 4) g(q) WHERE CASE WHEN q IN (1, 3) THEN w - hw ELSE hw END > 0 AND CASE WHEN q IN (2, 3) THEN h - hh ELSE hh END > 0),
  f AS (SELECT t.path, t.x, t.y, t.w, t.h, min(c.landcover) = max(c.landcover) OR (t.w <= 2 AND t.h <= 2) AS leaf FROM t JOIN cells c ON c.x >= t.x AND c.x < t.x + t.w AND c.y >= t.y AND c.y < t.y + t.h GROUP BY t.path, t.x, t.y, t.w, t.h),
  leaves AS (SELECT x, y, w, h FROM f WHERE leaf AND NOT EXISTS (SELECT 1 FROM f p WHERE p.leaf AND p.path <> f.path AND starts_with(f.path, p.path)))"""
query("quadtree", f"{QUADTREE} SELECT x, y, w, h FROM leaves")(lambda c: regions.quadtree(c, 2))
PATCHES = """SELECT l.x, l.y, l.w, l.h, (SELECT landcover FROM cells c WHERE c.x >= l.x AND c.x < l.x + l.w AND c.y >= l.y AND c.y < l.y + l.h GROUP BY landcover ORDER BY count(*) DESC, landcover LIMIT 1) AS landcover, round(avg(c.elevation), 6) AS avg_elevation
  FROM leaves l JOIN cells c ON c.x >= l.x AND c.x < l.x + l.w AND c.y >= l.y AND c.y < l.y + l.h GROUP BY l.x, l.y, l.w, l.h"""
query("patch_desc", f"{QUADTREE} {PATCHES}")(lambda c: regions.describe_patches(c, regions.quadtree(c, 2)).select("x", "y", "w", "h", "landcover", *r6("avg_elevation")))
query("quadtree_coverage", f"{QUADTREE} SELECT 100.0 * sum(w * h) / (SELECT w * h FROM dims) AS coverage FROM leaves")(lambda c: regions.rectangle_cells(regions.quadtree(c, 2)).select("px", "py").distinct().agg(F.count("*").alias("n")).crossJoin(sources.extent(c)).select((100.0 * F.col("n") / (F.col("width") * F.col("height"))).alias("coverage")))
RECTS = "SELECT a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM leaves a, leaves b WHERE (a.x, a.y) <> (b.x, b.y) AND a.x <= b.x + b.w AND b.x <= a.x + a.w AND a.y <= b.y + b.h AND b.y <= a.y + a.h"


def _rectangles(c: DataFrame) -> DataFrame:
    leaves = regions.quadtree(c, 2).withColumn("patch_id", F.col("y").cast("long") * 1_000_000 + F.col("x"))
    pairs = regions.rectangle_adjacency(leaves)
    return pairs.select((F.col("patch_id") % 1_000_000).cast("int").alias("ax"), F.floor(F.col("patch_id") / 1_000_000).cast("int").alias("ay"), (F.col("other") % 1_000_000).cast("int").alias("bx"), F.floor(F.col("other") / 1_000_000).cast("int").alias("by_"))


query("rect_adjacency", f"{QUADTREE} {RECTS}")(_rectangles)
query("patch_graph")(lambda c: plans.quadtree_graph(c, 4)[1])

# fits
query("plane_moments", "SELECT region_id, CAST(n AS BIGINT) AS n, round(a, 6) AS a, round(b, 6) AS b, round(d, 4) AS d, round(rmse, 5) AS rmse FROM fit")(lambda c: fitting.plane_moments(regions.members(c, _grid(c))).select("region_id", "n", *r6("a", "b"), F.round("d", 4).alias("d"), F.round("rmse", 5).alias("rmse")))
query("grade_direction", "SELECT region_id, round(100 * sqrt(a * a + b * b), 5) AS grade, round((degrees(atan2(-a, -b)) + 360) % 360, 3) AS direction FROM fit")(lambda c: fitting.grade_direction(fitting.plane_moments(regions.members(c, _grid(c)))).select("region_id", F.round("grade", 5).alias("grade"), F.round("direction", 3).alias("direction")))
query("recursive_fit")(lambda c: fitting.fit_patches(regions.members(c, _grid(c))))
query("surface_fit")(lambda c: fitting.fit_surfaces(regions.members(c, _grid(c))).select("region_id", F.round("mse", 5).alias("mse"), "n"))


def _rebuilt(c: DataFrame) -> DataFrame:
    tied = regions.members(c, _grid(c))
    modes = tied.groupBy("region_id").agg(F.mode("landcover", True).alias("landcover_fit"))
    fit = fitting.plane_moments(tied).select("region_id", "a", "b", "d")
    one = tied.groupBy("x", "y", "elevation", "landcover").agg(F.min("region_id").alias("region_id")).join(fit, "region_id").join(modes, "region_id")
    return one.withColumn("z_fit", fitting.plane_z(F.col("a"), F.col("b"), F.lit(-1.0), F.col("d"), F.col("x") * 30.0, F.col("y") * 30.0))


query("recon_loss", "SELECT region_id, round(sqrt(avg((elevation - z_fit) ** 2)), 5) AS elevation_rmse, round(var_pop(elevation - z_fit), 4) AS elevation_std, round(max(abs(elevation - z_fit)), 4) AS elevation_max_residual, CAST(1 AS BIGINT) AS plane_count FROM rebuilt GROUP BY region_id")(
    lambda c: fitting.loss_table(_rebuilt(c), _grid(c).select(F.col("seed_id").alias("region_id"))).select("region_id", F.round("elevation_rmse", 5).alias("elevation_rmse"), F.round("elevation_std", 4).alias("elevation_std"), F.round("elevation_max_residual", 4).alias("elevation_max_residual"), "plane_count")
)
query("error_map", "SELECT x, y, round(abs(elevation - z_fit), 4) AS abs_error, landcover <> landcover_fit AS class_differs FROM rebuilt")(lambda c: fitting.error_map(_rebuilt(c)).select("x", "y", F.round("abs_error", 4).alias("abs_error"), "class_differs"))
query("error_range", "SELECT round(min(abs(elevation - z_fit)), 4) AS least, round(max(abs(elevation - z_fit)), 4) AS most FROM rebuilt")(lambda c: fitting.error_range(_rebuilt(c)).select(F.round("least", 4).alias("least"), F.round("most", 4).alias("most")))
query("accuracy", "SELECT round(avg(CASE WHEN landcover = landcover_fit THEN 1.0 ELSE 0 END), 6) AS accuracy, count(*) AS cells FROM rebuilt")(lambda c: fitting.accuracy(_rebuilt(c)).select(*r6("accuracy"), "cells"))
query("confusion", "SELECT landcover AS truth, landcover_fit AS predicted, count(*) AS n FROM rebuilt GROUP BY 1, 2")(lambda c: fitting.confusion(_rebuilt(c)))
query("mean_iou", "SELECT round(avg(i / u), 6) AS mean_iou FROM (SELECT v, sum(CASE WHEN landcover = landcover_fit THEN 1.0 ELSE 0 END) AS i, count(*) AS u FROM rebuilt, (SELECT DISTINCT landcover AS v FROM cells) WHERE v = landcover OR v = landcover_fit GROUP BY v)")(lambda c: fitting.mean_iou(_rebuilt(c)).select(*r6("mean_iou")))
query("coverage", "SELECT region_id, CAST(100 AS DOUBLE) AS coverage, count(*) * 24 AS point_bytes FROM rebuilt GROUP BY region_id")(lambda c: fitting.coverage(_rebuilt(c)))

# costs of eastward steps


def _east(c: DataFrame) -> DataFrame:
    steps = c.select(F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("elevation").alias("z1"), F.col("landcover").alias("lc1"), (F.col("x") + 1).alias("x2"), F.col("y").alias("y2"), F.lead("elevation").over(stencil.row()).alias("z2"))
    return steps.where("z2 IS NOT NULL")


def _cost(name: str, sql: str) -> None:
    query(f"{name}_step", f"SELECT x, y, round({sql}, 6) AS cost FROM east")(lambda c: _east(c).select(F.col("x1").alias("x"), F.col("y1").alias("y"), F.round(costs.MODELS[name].step(), 6).alias("cost")))


GRADE = "(100 * (z2 - z1) / 30.01)"
_cost("vehicle", VEHICLE)
_cost("human", f"coalesce((1.5 * 85.0 + 2 * 93.0 * pow(8.0 / 85.0, 2) + tf * 93.0 * (1.5 * 1.8 * 1.8 + 0.35 * 1.8 * {GRADE}) - CASE WHEN {GRADE} < 0 THEN tf * (1.8 * {GRADE} * 93.0 / 3.5 - 93.0 * pow({GRADE} + 6, 2) / 85.0 + 25 * 1.8 * 1.8) ELSE 0 END) / 4, CAST('Infinity' AS DOUBLE))")
_cost("euclid2d", "d")
_cost("euclid3d", "sqrt(d * d + (z2 - z1) * (z2 - z1))")
_cost("linear", f"coalesce(105.765 + tf * 75 * (2.16 + 0.42 * {GRADE}), CAST('Infinity' AS DOUBLE))")
_cost("legacy", "CASE WHEN abs(z2 - z1) / d > 0.6 THEN 1e9 ELSE d + abs(z2 - z1) END")
query("power_fit", "SELECT CAST(0 AS DOUBLE) AS a, round(regr_slope(p, dz), 6) AS b, round(regr_intercept(p, dz), 6) AS c FROM (SELECT dz, 1.5 * 85.0 + 2 * 93.0 * pow(8.0 / 85.0, 2) + 3.0 * 93.0 * (1.5 * 0.25 + 0.35 * 0.5 * dz / 30 * 100) AS p FROM (SELECT -10 + i * 20.0 / 99 AS dz FROM range(0, 100) t(i)))")(lambda c: costs.linear_power_fit(c.sparkSession).select("a", *r6("b", "c")))

# lines and sight
SEGMENTS = "SELECT query_id, sx AS x0, sy AS y0, gx AS x1, gy AS y1 FROM trips"


def _segments(c: DataFrame) -> DataFrame:
    return plans.sample_queries(c).select(F.col("query_id"), F.col("sx").alias("x0"), F.col("sy").alias("y0"), F.col("gx").alias("x1"), F.col("gy").alias("y1"))


LINE = f"""SELECT query_id, i AS seq, CAST(x0 + sign(x1 - x0) * CASE WHEN abs(y1 - y0) > abs(x1 - x0) THEN m ELSE i END AS INT) AS x, CAST(y0 + sign(y1 - y0) * CASE WHEN abs(y1 - y0) > abs(x1 - x0) THEN i ELSE m END AS INT) AS y
  FROM (SELECT *, CASE WHEN n = 0 THEN 0 ELSE (2 * i * s + n) // (2 * n) END AS m FROM (SELECT *, CAST(unnest(range(0, n + 1)) AS INT) AS i FROM (SELECT *, greatest(abs(x1 - x0), abs(y1 - y0)) AS n, least(abs(x1 - x0), abs(y1 - y0)) AS s FROM ({SEGMENTS}))))"""
query("line_pixels", LINE)(lambda c: _segments(c).select("query_id", F.explode(line_pixels(*(F.col(n) for n in ("x0", "y0", "x1", "y1")))).alias("p")).select("query_id", "p.seq", "p.x", "p.y"))
SIGHT = f"""SELECT query_id, coalesce(bool_or(elevation > 400), false) AS blocked FROM (SELECT query_id, CAST(trunc(CASE WHEN n = 1 THEN x0 WHEN i = n - 1 THEN x1 ELSE x0 + i * CAST(x1 - x0 AS DOUBLE) / (n - 1) END) AS INT) AS x, CAST(trunc(CASE WHEN n = 1 THEN y0 WHEN i = n - 1 THEN y1 ELSE y0 + i * CAST(y1 - y0 AS DOUBLE) / (n - 1) END) AS INT) AS y
  FROM (SELECT *, unnest(range(0, n)) AS i FROM (SELECT *, greatest(abs(x1 - x0), abs(y1 - y0), 1) AS n FROM ({SEGMENTS})))) p LEFT JOIN cells c ON c.x = p.x AND c.y = p.y GROUP BY query_id"""
query("obstacle_los", SIGHT)(lambda c: graph.in_sight(_segments(c), c, ["query_id"]))

# graph
query("path_queries", "SELECT CAST(query_id AS INT) AS query_id, CAST(sx AS INT) AS sx, CAST(sy AS INT) AS sy, CAST(gx AS INT) AS gx, CAST(gy AS INT) AS gy FROM trips")(plans.sample_queries)
query("nearest_region", "SELECT CAST(query_id AS INT) AS query_id, src, dst FROM ends")(lambda c: plans.locate_queries(plans.sample_queries(c), _grid(c)).select("query_id", "src", "dst"))
query("k_nearest", "SELECT CAST(query_id AS INT) AS query_id, seed_id, CAST(nth AS INT) AS nth FROM (SELECT query_id, seed_id, row_number() OVER (PARTITION BY query_id ORDER BY (x - sx) ** 2 + (y - sy) ** 2, seed_id) AS nth FROM trips, seeds) WHERE nth <= 4")(lambda c: regions.locate(plans.sample_queries(c), _grid(c), "sx", "sy", 4).select("query_id", "seed_id", "nth"))


def _edges(c: DataFrame, model: str = "vehicle") -> DataFrame:
    seeds = _grid(c)
    return graph.edges(regions.raster_adjacency(regions.members(c, seeds)), seeds, c, model)


query("region_edges", "SELECT src, dst, round(weight, 4) AS weight FROM edges")(lambda c: _edges(c).select("src", "dst", F.round("weight", 4).alias("weight")))
query("edge_cost_2d", "SELECT src, dst, CAST(300 AS DOUBLE) AS weight FROM rook")(lambda c: _edges(c, "euclid2d"))
SSSP = """WITH RECURSIVE sp(query_id, node, cost) USING KEY (query_id, node) AS (SELECT query_id, src, CAST(0 AS DOUBLE) FROM {0} UNION
    SELECT s.query_id, e.dst, min(s.cost + e.weight) FROM sp s JOIN edges e ON e.src = s.node LEFT JOIN recurring.sp k ON k.query_id = s.query_id AND k.node = e.dst WHERE k.cost IS NULL OR s.cost + e.weight < k.cost - 1e-9 GROUP BY s.query_id, e.dst)"""
query("sssp_relax")(lambda c: graph.relax(_edges(c), c.sparkSession.createDataFrame([(0, 0)], "query_id int, src long")).select("node", F.round("cost", 4).alias("cost")))
_SQL["sssp_relax"] = with_ctes(SSSP.format("(SELECT 0 AS query_id, CAST(0 AS BIGINT) AS src)") + " SELECT node, round(cost, 4) AS cost FROM sp")


def _answer(c: DataFrame, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    return plans.answer(stable(_edges(c)), _grid(c), plans.sample_queries(c), **options)


query("path_cost")(lambda c: _answer(c)[0].where("rank = 0").select(F.col("query_id").cast("int").alias("query_id"), F.round("cost", 4).alias("cost")))
_SQL["path_cost"] = with_ctes(SSSP.format("ends") + " SELECT CAST(sp.query_id AS INT) AS query_id, round(cost, 4) AS cost FROM sp JOIN ends ON ends.query_id = sp.query_id AND ends.dst = sp.node")
WALK = SSSP.format("ends") + """, best AS (SELECT s.query_id, e.dst AS node, arg_min(e.src, s.cost + e.weight) AS before FROM sp s JOIN edges e ON e.src = s.node GROUP BY s.query_id, e.dst),
  back(query_id, k, node) AS (SELECT query_id, 0, dst FROM ends UNION ALL SELECT b.query_id, k + 1, p.before FROM back b JOIN best p ON p.query_id = b.query_id AND p.node = b.node JOIN ends n ON n.query_id = b.query_id WHERE b.node <> n.src),
  points AS (SELECT query_id, (max(k) OVER (PARTITION BY query_id)) - k + 1 AS seq, s.x, s.y FROM back JOIN seeds s ON s.seed_id = node UNION ALL SELECT query_id, 0, sx, sy FROM trips
    UNION ALL SELECT t.query_id, (SELECT max(k) + 2 FROM back b WHERE b.query_id = t.query_id), gx, gy FROM trips t)"""
query("path_nodes")(lambda c: _answer(c)[1].withColumn("query_id", F.col("query_id").cast("int")))
_SQL["path_nodes"] = with_ctes(WALK + " SELECT CAST(query_id AS INT) AS query_id, CAST(seq AS INT) AS seq, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM points")
REPORT = """ SELECT CAST(p.query_id AS INT) AS query_id, true AS solved, count(*) AS path_nodes, CAST(count(*) - 2 AS INT) AS region_nodes, round(any_value(cost), 4) AS cost, round(any_value(cost) / 1e4, 6) AS cost_scaled_x1e4, round(30 * sum(leg), 4) AS path_length_m
  FROM (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS leg FROM points WINDOW w AS (PARTITION BY query_id ORDER BY seq)) p JOIN ends n ON n.query_id = p.query_id JOIN sp ON sp.query_id = p.query_id AND sp.node = n.dst GROUP BY p.query_id"""
query("path_report")(lambda c: _answer(c)[2].select("query_id", "solved", "path_nodes", "region_nodes", F.round("cost", 4).alias("cost"), *r6("cost_scaled_x1e4"), F.round("path_length_m", 4).alias("path_length_m")))
_SQL["path_report"] = with_ctes(WALK + REPORT)
query("path_summary")(lambda c: graph.summary(_answer(c)[2]).select("n", F.round("mean_cost", 4).alias("mean_cost"), F.round("std_cost", 4).alias("std_cost"), F.round("mean_length", 3).alias("mean_length"), F.round("std_length", 3).alias("std_length")))
_SQL["path_summary"] = with_ctes(WALK + f" SELECT count(*) AS n, round(avg(cost / 1e4), 4) AS mean_cost, round(stddev_samp(cost / 1e4), 4) AS std_cost, round(avg(path_length_m), 3) AS mean_length, round(stddev_samp(path_length_m), 3) AS std_length FROM ({REPORT})")
query("path_recost")(lambda c: graph.path_costs(_answer(c)[1], c))
query("n_hop", "SELECT DISTINCT b.dst AS node FROM adjacent a JOIN adjacent b ON b.src = a.dst WHERE a.src = 0 AND b.dst <> 0 AND b.dst NOT IN (SELECT dst FROM adjacent WHERE src = 0)")(
    lambda c: graph.hops(regions.raster_adjacency(regions.members(c, _grid(c))), c.sparkSession.createDataFrame([(0,)], "node long"), 2)
)
query("k_shortest")(lambda c: _answer(c, k=3)[0].select("query_id", "rank", F.round("cost", 4).alias("cost"), F.size("nodes").alias("n")))
query("k_diverse")(lambda c: _answer(c, k=3, rise=1.0)[0].select("query_id", "rank", F.round("cost", 4).alias("cost"), F.size("nodes").alias("n")))
query("smooth")(lambda c: graph.smooth(_answer(c)[1], c))
query("refine")(lambda c: graph.refine(_answer(c)[1], c))

# whole plans
query("abstraction_quality")(lambda c: plans.evaluate(plans.build(c, plans.Settings(budget=120, decomposition="grid"))))
query("compare_decompositions")(lambda c: plans.compare(c, plans.sample_queries(c), ["grid", "hex"], [120], smooth=True))
query("class_names", "SELECT * FROM (VALUES " + ", ".join(f"({i + 1}, '{x}')" for i, x in enumerate(sources.CLASS_NAMES)) + ") t(landcover, name)")(lambda c: sources.classes(c.sparkSession))
query("materials", "SELECT landcover, CAST(mu AS DOUBLE) AS mu, CAST(rough AS DOUBLE) AS rough, CAST(tf AS DOUBLE) AS terrain_factor FROM material")(lambda c: costs.material(c.sparkSession))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
