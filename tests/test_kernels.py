"""Operators on small rasters worked out by hand or by brute force."""

import itertools
import math

import numpy as np
import pytest
from orolith.functions import costs
from orolith.functions.lines import line_pixels, sight_pixels
from orolith.operators import fitting, graph, regions, sampling, stencil
from orolith.sources import cells as sources
from pyspark.sql import functions as F


def table(spark, elevation, landcover):
    elevation, landcover = np.asarray(elevation), np.asarray(landcover)
    h, w = elevation.shape
    return spark.createDataFrame([(x, y, int(elevation[y, x]), int(landcover[y, x])) for y in range(h) for x in range(w)], "x int, y int, elevation int, landcover int")


@pytest.fixture(scope="module")
def rough(spark):
    rng = np.random.default_rng(1)
    return table(spark, rng.integers(300, 340, (14, 17)), rng.integers(1, 4, (14, 17)) // 2 + 1).cache()


def arrays(cells):
    rows = cells.collect()
    w, h = max(r.x for r in rows) + 1, max(r.y for r in rows) + 1
    z, c = np.zeros((h, w), int), np.zeros((h, w), int)
    for r in rows:
        z[r.y, r.x], c[r.y, r.x] = r.elevation, r.landcover
    return z, c


def test_boundary_and_entropy_of_two_classes(spark):
    cells = table(spark, np.zeros((5, 5)), [[1, 1, 2, 2, 2]] * 5)
    assert {r.x for r in stencil.boundary_mask(cells).where("is_boundary = 1").collect()} == {1, 2}
    assert {r.x for r in stencil.local_entropy(cells).where("entropy > 0").collect()} == {1, 2}
    assert stencil.boundary_mask4(cells).where("is_boundary4 = 1").count() == 10


def test_std_entropy_gradient_distance_equal_numpy(rough):
    z, c = arrays(rough)
    wide = np.pad(z, 2, mode="symmetric")
    labels = np.pad(c, 1, mode="edge")
    smooth = np.pad(z, 1, mode="symmetric").astype(float)
    std = {(r.x, r.y): r.local_std for r in stencil.local_std(rough, truncate=False).collect()}
    entropy = {(r.x, r.y): r.entropy for r in stencil.local_entropy(rough).collect()}
    gradient = {(r.x, r.y): r.gradient for r in stencil.sobel(rough).collect()}
    marked = stencil.boundary_mask(rough)
    edges = [(r.x, r.y) for r in marked.where("is_boundary = 1").collect()]
    distance = {(r.x, r.y): r.edt for r in stencil.distance_transform(marked).collect()}
    for y, x in np.ndindex(z.shape):
        assert std[x, y] == pytest.approx(wide[y : y + 5, x : x + 5].std(), abs=1e-5)
        _, n = np.unique(labels[y : y + 3, x : x + 3], return_counts=True)
        assert entropy[x, y] == pytest.approx(-(n / 9 * np.log2(n / 9)).sum(), abs=1e-8)
        s = smooth[y : y + 3, x : x + 3]
        gx, gy = (s[:, 2] - s[:, 0]) @ [1, 2, 1], (s[2] - s[0]) @ [1, 2, 1]
        assert gradient[x, y] == pytest.approx(math.hypot(gx, gy))
        assert distance[x, y] == pytest.approx(min(math.hypot(x - a, y - b) for a, b in edges))


def test_no_boundary_has_no_distance(spark):
    cells = table(spark, np.zeros((3, 4)), np.ones((3, 4)))
    assert stencil.distance_transform(stencil.boundary_mask(cells)).where("edt IS NOT NULL").count() == 0
    assert sampling.score_top(cells, 3).count() == 0


def test_components_equal_flood_fill(rough):
    _, c = arrays(rough)
    found = stencil.flat_components(rough.withColumn("is_flat", F.lit(True))).collect()
    label, seen = {}, set()
    for y, x in np.ndindex(c.shape):
        if (x, y) in seen:
            continue
        stack = [(x, y)]
        seen.add((x, y))
        while stack:
            a, b = stack.pop()
            label[a, b] = y * 2**31 + x
            for i, j in itertools.product((-1, 0, 1), repeat=2):
                p = (a + i, b + j)
                if 0 <= p[0] < c.shape[1] and 0 <= p[1] < c.shape[0] and p not in seen and c[p[1], p[0]] == c[b, a]:
                    seen.add(p)
                    stack.append(p)
    assert {(r.x, r.y): r.component for r in found} == label


@pytest.mark.parametrize("metric", ["chebyshev", "euclidean"])
def test_spaced_equals_sequential_greedy(rough, metric):
    ranked = rough.withColumn("rank", F.struct("elevation", sampling.draw(3).alias("h"), "y", "x"))
    rows = sorted(ranked.collect(), key=lambda r: tuple(r["rank"]))
    chosen = []
    for r in rows:
        far = (lambda a, b: max(abs(a), abs(b)) > 2) if metric == "chebyshev" else (lambda a, b: a * a + b * b > 4)
        if all(far(r.x - p, r.y - q) for p, q in chosen):
            chosen.append((r.x, r.y))
    got = sampling.spaced(ranked, 2, metric).orderBy("rank").collect()
    assert [(r.x, r.y) for r in got] == chosen


def test_bins_put_the_least_in_none(spark):
    cells = table(spark, [[0, 1, 2, 3, 4, 5, 10]], np.ones((1, 7)))
    assert [r.elev_bin for r in stencil.elevation_bins(cells).orderBy("x").collect()] == [0, 1, 1, 2, 2, 3, 5]
    flat = table(spark, np.full((2, 2), 7), np.ones((2, 2)))
    assert {r.elev_bin for r in stencil.elevation_bins(flat).collect()} == {0}


def bresenham(x0, y0, x1, y1):
    dx, dy, sx, sy = abs(x1 - x0), abs(y1 - y0), (x1 > x0) - (x1 < x0), (y1 > y0) - (y1 < y0)
    steep = dy > dx
    a, b, long, short = (y0, x0, dy, dx) if steep else (x0, y0, dx, dy)
    sa, sb = (sy, sx) if steep else (sx, sy)
    d, out = 2 * short - long, []
    for _ in range(long):
        out.append((b, a) if steep else (a, b))
        if d >= 0 and long:
            b += sb
            d -= 2 * long
        a += sa
        d += 2 * short
    return [*out, (x1, y1)]


def test_lines_equal_the_integer_algorithm(spark):
    ends = [(0, 0, a, b) for a, b in itertools.product(range(-7, 8), repeat=2)] + [(5, 3, 5, 3)]
    rows = spark.createDataFrame(ends, "x0 int, y0 int, x1 int, y1 int").withColumn("p", line_pixels(*map(F.col, ("x0", "y0", "x1", "y1"))))
    for r in rows.collect():
        assert [(q.x, q.y) for q in r.p] == bresenham(r.x0, r.y0, r.x1, r.y1)
    for r in rows.withColumn("s", sight_pixels(*map(F.col, ("x0", "y0", "x1", "y1")))).collect():
        n = max(abs(r.x1 - r.x0), abs(r.y1 - r.y0), 1)
        assert [(q.x, q.y) for q in r.s] == list(zip(np.linspace(r.x0, r.x1, n).astype(int).tolist(), np.linspace(r.y0, r.y1, n).astype(int).tolist(), strict=True))


def test_vehicle_cost_barrier_and_infinity(spark):
    rows = [(0, 0, 100.0, 1, 1, 0, 111.0), (0, 0, 100.0, 1, 1, 1, 111.0), (0, 0, 100.0, 0, 1, 0, 100.0), (0, 0, 100.0, 1, 0, 0, 100.0), (0, 0, 100.0, 1, 1, 0, 100.0)]
    got = [r.c for r in spark.createDataFrame(rows, "x1 int, y1 int, z1 double, lc1 int, x2 int, y2 int, z2 double").select(costs.vehicle().alias("c")).collect()]
    assert got[0] == 1e6 and 42 < got[1] < 1e3 and got[2] == math.inf and got[3] == 0
    assert got[4] == pytest.approx((1 / 0.504 - 1) / 2 + 30 + 6.65142)


def test_members_keep_ties_and_equal_brute_force(spark, rough):
    seeds = spark.createDataFrame([(0, 2, 2), (1, 12, 2), (2, 7, 12), (3, 16, 13)], "seed_id long, x int, y int")
    places = [(r.seed_id, r.x, r.y) for r in seeds.collect()]
    want = set()
    for r in rough.collect():
        d = [(r.x - a) ** 2 + (r.y - b) ** 2 for _, a, b in places]
        want |= {(places[i][0], r.x, r.y) for i in range(len(d)) if d[i] == min(d)}
    for side in (1, 3, 50):
        got = regions.nearest(rough.select("x", "y"), seeds, side, True, ["x", "y"])
        assert {(r.seed_id, r.x, r.y) for r in got.collect()} == want
    assert regions.members(rough, seeds).count() == len(want)


def test_voronoi_cells_cover_the_box(spark):
    rng = np.random.default_rng(7)
    points = {(int(a), int(b)) for a, b in rng.integers(0, 40, (60, 2))}
    seeds = regions.numbered(spark.createDataFrame(sorted(points), "x int, y int"))
    clipped = regions.voronoi(seeds, (0.0, 0.0, 40.0, 40.0)).collect()
    area = lambda p: abs(sum(p[i].x * p[(i + 1) % len(p)].y - p[(i + 1) % len(p)].x * p[i].y for i in range(len(p)))) / 2
    assert len(clipped) == len(points)
    assert sum(area(r.polygon) for r in clipped) == pytest.approx(1600)
    open_cells = regions.voronoi(seeds)
    pairs = {(r.src, r.dst) for r in regions.ridge_adjacency(open_cells).collect()}
    assert pairs and all((b, a) in pairs for a, b in pairs)


def test_quadtree_of_one_mixed_quadrant(spark):
    cells = table(spark, np.zeros((4, 4)), [[1, 1, 2, 2], [1, 1, 2, 2], [3, 3, 4, 5], [3, 3, 5, 4]])
    leaves = regions.quadtree(cells, 1)
    assert leaves.count() == 7
    assert regions.rectangle_cells(leaves).select("px", "py").distinct().count() == 16
    assert {r.landcover for r in regions.describe_patches(cells, leaves).collect()} == {1, 2, 3, 4, 5}


def test_planes(spark):
    x, y = np.meshgrid(np.arange(4), np.arange(4))
    cells = table(spark, 3 * x, np.ones((4, 4))).withColumn("region_id", F.lit(1).cast("long"))
    plane = fitting.grade_direction(fitting.plane_moments(cells)).first()
    assert (plane.a, plane.b, plane.rmse) == pytest.approx((0.1, 0, 0), abs=1e-9)
    assert plane.grade == pytest.approx(10) and plane.direction == pytest.approx(270)
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 60):
        px, py, pz = rng.integers(0, 12, n), rng.integers(0, 12, n), rng.integers(0, 200, n)
        found = fitting.split_planes(px, py, pz, np.ones(n, int), 10.0)
        assert sum(f[7] for f in found) >= n
        assert all(f[4] <= 10 or f[7] <= 3 or np.ptp([p[0] for p in f[5]]) < 3 for f in found)
    shape = [(0, i) for i in range(4)] + [(i, 0) for i in range(1, 4)]
    assert fitting.split_planes(*np.array(shape).T, np.array([0, 500, 0, 500, 500, 0, 500]), np.ones(7, int))


def test_surface_and_reconstruction(spark):
    x, y = np.meshgrid(np.arange(5), np.arange(5))
    cells = table(spark, 2 * x * x + y * y - x * y + 3 * x + 7, np.ones((5, 5))).withColumn("region_id", F.lit(4).cast("long"))
    surface = fitting.fit_surfaces(cells).first()
    assert surface.coefficients == pytest.approx([2, 1, -1, 3, 0, 7], abs=1e-6)
    patches = fitting.fit_patches(cells, 1.0)
    rebuilt = fitting.reconstruct(cells, patches)
    assert rebuilt.where("z_fit IS NULL").count() == 0
    assert fitting.mean_iou(rebuilt).first().mean_iou == 1 and fitting.accuracy(rebuilt).first().accuracy == 1
    assert fitting.loss_table(rebuilt, patches).first().elevation_rmse < 10


def test_polygon_predicate():
    square = [(0, 0), (4, 0), (4, 4), (0, 4)]
    assert regions.inside_polygon(2, 2, square) and regions.inside_polygon(4.7, 2, square) and not regions.inside_polygon(4.8, 2, square)
    assert regions.inside_polygon(0.5, 0.5, [(0, 0)]) and not regions.inside_polygon(1, 0, [(0, 0)])
    assert regions.inside_polygon(2, 0.7, [(0, 0), (4, 0)]) and not regions.inside_polygon(5, 0, [(0, 0), (4, 0)])
    assert not regions.inside_polygon(0, 0, [])


def test_paths_equal_relaxation(spark):
    rng = np.random.default_rng(9)
    rows = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 30, 120), rng.integers(0, 30, 120), rng.integers(1, 50, 120), strict=True) if a != b]
    edges = spark.createDataFrame(rows, "src long, dst long, weight double").groupBy("src", "dst").agg(F.min("weight").alias("weight"))
    queries = spark.createDataFrame([(i, 0, i) for i in range(31)], "query_id long, src long, dst long")
    found = {r.query_id: r for r in graph.routes(edges, queries).collect()}
    want = {r.node: r.cost for r in graph.relax(edges, spark.createDataFrame([(0, 0)], "query_id long, src long")).collect()}
    for i in range(31):
        assert found[i].solved == (i in want)
        assert (found[i].cost if found[i].solved else None) == want.get(i)
    several = graph.routes(edges, queries, k=4, every=1).collect()
    for i in range(31):
        mine = sorted((r for r in several if r.query_id == i and r.solved), key=lambda r: r["rank"])
        assert [r.cost for r in mine] == sorted(r.cost for r in mine) and len({tuple(r.nodes) for r in mine}) == len(mine)
    diverse = graph.routes(edges, queries, k=3, every=1, rise=10.0).collect()
    for i in range(31):
        mine = [r.cost for r in sorted((r for r in diverse if r.query_id == i and r.solved), key=lambda r: r["rank"])]
        assert all(b > a * 1.1 for a, b in itertools.pairwise(mine))


def test_hops(spark):
    ring = spark.createDataFrame([(i, (i + s) % 8) for i in range(8) for s in (1, -1 % 8)], "src long, dst long")
    path = spark.createDataFrame([(0,), (1,)], "node long")
    assert {r.node for r in graph.hops(ring, path, 2).collect()} == {2, 3, 6, 7}


def test_query_legs_and_parsing(spark):
    legs = [tuple(r) for r in sources.path_queries(spark, [(0, 0), (1, 2), (5, 5)]).orderBy("query_id").collect()]
    assert legs == [(0, 0, 0, 1, 2), (1, 1, 2, 5, 5), (2, 5, 5, 1, 2), (3, 1, 2, 0, 0)]
    assert sources.parse_point("3,4") == (3, 4) and sources.parse_selection("all") == list(range(20)) and sources.parse_selection("7") == [7]
    with pytest.raises(ValueError):
        sources.parse_selection("20")


def test_array_raster(spark, tmp_path):
    z, c = np.arange(12, dtype=np.int16).reshape(3, 4), np.ones((3, 4), np.uint8)
    np.save(tmp_path / "z.npy", z)
    np.save(tmp_path / "c.npy", c)
    rows = sources.read_arrays(spark, str(tmp_path / "z.npy"), str(tmp_path / "c.npy")).collect()
    assert {(r.x, r.y, r.elevation, r.landcover) for r in rows} == {(x, y, float(z[y, x]), 1) for y in range(3) for x in range(4)}


def test_seeds_that_meet_in_a_point_share_no_ridge(spark):
    """Four corners of a square meet in one point, wherever it lies and however far the box is."""
    spots = [(10 * i, 10 * j) for i in range(5) for j in range(6)]
    seeds = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(spots)], "seed_id long, x int, y int")
    inner = {(x, y): k for k, (x, y) in enumerate(spots) if 0 < x < 40 and 0 < y < 50}
    rook = {(k, inner[x + dx, y + dy]) for (x, y), k in inner.items() for dx, dy in ((10, 0), (-10, 0), (0, 10), (0, -10)) if (x + dx, y + dy) in inner}
    assert {(r.src, r.dst) for r in regions.ridge_adjacency(regions.voronoi(seeds, (-30080.0, -30080.0, 30390.0, 30550.0))).collect()} == rook


def test_rim_cells_of_far_groups(spark):
    """Two grids far apart, and a lone seed: each cell is that among all seeds at once."""
    spots = [(x + 10 * i, y + 10 * j) for x, y in ((0, 0), (7000, 313)) for i in range(6) for j in range(7)] + [(3001, 5003)]
    seeds = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(spots)], "seed_id long, x int, y int")
    box = (-450000.0, -330000.0, 460000.0, 340000.0)
    want = {}
    for k, (x, y) in enumerate(spots):
        others = sorted(((i, *p) for i, p in enumerate(spots) if i != k), key=lambda o: (o[1] - x) ** 2 + (o[2] - y) ** 2)
        tags = {p[2] for p in regions._cell((x, y), others, box)}
        want[k] = (sorted(tags - {-1}), -1 not in tags)
    assert {r.seed_id: (r.neighbours, r.is_bounded) for r in regions.voronoi(seeds, box).collect()} == want
    assert sum(len(n) for n, _ in want.values()) == sum(k in want[i][0] for k in want for i in want[k][0])


def test_spacing_follows_long_chains_in_few_rounds(spark):
    """Ranks that run along a line: cell after cell hangs on the one before."""
    ranked = spark.range(1200).select(F.col("id").cast("int").alias("x"), F.lit(0).alias("y"), F.struct(F.lit(0.5).alias("s"), F.col("id").alias("k")).alias("rank"))
    assert sorted(r.x for r in sampling.spaced(ranked, 2, most_rounds=20).collect()) == list(range(0, 1200, 3))
    best = sampling.spaced(ranked, 2, count=7).orderBy("rank").limit(7).collect()
    assert [(r.x, r["rank"].s, r["rank"].k) for r in best] == [(3 * k, 0.5, 3 * k) for k in range(7)]


@pytest.mark.parametrize("metric", ["chebyshev", "euclidean"])
def test_spacing_across_tiles(spark, monkeypatch, metric):
    """Tiles of 12 give the sequential choice, whatever the order."""
    monkeypatch.setattr(sampling, "TILE", 12)
    rng = np.random.default_rng(3)
    spots = {(int(x), int(y)): (int(r), int(x) - int(y), int(x)) for x, y, r in zip(rng.integers(-20, 40, 1500), rng.integers(0, 45, 1500), rng.integers(0, 4, 1500), strict=True)}
    near = (lambda dx, dy: max(abs(dx), abs(dy)) <= 3) if metric == "chebyshev" else (lambda dx, dy: dx * dx + dy * dy <= 9)
    want = []
    for x, y in sorted(spots, key=spots.get):
        if not any(near(x - p, y - q) for p, q in want):
            want.append((x, y))
    ranked = spark.createDataFrame([(x, y, r) for (x, y), r in spots.items()], "x int, y int, rank struct<a: int, b: int, c: int>")
    assert {(r.x, r.y) for r in sampling.spaced(ranked, 3, metric).collect()} == set(want)
    assert [(r.x, r.y) for r in sampling.spaced(ranked, 3, metric, count=20).orderBy("rank").limit(20).collect()] == want[:20]


def joins_of(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("BroadcastHashJoin"), plan.count("SortMergeJoin")


def test_cells_of_patches_are_not_broadcast(spark, rough):
    """Rectangles are few bytes, their cells are not."""
    patches = spark.createDataFrame([(0, 0, 9, 7), (9, 0, 8, 7)], "x int, y int, w int, h int")
    assert joins_of(regions.describe_patches(rough, patches)) == (0, 1)


def test_pixels_of_edges_are_not_broadcast(spark, rough):
    seeds = spark.createDataFrame([(0, 1, 1), (1, 9, 5)], "seed_id long, x int, y int")
    pairs = spark.createDataFrame([(0, 1), (1, 0)], "src long, dst long")
    assert joins_of(graph.edges(pairs, seeds, rough))[0] == 0
