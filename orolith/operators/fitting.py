"""Elevation abstraction: planes and quadratic surfaces per region, region attributes, reconstruction."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.costs import SCALE


def plane_moments(membership: DataFrame, key: str = "region_id", scale: float = SCALE) -> DataFrame:
    """(key, n, a, b, d, rmse): the least-squares plane z = a X + b Y + d of each region, x and y in metres, from sums
    alone (partial aggregates). Regions on a line or point have a = b = 0 and their mean, unless one axis varies."""
    x, y, z = (F.col(c).cast("double") for c in ("x", "y", "elevation"))
    s = membership.groupBy(key).agg(F.count("*").alias("n"), *[F.sum(v).alias(k) for k, v in {"sx": x, "sy": y, "sz": z, "sxx": x * x, "syy": y * y, "sxy": x * y, "sxz": x * z, "syz": y * z, "szz": z * z}.items()])
    n = F.col("n")
    centred = lambda p, q, pq: F.col(pq) - F.col(p) * F.col(q) / n
    s = s.withColumns({"cxx": centred("sx", "sx", "sxx"), "cyy": centred("sy", "sy", "syy"), "cxy": centred("sx", "sy", "sxy"), "cxz": centred("sx", "sz", "sxz"), "cyz": centred("sy", "sz", "syz"), "czz": centred("sz", "sz", "szz")})
    s = s.withColumn("det", F.col("cxx") * F.col("cyy") - F.col("cxy") ** 2)
    whole = F.col("det") > 1e-9
    det = F.nullif(F.col("det"), F.lit(0.0))
    line = F.col("cxx") + F.col("cyy")
    along = (F.col("cxz") + F.col("cyz")) * 0 + F.when(line > 0, 1.0).otherwise(0.0)
    a = F.when(whole, (F.col("cyy") * F.col("cxz") - F.col("cxy") * F.col("cyz")) / det).when(along > 0, F.col("cxz") / F.nullif(line, F.lit(0.0))).otherwise(0.0)
    b = F.when(whole, (F.col("cxx") * F.col("cyz") - F.col("cxy") * F.col("cxz")) / det).when(along > 0, F.col("cyz") / F.nullif(line, F.lit(0.0))).otherwise(0.0)
    s = s.withColumns({"a1": a, "b1": b})
    sse = F.col("czz") - F.col("a1") * F.col("cxz") - F.col("b1") * F.col("cyz")
    return s.select(key, "n", (F.col("a1") / scale).alias("a"), (F.col("b1") / scale).alias("b"), ((F.col("sz") - F.col("a1") * F.col("sx") - F.col("b1") * F.col("sy")) / n).alias("d"), F.sqrt(F.greatest(F.lit(0.0), sse) / n).alias("rmse"))


def grade_direction(planes: DataFrame) -> DataFrame:
    """planes with grade in per cent and the downslope direction in degrees."""
    a, b = F.col("a"), F.col("b")
    return planes.withColumn("grade", 100 * F.sqrt(a**2 + b**2)).withColumn("direction", F.pmod(F.degrees(F.atan2(-a, -b)) + 360, F.lit(360.0)))


def _hull(points: np.ndarray) -> np.ndarray:
    """Monotone-chain convex hull."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points

    def half(rows) -> list:
        out: list = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    low, high = half(points), half(points[::-1])
    return np.array(low[:-1] + high[:-1])


def split_planes(x: np.ndarray, y: np.ndarray, z: np.ndarray, labels: np.ndarray, tolerance: float = 10.0, scale: float = SCALE, margin: float = 0.08, most: int | None = None) -> list[tuple]:
    """[(a, b, c, d, rmse, hull, label, n)]: planes fitted to a point set, split at the medians into four overlapping
    parts until the error is within tolerance, three points are left or the extent is under 3 pixels. Parts of fewer than
    three points are flat, one plane a point. A part as large as its parent ends the split: it could not settle."""
    out: list[tuple] = []
    queue = [np.arange(len(z))]
    while queue:
        own = queue.pop()
        n = len(own)
        if n < 3:
            out += [(0.0, 0.0, -1.0, float(z[i]), 0.0, [(float(x[i]), float(y[i]))], int(labels[i]), 1) for i in own]
            continue
        px, py, pz = x[own].astype(float), y[own].astype(float), z[own].astype(float)
        basis = np.stack([px * scale, py * scale, np.ones(n)], 1)
        (a, b, d), *_ = np.linalg.lstsq(basis, pz, rcond=None)
        rmse = float(np.sqrt(np.mean((basis @ np.array([a, b, d]) - pz) ** 2)))
        small = np.ptp(px) < 3 and np.ptp(py) < 3
        parts: list[np.ndarray] = []
        if rmse > tolerance and n > 3 and not small and (most is None or len(out) + len(queue) + 4 <= most):
            mx, my = np.median(px), np.median(py)
            left, right, up, down = px <= mx + margin, px >= mx - margin, py <= my + margin, py >= my - margin
            parts = [own[m] for m in (left & up, right & up, left & down, right & down) if m.any()]
        if parts and max(map(len, parts)) < n:
            queue += parts
            continue
        hull = _hull(np.stack([px, py], 1))
        values, counts = np.unique(labels[own], return_counts=True)
        out.append((float(a), float(b), -1.0, float(d), rmse, [(float(p), float(q)) for p, q in hull], int(values[counts.argmax()]), n))
    return out


PATCHES = "region_id long, patch_id int, a double, b double, c double, d double, rmse double, polygon array<struct<x: double, y: double>>, landcover int, n long"


def fit_patches(membership: DataFrame, tolerance: float = 10.0, scale: float = SCALE, most: int | None = None) -> DataFrame:
    """Plane patches of each region: split_planes by region, one group a region."""

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["y", "x"])
        found = split_planes(*(group[c].to_numpy() for c in ("x", "y", "elevation", "landcover")), tolerance, scale, most=most)
        region = int(group["region_id"].iloc[0])
        rows = [(region, i, a, b, c, d, e, [{"x": p, "y": q} for p, q in hull], lc, n) for i, (a, b, c, d, e, hull, lc, n) in enumerate(found)]
        return pd.DataFrame(rows, columns=["region_id", "patch_id", "a", "b", "c", "d", "rmse", "polygon", "landcover", "n"])

    return membership.groupBy("region_id").applyInPandas(fit, PATCHES)


def fit_surfaces(membership: DataFrame) -> DataFrame:
    """(region_id, coefficients, mse, n): the least-squares surface a x² + b y² + c x y + d x + e y + f in pixels; regions
    of fewer than three cells have none."""

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["y", "x"])
        x, y, z = (group[c].to_numpy(float) for c in ("x", "y", "elevation"))
        if len(z) < 3:
            return pd.DataFrame([], columns=["region_id", "coefficients", "mse", "n"])
        ox, oy = x.mean(), y.mean()
        u, v = x - ox, y - oy
        basis = np.stack([u * u, v * v, u * v, u, v, np.ones(len(z))], 1)
        (a, b, c, d, e, f), *_ = np.linalg.lstsq(basis, z, rcond=None)
        mse = float(np.mean((basis @ np.array([a, b, c, d, e, f]) - z) ** 2))
        moved = [a, b, c, d - 2 * a * ox - c * oy, e - 2 * b * oy - c * ox, f + a * ox * ox + b * oy * oy + c * ox * oy - d * ox - e * oy]
        return pd.DataFrame([(int(group["region_id"].iloc[0]), [float(k) for k in moved], mse, len(z))], columns=["region_id", "coefficients", "mse", "n"])

    return membership.groupBy("region_id").applyInPandas(fit, "region_id long, coefficients array<double>, mse double, n long")


def surface_z(coefficients: Column, x: Column, y: Column) -> Column:
    a, b, c, d, e, f = (F.get(coefficients, i) for i in range(6))
    return a * x * x + b * y * y + c * x * y + d * x + e * y + f


def plane_z(a: Column, b: Column, c: Column, d: Column, x: Column, y: Column) -> Column:
    """z of the plane a x + b y + c z + d = 0 (x, y in metres); a vertical plane is an error."""
    return F.when(F.abs(c) < 1e-8, F.raise_error(F.lit("a vertical plane has no elevation"))).otherwise(-(a * x + b * y + d) / c)


def region_attributes(membership: DataFrame) -> DataFrame:
    """Per region: mean elevation, least and greatest with their first places in row-major order, most frequent class
    (least on ties), size, greatest distance to the mean place and from the mean elevation."""
    z = F.col("elevation").cast("double")
    place = F.struct("y", "x")
    first = membership.groupBy("region_id").agg(
        F.avg(z).alias("mean_elevation"), F.min(F.struct(z.alias("z"), F.col("y"), F.col("x"))).alias("low"), F.max(F.struct(z.alias("z"), (-F.col("y")).alias("y"), (-F.col("x")).alias("x"))).alias("high"),
        F.mode("landcover", True).alias("landcover"), F.count("*").alias("region_size"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.min(place).alias("first"),
    )
    far = membership.join(first.select("region_id", "mx", "my", F.col("mean_elevation").alias("mz")), "region_id").groupBy("region_id").agg(F.max(F.sqrt((F.col("x") - F.col("mx")) ** 2 + (F.col("y") - F.col("my")) ** 2)).alias("max_distance"), F.max(F.abs(z - F.col("mz"))).alias("max_z_distance"))
    return first.join(far, "region_id").select(
        "region_id", "mean_elevation", F.col("low.z").alias("min_elevation"), F.col("low.x").alias("min_x"), F.col("low.y").alias("min_y"),
        F.col("high.z").alias("max_elevation"), (-F.col("high.x")).alias("max_x"), (-F.col("high.y")).alias("max_y"), "landcover", "region_size", "max_distance", "max_z_distance",
    )


def class_points(membership: DataFrame) -> DataFrame:
    """(region_id, points): for each class of a region its first cell in row-major order, as a map class -> (x, y, z)."""
    first = membership.groupBy("region_id", "landcover").agg(F.min(F.struct("y", "x", F.col("elevation").cast("double").alias("z"))).alias("p"))
    entry = F.struct("landcover", F.struct(F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.col("p.z").alias("z")).alias("v"))
    return first.groupBy("region_id").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("points"))


def reconstruct(membership: DataFrame, patches: DataFrame, scale: float = SCALE, radius: float = 0.71, last: bool = True) -> DataFrame:
    """membership with z_fit, landcover_fit and patch_id: the last (or first) patch of the region that covers each cell;
    null where none does."""
    from .regions import polygon_cells

    keyed = patches.withColumn("key", F.col("region_id") * 1_000_000 + F.col("patch_id"))
    covered = polygon_cells(keyed, "key", radius).join(keyed.select("key", "region_id", "patch_id", "a", "b", "c", "d", F.col("landcover").alias("lc_fit")), "key")
    value = F.struct("patch_id", "lc_fit", plane_z(F.col("a"), F.col("b"), F.col("c"), F.col("d"), F.col("x") * scale, F.col("y") * scale).alias("z"))
    best = covered.groupBy("region_id", "x", "y").agg((F.max_by if last else F.min_by)(value, F.col("patch_id")).alias("v"))
    return membership.join(best, ["region_id", "x", "y"], "left").select("region_id", "x", "y", "elevation", "landcover", F.col("v.z").alias("z_fit"), F.col("v.lc_fit").alias("landcover_fit"), F.col("v.patch_id").alias("patch_id"))


def loss_table(rebuilt: DataFrame, patches: DataFrame) -> DataFrame:
    """(region_id, elevation_rmse, elevation_std, elevation_max_residual, plane_count): residuals per region."""
    r = F.col("elevation") - F.col("z_fit")
    counts = patches.groupBy("region_id").agg(F.count("*").alias("plane_count"))
    return rebuilt.groupBy("region_id").agg(F.sqrt(F.avg(r * r)).alias("elevation_rmse"), F.var_pop(r).alias("elevation_std"), F.max(F.abs(r)).alias("elevation_max_residual")).join(counts, "region_id")


def error_map(rebuilt: DataFrame) -> DataFrame:
    """rebuilt with abs_error and class_differs, as the plots take them; uncovered cells have no error."""
    return rebuilt.withColumn("abs_error", F.abs(F.col("elevation") - F.col("z_fit"))).withColumn("class_differs", F.col("landcover") != F.coalesce("landcover_fit", F.lit(-1)))


def error_range(rebuilt: DataFrame) -> DataFrame:
    e = F.coalesce(F.abs(F.col("elevation") - F.col("z_fit")), F.lit(0.0))
    return rebuilt.agg(F.min(e).alias("least"), F.max(e).alias("most"))


def accuracy(labelled: DataFrame, fill: int = -1) -> DataFrame:
    """One row: the share of cells whose class is rebuilt. Uncovered cells count as fill; cells at -1 are left out."""
    return labelled.withColumn("p", F.coalesce("landcover_fit", F.lit(fill))).where("p <> -1").agg(F.avg((F.col("landcover") == F.col("p")).cast("double")).alias("accuracy"), F.count("*").alias("cells"))


def confusion(labelled: DataFrame, fill: int = -1) -> DataFrame:
    return labelled.select(F.col("landcover").alias("truth"), F.coalesce("landcover_fit", F.lit(fill)).alias("predicted")).where("predicted <> -1").groupBy("truth", "predicted").agg(F.count("*").alias("n"))


def mean_iou(labelled: DataFrame, fill: int = -1) -> DataFrame:
    """One row: the mean over classes of intersection over union, 0 if there are none."""
    pairs = labelled.select(F.col("landcover").alias("t"), F.coalesce("landcover_fit", F.lit(fill)).alias("p"))
    each = pairs.select(F.explode(F.array_distinct(F.array("t", "p"))).alias("c"), (F.col("t") == F.col("p")).cast("int").alias("both")).where("c <> -1")
    per = each.groupBy("c").agg((F.sum("both") / F.count("*")).alias("iou"))
    return per.agg(F.coalesce(F.avg("iou"), F.lit(0.0)).alias("mean_iou"))


def coverage(rebuilt: DataFrame) -> DataFrame:
    """(region_id, coverage in per cent, point_bytes): 24 bytes a point."""
    return rebuilt.groupBy("region_id").agg((100.0 * F.count("z_fit") / F.count("*")).alias("coverage"), (F.count("*") * 24).alias("point_bytes"))
