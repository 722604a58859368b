"""Rasters as tables of cells (x, y, elevation, landcover): x is the column, y the row."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: The derived raster of the driver's tables; the same text runs in DuckDB.
DIMS = "SELECT count(*) AS n, CAST(floor(sqrt(count(*) / 1.5)) AS BIGINT) AS w FROM orders"
CELLS = """SELECT x, y,
  CAST(300 + 5*abs(x % 24 - 12) + 4*abs(y % 30 - 15) + k % 5
       + CASE WHEN x % 40 = 20 AND y % 17 <> 3 THEN 40 ELSE 0 END AS INT) AS elevation,
  CAST(CASE WHEN k % 41 = 0 THEN 18
       ELSE 1 + (CAST(floor(x / 8) AS INT)*3 + CAST(floor(y / 10) AS INT)*5) % 19 END AS INT) AS landcover
  FROM (SELECT CAST(o_orderkey % w AS INT) AS x, CAST(floor(o_orderkey / w) AS INT) AS y, o_custkey AS k
        FROM orders CROSS JOIN (DIMS) WHERE o_orderkey < w * CAST(floor(n / w) AS BIGINT))""".replace("DIMS", DIMS)

#: Landcover classes 1 to 19 by name: fixed values.
CLASS_NAMES = (
    "Temperate or sub-polar needleleaf forest", "Sub-polar taiga needleleaf forest", "Tropical or sub-tropical broadleaf evergreen forest",
    "Tropical or sub-tropical broadleaf deciduous forest", "Temperate or sub-polar broadleaf deciduous forest", "Mixed forest",
    "Tropical or sub-tropical shrubland", "Temperate or sub-polar shrubland", "Tropical or sub-tropical grassland",
    "Temperate or sub-polar grassland", "Sub-polar or polar shrubland-lichen-moss", "Sub-polar or polar grassland-lichen-moss",
    "Sub-polar or polar barren-lichen-moss", "Wetland", "Cropland", "Barren land", "Urban and built-up", "Water", "Snow and ice",
)


def load_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived raster of a folder of driver tables; the one-row dimensions are the only broadcast side."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return spark.sql(CELLS.replace("FROM orders", "FROM {orders}"), orders=orders)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """A stored table of cells."""
    return spark.read.parquet(path).select("x", "y", "elevation", "landcover")


def with_obstacles(cells: DataFrame, threshold: float = 400) -> DataFrame:
    return cells.withColumn("obstacle", F.col("elevation") > threshold)


def classes(spark: SparkSession) -> DataFrame:
    """(landcover, name): 19 rows."""
    return spark.createDataFrame([(i + 1, x) for i, x in enumerate(CLASS_NAMES)], "landcover int, name string")


def extent(cells: DataFrame) -> DataFrame:
    """(width, height): one row."""
    return cells.agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


def size(cells: DataFrame) -> tuple[int, int]:
    row = extent(cells).first()
    return (row["width"] or 0, row["height"] or 0)


def grid(spark: SparkSession, width: int, height: int) -> DataFrame:
    """(x, y) of every cell, generated in parallel."""
    return spark.range(width * height).select((F.col("id") % width).cast("int").alias("x"), F.floor(F.col("id") / width).cast("int").alias("y"))


class _Rows(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class _ArrayReader(DataSourceReader):
    def __init__(self, options: dict):
        self.elevation, self.landcover, self.rows = options["elevation"], options["landcover"], int(options.get("rows", 256))

    def _arrays(self) -> tuple[np.ndarray, np.ndarray]:
        a, b = (np.load(p, mmap_mode="r", allow_pickle=False) for p in (self.elevation, self.landcover))
        if a.ndim != 2 or a.shape != b.shape:
            raise ValueError("elevation and landcover must be 2-D arrays of one shape")
        return a, b

    def partitions(self) -> list[_Rows]:
        height = self._arrays()[0].shape[0]
        return [_Rows(y, min(y + self.rows, height)) for y in range(0, height, self.rows)]

    def read(self, partition: _Rows):
        elevation, landcover = self._arrays()
        ys, xs = np.mgrid[partition.first : partition.last, 0 : elevation.shape[1]]
        z, c = elevation[partition.first : partition.last], landcover[partition.first : partition.last]
        yield pa.RecordBatch.from_arrays([pa.array(xs.ravel(), pa.int32()), pa.array(ys.ravel(), pa.int32()), pa.array(np.asarray(z, float).ravel()), pa.array(np.asarray(c).ravel().astype(np.int32))], names=["x", "y", "elevation", "landcover"])


class ArrayRaster(DataSource):
    """format("array_raster"): two .npy files of one shape (options elevation, landcover), read by bands of rows. Pickles
    are not read: they can run code."""

    @classmethod
    def name(cls) -> str:
        return "array_raster"

    def schema(self) -> str:
        return "x int, y int, elevation double, landcover int"

    def reader(self, schema) -> DataSourceReader:
        return _ArrayReader(self.options)


def read_arrays(spark: SparkSession, elevation: str, landcover: str) -> DataFrame:
    spark.dataSource.register(ArrayRaster)
    return spark.read.format("array_raster").option("elevation", elevation).option("landcover", landcover).load()


def read_geotiffs(spark: SparkSession, elevation: str, landcover: str) -> DataFrame:
    """Band 1 of two GeoTIFFs of one shape. Needs rasterio, which is optional."""
    import rasterio

    def rows(kind: str, path: str) -> DataFrame:
        def decode(batches):
            for batch in batches:
                for content in batch.column(0).to_pylist():
                    with rasterio.MemoryFile(content) as held, held.open() as source:
                        band = source.read(1)
                    ys, xs = np.mgrid[0 : band.shape[0], 0 : band.shape[1]]
                    yield pa.RecordBatch.from_arrays([pa.array(xs.ravel(), pa.int32()), pa.array(ys.ravel(), pa.int32()), pa.array(np.asarray(band, float).ravel())], names=["x", "y", kind])

        return spark.read.format("binaryFile").load(path).select("content").mapInArrow(decode, f"x int, y int, {kind} double")

    return rows("elevation", elevation).join(rows("landcover", landcover), ["x", "y"]).withColumn("landcover", F.col("landcover").cast("int"))


@dataclass(frozen=True)
class Profile:
    """A map's settings: seed budget, spacing, boundary emphasis, waypoints."""

    key: str
    budget: int
    min_area: int
    alpha: float
    waypoints: tuple[tuple[int, int], ...]


#: The published settings of three maps: fixed values.
PROFILES = {
    "W": Profile("W", 31_440, 2, 0.0, ((99, 262), (98, 9), (327, 93), (26, 192), (140, 22), (99, 260), (304, 106), (92, 11), (63, 202), (318, 100), (59, 200))),
    "H": Profile("H", 156_004, 4, 0.7, ((1408, 1319), (898, 99), (188, 113), (1440, 398), (1553, 1202), (1354, 239), (1237, 1459), (834, 375), (53, 131), (1630, 1541), (1594, 398))),
    "R": Profile("R", 218_074, 4, 0.7, ((2404, 170), (693, 1400), (2255, 2015), (2029, 432), (3090, 1860), (2178, 319), (495, 234), (778, 1839), (2305, 92), (608, 2397), (608, 403))),
}


def path_queries(spark: SparkSession, waypoints: list[tuple[int, int]] | tuple) -> DataFrame:
    """(query_id, sx, sy, gx, gy): each leg of the waypoints forward, then of the way back."""
    points = spark.createDataFrame([(list(map(list, waypoints)),)], "there array<array<int>>")
    whole = F.concat("there", F.slice(F.reverse("there"), 2, len(waypoints)))
    legs = points.select(F.posexplode(whole).alias("query_id", "p"))
    ahead = legs.withColumn("q", F.lead("p").over(W.orderBy("query_id"))).where("q IS NOT NULL")  # one row a waypoint
    return ahead.select("query_id", F.col("p")[0].alias("sx"), F.col("p")[1].alias("sy"), F.col("q")[0].alias("gx"), F.col("q")[1].alias("gy"))


def pixel_to_world(x, y, transform: tuple[float, float, float, float, float, float]):
    """World coordinates of pixels by an affine transform (a, b, c, d, e, f)."""
    a, b, c, d, e, f = transform
    return a * x + b * y + c, d * x + e * y + f


def parse_point(text: str) -> tuple[int, int]:
    x, y = text.split(",")
    return int(x), int(y)


def parse_selection(text: str, n: int = 20) -> list[int]:
    """Query numbers of "all" or one number from 0 to n - 1."""
    if text == "all":
        return list(range(n))
    if not 0 <= int(text) < n:
        raise ValueError(f"query must be all or 0 to {n - 1}")
    return [int(text)]
