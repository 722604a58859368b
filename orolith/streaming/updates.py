"""Streaming upkeep of a raster: an extension for cells that arrive over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import sinks


def latest(updates: DataFrame) -> DataFrame:
    """Of updates (x, y, elevation, landcover, ts), the last of each cell."""
    return updates.groupBy("x", "y").agg(F.max_by(F.struct("elevation", "landcover"), "ts").alias("v")).select("x", "y", "v.elevation", "v.landcover")


def tile_counts(updates: DataFrame, tile: int = 64, late: str = "10 minutes", every: str = "5 minutes") -> DataFrame:
    """Updates a tile and window, with late rows up to a watermark."""
    return updates.withWatermark("ts", late).groupBy(F.window("ts", every), F.floor(F.col("x") / tile).alias("tx"), F.floor(F.col("y") / tile).alias("ty")).agg(F.count("*").alias("n"), F.avg("elevation").alias("mean_elevation"))


def keep(updates: DataFrame, path: str, checkpoint: str):
    """Starts a query that merges each batch's last updates into a table of cells."""

    def merge(batch: DataFrame, _: int) -> None:
        sinks.merge(batch.sparkSession, path, latest(batch), ["x", "y"])

    return updates.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).start()
