"""Sinks: stage tables, path tables, JSON and CSV reports, keyed merges, computed once and kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def cached(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """The table at path, computed and written first if there is none."""
    if not exists(spark, f"{path}/_SUCCESS"):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_tables(path: str, **tables: DataFrame) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_tables(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def write_paths(points: DataFrame, path: str, map_key: str) -> None:
    points.withColumn("map", F.lit(map_key)).write.mode("overwrite").partitionBy("map").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def merge(spark: SparkSession, path: str, new: DataFrame, keys: list[str]) -> DataFrame:
    """Replaces the rows of a table that share new's keys, or creates it. Written beside the old table and renamed, so a
    lost job leaves the old one."""
    rows = spark.read.parquet(path).join(new, keys, "left_anti").unionByName(new) if exists(spark, path) else new
    rows.write.mode("overwrite").parquet(f"{path}.next")
    jvm = spark._jvm.org.apache.hadoop.fs.Path
    fs = jvm(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(jvm(path), True)
    fs.rename(jvm(f"{path}.next"), jvm(path))
    return spark.read.parquet(path)
