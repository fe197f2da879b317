"""Index tables: levels, stars and quads as Parquet, laid out for pruning."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyquilt.operators.grid import RingGrid


def write_index(path: str, stars: DataFrame, grids: list[RingGrid], quads: DataFrame | None = None) -> None:
    """Stars by level and sorted by cell, so that a cone reads few row groups; quads clustered by code."""
    spark = stars.sparkSession
    levels = spark.createDataFrame([(k, g.cell_size, g.cells) for k, g in enumerate(grids)], "level int, cell_size double, cells int")
    levels.coalesce(1).write.mode("overwrite").parquet(f"{path}/levels")
    stars.repartitionByRange("level", "cell").sortWithinPartitions("level", "cell", "rn").write.mode("overwrite").partitionBy("level").parquet(f"{path}/stars")
    if quads is not None:
        quads.repartitionByRange("cx", "cy").sortWithinPartitions("cx", "cy", "dx", "dy").write.mode("overwrite").parquet(f"{path}/quads")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, list[RingGrid], DataFrame]:
    """Stars, grids of the levels and quads of a written index."""
    grids = [RingGrid(r.cell_size) for r in spark.read.parquet(f"{path}/levels").orderBy("level").collect()]
    return spark.read.parquet(f"{path}/stars"), grids, spark.read.parquet(f"{path}/quads")


def manifest(files: DataFrame) -> DataFrame:
    """``path, size, sha256`` of files read by the binary source."""
    return files.select("path", F.length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))


def verified(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Parts of a manifest (``path, size, sha256``) that are missing or differ."""
    got = manifest(files).select(F.col("path").alias("__p"), F.col("size").alias("__s"), F.col("sha256").alias("__h"))
    return expected.join(got, (F.col("path") == F.col("__p")) & (F.col("size") == F.col("__s")) & (F.col("sha256") == F.col("__h")), "left_anti")


