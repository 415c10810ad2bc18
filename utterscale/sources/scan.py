"""Parquet scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Scan one table, reading only ``columns``."""
    frame = spark.read.parquet(f"{folder}/{name}.parquet")
    return frame.select(*columns) if columns else frame


def spread(frame: DataFrame, key: str) -> DataFrame:
    """Give CPU-heavy work one task per core when the scan has fewer partitions.

    A scan of many files already has more partitions than cores and is returned
    as it is, so a large table never pays a shuffle here. ``key`` must be (nearly)
    unique: the rows are hashed on it and no partition gets hot.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    if frame.rdd.getNumPartitions() >= cores:
        return frame
    return frame.repartition(cores, key)
