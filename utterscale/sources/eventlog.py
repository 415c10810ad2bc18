"""Structured event log: one JSON object per line, routed by level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEVELS = ["info", "error", "warning", "debug"]  # fixed values; anything else is "notset"


def route(level: Column) -> Column:
    return F.when(level.isin(LEVELS), level).otherwise("notset")


def log_lines(rows: DataFrame, event: Column, level: Column, fields: list[str]) -> DataFrame:
    """``level, line``: the event name first, then the given fields."""
    return rows.select(route(level).alias("level"),
                       F.to_json(F.struct(event.alias("event"), *fields)).alias("line"))


def append(lines: DataFrame, path: str) -> None:
    lines.write.mode("append").partitionBy("level").text(path)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``level`` and the members of every line."""
    raw = spark.read.option("lineSep", "\n").text(path)
    return raw.select("level", F.from_json("value", schema).alias("e")).select("level", "e.*")
