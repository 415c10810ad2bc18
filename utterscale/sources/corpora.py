"""Corpora and prepared datasets on disk."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def concat(corpora: Mapping[str, DataFrame]) -> DataFrame:
    """All corpora in one frame with their name as ``corpus``; missing columns are null."""
    named = [frame.withColumn("corpus", F.lit(name)) for name, frame in corpora.items()]
    out = named[0]
    for frame in named[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def save_dataset(rows: DataFrame, path: str) -> None:
    """One folder per split, so that a split is read without touching the others."""
    rows.write.mode("overwrite").partitionBy("split").parquet(path)


def load_dataset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def load_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    return load_dataset(spark, path).where(F.col("split") == split)


def _plain_path(path: Column) -> Column:
    """A path as listings and rows both name it."""
    return F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "^file:/+", "/")


def _published(spark: SparkSession, cache: str) -> DataFrame:
    """``key, part`` of every file that was prepared."""
    schema = "key string, part string"
    try:
        return spark.read.schema(schema).parquet(f"{cache}/published")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def prepared_files(spark: SparkSession, cache: str, folder: str, settings: Mapping, prepare: Callable[[DataFrame], DataFrame],
                   pattern: str = "*.parquet") -> tuple[DataFrame, int]:
    """The files below ``folder``, each prepared once: the rows, and how many files this call prepared.

    A file is known by its path, length and time, and by the settings. Files that no earlier
    call prepared go through ``prepare`` (row by row, since it never sees all files) into a part of
    the cache; the part counts only when its keys are published, in one commit after the rows
    are written, so a call that fails leaves nothing behind that is read. Rows of files that
    changed or went are not read again. With nothing new, no file is opened.
    """
    cache = cache.rstrip("/")
    name = hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()
    listed = (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
              .select("path", F.sha2(F.concat_ws("|", F.lit(name), "path", "length", "modificationTime"), 256).alias("key")))
    wanted = [(r["path"], r["key"]) for r in listed.collect()]  # one row per file, as Spark's own listing holds it
    known = {r["key"] for r in _published(spark, cache).select("key").collect()}
    fresh = [(path, key) for path, key in wanted if key not in known]
    if fresh:
        part = f"{cache}/parts/{uuid.uuid4().hex}"
        keys = spark.createDataFrame(fresh, "_path string, _key string").select(_plain_path(F.col("_path")).alias("_path"), "_key")
        rows = spark.read.parquet(*[path for path, _ in fresh])
        marked = rows.withColumn("_path", _plain_path(F.col("_metadata.file_path"))).join(keys, "_path").drop("_path")
        prepare(marked).write.partitionBy("_key").parquet(part)
        published = spark.createDataFrame([(key, part) for _, key in fresh], "key string, part string")
        published.coalesce(1).write.mode("append").parquet(f"{cache}/published")
    use = spark.createDataFrame([(key,) for _, key in wanted], "key string")
    # a key that two calls prepared at the same time is read from one of the parts
    parts = _published(spark, cache).join(use, "key", "left_semi").groupBy("key").agg(F.min("part").alias("part")).collect()
    # partition pruning: only the folders of these keys are read
    frames = [spark.read.option("basePath", part).parquet(part).where(F.col("_key").isin(sorted(r["key"] for r in parts if r["part"] == part)))
              for part in sorted({r["part"] for r in parts})]
    if not frames:
        return prepare(spark.read.parquet(folder).withColumn("_key", F.lit("")).limit(0)).drop("_key"), 0
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out.drop("_key"), len(fresh)


def _finished(spark: SparkSession, path: str) -> bool:
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)


def prepared(spark: SparkSession, cache: str, settings: Mapping, build: Callable[[], DataFrame]) -> DataFrame:
    """The result of ``build`` for these settings, computed once and then read back."""
    key = hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()[:16]
    path = f"{cache.rstrip('/')}/{key}"
    if not _finished(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
