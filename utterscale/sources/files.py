"""File listings and whole-file text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterscale.functions.text import file_name, file_stem


def _glob(formats: Sequence[str]) -> str:
    return "*.{" + ",".join(formats) + "}"


def list_files(spark: SparkSession, folder: str, formats: Sequence[str] = ("txt",)) -> DataFrame:
    """``path, name, stem, format, format_order, length`` below a folder, at any depth.

    Only names and sizes are selected, so no file is opened.
    """
    found = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", _glob(formats)).load(folder).select("path", "length"))
    path = F.regexp_replace("path", "^file:/+", "/")
    ext = F.regexp_extract(path, r"\.([^./]+)$", 1)
    order = F.array_position(F.array(*[F.lit(f) for f in formats]), ext)
    return found.select(path.alias("path"), file_name(path).alias("name"), file_stem(path).alias("stem"),
                        ext.alias("format"), order.alias("format_order"), "length")


def read_lines(spark: SparkSession, folder: str, formats: Sequence[str] = ("txt",)) -> DataFrame:
    """``path, line`` of every matching file; large files are split between tasks."""
    lines = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", _glob(formats))
             .option("lineSep", "\n").text(folder))
    return lines.select(F.regexp_replace("_metadata.file_path", "^file:/+", "/").alias("path"),
                        F.col("value").alias("line"))


def read_texts(spark: SparkSession, folder: str, formats: Sequence[str] = ("txt",)) -> DataFrame:
    """``path, text``: one row per file."""
    texts = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", _glob(formats))
             .text(folder, wholetext=True))
    return texts.select(F.regexp_replace("_metadata.file_path", "^file:/+", "/").alias("path"),
                        F.col("value").alias("text"))
