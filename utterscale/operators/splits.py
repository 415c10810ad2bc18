"""Splits and folds over groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fold maps, split -> group ids.
PRODUCTION_FOLDS = {
    "train": ["1", "2", "3", "4", "7", "8", "9", "10", "12", "13", "14", "15", "16", "17", "18"],
    "test": ["5", "11"],
    "eval": ["6", "19", "20", "21"],
}
# Cross-validation folds over groups 0..10.
KFOLDS = [[0, 1, 2], [3, 4, 5], [6, 7, 8], [9, 10]]


def _local(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A parameter table whose size the optimizer knows, so it may choose to broadcast it."""
    return spark.createDataFrame(pa.Table.from_pylist(rows), schema)


def fold_table(spark: SparkSession, folds: Mapping[str, Sequence[str]]) -> DataFrame:
    """``group_id, split``; a group named in two splits has two rows."""
    rows = [{"group_id": g, "split": s} for s, groups in folds.items() for g in groups]
    return _local(spark, rows, "group_id string, split string")


def assign_split(rows: DataFrame, folds: DataFrame, group: str = "group_id") -> DataFrame:
    """Adds ``split`` (null without one). The lookup is a plain join: its size decides
    whether Spark broadcasts it."""
    return rows.join(folds.withColumnRenamed("group_id", group), group, "left")


def leakage(rows: DataFrame, folds: DataFrame, group: str = "group_id") -> DataFrame:
    """Groups of ``rows`` that are in several splits or in none, with their row count."""
    used = rows.groupBy(group).agg(F.count("*").alias("n_rows"))
    splits = folds.groupBy("group_id").agg(F.countDistinct("split").alias("n_splits"))
    joined = used.join(splits.withColumnRenamed("group_id", group), group, "left")
    return joined.withColumn("n_splits", F.coalesce("n_splits", F.lit(0))).where(F.col("n_splits") != 1)


def kfold_roles(rows: DataFrame, group: Column, folds: Sequence[Sequence[int]] = KFOLDS) -> DataFrame:
    """One row per row and fold: ``eval`` if its group is in the fold, else ``train``."""
    roles = F.array(*[F.struct(F.lit(k).alias("fold"),
                               F.when(group.isin(list(fold)), "eval").otherwise("train").alias("role"))
                      for k, fold in enumerate(folds)])
    return rows.select("*", F.inline(roles).alias("fold", "role"))


def kfold_train_groups(spark: SparkSession, groups: DataFrame, folds: Sequence[Sequence[int]] = KFOLDS) -> DataFrame:
    """Training groups of every fold: all groups without those of the fold."""
    members = _local(spark, [{"fold": k, "group_id": g} for k, fold in enumerate(folds) for g in fold],
                     "fold int, group_id bigint")
    everything = groups.select("group_id", F.explode(F.array(*[F.lit(k) for k in range(len(folds))])).alias("fold"))
    return everything.join(members, ["fold", "group_id"], "left_anti")
