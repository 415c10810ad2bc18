"""Evaluation history: numbering, best so far, retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from utterscale.operators.ordering import range_buckets, running

PARTS = 64  # pieces of a group that are ranked on their own
START = 1.0  # fixed value: a word error rate must be below this to count as best


def best_so_far(evals: DataFrame, order: Sequence[str], run: str = "run", score: str = "wer", start: float = START) -> DataFrame:
    """Adds ``eval_nr`` from 1, ``best_before`` and ``saved`` (strictly better).

    ``order`` must be unique. The history is cut into even ranges, so one run that
    holds most of it is tracked by many tasks.
    """
    ranged = range_buckets(evals, order)
    tracked = running(ranged, [run], order, F.col("_range"), ordinal="eval_nr",
                      minimum=(score, "_earlier")).drop("_range")
    best = F.least(F.lit(start), F.coalesce("_earlier", F.lit(start)))
    return tracked.withColumn("best_before", best).drop("_earlier").withColumn(
        "saved", F.col(score) < F.col("best_before"))


def retain_last(rows: DataFrame, by: Sequence[str], newest_first: Sequence[str | Column], k: int = 2,
                parts: int = PARTS) -> DataFrame:
    """The last ``k`` rows per group; ``newest_first`` must be unique.

    Every group is cut into ``parts`` by a hash of its row. The parts give their first ``k``
    rows each, and only those meet by group: a task ranks a part of a hot group, never all
    of it, and the second step sees ``parts * k`` rows of a group at most.
    """
    salted = rows.withColumn("_part", F.pmod(F.xxhash64(*rows.columns), F.lit(parts)))
    inner, outer = Window.partitionBy(*by, "_part").orderBy(*newest_first), Window.partitionBy(*by).orderBy(*newest_first)
    survivors = salted.withColumn("_rank", F.row_number().over(inner)).where(F.col("_rank") <= k)
    return survivors.withColumn("_rank", F.row_number().over(outer)).where(F.col("_rank") <= k).drop("_rank", "_part")


def every_n_steps(rows: DataFrame, step: str, n: int) -> DataFrame:
    return rows.where(F.col(step) % n == 0)
