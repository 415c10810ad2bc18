"""The pair table: one hypothesis and one reference per system and utterance."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pair(hyps: DataFrame, refs: DataFrame, on: str = "utt_id") -> DataFrame:
    """Pair by key. Utterances without a partner are left out (see ``coverage``)."""
    return hyps.join(refs, on, "inner")


def coverage(hyps: DataFrame, refs: DataFrame, on: str = "utt_id", system: str = "system") -> DataFrame:
    """Per system: paired, references without a hypothesis, hypotheses without a reference.

    Each side brings its key once per row; the counts come from one aggregation over
    the union, so no system needs its own join.
    """
    marks = (hyps.select(F.col(on).alias("_k"), F.col(system).alias("_s"), F.lit(0).alias("_r"))
             .unionByName(refs.select(F.col(on).alias("_k"), F.lit(None).cast("string").alias("_s"),
                                      F.lit(1).alias("_r"))))
    per_utt = marks.groupBy("_k").agg(F.max("_r").alias("has_ref"), F.collect_set("_s").alias("systems"))
    by_system = (per_utt.select("has_ref", F.explode("systems").alias(system))
                 .groupBy(system).agg(F.sum("has_ref").alias("paired"),
                                      F.sum(1 - F.col("has_ref")).alias("hyps_without_ref")))
    total = refs.agg(F.count("*")).scalar()
    return by_system.withColumn("refs_without_hyp", total - F.col("paired"))


def prepare(pairs: DataFrame, preprocessor: Callable[[Column], Column] | None = None,
            drop_empty_refs: bool = False) -> DataFrame:
    """Apply one preprocessor to both sides, then leave out pairs without a reference."""
    if preprocessor:
        pairs = pairs.withColumns({"ref": preprocessor(F.col("ref")), "hyp": preprocessor(F.col("hyp"))})
    pairs = pairs.where(F.col("ref").isNotNull()).withColumn("hyp", F.coalesce("hyp", F.lit("")))
    if drop_empty_refs:
        pairs = pairs.where(F.col("ref") != "")
    return pairs
