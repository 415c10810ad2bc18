"""Length-grouped batches and padding.

The batch plan is a narrow table (id, lengths, batch): signals are not shuffled until
one join brings them to their batch, and then padding is row-local.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from utterscale.functions import arrays
from utterscale.operators.ordering import seeded_shuffle

MEGABATCHES = 50  # fixed value: batches sorted together at most


def megabatch_size(rows: Column, batch_size: int) -> Column:
    """Rows sorted together: fewer batches when there is little data, at least one."""
    return F.greatest(F.least(F.floor(rows / F.lit(batch_size * 4)), F.lit(MEGABATCHES)), F.lit(1)) * batch_size


def length_batches(rows: DataFrame, row_id: str, length: str, batch_size: int, seed: int,
                   carry: Sequence[str] = ()) -> DataFrame:
    """``row_id, length, carry, position, batch_id``: shuffle, cut into megabatches, sort
    each by length descending, swap the longest row to the front, cut into batches."""
    narrow = rows.select(row_id, length, *carry)
    shuffled = seeded_shuffle(narrow, row_id, seed, "_ordinal", "_total").withColumn(
        "_size", megabatch_size(F.col("_total"), batch_size)).withColumn(
        "_mega", F.floor(F.col("_ordinal") / F.col("_size")))
    # the first megabatch with a row of greatest length gives its first row away
    longest = shuffled.agg(F.max(F.struct(F.col(length).alias("len"), (-F.col("_mega")).alias("mega")))).scalar()
    # a megabatch is bounded by its size, whatever the data
    inside = Window.partitionBy("_mega").orderBy(F.desc(length), "_ordinal")
    placed = (F.col("_mega") * F.col("_size") + F.row_number().over(inside) - 1).cast("bigint")
    front = (-longest["mega"] * F.col("_size")).cast("bigint")
    swapped = (F.when(F.col("_place") == 0, front).when(F.col("_place") == front, F.lit(0))
               .otherwise(F.col("_place")).cast("bigint"))
    return shuffled.withColumn("_place", placed).select(row_id, length, *carry, swapped.alias("position")).withColumn(
        "batch_id", F.floor(F.col("position") / batch_size).cast("bigint"))


def with_longest(plan: DataFrame, lengths: dict[str, str], batch: str = "batch_id") -> DataFrame:
    """Adds the longest length of every batch: ``{length column: new column}``."""
    in_batch = Window.partitionBy(batch)
    return plan.withColumns({new: F.max(old).over(in_batch) for old, new in lengths.items()})


def target_length(longest: Column, own: Column, padding: bool | str = True, max_length: int | None = None,
                  multiple_of: int | None = None) -> Column:
    """Length to pad to. ``True``/``'longest'``, ``'max_length'`` or ``False``/``'do_not_pad'``."""
    if padding in (False, "do_not_pad"):
        return own
    if padding == "max_length":
        if max_length is None:
            raise ValueError("padding='max_length' needs max_length")
        return arrays.padded_length(F.lit(max_length), multiple_of)
    if padding in (True, "longest"):
        return arrays.padded_length(longest, multiple_of)
    raise ValueError(f"unknown padding {padding!r}")


def pad_inputs(rows: DataFrame, length: Column, column: str = "input_values") -> DataFrame:
    """Signals filled with silence, plus their attention mask."""
    return rows.withColumns({
        "attention_mask": arrays.attention_mask(F.col(column), length),
        column: arrays.pad_right(F.col(column), length, F.lit(arrays.SIGNAL_PAD).cast("float"))})


def pad_labels(rows: DataFrame, length: Column, column: str = "labels") -> DataFrame:
    return rows.withColumn(column, arrays.pad_right(F.col(column), length, F.lit(arrays.LABEL_PAD)))


def pad_batches(rows: DataFrame, plan: DataFrame, row_id: str = "utt_id", padding: bool | str = True,
                max_length: int | None = None, max_length_labels: int | None = None,
                multiple_of: int | None = None, multiple_of_labels: int | None = None) -> DataFrame:
    """Collate: every row with its batch, inputs and labels padded separately.

    ``plan`` has ``batch_id, position, longest_input, longest_label`` per row.
    """
    joined = rows.join(plan, row_id)
    input_target = target_length(F.col("longest_input"), F.size("input_values"), padding, max_length, multiple_of)
    label_target = target_length(F.col("longest_label"), F.size("labels"), padding, max_length_labels,
                                 multiple_of_labels)
    sized = joined.withColumns({"_input": input_target, "_label": label_target})
    padded = pad_labels(pad_inputs(sized, F.col("_input")), F.col("_label"))
    return padded.select("batch_id", "position", row_id, "input_values", "attention_mask", "labels")


def padding_waste(rows: DataFrame, batch: str, length: str) -> DataFrame:
    """Padded and real lengths per batch policy (already grouped by ``policy``)."""
    per_batch = rows.groupBy("policy", batch).agg(
        (F.max(length) * F.count("*")).alias("padded"), F.sum(length).alias("real"))
    return per_batch.groupBy("policy").agg(
        F.count("*").alias("n_batches"), F.sum("padded").alias("padded"), F.sum("real").alias("real")
    ).withColumn("waste", F.col("padded") - F.col("real"))
