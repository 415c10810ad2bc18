"""Orders that do not depend on partitioning: seeded shuffle, samples, ordinals, scans.

No operator here sorts all rows in one task. A running value over a long (or hot)
group is computed per bucket, bucket totals are prefix-summed, and the offset is
joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from utterscale.sources.shared import shared_folder

HASH_DIGITS = 4  # hex digits of the shuffle key that name its bucket: 65,536 even buckets


def shuffle_key(seed: int, row_id: Column) -> Column:
    """Uniform, seeded, and the same whatever the partitioning."""
    return F.md5(F.concat(F.lit(f"{seed}:"), row_id.cast("string")))


def running(rows: DataFrame, by: Sequence[str], order: Sequence[str | Column], bucket: Column,
            ordinal: str | None = None, minimum: tuple[str, str] | None = None,
            first: int | None = None, total: str | None = None) -> DataFrame:
    """Running row number and running minimum of the rows before, per group.

    ``bucket`` must not be null nor decrease along ``order``, and should be even; one task
    holds one bucket of one group, never a whole group. ``minimum`` is ``(source column,
    new column)``. With ``first`` only that many rows per group are kept, and buckets
    that lie behind them are dropped before anything is sorted. ``total`` names a column
    for the row count of the group.
    """
    # a struct is never null itself, so null groups meet their offsets by plain equality,
    # and the join and the window below share one exchange
    keys = ["_group", "_bucket"]
    rows = rows.withColumns({"_group": F.struct(*by) if by else F.lit(0), "_bucket": bucket})
    source = minimum[0] if minimum else None
    totals = rows.groupBy(*keys).agg(
        F.count("*").alias("_n"),
        (F.min(source) if source else F.lit(None).cast("double")).alias("_min"))
    # bucket totals only: one row per group and bucket
    before = Window.partitionBy("_group").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"_o_{k}") for k in keys],
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.min("_min").over(before).alias("_before"),
        *([F.sum("_n").over(Window.partitionBy("_group")).alias(total)] if total else []))
    if first is not None:
        offsets = offsets.where(F.col("_offset") < first)
    match = (F.col("_group") == F.col("_o__group")) & (F.col("_bucket") == F.col("_o__bucket"))
    local = Window.partitionBy(*keys).orderBy(*order)
    out = rows.join(offsets, match)
    if ordinal or first is not None:
        number = ordinal or "_number"
        out = out.withColumn(number, (F.col("_offset") + F.row_number().over(local)).cast("bigint"))
        if first is not None:
            out = out.where(F.col(number) <= first)
    if source:
        earlier = local.rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn(minimum[1], F.least(F.min(source).over(earlier), F.col("_before")))
    helpers = [*keys, "_offset", "_before", *[f"_o_{k}" for k in keys]]
    return out.drop(*helpers, *([] if ordinal else ["_number"]))


def seeded_shuffle(rows: DataFrame, row_id: str, seed: int, position: str = "position",
                   total: str | None = None) -> DataFrame:
    """0-based position of every row in the seeded order, optionally with the row count."""
    keyed = rows.withColumn("_key", shuffle_key(seed, F.col(row_id)))
    ranked = running(keyed, [], ["_key", row_id], F.substring("_key", 1, HASH_DIGITS), ordinal="_rank", total=total)
    return ranked.withColumn(position, F.col("_rank") - 1).drop("_rank", "_key")


def _cutoffs(rows: DataFrame, by: Sequence[str], row_id: str, n: int, seed: int) -> DataFrame:
    """``_of, _last``: per group the last bucket of the seeded order that holds one of its first
    ``n`` rows. Written to the shared folder, so the optimizer knows how small it is."""
    spark = rows.sparkSession
    bucket = F.substring(shuffle_key(seed, F.col(row_id)), 1, HASH_DIGITS)
    counts = rows.select((F.struct(*by) if by else F.lit(0)).alias("_of"), bucket.alias("_b")).groupBy("_of", "_b").agg(
        F.count("*").alias("_n"))
    before = Window.partitionBy("_of").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # 65,536 rows at most
    needed = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).where(F.col("_before") < n)
    path = shared_folder(spark, "cutoffs")
    needed.groupBy("_of").agg(F.max("_b").alias("_last")).write.parquet(path)
    return spark.read.parquet(path)


def seeded_sample(rows: DataFrame, row_id: str, n: int, seed: int) -> DataFrame:
    """The first ``n`` rows of the seeded order; all rows if ``n`` is not positive. Runs a job when called."""
    return seeded_sample_per_group(rows, [], row_id, n, seed)


def seeded_sample_per_group(rows: DataFrame, by: Sequence[str], row_id: str, n: int, seed: int) -> DataFrame:
    """The first ``n`` rows of every group, one way for every ``n``. Runs a job when called.

    The counts per key bucket, from ids alone, give each group a last bucket; rows behind it are
    filtered out where they are scanned. What remains, little more than the sample, is
    ranked by bucket: only these rows move with all their columns, and no task sorts a group.
    """
    if n <= 0:
        return rows
    last = _cutoffs(rows, by, row_id, n, seed)
    keyed = rows.withColumn("_key", shuffle_key(seed, F.col(row_id)))
    bucket = F.substring("_key", 1, HASH_DIGITS)
    if by:
        near = keyed.join(last, F.struct(*by) == F.col("_of")).where(bucket <= F.col("_last")).drop("_of", "_last")
    else:
        found = last.first()
        near = keyed.where(bucket <= (found["_last"] if found else ""))
    return running(near, by, ["_key", row_id], bucket, first=n).drop("_key")


def range_buckets(rows: DataFrame, order: Sequence[str | Column], parts: int | None = None) -> DataFrame:
    """Materialise ``rows`` range-partitioned on ``order`` with the range as ``_range``.

    Spark samples the boundaries, so they must be fixed before two branches of a plan
    may rely on them: the rows are written once to the shared folder. Pass narrow rows.
    """
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = shared_folder(spark, "ranges")
    rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    return spark.read.parquet(path)


def number_rows(rows: DataFrame, by: Sequence[str], order: Sequence[str], ordinal: str = "idx",
                parts: int | None = None) -> DataFrame:
    """1-based row number per group in ``order`` without one task per group."""
    return running(range_buckets(rows, [*order, *by], parts), by, order, F.col("_range"),
                   ordinal=ordinal).drop("_range")
