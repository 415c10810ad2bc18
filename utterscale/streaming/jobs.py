"""Streams over the evaluation and event logs.

Every job keeps windowed or keyed aggregates in state. Updates go to an append-only
table in the shared folder with the batch number; ``latest`` reads the newest value of
each key. A restarted batch writes its own folder again, so replays do not double.

State stays bounded by event time. ``route_late`` first divides a stream by one rule: a row
is late if it is older, by more than the delay, than the newest row of the batches before.
Rows in time go on to a stream with that watermark, which closes windows and drops their
state and never meets a late row. Late rows stay in a table of their own, and a result that
must count everything adds them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from utterscale.operators.evaluations import best_so_far
from utterscale.sources.shared import shared_folder


def read_table_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int = 64) -> DataFrame:
    """Stream one table, a file or a folder of part files; the schema comes from the files."""
    path = f"{folder}/{name}.parquet"
    return (spark.readStream.schema(spark.read.parquet(path).schema)
            # as a pattern, since a plain path would have to be a folder
            .option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/{name}.parque[t]"))


def with_event_time(stream: DataFrame, column: str, delay: str | None = None) -> DataFrame:
    """Event time as a zoned timestamp. A watermark is set only where the longest ``delay`` of
    a row is known: later rows would be dropped, and a backlog comes in any order."""
    timed = stream.withColumn(column, F.col(column).cast("timestamp"))
    return timed.withWatermark(column, delay) if delay else timed


def windowed_counts(stream: DataFrame, by: Sequence[str], time: str = "ts", width: str = "1 day") -> DataFrame:
    """Events per tumbling window and group."""
    return (stream.groupBy(F.window(time, width).alias("w"), *by).agg(F.count("*").alias("n"))
            .select(F.col("w.start").alias("window_start"), *by, "n"))


def windowed_sums(stream: DataFrame, by: Sequence[str], sums: dict[str, Column], time: str = "ts",
                  width: str = "1 day") -> DataFrame:
    """Sums per tumbling window and group: running numerators and denominators."""
    return (stream.groupBy(F.window(time, width).alias("w"), *by)
            .agg(*[F.sum(c).alias(name) for name, c in sums.items()])
            .select(F.col("w.start").alias("window_start"), *by, *sums))


def running_best(stream: DataFrame, by: str, score: str, order: Sequence[str], start: float) -> DataFrame:
    """Best score per group so far and the first evaluation that reached it.

    A minimum is combined before the shuffle, so a hot group is no hot task.
    """
    best = F.min(F.struct(score, *order))
    return (stream.groupBy(by).agg(best.alias("b"))
            .select(by, F.least(F.lit(start), F.col(f"b.{score}")).alias("best"),
                    *[F.col(f"b.{c}").alias(c) for c in order]))


def _each_batch(stream: DataFrame, path: str, step: Callable[[DataFrame, int], None]) -> None:
    """Run ``step(batch, number)`` over the available input, one batch after the other."""
    stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()


def route_late(stream: DataFrame, name: str, time: str, delay: str, path: str | None = None) -> tuple[str, str]:
    """Divide the rows by the delay rule; returns the folders of rows in time and of late rows.

    With the ``path`` of an earlier call its checkpoint and newest time are continued.
    """
    spark = stream.sparkSession
    path = path or shared_folder(spark, f"stream-{name}")

    def step(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        newest = batch.sparkSession.read.schema("newest timestamp").parquet(f"{path}/newest/batch={number - 1}") if number else None
        limit = newest.first()["newest"] if newest is not None else None
        late = F.lit(False) if limit is None else F.coalesce(
            F.col(time).cast("timestamp") < F.lit(limit) - F.expr(f"INTERVAL {delay}"), F.lit(False))
        rows.where(~late).write.mode("overwrite").parquet(f"{path}/in_time/batch={number}")
        rows.where(late).write.mode("overwrite").parquet(f"{path}/late/batch={number}")
        seen = rows.agg(F.max(F.col(time).cast("timestamp")).alias("newest"))
        seen.select(F.greatest("newest", F.lit(limit).cast("timestamp")).alias("newest")).coalesce(1).write.mode("overwrite").parquet(
            f"{path}/newest/batch={number}")
        rows.unpersist()

    _each_batch(stream, path, step)
    return f"{path}/in_time", f"{path}/late"


def read_routed(spark: SparkSession, folder: str, like: DataFrame, batches_at_once: int = 64) -> DataFrame:
    """The rows of one side of ``route_late`` as a stream, in the order of their batches."""
    return (spark.readStream.schema(like.schema).option("maxFilesPerTrigger", batches_at_once).parquet(f"{folder}/batch=*"))


def read_side(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    """The rows of one side of ``route_late``."""
    return spark.read.schema(like.schema).parquet(f"{folder}/batch=*")


def history(evals: DataFrame, name: str, order: Sequence[str], run: str = "run", score: str = "wer", start: float = 1.0,
            idle: str | None = None, path: str | None = None) -> tuple[str, str]:
    """Number every evaluation of a stream, with the best score before it and whether it was saved.

    Returns the folders of numbered evaluations and of closed runs. A run's evaluations count
    in the order they come; those of one batch in ``order``, whose first column is a time. The
    state is one row per open run (count, best score, newest time): a table per batch, built
    from the one before, so that a batch that runs again gives the same rows. A run closes
    when nothing came for ``idle`` before the newest time of all runs; it leaves the state,
    and would start anew. No task holds a whole run.
    """
    spark = evals.sparkSession
    path = path or shared_folder(spark, f"stream-{name}")
    kinds = evals.schema
    state = f"{run} {kinds[run].dataType.simpleString()}, n bigint, best double, newest timestamp"

    def step(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        carried = (session.read.schema(state).parquet(f"{path}/open/batch={number - 1}") if number
                   else session.createDataFrame([], state))
        tracked = best_so_far(batch, order, run, score, start)
        known = carried.select(F.col(run).alias("_run"), "n", "best")
        numbered = tracked.join(known, F.col(run).eqNullSafe(F.col("_run")), "left").withColumns({
            "eval_nr": F.col("eval_nr") + F.coalesce("n", F.lit(0)), "best_before": F.least("best_before", "best")})
        numbered = numbered.withColumn("saved", F.col(score) < F.col("best_before")).drop("_run", "n", "best")
        numbered.write.mode("overwrite").parquet(f"{path}/history/batch={number}")
        fresh = batch.groupBy(run).agg(F.count("*").alias("n"), F.min(score).cast("double").alias("best"),
                                       F.max(F.col(order[0]).cast("timestamp")).alias("newest"))
        both = carried.unionByName(fresh).groupBy(run).agg(F.sum("n").alias("n"), F.min("best").alias("best"), F.max("newest").alias("newest"))
        both.write.mode("overwrite").parquet(f"{path}/runs/batch={number}")
        runs = session.read.schema(state).parquet(f"{path}/runs/batch={number}")
        latest_of_all = runs.agg(F.max("newest")).first()[0]
        closed = F.lit(False) if idle is None or latest_of_all is None else F.coalesce(
            F.col("newest") < F.lit(latest_of_all) - F.expr(f"INTERVAL {idle}"), F.lit(False))
        runs.where(closed).write.mode("overwrite").parquet(f"{path}/closed/batch={number}")
        runs.where(~closed).write.mode("overwrite").parquet(f"{path}/open/batch={number}")

    _each_batch(evals, path, step)
    return f"{path}/history", f"{path}/closed"


def run_available(updates: DataFrame, name: str) -> tuple[str, str]:
    """Process what is there in update mode; returns (table path, checkpoint path)."""
    spark = updates.sparkSession
    path = shared_folder(spark, f"stream-{name}")
    checkpoint = f"{path}-state"

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = (updates.writeStream.outputMode("update").foreachBatch(store)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return path, checkpoint


def latest(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Newest row per key from an update table."""
    updates = spark.read.parquet(path)
    values = [c for c in updates.columns if c not in (*keys, "batch")]
    newest = F.max_by(F.struct(*values), "batch").alias("v")
    return updates.groupBy(*keys).agg(newest).select(*keys, "v.*")


def current(updates: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """Run the stream over the available input and return its current result."""
    path, _ = run_available(updates, name)
    return latest(updates.sparkSession, path, keys)
