"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from utterscale.sources.shared import shared_folder

WHITE = r"[ \t\n\x0B\f\r]"  # Java class of the six separators 0x20, 0x09-0x0D


def written(frame: DataFrame, purpose: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, safe from lost executors.

    Runs a job when called.
    """
    path = shared_folder(frame.sparkSession, purpose)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the n+1 offsets of its values; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    whole = column.cast(pa.binary()).cast(pa.large_binary()).fill_null(b"")
    if not len(whole):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = whole.buffers()
    at = np.frombuffer(offsets, np.int64)[whole.offset:whole.offset + len(whole) + 1]
    flat = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batches cut by rows so that a piece holds about ``limit`` bytes of ``column``.

    A single longer value makes a piece of its own.
    """
    for batch in batches:
        size = np.asarray(pa.compute.binary_length(batch.column(column)).fill_null(0), dtype=np.int64)
        if not len(size):
            continue
        piece = (np.cumsum(size) - size) // limit
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(size)]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start+1, ... of every range, one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    begin = np.cumsum(lengths) - lengths
    return np.repeat(starts - begin, lengths) + np.arange(total)
