"""Centroid clustering in exact integers, on bit planes and popcounts.

A vector of 64 integers is stored by bit planes: plane b packs bit b of every component into
one 64-bit word, in two's complement, so the highest plane has a negative weight. The inner
product of two vectors is the weighted sum of ``popcount(plane & plane)`` over all pairs of
planes; squared distances to the centroids follow from it without rounding. A round is one
pass over the packed table: tasks assign their vectors, count the set bits of every plane and
component per cluster, and send k * 65 sums each; the driver receives the k totals only.

Defined cases: vectors that are null, have another length than 64, or hold null or
non-finite components are left out; repeated rows and ids count each; among equal hashes
the smaller components come first, and null ids last; with fewer vectors than centroids
every vector starts one; an empty table gives no rows; extra columns are ignored. Components
of 2^27 and more raise an error: their distances do not fit 64 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterscale.llm.common import written

WIDTH = 64
LARGEST = 1 << 27
BLOCK = 4096  # vectors that are unpacked at a time


def weights(planes: int) -> np.ndarray:
    """The weight of every plane in two's complement."""
    w = np.left_shift(np.int64(1), np.arange(planes, dtype=np.int64))
    w[-1] = -w[-1]
    return w


def pack(values: np.ndarray, planes: int) -> np.ndarray:
    """``planes`` words of each row of 64 integers."""
    bits = (values[:, None, :] >> np.arange(planes)[None, :, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little").view("<u8")[:, :, 0]


def products(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of all rows of ``x`` with all rows of ``c``, both packed."""
    w = weights(x.shape[1])
    out = np.zeros((len(x), len(c)), np.int64)
    for a in range(x.shape[1]):
        for b in range(c.shape[1]):
            out += (w[a] * w[b]) * np.bitwise_count(x[:, a, None] & c[None, :, b])
    return out


def norms(x: np.ndarray) -> np.ndarray:
    """Squared length of every packed row."""
    w = weights(x.shape[1])
    out = np.zeros(len(x), np.int64)
    for a in range(x.shape[1]):
        for b in range(a, x.shape[1]):
            out += (w[a] * w[b] * (1 if a == b else 2)) * np.bitwise_count(x[:, a] & x[:, b])
    return out


def sums(x: np.ndarray, cluster: np.ndarray, k: int) -> np.ndarray:
    """Componentwise sums per cluster, from the number of set bits of every plane and component."""
    total = np.zeros((k, WIDTH), np.int64)
    for a in range(0, len(x), BLOCK):
        bits = np.unpackbits(np.ascontiguousarray(x[a:a + BLOCK]).view(np.uint8), axis=1, bitorder="little")
        member = np.zeros((k, len(bits)), np.float32)
        member[cluster[a:a + BLOCK], np.arange(len(bits))] = 1
        counts = (member @ bits.astype(np.float32)).astype(np.int64)  # exact: at most BLOCK each
        total += (counts.reshape(k, x.shape[1], WIDTH) * weights(x.shape[1])[None, :, None]).sum(1)
    return total


def _words(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("planes")
    return np.asarray(column.flatten(), np.int64).view(np.uint64).reshape(len(column), -1)


def integers(vectors: DataFrame, scale: int) -> DataFrame:
    """``vec_id, v`` of the valid rows of ``vec_id, embedding``: components ``floor(scale * x)``, held as doubles."""
    x = F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", x.alias("v")).where(
        (F.size("v") == WIDTH) & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))))
    return rows.select("vec_id", F.transform("v", lambda e: F.floor(e * float(scale)).cast("double")).alias("v"))


def packed(rows: DataFrame) -> DataFrame | None:
    """``vec_id, planes, norm`` of ``vec_id, v``, written to the shared folder; None without rows."""
    low, high = rows.agg(F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    if low is None:
        return None
    if max(-low, high) >= LARGEST:
        raise ValueError(f"components reach {max(-low, high):.0f}; squared distances fit 64 bits below {LARGEST}")
    planes = 1 + max(int(high).bit_length(), (-int(low) - 1).bit_length() if low < 0 else 0)

    def run(batches):
        for batch in batches:
            column = batch.column("v")
            x = pack(np.asarray(column.flatten(), np.float64).astype(np.int64).reshape(len(column), WIDTH), planes)
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id"),
                pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * planes), pa.array(x.view(np.int64).ravel())),
                pa.array(norms(x))], names=["vec_id", "planes", "norm"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return written(rows.mapInArrow(run, f"vec_id {kind}, planes array<long>, norm long"), "planes")


def initial(rows: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The vectors of ``vec_id, v`` with the ``k`` smallest hashes of ``seed:vec_id``."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [[int(e) for e in r["v"]] for r in rows.orderBy(F.asc_nulls_last(order), "v").limit(k).collect()]


def _nearest(batch: pa.RecordBatch, x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    apart = np.asarray(batch.column("norm"))[:, None] + norms(c)[None, :] - 2 * products(x, c)
    cluster = apart.argmin(1)  # the first of equal ones
    return cluster, apart[np.arange(len(x)), cluster]


def fit(table: DataFrame, chosen: list[list[int]], rounds: int) -> list[list[int]]:
    """The centroids after ``rounds`` rounds over ``vec_id, planes, norm``, from ``chosen`` on. One job a round."""
    planes = len(table.first()["planes"])
    for _ in range(rounds):
        c = pack(np.array(chosen, np.int64), planes)

        def run(batches, c=c):
            total, count = np.zeros((len(c), WIDTH), np.int64), np.zeros(len(c), np.int64)
            for batch in batches:
                x = _words(batch)
                cluster, _ = _nearest(batch, x, c)
                total += sums(x, cluster, len(c))
                count += np.bincount(cluster, minlength=len(c))
            both = np.c_[total, count]
            at = np.indices(both.shape).reshape(2, -1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at[0]), pa.array(at[1]), pa.array(both.ravel())], names=["cluster", "pos", "s"])

        found = table.select("planes", "norm").mapInArrow(run, "cluster int, pos int, s long").groupBy("cluster", "pos").agg(F.sum("s").alias("s"))
        both = np.zeros((len(c), WIDTH + 1), object)
        for r in found.collect():  # k * 65 rows
            both[r["cluster"], r["pos"]] = r["s"]
        chosen = [[int(s) // int(row[-1]) for s in row[:-1]] if row[-1] else old for row, old in zip(both, chosen)]
    return chosen


def assigned(table: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``vec_id, cluster, distance``: the nearest centroid of every row of ``vec_id, planes, norm``."""
    planes = len(table.first()["planes"])
    c = pack(np.array(centroids, np.int64), planes)

    def run(batches):
        for batch in batches:
            cluster, apart = _nearest(batch, _words(batch), c)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(apart)],
                                             names=["vec_id", "cluster", "distance"])

    return table.mapInArrow(run, f"vec_id {table.schema['vec_id'].dataType.simpleString()}, cluster int, distance long")


def clustered(vectors: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, seed: int = 3) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``: one row per valid row.

    Centroids start as the vectors whose ``sha256(seed:vec_id)`` is smallest. Runs jobs when called.
    """
    spark = vectors.sparkSession
    rows = integers(vectors, scale)
    table = packed(rows)
    if table is None:
        kind = vectors.schema["vec_id"].dataType.simpleString()
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = fit(table, initial(rows, k, seed), rounds)
    found = written(assigned(table, centroids), "clusters")
    total = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows at most
    per = spark.createDataFrame(
        [(i, total.get(i, 0), sum(total.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest())
         for i, c in enumerate(centroids)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(per), "cluster").select(  # k rows
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
