"""Token sets of texts inside Arrow tasks: word hashes, shingles, set keys, rarity order."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKET_BITS = 18  # size of the frequency table that orders tokens: 2 MB, whatever the corpus
BITMAP_BITS = 24  # size of a key filter: 2 MB

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER_PLUS_1 = _LOWER.astype(np.uint64) + np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=1)
def powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The first 2^bits powers of the odd base modulo 2^64, and those of its inverse."""
    both = []
    for base in (int(_ODD), pow(int(_ODD), -1, 1 << 64)):
        power = np.full(1 << bits, base, np.uint64)
        power[0] = 1
        both.append(np.cumprod(power, dtype=np.uint64))
    return both[0], both[1]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and row of every word, A-Z lower-cased, in text order.

    A word's hash is its bytes' polynomial, taken as a difference of running sums and brought
    back to power 0 by the inverse base.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    solid = ~_WHITE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    start, stop = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1] | cut[1:-1]
    stop[:-1] &= ~solid[1:] | cut[1:-1]
    starts, stops = np.flatnonzero(start), np.flatnonzero(stop)
    power, back = powers(max(22, (len(data) - 1).bit_length()))
    sums = power[:len(data)] * _LOWER_PLUS_1[data]
    np.cumsum(sums, out=sums)
    words = (sums[stops] - np.where(starts > 0, sums[np.maximum(starts, 1) - 1], np.uint64(0))) * back[starts]
    return mix(words), np.searchsorted(offsets, starts, side="right") - 1


def row_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``width``-word shingles of every row, ascending: flat hashes and n+1 offsets.

    A row with fewer words has all its words as its one shingle.
    """
    rows = len(offsets) - 1
    h, row = word_hashes(data, offsets)
    if width > 1 and len(h):
        counts = np.bincount(row, minlength=rows)
        m = len(h) - width + 1
        grams, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if m > 0:
            grams = h[:m].copy()
            for k in range(1, width):
                grams = mix(grams * _ODD + h[k:k + m])
            inside = row[:m] == row[width - 1:]
            grams, owner = grams[inside], row[:m][inside]
        begin = np.cumsum(counts) - counts
        short = np.flatnonzero((counts > 0) & (counts < width))
        whole = []
        for r in short:
            x = h[begin[r]:begin[r] + 1]
            for k in range(1, counts[r]):
                x = mix(x * _ODD + h[begin[r] + k])
            whole.append(x[0] + np.uint64(counts[r]))
        h, row = np.r_[grams, np.array(whole, np.uint64)], np.r_[owner, short]
    order = _by_row(h, row)
    h, row = h[order], row[order]
    if len(h):
        new = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])]
        h, row = h[new], row[new]
    return h, np.r_[0, np.cumsum(np.bincount(row, minlength=rows))]


def _by_row(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The order by row and hash: one sort of numbers of row and leading hash bits, unless these
    leave the order of two different hashes open."""
    bits = max(int(row.max(initial=0)).bit_length(), 1)
    key = (row.astype(np.uint64) << np.uint64(64 - bits)) | (h >> np.uint64(bits))
    order = np.argsort(key)
    key, sorted_h = key[order], h[order]
    if ((key[1:] == key[:-1]) & (sorted_h[1:] != sorted_h[:-1])).any():
        return np.lexsort((h, row))
    return order


def set_keys(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit name of every set, independent of order; 0 for an empty one."""
    n = np.diff(offsets)
    sums = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        sums[full] = np.add.reduceat(mix(h ^ _ODD), offsets[:-1][full])
    return np.where(n > 0, mix(sums + n.astype(np.uint64) * _ODD), 0).view(np.int64)


def buckets(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def ceil_div(a, b):
    return -(-a // b)


def ranked(h: np.ndarray, offsets: np.ndarray, frequency: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of every row, rare ones first: hash, row, and place in the row."""
    size = np.diff(offsets)
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(h)) - offsets[row]
    count = frequency[buckets(h)]
    wide = [int(x.max(initial=0)).bit_length() for x in (row, count, place)]
    if sum(wide) > 63:
        order = np.lexsort((place, count, row))
    else:  # hashes ascend in a row, so row, count and place in one number state the order
        key = (row << (wide[1] + wide[2])) | (count << wide[2]) | place
        key.sort()
        order = (key & ((1 << wide[2]) - 1)) + offsets[row]
    return h[order], row, place


def frequencies(counts: DataFrame) -> np.ndarray:
    """The table of token counts per bucket from ``bucket, n``: at most 2^18 numbers on the driver."""
    found = counts.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(1 << BUCKET_BITS, np.int64)
    table[found["bucket"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return table


def key_filter(keys: DataFrame, column: str, size: int = BITMAP_BITS) -> np.ndarray:
    """Bits of the keys present, folded to 2^size: false positives only. The driver receives at
    most 2^size bits, in rows of 4 kB."""
    slot = F.pmod(F.col(column), F.lit(1 << size))
    rows = (keys.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("b"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits")).collect())
    bits = np.zeros(1 << size >> 3, np.uint8)
    # slot 0 is in a bucket of its own (number 0), slot s >= 1 in number (s - 1) / 32768 + 1
    for r in rows:
        part = np.frombuffer(bytes(r["bits"]), np.uint8)
        if r["b"] >= 1:
            a = (r["b"] - 1) * 4096
            if a < len(bits):
                bits[a:a + 4096] |= part
    return bits


def maybe(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be present."""
    slot = np.mod(keys, len(bits) << 3).astype(np.int64) - 1  # Spark's positions start at 1
    found = (bits[np.maximum(slot, 0) >> 3] >> (np.maximum(slot, 0) & 7).astype(np.uint8)) & 1
    return (slot < 0) | (found == 1)


def groups(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[pa.Table]:
    """The runs of equal ``columns`` of sorted batches, also across batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
        cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        bounds = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(bounds, bounds[1:]):
            name = tuple(k[a] for k in keys)
            if held and name != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = name
    if held:
        yield pa.Table.from_batches(held)
