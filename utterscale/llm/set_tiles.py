"""Candidate clusters of sets, cut into bounded tiles in which all pairs are decided in memory."""

from __future__ import annotations

from math import log

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = 1 << 20  # tokens of a block; a tile holds two blocks at most
SKETCHED = 1 << 22  # the same where sets come as sketches
COARSE, FINE = 16, 2  # tokens to a range of a sketch, at most


def tiles(members: DataFrame, num: int, den: int, limit: int = TILE) -> DataFrame:
    """``tile, key, n`` and the other columns of ``cluster, key, n, ...``.

    Two sets of a cluster that can reach the similarity share a tile. A cluster of up to
    ``limit`` tokens is one tile. A larger one is cut by size class first (sets more than one
    class apart can't match), a class by key into blocks, and every two blocks that can
    match meet in a tile.
    """
    total = members.groupBy("cluster").agg(F.sum("n").alias("total"))
    base = log(den / num) * 1.001
    rows = members.join(total, "cluster").withColumn(
        "cls", F.when(F.col("total") <= limit, 0).otherwise(1 + F.floor(F.log(F.col("n").cast("double")) / base)).cast("int"))
    blocks = rows.groupBy("cluster", "cls").agg(F.ceil(F.sum("n") / limit).cast("int").alias("nb"))
    above = blocks.select("cluster", (F.col("cls") - 1).alias("cls"), F.col("nb").alias("up"))
    below = blocks.select("cluster", (F.col("cls") + 1).alias("cls"), F.col("nb").alias("down"))
    plan = (blocks.join(above, ["cluster", "cls"], "left").join(below, ["cluster", "cls"], "left")
            .withColumn("down", F.when(F.col("cls") > 1, F.col("down"))))  # class 0 stands alone
    plan = plan.withColumn("up", F.when(F.col("cls") > 0, F.col("up")))
    placed = rows.join(plan, ["cluster", "cls"]).withColumn("b", F.pmod(F.xxhash64("key"), F.col("nb")).cast("int"))

    def span(n):
        return F.when(n.isNull(), F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), n - 1))

    def tile(cls, first, second, kind):
        return F.struct(cls.alias("c"), first.cast("int").alias("a"), second.cast("int").alias("b"), F.lit(kind).alias("k"))

    c, b = F.col("cls"), F.col("b")
    own = F.transform(span(F.col("nb")), lambda o: tile(c, F.least(b, o), F.greatest(b, o), 0))
    up = F.transform(span(F.col("up")), lambda o: tile(c, b, o, 1))
    down = F.transform(span(F.col("down")), lambda o: tile(c - 1, o, b, 1))
    keep = [x for x in members.columns if x != "cluster"]
    return placed.select(*keep, "cluster", F.explode(F.concat(own, up, down)).alias("t")).select(
        *keep, F.xxhash64("cluster", "t").alias("tile"))


def answers(flat: np.ndarray, offsets: np.ndarray, num: int, den: int):
    """Yields ``i, linked``: every set and the sets of the tile that match it (itself left out).

    The overlaps of a pivot set with all others are counted from its postings. The sets that
    match the pivot derive theirs from it: plus the postings of what they have more, minus
    those of what they lack.
    """
    m = len(offsets) - 1
    size = np.diff(offsets)
    names, token = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(m), size)
    order = np.argsort(token, kind="stable")
    posted = owner[order]
    begin = np.searchsorted(token[order], np.arange(len(names) + 1))

    def counted(tokens: np.ndarray) -> np.ndarray:
        if len(tokens) == 0:
            return np.zeros(m, np.int64)
        if len(tokens) < 16:
            hits = np.concatenate([posted[begin[t]:begin[t + 1]] for t in tokens])
        else:
            lengths = begin[tokens + 1] - begin[tokens]
            at = np.repeat(begin[tokens] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
            hits = posted[at]
        return np.bincount(hits, minlength=m)

    def linked(i: int, overlap: np.ndarray) -> np.ndarray:
        match = (den * overlap >= num * (size[i] + size - overlap)) & (overlap > 0)
        match[i] = False
        return np.flatnonzero(match)

    done = np.zeros(m, bool)
    for y in np.argsort(size, kind="stable"):
        if done[y]:
            continue
        own = token[offsets[y]:offsets[y + 1]]
        overlap = counted(own)
        found = linked(y, overlap)
        done[y] = True
        yield y, found
        for x in found:
            if done[x]:
                continue
            other = token[offsets[x]:offsets[x + 1]]
            more = np.setdiff1d(other, own, assume_unique=True)
            less = np.setdiff1d(own, other, assume_unique=True)
            done[x] = True
            yield x, linked(x, overlap + counted(more) - counted(less))


def sketch(h: np.ndarray, room: int = COARSE) -> np.ndarray:
    """Token counts in 2^k ranges of the hash, ``room`` / 2 to ``room`` tokens to a range, cut off at 255.

    The summed differences of two sketches are never more than the symmetric difference.
    Neighbouring ranges added give the next coarser sketch.
    """
    bits = max(4, int(np.ceil(np.log2(max(len(h), 1) / room))))
    found = np.bincount((h >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.minimum(found, 255).astype(np.uint8)


def _folded(rows: np.ndarray, width: int) -> np.ndarray:
    """The coarser sketches of ``width`` ranges."""
    while rows.shape[1] > width:
        rows = np.minimum(rows[:, ::2] + rows[:, 1::2], 255)
    return rows


def alike(key: np.ndarray, size: np.ndarray, sketches: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Pairs of keys whose sketches allow a match, enough of them to connect all such pairs."""
    order = np.argsort(size, kind="stable")
    key, size = key[order], size[order]
    levels = np.array([len(sketches[i]) for i in order])
    at = {m: np.flatnonzero(levels == m) for m in np.unique(levels)}
    stacks = {m: np.stack([sketches[order[i]] for i in at[m]]).astype(np.int16) for m in at}
    place = np.empty(len(key), np.int64)
    for m in at:
        place[at[m]] = np.arange(len(at[m]))
    # sketches of 16 and of 64 ranges part most pairs of longer ones before these are compared
    heads = {(m, w): _folded(stacks[m], w) for m in at for w in (16, 64) if m > w}
    label, out = np.arange(len(key)), []
    for i in range(len(key) - 1):
        end = int(np.searchsorted(size, size[i] * den // num, side="right"))
        mine = stacks[levels[i]][place[i]]
        for m in at:  # levels ascend; sizes that match may lie several apart
            if m < levels[i]:
                continue
            a, b = np.searchsorted(at[m], [i + 1, end])
            other = at[m][a:b]
            pick = np.flatnonzero(label[other] != label[i])
            if not len(pick):
                continue
            both = size[i] + size[other]
            room = both - 2 * -(-num * both // (num + den))
            for w in (16, 64):
                if levels[i] > w:
                    head = heads[levels[i], w][place[i]]
                    pick = pick[np.abs(heads[m, w][a:b][pick] - head).sum(1, dtype=np.int32) <= room[pick]]
            rows = _folded(stacks[m][a:b][pick], levels[i])
            near = other[pick[np.abs(rows - mine).sum(1, dtype=np.int32) <= room[pick]]]
            new, one = np.unique(label[near], return_index=True)
            if len(new):
                out += [(key[i], key[j]) for j in near[one]]
                label[np.isin(label, new)] = label[i]
    return out
