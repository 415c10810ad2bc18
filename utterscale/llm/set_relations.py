"""N-gram Jaccard join with set-relation skipping.

Sets are word shingles, equal sets are one. Tokens are ordered by rarity; the first ones of
every set go to index lists, one per token. A list is sorted by size and blocked by position:
only entries near enough to the front can be the smaller side of a match, the blocks of the
others are skipped, and an entry is linked to one such entry of a compatible size before it.
These links, linear in the lists, span candidate clusters, which sketches part further, coarse ones first. In a cluster a set's matches are
counted once for a pivot, and derived from it for the sets that resemble the pivot.

Counts, candidates and answers cover all documents. Sets are named by 64-bit hashes.

Defined cases: a null text, or one without words, has no shingles and no links; fewer words
than the shingle width are one shingle; rows that repeat an id are judged by their texts;
a null id gets the component of its text; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterscale.llm.common import flat_bytes, slices, written
from utterscale.llm.components import components
from utterscale.llm.set_tiles import COARSE, FINE, SKETCHED, alike, answers, sketch, tiles
from utterscale.llm.token_sets import (buckets, ceil_div, frequencies, groups, key_filter, maybe, ranked, row_sets,
                                       set_keys, BUCKET_BITS)

PIECE = 1 << 20


def _sets(docs: DataFrame, width: int) -> tuple[DataFrame, np.ndarray]:
    """``doc_id, key, n`` of every document, and the token frequencies."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        ids = None
        for batch in slices(batches, "text", PIECE):
            data, offsets = flat_bytes(batch.column("text"))
            h, at = row_sets(data, offsets, width)
            total += np.bincount(buckets(h), minlength=len(total))
            ids = batch.column("doc_id").type
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(set_keys(h, at)), pa.array(np.diff(at)),
                                              pa.nulls(batch.num_rows, pa.int32())], names=["doc_id", "key", "n", "bucket"])
        some = np.flatnonzero(total)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(some), ids), pa.array(total[some]), pa.array(total[some]),
                                              pa.array(some, pa.int32())], names=["doc_id", "key", "n", "bucket"])

    rows = written(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, key long, n long, bucket int"), "sets")
    return rows.where("bucket IS NULL").drop("bucket"), frequencies(rows.where("bucket IS NOT NULL").select("bucket", "n"))


def _links(docs: DataFrame, frequency: np.ndarray, width: int, num: int, den: int) -> DataFrame:
    """``a, b``: keys of sets that may match, linear in the lengths of the index lists."""
    table = docs.sparkSession.sparkContext.broadcast(frequency)

    def prefixes(batches):
        seen: set[int] = set()  # copies inside a task send their tokens once
        for batch in slices(batches, "text", PIECE):
            data, offsets = flat_bytes(batch.column("text"))
            h, at = row_sets(data, offsets, width)
            keys, n = set_keys(h, at), np.diff(at)
            fresh = np.zeros(len(keys), bool)
            for i, key in enumerate(keys.tolist()):
                if n[i] and key not in seen:
                    seen.add(key)
                    fresh[i] = True
            token, row, place = ranked(h, at, table.value)
            use = fresh[row] & (place <= n[row] - ceil_div(num * n[row], den))
            yield pa.RecordBatch.from_arrays([pa.array(token[use].view(np.int64)), pa.array(keys[row[use]]),
                                              pa.array(n[row[use]].astype(np.int32)), pa.array(place[use].astype(np.int32))],
                                             names=["token", "key", "n", "place"])

    def lists(batches):
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            rest.append(batch)
            token = batch.column("token").to_numpy()
            if not len(token) or token[0] == token[-1] and len(rest) > 1 and rest[0].column("token")[0].as_py() == token[-1]:
                continue
            whole = pa.Table.from_batches(rest).combine_chunks()
            token = whole["token"].to_numpy()
            end = int(np.searchsorted(token, token[-1]))  # the last list may go on
            yield from _linked(whole.slice(0, end), num, den)
            rest = whole.slice(end).to_batches()
        if rest:
            yield from _linked(pa.Table.from_batches(rest), num, den)

    index = (docs.select("text").mapInArrow(prefixes, "token long, key long, n int, place int")
             .repartition("token").sortWithinPartitions("token", "n", "key"))
    return index.mapInArrow(lists, "a long, b long").distinct()


def _linked(rows: pa.Table, num: int, den: int):
    token, key = rows["token"].to_numpy(), rows["key"].to_numpy()
    n, place = rows["n"].to_numpy().astype(np.int64), rows["place"].to_numpy()
    if len(token) < 2:
        return
    index = np.arange(len(token))
    start = np.r_[True, token[1:] != token[:-1]]
    head = np.maximum.accumulate(np.where(start, index, 0))
    # the smaller side of a match has the token within this shorter prefix: other positions are skipped
    front = place <= n - ceil_div(2 * num * n, num + den)
    last = np.maximum.accumulate(np.where(front, index, -1))
    before = np.r_[-1, last[:-1]]
    # the first front entry of the list, if its size suits, makes shorter paths than the last one before
    at = np.flatnonzero(front)
    nxt = np.searchsorted(at, head)
    first = np.where(nxt < len(at), at[np.minimum(nxt, max(len(at) - 1, 0))] if len(at) else -1, -1)
    suits = lambda x: (x >= head) & (x < index) & (den * n[np.maximum(x, 0)] >= num * n)
    to = np.where(suits(first), first, np.where(suits(before), before, -1))
    use = (to >= 0) & (key[np.maximum(to, 0)] != key)
    pairs = np.unique(np.stack([key[use], key[to[use]]], 1), axis=0)
    if len(pairs):
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _refined(docs: DataFrame, clusters: DataFrame, width: int, num: int, den: int, room: int) -> DataFrame:
    """``a, b``: links between sets of a cluster whose sketches allow a match.

    An index list links sets by one common token. Sketches part those that have little else in
    common before whole sets are moved: with ``room`` ``COARSE`` some hundredth of a set's size, which leaves one in
    eight pairs of unlike sets of 256 tokens, with ``FINE`` some twelfth, which leaves next to none.
    """
    bits = docs.sparkSession.sparkContext.broadcast(key_filter(clusters, "key"))

    def sketched(batches):
        for key, h in _wanted(batches, bits.value, width):
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array([sketch(x, room).tobytes() for x in h], pa.binary())],
                                             names=["key", "sketch"])

    def linked(batches):
        for tile in groups(batches, "tile"):
            key, one = np.unique(tile["key"].to_numpy(), return_index=True)
            found = tile["sketch"].combine_chunks().take(pa.array(one)).to_pylist()
            pairs = alike(key, tile["n"].to_numpy()[one], [np.frombuffer(x, np.uint8) for x in found], num, den)
            if pairs:
                a, b = zip(*pairs)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    found = docs.select("text").mapInArrow(sketched, "key long, sketch binary")
    placed = found.join(tiles(clusters, num, den, SKETCHED), "key")
    return placed.select("tile", "key", "n", "sketch").repartition("tile").sortWithinPartitions("tile").mapInArrow(linked, "a long, b long")


def _wanted(batches, bits: np.ndarray, width: int):
    """Keys and token arrays of the sets that the filter lets pass, each once per task."""
    seen: set[int] = set()
    for batch in slices(batches, "text", PIECE):
        data, offsets = flat_bytes(batch.column("text"))
        h, at = row_sets(data, offsets, width)
        keys, n = set_keys(h, at), np.diff(at)
        pick = []
        for i in np.flatnonzero((n > 0) & maybe(bits, keys)).tolist():
            if keys[i] not in seen:
                seen.add(keys[i])
                pick.append(i)
        yield keys[pick], [h[at[i]:at[i + 1]] for i in pick]


def _matches(docs: DataFrame, clusters: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """``a, b``: keys of matching sets, enough of them to connect all that match; ``clusters``: ``key, n, cluster``."""
    bits = docs.sparkSession.sparkContext.broadcast(key_filter(clusters, "key"))

    def wanted(batches):
        for key, h in _wanted(batches, bits.value, width):
            ends = np.r_[0, np.cumsum([len(x) for x in h])].astype(np.int32)
            flat = np.concatenate(h) if h else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))], names=["key", "tokens"])

    def decided(batches):
        for tile in groups(batches, "tile"):
            key, one = np.unique(tile["key"].to_numpy(), return_index=True)
            if len(key) < 2:
                continue
            column = tile["tokens"].combine_chunks().take(pa.array(one))
            offsets = np.r_[0, np.cumsum(np.asarray(column.value_lengths(), np.int64))]
            label, out = np.arange(len(key)), []
            for i, found in answers(np.asarray(column.flatten()), offsets, num, den):
                new, where = np.unique(label[found], return_index=True)
                apart = new != label[i]
                if apart.any():
                    out += [(key[i], key[j]) for j in found[where[apart]]]
                    label[np.isin(label, new)] = label[i]
            if out:
                a, b = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    found = docs.select("text").mapInArrow(wanted, "key long, tokens array<long>")
    placed = found.join(tiles(clusters, num, den), "key")
    return placed.select("tile", "key", "tokens").repartition("tile").sortWithinPartitions("tile").mapInArrow(decided, "a long, b long")


def joined(docs: DataFrame, width: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of ``doc_id, text``, one row per row.

    Two documents match when ``den * intersection >= num * union``; the component is the
    smallest ``doc_id`` reachable by matches. Runs jobs when called.
    """
    sets, frequency = _sets(docs, width)
    links = _links(docs, frequency, width, num, den)
    names = written(sets.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n")), "names")

    def clustered(pairs: DataFrame) -> DataFrame:
        found = components(pairs).select(F.col("node").alias("key"), F.col("component").alias("cluster"))
        return written(found.join(names.select("key", "n"), "key"), "clusters")

    clusters = clustered(links)
    for room in (COARSE, FINE):
        clusters = clustered(_refined(docs, clusters, width, num, den, room))
    matched = written(components(_matches(docs, clusters, width, num, den))
                      .select(F.col("node").alias("key"), "component"), "matched")
    both = names.join(matched, "key", "left")
    low = both.where("component IS NOT NULL").groupBy("component").agg(F.min("rep").alias("low"))
    named = both.join(low, "component", "left").select("key", F.coalesce("low", "rep").alias("component_id"))
    return (sets.join(named, "key", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))
