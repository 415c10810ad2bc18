"""Line dedup by an exact set-similarity join of lines.

A line's tokens are its distinct words, rare ones first. Two lines match when
``den * intersection >= num * union``; a line is removed if an earlier line, kept or not,
matches it. Order is by document id, then line number. Equal token sets are one set, named
by its first line. Index lists of the prefix tokens give candidates by length, position and
a parity bitmap (a lower bound of the symmetric difference); clusters of candidates meet in
bounded tiles where the similarity is verified.

Defined cases: a line without words (also of a null text) is never removed; rows that repeat
an id and text remove nothing from each other, their equal lines being at equal places; a
null id sorts first; an empty table gives no rows; extra columns are ignored. Document ids
are integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterscale.functions.arrays import let
from utterscale.llm.common import flat_bytes, ranges, slices, written
from utterscale.llm.components import components
from utterscale.llm.set_tiles import answers, tiles
from utterscale.llm.token_sets import (BUCKET_BITS, buckets, ceil_div, frequencies, groups, key_filter, maybe, ranked,
                                       row_sets, set_keys)

PIECE = 1 << 20
NEWLINE = 10
ID = ["doc_id", "text_key"]
ENTRY = np.dtype([("token", "<u8"), ("key", "<i8"), ("n", "<i4"), ("place", "<i4"), ("p", "<u8"), ("q", "<u8")])
SHELF = 1 << 16  # about so many index entries share a shelf; their number grows with the input
LOAD = 1 << 19  # entries a task holds before it hands them out, 20 MB


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"),
                       F.xxhash64("text").alias("text_key"), "text")


def line_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token sets of all lines (flat hashes, offsets), and the row and number of each line."""
    data, offsets = flat_bytes(column)
    starts = np.unique(np.r_[offsets[:-1][np.diff(offsets) > 0], np.flatnonzero(data == NEWLINE) + 1])
    starts = starts[starts < len(data)]
    row = np.searchsorted(offsets, starts, side="right") - 1
    number = np.arange(len(starts)) - np.searchsorted(row, row)
    h, at = row_sets(data, np.r_[starts, len(data)], 1)
    return h, at, row, number


def _sets(rows: DataFrame) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """Per document the numbers of its lines with words; per set its first line; token frequencies."""
    schema = "doc_id long, text_key long, worded array<int>, key long, n long, line int, bucket int"

    def run(batches):
        total = np.zeros(1 << BUCKET_BITS, np.int64)

        def record(size, **columns):
            kinds = {"doc_id": pa.int64(), "text_key": pa.int64(), "worded": pa.list_(pa.int32()), "key": pa.int64(),
                     "n": pa.int64(), "line": pa.int32(), "bucket": pa.int32()}
            return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(size, k)
                                               for c, k in kinds.items()], names=list(kinds))

        for batch in slices(batches, "text", PIECE):
            h, at, row, number = line_sets(batch.column("text"))
            total += np.bincount(buckets(h), minlength=len(total))
            ids, texts = batch.column("doc_id").to_numpy(), batch.column("text_key").to_numpy()
            n = np.diff(at)
            some = np.flatnonzero(n)
            cuts = np.searchsorted(row[some], np.arange(batch.num_rows + 1))
            worded = np.split(number[some].astype(np.int32), cuts[1:-1]) if batch.num_rows else []
            yield record(batch.num_rows, doc_id=ids, text_key=texts, worded=[w.tolist() for w in worded])
            keys = set_keys(h, at)[some]
            order = np.lexsort((number[some], ids[row[some]], keys))
            one = order[np.r_[True, keys[order][1:] != keys[order][:-1]]] if len(order) else order
            of = row[some][one]
            yield record(len(one), doc_id=ids[of], text_key=texts[of], key=keys[one], n=n[some][one],
                         line=number[some][one].astype(np.int32))
        seen = np.flatnonzero(total)
        yield record(len(seen), n=total[seen], bucket=seen.astype(np.int32))

    found = written(rows.mapInArrow(run, schema), "lines")
    first = (found.where("key IS NOT NULL").groupBy("key")
             .agg(F.min(F.struct("doc_id", "line", "text_key")).alias("f"), F.first("n").alias("n"))
             .select("key", "n", "f.doc_id", "f.line", "f.text_key"))
    documents = found.where("key IS NULL AND bucket IS NULL").select("doc_id", "text_key", "worded")
    return documents, written(first, "first"), frequencies(found.where("bucket IS NOT NULL").select("bucket", "n"))


def _fresh(keys: np.ndarray, wanted: np.ndarray, seen: set[int]) -> np.ndarray:
    """Places of the wanted keys' first occurrences that are not among ``seen``, which takes them."""
    at = np.flatnonzero(wanted)
    names, one = np.unique(keys[at], return_index=True)
    new = np.fromiter((k not in seen for k in names.tolist()), bool, len(names))
    seen.update(names[new].tolist())
    return np.sort(at[one[new]])


def _links(rows: DataFrame, frequency: np.ndarray, num: int, den: int) -> DataFrame:
    """``a, b``: keys of lines that pass all filters, enough of them to connect all that do.

    Index entries travel packed, one row per task and shelf; a shelf holds the whole lists of
    its tokens.
    """
    shelves = 1 + int(frequency.sum()) // (4 * SHELF)
    table = rows.sparkSession.sparkContext.broadcast(frequency)

    def packed(held):
        entries = np.concatenate(held)
        shelf = (entries["token"] % np.uint64(shelves)).astype(np.int64)
        order = np.argsort(shelf, kind="stable")
        entries, shelf = entries[order], shelf[order]
        cuts = np.flatnonzero(np.r_[True, shelf[1:] != shelf[:-1], True])
        data = pa.BinaryArray.from_buffers(pa.binary(), len(cuts) - 1, [
            None, pa.py_buffer((cuts * ENTRY.itemsize).astype(np.int32).tobytes()), pa.py_buffer(entries.tobytes())])
        return pa.RecordBatch.from_arrays([pa.array(shelf[cuts[:-1]]), data], names=["shelf", "entries"])

    def prefixes(batches):
        seen: set[int] = set()
        held: list[np.ndarray] = []
        for batch in slices(batches, "text", PIECE):
            h, at, _, _ = line_sets(batch.column("text"))
            keys, n = set_keys(h, at), np.diff(at)
            pick = _fresh(keys, n > 0, seen)
            h, at, keys, n = h[ranges(at[:-1][pick], n[pick])], np.r_[0, np.cumsum(n[pick])], keys[pick], n[pick]
            token, row, place = ranked(h, at, table.value)
            parity = np.zeros((len(n), 2), np.uint64)
            bit = np.uint64(1) << (token & np.uint64(63))
            half = ((token >> np.uint64(6)) & np.uint64(1)).astype(bool)
            for k, mine in enumerate((~half, half)):
                if len(n):
                    parity[:, k] = np.bitwise_xor.reduceat(np.where(mine, bit, np.uint64(0)), at[:-1])
            use = place <= n[row] - ceil_div(num * n[row], den)
            of = row[use]
            entries = np.empty(len(of), ENTRY)
            for name, values in zip(ENTRY.names, (token[use], keys[of], n[of], place[use], parity[of, 0], parity[of, 1])):
                entries[name] = values
            if len(entries):
                held.append(entries)
            if sum(map(len, held)) >= LOAD:
                yield packed(held)
                held = []
        if held:
            yield packed(held)

    def lists(batches):
        for shelf in groups(batches, "shelf"):
            entries = np.concatenate([flat_bytes(chunk)[0].view(ENTRY) for chunk in shelf["entries"].chunks])
            order = np.lexsort((entries["key"], entries["n"], entries["token"]))
            yield from _linked(entries[order], num, den)

    index = (rows.select("text").mapInArrow(prefixes, "shelf long, entries binary")
             .repartition("shelf").sortWithinPartitions("shelf"))
    return index.mapInArrow(lists, "a long, b long").distinct()


def _linked(rows: np.ndarray, num: int, den: int):
    """Pairs of a list's entries (sorted by token, size and key), by distance in the list, that
    pass the filters and are not yet connected through pairs given before."""
    token, key = rows["token"].copy(), rows["key"].copy()
    if len(token) < 2:
        return
    n, place = rows["n"].astype(np.int64), rows["place"].astype(np.int64)
    bits = np.stack([rows["p"], rows["q"]])
    names, who = np.unique(key, return_inverse=True)
    label = np.arange(len(names))
    front = place <= n - ceil_div(2 * num * n, num + den)  # the shorter prefix of a match's smaller side
    active = np.flatnonzero(front[:-1])
    out, lag = [], 1
    while len(active):
        active = active[active + lag < len(token)]
        other = active + lag
        go_on = (token[other] == token[active]) & (num * n[other] <= den * n[active])
        active, other = active[go_on], other[go_on]
        both = n[active] + n[other]
        least = ceil_div(num * both, num + den)
        left = np.minimum(n[active] - place[active], n[other] - place[other])  # this token and those behind it
        x, y = active[left >= least], other[left >= least]
        room = (both - 2 * least)[left >= least]
        apart = np.bitwise_count(bits[:, x] ^ bits[:, y]).sum(0, dtype=np.int64)
        x, y = x[apart <= room], y[apart <= room]
        a, b = label[who[x]], label[who[y]]
        new = a != b
        if new.any():
            out.append(np.stack([key[x[new]], key[y[new]]], 1))
            parent = np.arange(len(names))
            np.minimum.at(parent, np.maximum(a, b)[new], np.minimum(a, b)[new])
            while (parent[parent] != parent).any():
                parent = parent[parent]
            label = parent[label]
        lag += 1
    if out:
        pairs = np.unique(np.concatenate(out), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _removed(rows: DataFrame, clusters: DataFrame, num: int, den: int) -> DataFrame:
    """``key`` of the sets that match a set with an earlier first line; ``clusters``: ``key, n, cluster, doc_id, line``."""
    bits = rows.sparkSession.sparkContext.broadcast(key_filter(clusters, "key"))

    def wanted(batches):
        seen: set[int] = set()
        for batch in slices(batches, "text", PIECE):
            h, at, _, _ = line_sets(batch.column("text"))
            keys, n = set_keys(h, at), np.diff(at)
            pick = _fresh(keys, (n > 0) & maybe(bits.value, keys), seen)
            flat = h[ranges(at[:-1][pick], n[pick])]
            yield pa.RecordBatch.from_arrays([
                pa.array(keys[pick]),
                pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n[pick])].astype(np.int32)), pa.array(flat.view(np.int64)))],
                names=["key", "tokens"])

    def decided(batches):
        for tile in groups(batches, "tile"):
            key, one = np.unique(tile["key"].to_numpy(), return_index=True)
            if len(key) < 2:
                continue
            column = tile["tokens"].combine_chunks().take(pa.array(one))
            ids, line = tile["doc_id"].to_numpy()[one], tile["line"].to_numpy()[one]
            offsets = np.r_[0, np.cumsum(np.asarray(column.value_lengths(), np.int64))]
            gone = []
            for i, found in answers(np.asarray(column.flatten()), offsets, num, den):
                if ((ids[found] < ids[i]) | (ids[found] == ids[i]) & (line[found] < line[i])).any():
                    gone.append(key[i])
            if gone:
                yield pa.RecordBatch.from_arrays([pa.array(gone, pa.int64())], names=["key"])

    found = rows.select("text").mapInArrow(wanted, "key long, tokens array<long>")
    placed = found.join(tiles(clusters, num, den), "key")
    return (placed.select("tile", "key", "doc_id", "line", "tokens").repartition("tile").sortWithinPartitions("tile")
            .mapInArrow(decided, "key long").distinct())


def removed_lines(docs: DataFrame, num: int = 8, den: int = 10) -> DataFrame:
    """``doc_id, text_key, n_lines`` (those with words), ``removed`` (their 0-based numbers)
    of every distinct pair of id and text (``text_key``: its xxhash64). Runs jobs when called."""
    rows = _rows(docs)
    documents, first, frequency = _sets(rows)
    clusters = components(_links(rows, frequency, num, den)).select(F.col("node").alias("key"), F.col("component").alias("cluster"))
    gone = _removed(rows, written(clusters.join(first.drop("text_key"), "key"), "line_clusters"), num, den)
    kept = first.join(gone, "key", "left_anti").groupBy(*ID).agg(F.collect_list("line").alias("kept"))
    return (documents.distinct().join(kept, ID, "left")
            .select(F.when(F.col("doc_id") != -(1 << 63), F.col("doc_id")).alias("doc_id"), "text_key",
                    F.size("worded").alias("n_lines"),
                    F.array_sort(F.array_except("worded", F.coalesce("kept", F.array().cast("array<int>")))).alias("removed")))


def deduplicated(docs: DataFrame, num: int = 8, den: int = 10) -> DataFrame:
    """The documents, all columns, without their removed lines; those that had words and lost
    all of them are left out. A column named like the join's is kept as it is."""
    found = removed_lines(docs, num, den).select(F.struct("doc_id", "text_key").alias("_of"), "n_lines", "removed")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.struct(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key")).alias("_of"))
    joined = rows.join(found, rows["_of"].eqNullSafe(found["_of"]), "left")
    joined = joined.where("n_lines IS NULL OR n_lines = 0 OR size(removed) < n_lines")
    text = F.when(F.coalesce(F.size("removed"), F.lit(0)) <= 0, F.col("_row.text")).otherwise(
        let(F.col("removed"), lambda gone: F.array_join(
            F.filter(F.split("_row.text", "\n"), lambda line, i: ~F.array_contains(gone, i)), "\n")))
    return joined.select(*[text.alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])
