"""Repeated word windows by fixed blocks: every window but its first occurrence is removed.

A window is ``window`` consecutive words of one document. The index holds the reference
blocks: the runs of half as many words that start at multiples of their length. Whatever its
place, a window holds one whole reference block of its own document, so an equal window
elsewhere hits that block with one of the rolling runs of words inside it. Every rolling run
of every document probes the index; blocks that only hit themselves are done with. A hit is
extended to both sides over all windows around it, word by word: a window that equals an
earlier one is repeated, and neighbouring repeated windows join into maximal repeats. The
earliest of equal windows is found in the task first, then among the earliest of all tasks.

Blocks meet by 30 bits of a hash within a shelf (a false hit only makes a candidate), windows
by a 64-bit hash. Hashes travel packed, one row per task load and shelf; the number of shelves
grows with the words, and a task load sends an equal block or window once, however common.

Defined cases: a null text has no words; rows that repeat an id and a text are one document,
each gets its result; rows with one id and different texts are documents of their own, in
the order of the texts' xxhash64; a null id comes after all others; a document is handled
by one task, however long; an empty table gives no rows; extra columns are ignored. Document
ids are integers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterscale.llm.common import flat_bytes, slices, written
from utterscale.llm.token_sets import groups, key_filter, maybe, mix

PIECE = 1 << 21  # bytes of text hashed at a time
LOAD = 1 << 21  # hashes a task holds before it hands them out
SHELF = 1 << 21  # about so many hashes share a shelf
FILTER_BITS = 27  # size of the filter of repeated blocks, 16 MB at most; a fuller one only lets more windows pass
ID = ["no_id", "doc", "text_key"]

_ODD = np.uint64(0x9E3779B97F4A7C15)
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def _powers(base: int, n: int) -> np.ndarray:
    power = np.full(n, base, np.uint64)
    power[0] = 1
    return np.cumprod(power, dtype=np.uint64)


_BASE = 0xD1342543DE82EF95
_POWER = _powers(_BASE, 1 << 16)
_INVERSE = _powers(pow(_BASE, -1, 1 << 64), 1 << 16)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word, and the number of words of every row."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    solid = ~_WHITE[data]
    edge = np.zeros(len(data) + 1, bool)  # a word starts or ends before this byte
    edge[0], edge[-1] = solid[0], solid[-1]
    np.not_equal(solid[1:], solid[:-1], out=edge[1:-1])
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    joint = np.unique(inner[solid[inner] & solid[inner - 1]])  # a word ends and another starts
    at = np.flatnonzero(edge)
    if len(joint):
        at = np.sort(np.r_[at, joint, joint])
    starts, ends = at[::2], at[1::2]
    # values of bytes times powers of the base, restarted every 2^16 bytes; a word in two stretches is the sum of both
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    value = data.astype(np.uint64)
    value += np.uint64(1)
    for a in range(0, len(data), len(_POWER)):
        value[a:a + len(_POWER)] *= _POWER[:len(value) - a]
    np.cumsum(value, out=total[1:])
    low = starts & 0xFFFF
    stretch = starts >> 16
    h = (total[ends] - total[starts]) * _INVERSE[low]
    wide = np.flatnonzero(stretch != (ends - 1) >> 16)
    for i in wide.tolist():  # words over a border: one in some ten thousand
        word = data[starts[i]:ends[i]].astype(np.uint64) + np.uint64(1)
        s, scale = 0, 1
        for b in range(0, len(word), len(_POWER)):
            part = word[b:b + len(_POWER)]
            s += scale * int((part * _POWER[:len(part)]).sum(dtype=np.uint64))
            scale = scale * int(_POWER[-1]) * _BASE % (1 << 64)
        h[i] = s % (1 << 64)
    rows = np.searchsorted(starts, offsets)
    return mix(h + (ends - starts).astype(np.uint64) * _ODD), np.diff(rows)


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` values, from runs of powers of two."""
    parts, size, done, at = h, 1, None, 0
    while True:
        if width & size:
            if done is None:
                done = parts
            else:
                n = len(h) - at - size + 1
                done = mix(done[:n] * _ODD + parts[at:at + n]) if n > 0 else h[:0]
            at += size
        if size * 2 > width:
            return done
        size *= 2
        n = len(h) - size + 1
        parts = mix(parts[:n] * _ODD + (parts[size // 2:size // 2 + n] ^ np.uint64(size))) if n > 0 else h[:0]


def _places(counts: np.ndarray, width: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and place in it of the first ``n`` words, and which runs of ``width`` words stay in their row."""
    begin = np.cumsum(counts) - counts
    row = np.repeat(np.arange(len(counts)), counts)[:n]
    place = np.arange(n) - begin[row]
    return row, place, place + width <= counts[row]


def _shelved(hashes: np.ndarray, shelves: int) -> np.ndarray:
    """Shelf of every hash, by its high bits: ascending hashes have ascending shelves."""
    return ((hashes >> np.uint64(32)) * np.uint64(shelves) >> np.uint64(32)).astype(np.int64)


def _slots(shelf: np.ndarray | int, short: np.ndarray) -> np.ndarray:
    """The two filter positions of every block, from its shelf and 30 bits of hash, one row each."""
    m = mix((np.uint64(1) * np.asarray(shelf, np.uint64) << np.uint64(30)) | (short >> 2).astype(np.uint64))
    return np.stack([m & np.uint64((1 << FILTER_BITS) - 1), m >> np.uint64(64 - FILTER_BITS)]).astype(np.int64)


def _binary(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """``values`` cut at ``cuts`` as one binary value each."""
    return pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [
        None, pa.py_buffer((cuts * values.itemsize).astype(np.int64).tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())]).cast(pa.binary())


def _repeated_blocks(rows: DataFrame, block: int, shelves: int) -> DataFrame:
    """``slot``: the filter positions of the reference blocks that a run of words at another place equals."""
    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        # the lowest bits: 1 if some occurrence is a reference block, 2 if there are two or more
        x = np.sort(np.concatenate(held))
        first = np.flatnonzero(np.r_[True, (x[1:] ^ x[:-1]) > 3])
        own = np.bitwise_or.reduceat(x, first)
        own[np.diff(np.r_[first, len(x)]) > 1] |= np.uint64(2)
        shelf = _shelved(own, shelves)
        cuts = np.flatnonzero(np.r_[True, shelf[1:] != shelf[:-1], True])
        return pa.RecordBatch.from_arrays([pa.array(shelf[cuts[:-1]]), _binary(own.astype(np.uint32), cuts)], names=["shelf", "hashes"])

    def probes(batches):
        held, size = [], 0
        for batch in slices(batches, "text", PIECE):
            h, counts = word_hashes(*flat_bytes(batch.column("text")))
            runs = rolling(h, block)
            _, place, inside = _places(counts, block, len(runs))
            runs = (runs & ~np.uint64(3)) | (place % block == 0)
            held.append(runs[inside])
            size += len(held[-1])
            if size >= LOAD:
                yield packed(held)
                held, size = [], 0
        if size:
            yield packed(held)

    def hits(batches):
        for shelf in groups(batches, "shelf"):
            x = np.sort(np.concatenate([flat_bytes(c)[0].view("<u4") for c in shelf["hashes"].chunks]))
            first = np.flatnonzero(np.r_[True, (x[1:] ^ x[:-1]) > 3])
            flags = np.bitwise_or.reduceat(x, first)
            twice = (np.diff(np.r_[first, len(x)]) > 1) | (flags & 2 > 0)
            slots = _slots(shelf["shelf"][0].as_py(), flags[twice & (flags & 1 > 0)])
            yield pa.RecordBatch.from_arrays([pa.array(slots.ravel())], names=["slot"])

    return (rows.select("text").mapInArrow(probes, "shelf long, hashes binary")
            .repartition(_tasks(rows, shelves), "shelf").sortWithinPartitions("shelf").mapInArrow(hits, "slot long"))


def _tasks(rows: DataFrame, shelves: int) -> int:
    """Partitions for so many shelves: the session's number, and at most some eight shelves to a task."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), shelves // 8)


_NAME = [("no_id", bool), ("doc", np.int64), ("key", np.int64)]
_IDS = pa.struct([("no_id", pa.bool_()), ("doc", pa.int64()), ("text_key", pa.int64())])
_PACKED = "ids array<struct<no_id: boolean, doc: long, text_key: long>>, counts array<int>, places binary"


def _packed(part: np.ndarray, name: np.ndarray, place: np.ndarray, h: np.ndarray | None = None) -> list[pa.Array]:
    """One row per part: its documents, how many places each has, the places and their hashes."""
    order = np.lexsort((place, name["key"], name["doc"], name["no_id"], part))
    part, name, place = part[order], name[order], place[order]
    new = part[1:] != part[:-1]
    cuts = np.flatnonzero(np.r_[True, new, True])
    runs = np.flatnonzero(np.r_[True, new | (name[1:] != name[:-1]), True])
    lists, who = pa.array(np.searchsorted(runs, cuts).astype(np.int32)), name[runs[:-1]]
    ids = pa.StructArray.from_arrays([pa.array(who[k]) for k in ("no_id", "doc", "key")], fields=list(_IDS))
    rows = [pa.array(part[cuts[:-1]]), pa.ListArray.from_arrays(lists, ids),
            pa.ListArray.from_arrays(lists, pa.array(np.diff(runs).astype(np.int32))), _binary(place.astype(np.uint32), cuts)]
    return rows + ([] if h is None else [_binary(h[order], cuts)])


def _unpacked(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The documents and places of packed rows."""
    ids, counts = rows["ids"].combine_chunks().flatten(), np.asarray(rows["counts"].combine_chunks().flatten())
    one = np.empty(len(ids), _NAME)
    for k, name in enumerate(("no_id", "doc", "key")):
        one[name] = ids.field(k).to_numpy(zero_copy_only=False)
    return np.repeat(one, counts), np.concatenate([flat_bytes(c)[0].view("<u4") for c in rows["places"].chunks])


def _answers(name: np.ndarray, place: np.ndarray, parts: int) -> list[pa.Array]:
    """Places packed by part, a range of documents' hashes."""
    return _packed(_shelved(mix(name["key"].view(np.uint64)), parts), name, place)


def _per_document(batches):
    """``no_id, doc, text_key, starts`` of packed answers, one row per document."""
    for part in groups(batches, "part"):
        name, place = _unpacked(part)
        order = np.lexsort((place, name["key"], name["doc"], name["no_id"]))
        name, place = name[order], place[order]
        cuts = np.flatnonzero(np.r_[True, name[1:] != name[:-1], True])
        yield pa.RecordBatch.from_arrays([*[pa.array(name[k][cuts[:-1]]) for k in ("no_id", "doc", "key")],
                                          _binary(place.astype(np.uint32), cuts)], names=[*ID, "starts"])


def _repeated_windows(rows: DataFrame, bits: np.ndarray, window: int, block: int, shelves: int) -> DataFrame:
    """``no_id, doc, text_key, starts``: packed starts of windows that equal an earlier one, per document that has any."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)
    columns = ["part", "ids", "counts", "places", "hashes"]

    def load(held: list[tuple]):
        """The windows of a task load: repeats among themselves, and the earliest of each packed by shelf."""
        names = np.concatenate([h[0] for h in held])  # records of the documents
        first = np.cumsum([0, *[len(h[0]) for h in held]])
        row = np.concatenate([h[1] + a for h, a in zip(held, first)])
        place, h = np.concatenate([x[2] for x in held]), np.concatenate([x[3] for x in held])
        names, rank = np.unique(names, return_inverse=True)
        at = (rank[row].astype(np.uint64) << np.uint64(32)) | place.astype(np.uint64)
        order = np.lexsort((at, h))
        h, at = h[order], at[order]
        new = np.r_[True, h[1:] != h[:-1]]
        least = at[new][np.cumsum(new) - 1]
        gone = at != least
        return names, h[new], at[new], at[gone]

    def windows(batches):
        held, size = [], 0

        def out():
            names, h, at, gone = load(held)
            gone = np.unique(gone)
            low = np.uint64(0xFFFFFFFF)
            if len(gone):
                rows = _answers(names[(gone >> np.uint64(32)).astype(np.int64)], gone & low, shelves)
                yield pa.RecordBatch.from_arrays([*rows, pa.nulls(len(rows[0]), pa.binary())], names=columns)
            yield pa.RecordBatch.from_arrays(
                _packed(_shelved(h, shelves), names[(at >> np.uint64(32)).astype(np.int64)], at & low, h), names=columns)

        for batch in slices(batches, "text", PIECE):
            h, counts = word_hashes(*flat_bytes(batch.column("text")))
            runs = rolling(h, block)
            if len(h) < window:
                continue
            short = ((runs >> np.uint64(2)) & np.uint64(0x3FFFFFFF)).astype(np.uint32) << np.uint32(2)
            slots = _slots(_shelved(runs, shelves), short)
            hit = maybe(shared.value, slots[0])
            some = np.flatnonzero(hit)
            hit[some] = maybe(shared.value, slots[1][some])
            before = np.r_[0, np.cumsum(hit)]
            n = len(h) - window + 1
            row, place, inside = _places(counts, window, n)
            near = before[np.arange(n) + window - block + 1] > before[:n]  # one of the blocks of the window hits
            pick = np.flatnonzero(near & inside)
            names = np.empty(batch.num_rows, _NAME)
            names["no_id"], names["doc"] = batch.column("no_id").to_numpy(zero_copy_only=False), batch.column("doc").to_numpy()
            names["key"] = batch.column("text_key").to_numpy()
            if len(pick):
                held.append((names, row[pick], place[pick], rolling(h, window)[pick]))
                size += len(pick)
            if size >= LOAD:
                yield from out()
                held, size = [], 0
        if size:
            yield from out()

    def earliest(batches):
        pool, size = [], 0

        def out():
            found = _answers(np.concatenate([x[0] for x in pool]), np.concatenate([x[1] for x in pool]), shelves)
            return pa.RecordBatch.from_arrays(found, names=columns[:4])

        for shelf in groups(batches, "part"):
            name, place = _unpacked(shelf)
            h = np.concatenate([flat_bytes(c)[0].view("<u8") for c in shelf["hashes"].chunks])
            order = np.lexsort((place, name["key"], name["doc"], name["no_id"], h))
            h, place, name = h[order], place[order], name[order]
            new = np.r_[True, h[1:] != h[:-1]]
            least = np.flatnonzero(new)[np.cumsum(new) - 1]
            gone = (name != name[least]) | (place != place[least])
            if gone.any():
                pool.append((name[gone], place[gone]))
                size += int(gone.sum())
            if size >= LOAD:
                yield out()
                pool, size = [], 0
        if pool:
            yield out()

    both = written(rows.mapInArrow(windows, f"part long, {_PACKED}, hashes binary"), "windows")
    asked, known = both.where("hashes IS NOT NULL"), both.where("hashes IS NULL").drop("hashes")
    tasks = _tasks(rows, shelves)
    across = asked.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(earliest, f"part long, {_PACKED}")
    return (known.unionByName(across).repartition(tasks, "part").sortWithinPartitions("part")
            .mapInArrow(_per_document, "no_id boolean, doc long, text_key long, starts binary"))


def removed(docs: DataFrame, window: int = 20, texts: bool = True) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept``: one row per row of ``doc_id, text``.

    ``kept`` is the remaining words joined by single spaces, as UTF-8 (null with ``texts`` off).
    ``window`` is 3 or more. Runs jobs when called.
    """
    if window < 3:
        raise ValueError("a window has three words at least")
    block = (window + 1) // 2  # a window holds 2 * block - 1 words or more, so one whole reference block
    rows = docs.select(F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc"),
                       F.xxhash64("text").alias("text_key"), F.col("text").cast("binary").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shelves = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // (6 * SHELF))
    bits = key_filter(_repeated_blocks(rows, block, shelves), "slot", FILTER_BITS)
    spans = written(_repeated_windows(rows, bits, window, block, shelves), "starts")
    touched = docs.sparkSession.sparkContext.broadcast(key_filter(spans, "text_key"))

    def cut(batch: pa.RecordBatch, starts: list[bytes | None]) -> pa.RecordBatch:
        sizes, gone, digests, left = [], [], [], []
        for text, found in zip(batch.column("text").to_pylist(), starts):
            words = (text or b"").split()  # at the six separators
            n = len(words)
            if found:
                at = np.frombuffer(found, "<u4").astype(np.int64)
                step = np.bincount(at, minlength=n + 1) - np.bincount(at + window, minlength=n + 1)
                words = [words[i] for i in np.flatnonzero(np.cumsum(step)[:n] == 0).tolist()]
            kept = b" ".join(words)
            sizes.append(n)
            gone.append(n - len(words))
            digests.append(hashlib.sha256(kept).hexdigest())
            left.append(kept if texts else None)
        doc = pa.array(batch.column("doc").to_numpy(), mask=batch.column("no_id").to_numpy(zero_copy_only=False))
        return pa.RecordBatch.from_arrays([doc, pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string()),
                                           pa.array(left, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    def some(batch: pa.RecordBatch) -> np.ndarray:
        return maybe(touched.value, batch.column("text_key").to_numpy())

    def untouched(batches):
        for batch in slices(batches, "text", PIECE):
            own = batch.filter(pa.array(~some(batch)))
            if own.num_rows:
                yield cut(own, [None] * own.num_rows)

    def maybe_touched(batches):
        for batch in batches:
            yield batch.filter(pa.array(some(batch)))

    def changed(batches):
        for batch in slices(batches, "text", PIECE):
            yield cut(batch, batch.column("starts").to_pylist())

    result = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary"
    joined = rows.mapInArrow(maybe_touched, "no_id boolean, doc long, text_key long, text binary").join(spans, ID, "left")
    both = rows.mapInArrow(untouched, result).unionByName(joined.mapInArrow(changed, result))
    return both.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
