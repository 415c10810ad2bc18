"""Bytes covered by long strings that occur twice or more, by merging Burrows-Wheeler transforms.

A string of ``length`` bytes is a window. Every window has an anchor, the least hashed
``GRAM``-byte piece in it, so equal windows have equal anchors and lie alike around them.
Windows whose anchor occurs once need no more work. The others, as the segment of text that
the windows of one anchor occurrence span, meet by anchor. There the distinct segments form
shards; each shard's transform is built on its own, and the transforms are merged by refining
the interleave of their rows: one stable pass by the preceding symbol (``STEP`` bytes at a time)
makes the rows ordered by one symbol more. Row boundaries appear at the depth where prefixes
part, which gives the common prefixes; intervals that are still whole at ``length`` bytes are
the repeated windows. No pass sorts suffixes of the whole collection.

Anchors with very many different segments are cut further: windows that lie within
``NARROW`` bytes of each other around the anchor meet by the bytes they all share.

Defined cases: a null text is empty; texts shorter than ``length`` lose nothing; repeated
rows count as occurrences of each other; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterscale.llm.common import flat_bytes, slices, written
from utterscale.llm.token_sets import key_filter, maybe, mix, powers

GRAM = 64
NARROW = 8
CROWD = 4096  # segments of an anchor from which on it is cut further
ANCHOR_BITS = 26  # size of the filter of repeated anchors, 8 MB; a fuller one only lets more pass
PIECE = 1 << 20
BLOCK = 1 << 20  # bytes hashed at a time
SHARD, POOL = 1 << 16, 1 << 17  # bytes of a transform, and of the collection merged at a time
STEP = 32  # bytes of a symbol, 8 times a power of two
ID = ["doc_id", "text_key"]

_RANDOM = mix(np.arange(1, 257, dtype=np.uint64))


def _grams(data: np.ndarray) -> np.ndarray:
    """Hashes of all ``GRAM``-byte pieces: differences of running sums, a block at a time."""
    power, back = powers(1 + (BLOCK - 1).bit_length())
    out = np.empty(len(data) - GRAM + 1, np.uint64)
    for a in range(0, len(out), BLOCK):
        n = min(BLOCK, len(out) - a)
        sums = np.zeros(n + GRAM, np.uint64)
        np.cumsum(_RANDOM[data[a:a + n + GRAM - 1]] * power[:n + GRAM - 1], out=sums[1:])
        out[a:a + n] = mix((sums[GRAM:] - sums[:n]) * back[:n])
    return out


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with the same anchor: anchor hash and place, first and last window start, row."""
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    if len(data) < length:
        return none
    h = _grams(data)
    low = (h & ~np.uint64(0xFFFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    span, wide = 1, length - GRAM + 1
    while span * 2 <= wide:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < wide:
        low = np.minimum(low[:span - wide], low[wide - span:])
    place = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(sizes)), sizes)[:len(place)]
    inside = np.arange(len(place)) + length <= offsets[row + 1]
    at = np.flatnonzero(inside)
    if not len(at):
        return none
    new = np.r_[True, (place[at][1:] != place[at][:-1]) | (row[at][1:] != row[at][:-1])]
    first = at[new]
    last = at[np.r_[np.flatnonzero(new)[1:] - 1, len(at) - 1]]
    return h[place[first]].view(np.int64), place[first], first, last, row[first]


def _radix(symbols: np.ndarray) -> np.ndarray:
    """Stable order by symbol in passes of 16 bits."""
    order = np.argsort((symbols & 0xFFFF).astype(np.uint16), kind="stable")
    if len(symbols) and symbols.max() > 0xFFFF:
        order = order[np.argsort((symbols[order] >> 16).astype(np.uint16), kind="stable")]
    return order


def _named(values: np.ndarray) -> np.ndarray:
    """The rank of every value among the distinct ones."""
    return np.unique(values, return_inverse=True)[1].astype(np.int64)


def _leading(word: np.ndarray, eight: np.ndarray, n: int, rest: int) -> np.ndarray:
    """The rank of the first ``rest`` bytes at each of ``n`` places; ``eight``: those of whole words."""
    whole, left = divmod(rest, 8)
    rank = eight[:n] if whole else np.zeros(n, np.int64)
    for k in range(1, whole):
        rank = _named((rank << 32) | eight[8 * k:8 * k + n])
    if left:
        rank = _named((rank << 32) | _named(word[8 * whole:8 * whole + n] >> np.uint64(8 * (8 - left))))
    return rank


def _rows(strings: list[bytes], rest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Slots of all suffixes: symbol and slot before each, each string's first slot, and the
    rank of every symbol's first ``rest`` bytes.

    A string is padded with zeros to whole symbols and followed by one end slot per offset
    within a symbol; the ends have symbol 0 and stand before the first positions.
    """
    widths = np.array([-(-len(s) // STEP) * STEP + STEP for s in strings])
    starts = np.cumsum(widths) - widths
    flat = np.frombuffer(b"".join(s.ljust(w, b"\0") for s, w in zip(strings, widths)) + b"\0" * STEP, np.uint8)
    n = int(widths.sum())
    word = np.empty(n + STEP - 8, np.uint64)
    for k in range(8):
        part = flat[k:k + (len(flat) - k) // 8 * 8].copy().view(">u8")
        word[k::8] = part[:len(word[k::8])]
    eight = _named(word)
    symbol, width = eight, 8
    while width < STEP:
        symbol = _named((symbol[:-width] << 32) | symbol[width:])
        width *= 2
    short = np.zeros(int(symbol.max(initial=-1)) + 2, np.int32)
    short[symbol + 1] = _leading(word, eight, n, rest) + 1
    symbol = symbol.astype(np.int32) + 1
    before = np.arange(n, dtype=np.int32) - STEP
    ends = (starts + widths - STEP)[:, None] + np.arange(STEP)
    before[(starts[:, None] + np.arange(STEP)).ravel()] = ends.ravel()
    symbol[ends.ravel()] = 0
    return symbol[before], before, starts, short


def transform(symbol: np.ndarray, before: np.ndarray, rounds: int, short: np.ndarray) -> np.ndarray:
    """Slots of one shard ordered by their first ``rounds`` symbols, the last of them by its rank in ``short``."""
    order = np.arange(len(symbol), dtype=np.int32)
    for depth in range(rounds):
        here = symbol[order]
        order = before[order[_radix(here if depth else short[here])]]  # the last symbol of a window comes first
    return order


def merged(transforms: list[np.ndarray], rounds: int, short: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The interleave of the shards' rows, the interval of each row, and the common prefix, in
    symbols, with the row before (``rounds``: at least that)."""
    shard = np.repeat(np.arange(len(transforms), dtype=np.uint16), [len(t) for t in transforms])
    symbols = np.concatenate(transforms)
    interval = np.zeros(len(shard), np.int64)
    common = np.full(len(shard), rounds)
    for depth in range(rounds):
        here = np.empty(len(shard), np.int32)
        here[np.argsort(shard, kind="stable")] = symbols  # every shard's rows in their own order
        here = here if depth else short[here]
        order = _radix(here)
        here, above = here[order], interval[order]
        shard = shard[order]
        part = np.r_[False, (here[1:] != here[:-1]) | (above[1:] != above[:-1])]
        common[part & (common == rounds)] = depth
        interval = np.cumsum(part, dtype=np.int32)
    return shard, interval, common


def repeated(strings: list[bytes], weights: list[int], length: int) -> list[np.ndarray]:
    """For every string the starts of its windows that occur twice or more, counting a string ``weights`` times."""
    rounds = -(-length // STEP)
    symbol, before, starts, short = _rows(strings, length - (rounds - 1) * STEP)
    ends = np.r_[starts[1:], len(symbol)]
    cuts = [0, *(np.flatnonzero(np.diff(starts // SHARD)) + 1).tolist(), len(strings)]
    rows, transforms = [], []
    for a, b in zip(cuts, cuts[1:]):
        lo, hi = starts[a], ends[b - 1]
        order = transform(symbol[lo:hi], before[lo:hi] - lo, rounds, short)
        rows.append(order + lo)
        transforms.append(symbol[lo:hi][order])
    shard, interval, _ = merged(transforms, rounds, short)
    slot = np.empty(len(shard), np.int64)
    slot[np.argsort(shard, kind="stable")] = np.concatenate(rows)
    of = np.repeat(np.arange(len(strings)), ends - starts)
    start = np.arange(len(symbol)) - starts[of]
    valid = (start + length <= np.array([len(s) for s in strings])[of])[slot]
    count = np.bincount(interval, weights=valid * np.array(weights)[of[slot]])
    twice = np.zeros(len(symbol), bool)
    twice[slot] = valid & (count[interval] >= 2)
    at = np.flatnonzero(twice)
    return np.split(start[at], np.searchsorted(at, ends[:-1]))


def _spans(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by windows of ``length`` at ascending ``starts``."""
    if not len(starts):
        return starts, starts
    gap = np.flatnonzero(np.diff(starts) > length)
    return starts[np.r_[0, gap + 1]], starts[np.r_[gap, len(starts) - 1]] + length


def _digest(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"".join(parts), digest_size=8).digest(), "little", signed=True)


def _segments(rows: DataFrame, bits: np.ndarray, length: int) -> DataFrame:
    """Occurrences (``doc_id, text_key, at, anchor, seg``) and, once per task piece, segments (``anchor, seg, lead, n, bytes``)."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)
    kinds = {"doc_id": pa.int64(), "text_key": pa.int64(), "at": pa.int64(), "anchor": pa.int64(), "seg": pa.int64(),
             "lead": pa.int32(), "n": pa.int64(), "bytes": pa.binary()}

    def record(size, **columns):
        return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(size, k)
                                           for c, k in kinds.items()], names=list(kinds))

    def run(batches):
        for batch in slices(batches, "text", 4 * PIECE):
            data, offsets = flat_bytes(batch.column("text"))
            hashes, place, first, last, row = anchors(data, offsets, length)
            pick = np.flatnonzero(maybe(shared.value, hashes))
            whole = data.tobytes()
            found: dict[tuple[int, int], list] = {}
            segs = []
            for p, h, a, b in zip(place[pick].tolist(), hashes[pick].tolist(), first[pick].tolist(), last[pick].tolist()):
                text = whole[a:b + length]
                seg = _digest((p - a).to_bytes(4, "little"), text)
                segs.append(seg)
                if (h, seg) in found:
                    found[h, seg][1] += 1
                else:
                    found[h, seg] = [p - a, 1, text]
            of = row[pick]
            yield record(len(pick), doc_id=batch.column("doc_id").to_numpy()[of], text_key=batch.column("text_key").to_numpy()[of],
                         at=first[pick] - offsets[of], anchor=hashes[pick], seg=segs)
            if found:
                (h, seg), (lead, n, text) = zip(*found), zip(*found.values())
                yield record(len(found), anchor=h, seg=seg, lead=lead, n=n, bytes=text)

    return rows.mapInArrow(run, "doc_id long, text_key long, at long, anchor long, seg long, lead int, n long, bytes binary")


def _meeting(segments: DataFrame, length: int) -> DataFrame:
    """``meet, anchor, seg, skip, n, bytes``: segments by the value their windows must share."""
    crowded = segments.groupBy("anchor").agg(F.count("*").alias("c")).where(F.col("c") > CROWD)
    shared = segments.sparkSession.sparkContext.broadcast(key_filter(crowded, "anchor"))

    def run(batches):
        for batch in batches:
            busy = maybe(shared.value, batch.column("anchor").to_numpy())
            if not busy.any():
                yield pa.RecordBatch.from_arrays(
                    [batch.column("anchor"), batch.column("anchor"), batch.column("seg"),
                     pa.array(np.zeros(batch.num_rows, np.int32)), batch.column("n"), batch.column("bytes")],
                    names=["meet", "anchor", "seg", "skip", "n", "bytes"])
                continue
            out = []
            for many, r in zip(busy.tolist(), batch.to_pylist()):
                if not many:
                    out.append((r["anchor"], r["anchor"], r["seg"], 0, r["n"], r["bytes"]))
                    continue
                # the window at start s has the anchor lead - s bytes in; windows alike in that by NARROW share a core
                tail = len(r["bytes"]) - length
                for band in range((r["lead"] - tail) // NARROW, r["lead"] // NARROW + 1):
                    lo, hi = max(0, r["lead"] - band * NARROW - NARROW + 1), min(tail, r["lead"] - band * NARROW)
                    core = r["bytes"][r["lead"] - band * NARROW:r["lead"] - band * NARROW - NARROW + 1 + length]
                    meet = _digest(r["anchor"].to_bytes(8, "little", signed=True), band.to_bytes(4, "little", signed=True), core)
                    out.append((meet, r["anchor"], r["seg"], lo, r["n"], r["bytes"][lo:hi + length]))
            columns = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [
                pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()])],
                names=["meet", "anchor", "seg", "skip", "n", "bytes"])

    return segments.select("anchor", "seg", "lead", "n", "bytes").mapInArrow(
        run, "meet long, anchor long, seg long, skip int, n long, bytes binary")


def _found(meeting: DataFrame, length: int) -> DataFrame:
    """``anchor, seg, a, b``: the covered runs of every segment that has any, relative to its start."""
    def met(batches):
        """Per group its texts, each with its count and the segments it stands for."""
        last, texts = None, {}
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("meet", "bytes", "n", "anchor", "seg", "skip")]
            for meet, text, n, h, seg, skip in zip(*columns):
                if meet != last and texts:
                    yield texts
                    texts = {}
                last = meet
                entry = texts.setdefault(text, [0, set()])
                entry[0] += n
                entry[1].add((h, seg, skip))
        if texts:
            yield texts

    def run(batches):
        pool, size = [], 0  # (text, count, [(anchor, seg, skip)]) of groups with several texts

        def rows(results):
            out = [(h, seg, (starts + skip).tolist(), (stops + skip).tolist())
                   for names, starts, stops in results if len(starts) for h, seg, skip in names]
            if out:
                h, seg, a, b = zip(*out)
                spans = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(seg, pa.int64()), pa.array(a, spans),
                                                  pa.array(b, spans)], names=["anchor", "seg", "a", "b"])

        def decided():
            windows = repeated([p[0] for p in pool], [p[1] for p in pool], length)
            return rows([(p[2], *_spans(w, length)) for p, w in zip(pool, windows)])

        alone: list[tuple] = []  # of groups with one text that occurs several times
        for texts in met(batches):
            if len(texts) == 1:
                (text, (n, names)), = texts.items()
                if n > 1:
                    alone.append((names, np.array([0]), np.array([len(text)])))
                if len(alone) >= 10_000:
                    yield from rows(alone)
                    alone = []
                continue
            pool += [(text, min(n, 2), names) for text, (n, names) in texts.items()]
            size += sum(map(len, texts))
            if size >= POOL:
                yield from decided()
                pool, size = [], 0
        yield from rows(alone)
        if pool:
            yield from decided()

    placed = meeting.repartition("meet").sortWithinPartitions("meet")
    return placed.mapInArrow(run, "anchor long, seg long, a array<long>, b array<long>")


def removed(docs: DataFrame, length: int = 200) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept``: one row per row of ``doc_id, text``.

    ``kept`` is the remaining bytes. Document ids are integers; ``length`` is at least
    ``GRAM``. Runs jobs when called.
    """
    if length < GRAM:
        raise ValueError(f"length below {GRAM}")
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"),
                       F.xxhash64("text").alias("text_key"), text.alias("text"))

    def seen(batches):
        for batch in slices(batches, "text", 4 * PIECE):
            hashes = anchors(*flat_bytes(batch.column("text")), length)[0]
            key, n = np.unique(hashes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64))], names=["anchor", "n"])

    counts = rows.select("text").mapInArrow(seen, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    bits = key_filter(counts.where("n > 1"), "anchor", ANCHOR_BITS)
    table = written(_segments(rows, bits, length), "segments")
    segments, occurrences = table.where("bytes IS NOT NULL"), table.where("bytes IS NULL")
    found = _found(_meeting(segments, length), length).groupBy("anchor", "seg").agg(
        F.flatten(F.collect_list("a")).alias("a"), F.flatten(F.collect_list("b")).alias("b"))
    spans = (occurrences.select(*ID, "at", "anchor", "seg").join(found, ["anchor", "seg"])
             .select(*ID, F.explode(F.arrays_zip(F.transform("a", lambda x: x + F.col("at")).alias("a"),
                                                 F.transform("b", lambda x: x + F.col("at")).alias("b"))).alias("s")))
    spans = written(spans.groupBy(*ID).agg(F.sort_array(F.collect_set("s")).alias("spans")), "spans")
    touched = docs.sparkSession.sparkContext.broadcast(key_filter(spans, "text_key"))

    def marked(batches):
        for batch in batches:
            yield batch.append_column("some", pa.array(maybe(touched.value, batch.column("text_key").to_numpy())))

    flagged = rows.mapInArrow(marked, "doc_id long, text_key long, text binary, some boolean")
    changed = flagged.where("some").drop("some").join(spans, ID, "left")

    def cut(batches):
        for batch in slices(batches, "text", 4 * PIECE):
            out = []
            for text, parts in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                kept, gone, n, end, start = [], 0, 0, 0, None
                for s in parts or []:
                    if start is None or s["0"] > end:
                        kept.append(text[end:s["0"]])
                        gone, n = gone - (0 if start is None else start) + end, n + 1
                        start, end = s["0"], s["1"]
                    else:
                        end = max(end, s["1"])
                gone = gone - (start or 0) + end
                kept = b"".join([*kept, text[end:]])
                out.append((len(text), gone, n, hashlib.sha256(kept).hexdigest(), kept))
            sizes, gone, n, digest, kept = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(n, pa.int64()),
                 pa.array(digest, pa.string()), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    changed = changed.select("doc_id", "text", F.transform("spans", lambda s: F.struct(
        s["a"].alias("0"), s["b"].alias("1"))).alias("spans")).mapInArrow(
        cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    as_is = flagged.where("NOT some").select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), F.col("text").alias("kept"))
    return changed.unionByName(as_is).withColumn(
        "doc_id", F.when(F.col("doc_id") != -(1 << 63), F.col("doc_id")))
