"""Clipped n-gram matches between a hypothesis and its references.

Two forms with the same result. ``clipped_matches`` counts row by row inside an Arrow
batch: no exploded rows and no shuffle, so scores over large pair tables use it.
``ngram_table`` / ``clip_by_grouping`` keep every n-gram as a row, for jobs that need
the n-grams themselves.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utterscale.functions import codes

SYMBOLS = 1 << 18  # symbols counted at once by one task: its arrays stay in the processor's cache
HELD = 10_000  # rows of one pair from which its n-grams are counted by Spark


def _packed(symbols: np.ndarray, lengths: np.ndarray, row: np.ndarray, side: np.ndarray, rows: int, sides: int,
            order: int, bits: int, of_side: int) -> np.ndarray:
    """Counts from one sort: a number holds the row, the ``order`` symbols from a place on (0 behind
    the end) and the side, so the n-grams of every size are runs of equal beginnings."""
    gap = order - 1
    at = np.arange(len(symbols)) + np.repeat(np.arange(len(lengths)) * gap, lengths)
    padded = np.zeros(len(symbols) + len(lengths) * gap + gap, dtype=np.int64)
    padded[at] = symbols
    size = len(padded) - gap
    key = np.repeat(row, lengths + gap)
    for k in range(order):
        key <<= bits
        key |= padded[k:k + size]
    key <<= of_side
    key |= np.repeat(side, lengths + gap)
    key = np.sort(key[at])
    mine = key & ((1 << of_side) - 1)
    key >>= of_side
    # occurrences before every place, per reference and in all
    before = [np.arange(len(key) + 1)] + [_sums(mine == s) for s in range(1, sides)]
    matches = np.zeros((rows, order), dtype=np.int64)
    for n in range(order, 0, -1):
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        key = key[first]
        before = [np.append(x[first], x[-1]) for x in before]
        total, *refs = [np.diff(x) for x in before]
        most = refs[0] if sides == 2 else np.max(refs, axis=0)
        clipped = np.minimum(total - sum(refs), most)
        use = np.flatnonzero(((key & ((1 << bits) - 1)) != 0) & (clipped > 0))
        matches[:, n - 1] = np.bincount(key[use] >> (bits * n), weights=clipped[use], minlength=rows)
        key = key >> bits
    return matches


def _sums(marks: np.ndarray) -> np.ndarray:
    out = np.zeros(len(marks) + 1, dtype=np.int64)
    np.cumsum(marks, out=out[1:])
    return out


def _renumbered(symbols: np.ndarray, lengths: np.ndarray, row: np.ndarray, side: np.ndarray, rows: int, sides: int,
                order: int) -> np.ndarray:
    """The same for symbols too many to share one number: an n-gram is numbered from its (n-1)-gram
    and its last symbol."""
    end = np.repeat(np.cumsum(lengths), lengths)
    row, side = np.repeat(row, lengths), np.repeat(side, lengths)
    matches = np.zeros((rows, order), dtype=np.int64)
    width = len(symbols) and int(symbols.max()) + 1
    position, code = np.arange(len(symbols)), row
    for n in range(1, order + 1):
        inside = position + n <= end[position]
        position, code = position[inside], code[inside]
        if not len(position):
            break
        _, first, code = np.unique(code * width + symbols[position + n - 1], return_index=True, return_inverse=True)
        counts = [np.bincount(code[side[position] == s], minlength=len(first)) for s in range(sides)]
        clipped = np.minimum(counts[0], np.max(counts[1:], axis=0))
        matches[:, n - 1] = np.bincount(row[position[first]], weights=clipped, minlength=rows)
    return matches


def matches_of(symbols: np.ndarray, lengths: np.ndarray, row: np.ndarray, side: np.ndarray, rows: int, sides: int,
               order: int) -> np.ndarray:
    """``(rows, order)`` clipped matches of texts given as flat symbols, with the length, row and side
    (0 the hypothesis) of every text. Numbers are exact, not hashes."""
    if not len(symbols):
        return np.zeros((rows, order), dtype=np.int64)
    seen = np.zeros(int(symbols.max()) + 1, bool)
    seen[symbols] = True
    of_row, of_side = (rows - 1).bit_length(), (sides - 1).bit_length()
    bits = int(seen.sum()).bit_length()
    if of_row + order * bits + of_side <= 63:
        return _packed(np.cumsum(seen)[symbols], lengths, row, side, rows, sides, order, bits, of_side)
    symbols = codes.ranked_in_rows(symbols, np.repeat(row, lengths))
    bits = int(symbols.max()).bit_length()
    if of_row + order * bits + of_side <= 63:
        return _packed(symbols, lengths, row, side, rows, sides, order, bits, of_side)
    return _renumbered(symbols, lengths, row, side, rows, sides, order)


def clipped_counts(sides: Sequence[codes.Side], order: int) -> np.ndarray:
    """``(rows, order)`` matches: per n-gram the hypothesis count, at most the highest count in one
    reference. The first side is the hypothesis; long texts are taken a few rows at a time."""
    out = [np.zeros((0, order), dtype=np.int64)]
    for a, b in codes.pieces(sum(lengths for _, lengths in sides), SYMBOLS):
        part = [codes.cut(side, a, b) for side in sides]
        out.append(matches_of(np.concatenate([c for c, _ in part]), np.concatenate([n for _, n in part]),
                              np.tile(np.arange(b - a), len(part)), np.repeat(np.arange(len(part)), b - a), b - a,
                              len(part), order))
    return np.concatenate(out)


def count_clipped(hyp: list[str], refs: list[list[str]], order: int) -> np.ndarray:
    """``clipped_counts`` of texts; symbols are code points."""
    return clipped_counts([codes.points(pa.array(side, pa.string())) for side in [hyp, *refs]], order)


def as_lists(rows: np.ndarray) -> pa.Array:
    """``ARRAY<BIGINT>`` per line of a table of numbers."""
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(rows.ravel(), pa.int64()))


def clipped_matches(hyp: Column, refs: Sequence[Column], order: int) -> Column:
    """``ARRAY<BIGINT>`` of clipped matches for n = 1..order; symbols are code points."""
    @F.arrow_udf("array<bigint>")
    def count(h: pa.Array, *rs: pa.Array) -> pa.Array:
        return as_lists(clipped_counts([codes.points(side) for side in (h, *rs)], order))

    return count(hyp, *refs)


def tight_matches(hyp: Column, ref: Column, order: int) -> Column:
    """Struct of ``matches`` (as ``clipped_matches``) and both lengths of two texts without their white space."""
    @F.arrow_udf("struct<matches: array<bigint>, hyp_len: bigint, ref_len: bigint>")
    def count(h: pa.Array, r: pa.Array) -> pa.Array:
        sides = [codes.points(codes.without_spaces(side)) for side in (h, r)]
        return pa.StructArray.from_arrays([as_lists(clipped_counts(sides, order)), *[pa.array(n) for _, n in sides]],
                                          ["matches", "hyp_len", "ref_len"])

    return count(hyp, ref)


def word_report(hyp: Column, ref: Column, sides: Sequence[Column], order: int) -> Column:
    """Struct of the word ``edits`` and ``ref_words`` of two metric texts (see ``codes.metric_text``), and of
    the clipped ``matches`` and ``lengths`` of ``sides``, words between single blanks; the first is the hypothesis."""
    @F.arrow_udf("struct<edits: bigint, ref_words: bigint, matches: array<bigint>, lengths: array<bigint>>")
    def count(h: pa.Array, r: pa.Array, *texts: pa.Array) -> pa.Array:
        raw = codes.word_numbers([codes.filled_words(codes.metric_text(side)) for side in (h, r)])
        split = codes.word_numbers([codes.split_words(side) for side in texts])
        return pa.StructArray.from_arrays(
            [pa.array(codes.edit_distances(*raw)), pa.array(raw[1][1]), as_lists(clipped_counts(split, order)),
             as_lists(np.stack([n for _, n in split], axis=1))], ["edits", "ref_words", "matches", "lengths"])

    return count(hyp, ref, *sides)


def _ngrams(tokens: Column, order: int) -> Column:
    def of_size(n: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1),
                            lambda i: F.struct(n.alias("n"), F.slice(tokens, i, n).alias("gram")))
        return F.when(F.size(tokens) >= n, grams)

    per_size = F.transform(F.array(*[F.lit(n) for n in range(1, order + 1)]), of_size)
    return F.flatten(F.filter(per_size, lambda g: g.isNotNull()))


def ngram_table(pairs: DataFrame, keys: Sequence[str], order: int = 4) -> DataFrame:
    """``keys, n, gram, hyp_count, ref_count`` from token arrays ``hyp_tokens, ref_tokens``.

    ``keys`` identify the pair, so a group holds one n-gram of one utterance. The token
    arrays are placed by pair first: n-grams are then counted where they are made, and
    only the compact rows were shuffled.
    """
    pairs = pairs.select(*keys, "hyp_tokens", "ref_tokens").repartition(*keys)
    sides = F.array(F.struct(F.lit(1).alias("is_hyp"), F.col("hyp_tokens").alias("tokens")),
                    F.struct(F.lit(0).alias("is_hyp"), F.col("ref_tokens").alias("tokens")))
    grams = (pairs.select(*keys, F.inline(sides).alias("is_hyp", "tokens"))
             .select(*keys, "is_hyp", F.inline(_ngrams(F.col("tokens"), order)).alias("n", "gram")))
    return grams.groupBy(*keys, "n", "gram").agg(
        F.sum("is_hyp").alias("hyp_count"), F.sum(1 - F.col("is_hyp")).alias("ref_count"))


def _clip_runs(rows: pa.Table, run: np.ndarray, order: int) -> np.ndarray:
    """``(runs, order, 3)``: clipped, hypothesis and reference n-grams of the rows of every run together."""
    n = int(run[-1]) + 1
    sides = [(column.flatten(), np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64))
             for column in (rows[c].combine_chunks() for c in ("hyp_tokens", "ref_tokens"))]
    sides = codes.word_numbers(sides)
    out = np.zeros((n, order, 3), dtype=np.int64)
    first = np.searchsorted(run, np.arange(n + 1))
    ends = [np.r_[0, np.cumsum(lengths)] for _, lengths in sides]
    for a, b in codes.pieces(sum(np.diff(e[first]) for e in ends), SYMBOLS):
        parts = [codes.cut(side, first[a], first[b]) for side in sides]
        of = run[first[a]:first[b]] - a
        symbols, lengths = np.concatenate([c for c, _ in parts]), np.concatenate([x for _, x in parts])
        out[a:b, :, 0] = matches_of(symbols, lengths, np.tile(of, 2), np.repeat([0, 1], len(of)), b - a, 2, order)
    for size in range(1, order + 1):
        for at, (_, lengths) in enumerate(sides):
            out[:, size - 1, at + 1] = np.bincount(run, weights=np.maximum(lengths - size + 1, 0), minlength=n)
    return out


def clip_by_grouping(pairs: DataFrame, keys: Sequence[str], by: Sequence[str], order: int = 4) -> DataFrame:
    """Corpus totals per ``by``, some of ``keys``, and n: clipped, hypothesis and reference n-grams.

    Rows are placed and sorted by pair, and the n-grams of a pair are counted in its Arrow
    batch, together if several rows have its keys. Only when the rows of one pair fill a whole
    batch are its n-grams given out as rows, which Spark then counts.
    """
    placed = pairs.select(*keys, "hyp_tokens", "ref_tokens").repartition(*keys).sortWithinPartitions(*keys)
    kinds = ", ".join(f"`{k}` {placed.schema[k].dataType.simpleString()}" for k in keys)
    names = [*keys, "n", "gram", "hyp_ngrams", "ref_ngrams", "clipped"]

    def totals(rows: pa.Table, run: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Sums per ``by``, whose other keys and n-gram are null."""
        counted = _clip_runs(rows, run, order)
        first = pa.array(np.searchsorted(run, np.arange(len(counted))))
        head = rows.select(list(keys)).take(first)
        for size in range(order):
            columns = {c: pa.array(counted[:, size, i]) for i, c in enumerate(["clipped", "hyp_ngrams", "ref_ngrams"])}
            some = np.flatnonzero(counted[:, size, 1:].sum(axis=1))  # a pair without n-grams of a size has no row
            table = pa.table({**{k: head[k] for k in by}, **columns}).take(pa.array(some))
            summed = table.group_by(list(by)).aggregate([(c, "sum") for c in columns])
            given = {**{k: summed[k] for k in by}, **{c: summed[f"{c}_sum"] for c in columns}}
            yield from out(given, size + 1, len(summed), head.schema)

    def grams(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """Every n-gram of the rows."""
        for at in range(rows.num_rows):
            row = rows.slice(at, 1)
            for side, column in enumerate(("hyp_tokens", "ref_tokens")):
                words = row[column][0].as_py() or []
                for size in range(1, order + 1):
                    found = [words[i:i + size] for i in range(len(words) - size + 1)]
                    columns = {"gram": pa.array(found, pa.list_(pa.string())),
                               "hyp_ngrams": pa.array(np.full(len(found), 1 - side)), "ref_ngrams": pa.array(np.full(len(found), side))}
                    columns |= {k: pa.chunked_array([pa.concat_arrays([row[k].combine_chunks()] * len(found))]) for k in keys} if found else {}
                    yield from out(columns, size, len(found), rows.schema)

    def out(columns: dict, size: int, count: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        if count:
            kind = {**{k: schema.field(k).type for k in keys}, "n": pa.int32(), "gram": pa.list_(pa.string())}
            every = {"n": pa.array(np.full(count, size, np.int32))} | columns
            yield from pa.table({c: every.get(c, pa.nulls(count, kind.get(c, pa.int64()))) for c in names}).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, spread = None, None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if held is not None:
                rows = pa.concat_tables([held, rows])
            run = _run_numbers(rows, keys)
            cut = int(np.searchsorted(run, run[-1])) if len(run) else 0
            key = rows.select(list(keys)).slice(max(len(run) - 1, 0), 1).to_pylist()
            if spread is not None and len(run):  # the first run goes on with a pair whose n-grams are rows
                if rows.select(list(keys)).slice(0, 1).to_pylist() == spread:
                    begun = int(np.searchsorted(run, 0, side="right"))
                    yield from grams(rows.slice(0, begun))
                    if begun == len(run):
                        held = None
                        continue
                    rows, run, cut = rows.slice(begun), run[begun:] - 1, cut - begun
                spread = None
            if cut:
                yield from totals(rows.slice(0, cut), run[:cut])
            held = rows.slice(cut)
            if held.num_rows >= HELD:
                yield from grams(held)
                held, spread = None, key
        if held is not None and held.num_rows:
            yield from totals(held, np.zeros(held.num_rows, dtype=np.int64))

    found = placed.mapInArrow(run, f"{kinds}, n int, gram array<string>, hyp_ngrams bigint, ref_ngrams bigint, clipped bigint")
    counted = found.groupBy(*keys, "n", "gram").agg(*[F.sum(c).alias(c) for c in ("hyp_ngrams", "ref_ngrams", "clipped")])
    return counted.groupBy(*by, "n").agg(
        F.sum(F.coalesce("clipped", F.least("hyp_ngrams", "ref_ngrams"))).alias("clipped"),
        F.sum("hyp_ngrams").alias("hyp_ngrams"), F.sum("ref_ngrams").alias("ref_ngrams"))


def _run_numbers(rows: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Numbers from 0 of the runs of equal keys; null equals null."""
    new = np.zeros(rows.num_rows, bool)
    for k in keys:
        code = np.asarray(rows[k].combine_chunks().dictionary_encode(null_encoding="encode").indices)
        new[1:] |= code[1:] != code[:-1]
    return np.cumsum(new)
