"""Edits with block shifts for the translation edit rate.

A shift moves a run of hypothesis words that also occurs in the reference. Shifts are
taken greedily while they lower the edit distance; each costs one edit.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from utterscale.functions import codes
from utterscale.operators.align import CELLS, distance_tables, fill_rows, size_chunks

# Fixed values of the metric: longest run moved, furthest distance, candidates per pair.
MAX_RUN, MAX_DISTANCE, MAX_CANDIDATES = 10, 50, 1000

BATCH = 1 << 16  # runs whose places are tried at once, fewer when hypotheses are long


def _errors_and_places(hyp: np.ndarray, ref: np.ndarray, n: np.ndarray, m: np.ndarray, tables: np.ndarray):
    """From the cheapest path (match / substitute, then hypothesis-only, then
    reference-only) of every pair: counts of wrong hypothesis and reference words before each
    place, and for every reference word the hypothesis place it belongs to."""
    hyp_wrong, ref_wrong = np.zeros(hyp.shape, bool), np.zeros(ref.shape, bool)
    place = np.zeros(ref.shape, dtype=np.int64)
    k, i, j = np.arange(len(hyp)), n.copy(), m.copy()
    while len(k):
        up, left = np.maximum(i - 1, 0), np.maximum(j - 1, 0)
        here, differ = tables[k, i, j], hyp[k, up] != ref[k, left]
        both = (i > 0) & (j > 0) & (tables[k, up, left] + differ == here)
        hyp_only = ~both & (i > 0) & (tables[k, up, j] + 1 == here)
        ref_only = ~both & ~hyp_only
        at = np.flatnonzero(both)
        hyp_wrong[k[at], up[at]] = ref_wrong[k[at], left[at]] = differ[at]
        hyp_wrong[k[hyp_only], up[hyp_only]] = True
        ref_wrong[k[ref_only], left[ref_only]] = True
        at = np.flatnonzero(~hyp_only)
        place[k[at], left[at]] = i[at] - 1
        i, j = i - (both | hyp_only), j - (both | ref_only)
        on = (i > 0) | (j > 0)
        k, i, j = k[on], i[on], j[on]
    return _sums(hyp_wrong), _sums(ref_wrong), place


def _sums(wrong: np.ndarray) -> np.ndarray:
    """Prefix counts: a run has an error when its two ends differ."""
    out = np.zeros((len(wrong), wrong.shape[1] + 1), dtype=np.int32)
    np.cumsum(wrong, axis=1, out=out[:, 1:])
    return out


def _runs(hyp: np.ndarray, ref: np.ndarray, n: np.ndarray, m: np.ndarray, tables: np.ndarray, room: np.ndarray):
    """Runs worth moving as ``pair, start in hypothesis, start in reference, length``, in the order of
    pairs, and the places of the reference words. A pair that has no room for all of them gets none.

    Words that already stand where they belong start no run.
    """
    hyp_wrong, ref_wrong, place = _errors_and_places(hyp, ref, n, m, tables)
    k, h, r = np.nonzero(hyp[:, :, None] == ref[:, None, :])
    near = (place[k, r] != h) & (np.abs(h - r) <= MAX_DISTANCE)
    k, h, r = k[near], h[near], r[near]
    found, counts = [], np.zeros(len(hyp), dtype=np.int64)
    for length in range(1, MAX_RUN + 1):
        use = ((hyp_wrong[k, h] != hyp_wrong[k, h + length]) & (ref_wrong[k, r] != ref_wrong[k, r + length])
               & ~((h <= place[k, r]) & (place[k, r] < h + length)))
        found.append((k[use], h[use], r[use], np.full(int(use.sum()), length)))
        counts += np.bincount(k[use], minlength=len(hyp))
        on = np.flatnonzero((h + length < n[k]) & (r + length < m[k]) & (counts < room)[k])
        on = on[hyp[k[on], h[on] + length] == ref[k[on], r[on] + length]]
        k, h, r = k[on], h[on], r[on]
    runs = [np.concatenate(x) for x in zip(*found)]
    runs = [x[(counts < room)[runs[0]]] for x in runs]  # every run can go to a place at least
    order = np.argsort(runs[0], kind="stable")
    return [x[order] for x in runs], place


def _moves(k: np.ndarray, h: np.ndarray, r: np.ndarray, length: np.ndarray, place: np.ndarray):
    """Shifts worth trying, as ``pair, length, start, target``."""
    size = length + 1
    run = np.repeat(np.arange(len(k)), size)
    at = r[run] - 1 + np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size)
    target = np.where(at < 0, 0, place[k[run], np.maximum(at, 0)] + 1)
    new = np.ones(len(run), bool)
    new[1:] = (run[1:] != run[:-1]) | (target[1:] != target[:-1])
    run, target = run[new], target[new]
    return k[run], length[run], h[run], target


def _moved(hyp: np.ndarray, n: np.ndarray, length: np.ndarray, start: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The run ``start .. start + length`` of every row put before the word now at ``target``."""
    # inside the run itself it swaps with what follows
    to = np.where(target > start + length, target - length, np.where(target > start, np.minimum(target, n - length), target))
    place = np.arange(hyp.shape[1])[None]
    n, length, start, to = (x[:, None] for x in (n, length, start, to))
    rest = np.where(place < to, place, place - length)
    source = np.where((place >= to) & (place < to + length), start + place - to, np.where(rest < start, rest, rest + length))
    return np.take_along_axis(hyp, np.where(place < n, source, place), axis=1)


def _side(rows: np.ndarray, n: np.ndarray) -> codes.Side:
    return rows[np.arange(rows.shape[1])[None] < n[:, None]], n


def _best_moves(hyp: np.ndarray, ref: np.ndarray, n: np.ndarray, m: np.ndarray, tables: np.ndarray, now: np.ndarray,
                room: np.ndarray):
    """The pairs that gain by a shift and their hypotheses after the best one (the longer run, the
    earlier start, the earlier target on a tie), and the number of shifts tried per pair."""
    (k, h, r, length), place = _runs(hyp, ref, n, m, tables, room)
    tried, counts = np.zeros(len(hyp), dtype=np.int64), np.bincount(k, minlength=len(hyp))
    ends = np.cumsum(counts)
    pairs, better = [np.zeros(0, np.int64)], [hyp[:0]]
    limit = max(1, min(BATCH, CELLS // (1 + hyp.shape[1]) // (MAX_RUN + 1)))
    for a, b in codes.pieces(counts, limit):
        part = slice(int(ends[a] - counts[a]), int(ends[b - 1]))
        of, size, start, target = _moves(k[part], h[part], r[part], length[part], place)
        made = np.bincount(of, minlength=len(hyp))
        tried[a:b] = made[a:b]
        use = (made < room)[of]
        of, size, start, target = of[use], size[use], start[use], target[use]
        shifted = _moved(hyp[of], n[of], size, start, target)
        gain = now[of] - codes.edit_distances(_side(shifted, n[of]), _side(ref[of], m[of]))
        order = np.lexsort((-target, -start, size, gain, of))
        order = order[np.r_[of[order][1:] != of[order][:-1], True]] if len(order) else order
        order = order[gain[order] > 0]
        pairs.append(of[order])
        better.append(shifted[order])
    return np.concatenate(pairs), np.concatenate(better), tried


def _chunk_edits(hyps: Sequence[np.ndarray], refs: Sequence[np.ndarray]) -> np.ndarray:
    """Shifts plus remaining edits per pair. Every round tries the shifts of all pairs
    that still gain, in one batch."""
    n, m = (np.array([len(x) for x in side], dtype=np.int64) for side in (hyps, refs))
    out = np.maximum(n, m)
    tried, shifts = np.zeros(len(n), dtype=np.int64), np.zeros(len(n), dtype=np.int64)
    hyp, ref = fill_rows(hyps, -1), fill_rows(refs, -2)
    active = np.flatnonzero((n > 0) & (m > 0))
    while len(active):
        tables = distance_tables(hyp[active], ref[active])
        now = tables[np.arange(len(active)), n[active], m[active]].astype(np.int64)
        out[active] = shifts[active] + now
        left = np.flatnonzero(now)
        tables, now, active = tables[left], now[left], active[left]
        if not len(active):
            break
        gained, better, made = _best_moves(hyp[active], ref[active], n[active], m[active], tables, now,
                                           MAX_CANDIDATES - tried[active])
        tried[active] += made
        active = active[gained]
        shifts[active] += 1
        hyp[active] = better
    return out


def _edits(hyps: Sequence[np.ndarray], refs: Sequence[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(hyps), dtype=np.int64)
    for chunk in size_chunks(hyps, refs):
        out[chunk] = _chunk_edits([hyps[k] for k in chunk], [refs[k] for k in chunk])
    return out


def shift_counts(hyps: Sequence[str], refs: Sequence[str]) -> list[int]:
    """Edits per pair of coded texts."""
    sides = [[np.frombuffer(x.encode("utf-32-le"), dtype=np.uint32).astype(np.int64) for x in side] for side in (hyps, refs)]
    return _edits(*sides).tolist()


def shift_edits(hyp: Column, ref: Column) -> Column:
    """Struct of ``edits`` and ``ref_words`` of two texts, words between white space."""
    @F.arrow_udf("struct<edits: bigint, ref_words: bigint>")
    def count(h: pa.Array, r: pa.Array) -> pa.Array:
        spaced = [pc.replace_substring_regex(side, f"[{codes.SPACES}]+", " ") for side in (h, r)]
        sides = codes.word_numbers([codes.filled_words(side) for side in spaced])
        rows = [np.split(words, np.cumsum(lengths)[:-1]) for words, lengths in sides]
        return pa.StructArray.from_arrays([pa.array(_edits(*rows)), pa.array(sides[1][1])], ["edits", "ref_words"])

    return count(hyp, ref)
