"""Texts of an Arrow batch as numbers, and the edit distances of many pairs at once.

A side is a flat array of symbol numbers with the length of every text. Numbers are exact:
code points, or the places of words in a dictionary of the batch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

Side = tuple[np.ndarray, np.ndarray]

# Fixed value: the white space of Java's ``(?U)\s``.
SPACES = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
PIECE = 1 << 20  # symbols of the pairs compared at once
TABLE = 1 << 19  # match masks held for a group of pairs
CELLS = 1 << 20  # places of the longer side held for a group of pairs


def points(texts: pa.Array) -> Side:
    """Code points; null counts as empty."""
    plain = [x or "" for x in texts.to_pylist()]
    return (np.frombuffer("".join(plain).encode("utf-32-le"), dtype=np.uint32).astype(np.int64),
            np.fromiter(map(len, plain), dtype=np.int64, count=len(plain)))


def metric_text(texts: pa.Array) -> pa.Array:
    """Runs of two or more white-space characters become a blank; ends are stripped."""
    return pc.utf8_trim(pc.replace_substring_regex(texts, f"[{SPACES}][{SPACES}]+", " "), SPACES)


def without_spaces(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, f"[{SPACES}]+", "")


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words between single blanks, flat, and their number per text."""
    lists = pc.split_pattern(pc.fill_null(texts, ""), " ")
    return lists.flatten(), np.asarray(pc.list_value_length(lists)).astype(np.int64)


def filled_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """``split_words`` without empty words."""
    words, lengths = split_words(texts)
    full = np.asarray(pc.binary_length(words)) > 0
    if full.all():
        return words, lengths
    row = np.repeat(np.arange(len(lengths)), lengths)[full]
    return words.filter(pa.array(full)), np.bincount(row, minlength=len(lengths))


def word_numbers(sides: Sequence[tuple[pa.Array, np.ndarray]]) -> list[Side]:
    """The sides with one number per distinct word of all of them, from 0; null is a word too."""
    flat = pa.concat_arrays([words for words, _ in sides])
    codes = np.asarray(flat.dictionary_encode(null_encoding="encode").indices).astype(np.int64)
    cuts = np.cumsum([len(words) for words, _ in sides])[:-1]
    return [(part, lengths) for part, (_, lengths) in zip(np.split(codes, cuts), sides)]


def ranked_in_rows(codes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Numbers from 1 within every row, equal for equal codes of the row."""
    if not len(codes):
        return codes
    width = int(codes.max()) + 1
    key = row * width + codes
    order = np.argsort(key)
    key = key[order]
    place = np.cumsum(np.r_[True, key[1:] != key[:-1]])
    owner = row[order]
    head = np.r_[True, owner[1:] != owner[:-1]]
    out = np.empty_like(codes)
    out[order] = place - np.maximum.accumulate(np.where(head, place, 0)) + 1
    return out


def pieces(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` symbols; a longer row is a range of its own."""
    if not len(sizes):
        return
    part = (np.cumsum(sizes) - sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    yield from zip(cuts, cuts[1:])


def cut(side: Side, a: int, b: int) -> Side:
    codes, lengths = side
    start = int(lengths[:a].sum())
    return codes[start:start + int(lengths[a:b].sum())], lengths[a:b]


def edit_distances(left: Side, right: Side) -> np.ndarray:
    """Levenshtein distance per pair."""
    out = [np.zeros(0, np.int64)]
    for a, b in pieces(left[1] + right[1], PIECE):
        out.append(_distances(cut(left, a, b), cut(right, a, b)))
    return np.concatenate(out)


def _distances(left: Side, right: Side) -> np.ndarray:
    (l, ln), (r, rn) = left, right
    # the shorter side gives the bits, the longer one the steps
    swap = rn > ln
    row = np.r_[np.repeat(np.arange(len(ln)), ln), np.repeat(np.arange(len(rn)), rn)]
    place = np.concatenate([_places(ln), _places(rn)])
    codes = np.r_[l, r]
    first = np.r_[np.ones(len(l), bool), np.zeros(len(r), bool)]
    short = first == swap[row]
    few, many = np.minimum(ln, rn), np.maximum(ln, rn)
    words = -(-few // 64)
    codes, alphabet = _numbered(codes, short)
    if alphabet * int(words.max(initial=0)) * 64 > TABLE:
        codes = ranked_in_rows(codes, row)
        alphabet = int(codes.max(initial=0)) + 1
    out = many.copy()  # the distance to an empty text
    order = np.lexsort((-many, words))
    order = order[words[order] > 0]
    begin_few, begin_many = _starts(row, short, len(ln)), _starts(row, ~short, len(ln))
    bits, steps = (codes[short], place[short]), (codes[~short], place[~short])
    # per row the symbols of a side are contiguous, but rows of both sides alternate: bring them into row order
    bits, steps = _in_rows(bits, row[short]), _in_rows(steps, row[~short])
    at = 0
    while at < len(order):
        w, longest = int(words[order[at]]), int(many[order[at]])
        end = int(np.searchsorted(words[order], w, side="right"))
        size = max(1, min(TABLE // (alphabet * w), CELLS // longest))
        rows = order[at:min(end, at + size)]
        out[rows] = _group(rows, w, bits, steps, begin_few, begin_many, few, many, alphabet)
        at += len(rows)
    return out


def _places(lengths: np.ndarray) -> np.ndarray:
    return np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _starts(row: np.ndarray, of: np.ndarray, rows: int) -> np.ndarray:
    n = np.bincount(row[of], minlength=rows)
    return np.cumsum(n) - n


def _in_rows(side: tuple[np.ndarray, np.ndarray], row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if (row[1:] >= row[:-1]).all():
        return side
    order = np.argsort(row, kind="stable")
    return side[0][order], side[1][order]


def _numbered(codes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers from 1 of the symbols that occur in the part ``of``; 0 for all others."""
    seen = np.zeros(int(codes.max(initial=0)) + 1, bool)
    seen[codes[of]] = True
    number = np.where(seen, np.cumsum(seen), 0)
    return number[codes], int(seen.sum()) + 1


def _laid_out(rows: np.ndarray, side: tuple[np.ndarray, np.ndarray], begin: np.ndarray, lengths: np.ndarray, fill: int) -> np.ndarray:
    """One column per row of the group, one line per place."""
    n = lengths[rows]
    flat = np.repeat(begin[rows] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    out = np.full((int(n.max()), len(rows)), fill, dtype=np.int64)
    out[side[1][flat], np.repeat(np.arange(len(rows)), n)] = side[0][flat]
    return out


def _group(rows: np.ndarray, words: int, bits, steps, begin_few, begin_many, few, many, alphabet: int) -> np.ndarray:
    """Bit-parallel distances (Myers, in blocks of 64) of pairs with as many blocks; the longest first.

    Every step takes one symbol of all longer sides; a block holds the differences between 64
    neighbouring cells of a column, and gives its last one to the block below.
    """
    size = len(rows)
    lane = np.arange(size)
    one = np.uint64(1)
    small = alphabet * words <= TABLE  # else the masks of a symbol are made when it comes
    pattern = _laid_out(rows, bits, begin_few, few, alphabet)
    text = _laid_out(rows, steps, begin_many, many, 0)
    if small:
        masks = np.zeros((words, (alphabet + 1) * size), np.uint64)
        for i, symbols in enumerate(pattern):
            masks[i >> 6][symbols * size + lane] |= one << np.uint64(i & 63)
        masks = masks[:, :alphabet * size]
        masks[:, :size] = 0  # symbols of the text alone
    plus, minus = np.full((words, size), ~np.uint64(0)), np.zeros((words, size), np.uint64)
    last = ((few[rows] - 1) & 63).astype(np.uint64)
    score = few[rows].copy()
    live = np.searchsorted(-many[rows], -np.arange(len(text)))  # rows longer than every place
    for step, symbols in enumerate(text):
        k = int(live[step])
        if small:
            at = symbols[:k] * size + lane[:k]
        else:
            match = np.packbits((pattern[:, 0] == symbols[0]) & (symbols[0] > 0), bitorder="little")
            found = np.frombuffer(np.r_[match, np.zeros(words * 8 - len(match), np.uint8)].tobytes(), np.uint64)
        up, down = one, np.uint64(0)
        for w in range(words):
            p, m = plus[w, :k], minus[w, :k]
            eq = masks[w].take(at) if small else found[w:w + 1]
            xv = eq | m
            if w:
                eq = eq | down
            xh = (((eq & p) + p) ^ p) | eq
            ph = m | ~(xh | p)
            mh = p & xh
            if w == words - 1:
                end = last[:k]
                score[:k] += ((ph >> end) & one).astype(np.int64) - ((mh >> end) & one).astype(np.int64)
            else:
                next_up, next_down = ph >> np.uint64(63), mh >> np.uint64(63)
            ph = (ph << one) | up
            mh = (mh << one) | down
            plus[w, :k] = mh | ~(xv | ph)
            minus[w, :k] = ph & xv
            if w < words - 1:
                up, down = next_up, next_down
    return score
