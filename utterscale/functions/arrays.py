"""Array columns: signal normalising, frame decoding, padding, chunking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

LABEL_PAD = -100  # fixed value: label positions ignored by the loss
SIGNAL_PAD = 0.0  # fixed value: silence
# What decoding replaces, in this order.
CLEAN_UP = [(" .", "."), (" ?", "?"), (" !", "!"), (" ,", ","), (" ' ", "'"), (" n't", "n't"), (" 'm", "'m"), (" 's", "'s"),
            (" 've", "'ve"), (" 're", "'re")]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    An expression used inside a lambda is evaluated again for every element. Bound
    as the only element of an array it becomes a lambda variable instead.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def mean_of(values: Column) -> Column:
    """Null for an empty array."""
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double")), F.size(values))


def znorm(values: Column) -> Column:
    """Zero mean, unit population variance, in double precision; an empty array stays empty."""
    def spread(v: Column, mean: Column) -> Column:
        squares = F.aggregate(v, F.lit(0.0), lambda a, x: a + (x.cast("double") - mean) * (x.cast("double") - mean))
        return F.try_divide(squares, F.size(v))

    return let(values, lambda v: let(mean_of(v), lambda mean: let(
        F.sqrt(spread(v, mean) + F.lit(1e-7)),
        lambda scale: F.transform(v, lambda x: (x.cast("double") - mean) / scale))))


def frame_argmax(frames: Column) -> Column:
    """Index of the first maximum of every frame."""
    return F.transform(frames, lambda f: (F.array_position(f, F.array_max(f)) - 1).cast("int"))


def cut(values: Column, size: int) -> Column:
    """Consecutive pieces of ``size`` elements, the last one may be shorter."""
    return let(values, lambda v: F.when(
        F.size(v) > 0,
        F.transform(F.sequence(F.lit(1), F.size(v), F.lit(size)), lambda i: F.slice(v, i, size)))
        .otherwise(F.slice(F.array(v), 1, 0)))


def collapse_repeats(ids: Column) -> Column:
    return let(ids, lambda v: F.filter(v, lambda x, i: (i == 0) | (x != F.get(v, i - 1))))


def restore_pad(ids: Column, pad_id: int) -> Column:
    return F.transform(ids, lambda x: F.when(x == LABEL_PAD, F.lit(pad_id)).otherwise(x))


def ids_to_tokens(ids: Column, tokens_by_id: Column) -> Column:
    """Token of every id; ``tokens_by_id`` is indexed by id, so each lookup is constant time."""
    return F.transform(ids, lambda x: F.get(tokens_by_id, x.cast("int")))


def clean_up(text: Column) -> Column:
    """Takes out the blanks before punctuation and contractions, one rule after the other."""
    for spaced, tight in CLEAN_UP:
        text = F.replace(text, F.lit(spaced), F.lit(tight))
    return text


def ids_to_text(ids: Column, tokens_by_id: Column, pad_id: int, delimiter: str = "|",
                collapse: bool = True, clean: bool = True) -> Column:
    """Frame ids to text: collapse repeats, drop pads, join, delimiter to blank, trim, clean up."""
    kept = F.filter(collapse_repeats(ids) if collapse else ids, lambda x: x != pad_id)
    joined = F.trim(F.replace(F.array_join(ids_to_tokens(kept, tokens_by_id), ""), F.lit(delimiter), F.lit(" ")))
    return clean_up(joined) if clean else joined


def padded_length(longest: Column, multiple_of: int | None = None) -> Column:
    if not multiple_of:
        return longest
    return (F.ceil(longest / F.lit(multiple_of)) * multiple_of).cast("int")


def pad_right(values: Column, length: Column, fill: Column) -> Column:
    """Fill up to ``length``; longer arrays are left as they are."""
    return F.concat(values, F.array_repeat(fill, F.greatest(length - F.size(values), F.lit(0)).cast("int")))


def attention_mask(values: Column, length: Column) -> Column:
    missing = F.greatest(length - F.size(values), F.lit(0)).cast("int")
    return F.concat(F.array_repeat(F.lit(1), F.size(values)), F.array_repeat(F.lit(0), missing))
