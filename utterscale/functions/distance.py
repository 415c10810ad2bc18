"""Edit distance over token arrays with the built-in string distance.

Every distinct token of a pair gets its own code point, so one call of the
JVM ``levenshtein`` compares whole tokens. No shuffle, no Python. Characters, many more to a
text, are compared in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from utterscale.functions import codes
from utterscale.functions.arrays import let


def encode_tokens(tokens: Column, alphabet: Column) -> Column:
    """A string with one code point per token: the token's place in ``alphabet``."""
    def place(token: Column) -> Column:
        return F.array_position(alphabet, token).cast("int")

    def wide(token: Column) -> Column:
        # step over the surrogates and the rest of the plane (byte-order marks);
        # more tokens than code points fail in decode
        return let(place(token), lambda p: F.lpad(F.hex(F.when(p < 0xD000, p).otherwise(p + 0x3000)), 8, "0"))

    # ``char`` reaches 255 code points, which is enough for an utterance
    return (F.when(F.size(alphabet) < 256, F.array_join(F.transform(tokens, lambda t: F.char(place(t))), ""))
            .otherwise(F.decode(F.unhex(F.array_join(F.transform(tokens, wide), "")), "UTF-32")))


def encode_together(columns: Sequence[str]) -> Column:
    """Struct of the named token arrays as strings over one shared alphabet."""
    return let(F.struct(*columns), lambda row: let(
        F.array_distinct(F.concat(*[row[c] for c in columns])),
        lambda alphabet: F.struct(*[encode_tokens(row[c], alphabet).alias(c) for c in columns])))


def token_distance(left: Column, right: Column) -> Column:
    """Levenshtein distance between two ``ARRAY<STRING>`` columns, as BIGINT."""
    return let(F.struct(left.alias("l"), right.alias("r")), lambda p: let(
        F.array_union(p["l"], p["r"]),
        lambda alphabet: F.levenshtein(encode_tokens(p["l"], alphabet), encode_tokens(p["r"], alphabet)))).cast("bigint")


def metric_char_errors(hyp: Column, ref: Column) -> Column:
    """Struct of ``edits`` and ``ref_chars`` of two metric texts (see ``codes.metric_text``)."""
    @F.arrow_udf("struct<edits: bigint, ref_chars: bigint>")
    def count(h: pa.Array, r: pa.Array) -> pa.Array:
        hyps, refs = codes.points(codes.metric_text(h)), codes.points(codes.metric_text(r))
        return pa.StructArray.from_arrays([pa.array(codes.edit_distances(hyps, refs)), pa.array(refs[1])], ["edits", "ref_chars"])

    return count(hyp, ref)
