"""Word alignment of hypothesis and reference, and what is counted from it.

The backtrace is the one step that needs Python: an Arrow batch of encoded pairs gives
one string of steps per pair, and the positions of every step. Words and counts come from
these in native expressions.

A pair whose distance table exceeds ``CELLS`` keeps only every so many rows of it, about the
square root of their number, and makes the rows between two of them again when the path
comes there: the same path, in memory that grows with one row times that root.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utterscale.functions.distance import encode_together

CELLS = 8_000_000  # distance-table cells held at once by one task
STEPS = {"=": "match", "S": "substitute", "D": "delete", "I": "insert"}


def distance_rows(hyp: np.ndarray, ref: np.ndarray, known: np.ndarray | None = None, at: int = 0) -> Iterator[np.ndarray]:
    """Edit distances between growing hypothesis prefixes and all reference prefixes, for
    a batch of equally wide code rows: one ``(rows, m + 1)`` array per prefix. They go on
    from the ``known`` ones of the prefix of length ``at``."""
    columns = np.arange(ref.shape[1] + 1, dtype=np.int32)
    row = np.repeat(columns[None], len(hyp), axis=0) if known is None else known
    yield row
    for i in range(at, hyp.shape[1]):
        above, row = row, np.empty_like(row)
        row[:, 0] = i + 1
        np.minimum(above[:, :-1] + (hyp[:, i, None] != ref), above[:, 1:] + 1, out=row[:, 1:])
        # a chain of insertions along the row is a running minimum of (value - column)
        np.minimum.accumulate(row - columns, axis=1, out=row)
        row += columns
        yield row


def distance_tables(hyp: np.ndarray, ref: np.ndarray) -> np.ndarray:
    """``(rows, n + 1, m + 1)`` edit distances between all prefixes."""
    table = np.empty((len(hyp), hyp.shape[1] + 1, ref.shape[1] + 1), dtype=np.int32)
    for i, row in enumerate(distance_rows(hyp, ref)):
        table[:, i] = row
    return table


def code_rows(texts: Sequence[str], fill: int) -> np.ndarray:
    """Code points, one row per text, filled up to the longest."""
    return fill_rows([np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32) for t in texts], fill)


def fill_rows(codes: Sequence[np.ndarray], fill: int) -> np.ndarray:
    out = np.full((len(codes), max(map(len, codes))), fill, dtype=np.int64)
    for k, row in enumerate(codes):
        out[k, :len(row)] = row
    return out


def _trace(hyp: Sequence[str], ref: Sequence[str]) -> list[str]:
    h, r = code_rows(hyp, -1), code_rows(ref, -2)
    table = distance_tables(h, r)
    k = np.arange(len(h))
    i = np.array([len(t) for t in hyp])
    j = np.array([len(t) for t in ref])
    steps = []
    while (i > 0).any() or (j > 0).any():
        here, up, left = table[k, i, j], np.maximum(i - 1, 0), np.maximum(j - 1, 0)
        both = (i > 0) & (j > 0)
        same = both & (h[k, np.minimum(up, h.shape[1] - 1)] == r[k, np.minimum(left, r.shape[1] - 1)]) \
            if h.shape[1] and r.shape[1] else np.zeros(len(k), bool)
        diagonal = both & (table[k, up, left] + ~same == here)
        delete = ~diagonal & (j > 0) & (table[k, i, left] + 1 == here)
        insert = ~diagonal & ~delete & (i > 0)
        steps.append(np.select([diagonal & same, diagonal, delete, insert], ["=", "S", "D", "I"], ""))
        i = i - (diagonal | insert)
        j = j - (diagonal | delete)
    if not steps:
        return [""] * len(hyp)
    return ["".join(row) for row in np.array(steps[::-1]).T]


def _trace_long(hyp: str, ref: str) -> str:
    """The steps of one pair, from every ``gap``-th row of its distance table."""
    h, r = code_rows([hyp], -1), code_rows([ref], -2)
    gap = max(1, int(np.ceil((len(hyp) + 1)**0.5)))
    kept = [row.copy() for i, row in enumerate(distance_rows(h, r)) if i % gap == 0]
    words, target = h[0].tolist(), r[0].tolist()
    i, j, steps = len(hyp), len(ref), []
    for block in range(len(kept) - 1, -1, -1):
        first = block * gap
        rows = distance_rows(h[:, :min(first + gap, len(hyp))], r, kept[block], first)
        table = [row[0].tolist() if len(ref) < 64 else row[0] for row in rows]  # rows ``first`` to the next kept one
        while i > first or (first == 0 and j > 0):
            here = table[i - first][j]
            if i > first and j > 0 and table[i - first - 1][j - 1] + (words[i - 1] != target[j - 1]) == here:
                steps.append("=" if words[i - 1] == target[j - 1] else "S")
                i, j = i - 1, j - 1
            elif j > 0 and table[i - first][j - 1] + 1 == here:
                steps.append("D")
                j -= 1
            else:
                steps.append("I")
                i -= 1
    return "".join(reversed(steps))


def size_chunks(hyp: Sequence[str], ref: Sequence[str]) -> Iterator[list[int]]:
    """Indexes of pairs of similar size whose tables fit into ``CELLS`` together; a
    larger pair comes alone."""
    chunk: list[int] = []
    n = m = 0
    for k in sorted(range(len(hyp)), key=lambda k: (len(hyp[k]), len(ref[k]))):
        n, m = max(n, len(hyp[k])), max(m, len(ref[k]))
        if chunk and (len(chunk) + 1) * (n + 1) * (m + 1) > CELLS:
            yield chunk
            chunk, n, m = [], len(hyp[k]), len(ref[k])
        chunk.append(k)
    if chunk:
        yield chunk


def trace_steps(hyp: Sequence[str], ref: Sequence[str]) -> list[str]:
    """Steps per pair; among cheapest ones match / substitute > delete > insert, from the end."""
    out: list[str] = [""] * len(hyp)
    for chunk in size_chunks(hyp, ref):
        if len(chunk) == 1 and (len(hyp[chunk[0]]) + 1) * (len(ref[chunk[0]]) + 1) > CELLS:
            out[chunk[0]] = _trace_long(hyp[chunk[0]], ref[chunk[0]])
            continue
        for k, steps in zip(chunk, _trace([hyp[k] for k in chunk], [ref[k] for k in chunk])):
            out[k] = steps
    return out


def positions(steps: str, skipped: str) -> list[int | None]:
    """Per step the 0-based place it uses in the text whose words ``skipped`` steps don't use."""
    used = np.frombuffer(steps.encode(), np.uint8) != ord(skipped)
    return [p if u else None for p, u in zip((np.cumsum(used) - 1).tolist(), used.tolist())]


def with_steps(pairs: DataFrame, hyp_tokens: str = "hyp_tokens", ref_tokens: str = "ref_tokens", places: bool = False) -> DataFrame:
    """Adds ``steps``: one of ``= S D I`` per alignment step; with ``places`` also ``ref_places, hyp_places``."""
    @F.pandas_udf("string")
    def trace(hyp: pd.Series, ref: pd.Series) -> pd.Series:
        return pd.Series(trace_steps(hyp.tolist(), ref.tolist()), dtype=object)

    @F.pandas_udf("steps string, ref_places array<int>, hyp_places array<int>")
    def placed(hyp: pd.Series, ref: pd.Series) -> pd.DataFrame:
        steps = trace_steps(hyp.tolist(), ref.tolist())
        return pd.DataFrame({"steps": pd.Series(steps, dtype=object), "ref_places": [positions(s, "I") for s in steps],
                             "hyp_places": [positions(s, "D") for s in steps]})

    coded = pairs.withColumn("_c", encode_together([hyp_tokens, ref_tokens]))
    # marked nondeterministic so that filters inferred from a later explode do not
    # copy the call: the backtrace runs once per pair
    once = (placed if places else trace).asNondeterministic()
    found = coded.withColumn("_s", once(f"_c.{hyp_tokens}", f"_c.{ref_tokens}"))
    return found.select(*pairs.columns, "_s.*") if places else found.drop("_c").withColumnRenamed("_s", "steps")


def _count(step: str) -> Column:
    return (F.length("steps") - F.length(F.replace("steps", F.lit(step), F.lit("")))).cast("bigint")


def edit_breakdown(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Hits, substitutions, deletions and insertions per group."""
    return (with_steps(pairs).groupBy(*by)
            .agg(F.sum(_count("=")).alias("hits"), F.sum(_count("S")).alias("substitutions"),
                 F.sum(_count("D")).alias("deletions"), F.sum(_count("I")).alias("insertions")))


def align_words(pairs: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per step: ``step, op, ref_pos, hyp_pos, ref_word, hyp_word``."""
    ops = F.create_map(*[F.lit(x) for kv in STEPS.items() for x in kv])
    letters = F.filter(F.split("steps", ""), lambda s: s != "")
    steps = with_steps(pairs, places=True).select(
        *keys, *keep, "hyp_tokens", "ref_tokens",
        F.posexplode(F.arrays_zip(letters.alias("op"), F.col("ref_places").alias("ref"), F.col("hyp_places").alias("hyp"))).alias("step", "_p"))
    return steps.select(*keys, *keep, F.col("step").cast("bigint").alias("step"),
                        F.element_at(ops, F.col("_p.op")).alias("op"),
                        F.col("_p.ref").cast("bigint").alias("ref_pos"),
                        F.col("_p.hyp").cast("bigint").alias("hyp_pos"),
                        F.get("ref_tokens", "_p.ref").alias("ref_word"),
                        F.get("hyp_tokens", "_p.hyp").alias("hyp_word"))


def annotated_error_rate(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per tag: share of annotated reference words that the hypothesis does not repeat.

    ``pairs`` holds ``hyp_tokens``, ``ref_tokens`` and ``ref_tags`` (null = no tag).
    """
    # the steps that consume a reference word, in reference order
    kept = F.filter(F.split(F.replace("steps", F.lit("I"), F.lit("")), ""), lambda s: s != "")
    tagged = with_steps(pairs).select(
        *by, F.inline(F.arrays_zip(F.col("ref_tags").alias("tag"), kept.alias("op"))).alias("tag", "op"))
    return (tagged.where(F.col("tag").isNotNull()).groupBy(*by, "tag")
            .agg(F.count("*").alias("tagged_words"),
                 F.sum(F.when(F.col("op") == "=", 0).otherwise(1)).alias("lost_words"))
            .withColumn("annotated_wer", F.col("lost_words") / F.col("tagged_words")))
