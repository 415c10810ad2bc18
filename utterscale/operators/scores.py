"""Corpus scores. Every score is a row-local numerator and denominator, then sums:
partial aggregation does the rest and a hot group costs nothing extra."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utterscale.functions import arrays, text
from utterscale.functions.distance import encode_together, metric_char_errors, token_distance
from utterscale.operators.ngrams import clipped_matches, tight_matches, word_report
from utterscale.operators.pairing import prepare
from utterscale.operators.ter import shift_edits

Preprocessor = Callable[[Column], Column]

TINY = 2.2250738585072014e-308  # fixed value: stands for a zero precision in unsmoothed BLEU
SMOOTHING = 0.1  # fixed value: added to a zero numerator
CHRF_ORDER, CHRF_BETA, CHRF_EPSILON = 6, 3.0, 1e-16  # fixed values


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom)


def metric_text(value: Column) -> Column:
    """Runs of two or more white-space characters become a blank; ends are stripped."""
    return text.strip_unicode(F.regexp_replace(value, r"(?U)\s\s+", " "))


def metric_words(value: Column) -> Column:
    return F.filter(text.words(metric_text(value)), lambda w: w != "")


def word_errors(pairs: DataFrame, preprocessor: Preprocessor | None = None) -> DataFrame:
    """Adds ``edits`` and ``ref_words``, null for a pair without a reference.

    Such pairs stay as nulls, which sums skip: a filter on the preprocessed reference
    would run the preprocessor a second time below the projection.
    """
    ready = prepare(pairs, preprocessor)
    split = ready.withColumns({"_r": metric_words(F.col("ref")), "_h": metric_words(F.col("hyp"))})
    scored = F.col("ref") != ""
    return split.withColumns({"edits": F.when(scored, token_distance(F.col("_r"), F.col("_h"))),
                              "ref_words": F.when(scored, F.size("_r").cast("bigint"))}).drop("_r", "_h")


def _error_rate(errors: DataFrame, by: Sequence[str], length: str, name: str) -> DataFrame:
    total = errors.groupBy(*by).agg(F.count(length).alias("n_pairs"), F.sum("edits").alias("edits"),
                                    F.sum(length).alias(length))
    return total.where(F.col("n_pairs") > 0).withColumn(name, _ratio(F.col("edits"), F.col(length)))


def wer(pairs: DataFrame, by: Sequence[str] = (), preprocessor: Preprocessor | None = None) -> DataFrame:
    """Word error rate, summed over the corpus before dividing."""
    return _error_rate(word_errors(pairs, preprocessor), by, "ref_words", "wer")


def cer(pairs: DataFrame, by: Sequence[str] = (), preprocessor: Preprocessor | None = None) -> DataFrame:
    """Character error rate; blanks count as characters."""
    ready = prepare(pairs, preprocessor)
    scored = F.col("ref") != ""
    counted = ready.withColumn("_e", metric_char_errors(F.col("hyp"), F.col("ref")))
    errors = counted.withColumns({c: F.when(scored, F.col(f"_e.{c}")) for c in ("edits", "ref_chars")})
    return _error_rate(errors, by, "ref_chars", "cer")


def ter(pairs: DataFrame, by: Sequence[str] = (), preprocessor: Preprocessor | None = None) -> DataFrame:
    """Translation edit rate with block shifts, case-insensitive, on the scale 0..1."""
    ready = prepare(pairs, preprocessor, drop_empty_refs=True)
    errors = ready.select(*by, shift_edits(F.lower("hyp"), F.lower("ref")).alias("_e")).select(*by, "_e.*")
    return _error_rate(errors, by, "ref_words", "ter")


def _closest(hyp_len: Column, ref_lens: Sequence[Column]) -> Column:
    """Reference length nearest to the hypothesis length, the shorter one on a tie."""
    choices = [F.struct(F.abs(n - hyp_len).alias("gap"), n.alias("len")) for n in ref_lens]
    return (F.least(*choices) if len(choices) > 1 else choices[0])["len"]


def _geometric_bleu(clipped: Sequence[Column], possible: Sequence[Column], hyp_len: Column, ref_len: Column,
                    smoothing: float | None = None) -> Column:
    logs = F.lit(0.0)
    for top, bottom in zip(clipped, possible):
        precision = (F.when(top > 0, top / bottom)
                     .otherwise(F.lit(TINY) if smoothing is None else F.lit(smoothing) / bottom))
        logs = logs + F.log(precision) / len(clipped)
    brevity = F.when(hyp_len > ref_len, 1.0).otherwise(F.exp(1 - ref_len / F.nullif(hyp_len, F.lit(0))))
    return F.when((clipped[0] > 0) & (hyp_len > 0), brevity * F.exp(logs)).otherwise(0.0)


def _matches(tokens: DataFrame, hyp: str, refs: Sequence[str], order: int) -> DataFrame:
    """Adds ``m1..mN`` (clipped), ``p1..pN`` (possible), ``hyp_len`` and ``ref_len``."""
    hyp_len = F.length(hyp)
    out = tokens.withColumn("_m", clipped_matches(F.col(hyp), [F.col(r) for r in refs], order))
    return out.withColumns({
        **{f"m{n}": F.get("_m", F.lit(n - 1)) for n in range(1, order + 1)},
        **{f"p{n}": F.greatest(hyp_len - n + 1, F.lit(1)).cast("bigint") for n in range(1, order + 1)},
        "hyp_len": hyp_len.cast("bigint"),
        "ref_len": _closest(hyp_len, [F.length(r) for r in refs]).cast("bigint")}).drop("_m")


def bleu(pairs: DataFrame, by: Sequence[str] = (), preprocessor: Preprocessor | None = None,
         ref_columns: Sequence[str] = ("ref",), order: int = 4) -> DataFrame:
    """Corpus BLEU over blank-separated tokens, any number of reference columns."""
    ready = prepare(pairs, preprocessor)
    columns = ["hyp", *ref_columns]
    split = ready.select(*by, *[text.words(F.col(c)).alias(c) for c in columns])
    # one code point per distinct token of the row, so all sides are short strings
    coded_rows = split.select(*by, encode_together(columns).alias("_c")).select(*by, *[F.col(f"_c.{c}").alias(c) for c in columns])
    sums = [f"{k}{n}" for k in "mp" for n in range(1, order + 1)] + ["hyp_len", "ref_len"]
    total = (_matches(coded_rows, "hyp", ref_columns, order).groupBy(*by)
             .agg(F.count("*").alias("n_pairs"), *[F.sum(c).alias(c) for c in sums]))
    return total.withColumn("bleu", _geometric_bleu(
        [F.col(f"m{n}") for n in range(1, order + 1)], [F.col(f"p{n}") for n in range(1, order + 1)],
        F.col("hyp_len"), F.col("ref_len")))


def bleu_two_refs(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Corpus BLEU of normalised text against the reference and the reference with its
    numbers written out in German."""
    both = prepare(pairs).withColumns({
        "hyp": text.normalize(F.col("hyp")), "ref": text.normalize(F.col("ref")),
        "ref_words": text.normalize(text.numbers_to_words(F.col("ref")))})
    return bleu(both, by, ref_columns=("ref", "ref_words"))


def sentence_bleu_char(pairs: DataFrame, smoothing: bool = True, preprocessor: Preprocessor | None = None,
                       order: int = 4) -> DataFrame:
    """BLEU per pair over characters, blanks included."""
    ready = prepare(pairs, preprocessor)
    scored = _matches(ready, "hyp", ["ref"], order).withColumn("bleu", _geometric_bleu(
        [F.col(f"m{n}") for n in range(1, order + 1)], [F.col(f"p{n}") for n in range(1, order + 1)],
        F.col("hyp_len"), F.col("ref_len"), SMOOTHING if smoothing else None))
    return scored.select(*pairs.columns, "bleu")


def pair_chrf(pairs: DataFrame, preprocessor: Preprocessor | None = None) -> DataFrame:
    """Adds ``chrf``: the mean over n-gram sizes of one pair's F-score."""
    ready = prepare(pairs, preprocessor)
    counted = ready.withColumn("_c", tight_matches(F.col("hyp"), F.col("ref"), CHRF_ORDER))
    square = CHRF_BETA ** 2
    total = F.lit(0.0)
    for n in range(1, CHRF_ORDER + 1):
        match = F.get("_c.matches", F.lit(n - 1))
        precision, recall = match / (F.col("_c.hyp_len") - n + 1), match / (F.col("_c.ref_len") - n + 1)
        total = total + F.when(match > 0, (1 + square) * precision * recall / (square * precision + recall)).otherwise(
            CHRF_EPSILON)
    return counted.withColumn("chrf", total / CHRF_ORDER).drop("_c")


def chrf(pairs: DataFrame, by: Sequence[str] = (), preprocessor: Preprocessor | None = None) -> DataFrame:
    """Character F-score, averaged over pairs."""
    return pair_chrf(pairs, preprocessor).groupBy(*by).agg(
        F.count("*").alias("n_pairs"), F.avg("chrf").alias("chrf"))


def guarded(groups: DataFrame, scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """Scores for every wanted group; without pairs ``wer`` is infinite and ``bleu`` 0."""
    return groups.join(scored, list(by), "left").withColumns({
        "wer": F.coalesce("wer", F.lit(float("inf"))), "bleu": F.coalesce("bleu", F.lit(0.0))})


def eval_report(pairs: DataFrame, by: Sequence[str] = ("system",), wanted: DataFrame | None = None,
                normalized: bool = True) -> DataFrame:
    """Raw word error rate and BLEU in one pass over the pairs: two-reference BLEU of normalised
    text, or with ``normalized`` off BLEU of the raw one.

    Every group of ``wanted`` gets a row. It joins the pairs as a neutral row that adds nothing
    to any sum, so a group without pairs needs no second pass and no outer join.
    """
    real = pairs.select(*by, "hyp", "ref", F.lit(True).alias("_real"))
    if wanted is not None:
        empty = [F.lit("").alias("hyp"), F.lit("").alias("ref"), F.lit(False).alias("_real")]
        real = real.unionByName(wanted.select(*by, *empty))
    raw, columns = prepare(real), [F.col("hyp"), F.col("ref")]
    if normalized:
        # an Arrow function can't hold a lambda: a column with two uses stays a projection of its own
        both = F.struct("ref", text.normalize(text.numbers_to_words(F.col("ref"))).alias("spelled"))
        raw = raw.withColumn("_b", arrays.let(both, lambda b: b))
        columns = [text.normalize(F.col("hyp")), text.normalize(F.col("_b.ref")), F.col("_b.spelled")]
    counted = raw.select(*by, "_real", (F.col("ref") != "").alias("_has_ref"),
                         word_report(F.col("hyp"), F.col("ref"), columns, 4).alias("_c"))
    hyp_len, *ref_lens = [F.get("_c.lengths", F.lit(i)) for i in range(len(columns))]
    rows = counted.select(
        *by, "_real", *[F.when(F.col("_has_ref"), F.col(f"_c.{c}")).alias(c) for c in ("edits", "ref_words")],
        *[F.get("_c.matches", F.lit(n - 1)).alias(f"m{n}") for n in range(1, 5)],
        *[F.greatest(hyp_len - n + 1, F.lit(1)).cast("bigint").alias(f"p{n}") for n in range(1, 5)],
        hyp_len.alias("hyp_len"), _closest(hyp_len, ref_lens).alias("ref_len"))
    names = [f"{k}{n}" for k in "mp" for n in range(1, 5)] + ["hyp_len", "ref_len", "edits", "ref_words"]
    total = rows.groupBy(*by).agg(
        F.count(F.when(F.col("_real"), 1)).alias("n_pairs"), *[F.sum(F.when(F.col("_real"), F.col(c))).alias(c) for c in names])
    score = _geometric_bleu([F.col(f"m{n}") for n in range(1, 5)], [F.col(f"p{n}") for n in range(1, 5)],
                            F.col("hyp_len"), F.col("ref_len"))
    return total.select(*by, "n_pairs", "edits", "ref_words",
                        F.coalesce(_ratio(F.col("edits"), F.col("ref_words")), F.lit(float("inf"))).alias("wer"),
                        F.coalesce(score, F.lit(0.0)).alias("bleu"))


def decoded_pairs(rows: DataFrame, keep: Sequence[str], tokens_by_id: Column, pad_id: int, frames: str = "frames",
                  labels: str = "labels") -> DataFrame:
    """``keep``, ``hyp``, ``ref``: the best token of every frame, collapsed, against the labels as they are.

    A row without frames has an empty hypothesis; one without labels has no reference.
    """
    best = arrays.ids_to_text(arrays.frame_argmax(F.col(frames)), tokens_by_id, pad_id)
    spoken = arrays.ids_to_text(arrays.restore_pad(F.col(labels), pad_id), tokens_by_id, pad_id, collapse=False)
    return rows.select(*keep, best.alias("hyp"), spoken.alias("ref"))
