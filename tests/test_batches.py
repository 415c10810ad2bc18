"""Counts and distances that are made for a whole Arrow batch at once, against plain loops."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from utterscale.functions import codes
from utterscale.operators import ngrams, scores, ter
from utterscale.sources import sheets


def _text(rng: random.Random, letters: str) -> str:
    return "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 5, 63, 64, 65, 130, 200])))


def _levenshtein(a, b) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


LETTERS = ["ab", "abcdefgh é😀", "".join(map(chr, range(0x4E00, 0x8E00)))]


@pytest.mark.parametrize("letters", LETTERS)
def test_packed_counts_are_those_of_a_counter(letters):
    rng = random.Random(3)
    hyp, one = [_text(rng, letters) for _ in range(40)], [_text(rng, letters) for _ in range(40)]
    two = [h[:7] + r for h, r in zip(hyp, one)]

    def clipped(h, refs, n):
        grams = [Counter(x[i:i + n] for i in range(len(x) - n + 1)) for x in (h, *refs)]
        return sum(min(c, max(g[k] for g in grams[1:])) for k, c in grams[0].items())

    for order in (4, 6):
        assert ngrams.count_clipped(hyp, [one, two], order).tolist() == [
            [clipped(h, r, n) for n in range(1, order + 1)] for h, *r in zip(hyp, one, two)]
    # the n-grams of a row are one sorted number each where they fit
    sides = [codes.points(pa.array(x)) for x in (hyp, one)]
    symbols, lengths = np.concatenate([c for c, _ in sides]), np.concatenate([n for _, n in sides])
    symbols = np.unique(symbols, return_inverse=True)[1] + 1
    args = (symbols, lengths, np.tile(np.arange(40), 2), np.repeat([0, 1], 40), 40, 2, 3)
    assert (ngrams._packed(*args, 14, 1) == ngrams._renumbered(*args)).all()


@pytest.mark.parametrize("letters", LETTERS)
def test_edit_distances_of_a_batch(letters, monkeypatch):
    rng = random.Random(4)
    pairs = [(_text(rng, letters), _text(rng, letters)) for _ in range(120)]
    want = [_levenshtein(a, b) for a, b in pairs]

    def found():
        return codes.edit_distances(*[codes.points(pa.array(side)) for side in zip(*pairs)]).tolist()

    assert found() == want
    for name, few in [("TABLE", 1), ("TABLE", 5000), ("CELLS", 1), ("PIECE", 300)]:  # masks made on the way, small groups
        with monkeypatch.context() as patch:
            patch.setattr(codes, name, few)
            assert found() == want
    assert codes.edit_distances(*[codes.points(pa.array([], pa.string()))] * 2).tolist() == []


def test_character_errors_follow_the_metric_text(spark):
    rows = [("a  \tb", " a b　"), ("x\ny", "x y"), ("", "abc"), ("abc", ""), (None, "ab"), ("ab", None), ("ßé😀", "ße😀")]
    pairs = spark.createDataFrame(rows, "hyp string, ref string").withColumn("k", F.monotonically_increasing_id())
    both = pairs.select("k", scores.metric_text(F.coalesce("hyp", F.lit(""))).alias("h"), scores.metric_text(F.col("ref")).alias("r"))
    want = {r["k"]: (_levenshtein(r["h"], r["r"]), len(r["r"])) for r in both.collect() if r["r"]}
    errors = scores.cer(pairs, ["k"])
    assert {r["k"]: (r["edits"], r["ref_chars"]) for r in errors.collect()} == want
    assert "levenshtein" not in errors._jdf.queryExecution().executedPlan().toString()
    flat = codes.metric_text(pa.array([h or "" for h, _ in rows])).to_pylist()
    assert flat == [r["h"] for r in both.orderBy("k").collect()]


def _plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


CHRF = [("a b　c", "abc"), ("aé😀 aé", "aé😀aé\n"), ("", "abc"), (None, ""), ("ab", None), ("xyzxyz", "yzxyzx")]


def test_chrf_leaves_white_space_to_the_batch(spark):
    pairs = spark.createDataFrame(CHRF, "hyp string, ref string").withColumn("k", F.monotonically_increasing_id())

    def score(h, r):
        h, r, total = "".join((h or "").split()), "".join(r.split()), 0.0
        for n in range(1, 7):
            a, b = (Counter(x[i:i + n] for i in range(len(x) - n + 1)) for x in (h, r))
            m = sum((a & b).values())
            p, q = (m / sum(a.values()), m / sum(b.values())) if m else (0, 0)
            total += 10 * p * q / (9 * p + q) if m else 1e-16
        return total / 6

    found = scores.pair_chrf(pairs)
    assert [r["chrf"] for r in found.orderBy("k").collect()] == pytest.approx([score(h, r) for h, r in CHRF if r is not None])
    assert found.columns == [*pairs.columns, "chrf"]
    assert "regexp_replace" not in _plan(found)


ROWS = [("A", 1, "a b a b", "a b a b a"), ("A", 1, "a b", "b a"), ("A", 2, "", "x"), ("A", None, "a a", "a"), ("A", None, "a", "a a"),
        ("B", 1, "a b", "a b"), ("B", 2, None, "a b c"), ("B", 3, "a b c d e", None), (None, 3, "é 😀 é", "é 😀")]


@pytest.mark.parametrize("held, batch", [(10_000, 10_000), (10_000, 2), (1, 1), (2, 3), (1, 10_000)])
def test_ngrams_of_a_pair_are_counted_together(spark, monkeypatch, held, batch):
    monkeypatch.setattr(ngrams, "HELD", held)
    pairs = spark.createDataFrame(ROWS, "system string, utt_id long, hyp string, ref string").select(
        "system", "utt_id", F.split("hyp", " ").alias("hyp_tokens"), F.split("ref", " ").alias("ref_tokens"))
    counts: dict = {}
    for system, utt, *texts in ROWS:
        for side, text in enumerate(texts):
            words = [] if text is None else text.split(" ")
            for n in range(1, 4):
                for i in range(len(words) - n + 1):
                    counts.setdefault((system, n), {}).setdefault((utt, *words[i:i + n]), [0, 0])[side] += 1
    want = {k: (sum(map(min, c.values())), sum(x for x, _ in c.values()), sum(x for _, x in c.values())) for k, c in counts.items()}
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = ngrams.clip_by_grouping(pairs, ["system", "utt_id"], ["system"], 3)
        assert {(r["system"], r["n"]): (r["clipped"], r["hyp_ngrams"], r["ref_ngrams"]) for r in found.collect()} == want
        by_pair = ngrams.clip_by_grouping(pairs, ["system", "utt_id"], ["utt_id"], 3)
        assert sum(r["clipped"] for r in by_pair.collect()) == sum(c for c, _, _ in want.values())
        table = ngrams.ngram_table(pairs, ["system", "utt_id"], 3)
        assert table.agg(F.sum(F.least("hyp_count", "ref_count"))).first()[0] == sum(c for c, _, _ in want.values())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert "Generate" not in _plan(found)
    empty = ngrams.clip_by_grouping(pairs.where("false"), ["system", "utt_id"], ["system"], 3)
    assert empty.collect() == [] and empty.columns == ["system", "n", "clipped", "hyp_ngrams", "ref_ngrams"]


def test_translation_errors_come_from_the_batch(spark):
    rows = [("B a　c", "a b c"), ("c d a b", "a b\n c d"), ("", "a b"), (None, "a"), ("x", " "), ("x", ""), ("y", None)]
    pairs = spark.createDataFrame(rows, "hyp string, ref string").withColumn("k", F.monotonically_increasing_id())
    found = scores.ter(pairs, ["k"])
    assert [(r["edits"], r["ref_words"]) for r in found.orderBy("k").collect()] == [(1, 3), (1, 4), (2, 2), (1, 1), (1, 0)]
    assert "lambda" not in _plan(found)


def test_shifts_of_many_pairs_end_at_the_candidate_limit(monkeypatch):
    rng = random.Random(6)
    hyps, refs = (["".join(rng.choice("ab") for _ in range(rng.randrange(30))) for _ in range(60)] for _ in "hr")
    for limit in (0, 1, 40, 1000):
        monkeypatch.setattr(ter, "MAX_CANDIDATES", limit)
        found = ter.shift_counts(hyps, refs)
        assert found == [ter.shift_counts([h], [r])[0] for h, r in zip(hyps, refs)]
        if limit < 2:  # no shift is tried
            assert found == [_levenshtein(h, r) for h, r in zip(hyps, refs)]


def test_report_counts_words_in_the_batch(spark):
    rows = [("A", "a  b c", "a b\t c"), ("A", "ab 3", "ab 3"), ("A", "x", ""), ("B", None, "a\nb b"), ("B", "", "  "), ("B", "y", None)]
    pairs = spark.createDataFrame(rows, "system string, hyp string, ref string")
    errors = {r["system"]: (r["edits"], r["ref_words"]) for r in scores.wer(pairs, ["system"]).collect()}
    bleu = {r["system"]: (r["n_pairs"], round(r["bleu"], 9)) for r in scores.bleu_two_refs(pairs, ["system"]).collect()}
    report = scores.eval_report(pairs)
    found = report.collect()
    assert {r["system"]: (r["edits"], r["ref_words"]) for r in found} == errors
    assert {r["system"]: (r["n_pairs"], round(r["bleu"], 9)) for r in found} == bleu
    assert "levenshtein" not in _plan(report)


def test_sheet_makes_the_keys_of_its_pairs_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        made.add(1)
        return x

    rows = spark.range(40).select(counted("id").alias("utt_id"), F.lit("A").alias("system"), F.lit("x").alias("hyp"), F.lit("y\t").alias("ref"))
    head = spark.createDataFrame([("A", 0.5, 0.25)], "system string, wer double, bleu double")
    sheet = sheets.prediction_sheet(rows, head)
    assert made.value == 40
    assert [r["line"] for r in sheet.orderBy("idx").collect()] == ["WER: 0.500000\t BLEU:0.250000"] + [f"{i}\tx\ty\\t" for i in range(40)]
