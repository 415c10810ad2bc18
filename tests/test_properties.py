"""Properties and comparisons with brute force (layer 3)."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.compare import list_pairs
from utterscale.functions import arrays, text
from utterscale.functions.distance import token_distance
from utterscale.operators import align, evaluations, ngrams, ordering, pairing, scores, splits, ter
from utterscale.operators.ter import shift_counts
from utterscale.plans import fixtures

WORDS = st.lists(st.sampled_from("abcd"), max_size=7)


def table_of(h, r):
    d = [[i + j if not i or not j else 0 for j in range(len(r) + 1)] for i in range(len(h) + 1)]
    for i, j in itertools.product(range(1, len(h) + 1), range(1, len(r) + 1)):
        d[i][j] = min(d[i - 1][j - 1] + (h[i - 1] != r[j - 1]), d[i - 1][j] + 1, d[i][j - 1] + 1)
    return d


def steps_of(h, r):
    d, i, j, out = table_of(h, r), len(h), len(r), []
    while i or j:
        if i and j and d[i][j] == d[i - 1][j - 1] + (h[i - 1] != r[j - 1]):
            out.append("=" if h[i - 1] == r[j - 1] else "S")
            i, j = i - 1, j - 1
        elif j and d[i][j] == d[i][j - 1] + 1:
            out.append("D")
            j -= 1
        else:
            out.append("I")
            i -= 1
    return "".join(reversed(out))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(WORDS, WORDS), min_size=1, max_size=6))
def test_alignment_is_the_brute_force_path(pairs):
    hyps, refs = ["".join(h) for h, _ in pairs], ["".join(r) for _, r in pairs]
    assert align.trace_steps(hyps, refs) == [steps_of(h, r) for h, r in zip(hyps, refs)]


def test_alignment_in_small_pieces(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randrange(9))) for _ in range(60)]
    monkeypatch.setattr(align, "CELLS", 150)
    assert align.trace_steps(texts, texts[::-1]) == [steps_of(h, r) for h, r in zip(texts, texts[::-1])]


def test_long_pairs_take_the_same_path():
    rng = random.Random(7)
    for n, m in [(0, 0), (0, 5), (5, 0), (1, 1), (40, 3), (3, 40), (37, 41), (150, 160), (16, 15), (90, 70)]:
        h, r = ("".join(rng.choice("abc") for _ in range(k)) for k in (n, m))
        assert align._trace_long(h, r) == steps_of(h, r)


def test_a_pair_of_20000_words_fits():
    import tracemalloc

    rng = np.random.default_rng(2)
    ref = rng.integers(0x4E00, 0x4E00 + 3000, 20_000)
    hyp = np.insert(np.delete(ref, np.arange(7, 19_000, 50)), np.arange(3, 19_000, 90), 0x4E00)
    texts = ["".join(map(chr, x)) for x in (hyp, ref)]
    tracemalloc.start()
    steps = align.trace_steps(texts[:1], texts[1:])[0]
    assert tracemalloc.get_traced_memory()[1] < 200_000_000
    tracemalloc.stop()
    assert len(steps) - steps.count("D") == len(hyp) and len(steps) - steps.count("I") == len(ref)
    assert align.positions("=DSI", "I") == [0, 1, 2, None] and align.positions("=DSI", "D") == [0, None, 1, 2]


def clipped(h, refs, order):
    out = []
    for n in range(1, order + 1):
        def grams(t):
            return Counter(tuple(t[i:i + n]) for i in range(len(t) - n + 1))
        best = Counter()
        for r in refs:
            best |= grams(r)
        out.append(sum((grams(h) & best).values()))
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(WORDS, WORDS, WORDS), min_size=1, max_size=5))
def test_clipped_counts(rows):
    h, a, b = (["".join(x) for x in side] for side in zip(*rows))
    assert ngrams.count_clipped(h, [a, b], 4).tolist() == [clipped(x, [y, z], 4) for x, y, z in zip(h, a, b)]


def test_clipped_counts_in_small_pieces(monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randrange(12))) for _ in range(50)]
    monkeypatch.setattr(ngrams, "SYMBOLS", 30)
    assert ngrams.count_clipped(texts, [texts[::-1]], 3).tolist() == [
        clipped(h, [r], 3) for h, r in zip(texts, texts[::-1])]
    assert ngrams.count_clipped([], [[]], 3).shape == (0, 3)


def best_with_shifts(h, r):
    """Fewest edits when any run may be moved anywhere, by breadth-first search."""
    seen, layer, best = {tuple(h)}, {tuple(h)}, table_of(h, r)[-1][-1]
    for cost in range(1, best):
        following = set()
        for w in layer:
            for i, j in itertools.combinations(range(len(w) + 1), 2):
                rest = w[:i] + w[j:]
                following |= {rest[:k] + w[i:j] + rest[k:] for k in range(len(rest) + 1)}
        layer = following - seen
        seen |= layer
        best = min([best] + [cost + table_of(w, r)[-1][-1] for w in layer])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abcd"), min_size=1, max_size=5), st.lists(st.sampled_from("abcd"), min_size=1, max_size=5))
def test_shift_edits_lie_between_the_best_and_plain_edits(h, r):
    found = shift_counts(["".join(h), "a", ""], ["".join(r), "a", "ab"])
    assert found[1:] == [0, 2]
    assert best_with_shifts(h, r) <= found[0] <= table_of(h, r)[-1][-1]


def test_shift_edits_do_not_depend_on_the_batch(monkeypatch):
    rng = random.Random(11)
    hyps, refs = (["".join(rng.choice("abcdef") for _ in range(rng.randrange(15))) for _ in range(80)] for _ in "hr")
    alone = [shift_counts([h], [r])[0] for h, r in zip(hyps, refs)]
    assert shift_counts(hyps, refs) == alone
    monkeypatch.setattr(ter, "BATCH", 3)
    monkeypatch.setattr(align, "CELLS", 500)
    assert shift_counts(hyps, refs) == alone


@pytest.fixture(scope="module")
def pairs(spark, small):
    return fixtures.pairs(spark, small)


def test_distance_bounds_and_symmetry(pairs):
    rows = pairs.select(text.words(F.col("ref")).alias("r"), text.words(F.col("hyp")).alias("h")).select(
        token_distance(F.col("r"), F.col("h")).alias("d"), token_distance(F.col("h"), F.col("r")).alias("e"),
        token_distance(F.col("r"), F.col("r")).alias("z"), F.size("r").alias("n"), F.size("h").alias("m"))
    bad = rows.where("d <> e or z <> 0 or d < abs(n - m) or d > greatest(n, m)")
    assert bad.count() == 0


def test_long_rows_keep_every_token_apart(spark):
    rows = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(60_000)), lambda i: i.cast("string")).alias("a"))
    codes = rows.select(F.length(F.lit("")), token_distance(F.slice("a", 59_990, 10), F.slice("a", 59_991, 10)))
    assert codes.first()[1] == 2


def test_scores_of_equal_texts(pairs):
    same = pairs.withColumn("hyp", F.col("ref"))
    assert scores.wer(same).first()["wer"] == 0
    assert scores.bleu(same).first()["bleu"] == pytest.approx(1.0, abs=1e-2)
    row = scores.pair_chrf(pairs).agg(F.min("chrf"), F.max("chrf")).first()
    assert 0 <= row[0] and row[1] <= 1


def test_normalize_is_idempotent(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select(text.normalize(F.col("text")).alias("a"))
    assert docs.where(text.normalize(F.col("a")) != F.col("a")).count() == 0


def test_both_ngram_forms_agree(pairs):
    split = pairs.select("system", "utt_id", text.words(F.col("hyp")).alias("hyp_tokens"),
                         text.words(F.col("ref")).alias("ref_tokens"))
    grouped = {(r["system"], r["n"]): r["clipped"] for r in
               ngrams.clip_by_grouping(split, ["system", "utt_id"], ["system"]).collect()}
    summed = scores.bleu(pairs, ["system"]).collect()
    assert grouped == {(r["system"], n): r[f"m{n}"] for r in summed for n in range(1, 5)}


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_results_do_not_depend_on_partitioning(spark, small, parts):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang").repartition(parts)
    order = [r["doc_id"] for r in ordering.seeded_shuffle(docs, "doc_id", 5).orderBy("position").collect()]
    expected = [r["doc_id"] for r in docs.orderBy(ordering.shuffle_key(5, F.col("doc_id")), "doc_id").collect()]
    assert order == expected and sorted(order) == sorted(r["doc_id"] for r in docs.collect())
    few = ordering.seeded_sample_per_group(docs, ["lang"], "doc_id", 7, 5)
    sizes = {r["lang"]: r["count"] for r in few.groupBy("lang").count().collect()}
    whole = {r["lang"]: min(7, r["count"]) for r in docs.groupBy("lang").count().collect()}
    assert sizes == whole


@pytest.mark.parametrize("n", [1, 40, 480, 900])
def test_samples_are_cut_before_they_move(spark, n):
    rows = spark.range(500).select(F.col("id").alias("k"), F.when(F.col("id") % 5 > 0, "a").when(F.col("id") % 2 > 0, "b").alias("g"),
                                   F.repeat(F.col("id").cast("string"), 50).alias("text"))
    order = {r["k"]: i for i, r in enumerate(rows.orderBy(ordering.shuffle_key(9, F.col("k")), "k").collect())}
    got = ordering.seeded_sample(rows, "k", n, 9)
    assert {r["k"] for r in got.collect()} == {k for k, i in order.items() if i < n}
    grouped = ordering.seeded_sample_per_group(rows, ["g"], "k", n, 9)
    want = set()
    for g in ("a", "b", None):
        own = sorted((i, r["k"]) for r in rows.collect() if r["g"] == g for i in [order[r["k"]]])
        want |= {k for _, k in own[:n]}
    assert {r["k"] for r in grouped.collect()} == want and grouped.columns == rows.columns
    for frame in (got, grouped):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "TakeOrderedAndProject" not in plan
        assert "_last#" in plan and "BroadcastHashJoin" in plan or frame is got  # the cut needs no exchange of the rows
    assert ordering.seeded_sample(rows, "k", -1, 9).count() == 500
    assert ordering.seeded_sample(rows.limit(0), "k", 3, 9).count() == 0


def test_running_values_with_one_hot_group(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, 0).when(F.col("id") % 7 > 1, F.col("id") % 7).alias("g"), "id",
                                    ((F.col("id") * 7919) % 1000).cast("double").alias("v"))
    got = ordering.running(rows, ["g"], ["id"], F.floor(F.col("id") / 100), ordinal="n", minimum=("v", "before"))
    groups = {}
    for r in got.orderBy("g", "id").collect():
        seen = groups.setdefault(r["g"], [])
        assert r["n"] == len(seen) + 1 and r["before"] == (min(seen) if seen else None)
        seen.append(r["v"])
    assert sum(map(len, groups.values())) == 3000


@pytest.mark.parametrize("k", [1, 20, 1500])
def test_retention_ranks_parts_of_a_hot_group(spark, k):
    rows = spark.range(4000).select(F.when(F.col("id") % 3 > 0, 0).when(F.col("id") % 5 > 0, F.col("id") % 5).alias("g"), "id")
    got = evaluations.retain_last(rows, ["g"], [F.desc("id")], k)
    groups = {}
    for r in rows.collect():
        groups.setdefault(r["g"], []).append(r["id"])
    assert {(r["g"], r["id"]) for r in got.collect()} == {(g, i) for g, ids in groups.items() for i in sorted(ids)[-k:]}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(g#" in plan and plan.count("_part#") > 1
    first = next(line for line in reversed(plan.split("\n")) if "Exchange hashpartitioning" in line)
    assert "_part#" in first  # the step that meets all rows deals them by part
    if k > 1000:
        sizes = rows.withColumn("p", F.pmod(F.xxhash64("g", "id"), F.lit(evaluations.PARTS))).groupBy("g", "p").count()
        assert sizes.agg(F.max("count")).first()[0] < 100  # of 2666 rows of the hot group


def test_unpadding_returns_the_input(spark):
    rows = spark.createDataFrame([([1.0, 2.0],), ([],)], "x array<float>")
    padded = rows.select("x", arrays.pad_right(F.col("x"), F.lit(5), F.lit(0.0).cast("float")).alias("p"),
                         arrays.attention_mask(F.col("x"), F.lit(5)).alias("m"))
    for r in padded.collect():
        assert len(r["p"]) == len(r["m"]) == 5
        assert [v for v, keep in zip(r["p"], r["m"]) if keep] == r["x"]


def test_fold_maps_are_disjoint():
    groups = [g for members in splits.PRODUCTION_FOLDS.values() for g in members]
    assert sorted(map(int, groups)) == list(range(1, 22))


def test_python_preprocessor(spark):
    pairs = list_pairs(spark, ["A b"], ["a B"])
    assert scores.wer(pairs, preprocessor=text.as_preprocessor(str.lower)).first()["edits"] == 0


def test_colliding_numbers_are_refused(spark):
    rows = spark.createDataFrame([(3, 0), (3, 999), (3, None)], "r bigint, p int")
    number = fixtures._numbered(F.col("r"), F.col("p"), 1000).alias("n")
    assert [r["n"] for r in rows.select(number).collect()] == [3000, 3999, None]
    with pytest.raises(Exception, match="more than 1000 parts in row 3"):
        spark.createDataFrame([(3, 1000)], "r bigint, p int").select(number).collect()
