"""Hand-worked results (layer 2)."""

import math

import pytest
from pyspark.sql import functions as F

from tests.compare import list_pairs
from utterscale.functions import annotation, arrays, text
from utterscale.operators import align, batching, evaluations, pairing, scores, splits, vocabulary


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first()["y"]


def scored(spark, fn, hyp, ref, column):
    return fn(list_pairs(spark, hyp, ref)).first()[column]


@pytest.mark.parametrize("given, want", [
    ("Straße  Ça-va/là", "strasse ca va la"),
    ("end of line.\nNext line", "end of linenext line"),
    ("ñandú Ünï", "andu ün"),
    ("A & B", "a b"),
    ("3D–Print", "3d print"),
    ("it’s", "its"),
    (" \t ", ""),
])
def test_normalize(spark, given, want):
    assert one(spark, given, text.normalize) == want


@pytest.mark.parametrize("hyp, ref, edits, length", [
    ("the cat on the mat", "the cat sat on mat", 2, 5),
    ("", "a b c", 3, 3),
    ("a b c", "a", 2, 1),
])
def test_wer(spark, hyp, ref, edits, length):
    row = scores.wer(list_pairs(spark, hyp, ref)).first()
    assert (row["edits"], row["ref_words"]) == (edits, length)


@pytest.mark.parametrize("hyp, ref, edits, length", [("", "a b c", 5, 5), ("a b c", "a", 4, 1), ("äö", "ao", 2, 2)])
def test_cer(spark, hyp, ref, edits, length):
    row = scores.cer(list_pairs(spark, hyp, ref)).first()
    assert (row["edits"], row["ref_chars"]) == (edits, length)


def vocab_of(spark, texts, min_freq, compat=True):
    rows = spark.createDataFrame(list(enumerate(texts)), "id bigint, t string")
    return vocabulary.lookup(vocabulary.build(vocabulary.char_freq(rows, "t", "id"), min_freq, compat))


def test_vocabulary_compat(spark):
    assert vocab_of(spark, ["ab ab", "ba c"], 1) == {"a": 1, "b": 2, "|": 3, "[UNK]": 3}
    assert vocab_of(spark, ["ab ab", "ba c"], 0) == {"a": 1, "b": 2, "|": 3, "c": 4, "[UNK]": 4}


def test_vocabulary_dense(spark):
    assert vocab_of(spark, ["xab ab", "ba|c"], 1, compat=False) == {"a": 1, "b": 2, "[UNK]": 3, "[PAD]": 4}
    assert vocab_of(spark, ["a b| |"], 0) == {"a": 1, "|": 2, "b": 3, "[UNK]": 3}


def test_vocabulary_is_written_once(spark, tmp_path):
    rows = spark.createDataFrame([(0, "aab")], "id bigint, t string")
    vocab = vocabulary.build(vocabulary.char_freq(rows, "t", "id"), 0)
    path = str(tmp_path / "vocab")
    vocabulary.save_once(vocab, path)
    vocabulary.save_once(vocab.limit(1), path)
    assert spark.read.parquet(path).count() == 3
    vocabulary.save_json(vocab, str(tmp_path / "json"))
    assert spark.read.text(str(tmp_path / "json")).first()["value"] == '{"[UNK]":2,"a":1,"b":2}'


def test_encode_decode(spark):
    ids = {"a": 1, "b": 2, "|": 3, "[UNK]": 4}
    assert one(spark, "ab zb", lambda c: vocabulary.encode(c, ids)) == [1, 2, 3, 4, 2]
    assert one(spark, "", lambda c: vocabulary.encode(c, ids)) == []
    assert one(spark, [1, 1, 3, 2, -100, -100], lambda c: vocabulary.decode(c, ids, 9), "array<int>") == "aa b"


def test_ctc(spark):
    tokens = F.array(*[F.lit(t) for t in ["", "a", "b", "|"]])
    ids = [9, 1, 1, 9, 1, 2, 2, 3, 3, 1, 9]
    assert one(spark, ids, lambda c: arrays.ids_to_text(c, tokens, 9), "array<int>") == "aab a"
    assert one(spark, [9, 9], lambda c: arrays.ids_to_text(c, tokens, 9), "array<int>") == ""
    assert one(spark, [], lambda c: arrays.ids_to_text(c, tokens, 9), "array<int>") == ""


def test_frame_argmax_takes_first_maximum(spark):
    assert one(spark, [[0.5, 0.9, 0.9], [1.0, 0.0, 1.0]], arrays.frame_argmax, "array<array<float>>") == [1, 0]


def test_znorm(spark):
    got = one(spark, [1.0, 2.0, 3.0, 4.0], arrays.znorm, "array<float>")
    assert [round(x, 6) for x in got] == [-1.341641, -0.447214, 0.447214, 1.341641]


@pytest.mark.parametrize("hyp, ref, want", [
    (["the cat sat on mat today"], ["the cat sat on the mat today"], 0.511508),
    (["a b", "a b c d e"], ["a b", "a b c d e"], 0.840896),
    (["x"], ["y"], 0.0),
])
def test_bleu(spark, hyp, ref, want):
    assert round(scored(spark, scores.bleu, hyp, ref, "bleu"), 6) == want


def test_bleu_two_references(spark):
    assert scored(spark, scores.bleu_two_refs, "ich habe drei rote hunde", "ich habe 3 rote hunde", "bleu") == 1.0


def test_sentence_bleu(spark):
    assert round(scored(spark, scores.sentence_bleu_char, "he plays", "he play", "bleu"), 6) == 0.840896
    assert scored(spark, scores.sentence_bleu_char, "", "he play", "bleu") == 0.0
    # one character in common, no bigram: 0.1 stands for each missing match
    want = math.exp((math.log(1 / 4) + math.log(0.1 / 3) + math.log(0.1 / 2) + math.log(0.1)) / 4)
    assert scored(spark, scores.sentence_bleu_char, "axyz", "abcd", "bleu") == pytest.approx(want)


def test_chrf(spark):
    assert round(scored(spark, scores.chrf, "he plays", "he play", "chrf"), 6) == 0.961470
    assert round(scored(spark, scores.chrf, "ab", "ab", "chrf"), 6) == 0.333333


@pytest.mark.parametrize("given, want", [
    ("10-20", "zehn-zwanzig"), ("1'000", "1'000"), ("1,5", "1,5"), ("...", "..."), ("3 Hunde", "drei Hunde"),
    ("1.", "erste"), ("3.", "dritte"), ("7.", "siebte"), ("8.", "achte"), ("20.", "zwanzigste"), ("100.", "hundertste"),
    ("101.", "einhunderterste"), ("1000.", "tausendste"), ("1000000.", "millionste"), ("2000000.", "zweimillionste"),
    ("0", "null"), ("007", "sieben"), ("12", "zwölf"), ("21", "einundzwanzig"), ("100", "einhundert"),
    ("1001", "eintausendeins"), ("1100", "eintausendeinhundert"), ("1000000", "eine Million"),
    ("2500000", "zwei Millionen fünfhunderttausend"), ("1.5", "eins Komma fünf"), ("12.50", "zwölf Komma fünf"),
    ("2.0", "zwei"), ("2.0.", "2.0."), ("a-3b-4", "a-dreib-4"), ("5–6", "fünf–sechs"), ("  3\t4 ", "drei vier"),
    ("1" + "0" * 18, "eine Trillion"),
])
def test_number_words(spark, given, want):
    assert one(spark, given, text.numbers_to_words) == want


def test_padding(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0, 3.0], [7]), (2, [4.0], [8, 9])],
                                 "utt_id bigint, input_values array<float>, labels array<int>")
    plan = spark.createDataFrame([(1, 0, 0, 3, 2), (2, 0, 1, 3, 2)],
                                 "utt_id bigint, batch_id int, position int, longest_input int, longest_label int")
    out = {r["utt_id"]: r for r in batching.pad_batches(rows, plan, multiple_of=4, multiple_of_labels=4).collect()}
    assert out[1]["attention_mask"] == [1, 1, 1, 0] and out[2]["attention_mask"] == [1, 0, 0, 0]
    assert out[2]["input_values"] == [4.0, 0.0, 0.0, 0.0]
    assert out[1]["labels"] == [7, -100, -100, -100] and out[2]["labels"] == [8, 9, -100, -100]
    free = batching.pad_batches(rows, plan, padding=False).where("utt_id = 2").first()
    assert free["input_values"] == [4.0]
    long = batching.pad_batches(rows, plan, padding="max_length", max_length=2, max_length_labels=1)
    assert long.where("utt_id = 1").first()["input_values"] == [1.0, 2.0, 3.0]
    with pytest.raises(ValueError):
        batching.target_length(F.lit(1), F.lit(1), "max_length")


def test_longest_row_comes_first(spark):
    rows = spark.range(200).select(F.col("id"), ((F.col("id") * 37) % 101).cast("int").alias("len"))
    plan = batching.length_batches(rows, "id", "len", 4, 7)
    first = plan.where("position = 0").first()
    assert first["len"] == rows.agg(F.max("len")).first()[0]
    assert sorted(r["position"] for r in plan.collect()) == list(range(200))


def test_kfold(spark):
    train = splits.kfold_train_groups(spark, spark.range(11).withColumnRenamed("id", "group_id"))
    assert sorted(r["group_id"] for r in train.where("fold = 3").collect()) == list(range(9))


def test_best_so_far(spark):
    rows = spark.createDataFrame([("r", i, w) for i, w in enumerate([1.2, 0.9, 0.9, 0.5])], "run string, step int, wer double")
    got = evaluations.best_so_far(rows, ["step"]).orderBy("eval_nr").collect()
    assert [r["saved"] for r in got] == [False, True, False, True]
    assert [r["eval_nr"] for r in got] == [1, 2, 3, 4]


def test_annotations(spark):
    def parsed(t):
        return [(p["word"], p["tag"]) for p in one(spark, t, annotation.parse_annotations)]

    assert parsed("He plays on the Wiese@g")[-1] == ("Wiese", "l1")
    assert parsed("He play@! soccer.")[1] == ("play", "error")
    assert parsed("What @! you doing?")[1] == (None, "missing")
    assert parsed("have@? a  (…) nice -- face")[0] == ("have", "guess")
    assert one(spark, "He’s - he's (...) on Wiese@g, now", lambda c: annotation.clean_text(
        annotation.parse_annotations(c))) == "He’s he's on Wiese, now"


def test_annotated_error_rate(spark):
    rows = spark.createDataFrame(
        [("He play soccer on the Wiese".split(), [None, "error", None, None, None, "l1"],
          "He plays soccer on the Wiese".split())], "ref_tokens array<string>, ref_tags array<string>, hyp_tokens array<string>")
    got = {r["tag"]: r["annotated_wer"] for r in align.annotated_error_rate(rows).collect()}
    assert got == {"error": 1.0, "l1": 0.0}


@pytest.mark.parametrize("hyp, ref, edits", [
    ("b a c d", "a b c d", 1), ("a b c", "a b c", 0), ("", "a b", 2), ("A B", "a b", 0),
    ("c d e a b", "a b c d e", 1), ("x y", "a b", 2),
])
def test_ter(spark, hyp, ref, edits):
    row = scores.ter(list_pairs(spark, hyp, ref)).first()
    assert (row["edits"], row["ref_words"]) == (edits, len(ref.split()))


def test_empty_references_are_left_out(spark):
    pairs = list_pairs(spark, ["a", "b"], ["a", "&"])
    assert scores.wer(pairs, preprocessor=text.normalize).first()["n_pairs"] == 1
    assert pairing.prepare(pairs, text.normalize, drop_empty_refs=True).count() == 1
    assert scores.wer(list_pairs(spark, ["a"], [""])).count() == 0


def test_guards(spark):
    groups = spark.createDataFrame([("A",), ("B",)], "system string")
    scored_rows = spark.createDataFrame([("A", 0.5, 0.4)], "system string, wer double, bleu double")
    got = {r["system"]: (r["wer"], r["bleu"]) for r in scores.guarded(groups, scored_rows, ["system"]).collect()}
    assert got == {"A": (0.5, 0.4), "B": (math.inf, 0.0)}


@pytest.mark.parametrize("path, name, stem", [
    ("/a/b/c.txt", "c.txt", "c"), ("c.tar.gz", "c.tar.gz", "c.tar"), (".bashrc", ".bashrc", ".bashrc"),
    ("/x/..a.b", "..a.b", "..a"), ("plain", "plain", "plain"), ("a.", "a.", "a"), ("/dir/", "", ""),
])
def test_file_names(spark, path, name, stem):
    assert one(spark, path, text.file_name) == name
    assert one(spark, path, text.file_stem) == stem


def test_terms(spark):
    terms = {"ps5": "ps five", "3d": "three d"}
    assert one(spark, "My PS5 is 3D not ps55", lambda c: text.map_terms(c, terms)) == "my ps five is three d not ps55"
    assert one(spark, "My PS5", lambda c: text.map_terms(c, terms, lowercase=False)) == "My PS5"


def test_recording_id(spark):
    row = one(spark, "8032_6_B", text.recording_id_parts)
    assert tuple(row) == ("8032", 6, "B")
    assert tuple(one(spark, "8404_5", text.recording_id_parts)) == ("8404", 5, None)


def test_null_references_are_left_out(spark):
    pairs = list_pairs(spark, ["a b", "c", None], ["a b", None, "d"])
    assert scores.wer(pairs).first()["n_pairs"] == 2
    assert 0 <= scores.bleu(pairs).first()["bleu"] <= 1
    assert scores.chrf(pairs).first() is not None


def test_marks_with_punctuation_are_no_words(spark):
    got = one(spark, "a @!. b (...), - c", lambda x: annotation.clean_text(annotation.parse_annotations(x)))
    assert got == "a b c"


def test_vocabulary_order_is_by_row_and_position_without_sorting(spark):
    big = (1 << 63) - 1
    rows = spark.createDataFrame([(big, "zyx"), (-big - 1, "😀b" + "a" * 70_000), (0, "ca|"), (1, None), (2, "")], "id bigint, t string")
    freq = vocabulary.char_freq(rows.repartition(3), "t", "id")
    got = {r["ch"]: (r["freq"], r["first_row"], r["first_pos"]) for r in freq.collect()}
    assert got == {"z": (1, big, 0), "y": (1, big, 1), "x": (1, big, 2), "😀": (1, -big - 1, 0), "b": (1, -big - 1, 1),
                   "a": (70_001, -big - 1, 2), "c": (1, 0, 0), "|": (1, 0, 2)}
    plan = freq._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "Sort" not in plan
    assert list(vocabulary.lookup(vocabulary.build(freq, 0).orderBy("id")))[:3] == ["😀", "b", "a"]


def test_pad_follows_the_tokens_and_sentence_marks(spark):
    freq = vocabulary.char_freq(spark.createDataFrame([(0, "ab ab"), (1, "ba c")], "id bigint, t string"), "t", "id")
    assert vocabulary.lookup(vocabulary.with_pad(vocabulary.build(freq, 1))) == {"a": 1, "b": 2, "|": 3, "[UNK]": 3, "[PAD]": 6}
    dense = vocabulary.build(freq, 1, compat=False)
    assert vocabulary.lookup(vocabulary.with_pad(dense)) == vocabulary.lookup(dense)
    assert vocabulary.lookup(vocabulary.with_pad(dense.limit(0))) == {"[PAD]": 2}


def test_encoding_with_a_large_alphabet(spark):
    ids = {chr(0x4E00 + 3 * i): 7 + i for i in range(6000)} | {"😀": 5, "|": 6, "[UNK]": 3}
    value = "".join(chr(0x4E00 + i) for i in range(40)) + " |😀\U0010ffff\x00"
    want = [ids.get("|" if c == " " else c, 3) for c in value]
    assert one(spark, value, lambda c: vocabulary.encode(c, ids)) == want
    known = [i for i in want if i != 3]
    assert one(spark, known, lambda c: vocabulary.decode(c, ids, 99999), "array<int>") == "".join(
        c for c in value.replace("|", " ") if c in ids or c == " ").strip() + ""


@pytest.mark.parametrize("given, want", [
    ("a . b ? c ! d , e", "a. b? c! d, e"), ("it 's we 've you 're i 'm do n't", "it's we've you're i'm don't"),
    ("a ' b", "a'b"), ("x  .", "x ."), ("", "")])
def test_clean_up_after_decoding(spark, given, want):
    assert one(spark, given, arrays.clean_up) == want


def test_wanted_groups_keep_their_row(spark):
    pairs = spark.createDataFrame([("A", "a b c d e", "a b c d e"), ("B", "x", ""), ("B", None, ""), ("C", "y", None), (None, "a", "a b")],
                                  "system string, hyp string, ref string")
    wanted = spark.createDataFrame([("A",), ("B",), ("C",), ("D",), ("D",), (None,)], "system string")
    got = {r["system"]: (r["n_pairs"], r["wer"], round(r["bleu"], 6)) for r in scores.eval_report(pairs, ["system"], wanted).collect()}
    assert got == {"A": (1, 0.0, 1.0), "B": (2, math.inf, 0.0), "C": (0, math.inf, 0.0), "D": (0, math.inf, 0.0), None: (1, 0.5, got[None][2])}
    plan = scores.eval_report(pairs, ["system"], wanted)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_evaluation_from_frames(spark):
    rows = spark.createDataFrame([(1, [[0.1, 0.9, 0.9], [0.0, 1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 2.0, 1.0], [0.0, 0.1, 0.2]], [1, 1, 2, -100]),
                                  (2, None, [1]), (3, [[0.0, 1.0, 0.0]], None)], "id int, frames array<array<double>>, labels array<int>")
    tokens = F.array(F.lit("[PAD]"), F.lit("a"), F.lit("b"))
    got = {r["id"]: (r["hyp"], r["ref"]) for r in scores.decoded_pairs(rows, ["id"], tokens, 0).collect()}
    assert got == {1: ("aab", "aab"), 2: (None, "a"), 3: ("a", None)}
    report = scores.eval_report(scores.decoded_pairs(rows, [], tokens, 0), []).first()
    assert (report["n_pairs"], report["edits"], report["ref_words"]) == (2, 1, 2)
