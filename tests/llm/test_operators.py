"""Small tables with nulls, empty and long texts, ties, repeats and clashing columns, against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from utterscale.llm import (bwt_repeats, chat_format, code_words, line_frequency, line_join, piece_transducer,
                            posting_lists, queries, set_relations, set_tiles, soft_mixing, warc_chain)
from utterscale.llm.components import components
from utterscale.sources.shared import shared_folder

WORDS = [f"w{i}" for i in range(60)]


def some_texts():
    rng = random.Random(5)
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(1, 60))) for _ in range(30)]
    texts += ["\n".join(rng.sample(texts, 3)) for _ in range(6)] + texts[:4]
    near = "one two three four five six seven eight nine ten eleven twelve " * 4
    texts += [near, near + "x", near.replace("ten", "TEN"), None, "", " \n\t ", "a", "a b", "#$ 12 %", "x" * 5000]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"s{i % 2}" if i % 7 else None, i) for i, t in enumerate(some_texts())]
    rows.append(rows[3])  # a repeated row
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_words long")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_repeats(docs, empty):
    length = 96
    got = sorted(tuple(r)[:5] for r in bwt_repeats.removed(docs, length).collect())
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    seen = collections.Counter(t[i:i + length] for _, t in rows for i in range(len(t) - length + 1))
    want = []
    for i, t in rows:
        gone = [False] * len(t)
        for k in range(len(t) - length + 1):
            if seen[t[k:k + length]] > 1:
                gone[k:k + length] = [True] * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        want.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    assert got == sorted(want)
    assert bwt_repeats.removed(empty, length).count() == 0


def test_merged_transforms_find_repeated_windows(monkeypatch):
    monkeypatch.setattr(bwt_repeats, "SHARD", 64)
    rng = np.random.default_rng(3)
    for _ in range(40):
        texts = [bytes(rng.integers(97, 99, rng.integers(0, 50)).astype(np.uint8)) for _ in range(rng.integers(1, 9))]
        weights = [int(w) for w in rng.integers(1, 3, len(texts))]
        length = int(rng.choice([8, 16, 24]))
        seen = collections.Counter()
        for t, w in zip(texts, weights):
            for i in range(len(t) - length + 1):
                seen[t[i:i + length]] += w
        want = [[i for i in range(len(t) - length + 1) if seen[t[i:i + length]] > 1] for t in texts]
        assert [x.tolist() for x in bwt_repeats.repeated(texts, weights, length)] == want


def test_repeats_of_any_length(spark, monkeypatch):
    monkeypatch.setattr(bwt_repeats, "SHARD", 64)
    rng = np.random.default_rng(8)
    for length in range(1, 27):
        for _ in range(4):
            texts = [bytes(rng.integers(97, 99, rng.integers(0, 50)).astype(np.uint8)) for _ in range(5)]
            seen = collections.Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
            want = [[i for i in range(len(t) - length + 1) if seen[t[i:i + length]] > 1] for t in texts]
            assert [x.tolist() for x in bwt_repeats.repeated(texts, [1] * 5, length)] == want
    core = "".join(random.Random(2).choices("abcdefgh", k=100))
    frame = spark.createDataFrame([(1, "x" + core + "1" * 30), (2, "y" + core + "2" * 30)], "doc_id long, text string")
    assert [r["n_removed"] for r in bwt_repeats.removed(frame, 100).orderBy("doc_id").collect()] == [100, 100]


def test_crowded_anchor_is_cut_further(spark, monkeypatch):
    monkeypatch.setattr(bwt_repeats, "CROWD", 3)
    rng = random.Random(1)
    core = "".join(rng.choices("abcdefgh", k=190))
    rows = [(i, "".join(rng.choices("ij", k=30)) + core + "".join(rng.choices("kl", k=30)) ) for i in range(30)]
    rows += [(30 + i, rows[i][1]) for i in range(3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    seen = collections.Counter(t[i:i + 200] for _, t in rows for i in range(len(t) - 199))
    got = {r["doc_id"]: r["n_removed"] for r in bwt_repeats.removed(frame).collect()}
    for i, t in rows:
        gone = set()
        for k in range(len(t) - 199):
            if seen[t[k:k + 200]] > 1:
                gone.update(range(k, k + 200))
        assert got[i] == len(gone)


def test_posting_lists(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    x[50:90] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(400, None), (401, [0.0] * 8), (402, [float("nan")] + [1.0] * 7), (403, [None] + [1.0] * 7), (404, [1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rep", F.lit(1))
    got = collections.defaultdict(list)
    for r in posting_lists.nearest(frame, frame.where("vec_id % 20 = 0"), 20).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    d = x.astype(np.float64)
    hits = 0
    assert sorted(got) == list(range(0, 400, 20))
    for q, found in got.items():
        s = d @ d[q]
        want = sorted((i for i in range(400) if i != q), key=lambda i: (-round(s[i], 9), i))[:20]
        hits += len(set(want) & {i for i, _ in found})
        assert [i for i, _ in found] == sorted((i for i, _ in found), key=lambda i: (-round(s[i], 9), i))
        assert q not in [i for i, _ in found] and len(found) == 20
    assert hits / 400 >= 0.9
    assert posting_lists.nearest(frame.limit(0), frame.limit(0)).count() == 0


def test_posting_lists_fill_every_query(spark, monkeypatch):
    monkeypatch.setattr(posting_lists, "LIST", 8)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 8))  # some 370 lists
    x[:, 0] = -abs(x[:, 0])
    x[:5] = np.eye(8)[0] * 3 + rng.normal(size=(5, 8)) * 0.1  # few, far from all others
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for k, queries_ in ((20, "vec_id < 5 OR vec_id % 30 = 0"), (700, "vec_id % 1000 = 0"), (3500, "vec_id = 7")):
        got = collections.defaultdict(set)
        for r in posting_lists.nearest(frame, frame.where(queries_), k).collect():
            got[r["query_id"]].add(r["vec_id"])
        assert len(got) == {20: 104, 700: 3, 3500: 1}[k]
        assert {len(found) for found in got.values()} == {min(k, 2999)}


def nearest_by_hand(rows, queries_, k):
    good = {(i, tuple(float(np.float32(e)) for e in v)) for i, v in rows if i is not None and v and all(
        e is not None and np.isfinite(e) for e in v) and any(v)}
    out = collections.Counter()
    for q, v in {r for r in good if queries_(r[0])}:
        found = sorted((-round(float(np.dot(v, w)), 9), i) for i, w in good if i != q and len(w) == len(v))[:k]
        out.update((q, n + 1, i, -s) for n, (s, i) in enumerate(found))
    return out


@pytest.mark.parametrize("block", [7, 4096])
def test_posting_lists_ties_repeats_and_lengths(spark, monkeypatch, block):
    monkeypatch.setattr(posting_lists, "BLOCK", block)
    monkeypatch.setattr(posting_lists, "LOAD", block * 10)
    rng = np.random.default_rng(4)
    rows = []
    for i in range(300):  # distinct vectors with equal products with the axes
        rows.append((i, [1.0, 0.0, 0.0, 0.0] if i % 20 == 0 else [1.0, *rng.integers(-9, 9, 3).astype(float).tolist()]))
    rows += [(0, [1.0, float(j), 0.0, 0.0]) for j in range(1, 7)] + [rows[40]] * 3 + [(500 + i, rows[40][1]) for i in range(40)]
    rows += [(600 + i, [float(i + 1), 1.0]) for i in range(30)] + [(700, [1.0]), (720, [2.0]), (740, [1.0] * 9), (760, None), (780, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = posting_lists.nearest(frame, frame.where("vec_id % 20 = 0"), 20).collect()
    assert collections.Counter((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in got) == nearest_by_hand(
        rows, lambda i: i % 20 == 0, 20)


@pytest.mark.parametrize("norms", ["even", "uneven"])
def test_recall_over_many_lists(spark, monkeypatch, norms):
    monkeypatch.setattr(posting_lists, "LIST", 16)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(6000, 16))  # some 375 lists
    if norms == "uneven":
        x *= rng.uniform(0.5, 2, (6000, 1))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(set)
    for r in posting_lists.nearest(frame, frame.where("vec_id % 20 = 0")).collect():
        got[r["query_id"]].add(r["vec_id"])
    hits = 0
    for q in range(0, 6000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:20].tolist()) & got[q])
    assert hits / (300 * 20) >= 0.9


def test_repeated_rows_are_one_document(spark):
    line = "all of these words stand on one line"
    own = "\nthese are some other words that are not like those of others at all"
    rows = [(1, line + own, "s")] * 30 + [(i, f"{line}{own} {i}", "t") for i in range(25)] + [(None, line + own, None)] * 40
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    frame = frame.withColumn("n", F.lit(0)).withColumn("line", F.lit(0)).withColumn("host", F.lit("h"))
    assert {r["host"] for r in line_frequency.frequent_lines(frame).collect()} == {"t"}
    removed = {(r["doc_id"], r["host"]): r["removed_words"] for r in line_frequency.judged(frame).collect()}
    assert removed[1, "s"] == 0 and removed[None, ""] == 0 and removed[7, "t"] == 8 and removed[24, "t"] == 8
    both = spark.createDataFrame([(i, line, "" if i % 2 else None) for i in range(24)], "doc_id long, text string, source string")
    assert [r["host"] for r in line_frequency.frequent_lines(both).collect()] == [""]


def test_line_frequency(docs, empty):
    rows = line_frequency.judged(docs, min_docs=1, share=0.0).collect()
    assert len(rows) == docs.count()
    assert all(not r["kept"] for r in rows if r["n_words"] < 10)
    assert line_frequency.cleaned(docs, min_docs=1, share=0.0).count() == sum(r["kept"] for r in rows)
    assert line_frequency.judged(empty).count() == 0


def test_code_words(spark):
    held = code_words.codewords(4)
    assert held.shape == (4, 7) and len({tuple(c) for c in held}) == 4
    rows = [(i, f"{'der und die' if i % 2 else 'the and of'} {i}", "de" if i % 2 else "en", "x") for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = code_words.fit(frame)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 %"), (4, "und die"), (5, "of the")], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in code_words.predict(odd, model).collect()}
    assert got == {1: "und", 2: "und", 3: "und", 4: "de", 5: "en"}
    nothing = code_words.fit(frame.limit(0))
    assert {r["lang_pred"] for r in code_words.predict(odd, nothing).collect()} == {"und"}


def test_language_held_out(spark, small):
    got = queries.op4_code_words(spark, small).join(spark.read.parquet(f"{small}/documents.parquet"), "doc_id")
    right = got.where("held_out AND lang_pred <> 'und'").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.95


def test_chat_round_trip(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "user", said), (1, 1, "assistant", said), (1, 2, "tool [/ROLE]", "\\<s>\\\\"), (2, 0, "assistant", None),
            (2, 1, None, "ä𝄞"), (None, 0, "user", ""), (3, 0, "assistant", "a"), (3, 0, "assistant", "a"), (3, 1, "system", "[ROLE]")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit(0))
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.formatted(frame)).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[conv]["n_turns"] == len(own)
        assert got[conv]["turns_sha256"] == hashlib.sha256(turns.encode()).hexdigest()
        assert got[conv]["loss_chars"] == len(loss)
        assert got[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat_format.formatted(frame.limit(0)).count() == 0


def test_warc_rejects_magic_in_payloads(spark):
    fake = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    html = ["plain", None, "", fake, fake + "tail" + fake, "WARC/1.0\r\n", "x" * 100000, "plain", "a\r\n\r\nWARC/1.0\r\nContent-Length: 7"]
    rows = [(i, f"http://h/{i}\n", h) for i, h in enumerate(html)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x"))
    got = {r["page_id"]: r for r in warc_chain.round_trip(frame, shared_folder(spark, "warc-test")).collect()}
    assert sorted(got) == list(range(len(html)))
    for i, h in enumerate(html):
        assert got[i]["payload_bytes"] == len((h or "").encode()) and got[i]["digest_ok"]
    assert (got[7]["record_type"], got[7]["refers_to"], got[2]["refers_to"]) == ("revisit", 0, 1)
    assert warc_chain.round_trip(frame.limit(0), shared_folder(spark, "warc-test")).count() == 0


def test_rates_match_targets(spark):
    rng = np.random.default_rng(4)
    p = rng.dirichlet([1, 1, 1], 200)
    rows = [(i, 1, int(rng.integers(1, 90)), x.tolist()) for i, x in enumerate(p)]
    frame = spark.createDataFrame(rows, "doc_id long, n_rows long, tokens long, posterior array<double>")
    found = soft_mixing.fit_rates(frame, [0.5, 0.3, 0.2], [0, 1, 2]).collect()
    totals = sum(r["rate"] * r["tokens"] * np.array(r["posterior"]) for r in found)
    assert np.allclose(totals / totals.sum(), [0.5, 0.3, 0.2], atol=1e-3)
    assert all(r["rate"] >= 0 for r in found)


def test_rates_are_fitted_to_the_end(spark):
    rng = np.random.default_rng(4)
    p = rng.dirichlet([1, 1, 1], 200)
    rows = [(i, 1, int(rng.integers(1, 90)), x.tolist()) for i, x in enumerate(p)]
    frame = spark.createDataFrame(rows, "doc_id long, n_rows long, tokens long, posterior array<double>")

    def missed(found, weights, whole):
        now, share = sum(r["tokens"] * np.array(r["posterior"]) for r in found), np.array(weights)
        target = share * max(now[i] / share[i] for i in whole)
        gap = sum(r["rate"] * r["tokens"] * np.array(r["posterior"]) for r in found) - target
        assert np.allclose([r["missed"] for r in found], gap, atol=1e-6 * target.sum())
        return np.abs(gap) / target.sum()

    # a corner of what the members reach: most rates are 0
    found = soft_mixing.fit_rates(frame, [0.9, 0.05, 0.05], [0, 1, 2]).collect()
    assert missed(found, [0.9, 0.05, 0.05], [0, 1, 2]).max() <= 1e-6
    # members that all hold some of an unwanted domain stay, and the domains with a weight are met
    found = soft_mixing.fit_rates(frame, [0.5, 0.5, 0.0], [0, 1]).collect()
    gap = missed(found, [0.5, 0.5, 0.0], [0, 1])
    assert gap[:2].max() <= 1e-6 and gap[2] > 0.01
    assert all(r["rate"] > 0.5 for r in found if r["posterior"][2] < 0.2)
    # out of reach: no member is that pure; ends, and says what is missed
    found = soft_mixing.fit_rates(frame, [0.9999, 0.00005, 0.00005], [0, 1, 2]).collect()
    assert missed(found, [0.9999, 0.00005, 0.00005], [0, 1, 2]).max() > 1e-6


def test_mixing_edge_cases(spark, docs, empty):
    labels = spark.createDataFrame([(i, f"d{i % 2}") for i in range(20)] + [(None, "d0"), (3, None)], "doc_id long, domain string")
    _, rows = soft_mixing.mixed(docs, labels, {"d0": 0.5, "d1": 0.5}, ["d0", "d1"])
    assert rows.agg(F.sum("n_rows")).first()[0] == docs.count()
    assert soft_mixing.mixed(empty, labels, {"d0": 1.0}, ["d0"])[1].count() == 0
    assert {r["rate"] for r in soft_mixing.mixed(docs, labels.limit(0), {}, [])[1].collect()} == {1.0}


def test_line_join(docs, empty):
    lines = []
    for i, text in sorted({(r["doc_id"], r["text"] or "") for r in docs.collect()}):
        lines += [(i, k, frozenset(lower(line).split())) for k, line in enumerate(text.split("\n"))]
    want = collections.defaultdict(list)
    for k, (i, n, s) in enumerate(lines):
        if any(s and 10 * len(s & t) >= 8 * len(s | t) for _, _, t in lines[:k]):
            want[i].append(n)
    got = {r["doc_id"]: r["removed"] for r in line_join.removed_lines(docs).collect()}
    assert {i: x for i, x in got.items() if x} == dict(want)
    assert line_join.deduplicated(docs).columns == docs.columns
    assert line_join.removed_lines(empty).count() == 0


@pytest.mark.parametrize("width, num, den", [(3, 90, 100), (5, 8, 10)])
def test_set_relations(docs, empty, width, num, den):
    sets = {}
    for r in docs.collect():
        w = lower(r["text"]).split()
        sets[r["doc_id"]] = ({tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    low = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                    low[a] = min(low[a], low[b])
    rows = set_relations.joined(docs, width, num, den).collect()
    assert len(rows) == docs.count()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == {i: (len(s), low[i]) for i, s in sets.items()}
    assert set_relations.joined(empty, width, num, den).count() == 0


def test_sets_of_very_different_sizes(spark):
    words = [f"v{i}" for i in range(660)]
    frame = spark.createDataFrame([(1, " ".join(words[:260])), (2, " ".join(words[:644])), (3, "a b c d e f g")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in set_relations.joined(frame, 5, 2, 5).collect()} == {1: 1, 2: 1, 3: 3}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (200, 200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 200}


def test_pieces_match_the_library(spark, docs):
    sentencepiece = pytest.importorskip("sentencepiece")
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.MODEL)
    rng = random.Random(9)
    alphabet = "abcdeèéßñ  \n\t12.,'\"日本語😀▁<0x41></s>"
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 80))) for _ in range(400)] + ["a" * 3000, "   ", "the The  the"]
    with open(queries.MODEL, "rb") as file:
        t = piece_transducer.Transducer(file.read())
    assert [t.encode(x).tolist() for x in texts] == sp.encode(texts)
    ids, counts = t.encode_all(texts)
    assert t.decode_all(ids, counts) == [sp.decode(x) for x in sp.encode(texts)]
    rows = piece_transducer.round_trip(docs, queries.MODEL).collect()
    assert len(rows) == docs.count() and all(r["same"] for r in rows)
    back = {r["doc_id"]: r["text"] for r in piece_transducer.decode(piece_transducer.encode(docs, queries.MODEL), queries.MODEL).collect()}
    assert back == {r["doc_id"]: r["text"] for r in docs.collect()}


def test_pipeline_keeps_columns_and_copies_go(spark, docs, tmp_path):
    import corpus_pipeline

    rows = docs.withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text")).drop("n_words")
    got = corpus_pipeline.identify(spark, rows, "")
    assert got.columns == rows.columns and got.where("text IS NULL OR text = ''").count() == 0
    kept = corpus_pipeline.drop_near_copies(spark, got, "")
    assert kept.columns == rows.columns
    near = {r["doc_id"] for r in kept.collect()} & {40, 41, 42}
    assert near == {40}


@pytest.mark.parametrize("fallback", [False, True])
def test_unigram_pieces_match_the_library(fallback):
    sentencepiece = pytest.importorskip("sentencepiece")
    from sentencepiece import sentencepiece_model_pb2

    rng = random.Random(4)
    model = sentencepiece_model_pb2.ModelProto()
    model.trainer_spec.model_type = 1
    model.trainer_spec.byte_fallback = fallback
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.remove_extra_whitespaces = True
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    pieces += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] if fallback else []
    names = {"▁", *"abcde", "▁a", "▁b", *("".join(rng.choices("abcdeé", k=rng.randint(2, 5))) for _ in range(60))}
    pieces += [(p, -rng.choice([1.0, 2.0, 2.5, 4.0]) * len(p), 1) for p in sorted(names)]  # ties are wanted
    for piece, score, kind in pieces:
        model.pieces.add(piece=piece, score=score, type=kind)
    blob = model.SerializeToString()
    sp, t = sentencepiece.SentencePieceProcessor(model_proto=blob), piece_transducer.Transducer(blob)
    texts = ["".join(rng.choices("abcdeé日 x", k=rng.randint(0, 60))) for _ in range(300)] + ["", "  ", "abcde" * 400]
    ids, counts = t.encode_all(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == sp.encode(texts)


def test_long_texts_without_blanks_match_the_library():
    sentencepiece = pytest.importorskip("sentencepiece")
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.MODEL)
    rng = random.Random(5)
    texts = ["abcdefghij" * 600, "".join(rng.choices("abcdeinst日\n", k=6000)), "".join(rng.choices(["the", "ing", "un", "tion"], k=900)), "日本" * 900]
    with open(queries.MODEL, "rb") as file:
        t = piece_transducer.Transducer(file.read())
    ids, counts = t.encode_all(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == sp.encode(texts)
    assert [len(x) for x in t.encode_all([])] == [0, 0]


def test_units_beyond_the_memory_match_the_library(spark, monkeypatch):
    sentencepiece = pytest.importorskip("sentencepiece")
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.MODEL)
    for name, bound in (("MEMO", 40), ("STEPS", 16), ("PIECE", 64)):
        monkeypatch.setattr(piece_transducer, name, bound)
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdeé日", k=rng.randint(1, 9))) for _ in range(120)]
    with open(queries.MODEL, "rb") as file:
        t = piece_transducer.Transducer(file.read())
    for _ in range(6):
        texts = [" ".join(rng.choices(words, k=rng.randint(0, 25))) for _ in range(8)]
        ids, counts = t.encode_all(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == sp.encode(texts)
        assert len(t.names) <= 40 + 120
    empty = spark.createDataFrame([], "doc_id long, text string, ids string")
    assert piece_transducer.round_trip(empty, queries.MODEL).collect() == []


def test_fine_sketches_part_unlike_sets_that_coarse_ones_chain():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 1 << 64, 256, dtype=np.uint64)) for _ in range(300)]
    sets += [np.unique(np.r_[s[:240], rng.integers(0, 1 << 64, 4, dtype=np.uint64)]) for s in sets[:12]]
    key, size = np.arange(len(sets)), np.array([len(s) for s in sets])
    coarse, fine = (set_tiles.alike(key, size, [set_tiles.sketch(s, room) for s in sets], 8, 10)
                    for room in (set_tiles.COARSE, set_tiles.FINE))
    assert len(coarse) > 250  # nearly all are one cluster, whose tokens would go to every tile
    assert sorted(tuple(sorted(p)) for p in fine) == [(i, 300 + i) for i in range(12)]
