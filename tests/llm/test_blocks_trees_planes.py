"""Bit-plane clustering, the range tree and fixed blocks against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from utterscale.llm import bit_planes, blocks, range_tree

NAN, INF = float("nan"), float("inf")


def vectors(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    return frame.withColumn("row", F.lit(1)).withColumn("planes", F.lit("x")).withColumn("cluster", F.lit(0)).repartition(3)


# clustering

def clusters_by_hand(rows, k=8, rounds=10, scale=1024, seed=3):
    kept = [(i, [math.floor(scale * e) for e in v]) for i, v, _ in rows
            if v is not None and len(v) == 64 and all(e is not None and math.isfinite(e) for e in v)]

    def order(r):
        return (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])

    centroids = [list(v) for _, v in sorted(kept, key=order)[:k]]

    def nearest(v):
        d = [sum((a - b)**2 for a, b in zip(v, c)) for c in centroids]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        member = [nearest(v)[0] for _, v in kept]
        for j in range(len(centroids)):
            own = [v for (_, v), m in zip(kept, member) if m == j]
            if own:
                centroids[j] = [sum(c) // len(own) for c in zip(*own)]
    last = [(i, *nearest(v)) for i, v in kept]
    sums = [sum(d for _, c, d in last if c == j) for j in range(len(centroids))]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, sums[c], sum(sums), names[c]) for i, c, d in last), key=repr)


def some_vectors():
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=64) * (3 if i % 5 else 0.1)).tolist(), i % 4) for i in range(90)]
    rows += [(200 + i, rows[7][1], 1) for i in range(40)] + [rows[3], (3, rows[4][1], 2), (None, rows[5][1], 0)]
    rows += [(300, None, 1), (301, [1.0] * 63, 1), (302, [NAN] * 64, 1), (303, [INF] + [0.0] * 63, 1),
             (304, [None] + [0.0] * 63, 1), (305, [0.0] * 64, 1), (306, [], 1)]
    return rows


@pytest.mark.parametrize("k", [1, 8, 500])
def test_clusters(spark, k):
    rows = some_vectors()
    got = bit_planes.clustered(vectors(spark, rows), k=k, rounds=4).collect()
    assert sorted((tuple(r) for r in got), key=repr) == clusters_by_hand(rows, k=k, rounds=4)


def test_clusters_edges(spark):
    rows = some_vectors()
    columns = "vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256".split(", ")
    for part in (rows[:0], rows[-7:-2]):
        got = bit_planes.clustered(vectors(spark, part))
        assert got.columns == columns and got.count() == 0
    with pytest.raises(ValueError):
        bit_planes.clustered(vectors(spark, [(1, [1e9] + [0.0] * 63, 0)]))


def test_planes_are_exact():
    rng = np.random.default_rng(1)
    for planes in (1, 2, 11, 27):
        x = rng.integers(-(1 << planes - 1), 1 << planes - 1, (50, 64))
        p = bit_planes.pack(x, planes)
        assert (bit_planes.products(p, p) == x @ x.T).all() and (bit_planes.norms(p) == (x * x).sum(1)).all()
        side = rng.integers(0, 3, 50)
        assert (bit_planes.sums(p, side, 3) == np.stack([x[side == j].sum(0) for j in range(3)])).all()


# hard negatives

def mined_by_hand(rows, step, k=5, scale=256):
    kept = [(i, lab, [math.floor(scale * e) for e in v]) for i, v, lab in rows
            if i is not None and lab is not None and v and all(e is not None and math.isfinite(e) for e in v)]
    out = []
    for a, (i, lab, v) in enumerate(kept):
        if i % step:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, b, m) for b, (j, m, w) in enumerate(kept) if b != a and len(w) == len(v))
        for p, j, _, _ in [s for s in scored if s[3] == lab][:k]:
            near = [s for s in scored if s[3] != lab and 80 * -p <= 100 * -s[0] <= 100 * -p][:k]
            out += [(i, j, rank + 1, s[1], -p, -s[0]) for rank, s in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("leaf, block", [(1024, 2048), (8, 7)])
def test_negatives(spark, monkeypatch, leaf, block):
    monkeypatch.setattr(range_tree, "LEAF", leaf)
    monkeypatch.setattr(range_tree, "BLOCK", block)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 6)) * 2
    rows = [(i, (centres[i % 6] + rng.normal(size=6) * 0.3).tolist(), int(rng.integers(0, 3))) for i in range(260)]
    rows += [(400 + i, rows[12][1], i % 2) for i in range(60)]  # ties: equal vectors under two labels
    rows += [rows[20], (20, rows[21][1], 0), (500, [0.0] * 6, 1), (510, [1.0, 2.0], 1), (520, [2.0, 2.0], 1), (530, [1.0, 2.0], 2)]
    rows += [(540, None, 1), (550, [NAN] * 6, 1), (560, [None] * 6, 1), (570, rows[0][1], None), (None, rows[0][1], 1),
             (580, [INF] * 6, 1), (590, [], 1), (600, [1.0, 2.0, 3.0], 1)]
    got = range_tree.mined(vectors(spark, rows), "vec_id % 10 = 0").collect()
    assert sorted(tuple(r) for r in got) == mined_by_hand(rows, 10)


def test_negatives_edges(spark):
    assert range_tree.mined(vectors(spark, []), "vec_id % 10 = 0").count() == 0
    assert range_tree.mined(vectors(spark, [(10, [1.0, 1.0], 1)]), "vec_id % 10 = 0").count() == 0
    assert range_tree.mined(vectors(spark, [(11, [1.0, 1.0], 1), (12, [1.0, 1.0], 2)]), "vec_id % 10 = 0").count() == 0
    with pytest.raises(ValueError):
        range_tree.mined(vectors(spark, [(10, [1e30], 1)]), "vec_id % 10 = 0")


def test_ranges_leave_out_siblings():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(100, 4)) + c for c in (np.eye(4) * 40)])
    tree = range_tree.planted(x, float((x * x).sum(1).max()), 16)
    lifted = tree.lifted(x)
    leaf = tree.leaf_of(lifted, True)
    q = np.c_[x[:20], np.zeros(20)]
    d = range_tree._apart(q, lifted)
    near, far = d[:, :100].min(1)[:, None], d[:, :100].max(1)[:, None]
    rows, leaves = tree.search(q, near, far)
    found = set(zip(rows.tolist(), leaves.tolist()))
    for a in range(20):  # nothing in the annulus is lost
        assert {(a, int(b)) for b in leaf[(d[a] >= near[a]) & (d[a] <= far[a])]} <= found
    assert len(found) < 20 * tree.leaves * 0.6


# repeated windows

def blocks_by_hand(rows, window):
    keyed = sorted({(i is None, i or 0, i, t) for i, t in rows}, key=lambda r: r[:2])
    first, texts = {}, {}
    for _, _, i, t in keyed:
        texts[i, t] = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        for k in range(len(texts[i, t]) - window + 1):
            first.setdefault(tuple(texts[i, t][k:k + window]), (i, t, k))
    out = []
    for i, t in rows:
        words = texts[i, t]
        gone = set()
        for k in range(len(words) - window + 1):
            if first[tuple(words[k:k + window])] != (i, t, k):
                gone.update(range(k, k + window))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept.encode()))
    return sorted(out, key=repr)


def repeating_rows():
    rng = random.Random(4)
    passages = [[f"p{i}x{j}" for j in range(rng.randint(10, 60))] for i in range(6)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += rng.choice(passages) if rng.random() < 0.6 else [f"w{rng.randint(0, 4)}" for _ in range(rng.randint(1, 30))]
        rows.append((i, rng.choice([" ", "\n", " \t\x0b "]).join(words)))
    rows += [(500 + i, "a hot passage " * 20) for i in range(40)] + [rows[5], rows[5]]
    rows += [(None, rows[6][1]), (None, None), (700, None), (701, ""), (702, " \n "), (703, "ä ö ü " * 30), (704, "    x " * 25),
             (705, "x" * 200_000 + " " + rows[6][1]), (706, "x" * 200_000 + " " + rows[6][1]), (707, "0 1 2 3 4 " * 4000)]
    return rows


@pytest.mark.parametrize("window, piece, load", [(20, 1 << 21, 1 << 21), (3, 3000, 500), (7, 1 << 17, 2000)])
def test_repeated_windows(spark, monkeypatch, window, piece, load):
    monkeypatch.setattr(blocks, "PIECE", piece)
    monkeypatch.setattr(blocks, "LOAD", load)
    rows = repeating_rows()
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit(1)).withColumn("starts", F.lit("x"))
    got = blocks.removed(frame.repartition(5), window).collect()
    assert sorted((tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in got), key=repr) == blocks_by_hand(rows, window)


def test_repeated_windows_edges(spark):
    frame = spark.createDataFrame([], "doc_id int, text string")
    got = blocks.removed(frame)
    assert got.count() == 0 and got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]
    # one id, two texts: both are documents, one before the other
    frame = spark.createDataFrame([(1, "a " * 30), (1, "a " * 40)], "doc_id int, text string")
    assert sorted(r["n_removed"] for r in blocks.removed(frame).collect())[0] in (29, 30)
    with pytest.raises(ValueError):
        blocks.removed(frame, 2)


def test_words_do_not_depend_on_their_place():
    texts = [b"one two", b"", b"three", b"\tfour  five\n", b"x" * 70_000 + b" y", b"two" + b" z" * 40_000, b"x" * 70_000, "ä".encode()]
    flat = np.frombuffer(b"".join(texts), np.uint8)
    h, counts = blocks.word_hashes(flat, np.cumsum([0, *map(len, texts)]))
    words = [w for t in texts for w in t.split()]
    assert counts.tolist() == [len(t.split()) for t in texts]
    names = {}
    for w, x in zip(words, h.tolist()):
        assert names.setdefault(w, x) == x
    assert len(set(names.values())) == len(names)
