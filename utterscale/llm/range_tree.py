"""Hard negatives in score windows below the positives, from a multiway hyperplane tree.

Vectors are integers; scores are inner products. One more component brings every vector to
the largest norm, so that a score is a Euclidean distance and a window of scores an annulus.
A node of the tree has up to ``FANOUT`` split points; a vector belongs to the nearest one.
Every split point stores, for each sibling subtree, the least and greatest distance to that
subtree's vectors. An anchor descends with its windows: the ranges bound its distance to
every sibling from below and above, and a sibling that no window's annulus meets is left out.
The leaves that remain are searched exactly.

Split points come from a bounded sample (``SAMPLE`` vectors); every vector is assigned, and
the ranges cover all of them. Three searches use the tree: the anchor's own leaf gives a
bound on its last positive's score, the leaves that reach the bound give the positives, and
the positives' windows give the negatives. Leaves are cut into blocks of ``BLOCK`` vectors
and of ``BLOCK`` anchors, so that no leaf, label or repeated vector fills a task.

Defined cases: rows with a null id, label or vector, or with null or non-finite components
take no part, neither do empty vectors; vectors are compared with those of their length;
repeated rows are rows of their own, so an anchor's copy can be its positive; equal scores go
by id; an anchor without positives, and a positive without a row in its window, give no rows;
an empty table gives no rows; extra columns are ignored. Scores of 2^48 and more raise an error.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from utterscale.llm.common import written

SAMPLE = 1 << 14  # vectors the split points are chosen from: 8 MB at 64 components
FANOUT = 16
LEAF = 1024  # vectors of a leaf aimed at, as far as the sample tells
BLOCK = 2048
EXACT = 1 << 48
NOTHING = -(1 << 62)


@dataclass
class Tree:
    """``splits[i]``: lifted split points of node i; ``below[i]``: per split point its node, or ``-1 - leaf``."""
    splits: list[np.ndarray] = field(default_factory=list)
    below: list[np.ndarray] = field(default_factory=list)
    low: list[np.ndarray] = field(default_factory=list)
    high: list[np.ndarray] = field(default_factory=list)
    leaves: int = 0
    norm: float = 0.0  # the largest squared length

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.c_[x, np.sqrt(np.maximum(self.norm - (x * x).sum(1), 0))]

    def leaf_of(self, x: np.ndarray, ranges: bool) -> np.ndarray:
        """The leaf of every lifted vector; ``ranges`` widens those of the nodes on the way."""
        out, stack = np.zeros(len(x), np.int32), [(0, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            d = _apart(x[rows], self.splits[node])
            pick = d.argmin(1)
            for j, child in enumerate(self.below[node]):
                mine = pick == j
                if not mine.any():
                    continue
                if ranges:
                    self.low[node][:, j] = np.minimum(self.low[node][:, j], d[mine].min(0))
                    self.high[node][:, j] = np.maximum(self.high[node][:, j], d[mine].max(0))
                if child < 0:
                    out[rows[mine]] = -1 - child
                else:
                    stack.append((child, rows[mine]))
        return out

    def search(self, x: np.ndarray, near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row, leaf) of the leaves that may hold a vector between ``near`` and ``far``, the
        distances of each row's windows (nan: no window)."""
        slack = 1e-6 * (1 + self.norm**0.5)  # distances are rounded
        rows_out, leaves_out, stack = [], [], [(0, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            d = _apart(x[rows], self.splits[node])[:, :, None]
            least = np.maximum(np.maximum(d - self.high[node], self.low[node] - d), 0).max(1)
            most = (d + self.high[node]).min(1)
            meets = (least[:, :, None] <= far[rows][:, None, :] + slack) & (most[:, :, None] >= near[rows][:, None, :] - slack)
            for j, child in enumerate(self.below[node]):
                go_on = rows[meets[:, j].any(1)]
                if not len(go_on):
                    continue
                if child < 0:
                    rows_out.append(go_on)
                    leaves_out.append(np.full(len(go_on), -1 - child))
                else:
                    stack.append((child, go_on))
        if not rows_out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(rows_out), np.concatenate(leaves_out)


def _apart(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2 * x @ p.T, 0))


def planted(sample: np.ndarray, norm: float, leaves: int) -> Tree:
    """A tree of about ``leaves`` leaves whose split points are vectors of the sample, far from each other."""
    tree, rng = Tree(norm=norm), np.random.default_rng(17)
    x = tree.lifted(sample)
    limit = max(1, len(x) // max(1, leaves))
    todo: list[tuple[np.ndarray, int, int]] = [(np.arange(len(x)), -1, 0)]  # rows, parent node, place in it
    while todo:
        rows, parent, place = todo.pop()
        some = rng.permutation(rows)[:3 * FANOUT]
        want = min(FANOUT, max(2, -(-len(rows) // limit)))
        picked, d = [some[0]], _apart(x[some], x[some[:1]])[:, 0]
        while len(picked) < want and d.max() > 0:  # the candidate farthest from those picked
            picked.append(some[d.argmax()])
            d = np.minimum(d, _apart(x[some], x[picked[-1:]])[:, 0])
        node, m = len(tree.splits), len(picked)
        if parent >= 0:
            tree.below[parent][place] = node
        tree.splits.append(x[picked])
        tree.below.append(np.zeros(m, np.int64))
        tree.low.append(np.full((m, m), np.inf))
        tree.high.append(np.full((m, m), -np.inf))
        side = _apart(x[rows], x[picked]).argmin(1)
        for j in range(m):
            mine = rows[side == j]
            if m > 1 and len(mine) > limit and len(mine) < len(rows):
                todo.append((mine, node, j))
            else:
                tree.below[node][j] = -1 - tree.leaves
                tree.leaves += 1
    return tree


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _grown(rows: DataFrame, tree: Tree) -> DataFrame:
    """``row, id, label, v, leaf``, written, and the tree's ranges widened to all of its vectors."""
    shared, kind = rows.sparkSession.sparkContext.broadcast(tree), {"id": pa.int64(), "label": pa.int64()}
    names = ["row", "id", "label", "v", "leaf", "node", "i", "j", "low", "high"]
    types = [pa.int64(), *kind.values(), pa.list_(pa.float64()), pa.int32(), *[pa.int32()] * 3, *[pa.float64()] * 2]

    def run(batches):
        own = Tree(shared.value.splits, shared.value.below, [a.copy() for a in shared.value.low],
                   [a.copy() for a in shared.value.high], shared.value.leaves, shared.value.norm)
        for batch in batches:
            leaf = own.leaf_of(own.lifted(_matrix(batch.column("v"))), True)
            yield pa.RecordBatch.from_arrays([*batch.select(names[:4]).columns, pa.array(leaf),
                                              *[pa.nulls(batch.num_rows, t) for t in types[5:]]], names=names)
        for node, (low, high) in enumerate(zip(own.low, own.high)):
            i, j = np.nonzero(np.isfinite(low))
            yield pa.RecordBatch.from_arrays(
                [*[pa.nulls(len(i), t) for t in types[:5]], pa.array(np.full(len(i), node, np.int32)), pa.array(i.astype(np.int32)),
                 pa.array(j.astype(np.int32)), pa.array(low[i, j]), pa.array(high[i, j])], names=names)

    table = written(rows.mapInArrow(run, "row long, id long, label long, v array<double>, leaf int, node int, i int, j int, "
                                         "low double, high double"), "leaves")
    found = table.where("leaf IS NULL").groupBy("node", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    for r in found.collect():  # at most FANOUT numbers per split point of the tree
        tree.low[r["node"]][r["i"], r["j"]], tree.high[r["node"]][r["i"], r["j"]] = r["low"], r["high"]
    return table.where("leaf IS NOT NULL").select("row", "id", "label", "v", "leaf")


def _probes(anchors: DataFrame, tree: Tree, own_leaf: bool) -> DataFrame:
    """``row, label, v, least, most, leaf`` of anchors with the score windows ``least, most``: one row per leaf to read."""
    shared = anchors.sparkSession.sparkContext.broadcast(tree)

    def run(batches):
        t = shared.value
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                batch = whole.slice(a, 256)
                v = _matrix(batch.column("v"))
                x = np.c_[v, np.zeros(len(v))]
                if own_leaf:
                    at, leaf = np.arange(len(v)), t.leaf_of(t.lifted(v), False)
                else:
                    width = max([1, *batch.column("least").value_lengths().to_pylist()])
                    windows = []
                    for side in ("most", "least"):
                        score = np.full((len(v), width), np.nan)
                        for i, s in enumerate(batch.column(side).to_pylist()):
                            score[i, :len(s)] = s
                        square = (v * v).sum(1)[:, None] + t.norm - 2 * score
                        windows.append(np.where(np.isnan(score), np.nan, np.sqrt(np.maximum(square, 0))))
                    at, leaf = t.search(x, *windows)
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(at)).columns, pa.array(leaf.astype(np.int32))],
                                                 names=[*batch.schema.names, "leaf"])

    return anchors.select("row", "label", "v", "least", "most").mapInArrow(
        run, "row long, label long, v array<double>, least array<double>, most array<double>, leaf int")


def _read(postings: DataFrame, probes: DataFrame, k: int, same: bool) -> DataFrame:
    """``anchor, slot, id, row, score``: per anchor and window (``slot``) at most ``k`` rows of each block
    in the window, the best; rows of the anchor's label if ``same``, else of others."""
    parts = postings.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("pn")).join(
        probes.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("qn")), "leaf")
    parts = F.broadcast(parts)  # one row per leaf of the bounded tree
    left = postings.join(parts, "leaf").select(
        "row", "id", "label", "v", "leaf", F.pmod(F.xxhash64("row"), F.col("pn")).cast("int").alias("p"),
        F.explode(F.sequence(F.lit(0), F.col("qn") - 1)).alias("q"))
    right = probes.join(parts, "leaf").select(
        "row", "label", "v", "least", "most", "leaf", F.explode(F.sequence(F.lit(0), F.col("pn") - 1)).alias("p"),
        F.pmod(F.xxhash64("row"), F.col("qn")).cast("int").alias("q"))

    def best(posts: pa.Table, asks: pa.Table) -> pa.Table:
        rows, ids = posts["row"].to_numpy(), posts["id"].to_numpy()
        order = np.lexsort((rows, ids))
        rows, ids, label, x = rows[order], ids[order], posts["label"].to_numpy()[order], _matrix(posts["v"])[order]
        n, bits = len(rows), max(1, (len(rows) - 1).bit_length())
        back = (n - 1 - np.arange(n)).astype(np.int64)  # smaller ids win among equal scores
        own, mine, anchors = asks["row"].to_numpy(), asks["label"].to_numpy(), _matrix(asks["v"])
        windows = list(zip(asks["least"].to_pylist(), asks["most"].to_pylist()))
        out: list[list[np.ndarray]] = [[], [], [], []]
        for a in range(0, len(own), 128):
            score = (anchors[a:a + 128] @ x.T).astype(np.int64)
            some = (label[None, :] == mine[a:a + 128, None]) == same
            some &= rows[None, :] != own[a:a + 128, None]
            key = np.where(some, (score << bits) + back, NOTHING)
            width = max([0, *[len(w[0]) for w in windows[a:a + 128]]])
            for slot in range(width):
                low, high = (np.array([w[i][slot] if len(w[i]) > slot else end for w in windows[a:a + 128]])
                             for i, end in ((0, np.inf), (1, -np.inf)))
                low = np.where(np.isinf(low), np.sign(low) * EXACT, low).astype(np.int64) << bits
                high = (np.where(np.isinf(high), np.sign(high) * EXACT, high).astype(np.int64) << bits) + ((1 << bits) - 1)
                inside = np.where((key >= low[:, None]) & (key <= high[:, None]), key, NOTHING)
                top = -np.partition(-inside, min(k, n) - 1, axis=1)[:, :k] if n > k else inside
                at, col = np.nonzero(top > NOTHING)
                found = top[at, col]
                post = n - 1 - (found & ((1 << bits) - 1))
                for o, values in zip(out, (own[a + at], np.full(len(at), slot, np.int32), rows[post], found >> bits)):
                    o.append(values)
        anchor, slot, row, score = (np.concatenate(o) if o else np.zeros(0, np.int64) for o in out)
        spot = np.argsort(rows, kind="stable")
        return pa.table({"anchor": pa.array(anchor, pa.int64()), "slot": pa.array(slot, pa.int32()),
                         "id": pa.array(ids[spot][np.searchsorted(rows[spot], row)], pa.int64()), "row": pa.array(row, pa.int64()),
                         "score": pa.array(score, pa.int64())})

    keys = ["leaf", "p", "q"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, "anchor long, slot int, id long, row long, score long")
    order = W.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _of_length(rows: DataFrame, anchors: DataFrame, positives: int, negatives: int, low: int, high: int, den: int) -> DataFrame:
    """The result for ``row, id, label, v`` of one length."""
    n, norm = rows.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    if norm >= EXACT:
        raise ValueError(f"scores reach {norm:.0f}; exact ones end at {EXACT}")
    rate = min(1.0, SAMPLE / n)
    unit = F.pmod(F.xxhash64(F.lit(5), F.col("row")), F.lit(1 << 40)) / float(1 << 40)
    sample = rows.where(unit < rate).orderBy("row").limit(2 * SAMPLE).select("v").toArrow()["v"]
    if not len(sample):
        sample = rows.orderBy("row").limit(SAMPLE).select("v").toArrow()["v"]
    tree = planted(_matrix(sample), norm, -(-n // LEAF))
    postings = _grown(rows, tree)
    none, whole = F.array().cast("array<double>"), F.array(F.lit(float("-inf")))
    start = anchors.withColumn("least", whole).withColumn("most", F.array(F.lit(float("inf"))))
    seed = _read(postings, written(_probes(start, tree, True), "probes"), positives, True)
    bound = seed.groupBy("anchor").agg(F.count("*").alias("n"), F.min("score").alias("s")).where(F.col("n") >= positives)
    reach = start.join(bound.select(F.col("anchor").alias("row"), F.col("s").cast("double").alias("s")), "row", "left").withColumn(
        "least", F.when(F.col("s").isNotNull(), F.array("s")).otherwise(F.col("least")))
    best = written(_read(postings, written(_probes(reach, tree, False), "probes"), positives, True), "positives")
    scores = best.groupBy(F.col("anchor").alias("row")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda s: s["score"]).alias("scores"))
    window = anchors.join(scores, "row").select(
        "row", "label", "v", F.transform("scores", lambda s: F.ceil(s * low / den).cast("double")).alias("least"),
        F.transform("scores", lambda s: F.floor(s * high / den).cast("double")).alias("most"))
    found = _read(postings, written(_probes(window, tree, False), "probes"), negatives, False)
    names = anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    pairs = best.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(pairs, ["anchor", "slot"]).join(names, "anchor").select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def mined(vectors: DataFrame, anchors: str, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, den: int = 100,
          scale: int = 256) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of ``vec_id, label, embedding``.

    ``anchors`` is a condition on ``vec_id``. Components become ``floor(scale * x)``. For each
    anchor and each of its first ``positives`` rows of the same label, the first ``negatives``
    rows of other labels with ``low * positive <= den * negative <= high * positive``. Runs
    jobs when called.
    """
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", "label", v.alias("v")).where(
        (F.size("v") > 0) & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
        & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    rows = written(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.col("label").cast("long").alias("label"),
                               F.transform("v", lambda e: F.floor(e * float(scale)).cast("double")).alias("v")), "vectors")
    parts = []
    for r in rows.groupBy(F.size("v").alias("d")).count().orderBy("d").collect():  # the lengths that occur
        own = rows.where(F.size("v") == r["d"]).withColumnRenamed("vec_id", "id")
        asked = own.where(anchors.replace("vec_id", "id"))
        parts.append(_of_length(own.withColumn("id", F.col("id").cast("long")), asked, positives, negatives, low, high, den))
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not parts:
        return vectors.sparkSession.createDataFrame([], result)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
