"""Nearest neighbours by inner product from balanced posting lists.

A bounded sample is split into balanced leaves; their means are the centroids. Every vector
goes to its closest lists, also to those within a distance ratio of the closest (boundary
vectors are replicated). Centroids are searched through a neighbour graph in memory; a query
reads the lists whose centroids lie within a distance ratio of its closest one, and the next
closest until they are home to enough distinct vectors.

Inner products become distances by one more component that brings all vectors to the largest
norm. Equal vectors are one entry that carries its smallest ids, so copies cost nothing.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, and
rows with a null id take no part; vectors are compared with those of their length; rows that
repeat an id and a vector are one row; other rows with a repeated id are rows of their own, as
candidates and as queries, but no row with the query's id is found; equal scores go by
id; without any vector there are no rows; extra columns are ignored. Ids are integers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from utterscale.llm.common import written

LIST = 128  # vectors of a list aimed at
MAX_LISTS = 8192  # bounds the broadcast index: centroids and graph stay below 10 MB at 64 components
SAMPLE = 32  # sampled vectors per list the index is fitted on
DEGREE = 32
REPLICAS, REPLICA_RATIO = 8, 1.05
PROBE_RATIO = 1.15
LOAD = 1 << 20  # found entries a task holds before it combines them
BLOCK = 4096  # postings or queries of a list that one group may hold


@dataclass(frozen=True)
class Index:
    """``centroids`` with the norm component last, ``graph``: neighbours of each, ``norm``: the largest."""
    centroids: np.ndarray
    graph: np.ndarray
    pivots: np.ndarray
    norm: float

    def lifted(self, x: np.ndarray, query: bool) -> np.ndarray:
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.norm**2 - (x * x).sum(1), 0))
        return np.c_[x, more]

    def search(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the ``beam`` centroids that a best-first walk finds closest."""
        n, k = len(x), len(self.centroids)
        beam = min(beam, k)
        c, size = self.centroids, (self.centroids**2).sum(1)
        own = (x * x).sum(1)[:, None]

        def distance(rows, ids):
            return np.maximum(own[rows] + size[ids] - 2 * np.einsum("nd,nkd->nk", x[rows], c[ids]), 0)

        seen = np.zeros((n, k), bool)
        seen[:, self.pivots] = True
        start = np.maximum(own + size[self.pivots] - 2 * x @ c[self.pivots].T, 0)
        order = np.argsort(start, axis=1)[:, :beam]
        ids = np.full((n, beam), -1)
        dist = np.full((n, beam), np.inf)
        ids[:, :order.shape[1]], dist[:, :order.shape[1]] = self.pivots[order], np.take_along_axis(start, order, 1)
        open_ = ids >= 0
        while True:
            rows = np.flatnonzero(open_.any(1))
            if not len(rows):
                return ids, np.sqrt(dist)
            pick = np.argsort(~open_[rows], axis=1, kind="stable")[:, :4]  # the beam is sorted: the closest open ones
            live = np.take_along_axis(open_[rows], pick, 1)
            open_[rows[:, None], pick] = False
            near = self.graph[np.take_along_axis(ids[rows], pick, 1)]
            near = np.where(live[:, :, None], near, near[:, :1, :]).reshape(len(rows), -1)
            near.sort(axis=1)
            fresh = ~seen[rows[:, None], near] & np.c_[np.ones(len(rows), bool), near[:, 1:] != near[:, :-1]]
            seen[rows[:, None], near] = True
            d = np.where(fresh, distance(rows, near), np.inf)
            all_d, all_i = np.c_[dist[rows], d], np.c_[ids[rows], near]
            all_o = np.c_[open_[rows], fresh]
            keep = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
            dist[rows], ids[rows] = np.take_along_axis(all_d, keep, 1), np.take_along_axis(all_i, keep, 1)
            open_[rows] = np.take_along_axis(all_o, keep, 1) & np.isfinite(dist[rows])

    def within(self, x: np.ndarray, ratio: float, beam: int, held: np.ndarray, need: int) -> list[np.ndarray]:
        """All found centroids within ``ratio`` of the closest, and the next ones until their lists
        hold ``need`` vectors by ``held``; the beam widens until it ends beyond, at last to all lists."""
        out: list[np.ndarray] = [np.zeros(0, int)] * len(x)
        todo, k = np.arange(len(x)), len(self.centroids)
        while len(todo):
            ids, dist = self.search(x[todo], beam) if beam < k else self.all(x[todo])
            limit = dist[:, :1] * ratio
            sums = np.cumsum(np.where(ids >= 0, held[ids], 0), axis=1)
            enough = np.maximum((dist <= limit).sum(1), (sums < need).sum(1) + 1)
            done = (dist[:, -1:] > limit)[:, 0] & (sums[:, -1] >= need) | (beam >= k)
            for i in np.flatnonzero(done):
                found = ids[i][:enough[i]]
                out[todo[i]] = found[found >= 0]
            todo, beam = todo[~done], beam * 4
        return out

    def all(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of all centroids, the closest first."""
        d = (x * x).sum(1)[:, None] + (self.centroids**2).sum(1) - 2 * x @ self.centroids.T
        ids = np.argsort(d, axis=1, kind="stable")
        return ids, np.sqrt(np.maximum(np.take_along_axis(d, ids, 1), 0))


def _leaves(x: np.ndarray, leaf: int) -> np.ndarray:
    """Means of equal halves, split again and again along the line between two means."""
    rng, out, stack = np.random.default_rng(11), [], [np.arange(len(x))]
    while stack:
        m = stack.pop()
        if len(m) <= leaf:
            out.append(x[m].mean(0))
            continue
        y = x[m]
        two = y[rng.choice(len(y), 2, replace=False)]
        for _ in range(6):
            side = ((y - two[0])**2).sum(1) - ((y - two[1])**2).sum(1)
            far = side > np.median(side)
            if far.all() or not far.any():
                break
            two = np.stack([y[~far].mean(0), y[far].mean(0)])
        order = np.argsort(side, kind="stable")
        stack += [m[order[:len(m) // 2]], m[order[len(m) // 2:]]]
    return np.array(out)


def fit(vectors: DataFrame) -> Index | None:
    """The index of ``rep, v``; runs jobs when called. The driver holds at most ``MAX_LISTS * SAMPLE`` vectors."""
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    n, norm = vectors.agg(F.count("*"), F.max(size)).first()
    if not n:
        return None
    lists = max(1, min(MAX_LISTS, round(n / LIST)))
    rate = min(1.0, lists * SAMPLE / n)
    unit = F.pmod(F.xxhash64(F.lit(31), F.col("v")), F.lit(1 << 40)) / float(1 << 40)
    rows = vectors.where(unit < rate).orderBy("rep", "v").select("v").toArrow()["v"].combine_chunks()
    x = np.asarray(rows.flatten(), np.float64).reshape(len(rows), -1)
    if not len(x):  # a tiny table whose hashes all fall outside the sample
        rows = vectors.orderBy("rep", "v").limit(lists * SAMPLE).select("v").toArrow()["v"].combine_chunks()
        x = np.asarray(rows.flatten(), np.float64).reshape(len(rows), -1)
    x = np.c_[x, np.sqrt(np.maximum(norm**2 - (x * x).sum(1), 0))]
    centroids = _leaves(x, max(1, -(-len(x) // lists)))
    k, near = len(centroids), []
    size = (centroids**2).sum(1)
    for a in range(0, k, 512):
        d = size - 2 * centroids[a:a + 512] @ centroids.T
        near.append(np.argsort(d, axis=1, kind="stable")[:, :min(DEGREE, k)])
    pivots = np.unique(np.linspace(0, k - 1, max(1, int(np.ceil(2 * k**0.5)))).astype(int))
    return Index(centroids, np.concatenate(near), pivots, float(norm))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _assigned(rows: DataFrame, index: Index, held: np.ndarray | None = None, need: int = 0) -> DataFrame:
    """The rows, which have ``v``, with ``list, home``: one row per list of a vector; its home is the closest.

    With ``held``, the vectors at home in each list, rows are queries that ask for ``need`` vectors.
    """
    shared, query = rows.sparkSession.sparkContext.broadcast(index), held is not None

    def run(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                batch = whole.slice(a, 512)
                x = shared.value.lifted(_matrix(batch.column("v")), query)
                if query:
                    found = shared.value.within(x, PROBE_RATIO, 128, held, need)
                else:
                    ids, dist = shared.value.search(x, 32)
                    ids, dist = ids[:, :REPLICAS], dist[:, :REPLICAS]
                    found = [i[d <= d[0] * REPLICA_RATIO] for i, d in zip(ids, dist)]
                at = np.repeat(np.arange(len(found)), [len(f) for f in found])
                picked = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(np.concatenate(found), pa.int32()),
                                                  pa.array(np.r_[True, at[1:] != at[:-1]])], names=[*batch.schema.names, "list", "home"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{kinds}, list int, home boolean")


def _best(asked: np.ndarray, own: np.ndarray, x: np.ndarray, rep: np.ndarray, sole: np.ndarray, alone: np.ndarray,
          k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best entries of each query (fewer, if there are no more): place of the query, of the entry, exact score.

    An entry whose only id (``sole``, where ``alone``) is the query's own takes no part. All
    entries that may tie with the last one are scored exactly before the smaller ids win.
    """
    found = np.where(alone[None, :] & (sole[None, :] == own[:, None]), -np.inf, asked @ x.T)
    last = np.partition(found, len(x) - min(k, len(x)), axis=1)[:, len(x) - min(k, len(x))]
    slack = 1e-11 * (1 + np.sqrt((asked * asked).sum(1)) * np.sqrt((x * x).sum(1).max()))  # products are rounded
    q, e = np.nonzero((found >= (last - slack)[:, None]) & (found > -np.inf))
    # summed alike wherever a vector stands, so that a pair's score never depends on its block
    exact = np.concatenate([(asked[q[a:a + 8192]] * x[e[a:a + 8192]]).sum(1) for a in range(0, len(q), 8192)] or [np.zeros(0)])
    order = np.lexsort((rep[e], -exact, q))
    q, e, exact = q[order], e[order], exact[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], e[keep], exact[keep]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: up to ``k`` nearest rows found for each query row.

    ``vectors`` and ``queries`` have ``vec_id`` and ``embedding``; a query never finds its own
    id. Lists with more than ``BLOCK`` postings or queries are cut into blocks. Runs jobs when called.
    """
    good = [F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))),
            F.exists("embedding", lambda x: x != 0), F.col("vec_id").isNotNull()]

    def valid(rows: DataFrame) -> DataFrame:
        rows = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
        return rows.where(good[0] & good[1] & good[2]).select("vec_id", F.col("embedding").alias("v"))

    kind = vectors.schema["vec_id"].dataType.simpleString()
    rows, asked = valid(vectors), valid(queries)
    lengths = rows.select(F.size("v").alias("d")).distinct().join(asked.select(F.size("v").alias("d")).distinct(), "d").orderBy("d")
    parts = [_of_length(rows.where(F.size("v") == r["d"]), asked.where(F.size("v") == r["d"]), kind, k) for r in lengths.collect()]
    if not parts:
        return vectors.sparkSession.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _of_length(rows: DataFrame, asked: DataFrame, kind: str, k: int) -> DataFrame:
    """The result for ``vec_id, v`` of one length."""
    # the rank limit is applied before the shuffle as well: a hot vector sends k+1 ids per task
    first = (rows.withColumn("n", F.dense_rank().over(W.partitionBy("v").orderBy("vec_id"))).where(F.col("n") <= k + 1)
             .select("vec_id", "v").distinct())
    # "key" numbers the distinct vectors; "sole" is the id of a vector that has no other
    distinct = written(first.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(
        F.monotonically_increasing_id().alias("key"), F.col("ids")[0].alias("rep"), "v", "ids",
        F.when(F.size("ids") == 1, F.col("ids")[0]).alias("sole")), "vectors")
    index = fit(distinct)
    members = written(asked.distinct().select(F.monotonically_increasing_id().alias("q"), F.col("vec_id").alias("query_id"), "v"), "queries")
    postings = written(_assigned(distinct.drop("ids"), index), "postings")
    held = np.zeros(len(index.centroids), np.int64)
    for r in postings.where("home").groupBy("list").count().collect():  # at most MAX_LISTS rows
        held[r["list"]] = r["count"]
    probes = written(_assigned(members, index, held, k + 1), "probes")

    sizes = (postings.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("pn"))
             .join(probes.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("qn")), "list"))
    sizes = F.broadcast(sizes)  # at most MAX_LISTS rows
    left = postings.join(sizes, "list").select(
        "key", "rep", "sole", "v", "list", F.pmod(F.xxhash64("key"), F.col("pn")).cast("int").alias("p"),
        F.explode(F.sequence(F.lit(0), F.col("qn") - 1)).alias("b"))
    right = probes.join(sizes, "list").select(
        "q", "query_id", "v", "list", F.explode(F.sequence(F.lit(0), F.col("pn") - 1)).alias("p"),
        F.pmod(F.xxhash64("q"), F.col("qn")).cast("int").alias("b"))

    def scored(posts: pa.Table, asks: pa.Table) -> pa.Table:
        rep, x = np.asarray(posts["rep"]), _matrix(posts["v"])
        alone = ~np.asarray(posts["sole"].is_null())
        sole = np.asarray(posts["sole"].fill_null(0))
        out = [[], [], []]
        own, number, wanted = np.asarray(asks["query_id"]), np.asarray(asks["q"]), _matrix(asks["v"])
        for a in range(0, len(wanted), 256):
            q, e, exact = _best(wanted[a:a + 256], own[a:a + 256], x, rep, sole, alone, k)
            for o, values in zip(out, (number[a:a + 256][q], e, exact)):
                o.append(values)
        q, e, exact = (np.concatenate(o) for o in out)
        cuts = np.flatnonzero(np.r_[True, q[1:] != q[:-1], True]) if len(q) else np.zeros(1, np.int64)

        def lists(values):
            return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(values))

        return pa.table({"q": pa.array(q[cuts[:-1]], pa.int64()), "reps": lists(rep[e]), "keys": lists(np.asarray(posts["key"])[e]),
                         "scores": lists(exact)})

    def combined(batches):
        """The ``k`` best entries of each query among those its partition found."""
        held, size = [], 0

        def best_of(held):
            q, rep, key, score = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((key, rep, -score, q))
            q, rep, key, score = q[order], rep[order], key[order], score[order]
            # a vector of several lists has one score: its copies stand next to each other
            new = np.r_[True, (q[1:] != q[:-1]) | (key[1:] != key[:-1])] if len(q) else np.zeros(0, bool)
            q, rep, key, score = q[new], rep[new], key[new], score[new]
            keep = np.arange(len(q)) - np.searchsorted(q, q) < k
            return q[keep], rep[keep], key[keep], score[keep]

        def rows(found):
            return pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1]).cast(rep_type), pa.array(found[2], pa.int64()),
                                               pa.array(found[3], pa.float64())], names=["q", "rep", "key", "score"])

        for batch in batches:
            n = np.asarray(batch.column("keys").value_lengths(), np.int64)
            held.append((np.repeat(batch.column("q").to_numpy(), n), *(np.asarray(batch.column(c).flatten()) for c in ("reps", "keys", "scores"))))
            size += int(n.sum())
            if size >= LOAD:
                held = [best_of(held)]
                size = len(held[0][0])
                if size >= LOAD // 2:
                    yield rows(held[0])
                    held, size = [], 0
        if held:
            yield rows(best_of(held))

    keys = ["list", "p", "b"]
    rep_type = {"int": pa.int32(), "bigint": pa.int64()}.get(kind, pa.int64())
    found = (left.groupBy(*keys).cogroup(right.groupBy(*keys))
             .applyInArrow(scored, f"q long, reps array<{kind}>, keys array<long>, scores array<double>")
             .mapInArrow(combined, f"q long, rep {kind}, key long, score double"))
    best = (found.groupBy("q", "rep", "key").agg(F.max("score").alias("score"))
            .withColumn("n", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "rep", "key")))
            .where(F.col("n") <= k))
    # each of the k entries has an id beside the query's own, so k rows are among their smallest ids
    expanded = (best.join(distinct.select("key", "ids"), "key").join(members.select("q", "query_id"), "q")
                .select("q", "query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id"))
    ranked = expanded.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
