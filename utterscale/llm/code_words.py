"""Language identification by error-correcting output codes.

Every language gets a codeword of +1 and -1; for each bit a binary classifier over hashed
byte n-grams (log odds of the two sides, calibrated to a logistic margin) predicts the bit
of a text; the codeword with the smallest loss, weighted by how reliable each bit is for
that language, names the language.

Defined cases: text null or without a letter is ``und`` with score 0; without any labelled
text everything is ``und``; with one language everything with a letter gets it; ties go to
the language that sorts first; repeated rows are predicted alike; extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterscale.llm.common import flat_bytes, slices

ORDERS = (2, 3, 4)
BUCKETS = 1 << 15
PIECE = 1 << 20  # bytes handled at a time


@dataclass(frozen=True)
class Model:
    """``codes``: language x bit; ``odds``: bit x bucket; ``scale, shift``: per bit; ``trust``: language x bit."""
    languages: list[str]
    codes: np.ndarray
    odds: np.ndarray
    scale: np.ndarray
    shift: np.ndarray
    trust: np.ndarray


def codewords(n: int) -> np.ndarray:
    """Exhaustive code up to five languages, else the widest spread of seeded random codes."""
    if n == 1:
        return np.ones((1, 1))
    if n <= 5:
        rest = itertools.product([1, -1], repeat=n - 1)
        return np.array([(1, *column) for column in rest if -1 in column], dtype=float).T
    bits, rng = max(15, int(np.ceil(10 * np.log2(n)))), np.random.default_rng(7)
    best, gap = None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], size=(n, bits))
        code[0, np.abs(code.sum(0)) == n] *= -1  # a bit must tell some languages apart
        apart = (bits - code @ code.T) / 2 + bits * np.eye(n)
        if apart.min() > gap:
            best, gap = code, apart.min()
    return best


def _grams(data: np.ndarray, order: int) -> np.ndarray:
    code = np.zeros(len(data) - order + 1, np.uint32)
    for k in range(order):
        code = (code << np.uint32(8)) | data[k:len(data) - order + 1 + k]
    code = (code + np.uint32(order)) * np.uint32(2654435761)
    return code >> np.uint32(32 - 15)


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``buckets, rows`` of all n-grams that lie within one row, a bounded piece at a time."""
    for start in range(0, len(data), PIECE):
        for order in ORDERS:
            part = data[start:start + PIECE + order - 1]
            if len(part) < order:
                continue
            row = np.searchsorted(offsets, np.arange(start, start + len(part) - order + 1), side="right") - 1
            inside = np.arange(start, start + len(part) - order + 1) + order <= offsets[row + 1]
            yield _grams(part, order)[inside], row[inside]


def margins(data: np.ndarray, offsets: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """Mean log odds per row and bit; 0 for a row without n-grams."""
    n = len(offsets) - 1
    total, count = np.zeros((n, len(odds))), np.zeros(n)
    for bucket, row in _pieces(data, offsets):
        if not len(row):
            continue
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        seen = row[first]
        count[seen] += np.diff(np.r_[first, len(row)])
        for bit in range(len(odds)):
            total[seen, bit] += np.add.reduceat(odds[bit][bucket], first)
    return total / np.maximum(count, 1)[:, None]


def _lower(column: pa.Array) -> pa.Array:
    return pa.compute.utf8_lower(column.fill_null(""))


def _sample(labelled: DataFrame, per_language: int) -> DataFrame:
    """About ``per_language`` rows of every language, picked by a hash of the id."""
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return labelled
    rates = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items())
                           for x in (lang, min(1.0, per_language / n))])
    unit = F.pmod(F.xxhash64(F.lit(17), F.col("doc_id")), F.lit(1 << 40)) / float(1 << 40)
    return labelled.where(unit < F.element_at(rates, F.col("lang")))


def fit(labelled: DataFrame, per_language: int = 2000) -> Model:
    """Learn from ``doc_id, text, lang``; runs jobs when called.

    The classifiers are fitted on a sample bounded by ``per_language`` expected rows of each
    language. Whole texts are counted on the executors; the driver receives at most one
    histogram of ``BUCKETS`` per language, and one margin row per sampled text.
    """
    rows = _sample(labelled.select("doc_id", "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL"), per_language)

    def histogram(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text", PIECE):
            data, offsets = flat_bytes(_lower(batch.column("text")))
            names = np.array(batch.column("lang").to_pylist(), dtype=object)
            for bucket, row in _pieces(data, offsets):
                for lang in set(names):
                    part = bucket[(names == lang)[row]]
                    sums[lang] = sums.get(lang, 0) + np.bincount(part, minlength=BUCKETS)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()),
                                              "bucket": pa.array(at, pa.int32()), "n": pa.array(n[at], pa.int64())})

    found = (rows.mapInArrow(histogram, "lang string, bucket int, n long")
             .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())
    languages = sorted(found["lang"].unique())
    if not languages:
        none = np.zeros((0, 0))
        return Model([], none, none, np.zeros(0), np.zeros(0), none)
    counts = np.full((len(languages), BUCKETS), 0.0)
    counts[found["lang"].map({x: i for i, x in enumerate(languages)}), found["bucket"]] = found["n"]
    share = counts / counts.sum(1, keepdims=True)  # a language counts alike, however much of it there is
    codes = codewords(len(languages))
    odds = np.array([_log_odds(share, code) for code in codes.T], dtype=np.float32)

    def margin(batches):
        for batch in slices(batches, "text", PIECE):
            data, offsets = flat_bytes(_lower(batch.column("text")))
            out = margins(data, offsets, odds)
            yield pa.RecordBatch.from_pydict({"lang": batch.column("lang"),
                                              "m": pa.array(list(out), pa.list_(pa.float64()))})

    sample = rows.mapInArrow(margin, "lang string, m array<double>").toPandas().sort_values("lang")
    x = np.stack(sample["m"])
    truth = codes[sample["lang"].map({name: i for i, name in enumerate(languages)})]
    fitted = [_logistic(x[:, b], truth[:, b]) for b in range(codes.shape[1])]
    scale, shift = np.array([f[0] for f in fitted]), np.array([f[1] for f in fitted])
    right = pd.DataFrame((x * scale + shift) * truth > 0).groupby(sample["lang"].to_numpy()).mean()
    trust = right.reindex(languages).to_numpy() + 1e-3
    return Model(languages, codes, odds, scale, shift, trust / trust.sum(1, keepdims=True))


def _log_odds(share: np.ndarray, code: np.ndarray) -> np.ndarray:
    sides = [share[code == side].mean(0) if (code == side).any() else np.zeros(BUCKETS) for side in (1, -1)]
    return np.log(sides[0] + 1e-6) - np.log(sides[1] + 1e-6)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit by Newton steps with a small ridge; classes weigh alike."""
    if len(set(y)) < 2:
        return 1.0, 0.0
    weight = np.where(y > 0, 0.5 / (y > 0).mean(), 0.5 / (y < 0).mean())
    z = np.c_[x, np.ones_like(x)]
    beta, ridge = np.zeros(2), 1e-3 * len(x) * np.array([np.var(x) + 1e-9, 1e-3])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (weight * (p * (1 - p) + 1e-9))[:, None]).T @ z + np.diag(ridge),
                               z.T @ (weight * ((y > 0) - p)) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-8 * (1 + np.abs(beta).max()):
            break
    return float(beta[0]), float(beta[1])


def decode(model: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best codeword, its score, and the relative gap to the next, for rows of raw margins."""
    f = np.clip(x * model.scale + model.shift, -30, 30)
    loss = np.stack([(np.logaddexp(0, -f * code) * trust).sum(1) for code, trust in zip(model.codes, model.trust)], 1)
    best = loss.argmin(1)
    odds = np.exp(-(loss - loss.min(1, keepdims=True)) * model.codes.shape[1] / 2)
    two = np.sort(loss, axis=1)[:, :2]
    gap = (two[:, 1] - two[:, 0]) / np.maximum(two[:, 1], 1e-12) if loss.shape[1] > 1 else np.ones(len(x))
    return best, 1 / odds.sum(1), gap


def predict(docs: DataFrame, model: Model, min_gap: float = 0.05) -> DataFrame:
    """``doc_id, lang_pred, score, ambiguous``; only ``text`` is used.

    ``ambiguous`` marks texts whose two nearest codewords differ by less than ``min_gap`` in
    relative loss. The model is bounded by bits x ``BUCKETS`` and travels with the tasks.
    """
    rows = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in slices(batches, "text", PIECE):
            n = batch.num_rows
            letters = np.asarray(batch.column("letters"), dtype=bool) & bool(m.languages)
            names, score, unsure = np.full(n, "und", dtype=object), np.zeros(n), ~letters
            if m.languages:
                data, offsets = flat_bytes(_lower(batch.column("text")))
                best, p, gap = decode(m, margins(data, offsets, m.odds))
                names[letters] = np.array(m.languages, dtype=object)[best[letters]]
                score[letters], unsure = p[letters], unsure | (gap < min_gap)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score), pa.array(unsure)],
                names=["doc_id", "lang_pred", "score", "ambiguous"])

    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")
