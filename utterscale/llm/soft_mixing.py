"""Mixing documents to target domain weights with soft membership, in DataFrame functions only.

A naive Bayes classifier learned from a labelled table gives every document a posterior per
domain. Least squares by projected Newton steps then fits nonnegative document rates r so that
the expected domain token totals sum(r * tokens * posterior) match the targets.

Defined cases: a null text has no words, its posterior is the prior and its tokens are 0;
documents with the same id and text are one row with ``n_rows`` of them, each counting; a
domain without a weight has weight 0; without labels, or with no tokens at all, every rate
is 1 and nothing is missed; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utterscale.llm.common import written

BUCKETS = 4096
RIDGE = 1e-9


def _words(text: Column) -> Column:
    """The lower-cased pieces between single separators; some are empty and no words."""
    plain = F.lower(F.coalesce(text, F.lit("")))
    for other in "\t\n\x0B\f\r":
        plain = F.replace(plain, F.lit(other), F.lit(" "))
    return F.split(plain, " ")


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def learn(docs: DataFrame, labels: DataFrame, per_domain: int = 4000) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Domains, log priors, and log likelihoods (domain x bucket) of ``labels``' ``doc_id, domain``.

    Fitted on about ``per_domain`` labelled documents of each domain, picked by a hash of the
    id. The driver receives at most ``BUCKETS`` counts per domain.
    """
    known = labels.where("domain IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "domain").distinct()
    sizes = {r["domain"]: r["n"] for r in known.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    domains = sorted(sizes)
    counts = np.zeros((len(domains), BUCKETS))
    if domains:
        rates = F.create_map(*[F.lit(x) for d in domains for x in (d, min(1.0, per_domain / sizes[d]))])
        unit = F.pmod(F.xxhash64(F.lit(23), F.col("doc_id")), F.lit(1 << 40)) / float(1 << 40)
        sample = known.where(unit < F.element_at(rates, F.col("domain")))
        # the sample's size is bounded by per_domain, so it goes to the texts
        words = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("domain", F.explode(_words(F.col("text"))).alias("w")).where("w <> ''")
        for r in words.groupBy("domain", _bucket(F.col("w")).alias("b")).agg(F.count("*").alias("n")).collect():
            counts[domains.index(r["domain"]), r["b"]] = r["n"]
    prior = np.log(np.array([sizes[d] for d in domains], float)) if domains else np.zeros(0)
    return domains, prior, np.log(counts + 1) - np.log((counts + 1).sum(1, keepdims=True))


def posteriors(docs: DataFrame, domains: Sequence[str], prior: np.ndarray, likelihood: np.ndarray) -> DataFrame:
    """``doc_id, text_hash, n_rows, tokens, posterior`` (array in the order of ``domains``).

    Words are exploded and summed inside the task before the shuffle, which carries one row
    per document. The likelihoods, relative to the first domain, are one constant array of
    ``BUCKETS`` numbers per further domain. The log likelihood counts with the root of the
    length, so that long texts do not saturate.
    """
    names = [f"l{k}" for k in range(1, len(domains))]
    constant = [_constant(row - likelihood[0]) for row in likelihood[1:]]
    # the hash is taken below the explode, once per text
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), _words(F.col("text")).alias("words"))
    words = texts.select("doc_id", "text_hash", F.posexplode("words").alias("pos", "w"))
    is_word = F.col("w") != ""
    bucket = F.when(is_word, _bucket(F.col("w")))
    scored = words.select("doc_id", "text_hash", (F.col("pos") == 0).cast("long").alias("first"), bucket.alias("b"))
    sums = scored.groupBy("doc_id", "text_hash").agg(
        F.sum("first").alias("n_rows"), F.count("b").alias("tokens"),
        *[F.coalesce(F.sum(F.get(c, F.col("b"))), F.lit(0.0)).alias(n) for n, c in zip(names, constant)])
    tokens = (F.col("tokens") / F.col("n_rows")).cast("long")
    relative = [F.lit(0.0), *map(F.col, names)][:len(domains)]
    scores = F.array(*[F.lit(float(prior[k])) + x / F.col("n_rows") / F.sqrt(F.greatest(tokens, F.lit(1)))
                       for k, x in enumerate(relative)]).cast("array<double>")
    rows = sums.select("doc_id", "text_hash", "n_rows", tokens.alias("tokens"), scores.alias("s"))
    rows = rows.withColumn("e", F.transform("s", lambda x: F.exp(x - F.array_max("s"))))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    return rows.withColumn("z", total).select("doc_id", "text_hash", "n_rows", "tokens",
                                              F.transform("e", lambda x: x / F.col("z")).alias("posterior"))


def _constant(values: Sequence[float]) -> Column:
    """An array column of fixed numbers that the optimizer folds to one value."""
    return F.split(F.lit(",".join(map(repr, map(float, values)))), ",").cast("array<double>")


def _rate(factors: Sequence[float]) -> Column:
    """The posterior weighed by the domains' factors, cut off at zero. The expression keeps its
    shape, so that its compiled code serves every step."""
    parts = F.zip_with("posterior", _constant(factors), lambda p, x: p * x)
    return F.greatest(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x), F.lit(0.0))


def fit_rates(members: DataFrame, weights: Sequence[float], whole: Sequence[int], tolerance: float = 1e-6) -> DataFrame:
    """Adds ``rate`` and ``missed`` to rows of ``n_rows, tokens, posterior``.

    The targets are ``weights`` times the smallest total for which no domain listed in
    ``whole`` has to shrink. Of all nonnegative rates that meet the targets of the domains with
    a weight, those of the smallest tokens-weighted sum of squares are found: they are the
    posterior times one factor per domain, cut off at zero. A domain of weight 0 has the
    factor 0: nothing of it is asked for, but what the other domains' documents hold of it
    comes along. ``missed`` has, per domain, the expected tokens minus the target, the same
    in all rows.

    Newton steps over the documents with a positive rate (an active set) go on until the
    targets are met within ``tolerance`` of their sum, or until no step comes closer, where
    nonnegative rates can't meet them: the result is then the least-squares one. A step is one
    aggregate of the Gram matrix of these documents, which gives the totals as well.
    """
    k = len(weights)
    nothing = F.array_repeat(F.lit(0.0), k)
    if not k:
        return members.withColumn("rate", F.lit(1.0)).withColumn("missed", nothing)
    p = [F.col("posterior")[i] for i in range(k)]
    mass = F.col("tokens") * F.col("n_rows")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def gram(rows: DataFrame) -> np.ndarray:
        found, out = rows.agg(*[F.sum(mass * p[i] * p[j]) for i, j in pairs]).first(), np.zeros((k, k))
        for (i, j), x in zip(pairs, found):
            out[i, j] = out[j, i] = x or 0.0
        return out

    full = gram(members)
    now = full.sum(1)  # posteriors add up to 1
    if not now.sum():
        return members.withColumn("rate", F.lit(1.0)).withColumn("missed", nothing)
    share = np.array(weights, float) / max(sum(weights), 1e-300)
    target = share * max([now[i] / share[i] for i in whole if share[i] > 0], default=now.sum())
    asked = np.flatnonzero(share > 0)
    at = np.ix_(asked, asked)
    base = RIDGE * full[at]  # keeps the factors finite where the targets are out of reach

    def placed(x: np.ndarray) -> np.ndarray:
        out = np.zeros(k)
        out[asked] = x
        return out

    def value(g: np.ndarray, x: np.ndarray) -> float:
        return x @ (g[at] + base) @ x / 2 - target[asked] @ x

    def held(x: np.ndarray) -> np.ndarray:
        return gram(members.withColumn("rate", _rate(placed(x))).where("rate > 0"))

    factors = np.linalg.pinv(full[at], rcond=1e-9, hermitian=True) @ target[asked]
    active = held(factors)
    while np.abs((active @ placed(factors) - target)[asked]).max(initial=0) > tolerance * target.sum():
        slope = (active[at] + base) @ factors - target[asked]
        step = -np.linalg.pinv(active[at] + base, rcond=1e-15, hermitian=True) @ slope
        size, before = 1.0, value(active, factors)
        if -(slope @ step) <= 1e-12 * abs(before):
            break
        moved = held(factors + step)
        while size > 1e-12 and value(moved, factors + size * step) > before + 1e-4 * size * (slope @ step):
            size /= 8
            moved = held(factors + size * step)
        if not value(moved, factors + size * step) < before:
            break
        factors, active = factors + size * step, moved
    missed = active @ placed(factors) - target
    return members.withColumn("rate", _rate(placed(factors))).withColumn("missed", _constant(missed))


def mixed(docs: DataFrame, labels: DataFrame, weights: Mapping[str, float], whole: Sequence[str],
          per_domain: int = 4000) -> tuple[list[str], DataFrame]:
    """The domains, and ``doc_id, text_hash, n_rows, tokens, posterior, rate, missed, copies``.

    ``copies`` rounds the rate up or down by a hash of the document, so that it is right in
    expectation; a document with a rate of a half or more is never lost. Runs jobs when
    called; the posteriors are kept as a narrow table in the shared folder.
    """
    domains, prior, likelihood = learn(docs, labels, per_domain)
    members = written(posteriors(docs, domains, prior, likelihood), "members")
    rows = fit_rates(members, [weights.get(d, 0.0) for d in domains], [domains.index(d) for d in whole if d in domains])
    unit = F.pmod(F.xxhash64(F.lit(29), F.col("doc_id"), F.col("text_hash")), F.lit(1 << 40)) / float(1 << 40)
    copies = F.greatest(F.floor(F.col("rate") + unit), (F.col("rate") >= 0.5).cast("long"))
    return domains, rows.withColumn("copies", copies.cast("long"))
