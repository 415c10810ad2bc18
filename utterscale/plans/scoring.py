"""Queries: pairing, scores, alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from utterscale.functions import annotation, text
from utterscale.operators import align, ngrams, pairing, scores
from utterscale.plans import fixtures, sql, texts
from utterscale.plans.registry import query
from utterscale.sources.scan import table

BASE = (sql.UTTERANCES, sql.PAIRS)


def _sum(*columns: str) -> str:
    return ", ".join(f"sum({c})::BIGINT AS {c}" for c in columns)


@query(sql.with_(*BASE, sql.BENCHMARK_UTTERANCES, sql.HYPS_REFS)
       + "SELECT utt_id, system, lang, hyp, ref FROM hyps JOIN refs USING (utt_id)")
def pair_hyp_ref(spark: SparkSession, folder: str) -> DataFrame:
    return pairing.pair(fixtures.hyps(spark, folder), fixtures.refs(spark, folder)).select(
        "utt_id", "system", "lang", "hyp", "ref")


@query(sql.with_(*BASE, sql.BENCHMARK_UTTERANCES, sql.HYPS_REFS) + """
SELECT system, count(r.utt_id) AS paired, count(*) - count(r.utt_id) AS hyps_without_ref,
       (SELECT count(*) FROM refs) - count(r.utt_id) AS refs_without_hyp
FROM hyps LEFT JOIN refs r USING (utt_id) GROUP BY system""")
def pair_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return pairing.coverage(fixtures.hyps(spark, folder), fixtures.refs(spark, folder))


@query(sql.with_(*BASE) + f"""
SELECT system, utt_id, {sql.normalize('ref')} AS ref, {sql.normalize('hyp')} AS hyp FROM pairs
WHERE {sql.normalize('ref')} <> ''""")
def drop_empty_refs(spark: SparkSession, folder: str) -> DataFrame:
    return pairing.prepare(fixtures.pairs(spark, folder), text.normalize, drop_empty_refs=True).select(
        "system", "utt_id", "ref", "hyp")


@query(sql.with_(*BASE, f"""
c AS (SELECT system, utt_id, n, g, sum(h)::BIGINT AS hc, sum(1 - h)::BIGINT AS rc FROM (
        SELECT system, utt_id, n, h, unnest(list_transform(range(1, len(t) - n + 2),
               lambda i: array_to_string(t[i : i + n - 1], ' '))) AS g
        FROM (SELECT system, utt_id, 1 AS h, string_split({sql.normalize('hyp')}, ' ') AS t FROM pairs
              UNION ALL SELECT system, utt_id, 0, string_split({sql.normalize('ref')}, ' ') FROM pairs),
             (SELECT unnest(range(1, 5)) AS n)) GROUP BY system, utt_id, n, g)""") + """
SELECT system, n, sum(least(hc, rc))::BIGINT AS clipped, sum(hc)::BIGINT AS hyp_ngrams, sum(rc)::BIGINT AS ref_ngrams
FROM c GROUP BY system, n""")
def ngram_clip_counts(spark: SparkSession, folder: str) -> DataFrame:
    split = fixtures.pairs(spark, folder).select(
        "system", "utt_id", text.words(text.normalize(F.col("hyp"))).alias("hyp_tokens"),
        text.words(text.normalize(F.col("ref"))).alias("ref_tokens"))
    return ngrams.clip_by_grouping(split, ["system", "utt_id"], ["system"])


@query(sql.with_(*BASE, sql.word_errors()) + f"""
SELECT system, count(*) AS n_pairs, {_sum('edits', 'ref_words')},
       round(sum(edits) / sum(ref_words), 6) AS wer FROM we GROUP BY system""")
def wer_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Word error rate of raw transcripts per system."""
    return scores.wer(fixtures.pairs(spark, folder), ["system"]).withColumn("wer", F.round("wer", 6))


@query(sql.with_(*BASE, f"pn AS (SELECT system, lang, {sql.normalize('ref')} AS ref, {sql.normalize('hyp')} AS hyp FROM pairs)",
                 sql.word_errors("pn")) + f"""
SELECT system, lang, count(*) AS n_pairs, {_sum('edits', 'ref_words')},
       round(sum(edits) / sum(ref_words), 6) AS wer FROM we GROUP BY system, lang""")
def wer_by_lang(spark: SparkSession, folder: str) -> DataFrame:
    """Word error rate of normalised transcripts per system and language."""
    return scores.wer(fixtures.pairs(spark, folder), ["system", "lang"], text.normalize).withColumn(
        "wer", F.round("wer", 6))


@query(sql.with_(*BASE, sql.listed("cc", "system, lang", sql.chars(sql.metric_text("ref")),
                                   sql.chars(sql.metric_text("hyp")), "pairs", "ref <> ''"),
                 f"ce AS (SELECT system, lang, {sql.distance('r', 'h')} AS edits, len(r)::BIGINT AS ref_chars FROM cc)")
       + f"""
SELECT system, lang, count(*) AS n_pairs, {_sum('edits', 'ref_chars')},
       round(sum(edits) / sum(ref_chars), 6) AS cer FROM ce GROUP BY system, lang""")
def cer_corpus(spark: SparkSession, folder: str) -> DataFrame:
    return scores.cer(fixtures.pairs(spark, folder), ["system", "lang"]).withColumn("cer", F.round("cer", 6))


@query()
def ter_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Translation edit rate; its greedy shift search has no SQL form."""
    return scores.ter(fixtures.pairs(spark, folder), ["system", "lang"]).withColumn("ter", F.round("ter", 6))


@query(sql.with_(*BASE, "src AS (SELECT utt_id * 2 + (system = 'B')::BIGINT AS k, system, lang, hyp, ref FROM pairs)",
                 sql.ngram_sums("src", "system, lang", "hyp", ["ref"]), sql.bleu_totals("system, lang"))
       + f"SELECT * EXCLUDE (bleu), round(bleu, 6) AS bleu FROM (SELECT *, {sql.bleu_value()} AS bleu FROM tot)")
def bleu_corpus(spark: SparkSession, folder: str) -> DataFrame:
    return scores.bleu(fixtures.pairs(spark, folder), ["system", "lang"]).withColumn("bleu", F.round("bleu", 6))


TWO_REFS = (*BASE, "keyed AS (SELECT utt_id * 2 + (system = 'B')::BIGINT AS k, system, lang, doc_id, hyp, ref FROM pairs)",
            sql.number_words("keyed", "k", "ref"),
            f"""src AS (SELECT k, system, lang, doc_id, {sql.normalize('hyp')} AS hyp, {sql.normalize('ref')} AS ref,
                        {sql.normalize('spelled')} AS ref2 FROM keyed JOIN nw ON nw.k0 = k)""")


@query(sql.with_(*TWO_REFS, sql.ngram_sums("src", "system, lang", "hyp", ["ref", "ref2"]),
                 sql.bleu_totals("system, lang"))
       + f"SELECT * EXCLUDE (bleu), round(bleu, 6) AS bleu FROM (SELECT *, {sql.bleu_value()} AS bleu FROM tot)")
def bleu_two_refs(spark: SparkSession, folder: str) -> DataFrame:
    """Normalised BLEU against the reference and its written-out numbers."""
    return scores.bleu_two_refs(fixtures.pairs(spark, folder), ["system", "lang"]).withColumn(
        "bleu", F.round("bleu", 6))


@query(sql.with_(*BASE, "src AS (SELECT utt_id * 2 + (system = 'B')::BIGINT AS k, system, utt_id, hyp, ref FROM pairs)",
                 sql.ngram_sums("src", "system, utt_id", "hyp", ["ref"], char=True))
       + f"SELECT system, utt_id, round({sql.bleu_value(0.1)}, 6) AS bleu FROM wide")
def bleu_sentence_char(spark: SparkSession, folder: str) -> DataFrame:
    """Smoothed BLEU per pair over characters."""
    return scores.sentence_bleu_char(fixtures.pairs(spark, folder)).select(
        "system", "utt_id", F.round("bleu", 6).alias("bleu"))


def _chrf_terms() -> str:
    def term(n: int) -> str:
        p, r = f"(m{n} / (hyp_len - {n - 1}))", f"(m{n} / (ref_len - {n - 1}))"
        return f"CASE WHEN m{n} > 0 THEN 10 * {p} * {r} / (9 * {p} + {r}) ELSE 1e-16 END"

    return "(" + " + ".join(term(n) for n in range(1, 7)) + ") / 6"


@query(sql.with_(*BASE, r"""src AS (SELECT utt_id * 2 + (system = 'B')::BIGINT AS k, system, lang,
                 regexp_replace(hyp, '\s+', '', 'g') AS hyp, regexp_replace(ref, '\s+', '', 'g') AS ref FROM pairs)""",
                 sql.ngram_sums("src", "system, lang", "hyp", ["ref"], order=6, char=True))
       + f"SELECT system, lang, count(*) AS n_pairs, round(avg({_chrf_terms()}), 6) AS chrf FROM wide GROUP BY system, lang")
def chrf_corpus(spark: SparkSession, folder: str) -> DataFrame:
    return scores.chrf(fixtures.pairs(spark, folder), ["system", "lang"]).withColumn("chrf", F.round("chrf", 6))


REPORT = (*TWO_REFS, sql.ngram_sums("src", "system, lang, doc_id", "hyp", ["ref", "ref2"]),
          sql.word_errors("pairs", "system, lang, doc_id, source"))


def _report(by: str, having: str = "") -> str:
    return f"""
tot AS (SELECT {by}, count(*) AS n_pairs, {', '.join(f'sum({k}{n})::BIGINT AS {k}{n}' for k in 'mp' for n in range(1, 5))},
        sum(hyp_len)::BIGINT AS hyp_len, sum(ref_len)::BIGINT AS ref_len FROM wide GROUP BY {by}),
err AS (SELECT {by}, sum(edits)::BIGINT AS edits, sum(ref_words)::BIGINT AS ref_words FROM we GROUP BY {by})"""


@query(sql.with_(*REPORT, _report("system")) + f"""
SELECT system, n_pairs, edits, ref_words, round(edits / ref_words, 6) AS wer, round({sql.bleu_value()}, 6) AS bleu
FROM tot JOIN err USING (system)""")
def eval_report(spark: SparkSession, folder: str) -> DataFrame:
    """Raw word error rate and normalised BLEU per system, in one pass."""
    return scores.eval_report(fixtures.pairs(spark, folder)).withColumns(
        {"wer": F.round("wer", 6), "bleu": F.round("bleu", 6)})


@query(sql.with_(*BASE, sql.word_errors()) + f"""
SELECT system, coalesce(lang, 'all') AS lang, count(*) AS n_pairs, {_sum('edits', 'ref_words')},
       round(sum(edits) / sum(ref_words), 6) AS wer
FROM we GROUP BY GROUPING SETS ((system, lang), (system))""")
def eval_by_system(spark: SparkSession, folder: str) -> DataFrame:
    """Systems compared per language and in total."""
    errors = scores.word_errors(fixtures.pairs(spark, folder))
    rolled = (errors.groupBy("system", "lang").agg(F.count("ref_words").alias("n_pairs"), F.sum("edits").alias("edits"),
                                                   F.sum("ref_words").alias("ref_words"))
              .rollup("system", "lang").agg(*[F.sum(c).alias(c) for c in ("n_pairs", "edits", "ref_words")]))
    return rolled.where(F.col("system").isNotNull()).select(
        "system", F.coalesce("lang", F.lit("all")).alias("lang"), "n_pairs", "edits", "ref_words",
        F.round(F.col("edits") / F.col("ref_words"), 6).alias("wer"))


@query(sql.with_(*BASE, sql.BENCHMARK_UTTERANCES, sql.HYPS_REFS,
                 """pp AS (SELECT system, utt_id, source, hyps.hyp, refs.ref FROM hyps JOIN refs USING (utt_id)
                          JOIN utt USING (utt_id))""",
                 "src AS (SELECT utt_id * 2 + (system = 'B')::BIGINT AS k, * FROM pp)", sql.word_errors("src", "system, source"),
                 sql.ngram_sums("src", "system, source", "hyp", ["ref"]), sql.bleu_totals("system, source"),
                 "err AS (SELECT system, source, sum(edits) / sum(ref_words) AS wer FROM we GROUP BY system, source)",
                 """want AS (SELECT s.system, d.source FROM (SELECT DISTINCT system FROM hyps) s,
                            (SELECT DISTINCT source FROM documents) d)""") + f"""
SELECT system, source, round(coalesce(wer, 'inf'::DOUBLE), 6) AS wer,
       round(coalesce({sql.bleu_value()}, 0.0), 6) AS bleu
FROM want LEFT JOIN tot USING (system, source) LEFT JOIN err USING (system, source)""")
def metrics_guarded(spark: SparkSession, folder: str) -> DataFrame:
    """Every system and source gets a row; one without pairs gets the guard values."""
    docs = table(spark, folder, "documents", "source").distinct()
    wanted = docs.select(F.explode(F.array(F.lit("A"), F.lit("B"))).alias("system"), "source")
    done = fixtures.pairs(spark, folder).where((F.col("system") == "A") | (F.col("source") != "src3"))
    by = ["system", "source"]
    return scores.eval_report(done, by, wanted, normalized=False).select(
        *by, F.round("wer", 6).alias("wer"), F.round("bleu", 6).alias("bleu"))


def report_of(pairs: str, by: str) -> str:
    """CTEs up to ``rep(by, n_pairs, wer, bleu)`` over a CTE ``pairs`` with ``k, by, hyp, ref``."""
    keyed = f"keyed AS (SELECT * FROM {pairs})"
    src = f"""src AS (SELECT k, {by}, {sql.normalize('hyp')} AS hyp, {sql.normalize('ref')} AS ref, {sql.normalize('spelled')} AS ref2
                FROM keyed JOIN nw ON nw.k0 = k)"""
    rep = f"rep AS (SELECT {by}, n_pairs, coalesce(edits / ref_words, 'inf'::DOUBLE) AS wer, {sql.bleu_value()} AS bleu FROM tot LEFT JOIN err USING ({by}))"
    return ",\n".join([keyed, sql.number_words("keyed", "k", "ref"), src, sql.ngram_sums("src", by, "hyp", ["ref", "ref2"]),
                       sql.word_errors("keyed", by), _report(by), rep])


LOGITS = f"""
lg AS (SELECT label AS run, vec_id AS k,
         CASE WHEN label = 3 THEN NULL ELSE list_transform(range(0, 8), lambda f: list_position(embedding[f * 8 + 1 : f * 8 + 8],
           list_max(embedding[f * 8 + 1 : f * 8 + 8])) - 1) END AS best,
         CASE WHEN label = 4 THEN [] ELSE list_transform(embedding[9:16], lambda x: ((floor(x * 16)::INT % 8) + 8) % 8) END AS spoken
       FROM embeddings),
dec AS (SELECT run, k, {{hyp}} AS hyp, {{ref}} AS ref FROM lg)
""".format(**{side: texts.cleaned(f"""trim(replace(coalesce(array_to_string(list_transform(list_filter({ids}, lambda x: x <> 0),
    lambda x: ['a', 'b', '|', '1', '0', '.', '|'][x]), ''), ''), '|', ' '))""") for side, ids in [
        ("hyp", "list_filter(best, lambda x, i: i = 1 OR x <> best[i - 1])"), ("ref", "spoken")]})


@query(sql.with_(LOGITS, report_of("dec", "run")) + """
SELECT run, coalesce(n_pairs, 0) AS n_pairs, round(coalesce(wer, 'inf'::DOUBLE), 6) AS wer, round(coalesce(bleu, 0.0), 6) AS bleu
FROM (SELECT unnest(range(0, 12))::INT AS run) LEFT JOIN rep USING (run)""")
def eval_from_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluations from frame scores and padded labels; two of the runs asked for have no rows."""
    tokens = F.array(*[F.lit(t) for t in fixtures.LOGIT_TOKENS])
    pairs = scores.decoded_pairs(fixtures.logits(spark, folder), ["run"], tokens, 0)
    wanted = spark.range(12).select(F.col("id").cast("int").alias("run"))
    return scores.eval_report(pairs, ["run"], wanted).select(
        "run", "n_pairs", F.round("wer", 6).alias("wer"), F.round("bleu", 6).alias("bleu"))




@query(sql.with_(*TWO_REFS, sql.ngram_sums("src", "system, doc_id", "hyp", ["ref", "ref2"]),
                 """parts AS (SELECT system, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'public' ELSE 'private' END
                             AS part, * EXCLUDE (system) FROM wide)""",
                 sql.bleu_totals("system, part").replace("FROM wide", "FROM parts"))
       + f"SELECT system, part, n_pairs, round({sql.bleu_value()}, 6) AS score FROM tot")
def score_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Two-reference BLEU of the labelled (public) and the other (private) documents."""
    public = table(spark, folder, "labels", "doc_id").distinct().withColumn("part", F.lit("public"))
    parts = fixtures.pairs(spark, folder).join(public, "doc_id", "left").withColumn(
        "part", F.coalesce("part", F.lit("private")))
    return scores.bleu_two_refs(parts, ["system", "part"]).select(
        "system", "part", "n_pairs", F.round("bleu", 6).alias("score"))


@query(sql.with_(*BASE, f"""pm AS (SELECT system, lang,
         {sql.normalize("replace(replace(lower(ref), 'ps5', 'ps five'), '3d', 'three d')")} AS ref,
         {sql.normalize("replace(replace(lower(hyp), 'ps5', 'ps five'), '3d', 'three d')")} AS hyp FROM pairs)""",
                 sql.word_errors("pm")) + f"""
SELECT system, lang, count(*) AS n_pairs, {_sum('edits', 'ref_words')} FROM we GROUP BY system, lang""")
def score_with_preprocessor(spark: SparkSession, folder: str) -> DataFrame:
    """Word errors with a caller's own preprocessor, a function of columns, on both sides."""
    def own(c: Column) -> Column:
        return text.normalize(F.replace(F.replace(F.lower(c), F.lit("ps5"), F.lit("ps five")), F.lit("3d"), F.lit("three d")))

    return scores.wer(fixtures.pairs(spark, folder), ["system", "lang"], own).drop("wer")


def _token_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return fixtures.pairs(spark, folder).select(
        "system", "utt_id", "lang", text.words(F.col("hyp")).alias("hyp_tokens"),
        text.words(F.col("ref")).alias("ref_tokens"))


@query()
def align_words(spark: SparkSession, folder: str) -> DataFrame:
    """One row per alignment step; ties make the path itself no SQL matter."""
    return align.align_words(_token_pairs(spark, folder), ["system", "utt_id"])


@query(sql.with_(*BASE, sql.listed("al", "system, utt_id", "string_split(ref, ' ')", "string_split(hyp, ' ')", "pairs"))
       + f"""SELECT system, utt_id, {sql.distance('r', 'h')} AS edits, len(r)::BIGINT AS ref_words,
                    len(h)::BIGINT AS hyp_words FROM al""")
def align_edit_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Alignment rows counted back: steps that cost an edit, reference and hypothesis words."""
    steps = align.align_words(_token_pairs(spark, folder), ["system", "utt_id"])
    return steps.groupBy("system", "utt_id").agg(
        F.sum((F.col("op") != "match").cast("bigint")).alias("edits"),
        F.count("ref_pos").alias("ref_words"), F.count("hyp_pos").alias("hyp_words"))


@query()
def edit_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    return align.edit_breakdown(_token_pairs(spark, folder), ["system", "lang"])


@query(sql.with_(*BASE, sql.listed("al", "system, lang", "string_split(ref, ' ')", "string_split(hyp, ' ')", "pairs")) + f"""
SELECT system, lang, sum({sql.distance('r', 'h')})::BIGINT AS edits, sum(len(r))::BIGINT AS ref_words,
       sum(len(h))::BIGINT AS hyp_words FROM al GROUP BY system, lang""")
def edit_breakdown_totals(spark: SparkSession, folder: str) -> DataFrame:
    """The breakdown summed back to what SQL can state."""
    parts = align.edit_breakdown(_token_pairs(spark, folder), ["system", "lang"])
    hit, sub, dele, ins = (F.col(c) for c in ("hits", "substitutions", "deletions", "insertions"))
    return parts.select("system", "lang", (sub + dele + ins).alias("edits"), (hit + sub + dele).alias("ref_words"),
                        (hit + sub + ins).alias("hyp_words"))


@query()
def annotated_wer(spark: SparkSession, folder: str) -> DataFrame:
    """Annotated words that a noisy transcript of the turn does not repeat, per tag and role."""
    parsed = fixtures.annotated(spark, folder).withColumn("p", annotation.parse_annotations(F.col("annotated")))
    kept = parsed.select("role", F.filter("p", lambda x: x["word"].isNotNull()).alias("p"))
    sides = kept.select("role", F.transform("p", lambda x: x["word"]).alias("ref_tokens"),
                        F.transform("p", lambda x: x["tag"]).alias("ref_tags"))
    noisy = sides.withColumn("hyp_tokens", fixtures.misheard(F.col("ref_tokens")))
    return align.annotated_error_rate(noisy, ["role"]).withColumn("annotated_wer", F.round("annotated_wer", 6))
