"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterscale.llm import (bit_planes, blocks, bwt_repeats, chat_format, code_words, line_frequency, line_join, piece_transducer,
                            posting_lists, range_tree, set_relations, soft_mixing, warc_chain)
from utterscale.sources.scan import table
from utterscale.sources.shared import shared_folder

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Target shares of the labelled domains; toxic documents get none.
MIX = {"q1_t0": 0.85, "q0_t0": 0.15}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


@query()
def op2_posting_lists(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings", "vec_id", "embedding")
    return posting_lists.nearest(rows, rows.where("vec_id % 20 = 0"))


LINE_FREQUENCY_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
words AS (
  SELECT doc_id, unnest(list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS w,
         generate_subscripts(list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> ''), 1) AS i
  FROM docs),
base AS (SELECT doc_id, count(*) AS n_words, sum(length(w)) AS word_chars FROM words GROUP BY doc_id),
windows AS (
  SELECT doc_id, i, w AS a, lead(w, 1) OVER p AS b, lead(w, 2) OVER p AS c, lead(w, 3) OVER p AS d, lead(w, 4) OVER p AS e
  FROM words WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
repeated AS (
  SELECT doc_id, i FROM windows WHERE e IS NOT NULL
  QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c, d, e) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM repeated, range(5) AS r(k) GROUP BY doc_id),
raw AS (
  SELECT doc_id, host, unnest(string_split(t, chr(10))) AS line,
         generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM docs),
lines AS (
  SELECT *, lower(regexp_replace(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' '), '[0-9]', '0', 'g')) AS norm,
         len(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n
  FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY doc_id),
hosts AS (SELECT host, count(DISTINCT doc_id) AS docs FROM docs GROUP BY host),
frequent AS (
  SELECT l.host, l.norm FROM (SELECT host, norm, count(DISTINCT doc_id) AS n FROM lines GROUP BY host, norm) l
  JOIN hosts h ON h.host = l.host WHERE n > 20 AND n > docs * 0.01),
gone AS (SELECT doc_id, sum(n) AS removed FROM lines SEMI JOIN frequent USING (host, norm) GROUP BY doc_id),
judged AS (
  SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(removed, 0) AS removed_words
  FROM docs d LEFT JOIN base USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN dups USING (doc_id)
  LEFT JOIN gone USING (doc_id)),
failed AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM judged)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND n_words - removed_words >= 10 AND n_words - removed_words >= n_words * 0.5 AS kept,
       CAST(removed_words AS BIGINT) AS removed_words
FROM failed"""


@query(LINE_FREQUENCY_SQL)
def op3_line_frequency(spark: SparkSession, folder: str) -> DataFrame:
    rows = line_frequency.judged(table(spark, folder, "documents", "doc_id", "text", "source"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                       "kept", "removed_words")


def _held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


@query()
def op4_code_words(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text", "lang")
    model = code_words.fit(docs.where(F.col("doc_id").isNotNull() & ~_held_out()))
    return code_words.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", _held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


@query()
def op5_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations", "conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(said).alias("text"))
    return chat_format.read_back(chat_format.formatted(rows.unionByName(extra)))


@query()
def op6_warc_chain(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages", "page_id", "url", "html")
    return warc_chain.round_trip(pages, shared_folder(spark, "warc"))


def domains(labels: DataFrame) -> DataFrame:
    """``doc_id, domain``: quality and toxicity as one of four names."""
    return labels.where("quality IS NOT NULL AND toxic IS NOT NULL").select(
        "doc_id", F.concat(F.lit("q"), F.col("quality"), F.lit("_t"), F.col("toxic")).alias("domain"))


@query()
def op7_soft_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    labels = domains(table(spark, folder, "labels", "doc_id", "quality", "toxic"))
    _, rows = soft_mixing.mixed(docs, labels, MIX, list(MIX))
    return rows.select("doc_id", "n_rows", "tokens", "posterior", "rate", "missed", "copies")


@query()
def op10_piece_transducer(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every text, and whether decoding them gives the text back."""
    docs = table(spark, folder, "documents", "doc_id", "text")
    return piece_transducer.round_trip(docs, MODEL)


@query()
def op9_set_relations(spark: SparkSession, folder: str) -> DataFrame:
    return set_relations.joined(table(spark, folder, "documents", "doc_id", "text"), 3, 90, 100)


@query()
def op8_line_join(spark: SparkSession, folder: str) -> DataFrame:
    rows = line_join.removed_lines(table(spark, folder, "documents", "doc_id", "text"))
    return rows.select("doc_id", "n_lines", F.size("removed").alias("n_removed"), "removed")


@query()
def op1_bwt_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return bwt_repeats.removed(table(spark, folder, "documents", "doc_id", "text")).drop("kept")


def _cluster_sql(k: int = 8, rounds: int = 10) -> str:
    """Every round as a pair of common table expressions over (row, component, value)."""
    parts = [r"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024.0 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             "x AS MATERIALIZED (SELECT r, unnest(e) AS x, generate_subscripts(e, 1) AS j FROM v)",
             f"""c0 AS MATERIALIZED (
  SELECT k, unnest(e) AS x, generate_subscripts(e, 1) AS j FROM (
    SELECT row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR)) NULLS LAST, e) - 1 AS k, e FROM v) WHERE k < {k})"""]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
  SELECT r, arg_min(k, (d, k)) AS k, min(d) AS d FROM (
    SELECT r, k, CAST(sum((x.x - c.x) * (x.x - c.x)) AS BIGINT) AS d FROM x JOIN c{i} c USING (j) GROUP BY r, k) GROUP BY r)""")
        if i < rounds:
            parts.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c.k, c.j, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN (
    SELECT k, j, CAST(sum(x) - ((sum(x) % count(*)) + count(*)) % count(*) AS BIGINT) // count(*) AS x
    FROM x JOIN a{i} USING (r) GROUP BY k, j) m ON m.k = c.k AND m.j = c.j)""")
    return f"""WITH {", ".join(parts)},
shas AS (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY j)) AS s FROM c{rounds} GROUP BY k)
SELECT vec_id, CAST(a.k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, s AS centroid_sha256
FROM v JOIN a{rounds} a USING (r) JOIN shas ON shas.k = a.k"""


@query(_cluster_sql())
def op12_bit_planes(spark: SparkSession, folder: str) -> DataFrame:
    return bit_planes.clustered(table(spark, folder, "embeddings", "vec_id", "embedding"))


BLOCKS_SQL = r"""
WITH words AS MATERIALIZED (
  SELECT doc_id, i, w FROM (
    SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (
      SELECT doc_id, list_filter(string_split_regex(text, '[ 	-
]+'), lambda x: x <> '') AS ws FROM documents))),
grams AS MATERIALIZED (
  SELECT doc_id, i, string_agg(w, ' ') OVER p AS g, count(*) OVER p AS n
  FROM words WINDOW p AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
later AS (
  SELECT doc_id, i FROM grams WHERE n = 20
  QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM later, range(20) AS r(k)),
kept AS (
  SELECT doc_id, count(*) AS n_kept, string_agg(w, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
sizes AS (SELECT doc_id, count(*) AS n_words FROM words GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_words, 0) - coalesce(n_kept, 0) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN kept USING (doc_id)"""


@query(BLOCKS_SQL)
def op13_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return blocks.removed(table(spark, folder, "documents", "doc_id", "text"), texts=False).drop("kept")


RANGE_TREE_SQL = r"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256.0 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
       n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
QUALIFY rank <= 5"""


@query(RANGE_TREE_SQL)
def op11_range_tree(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings", "vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return range_tree.mined(rows.withColumn("label", label), "vec_id % 100 = 0")
