"""Queries: text rules, number words, mark-up, vocabulary, decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from utterscale.functions import annotation, arrays, text
from utterscale.operators import vocabulary
from utterscale.plans import fixtures, sql
from utterscale.plans.registry import query
from utterscale.sources.scan import spread, table
from utterscale.sources.shared import shared_folder

TERMS = {"ps5": "ps five", "ps4": "ps four", "3d": "three d"}  # fixed values: configured spellings


def _documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return spread(table(spark, folder, "documents", "doc_id", *columns), "doc_id")


@query(f"SELECT doc_id, {sql.normalize('text')} AS norm FROM documents")
def normalize_text(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder, "text").select("doc_id", text.normalize(F.col("text")).alias("norm"))


@query(f"""
SELECT doc_id, len(t) AS n_words, len(list_distinct(t)) AS n_types, max_len
FROM (SELECT doc_id, t, list_max(list_transform(t, lambda w: length(w)))::BIGINT AS max_len
      FROM (SELECT doc_id, string_split({sql.normalize('text')}, ' ') AS t FROM documents))""")
def tokenize_words(spark: SparkSession, folder: str) -> DataFrame:
    """Words per document after normalising; the empty text is one empty word."""
    split = _documents(spark, folder, "text").select("doc_id", text.words(text.normalize(F.col("text"))).alias("t"))
    return split.select("doc_id", F.size("t").cast("bigint").alias("n_words"),
                        F.size(F.array_distinct("t")).cast("bigint").alias("n_types"),
                        F.array_max(F.transform("t", F.length)).cast("bigint").alias("max_len"))


@query(sql.with_(sql.UTTERANCES, "ut AS (SELECT utt_id, array_to_string(tokens, ' ') AS txt FROM utt)",
                 sql.number_words("ut", "utt_id", "txt"))
       + "SELECT k0 AS utt_id, spelled AS words FROM nw")
def numbers_to_words(spark: SparkSession, folder: str) -> DataFrame:
    """German number words in every utterance."""
    rows = fixtures.utterances(spark, folder)
    return rows.select("utt_id", text.numbers_to_words(F.array_join("tokens", " ")).alias("words"))


@query("""
SELECT event_id, array_to_string(list_transform(string_split(lower(txt), ' '),
       lambda w: CASE w WHEN 'ps5' THEN 'ps five' WHEN 'ps4' THEN 'ps four' WHEN '3d' THEN 'three d' ELSE w END), ' ') AS mapped
FROM (SELECT event_id, 'PS' || (user_id % 7) || ' ' || event_type || ' ' || (user_id % 4) || 'D ps4x' AS txt FROM events)""")
def map_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Configured terms in short device notes derived from the event log."""
    note = F.concat(F.lit("PS"), F.col("user_id") % 7, F.lit(" "), F.col("event_type"), F.lit(" "),
                    F.col("user_id") % 4, F.lit("D ps4x"))
    return table(spark, folder, "events", "event_id", "user_id", "event_type").select(
        "event_id", text.map_terms(note, TERMS).alias("mapped"))


PARSED = (sql.TURNS, sql.ANNOTATED, sql.PARSED)


@query(sql.with_(*PARSED) + "SELECT utt_id, pos, word, tag FROM par")
def parse_annotations(spark: SparkSession, folder: str) -> DataFrame:
    rows = fixtures.annotated(spark, folder).select(
        "utt_id", F.posexplode(annotation.parse_annotations(F.col("annotated"))).alias("pos", "p"))
    return rows.select("utt_id", F.col("pos").cast("bigint").alias("pos"), "p.word", "p.tag")


@query(sql.with_(*PARSED) + "SELECT utt_id, string_agg(word, ' ' ORDER BY pos) AS clean FROM par GROUP BY utt_id")
def strip_annotations(spark: SparkSession, folder: str) -> DataFrame:
    parsed = fixtures.annotated(spark, folder).select(
        "utt_id", annotation.parse_annotations(F.col("annotated")).alias("p"))
    return parsed.select("utt_id", annotation.clean_text(F.col("p")).alias("clean"))


@query(sql.with_(*PARSED) + """
SELECT coalesce(role, 'all') AS role, coalesce(tag, 'all') AS tag, count(*) AS n FROM par WHERE tag IS NOT NULL
GROUP BY GROUPING SETS ((role, tag), (role), ())""")
def annotation_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Marks per role and kind with totals."""
    tags = fixtures.annotated(spark, folder).select(
        "role", F.explode(annotation.parse_annotations(F.col("annotated"))).alias("p")).select("role", "p.tag")
    counted = tags.where(F.col("tag").isNotNull()).rollup("role", "tag").agg(F.count("*").alias("n"))
    return counted.select(F.coalesce("role", F.lit("all")).alias("role"),
                          F.coalesce("tag", F.lit("all")).alias("tag"), "n")


@query(sql.with_(*PARSED) + """
SELECT role, count(*) FILTER (tag = 'l1') AS l1, count(*) FILTER (tag = 'error') AS error,
       count(*) FILTER (tag = 'guess') AS guess, count(*) FILTER (tag = 'missing') AS missing
FROM par GROUP BY role""")
def annotation_pivot(spark: SparkSession, folder: str) -> DataFrame:
    kinds = ["l1", "error", "guess", "missing"]
    tags = fixtures.annotated(spark, folder).select(
        "role", F.explode(annotation.parse_annotations(F.col("annotated"))).alias("p")).select("role", "p.tag")
    return tags.groupBy("role").pivot("tag", kinds).agg(F.count(F.lit(1))).na.fill(0, kinds)


def _recording_id() -> Column:
    d = F.col("doc_id")
    base = F.concat((8000 + d % 500).cast("string"), F.lit("_"), (4 + d % 3).cast("string"))
    return F.when(d % 2 == 0, F.concat(base, F.lit("_B"))).otherwise(base)


RECORDINGS = """
rec AS (SELECT doc_id, lang, (8000 + doc_id % 500) || '_' || (4 + doc_id % 3)
               || CASE WHEN doc_id % 2 = 0 THEN '_B' ELSE '' END AS recording_id FROM documents)
"""


@query(sql.with_(RECORDINGS) + """
SELECT doc_id, recording_id, string_split(recording_id, '_')[1] AS postal_code,
       string_split(recording_id, '_')[2]::INT AS grade, string_split(recording_id, '_')[3] AS audio_id FROM rec""")
def recording_id_parts(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents", "doc_id").withColumn("recording_id", _recording_id())
    return rows.select("doc_id", "recording_id", text.recording_id_parts(F.col("recording_id")).alias("p")).select(
        "doc_id", "recording_id", "p.*")


@query(sql.with_(RECORDINGS) + """
SELECT doc_id, recording_id, lang FROM rec WHERE recording_id IN ('8032_6_B', '8404_5', '8400_4')""")
def filter_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Only the listed interventions (the filter is the operator)."""
    rows = table(spark, folder, "documents", "doc_id", "lang").withColumn("recording_id", _recording_id())
    return rows.where(F.col("recording_id").isin("8032_6_B", "8404_5", "8400_4")).select(
        "doc_id", "recording_id", "lang")


@query(sql.with_(sql.TURNS) + """
SELECT utt_id, i - 1 AS pos, tokens[i] AS word, round((i - 1) * 0.4::DOUBLE, 6) AS start,
       round((i - 1) * 0.4::DOUBLE + 0.3::DOUBLE, 6) AS "end",
       round((len(tokens) - 1) * 0.4::DOUBLE + 0.3::DOUBLE, 6) AS duration
FROM (SELECT utt_id, tokens, unnest(range(1, len(tokens) + 1)) AS i FROM turns)""")
def explode_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Word rows of every segment, with the segment's duration."""
    rows = fixtures.segments(spark, folder).withColumn("duration", _duration())
    return rows.select("utt_id", F.inline("words"), "duration").select(
        "utt_id", F.col("pos").cast("bigint").alias("pos"), "word", F.round("start", 6).alias("start"),
        F.round("end", 6).alias("end"), F.round("duration", 6).alias("duration"))


def _duration() -> Column:
    return F.array_max(F.transform("words", lambda w: w["end"])) - F.array_min(F.transform("words", lambda w: w["start"]))


@query(sql.with_(sql.TURNS) + """
SELECT utt_id, round(d, 6) AS duration FROM (SELECT utt_id, (len(tokens) - 1) * 0.4::DOUBLE + 0.3::DOUBLE AS d FROM turns)
WHERE d >= 0.5""")
def filter_min_length(spark: SparkSession, folder: str) -> DataFrame:
    rows = fixtures.segments(spark, folder).select("utt_id", _duration().alias("d"))
    return rows.where(F.col("d") >= 0.5).select("utt_id", F.round("d", 6).alias("duration"))


FREQ = """
cf AS (SELECT ch, count(*) AS freq, min(utt_id * 1000000 + p) AS first FROM (
         SELECT utt_id, unnest(string_split(clear_text, '')) AS ch, unnest(range(0, length(clear_text))) AS p
         FROM lab WHERE clear_text <> '' AND doc_id % 21 + 1 IN (1, 2, 3, 4, 7, 8, 9, 10, 12, 13, 14, 15, 16, 17, 18))
       GROUP BY ch)
"""
ALL_FREQ = """
cf AS (SELECT ch, count(*) AS freq, min(utt_id * 1000000 + p) AS first FROM (
         SELECT utt_id, unnest(string_split(clear_text, '')) AS ch, unnest(range(0, length(clear_text))) AS p
         FROM lab WHERE clear_text <> '') GROUP BY ch)
"""
VOCAB = """
nums AS (SELECT ch, freq, row_number() OVER (ORDER BY first) AS id FROM cf),
kept AS (SELECT CASE WHEN ch = ' ' THEN '|' ELSE ch END AS token, id, freq FROM nums
         WHERE freq > 1 AND NOT (ch = '|' AND EXISTS (SELECT 1 FROM nums WHERE ch = ' ' AND freq > 1))),
voc AS (SELECT token, id, freq FROM kept UNION ALL SELECT '[UNK]', (SELECT count(*) FROM kept), NULL)
"""
LABELS = (sql.UTTERANCES, sql.LABELS)


def _freq(spark: SparkSession, folder: str, split: str | None = None) -> DataFrame:
    return vocabulary.char_freq(fixtures.label_utterances(spark, folder, split), "clear_text", "utt_id")


@query(sql.with_(*LABELS, ALL_FREQ) + """
SELECT ch, freq, first // 1000000 AS first_row, first % 1000000 AS first_pos FROM cf""")
def char_freq(spark: SparkSession, folder: str) -> DataFrame:
    """Characters of all documents."""
    return _freq(spark, folder)


def _vocabulary(spark: SparkSession, folder: str, min_freq: int = 1, compat: bool = True, split: str | None = "train") -> DataFrame:
    return vocabulary.build(_freq(spark, folder, split), min_freq, compat)


@query(sql.with_(*LABELS, ALL_FREQ, VOCAB) + "SELECT token, id, freq FROM voc")
def char_vocab(spark: SparkSession, folder: str) -> DataFrame:
    """Vocabulary of all documents; ``tokenizer_vocab`` has the training split's."""
    return _vocabulary(spark, folder, split=None)


@query(sql.with_(*LABELS, ALL_FREQ) + """
SELECT CASE WHEN ch = ' ' THEN '|' ELSE ch END AS token, row_number() OVER (ORDER BY first) AS id, freq
FROM cf WHERE freq > 10 AND ch <> '|'
UNION ALL SELECT '[UNK]', (SELECT count(*) + 1 FROM cf WHERE freq > 10 AND ch <> '|'), NULL
UNION ALL SELECT '[PAD]', (SELECT count(*) + 2 FROM cf WHERE freq > 10 AND ch <> '|'), NULL""")
def char_vocab_dense(spark: SparkSession, folder: str) -> DataFrame:
    """Dense ids without collisions, characters seen more than ten times in all documents."""
    return _vocabulary(spark, folder, 10, compat=False, split=None)


@query(sql.with_(*LABELS, FREQ, VOCAB) + """
SELECT token, id, freq FROM voc UNION ALL SELECT '[PAD]', (SELECT count(*) + 2 FROM voc), NULL""")
def tokenizer_vocab(spark: SparkSession, folder: str) -> DataFrame:
    """The vocabulary written once, read back, and completed as a tokenizer does it."""
    path = shared_folder(spark, "vocabulary")
    for _ in range(2):  # the second call finds it there
        vocabulary.save_once(_vocabulary(spark, folder), path)
    return vocabulary.with_pad(vocabulary.load(spark, path))


ENCODED = """
vm AS (SELECT map(list(CASE WHEN token = '|' THEN ' ' ELSE token END), list(id)) AS m,
              max(id) FILTER (token = '|') AS bar FROM voc WHERE token <> '[UNK]'),
enc AS (SELECT utt_id, doc_id, clear_text, list_transform(CASE WHEN clear_text = '' THEN [] ELSE string_split(clear_text, '') END,
          lambda c: coalesce(m[c], CASE WHEN c = '|' THEN bar END, unk)) AS ids
        FROM lab, vm, (SELECT id AS unk FROM voc WHERE token = '[UNK]'))
"""


def cleaned(x: str) -> str:
    for spaced, tight in [(" .", "."), (" ?", "?"), (" !", "!"), (" ,", ","), (" '' ", "''"), (" n''t", "n''t"), (" ''m", "''m"),
                          (" ''s", "''s"), (" ''ve", "''ve"), (" ''re", "''re")]:
        x = f"replace({x}, '{spaced}', '{tight}')"
    return x


@query(sql.with_(*LABELS, ALL_FREQ, VOCAB, ENCODED) + "SELECT utt_id, array_to_string(ids, ' ') AS labels FROM enc")
def encode_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of every utterance by the vocabulary of all documents."""
    ids = vocabulary.lookup(_vocabulary(spark, folder, split=None))
    return fixtures.label_utterances(spark, folder).select(
        "utt_id", F.array_join(vocabulary.encode(F.col("clear_text"), ids).cast("array<string>"), " ").alias("labels"))


@query(sql.with_(*LABELS, FREQ, VOCAB, ENCODED, """
pad AS (SELECT count(*) + 2 AS pad FROM voc),
inv AS (SELECT map(list(id), list(token)) AS m FROM (SELECT id, max(token) FILTER (token <> '[UNK]') AS t1,
               coalesce(t1, max(token)) AS token FROM voc GROUP BY id))""") + f"""
SELECT utt_id, {cleaned("trim(replace(coalesce(array_to_string(list_transform(list_filter(ids, lambda i: i <> pad), lambda i: m[i]), ''), ''), '|', ' '))")} AS decoded
FROM enc, inv, pad""")
def decode_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels with ignored positions appended, decoded without collapsing."""
    ids = vocabulary.lookup(vocabulary.with_pad(_vocabulary(spark, folder)))
    pad_id = ids[vocabulary.PAD]
    coded = fixtures.label_utterances(spark, folder).select(
        "utt_id", F.concat(vocabulary.encode(F.col("clear_text"), ids),
                           F.array(F.lit(arrays.LABEL_PAD), F.lit(arrays.LABEL_PAD))).alias("labels"))
    return coded.select("utt_id", vocabulary.decode(F.col("labels"), ids, pad_id).alias("decoded"))


@query(sql.with_(*LABELS, FREQ, """
known AS (SELECT ch FROM cf WHERE freq > 10 AND (ch <> '|' OR NOT EXISTS (SELECT 1 FROM cf WHERE ch = ' ' AND freq > 10))),
seen AS (SELECT lang, utt_id, clear_text, unnest(CASE WHEN clear_text = '' THEN [NULL] ELSE string_split(clear_text, '') END) AS ch
         FROM lab JOIN (SELECT utt_id, lang FROM utt) USING (utt_id) WHERE doc_id % 21 + 1 IN (6, 19, 20, 21)),
per AS (SELECT lang, utt_id, count(ch) AS n, count(ch) FILTER (ch <> '|' AND ch NOT IN (SELECT ch FROM known)) AS u FROM seen GROUP BY 1, 2)
""") + """
SELECT lang, sum(n)::BIGINT AS labels, sum(u)::BIGINT AS unknown, count(*) AS n_rows, round(sum(u) / sum(n), 6) AS unk_share
FROM per GROUP BY lang""")
def vocab_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """How the training split's vocabulary covers the evaluation split, per language."""
    ids = vocabulary.lookup(_vocabulary(spark, folder, 10, compat=False))
    found = vocabulary.coverage(fixtures.label_utterances(spark, folder, "eval"), "clear_text", ids, ["lang"])
    return found.select("lang", "labels", "unknown", "n_rows", F.round("unk_share", 6).alias("unk_share"))


@query(sql.with_(sql.FRAMES) + """
SELECT utt_id, array_to_string(list_transform(frames, lambda f: list_position(f, list_max(f)) - 1), ' ') AS ids FROM fr""")
def frame_argmax(spark: SparkSession, folder: str) -> DataFrame:
    return fixtures.frames(spark, folder).select(
        "utt_id", F.array_join(arrays.frame_argmax(F.col("frames")).cast("array<string>"), " ").alias("ids"))


@query(sql.with_(sql.FRAME_IDS) + """
SELECT utt_id, trim(replace(coalesce(array_to_string(list_transform(
         list_filter(list_filter(ids, lambda x, i: i = 1 OR x <> ids[i - 1]), lambda x: x <> 0),
         lambda x: ['a', 'b', '|'][x]), ''), ''), '|', ' ')) AS decoded FROM fid""")
def ctc_greedy(spark: SparkSession, folder: str) -> DataFrame:
    tokens = F.array(*[F.lit(t) for t in fixtures.FRAME_TOKENS])
    return fixtures.frame_ids(spark, folder).select(
        "utt_id", arrays.ids_to_text(F.col("ids"), tokens, pad_id=0).alias("decoded"))


@query("""
SELECT page_id, name, CASE WHEN regexp_matches(name, '^\\.*[^.].*\\.[^.]*$')
       THEN name[: length(name) - length(regexp_extract(name, '\\.[^.]*$'))] ELSE name END AS stem
FROM (SELECT page_id, string_split(url, '/')[-1] AS name FROM pages)""")
def file_stem(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages", "page_id", "url").select(
        "page_id", text.file_name(F.col("url")).alias("name"), text.file_stem(F.col("url")).alias("stem"))
