"""Inputs derived from the test tables by rules that Spark and SQL share.

Whole texts are used: a document is cut into utterances of ``UTTERANCE_WORDS``
words and every utterance is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from utterscale.functions import arrays, text
from utterscale.operators import splits
from utterscale.sources.scan import spread, table

UTTERANCE_WORDS = 24
SEGMENT_SPAN = 1_000_000  # utt_id = doc_id * SEGMENT_SPAN + segment
TURN_SPAN = 1000  # utt_id = conv_id * TURN_SPAN + turn


def _numbered(row: Column, part: Column, span: int) -> Column:
    """``row * span + part``; a part beyond the span is refused, as its number would be another row's."""
    beyond = F.raise_error(F.concat(F.lit(f"more than {span} parts in row "), row.cast("string"))).cast("bigint")
    return F.when(part.isNull() | part.between(0, span - 1), row * span + part).otherwise(beyond)


def _tokens(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(text, "[ \t\n]{2,}|[\t\n]", " ")), " ")


def _utterances(rows: DataFrame, id_of_row: Column) -> DataFrame:
    keep = [c for c in rows.columns if c != "text"]
    pieces = arrays.cut(_tokens(F.col("text")), UTTERANCE_WORDS)
    # outer: an inner explode would first filter on the size, cutting every text twice
    return rows.select(*keep, F.posexplode_outer(pieces).alias("seg", "tokens")).select(
        _numbered(id_of_row, F.col("seg"), SEGMENT_SPAN).alias("utt_id"), *keep, "tokens")


def utterances_of(docs: DataFrame, *carry: str) -> DataFrame:
    """``utt_id, doc_id, lang, source, tokens`` of documents, as a batch or a stream, and the columns ``carry``."""
    return _utterances(docs.select("doc_id", "lang", "source", *carry, "text"), F.col("doc_id"))


def utterances(spark: SparkSession, folder: str, split: str | None = None) -> DataFrame:
    """Utterances of all documents, or of those whose group the fold map puts into ``split``."""
    docs = table(spark, folder, "documents", "doc_id", "lang", "source", "text")
    if split:
        grouped = docs.withColumn("group_id", (F.col("doc_id") % 21 + 1).cast("string"))
        docs = splits.assign_split(grouped, splits.fold_table(spark, splits.PRODUCTION_FOLDS)).where(F.col("split") == split)
    return utterances_of(spread(docs, "doc_id"))


def benchmark_utterances(spark: SparkSession, folder: str) -> DataFrame:
    """Utterances that only ever get a hypothesis; their ids are negative."""
    items = spread(table(spark, folder, "benchmark", "item_id", "text"), "item_id")
    return _utterances(items, -(F.col("item_id") + 1))


def _noise_a(tokens: Column) -> Column:
    kept = F.filter(tokens, lambda t, i: i % 7 != 3)
    noisy = F.transform(kept, lambda t, i: F.when(i % 11 == 5, F.concat(t, F.lit("x"))).otherwise(t))
    # a one-word utterance is not recognised at all
    return F.when(F.size(tokens) == 1, "").otherwise(F.array_join(noisy, " "))


def _noise_b(tokens: Column) -> Column:
    kept = F.filter(tokens, lambda t, i: i % 5 != 2)
    doubled = F.transform(kept, lambda t, i: F.when(i % 13 == 4, F.array(t, t)).otherwise(F.array(t)))
    return F.array_join(F.flatten(doubled), " ")


def misheard(tokens: Column) -> Column:
    """A transcript with words left out, replaced and doubled."""
    kept = F.filter(tokens, lambda t, i: i % 7 != 3)
    return F.flatten(F.transform(kept, lambda t, i: F.when(i % 11 == 5, F.array(F.concat(t, F.lit("x"))))
                                 .when(i % 13 == 4, F.array(t, t)).otherwise(F.array(t))))


def pairs_of(spoken: DataFrame, *carry: str) -> DataFrame:
    """``system, utt_id, doc_id, lang, source, ref, hyp`` and ``carry``, two systems per utterance."""
    both = F.array(F.struct(F.lit("A").alias("system"), _noise_a(F.col("tokens")).alias("hyp")),
                   F.struct(F.lit("B").alias("system"), _noise_b(F.col("tokens")).alias("hyp")))
    return (spoken.select("utt_id", "doc_id", "lang", "source", *carry, F.array_join("tokens", " ").alias("ref"),
                    F.inline(both).alias("system", "hyp"))
            .select("system", "utt_id", "doc_id", "lang", "source", *carry, "ref", "hyp"))


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    return pairs_of(utterances(spark, folder))


def refs(spark: SparkSession, folder: str) -> DataFrame:
    return utterances(spark, folder).select("utt_id", "lang", F.array_join("tokens", " ").alias("ref"))


def hyps(spark: SparkSession, folder: str) -> DataFrame:
    """Hypotheses as a separate table: system B skipped one source, system A also
    transcribed the benchmark items, for which no reference exists."""
    done = pairs(spark, folder).where((F.col("system") == "A") | (F.col("source") != "src3"))
    extra = benchmark_utterances(spark, folder).select(
        F.lit("A").alias("system"), "utt_id", F.array_join("tokens", " ").alias("hyp"))
    return done.select("system", "utt_id", "hyp").unionByName(extra)


def label_utterances(spark: SparkSession, folder: str, split: str | None = None) -> DataFrame:
    """Lower-cased utterances with the corpus column name ``clear_text``."""
    return utterances(spark, folder, split).select(
        "utt_id", "doc_id", "lang", F.lower(F.array_join("tokens", " ")).alias("clear_text"))


def signals(spark: SparkSession, folder: str) -> DataFrame:
    """The code points of every utterance standing in for audio, the lengths of its words for labels."""
    rows = utterances(spark, folder).select("utt_id", "tokens", F.array_join("tokens", " ").alias("spoken"))
    return rows.select("utt_id", F.lower("spoken").alias("clear_text"),
                       F.transform(text.chars(F.col("spoken")), lambda c: F.ascii(c).cast("float")).alias("input_values"),
                       F.transform("tokens", F.length).alias("labels"))


def frames(spark: SparkSession, folder: str) -> DataFrame:
    """Eight frames of eight scores per row."""
    rows = table(spark, folder, "embeddings", "vec_id", "embedding")
    return rows.select(F.col("vec_id").alias("utt_id"), arrays.cut(F.col("embedding"), 8).alias("frames"))


def frame_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Frame ids 0..3; 0 is the pad id."""
    rows = table(spark, folder, "embeddings", "vec_id", "embedding")
    return rows.select(F.col("vec_id").alias("utt_id"),
                       F.transform("embedding", lambda x: F.pmod(F.floor(x * 16), F.lit(4)).cast("int")).alias("ids"))


def logits(spark: SparkSession, folder: str) -> DataFrame:
    """``run, utt_id, frames, labels``: eight frames of eight scores, and eight padded labels.

    Run 3 has no frames, run 4 no labels but padding."""
    rows = table(spark, folder, "embeddings", "vec_id", "embedding", "label")
    ids = F.transform(F.slice("embedding", 9, 8), lambda x: F.pmod(F.floor(x * 16), F.lit(8)).cast("int"))
    labels = F.transform(ids, lambda x: F.when((x == 0) | (F.col("label") == 4), arrays.LABEL_PAD).otherwise(x))
    frames = F.when(F.col("label") != 3, arrays.cut(F.col("embedding"), 8))
    return rows.select(F.col("label").alias("run"), F.col("vec_id").alias("utt_id"), frames.alias("frames"), labels.alias("labels"))


LOGIT_TOKENS = ["[PAD]", "a", "b", "|", "1", "0", ".", "|"]  # vocabulary of ``logits``
FRAME_TOKENS = ["[PAD]", "a", "b", "|"]  # vocabulary of ``frame_ids``


def _mark_up(tokens: Column) -> Column:
    def mark(t: Column, i: Column) -> Column:
        return (F.when(i % 13 == 5, F.array(F.concat(t, F.lit("@!"))))
                .when(i % 17 == 3, F.array(F.concat(t, F.lit("@g"))))
                .when(i % 19 == 7, F.array(t, F.lit("-"), t))
                .when(i % 23 == 11, F.array(F.concat(t, F.lit("@?"))))
                .when(i % 29 == 13, F.array(F.lit("@!"), t))
                .when(i % 31 == 17, F.array(t, F.lit("--"), t))
                .when(i % 37 == 19, F.array(F.lit("(...)"), t))
                .otherwise(F.array(t)))

    return F.flatten(F.transform(tokens, mark))


def turns(spark: SparkSession, folder: str) -> DataFrame:
    """``utt_id, role, tokens`` for every conversation turn."""
    rows = spread(table(spark, folder, "conversations", "conv_id", "turn", "role", "text"), "conv_id")
    return rows.select(_numbered(F.col("conv_id"), F.col("turn"), TURN_SPAN).alias("utt_id"), "conv_id", "role",
                       _tokens(F.col("text")).alias("tokens"))


def annotated(spark: SparkSession, folder: str) -> DataFrame:
    """Turns with learner mark-up: ``utt_id, conv_id, role, annotated``."""
    return turns(spark, folder).select("utt_id", "conv_id", "role",
                                       F.array_join(_mark_up(F.col("tokens")), " ").alias("annotated"))


def segments(spark: SparkSession, folder: str) -> DataFrame:
    """Turns as word lists with start and end times in seconds."""
    def timed(w: Column, i: Column) -> Column:
        return F.struct(i.alias("pos"), w.alias("word"), (i * 0.4).cast("double").alias("start"),
                        (i * 0.4 + 0.3).cast("double").alias("end"))

    return turns(spark, folder).select("utt_id", F.transform("tokens", timed).alias("words"))


def evals_of(events: DataFrame) -> DataFrame:
    """Evaluations ``run, ts, event_id, wer``: every event, a run per type and fifth of the users."""
    run = F.concat("event_type", F.lit(":"), F.col("user_id") % 5)
    return events.select(run.alias("run"), "ts", "event_id", (F.col("value") / 50).alias("wer"))


def evals(spark: SparkSession, folder: str) -> DataFrame:
    return evals_of(table(spark, folder, "events", "event_id", "ts", "user_id", "event_type", "value"))


def payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Event properties whose member types depend on the event type, as JSON text."""
    k = F.regexp_extract("props", ":\\s*(-?[0-9]+)", 1)
    value = (F.when(F.col("event_type") == "click", F.concat(F.lit('"'), k, F.lit('"')))
             .when(F.col("event_type") == "error", F.concat(k, F.lit(".5")))
             .when(F.col("event_type") == "purchase", F.lit("true"))
             .when(F.col("event_type") == "signup", F.lit("null"))
             .otherwise(k))
    tags = (F.when(F.col("user_id") % 3 == 0, F.concat(F.lit('["'), F.col("event_type"), F.lit('", 1]')))
            .when(F.col("user_id") % 3 == 1, F.concat(F.lit('["'), F.col("event_type"), F.lit('"]')))
            .otherwise(F.lit("{}")))
    meta = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit('{"user": '), F.col("user_id"), F.lit("}"))).otherwise(F.lit("null"))
    return table(spark, folder, "events", "event_id", "user_id", "event_type", "value", "props").select(
        "event_id", "event_type",
        F.concat(F.lit('{"k": '), value, F.lit(', "tags": '), tags, F.lit(', "meta": '), meta,
                 F.lit(', "name": "'), F.col("event_type"), F.lit('"}')).alias("payload"))
