"""Queries: evaluation history, logs, sheets, run configurations, validation, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterscale.functions import arrays
from utterscale.operators import evaluations, scores, validation
from utterscale.operators.validation import Rule
from utterscale.plans import fixtures, scoring, sql
from utterscale.plans.registry import query
from utterscale.sources import eventlog, runconfig, sheets
from utterscale.sources.scan import table
from utterscale.sources.shared import shared_folder
from utterscale.streaming import jobs


@query(sql.with_(sql.EVALS, """
b AS (SELECT *, least(1.0, coalesce(min(wer) OVER (PARTITION BY run ORDER BY eval_nr
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0)) AS best_before FROM ranked)""") + """
SELECT run, event_id, eval_nr, round(wer, 6) AS wer, round(best_before, 6) AS best_before, wer < best_before AS saved
FROM b""")
def best_so_far(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluations numbered per run; an evaluation is saved when it beats all before it."""
    tracked = evaluations.best_so_far(fixtures.evals(spark, folder), ["ts", "event_id"])
    return tracked.select("run", "event_id", "eval_nr", F.round("wer", 6).alias("wer"),
                          F.round("best_before", 6).alias("best_before"), "saved")


@query("""
SELECT user_id, event_id FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 2""")
def retain_last_k(spark: SparkSession, folder: str) -> DataFrame:
    """The two newest rows per user."""
    rows = table(spark, folder, "events", "user_id", "ts", "event_id")
    return evaluations.retain_last(rows, ["user_id"], [F.desc("ts"), F.desc("event_id")], 2).select(
        "user_id", "event_id")


@query("SELECT event_id, event_type FROM events WHERE event_id % 100 = 0")
def every_n_steps(spark: SparkSession, folder: str) -> DataFrame:
    """Every hundredth step (the filter is the operator)."""
    return evaluations.every_n_steps(table(spark, folder, "events", "event_id", "event_type"), "event_id", 100)


@query(sql.with_(*scoring.REPORT, scoring._report("system"), f"""
sc AS (SELECT system, edits / ref_words AS wer, {sql.bleu_value()} AS bleu FROM tot JOIN err USING (system))""") + """
SELECT system, row_number() OVER (PARTITION BY system ORDER BY utt_id) - 1 AS idx,
       (row_number() OVER (PARTITION BY system ORDER BY utt_id) - 1) || chr(9) || replace(hyp, '\\', '\\\\') || chr(9)
       || replace(ref, '\\', '\\\\') AS line FROM pairs
UNION ALL SELECT system, -1, 'WER: ' || printf('%.6f', wer) || chr(9) || ' BLEU:' || printf('%.6f', bleu) FROM sc""")
def prediction_sheet(spark: SparkSession, folder: str) -> DataFrame:
    """Per system a score header and numbered hypothesis / reference lines."""
    pairs = fixtures.pairs(spark, folder)
    return sheets.prediction_sheet(pairs, scores.eval_report(pairs))


@query(sql.with_(sql.FRAME_IDS, scoring.LOGITS, """
fp AS (SELECT 0 AS run, utt_id AS k, {hyp} AS hyp, {ref} AS ref FROM fid)
""".format(**{side: "trim(replace(coalesce(array_to_string(list_transform(list_filter(" + ids + """, lambda x: x <> 0),
    lambda x: ['a', 'b', '|'][x]), ''), ''), '|', ' '))""" for side, ids in [
        ("hyp", "list_filter(ids, lambda x, i: i = 1 OR x <> ids[i - 1])"), ("ref", "ids")]}), scoring.report_of("fp", "run")) + """
SELECT row_number() OVER (ORDER BY utt_id) - 1 AS idx, (row_number() OVER (ORDER BY utt_id) - 1) || chr(9) ||
       array_to_string(list_transform(ids, lambda x: ['[PAD]', 'a', 'b', '|'][x + 1]), ' ') AS line FROM fid
UNION ALL SELECT -1, 'WER: ' || printf('%.6f', wer) || chr(9) || ' BLEU:' || printf('%.6f', bleu) FROM rep""")
def token_sheet(spark: SparkSession, folder: str) -> DataFrame:
    """A score header, then the ungrouped tokens of every row; scored against the tokens that are not collapsed."""
    tokens = F.array(*[F.lit(t) for t in fixtures.FRAME_TOKENS])
    rows = fixtures.frame_ids(spark, folder)
    pairs = rows.select(arrays.ids_to_text(F.col("ids"), tokens, 0).alias("hyp"),
                        arrays.ids_to_text(F.col("ids"), tokens, 0, collapse=False).alias("ref"))
    return sheets.token_sheet(rows, F.col("ids"), tokens, scores=scores.eval_report(pairs, []))


@query("""
SELECT event_id, CASE event_type WHEN 'view' THEN 'info' WHEN 'click' THEN 'debug' WHEN 'error' THEN 'error'
       WHEN 'purchase' THEN 'warning' ELSE 'notset' END AS level, event_type AS event, user_id, value FROM events""")
def event_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events written as JSON lines, routed by level, and read back."""
    level = (F.when(F.col("event_type") == "view", "info").when(F.col("event_type") == "click", "debug")
             .when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "warning")
             .otherwise("audit"))
    rows = table(spark, folder, "events", "event_id", "user_id", "event_type", "value")
    path = shared_folder(spark, "log")
    eventlog.append(eventlog.log_lines(rows, F.col("event_type"), level, ["event_id", "user_id", "value"]), path)
    return eventlog.read(spark, path, "event string, event_id bigint, user_id bigint, value double").select(
        "event_id", "level", "event", "user_id", "value")


CONFIGS = """
raw AS (SELECT event_id, CASE event_type
    WHEN 'view' THEN '{"seed":' || user_id || ',"optim":"view"}'
    WHEN 'click' THEN '{"n_steps":' || (event_id % 250) || ',"train_corpora":[["click","train"]],"old_key":1}'
    WHEN 'error' THEN '{"learning_rate":' || value || ',"optim":null}'
    WHEN 'purchase' THEN '{"fp16":false,"gradient_checkpointing":false,"dataset_kwargs":{"lowercase":true}}'
    ELSE CASE event_id % 3 WHEN 0 THEN '{"seed":1' WHEN 1 THEN '{"seed":"abc","fp16":false}' ELSE '{}' END END AS config FROM events),
whole AS (SELECT event_id, CASE WHEN json_valid(config) THEN config END AS config FROM raw),
cfg AS (SELECT *, CASE WHEN config IS NULL THEN 'json'
    WHEN (config ->> '$.seed') IS NOT NULL AND TRY_CAST(config ->> '$.seed' AS BIGINT) IS NULL THEN 'type: seed' END AS error FROM whole)
"""


def _config_value(key: str, default: str, kind: str) -> str:
    return (f"CASE WHEN list_contains(json_keys(config), '{key}') THEN TRY_CAST(config ->> '$.{key}' AS {kind}) "
            f"WHEN error IS NULL THEN {default} END AS {key}")


@query(sql.with_(CONFIGS) + f"""
SELECT event_id, {_config_value('seed', '123', 'BIGINT')}, {_config_value('n_steps', '30', 'BIGINT')},
       {_config_value('optim', "'adamw_hf'", 'VARCHAR')}, {_config_value('learning_rate', '3e-5', 'DOUBLE')},
       {_config_value('fp16', 'true', 'BOOLEAN')}, {_config_value('dataset_kwargs', "'{}'", 'VARCHAR')},
       CASE WHEN list_contains(json_keys(config), 'gradient_checkpointing') THEN 0 WHEN error IS NULL THEN 1 END::BIGINT AS gradient_checkpointing,
       coalesce(config ->> '$.train_corpora[0][0]', CASE WHEN error IS NULL THEN 'corpus' END) AS corpus,
       CASE WHEN list_contains(json_keys(config), 'old_key') THEN 'old_key' WHEN config IS NOT NULL THEN '' END AS unknown_keys, error FROM cfg""")
def runs_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Run configurations (one JSON object per event) with defaults filled in."""
    e, j = F.col("event_type"), F.concat
    config = (F.when(e == "view", j(F.lit('{"seed":'), "user_id", F.lit(',"optim":"view"}')))
              .when(e == "click", j(F.lit('{"n_steps":'), F.col("event_id") % 250,
                                    F.lit(',"train_corpora":[["click","train"]],"old_key":1}')))
              .when(e == "error", j(F.lit('{"learning_rate":'), "value", F.lit(',"optim":null}')))
              .when(e == "purchase", '{"fp16":false,"gradient_checkpointing":false,"dataset_kwargs":{"lowercase":true}}')
              .otherwise(F.when(F.col("event_id") % 3 == 0, '{"seed":1')
                         .when(F.col("event_id") % 3 == 1, '{"seed":"abc","fp16":false}').otherwise("{}")))
    rows = table(spark, folder, "events", "event_id", "user_id", "event_type", "value").select(
        "event_id", config.alias("config"))
    return runconfig.expand(rows).select(
        "event_id", "seed", "n_steps", "optim", "learning_rate", "fp16", "dataset_kwargs", "gradient_checkpointing",
        F.get(F.get("train_corpora", F.lit(0)), F.lit(0)).alias("corpus"),
        F.array_join("unknown_keys", ",").alias("unknown_keys"), "error")


RULES = {
    "k": Rule("int"),
    "tags": Rule("list", each=Rule("str")),
    "meta": Rule("dict", nullable=True, members={"user": Rule("int")}),
    "name": Rule("str"),
    "flag": Rule("bool", nullable=True),
}
CHECKED = """
chk AS (SELECT event_id, event_type, payload, list_filter([
    CASE WHEN coalesce(json_type(payload, '$.k'), 'NULL') NOT IN ('BIGINT', 'UBIGINT') THEN 'k' END,
    CASE WHEN coalesce(json_type(payload, '$.tags'), 'NULL') <> 'ARRAY' OR len(list_filter(
           json_extract(payload, '$.tags[*]'), lambda x: json_type(x) <> 'VARCHAR')) > 0 THEN 'tags' END,
    CASE WHEN NOT (coalesce(json_type(payload, '$.meta'), 'NULL') = 'NULL' OR (json_type(payload, '$.meta') = 'OBJECT'
           AND coalesce(json_type(payload, '$.meta.user'), 'NULL') IN ('BIGINT', 'UBIGINT'))) THEN 'meta' END,
    CASE WHEN coalesce(json_type(payload, '$.name'), 'NULL') <> 'VARCHAR' THEN 'name' END,
    CASE WHEN coalesce(json_type(payload, '$.flag'), 'NULL') NOT IN ('NULL', 'BOOLEAN') THEN 'flag' END],
    lambda x: x IS NOT NULL) AS bad FROM pay)
"""


@query(sql.with_(sql.PAYLOADS, CHECKED)
       + "SELECT event_id, coalesce(array_to_string(bad, ','), '') AS violations, len(bad) = 0 AS valid FROM chk")
def validate_props(spark: SparkSession, folder: str) -> DataFrame:
    checked = validation.validate(fixtures.payloads(spark, folder), "payload", RULES)
    return checked.select("event_id", F.array_join("violations", ",").alias("violations"),
                          (F.size("violations") == 0).alias("valid"))


@query(sql.with_(sql.PAYLOADS, CHECKED) + """
SELECT event_type, rule, count(*) AS n FROM (SELECT event_type, unnest(bad) AS rule FROM chk) GROUP BY event_type, rule""")
def quarantine_counts(spark: SparkSession, folder: str) -> DataFrame:
    checked = validation.validate(fixtures.payloads(spark, folder), "payload", RULES)
    return validation.quarantine(checked)[1].groupBy("event_type", "rule").agg(F.count("*").alias("n"))


@query(sql.with_(sql.PAYLOADS, CHECKED) + """
SELECT event_id, CASE WHEN len(bad) = 0 THEN '{"k":' || (payload ->> '$.k') || ',"tags":["' || event_type || '"],"meta":'
       || coalesce('{"user":' || (payload ->> '$.meta.user') || '}', 'null') || ',"name":"' || event_type || '","flag":null}' END AS serialised,
       len(bad) = 0 AS kept FROM chk""")
def serialise_props(spark: SparkSession, folder: str) -> DataFrame:
    """Valid properties checked, written as JSON, and kept only if what was written checks and serialises to itself."""
    once = validation.serialise(fixtures.payloads(spark, folder), "payload", RULES, "first").select("event_id", "first")
    again = validation.serialise(once, "first", RULES)
    same = F.coalesce((F.size("violations") == 0) & (F.col("first") == F.col("serialised")), F.lit(False))
    return again.select("event_id", F.col("first").alias("serialised"), same.alias("kept"))


@query(sql.with_(sql.PAYLOADS) + """
SELECT event_id, CASE WHEN json_type(payload, '$.k') IN ('BIGINT', 'UBIGINT', 'DOUBLE')
       THEN (payload ->> '$.k')::DOUBLE END AS k FROM pay""")
def coerce_float(spark: SparkSession, folder: str) -> DataFrame:
    return fixtures.payloads(spark, folder).select(
        "event_id", validation.coerce_float(F.col("payload"), "k").alias("k"))


DAY = "yyyy-MM-dd"
DELAY = "2 days"  # how much older than the newest row a row may be and still change a window


@query("""
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def stream_event_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Events per day and type: windows closed by a stream, plus the rows that came late."""
    source = jobs.read_table_stream(spark, folder, "events").select("ts", "event_type")
    in_time, late = jobs.route_late(source, "events", "ts", DELAY)
    timed = jobs.with_event_time(jobs.read_routed(spark, in_time, source), "ts", DELAY)
    counts = jobs.current(jobs.windowed_counts(timed, ["event_type"]), "event-counts", ["window_start", "event_type"])
    rest = jobs.windowed_counts(jobs.with_event_time(jobs.read_side(spark, late, source), "ts"), ["event_type"])
    return counts.unionByName(rest).groupBy(F.date_format("window_start", DAY).alias("day"), "event_type").agg(F.sum("n").alias("n"))


@query(sql.with_(*scoring.BASE, sql.word_errors("pairs", "system, doc_id")) + """
SELECT strftime(date_trunc('day', TIMESTAMP '2024-01-01' + INTERVAL (doc_id) HOUR), '%Y-%m-%d') AS day, system,
       sum(edits)::BIGINT AS edits, sum(ref_words)::BIGINT AS ref_words, round(sum(edits) / sum(ref_words), 6) AS wer
FROM we GROUP BY 1, 2""")
def stream_wer(spark: SparkSession, folder: str) -> DataFrame:
    """Running word error rate per day and system; a document arrives every hour. Late ones are added."""
    docs = jobs.read_table_stream(spark, folder, "documents").select("doc_id", "lang", "source", "text")
    docs = docs.withColumn("ts", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id") * 3600))
    in_time, late = jobs.route_late(docs, "documents", "ts", DELAY)
    sums = {"edits": F.col("edits"), "ref_words": F.col("ref_words")}

    def summed(rows: DataFrame, delay: str | None) -> DataFrame:
        timed = jobs.with_event_time(rows, "ts", delay)
        pairs = fixtures.pairs_of(fixtures.utterances_of(timed, "ts"), "ts")
        return jobs.windowed_sums(scores.word_errors(pairs), ["system"], sums)

    live = jobs.current(summed(jobs.read_routed(spark, in_time, docs), DELAY), "wer", ["window_start", "system"])
    both = live.unionByName(summed(jobs.read_side(spark, late, docs), None))
    total = both.groupBy(F.date_format("window_start", DAY).alias("day"), "system").agg(*[F.sum(c).alias(c) for c in sums])
    return total.withColumn("wer", F.round(F.col("edits") / F.col("ref_words"), 6))


@query(sql.with_(sql.EVALS) + """
SELECT run, round(least(1.0, wer), 6) AS best, event_id FROM ranked
QUALIFY row_number() OVER (PARTITION BY run ORDER BY wer, ts, event_id) = 1""")
def stream_best(spark: SparkSession, folder: str) -> DataFrame:
    """Best evaluation per run, kept by a stream."""
    evals = fixtures.evals_of(jobs.read_table_stream(spark, folder, "events"))
    best = jobs.running_best(evals, "run", "wer", ["ts", "event_id"], evaluations.START)
    return jobs.current(best, "best", ["run"]).select("run", F.round("best", 6).alias("best"), "event_id")


@query(sql.with_(sql.EVALS, """
b AS (SELECT *, least(1.0, coalesce(min(wer) OVER (PARTITION BY run ORDER BY eval_nr
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0)) AS best_before FROM ranked)""") + """
SELECT run, event_id, eval_nr, round(wer, 6) AS wer, round(best_before, 6) AS best_before, wer < best_before AS saved
FROM b""")
def stream_history(spark: SparkSession, folder: str) -> DataFrame:
    """Every evaluation numbered by a stream, with the best before it and whether it was saved."""
    evals = fixtures.evals_of(jobs.read_table_stream(spark, folder, "events"))
    numbered, _ = jobs.history(evals, "history", ["ts", "event_id"], start=evaluations.START)
    return spark.read.parquet(numbered).select("run", "event_id", "eval_nr", F.round("wer", 6).alias("wer"),
                                               F.round("best_before", 6).alias("best_before"), "saved")
