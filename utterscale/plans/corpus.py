"""Queries: corpora, splits, samples, batches, signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterscale.functions import arrays, text
from utterscale.operators import batching, ordering, splits, vocabulary
from utterscale.plans import fixtures, sql, texts
from utterscale.plans.registry import query
from utterscale.sources import corpora, files, sheets
from utterscale.sources.scan import table
from utterscale.sources.shared import shared_folder

SEED = 123  # fixed value: configured seed

FOLDS = """
fold AS (SELECT unnest(['1', '2', '3', '4', '7', '8', '9', '10', '12', '13', '14', '15', '16', '17', '18']) AS group_id, 'train' AS split
         UNION ALL SELECT unnest(['5', '11']), 'test' UNION ALL SELECT unnest(['6', '19', '20', '21']), 'eval')
"""
GROUPS = """
grp AS (SELECT doc_id, lang, n_chars, text, (doc_id % 21 + 1)::VARCHAR AS group_id FROM documents),
ass AS (SELECT grp.*, split FROM grp LEFT JOIN fold USING (group_id))
"""


def _grouped(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return table(spark, folder, "documents", "doc_id", *columns).withColumn(
        "group_id", (F.col("doc_id") % 21 + 1).cast("string"))


def _assigned(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    folds = splits.fold_table(spark, splits.PRODUCTION_FOLDS)
    return splits.assign_split(_grouped(spark, folder, *columns), folds)


@query(sql.with_(FOLDS, GROUPS) + "SELECT doc_id, lang, n_chars, split FROM ass WHERE split = 'eval'")
def load_split(spark: SparkSession, folder: str) -> DataFrame:
    """One split of a saved dataset; the other splits' folders are not read."""
    path = shared_folder(spark, "dataset")
    corpora.save_dataset(_assigned(spark, folder, "lang", "n_chars"), path)
    return corpora.load_split(spark, path, "eval").select("doc_id", "lang", "n_chars", "split")


@query("""
SELECT 'documents' AS corpus, doc_id AS row_id, lang, length(text) AS n_chars FROM documents
UNION ALL SELECT 'benchmark', item_id, NULL, length(text) FROM benchmark""")
def concat_corpora(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "lang", "text").withColumnRenamed("doc_id", "row_id")
    items = table(spark, folder, "benchmark", "item_id", "text").withColumnRenamed("item_id", "row_id")
    both = corpora.concat({"documents": docs, "benchmark": items})
    return both.select("corpus", "row_id", "lang", F.length("text").cast("bigint").alias("n_chars"))


@query(sql.with_(FOLDS, GROUPS) + "SELECT doc_id, split, lang, md5(text) AS digest FROM ass")
def dataset_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Prepared once per settings, saved by split, loaded back whole."""
    base = shared_folder(spark, "cache")
    rows = corpora.prepared(spark, base, {"table": folder, "seed": SEED},
                            lambda: _assigned(spark, folder, "lang", "text"))
    path = shared_folder(spark, "dataset")
    corpora.save_dataset(rows, path)
    return corpora.load_dataset(spark, path).select("doc_id", "split", "lang", F.md5("text").alias("digest"))


@query("""
SELECT lang, 'txt' AS format, sum(len(string_split(text, chr(10))))::BIGINT AS n_lines, min(length(text)) >= 0 AS listed
FROM documents GROUP BY lang
UNION ALL SELECT lang, 'csv', count(*), true FROM documents GROUP BY lang""")
def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Texts exported to nested folders in two formats, found again by extension and read."""
    path = shared_folder(spark, "export")
    docs = table(spark, folder, "documents", "doc_id", "lang", "source", "n_chars", "text")
    docs.select("lang", "source", F.col("text").alias("value")).write.partitionBy("lang", "source").text(f"{path}/plain")
    docs.select("lang", F.concat_ws(",", "doc_id", "n_chars").alias("value")).write.partitionBy("lang").option(
        "compression", "none").csv(f"{path}/sheets")
    formats = ["txt", "csv"]
    found = files.list_files(spark, path, formats)
    lines = files.read_lines(spark, path, formats).groupBy("path").agg(F.count("*").alias("n"))
    lang = F.regexp_extract("path", "/lang=([^/]+)/", 1)
    return found.join(lines, "path").groupBy(lang.alias("lang"), "format").agg(
        F.sum("n").alias("n_lines"), F.min(F.col("length") > 0).alias("listed"))


@query("SELECT doc_id, lang, md5(text) AS digest FROM documents")
def csv_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_folder(spark, "csv")
    sheets.write_csv(table(spark, folder, "documents", "doc_id", "lang", "text"), path, one_line=True)
    return sheets.read_csv(spark, path, "doc_id bigint, lang string, text string", one_line=True).select(
        "doc_id", "lang", F.md5("text").alias("digest"))


@query(f"""
SELECT doc_id, md5({sql.normalize('text')}) AS digest, CASE WHEN doc_id % 4 = 3 THEN 'second' ELSE 'first' END AS call,
       (SELECT count(DISTINCT doc_id % 4) FROM documents WHERE doc_id % 4 < 3) AS files_first,
       (SELECT count(DISTINCT doc_id % 4) FROM documents WHERE doc_id % 4 = 3) AS files_second, 0::BIGINT AS files_third FROM documents""")
def incremental_preparation(spark: SparkSession, folder: str) -> DataFrame:
    """A corpus of one file per quarter, prepared before and after the last file comes, and once more."""
    base = shared_folder(spark, "incremental")
    docs = table(spark, folder, "documents", "doc_id", "text").withColumn("quarter", F.col("doc_id") % 4)

    def prepare(rows: DataFrame) -> DataFrame:
        return rows.withColumns({"digest": F.md5(text.normalize(F.col("text"))), "call": F.lit(calls[-1])}).drop("text")

    calls, counts = [], []
    for call, part in (("first", "quarter < 3"), ("second", "quarter = 3"), ("third", "false")):
        calls.append(call)
        docs.where(part).repartition("quarter").write.mode("append").partitionBy("quarter").parquet(f"{base}/corpus")
        rows, fresh = corpora.prepared_files(spark, f"{base}/cache", f"{base}/corpus", {"rule": "normalize"}, prepare)
        counts.append(fresh)
    return rows.select("doc_id", "digest", "call", *[F.lit(n).cast("bigint").alias(f"files_{call}") for call, n in zip(calls, counts)])


@query(sql.with_(FOLDS, GROUPS) + "SELECT doc_id, group_id, split FROM ass")
def fold_split(spark: SparkSession, folder: str) -> DataFrame:
    return _assigned(spark, folder).select("doc_id", "group_id", "split")


LEAKY = {"train": ["1", "2", "3"], "test": ["3", "4"], "eval": ["5", "6"]}


@query(sql.with_("lf AS (" + " UNION ALL ".join(f"SELECT unnest({g!r}) AS group_id, '{s}' AS split"
                                                for s, g in LEAKY.items()) + ")",
                 "grp AS (SELECT (doc_id % 21 + 1)::VARCHAR AS group_id, count(*) AS n_rows FROM documents GROUP BY 1)") + """
SELECT group_id, n_rows, count(DISTINCT split) AS n_splits FROM grp LEFT JOIN lf USING (group_id)
GROUP BY group_id, n_rows HAVING count(DISTINCT split) <> 1""")
def split_leakage(spark: SparkSession, folder: str) -> DataFrame:
    """A fold map with an overlap and gaps, checked against the groups in use."""
    return splits.leakage(_grouped(spark, folder), splits.fold_table(spark, LEAKY))


@query(sql.with_(FOLDS, GROUPS) + "SELECT coalesce(split, 'none') AS split, count(*) AS n FROM ass GROUP BY 1")
def split_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _assigned(spark, folder).groupBy(F.coalesce("split", F.lit("none")).alias("split")).agg(
        F.count("*").alias("n"))


@query("""
SELECT doc_id, fold, CASE WHEN list_contains(groups, doc_id % 11) THEN 'eval' ELSE 'train' END AS role
FROM documents, (VALUES (0, [0, 1, 2]), (1, [3, 4, 5]), (2, [6, 7, 8]), (3, [9, 10])) f(fold, groups)""")
def kfold_roles(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id")
    return splits.kfold_roles(docs, F.col("doc_id") % 11)


@query("""
SELECT fold, g AS group_id, n_rows FROM (SELECT doc_id % 11 AS g, count(*) AS n_rows FROM documents GROUP BY 1),
     (VALUES (0, [0, 1, 2]), (1, [3, 4, 5]), (2, [6, 7, 8]), (3, [9, 10])) f(fold, groups)
WHERE NOT list_contains(groups, g)""")
def kfold_train_anti(spark: SparkSession, folder: str) -> DataFrame:
    """Training groups of every fold with their size, as a set difference."""
    groups = table(spark, folder, "documents", "doc_id").groupBy((F.col("doc_id") % 11).alias("group_id")).agg(
        F.count("*").alias("n_rows"))
    train = splits.kfold_train_groups(spark, groups.select("group_id"))
    return train.join(groups, "group_id").select("fold", "group_id", "n_rows")


@query(f"""
SELECT doc_id, row_number() OVER (ORDER BY md5('{SEED}:' || doc_id), doc_id) - 1 AS position FROM documents""")
def seeded_shuffle(spark: SparkSession, folder: str) -> DataFrame:
    return ordering.seeded_shuffle(table(spark, folder, "documents", "doc_id"), "doc_id", SEED)


@query(f"SELECT doc_id, lang FROM documents ORDER BY md5('{SEED}:' || doc_id), doc_id LIMIT 300")
def seeded_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Three hundred rows (the sample size is the operator's parameter)."""
    return ordering.seeded_sample(table(spark, folder, "documents", "doc_id", "lang"), "doc_id", 300, SEED)


@query(f"""
SELECT doc_id, lang FROM documents
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('{SEED}:' || doc_id), doc_id) <= 50""")
def seeded_sample_per_group(spark: SparkSession, folder: str) -> DataFrame:
    return ordering.seeded_sample_per_group(table(spark, folder, "documents", "doc_id", "lang"), ["lang"], "doc_id",
                                            50, SEED)


ZNORM = """
zn AS (SELECT utt_id, vs, mu, sqrt(list_sum(list_transform(vs, lambda x: (x - mu) * (x - mu))) / len(vs) + 1e-7) AS sd
       FROM (SELECT utt_id, vs, list_sum(vs) / len(vs) AS mu
             FROM (SELECT utt_id, input_values::DOUBLE[] AS vs FROM sig)))
"""


@query(sql.with_(sql.SIGNALS, ZNORM) + """
SELECT utt_id, i - 1 AS pos, round((vs[i] - mu) / sd, 6) AS value
FROM (SELECT *, unnest(range(1, len(vs) + 1)) AS i FROM zn)""")
def znorm_arrays(spark: SparkSession, folder: str) -> DataFrame:
    rows = fixtures.signals(spark, folder).select("utt_id", F.posexplode(arrays.znorm(F.col("input_values"))).alias("pos", "v"))
    return rows.select("utt_id", F.col("pos").cast("bigint").alias("pos"), F.round("v", 6).alias("value"))


@query(sql.with_(sql.SIGNALS, sql.LABELS, texts.FREQ, texts.VOCAB, ZNORM, """
vm AS (SELECT map(list(CASE WHEN token = '|' THEN ' ' ELSE token END), list(id)) AS m,
              max(id) FILTER (token = '|') AS bar FROM voc WHERE token <> '[UNK]')""") + """
SELECT utt_id, len(vs)::BIGINT AS input_length, round((vs[1] - mu) / sd, 6) AS first, round((list_max(vs) - mu) / sd, 6) AS peak,
       array_to_string(list_transform(string_split(clear_text, ''),
         lambda c: coalesce(m[c], CASE WHEN c = '|' THEN bar END, unk)), ' ') AS labels
FROM zn JOIN lab USING (utt_id), vm, (SELECT id AS unk FROM voc WHERE token = '[UNK]')""")
def prepare_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Every corpus row (signal and text) mapped to length, normalised signal and labels."""
    ids = vocabulary.lookup(texts._vocabulary(spark, folder))
    rows = fixtures.signals(spark, folder).select(
        "utt_id", F.size("input_values").cast("bigint").alias("input_length"),
        arrays.znorm(F.col("input_values")).alias("input_values"), vocabulary.encode(F.col("clear_text"), ids).alias("labels"))
    return rows.select("utt_id", "input_length", F.round(F.get("input_values", 0), 6).alias("first"),
                       F.round(F.array_max("input_values"), 6).alias("peak"),
                       F.array_join(F.col("labels").cast("array<string>"), " ").alias("labels"))


BATCH = 8


def _batches(source: str, key: str, length: str) -> str:
    """CTE ``plan(key, length, position, batch_id)`` with the longest row swapped first."""
    return f"""
sh AS (SELECT {key}, {length} AS len, row_number() OVER (ORDER BY md5('{SEED}:' || {key}), {key}) - 1 AS o,
              greatest(least((SELECT count(*) FROM {source}) // {BATCH * 4}, 50), 1) * {BATCH} AS mb FROM {source}),
pl AS (SELECT *, (o // mb) * mb + row_number() OVER (PARTITION BY o // mb ORDER BY len DESC, o) - 1 AS p FROM sh),
top AS (SELECT p AS front FROM pl WHERE p % mb = 0 ORDER BY len DESC, p LIMIT 1),
plan AS (SELECT {key}, len, CASE WHEN p = 0 THEN front WHEN p = front THEN 0 ELSE p END AS position,
                (CASE WHEN p = 0 THEN front WHEN p = front THEN 0 ELSE p END) // {BATCH} AS batch_id FROM pl, top)"""


@query(sql.with_(_batches("documents", "doc_id", "n_chars"))
       + "SELECT doc_id, len AS n_chars, position, batch_id FROM plan")
def length_batches(spark: SparkSession, folder: str) -> DataFrame:
    return batching.length_batches(table(spark, folder, "documents", "doc_id", "n_chars"), "doc_id", "n_chars",
                                   BATCH, SEED)


PLAN = (sql.SIGNALS, _batches("sig", "utt_id", "len(input_values)"))


def _plan(spark: SparkSession, folder: str) -> DataFrame:
    lengths = fixtures.signals(spark, folder).select(
        "utt_id", F.size("input_values").alias("input_length"), F.size("labels").alias("label_length"))
    batches = batching.length_batches(lengths, "utt_id", "input_length", BATCH, SEED, carry=["label_length"])
    return batching.with_longest(batches, {"input_length": "longest_input", "label_length": "longest_label"}).drop(
        "input_length", "label_length")


def _padded(spark: SparkSession, folder: str, **options) -> DataFrame:
    return batching.pad_batches(fixtures.signals(spark, folder), _plan(spark, folder), **options)


def _joined(column: str):
    return F.array_join(F.col(column).cast("array<string>"), " ")


def _input_sql(target: str) -> str:
    return f"""
SELECT utt_id, batch_id, {target} AS padded_length, len(input_values)::BIGINT AS ones,
       round(list_sum(input_values::DOUBLE[]), 6) AS total,
       repeat('1', len(input_values)) || repeat('0', {target} - len(input_values)) AS mask
FROM (SELECT sig.*, batch_id, max(len) OVER (PARTITION BY batch_id) AS longest FROM sig JOIN plan USING (utt_id))"""


def _input_rows(padded: DataFrame) -> DataFrame:
    return padded.select(
        "utt_id", "batch_id", F.size("input_values").cast("bigint").alias("padded_length"),
        F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).cast("bigint").alias("ones"),
        F.round(F.aggregate("input_values", F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("total"),
        F.array_join(F.col("attention_mask").cast("array<string>"), "").alias("mask"))


@query(sql.with_(*PLAN) + _input_sql("longest"))
def pad_inputs(spark: SparkSession, folder: str) -> DataFrame:
    return _input_rows(_padded(spark, folder))


@query(sql.with_(*PLAN) + """
SELECT utt_id, batch_id, array_to_string(list_concat(labels, list_transform(range(0, longest - len(labels)),
       lambda x: -100)), ' ') AS labels
FROM (SELECT sig.*, batch_id, max(len(labels)) OVER (PARTITION BY batch_id) AS longest FROM sig JOIN plan USING (utt_id))""")
def pad_labels(spark: SparkSession, folder: str) -> DataFrame:
    return _padded(spark, folder).select("utt_id", "batch_id", _joined("labels").alias("labels"))


@query(sql.with_(*PLAN) + _input_sql("(ceil(longest / 16) * 16)::BIGINT"))
def pad_multiple(spark: SparkSession, folder: str) -> DataFrame:
    return _input_rows(_padded(spark, folder, multiple_of=16, multiple_of_labels=4))


@query(sql.with_(*PLAN) + _input_sql("greatest(160, len(input_values))"))
def pad_max_length(spark: SparkSession, folder: str) -> DataFrame:
    """Padding to a fixed length does not cut what is longer."""
    return _input_rows(_padded(spark, folder, padding="max_length", max_length=160, max_length_labels=16))


@query(sql.with_(_batches("documents", "doc_id", "n_chars"), f"""
pol AS (SELECT 'grouped' AS policy, batch_id, len FROM plan UNION ALL SELECT 'shuffled', o // {BATCH}, len FROM sh)""",
                 "b AS (SELECT policy, batch_id, max(len) * count(*) AS padded, sum(len) AS real FROM pol GROUP BY 1, 2)") + """
SELECT policy, count(*) AS n_batches, sum(padded)::BIGINT AS padded, sum(real)::BIGINT AS real,
       (sum(padded) - sum(real))::BIGINT AS waste FROM b GROUP BY policy""")
def padding_waste(spark: SparkSession, folder: str) -> DataFrame:
    """Padding with and without grouping by length."""
    docs = table(spark, folder, "documents", "doc_id", "n_chars")
    grouped = batching.length_batches(docs, "doc_id", "n_chars", BATCH, SEED).select(
        F.lit("grouped").alias("policy"), "batch_id", "n_chars")
    shuffled = ordering.seeded_shuffle(docs, "doc_id", SEED).select(
        F.lit("shuffled").alias("policy"), F.floor(F.col("position") / BATCH).alias("batch_id"), "n_chars")
    return batching.padding_waste(grouped.unionByName(shuffled), "batch_id", "n_chars")


@query(sql.with_(sql.SIGNALS) + """
SELECT utt_id, c AS chunk, len(x)::BIGINT AS n, round(list_sum(x::DOUBLE[]), 6) AS total FROM (
  SELECT utt_id, c, input_values[c * 10 + 1 : c * 10 + 10] AS x
  FROM (SELECT utt_id, input_values, unnest(range(0, (len(input_values) + 9) // 10)) AS c FROM sig))""")
def chunk_arrays(spark: SparkSession, folder: str) -> DataFrame:
    rows = fixtures.signals(spark, folder).select(
        "utt_id", F.posexplode(arrays.cut(F.col("input_values"), 10)).alias("chunk", "x"))
    return rows.select("utt_id", F.col("chunk").cast("bigint").alias("chunk"), F.size("x").cast("bigint").alias("n"),
                       F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double")), 6).alias("total"))
