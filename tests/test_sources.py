"""Readers, writers, configurations, validation and streams."""

import pytest
from pyspark.sql import functions as F

from utterscale.operators import validation
from utterscale.operators.validation import Rule
from utterscale.sources import corpora, eventlog, files, runconfig, sheets
from utterscale.sources.shared import shared_folder
from utterscale.streaming import jobs


def test_files(spark, tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    (tmp_path / "deep" / "b.tar.txt").write_text("x")
    (tmp_path / "deep" / "er" / "c.csv").write_text("1,2")
    (tmp_path / "deep" / "d.bin").write_text("no")
    only_text = files.list_files(spark, str(tmp_path))
    assert sorted(r["stem"] for r in only_text.collect()) == ["a", "b.tar"]
    both = files.list_files(spark, str(tmp_path), ["csv", "txt"]).orderBy("format_order", "name").collect()
    assert [r["name"] for r in both] == ["c.csv", "a.txt", "b.tar.txt"]
    assert {r["text"] for r in files.read_texts(spark, str(tmp_path)).collect()} == {"one\ntwo\n", "x"}
    assert files.read_lines(spark, str(tmp_path)).count() == 3


def test_prepared_once(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    for _ in range(2):
        assert corpora.prepared(spark, str(tmp_path), {"a": 1}, build).count() == 3
    corpora.prepared(spark, str(tmp_path), {"a": 2}, build)
    assert len(built) == 2


def test_split_is_pruned(spark, tmp_path):
    rows = spark.range(10).withColumn("split", F.when(F.col("id") < 3, "eval").otherwise("train"))
    corpora.save_dataset(rows, str(tmp_path / "d"))
    one = corpora.load_split(spark, str(tmp_path / "d"), "eval")
    assert one.count() == 3
    assert "PartitionFilters: [isnotnull(split" in one._jdf.queryExecution().executedPlan().toString()


def test_csv_keeps_quotes_blanks_and_newlines(spark, tmp_path):
    rows = [(1, ' a "b", c \nd'), (2, "-"), (3, "\\")]
    sheets.write_csv(spark.createDataFrame(rows, "i int, t string"), str(tmp_path / "c"))
    back = sheets.read_csv(spark, str(tmp_path / "c"), "i int, t string")
    assert sorted((r["i"], r["t"]) for r in back.collect()) == rows


def test_prediction_sheet_files(spark, tmp_path):
    pairs = spark.createDataFrame([("A", 5, "h5", "r5"), ("A", 2, "h2", "r2")],
                                  "system string, utt_id bigint, hyp string, ref string")
    scored = spark.createDataFrame([("A", 0.25, 0.5)], "system string, wer double, bleu double")
    sheet = sheets.prediction_sheet(pairs, scored)
    sheets.write_sheet(sheet, str(tmp_path / "s"))
    lines = {r["value"] for r in spark.read.text(str(tmp_path / "s")).collect()}
    assert lines == {"WER: 0.250000\t BLEU:0.500000", "0\th2\tr2", "1\th5\tr5"}


def test_event_log(spark, tmp_path):
    rows = spark.createDataFrame([(1, "start", "info"), (2, "odd", "loud")], "n int, e string, l string")
    eventlog.append(eventlog.log_lines(rows, F.col("e"), F.col("l"), ["n"]), str(tmp_path / "log"))
    back = eventlog.read(spark, str(tmp_path / "log"), "event string, n int").collect()
    assert {tuple(r) for r in back} == {("info", "start", 1), ("notset", "odd", 2)}


def test_run_configuration(spark):
    assert len(runconfig.KEYS) == 28
    assert runconfig.RunConfig.from_json('{"seed": 5}')["seed"] == 5
    assert runconfig.RunConfig.from_json("{}")["batch_size"] == 2
    with pytest.raises(ValueError, match="speed"):
        runconfig.RunConfig.from_json('{"speed": 5}')
    rows = spark.createDataFrame([('{"checkpoint": null, "seed": null, "x": 1}',)], "config string")
    row = runconfig.expand(rows).first()
    assert row["seed"] is None and row["n_steps"] == 30 and row["unknown_keys"] == ["x"]
    assert row["train_corpora"] == [["corpus", "train"]]


@pytest.mark.parametrize("rule, good, bad", [
    (Rule("float"), ["1", "1.5", "1e3"], ["true", '"1"', "null", "[]"]),
    (Rule("real"), ["1.5", "1e3"], ["1", "true", "null"]),
    (Rule("int"), ["1", "-3"], ["1.5", "true", "null", '"1"']),
    (Rule("str"), ['"a"'], ["1", "null", "{}"]),
    (Rule("bool"), ["true", "false"], ["0", '"true"', "null"]),
    (Rule("list"), ["[]", "[1]"], ["{}", "null", '"[]"']),
    (Rule("dict"), ["{}", '{"a": 1}'], ["[]", "null"]),
    (Rule("list", each=Rule("int")), ["[]", "[1, 2]"], ['[1, "a"]', "[null]", "1"]),
    (Rule("list", each=Rule("list", each=Rule("str"))), ['[["a"], []]'], ['[["a", 1]]', '["a"]']),
    (Rule("dict", members={"a": Rule("dict", members={"b": Rule("bool")})}), ['{"a": {"b": true}}'],
     ['{"a": {"b": 1}}', '{"a": 1}', "{}"]),
    (Rule("int", nullable=True), ["1", "null"], ["true", "1.0e0"]),
    (Rule("dict", nullable=True, members={"a": Rule("str")}), ["null", '{"a": "x"}'], ['{"a": 1}', "{}"]),
])
def test_rules(spark, rule, good, bad):
    rows = spark.createDataFrame([(f'{{"v": {v}}}', v in good) for v in good + bad], "j string, want boolean")
    wrong = validation.validate(rows, "j", {"v": rule}).where((F.size("violations") == 0) != F.col("want"))
    assert wrong.collect() == []


def test_broken_json_and_coercion(spark):
    rows = spark.createDataFrame([("{",), ('{"v": 2}',), ('{"v": true}',)], "j string")
    assert validation.validate(rows, "j", {"v": Rule("int")}).first()["violations"] == ["json"]
    got = rows.select(validation.coerce_float(F.col("j"), "v").alias("x")).collect()
    assert [r["x"] for r in got] == [None, 2.0, None]


def test_shared_folder_comes_from_the_session(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark, "x").startswith(base.rstrip("/"))
    assert shared_folder(spark, "x") != shared_folder(spark, "x")


def test_stream_over_several_batches_equals_batch(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    events.repartitionByRange(6, "ts").write.parquet(str(tmp_path / "events.parquet"))
    stream = (spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1)
              .parquet(str(tmp_path / "events.parquet")))
    timed = jobs.with_event_time(stream, "ts", "40 days")
    got = jobs.current(jobs.windowed_counts(timed, ["event_type"]), "t", ["window_start", "event_type"])
    want = jobs.windowed_counts(events.withColumn("ts", F.col("ts").cast("timestamp")), ["event_type"])
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    best = jobs.running_best(stream, "user_id", "value", ["ts", "event_id"], 1.0)
    kept = jobs.current(best, "b", ["user_id"])
    assert kept.count() == events.select("user_id").distinct().count()
    joined = kept.join(events.groupBy("user_id").agg(F.min("value").alias("m")), "user_id")
    assert joined.where(F.col("best") != F.least(F.lit(1.0), "m")).count() == 0


def test_streams_read_folders_in_any_order(spark, small, tmp_path, monkeypatch):
    from functools import partial

    from utterscale.plans import catalog

    events = spark.read.parquet(f"{small}/events.parquet").orderBy("ts").collect()
    schema = spark.read.parquet(f"{small}/events.parquet").schema
    step = len(events) // 4 + 1
    for part in range(3, -1, -1):  # the newest rows come first, one file per batch
        rows = spark.createDataFrame(events[part * step:(part + 1) * step], schema)
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(jobs, "read_table_stream", partial(jobs.read_table_stream, files_per_batch=1))
    for name in ("stream_event_counts", "stream_best"):
        query = catalog.queries()[name]
        assert sorted(map(tuple, query(spark, str(tmp_path)).collect())) == sorted(map(tuple, query(spark, small).collect()))


def test_broken_configurations_take_no_defaults(spark):
    given = ['{"seed":1', '{"seed":"abc"}', "[1]", None, '{"seed":null}', '{"fp16":3,"n_steps":7}', "{}"]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(given)], "i int, config string")
    found = {r["i"]: (r["error"], r["seed"], r["n_steps"]) for r in runconfig.expand(rows).select("i", "error", "seed", "n_steps").collect()}
    assert found == {0: ("json", None, None), 1: ("type: seed", None, None), 2: ("json", None, None), 3: ("json", None, None),
                     4: (None, None, 30), 5: ("type: fp16", None, 7), 6: (None, 123, 30)}


def test_integers_beyond_64_bits(spark):
    given = ['{"a":12345678901234567890}', '{"a":1.0}', '{"a":5}', '{"a":12345678901234567890.5}']
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(given)], "i int, j string")
    for kind, wanted in {"int": [0, 2], "real": [1, 3], "float": [0, 1, 2, 3]}.items():
        kept = validation.validate(rows, "j", {"a": validation.Rule(kind)}).where("size(violations) = 0")
        assert sorted(r["i"] for r in kept.collect()) == wanted


def _months(spark, folder, files):
    """Half a year of rows, nearly in order, one file per batch; some come far too late."""
    day = "timestamp '2024-01-01'"
    rows = spark.range(3000).selectExpr(
        "id AS event_id", f"{day} + make_dt_interval(0, id + IF(id % 97 = 5, -400, -(id * 7) % 20)) AS ts",
        "IF(id % 3 = 0, 'a', 'b') AS event_type", "id % 4 AS user_id", "abs(hash(id)) % 1000 / 900D AS value")
    kept = rows.collect()
    for part in range(files):
        cut = [r for r in kept if r["event_id"] * files // 3000 == part]
        spark.createDataFrame(cut, rows.schema).coalesce(1).write.mode("append").parquet(folder)
    return rows


def test_late_rows_and_windows_add_up(spark, tmp_path):
    rows = _months(spark, f"{tmp_path}/events.parquet", 12)
    source = jobs.read_table_stream(spark, str(tmp_path), "events", files_per_batch=1)
    in_time, late = jobs.route_late(source, "t", "ts", "2 days")
    assert 20 < jobs.read_side(spark, late, source).count() < 200
    timed = jobs.with_event_time(jobs.read_routed(spark, in_time, source, 1), "ts", "2 days")
    counts = jobs.windowed_counts(timed, ["event_type"])
    sizes = []
    query = (counts.writeStream.outputMode("update").foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}"))
             .option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start())
    query.awaitTermination()
    for progress in query.recentProgress:
        sizes += [s["numRowsTotal"] for s in progress["stateOperators"]]
        assert sum(s["numRowsDroppedByWatermark"] for s in progress["stateOperators"]) == 0
    windows = rows.selectExpr("date_trunc('day', ts)", "event_type").distinct().count()
    assert len(sizes) >= 12 and max(sizes) < windows / 3  # closed windows leave the state
    live = jobs.latest(spark, f"{tmp_path}/out", ["window_start", "event_type"])
    rest = jobs.windowed_counts(jobs.with_event_time(jobs.read_side(spark, late, source), "ts"), ["event_type"])
    both = live.unionByName(rest).groupBy("window_start", "event_type").agg(F.sum("n").alias("n"))
    want = jobs.windowed_counts(rows, ["event_type"])
    assert both.exceptAll(want).count() == 0 and want.exceptAll(both).count() == 0


def test_history_stream_equals_the_batch_and_replays(spark, tmp_path, monkeypatch):
    from utterscale.operators.evaluations import best_so_far

    rows = _months(spark, f"{tmp_path}/events.parquet", 5).selectExpr("user_id AS run", "event_id", "ts", "value AS wer")
    rows = rows.withColumn("ts", F.timestamp_seconds(F.col("event_id") * 3600))
    twice = jobs._each_batch
    columns = ["run", "event_id", "eval_nr", "wer", "best_before", "saved"]
    want = best_so_far(rows, ["ts", "event_id"]).select(columns)
    stream = jobs.read_table_stream(spark, str(tmp_path), "events", files_per_batch=1).selectExpr(
        "user_id AS run", "event_id", "timestamp_seconds(event_id * 3600) AS ts", "value AS wer")
    monkeypatch.setattr(jobs, "_each_batch", lambda s, path, step: twice(s, path, lambda b, n: (step(b, n), step(b, n))))
    numbered, _ = jobs.history(stream, "h", ["ts", "event_id"])  # every batch runs a second time
    got = spark.read.parquet(numbered).select(columns)
    assert got.count() == 3000 and got.exceptAll(want).count() == 0


def test_runs_close_and_streams_continue(spark, tmp_path):
    schema = "run string, ts timestamp, event_id long, wer double"

    def add(name, *cells):
        table = spark.createDataFrame([(r, None, i, w) for r, _, i, w in cells], schema)
        table.withColumn("ts", F.timestamp_seconds(F.col("event_id") * 86400)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/e.parquet")

    add("x", ("a", 0, 1, 0.9), ("b", 0, 2, 0.8), ("a", 0, 3, 1.5), (None, 0, 3, 0.2))
    stream = jobs.read_table_stream(spark, str(tmp_path), "e", files_per_batch=1)
    path = shared_folder(spark, "closing")
    jobs.history(stream, "c", ["ts", "event_id"], idle="10 days", path=path)
    add("y", ("b", 0, 40, 0.7), ("b", 0, 41, 0.75))
    numbered, closed = jobs.history(stream, "c", ["ts", "event_id"], idle="10 days", path=path)
    got = sorted(((r["run"] or "", r["event_id"], r["eval_nr"], r["best_before"], r["saved"]) for r in spark.read.parquet(numbered).collect()))
    assert got == [("", 3, 1, 1.0, True), ("a", 1, 1, 1.0, True), ("a", 3, 2, 0.9, False), ("b", 2, 1, 1.0, True),
                   ("b", 40, 2, 0.8, True), ("b", 41, 3, 0.7, False)]
    assert sorted((r["run"] or "", r["n"], r["best"]) for r in spark.read.parquet(closed).collect()) == [("", 1, 0.2), ("a", 2, 0.9)]
    assert [r["run"] for r in spark.read.parquet(f"{path}/open/batch=1").collect()] == ["b"]


def test_only_new_and_changed_files_are_prepared(spark, tmp_path):
    seen = []

    def prepare(rows):
        seen.append(1)
        return rows.withColumn("x", F.col("id") * 10)

    def call(settings=None):
        rows, fresh = corpora.prepared_files(spark, f"{tmp_path}/cache", f"{tmp_path}/in", settings or {"a": 1}, prepare)
        return sorted(r["x"] for r in rows.collect()), fresh

    spark.range(3).coalesce(1).write.parquet(f"{tmp_path}/in/a b+c")
    assert call() == ([0, 10, 20], 1) and call() == ([0, 10, 20], 0) and len(seen) == 1
    spark.range(3, 5).coalesce(1).write.parquet(f"{tmp_path}/in/y")
    assert call() == ([0, 10, 20, 30, 40], 1)
    spark.range(7, 8).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/in/y")  # another file in its place
    assert call() == ([0, 10, 20, 70], 1)
    assert call({"a": 2}) == ([0, 10, 20, 70], 2) and len(seen) == 4

    def fails(rows):
        return rows.withColumn("x", F.raise_error(F.lit("no")).cast("long"))

    spark.range(9, 10).coalesce(1).write.parquet(f"{tmp_path}/in/z")
    with pytest.raises(Exception, match="no"):
        corpora.prepared_files(spark, f"{tmp_path}/cache", f"{tmp_path}/in", {"a": 1}, fails)
    assert call() == ([0, 10, 20, 70, 90], 1)


def test_serialise_round_trip(spark):
    rules = {"i": Rule("int"), "r": Rule("real"), "f": Rule("float", nullable=True), "s": Rule("str"), "b": Rule("bool"),
             "l": Rule("list", each=Rule("list", each=Rule("int"))), "d": Rule("dict", members={"x": Rule("str", nullable=True)})}
    good = '{"i": 12345678901234567890, "r": 1.5e3, "f": 2, "s": "a \\"q\\" ä", "b": true, "l": [[1], []], "d": {"x": null, "more": 1}, "z": 0}'
    bad = [good.replace("1.5e3", "1"), good.replace("[[1], []]", '[["1"]]'), good.replace("true", "1"), "{", "null"]
    rows = spark.createDataFrame([(i, j) for i, j in enumerate([good, *bad, None])], "n int, j string")
    out = {r["n"]: r["serialised"] for r in validation.serialise(rows, "j", rules).collect()}
    assert [out[i] for i in range(1, 7)] == [None] * 6
    import json
    back = json.loads(out[0])
    assert back == {"i": 12345678901234567890, "r": 1500.0, "f": 2.0, "s": 'a "q" ä', "b": True, "l": [[1], []], "d": {"x": None}}
    again = validation.serialise(spark.createDataFrame([(out[0],)], "j string"), "j", rules).first()
    assert again["violations"] == [] and again["serialised"] == out[0]


@pytest.mark.parametrize("cell", ["plain", "a\tb\nc\rd", "\\t \\\\n \\", "\\\n", "", None, " x "])
def test_cells_stay_on_one_line(spark, tmp_path, cell):
    rows = spark.createDataFrame([(1, cell)], "i int, t string")
    one = rows.select(sheets.escaped(F.col("t")).alias("e"), sheets.unescaped(sheets.escaped(F.col("t"))).alias("u")).first()
    assert one["u"] == cell and (cell is None or not set(one["e"]) & set("\t\n\r"))
    sheets.write_csv(rows, str(tmp_path / "c"), one_line=True)
    assert (sheets.read_csv(spark, str(tmp_path / "c"), "i int, t string", one_line=True).first()["t"] or None) == (cell or None)


def test_large_one_line_sheets_are_split(spark, tmp_path):
    rows = spark.range(3000).select("id", F.repeat(F.lit("a\n"), 40).alias("t")).coalesce(1)
    sheets.write_csv(rows, str(tmp_path / "c"), one_line=True)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50k")
    back = sheets.read_csv(spark, str(tmp_path / "c"), "id bigint, t string", one_line=True)
    assert back.select(F.spark_partition_id().alias("p")).distinct().count() > 3 and back.exceptAll(rows).count() == 0
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_token_sheet_header(spark):
    rows = spark.createDataFrame([(5, [1, 0]), (2, [2])], "utt_id bigint, ids array<int>")
    scored = spark.createDataFrame([(0.5, 0.25)], "wer double, bleu double")
    tokens = F.array(F.lit("[PAD]"), F.lit("a"), F.lit("\t"))
    got = sorted(tuple(r) for r in sheets.token_sheet(rows, F.col("ids"), tokens, scores=scored).collect())
    assert got == [(-1, "WER: 0.500000\t BLEU:0.250000"), (0, "0\t\\t"), (1, "1\ta [PAD]")]
