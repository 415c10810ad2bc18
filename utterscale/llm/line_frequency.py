"""Quality rules with cross-document line frequency, in DataFrame functions only.

Lines are normalised (blanks collapsed, lower case, digits to 0) and hashed; per host the
documents that hold a line are counted; lines above the host's limit are removed, and a
document that keeps too few of its words is rejected.

Defined cases: a null text is empty and fails the base rules, a text of any length is judged
whole; a null host and an empty one are one host; repeated rows are judged alike, each by
itself, and count as one document, as do all rows without an id; an empty table gives no rows;
extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utterscale.functions.arrays import let
from utterscale.llm.common import WHITE, written

WINDOW = 5
SYMBOLS = "#*$%&|<>"  # fixed value


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, WHITE + "+"), "")


def normal_line(line: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(F.regexp_replace(line, WHITE + "+", " ")), "[0-9]", "0"))


def _repeated_words(words: Column) -> Column:
    """Words covered by a window of five words that occurs twice or more in the text.

    Windows are compared by a 64-bit hash. Only texts with a repeat sort their windows.
    """
    def window(w: Column, i: Column) -> Column:
        return F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def repeated(s: Column) -> Column:
            same = lambda e, j: F.coalesce(F.get(s, j)["h"] == e["h"], F.lit(False))
            found = F.filter(s, lambda e, j: same(e, j + 1) | ((j > 0) & same(e, F.greatest(j - 1, F.lit(0)))))
            starts = F.sort_array(F.transform(found, lambda e: e["i"].cast("long")))
            zero = F.struct(F.lit(-WINDOW).cast("long").alias("last"), F.lit(0).cast("long").alias("n"))
            return F.aggregate(
                starts, zero,
                lambda a, p: F.struct(p.alias("last"),
                                      (a["n"] + F.least(p - a["last"], F.lit(WINDOW).cast("long"))).alias("n")),
                lambda a: a["n"])

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(ordered, repeated))

    def counted(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: window(w, i))
        return F.when(F.size(w) < WINDOW, F.lit(0).cast("long")).otherwise(let(windows, covered))

    return counted(words)


def _stats(docs: DataFrame, host: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), text.alias("text"))
    worded = F.filter(F.split("text", "\n"), lambda line: line.rlike("[^ \\t\\n\\x0B\\f\\r]"))
    return rows.select(
        "doc_id", "host", F.xxhash64("text").alias("text_hash"), "text",
        let(words_of(F.col("text")), lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"), _repeated_words(w).alias("n_repeat_words"))).alias("w"),
        F.length(F.regexp_replace("text", WHITE + "+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        let(worded, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ).select("doc_id", "host", "text_hash", "text", "w.n_words", "word_chars", "n_symbols", "n_dup_lines",
             "w.n_repeat_words")


def _lines(docs: DataFrame, host: str) -> DataFrame:
    """``doc_id, host, text_hash, pos, line, words``: every line that has a word."""
    rows = docs.select("doc_id", F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"),
                       F.coalesce("text", F.lit("")).alias("text"))
    return (rows.select("doc_id", "host", F.xxhash64("text").alias("text_hash"),
                        F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
            .select("doc_id", "host", "text_hash", "pos", F.xxhash64(normal_line(F.col("raw"))).alias("line"),
                    F.size(words_of(F.col("raw"))).cast("long").alias("words"))
            .where(F.col("words") > 0))


def _candidates(docs: DataFrame, host: str, min_docs: int) -> DataFrame:
    """The rows of ``_lines`` whose line may be held by more than ``min_docs`` documents of the host.

    Hashes are made distinct inside a row before rows are counted, so the counts are plain
    sums, combined before the shuffle: a hot host or line sends one row per task. Rows are at
    least as many as documents, so no line is lost.
    """
    rows = docs.select(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"),
                       F.coalesce("text", F.lit("")).alias("text"))
    worded = F.filter(F.split("text", "\n"), lambda line: line.rlike("[^ \\t\\n\\x0B\\f\\r]"))
    hashes = F.array_distinct(F.transform(worded, lambda line: F.xxhash64(normal_line(line))))
    counts = (rows.select("host", F.explode(hashes).alias("line")).groupBy("host", "line")
              .agg(F.count("*").alias("n")).where(F.col("n") > min_docs))
    return _lines(docs, host).join(counts.drop("n"), ["host", "line"], "left_semi")


def _frequent(docs: DataFrame, candidates: DataFrame, host: str, min_docs: int, share: float) -> DataFrame:
    """``host, line`` held by more than the limit; documents are counted once, whatever their rows."""
    sizes = docs.groupBy(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host")).agg(
        F.count_distinct(F.struct("doc_id")).alias("docs"))
    counts = candidates.groupBy("host", "line").agg(F.count_distinct(F.struct("doc_id")).alias("n")).where(F.col("n") > min_docs)
    return counts.join(sizes, "host").where(F.col("n") > F.col("docs") * share).select("host", "line")


def frequent_lines(docs: DataFrame, host: str = "source", min_docs: int = 20, share: float = 0.01) -> DataFrame:
    """``host, line``: hashes of lines held by more than ``max(min_docs, share * documents of the host)``."""
    return _frequent(docs, _candidates(docs, host, min_docs), host, min_docs, share)


def judged(docs: DataFrame, host: str = "source", min_docs: int = 20, share: float = 0.01, min_words: int = 10,
           keep_share: float = 0.5) -> DataFrame:
    """One row per document: the base figures, ``removed_lines`` (0-based line numbers),
    ``removed_words``, ``base_failed`` and ``kept``, beside ``doc_id, host, text``. Runs a job when called."""
    candidates = written(_candidates(docs, host, min_docs), "candidate-lines")
    frequent = _frequent(docs, candidates, host, min_docs, share)
    gone = (candidates.join(frequent, ["host", "line"], "left_semi")
            .groupBy("doc_id", "host", "text_hash")
            .agg(F.sort_array(F.collect_set(F.struct("pos", "words"))).alias("gone")))
    base = _stats(docs, host).alias("b")
    gone = gone.alias("g")
    same = ((F.col("b.doc_id").eqNullSafe(F.col("g.doc_id"))) & (F.col("b.host") == F.col("g.host"))
            & (F.col("b.text_hash") == F.col("g.text_hash")))
    removed = F.coalesce(F.aggregate("gone", F.lit(0).cast("long"), lambda a, x: a + x["words"]), F.lit(0))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words")
    return (base.join(gone, same, "left")
            .select("b.*", removed.cast("long").alias("removed_words"),
                    F.coalesce(F.transform("gone", lambda x: x["pos"]), F.array().cast("array<int>"))
                    .alias("removed_lines"))
            .withColumn("base_failed", failed)
            .withColumn("kept", ~failed & (left >= min_words) & (left >= F.col("n_words") * keep_share)))


def cleaned(docs: DataFrame, **limits) -> DataFrame:
    """``doc_id, host, text`` of the kept documents, without their frequent lines."""
    rows = judged(docs, **limits).where("kept")
    text = let(F.col("removed_lines"), lambda gone: F.array_join(
        F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains(gone, i)), "\n"))
    return rows.select("doc_id", "host", F.when(F.size("removed_lines") == 0, F.col("text")).otherwise(text).alias("text"))
