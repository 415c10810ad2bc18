"""Comma-separated tables, prediction sheets and token sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from utterscale.functions.arrays import ids_to_tokens
from utterscale.operators.ordering import number_rows
from utterscale.sources.shared import shared_folder


# What a cell on one line may not hold, and what stands for it; the escape comes first.
ESCAPES = [("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")]


def escaped(cell: Column) -> Column:
    """The cell without tabs and line ends."""
    for plain, written in ESCAPES:
        cell = F.replace(cell, F.lit(plain), F.lit(written))
    return cell


def unescaped(cell: Column) -> Column:
    """The cell that ``escaped`` was given. The escape itself is set aside first, as a character that stays out of texts."""
    hidden = F.lit("\ufdd0")
    cell = F.replace(cell, F.lit("\\\\"), hidden)
    for plain, written in ESCAPES[1:]:
        cell = F.replace(cell, F.lit(written), F.lit(plain))
    return F.replace(cell, hidden, F.lit("\\"))


def _texts(schema: StructType) -> list[str]:
    return [f.name for f in schema.fields if f.dataType.simpleString() == "string"]


def read_csv(spark: SparkSession, path: str, schema: str, one_line: bool = False) -> DataFrame:
    """UTF-8, comma, header, quoted cells that may hold newlines.

    Such a file is one task, whatever its size. With ``one_line``, as ``write_csv`` writes it,
    every row is a line and large files are split between tasks.
    """
    rows = spark.read.schema(schema).csv(path, sep=",", header=True, multiLine=not one_line, quote='"', escape='"',
                                         encoding="UTF-8", ignoreLeadingWhiteSpace=False,
                                         ignoreTrailingWhiteSpace=False)
    return rows.withColumns({c: unescaped(F.col(c)) for c in _texts(rows.schema)}) if one_line else rows


def write_csv(rows: DataFrame, path: str, one_line: bool = False) -> None:
    """``one_line`` writes line ends, tabs and backslashes of texts as escapes."""
    if one_line:
        rows = rows.withColumns({c: escaped(F.col(c)) for c in _texts(rows.schema)})
    rows.write.mode("overwrite").csv(path, sep=",", header=True, quote='"', escape='"', encoding="UTF-8",
                                     ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def score_line() -> Column:
    return F.format_string("WER: %.6f\t BLEU:%.6f", "wer", "bleu")


def prediction_sheet(pairs: DataFrame, scores: DataFrame, evaluation: str = "system") -> DataFrame:
    """``evaluation, idx, line``: a score header (idx -1), then ``idx, hyp, ref`` lines."""
    # the keys are written first: numbering samples and reads them, and would make the pairs each time
    path = shared_folder(pairs.sparkSession, "keys")
    pairs.select(evaluation, "utt_id").write.parquet(path)
    keys = pairs.sparkSession.read.parquet(path)
    numbers = number_rows(keys, [evaluation], ["utt_id"])
    numbered = pairs.join(numbers, [evaluation, "utt_id"]).withColumn("idx", F.col("idx") - 1)
    body = numbered.select(evaluation, "idx", F.concat_ws(
        "\t", F.col("idx").cast("string"), *[F.coalesce(escaped(F.col(c)), F.lit("")) for c in ("hyp", "ref")]).alias("line"))
    head = scores.select(evaluation, F.lit(-1).cast("bigint").alias("idx"), score_line().alias("line"))
    return head.unionByName(body)


def write_sheet(sheet: DataFrame, path: str, evaluation: str = "system") -> None:
    """Text files per evaluation; every file holds a range of indexes in order."""
    (sheet.repartitionByRange(evaluation, "idx").sortWithinPartitions(evaluation, "idx")
     .select(evaluation, "line").write.mode("overwrite").partitionBy(evaluation).text(path))


def token_sheet(rows: DataFrame, ids: Column, tokens_by_id: Column, row_id: str = "utt_id", scores: DataFrame | None = None) -> DataFrame:
    """``idx, line`` with the ungrouped tokens of every row, pads kept; with ``scores`` (one row) a header at -1."""
    numbers = number_rows(rows.select(row_id), [], [row_id])
    tokens = F.array_join(F.transform(ids_to_tokens(ids, tokens_by_id), escaped), " ")
    body = rows.withColumn("_tokens", tokens).join(numbers, row_id).select(
        (F.col("idx") - 1).alias("idx"),
        F.concat_ws("\t", (F.col("idx") - 1).cast("string"), "_tokens").alias("line"))
    if scores is None:
        return body
    return scores.select(F.lit(-1).cast("bigint").alias("idx"), score_line().alias("line")).unionByName(body)
