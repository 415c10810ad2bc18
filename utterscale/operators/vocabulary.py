"""Character vocabulary, label encoding and decoding."""

from __future__ import annotations

import json
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from utterscale.functions import arrays, text

# Special tokens.
UNK, PAD, DELIMITER = "[UNK]", "[PAD]", "|"
SENTENCE_MARKS = 2  # fixed value: tokens a tokenizer numbers between the vocabulary and ``[PAD]``
PLACES = Decimal(1 << 31)  # positions of a row in the packed order of occurrences
LOWEST = Decimal(1 << 63)  # makes 64-bit row ids positive there
PAGE = 8  # bits of a code point within its page of the encoding table


def char_freq(rows: DataFrame, column: str, row_id: str) -> DataFrame:
    """``ch, freq, first_row, first_pos`` per code point; ``row_id`` is an integer.

    Row and position of an occurrence make one number of fixed width, so the first one is a
    plain minimum: hash aggregation shrinks the characters to the alphabet before the shuffle,
    and nothing is sorted.
    """
    start = (F.col(row_id).cast("decimal(20,0)") + F.lit(LOWEST)) * F.lit(PLACES)
    each = rows.where(F.col(column) != "").select(
        start.cast("decimal(32,0)").alias("_start"), F.posexplode(F.split(column, "")).alias("_pos", "ch"))
    found = each.groupBy("ch").agg(F.count("*").alias("freq"), F.min(F.col("_start") + F.col("_pos")).alias("_first"))
    return found.select("ch", "freq", (F.floor(F.col("_first") / F.lit(PLACES)) - F.lit(LOWEST)).cast("bigint").alias("first_row"),
                        (F.col("_first") % F.lit(PLACES)).cast("bigint").alias("first_pos"))


def build(freq: DataFrame, min_freq: int = 1, compat: bool = True) -> DataFrame:
    """``token, id, freq`` in order of first occurrence.

    ``compat`` numbers before filtering (gaps stay) and gives ``[UNK]`` the number of
    kept entries, which may collide. Otherwise ids are dense and ``[UNK]``, ``[PAD]``
    follow. The window holds one row per code point of Unicode at most.
    """
    number = F.row_number().over(Window.orderBy("first_row", "first_pos")).cast("bigint")
    # the blank takes the delimiter's name, so a real delimiter gives way to it
    has_blank = F.max((F.col("ch") == " ") & (F.col("freq") > min_freq)).over(Window.partitionBy())
    named = freq.withColumn("_gives_way", has_blank & (F.col("ch") == DELIMITER))
    kept = (F.col("freq") > min_freq) & ~F.col("_gives_way")
    numbered = named.withColumn("id", number).where(kept) if compat else named.where(kept).withColumn("id", number)
    entries = numbered.select(F.when(F.col("ch") == " ", DELIMITER).otherwise(F.col("ch")).alias("token"), "id", "freq")
    last = F.coalesce(F.max("id"), F.lit(0))
    # counted through the id: both branches then read the same numbered rows, and the characters are counted once
    unk = F.count_if(F.col("id") > 0) if compat else last + 1
    special = [(UNK, unk)] if compat else [(UNK, unk), (PAD, last + 2)]
    extra = entries.agg(F.array(*[F.struct(F.lit(t).alias("token"), i.cast("bigint").alias("id"))
                                  for t, i in special]).alias("s")).select(F.inline("s"))
    return entries.unionByName(extra.withColumn("freq", F.lit(None).cast("bigint")))


def with_pad(vocab: DataFrame) -> DataFrame:
    """The vocabulary as a tokenizer completes it: ``[PAD]`` behind the tokens and the sentence
    marks, unless it has a number already. A gap's character may share it."""
    missing = F.sum((F.col("token") == PAD).cast("int")) == 0
    extra = vocab.agg((F.count("*") + SENTENCE_MARKS).alias("id"), F.coalesce(missing, F.lit(True)).alias("_m")).where("_m")
    return vocab.unionByName(extra.select(F.lit(PAD).alias("token"), "id", F.lit(None).cast("bigint").alias("freq")))


def save_once(vocab: DataFrame, path: str) -> None:
    """Write the vocabulary unless there is one already."""
    vocab.coalesce(1).write.mode("ignore").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def lookup(vocab: DataFrame) -> dict[str, int]:
    """Vocabulary as a mapping: one entry per code point at most, so it fits the driver."""
    return {r["token"]: r["id"] for r in vocab.select("token", "id").collect()}


def _constant(value: list, kind: str) -> Column:
    """One literal of any size; written as JSON, which the optimizer folds."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def encode(value: Column, ids: dict[str, int]) -> Column:
    """Label ids of a text; blanks take the delimiter's id, unknown characters ``[UNK]``'s.

    A character is found by its code point in two array steps, whatever the alphabet: the
    high bits name a page, pages without characters are left out.
    """
    known = {(" " if t == DELIMITER else t): i for t, i in ids.items() if len(t) == 1}
    if DELIMITER in ids:
        known[DELIMITER] = ids[DELIMITER]
    pages: dict[int, list[int | None]] = {}
    for c, i in known.items():
        pages.setdefault(ord(c) >> PAGE, [None] * (1 << PAGE))[ord(c) & ((1 << PAGE) - 1)] = i
    place = {page: k for k, page in enumerate(pages)}
    index = _constant([place.get(page) for page in range(max(pages, default=-1) + 1)], "array<int>")
    table = _constant(list(pages.values()), "array<array<int>>")

    def number(code: Column) -> Column:
        page = F.get(table, F.get(index, F.shiftright(code, PAGE)))
        return F.coalesce(F.get(page, code.bitwiseAND((1 << PAGE) - 1)), F.lit(ids[UNK]).cast("int"))

    return F.transform(F.transform(text.chars(value), F.ascii), number)


def tokens_by_id(ids: dict[str, int]) -> Column:
    """Array indexed by id. When an id is shared, the character wins over special tokens."""
    table: list[str] = [""] * (max(ids.values()) + 1)
    for token, i in sorted(ids.items(), key=lambda kv: kv[0] not in (UNK, PAD)):
        table[i] = token
    return _constant(table, "array<string>")


def decode(ids_column: Column, ids: dict[str, int], pad_id: int, collapse: bool = False, clean: bool = True) -> Column:
    """Ids to text; positions marked as ignored are pads; ``clean`` takes out blanks before punctuation."""
    return arrays.ids_to_text(arrays.restore_pad(ids_column, pad_id), tokens_by_id(ids), pad_id,
                              DELIMITER, collapse, clean)


def coverage(rows: DataFrame, column: str, ids: dict[str, int], by: list[str]) -> DataFrame:
    """Per group: labels, share of unknown ones, and texts that survive the round trip."""
    coded = rows.withColumn("_l", encode(F.col(column), ids))
    pad_id = max(ids.values()) + 1
    return (coded.withColumns({
        "_unk": F.size(F.filter("_l", lambda x: x == ids[UNK])),
        "_same": (decode(F.col("_l"), ids, pad_id, clean=False) == F.trim(column)).cast("int")})
        .groupBy(*by).agg(F.sum(F.size("_l")).alias("labels"), F.sum("_unk").alias("unknown"),
                          F.sum("_same").alias("round_trips"), F.count("*").alias("n_rows"))
        .withColumn("unk_share", F.col("unknown") / F.col("labels")))


def save_json(vocab: DataFrame, path: str) -> None:
    """One JSON object ``{token: id}``, written once."""
    as_map = vocab.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("token", "id")))).alias("vocab"))
    as_map.select(F.to_json("vocab").alias("value")).write.mode("ignore").text(path)
