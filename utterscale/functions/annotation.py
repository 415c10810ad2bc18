"""Transcript mark-up: word tags ``@g @? @!`` and the marks ``@! - -- (...)``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from utterscale.functions.text import collapse_blanks, words

# Mark-up of annotated transcripts.
WORD_TAG = r"(?s)^(.+)@([g?!])([.,;:!?…]*)$"
TAG_NAMES = {"g": "l1", "?": "guess", "!": "error"}
MARKS = {"@!": "missing", "-": "repetition", "--": "reformulation", "(...)": "pause", "(…)": "pause"}


MARK = r"^(@!|--?|\(\.\.\.\)|\(…\))[.,;:!?…]*$"


def _mark(token: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in MARKS.items() for x in kv])
    return F.try_element_at(table, F.regexp_extract(token, MARK, 1))


def tokens(text: Column) -> Column:
    """Transcript tokens; a run of blanks or tabs counts as one separator."""
    return F.filter(words(F.trim(collapse_blanks(text))), lambda w: w != "")


def parse_annotations(text: Column) -> Column:
    """``ARRAY<STRUCT<word, tag>>``; a mark that stands for no word has a null word."""
    tags = F.create_map(*[F.lit(x) for kv in TAG_NAMES.items() for x in kv])

    def parse(token: Column) -> Column:
        tagged = token.rlike(WORD_TAG)
        word = F.when(tagged, F.concat(F.regexp_extract(token, WORD_TAG, 1), F.regexp_extract(token, WORD_TAG, 3)))
        return (F.when(_mark(token).isNotNull(),
                       F.struct(F.lit(None).cast("string").alias("word"), _mark(token).alias("tag")))
                .otherwise(F.struct(F.coalesce(word, token).alias("word"),
                                    F.when(tagged, F.try_element_at(tags, F.regexp_extract(token, WORD_TAG, 2)))
                                    .alias("tag"))))

    return F.transform(tokens(text), parse)


def clean_text(parsed: Column) -> Column:
    """Words of a parsed transcript without any mark-up."""
    return F.array_join(F.transform(F.filter(parsed, lambda p: p["word"].isNotNull()), lambda p: p["word"]), " ")
