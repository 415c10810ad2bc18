"""Transcript text rules: normalising, tokenising, term mapping, number words, mark-up."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from utterscale.functions.arrays import let
from utterscale.functions.numbers_de import cardinal, spell_number

# Letters folded one to one, and the characters that become a blank.
FOLD_FROM = "çáàâéèêíìîóòôúùû" + "-–­/"
FOLD_TO = "caaaeeeiiiooouuu" + "    "
# Fixed value: what may remain in a normalised transcript.
ALLOWED = "abcdefghijklmnopqrstuvwxyz" + "äöü" + "0123456789" + " "
# ``translate`` drops the rest of ASCII while it folds letters. What is then left to a
# regular expression is one small class, several times faster than the whole rule.
ASCII_DROPPED = "".join(c for c in map(chr, range(128)) if c not in ALLOWED + FOLD_FROM + "\t")
NOT_ASCII_ALLOWED = "[^ -~äöü]+"
# Fixed value: dashes that tie a number to a word.
DASHES = "-–­"


def collapse_blanks(text: Column) -> Column:
    """Runs of blanks and tabs become one blank; newlines are not touched."""
    # a lone blank is no match, so only real runs are rewritten
    return F.regexp_replace(text, "[ \t]{2,}|\t", " ")


def normalize(text: Column) -> Column:
    """Lower-case, fold accents, open dashes and slashes, keep a-z äöü 0-9 and blanks."""
    folded = F.translate(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")),
                         FOLD_FROM + "\t" + ASCII_DROPPED, FOLD_TO + " ")
    kept = F.regexp_replace(folded, NOT_ASCII_ALLOWED, "")
    return F.trim(F.regexp_replace(kept, " {2,}", " "))


def words(text: Column) -> Column:
    """Split on single blanks. ``''`` gives ``['']``; two blanks give an empty token."""
    return F.split(text, " ")


def chars(text: Column) -> Column:
    """Code points of a text; the empty text gives an empty array."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))


def strip_unicode(text: Column) -> Column:
    """Strip every Unicode blank, not only U+0020."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def map_terms(text: Column, terms: dict[str, str], lowercase: bool = True) -> Column:
    """Replace whole words by their configured spelling, after optional lower-casing."""
    base = F.lower(text) if lowercase else text
    if not terms:
        return base
    table = F.create_map(*[F.lit(x) for kv in terms.items() for x in kv])
    return F.array_join(F.transform(words(base), lambda w: F.coalesce(F.try_element_at(table, w), w)), " ")


def _spell_part(word: Column, pattern: str) -> Column:
    """Spell group 2 of the first match, keep groups 1 and 3."""
    number = F.regexp_extract(word, pattern, 2)
    return F.when(number != "", F.concat(F.regexp_extract(word, pattern, 1), F.coalesce(cardinal(number), number),
                                         F.regexp_extract(word, pattern, 3))).otherwise(word)


def numbers_to_words(text: Column) -> Column:
    """German number words for number tokens and for numbers tied to a dash."""
    before_dash = rf"(?s)^(.*?)([0-9]+)([{DASHES}].*)$"
    after_dash = rf"(?s)^(.*?[{DASHES}])([0-9]+)(.*)$"

    def spell(word: Column) -> Column:
        return (F.when(word.rlike(r"^[0-9',.]+\n?\z"), spell_number(word))
                .when(word.rlike(rf"[0-9][{DASHES}]|[{DASHES}][0-9]"),
                      let(_spell_part(word, before_dash), lambda w: _spell_part(w, after_dash)))
                .otherwise(word))

    return let(strip_unicode(collapse_blanks(text)), lambda clean: F.when(
        clean.rlike("[0-9]"), F.array_join(F.transform(words(clean), spell), " ")).otherwise(clean))


def as_preprocessor(fn: Callable[[str], str]) -> Callable[[Column], Column]:
    """Wrap a plain ``str -> str`` as an Arrow-batched Column function."""
    @F.pandas_udf("string")
    def apply(series: pd.Series) -> pd.Series:
        return series.map(fn, na_action="ignore")

    return lambda column: apply(column)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    """Base name without its last extension; leading dots never start an extension."""
    name = file_name(path)
    return F.regexp_replace(name, r"(?s)^(\.*[^.].*)\.[^.]*$", "$1")


def recording_id_parts(recording_id: Column) -> Column:
    """``8032_6_B`` -> postal code, grade and (optional) audio id."""
    def part(i: int) -> Column:
        piece = F.split_part(recording_id, F.lit("_"), F.lit(i))
        return F.when(piece != "", piece)

    return F.struct(part(1).alias("postal_code"), part(2).cast("int").alias("grade"), part(3).alias("audio_id"))
