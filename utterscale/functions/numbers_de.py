"""German number words as native Column expressions.

Numbers are cut into groups of three digits; every group is a few array lookups.
Values up to ``MAX_DIGITS`` digits are spelled, longer ones are left to the caller (null).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from utterscale.functions.arrays import let

# German number words.
UNITS = ["", "ein", "zwei", "drei", "vier", "fünf", "sechs", "sieben", "acht", "neun"]
TEENS = ["zehn", "elf", "zwölf", "dreizehn", "vierzehn", "fünfzehn", "sechzehn",
         "siebzehn", "achtzehn", "neunzehn"]
TENS = ["", "", "zwanzig", "dreißig", "vierzig", "fünfzig", "sechzig", "siebzig",
        "achtzig", "neunzig"]
# Names of 10^6, 10^9, ... as (one, many).
SCALES = [("eine Million", "Millionen"), ("eine Milliarde", "Milliarden"),
          ("eine Billion", "Billionen"), ("eine Billiarde", "Billiarden"),
          ("eine Trillion", "Trillionen"), ("eine Trilliarde", "Trilliarden"),
          ("eine Quadrillion", "Quadrillionen"), ("eine Quadrilliarde", "Quadrilliarden")]
# Endings of cardinals and what they become before "te".
ORDINAL_ENDINGS = [("eins", "ers"), ("drei", "drit"), ("acht", "ach"), ("sieben", "sieb"),
                   ("ig", "igs"), ("ert", "erts"), ("end", "ends"), ("ion", "ions"),
                   ("nen", "ns"), ("rden", "rds"), ("rde", "rds")]
MAX_DIGITS = 3 * (len(SCALES) + 2)


def below_hundred() -> list[str]:
    """Words for 0..99, with 0 as the empty string (it is silent inside a number)."""
    words = ["", "eins", *UNITS[2:], *TEENS]
    for ten in range(2, 10):
        words += [TENS[ten]] + [f"{UNITS[u]}und{TENS[ten]}" for u in range(1, 10)]
    return words


def hundreds() -> list[str]:
    return [""] + [f"{u}hundert" for u in UNITS[1:]]


def _lookup(values: list[str], index: Column) -> Column:
    # one literal, folded to an array constant; names hold no semicolon
    return F.get(F.split(F.lit(";".join(values)), ";"), index.cast("int"))


def _groups(digits: Column) -> Column:
    """Groups of three digits as integers, the highest first."""
    return let(F.lpad(digits, MAX_DIGITS, "0"), lambda p: F.transform(
        F.array(*[F.lit(i) for i in range(1, MAX_DIGITS, 3)]), lambda i: F.substring(p, i, F.lit(3)).cast("int")))


def _group_words(k: Column, i: Column) -> Column:
    """Words of group ``i``: named scales from the highest down, thousands, units."""
    one = [one for one, _ in reversed(SCALES)] + ["eintausend", "eins"]
    many = [" " + many for _, many in reversed(SCALES)] + ["tausend", ""]
    below_thousand = F.concat(_lookup(hundreds(), F.floor(k / 100)), _lookup(below_hundred(), k % 100))
    return (F.when(k == 0, "").when(k == 1, _lookup(one, i))
            .otherwise(F.concat(below_thousand, _lookup(many, i))))


def cardinal(digits: Column) -> Column:
    """Spell a string of decimal digits; null beyond ``MAX_DIGITS`` significant digits."""
    def join(words: Column) -> Column:
        low = F.array_join(F.slice(words, len(SCALES) + 1, 2), "")  # thousands and units are one word
        parts = F.concat(F.slice(words, 1, len(SCALES)), F.array(low))
        return F.array_join(F.filter(parts, lambda w: w != ""), " ")

    return let(F.regexp_replace(digits, "^0+", ""), lambda plain: (
        F.when(F.length(plain) > MAX_DIGITS, F.lit(None).cast("string"))
        .when(plain == "", "null")
        .otherwise(let(F.transform(_groups(plain), _group_words), join))))


def ordinal(word: Column) -> Column:
    """Ordinal of a cardinal word: its ending changes, then ``te`` follows."""
    def change(w: Column) -> Column:
        stem = w
        for ending, becomes in reversed(ORDINAL_ENDINGS):
            stem = F.when(w.endswith(ending), F.regexp_replace(w, ending + "$", becomes)).otherwise(stem)
        return F.concat(stem, F.lit("te"))

    spelled = F.regexp_replace(let(F.lower(word), change), "^ein(hundertste|tausendste)$", "$1")
    spelled = F.regexp_replace(spelled, "(^|.* )eine ([a-z]+(?:illion|illiard)ste)$", "$1$2")
    return F.regexp_replace(spelled, " ([a-z]+(?:illion|illiard)ste)$", "$1")


def _with_fraction(word: Column, number: Column) -> Column:
    """``12.50`` -> ``zwölf Komma fünf``; a zero fraction leaves the whole number."""
    digit_words = ["null", "eins", *UNITS[2:]]
    significant = F.length(F.regexp_replace(F.regexp_replace(number, r"\.", ""), "^0+|0+$", ""))
    return let(F.regexp_replace(F.regexp_extract(number, r"\.([0-9]+)$", 1), "0+$", ""), lambda fraction: (
        F.when(fraction == "", word)
        # beyond 15 significant digits a binary float no longer holds the value
        .when(significant <= 15, F.concat(word, F.lit(" Komma "), F.array_join(
            F.transform(F.split(fraction, ""), lambda d: _lookup(digit_words, d)), " ")))))


def spell_number(token: Column) -> Column:
    """Spell a token of digits, dots, commas and apostrophes; unreadable ones stay."""
    value = F.regexp_replace(token, "\n$", "")
    spelled = let(cardinal(F.regexp_extract(value, "^([0-9]*)", 1)), lambda word: (
        F.when(value.rlike(r"^[0-9]+\.$") & token.endswith("."), ordinal(word))
        .when(value.rlike(r"^[0-9]+\.?$"), word)
        .when(value.rlike(r"^[0-9]*\.[0-9]+$"), _with_fraction(word, value))))
    return F.coalesce(spelled, token)
