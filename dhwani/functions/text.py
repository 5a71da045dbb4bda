"""Text normalisation and Unicode repair as column expressions.

Every function maps a string column to a string column; null stays null.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from dhwani.functions import tables as T

LATIN = "[a-zA-Z]+"
_EDGE = r"[\p{L}\p{N}_ঀ-৿]"


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once (a one-element array's transform)."""
    return F.get(F.transform(F.array(value), body), 0)


@lru_cache
def decimal_digits() -> tuple[str, str]:
    """Every decimal digit of Unicode outside ASCII, and the ASCII digit each stands for."""
    found = [chr(c) for c in range(128, 0x110000) if unicodedata.category(chr(c)) == "Nd"]
    return "".join(found), "".join(str(unicodedata.decimal(c)) for c in found)


def digits_to_ascii(text: Column) -> Column:
    """Bengali digits become ASCII digits."""
    return F.translate(text, T.DIGITS, "0123456789")


@lru_cache
def _under_thousand() -> str:
    """The words of 0 to 999, a line each."""
    words = T.NUMBER_WORDS
    hundreds = [words[n // 100] + T.HUNDRED + (" " + words[n % 100] if n % 100 else "") for n in range(100, 1000)]
    return "\n".join([*words, *hundreds])


def number_words(n: Column) -> Column:
    """Words of an integer from 0 to 9999; larger ones stay decimal digits, negative ones too."""
    words = F.split(F.lit(_under_thousand()), "\n")  # folded to a literal
    n = n.cast("long")
    rest = (n % 1000).cast("int")
    thousands = F.concat(F.get(words, F.floor(n / 1000).cast("int")), F.lit(" " + T.THOUSAND))
    below = F.get(words, rest)
    return (
        F.when((n < 0) | (n > 9999), n.cast("string")).when(n < 1000, below).when(rest == 0, thousands)
        .otherwise(F.concat(thousands, F.lit(" "), below))
    )


def normalize_numbers(text: Column) -> Column:
    """Runs of decimal digits of any script become words in place; runs above 9999 lose leading zeros only."""
    text = F.translate(text, *decimal_digits())

    def piece(run: Column) -> Column:
        value = F.concat(F.ltrim(F.substring(run, F.lit(1), F.length(run) - 1), F.lit("0")), F.substring(run, -1, 1))
        spoken = bind(value, lambda v: F.when(F.length(v) <= 4, bind(v.try_cast("long"), number_words)).otherwise(v))
        return F.when(run.between("0", ":") & (run != ":"), spoken).otherwise(run)

    runs = F.regexp_extract_all(text, F.lit(r"(?s)([0-9]+|[^0-9]+)"), 1)
    return F.when(text.rlike("[0-9]"), F.array_join(F.transform(runs, piece), "")).otherwise(text)


def expand_abbreviations(text: Column) -> Column:
    """Abbreviations that stand alone become their full forms, longest first, each seeing the last's result."""
    for short, full in T.ABBREVIATIONS:
        if short != full:
            text = F.regexp_replace(text, rf"(?<!{_EDGE})\Q{short}\E(?!{_EDGE})", full)
    return text


def strip_latin(text: Column) -> Column:
    return F.regexp_replace(text, LATIN, "")


def strip_punctuation(text: Column) -> Column:
    return F.translate(text, T.PUNCTUATION, " " * len(T.PUNCTUATION))


def clean_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, T.WS + "+", " "))


def strip_ws(text: Column) -> Column:
    """Trim all Unicode white space."""
    return F.regexp_replace(text, f"^{T.WS}+|{T.WS}+$", "")


def normalize(text: Column) -> Column:
    """Digits, numbers, abbreviations, Latin words, punctuation and white space, in that order."""
    return clean_whitespace(strip_punctuation(strip_latin(expand_abbreviations(normalize_numbers(digits_to_ascii(text))))))


_SPLIT = (("ড়", "ড়"), ("ঢ়", "ঢ়"), ("য়", "য়"))
_JOINED_VOWELS = (("ো", "ো"), ("ৌ", "ৌ"))


@F.pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def preprocess(text: Column, exact_nfc: bool = False) -> Column:
    """Canonical composition of the Bengali block, with the three dotted letters as single letters.

    Native for U+0980-09FF; ``exact_nfc`` normalises all of Unicode first, in Python.
    """
    if exact_nfc:
        text = _nfc(text)
    for whole, parts in _SPLIT:
        text = F.replace(text, F.lit(whole), F.lit(parts))
    # marks in a row stand in the order of their combining classes
    marks = "়্৾"
    pieces = F.regexp_extract_all(text, F.lit(f"(?s)([{marks}]+|[^{marks}]+)"), 1)
    ordered = F.transform(pieces, lambda p: F.when(p.rlike(f"^[{marks}]"), F.concat(*[F.regexp_replace(p, f"[^{m}]", "") for m in marks])).otherwise(p))
    text = F.when(text.rlike("[্৾]়|্৾"), F.array_join(ordered, "")).otherwise(text)
    for parts, whole in (*_JOINED_VOWELS, *((b, a) for a, b in _SPLIT)):
        text = F.replace(text, F.lit(parts), F.lit(whole))
    return text


def classify_char(ch: Column) -> Column:
    """Class of a one-character string; the first that fits."""
    return (
        F.when(ch.isin(*T.VOWELS), "VOWEL").when(ch.isin(*T.SIGNS), "VOWEL_SIGN").when(ch.isin(*T.CONSONANTS), "CONSONANT")
        .when(ch == T.HASANTA, "HASANTA").when(ch == T.NASAL, "CHANDRABINDU").when(ch.isin(*T.MARKS), "DIACRITIC")
        .when(ch.isin(*T.DIGITS), "DIGIT").when(ch.rlike(f"^{T.WS}$"), "SPACE").otherwise("OTHER")
    )

