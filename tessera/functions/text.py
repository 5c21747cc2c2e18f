"""String functions. White space is what ECMAScript trims: ASCII blanks, all Unicode separators and the byte order mark."""

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

BLANK = r"[\s\p{Z}﻿]"

# Country names, after normalisation, and their two-letter codes.
COUNTRIES = {
    "CN": ["china", "chn", "cn", "prc", "中国", "中华人民共和国", "中國", "中華人民共和國"],
    "JP": ["japan", "jpn", "jp", "日本", "日本国", "日本國"],
    "HK": ["hongkong", "hkg", "hk", "香港"],
    "TW": ["taiwan", "twn", "tw", "台湾", "臺灣"],
    "KR": ["korea", "kor", "kr", "southkorea", "韩国", "韓國", "韓国"],
    "US": ["unitedstates", "usa", "us", "美国", "美國"],
    "GB": ["greatbritain", "unitedkingdom", "uk", "gb", "英国", "英國"],
}


@F.pandas_udf(StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """Unicode compatibility composition, which Spark has no function for; Arrow batches."""
    return values.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def collapsed(c: Column) -> Column:
    """Header form: runs of white space as one space, trimmed."""
    return trimmed(F.regexp_replace(F.coalesce(c, F.lit("")), f"{BLANK}+", " "))


def text_or_null(c: Column) -> Column:
    return F.nullif(trimmed(c.cast("string")), F.lit(""))


def is_blank(c: Column) -> Column:
    """Null and the empty string alike."""
    return F.coalesce(c, F.lit("")) == ""


def includes(c: Column, query: str) -> Column:
    """Literal, case-insensitive substring; null holds nothing."""
    return F.lower(F.coalesce(c, F.lit(""))).contains(query.lower())


def title_key(c: Column, compose: bool = True) -> Column:
    """Titles that differ in width, case, punctuation and spacing only have one key. compose=False: the text is ASCII and stays in the JVM."""
    c = F.coalesce(c, F.lit(""))
    return F.regexp_replace(F.lower(trimmed(nfkc(c) if compose else c)), r"[\p{P}\p{Z}\p{Cf}]", "")


def country_code(c: Column, compose: bool = True) -> Column:
    """A known name's code, else two letters upper-cased, else US."""
    c = F.coalesce(c, F.lit(""))
    key = F.regexp_replace(F.lower(trimmed(nfkc(c) if compose else c)), r"[\p{P}\p{Z}]", "")
    known = F.create_map(*[F.lit(x) for code, names in COUNTRIES.items() for name in names for x in (name, code)])
    return F.coalesce(F.try_element_at(known, key), F.when(key.rlike("^[a-z]{2}$"), F.upper(key)), F.lit("US"))


def has_cjk(c: Column) -> Column:
    return c.rlike(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]")


def is_composite(c: Column, compose: bool = True) -> Column:
    """A credit of several artists."""
    word = "[A-Za-z0-9_]"
    return (nfkc(c) if compose else c).rlike(rf"(?i)[&+×/,，、]|{BLANK}x{BLANK}|(?<!{word})feat(?:uring)?\.?{BLANK}|(?<!{word})with(?!{word})")


def whole_word(words: str) -> str:
    """A pattern of whole ASCII words, as ECMAScript's boundaries take them."""
    return rf"(?<![A-Za-z0-9_])(?:{words})(?![A-Za-z0-9_])"


# The lengths that stored and shown texts are cut to.
ERROR_LENGTH, SHOWN_ERROR_LENGTH, PREVIEW_LENGTH = 2000, 500, 500


def cut(c: Column, most: int) -> Column:
    """The first `most` characters."""
    return F.left(c, F.lit(most))


def masked(secret: Column) -> Column:
    """First and last characters only: 4, or 2 of a secret of 8 or fewer."""
    n = F.when(F.length(secret) <= 8, 2).otherwise(4)
    return F.when(is_blank(secret), F.lit("")).otherwise(F.concat(F.left(secret, n), F.lit("..."), F.right(secret, n)))


def redacted(message: Column, secret: Column) -> Column:
    return F.when(is_blank(secret), message).otherwise(F.replace(message, secret, masked(secret)))
