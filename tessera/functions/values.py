"""Dates, enumerations, booleans and numbers as catalogue columns take them."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trimmed

# The enumerations and their accepted spellings.
STATUSES = ("OWNED", "NOT_OWNED", "WANTED", "EXCLUDED", "PENDING_REVIEW")
OLD_STATUSES = {"WANT": "WANTED", "SKIP": "NOT_OWNED", "UNKNOWN": "NOT_OWNED", "ORDERED": "WANTED"}
CATEGORIES = ("ORIGINAL_ALBUM", "SINGLE", "BEST", "COLLECTION", "COMPILATION", "LIVE", "REMIX", "BOX", "EP", "OTHER")
CANDIDATE_CATEGORIES = tuple(c for c in CATEGORIES if c != "COMPILATION")
FORMATS = ("CD", "SHM_CD", "BLU_SPEC_CD", "SACD", "HYBRID_SACD", "CD_DVD", "BOX_SET", "OTHER")
CONFIDENCES = ("LOW", "MEDIUM", "HIGH")
TRUE_WORDS, FALSE_WORDS = ("是", "true", "yes", "y", "1", "再版"), ("否", "false", "no", "n", "0", "原版")
LEFT_OUT_WORDS = ("否", "false", "no", "n", "0", "排除")
STATUS_WORDS = {
    "OWNED": ("已拥有", "拥有", "owned", "have"),
    "NOT_OWNED": ("未拥有", "skip", "跳过"),
    "WANTED": ("想买", "want", "wishlist"),
    "EXCLUDED": ("排除", "excluded"),
}
FIRST_WORDS, LAST_WORDS = ("必收", "最高", "high"), ("候补", "低", "low")
# What a format's text holds, and the words of a sheet's name and of its type column, in the order in which they are tried.
FORMAT_WORDS = (("SHM", "SHM_CD"), ("BLU", "BLU_SPEC_CD"), ("HYBRID", "HYBRID_SACD"), ("SACD", "HYBRID_SACD"), ("DVD", "CD_DVD"), ("BOX", "BOX_SET"), ("CD", "CD"))
SHEET_CATEGORIES = (("A_原创专辑原版CD", "ORIGINAL_ALBUM"), ("B_单曲原版CD", "SINGLE"))
TYPE_CATEGORIES = (("best|ベスト|精选", "BEST"), ("collection|合集", "COLLECTION"), ("live|ライブ|现场", "LIVE"), ("remix|リミックス|混音", "REMIX"))


def word(c: Column) -> Column:
    return F.lower(trimmed(F.coalesce(c, F.lit(""))))


# The last day number of a spreadsheet, 9999-12-31; its day 60, 1900-02-29, was none; how near to midnight a time counts as the next day.
LAST_DAY, LEAP_DAY, TO_MIDNIGHT = 2958465, 60, 0.0001 / 86400


def serial_date(days: Column) -> Column:
    """The date of a spreadsheet's day number, 0 to LAST_DAY, else null. Day 1 is 1900-01-01, and both 60 and 61 are 1900-03-01."""
    day = F.floor(F.when(days.between(0, LAST_DAY), days) + F.lit(TO_MIDNIGHT)).try_cast("int")
    return F.date_add(F.lit("1899-12-30").cast("date"), day + (day <= LEAP_DAY).cast("int"))


def written_date(c: Column) -> Column:
    """y-m-d with -, ., / or 年月日; months and days beyond their range roll over. Else null."""
    text = F.regexp_replace(trimmed(F.coalesce(c, F.lit(""))), "[./年月]", "-")
    text = trimmed(F.regexp_replace(text, "日", ""))
    parts = r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})$"
    y, m, d = (F.regexp_extract(text, parts, i).try_cast("int") for i in (1, 2, 3))
    year = F.when(y < 100, y + 1900).otherwise(y)
    return F.when(text.rlike(parts), F.date_add(F.add_months(F.make_date(year, F.lit(1), F.lit(1)), m - 1), d - 1))


def strict_date(c: Column) -> Column:
    """yyyy-mm-dd on the calendar, else null."""
    return F.when(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(c, "yyyy-MM-dd"))


def leading_date(c: Column) -> Column:
    """The date in the first ten characters; a year or a year and month stand for their first day."""
    head = F.left(c, F.lit(10))
    return F.coalesce(strict_date(head), strict_date(F.when(head.rlike(r"^[0-9]{4}-[0-9]{2}$"), F.concat(head, F.lit("-01")))), strict_date(F.when(head.rlike(r"^[0-9]{4}$"), F.concat(head, F.lit("-01-01")))))


def leading_year(c: Column) -> Column:
    year = F.regexp_extract(F.coalesce(c, F.lit("")), r"^([0-9]{4})", 1).try_cast("int")
    return F.when(year.between(1000, 2999), year)


def boolean(c: Column, default: bool = False) -> Column:
    return F.when(word(c).isin(*TRUE_WORDS), True).when(word(c).isin(*FALSE_WORDS), False).otherwise(default)


def included(c: Column) -> Column:
    return ~word(c).isin(*LEFT_OUT_WORDS)


def status(c: Column, is_included: Column) -> Column:
    out = F.when(~is_included, "EXCLUDED")
    for name, words in STATUS_WORDS.items():
        out = out.when(word(c).isin(*words), name)
    return out.otherwise("NOT_OWNED")


def _format(text: Column) -> Column:
    return F.coalesce(*[F.when(text.contains(word), name) for word, name in FORMAT_WORDS])


def sheet_format(c: Column) -> Column:
    """A blank cell is a CD."""
    text = F.upper(trimmed(F.coalesce(c, F.lit(""))))
    return F.coalesce(_format(text), F.when(text == "", "CD"), F.lit("OTHER"))


def candidate_format(c: Column) -> Column:
    """Null is a CD, an empty text is not."""
    return F.coalesce(_format(F.upper(F.coalesce(c, F.lit("CD")))), F.lit("OTHER"))


def within(c: Column, least: int, most: int, fallback: int | None = None) -> Column:
    """c between least and most; greatest() and least() pass over nulls, so null is told apart."""
    return F.when(c.isNull(), F.lit(fallback)).otherwise(F.greatest(F.lit(least), F.least(F.lit(most), c)))


def clamped_priority(c: Column, fallback: int = 3) -> Column:
    return within(c, 1, 5, fallback).cast("int")


def priority(c: Column) -> Column:
    """Words for first and last, else the leading integer within 1 to 5, else 3."""
    number = F.regexp_extract(F.coalesce(c, F.lit("")), r"^\s*([+-]?[0-9]+)", 1).try_cast("decimal(38,0)")
    return F.when(word(c).isin(*FIRST_WORDS), 1).when(word(c).isin(*LAST_WORDS), 5).otherwise(clamped_priority(number))


def canonical_status(c: Column) -> Column:
    """Current statuses and old spellings, in any case; else null."""
    key = F.upper(trimmed(c))
    table = F.create_map(*[F.lit(x) for k, v in (*((s, s) for s in STATUSES), *OLD_STATUSES.items()) for x in (k, v)])
    return F.try_element_at(table, key)


def sheet_category(sheet: Column, kind: Column) -> Column:
    by_sheet = [F.when(sheet.contains(word), name) for word, name in SHEET_CATEGORIES]
    by_type = [F.when(F.coalesce(kind, F.lit("")).rlike(f"(?i){words}"), name) for words, name in TYPE_CATEGORIES]
    return F.coalesce(*by_sheet, *by_type, F.lit("OTHER"))


def confidence_rank(c: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, CONFIDENCES)), c).cast("int")


def confidence_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, CONFIDENCES)), rank)


def rate(part: Column, whole: Column) -> Column:
    """Rounded per cent, 0 of nothing."""
    return F.when(whole == 0, 0).otherwise(F.round(100 * part / F.greatest(whole, F.lit(1)))).cast("int")


def clamp_integer(c: Column, fallback: int, least: int, most: int) -> Column:
    return within(F.when(~F.isnan(c.cast("double")), c).try_cast("long"), least, most, fallback)


def release_status(excluded: Column, pending: Column) -> Column:
    return F.when(excluded, "EXCLUDED").when(pending, "PENDING_REVIEW").otherwise("NOT_OWNED")


def confidence_priority(c: Column) -> Column:
    return F.when(c == "HIGH", 2).when(c == "MEDIUM", 3).otherwise(5)


def row_state(errors: Column, duplicate: Column) -> Column:
    return F.when(F.size(errors) > 0, "error").when(duplicate, "duplicate").otherwise("ready")


def exclusion_reason(by_default: Column, status_: Column) -> Column:
    return F.when(by_default, "EXCLUDED_BY_DEFAULT").when(status_ == "EXCLUDED", "EXCLUDED")


def progress(c: Column) -> Column:
    return within(c, 0, 100)
