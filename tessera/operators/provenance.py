"""Where sources come from: explicit URLs of pasted text, categories inferred from it, and the rows stored for sources."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import is_blank, whole_word
from ..functions.urls import STORE_HOSTS, on_hosts, without_dots
from ..plans.filters import COVER_ROLE

NO_URL = "PENDING_REVIEW: no explicit source url."
# The fields that describe a row, and the words of each category, in the order in which they are tried; words of the reissue hint.
ROW_FIELDS = ("title", "titleOriginal", "category", "format", "editionType", "notes", "label")
COLLECTED = "collection|best|ベスト|精选|精選|合集"
CATEGORY_WORDS = (
    ("live|ライブ|现场|現場", "LIVE"),
    ("remix|リミックス|混音", "REMIX"),
    (f"{whole_word('box')}|box set", "BOX"),
    (f"8cmcd|cdシングル|{whole_word('single')}|シングル", "SINGLE"),
    ("original album|studio album|オリジナル.?アルバム|原创专辑|原創專輯", "ORIGINAL_ALBUM"),
)
REISSUED = "(?i)再発|復刻|リマスター|reissue|remaster"


def release_sources(sources: Column, cover: Column) -> Column:
    """Stored rows of a candidate's sources: one for each URL, at its first place and with its last values; then the cover's
    own row, even if its URL is there already. sources: array<struct<title,url,sourceType>>."""
    urls = F.array_distinct(F.transform(sources, lambda s: s["url"]))
    last = lambda u: F.element_at(F.filter(sources, lambda s: s["url"] == u), -1)
    rows = F.transform(urls, lambda u: F.struct(u.alias("url"), last(u)["title"].alias("label"), last(u)["sourceType"].alias("description")))
    label = F.when(on_hosts(cover, STORE_HOSTS), "Apple Music").otherwise("Cover image source")
    return F.when(is_blank(cover), rows).otherwise(F.array_append(rows, F.struct(cover.alias("url"), label.alias("label"), F.lit(COVER_ROLE).alias("description"))))


def row_text(prefix: str = "") -> Column:
    """A row's describing fields, one space between, nulls as nothing."""
    parts = [F.coalesce(F.col(prefix + n).cast("string"), F.lit("")) for n in ROW_FIELDS]
    return F.concat(*[x for p in parts for x in (p, F.lit(" "))][:-1])


def pasted_category(current: Column, source_text: Column, prefix: str = "") -> Column:
    """By the row's text and the whole pasted document, in a fixed order; else the current category, else OTHER."""
    now = F.upper(F.coalesce(current, F.lit("")))
    text = F.lower(F.concat(row_text(prefix), F.lit(" "), F.coalesce(source_text, F.lit(""))))
    collected = F.when(text.rlike(COLLECTED), F.when(now == "BEST", "BEST").otherwise("COLLECTION"))
    return F.coalesce(collected, *[F.when(text.rlike(words), name) for words, name in CATEGORY_WORDS], F.nullif(now, F.lit("")), F.lit("OTHER"))


def pasted_reissue(flag: Column, prefix: str = "") -> Column:
    """An explicit flag wins; a hint in the text says yes; else unknown."""
    return F.when(flag.isNotNull(), flag).when(row_text(prefix).rlike(REISSUED), True)


def allowed_urls(model: Column, explicit: Column) -> Column:
    """URLs of the model that the text names, in the model's order, then the text's others."""
    clean = F.transform(model, without_dots)
    return F.array_distinct(F.filter(F.concat(F.filter(clean, lambda u: F.array_contains(explicit, u)), explicit), lambda u: ~is_blank(u)))


def as_sources(urls: Column) -> Column:
    return F.transform(urls, lambda u: F.struct(u.alias("title"), u.alias("url"), F.lit("other").alias("sourceType")))


def url_warnings(warnings: Column, urls: Column) -> Column:
    """A warning where no URL is left, once."""
    there = F.exists(warnings, lambda w: w.contains("no explicit source url"))
    return F.when((F.size(urls) == 0) & ~there, F.array_append(warnings, F.lit(NO_URL))).otherwise(warnings)


def explicit_cover(url: Column, explicit: Column) -> Column:
    """A cover survives only where it was given explicitly."""
    return F.when(F.array_contains(explicit, without_dots(url)), without_dots(url))


def explicit_cover_source(url: Column, explicit: Column) -> Column:
    return F.coalesce(explicit_cover(url, explicit), F.try_element_at(explicit, F.lit(1)))


def field_or(value: Column, default: Column) -> Column:
    """A document's header field, or what the request says."""
    return F.coalesce(F.nullif(value, F.lit("")), default)
