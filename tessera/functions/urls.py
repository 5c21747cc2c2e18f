"""URL tests and rewrites, by Spark's own parser: a text with spaces or a non-ASCII host is no URL here."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import text_or_null

# The hosts of store pages and of their pictures, the longest URL, and what a URL in a text looks like.
STORE_HOSTS = ("music.apple.com", "itunes.apple.com")
ARTWORK_HOSTS = ("mzstatic.com", "itunes.apple.com")
MOST = 2048
URL = r"(?i)https?://[^\s\"'<>),\]]+"


def host(c: Column) -> Column:
    return F.lower(F.try_parse_url(c, F.lit("HOST")))


def is_http(c: Column) -> Column:
    return F.coalesce((F.length(c) <= MOST) & c.rlike(r"(?i)^https?://") & host(c).isNotNull(), F.lit(False))


def http_or_null(c: Column) -> Column:
    text = text_or_null(c)
    return F.when(is_http(text), text)


def http_error(c: Column) -> Column:
    """What is wrong with a URL that is given, else null."""
    text = text_or_null(c)
    return F.when(text.isNotNull() & ~is_http(text), F.lit("URL must use HTTP or HTTPS and be at most 2048 characters."))


def on_hosts(c: Column, hosts: tuple[str, ...]) -> Column:
    """The host is one of hosts or a subdomain of one."""
    h = host(c)
    hit = F.lit(False)
    for x in hosts:
        hit = hit | (h == x) | h.endswith("." + x)
    return F.coalesce(hit, F.lit(False))


def secure(c: Column, hosts: tuple[str, ...]) -> Column:
    """The URL with https, if it is http(s) on one of hosts."""
    return F.when(c.rlike(r"(?i)^https?://") & on_hosts(c, hosts), F.regexp_replace(c, r"(?i)^https?:", "https:"))


def artwork_600(c: Column, hosts: tuple[str, ...] = ARTWORK_HOSTS) -> Column:
    """The artwork's URL at 600 pixels; null if the path names no other size."""
    url = secure(c, hosts)
    parts = r"(?i)^(https://[^/?#]*[^?#]*)/\d+x\d+([a-z0-9-]*\.[a-z0-9]+)([?#].*)?$"
    new = F.regexp_replace(url, parts, "$1/600x600$2$3")
    return F.when(url.rlike(parts) & (new != url), new)


def without_dots(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), r"[.。]+$", "")


def explicit_urls(text: Column) -> Column:
    """URLs written in a text: distinct first, then without trailing full stops."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(URL), F.lit(0))
    return F.transform(F.array_distinct(F.filter(found, lambda u: u != "")), without_dots)


def is_wiki(url: Column, title: Column) -> Column:
    return F.coalesce(url.rlike(r"(?i)wikipedia\.org|wikidata\.org"), F.lit(False)) | F.coalesce(title.rlike(r"(?i)wiki"), F.lit(False))
