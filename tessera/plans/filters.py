"""Library filters: text fields as they come from a query string, compiled to one predicate."""

from dataclasses import dataclass, fields

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import includes, is_blank
from ..functions.urls import STORE_HOSTS, on_hosts

COVER_ROLE = "cover-image-source"
DECADES = {"1980s": (1980, 1989), "1990s": (1990, 1999), "2000s": (2000, 2009)}
GAP_STATUSES = ("NOT_OWNED", "WANTED", "PENDING_REVIEW")


def is_evidence(description: Column) -> Column:
    """A null description is evidence."""
    return ~description.eqNullSafe(F.lit(COVER_ROLE))


def evidence(sources: Column) -> Column:
    """Sources that are not there for the cover alone."""
    return F.filter(sources, lambda s: is_evidence(s["description"]))


def cover_source(sources: Column) -> Column:
    """The first source in the cover role."""
    return F.try_element_at(F.filter(sources, lambda s: s["description"].eqNullSafe(F.lit(COVER_ROLE))), F.lit(1))


def store_cover_source(sources: Column) -> Column:
    """The first source in the cover role, if it is a page of the store."""
    first = cover_source(sources)
    return F.when(on_hosts(first["url"], STORE_HOSTS), first)


def mentions_review(warnings: Column, notes: Column) -> Column:
    hit = lambda t: F.lower(t).contains("pending_review") | F.lower(t).contains("pending review")
    return F.coalesce(F.exists(warnings, hit), F.lit(False)) | F.coalesce(hit(notes), F.lit(False))


def number(text: str | None) -> float | None:
    """None for what is no number, and for zero: an open bound."""
    try:
        return float(text.strip()) or None if text and text.strip() else None
    except ValueError:
        return None


@dataclass(frozen=True)
class Filters:
    """Empty and missing fields do not filter. Columns: title, catalogNo, notes, category, status, confidence, isExcludedByDefault, isReissue, isRemaster, coverUrl, sources, warnings, releaseDate."""

    q: str = ""
    category: str = ""
    status: str = ""
    confidence: str = ""
    excluded: str = ""
    reissue: str = ""
    remaster: str = ""
    missingCover: str = ""
    missingSource: str = ""
    missingCatalog: str = ""
    pendingReview: str = ""
    gap: str = ""
    decade: str = ""
    yearFrom: str = ""
    yearTo: str = ""

    @classmethod
    def of(cls, query: dict[str, str | list[str]]) -> "Filters":
        """From a parsed query string: first values, unknown names ignored."""
        first = {k: v[0] if isinstance(v, list) and v else v for k, v in query.items()}
        return cls(**{f.name: first[f.name] for f in fields(cls) if isinstance(first.get(f.name), str)})

    def years(self) -> tuple[float | None, float | None] | None:
        return (number(self.yearFrom), number(self.yearTo)) if self.decade == "custom" else DECADES.get(self.decade)

    def predicate(self, no_evidence: Column | None = None) -> Column:
        """no_evidence: whether a release has no source but for its cover; by `sources` unless given."""
        if no_evidence is None:
            no_evidence = F.size(evidence(F.col("sources"))) == 0
        c, out = F.col, F.lit(True)
        if query := self.q.strip():
            out &= includes(c("title"), query) | includes(c("catalogNo"), query) | includes(c("notes"), query)
        if self.category:
            out &= c("category") == self.category
        if self.status:
            out &= F.coalesce(c("status"), F.lit("NOT_OWNED")) == self.status
        if self.confidence:
            out &= F.coalesce(c("confidence"), F.lit("")) == self.confidence
        for value, name in ((self.excluded, "isExcludedByDefault"), (self.reissue, "isReissue"), (self.remaster, "isRemaster")):
            if value:
                out &= c(name) == F.lit(value == "true")
        if self.missingCover == "true":
            out &= is_blank(c("coverUrl"))
        if self.missingSource == "true":
            out &= no_evidence
        if self.missingCatalog == "true":
            out &= is_blank(c("catalogNo"))
        review = mentions_review(c("warnings"), c("notes"))
        if self.pendingReview == "true":
            out &= F.coalesce(c("status") == "PENDING_REVIEW", F.lit(False)) | review
        if self.gap == "true":
            out &= F.coalesce(c("status"), F.lit("NOT_OWNED")).isin(*GAP_STATUSES) | is_blank(c("coverUrl")) | no_evidence | review
        if (bounds := self.years()) is not None:
            year = F.year("releaseDate")
            out &= year.isNotNull()
            out &= (year >= bounds[0]) if bounds[0] else F.lit(True)
            out &= (year <= bounds[1]) if bounds[1] else F.lit(True)
        return F.coalesce(out, F.lit(False))
