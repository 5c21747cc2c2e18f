"""Changes as new snapshots: upserts, bulk updates, patches, source rows, artists. Parquet has no MERGE, so each returns the whole new table."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import text_or_null, trimmed
from ..functions.urls import http_error, http_or_null
from ..functions.values import canonical_status, strict_date
from ..plans.filters import COVER_ROLE

STATUS_FIELDS = {"status": "NOT_OWNED", "priority": 3, "ownedCondition": None, "ownedNotes": None}


def upsert_statuses(statuses: DataFrame, changes: DataFrame) -> DataFrame:
    """By (userId, releaseId): null in a change keeps what is there; a new row gets NOT_OWNED and 3 where nothing is given."""
    key = ["userId", "releaseId"]
    given = [c for c in changes.columns if c not in key]
    both = statuses.join(changes.select(*key, *[F.col(c).alias(f"__{c}") for c in given]), key, "full_outer")
    for c in given:
        now = F.col(c) if c in statuses.columns else F.lit(None)
        both = both.withColumn(c, F.coalesce(F.col(f"__{c}"), now, F.lit(STATUS_FIELDS.get(c)))).drop(f"__{c}")
    return both.select(*dict.fromkeys([*statuses.columns, *given]))


def scoped(releases: DataFrame, artist: object, ids: DataFrame) -> DataFrame:
    """The named releases that are the artist's; ids of others drop out silently."""
    return releases.where(F.col("artistId") == F.lit(artist)).join(ids.select("id").distinct(), "id", "left_semi")


def bulk_update(releases: DataFrame, statuses: DataFrame, user: object, artist: object, ids: DataFrame, status: str | None = None, priority: int | None = None, excluded: bool | None = None) -> dict[str, DataFrame]:
    """New releases and statuses after one change of many releases."""
    if status is None and priority is None and excluded is None:
        raise ValueError("No bulk update operation was provided.")
    hit = scoped(releases, artist, ids).select("id")
    out = {"releases": releases, "statuses": statuses}
    if status is not None or priority is not None:
        change = hit.select(F.lit(user).alias("userId"), F.col("id").alias("releaseId"), F.lit(status).cast("string").alias("status"), F.lit(priority).cast("int").alias("priority"))
        out["statuses"] = upsert_statuses(statuses, change)
    if excluded is not None:
        marked = releases.join(hit.withColumn("__hit", F.lit(True)), "id", "left")
        out["releases"] = marked.withColumn("isExcludedByDefault", F.when(F.col("__hit"), F.lit(excluded)).otherwise(F.col("isExcludedByDefault"))).drop("__hit").select(*releases.columns)
    return out


def patch_release(releases: DataFrame, sources: DataFrame, release: object, fields: dict[str, object]) -> dict[str, DataFrame]:
    """Fields that are given replace, None clears, absent ones stay. A changed cover drops the sources that were there for the old one.
    `warning` has a row where another release of the artist has the new catalogue number."""
    here = F.col("id") == F.lit(release)
    new = releases.select(*[F.when(here, F.lit(fields[c]).cast(releases.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in releases.columns])
    links = sources
    if "coverUrl" in fields:
        same = releases.where(here & F.col("coverUrl").eqNullSafe(F.lit(fields["coverUrl"]))).select(F.col("id").alias("releaseId"))
        old = sources.where((F.col("releaseId") == F.lit(release)) & F.col("description").eqNullSafe(F.lit(COVER_ROLE))).join(same, "releaseId", "left_anti").select("id")
        links = sources.join(old, "id", "left_anti").select(*sources.columns)
    number = fields.get("catalogNo")
    own = releases.where(here).select("artistId")
    others = releases.where(~here & (F.col("catalogNo") == F.lit(number).cast("string"))).join(own, "artistId", "left_semi")
    return {"releases": new, "sources": links, "warning": others.agg(F.min_by("title", "id").alias("title")).where("title is not null").select(F.concat(F.lit('Catalog number already exists on "'), "title", F.lit('".')).alias("warning"))}


def add_sources(sources: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sources with the new rows (id, releaseId, url, label), faults). Rows without a usable URL are faults."""
    checked = new.withColumn("fault", F.coalesce(http_error(F.col("url")), F.when(http_or_null(F.col("url")).isNull(), "url is required.")))
    good = checked.where("fault is null").select("id", "releaseId", trimmed(F.col("url")).alias("url"), F.coalesce(text_or_null(F.col("label")), F.lit("Manual source")).alias("label"))
    return sources.unionByName(good, allowMissingColumns=True), checked.where("fault is not null")


def delete_sources(sources: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the rows named by (id, releaseId); both must agree."""
    return sources.join(gone.select("id", "releaseId"), ["id", "releaseId"], "left_anti").select(*sources.columns)


def new_links(links: DataFrame, sources: DataFrame) -> DataFrame:
    """Links (releaseId, url) not stored yet, once each."""
    return links.select("releaseId", "url").distinct().join(sources, ["releaseId", "url"], "left_anti")


def delete_cascade(releases: DataFrame, children: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Releases and all their children without the releases named by id."""
    ids = gone.select(F.col("id").alias("releaseId")).distinct()
    return {"releases": releases.join(ids.withColumnRenamed("releaseId", "id"), "id", "left_anti")} | {k: c.join(ids, "releaseId", "left_anti") for k, c in children.items()}


def follow_artists(artists: DataFrame, follows: DataFrame, wanted: DataFrame, user: object) -> dict[str, DataFrame]:
    """Artists and follows after the user asked for names: a name known in any case is followed (the oldest artist), another is created."""
    from .resolve import lookup_by_name

    names = wanted.select(trimmed(F.col("name")).alias("name")).where("name <> ''").distinct()
    known = lookup_by_name(artists, names, fold_case=True)
    fresh = names.join(known, "name", "left_anti").groupBy(F.lower("name").alias("__k")).agg(F.min("name").alias("name")).select(F.concat(F.lit("artist:"), F.col("name")).alias("id"), "name")
    ids = known.select("id").unionByName(fresh.select("id")).distinct().select(F.lit(user).alias("userId"), F.col("id").alias("artistId"))
    return {"artists": artists.unionByName(fresh, allowMissingColumns=True), "follows": follows.unionByName(ids.join(follows, ["userId", "artistId"], "left_anti"), allowMissingColumns=True)}


def validated(rows: DataFrame, rules: dict[str, object]) -> tuple[DataFrame, DataFrame]:
    """(rows without faults, rows with them). rules: message to a condition that a good row meets; a null condition is a fault."""
    faults = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(m)) for m, ok in rules.items()]), lambda x: x.isNotNull())
    marked = rows.withColumn("faults", faults)
    return marked.where(F.size("faults") == 0).drop("faults"), marked.where(F.size("faults") > 0)


def patch_rules() -> dict[str, object]:
    """Rules of a release's patch: title, category, releaseDate, format and coverUrl as texts."""
    from ..functions.values import CATEGORIES, FORMATS

    c = F.col
    date, cover = text_or_null(c("releaseDate")), text_or_null(c("coverUrl"))
    return {
        "title is required.": text_or_null(c("title")).isNotNull(),
        "Invalid category.": c("category").isin(*CATEGORIES),
        "releaseDate must be YYYY-MM-DD.": date.isNull() | strict_date(date).isNotNull(),
        "Invalid format.": c("format").isin(*FORMATS),
        "URL must use HTTP or HTTPS and be at most 2048 characters.": cover.isNull() | http_or_null(cover).isNotNull(),
    }


def request_rules() -> dict[str, object]:
    """Rules of a research request: artistName, country, target and three flags."""
    short = lambda c, n: F.length(trimmed(F.col(c))).between(1, n)
    flags = ("excludeReissues", "includeCollaborations", "includeLiveRemixBest")
    return {"artistName is required.": short("artistName", 160), "country is required.": short("country", 80), "Invalid target.": F.col("target").isin("ORIGINAL_CD", "ALL_CD", "ALL_PHYSICAL")} | {f"{f} is required.": F.col(f).isNotNull() for f in flags}


def edit_rules() -> dict[str, object]:
    """Rules of a candidate's edit."""
    from ..functions.values import CANDIDATE_CATEGORIES

    c = F.col
    within = lambda name, n: c(name).isNull() | (F.length(trimmed(c(name))) <= n)
    texts = {"format": 80, "catalogNumber": 120, "label": 200, "notes": 4000}
    date, cover = c("originalReleaseDate"), c("coverImageUrl")
    return {
        "title must have 1 to 300 characters.": F.length(trimmed(c("title"))).between(1, 300),
        "artistCredit must have 1 to 300 characters.": F.length(trimmed(c("artistCredit"))).between(1, 300),
        "Invalid category.": c("category").isin(*CANDIDATE_CATEGORIES),
        "Date must be a real calendar date in YYYY-MM-DD format.": date.isNull() | strict_date(trimmed(date)).isNotNull(),
        "URL must use HTTP or HTTPS.": cover.isNull() | http_or_null(cover).isNotNull(),
    } | {f"{n} is too long.": within(n, most) for n, most in texts.items()}


def import_input_rules() -> dict[str, object]:
    """Rules of a candidate import: artistMode, artistId, artistName, selected, excluded, pending and edited ids (arrays)."""
    from .selection import has_repeats
    from .selection import within as inside

    c = F.col
    few = F.lit(True)
    for n in ("selected", "excluded", "pending"):
        few &= F.size(n) <= 1000
    return {
        "artistId is required.": (c("artistMode") != "existing") | text_or_null(c("artistId")).isNotNull(),
        "artistName is required.": (c("artistMode") != "create") | text_or_null(c("artistName")).isNotNull(),
        "Invalid artistMode.": c("artistMode").isin("create", "existing"),
        "Too many ids.": few,
        "Candidate IDs must be unique.": ~has_repeats(c("selected")),
        "Only selected candidates may be changed.": inside(c("edited"), c("selected")),
    }


# The most characters of an artist form's fields.
ARTIST_TEXTS = {"name": 160, "sortName": 160, "country": 80, "description": 4000}


def artist_rules() -> dict[str, object]:
    """Rules of an artist's form; name must be there, the other fields may be blank. Lengths are of the trimmed texts."""
    text = lambda n: text_or_null(F.col(n))
    return {"name is required.": text("name").isNotNull()} | {f"{n} has more than {most} characters.": text(n).isNull() | (F.length(text(n)) <= most) for n, most in ARTIST_TEXTS.items()}


def bulk_rules() -> dict[str, object]:
    """Rules of a bulk change as it was sent: artistId, releaseIds (array) and status, priority and excluded as texts, of which blank ones count as not sent."""
    c = F.col
    status, priority, excluded = (text_or_null(c(n)) for n in ("status", "priority", "excluded"))
    return {
        "releaseIds is required.": F.coalesce(F.size(F.filter("releaseIds", lambda x: F.coalesce(x, F.lit("")) != "")) > 0, F.lit(False)),
        "artistId is required.": text_or_null(c("artistId")).isNotNull(),
        "Invalid collection status.": status.isNull() | canonical_status(status).isNotNull(),
        "priority must be an integer from 1 to 5.": priority.isNull() | priority.try_cast("double").isin(1.0, 2.0, 3.0, 4.0, 5.0),
        "No bulk update operation was provided.": status.isNotNull() | priority.isNotNull() | excluded.isNotNull(),
    }


def flag(c: Column) -> Column:
    """True for true and its text, false for anything else."""
    return F.coalesce(c.cast("string") == "true", F.lit(False))


def whole_priority(c: Column) -> Column:
    """An integer from 1 to 5, else null (which the rules refuse)."""
    n = c.cast("string").try_cast("double")
    return F.when(n.isin(1.0, 2.0, 3.0, 4.0, 5.0), n.cast("int"))


def status_rules() -> dict[str, object]:
    return {"Invalid collection status.": canonical_status(F.col("status")).isNotNull(), "priority must be an integer from 1 to 5.": F.col("priority").try_cast("double").isin(1.0, 2.0, 3.0, 4.0, 5.0)}
