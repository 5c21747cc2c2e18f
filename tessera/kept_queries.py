"""Queries of what is kept between runs: snapshots changed in place and read by key, statistics kept up to date, the keyword index; and the same in SQL."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import catalogue_tables as T
from .catalogue_queries import UPSERT_SQL, artists, counted, register
from .change_queries import USER_SQL, statuses
from .operators import library, mutations
from .plans.keyword_index import KeywordIndex
from .sources import folders
from .sources.snapshots import Snapshot

KEYWORDS = ("e 49", "cat-77", "CAT-1", "L", "%", "_", "review", "title 4", "no such text")


@register("keyword_index", f"""
SELECT q, id FROM library, (VALUES {", ".join(f"('{q}')" for q in KEYWORDS)}) k(q) WHERE contains(lower(title), lower(q)) OR contains(lower(coalesce("catalogNo", '')), lower(q)) OR contains(lower(coalesce(notes, '')), lower(q))""", T.SQL)
def keyword_index(spark, d):
    """Several keywords, looked up in one index of all releases."""
    rows = T.releases(spark, d)
    index = KeywordIndex(folders.fresh(spark, "keywords"))
    index.create(rows)
    out = None
    for q in KEYWORDS:
        found = index.search(rows, q).select(F.lit(q).alias("q"), "id")
        out = found if out is None else out.unionByName(found)
    return out


def user(n):
    return F.concat(F.lit("u"), n.cast("string")).alias("userId")


@register("status_upsert_in_place", UPSERT_SQL)
def status_upsert_in_place(spark, d):
    """The statuses' snapshot after an upsert that rewrites the buckets it touches."""
    rel, k = T.releases(spark, d), F.col("id")
    kept = Snapshot(folders.fresh(spark, "statuses"), "releaseId")
    kept.create(rel.select(user(k % 2), k.alias("releaseId"), F.coalesce("status", F.lit("SKIP")).alias("status"), "priority"))
    kept.rewrite(rel.select(user(k % 3 % 2), k.alias("releaseId"), F.when(k % 4 == 0, "WANTED").alias("status"), F.when(k % 6 == 0, 1).alias("priority")), mutations.upsert_statuses)
    return kept.read(spark)


def with_status(releases: DataFrame, changes: DataFrame) -> DataFrame:
    """releases with the changed statuses in place of theirs; a change to DELETED takes the release away."""
    both = releases.join(changes.select(F.col("id").alias("__id"), F.col("status").alias("__status"), F.col("artistId").alias("__artist")), F.col("id") == F.col("__id"), "left")
    new = both.withColumns({"status": F.coalesce("__status", "status"), "artistId": F.coalesce("__artist", "artistId")})
    return new.where(~F.col("__status").eqNullSafe(F.lit("DELETED"))).select(*releases.columns)


@register("kept_stats", """
, after AS (SELECT CASE WHEN id % 40 = 3 THEN "artistId" % 5 ELSE "artistId" END AS "artistId", CASE WHEN id % 10 = 3 THEN 'OWNED' ELSE status END AS status, review, "isExcludedByDefault" OR coalesce(CASE WHEN id % 10 = 3 THEN 'OWNED' ELSE status END = 'EXCLUDED', false) AS excluded, no_cover, evidence, no_catalog FROM library WHERE id % 40 <> 13)
SELECT "artistId", count(*) AS total, count(*) FILTER (status = 'OWNED') AS owned, count(*) FILTER (status = 'NOT_OWNED') AS not_owned,
  count(*) FILTER (status = 'WANTED') AS wanted, count(*) FILTER (coalesce(status = 'PENDING_REVIEW', false) OR review) AS pending_review,
  count(*) FILTER (excluded) AS excluded, count(*) FILTER (no_cover) AS missing_cover, count(*) FILTER (evidence = 0) AS missing_source, count(*) FILTER (no_catalog) AS missing_catalog,
  CASE WHEN count(*) FILTER (NOT excluded) = 0 THEN 0 ELSE round(100.0 * count(*) FILTER (NOT excluded AND status = 'OWNED') / count(*) FILTER (NOT excluded))::INT END AS completion_rate
FROM after GROUP BY 1""", T.SQL)
def kept_stats(spark, d):
    """Statistics kept up to date over a change of every tenth release: new statuses, other artists, releases that go."""
    kept = Snapshot(folders.fresh(spark, "releases"), "id")
    kept.create(counted(spark, d))
    stats, k = folders.written(library.kept_stats(kept.read(spark)), "stats"), F.col("id")
    changes = T.releases(spark, d).where(k % 10 == 3).select("id", F.when(k % 40 == 13, "DELETED").otherwise("OWNED").alias("status"), F.when(k % 40 == 3, F.col("artistId") % 5).alias("artistId"))
    change = kept.rewrite(changes, with_status)
    return library.changed_stats(stats, change.before, change.after).drop("owned_in", "total_in")


@register("point_detail", """, owner AS (SELECT c_custkey AS id, c_name AS name FROM customer)
SELECT m.id, m.title, o.name AS "artistName", m.status, (SELECT count(*) FROM sources s WHERE s."releaseId" = m.id)::INT AS n_sources FROM mine m JOIN owner o ON m."artistId" = o.id WHERE m.id = 7""", USER_SQL)
def point_detail(spark, d):
    """One release from snapshots, each read by its key."""
    tables = (T.releases(spark, d).drop("status", "priority"), T.sources(spark, d), statuses(spark, d))
    rel, src, own = (Snapshot(folders.fresh(spark, n), k, blooms=(k,)) for n, k in (("releases", "id"), ("sources", "releaseId"), ("statuses", "releaseId")))
    for kept, rows in zip((rel, src, own), tables, strict=True):
        kept.create(rows)
    one = library.detail(rel.at(spark, 7), artists(spark, d), src.at(spark, 7), own.at(spark, 7), 7, "u1")
    return one.select("id", "title", "artistName", "status", F.size("sources").alias("n_sources"))
