"""The library of an artist: releases with sources and one user's status, filters, statistics, orders."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..functions.values import canonical_status, clamped_priority, rate
from ..plans.filters import Filters, evidence, is_evidence, mentions_review
from ..sources.folders import written

#: Fixed order of the groups of category completion, empty ones included.
GROUPS = [
    ("ORIGINAL_ALBUM", ["ORIGINAL_ALBUM"]),
    ("SINGLE", ["SINGLE"]),
    ("BEST_COLLECTION", ["BEST", "COLLECTION", "COMPILATION"]),
    ("LIVE", ["LIVE"]),
    ("REMIX", ["REMIX"]),
    ("OTHER", ["BOX", "EP", "OTHER"]),
]


def nest_sources(releases: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds `sources`, ordered by id; a release without any gets an empty array. Sources are grouped before the join."""
    nested = sources.groupBy("releaseId").agg(F.array_sort(F.collect_list(F.struct("id", "url", "label", "description"))).alias("sources"))
    joined = releases.join(nested, releases["id"] == nested["releaseId"], "left").drop("releaseId")
    return joined.withColumn("sources", F.coalesce("sources", F.expr("array()").cast(nested.schema["sources"].dataType)))


def with_evidence(releases: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds `evidence`, the number of sources that are not there for the cover alone: what counts and filters need of sources. A sum per release joins, no lists."""
    n = sources.where(is_evidence(F.col("description"))).groupBy("releaseId").agg(F.count("*").alias("evidence"))
    joined = releases.join(n, releases["id"] == n["releaseId"], "left").drop("releaseId")
    return joined.withColumn("evidence", F.coalesce("evidence", F.lit(0)))


def with_status(releases: DataFrame, statuses: DataFrame, user: str | None) -> DataFrame:
    """Adds the user's status and priority; without a user no status is shown. Unknown statuses show as none."""
    own = statuses.where(F.col("userId") == F.lit(user)).select("releaseId", canonical_status(F.col("status")).alias("status"), clamped_priority(F.col("priority")).alias("priority"))
    joined = releases.join(own, releases["id"] == own["releaseId"], "left").drop("releaseId")
    return joined.withColumn("priority", F.when(F.col("status").isNotNull(), F.col("priority")))


def library(releases: DataFrame, sources: DataFrame, statuses: DataFrame, user: str | None) -> DataFrame:
    return nest_sources(with_status(releases, statuses, user), sources)


def filtered(rows: DataFrame, filters: Filters) -> DataFrame:
    """Rows that pass. Filters of missing sources read `evidence` (with_evidence) where it is there, else `sources`."""
    return rows.where(filters.predicate(F.col("evidence") == 0 if "evidence" in rows.columns else F.size(evidence(F.col("sources"))) == 0 if "sources" in rows.columns else None))


def order() -> list[Column]:
    """By date, undated rows last, then title; ids settle ties."""
    return [F.asc_nulls_last("releaseDate"), F.col("title"), F.col("id")]


def ordered(rows: DataFrame) -> DataFrame:
    return rows.orderBy(*order())


def is_excluded() -> Column:
    return F.col("isExcludedByDefault") | F.coalesce(F.col("status") == "EXCLUDED", F.lit(False))


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def stat_columns() -> list[Column]:
    """All measures, for one grouping: a single pass with partial sums. Rows have `evidence` (with_evidence)."""
    has = lambda s: F.col("status") == s
    owned, total = count_where(~is_excluded() & has("OWNED")), count_where(~is_excluded())
    return [
        F.count("*").alias("total"),
        count_where(has("OWNED")).alias("owned"),
        count_where(has("NOT_OWNED")).alias("not_owned"),
        count_where(has("WANTED")).alias("wanted"),
        count_where(has("PENDING_REVIEW") | mentions_review(F.col("warnings"), F.col("notes"))).alias("pending_review"),
        count_where(is_excluded()).alias("excluded"),
        count_where(is_blank(F.col("coverUrl"))).alias("missing_cover"),
        count_where(F.col("evidence") == 0).alias("missing_source"),
        count_where(is_blank(F.col("catalogNo"))).alias("missing_catalog"),
        rate(owned, total).alias("completion_rate"),
    ]


def stats(rows: DataFrame, by: str = "artistId") -> DataFrame:
    """Measures of each artist. Rows with `sources` and no `evidence` get its count from them."""
    if "evidence" not in rows.columns:
        rows = rows.withColumn("evidence", F.size(evidence(F.col("sources"))))
    return rows.groupBy(by).agg(*stat_columns())


def changed_stats(kept: DataFrame, before: DataFrame, after: DataFrame, by: str = "artistId") -> DataFrame:
    """stats() after a change, from those before it and the changed releases as they were and as they are (with status and evidence): what they
    counted is taken back, what they count now is added. A release that moves, goes or comes is told by being in one of the two or under another artist. Artists without a release go.

    Only the changed rows are read and grouped; the kept statistics, a row for each artist, are joined with the sums of the artists that are touched."""
    measures = [*stat_columns()[:-1], count_where(~is_excluded() & (F.col("status") == "OWNED")).alias("owned_in"), count_where(~is_excluded()).alias("total_in")]
    names = [c for c in kept.columns if c not in (by, "completion_rate")]
    signed = lambda rows, sign: rows.groupBy(by).agg(*measures).select(by, *[(F.col(c) * sign).alias(c) for c in names])
    delta = signed(before, -1).unionByName(signed(after, 1)).groupBy(F.col(by).alias("__by")).agg(*[F.sum(c).alias(f"__{c}") for c in names])
    both = kept.join(delta, F.col(by).eqNullSafe(F.col("__by")), "full_outer")
    known = kept.schema[by].dataType.simpleString()
    # an artist that is new has no row of its own yet
    key = F.when(F.col("total").isNull(), F.col("__by")).otherwise(F.col(by)).cast(known).alias(by)
    now = both.select(key, *[(F.coalesce(c, F.lit(0)) + F.coalesce(f"__{c}", F.lit(0))).alias(c) for c in names]).where("total > 0")
    return now.withColumn("completion_rate", rate(F.col("owned_in"), F.col("total_in"))).select(*kept.columns)


def kept_stats(rows: DataFrame, by: str = "artistId") -> DataFrame:
    """stats() with what changed_stats() needs beside them: the two counts of the rate."""
    return rows.groupBy(by).agg(*stat_columns(), count_where(~is_excluded() & (F.col("status") == "OWNED")).alias("owned_in"), count_where(~is_excluded()).alias("total_in"))


def collection_counts(stats_rows: DataFrame) -> DataFrame:
    """Adds collectible (not excluded) and gap (not owned of these), never below 0."""
    collectible = F.greatest(F.lit(0), F.col("total") - F.col("excluded"))
    return stats_rows.withColumn("collectible", collectible).withColumn("gap", F.greatest(F.lit(0), F.col("collectible") - F.col("owned")))


def category_completion(rows: DataFrame, by: str = "artistId") -> DataFrame:
    """One row for each artist and group: position, group, owned, total, rate, over releases that are not excluded."""
    sums = []
    for key, names in GROUPS:
        member = F.col("category").isin(*names) & ~is_excluded()
        sums += [count_where(member & (F.col("status") == "OWNED")).alias(f"{key}_owned"), count_where(member).alias(f"{key}_total")]
    wide = rows.groupBy(by).agg(*sums)
    items = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(k).alias("grp"), F.col(f"{k}_owned").alias("owned"), F.col(f"{k}_total").alias("total")) for i, (k, _) in enumerate(GROUPS)])
    long = wide.select(by, F.explode(items).alias("g")).select(by, "g.*")
    return long.withColumn("rate", rate(F.col("owned"), F.col("total")))


def dashboard(artists: DataFrame, children: dict[str, DataFrame], n: int = 12) -> DataFrame:
    """The n artists changed last, with a count of each kind of child. Artists are cut first, so only their children are counted."""
    top = artists.orderBy(F.desc("updatedAt"), "id").limit(n)
    for name, child in children.items():
        counts = child.join(top.select(F.col("id").alias("artistId")), "artistId", "left_semi").groupBy("artistId").agg(F.count("*").alias(name))
        top = top.join(counts, top["id"] == counts["artistId"], "left").drop("artistId").withColumn(name, F.coalesce(name, F.lit(0)))
    return top


def detail(releases: DataFrame, artists: DataFrame, sources: DataFrame, statuses: DataFrame, release: object, user: str | None) -> DataFrame:
    """One release with its artist's name, sources and the user's status. The key reaches the scan of every table."""
    one = library(releases.where(F.col("id") == F.lit(release)), sources.where(F.col("releaseId") == F.lit(release)), statuses.where(F.col("releaseId") == F.lit(release)), user)
    names = artists.select(F.col("id").alias("artistId"), F.col("name").alias("artistName"))
    return one.join(names, "artistId")


def artist_options(artists: DataFrame) -> DataFrame:
    return artists.select("id", "name").orderBy("name", "id")


def serialised(rows: DataFrame) -> DataFrame:
    """(id, release): each release as JSON, dates as texts, absent fields as nulls, and `userStatus` null where the user has no known status."""
    own = F.when(F.col("status").isNotNull(), F.struct("status", "priority"))
    fields = [F.col(c).cast("string").alias(c) if t == "date" else F.col(c) for c, t in rows.dtypes if c not in ("status", "priority")]
    return rows.select("id", F.to_json(F.struct(*fields, own.alias("userStatus")), {"ignoreNullFields": "false"}).alias("release"))


def same_number(releases: DataFrame) -> DataFrame:
    """(id, others): releases whose catalogue number other releases of their artist have too, and how many. A count per number, no pairs."""
    numbered = releases.where(~is_blank(F.col("catalogNo"))).select("id", "artistId", "catalogNo")
    n = numbered.groupBy("artistId", "catalogNo").agg(F.count("*").alias("n")).where("n > 1")
    return numbered.join(n, ["artistId", "catalogNo"]).select("id", (F.col("n") - 1).alias("others"))


def numbered_positions(rows: DataFrame, by: str = "artistId") -> DataFrame:
    """Adds `position` of each release in its artist's library, in the order of ordered().

    Rows are sorted over all partitions by artist and order, and written with their place, so an artist of very many releases is spread over partitions; a row's position is its place
    less that of its artist's first row in the partition, plus the artist's rows in the partitions before. Only a row for each artist and partition is summed up in a window."""
    keys = [F.asc_nulls_first(by), *order()]
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()})
    placed = written(placed, "positions")
    parts = placed.groupBy(F.col(by).alias("__by"), F.col("__part").alias("__of")).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("__by").orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("__before", before)
    both = placed.join(parts, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__part") == F.col("__of")))
    return both.withColumn("position", (F.col("__at") - F.col("__first") + F.col("__before") + 1).cast("int")).drop("__part", "__at", "__by", "__of", "__first", "__n", "__before")


def previews(rows: DataFrame, n: int) -> DataFrame:
    """The first n rows in the library's order."""
    return ordered(rows).limit(n)
