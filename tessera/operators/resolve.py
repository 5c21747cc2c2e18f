"""Entity resolution against an external album list: exact title and year, unique matches, majority votes."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import has_cjk, is_blank, is_composite, nfkc, title_key, trimmed
from ..functions.urls import STORE_HOSTS, artwork_600, secure
from ..functions.values import leading_year
from ..sources.folders import written

MOST_SAFE = (1 << 53) - 1
MOST_ALBUMS = 200
UNIT = 1_000_000  #: matches of one key that a task makes at once


def valid_albums(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Albums whose ids and names can be used; optional texts over their length become null."""
    name = lambda c, n: F.when((F.length(trimmed(F.col(c))) > 0) & (F.length(trimmed(F.col(c))) <= n), trimmed(F.col(c)))
    kind = lambda c, v: (F.coalesce(F.col(c), F.lit(v)) == v) if c in rows.columns else F.lit(True)
    ids = F.lit(True)
    for c in ("collectionId", "artistId"):
        ids &= F.col(c).between(1, MOST_SAFE)
    out = rows.where(kind("wrapperType", "collection") & kind("collectionType", "Album") & ids)
    out = out.select(*keep, "collectionId", "artistId", name("artistName", 500).alias("artistName"), name("collectionName", 500).alias("collectionName"), name("releaseDate", 100).alias("releaseDate"), name("artworkUrl100", 2048).alias("artworkUrl100"), name("collectionViewUrl", 2048).alias("collectionViewUrl"))
    return out.where("artistName is not null and collectionName is not null")


def album_list(rows: DataFrame, limit: int = MOST_ALBUMS, search: str = "search") -> DataFrame:
    """The first `limit` results (1 to MOST_ALBUMS) of each search, by their position from 0, and of these the usable albums."""
    most = max(1, min(MOST_ALBUMS, int(limit)))
    taken = rows.where(F.col("position") < most)
    return valid_albums(taken, keep=(search,))


def candidate_keys(candidates: DataFrame, compose: bool = True) -> DataFrame:
    """(taskId, id, key, year): a row for each different title key of a candidate with a year."""
    keys = F.array_distinct(F.filter(F.array(title_key(F.col("title"), compose), title_key(F.col("titleOriginal"), compose)), lambda k: k != ""))
    year = F.coalesce(leading_year(F.col("originalReleaseDate")), leading_year(F.col("releaseDate")))
    return candidates.select("taskId", "id", F.explode(keys).alias("key"), year.alias("year")).where("year is not null")


def album_keys(albums: DataFrame, compose: bool = True) -> DataFrame:
    """(key, year, artistId, collectionId, album) of albums with a title key and a year."""
    rows = albums.select(title_key(F.col("collectionName"), compose).alias("key"), leading_year(F.col("releaseDate")).alias("year"), "artistId", "collectionId", F.struct(*albums.columns).alias("album"))
    return rows.where("key <> '' and year is not null")


def title_year_matches(candidates: DataFrame, albums: DataFrame, compose: bool = True) -> DataFrame:
    """(taskId, id, album): candidates and albums of one title key and year, once for each album. Keys are exploded, so the join is an
    equi-join. Its result is all matches, as many as there are; sole_matches() needs none of them.

    Matches are rows of the join as they come out, with no shuffle of their own: only a candidate of several keys and an album of several can meet twice, and these
    alone are grouped. A key's candidates are dealt to slices of some UNIT matches each, and the join's tasks are as many as spark.sql.shuffle.partitions says:
    they are few bytes that give many rows, which would otherwise be read as a task or two."""
    keys = written(candidate_keys(candidates, compose).distinct(), "keys")
    held = written(album_keys(albums, compose).groupBy("key", "year", "collectionId").agg(F.min("album").alias("album")), "albums")
    many = lambda *by: F.count("*").over(Window.partitionBy(*by)) > 1
    keys, held = keys.withColumn("asks", many("taskId", "id")), held.withColumn("repeats", many("collectionId"))
    again = keys.where("asks").join(held.where("repeats"), ["key", "year"]).groupBy("taskId", "id", "collectionId").agg(F.min("album").alias("album"))
    # slices of a key: as many as its matches make units, a candidate each at most
    counts = keys.groupBy("key", "year").agg(F.count("*").alias("n")).join(held.groupBy("key", "year").agg(F.count("*").alias("m")), ["key", "year"])
    cut = counts.select("key", "year", F.least("n", F.ceil(F.col("n") * F.col("m") / F.lit(UNIT))).alias("slices")).where("slices > 1")
    slices = F.coalesce("slices", F.lit(1))
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = keys.join(cut, ["key", "year"], "left").withColumn("slice", F.pmod(F.xxhash64("taskId", "id"), slices)).drop("slices").repartition(parts, "key", "year", "slice")
    found = held.join(cut, ["key", "year"], "left").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), slices - 1))).drop("slices").repartition(parts, "key", "year", "slice")
    once = asked.join(found, ["key", "year", "slice"]).where("not (asks and repeats)").select("taskId", "id", "album")
    return once.unionByName(again.select("taskId", "id", "album"))


def unique_matches(matches: DataFrame) -> DataFrame:
    """Candidates with exactly one album, of title_year_matches()."""
    return matches.groupBy("taskId", "id").agg(F.count("*").alias("n"), F.min("album").alias("album")).where("n = 1").drop("n")


def sole_matches(keys: DataFrame, albums: DataFrame, artists: DataFrame | None = None) -> DataFrame:
    """(taskId, id, album): the candidates of candidate_keys() to which exactly one album of album_keys() belongs; with (taskId,
    artistId), one album of their task's artist. Albums of a key (and artist) become one row with their least and greatest id before they meet a candidate, and a
    candidate has one album if these are the same over its keys: however common a key is, each of its candidates meets one row."""
    by = ["key", "year", *(["artistId"] if artists is not None else [])]
    held = albums.groupBy(*by).agg(F.min(F.struct("collectionId", "album")).alias("least"), F.max("collectionId").alias("most"))
    asked = keys if artists is None else keys.join(artists, "taskId")
    found = asked.join(held, by).groupBy("taskId", "id").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    return found.where(F.col("least.collectionId") == F.col("most")).select("taskId", "id", "least.album")


def majority(votes: DataFrame, group: list[str], choice: str, evidence: str, least: int = 2) -> DataFrame:
    """The choice of each group with the most distinct evidence: at least `least`, more than any other and more than half of all. Groups without such a choice have no row."""
    counts = votes.groupBy(*group, choice).agg(F.countDistinct(evidence).alias("n"))
    by = Window.partitionBy(*group)
    ranked = counts.withColumn("place", F.row_number().over(by.orderBy(F.desc("n"), choice))).withColumn("second", F.lead("n").over(by.orderBy(F.desc("n"), choice))).withColumn("all", F.sum("n").over(by))
    return ranked.where((F.col("place") == 1) & (F.col("n") >= max(1, least)) & ~F.coalesce(F.col("second") == F.col("n"), F.lit(False)) & (2 * F.col("n") > F.col("all"))).select(*group, choice, "n")


def votes_of(matches: DataFrame) -> DataFrame:
    return matches.select("taskId", F.col("album.artistId").alias("artistId"), F.col("album.collectionId").alias("collectionId"))


def dominant_artist(candidates: DataFrame, albums: DataFrame, least: int = 2, compose: bool = True) -> DataFrame:
    """(taskId, artistId, n): the artist to whom most uniquely matched albums belong."""
    return majority(votes_of(sole_matches(candidate_keys(candidates, compose), album_keys(albums, compose))), ["taskId"], "artistId", "collectionId", least)


def native_name(matches: DataFrame, least: int = 2) -> DataFrame:
    """(taskId, name, n) of matches that are unique for the winning artist: the one native-script name that most albums carry; composite credits do not count."""
    names = matches.select("taskId", trimmed(nfkc(F.col("album.artistName"))).alias("name"), F.col("album.collectionId").alias("collectionId"))
    return majority(names.where(has_cjk(F.col("name")) & ~is_composite(F.col("name"), compose=False)), ["taskId"], "name", "collectionId", least)


def enrich(candidates: DataFrame, artists: DataFrame, albums: DataFrame, compose: bool = True) -> tuple[DataFrame, DataFrame]:
    """(candidates with missing covers filled, artists (taskId, name, nameRomaji, query) with a native name where one wins).

    Keys, for which titles are composed outside the JVM, and the matches of the winning artists are each made once and written: several results read them."""
    keys, keyed = written(candidate_keys(candidates, compose), "keys"), written(album_keys(albums, compose), "albums")
    winner = majority(votes_of(sole_matches(keys, keyed)), ["taskId"], "artistId", "collectionId").select("taskId", "artistId")
    own = written(sole_matches(keys, keyed, winner), "matches")
    covers = own.select("taskId", "id", artwork_600(F.col("album.artworkUrl100")).alias("__art"), secure(F.col("album.collectionViewUrl"), STORE_HOSTS).alias("__page")).where("__art is not null and __page is not null")
    rows = candidates.join(covers, ["taskId", "id"], "left")
    fill = is_blank(F.col("coverImageUrl")) & F.col("__art").isNotNull()
    rows = rows.withColumn("coverImageSourceUrl", F.when(fill, F.col("__page")).otherwise(F.col("coverImageSourceUrl"))).withColumn("coverImageUrl", F.when(fill, F.col("__art")).otherwise(F.col("coverImageUrl")))
    local = native_name(own).select("taskId", F.col("name").alias("__name"))
    named = artists.join(local, "taskId", "left")
    swap = ~has_cjk(F.col("name")) & F.col("__name").isNotNull()
    latin = F.coalesce(F.nullif(trimmed(F.col("query")), F.lit("")), F.col("name"))
    named = named.withColumn("nameRomaji", F.when(swap, F.coalesce("nameRomaji", F.when(~has_cjk(latin), latin))).otherwise(F.col("nameRomaji"))).withColumn("name", F.when(swap, F.col("__name")).otherwise(F.col("name")))
    return rows.drop("__art", "__page"), named.drop("__name")


def lookup_by_name(artists: DataFrame, names: DataFrame, fold_case: bool) -> DataFrame:
    """(name, id): the artist of each trimmed name. Case folded: the oldest wins; exact: the least id."""
    wanted = names.select(trimmed(F.col("name")).alias("name")).distinct()
    key: Column = F.lower("name") if fold_case else F.col("name")
    order = F.struct("createdAt", "id") if fold_case else F.struct("id")
    found = artists.groupBy(key.alias("key")).agg(F.min_by("id", order).alias("id"))
    return wanted.withColumn("key", key).join(found, "key").select("name", "id")


def resolve_or_create(artists: DataFrame, names: DataFrame) -> dict[str, DataFrame]:
    """The artist of each trimmed name of an import: `found` (name, id) by exact name, the least id, or else a new one; and `artists` with the new ones."""
    wanted = names.select(trimmed(F.col("name")).alias("name")).where("name <> ''").distinct()
    known = lookup_by_name(artists, wanted, fold_case=False)
    fresh = wanted.join(known, "name", "left_anti").select("name", F.concat(F.lit("artist:"), F.col("name")).alias("id"))
    return {"found": known.select("name", F.col("id").cast("string").alias("id")).unionByName(fresh), "artists": artists.unionByName(fresh, allowMissingColumns=True)}
