"""Sole matches against matching all pairs, and their size on one common key."""

import random

import pytest

from tessera.operators import resolve

CANDIDATES = "taskId string, id string, title string, titleOriginal string, originalReleaseDate string, releaseDate string"
ALBUMS = "collectionId long, artistId long, artistName string, collectionName string, releaseDate string"


@pytest.mark.parametrize("seed", range(4))
def test_sole_matches_against_all_pairs(spark, seed):
    """Titles with two keys, albums that repeat with other names, ties and missing years."""
    rng = random.Random(seed)
    title, year = lambda: rng.choice(["Rose", "rose!", "Blue", "Red", "", None]), lambda: rng.choice(["1990-01-01", "1991", None, "x"])
    cand = spark.createDataFrame([(f"t{i % 3}", str(i), title(), title(), year(), year()) for i in range(60)], CANDIDATES)
    albums = spark.createDataFrame([(rng.randint(1, 12), rng.randint(1, 3), "a", title(), year()) for _ in range(rng.choice([3, 14]))], ALBUMS)
    pairs = resolve.title_year_matches(cand, albums, compose=False)
    keys, keyed = resolve.candidate_keys(cand, compose=False), resolve.album_keys(albums, compose=False)
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(resolve.sole_matches(keys, keyed)) == rows(resolve.unique_matches(pairs).select("taskId", "id", "album"))
    winner = spark.createDataFrame([("t0", 1), ("t1", 2)], "taskId string, artistId long")
    own = resolve.unique_matches(pairs.join(winner.withColumnRenamed("artistId", "w"), "taskId").where("album.artistId = w").drop("w"))
    assert rows(resolve.sole_matches(keys, keyed, winner)) == rows(own.select("taskId", "id", "album"))


def test_one_common_key(spark):
    """100,000 candidates and 100,000 albums of one key: ten milliards of pairs that no one makes."""
    cand = spark.range(100_000).selectExpr("'t' as taskId", "cast(id as string) as id", "'Same' as title", "'same!' as titleOriginal", "'1990' as originalReleaseDate", "cast(null as string) as releaseDate")
    albums = spark.range(1, 100_001).selectExpr("id as collectionId", "if(id = 5, 5, 6) as artistId", "'a' as artistName", "'SAME' as collectionName", "'1990-05-05' as releaseDate")
    keys, keyed = resolve.candidate_keys(cand, compose=False), resolve.album_keys(albums, compose=False)
    assert resolve.sole_matches(keys, keyed).count() == 0
    winner = spark.createDataFrame([("t", 5)], "taskId string, artistId long")
    own = resolve.sole_matches(keys, keyed, winner)
    assert own.count() == 100_000 and own.select("album.collectionId").distinct().first()[0] == 5


@pytest.mark.parametrize("seed", range(3))
def test_all_matches(spark, monkeypatch, seed):
    """Each match once, with its least album, of candidates and albums of several keys, in slices of a few matches."""
    monkeypatch.setattr(resolve, "UNIT", 5)
    rng = random.Random(seed)
    title, year = lambda: rng.choice(["Rose", "rose!", "Blue", "Red", "", None]), lambda: rng.choice(["1990-01-01", "1991", None, "x"])
    cand = spark.createDataFrame([(f"t{i % 3}", str(i % 50), title(), title(), year(), year()) for i in range(60)], CANDIDATES)
    albums = spark.createDataFrame([(rng.randint(1, 12), rng.randint(1, 3), "a", title(), year()) for _ in range(30)], ALBUMS)
    got = [(r.taskId, r.id, r.album) for r in resolve.title_year_matches(cand, albums, compose=False).collect()]
    want = {}
    for k in resolve.candidate_keys(cand, compose=False).collect():
        for a in resolve.album_keys(albums, compose=False).collect():
            if (k.key, k.year) == (a.key, a.year):
                want.setdefault((k.taskId, k.id, a.collectionId), []).append(a.album)
    least = lambda found: min(found, key=lambda a: (a.artistId, a.artistName, a.collectionName, a.releaseDate))
    assert sorted(map(repr, got)) == sorted(repr((t, i, least(found))) for (t, i, _), found in want.items())


def test_matches_of_one_key_are_dealt(spark, monkeypatch):
    """One key's matches come from all tasks of the join, and no shuffle moves them."""
    monkeypatch.setattr(resolve, "UNIT", 1000)
    cand = spark.range(300).selectExpr("'t' as taskId", "cast(id as string) as id", "'Same' as title", "'same!' as titleOriginal", "'1990' as originalReleaseDate", "cast(null as string) as releaseDate")
    albums = spark.range(1, 301).selectExpr("id as collectionId", "1 as artistId", "'a' as artistName", "'SAME' as collectionName", "'1990-05-05' as releaseDate")
    rows = resolve.title_year_matches(cand, albums, compose=False)
    sizes = rows.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == 90_000 and max(sizes) < 60_000
