"""Snapshots in place, reads by key, statistics kept up to date, positions of hot artists, the keyword index: each against its plain form."""

import os
import random

from pyspark.sql import functions as F

from tessera.operators import library, mutations
from tessera.plans.filters import Filters
from tessera.plans.keyword_index import KeywordIndex
from tessera.sources.snapshots import Snapshot, scanned_rows

FIELDS = "id long, artistId string, title string, releaseDate date, catalogNo string, notes string, coverUrl string, warnings array<string>, isExcludedByDefault boolean, status string, evidence long"


def releases(seed, n=300):
    rng = random.Random(seed)
    pick = lambda *x: rng.choice(x)
    return [(i, pick("a", "b", "c", None), f"T {i % 9}", None, pick(None, "", "K-1"), pick(None, "pending review"), pick("", "u"), [], pick(True, False), pick(None, "OWNED", "NOT_OWNED", "WANTED", "EXCLUDED", "PENDING_REVIEW"), pick(0, 0, 2)) for i in range(n)]


def rows(df):
    return sorted(map(repr, df.collect()))


def files(path):
    return {d: sorted(f for f in os.listdir(f"{path}/{d}") if f.endswith(".parquet")) for d in os.listdir(path) if d.startswith("__bucket=")}


def test_upsert_in_place(spark, tmp_path):
    """Files of other buckets keep their names; the result is the whole new snapshot's, and the change tells what was and is."""
    old = spark.createDataFrame([(f"u{i % 2}", i, "OWNED", 3) for i in range(500)], "userId string, releaseId long, status string, priority int")
    changes = spark.createDataFrame([("u1", 7, "WANTED", None), ("u0", 7, None, 1), ("u0", 9999, None, None)], "userId string, releaseId long, status string, priority int")
    kept = Snapshot(f"{tmp_path}/s", "releaseId", buckets=16)
    kept.create(old)
    before = files(kept.path)
    change = kept.rewrite(changes, mutations.upsert_statuses)
    assert rows(kept.read(spark)) == rows(mutations.upsert_statuses(old, changes)) and len(change.buckets) <= 2
    after = files(kept.path)
    assert {d for d in before if before[d] != after.get(d)} == {f"__bucket={b}" for b in change.buckets} and len(before) > 10
    assert rows(change.before) == rows(old.where("releaseId = 7")) and change.after.count() == 3
    # again: nothing else changes
    kept.rewrite(changes, mutations.upsert_statuses)
    assert rows(kept.read(spark)) == rows(mutations.upsert_statuses(old, changes))


def test_a_bucket_that_becomes_empty(spark, tmp_path):
    kept = Snapshot(f"{tmp_path}/s", "id", buckets=64)
    kept.create(spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id long, v string"))
    gone = lambda old, new: old.join(new.select(F.col("id").alias("x")), F.col("id").eqNullSafe(F.col("x")), "left_anti")
    change = kept.rewrite(spark.createDataFrame([(2,), (None,)], "id long"), gone)
    assert rows(kept.read(spark)) == ["Row(id=1, v='a')"] and change.after.count() == 0 and change.before.count() == 2


def test_a_key_reads_few_row_groups(spark, tmp_path):
    """Of 200,000 rows in sixteen buckets a key's read scans a row group at most, and none if the bloom filter does not know it."""
    kept = Snapshot(f"{tmp_path}/s", "id", blooms=("id",), buckets=16)
    kept.create(spark.range(200_000).selectExpr("id * 2 as id", "sha2(cast(id as string), 512) as v"))
    one = kept.at(spark, 4444)
    assert [r.id for r in one.collect()] == [4444] and scanned_rows(one) < 200_000 / 16 and scanned_rows(kept.at(spark, 4444, 6)) < 2 * 200_000 / 16
    assert scanned_rows(kept.at(spark, 4445)) == 0
    assert "__bucket" in one._jdf.queryExecution().executedPlan().toString() and kept.at(spark, None).count() == 0


def test_a_hot_key_is_spread(spark, tmp_path):
    old = (spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes"), spark.conf.get("spark.sql.adaptive.coalescePartitions.minPartitionSize"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        kept = Snapshot(f"{tmp_path}/s", "k", buckets=4)
        kept.create(spark.range(0, 20_000, 1, 8).selectExpr("7 as k", "sha2(cast(id as string), 256) as v"))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old[0])
    assert kept.at(spark, 7).count() == 20_000 and len(next(iter(files(kept.path).values()))) > 1


def test_stats_kept_up_to_date(spark):
    """After each of three changes the kept statistics are those from scratch; only changed rows are given."""
    now = {r[0]: r for r in releases(1)}
    frame = lambda of: spark.createDataFrame(list(of), FIELDS)
    kept = library.kept_stats(frame(now.values()))
    rng = random.Random(2)
    for step in range(3):
        ids = rng.sample(range(300), 40) + [1000 + step]
        new = {r[0]: r for r in releases(10 + step) if r[0] in ids}
        if step == 0:
            new = {i: (*r[:1], "z", *r[2:]) for i, r in new.items()}  # a new artist
        gone = set(ids[:7])
        if step == 2:
            gone |= {i for i, r in now.items() if r[1] == "z"}  # an artist without a release
        touched = set(ids) | gone
        before = [now[i] for i in touched if i in now]
        now = {i: r for i, r in {**now, **new}.items() if i not in gone}
        kept = library.changed_stats(kept, frame(before), frame([now[i] for i in touched if i in now]))
        assert rows(kept.drop("owned_in", "total_in")) == rows(library.stats(frame(now.values())))
    assert "z" not in {r.artistId for r in kept.collect()}


def test_positions_of_a_hot_artist(spark):
    """An artist of most releases; the same positions as by a window, null artists and dates too."""
    many = spark.range(5000).selectExpr("id", "case when id % 10 < 8 then 'hot' when id % 10 = 8 then null else concat('a', id % 30) end as artistId", "concat('T', id % 7) as title", "if(id % 5 = 0, null, date_add(date'2000-01-01', cast(id % 50 as int))) as releaseDate")
    got = library.numbered_positions(many.repartition(5))
    want = many.withColumn("position", F.row_number().over(library.Window.partitionBy("artistId").orderBy(*library.order())))
    assert rows(got.select(*want.columns)) == rows(want) and got.select(*want.columns).dtypes == want.dtypes
    assert library.numbered_positions(many.where("false")).count() == 0


def test_keyword_index(spark, tmp_path):
    """Every keyword gives what the filter gives."""
    odd = [(1, "50% off_now", None, "x"), (2, "50 percent", "K_1", None), (3, "Ünïcödé 日本語 題", "", "ab"), (4, None, None, None), (5, "aaaa", "aa", "AAAAB"), (6, "İstanbul", "ab", "cd")]
    data = spark.createDataFrame([*odd, *[(100 + i, f"Title {i}", f"CAT-{i % 30}", None) for i in range(300)]], "id long, title string, catalogNo string, notes string")
    index = KeywordIndex(f"{tmp_path}/i")
    index.create(data)
    for q in ("50%", "0% o", "f_n", "%", "_", "K_1", "日本語", "日本", "ünï", "aaa", "aaaab", "b", "", "  title 29 ", "TITLE", "cat-2", "İst", "nothing like it", "abc"):
        assert rows(index.search(data, q)) == rows(library.filtered(data, Filters(q=q))), q
    assert index.candidates(spark, "ti") is None and index.candidates(spark, "zzz").count() == 0 and index.candidates(spark, "title 29").count() == 11
    empty = KeywordIndex(f"{tmp_path}/e")
    empty.create(data.where("false"))
    assert empty.search(data.where("false"), "title").count() == 0
