"""Operators of the library, the gate, imports and changes, on small tables."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import export, importing, library, mutations, provenance, quality, research, resolve, selection, tasks
from tessera.plans.filters import COVER_ROLE, Filters
from tessera.sources import xlsx

LIBRARY = """id string, artistId string, category string, title string, releaseDate date, format string, catalogNo string, isReissue boolean,
 isRemaster boolean, isExcludedByDefault boolean, confidence string, warnings array<string>, notes string, coverUrl string,
 sources array<struct<id:string,url:string,label:string,description:string>>, status string, priority int"""


def release(i, **more):
    row = dict(id=i, artistId="a", category="ORIGINAL_ALBUM", title="Title", releaseDate=datetime.date(1985, 9, 5), format="CD", catalogNo="K32X-30", isReissue=False, isRemaster=False, isExcludedByDefault=False, confidence="HIGH", warnings=[], notes=None, coverUrl="https://x.example/c.jpg", sources=[("s", "https://x.example", None, None)], status="OWNED", priority=3)
    return tuple((row | more).values())


@pytest.fixture(scope="module")
def two(spark):
    rows = [release("r1"), release("r2", releaseDate=datetime.date(1994, 2, 9), catalogNo=None, coverUrl="", sources=[], warnings=["PENDING_REVIEW: missing catalogNumber"], status="PENDING_REVIEW", title="Other")]
    return spark.createDataFrame(rows, LIBRARY)


@pytest.mark.parametrize(("fields", "ids"), [
    (dict(q="k32x"), ["r1"]), (dict(missingSource="true"), ["r2"]), (dict(missingCover="true"), ["r2"]), (dict(missingCatalog="true"), ["r2"]), (dict(pendingReview="true"), ["r2"]),
    (dict(gap="true"), ["r2"]), (dict(decade="1980s"), ["r1"]), (dict(decade="custom", yearFrom="1990", yearTo="1999"), ["r2"]), (dict(), ["r1", "r2"]), (dict(decade="custom"), ["r1", "r2"]), (dict(q="%"), []), (dict(category="none"), []),
])
def test_filters(two, fields, ids):
    assert sorted(r.id for r in library.filtered(two, Filters(**fields)).collect()) == ids


def test_filters_default_status_and_cover_role(spark):
    rows = spark.createDataFrame([release("r", status=None, sources=[("s", "u", None, COVER_ROLE)])], LIBRARY)
    for f in (dict(status="NOT_OWNED"), dict(gap="true"), dict(missingSource="true")):
        assert library.filtered(rows, Filters(**f)).count() == 1
    assert Filters.of({"q": ["a", "b"], "status": "", "x": "y"}) == Filters(q="a")


def test_stats(spark):
    rows = spark.createDataFrame([release("1", coverUrl=None, sources=[]), release("2", status="WANTED", coverUrl=None, sources=[]), release("3", status="NOT_OWNED", category="SINGLE", coverUrl=None, sources=[]), release("4", status="EXCLUDED", coverUrl=None, sources=[]), release("5", isExcludedByDefault=True, coverUrl=None, sources=[])], LIBRARY)
    s = library.stats(rows).first()
    assert (s.total, s.owned, s.wanted, s.excluded, s.completion_rate, s.missing_cover, s.missing_source) == (5, 2, 1, 2, 33, 5, 5)
    groups = library.category_completion(rows).orderBy("position").collect()
    assert [(g.grp, g.total) for g in groups][:2] == [("ORIGINAL_ALBUM", 2), ("SINGLE", 1)] and len(groups) == 6


def test_private_status(spark):
    rel = spark.createDataFrame([("r",)], "id string")
    st = spark.createDataFrame([("u1", "r", "OWNED", 9), ("u2", "r", "want", None)], "userId string, releaseId string, status string, priority int")
    seen = lambda u: [(r.status, r.priority) for r in library.with_status(rel, st, u).collect()]
    assert (seen("u1"), seen("u2"), seen("u3"), seen(None)) == ([("OWNED", 5)], [("WANTED", 3)], [(None, None)], [(None, None)])


def test_export(spark):
    rows = spark.createDataFrame([release("r", catalogNo="KIDS-111", sources=[("1", "https://a", None, None), ("2", "https://c", None, COVER_ROLE), ("3", "https://b", None, "x")]), release("s", status=None, priority=None)], LIBRARY)
    a, b = export.export(rows).orderBy(F.desc("来源 URL")).collect()
    assert (a["收藏状态"], a["原版品番"], a["来源 URL"], a["封面来源 URL"]) == ("OWNED", "KIDS-111", "https://a\nhttps://b", "https://c") if a["收藏状态"] == "OWNED" else True
    assert {r["收藏状态"] for r in (a, b)} == {"OWNED", "NOT_OWNED"}
    assert export.file_name("Shelf", 'a/b:"c"\\', datetime.date(2024, 5, 6)) == "Shelf_a_b__c___20240506.xlsx"


CANDIDATE = """taskId string, id string, position int, title string, category string, artistCredit string, format string, releaseDate string, originalReleaseDate string, catalogNumber string, label string,
 isReissue boolean, isRemaster boolean, isExcludedByDefault boolean, confidence string, warnings array<string>, notes string, editionType string, originalPrice string, barcode string, coverImageUrl string, coverImageSourceUrl string,
 sources array<struct<title:string,url:string,sourceType:string>>, target string, excludeReissues boolean"""


def candidate(**more):
    row = dict(taskId="t", id="candidate-1", position=0, title="Title", category="SINGLE", artistCredit="A", format="CD", releaseDate="1985-09-05", originalReleaseDate=None, catalogNumber="K-1", label="L", isReissue=None, isRemaster=None, isExcludedByDefault=False, confidence="HIGH", warnings=[], notes=None, editionType=None, originalPrice=None, barcode=None, coverImageUrl=None, coverImageSourceUrl=None, sources=[("s", "https://shop.example", "other")], target="ORIGINAL_CD", excludeReissues=True)
    assert not set(more) - set(row)
    return tuple((row | more).values())


def gated(spark, *rows):
    return quality.gate(spark.createDataFrame(list(rows), CANDIDATE), F.col("target"), F.col("excludeReissues"))


@pytest.mark.parametrize(("change", "confidence", "excluded", "warning"), [
    (dict(confidence="LOW"), "HIGH", False, ""), (dict(releaseDate=None), "MEDIUM", False, ""), (dict(catalogNumber=""), "MEDIUM", False, "catalogNumber"), (dict(sources=[]), "LOW", False, "source"),
    (dict(sources=[("Wiki", "https://ja.wikipedia.org/x", "other")]), "MEDIUM", False, "only wiki source"), (dict(format="LP"), "MEDIUM", True, "non-CD"), (dict(isReissue=True), "MEDIUM", True, "reissue excluded by scope"),
    (dict(isRemaster=True), "MEDIUM", True, "remaster excluded by scope"), (dict(warnings=["suspected hallucination of a number"]), "LOW", False, ""), (dict(label=None), "HIGH", False, ""), (dict(format="8cmCD"), "HIGH", False, ""), (dict(format="CDシングル"), "HIGH", False, ""),
    (dict(format="unknown", releaseDate=None), "LOW", False, "format"),
])
def test_gate(spark, change, confidence, excluded, warning):
    r = gated(spark, candidate(**change)).first()
    assert (r.confidence, r.isExcludedByDefault) == (confidence, excluded)
    assert any(warning in w for w in r.warnings) if warning else len(r.warnings) == len(change.get("warnings", []))


def test_gate_is_idempotent(spark):
    rng = random.Random(1)
    pick = lambda *x: rng.choice(x)
    rows = [candidate(id=str(i), format=pick("CD", "LP", "unknown", None, "DVD"), releaseDate=pick(None, "1999"), catalogNumber=pick("", "1"), label=pick(None, "l"), isReissue=pick(None, True), isRemaster=pick(False, True), confidence=pick("LOW", "HIGH"), warnings=pick([], ["source?"], ["guessed"]), sources=pick([], [("wiki", "https://x.example", "other")])) for i in range(60)]
    one = gated(spark, *rows)
    two = quality.gate(one.drop("quality"), F.col("target"), F.col("excludeReissues"))
    pairs = lambda df: {r.id: (r.isExcludedByDefault, tuple(r.warnings)) for r in df.collect()}
    assert pairs(one) == pairs(two)


def test_documents(spark):
    head = '"artist":{"name":"A","country":"JP"},"collectionScope":{"target":"ALL_CD","excludeReissues":false,"includeCollaborations":true}'
    good = "Here: ```json\n{" + head + ',"releases":[{"title":"T","artistCredit":"A","category":"COMPILATION","format":5,"isReissue":"yes","coverImageUrl":"javascript:x","sources":[{"url":"https://a.example"}]},{"title":"U","artistCredit":"A","sources":[{"url":"https://a.example"},{"url":"ftp://b"}],"warnings":[1]}]}\n```'
    bad = "{" + head + ',"releases":[{"artistCredit":"A"}]}'
    rows, errors = research.parse_documents(spark.createDataFrame([("g", good), ("b", bad), ("n", "nothing"), ("u", '{"a":'), ("z", None)], "taskId string, text string"))
    got = rows.orderBy("position").collect()
    assert [(r.id, r.category, r.format, r.isReissue, r.coverImageUrl, len(r.sources)) for r in got] == [("candidate-1", "OTHER", None, None, None, 1), ("candidate-2", "OTHER", None, None, None, 0)]
    assert {r.taskId for r in errors.collect()} == {"b", "n", "u", "z"}


def test_candidate_import(spark):
    rows = gated(spark, candidate(id="c1"), candidate(id="c2", position=1), candidate(id="c3", position=2, catalogNumber=None), candidate(id="c4", position=3, catalogNumber=None), candidate(id="c5", position=4, title="Old"), candidate(id="c6", position=5))
    ids = spark.createDataFrame([("t", f"c{i}") for i in range(1, 6)], "taskId string, id string")
    old = spark.createDataFrame([("x", "a", "Old", "K-1")], "id string, artistId string, title string, catalogNo string")
    out = research.import_candidates(rows, ids, old, "a", "u")
    assert sorted(r.id for r in out["releases"].collect()) == ["t:c1", "t:c3", "t:c4"]
    assert tuple(out["counters"].first()) == (3, 2, 2, 0)
    assert {r.releaseId: (r.status, r.priority) for r in out["statuses"].collect()}["t:c1"] == ("NOT_OWNED", 2)
    assert research.unknown_ids(rows, spark.createDataFrame([("t", "zz")], "taskId string, id string")).count() == 1


def test_candidate_edits(spark):
    rows = gated(spark, candidate(id="c1", catalogNumber=None), candidate(id="c2"))
    edit = rows.where("id = 'c1'").withColumn("catalogNumber", F.lit("N")).select("taskId", "id", *research.EDITED)
    got = {r.id: r for r in research.edited(rows, edit).collect()}
    assert got["c1"].confidence == "HIGH" and not got["c1"].warnings and got["c2"].confidence == "HIGH"


def test_release_sources(spark):
    given = spark.createDataFrame([([("a", "u1", "x"), ("b", "u2", "y"), ("c", "u1", "z")], "https://music.apple.com/1")], "s array<struct<title:string,url:string,sourceType:string>>, c string")
    r = given.select(provenance.release_sources(F.col("s"), F.col("c")).alias("r")).first().r
    assert [(x.url, x.label, x.description) for x in r] == [("u1", "c", "z"), ("u2", "b", "y"), ("https://music.apple.com/1", "Apple Music", COVER_ROLE)]


ALBUM = "collectionId long, artistId long, artistName string, collectionName string, releaseDate string, artworkUrl100 string, collectionViewUrl string"


def test_resolution(spark):
    names = "taskId string, id string, title string, titleOriginal string, releaseDate string, originalReleaseDate string, coverImageUrl string, coverImageSourceUrl string"
    cand = spark.createDataFrame([("t", str(i), f"Album {i}", None, "1990-01-01", None, "mine" if i == 2 else None, None) for i in range(1, 4)] + [("w", "1", "Album 1", "ALBUM-1", "1990", None, None, None), ("w", "2", "album 1", None, "1990", None, None, None)], names)
    art, page = "http://is1.mzstatic.com/100x100bb.jpg", "http://music.apple.com/x"
    albums = resolve.valid_albums(spark.createDataFrame([(i, 7, "山田花子", f"Ａlbum {i}", "1990-05-05", art, page) for i in range(1, 4)] + [(9, 8, "B", "Album 3", "1990", art, page), (0, 7, "x", "Album 1", "1990", art, page), (5, 7, " ", "Album 1", "1990", art, page)], ALBUM))
    assert albums.count() == 4
    assert [tuple(r) for r in resolve.dominant_artist(cand, albums).collect()] == [("t", 7, 2)]  # w's two candidates meet one album
    rows, artists = resolve.enrich(cand, spark.createDataFrame([("t", "Hanako", None, "Hanako N"), ("w", "Hanako", None, "")], "taskId string, name string, nameRomaji string, query string"), albums)
    got = {(r.taskId, r.id): r.coverImageUrl for r in rows.collect()}
    assert got[("t", "1")] == "https://is1.mzstatic.com/600x600bb.jpg" and got[("t", "2")] == "mine" and got[("w", "1")] is None
    assert {r.taskId: (r.name, r.nameRomaji) for r in artists.collect()} == {"t": ("山田花子", "Hanako N"), "w": ("Hanako", None)}
    assert resolve.enrich(cand, artists, albums.where("false"))[0].where("coverImageUrl is not null").count() == 1


def test_majority_ties(spark):
    votes = spark.createDataFrame([("tie", "a", 1), ("tie", "a", 2), ("tie", "b", 3), ("tie", "b", 4), ("half", "a", 1), ("half", "a", 2), ("half", "b", 3), ("half", "c", 4), ("win", "a", 1), ("win", "a", 2), ("win", "a", 2), ("few", "a", 1)], "g string, c string, e int")
    assert [tuple(r) for r in resolve.majority(votes, ["g"], "c", "e").collect()] == [("win", "a", 2)]


def test_workbook_import(spark, tmp_path):
    head = ["分类", "标题", "原版  CD\n发行日", "格式", "品番", "是否再版", "收集状态", "优先级", "是否纳入", "来源 URL"]
    a = [["x", "First", "1985/09/05", "CD", "K-1", "再版", "想买", 9, "", "https://a.example"], [""] * 10, ["x", "", "1985年9月5日", "", "", "原版", "", "", "否", ""]]
    c = [["Live", "Second", 31295, "SHM-CD", "K-2", "", "已拥有", "必收", "", ""]]
    (tmp_path / "b.xlsx").write_bytes(xlsx.workbook({"A_原创专辑原版CD": (head, a), "总览": (head, a), "C_精选现场混音": (head, c)}))
    rows = importing.typed_rows(xlsx.read(spark, f"file://{tmp_path}/b.xlsx"))
    got = {r.rowId: r for r in rows.collect()}
    assert sorted(got) == ["b.xlsx:A_原创专辑原版CD:2", "b.xlsx:A_原创专辑原版CD:3", "b.xlsx:C_精选现场混音:2"]
    first, blank, second = (got[k] for k in sorted(got))
    assert (first.category, first.releaseDate, first.priority, first.status, first.isReissue) == ("ORIGINAL_ALBUM", datetime.date(1985, 9, 5), 5, "WANTED", True)
    assert (blank.status, blank.errors, blank.format, blank.priority) == ("EXCLUDED", [importing.NO_TITLE], "CD", 3)
    assert (second.category, second.releaseDate, second.priority, second.format) == ("LIVE", datetime.date(1985, 9, 5), 1, "SHM_CD")
    old = spark.createDataFrame([("r9", "a", "K-2", "x", None, "CD"), ("r1", "a", "K-2", "y", None, "CD")], "id string, artistId string, catalogNo string, title string, releaseDate date, format string")
    found = importing.with_duplicates(rows, old, F.lit("a"))
    assert tuple(found.agg(*importing.preview_columns()).first()) == (3, 2, 1, 1)
    assert {r.rowId: r.duplicateId for r in found.where("duplicateId is not null").collect()} == {second.rowId: "r1"}


def test_apply_import(spark):
    rel = "id string, artistId string, category string, title string, releaseDate date, format string, catalogNo string, label string, isReissue boolean, notes string, coverUrl string, importBatchId string"
    releases = spark.createDataFrame([("r1", "a", "LIVE", "Old", None, "CD", "K", "keep", False, "n", "c", None)], rel)
    row = "rowId string, sheetName string, rowNumber int, artistId string, category string, title string, releaseDate date, format string, catalogNo string, label string, isReissue boolean, notes string, coverUrl string, sourceUrl string, priority int, status string, errors array<string>, duplicateId string"
    make = lambda n, dup, url, errors=(): (f"f:{n}", "s", n, "a", "SINGLE", f"New {n}", None, "CD", "K", None, True, None, None, url, 2, "OWNED", list(errors), dup)
    rows = spark.createDataFrame([make(2, "r1", "https://a"), make(3, "r1", "https://b"), make(4, None, None), make(5, None, None), make(6, None, None, ["x"])], row)
    st = spark.createDataFrame([("u", "r1", "WANTED", 5, None)], "userId string, releaseId string, status string, priority int, ownedNotes string")
    src = spark.createDataFrame([("s", "r1", "https://a", None, None)], "id string, releaseId string, url string, label string, description string")
    out = importing.apply_import(rows, releases, st, src, "u", "b", "update")
    got = {r.id: r for r in out["releases"].collect()}
    assert sorted(got) == ["f:4", "f:5", "r1"] and (got["r1"].title, got["r1"].label, got["r1"].importBatchId) == ("New 3", None, "b")
    assert sorted(r.url for r in out["sources"].where("releaseId = 'r1'").collect()) == ["https://a", "https://b"]
    assert {r.releaseId: (r.status, r.priority) for r in out["statuses"].collect()}["r1"] == ("OWNED", 2)
    counts = rows.withColumn("action", importing.action("skip")).agg(*importing.outcome_columns()).first()
    assert tuple(counts) == (2, 0, 2, 1, "IMPORTED")


def test_patch_and_sources(spark):
    rel = spark.createDataFrame([("1", "a", "T", "K", "c"), ("2", "a", "U", "M", None)], "id string, artistId string, title string, catalogNo string, coverUrl string")
    src = spark.createDataFrame([("s", "1", "u", COVER_ROLE), ("t", "1", "v", None)], "id string, releaseId string, url string, description string")
    out = mutations.patch_release(rel, src, "1", {"catalogNo": "M", "coverUrl": None})
    assert [tuple(r) for r in out["releases"].orderBy("id").collect()] == [("1", "a", "T", "M", None), ("2", "a", "U", "M", None)]
    assert [r.id for r in out["sources"].collect()] == ["t"] and out["warning"].first().warning == 'Catalog number already exists on "U".'
    assert mutations.patch_release(rel, src, "1", {"coverUrl": "c"})["sources"].count() == 2
    new, faults = mutations.add_sources(src, spark.createDataFrame([("n", "1", " https://x.example ", None), ("m", "1", "javascript:x", None)], "id string, releaseId string, url string, label string"))
    assert new.where("id = 'n'").first().label == "Manual source" and [r.id for r in faults.collect()] == ["m"]
    with pytest.raises(ValueError):
        mutations.bulk_update(rel, src, "u", "a", rel.select("id"))


def test_follow(spark):
    artists = spark.createDataFrame([("1", "Hanako", 2), ("2", "HANAKO", 1)], "id string, name string, createdAt int")
    out = mutations.follow_artists(artists, spark.createDataFrame([], "userId string, artistId string"), spark.createDataFrame([(" hanako ",), ("New",), ("new",), (" ",)], "name string"), "u")
    assert out["artists"].count() == 3 and {r.artistId for r in out["follows"].collect()} == {"2", "artist:New"}


def test_sets(spark):
    row = spark.createDataFrame([(["a", "b", "a", "c"], ["c", "a"])], "x array<string>, y array<string>")
    x, y = F.col("x"), F.col("y")
    got = row.select(selection.intersected(x, y), selection.added(y, x), selection.removed(x, y), selection.toggled(y, F.lit("c")), selection.toggled(y, F.lit("d")), selection.has_repeats(x), selection.within(y, x), selection.ordered_urls(x, y)).first()
    assert list(got) == [["a", "c"], ["c", "a", "b"], ["b"], ["a"], ["c", "a", "d"], True, True, ["a", "c"]]


def test_pasted(spark):
    fields = "title string, titleOriginal string, category string, format string, editionType string, notes string, label string, text string, flag boolean"
    rows = spark.createDataFrame([("Box", None, "", None, None, None, None, "", None), ("A", None, "BEST", None, None, None, None, "a collection", None), ("A", None, "", "8cmCD", None, "reissue", None, None, None), ("A", None, "ep", None, None, None, None, "", False)], fields)
    got = rows.select(provenance.pasted_category(F.col("category"), F.col("text")), provenance.pasted_reissue(F.col("flag"))).collect()
    assert [tuple(r) for r in got] == [("BOX", None), ("BEST", None), ("SINGLE", True), ("EP", False)]


def test_tasks(spark):
    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    rows = spark.createDataFrame([("u", i, at(i), at(i), "QUEUED" if i == 3 else "FAILED") for i in range(4)] + [("v", 9, at(0), at(0), "FAILED")], "userId string, id int, createdAt timestamp, updatedAt timestamp, status string")
    assert [r.id for r in tasks.over_limit(rows, "userId", "createdAt").orderBy("id").collect()] == [2, 3]
    assert [r.userId for r in tasks.leased(rows, F.lit("2024-01-01 00:10:00").cast("timestamp")).collect()] == ["u"]
    assert {r.userId: r.id for r in tasks.latest(rows, "userId", "createdAt", "id").collect()} == {"u": 3, "v": 9}


def streamed(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.table(name)


def test_stream(spark, sf):
    from tessera.streaming import tasks as streaming

    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf).withColumn("ts", F.col("ts").cast("timestamp"))
    spans = streamed(streaming.request_counts(events, "user_id", "ts", "1 hour", "30 minutes", most=2), "spans", "complete")
    assert spans.where("n >= 2").count() == spans.count() > 0
    at = F.unix_timestamp("ts").alias("s")
    got = sorted(map(tuple, streamed(streaming.over_limit(events, "user_id", "ts", span=3600, most=3), "limits").select("user_id", at, "recent").collect()))
    batch = tasks.over_limit(spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", span=3600, most=3)
    assert got == sorted(map(tuple, batch.select("user_id", at, "recent").collect())) and len(got) > 3


def test_stream_of_two_batches(spark, tmp_path):
    """What a user did in an earlier micro-batch counts in the next."""
    from tessera.streaming import tasks as streaming

    rows = lambda *seconds: spark.createDataFrame([("u", datetime.datetime(2024, 1, 1, 0, 0, s)) for s in seconds], "user string, at timestamp").coalesce(1)
    rows(0, 10, 20).write.mode("append").parquet(str(tmp_path / "in"))
    rows(25, 59).write.mode("append").parquet(str(tmp_path / "in"))
    files = spark.readStream.schema("user string, at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = streamed(streaming.over_limit(files, "user", "at", span=30, most=2), "two").select("user", F.second("at"), "recent").collect()
    assert sorted((r[1], r[2]) for r in got) == [(10, 2), (20, 3), (25, 4)]


def test_workbooks_round_trip(spark, tmp_path):
    rows = export.export_rows(spark.createDataFrame([release("r", notes="a<b>&\x01"), release("s", artistId="b", status=None)], LIBRARY), keep=("artistId",))
    for r in xlsx.write(rows, "artistId", order=("标题",)).collect():
        (tmp_path / f"{r.artistId}.xlsx").write_bytes(r.content)
    back = xlsx.read(spark, f"file://{tmp_path}/*.xlsx").collect()
    assert sorted((r.fileName, r.sheetName, r.rowNumber) for r in back) == [("a.xlsx", "Library", 2), ("b.xlsx", "Library", 2)]
    cells = {c.header: c.text for c in next(r for r in back if r.fileName == "a.xlsx").cells}
    assert cells["收藏状态"] == "OWNED" and cells["备注"] == "a<b>&" and list(cells) == list(export.TITLES)


def test_structuring(spark):
    from tessera.operators import structuring

    row = '{"title":"Album","format":"CD","catalogNumber":"K-1","label":"L","releaseDate":"1985-09-05","coverImageUrl":"https://c.example/x.jpg","sources":[{"url":"https://made.up/x"}]}'
    other = '{"title":"Best","category":"BEST","format":"LP","catalogNumber":"K-2","label":"L","releaseDate":"1985-09-05","notes":"reissue","isReissue":"?"}'
    text = "Result: ```json\n{\"releases\":[" + row + "," + other + "]}\n```"
    fields = "taskId string, text string, sourceText string, artistName string, country string, target string, excludeReissues boolean, sourceUrl string, defaultCoverSourceUrl string"
    rows = [("a", text, "from https://shop.example/p.", "A", "JP", "ORIGINAL_CD", True, None, None), ("b", text, "no address here", "A", "JP", "ALL_CD", False, None, "https://c.example/x.jpg"), ("c", '{"releases":[{"format":"CD"}]}', "", "A", "JP", "ALL_CD", False, None, None), ("d", None, None, "A", "JP", "ALL_CD", False, None, None)]
    good, errors = structuring.structure(spark.createDataFrame(rows, fields))
    got = {(r.taskId, r.id): r for r in good.collect()}
    assert {r.taskId for r in errors.collect()} == {"c", "d"} and len(got) == 4
    first, second, bare = got["a", "candidate-1"], got["a", "candidate-2"], got["b", "candidate-1"]
    assert (first.confidence, [s.url for s in first.sources], first.coverImageUrl, first.artistCredit) == ("HIGH", ["https://shop.example/p"], None, "A")
    assert (second.category, second.isReissue, second.isExcludedByDefault, second.confidence) == ("BEST", True, True, "MEDIUM")
    assert (bare.confidence, bare.sources, bare.coverImageUrl, bare.coverImageSourceUrl) == ("LOW", [], "https://c.example/x.jpg", "https://c.example/x.jpg")
    assert any("no explicit source url" in w for w in bare.warnings)


def test_rules(spark):
    faults = lambda df, rules: [r.faults for r in mutations.validated(df, rules)[1].collect()]
    req = spark.createDataFrame([("A", "JP", "ALL_CD", True, True, True), (" ", "JP", "x", True, None, True)], "artistName string, country string, target string, excludeReissues boolean, includeCollaborations boolean, includeLiveRemixBest boolean")
    assert faults(req, mutations.request_rules()) == [["artistName is required.", "Invalid target.", "includeCollaborations is required."]]
    imp = spark.createDataFrame([("create", None, "A", ["1"], [], [], ["1"]), ("existing", None, None, ["1", "1"], [], [], ["2"])], "artistMode string, artistId string, artistName string, selected array<string>, excluded array<string>, pending array<string>, edited array<string>")
    assert faults(imp, mutations.import_input_rules()) == [["artistId is required.", "Candidate IDs must be unique.", "Only selected candidates may be changed."]]
    edit = spark.createDataFrame([("T", "A", "LIVE", "2025-02-30", "javascript:x", None, None, None, "n" * 4001), ("T", "A", "LIVE", None, None, None, None, None, None)], "title string, artistCredit string, category string, originalReleaseDate string, coverImageUrl string, format string, catalogNumber string, label string, notes string")
    assert [len(f) for f in faults(edit, mutations.edit_rules())] == [3]
    st = spark.createDataFrame([("want", "0"), ("SKIP", "5"), ("x", "6")], "status string, priority string")
    assert [len(f) for f in faults(st, mutations.status_rules())] == [1, 2]


def test_workbook_oddities(spark, tmp_path):
    """Phonetic guides, the 1904 epoch, date cells as texts, files that cannot be taken, and a key of many rows."""
    import io
    import zipfile

    def parts(book, **more):
        src, out = zipfile.ZipFile(io.BytesIO(book)), io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n in src.namelist():
                if n not in more:
                    z.writestr(n, src.read(n))
            for n, data in more.items():
                z.writestr(n, data)
        return out.getvalue()

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    plain = xlsx.workbook({"A_原创专辑原版CD": (["标题"], [["x"]])})
    shared = f'<sst {ns}><si><t>标题</t></si><si><t>中山美穂</t><rPh sb="0" eb="2"><t>ナカヤマ</t></rPh></si><si><r><t>二</t></r><r><t>つ</t></r><phoneticPr fontId="1"/></si><si><t>发行日</t></si></sst>'
    sheet = f'<worksheet {ns}><sheetData><row><c t="s"><v>0</v></c><c t="s"><v>3</v></c></row><row><c t="s"><v>1</v></c><c s="1"><v>29833</v></c></row><row><c t="s"><v>2</v></c><c><v>31295</v></c></row></sheetData></worksheet>'
    styles = f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>'
    book = zipfile.ZipFile(io.BytesIO(plain)).read("xl/workbook.xml").decode().replace("<sheets>", '<workbookPr date1904="1"/><sheets>')
    (tmp_path / "a.xlsx").write_bytes(parts(plain, **{"xl/sharedStrings.xml": shared, "xl/worksheets/sheet1.xml": sheet, "xl/styles.xml": styles, "xl/workbook.xml": book}))
    (tmp_path / "broken.xlsx").write_bytes(b"no zip")
    (tmp_path / "large.xlsx").write_bytes(bytes(xlsx.MOST_BYTES + 1))
    (tmp_path / "other.txt").write_bytes(b"x")
    rows = xlsx.read(spark, f"file://{tmp_path}/*").orderBy("rowNumber").collect()
    assert [[(c.text, c.serial) for c in r.cells] for r in rows] == [[("中山美穂", None), ("1985-09-05T00:00:00.000Z", 31295.0)], [("二つ", None), ("31295", 31295.0)]]
    assert {r.fileName: r.error for r in xlsx.rejected(spark, f"file://{tmp_path}/*").collect()} == {"broken.xlsx": xlsx.UNREADABLE, "large.xlsx": xlsx.TOO_LARGE}
    many = spark.range(100).selectExpr("'k' as key", "cast(id as string) as v").unionByName(spark.createDataFrame([("one", "1")], "key string, v string"))
    made = xlsx.write(many, "key", most=30).collect()
    assert sorted((r.key, r.part) for r in made) == [("k", 0), ("k", 1), ("k", 2), ("k", 3), ("one", 0)]
    assert sum(len(list(xlsx._workbook(bytes(r.content)))) for r in made) == 101


def test_objects_in_text():
    from tessera.functions.json_text import _first_object as first

    assert first('x {"a": "}\\"{", "b": {}} {') == '{"a": "}\\"{", "b": {}}' and first("no") is None and first('{"a": "x}') is None and first(None) is None
    assert first('{"x":1} ```json\n{"y":2}\n```') == '{"y":2}' and first('{"x":1} ``` none ```') is None and first('``` {"z":3}') == '{"z":3}' and first("} {}") == "{}"


def test_gate_plan_is_small(spark):
    rows = gated(spark, candidate())
    assert len(rows._jdf.queryExecution().optimizedPlan().toString()) < 10_000


def test_forms_and_bulk(spark):
    faults = lambda df, rules: [r.faults for r in mutations.validated(df, rules)[1].collect()]
    form = spark.createDataFrame([("A", None, " ", "d" * 4000), (" ", "s" * 161, "c" * 81, None)], "name string, sortName string, country string, description string")
    assert faults(form, mutations.artist_rules()) == [["name is required.", "sortName has more than 160 characters.", "country has more than 80 characters."]]
    bulk = spark.createDataFrame([("a1", ["r1"], "OWNED", None, None), ("a1", [], "OWNED", None, None), ("a1", ["r1"], "BAD", None, None), ("a1", ["r1"], None, "9", None), ("a1", ["r1"], None, None, ""), (" ", ["", "r"], "WANT", "5", "true")], "artistId string, releaseIds array<string>, status string, priority string, excluded string")
    assert sorted(faults(bulk, mutations.bulk_rules())) == sorted([["releaseIds is required."], ["Invalid collection status."], ["priority must be an integer from 1 to 5."], ["No bulk update operation was provided."], ["artistId is required."]])


def test_serialised(spark, two):
    import json

    got = {r.id: json.loads(r.release) for r in library.serialised(two.withColumn("status", F.when(F.col("id") == "r1", F.col("status")))).collect()}
    assert got["r2"]["userStatus"] is None and got["r2"]["catalogNo"] is None and got["r1"]["releaseDate"] == "1985-09-05" and set(got["r1"]["userStatus"]) == {"status", "priority"}
