"""Workbooks that cannot be read, the data source's pruning, and its sink's commit and abort."""

import io
import os
import zipfile

import pytest

from tessera.sources import workbooks, xlsx

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


@pytest.fixture
def source(spark):
    workbooks.register(spark)
    return spark


def changed(book: bytes, **parts) -> bytes:
    """A workbook with other parts."""
    src, out = zipfile.ZipFile(io.BytesIO(book)), io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n in src.namelist():
            z.writestr(n, parts.get(n, src.read(n)))
        for n in parts.keys() - set(src.namelist()):
            z.writestr(n, parts[n])
    return out.getvalue()


def damaged() -> dict[str, bytes]:
    """Workbooks that cannot be read, each in a way of its own."""
    good = xlsx.workbook({"S": (["a"], [[f"some text {i}"] for i in range(300)])})
    sheet = "xl/worksheets/sheet1.xml"
    at = good.index(b"xl/worksheets/sheet1.xml") + len(sheet) + 20
    torn = good[:at] + bytes(len(good[at : at + 40])) + good[at + 40 :]
    locked = bytearray(good)
    for mark, flag in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):
        i = locked.find(mark)
        while i >= 0:
            locked[i + flag] |= 1
            i = locked.find(mark, i + 4)
    odd = bytearray(good)
    i = odd.find(b"PK\x01\x02")
    while i >= 0:
        odd[i + 10] = 99
        i = odd.find(b"PK\x01\x02", i + 4)
    cell = lambda x: f"<worksheet {NS}><sheetData><row><c t=\"inlineStr\"><is><t>h</t></is></c></row><row>{x}</row></sheetData></worksheet>"
    return {
        "no-zip.xlsx": b"nothing", "torn.xlsx": torn, "locked.xlsx": bytes(locked), "odd-method.xlsx": bytes(odd), "cut.xlsx": good[: len(good) // 2],
        "bad-xml.xlsx": changed(good, **{sheet: "<worksheet><row>"}), "bad-number.xlsx": changed(good, **{sheet: cell("<c><v>x1</v></c>")}), "bad-shared.xlsx": changed(good, **{sheet: cell('<c t="s"><v>7</v></c>')}),
        "no-part.xlsx": changed(good, **{"xl/_rels/workbook.xml.rels": "<Relationships/>"}),
    }


def test_damaged_workbooks_are_error_rows(spark, tmp_path):
    books = damaged()
    for name, data in books.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "good.xlsx").write_bytes(xlsx.workbook({"S": (["a"], [["x"]])}))
    assert {r.fileName: r.error for r in xlsx.rejected(spark, f"file://{tmp_path}").collect()} == dict.fromkeys(books, xlsx.UNREADABLE)
    assert [r.fileName for r in xlsx.read(spark, f"file://{tmp_path}").collect()] == ["good.xlsx"]


def test_far_dates_stay_numbers(spark, tmp_path):
    """A date cell beyond the calendar keeps its number, and the rest of the workbook is read."""
    sheet = f'<worksheet {NS}><sheetData><row><c t="inlineStr"><is><t>发行日</t></is></c></row>' + "".join(f'<row><c s="1"><v>{v}</v></c></row>' for v in ("99999999", "1e400", "-800000", "31295")) + "</sheetData></worksheet>"
    styles = f'<styleSheet {NS}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>'
    (tmp_path / "far.xlsx").write_bytes(changed(xlsx.workbook({"S": (["a"], [])}), **{"xl/worksheets/sheet1.xml": sheet, "xl/styles.xml": styles}))
    rows = xlsx.read(spark, f"file://{tmp_path}").orderBy("rowNumber").collect()
    assert [(r["cells"][0].text, r["cells"][0].serial) for r in rows] == [("99999999", 99999999.0), ("1e400", None), ("-800000", -800000.0), ("1985-09-05T00:00:00.000Z", 31295.0)]


def test_unpacked_size_is_bounded(spark, tmp_path, monkeypatch):
    """A zip bomb is an error row; workbooks beyond what is held are parsed twice and give the same rows, or none at all."""
    big = xlsx.workbook({"S": (["a"], [["x" * 1000] for _ in range(400)])})
    monkeypatch.setattr(xlsx, "MOST_UNPACKED", 100_000)
    assert [r[-1] for r in xlsx.told("b", big)] == [xlsx.UNPACKED]
    monkeypatch.setattr(xlsx, "MOST_UNPACKED", 1 << 30)
    monkeypatch.setattr(xlsx, "HELD", 1000)
    assert len(list(xlsx.told("b", big))) == 400
    late = changed(big, **{"xl/worksheets/sheet1.xml": zipfile.ZipFile(io.BytesIO(big)).read("xl/worksheets/sheet1.xml")[:-40]})
    assert [r[-1] for r in xlsx.told("b", late)] == [xlsx.UNREADABLE]


def test_source_equals_scan(source, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(xlsx.workbook({"S": (["h", "n"], [["x", 1], ["", ""], ["y", 2.5]]), "T": (["h"], [["z"]])}))
    (tmp_path / "broken.xlsx").write_bytes(b"no zip")
    (tmp_path / "large.xlsx").write_bytes(bytes(xlsx.MOST_BYTES + 1))
    (tmp_path / "other.txt").write_bytes(b"x")
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(workbooks.load(source, str(tmp_path))) == rows(xlsx.scan(source, f"file://{tmp_path}"))
    assert source.read.format("workbook").load(f"file://{tmp_path}/a.xlsx").count() == 3
    (tmp_path / "none").mkdir()
    assert source.read.format("workbook").load(str(tmp_path / "none")).count() == 0


def test_filters_prune_sheets(source, tmp_path):
    """What the filters rule out is never read: those sheets are damaged, and no error comes."""
    good = xlsx.workbook({"A": (["h"], [["a"]]), "B": (["h"], [["b"]]), "C": (["h"], [["c"]])})
    for name in ("one.xlsx", "two.xlsx"):
        (tmp_path / name).write_bytes(changed(good, **{"xl/worksheets/sheet2.xml": "<broken"}))
    (tmp_path / "worse.xlsx").write_bytes(b"no zip")
    every = workbooks.load(source, str(tmp_path))
    got = lambda test: sorted((r.fileName, r.sheetName, r.error) for r in every.where(test).collect())
    assert got("sheetName = 'A'") == [("one.xlsx", "A", None), ("two.xlsx", "A", None)]
    assert got("sheetName in ('A', 'C') and fileName = 'one.xlsx'") == [("one.xlsx", "A", None), ("one.xlsx", "C", None)]
    assert got("sheetName like 'B%' and fileName like 'o%'") == [("one.xlsx", "B", xlsx.UNREADABLE)]
    assert got("not sheetName in ('A', 'B')") == [("one.xlsx", "C", None), ("two.xlsx", "C", None)]
    assert got("sheetName is null") == [("worse.xlsx", None, xlsx.UNREADABLE)]
    assert got("sheetName = 'none'") == [] and got("rowNumber = 2 and sheetName = 'C'") == got("sheetName = 'C'")
    one = every.where("sheetName = 'A'")
    assert one.rdd.getNumPartitions() == 2 and every.rdd.getNumPartitions() == 7
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "Filter (sheetName" not in plan and "sheetName" in plan


def test_sink(source, tmp_path):
    """Parts of bounded size; an overwrite takes the place of what was there, an append joins it."""
    folder = str(tmp_path / "out")
    rows = source.range(25).selectExpr("id", "concat('t', id) as name", "cast(null as string) as none").repartition(2)
    rows.write.format("workbook").mode("append").option("sheet", "X").option("maxRows", 5).save(folder)
    back = source.read.format("workbook").load(folder).collect()
    assert len(os.listdir(folder)) in (5, 6) and not [f for f in os.listdir(folder) if not f.endswith(".xlsx")]
    assert sorted((int(r["cells"][0].serial), r["cells"][1].text, r["cells"][2].text) for r in back) == [(i, f"t{i}", "") for i in range(25)]
    assert {r.sheetName for r in back} == {"X"} and [c.header for c in back[0]["cells"]] == ["id", "name", "none"]
    rows.where("id < 3").write.format("workbook").mode("append").save(folder)
    assert source.read.format("workbook").load(folder).count() == 28
    rows.where("id < 4").write.format("workbook").mode("overwrite").save(folder)
    assert source.read.format("workbook").load(folder).count() == 4


def test_aborted_sink_leaves_nothing(source, tmp_path):
    folder = str(tmp_path / "out")
    source.range(3).write.format("workbook").mode("append").save(folder)
    before = sorted(os.listdir(folder))
    bad = source.range(0, 100, 1, 4).selectExpr("if(id = 99, raise_error('no'), id) as id")
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="no"):
            bad.write.format("workbook").mode(mode).option("maxRows", 5).save(folder)
        assert sorted(os.listdir(folder)) == before


def test_own_sheets_read_alike(monkeypatch):
    """Sheets as they are written are read as the XML parser reads them, and what is written otherwise is left to it."""
    texts = ["a&<b>\n", "&amp;", "", " x ", "é\U0001f600", "\t]]>", 'q"\'', "x\x01y", 1, -2.5, float("inf"), True, None, "3"]
    data = xlsx.workbook({"S": ([f"h{i}" for i in range(len(texts))], [texts, [""] * len(texts), texts[::-1], [5]])})
    fast = list(xlsx.Book(data).rows())
    part = xlsx.Book(data).zip.read("xl/worksheets/sheet1.xml")
    assert xlsx._plain(part) is not None
    monkeypatch.setattr(xlsx, "_plain", lambda data: None)
    assert fast == list(xlsx.Book(data).rows()) and len(fast) == 3
    monkeypatch.undo()
    for old, new in ((b"&lt;", b"&#60;"), (b"&lt;", b"\r"), (b"<row>", b"<row >"), (b"<c><v>", b'<c s="1"><v>'), (b"</row>", b"</row><!-- -->"), (b"\xc3\xa9", b"\xff"), (b"&lt;", b"&"), (b"3</t>", b"3</t><t>4</t>"), (b"</is>", b"</is></is>"), (b"&gt;", b">")):
        assert old in part and xlsx._plain(part.replace(old, new, 1)) is None


def test_workbooks_are_parsed_once(source, tmp_path, monkeypatch):
    """Written workbooks stay within what is held, so that large ones are not read twice, nor beyond what is taken."""
    monkeypatch.setattr(workbooks, "MOST_TEXT", 2 << 20)
    source.range(30_000).selectExpr("id", "repeat(sha2(cast(id as string), 256), 6) as t").coalesce(1).write.format("workbook").mode("append").save(f"{tmp_path}/w")
    sizes = [xlsx.Book(p.read_bytes()).unpacked for p in (tmp_path / "w").glob("*.xlsx")]
    assert max(sizes) <= xlsx.HELD
    rows = workbooks.load(source, f"{tmp_path}/w")
    assert rows.where("error is not null").count() == 0 and rows.selectExpr("cells[0].text as id").distinct().count() == 30_000
