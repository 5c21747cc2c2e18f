"""Workbooks: Spark lists and reads the files, each file is parsed by a task, row by row, and tables are written as workbooks.

A workbook is a zip of XML parts; only what cells need is read. Dates stay day numbers, so no time zone is involved; as texts
they are ISO times, and a number beyond the calendar stays as it is written. Phonetic guides are no part of a text. A file that cannot be
taken, or whose parts unpack to more than MOST_UNPACKED bytes, is one row with an error, whatever could be read of it.
"""

import datetime
import io
import itertools
import math
import re
import zipfile
import zlib
from collections import deque
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
C, V, IS, T = (MAIN + tag for tag in ("c", "v", "is", "t"))
MOST_BYTES = 10 << 20
MOST_UNPACKED = 256 << 20  #: bytes of a workbook's parts
HELD = 16 << 20  #: unpacked bytes up to which a workbook's rows are held until all are read; larger ones are parsed twice
MOST_ROWS = 500_000  #: rows of a written workbook; a sheet cannot hold more than about twice as many
CELLS = "array<struct<header:string,text:string,serial:double>>"
# Built-in number formats that show dates.
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), 45, 46, 47, *range(50, 59)])


def _sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) in workbook order."""
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    parts = [(s.get("name"), links[s.get(LINK)]) for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet")]
    return [(n, p.lstrip("/") if p.startswith("/") else f"xl/{p}") for n, p in parts]


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref).group():
        n = 26 * n + ord(c) - 64
    return n


def _text(item) -> str:
    """The text of a string item: its own, or that of its runs; guides to its reading (rPh) stay out."""
    return "".join(t.text or "" for t in [*item.findall(f"{MAIN}t"), *item.findall(f"{MAIN}r/{MAIN}t")])


def _day(serial: float) -> str | None:
    """A day number as an ISO time, in milliseconds; None beyond the calendar."""
    try:
        at = datetime.datetime(1899, 12, 30) + datetime.timedelta(milliseconds=round(serial * 86_400_000))
    except OverflowError:
        return None
    return at.isoformat(timespec="milliseconds") + "Z"


def _elements(book: zipfile.ZipFile, part: str, tag: str):
    """The elements of one kind of a part, one at a time; what has been read is let go."""
    tag = MAIN + tag
    with book.open(part) as stream:
        path = []
        for event, e in ElementTree.iterparse(stream, ("start", "end")):
            if event == "start":
                path.append(e)
                continue
            path.pop()
            if e.tag == tag:
                yield e
                if path:
                    path[-1].remove(e)


NUMBER, TEXT = ("<c><v>", "</v></c>"), ('<c t="inlineStr"><is><t xml:space="preserve">', "</t></is></c>")
OPENS, CLOSES = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>', "</sheetData></worksheet>"
ROW = re.compile(f"<row>(?:{TEXT[0]}[^<>]*{TEXT[1]}|{NUMBER[0]}[^<>]*{NUMBER[1]})*")
CELL = re.compile(f"<c({TEXT[0][2:]}|{NUMBER[0][2:]})([^<>]*)<")
ENTITY = re.compile("&(?!(?:amp|lt|gt);)")
ODD = bytes(i for i in range(32) if i not in (9, 10))


def _plain(data: bytes) -> list[list[tuple[bool, str]]] | None:
    """The cells (whether text, value) of each row of a sheet that is written as packed() does, without other elements, attributes, entities or characters that
    XML refuses or changes; None for any other, which the XML parser reads. An element's object for every cell costs eight times as much."""
    if not (data.startswith(OPENS.encode()) and data.endswith(CLOSES.encode())):
        return None
    try:
        body = data[len(OPENS) : -len(CLOSES)].decode()
    except UnicodeDecodeError:
        return None
    *rows, rest = body.split("</row>")
    if rest or ("&" in body and ENTITY.search(body)) or "\ufffe" in body or "\uffff" in body or len(data.translate(None, ODD)) < len(data) or not all(map(ROW.fullmatch, rows)):
        return None
    own = lambda v: v.replace("&lt;", "<").replace("&gt;", ">").replace("&amp;", "&") if "&" in v else v
    return [[(len(kind) > 4, own(v)) for kind, v in CELL.findall(r)] for r in rows]


class Book:
    """A workbook's shared texts, date styles and sheets."""

    def __init__(self, data):
        self.zip = book = zipfile.ZipFile(io.BytesIO(data) if isinstance(data, bytes | bytearray) else data)
        names = set(book.namelist())
        self.unpacked = sum(i.file_size for i in book.infolist())
        if self.unpacked > MOST_UNPACKED:
            raise _TooLargeError
        self.sheets = dict(_sheets(book))
        self.has_shared = "xl/sharedStrings.xml" in names
        about = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{MAIN}workbookPr")
        self.since = 1462 if about is not None and about.get("date1904") in ("1", "true") else 0  # days from the other epoch
        self.dates: set[int] = set()
        if "xl/styles.xml" in names:
            styles = ElementTree.fromstring(book.read("xl/styles.xml"))
            own = {int(f.get("numFmtId")) for f in styles.iter(f"{MAIN}numFmt") if re.search("[ymd]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode")).lower())}
            xfs = styles.find(f"{MAIN}cellXfs")
            self.dates = {i for i, x in enumerate(xfs if xfs is not None else ()) if int(x.get("numFmtId", 0)) in DATE_FORMATS | own}

    def _number(self, text: str, dated: bool) -> tuple[str, float | None]:
        serial = float(text)
        if not math.isfinite(serial):
            return text, None
        serial += self.since if dated else 0
        return (_day(serial) if dated else None) or (str(int(serial)) if serial.is_integer() else text), serial

    def rows(self, sheets=None):
        """(sheet, row number, cells (header, text, day number)) of these sheets, else of all in their order. A sheet's first row that has cells is its header; blank rows are left out and not counted."""
        shared = [_text(s) for s in _elements(self.zip, "xl/sharedStrings.xml", "si")] if self.has_shared else []
        for sheet in self.sheets if sheets is None else sheets:
            header: dict[int, str] = {}
            n = 1
            plain = _plain(self.zip.read(self.sheets[sheet])) if self.unpacked <= HELD else None
            for row in _elements(self.zip, self.sheets[sheet], "row") if plain is None else plain:
                cells = {}
                if plain is not None:
                    cells = {at: (v, None) if text or not v else self._number(v, 0 in self.dates) for at, (text, v) in enumerate(row, 1)}
                for at, c in enumerate(row.iter(C) if plain is None else (), 1):
                    kind, v = c.get("t", "n"), c.find(V)
                    value = v.text if v is not None and v.text else ""
                    serial = None
                    if kind == "s":
                        value = shared[int(value)] if value else ""
                    elif kind == "inlineStr":
                        # one plain text, as most are, is taken without looking for runs
                        alone = len(c) == 1 and c[0].tag == IS and len(c[0]) == 1 and c[0][0].tag == T
                        value = c[0][0].text or "" if alone else "".join(map(_text, c.findall(IS)))
                    elif kind == "b":
                        value = "true" if value == "1" else "false"
                    elif kind == "n" and value:
                        value, serial = self._number(value, int(c.get("s", 0)) in self.dates)
                    cells[_column(c.get("r")) if c.get("r") else at] = (value, serial)
                if not any(v for v, _ in cells.values()):
                    continue
                if not header:
                    header = {k: v for k, (v, _) in cells.items()}
                    columns, none = sorted(header.items()), ("", None)
                else:
                    n += 1
                    yield sheet, n, [(h, *cells.get(k, none)) for k, h in columns]


class _TooLargeError(Exception):
    pass


def sheet_names(file) -> list[str]:
    """The names of a workbook's sheets, in order."""
    with zipfile.ZipFile(file) as book:
        return [n for n, _ in _sheets(book)]


def _workbook(data: bytes):
    """The rows of a workbook, all of which can be read: what fails, fails before the first row is given."""
    book = Book(data)
    if book.unpacked <= HELD:
        return list(book.rows())
    deque(book.rows(), maxlen=0)
    return book.rows()


# What is said of a file that cannot be taken.
TOO_LARGE, UNREADABLE, UNPACKED = "File is larger than 10 MiB.", "File is not a readable workbook.", "File unpacks to more than 256 MiB."
# a zip that is damaged, encrypted or of an unknown kind, XML that is none, parts or numbers that are missing or no numbers
BAD = (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError, OSError, ElementTree.ParseError, LookupError, ValueError, AttributeError, TypeError)


def told(name: str, data, rows=_workbook, cell=lambda c: dict(zip(("header", "text", "serial"), c, strict=True))):
    """(fileName, sheetName, rowNumber, cells, error) for each row of a workbook, or once with an error; cells as `cell` makes them, or as triples where it is None."""
    try:
        for sheet, n, cells in rows(data):
            yield name, sheet, n, list(map(cell, cells)) if cell else cells, None
    except _TooLargeError:
        yield name, None, None, None, UNPACKED
    except BAD:
        yield name, None, None, None, UNREADABLE


def parsed(books: DataFrame) -> DataFrame:
    """(fileName, sheetName, rowNumber, cells, error) of (fileName, content): a row for each row of each sheet, or one with an error for what is no workbook."""
    names = ["fileName", "sheetName", "rowNumber", "cells", "error"]

    def rows(batches):
        for batch in batches:
            for f, data in zip(batch.fileName, batch.content, strict=True):
                found = told(f, data)
                while part := list(itertools.islice(found, 10_000)):
                    yield pd.DataFrame(part, columns=names).astype({"rowNumber": "Int32"})

    return books.select("fileName", "content").mapInPandas(rows, f"fileName string, sheetName string, rowNumber int, cells {CELLS}, error string")


def scan(spark: SparkSession, path: str) -> DataFrame:
    """parsed() of the .xlsx files at path. A file over MOST_BYTES is a row with an error, and its content is never read. Spark's file scans leave out files without a byte."""
    files = spark.read.format("binaryFile").load(path).where(F.lower("path").endswith(".xlsx")).withColumn("fileName", F.element_at(F.split("path", "/"), -1))
    good = parsed(files.where(F.col("length") <= MOST_BYTES))
    bad = files.where(F.col("length") > MOST_BYTES).select("fileName", F.lit(TOO_LARGE).alias("error"))
    return good.unionByName(bad, allowMissingColumns=True)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(fileName, sheetName, rowNumber, cells) of all sheets of the workbooks at path; see rejected() for the files that give none."""
    return scan(spark, path).where("error is null").drop("error")


def rejected(spark: SparkSession, path: str) -> DataFrame:
    """(fileName, error) of the files that cannot be taken."""
    return scan(spark, path).where("error is not null").select("fileName", "error")


def _escape(text: str) -> str:
    return re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", text).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def row_of(values) -> str:
    """A row's XML: numbers as numbers, all else as text."""
    one = lambda v: f"{NUMBER[0]}{v}{NUMBER[1]}" if isinstance(v, int | float) and not isinstance(v, bool) else f"{TEXT[0]}{_escape('' if v is None else str(v))}{TEXT[1]}"
    return f"<row>{''.join(map(one, values))}</row>"


def rows_of(batch: pa.RecordBatch) -> str:
    """row_of() of all rows of a batch of texts and whole numbers, column by column."""
    parts = ["<row>"]
    for column in batch.columns:
        texts = pc.fill_null(column.cast(pa.string()), "")
        if pa.types.is_integer(column.type):
            parts.append(pc.if_else(column.is_null(), "".join(TEXT), pc.binary_join_element_wise(NUMBER[0], texts, NUMBER[1], "")))
            continue
        texts = pc.replace_substring_regex(texts, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
        for c, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            texts = pc.replace_substring(texts, c, entity)
        parts += [TEXT[0], texts, TEXT[1]]
    return "".join(pc.binary_join_element_wise(*parts, "</row>", "").to_pylist())


def workbook(sheets: dict[str, tuple[list[str], list[list[object]]]]) -> bytes:
    """A workbook of (header, rows) by sheet name: numbers as numbers, all else as text."""
    return packed({name: "".join(map(row_of, [header, *rows])) for name, (header, rows) in sheets.items()})


def packed(sheets: dict[str, str]) -> bytes:
    """A workbook of its sheets' rows by name."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        n = range(1, len(sheets) + 1)
        z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in n) + "</Types>")
        rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        z.writestr("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{_escape(s)}" sheetId="{i}" r:id="r{i}"/>' for i, s in zip(n, sheets, strict=True)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in n) + "</Relationships>")
        for i, body in zip(n, sheets.values(), strict=True):
            z.writestr(f"xl/worksheets/sheet{i}.xml", OPENS + body + CLOSES)
    return out.getvalue()


def write(rows: DataFrame, key: str, sheet: str = "Library", order: tuple[str, ...] = (), most: int = MOST_ROWS) -> DataFrame:
    """(key, part, content): workbooks of each value of key, such as an artist, with some `most` rows each, from part 0, sorted by `order` (nulls last).

    A key of more rows is dealt to parts by hash before any workbook is made: a task makes one part, however large a key is."""
    names = [c for c in rows.columns if c != key]
    large = rows.groupBy(F.col(key).alias("__key")).agg(F.ceil(F.count("*") / F.lit(most)).cast("int").alias("__parts")).where("__parts > 1")
    dealt = rows.join(large, F.col(key).eqNullSafe(F.col("__key")), "left")
    part = F.when(F.col("__parts") > 1, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("__parts"))).otherwise(0)
    dealt = dealt.select(key, part.cast("int").alias("__part"), *names)

    def one(k, pdf):
        own = pdf.sort_values(list(order), na_position="last", kind="stable") if order else pdf
        return pd.DataFrame([(k[0], k[1], workbook({sheet: (names, own[names].astype(object).where(own[names].notna(), "").values.tolist())}))], columns=[key, "part", "content"])

    return dealt.groupBy(key, "__part").applyInPandas(one, f"`{key}` {rows.schema[key].dataType.simpleString()}, part int, content binary")
