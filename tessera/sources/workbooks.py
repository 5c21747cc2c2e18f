"""The data source `workbook`: load(spark, folder), which is spark.read.format("workbook"), and df.write.format("workbook").save(folder).

Reading gives the rows of xlsx.parsed(), from a partition for each sheet. Filters on fileName and sheetName are taken over (equal, in, null or
not, beginning, end, part): files and sheets that they rule out are never read, and a filter of sheetName alone costs a look at each
file's list of sheets. Planning reads only these lists, LISTERS files at a time. A sheet that cannot be read is one row with an error; so is
a file without a readable list of sheets, whose sheetName is null.

Writing makes workbooks of at most `maxRows` rows (option) and about MOST_TEXT bytes of XML, each with one sheet (option `sheet`), the columns' names as header. Tasks write to
a folder of their own beside the target; files move into the target when all tasks have succeeded, and go if any has failed for good.

Folders are URIs or paths that pyarrow's file systems open (local, hdfs, s3, gs); where only Spark's readers reach the files, xlsx.scan() reads them.
"""

import itertools
import posixpath
import uuid
from collections import deque
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, EqualNullSafe, EqualTo, In, InputPartition, IsNotNull, IsNull, Not, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType, StringType

from . import xlsx

SCHEMA = f"fileName string, sheetName string, rowNumber int, cells {xlsx.CELLS}, error string"
LISTERS = 16
BATCH = 2000  #: rows of a batch that is read
SLICE = 200  #: rows that are made into XML at once
MOST_TEXT = 6 << 20  #: bytes of XML of a written workbook, but for a slice: it is read without a second parse (xlsx.HELD) and stays under xlsx.MOST_BYTES
STAGING = "_staging-"
TESTS = {
    EqualTo: lambda x, v: x is not None and x == v,
    EqualNullSafe: lambda x, v: x == v,
    In: lambda x, v: x is not None and x in v,
    IsNull: lambda x, _: x is None,
    IsNotNull: lambda x, _: x is not None,
    StringStartsWith: lambda x, v: x is not None and x.startswith(v),
    StringEndsWith: lambda x, v: x is not None and x.endswith(v),
    StringContains: lambda x, v: x is not None and v in x,
}


def register(spark: SparkSession) -> None:
    """Make the source known to the session, and let it take over filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Workbooks)


def load(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of a folder's workbooks. Spark 4.1 keeps what a loaded table has last taken over for its next query without a filter; here each has one, of fileName."""
    register(spark)
    return spark.read.format("workbook").load(folder).where("fileName is not null")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, and the folder's path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def holds(test, row: dict) -> bool:
    """Whether a filter lets a row through; null lets none through, turned round or not."""
    if isinstance(test, Not):
        inner = test.child
        if row[inner.attribute[0]] is None and not isinstance(inner, IsNull | IsNotNull | EqualNullSafe):
            return False
        return not holds(inner, row)
    return TESTS[type(test)](row[test.attribute[0]], getattr(test, "value", None))


def taken(test, columns: tuple[str, ...]) -> bool:
    inner = test.child if isinstance(test, Not) else test
    return type(inner) in TESTS and len(inner.attribute) == 1 and inner.attribute[0] in columns


@dataclass
class Sheet(InputPartition):
    path: str
    sheet: str | None
    error: str | None = None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows as a batch, column by column."""
    names, sheets, numbers, cells, errors = zip(*rows, strict=True)
    flat = [c for of in cells if of for c in of]
    headers, texts, serials = zip(*flat, strict=True) if flat else ((), (), ())
    items = pa.StructArray.from_arrays([pa.array(headers, pa.string()), pa.array(texts, pa.string()), pa.array(serials, pa.float64())], names=["header", "text", "serial"])
    ends = [0, *itertools.accumulate(len(of or ()) for of in cells)]
    lists = pa.ListArray.from_arrays(pa.array([None if of is None else at for of, at in zip(cells, ends, strict=False)] + ends[-1:], pa.int32()), items)
    columns = [pa.array(names, pa.string()), pa.array(sheets, pa.string()), pa.array(numbers, pa.int32()), lists, pa.array(errors, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["fileName", "sheetName", "rowNumber", "cells", "error"])


class Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder, self.tests = folder, []

    def pushFilters(self, filters):  # noqa: N802  Spark's name
        for test in filters:
            if taken(test, ("fileName", "sheetName")):
                self.tests.append(test)
            else:
                yield test

    def _sheets(self, path: str) -> list[Sheet]:
        """The sheets of one file that the filters leave."""
        name = posixpath.basename(path)
        row = {"fileName": name, "sheetName": None}
        if not all(holds(t, row) for t in self.tests if not taken(t, ("sheetName",))):
            return []
        files, _ = opened(self.folder)
        try:
            if files.get_file_info(path).size > xlsx.MOST_BYTES:
                found = [Sheet(path, None, xlsx.TOO_LARGE)]
            else:
                with files.open_input_file(path) as f:
                    found = [Sheet(path, s) for s in xlsx.sheet_names(f)]
        except xlsx.BAD:
            found = [Sheet(path, None, xlsx.UNREADABLE)]
        return [p for p in found if all(holds(t, row | {"sheetName": p.sheet}) for t in self.tests)]

    def partitions(self):
        files, folder = opened(self.folder)
        one = files.get_file_info(folder)
        every = [one] if one.is_file else files.get_file_info(fs.FileSelector(folder, recursive=True))
        inside = lambda p: p[len(folder) :].split("/")
        paths = sorted(i.path for i in every if i.is_file and i.path.lower().endswith(".xlsx") and not any(x.startswith(("_", ".")) for x in inside(i.path)))
        with ThreadPoolExecutor(LISTERS) as pool:
            return [p for of in pool.map(self._sheets, paths) for p in of] or [Sheet("", None)]

    def read(self, partition):
        if not partition.path:
            return
        name = posixpath.basename(partition.path)
        if partition.error:
            yield _batch([(name, None, None, None, partition.error)])
            return
        files, _ = opened(self.folder)

        def rows(path):
            with files.open_input_file(path) as f:
                data = f.read()
            book = xlsx.Book(data)
            if book.unpacked <= xlsx.HELD:
                return list(book.rows([partition.sheet]))
            deque(book.rows([partition.sheet]), maxlen=0)
            return book.rows([partition.sheet])

        found = ((file, sheet or partition.sheet, n, cells, error) for file, sheet, n, cells, error in xlsx.told(name, partition.path, rows, cell=None))
        while part := list(itertools.islice(found, BATCH)):
            yield _batch(part)


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


class Writer(DataSourceWriter):
    def __init__(self, folder: str, sheet: str, most: int, header: list[str], overwrite: bool):
        self.folder, self.sheet, self.most, self.header, self.overwrite = folder.rstrip("/"), sheet, most, header, overwrite
        self.job = uuid.uuid4().hex
        files, target = opened(self.folder)
        self.earlier = [i.path for i in files.get_file_info(fs.FileSelector(target, allow_not_found=True)) if i.is_file and i.path.lower().endswith(".xlsx")] if overwrite else []

    def _staging(self) -> tuple[fs.FileSystem, str]:
        files, target = opened(self.folder)
        return files, f"{target}/{STAGING}{self.job}"

    def _parts(self, iterator, room):
        """(rows, their XML) of `room()` rows at most."""
        for row in iterator:
            yield 1, xlsx.row_of(row)

    def write(self, iterator) -> Written:
        files, staging = self._staging()
        files.create_dir(staging, recursive=True)
        paths, held, n, size = [], [], 0, 0

        def put():
            path = f"{staging}/{uuid.uuid4().hex}.xlsx"
            with files.open_output_stream(path) as out:
                out.write(xlsx.packed({self.sheet: xlsx.row_of(self.header) + "".join(held)}))
            paths.append(path)
            held.clear()

        for rows, xml in self._parts(iterator, lambda: self.most - n):
            held.append(xml)
            n, size = n + rows, size + len(xml.encode())
            if n >= self.most or size >= MOST_TEXT:
                put()
                n, size = 0, 0
        if held:
            put()
        return Written(paths)

    def commit(self, messages) -> None:
        files, staging = self._staging()
        _, target = opened(self.folder)
        files.create_dir(target, recursive=True)
        for path in self.earlier:
            files.delete_file(path)
        # what failed or repeated tasks have left in the staging folder is in no message and goes with it
        for n, path in enumerate(p for m in messages if m for p in m.paths):
            files.move(path, f"{target}/part-{n:05d}-{self.job}.xlsx")
        if files.get_file_info(staging).type == fs.FileType.Directory:
            files.delete_dir(staging)

    def abort(self, messages) -> None:
        files, staging = self._staging()
        if files.get_file_info(staging).type == fs.FileType.Directory:
            files.delete_dir(staging)


class ColumnWriter(Writer, DataSourceArrowWriter):
    """Writer of texts and whole numbers, column by column."""

    def _parts(self, iterator, room):
        for batch in iterator:
            at = 0
            while at < len(batch):
                part = batch.slice(at, min(SLICE, room()))
                yield len(part), xlsx.rows_of(part)
                at += len(part)


class Workbooks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> Writer:
        plain = all(isinstance(f.dataType, StringType | ByteType | ShortType | IntegerType | LongType) for f in schema.fields)
        return (ColumnWriter if plain else Writer)(self.options["path"], self.options.get("sheet", "Sheet1"), int(self.options.get("maxRows", 100_000)), list(schema.names), overwrite)

