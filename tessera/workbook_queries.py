"""Queries of workbooks as a data source and as a sink, and of spreadsheet day numbers, over the driver's tables, and the same in SQL."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import catalogue_tables as T
from .catalogue_queries import register, rows_of
from .operators import export, importing
from .plans.filters import COVER_ROLE
from .sources import folders, workbooks

SHEETS = ("A_原创专辑原版CD", "B_单曲原版CD", "总览")


def by_header(cells) -> F.Column:
    """The texts of a row's cells by header."""
    return F.map_from_entries(F.transform(cells, lambda c: F.struct(c["header"], c["text"])))


def saved(spark, d) -> str:
    """A folder of workbooks of customers: dates as day numbers on one kind of sheet, as texts on another, and a sheet that no import takes."""
    workbooks.register(spark)
    k, folder = F.col("c_custkey"), folders.fresh(spark, "workbooks")
    day = F.lit(30000) + k % 5000
    rows = T.load(spark, d, "customer")
    for sheet, date in zip(SHEETS, (day, F.concat(F.lit("1990/02/"), (k % 28 + 1).cast("string")), F.lit("")), strict=True):
        columns = [k.alias("品番"), F.when(k % 7 != 0, F.col("c_name")).alias("标题"), F.when(k % 3 == 0, "SHM-CD").otherwise("CD").alias("格式"), date.alias("原版发行日")]
        rows.select(*columns).write.format("workbook").mode("append").option("sheet", sheet).option("maxRows", 2000).save(folder)
    return folder


@register("workbook_sheet", """SELECT 'A_原创专辑原版CD' AS sheet, c_custkey::VARCHAR AS number, CASE WHEN c_custkey % 7 <> 0 THEN c_name ELSE '' END AS title, (30000 + c_custkey % 5000)::DOUBLE AS serial FROM customer""")
def workbook_sheet(spark, d):
    """One sheet of each workbook that has it; the others are never read."""
    rows = workbooks.load(spark, saved(spark, d)).where(F.col("sheetName") == SHEETS[0])
    return rows.select(F.col("sheetName").alias("sheet"), by_header(F.col("cells"))["品番"].alias("number"), by_header(F.col("cells"))["标题"].alias("title"), F.filter("cells", lambda c: c["header"] == "原版发行日")[0]["serial"].alias("serial"))


@register("workbook_import", """
SELECT c_custkey::VARCHAR AS number, CASE WHEN c_custkey % 7 <> 0 THEN c_name ELSE '' END AS title, category, CASE WHEN category = 'SINGLE' THEN make_date(1990, 2, (c_custkey % 28 + 1)::INT) ELSE DATE '1899-12-30' + (30000 + c_custkey % 5000)::INT END AS day,
  CASE WHEN c_custkey % 3 = 0 THEN 'SHM_CD' ELSE 'CD' END AS format, c_custkey % 7 = 0 AS bad FROM customer, (VALUES ('ORIGINAL_ALBUM'), ('SINGLE')) s(category)""")
def workbook_import(spark, d):
    """Typed rows of the sheets that an import takes."""
    rows = workbooks.load(spark, saved(spark, d)).where("error is null and rowNumber is not null")
    return importing.typed_rows(rows).select(F.col("catalogNo").alias("number"), "title", "category", F.col("releaseDate").alias("day"), "format", (F.size("errors") > 0).alias("bad"))


@register("export_workbooks", f"""
SELECT coalesce(r.status, 'NOT_OWNED') AS status, coalesce(r.priority::VARCHAR, '') AS priority, r.category, r.title, r."releaseDate"::VARCHAR AS release_date, r.format, coalesce(r."catalogNo", '') AS catalog_no,
  CASE WHEN r.id % 6 <> 0 THEN 'Label ' || (r.id % 6)::VARCHAR ELSE '' END AS label, '' AS price, '' AS edition, CASE WHEN r."isReissue" THEN '是' ELSE '否' END AS reissue, CASE WHEN r."isRemaster" THEN '是' ELSE '否' END AS remaster,
  CASE WHEN r."isExcludedByDefault" THEN '是' ELSE '否' END AS excluded, coalesce(r."coverUrl", '') AS cover, coalesce(min_by(s.url, s.id) FILTER (s.description = '{COVER_ROLE}'), '') AS cover_source,
  coalesce(string_agg(s.url, chr(10) ORDER BY s.id) FILTER (s.description IS DISTINCT FROM '{COVER_ROLE}' AND s.id IS NOT NULL), '') AS urls, coalesce(r.notes, '') AS notes, '' AS own_notes
FROM releases r LEFT JOIN sources s ON s."releaseId" = r.id GROUP BY r.id, r.status, r.priority, r.category, r.title, r."releaseDate", r.format, r."catalogNo", r."isReissue", r."isRemaster", r."isExcludedByDefault", r."coverUrl", r.notes""", T.SQL)
def export_workbooks(spark, d):
    """All columns of an export, from the workbooks to which it was saved."""
    workbooks.register(spark)
    folder = folders.fresh(spark, "export")
    export.save(rows_of(spark, d), folder)
    names = ("status", "priority", "category", "title", "release_date", "format", "catalog_no", "label", "price", "edition", "reissue", "remaster", "excluded", "cover", "cover_source", "urls", "notes", "own_notes")
    rows = workbooks.load(spark, folder).where(F.col("sheetName") == export.SHEET)
    rows = rows.select(by_header(F.col("cells")).alias("texts"))  # one map for all columns
    return rows.select(*[F.col("texts")[t].alias(n) for t, n in zip(export.TITLES, names, strict=True)])


@register("day_numbers", """
WITH n AS (SELECT p_partkey, CASE p_partkey % 12 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 59 WHEN 3 THEN 60 WHEN 4 THEN 61 WHEN 5 THEN 2958465 WHEN 6 THEN 2958466 WHEN 7 THEN 1e13 + p_partkey WHEN 8 THEN 'nan'::DOUBLE WHEN 9 THEN -1 WHEN 10 THEN 19850905 ELSE 100 + p_partkey + 0.75 END::DOUBLE AS days FROM part)
SELECT p_partkey, CASE WHEN isnan(days) OR days < 0 OR days > 2958465 THEN CASE WHEN p_partkey % 24 = 7 THEN DATE '1985-09-05' END WHEN days < 61 THEN DATE '1899-12-31' + floor(days)::INT ELSE DATE '1899-12-30' + floor(days)::INT END AS day FROM n""")
def day_numbers(spark, d):
    """Dates of day numbers within and beyond the calendar; beyond it the cell's text counts."""
    k = F.col("p_partkey")
    days = F.lit(100.75) + k
    for i, n in enumerate((0.0, 1.0, 59.0, 60.0, 61.0, 2958465.0, 2958466.0, F.lit(1e13) + k, float("nan"), -1.0, 19850905.0)):
        days = F.when(k % 12 == i, n).otherwise(days)
    text = F.when(k % 24 == 7, "1985/9/5").otherwise(F.format_string("%.0f", days))
    cells = F.array(F.struct(F.lit("标题").alias("header"), F.lit("T").alias("text"), F.lit(None).cast("double").alias("serial")), F.struct(F.lit("发行日").alias("header"), text.alias("text"), days.alias("serial")))
    raw = T.load(spark, d, "part").select(F.lit("b.xlsx").alias("fileName"), F.lit(SHEETS[0]).alias("sheetName"), k.cast("int").alias("rowNumber"), cells.alias("cells"))
    return importing.typed_rows(raw).select(F.col("rowNumber").cast("long").alias("p_partkey"), F.col("releaseDate").alias("day"))
