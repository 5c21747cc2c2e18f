"""Queries of imports, workbooks, the user's library, changes and input rules over the driver's tables, and the same in SQL."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import catalogue_tables as T
from .catalogue_queries import ARTISTS_SQL, IMPORT_SQL, NAMES_SQL, asked_names, artists, import_rows, named_artists, register, rows_of, stored_releases
from .functions import text as X
from .functions import urls as U
from .functions import values as V
from .operators import export, importing, library, mutations, selection, tasks
from .plans.filters import COVER_ROLE, Filters, store_cover_source
from .sources import xlsx


def pick(names, i):
    """The element of names at i, which counts from 0 and wraps."""
    return F.element_at(F.array(*map(F.lit, names)), (F.pmod(i, F.lit(len(names))) + 1).cast("int"))


def pick_sql(names, i: str) -> str:
    """The same in SQL."""
    quoted = ", ".join("NULL" if n is None else "'" + n.replace("'", "''") + "'" for n in names)
    return f"([{quoted}])[({i}) % {len(names)} + 1]"


# ---- workbooks: orders as the rows of a workbook's sheets

SHEET_NAMES = ["A_原创专辑原版CD", "B_单曲原版CD", "2024 C_精选现场混音 v2", "总览", "Notes"]
KINDS = ["", "Live", "best of", "x REMIX", "混音", "合集"]
FORMAT_WORDS = ["", "cd", "SHM-CD", "Blu-spec", "sacd", "dvd", "box", "vinyl"]
YES_WORDS = ["是", " TRUE ", "no", "0", "再版", "?", ""]
STATUS_TEXTS = ["已拥有", " Owned", "skip", "Wishlist", "想买", "排除", "", "other"]
TAKEN_WORDS = ["", "是", "NO", "排除", "0", "yes"]
PRIORITY_TEXTS = ["必收", "2", "9 stars", "-3", "low", "候补", "x", ""]
RAW_SQL = f"""WITH raw AS (SELECT o_orderkey AS k, 'book.xlsx:' || {pick_sql(SHEET_NAMES, "o_orderkey")} || ':' || (o_orderkey + 1)::VARCHAR AS "rowId", {pick_sql(SHEET_NAMES, "o_orderkey")} AS "sheetName",
  {pick_sql(KINDS, "o_orderkey // 5")} AS kind, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'T' || (o_orderkey % 40)::VARCHAR END AS title, o_orderdate::DATE AS day,
  {pick_sql(FORMAT_WORDS, "o_orderkey // 3")} AS format, {pick_sql(YES_WORDS, "o_orderkey // 2")} AS reissue, {pick_sql(STATUS_TEXTS, "o_orderkey // 4")} AS status, {pick_sql(TAKEN_WORDS, "o_orderkey // 11")} AS taken, {pick_sql(PRIORITY_TEXTS, "o_orderkey // 13")} AS priority
  FROM orders),
typed AS (SELECT "rowId", "sheetName", k, title,
  CASE k % 5 WHEN 0 THEN 'ORIGINAL_ALBUM' WHEN 1 THEN 'SINGLE' ELSE {pick_sql(["OTHER", "LIVE", "BEST", "REMIX", "REMIX", "COLLECTION"], "k // 5")} END AS category,
  CASE k % 4 WHEN 3 THEN NULL ELSE day END AS "releaseDate",
  {pick_sql(["CD", "CD", "SHM_CD", "BLU_SPEC_CD", "HYBRID_SACD", "CD_DVD", "BOX_SET", "OTHER"], "k // 3")} AS format,
  CASE WHEN k % 10 <> 0 THEN 'K-' || (k % 30)::VARCHAR END AS "catalogNo", {pick_sql(["t", "t", "f", "f", "t", "f", "f"], "k // 2")} = 't' AS "isReissue",
  taken NOT IN ('NO', '排除', '0') AS included,
  CASE WHEN taken IN ('NO', '排除', '0') THEN 'EXCLUDED' ELSE {pick_sql(["OWNED", "OWNED", "NOT_OWNED", "WANTED", "WANTED", "EXCLUDED", "NOT_OWNED", "NOT_OWNED"], "k // 4")} END AS status,
  {pick_sql(["1", "2", "5", "1", "5", "5", "3", "3"], "k // 13")}::INT AS priority, title = '' AS bad
  FROM raw WHERE k % 5 < 3)
"""


def raw_rows(spark, d) -> DataFrame:
    """(fileName, sheetName, rowNumber, cells): headers in several spellings, two of the catalogue number's, dates as day numbers and as texts."""
    k = F.col("o_orderkey")
    cell = lambda header, text, serial=None: F.struct(F.lit(header).alias("header"), text.alias("text"), (F.lit(None) if serial is None else serial).cast("double").alias("serial"))
    by_5, nothing = F.floor(k / 5), F.lit("")
    serial = F.when(k % 4 == 0, F.datediff(F.col("o_orderdate").cast("date"), F.lit("1899-12-30").cast("date")) + F.lit(0.5))
    written = F.when(k % 4 == 1, F.date_format("o_orderdate", "yyyy年M月d日")).when(k % 4 == 2, F.date_format("o_orderdate", " yyyy/MM/dd ")).when(k % 4 == 3, "soon").otherwise(nothing)
    cells = F.array(
        cell("类型", pick(KINDS, by_5)),
        cell(" 标题　", F.when(k % 7 == 0, " 　").otherwise(F.concat(F.lit(" T"), (k % 40).cast("string")))),
        cell("原版 CD\n 发行日", written, serial),
        cell("格式", pick(FORMAT_WORDS, F.floor(k / 3))),
        cell("品番", F.when(k % 10 != 0, F.concat(F.lit("K-"), (k % 30).cast("string"))).otherwise(nothing)),
        cell("原版品番", F.lit("never")),
        cell("", F.lit("no header")),
        cell("是否再版", pick(YES_WORDS, F.floor(k / 2))),
        cell("收藏状态", pick(STATUS_TEXTS, F.floor(k / 4))),
        cell("是否纳入", pick(TAKEN_WORDS, F.floor(k / 11))),
        cell("优先度", pick(PRIORITY_TEXTS, F.floor(k / 13))),
    )
    return T.load(spark, d, "orders").select(F.lit("book.xlsx").alias("fileName"), pick(SHEET_NAMES, k).alias("sheetName"), (k + 1).cast("int").alias("rowNumber"), cells.alias("cells"))


@register("typed_import", 'SELECT "rowId", category, title, "releaseDate", format, "catalogNo", "isReissue", included, status, priority, bad FROM typed', RAW_SQL)
def typed_import(spark, d):
    """Sheets, headers, row identity, cells and words of a spreadsheet."""
    return importing.typed_rows(raw_rows(spark, d)).select("rowId", "category", "title", "releaseDate", "format", "catalogNo", "isReissue", "included", "status", "priority", (F.size("errors") > 0).alias("bad"))


@register("raw_cells", """SELECT "rowId", 10 AS n, CASE WHEN title = '' THEN '' ELSE title END AS title, CASE WHEN k % 10 <> 0 THEN 'K-' || (k % 30)::VARCHAR ELSE '' END AS number, 'never' AS other FROM raw WHERE k % 5 < 3""", RAW_SQL)
def raw_cells(spark, d):
    """Cells by normalised header, those without a header left out."""
    rows = importing.typed_rows(raw_rows(spark, d))
    return rows.select("rowId", F.size("raw").alias("n"), X.trimmed(F.col("raw")["标题"]).alias("title"), F.col("raw")["品番"].alias("number"), F.col("raw")["原版品番"].alias("other"))


@register("sheet_counts", 'SELECT "sheetName", category, count(*) AS count FROM typed GROUP BY 1, 2', RAW_SQL)
def sheet_counts(spark, d):
    return importing.sheet_counts(importing.typed_rows(raw_rows(spark, d)))


@register("column_coverage", """SELECT count(*) FILTER (title <> '') AS title, count("releaseDate") AS "releaseDate", count("catalogNo") AS "catalogNo", 0::BIGINT AS notes FROM typed""", RAW_SQL)
def column_coverage(spark, d):
    return importing.coverage(importing.typed_rows(raw_rows(spark, d)), ["title", "releaseDate", "catalogNo", "notes"])


@register("workbook_cells", """SELECT 'k' || (c_custkey % 40)::VARCHAR || '.xlsx' AS "fileName", 'Artists' AS "sheetName", (row_number() OVER (PARTITION BY c_custkey % 40 ORDER BY c_name) + 1)::INT AS "rowNumber", c_name || '<&>' AS name, (c_custkey % 7)::VARCHAR AS number, (c_custkey % 7)::DOUBLE AS serial FROM customer""")
def workbook_cells(spark, d):
    """Customers dealt to forty workbooks, sorted by name, written and scanned again."""
    k = F.col("c_custkey")
    rows = T.load(spark, d, "customer").select((k % 40).alias("key"), F.concat("c_name", F.lit("<&>")).alias("name"), (k % 7).alias("number"))
    books = xlsx.write(rows, "key", "Artists", order=("name",)).select(F.concat(F.lit("k"), F.col("key").cast("string"), F.lit(".xlsx")).alias("fileName"), "content")
    cell = lambda i: F.col("cells")[i]
    return xlsx.parsed(books).where("error is null").select("fileName", "sheetName", "rowNumber", cell(0)["text"].alias("name"), cell(1)["text"].alias("number"), cell(1)["serial"].alias("serial"))


# ---- what an import does


@register("import_states", """SELECT "rowId", CASE WHEN bad THEN 'error' WHEN duplicate IS NOT NULL THEN 'duplicate' ELSE 'ready' END AS state FROM found""", IMPORT_SQL)
def import_states(spark, d):
    return import_rows(spark, d).select("rowId", V.row_state(F.col("errors"), F.col("duplicateId").isNotNull()).alias("state"))


@register("import_errors", f"""SELECT "rowId", 'sheet ' || ("rowId" % 3)::VARCHAR AS "sheetName", "rowId"::INT AS "rowNumber", '{importing.NO_TITLE}' AS errors FROM found WHERE bad""", IMPORT_SQL)
def import_errors(spark, d):
    return importing.batch_errors(import_rows(spark, d)).withColumn("errors", F.array_join("errors", ";"))


CONFIRM_SQL = IMPORT_SQL + """, sent AS (SELECT *, CASE WHEN "rowId" % 30 = 0 THEN 'unheard of' WHEN "rowId" % 3 = 0 THEN ' want' ELSE 'OWNED' END AS told, CASE WHEN "rowId" % 45 = 7 THEN 6 ELSE priority END AS level FROM found)
"""


def sent_rows(spark, d):
    k = F.col("rowId")
    rows = import_rows(spark, d).withColumn("status", F.when(k % 30 == 0, "unheard of").when(k % 3 == 0, " want").otherwise("OWNED"))
    return rows.withColumn("priority", F.when(k % 45 == 7, 6).otherwise(F.col("priority"))).withColumn("errors", F.expr("cast(array() as array<string>)"))


@register("confirmed_rows", f"""SELECT "rowId", trim(title) AS title, CASE told WHEN ' want' THEN 'WANTED' WHEN 'OWNED' THEN 'OWNED' END AS status, CASE WHEN bad THEN '{importing.CONFIRM_NO_TITLE}' ELSE '' END AS errors FROM sent""", CONFIRM_SQL)
def confirmed_rows(spark, d):
    return importing.confirmed_rows(sent_rows(spark, d))[0].select("rowId", "title", "status", F.array_join("errors", ";").alias("errors"))


@register("import_faults", """SELECT CASE WHEN told = 'unheard of' THEN 'Invalid collection status on row ' ELSE 'priority must be an integer from 1 to 5 on row ' END || "rowId"::VARCHAR || '.' AS fault FROM sent WHERE told = 'unheard of' OR level = 6""", CONFIRM_SQL)
def import_faults(spark, d):
    return importing.confirmed_rows(sent_rows(spark, d))[1]


APPLIED_SQL = IMPORT_SQL + """, goal AS (SELECT *, CASE WHEN action = 'updated' THEN duplicate ELSE -"rowId" END AS target, 'sheet ' || ("rowId" % 3)::VARCHAR AS sheet FROM acted WHERE action <> 'error'),
latest AS (SELECT target, max_by("rowId", (sheet, "rowId")) AS "rowId" FROM goal GROUP BY 1),
new AS (SELECT g.* FROM goal g JOIN latest l USING (target, "rowId"))
"""


def applied(spark, d, strategy: str = "update"):
    rows = import_rows(spark, d).withColumn("rowId", -F.col("rowId"))
    releases = stored_releases(spark, d).withColumn("importBatchId", F.lit(None).cast("string"))
    k = F.col("id")
    statuses = releases.where("status is not null").select(F.concat(F.lit("u"), (k % 2).cast("string")).alias("userId"), k.alias("releaseId"), "status", "priority")
    return importing.apply_import(rows, releases, statuses, T.sources(spark, d), "u1", "batch-1", strategy)


@register("import_releases", """SELECT coalesce(s.id, n.target) AS id, CASE WHEN n.target IS NOT NULL THEN n.title ELSE s.title END AS title, CASE WHEN n.target IS NOT NULL THEN n."catalogNo" ELSE s."catalogNo" END AS "catalogNo",
  CASE WHEN n.target IS NOT NULL THEN n."releaseDate" ELSE s."releaseDate" END AS "releaseDate", CASE WHEN n.target IS NOT NULL THEN 'batch-1' END AS batch FROM stored s FULL JOIN new n ON s.id = n.target""", APPLIED_SQL)
def import_releases(spark, d):
    return applied(spark, d)["releases"].select("id", "title", "catalogNo", "releaseDate", F.col("importBatchId").alias("batch"))


@register("created_duplicates", """SELECT id, title, "catalogNo", NULL::VARCHAR AS batch FROM stored UNION ALL SELECT -"rowId", title, "catalogNo", 'batch-1' FROM found WHERE NOT bad""", IMPORT_SQL)
def created_duplicates(spark, d):
    """With the strategy that creates, every row without an error is a release of its own, duplicate or not."""
    return applied(spark, d, "create")["releases"].select("id", "title", "catalogNo", F.col("importBatchId").alias("batch"))


@register("import_statuses", """, own AS (SELECT 'u' || (id % 2)::VARCHAR AS "userId", id AS "releaseId", status, priority FROM stored WHERE status IS NOT NULL)
SELECT coalesce(o."userId", 'u1') AS "userId", coalesce(o."releaseId", n.target) AS "releaseId", CASE WHEN n.target IS NOT NULL THEN 'owned' ELSE o.status END AS status, CASE WHEN n.target IS NOT NULL THEN n.priority ELSE o.priority END AS priority
FROM own o FULL JOIN new n ON o."userId" = 'u1' AND o."releaseId" = n.target""", APPLIED_SQL)
def import_statuses(spark, d):
    return applied(spark, d)["statuses"]


@register("import_sources", """SELECT "releaseId", url FROM sources UNION ALL (SELECT DISTINCT target, "sourceUrl" FROM goal WHERE trim("sourceUrl") <> '' EXCEPT SELECT "releaseId", url FROM sources)""", APPLIED_SQL)
def import_sources(spark, d):
    return applied(spark, d)["sources"].select("releaseId", "url")


# ---- the library of one user

SPELLED = ["owned", "Want", "skip", "ORDERED", "nonsense", "EXCLUDED"]
USER_SQL = T.SQL + f""", told AS (SELECT id, CASE (id % 6) WHEN 0 THEN 'OWNED' WHEN 1 THEN 'WANTED' WHEN 2 THEN 'NOT_OWNED' WHEN 3 THEN 'WANTED' WHEN 5 THEN 'EXCLUDED' END AS own, least(5, greatest(1, coalesce((CASE WHEN id % 5 <> 0 THEN id % 9 END)::INT, 3))) AS level, CASE WHEN id % 4 = 3 THEN 9 ELSE id % 2 END AS u FROM releases),
mine AS (SELECT r.* EXCLUDE (status, priority), CASE WHEN t.u = 1 THEN t.own END AS status, CASE WHEN t.u = 1 AND t.own IS NOT NULL THEN t.level END AS priority FROM releases r LEFT JOIN told t ON r.id = t.id)
"""


def statuses(spark, d):
    """Each release's status of one of three users, in old and new spellings."""
    k = F.col("id")
    return T.releases(spark, d).select(F.concat(F.lit("u"), F.when(k % 4 == 3, 9).otherwise(k % 2).cast("string")).alias("userId"), k.alias("releaseId"), pick(SPELLED, k).alias("status"), F.when(k % 5 != 0, k % 9).cast("int").alias("priority"))


@register("user_library", 'SELECT id, status, priority FROM mine', USER_SQL)
def user_library(spark, d):
    return library.with_status(T.releases(spark, d).drop("status", "priority"), statuses(spark, d), "u1").select("id", "status", "priority")


@register("no_user_library", 'SELECT id, NULL::VARCHAR AS status, NULL::INT AS priority FROM releases', T.SQL)
def no_user_library(spark, d):
    """Without a user no status is shown."""
    return library.with_status(T.releases(spark, d).drop("status", "priority"), statuses(spark, d), None).select("id", "status", "priority")


@register("serialised_library", """SELECT id, title, "releaseDate"::VARCHAR AS day, "catalogNo" AS number, status AS own, priority::VARCHAR AS level, status IS NULL AS absent FROM mine""", USER_SQL)
def serialised_library(spark, d):
    rows = library.serialised(library.with_status(T.releases(spark, d).drop("status", "priority"), statuses(spark, d), "u1"))
    field = lambda path: F.get_json_object("release", f"$.{path}")
    return rows.select("id", field("title").alias("title"), field("releaseDate").alias("day"), field("catalogNo").alias("number"), field("userStatus.status").alias("own"), field("userStatus.priority").alias("level"), F.col("release").contains('"userStatus":null').alias("absent"))


@register("release_detail", """, owner AS (SELECT c_custkey AS id, c_name AS name FROM customer)
SELECT m.id, m.title, o.name AS "artistName", m.status, (SELECT count(*) FROM sources s WHERE s."releaseId" = m.id)::INT AS n_sources FROM mine m JOIN owner o ON m."artistId" = o.id WHERE m.id = 7""", USER_SQL)
def release_detail(spark, d):
    one = library.detail(T.releases(spark, d).drop("status", "priority"), artists(spark, d), T.sources(spark, d), statuses(spark, d), 7, "u1")
    return one.select("id", "title", "artistName", "status", F.size("sources").alias("n_sources"))


@register("artist_options", "SELECT id, name FROM artists", ARTISTS_SQL)
def artist_options(spark, d):
    return library.artist_options(artists(spark, d))


@register("first_ten", 'SELECT id, title FROM releases ORDER BY "releaseDate" NULLS LAST, title, id LIMIT 10', T.SQL)
def first_ten(spark, d):
    return library.previews(T.releases(spark, d), 10).select("id", "title")


@register("export_scope", """SELECT title, coalesce("catalogNo", '') AS number FROM library WHERE category = 'LIVE' AND coalesce(status, 'NOT_OWNED') = 'OWNED' UNION ALL SELECT title, coalesce("catalogNo", '') FROM library""", T.SQL)
def export_scope(spark, d):
    """What the filters leave, and behind it the whole library."""
    rows = rows_of(spark, d)
    both = export.export(rows, Filters(category="LIVE", status="OWNED")).unionByName(export.export(rows))
    return both.select(F.col("`标题`").alias("title"), F.col("`原版品番`").alias("number"))


@register("export_columns", """SELECT id, format, coalesce(label, '') AS label, CASE WHEN "isRemaster" THEN '是' ELSE '否' END AS remaster, CASE WHEN "isExcludedByDefault" THEN '是' ELSE '否' END AS excluded, coalesce(notes, '') AS notes, '' AS price, '' AS edition, '' AS own_notes
FROM (SELECT r.*, CASE WHEN r.id % 6 <> 0 THEN 'Label ' || (r.id % 6)::VARCHAR END AS label FROM releases r)""", T.SQL)
def export_columns(spark, d):
    """The columns of an export that export_projection leaves out."""
    out = export.export_rows(rows_of(spark, d), keep=("id",))
    names = {"格式": "format", "厂牌": "label", "是否 Remaster": "remaster", "是否默认排除": "excluded", "备注": "notes", "原价": "price", "版本类型": "edition", "拥有状态备注": "own_notes"}
    return out.select("id", *[F.col(f"`{k}`").alias(v) for k, v in names.items()])


@register("export_files", """SELECT c_custkey, 'Shelf_' || regexp_replace(CASE c_custkey % 3 WHEN 0 THEN c_name ELSE replace(c_name, '#', '?/') || '"<x>|:*\\' END, '[\\\\/:*?"<>|]', '_', 'g') || '_' || strftime(DATE '2024-01-01' + (c_custkey % 400)::INT, '%Y%m%d') || '.xlsx' AS name FROM customer""")
def export_files(spark, d):
    k = F.col("c_custkey")
    artist = F.when(k % 3 == 0, F.col("c_name")).otherwise(F.concat(F.replace(F.col("c_name"), F.lit("#"), F.lit("?/")), F.lit('"<x>|:*\\')))
    return T.load(spark, d, "customer").select("c_custkey", export.file_names("Shelf", artist, F.date_add(F.lit("2024-01-01").cast("date"), (k % 400).cast("int"))).alias("name"))


@register("store_covers", f"""SELECT r.id, CASE WHEN min_by(s.releaseId % 2, s.id) FILTER (s.description = '{COVER_ROLE}') = 0 THEN 'https://music.apple.com/' || min(s.id) FILTER (s.description = '{COVER_ROLE}') END AS page FROM releases r LEFT JOIN sources s ON s."releaseId" = r.id GROUP BY 1""", T.SQL)
def store_covers(spark, d):
    """The cover's source, where it is a page of the store."""
    k = F.col("releaseId")
    pages = T.sources(spark, d).withColumn("url", F.concat(F.when(k % 2 == 0, "https://music.apple.com/").otherwise("https://music.apple.com.example/"), F.col("id")))
    return library.nest_sources(T.releases(spark, d), pages).select("id", store_cover_source(F.col("sources"))["url"].alias("page"))


@register("filter_any_year", 'SELECT id FROM releases WHERE id % 8 <> 0', T.SQL)
def filter_any_year(spark, d):
    """Own bounds that are both open still ask for a date."""
    rows = T.releases(spark, d).withColumn("releaseDate", F.when(F.col("id") % 8 != 0, F.col("releaseDate")))
    return library.filtered(rows, Filters.of({"decade": ["custom", "1980s"], "yearFrom": "0", "yearTo": "x", "page": "2"})).select("id")


@register("skipped_batch", """SELECT "artistId", count(*) FILTER (NOT bad AND duplicate IS NULL) AS created, 0::BIGINT AS updated, count(duplicate) AS skipped, count(*) FILTER (bad) AS errors, CASE WHEN count(*) FILTER (bad) > 0 AND count(*) FILTER (NOT bad AND duplicate IS NULL) = 0 THEN 'FAILED' ELSE 'IMPORTED' END AS batch_status FROM found GROUP BY 1""", IMPORT_SQL)
def skipped_batch(spark, d):
    """A batch that leaves duplicates out."""
    return import_rows(spark, d).withColumn("action", importing.action("skip")).groupBy("artistId").agg(*importing.outcome_columns())


# ---- changes


#: The least number among the artist's other releases, so that the patch of release 7 meets it.
NUMBER_SQL = """(SELECT coalesce(min(o."catalogNo"), 'CAT-1') FROM releases o JOIN releases r ON r.id = 7 AND o."artistId" = r."artistId" AND o.id <> 7)"""


def patched(spark, d):
    rel, src = T.releases(spark, d), T.sources(spark, d)
    own = rel.where("id = 7").select("artistId")
    number = rel.where("id <> 7").join(own, "artistId").agg(F.coalesce(F.min("catalogNo"), F.lit("CAT-1"))).first()[0]
    return mutations.patch_release(rel, src, 7, {"catalogNo": number, "coverUrl": None, "title": "New"})


@register("patch_fields", f"""SELECT id, CASE WHEN id = 7 THEN 'New' ELSE title END AS title, CASE WHEN id = 7 THEN {NUMBER_SQL} ELSE "catalogNo" END AS "catalogNo", CASE WHEN id <> 7 THEN "coverUrl" END AS "coverUrl", category FROM releases""", T.SQL)
def patch_fields(spark, d):
    return patched(spark, d)["releases"].select("id", "title", "catalogNo", "coverUrl", "category")


@register("patch_sources", f"""SELECT id FROM sources WHERE NOT ("releaseId" = 7 AND description IS NOT DISTINCT FROM '{COVER_ROLE}' AND EXISTS (SELECT 1 FROM releases WHERE id = 7 AND "coverUrl" IS NOT NULL))""", T.SQL)
def patch_sources(spark, d):
    """A changed cover takes the old cover's sources with it."""
    return patched(spark, d)["sources"].select("id")


@register("patch_warning", f"""SELECT 'Catalog number already exists on "' || min_by(o.title, o.id) || '".' AS warning FROM releases o JOIN releases r ON r.id = 7 AND o."artistId" = r."artistId" AND o.id <> 7 WHERE o."catalogNo" = {NUMBER_SQL} HAVING count(*) > 0""", T.SQL)
def patch_warning(spark, d):
    return patched(spark, d)["warning"]


URLS_GIVEN = [" https://x.example/a ", "javascript:alert(1)", "", None, "HTTP://y.example", "ftp://z.example/", "https://"]
GIVEN_SQL = T.SQL + f""", given AS (SELECT id, {pick_sql(URLS_GIVEN, "id")} AS url, CASE WHEN id % 3 = 0 THEN 'Shop' WHEN id % 3 = 1 THEN ' ' END AS label FROM releases)
"""


def given_sources(spark, d):
    k = F.col("id")
    return T.releases(spark, d).select(F.concat(F.lit("new-"), k.cast("string")).alias("id"), k.alias("releaseId"), pick(URLS_GIVEN, k).alias("url"), F.when(k % 3 == 0, "Shop").when(k % 3 == 1, " ").alias("label"))


@register("added_sources", """SELECT id, "releaseId", url, NULL::VARCHAR AS label FROM sources UNION ALL SELECT 'new-' || id::VARCHAR, id, trim(url), CASE WHEN label = 'Shop' THEN 'Shop' ELSE 'Manual source' END FROM given WHERE trim(url) IN ('https://x.example/a', 'HTTP://y.example')""", GIVEN_SQL)
def added_sources(spark, d):
    return mutations.add_sources(T.sources(spark, d), given_sources(spark, d))[0].select("id", "releaseId", "url", "label")


@register("refused_sources", """SELECT 'new-' || id::VARCHAR AS id, CASE WHEN coalesce(trim(url), '') = '' THEN 'url is required.' ELSE 'URL must use HTTP or HTTPS and be at most 2048 characters.' END AS fault FROM given WHERE url IS NULL OR trim(url) NOT IN ('https://x.example/a', 'HTTP://y.example')""", GIVEN_SQL)
def refused_sources(spark, d):
    return mutations.add_sources(T.sources(spark, d), given_sources(spark, d))[1].select("id", "fault")


@register("deleted_sources", """SELECT id FROM sources WHERE NOT (id LIKE '%-1' AND "releaseId" % 2 = 0)""", T.SQL)
def deleted_sources(spark, d):
    """First lines of all releases are named, half of them with another release's id: both must agree."""
    s = T.sources(spark, d)
    gone = s.where(F.col("id").endswith("-1")).select("id", (F.col("releaseId") + F.col("releaseId") % 2).alias("releaseId"))
    return mutations.delete_sources(s, gone).select("id")


FOLLOW_SQL = NAMES_SQL + """, follow AS (SELECT CASE WHEN "createdAt" < 100 THEN 'me' ELSE 'other' END AS "userId", id::VARCHAR AS "artistId" FROM artist),
known AS (SELECT a.name, min_by(x.id, (x."createdAt", x.id)) AS id FROM asked a JOIN artist x ON lower(x.name) = lower(a.name) GROUP BY 1),
fresh AS (SELECT min(name) AS name FROM asked WHERE name NOT IN (SELECT name FROM known) GROUP BY lower(name))
"""


def followed(spark, d):
    own = named_artists(spark, d).withColumn("id", F.col("id").cast("string"))
    follows = own.select(F.when(F.col("createdAt") < 100, "me").otherwise("other").alias("userId"), F.col("id").alias("artistId"))
    # ids are texts here, so the oldest artist's tie is settled among texts; days of creation do not repeat within a name
    return mutations.follow_artists(own, follows, asked_names(spark, d), "me")


@register("followed_artists", """SELECT id::VARCHAR AS id, name FROM artist UNION ALL SELECT 'artist:' || name, name FROM fresh""", FOLLOW_SQL)
def followed_artists(spark, d):
    return followed(spark, d)["artists"].select("id", "name")


@register("follows", """SELECT "userId", "artistId" FROM follow UNION SELECT 'me', id::VARCHAR FROM known UNION SELECT 'me', 'artist:' || name FROM fresh""", FOLLOW_SQL)
def follows(spark, d):
    return followed(spark, d)["follows"]


# ---- texts, values, URLs

ODD_TEXTS = ["", None, "  x  y ", "short", "12345678", "a secret of 20 chars", "　宽　", "山田 花子", "A & B", "A feat. B", "Team x Duo", "with love", "Withnail", "カタカナ"]


@register("text_forms", f"""SELECT k, CASE WHEN t IS NULL OR regexp_replace(t, '[\\s　]', '', 'g') = '' THEN NULL ELSE regexp_replace(t, '^[\\s　]+|[\\s　]+$', '', 'g') END AS text,
  regexp_replace(regexp_replace(coalesce(t, ''), '[\\s　]+', ' ', 'g'), '^ | $', '', 'g') AS header,
  coalesce(regexp_matches(t, '[\\p{{Han}}\\p{{Hiragana}}\\p{{Katakana}}\\p{{Hangul}}]'), false) AS cjk, coalesce(t IN ('A & B', 'A feat. B', 'Team x Duo', 'with love', '  x  y '), false) AS composite,
  CASE WHEN coalesce(t, '') = '' THEN '' WHEN length(t) <= 8 THEN left(t, 2) || '...' || right(t, 2) ELSE left(t, 4) || '...' || right(t, 4) END AS masked, left(repeat(coalesce(t, '-'), 300), 500) AS preview
FROM (SELECT p_partkey AS k, {pick_sql(ODD_TEXTS, "p_partkey")} AS t FROM part)""")
def text_forms(spark, d):
    t = pick(ODD_TEXTS, F.col("p_partkey"))
    return T.load(spark, d, "part").select(F.col("p_partkey").alias("k"), X.text_or_null(t).alias("text"), X.collapsed(t).alias("header"), F.coalesce(X.has_cjk(t), F.lit(False)).alias("cjk"), F.coalesce(X.is_composite(t), F.lit(False)).alias("composite"), X.masked(t).alias("masked"), X.cut(F.repeat(F.coalesce(t, F.lit("-")), F.lit(300)), X.PREVIEW_LENGTH).alias("preview"))


@register("redacted_messages", """SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'key ' || p_name || ' refused: ' || p_name ELSE 'key ' || left(p_name, n) || '...' || right(p_name, n) || ' refused: ' || left(p_name, n) || '...' || right(p_name, n) END AS message FROM (SELECT *, CASE WHEN length(p_name) <= 8 THEN 2 ELSE 4 END AS n FROM part)""")
def redacted_messages(spark, d):
    said = F.concat(F.lit("key "), F.col("p_name"), F.lit(" refused: "), F.col("p_name"))
    return T.load(spark, d, "part").select("p_partkey", X.redacted(said, F.when(F.col("p_size") % 4 == 0, "").otherwise(F.col("p_name"))).alias("message"))


FULL_WIDTH = ["Ａｌｂｕｍ １", "ｶﾀｶﾅ", "Album-1!", "  Ｍｉｘ （Live）", "日本", "ＵＳＡ", "jp", "France", "ﾆﾎﾝ"]
KEYS = ["album1", "カタカナ", "album1", "mixlive", "日本", "usa", "jp", "france", "ニホン"]
CODES = ["US", "US", "US", "US", "JP", "US", "JP", "US", "US"]


@register("composed_keys", f"""SELECT p_partkey, {pick_sql(KEYS, "p_partkey")} AS key, {pick_sql(CODES, "p_partkey")} AS code FROM part""")
def composed_keys(spark, d):
    """Keys and codes of texts that only Unicode composition makes equal."""
    t = pick(FULL_WIDTH, F.col("p_partkey"))
    return T.load(spark, d, "part").select("p_partkey", X.title_key(t).alias("key"), X.country_code(t).alias("code"))


@register("clamped_integers", """SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 7 ELSE least(40, greatest(-10, trunc(CASE WHEN event_id % 2 = 0 THEN value ELSE -value END)::BIGINT)) END AS n FROM events""")
def clamped_integers(spark, d):
    v, k = F.col("value"), F.col("event_id")
    number = F.when(k % 6 == 0, F.lit(float("nan"))).when(k % 2 == 0, v).otherwise(-v)
    return T.load(spark, d, "events").select("event_id", V.clamp_integer(number, 7, -10, 40).cast("long").alias("n"))


SENT_FLAGS, SENT_PRIORITIES = ["true", "false", "TRUE", "1", None], ["1", "5", "0", "6", "2.5", "3.0", "x", None]


@register("sent_values", f"""SELECT o_orderkey, o_orderkey % 5 = 0 AS flag, {pick_sql(["1", "5", None, None, None, "3", None, None], "o_orderkey")}::INT AS priority FROM orders""")
def sent_values(spark, d):
    k = F.col("o_orderkey")
    return T.load(spark, d, "orders").select("o_orderkey", mutations.flag(pick(SENT_FLAGS, k)).alias("flag"), mutations.whole_priority(pick(SENT_PRIORITIES, k)).alias("priority"))


SITES = ["https://a.example/x", " http://b.example ", "HTTPS://C.example/Q?x=1", "ftp://d.example", "javascript:x", "no url", "", None, "https://"]


@register("url_checks", f"""SELECT k, CASE WHEN i IN (0, 1, 2) AND NOT long THEN trim(u) END AS url, CASE WHEN long OR i IN (3, 4, 5, 8) THEN 'URL must use HTTP or HTTPS and be at most 2048 characters.' END AS fault
FROM (SELECT p_partkey AS k, p_partkey % 9 AS i, {pick_sql(SITES, "p_partkey")} AS u, p_size = 3 AND p_partkey % 9 IN (0, 2) AS long FROM part)""")
def url_checks(spark, d):
    k = F.col("p_partkey")
    site = pick(SITES, k)
    url = F.when((F.col("p_size") == 3) & (k % 9).isin(0, 2), F.rpad(site, 2049, "x")).otherwise(site)
    return T.load(spark, d, "part").select(k.alias("k"), U.http_or_null(url).alias("url"), U.http_error(url).alias("fault"))


ASCII = "".join(map(chr, range(33, 127)))
WIDE = "".join(chr(c + 0xFEE0) for c in range(33, 127))  # the same characters in full width


@register("composed_names", """SELECT p_partkey, regexp_replace(lower(p_name || ' - ' || p_type), '[^a-z0-9+]', '', 'g') AS key, CASE WHEN length(regexp_replace(p_name, '\\s', '', 'g')) = 2 THEN upper(p_name) ELSE 'US' END AS code FROM part""")
def composed_names(spark, d):
    """Keys and codes of the parts' names, written in full width."""
    wide = lambda c: F.translate(F.translate(c, ASCII, WIDE), " ", "　")
    return T.load(spark, d, "part").select("p_partkey", X.title_key(wide(F.concat("p_name", F.lit(" - "), "p_type"))).alias("key"), X.country_code(wide(F.col("p_name"))).alias("code"))


@register("name_forms", """SELECT p_partkey, p_name AS text, regexp_replace(p_name, ' +', ' ', 'g') AS header, left(p_name, CASE WHEN length(p_name) <= 8 THEN 2 ELSE 4 END) || '...' || right(p_name, CASE WHEN length(p_name) <= 8 THEN 2 ELSE 4 END) AS masked, left(repeat(p_name || ' ', 1 + (p_partkey % 90)::INT), 500) AS preview, length(repeat(p_name || ' ', 1 + (p_partkey % 90)::INT)) > 2000 AS longer FROM part""")
def name_forms(spark, d):
    """Forms of the parts' names, with white space about and between their words, and texts of them of many lengths, cut."""
    name, k = F.col("p_name"), F.col("p_partkey")
    spaced = F.concat(F.lit(" \t　"), F.regexp_replace(name, " ", " \n　"), F.lit("\r\n "))
    long = F.repeat(F.concat(name, F.lit(" ")), (1 + k % 90).cast("int"))
    return T.load(spark, d, "part").select("p_partkey", X.text_or_null(F.concat(F.lit("　\n"), name, F.lit(" "))).alias("text"), X.collapsed(spaced).alias("header"), X.masked(name).alias("masked"), X.cut(long, X.PREVIEW_LENGTH).alias("preview"), (F.length(X.cut(long, 2000)) < F.length(long)).alias("longer"))


@register("sent_numbers", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 2 AND o_custkey % 9 - 1 BETWEEN 1 AND 5 THEN (o_custkey % 9 - 1)::INT END AS priority FROM orders""")
def sent_numbers(spark, d):
    """Priorities sent as texts: whole numbers, such with a zero behind the point, and broken ones."""
    k, n = F.col("o_orderkey"), (F.col("o_custkey") % 9 - 1).cast("string")
    return T.load(spark, d, "orders").select("o_orderkey", mutations.whole_priority(F.concat(n, F.when(k % 3 == 0, "").when(k % 3 == 1, ".0").otherwise(".5"))).alias("priority"))


@register("url_lengths", """SELECT p_partkey, CASE WHEN p_size % 4 < 2 AND length(u) <= 2048 THEN u END AS url, CASE WHEN p_size % 4 >= 2 OR length(u) > 2048 THEN 'URL must use HTTP or HTTPS and be at most 2048 characters.' END AS fault
FROM (SELECT p_partkey, p_size, CASE p_size % 4 WHEN 0 THEN 'http' WHEN 1 THEN 'https' WHEN 2 THEN 'ftp' ELSE 'file' END || '://h' || p_partkey::VARCHAR || '.example/' || repeat('x', (2000 + p_partkey % 60)::INT) AS u FROM part)""")
def url_lengths(spark, d):
    """Addresses about the greatest length, of several schemes."""
    n, k = F.col("p_size") % 4, F.col("p_partkey")
    u = F.concat(F.when(n == 0, "http").when(n == 1, "https").when(n == 2, "ftp").otherwise("file"), F.lit("://h"), k.cast("string"), F.lit(".example/"), F.repeat(F.lit("x"), (2000 + k % 60).cast("int")))
    return T.load(spark, d, "part").select("p_partkey", U.http_or_null(u).alias("url"), U.http_error(u).alias("fault"))


@register("artist_aliases", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || '|' || p_brand WHEN 2 THEN p_brand ELSE p_name || '|' || p_brand || '|' || p_type END AS names FROM part""")
def artist_aliases(spark, d):
    k, name, brand = F.col("p_partkey"), F.col("p_name"), F.col("p_brand")
    kana = F.when(k % 4 == 0, " ").otherwise(brand)
    romaji = F.when(k % 4 == 0, F.col("p_name")).when(k % 4 == 3, F.col("p_type")).when(k % 4 == 1, brand)
    return T.load(spark, d, "part").select("p_partkey", F.array_join(selection.aliases(F.when(k % 4 != 2, name), kana, romaji), "|").alias("names"))


# ---- input rules: how many faults each row has, and the first


def faults_of(rows: DataFrame, key: str, rules: dict) -> DataFrame:
    good, bad = mutations.validated(rows, rules)
    return bad.select(key, F.array_join("faults", " ").alias("faults")).unionByName(good.select(key, F.lit("").alias("faults")))


def rules_sql(key: str, table: str, faults: list[tuple[str, str]]) -> str:
    """Messages, in their order, of the conditions that hold."""
    return f"SELECT {key}, array_to_string(list_filter([{', '.join(f'''CASE WHEN {when} THEN '{m}' END''' for m, when in faults)}], lambda x: x IS NOT NULL), ' ') AS faults FROM {table}"


@register("artist_form_faults", rules_sql("c_custkey", "customer", [("name is required.", "c_custkey % 7 = 0"), ("name has more than 160 characters.", "c_custkey % 7 = 1"), ("sortName has more than 160 characters.", "c_custkey % 5 = 0"), ("country has more than 80 characters.", "c_custkey % 3 = 0"), ("description has more than 4000 characters.", "c_custkey % 11 = 0")]))
def artist_form_faults(spark, d):
    k, name = F.col("c_custkey"), F.col("c_name")
    rows = T.load(spark, d, "customer").select("c_custkey", F.when(k % 7 == 0, " \t").when(k % 7 == 1, F.rpad(name, 161, "x")).otherwise(name).alias("name"), F.when(k % 5 == 0, F.rpad(name, 161, "x")).otherwise(F.rpad(name, 200, " ")).alias("sortName"), F.when(k % 3 == 0, F.repeat(F.lit("c"), F.lit(81))).alias("country"), F.when(k % 11 == 0, F.repeat(F.lit("d"), F.lit(4001))).otherwise("").alias("description"))
    return faults_of(rows, "c_custkey", mutations.artist_rules())


@register("bulk_faults", rules_sql("o_orderkey", "orders", [("releaseIds is required.", "o_orderkey % 7 IN (0, 1)"), ("artistId is required.", "o_orderkey % 5 = 0"), ("Invalid collection status.", "o_orderkey % 4 = 1"), ("priority must be an integer from 1 to 5.", "o_orderkey % 3 = 1"), ("No bulk update operation was provided.", "o_orderkey % 4 = 2 AND o_orderkey % 3 = 2 AND o_orderkey % 2 = 0")]))
def bulk_faults(spark, d):
    k = F.col("o_orderkey")
    ids = F.when(k % 7 == 0, F.expr("cast(array() as array<string>)")).when(k % 7 == 1, F.array(F.lit(""))).otherwise(F.array(k.cast("string"), F.lit("")))
    rows = T.load(spark, d, "orders").select("o_orderkey", F.when(k % 5 != 0, "a").alias("artistId"), ids.alias("releaseIds"), F.when(k % 4 == 1, "BAD").when(k % 4 == 2, "").otherwise("want").alias("status"), F.when(k % 3 == 1, "9").when(k % 3 == 0, "4").alias("priority"), F.when(k % 2 == 1, "false").alias("excluded"))
    return faults_of(rows, "o_orderkey", mutations.bulk_rules())


@register("status_faults", rules_sql("o_orderkey", "orders", [("Invalid collection status.", "o_orderkey % 5 = 4"), ("priority must be an integer from 1 to 5.", "o_orderkey % 8 IN (2, 3, 4, 6, 7)")]))
def status_faults(spark, d):
    k = F.col("o_orderkey")
    rows = T.load(spark, d, "orders").select("o_orderkey", pick(["OWNED", "want", "Skip ", "unknown", "nothing"], k).alias("status"), pick(SENT_PRIORITIES, k).alias("priority"))
    return faults_of(rows, "o_orderkey", mutations.status_rules())


@register("request_faults", rules_sql("o_orderkey", "orders", [("artistName is required.", "o_orderkey % 6 IN (0, 1)"), ("country is required.", "o_orderkey % 5 = 0"), ("Invalid target.", "o_orderkey % 4 = 3"), ("excludeReissues is required.", "o_orderkey % 9 = 0"), ("includeLiveRemixBest is required.", "o_orderkey % 11 = 0")]))
def request_faults(spark, d):
    k = F.col("o_orderkey")
    rows = T.load(spark, d, "orders").select("o_orderkey", F.when(k % 6 == 0, " ").when(k % 6 == 1, F.repeat(F.lit("n"), F.lit(161))).otherwise(F.lit("Name")).alias("artistName"), F.when(k % 5 == 0, "").otherwise(F.lit("Japan")).alias("country"), pick(["ORIGINAL_CD", "ALL_CD", "ALL_PHYSICAL", "TAPE"], k).alias("target"), F.when(k % 9 != 0, True).alias("excludeReissues"), F.lit(False).alias("includeCollaborations"), F.when(k % 11 != 0, False).alias("includeLiveRemixBest"))
    return faults_of(rows, "o_orderkey", mutations.request_rules())


@register("edit_faults", rules_sql("o_orderkey", "orders", [("title must have 1 to 300 characters.", "o_orderkey % 7 IN (0, 1)"), ("Invalid category.", "o_orderkey % 10 = 4"), ("Date must be a real calendar date in YYYY-MM-DD format.", "o_orderkey % 6 = 1"), ("URL must use HTTP or HTTPS.", "o_orderkey % 8 = 3"), ("label is too long.", "o_orderkey % 9 = 0"), ("notes is too long.", "o_orderkey % 11 = 0")]))
def edit_faults(spark, d):
    k = F.col("o_orderkey")
    long = lambda n: F.repeat(F.lit("x"), F.lit(n))
    rows = T.load(spark, d, "orders").select("o_orderkey", F.when(k % 7 == 0, " ").when(k % 7 == 1, long(301)).otherwise(F.lit(" Title ")).alias("title"), F.lit("Credit").alias("artistCredit"), pick(V.CATEGORIES, k).alias("category"), F.when(k % 6 == 1, "2025-02-30").when(k % 6 == 2, " 2024-02-29 ").alias("originalReleaseDate"), F.when(k % 8 == 3, "data:x").when(k % 8 == 4, "https://a.example/c.jpg").alias("coverImageUrl"), F.lit("CD").alias("format"), F.lit(None).cast("string").alias("catalogNumber"), F.when(k % 9 == 0, long(201)).alias("label"), F.when(k % 11 == 0, long(4001)).alias("notes"))
    return faults_of(rows, "o_orderkey", mutations.edit_rules())


@register("import_input_faults", rules_sql("o_orderkey", "orders", [("artistId is required.", "o_orderkey % 3 = 0 AND o_orderkey % 2 = 0"), ("artistName is required.", "o_orderkey % 3 = 1 AND o_orderkey % 4 = 0"), ("Invalid artistMode.", "o_orderkey % 3 = 2"), ("Too many ids.", "o_orderkey % 500 = 0"), ("Candidate IDs must be unique.", "o_orderkey % 7 = 0"), ("Only selected candidates may be changed.", "o_orderkey % 5 = 0")]))
def import_input_faults(spark, d):
    k = F.col("o_orderkey")
    text = lambda x: x.cast("string")
    chosen = F.concat(F.array(F.lit("a"), F.lit("b")), F.when(k % 7 == 0, F.array(F.lit("a"))).otherwise(F.array(text(k))))
    none = F.expr("cast(array() as array<string>)")
    pending = F.when(k % 500 == 0, F.transform(F.sequence(F.lit(1), F.lit(1001)), text)).otherwise(none)
    rows = T.load(spark, d, "orders").select("o_orderkey", pick(["existing", "create", "other"], k).alias("artistMode"), F.when(k % 2 != 0, "id").alias("artistId"), F.when(k % 4 != 0, "name").otherwise(" ").alias("artistName"), chosen.alias("selected"), none.alias("excluded"), pending.alias("pending"), F.when(k % 5 == 0, F.array(F.lit("z"))).otherwise(F.array(F.lit("b"))).alias("edited"))
    return faults_of(rows, "o_orderkey", mutations.import_input_rules())


@register("repeated_selection", """SELECT l_orderkey, count(*) <> count(DISTINCT l_partkey % 50) AS repeats FROM lineitem GROUP BY 1""")
def repeated_selection(spark, d):
    ids = T.load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_partkey") % 50).alias("ids"))
    return ids.select("l_orderkey", selection.has_repeats(F.col("ids")).alias("repeats"))


# ---- tasks

TASK_SQL = """WITH task AS (SELECT event_id AS id, event_id % 5 AS "userId", CASE WHEN event_type = 'click' THEN 'SUCCEEDED' ELSE 'FAILED' END AS status FROM events)
"""


@register("own_task", """SELECT id, "userId", status FROM task WHERE id = 12 AND "userId" = 2 UNION ALL SELECT id, "userId", status FROM task WHERE id = 13 AND "userId" = 2 UNION ALL SELECT id, "userId", status FROM task WHERE id = 22 AND "userId" = 2 AND status = 'SUCCEEDED'""", TASK_SQL)
def own_task(spark, d):
    """A user's own task, another's, and one that must have succeeded."""
    k = F.col("event_id")
    rows = T.load(spark, d, "events").select(k.alias("id"), (k % 5).alias("userId"), F.when(F.col("event_type") == "click", "SUCCEEDED").otherwise("FAILED").alias("status"))
    return tasks.of_user(rows, 12, 2).unionByName(tasks.of_user(rows, 13, 2)).unionByName(tasks.of_user(rows, 22, 2, succeeded=True))


@register("search_calls", """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 0 ELSE event_id % 3 END::INT AS calls, CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN event_id % 4 ELSE event_id % 4 + 1 END::INT AS found FROM events""")
def search_calls(spark, d):
    k = F.col("event_id")
    urls = lambda n: F.transform(F.filter(F.sequence(F.lit(0), n), lambda i: i > 0), lambda i: i.cast("string"))
    item = lambda kind, sources: F.struct(F.lit(kind).alias("type"), sources.alias("sources"))
    nothing = F.expr("cast(null as array<string>)")
    output = F.when(k % 3 == 0, F.array(item("message", urls(F.lit(3))))).when(k % 3 == 1, F.array(item("web_search_call", urls((k % 4).cast("int"))), item("message", nothing))).otherwise(F.array(item("web_search_call", urls((k % 4).cast("int"))), item("web_search_call", F.array(F.lit("u")))))
    calls, found = tasks.search_calls(output)
    return T.load(spark, d, "events").select("event_id", calls.alias("calls"), found.alias("found"))
