"""Spreadsheet import: typed rows, duplicates, actions, new snapshots.

Rows have rowId, sheetName, rowNumber, category, title, releaseDate, format, catalogNo, label, isReissue, notes, coverUrl,
sourceUrl, priority, status, included and errors (array of text).
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.text import collapsed, is_blank, text_or_null, trimmed
from .library import count_where

# Spellings of each column's header.
HEADERS = {
    "type": ["分类", "类型"],
    "title": ["标题"],
    "releaseDate": ["原版发行日", "发行日", "原版CD发行日", "原版 CD 发行日"],
    "format": ["格式"],
    "catalogNo": ["原版品番", "品番", "应找原版 CD 品番", "原版CD品番", "原版 CD 品番"],
    "label": ["厂牌"],
    "isReissue": ["是否再版"],
    "notes": ["备注"],
    "coverUrl": ["封面图", "封面图 URL", "封面 URL", "Cover Image URL"],
    "sourceUrl": ["来源 URL", "来源URL", "来源 url", "Source URL"],
    "priority": ["优先级", "优先度"],
    "status": ["收集状态", "收藏状态"],
    "included": ["是否纳入"],
}
IGNORED_SHEETS = ("总览", "收藏口径", "术语与排除项", "选项")
SHEETS = ("A_原创专辑原版CD", "B_单曲原版CD", "C_精选现场混音")
NO_TITLE = "缺少标题"
CONFIRM_NO_TITLE = "Missing title"
STRATEGIES = ("skip", "update", "create")
UPDATED = ("category", "title", "releaseDate", "format", "catalogNo", "label", "isReissue", "notes", "coverUrl")


def takes_sheet(sheet: Column) -> Column:
    hit = F.lit(False)
    for s in SHEETS:
        hit = hit | sheet.contains(s)
    return ~sheet.isin(*IGNORED_SHEETS) & hit


def cell(cells: Column, field: str) -> Column:
    """The first cell, in column order, whose header is one of the field's spellings. cells: array<struct<name,...>>, name the header in lower case with single spaces."""
    names = [h.lower() for h in HEADERS[field]]
    return F.try_element_at(F.filter(cells, lambda c: c["name"].isin(*names)), F.lit(1))


def typed_rows(raw: DataFrame) -> DataFrame:
    """Typed rows of (fileName, sheetName, rowNumber, cells). A row without a title stays, with an error. `raw` keeps the cells by header."""
    raw = raw.where(takes_sheet(F.col("sheetName")))
    # headers are normalised once, and each field's cell is looked for once
    headed = F.transform("cells", lambda c: F.struct(collapsed(c["header"]).alias("header"), c["text"].alias("text"), c["serial"].alias("serial")))
    raw = raw.withColumn("cells", headed).withColumn("cells", F.transform("cells", lambda c: F.struct(F.lower(c["header"]).alias("name"), c["header"].alias("header"), c["text"].alias("text"), c["serial"].alias("serial"))))
    raw = raw.withColumns({f"__{field}": cell(F.col("cells"), field) for field in HEADERS})
    raw = raw.withColumns({f"__{field}_text": trimmed(F.coalesce(F.col(f"__{field}.text"), F.lit(""))) for field in HEADERS})
    at = lambda field: F.col(f"__{field}")
    text = lambda field: F.col(f"__{field}_text")
    date = F.coalesce(V.serial_date(at("releaseDate")["serial"]), V.written_date(at("releaseDate")["text"]))
    rows = raw.withColumn("included", V.included(text("included")))
    named = F.filter("cells", lambda c: c["header"] != "")
    by_header = F.map_from_entries(F.transform(F.array_distinct(F.transform(named, lambda c: c["header"])), lambda h: F.struct(h, F.element_at(F.filter(named, lambda c: c["header"] == h), -1)["text"])))
    return rows.select(
        F.concat_ws(":", "fileName", "sheetName", F.col("rowNumber").cast("string")).alias("rowId"),
        "sheetName",
        "rowNumber",
        V.sheet_category(F.col("sheetName"), text("type")).alias("category"),
        text("title").alias("title"),
        date.alias("releaseDate"),
        V.sheet_format(text("format")).alias("format"),
        *[F.nullif(text(c), F.lit("")).alias(c) for c in ("catalogNo", "label", "notes", "coverUrl", "sourceUrl")],
        V.boolean(text("isReissue")).alias("isReissue"),
        V.priority(text("priority")).alias("priority"),
        V.status(text("status"), F.col("included")).alias("status"),
        "included",
        F.when(text("title") == "", F.array(F.lit(NO_TITLE))).otherwise(F.expr("cast(array() as array<string>)")).alias("errors"),
        by_header.alias("raw"),
    )


def with_duplicates(rows: DataFrame, releases: DataFrame, artist: Column) -> DataFrame:
    """Adds duplicateId, the least id of the artist's release with the row's catalogue number, or without a number with its
    title, date (null equals null) and format. Rows with errors or no title are not looked up. Each side is one row per key, so rows never multiply."""
    rows = rows.withColumn("artistId", artist)
    looked = (F.size("errors") == 0) & ~is_blank(F.col("title"))
    numbered = ~is_blank(F.col("catalogNo"))
    by_number = releases.where(~is_blank(F.col("catalogNo"))).groupBy("artistId", "catalogNo").agg(F.min("id").alias("__byNumber"))
    by_title = releases.groupBy("artistId", "title", "releaseDate", "format").agg(F.min("id").alias("__byTitle"))
    out = rows.withColumn("__n", F.when(looked & numbered, F.col("catalogNo"))).withColumn("__t", F.when(looked & ~numbered, F.col("title")))
    n, t = by_number.alias("n"), by_title.alias("t")
    out = out.alias("r").join(n, (F.col("r.artistId") == F.col("n.artistId")) & (F.col("r.__n") == F.col("n.catalogNo")), "left").select("r.*", "n.__byNumber")
    out = out.alias("r").join(t, (F.col("r.artistId") == F.col("t.artistId")) & (F.col("r.__t") == F.col("t.title")) & F.col("r.releaseDate").eqNullSafe(F.col("t.releaseDate")) & (F.col("r.format") == F.col("t.format")), "left").select("r.*", "t.__byTitle")
    return out.withColumn("duplicateId", F.coalesce("__byNumber", "__byTitle")).drop("__n", "__t", "__byNumber", "__byTitle")


def preview_columns() -> list[Column]:
    return [
        F.count("*").alias("total_rows"),
        count_where((F.size("errors") == 0) & F.col("included")).alias("importable_rows"),
        count_where(F.col("duplicateId").isNotNull()).alias("duplicate_rows"),
        count_where(F.size("errors") > 0).alias("error_rows"),
    ]


def confirmed_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows as they are imported, faults that forbid the whole batch). A blank title is an error of its row only."""
    good = V.canonical_status(F.col("status"))
    fault = F.when(good.isNull(), F.concat(F.lit("Invalid collection status on row "), F.col("rowNumber"), F.lit("."))).when(~F.coalesce(F.col("priority").between(1, 5), F.lit(False)), F.concat(F.lit("priority must be an integer from 1 to 5 on row "), F.col("rowNumber"), F.lit(".")))
    blank = is_blank(trimmed(F.col("title"))) & ~F.array_contains("errors", CONFIRM_NO_TITLE)
    ready = rows.withColumn("errors", F.when(blank, F.array_append("errors", F.lit(CONFIRM_NO_TITLE))).otherwise(F.col("errors"))).withColumn("title", trimmed(F.col("title"))).withColumn("status", good)
    return ready, rows.select(fault.alias("fault")).where("fault is not null")


def action(strategy: str) -> Column:
    """What a row does: error, skipped, updated or created. An unknown strategy skips duplicates."""
    on_duplicate = {"update": "updated", "create": "created"}.get(strategy, "skipped")
    return F.when(F.size("errors") > 0, "error").when(F.col("duplicateId").isNotNull(), on_duplicate).otherwise("created")


def outcome_columns() -> list[Column]:
    """Counters of a batch, and its status: failed if it has errors and made nothing."""
    n = lambda a: count_where(F.col("action") == a)
    return [n("created").alias("created"), n("updated").alias("updated"), n("skipped").alias("skipped"), n("error").alias("errors"), F.when((n("error") > 0) & (n("created") == 0) & (n("updated") == 0), "FAILED").otherwise("IMPORTED").alias("batch_status")]


def batch_errors(rows: DataFrame) -> DataFrame:
    """(rowId, sheetName, rowNumber, errors) of a batch's error rows, as they were before anything was stored. Rows, not one list: a batch may have any number."""
    return rows.where(F.size("errors") > 0).select("rowId", "sheetName", "rowNumber", "errors")


def last_wins(updates: DataFrame, target: str, order: str) -> DataFrame:
    """Of several updates of one target the last stays: a partial maximum, however many there are."""
    return updates.groupBy(target).agg(F.max_by(F.struct(*updates.columns), F.col(order)).alias("__x")).select("__x.*")


def apply_import(rows: DataFrame, releases: DataFrame, statuses: DataFrame, sources: DataFrame, user: object, batch: object, strategy: str) -> dict[str, DataFrame]:
    """New snapshots of releases, statuses and sources. Duplicates were looked up before, so rows of one file never meet each
    other: each creates a release. Several rows that update one release: the last one's fields stay, all their source URLs do."""
    acted = rows.withColumn("action", action(strategy)).withColumn("order", F.struct("sheetName", "rowNumber"))
    acted = acted.withColumn("releaseId", F.when(F.col("action") == "updated", F.col("duplicateId")).otherwise(F.col("rowId"))).where(F.col("action").isin("created", "updated"))
    changed = last_wins(acted.where("action = 'updated'"), "releaseId", "order").select(F.col("releaseId").alias("id"), F.struct(*UPDATED).alias("new"))
    kept = releases.join(changed, "id", "left")
    for c in UPDATED:
        kept = kept.withColumn(c, F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)))
    kept = kept.withColumn("importBatchId", F.when(F.col("new").isNotNull(), F.lit(batch)).otherwise(F.col("importBatchId"))).drop("new")
    made = acted.where("action = 'created'").select(F.col("releaseId").alias("id"), "artistId", *UPDATED, F.lit(batch).alias("importBatchId"))
    own = last_wins(acted, "releaseId", "order").select(F.lit(user).alias("userId"), "releaseId", "status", "priority")
    given = text_or_null(F.col("sourceUrl"))
    links = acted.where(given.isNotNull()).select("releaseId", F.col("sourceUrl").alias("url")).distinct().join(sources.select("releaseId", "url"), ["releaseId", "url"], "left_anti")
    links = links.select(F.concat_ws("|", "releaseId", "url").alias("id"), "releaseId", "url", F.lit("Imported source URL").alias("label"), F.lit(None).cast("string").alias("description"))
    from .mutations import upsert_statuses

    return {"releases": kept.unionByName(made, allowMissingColumns=True), "statuses": upsert_statuses(statuses, own), "sources": sources.unionByName(links, allowMissingColumns=True)}


def sheet_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("sheetName", "category").count()


def coverage(rows: DataFrame, columns: list[str]) -> DataFrame:
    """How many rows have a value in each column."""
    return rows.agg(*[count_where(~is_blank(F.col(c).cast("string"))).alias(c) for c in columns])
