"""Export of a library: one flat row per release."""

import datetime
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.filters import Filters, cover_source, evidence
from .library import filtered, ordered

# Column titles of the exported sheet, in order.
TITLES = ("收藏状态", "优先级", "分类", "标题", "原版发行日", "格式", "原版品番", "厂牌", "原价", "版本类型", "是否再版", "是否 Remaster", "是否默认排除", "封面图 URL", "封面来源 URL", "来源 URL", "备注", "拥有状态备注")


def export_rows(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """All columns as texts, nulls as empty ones; evidence URLs a line each, the cover's URL in a column of its own."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in rows.columns else F.lit("")
    flag = lambda c: F.when(F.col(c), "是").otherwise("否")
    note = F.coalesce(*[F.col(c) for c in ("ownedNotes", "statusNotes") if c in rows.columns], F.lit(""))
    values = [F.coalesce("status", F.lit("NOT_OWNED")), text("priority"), text("category"), text("title"), text("releaseDate"), text("format"), text("catalogNo"), text("label"), text("originalPrice"), text("editionType"), flag("isReissue"), flag("isRemaster"), flag("isExcludedByDefault"), text("coverUrl"), F.coalesce(cover_source(F.col("sources"))["url"], F.lit("")), F.array_join(F.transform(evidence(F.col("sources")), lambda s: s["url"]), "\n"), text("notes"), note]
    return rows.select(*keep, *[v.alias(t) for v, t in zip(values, TITLES, strict=True)])


# Fixed value: the sheet that an export fills.
SHEET = "CD-BOX"


def export(rows: DataFrame, filters: Filters | None = None) -> DataFrame:
    """The whole library, or what the filters leave, in the library's order."""
    return export_rows(ordered(filtered(rows, filters) if filters else rows))


def save(rows: DataFrame, folder: str, filters: Filters | None = None, most: int = 100_000) -> None:
    """export() as workbooks of `most` rows in a folder, by the data source `workbook`, which the session must know. A task's rows are in the library's order."""
    export(rows, filters).write.format("workbook").mode("append").option("sheet", SHEET).option("maxRows", most).save(folder)


REFUSED = r'[\\/:*?"<>|]'


def file_name(prefix: str, artist: str, day: datetime.date) -> str:
    """prefix_artist_yyyymmdd.xlsx; characters that file systems refuse become underscores."""
    return f"{prefix}_{re.sub(REFUSED, '_', artist)}_{day:%Y%m%d}.xlsx"


def file_names(prefix: str, artist: Column, day: Column) -> Column:
    """file_name() of columns."""
    return F.concat(F.lit(f"{prefix}_"), F.regexp_replace(artist, REFUSED, "_"), F.lit("_"), F.date_format(day, "yyyyMMdd"), F.lit(".xlsx"))
