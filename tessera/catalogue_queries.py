"""Queries of the catalogue operators over the driver's tables, and the same in SQL."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import catalogue_tables as T
from .functions import text as X
from .functions import urls as U
from .functions import values as V
from .operators import export, importing, library, mutations, provenance, quality, resolve, selection, tasks
from .operators.research import first_of_each
from .plans.filters import COVER_ROLE, Filters, cover_source, evidence

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str, prefix: str = ""):
    def put(f):
        QUERIES[name] = f
        ORACLE_SQL[name] = prefix + sql
        return f

    return put


def rows_of(spark, d: str) -> DataFrame:
    return library.nest_sources(T.releases(spark, d), T.sources(spark, d))


def counted(spark, d) -> DataFrame:
    return library.with_evidence(T.releases(spark, d), T.sources(spark, d))


@register("library_stats", """
SELECT "artistId", count(*) AS total, count(*) FILTER (status = 'OWNED') AS owned, count(*) FILTER (status = 'NOT_OWNED') AS not_owned,
  count(*) FILTER (status = 'WANTED') AS wanted, count(*) FILTER (coalesce(status = 'PENDING_REVIEW', false) OR review) AS pending_review,
  count(*) FILTER (excluded) AS excluded, count(*) FILTER (no_cover) AS missing_cover, count(*) FILTER (evidence = 0) AS missing_source,
  count(*) FILTER (no_catalog) AS missing_catalog,
  CASE WHEN count(*) FILTER (NOT excluded) = 0 THEN 0 ELSE round(100.0 * count(*) FILTER (NOT excluded AND status = 'OWNED') / count(*) FILTER (NOT excluded))::INT END AS completion_rate
FROM library GROUP BY 1""", T.SQL)
def library_stats(spark, d):
    return library.stats(counted(spark, d))


@register("collection_counts", """
SELECT "artistId", greatest(0, count(*) - count(*) FILTER (excluded)) AS collectible,
  greatest(0, greatest(0, count(*) - count(*) FILTER (excluded)) - count(*) FILTER (status = 'OWNED')) AS gap
FROM library GROUP BY 1""", T.SQL)
def collection_counts(spark, d):
    return library.collection_counts(library.stats(counted(spark, d))).select("artistId", "collectible", "gap")


@register("category_completion", """
, grp AS (SELECT * FROM (VALUES (0, 'ORIGINAL_ALBUM', ['ORIGINAL_ALBUM']), (1, 'SINGLE', ['SINGLE']), (2, 'BEST_COLLECTION', ['BEST', 'COLLECTION', 'COMPILATION']),
  (3, 'LIVE', ['LIVE']), (4, 'REMIX', ['REMIX']), (5, 'OTHER', ['BOX', 'EP', 'OTHER'])) g(position, grp, names)),
n AS (SELECT "artistId", position, grp, count(*) FILTER (NOT excluded AND list_contains(names, category) AND status = 'OWNED') AS owned,
  count(*) FILTER (NOT excluded AND list_contains(names, category)) AS total FROM library, grp GROUP BY 1, 2, 3)
SELECT *, CASE WHEN total = 0 THEN 0 ELSE round(100.0 * owned / total)::INT END AS rate FROM n""", T.SQL)
def category_completion(spark, d):
    return library.category_completion(T.releases(spark, d))


def filter_query(name: str, where: str, **fields):
    needs_sources = any(k in fields for k in ("gap", "missingSource"))

    @register(name, f'SELECT id, "artistId", title FROM library WHERE {where}', T.SQL)
    def run(spark, d):
        rows = counted(spark, d) if needs_sources else T.releases(spark, d)
        return library.filtered(rows, Filters(**fields)).select("id", "artistId", "title")


filter_query("filter_keyword", "lower(title) LIKE '%e 49%' OR lower(coalesce(\"catalogNo\", '')) LIKE '%e 49%' OR lower(coalesce(notes, '')) LIKE '%e 49%'", q="  E 49 ")
filter_query("filter_keyword_catalog", "lower(coalesce(\"catalogNo\", '')) LIKE '%cat-77%' OR lower(coalesce(notes, '')) LIKE '%cat-77%'", q="cat-77")
filter_query("filter_category", "category = 'LIVE'", category="LIVE")
filter_query("filter_status_default", "coalesce(status, 'NOT_OWNED') = 'NOT_OWNED'", status="NOT_OWNED")
filter_query("filter_confidence", "confidence = 'MEDIUM'", confidence="MEDIUM")
filter_query("filter_flags", "\"isExcludedByDefault\" AND NOT \"isReissue\" AND \"isRemaster\"", excluded="true", reissue="no", remaster="true")
filter_query("filter_missing_cover", "no_cover", missingCover="true")
filter_query("filter_missing_source", "evidence = 0", missingSource="true")
filter_query("filter_missing_catalog", "no_catalog", missingCatalog="true")
filter_query("filter_pending_review", "coalesce(status = 'PENDING_REVIEW', false) OR review", pendingReview="true")
filter_query("filter_gap", "coalesce(status, 'NOT_OWNED') IN ('NOT_OWNED', 'WANTED', 'PENDING_REVIEW') OR no_cover OR evidence = 0 OR review", gap="true")
filter_query("filter_decade", "year(\"releaseDate\") BETWEEN 2000 AND 2009", decade="2000s")
filter_query("filter_custom_year", "year(\"releaseDate\") >= 1997 AND year(\"releaseDate\") <= 1998", decade="custom", yearFrom="1997", yearTo="1998")
filter_query("filter_open_year", "year(\"releaseDate\") >= 2000", decade="custom", yearFrom="2000", yearTo="soon")


@register("library_order", """
SELECT id, "artistId", row_number() OVER (PARTITION BY "artistId" ORDER BY CASE WHEN id % 8 <> 0 THEN "releaseDate" END ASC NULLS LAST, title, id)::INT AS position FROM releases""", T.SQL)
def library_order(spark, d):
    rows = T.releases(spark, d).withColumn("releaseDate", F.when(F.col("id") % 8 != 0, F.col("releaseDate")))
    return library.numbered_positions(rows).select("id", "artistId", "position")


ARTISTS_SQL = T.SQL + """, artists AS (SELECT c_custkey AS id, c_name AS name, TIMESTAMP '2020-01-01' + to_days((c_custkey * 7919 % 1000)::INT) AS "updatedAt" FROM customer)"""


def artists(spark, d):
    k = F.col("c_custkey")
    return T.load(spark, d, "customer").select(k.alias("id"), F.col("c_name").alias("name"), F.date_add(F.lit("2020-01-01").cast("date"), (k * 7919 % 1000).cast("int")).cast("timestamp").alias("updatedAt"))


DASHBOARD_SQL = ARTISTS_SQL + """, top AS (SELECT * FROM artists ORDER BY "updatedAt" DESC, id LIMIT 12),
n AS (SELECT t.id, t.name, (SELECT count(*) FROM releases r WHERE r."artistId" = t.id) AS releases,
  (SELECT count(*) FROM releases r WHERE r."artistId" = t.id AND r.status = 'WANTED') AS wanted FROM top t)
"""


def top12(spark, d):
    rows = T.releases(spark, d)
    return library.dashboard(artists(spark, d), {"releases": rows, "wanted": rows.where("status = 'WANTED'")})


@register("dashboard_top12", "SELECT id, name, releases, wanted FROM n", DASHBOARD_SQL)
def dashboard_top12(spark, d):
    return top12(spark, d).select("id", "name", "releases", "wanted")


@register("dashboard_sums", "SELECT sum(releases)::BIGINT AS releases, sum(wanted)::BIGINT AS wanted FROM n", DASHBOARD_SQL)
def dashboard_sums(spark, d):
    return top12(spark, d).agg(F.sum("releases").alias("releases"), F.sum("wanted").alias("wanted"))


@register("source_roles", f"""
SELECT r.id, coalesce(count(s.id) FILTER (s.description IS DISTINCT FROM '{COVER_ROLE}'), 0)::INT AS evidence,
  min_by(s.url, s.id) FILTER (s.description = '{COVER_ROLE}') AS cover
FROM releases r LEFT JOIN sources s ON s."releaseId" = r.id GROUP BY 1""", T.SQL)
def source_roles(spark, d):
    return rows_of(spark, d).select("id", F.size(evidence(F.col("sources"))).alias("evidence"), cover_source(F.col("sources"))["url"].alias("cover"))


@register("export_projection", f"""
SELECT r.id, coalesce(r.status, 'NOT_OWNED') AS status, coalesce(r.priority::VARCHAR, '') AS priority, r.category, r.title, r."releaseDate"::VARCHAR AS release_date,
  coalesce(r."catalogNo", '') AS catalog_no, CASE WHEN r."isReissue" THEN '是' ELSE '否' END AS reissue, coalesce(r."coverUrl", '') AS cover,
  coalesce(min_by(s.url, s.id) FILTER (s.description = '{COVER_ROLE}'), '') AS cover_source,
  coalesce(string_agg(s.url, chr(10) ORDER BY s.id) FILTER (s.description IS DISTINCT FROM '{COVER_ROLE}' AND s.id IS NOT NULL), '') AS urls
FROM releases r LEFT JOIN sources s ON s."releaseId" = r.id GROUP BY ALL""", T.SQL)
def export_projection(spark, d):
    out = export.export_rows(rows_of(spark, d), keep=("id",))
    names = {"收藏状态": "status", "优先级": "priority", "分类": "category", "标题": "title", "原版发行日": "release_date", "原版品番": "catalog_no", "是否再版": "reissue", "封面图 URL": "cover", "封面来源 URL": "cover_source", "来源 URL": "urls"}
    return out.select("id", *[F.col(f"`{k}`").alias(v) for k, v in names.items()])


@register("owned_scope", """
SELECT r.id FROM releases r WHERE r."artistId" = 7 AND r.id IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 20)""", T.SQL)
def owned_scope(spark, d):
    ids = T.load(spark, d, "lineitem").where("l_quantity > 20").select(F.col("l_orderkey").alias("id"))
    return mutations.scoped(T.releases(spark, d), 7, ids).select("id")


# Rows of a spreadsheet: every release comes again, some under another number or title, some without a number, some with a fault.
IMPORT_SQL = T.SQL + """, stored AS (SELECT * REPLACE (CASE WHEN id % 4 = 0 THEN 'OLD-' || id::VARCHAR ELSE "catalogNo" END AS "catalogNo", CASE WHEN id % 5 = 0 THEN 'Old ' || title ELSE title END AS title) FROM releases),
file AS (SELECT id AS "rowId", "artistId", CASE WHEN id % 6 = 1 THEN 'NEW-' || id::VARCHAR WHEN id % 2 = 0 THEN "catalogNo" END AS "catalogNo", CASE WHEN id % 25 = 0 THEN '' ELSE title END AS title,
  CASE WHEN id % 9 <> 0 THEN "releaseDate" END AS "releaseDate", format, category, id % 25 = 0 AS bad, id % 6 <> 0 AS included, CASE WHEN id % 8 = 0 THEN ' ' WHEN id % 8 < 6 THEN 'https://file.example/' || (id % 50)::VARCHAR END AS "sourceUrl", (id % 5 + 1)::INT AS priority FROM releases),
found AS (SELECT f.*, CASE WHEN NOT bad THEN coalesce(n.id, t.id) END AS duplicate FROM file f
  LEFT JOIN (SELECT "artistId", "catalogNo", min(id) AS id FROM stored WHERE "catalogNo" <> '' GROUP BY ALL) n ON n."artistId" = f."artistId" AND n."catalogNo" = f."catalogNo"
  LEFT JOIN (SELECT "artistId", title, "releaseDate", format, min(id) AS id FROM stored GROUP BY ALL) t ON f."catalogNo" IS NULL AND t."artistId" = f."artistId" AND t.title = f.title AND t."releaseDate" IS NOT DISTINCT FROM f."releaseDate" AND t.format = f.format),
acted AS (SELECT *, CASE WHEN bad THEN 'error' WHEN duplicate IS NOT NULL THEN 'updated' ELSE 'created' END AS action FROM found)
"""


def stored_releases(spark, d):
    k = F.col("id")
    return T.releases(spark, d).withColumn("catalogNo", F.when(k % 4 == 0, F.concat(F.lit("OLD-"), k.cast("string"))).otherwise(F.col("catalogNo"))).withColumn("title", F.when(k % 5 == 0, F.concat(F.lit("Old "), F.col("title"))).otherwise(F.col("title")))


def import_rows(spark, d):
    k = F.col("id")
    none = F.expr("cast(array() as array<string>)")
    number = F.when(k % 6 == 1, F.concat(F.lit("NEW-"), k.cast("string"))).when(k % 2 == 0, F.col("catalogNo"))
    url = F.when(k % 8 == 0, " ").when(k % 8 < 6, F.concat(F.lit("https://file.example/"), (k % 50).cast("string")))
    rows = T.releases(spark, d).select(
        k.alias("rowId"), F.col("artistId").alias("target"), number.alias("catalogNo"), F.when(k % 25 == 0, "").otherwise(F.col("title")).alias("title"), F.when(k % 9 != 0, F.col("releaseDate")).alias("releaseDate"), "format", "category", F.lit(None).cast("string").alias("label"),
        "isReissue", F.lit(None).cast("string").alias("notes"), F.lit(None).cast("string").alias("coverUrl"), url.alias("sourceUrl"), (k % 5 + 1).cast("int").alias("priority"), F.lit("owned").alias("status"), F.concat(F.lit("sheet "), (k % 3).cast("string")).alias("sheetName"), k.cast("int").alias("rowNumber"),
        F.when(k % 25 == 0, F.array(F.lit(importing.NO_TITLE))).otherwise(none).alias("errors"), (k % 6 != 0).alias("included"),
    )
    return importing.with_duplicates(rows, stored_releases(spark, d), F.col("target")).withColumn("action", importing.action("update"))


@register("dup_lookup", 'SELECT "rowId", duplicate AS "duplicateId" FROM found', IMPORT_SQL)
def dup_lookup(spark, d):
    return import_rows(spark, d).select("rowId", "duplicateId")


@register("import_preview", 'SELECT "artistId", count(*) AS total_rows, count(*) FILTER (NOT bad AND included) AS importable_rows, count(duplicate) AS duplicate_rows, count(*) FILTER (bad) AS error_rows FROM found GROUP BY 1', IMPORT_SQL)
def import_preview(spark, d):
    return import_rows(spark, d).groupBy("artistId").agg(*importing.preview_columns())


@register("import_actions", """SELECT s AS strategy, CASE WHEN bad THEN 'error' WHEN duplicate IS NULL THEN 'created' ELSE CASE s WHEN 'update' THEN 'updated' WHEN 'create' THEN 'created' ELSE 'skipped' END END AS action, count(*) AS n
FROM found, (VALUES ('skip'), ('update'), ('create')) g(s) GROUP BY 1, 2""", IMPORT_SQL)
def import_actions(spark, d):
    rows = import_rows(spark, d)
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("strategy"), importing.action(s).alias("action")) for s in importing.STRATEGIES])).alias("x")
    return rows.select(each).groupBy("x.strategy", "x.action").agg(F.count("*").alias("n"))


@register("batch_outcome", """SELECT "artistId", count(*) FILTER (action = 'created') AS created, count(*) FILTER (action = 'updated') AS updated, 0::BIGINT AS skipped, count(*) FILTER (action = 'error') AS errors,
  CASE WHEN count(*) FILTER (action = 'error') > 0 AND count(*) FILTER (action <> 'error') = 0 THEN 'FAILED' ELSE 'IMPORTED' END AS batch_status FROM acted GROUP BY 1""", IMPORT_SQL)
def batch_outcome(spark, d):
    return import_rows(spark, d).groupBy("artistId").agg(*importing.outcome_columns())


@register("last_wins_update", """
SELECT duplicate AS id, max_by(title, "rowId") AS title, max("rowId") AS "rowId" FROM acted WHERE action = 'updated' GROUP BY 1""", IMPORT_SQL)
def last_wins_update(spark, d):
    rows = import_rows(spark, d).where("action = 'updated'")
    return importing.last_wins(rows, "duplicateId", "rowId").select(F.col("duplicateId").alias("id"), "title", "rowId")


@register("first_wins_dedup", """
SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY "artistId", "releaseDate", "catalogNo" IS NULL ORDER BY id) AS n FROM releases) WHERE "catalogNo" IS NULL OR n = 1""", T.SQL)
def first_wins_dedup(spark, d):
    return first_of_each(T.releases(spark, d), ["artistId", "releaseDate"], ["id"], F.col("catalogNo").isNotNull()).select("id")


@register("map_dedup", """
SELECT l_orderkey AS id, l_partkey % 10 AS shop, min(l_linenumber)::INT AS first, max_by(l_suppkey, l_linenumber) AS last FROM (
  SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1, 2) GROUP BY 1, 2""")
def map_dedup(spark, d):
    lines = T.load(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"), F.min("l_suppkey").alias("supp"))
    return lines.groupBy(F.col("l_orderkey").alias("id"), (F.col("part") % 10).alias("shop")).agg(F.min("l_linenumber").alias("first"), F.max_by("supp", "l_linenumber").alias("last"))


@register("stored_sources", f"""
, u AS (SELECT "releaseId", url, min(id) AS pos, max_by(coalesce(description, ''), id) AS description FROM sources WHERE description IS DISTINCT FROM '{COVER_ROLE}' GROUP BY 1, 2)
SELECT "releaseId", string_agg(url || '=' || description, ',' ORDER BY pos) AS stored FROM u GROUP BY 1""", T.SQL)
def stored_sources(spark, d):
    own = T.sources(spark, d).where(~F.col("description").eqNullSafe(F.lit(COVER_ROLE))).groupBy("releaseId").agg(F.array_sort(F.collect_list(F.struct("id", "url", F.coalesce("description", F.lit("")).alias("sourceType")))).alias("s"))
    given = F.transform("s", lambda s: F.struct(s["url"].alias("title"), s["url"].alias("url"), s["sourceType"].alias("sourceType")))
    rows = own.select("releaseId", provenance.release_sources(given, F.lit(None).cast("string")).alias("r"))
    return rows.select("releaseId", F.array_join(F.transform("r", lambda s: F.concat(s["url"], F.lit("="), s["description"])), ",").alias("stored"))


@register("majority_vote", """
WITH n AS (SELECT source, lang, count(DISTINCT text) AS n FROM documents GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS place, lead(n) OVER (PARTITION BY source ORDER BY n DESC, lang) AS second, sum(n) OVER (PARTITION BY source) AS everything FROM n)
SELECT source, lang, n FROM r WHERE place = 1 AND n >= 2 AND second IS DISTINCT FROM n AND 2 * n > everything""")
def majority_vote(spark, d):
    return resolve.majority(T.load(spark, d, "documents").select("source", "lang", F.xxhash64("text").alias("h")), ["source"], "lang", "h")


# Parts are albums, and candidates of the same names: the year comes from the key.
ALBUM_SQL = T.CANDIDATES_SQL + """, albums AS (SELECT p_partkey AS "collectionId", CASE WHEN p_size % 2 = 0 THEN 1 ELSE p_partkey % 7 + 1 END AS "artistId", trim(lower(p_name)) AS name, CASE WHEN p_partkey % 3 = 2 THEN 1950 ELSE 1980 END + p_partkey % 30 AS year FROM part),
keys AS (SELECT DISTINCT "taskId", id, regexp_replace(lower(t), '[^a-z0-9]', '', 'g') AS key, year FROM (SELECT "taskId", id, title AS t, year FROM base WHERE dated UNION ALL SELECT "taskId", id, "titleOriginal", year FROM base WHERE dated AND "titleOriginal" IS NOT NULL)),
hits AS (SELECT DISTINCT k."taskId", k.id, a."collectionId", a."artistId" FROM keys k JOIN albums a ON regexp_replace(a.name, '[^a-z0-9]', '', 'g') = k.key AND a.year = k.year),
uniq AS (SELECT "taskId", id, min("collectionId") AS "collectionId", min("artistId") AS "artistId" FROM hits GROUP BY 1, 2 HAVING count(*) = 1)
"""


def albums(spark, d):
    k = F.col("p_partkey")
    return T.load(spark, d, "part").select(k.alias("collectionId"), F.when(F.col("p_size") % 2 == 0, 1).otherwise(k % 7 + 1).alias("artistId"), F.col("p_brand").alias("artistName"), F.col("p_name").alias("collectionName"), F.concat((F.when(k % 3 == 2, 1950).otherwise(1980) + k % 30).cast("string"), F.lit("-01-01T00:00:00Z")).alias("releaseDate"), F.lit(None).cast("string").alias("artworkUrl100"), F.lit(None).cast("string").alias("collectionViewUrl"))


@register("title_year_join", 'SELECT "taskId", id, "collectionId" FROM hits', ALBUM_SQL)
def title_year_join(spark, d):
    return resolve.title_year_matches(T.candidates(spark, d), albums(spark, d), compose=False).select("taskId", "id", "album.collectionId")


@register("unique_match", 'SELECT "taskId", id, "collectionId" FROM uniq', ALBUM_SQL)
def unique_match(spark, d):
    return resolve.sole_matches(resolve.candidate_keys(T.candidates(spark, d), compose=False), resolve.album_keys(albums(spark, d), compose=False)).select("taskId", "id", "album.collectionId")


@register("dominant_artist", """, n AS (SELECT "taskId", "artistId", count(DISTINCT "collectionId") AS n FROM uniq GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER w AS place, lead(n) OVER w AS second, sum(n) OVER (PARTITION BY "taskId") AS everything FROM n WINDOW w AS (PARTITION BY "taskId" ORDER BY n DESC, "artistId"))
SELECT "taskId", "artistId", n FROM r WHERE place = 1 AND n >= 2 AND second IS DISTINCT FROM n AND 2 * n > everything""", ALBUM_SQL)
def dominant_artist(spark, d):
    return resolve.dominant_artist(T.candidates(spark, d), albums(spark, d), compose=False)


@register("title_key", "SELECT p_partkey, regexp_replace(lower(p_name || ' - ' || p_type), '[^a-z0-9+]', '', 'g') AS key FROM part")
def title_key(spark, d):
    return T.load(spark, d, "part").select("p_partkey", X.title_key(F.concat("p_name", F.lit(" - "), "p_type"), compose=False).alias("key"))


@register("country_alias", """SELECT n_nationkey, CASE n_name WHEN 'CHINA' THEN 'CN' WHEN 'JAPAN' THEN 'JP' WHEN 'UNITED STATES' THEN 'US' WHEN 'UNITED KINGDOM' THEN 'GB'
  ELSE CASE WHEN regexp_matches(n_name, '^[A-Za-z]{2}$') THEN upper(n_name) ELSE 'US' END END AS code FROM nation""")
def country_alias(spark, d):
    return T.load(spark, d, "nation").select("n_nationkey", X.country_code(F.col("n_name"), compose=False).alias("code"))


@register("host_allowlist", r"""SELECT page_id, coalesce(regexp_matches(lower(url), '^https?://([^/?#]*\.)?(example\.com|example\.org)([:/?#]|$)'), false) AS allowed,
  CASE WHEN regexp_matches(lower(url), '^https?://([^/?#]*\.)?(example\.com|example\.org)([:/?#]|$)') THEN regexp_replace(url, '^https?:', 'https:') END AS secure FROM pages""")
def host_allowlist(spark, d):
    hosts = ("example.com", "example.org")
    return T.load(spark, d, "pages").select("page_id", U.on_hosts(F.col("url"), hosts).alias("allowed"), U.secure(F.col("url"), hosts).alias("secure"))


@register("artwork_resize", """SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 AND p_size % 4 <> 0 AND p_size <> 6 THEN 'https://is1.mzstatic.com/image/' || p_partkey::VARCHAR || '/600x600bb.jpg' END AS url FROM part""")
def artwork_resize(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    side = F.when(s == 6, F.lit("600")).otherwise((s * 10).cast("string"))
    size = F.when(s % 4 == 0, F.lit("cover")).otherwise(F.concat(side, F.lit("x"), side, F.lit("bb")))
    url = F.concat(F.when(k % 5 == 0, "http://other.example/").otherwise("http://is1.mzstatic.com/"), F.lit("image/"), k.cast("string"), F.lit("/"), size, F.lit(".jpg"))
    return T.load(spark, d, "part").select("p_partkey", U.artwork_600(url).alias("url"))


@register("explicit_urls", r"""SELECT page_id, len(u)::INT AS n, md5(array_to_string(list_transform(u, lambda x: regexp_replace(trim(x), '[.。]+$', '')), ' ')) AS digest
FROM (SELECT page_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS u FROM (SELECT page_id, regexp_extract_all(html, '(?i)https?://[^\s"''<>),\]]+') AS l FROM pages))""")
def explicit_urls(spark, d):
    found = U.explicit_urls(F.col("html"))
    return T.load(spark, d, "pages").select("page_id", F.size(found).alias("n"), F.md5(F.array_join(found, " ")).alias("digest"))


@register("json_props", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_props(spark, d):
    return T.load(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@register("status_canonical", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'WANTED' WHEN 'O' THEN 'NOT_OWNED' END AS status FROM orders""")
def status_canonical(spark, d):
    raw = F.when(F.col("o_orderstatus") == "F", " ordered").when(F.col("o_orderstatus") == "O", "Unknown ").otherwise("none such")
    return T.load(spark, d, "orders").select("o_orderkey", V.canonical_status(raw).alias("status"))


@register("format_case", """SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'SHM_CD' WHEN 1 THEN 'BLU_SPEC_CD' WHEN 2 THEN 'HYBRID_SACD' WHEN 3 THEN 'CD_DVD' WHEN 4 THEN 'BOX_SET' WHEN 5 THEN 'CD' WHEN 6 THEN 'CD' ELSE 'OTHER' END AS sheet,
  CASE p_partkey % 8 WHEN 0 THEN 'SHM_CD' WHEN 1 THEN 'BLU_SPEC_CD' WHEN 2 THEN 'HYBRID_SACD' WHEN 3 THEN 'CD_DVD' WHEN 4 THEN 'BOX_SET' WHEN 5 THEN 'CD' ELSE 'OTHER' END AS candidate FROM part""")
def format_case(spark, d):
    raw = F.element_at(F.array(*map(F.lit, ["shm-cd", "Blu-spec CD", "sacd", "cd+dvd", "3cd box", "8cm cd", "", "vinyl"])), (F.col("p_partkey") % 8 + 1).cast("int"))
    return T.load(spark, d, "part").select("p_partkey", V.sheet_format(raw).alias("sheet"), V.candidate_format(raw).alias("candidate"))


@register("priority_clamp", """SELECT o_orderkey, least(5, greatest(1, left(o_orderpriority, 1)::INT * 2 - 3)) AS written, CASE WHEN o_orderkey % 3 = 0 THEN 3 ELSE least(5, greatest(1, (o_orderkey % 9)::INT)) END AS clamped FROM orders""")
def priority_clamp(spark, d):
    k = F.col("o_orderkey")
    text = F.concat((F.left("o_orderpriority", F.lit(1)).cast("int") * 2 - 3).cast("string"), F.lit(" stars"))
    return T.load(spark, d, "orders").select("o_orderkey", V.priority(text).alias("written"), V.clamped_priority(F.when(k % 3 != 0, k % 9)).alias("clamped"))


@register("date_rollover", """SELECT o_orderkey, (make_date(year(o_orderdate)::INT, 1, 1) + to_months((o_orderkey % 20)::INT - 1) + to_days((o_orderkey % 40)::INT - 1))::DATE AS rolled FROM orders""")
def date_rollover(spark, d):
    k = F.col("o_orderkey")
    text = F.concat(F.year("o_orderdate").cast("string"), F.lit("年"), (k % 20).cast("string"), F.lit("月"), (k % 40).cast("string"), F.lit("日"))
    return T.load(spark, d, "orders").select("o_orderkey", V.written_date(text).alias("rolled"))


@register("strict_dates", """SELECT o_orderkey, try_cast(t AS DATE) AS strict, CASE WHEN o_orderkey % 3 = 0 THEN make_date(year(o_orderdate)::INT, 1, 1) ELSE try_cast(t AS DATE) END AS leading
  FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN year(o_orderdate)::VARCHAR ELSE year(o_orderdate)::VARCHAR || '-02-' || (o_orderkey % 21 + 10)::VARCHAR END AS t FROM orders)""")
def strict_dates(spark, d):
    k = F.col("o_orderkey")
    text = F.when(k % 3 == 0, F.year("o_orderdate").cast("string")).otherwise(F.concat(F.year("o_orderdate").cast("string"), F.lit("-02-"), (k % 21 + 10).cast("string")))
    return T.load(spark, d, "orders").select("o_orderkey", V.strict_date(text).alias("strict"), V.leading_date(text).alias("leading"))


@register("serial_dates", "SELECT p_partkey, DATE '1899-12-30' + (30000 + p_partkey % 9000)::INT AS day FROM part")
def serial_dates(spark, d):
    return T.load(spark, d, "part").select("p_partkey", V.serial_date(F.lit(30000.75) + F.col("p_partkey") % 9000).alias("day"))


def gated(spark, d):
    return quality.gate(T.candidates(spark, d), F.lit("ORIGINAL_CD"), F.lit(True))


@register("confidence_gate", """SELECT "taskId", id, ['LOW', 'MEDIUM', 'HIGH'][level] AS confidence, excluded, pending, n_warnings FROM gated""", T.CANDIDATES_SQL)
def confidence_gate(spark, d):
    return gated(spark, d).select("taskId", "id", "confidence", F.col("isExcludedByDefault").alias("excluded"), F.col("quality.pendingReview").alias("pending"), F.size("warnings").alias("n_warnings"))


@register("quality_summary", """SELECT "taskId", count(*) AS total, count(*) FILTER (level = 3 AND NOT excluded AND NOT no_source AND NOT no_catalog) AS safe_to_import,
  count(*) FILTER (warns AND NOT (unknown AND NOT dated AND non_cd AND NOT no_catalog AND NOT wiki AND (NOT no_source OR said_source))) AS pending_review, count(*) FILTER (no_catalog) AS missing_catalog, count(*) FILTER (no_source) AS missing_sources, count(*) FILTER (excluded) AS default_excluded
FROM gated GROUP BY 1""", T.CANDIDATES_SQL)
def quality_summary(spark, d):
    return gated(spark, d).groupBy("taskId").agg(*quality.summary_columns())


@register("confidence_histogram", """SELECT "taskId", count(*) FILTER (level = 3) AS high, count(*) FILTER (level = 2) AS medium, count(*) FILTER (level = 1) AS low FROM gated GROUP BY 1""", T.CANDIDATES_SQL)
def confidence_histogram(spark, d):
    return quality.histogram(gated(spark, d), "taskId")


@register("research_audit", """SELECT "taskId", count(*) FILTER (no_catalog) AS missing_catalog, count(*) FILTER (no_source AND NOT said_source) AS missing_source, count(*) FILTER (wiki) AS wiki_only, count(*) FILTER (non_cd) AS non_cd, count(*) FILTER (reissue) AS reissue FROM gated GROUP BY 1""", T.CANDIDATES_SQL)
def research_audit(spark, d):
    return gated(spark, d).groupBy("taskId").agg(*quality.audit_columns())


SETS_SQL = """WITH s AS (SELECT l_orderkey AS id, list(DISTINCT l_partkey % 8) FILTER (l_linestatus = 'O') AS a0, list(DISTINCT l_partkey % 8) FILTER (l_linestatus = 'F') AS b0 FROM lineitem GROUP BY 1), t AS (SELECT id, coalesce(a0, []) AS a, coalesce(b0, []) AS b FROM s)"""


@register("candidate_sets", """SELECT id, len(list_intersect(a, b))::INT AS both, len(list_distinct(list_concat(a, b)))::INT AS either, len(list_filter(a, lambda x: NOT list_contains(b, x)))::INT AS only,
  len(CASE WHEN list_contains(a, 3) THEN list_filter(a, lambda x: x <> 3) ELSE list_append(a, 3) END)::INT AS toggled, len(list_filter(b, lambda x: NOT list_contains(a, x))) = 0 AS inside FROM t""", SETS_SQL)
def candidate_sets(spark, d):
    item = F.col("l_partkey") % 8
    rows = T.load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set(F.when(F.col("l_linestatus") == "O", item)).alias("a"), F.collect_set(F.when(F.col("l_linestatus") == "F", item)).alias("b"))
    a, b = F.col("a"), F.col("b")
    return rows.select("id", F.size(selection.intersected(a, b)).alias("both"), F.size(selection.added(a, b)).alias("either"), F.size(selection.removed(a, b)).alias("only"), F.size(selection.toggled(a, F.lit(3).cast("long"))).alias("toggled"), selection.within(b, a).alias("inside"))


@register("rate_limit", """SELECT event_id, n AS recent FROM (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS n FROM (SELECT *, date_trunc('second', ts) AS s FROM events)) WHERE n >= 3""".replace("epoch(ts)::BIGINT", "epoch(s)::BIGINT"))
def rate_limit(spark, d):
    return tasks.over_limit(T.load(spark, d, "events"), "user_id", "ts", span=3600, most=3).select("event_id", "recent")


@register("task_lease", """SELECT DISTINCT user_id AS "userId" FROM events WHERE event_type IN ('click', 'view') AND ts >= TIMESTAMP '2024-01-29 00:00:00'""")
def task_lease(spark, d):
    kind = F.col("event_type")
    rows = T.load(spark, d, "events").select(F.col("user_id").alias("userId"), F.when(kind == "click", "QUEUED").when(kind == "view", "RUNNING").otherwise("FAILED").alias("status"), F.col("ts").alias("updatedAt"))
    return tasks.leased(rows, F.lit("2024-01-30 00:00:00").cast("timestamp_ntz"), "1 day")


@register("latest_task", """SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1""")
def latest_task(spark, d):
    return tasks.latest(T.load(spark, d, "events"), "user_id", "ts", "event_id").select("user_id", "event_id")


@register("task_states", """SELECT user_id AS "taskId", max_by(event_type, (ts, event_id)) AS status, least(100, greatest(0, max_by(floor(value)::INT, (ts, event_id)))) AS progress FROM events GROUP BY 1""")
def task_states(spark, d):
    rows = T.load(spark, d, "events").select(F.col("user_id").alias("taskId"), F.col("event_type").alias("status"), F.floor("value").cast("int").alias("progress"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))
    return tasks.task_states(rows)


UPSERT_SQL = T.SQL + """, old AS (SELECT 'u' || (id % 2)::VARCHAR AS "userId", id AS "releaseId", coalesce(status, 'SKIP') AS status, priority FROM releases),
change AS (SELECT 'u' || (id % 3 % 2)::VARCHAR AS "userId", id AS "releaseId", CASE WHEN id % 4 = 0 THEN 'WANTED' END AS status, CASE WHEN id % 6 = 0 THEN 1 END AS priority FROM releases)
SELECT coalesce(o."userId", c."userId") AS "userId", coalesce(o."releaseId", c."releaseId") AS "releaseId", coalesce(c.status, o.status, 'NOT_OWNED') AS status, coalesce(c.priority, o.priority, 3) AS priority FROM old o FULL JOIN change c ON o."userId" = c."userId" AND o."releaseId" = c."releaseId" """


@register("status_upsert", UPSERT_SQL)
def status_upsert(spark, d):
    rel, k = T.releases(spark, d), F.col("id")
    user = lambda n: F.concat(F.lit("u"), n.cast("string")).alias("userId")
    old = rel.select(user(k % 2), k.alias("releaseId"), F.coalesce("status", F.lit("SKIP")).alias("status"), "priority")
    change = rel.select(user(k % 3 % 2), k.alias("releaseId"), F.when(k % 4 == 0, "WANTED").alias("status"), F.when(k % 6 == 0, 1).alias("priority"))
    return mutations.upsert_statuses(old, change)


@register("bulk_update", """SELECT id, CASE WHEN "artistId" = 7 AND "isReissue" THEN true ELSE "isExcludedByDefault" END AS excluded FROM releases""", T.SQL)
def bulk_update(spark, d):
    rel = T.releases(spark, d)
    none = rel.where("false").select(F.lit("u1").alias("userId"), F.col("id").alias("releaseId"), "status", "priority")
    return mutations.bulk_update(rel, none, "u1", 7, rel.where("isReissue").select("id"), excluded=True)["releases"].select("id", F.col("isExcludedByDefault").alias("excluded"))


@register("bulk_statuses", """, own AS (SELECT 'u' || (id % 2)::VARCHAR AS "userId", id AS "releaseId", status, priority FROM releases WHERE status IS NOT NULL),
hit AS (SELECT id FROM releases WHERE "artistId" = 7 AND "isReissue")
SELECT coalesce(o."userId", 'u1') AS "userId", coalesce(o."releaseId", h.id) AS "releaseId", CASE WHEN h.id IS NOT NULL THEN 'OWNED' ELSE status END AS status, CASE WHEN h.id IS NOT NULL THEN 2 ELSE priority END AS priority
FROM own o FULL JOIN hit h ON o."releaseId" = h.id AND o."userId" = 'u1' """, T.SQL)
def bulk_statuses(spark, d):
    rel, k = T.releases(spark, d), F.col("id")
    own = rel.where("status is not null").select(F.concat(F.lit("u"), (k % 2).cast("string")).alias("userId"), k.alias("releaseId"), "status", "priority")
    return mutations.bulk_update(rel, own, "u1", 7, rel.where("isReissue").select("id"), status="OWNED", priority=2)["statuses"]


@register("delete_cascade", """SELECT s.id FROM sources s WHERE s."releaseId" NOT IN (SELECT id FROM releases WHERE "isExcludedByDefault")""", T.SQL)
def delete_cascade(spark, d):
    rel = T.releases(spark, d)
    return mutations.delete_cascade(rel, {"sources": T.sources(spark, d)}, rel.where("isExcludedByDefault"))["sources"].select("id")


# A hundred names, each borne by several artists in two spellings; the key also gives the day each was made.
NAMES_SQL = """WITH artist AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'ARTIST ' ELSE 'Artist ' END || (c_custkey % 100)::VARCHAR AS name, c_custkey * 7919 % 1000 AS "createdAt" FROM customer),
asked AS (SELECT DISTINCT CASE WHEN c_custkey % 4 = 0 THEN 'Nobody ' ELSE 'artist ' END || (c_custkey % 120)::VARCHAR AS name FROM customer)
"""


def named_artists(spark, d):
    k = F.col("c_custkey")
    return T.load(spark, d, "customer").select(k.alias("id"), F.concat(F.when(k % 2 == 0, "ARTIST ").otherwise("Artist "), (k % 100).cast("string")).alias("name"), (k * 7919 % 1000).alias("createdAt"))


def asked_names(spark, d):
    k = F.col("c_custkey")
    return T.load(spark, d, "customer").select(F.concat(F.when(k % 4 == 0, " Nobody ").otherwise(" artist "), (k % 120).cast("string")).alias("name"))


@register("case_insensitive_lookup", """SELECT w.name, min_by(a.id, (a."createdAt", a.id)) AS id FROM asked w JOIN artist a ON lower(a.name) = lower(w.name) GROUP BY 1""", NAMES_SQL)
def case_insensitive_lookup(spark, d):
    return resolve.lookup_by_name(named_artists(spark, d), asked_names(spark, d), fold_case=True)


@register("exact_lookup", """SELECT w.name, min(a.id) AS id FROM (SELECT DISTINCT 'A' || substr(name, 2) AS name FROM asked) w JOIN artist a ON a.name = w.name GROUP BY 1""", NAMES_SQL)
def exact_lookup(spark, d):
    names = asked_names(spark, d).select(F.concat(F.lit("A"), F.substring("name", 3, 100)).alias("name"))
    return resolve.lookup_by_name(named_artists(spark, d), names, fold_case=False)


EXACT_SQL = NAMES_SQL + """, w AS (SELECT DISTINCT 'A' || substr(name, 2) AS name FROM asked), known AS (SELECT w.name, min(a.id::VARCHAR) AS id FROM w JOIN artist a ON a.name = w.name GROUP BY 1)
"""


def resolved(spark, d):
    names = asked_names(spark, d).select(F.concat(F.lit(" A"), F.substring("name", 3, 100)).alias("name"))
    return resolve.resolve_or_create(named_artists(spark, d).withColumn("id", F.col("id").cast("string")), names)


@register("import_artists", """SELECT w.name, coalesce(k.id, 'artist:' || w.name) AS id FROM w LEFT JOIN known k USING (name)""", EXACT_SQL)
def import_artists(spark, d):
    """Artists that an import finds by their exact names, or makes."""
    return resolved(spark, d)["found"]


@register("created_artists", """SELECT id::VARCHAR AS id, name FROM artist UNION ALL SELECT 'artist:' || name, name FROM w WHERE name NOT IN (SELECT name FROM known)""", EXACT_SQL)
def created_artists(spark, d):
    return resolved(spark, d)["artists"].select("id", "name")


@register("anti_sources", """SELECT DISTINCT "releaseId" + 1 AS "releaseId", url FROM sources EXCEPT SELECT "releaseId", url FROM sources""", T.SQL)
def anti_sources(spark, d):
    s = T.sources(spark, d)
    return mutations.new_links(s.select((F.col("releaseId") + 1).alias("releaseId"), "url"), s)


@register("catalogue_collision", """SELECT a.id, count(*) AS others FROM releases a JOIN releases b ON a."artistId" = b."artistId" AND a."catalogNo" = b."catalogNo" AND a.id <> b.id GROUP BY 1""", T.SQL)
def catalogue_collision(spark, d):
    return library.same_number(T.releases(spark, d))


@register("url_provenance", """, m AS (SELECT "releaseId", list(DISTINCT url ORDER BY url) FILTER (description = 'official') AS m0, list(DISTINCT url ORDER BY url) FILTER (description IS DISTINCT FROM 'official' OR url LIKE '%1') AS e0 FROM sources GROUP BY 1),
n AS (SELECT "releaseId", coalesce(m0, []) AS m, coalesce(e0, []) AS e FROM m)
SELECT "releaseId", array_to_string(list_concat(list_filter(m, lambda x: list_contains(e, x)), list_filter(e, lambda x: NOT list_contains(m, x))), ' ') AS urls FROM n""", T.SQL)
def url_provenance(spark, d):
    own = F.coalesce(F.col("description") == "official", F.lit(False))
    rows = T.sources(spark, d).groupBy("releaseId").agg(F.array_sort(F.collect_set(F.when(own, F.col("url")))).alias("m"), F.array_sort(F.collect_set(F.when(~own | F.col("url").endswith("1"), F.col("url")))).alias("e"))
    return rows.select("releaseId", F.array_join(provenance.allowed_urls(F.col("m"), F.col("e")), " ").alias("urls"))


@register("import_status", """SELECT id, CASE WHEN excluded THEN 'EXCLUDED' WHEN review THEN 'PENDING_REVIEW' ELSE 'NOT_OWNED' END AS status, CASE confidence WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3 ELSE 5 END AS priority,
  CASE WHEN "isExcludedByDefault" THEN 'EXCLUDED_BY_DEFAULT' WHEN status = 'EXCLUDED' THEN 'EXCLUDED' END AS reason FROM library""", T.SQL)
def import_status(spark, d):
    from .plans.filters import mentions_review

    c = F.col
    return T.releases(spark, d).select("id", V.release_status(library.is_excluded(), mentions_review(c("warnings"), c("notes"))).alias("status"), V.confidence_priority(c("confidence")).alias("priority"), V.exclusion_reason(c("isExcludedByDefault"), c("status")).alias("reason"))


@register("sheet_categories", """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'ORIGINAL_ALBUM' WHEN 1 THEN 'SINGLE' WHEN 2 THEN 'BEST' WHEN 3 THEN 'LIVE' WHEN 4 THEN 'REMIX' ELSE 'OTHER' END AS category FROM part""")
def sheet_categories(spark, d):
    i = (F.col("p_partkey") % 6 + 1).cast("int")
    sheet = F.element_at(F.array(*map(F.lit, ["A_原创专辑原版CD", "B_单曲原版CD", "C", "C", "C", "C"])), i)
    kind = F.element_at(F.array(*map(F.lit, ["", "Live", "ベスト Live", "LIVE album", "混音", "Studio"])), i)
    return T.load(spark, d, "part").select("p_partkey", V.sheet_category(sheet, kind).alias("category"))


@register("validated_rows", """SELECT id, (CASE WHEN id % 10 = 3 THEN 1 ELSE 0 END + CASE WHEN id % 6 = 1 THEN 1 ELSE 0 END)::INT AS faults FROM releases WHERE id % 10 = 3 OR id % 6 = 1""", T.SQL)
def validated_rows(spark, d):
    k = F.col("id")
    rows = T.releases(spark, d).withColumn("releaseDate", F.when(k % 6 == 1, "2025-02-30").otherwise(F.col("releaseDate").cast("string"))).withColumn("category", F.when(k % 10 == 3, "TAPE").otherwise(F.col("category")))
    return mutations.validated(rows, mutations.patch_rules())[1].select("id", F.size("faults").alias("faults"))
