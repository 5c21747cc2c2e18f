"""Queries of model documents, candidates, their edits and import, and of artist and cover enrichment, and the same in SQL."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import catalogue_tables as T
from .catalogue_queries import register
from .change_queries import pick, pick_sql
from .functions import json_text as J
from .operators import provenance, quality, research, resolve, structuring
from .plans.filters import COVER_ROLE
from .sources.folders import written


def text(c):
    return c.cast("string")


# ---- documents: parts as what a model answered, good and bad in turn

OBJECT_ERRORS = {"none": "No JSON object found in model output.", "open": "Unclosed JSON object in model output.", "json": "Invalid JSON.", "schema": "Document does not match the schema."}
MODEL_CATEGORIES, TAKEN_CATEGORIES = ["LIVE", "COMPILATION", "nonsense", "EP"], ["LIVE", "OTHER", "OTHER", "EP"]
CONFIDENCES, TAKEN_CONFIDENCES = ["HIGH", "sure", "MEDIUM"], ["HIGH", "LOW", "MEDIUM"]


def documents(spark, d) -> DataFrame:
    """(taskId, text): seven kinds of answers; a good one has two releases, with fields of wrong kinds in turn."""
    k = F.col("p_partkey")
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    fields = {
        "title": q(F.col("p_name")), "artistCredit": q(F.col("p_brand")), "category": q(pick(MODEL_CATEGORIES, k)), "format": F.when(k % 3 == 0, F.lit("5")).otherwise('"CD"'), "isReissue": F.when(k % 2 == 0, F.lit("true")).otherwise('"yes"'),
        "confidence": q(pick(CONFIDENCES, k)), "warnings": F.when(k % 4 == 0, F.lit('["a", 1]')).otherwise('["a", "b"]'), "coverImageUrl": F.when(k % 5 == 0, F.lit('"javascript:x"')).otherwise('"https://c.example/x.jpg"'),
        "sources": F.concat(F.lit('[{"url": "https://a.example/'), text(k), F.when(k % 5 == 1, F.lit('"}, {"title": "t", "url": "bad"}]')).otherwise('", "sourceType": "x"}, {"title": "t{", "url": "http://b.example", "sourceType": "news"}]')),
    }
    one = F.concat(F.lit("{"), *[x for i, (n, v) in enumerate(fields.items()) for x in (F.lit(f'{", " if i else ""}"{n}": '), v)], F.lit("}"))
    head = F.concat(F.lit('{"artist": {"name": "A \\" } {", "country": '), F.when(k % 7 == 3, F.lit("7")).otherwise('"JP"'), F.lit('}, "collectionScope": {"target": '), F.when(k % 7 == 4, F.lit('"TAPES"')).otherwise('"ALL_CD"'), F.lit(', "excludeReissues": false, "includeCollaborations": true}, "releases": ['))
    second = F.concat(F.lit(', {"artistCredit": "B", "title": '), F.when(k % 7 == 5, F.lit("[1]")).otherwise('"Second"'), F.lit("}]}"))
    good = F.concat(F.lit("Here {so}: ```json\n"), head, one, second, F.lit("\n``` and {more}"))
    answer = F.when(k % 7 == 0, "nothing here").when(k % 7 == 1, '{"a": "}" ').when(k % 7 == 2, "{not: json}").otherwise(good)
    return T.dealt(T.load(spark, d, "part").select("p_partkey", "p_name", "p_brand")).select(F.concat(F.lit("task-"), text(k)).alias("taskId"), answer.alias("text"), k.alias("k"))


@register("parsed_documents", f"""SELECT 'task-' || p_partkey::VARCHAR AS "taskId", 'candidate-1' AS id, p_name AS title, {pick_sql(TAKEN_CATEGORIES, "p_partkey")} AS category, CASE WHEN p_partkey % 3 <> 0 THEN 'CD' END AS format, CASE WHEN p_partkey % 2 = 0 THEN true END AS reissue,
  {pick_sql(TAKEN_CONFIDENCES, "p_partkey")} AS confidence, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'a|b' END AS warnings, CASE WHEN p_partkey % 5 <> 0 THEN 'https://c.example/x.jpg' END AS cover,
  CASE WHEN p_partkey % 5 = 1 THEN '' ELSE 'Untitled source=https://a.example/' || p_partkey::VARCHAR || '=other|t' || chr(123) || '=http://b.example=news' END AS sources FROM part WHERE p_partkey % 7 = 6
UNION ALL SELECT 'task-' || p_partkey::VARCHAR, 'candidate-2', 'Second', 'OTHER', NULL, NULL, 'LOW', '', NULL, '' FROM part WHERE p_partkey % 7 = 6""")
def parsed_documents(spark, d):
    good, _ = research.parse_documents(documents(spark, d), gated=False)
    sources = F.array_join(F.transform("sources", lambda s: F.concat_ws("=", s["title"], s["url"], s["sourceType"])), "|")
    return good.select("taskId", "id", "title", "category", "format", F.col("isReissue").alias("reissue"), "confidence", F.array_join("warnings", "|").alias("warnings"), F.col("coverImageUrl").alias("cover"), sources.alias("sources"))


@register("document_errors", f"""SELECT 'task-' || p_partkey::VARCHAR AS "taskId", CASE p_partkey % 7 WHEN 0 THEN '{OBJECT_ERRORS["none"]}' WHEN 1 THEN '{OBJECT_ERRORS["open"]}' WHEN 2 THEN '{OBJECT_ERRORS["json"]}' ELSE '{OBJECT_ERRORS["schema"]}' END AS error FROM part WHERE p_partkey % 7 <> 6""")
def document_errors(spark, d):
    return research.parse_documents(documents(spark, d), gated=False)[1]


@register("json_objects", """SELECT p_partkey AS k, CASE p_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE 1 END::BOOLEAN AS found, CASE WHEN p_partkey % 7 > 2 THEN 'A " } {' END AS name FROM part""")
def json_objects(spark, d):
    """The first balanced object of a text, and a name in it that holds quotes and braces."""
    found = J.first_object(F.col("text"))
    return documents(spark, d).withColumn("json", found).select("k", F.when(F.col("json").isNotNull(), True).alias("found"), F.when(F.col("json").startswith('{"artist'), F.get_json_object("json", "$.artist.name")).alias("name"))


# ---- pasted sources

SOURCE_TEXTS = ["A live set, https://s.example/1. and (https://s.example/2)", "remix list", "Studio Album at https://t.example/x, ok", "plain"]
STRUCTURED_SQL = f"""WITH req AS (SELECT p_partkey AS k, {pick_sql(SOURCE_TEXTS, "p_partkey")} AS pasted FROM part),
one AS (SELECT k, CASE WHEN k // 4 % 3 = 0 THEN 'BEST' WHEN k % 4 = 0 THEN 'LIVE' WHEN k % 4 = 1 THEN 'REMIX' WHEN k % 4 = 2 THEN 'ORIGINAL_ALBUM' WHEN k // 4 % 3 = 1 THEN 'EP' ELSE 'OTHER' END AS category,
  CASE WHEN k % 3 = 0 THEN true WHEN k % 5 = 0 THEN false WHEN k % 2 = 0 THEN true END AS reissue, CASE WHEN k % 6 = 0 THEN 'Own' ELSE 'Asked' END AS credit,
  CASE WHEN k % 3 = 1 THEN 'https://c.example/x.jpg' END AS cover,
  CASE WHEN k % 3 = 1 THEN 'https://c.example/x.jpg' END AS page,
  CASE k % 4 WHEN 0 THEN CASE WHEN k % 8 = 0 THEN 'https://s.example/2|https://s.example/1' ELSE 'https://s.example/1|https://s.example/2' END WHEN 2 THEN 'https://t.example/x' ELSE '' END
    || CASE WHEN k % 10 = 0 THEN CASE WHEN k % 4 IN (1, 3) THEN '' ELSE '|' END || 'https://given.example' ELSE '' END AS urls FROM req)
"""


def structured(spark, d):
    """Model answers with requests: what the answer lacks comes from the request, and only URLs of the pasted text stay."""
    k = F.col("p_partkey")
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    flag = F.when(k % 3 == 0, F.lit("true")).when(k % 5 == 0, F.lit("false")).otherwise('"?"')
    urls = F.when(k % 8 == 0, F.lit('[{"url": "https://s.example/2"}, {"url": "https://made.up/"}]')).otherwise('[{"url": "https://made.up/"}]')
    parts = [F.lit('{"releases": [{"title": "Alpha", "category": '), q(pick(["best", "EP", ""], F.floor(k / 4))), F.lit(', "isReissue": '), flag, F.lit(', "notes": '), F.when(k % 2 == 0, F.lit('"a Reissue"')).otherwise("null"), F.when(k % 6 == 0, F.lit(', "artistCredit": "Own"')).otherwise(""), F.lit(', "coverImageUrl": "https://c.example/x.jpg", "sources": '), urls, F.lit("}]}")]
    request = T.dealt(T.load(spark, d, "part").select("p_partkey")).select(
        F.concat(F.lit("task-"), text(k)).alias("taskId"), F.concat(*parts).alias("text"), pick(SOURCE_TEXTS, k).alias("sourceText"), F.lit("Asked").alias("artistName"), F.lit("JP").alias("country"), F.lit("ALL_CD").alias("target"), F.lit(False).alias("excludeReissues"),
        F.when(k % 10 == 0, "https://given.example").alias("sourceUrl"), F.when(k % 3 == 1, "https://c.example/x.jpg").alias("defaultCoverSourceUrl"),
    )
    return structuring.structure(request)[0]


@register("structured_documents", """SELECT 'task-' || k::VARCHAR AS "taskId", 'candidate-1' AS id, category, reissue, credit, cover, page, urls, urls = '' AS warned FROM one""", STRUCTURED_SQL)
def structured_documents(spark, d):
    urls = F.array_join(F.transform("sources", lambda s: s["url"]), "|")
    warned = F.exists("warnings", lambda w: w == provenance.NO_URL)
    return structured(spark, d).select("taskId", "id", "category", F.col("isReissue").alias("reissue"), F.col("artistCredit").alias("credit"), F.col("coverImageUrl").alias("cover"), F.col("coverImageSourceUrl").alias("page"), urls.alias("urls"), warned.alias("warned"))


ROW_TITLES = ["Collection of x", "The BEST", "box", "Boxer", "single cut", "8cmCD thing", "original album", "plain", "ライブ"]


@register("pasted_rows", f"""SELECT k, CASE WHEN i IN (0, 1) OR pasted THEN CASE WHEN now = 'BEST' THEN 'BEST' ELSE 'COLLECTION' END WHEN i = 8 THEN 'LIVE' WHEN i = 2 THEN 'BOX' WHEN i IN (4, 5) THEN 'SINGLE' WHEN i = 6 THEN 'ORIGINAL_ALBUM' WHEN now <> '' THEN now ELSE 'OTHER' END AS category,
  CASE WHEN k % 4 = 0 THEN false WHEN k % 4 = 1 THEN true WHEN k % 3 = 0 THEN true END AS reissue, coalesce(t, '') || '  ' || coalesce(c, '') || ' CD  ' || CASE WHEN k % 3 = 0 THEN 'remastered' ELSE '' END || ' ' AS row
FROM (SELECT p_partkey AS k, p_partkey % 9 AS i, {pick_sql(ROW_TITLES, "p_partkey")} AS t, {pick_sql(["best", None, "ep", ""], "p_partkey")} AS c, coalesce(upper({pick_sql(["best", None, "ep", ""], "p_partkey")}), '') AS now, p_partkey % 11 = 0 OR p_partkey % 4 = 0 AS pasted FROM part)""")
def pasted_rows(spark, d):
    """A row's words decide its category, in a fixed order, together with the pasted document."""
    k = F.col("p_partkey")
    rows = T.load(spark, d, "part").select(k.alias("k"), pick(ROW_TITLES, k).alias("title"), F.lit(None).cast("string").alias("titleOriginal"), pick(["best", None, "ep", ""], k).alias("category"), F.lit("CD").alias("format"), F.lit(None).cast("string").alias("editionType"), F.when(k % 3 == 0, "remastered").alias("notes"), F.lit(None).cast("string").alias("label"))
    k = F.col("k")
    flag = F.when(k % 4 == 0, False).when(k % 4 == 1, True)
    return rows.select("k", provenance.pasted_category(F.col("category"), F.when(k % 11 == 0, "the ベスト of")).alias("category"), provenance.pasted_reissue(flag).alias("reissue"), provenance.row_text().alias("row"))


# ---- other texts of a model's response


@register("response_texts", """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'own ' || lang WHEN 1 THEN lang || chr(10) || 'x' ELSE '' END AS text FROM documents""")
def response_texts(spark, d):
    k, none = F.col("doc_id"), F.lit(None).cast("string")
    part = lambda t: F.struct(F.lit("output_text").alias("type"), t.alias("text"))
    item = lambda *parts: F.struct(F.array(*parts).alias("content"))
    output = F.when(k % 3 == 2, F.array(item(part(none)))).otherwise(F.array(item(part(F.col("lang")), part(none)), item(part(F.lit("x")))))
    own = F.when(k % 3 == 0, F.concat(F.lit("own "), F.col("lang"))).when(k % 3 == 1, "")
    return T.load(spark, d, "documents").select("doc_id", J.response_text(own, output).alias("text"))


WARNING_TEXTS = ['["a", "b"]', "[]", '{"a": 1}', "no json", None, '["x", 2, true]']


@register("warning_texts", f"""SELECT p_partkey, {pick_sql(["a|b", "", "", "", "", "x|2|true"], "p_partkey")} AS warnings FROM part""")
def warning_texts(spark, d):
    return T.load(spark, d, "part").select("p_partkey", F.array_join(J.warnings_of(pick(WARNING_TEXTS, F.col("p_partkey"))), "|").alias("warnings"))


@register("json_round_trip", """SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS day, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS status, o_orderkey % 3 <> 0 AS there, o_orderkey::VARCHAR AS number FROM orders""")
def json_round_trip(spark, d):
    """What is stored of a record: dates as texts, absent fields left out."""
    k = F.col("o_orderkey")
    record = F.struct(F.col("o_orderdate").cast("date").alias("day"), F.when(k % 3 != 0, F.col("o_orderstatus")).alias("status"), k.alias("number"))
    rows = T.load(spark, d, "orders").select("o_orderkey", J.json_safe(record).alias("json"))
    field = lambda n: F.get_json_object("json", f"$.value.{n}").alias(n)
    return rows.select("o_orderkey", field("day"), field("status"), F.col("json").contains('"status"').alias("there"), field("number"))


# ---- candidates: gated, edited, chosen, imported


def candidates(spark, d) -> DataFrame:
    """T.candidates with the fields that edits and imports need, and titles that repeat."""
    k, none = F.col("position"), F.lit(None).cast("string")
    cover = F.when(k % 3 == 0, F.concat(F.lit("https://c.example/"), text(k)))
    more = {"title": F.concat(F.lit("Title "), text(k % 20)), "coverImageUrl": cover, "coverImageSourceUrl": F.when(k % 3 == 0, "https://page.example"), "notes": none, "editionType": F.when(k % 4 == 0, "First press"), "originalPrice": none, "barcode": none, "target": F.lit("ORIGINAL_CD"), "excludeReissues": F.lit(True)}
    return T.candidates(spark, d).withColumns(more)


def gated(spark, d) -> DataFrame:
    return quality.gate(candidates(spark, d), F.col("target"), F.col("excludeReissues"))


# all levels but the highest, and whatever lacks a number, a source or a warning-free record
LEVEL = "['LOW', 'MEDIUM', 'HIGH'][level]"
REVIEW_SQL = "level < 3 OR no_catalog OR no_source OR flagged"


@register("candidate_review", f'SELECT "taskId", id, {REVIEW_SQL} AS review, {LEVEL} AS confidence FROM gated', T.CANDIDATES_SQL)
def candidate_review(spark, d):
    return gated(spark, d).select("taskId", "id", quality.needs_review().alias("review"), "confidence")


@register("visible_candidates", """SELECT "taskId", id FROM gated WHERE level = 2""", T.CANDIDATES_SQL)
def visible_candidates(spark, d):
    return gated(spark, d).where(research.visible("OTHER", "MEDIUM")).select("taskId", "id")


@register("default_selection", f"""SELECT "taskId", id, level = 3 AND NOT excluded AND NOT no_source AND NOT no_catalog AS selected, excluded, {REVIEW_SQL} AS pending FROM gated""", T.CANDIDATES_SQL)
def default_selection(spark, d):
    return research.default_selection(gated(spark, d))


CHOSEN_SQL = T.CANDIDATES_SQL + """, chosen AS (SELECT "taskId", id FROM gated WHERE level >= 2 UNION ALL SELECT 'task-' || p_size::VARCHAR, CASE WHEN p_size < 10 THEN 'unknown-' ELSE 'candidate-' END || p_partkey::VARCHAR FROM part)
"""


def chosen(spark, d) -> DataFrame:
    """Ids that a user chose: candidates of some confidence, and each part's, which in a few tasks no candidate has."""
    name = F.concat(F.when(F.col("p_size") < 10, "unknown-").otherwise("candidate-"), text(F.col("p_partkey")))
    named = T.load(spark, d, "part").select(F.concat(F.lit("task-"), text(F.col("p_size"))).alias("taskId"), name.alias("id"))
    return gated(spark, d).where("confidence <> 'LOW'").select("taskId", "id").unionByName(named)


@register("unknown_candidates", """SELECT "taskId", count(*)::VARCHAR || ' selected candidates are not in the task.' AS error FROM chosen WHERE id LIKE 'unknown%' GROUP BY 1""", CHOSEN_SQL)
def unknown_candidates(spark, d):
    return research.check_known(candidates(spark, d), chosen(spark, d))


@register("selection_counts", """SELECT "taskId", count(*) AS candidates, count(*) FILTER (level >= 2 OR substr("taskId", 6)::INT >= 10) AS selected, count(*) FILTER (k % 3 = 0) AS with_cover FROM gated GROUP BY 1""", CHOSEN_SQL)
def selection_counts(spark, d):
    return research.selection_counts(candidates(spark, d), chosen(spark, d))


EDITED_SQL = T.CANDIDATES_SQL + """, again AS (SELECT "taskId", id, k, true AS dated, 'CD' AS format, false AS no_catalog, true AS labelled, false AS reissue, false AS remaster, excluded AS excluded0, level AS conf0, risky, said_source, no_source, wiki FROM gated WHERE k % 4 = 1),
""" + T.gate_sql("again", "regated")


@register("edited_candidates", """SELECT "taskId", id, 'New ' || (k % 20)::VARCHAR AS title, ['LOW', 'MEDIUM', 'HIGH'][level] AS confidence, excluded, flagged AS pending, CASE WHEN k % 3 = 0 AND k % 8 = 1 THEN 'https://page.example' END AS page, 'E-' || k::VARCHAR AS number FROM regated
UNION ALL SELECT "taskId", id, 'Title ' || (k % 20)::VARCHAR, ['LOW', 'MEDIUM', 'HIGH'][level], excluded, flagged, CASE WHEN k % 3 = 0 THEN 'https://page.example' END, CASE WHEN NOT no_catalog THEN 'N-' || (k % 50)::VARCHAR END FROM gated WHERE k % 4 <> 1""", EDITED_SQL)
def edited_candidates(spark, d):
    """Every fourth candidate is edited and passes the gate again; its cover's page stays only where the cover does."""
    rows, k, none = gated(spark, d), F.col("position"), F.lit(None).cast("string")
    edits = rows.where(k % 4 == 1).select(
        "taskId", "id", F.concat(F.lit("New "), text(k % 20)).alias("title"), F.lit("LIVE").alias("category"), F.lit("Me").alias("artistCredit"), F.lit("1999-01-02").alias("originalReleaseDate"), F.lit("CD").alias("format"), F.concat(F.lit("E-"), text(k)).alias("catalogNumber"), F.lit("L").alias("label"),
        F.when(k % 8 == 1, F.col("coverImageUrl")).otherwise("https://new.example/c.jpg").alias("coverImageUrl"), F.lit(None).cast("boolean").alias("isReissue"), F.lit(False).alias("isRemaster"), none.alias("notes"),
    )
    return research.edited(rows, edits).select("taskId", "id", "title", "confidence", F.col("isExcludedByDefault").alias("excluded"), quality.is_pending(F.col("warnings")).alias("pending"), F.col("coverImageSourceUrl").alias("page"), F.col("catalogNumber").alias("number"))


IMPORTED_SQL = T.CANDIDATES_SQL + f""", brand AS (SELECT p_partkey AS k, p_brand FROM part),
known AS (SELECT DISTINCT k % 20 AS t, k % 50 AS n FROM base WHERE k % 9 = 0 AND NOT no_catalog),
picked AS (SELECT g.*, {REVIEW_SQL} AS review, g.k % 20 AS t, g.k % 50 AS n FROM gated g WHERE level >= 2),
fresh AS (SELECT p.*, row_number() OVER (PARTITION BY "taskId", p.t, p.n, no_catalog ORDER BY p.k) AS place FROM picked p WHERE no_catalog OR NOT EXISTS (SELECT 1 FROM known x WHERE x.t = p.t AND x.n = p.n)),
kept AS (SELECT * FROM fresh JOIN brand USING (k) WHERE no_catalog OR place = 1)
"""


def imported(spark, d, flagged: bool = False):
    k = F.col("position")
    rows = written(gated(spark, d), "gated")  # several results read what passed the gate
    # the others' numbers belong to another artist
    known = rows.select(F.when(k % 9 == 0, "artist").otherwise("other").alias("artistId"), "title", F.col("catalogNumber").alias("catalogNo"))
    ids = lambda n: rows.where(k % 7 == n).select("taskId", "id")
    flags = {"excluded_ids": ids(2), "pending_ids": ids(3)} if flagged else {}
    return research.import_candidates(rows, rows.where("confidence <> 'LOW'").select("taskId", "id"), known, "artist", "me", **flags)


@register("candidate_releases", """SELECT "taskId" || ':' || id AS id, 'Title ' || t::VARCHAR AS title, CASE WHEN NOT no_catalog THEN 'N-' || n::VARCHAR END AS number, CASE WHEN dated THEN make_date(year::INT, 3, 4) END AS day, CASE WHEN format IS NULL OR format = '8cm CD' THEN 'CD' WHEN format = 'DVD box' THEN 'CD_DVD' ELSE 'OTHER' END AS format,
  reissue, remaster, excluded, 'Artist credit: ' || p_brand || CASE WHEN k % 4 = 0 THEN chr(10) || 'Edition: First press' ELSE '' END || CASE WHEN review THEN chr(10) || 'PENDING_REVIEW' ELSE '' END || CASE WHEN n_warnings > 0 THEN chr(10) || 'Warnings: ' ELSE '' END AS notes FROM kept""", IMPORTED_SQL)
def candidate_releases(spark, d):
    notes = F.regexp_replace("notes", r"(?s)(\nWarnings: ).*$", "$1")
    return imported(spark, d)["releases"].select("id", "title", F.col("catalogNo").alias("number"), F.col("releaseDate").alias("day"), "format", F.col("isReissue").alias("reissue"), F.col("isRemaster").alias("remaster"), F.col("isExcludedByDefault").alias("excluded"), notes.alias("notes"))


@register("candidate_statuses", """SELECT 'me' AS "userId", "taskId" || ':' || id AS "releaseId", CASE WHEN excluded THEN 'EXCLUDED' WHEN review THEN 'PENDING_REVIEW' ELSE 'NOT_OWNED' END AS status, CASE level WHEN 3 THEN 2 WHEN 2 THEN 3 ELSE 5 END AS priority, CASE WHEN review THEN 'PENDING_REVIEW' END AS notes FROM kept""", IMPORTED_SQL)
def candidate_statuses(spark, d):
    return imported(spark, d)["statuses"]


@register("flagged_statuses", """SELECT "taskId" || ':' || id AS "releaseId", CASE WHEN excluded OR k % 7 = 2 THEN 'EXCLUDED' WHEN review OR k % 7 = 3 THEN 'PENDING_REVIEW' ELSE 'NOT_OWNED' END AS status, CASE WHEN review OR k % 7 = 3 THEN 'PENDING_REVIEW' END AS notes FROM kept""", IMPORTED_SQL)
def flagged_statuses(spark, d):
    """Statuses where the user has marked some candidates as excluded and others as pending."""
    return imported(spark, d, flagged=True)["statuses"].select("releaseId", "status", "notes")


@register("flagged_counters", """SELECT count(*) AS imported, (SELECT count(*) FROM picked) - count(*) AS "skippedDuplicates", count(*) FILTER (review OR k % 7 = 3) AS "pendingReview", count(*) FILTER (excluded OR k % 7 = 2) AS excluded FROM kept""", IMPORTED_SQL)
def flagged_counters(spark, d):
    return imported(spark, d, flagged=True)["counters"]


@register("candidate_sources", f"""SELECT "taskId" || ':' || id AS "releaseId", 'https://' || site || '/' || k::VARCHAR AS url, 'other' AS description FROM kept, (VALUES ('shop.example', 0), ('ja.wikipedia.org', 1)) s(site, i) WHERE NOT no_source AND (i = 1 OR NOT wiki)
UNION ALL SELECT "taskId" || ':' || id, 'https://page.example', '{COVER_ROLE}' FROM kept WHERE k % 3 = 0""", IMPORTED_SQL)
def candidate_sources(spark, d):
    return imported(spark, d)["sources"].select("releaseId", "url", "description")


@register("candidate_counters", """SELECT count(*) AS imported, (SELECT count(*) FROM picked) - count(*) AS "skippedDuplicates", count(*) FILTER (review) AS "pendingReview", count(*) FILTER (excluded) AS excluded FROM kept""", IMPORTED_SQL)
def candidate_counters(spark, d):
    return imported(spark, d)["counters"]


@register("cover_append", f"""SELECT "releaseId", coalesce(string_agg(url, ' ' ORDER BY pos), '') || CASE WHEN "releaseId" % 3 = 0 THEN ' https://music.apple.com/x=Apple Music' WHEN "releaseId" % 3 = 1 THEN ' ' || min_by(url, pos) || '=Cover image source' ELSE '' END AS stored
FROM (SELECT "releaseId", url, min(id) AS pos FROM sources GROUP BY 1, 2) GROUP BY "releaseId" """, T.SQL)
def cover_append(spark, d):
    """The cover's own row comes last, even where its URL is a source already."""
    own = T.sources(spark, d).groupBy("releaseId").agg(F.array_sort(F.collect_list(F.struct("id", "url", "description"))).alias("s"))
    given = F.transform("s", lambda s: F.struct(s["url"].alias("title"), s["url"].alias("url"), F.lit("other").alias("sourceType")))
    k = F.col("releaseId")
    cover = F.when(k % 3 == 0, "https://music.apple.com/x").when(k % 3 == 1, F.col("s")[0]["url"]).otherwise("")
    rows = own.select("releaseId", provenance.release_sources(given, cover).alias("r"))
    told = F.transform("r", lambda s: F.when(s["description"] == COVER_ROLE, F.concat(s["url"], F.lit("="), s["label"])).otherwise(s["url"]))
    return rows.select("releaseId", F.array_join(told, " ").alias("stored"))


# ---- albums and enrichment


def results(spark, d) -> DataFrame:
    """Search results in their order, with faults in turn."""
    k = F.col("p_partkey")
    return T.load(spark, d, "part").select(
        (k % 10).alias("search"), F.floor(k / 10).alias("position"), F.when(k % 7 == 0, "track").when(k % 7 != 1, "collection").alias("wrapperType"), F.when(k % 9 == 0, "Single").otherwise("Album").alias("collectionType"), F.when(k % 11 == 0, 0).otherwise(k).alias("collectionId"), F.lit(3).cast("long").alias("artistId"),
        F.when(k % 13 == 0, " ").otherwise(F.concat(F.lit(" "), F.col("p_brand"))).alias("artistName"), F.when(k % 17 == 0, F.rpad("p_name", 501, "x")).otherwise(F.col("p_name")).alias("collectionName"), F.when(k % 3 == 0, F.rpad("p_name", 101, "x")).otherwise("1999").alias("releaseDate"), F.lit(None).cast("string").alias("artworkUrl100"), F.lit(" u ").alias("collectionViewUrl"),
    )


@register("album_list", """SELECT p_partkey % 10 AS search, p_partkey AS "collectionId", trim(p_brand) AS "artistName", trim(p_name) AS "collectionName", CASE WHEN p_partkey % 3 <> 0 THEN '1999' END AS "releaseDate", 'u' AS page FROM part
WHERE p_partkey // 10 < 150 AND p_partkey % 7 <> 0 AND p_partkey % 9 <> 0 AND p_partkey % 11 <> 0 AND p_partkey % 13 <> 0 AND p_partkey % 17 <> 0""")
def album_list(spark, d):
    return resolve.album_list(results(spark, d), 150).select("search", "collectionId", "artistName", "collectionName", "releaseDate", F.col("collectionViewUrl").alias("page"))


@register("album_limit", """SELECT count(*) AS n, count(*) FILTER (p_partkey // 10 = 0) AS firsts FROM part WHERE p_partkey // 10 < 200 AND p_partkey % 7 <> 0 AND p_partkey % 9 <> 0 AND p_partkey % 11 <> 0 AND p_partkey % 13 <> 0 AND p_partkey % 17 <> 0""")
def album_limit(spark, d):
    """A limit beyond what a search may give is the most it may give, and one below 1 is 1."""
    rows = results(spark, d)
    return resolve.album_list(rows, 5000).agg(F.count("*").alias("n")).join(F.broadcast(resolve.album_list(rows, 0).agg(F.count("*").alias("firsts"))))


NATIVE, NATIVE_KEYS = ["ヤマダ", "ﾔﾏﾀﾞ ", "Yamada", "ヤマダ & タナカ", "タナカ", "ヤマダ"], ["ヤマダ", "ヤマダ", None, None, "タナカ", "ヤマダ"]


@register("native_names", f"""WITH n AS (SELECT 'task-' || p_size::VARCHAR AS "taskId", {pick_sql(NATIVE_KEYS, "p_partkey")} AS name, count(DISTINCT p_partkey // 4) AS n FROM part GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER w AS place, lead(n) OVER w AS second, sum(n) OVER (PARTITION BY "taskId") AS everything FROM n WHERE name IS NOT NULL WINDOW w AS (PARTITION BY "taskId" ORDER BY n DESC, name))
SELECT "taskId", name, n FROM r WHERE place = 1 AND n >= 2 AND second IS DISTINCT FROM n AND 2 * n > everything""")
def native_names(spark, d):
    """Distinct albums per composed name; Latin names and composite credits do not vote."""
    k = F.col("p_partkey")
    album = F.struct(pick(NATIVE, k).alias("artistName"), F.floor(k / 4).alias("collectionId"))
    return resolve.native_name(T.load(spark, d, "part").select(F.concat(F.lit("task-"), text(F.col("p_size"))).alias("taskId"), text(k).alias("id"), album.alias("album")))


ENRICH_SQL = T.CANDIDATES_SQL + """, albums AS (SELECT p_partkey AS "collectionId", CASE WHEN p_partkey % 5 <> 4 THEN 1 ELSE 2 END AS "artistId", p_partkey % 200 AS key, p_partkey % 200 >= 60 OR p_partkey < 200 AS of_year FROM part),
hits AS (SELECT b."taskId", b.id, b.k, a."collectionId", a."artistId" FROM base b JOIN albums a ON a.key = b.k % 200 AND a.of_year WHERE b.dated),
uniq AS (SELECT "taskId", id, min("collectionId") AS "collectionId", min("artistId") AS "artistId" FROM hits GROUP BY 1, 2 HAVING count(*) = 1),
n AS (SELECT "taskId", "artistId", count(DISTINCT "collectionId") AS n FROM uniq GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER w AS place, lead(n) OVER w AS second, sum(n) OVER (PARTITION BY "taskId") AS everything FROM n WINDOW w AS (PARTITION BY "taskId" ORDER BY n DESC, "artistId")),
winner AS (SELECT "taskId", "artistId" FROM r WHERE place = 1 AND n >= 2 AND second IS DISTINCT FROM n AND 2 * n > everything),
own AS (SELECT h."taskId", h.id, min(h."collectionId") AS c FROM hits h JOIN winner w ON w."taskId" = h."taskId" AND w."artistId" = h."artistId" GROUP BY 1, 2 HAVING count(*) = 1)
"""


def enriched(spark, d):
    """Candidates and albums of one name and year; names repeat among both, so that some matches are not unique."""
    k = F.col("p_partkey")
    name, year = F.concat(F.lit("Name "), text(k % 200)), F.when((k % 200 >= 60) | (k < 200), "1999-01-01").otherwise("1950-01-01")
    albums = T.load(spark, d, "part").select(
        k.alias("collectionId"), F.when(k % 5 != 4, 1).otherwise(2).cast("long").alias("artistId"), F.when(k % 5 != 4, "歌手").otherwise("Other").alias("artistName"), name.alias("collectionName"), year.alias("releaseDate"),
        F.when(k % 5 != 1, F.concat(F.lit("http://is1.mzstatic.com/"), text(k), F.lit("/100x100bb.jpg"))).otherwise("http://other.example/x.jpg").alias("artworkUrl100"), F.when(k % 7 != 0, F.concat(F.lit("http://music.apple.com/"), text(k))).alias("collectionViewUrl"),
    )
    p = F.col("position")
    own = candidates(spark, d).withColumns({"title": F.concat(F.lit("name-"), text(p % 200)), "titleOriginal": F.lit(None).cast("string"), "releaseDate": F.when(p % 6 != 0, "1999-03-04"), "coverImageUrl": F.when(p % 4 == 0, "mine").when(p % 4 == 1, ""), "coverImageSourceUrl": F.when(p % 4 == 0, "page")})
    artists = own.select("taskId").distinct().select("taskId", F.when(F.col("taskId").endswith("1"), "既存").otherwise("Latin").alias("name"), F.when(F.col("taskId").endswith("2"), "Own Romaji").alias("nameRomaji"), F.when(F.col("taskId").endswith("3"), " ").when(F.col("taskId").endswith("4"), "漢字").otherwise(" Asked ").alias("query"))
    return resolve.enrich(own, artists, albums)


@register("cover_enrichment", """SELECT b."taskId", b.id, CASE WHEN fill THEN 'https://is1.mzstatic.com/' || c::VARCHAR || '/600x600bb.jpg' WHEN k % 4 = 0 THEN 'mine' WHEN k % 4 = 1 THEN '' END AS cover, CASE WHEN fill THEN 'https://music.apple.com/' || c::VARCHAR WHEN k % 4 = 0 THEN 'page' END AS page
FROM (SELECT b.*, o.c, b.k % 4 <> 0 AND o.c IS NOT NULL AND o.c % 5 <> 1 AND o.c % 7 <> 0 AS fill FROM base b LEFT JOIN own o ON o."taskId" = b."taskId" AND o.id = b.id) b""", ENRICH_SQL)
def cover_enrichment(spark, d):
    return enriched(spark, d)[0].select("taskId", "id", F.col("coverImageUrl").alias("cover"), F.col("coverImageSourceUrl").alias("page"))


@register("artist_enrichment", """, named AS (SELECT "taskId", count(DISTINCT c) FILTER (c % 5 <> 4) AS n FROM own GROUP BY 1),
task AS (SELECT DISTINCT "taskId", right("taskId", 1) AS e FROM base)
SELECT t."taskId", CASE WHEN e = '1' THEN '既存' WHEN n >= 2 THEN '歌手' ELSE 'Latin' END AS name, CASE WHEN e = '2' THEN 'Own Romaji' WHEN e IN ('1', '4') OR coalesce(n, 0) < 2 THEN NULL WHEN e = '3' THEN 'Latin' ELSE 'Asked' END AS romaji FROM task t LEFT JOIN named m ON m."taskId" = t."taskId" """, ENRICH_SQL)
def artist_enrichment(spark, d):
    return enriched(spark, d)[1].select("taskId", "name", F.col("nameRomaji").alias("romaji"))
