"""The driver's tables seen as catalogue tables: the same projections in DataFrames and, for the oracle, in SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.values import CATEGORIES, FORMATS
from .plans.filters import COVER_ROLE


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame) -> DataFrame:
    """rows over spark.sql.shuffle.partitions tasks. Millions of rows of a few bytes are one split of a file, so costly work on each would be one task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as releases, with the user's status."""
    k = F.col("o_orderkey")
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    none = F.expr("cast(array() as array<string>)")
    return load(spark, sf_dir, "orders").select(
        k.alias("id"),
        F.col("o_custkey").alias("artistId"),
        pick(CATEGORIES, k % 10).alias("category"),
        F.concat(F.lit("Title "), (k % 500).cast("string")).alias("title"),
        F.col("o_orderdate").cast("date").alias("releaseDate"),
        pick(FORMATS, k % 8).alias("format"),
        F.when(k % 11 != 0, F.concat(F.lit("CAT-"), (k % 1000).cast("string"))).alias("catalogNo"),
        F.when(k % 6 != 0, F.concat(F.lit("Label "), (k % 6).cast("string"))).alias("label"),
        (k % 3 == 0).alias("isReissue"),
        (k % 4 == 0).alias("isRemaster"),
        (k % 7 == 0).alias("isExcludedByDefault"),
        F.when(k % 4 == 1, "HIGH").when(k % 4 == 2, "MEDIUM").when(k % 4 == 3, "LOW").alias("confidence"),
        F.when(k % 19 == 0, F.array(F.lit("PENDING_REVIEW: missing catalogNumber."))).otherwise(none).alias("warnings"),
        F.when(k % 17 == 0, "Pending review later").when(k % 17 == 1, "").alias("notes"),
        F.when(k % 5 == 1, "").when(k % 5 != 0, F.concat(F.lit("https://img.example/"), k.cast("string"), F.lit(".jpg"))).alias("coverUrl"),
        F.when(k % 13 != 0, F.when(F.col("o_orderstatus") == "F", "OWNED").when(F.col("o_orderstatus") == "O", F.when(k % 9 == 0, "WANTED").otherwise("NOT_OWNED")).otherwise(F.when(k % 9 == 1, "EXCLUDED").otherwise("PENDING_REVIEW"))).alias("status"),
        F.when(k % 13 != 0, F.left("o_orderpriority", F.lit(1)).cast("int")).alias("priority"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems as sources, once for each release and line number."""
    rows = load(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"), F.min("l_returnflag").alias("role"))
    return rows.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"),
        F.col("l_orderkey").alias("releaseId"),
        F.concat(F.lit("https://shop"), (F.col("part") % 10).cast("string"), F.lit(".example/"), F.col("part").cast("string")).alias("url"),
        F.lit(None).cast("string").alias("label"),
        F.when(F.col("role") == "R", COVER_ROLE).when(F.col("role") == "N", "official").alias("description"),
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as candidates of tasks (by size), with fields missing in turn."""
    k = F.col("p_partkey")
    url = lambda site: F.struct(F.lit("page").alias("title"), F.concat(F.lit(f"https://{site}/"), k.cast("string")).alias("url"), F.lit("other").alias("sourceType"))
    empty = F.expr("cast(array() as array<struct<title:string,url:string,sourceType:string>>)")
    return load(spark, sf_dir, "part").select(
        F.concat(F.lit("task-"), F.col("p_size").cast("string")).alias("taskId"),
        F.concat(F.lit("candidate-"), k.cast("string")).alias("id"),
        k.alias("position"),
        F.col("p_name").alias("title"),
        F.when(k % 4 == 0, F.upper("p_name")).alias("titleOriginal"),
        F.lit("OTHER").alias("category"),
        F.col("p_brand").alias("artistCredit"),
        F.when(k % 6 != 0, F.concat((1980 + k % 30).cast("string"), F.lit("-03-04"))).alias("releaseDate"),
        F.lit(None).cast("string").alias("originalReleaseDate"),
        F.when(k % 8 == 0, "LP").when(k % 8 == 1, "unknown").when(k % 8 == 2, None).when(k % 8 == 3, "DVD box").otherwise("8cm CD").alias("format"),
        F.when(k % 5 != 0, F.concat(F.lit("N-"), (k % 50).cast("string"))).alias("catalogNumber"),
        F.when(k % 3 != 0, F.lit("Label")).alias("label"),
        F.when(k % 9 == 0, True).when(k % 9 == 1, False).alias("isReissue"),
        F.when(k % 10 == 0, True).alias("isRemaster"),
        (k % 31 == 0).alias("isExcludedByDefault"),
        F.when(k % 2 == 0, "LOW").when(k % 3 == 0, "HIGH").otherwise("MEDIUM").alias("confidence"),
        F.when(k % 23 == 0, F.array(F.lit("suspected hallucination"))).when(k % 23 == 1, F.array(F.lit("check the source"))).otherwise(F.expr("cast(array() as array<string>)")).alias("warnings"),
        F.when(k % 7 == 0, empty).when(k % 7 == 1, F.array(url("ja.wikipedia.org"))).otherwise(F.array(url("shop.example"), url("ja.wikipedia.org"))).alias("sources"),
    )


# Fixed values of the projections above, in SQL.
SQL = f"""
WITH releases AS (
  SELECT o_orderkey AS id, o_custkey AS "artistId",
    [{", ".join(repr(c) for c in CATEGORIES)}][(o_orderkey % 10)::INT + 1] AS category,
    'Title ' || (o_orderkey % 500)::VARCHAR AS title, o_orderdate::DATE AS "releaseDate",
    [{", ".join(repr(c) for c in FORMATS)}][(o_orderkey % 8)::INT + 1] AS format,
    CASE WHEN o_orderkey % 11 <> 0 THEN 'CAT-' || (o_orderkey % 1000)::VARCHAR END AS "catalogNo",
    o_orderkey % 3 = 0 AS "isReissue", o_orderkey % 4 = 0 AS "isRemaster", o_orderkey % 7 = 0 AS "isExcludedByDefault",
    CASE o_orderkey % 4 WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'LOW' END AS confidence,
    o_orderkey % 19 = 0 OR o_orderkey % 17 = 0 AS review,
    CASE o_orderkey % 17 WHEN 0 THEN 'Pending review later' WHEN 1 THEN '' END AS notes,
    CASE WHEN o_orderkey % 5 = 1 THEN '' WHEN o_orderkey % 5 <> 0 THEN 'https://img.example/' || o_orderkey::VARCHAR || '.jpg' END AS "coverUrl",
    CASE WHEN o_orderkey % 13 <> 0 THEN CASE WHEN o_orderstatus = 'F' THEN 'OWNED' WHEN o_orderstatus = 'O' THEN CASE WHEN o_orderkey % 9 = 0 THEN 'WANTED' ELSE 'NOT_OWNED' END ELSE CASE WHEN o_orderkey % 9 = 1 THEN 'EXCLUDED' ELSE 'PENDING_REVIEW' END END END AS status,
    CASE WHEN o_orderkey % 13 <> 0 THEN left(o_orderpriority, 1)::INT END AS priority
  FROM orders),
sources AS (
  SELECT l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR AS id, l_orderkey AS "releaseId",
    'https://shop' || (min(l_partkey) % 10)::VARCHAR || '.example/' || min(l_partkey)::VARCHAR AS url,
    CASE min(l_returnflag) WHEN 'R' THEN '{COVER_ROLE}' WHEN 'N' THEN 'official' END AS description
  FROM lineitem GROUP BY l_orderkey, l_linenumber),
evidence AS (SELECT "releaseId", count(*) AS n FROM sources WHERE description IS DISTINCT FROM '{COVER_ROLE}' GROUP BY ALL),
library AS (SELECT r.*, coalesce(e.n, 0) AS evidence, coalesce("coverUrl", '') = '' AS no_cover, coalesce("catalogNo", '') = '' AS no_catalog,
    "isExcludedByDefault" OR coalesce(status = 'EXCLUDED', false) AS excluded
  FROM releases r LEFT JOIN evidence e ON r.id = e."releaseId")
"""

BASE_SQL = """
WITH base AS (
  SELECT 'task-' || p_size::VARCHAR AS "taskId", 'candidate-' || p_partkey::VARCHAR AS id, p_partkey AS k, p_name AS title,
    CASE WHEN p_partkey % 4 = 0 THEN upper(p_name) END AS "titleOriginal",
    p_partkey % 6 <> 0 AS dated, 1980 + p_partkey % 30 AS year,
    CASE p_partkey % 8 WHEN 0 THEN 'LP' WHEN 1 THEN 'unknown' WHEN 2 THEN NULL WHEN 3 THEN 'DVD box' ELSE '8cm CD' END AS format,
    p_partkey % 5 = 0 AS no_catalog, p_partkey % 3 <> 0 AS labelled, coalesce(p_partkey % 9 = 0, false) AS reissue, p_partkey % 10 = 0 AS remaster,
    p_partkey % 31 = 0 AS excluded0, CASE WHEN p_partkey % 2 = 0 THEN 1 WHEN p_partkey % 3 = 0 THEN 3 ELSE 2 END AS conf0,
    p_partkey % 23 = 0 AS risky, p_partkey % 23 = 1 AS said_source, p_partkey % 7 = 0 AS no_source, p_partkey % 7 = 1 AS wiki
  FROM part),
"""


def gate_sql(base: str, gated: str) -> str:
    """The gate over the table `base`, as a chain of tables that ends in `gated`."""
    t = lambda n: f"{gated}_{n}"
    return f"""{t("f")} AS (SELECT *, format IN ('LP', 'DVD box') AS non_cd_, format IN ('8cm CD', 'CD') AS cd_, format IS NULL OR format = 'unknown' AS unknown FROM {base}),
{t("g")} AS (SELECT *, coalesce(non_cd_, false) AS non_cd, coalesce(cd_, false) AS cd FROM {t("f")}),
{t("1")} AS (SELECT *, CASE WHEN no_source THEN 1 WHEN no_catalog OR wiki OR non_cd OR reissue OR remaster THEN least(conf0, 2) ELSE conf0 END AS a FROM {t("g")}),
{t("2")} AS (SELECT *, CASE WHEN NOT no_source AND NOT no_catalog THEN greatest(a, 2) ELSE a END AS b FROM {t("1")}),
{t("3")} AS (SELECT *, CASE WHEN NOT dated OR format IS NULL OR NOT labelled THEN least(b, 2) ELSE b END AS c FROM {t("2")}),
{t("4")} AS (SELECT *, CASE WHEN NOT no_source AND NOT no_catalog AND dated AND cd AND NOT reissue AND NOT remaster AND NOT risky AND NOT wiki THEN 3 ELSE c END AS d FROM {t("3")}),
{t("5")} AS (SELECT *, CASE WHEN (unknown AND NOT dated) OR (no_catalog AND NOT dated) OR risky OR no_source THEN 1 ELSE d END AS e FROM {t("4")}),
{gated} AS (SELECT *, CASE WHEN no_catalog OR wiki THEN least(e, 2) ELSE e END AS level,
    excluded0 OR non_cd OR reissue OR remaster AS excluded,
    no_catalog OR wiki OR non_cd OR risky OR no_source OR (unknown AND NOT dated) AS pending,
    no_catalog::INT + (no_source AND NOT said_source)::INT + wiki::INT + non_cd::INT + reissue::INT + remaster::INT
      + (unknown AND NOT dated AND NOT non_cd)::INT + (risky OR said_source)::INT AS n_warnings,
    no_catalog OR (no_source AND NOT said_source) OR wiki OR (unknown AND NOT dated) AS warns,
    no_catalog OR (no_source AND NOT said_source) OR wiki OR (unknown AND NOT dated AND NOT non_cd) AS flagged
  FROM {t("5")})
"""


CANDIDATES_SQL = BASE_SQL + gate_sql("base", "gated")
