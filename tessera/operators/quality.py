"""The quality gate of candidates: confidence, warnings and exclusion by rules in a fixed order.

A candidate has title, category, format, releaseDate, originalReleaseDate, catalogNumber, label, isReissue, isRemaster,
isExcludedByDefault, confidence, warnings and sources (array of struct<title,url,sourceType>).
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, whole_word
from ..functions.urls import is_wiki
from ..functions.values import confidence_name, confidence_rank
from .library import count_where

# Patterns and the warnings that the gate itself manages.
CD = f"(?i){whole_word(r'cd|8cm\s*cd')}|cdシングル|cdアルバム"
NOT_CD = f"(?i){whole_word(r'lp|vinyl|cassette|tape|dvd|blu[-\s]?ray')}|レコード|カセット|テープ|ブルーレイ"
UNKNOWN = "(?i)unknown|unclear|不明|未確認|不詳"
RISKY = "(?i)no explicit source url|fabricated|guessed|unknown catalog|suspected hallucination|hallucination"
NO_CATALOG = "PENDING_REVIEW: missing catalogNumber."
NO_SOURCE = "PENDING_REVIEW: no source URL provided."
ONLY_WIKI = "PENDING_REVIEW: only wiki source."
NON_CD = "EXCLUDED_BY_DEFAULT: non-CD format excluded under ORIGINAL_CD scope."
REISSUE = "EXCLUDED_BY_DEFAULT: reissue excluded by scope."
REMASTER = "EXCLUDED_BY_DEFAULT: remaster excluded by scope."
NO_FORMAT = "PENDING_REVIEW: unknown release format."
MANAGED = (NO_CATALOG, NO_SOURCE, ONLY_WIKI, NON_CD, REISSUE, REMASTER, NO_FORMAT)
LOW, MEDIUM, HIGH = 1, 2, 3


def yes(c: Column) -> Column:
    """True only where it is true; unknown is not."""
    return F.coalesce(c, F.lit(False))


def any_warning(warnings: Column, needle: str) -> Column:
    return F.exists(warnings, lambda w: F.lower(w).contains(needle.lower()))


def gate(candidates: DataFrame, target: Column, exclude_reissues: Column) -> DataFrame:
    """Replaces confidence, warnings and isExcludedByDefault, adds `quality`. A second pass changes nothing."""
    c = F.col
    no_catalog, no_source = is_blank(c("catalogNumber")), F.size("sources") == 0
    wiki = (F.size("sources") > 0) & F.forall("sources", lambda s: is_wiki(s["url"], s["title"]))
    fmt = F.coalesce(c("format"), F.lit(""))
    dated = ~(is_blank(c("originalReleaseDate")) & is_blank(c("releaseDate")))
    non_cd = yes(target == "ORIGINAL_CD") & fmt.rlike(NOT_CD)
    reissue, remaster = yes(c("isReissue")) & yes(exclude_reissues), yes(c("isRemaster")) & yes(exclude_reissues)
    unknown = (fmt == "") | fmt.rlike(UNKNOWN)
    incomplete = ~dated | (fmt == "") | is_blank(c("label"))
    own = F.filter(F.coalesce("warnings", F.expr("cast(array() as array<string>)")), lambda w: ~w.isin(*MANAGED))
    rows = candidates.withColumn("warnings", own)
    facts = {"no_catalog": no_catalog, "no_source": no_source, "wiki": wiki, "dated": dated, "non_cd": non_cd, "reissue": reissue, "remaster": remaster, "unknown": unknown, "incomplete": incomplete, "risky": F.exists("warnings", lambda w: w.rlike(RISKY)), "cd": (fmt != "") & fmt.rlike(CD) & ~fmt.rlike(NOT_CD)}
    rows = rows.withColumn("__f", F.struct(*[v.alias(k) for k, v in facts.items()]))
    f = lambda k: c("__f")[k]
    # each rule that can warn sees the warnings of those before it: one fold over the rules
    rules = F.array(
        *[
            F.struct(hit.alias("hit"), F.lit(needle.lower()).alias("needle"), F.lit(text).alias("text"))
            for hit, needle, text in (
                (f("no_catalog"), "catalogNumber", NO_CATALOG),
                (f("no_source"), "source", NO_SOURCE),
                (f("wiki"), "only wiki source", ONLY_WIKI),
                (f("non_cd"), "non-CD", NON_CD),
                (f("reissue"), "reissue excluded by scope", REISSUE),
                (f("remaster"), "remaster excluded by scope", REMASTER),
                (f("unknown") & ~f("dated"), "format", NO_FORMAT),
            )
        ]
    )
    said = lambda warnings, needle: F.exists(warnings, lambda w: F.lower(w).contains(needle))
    rows = rows.withColumn("warnings", F.aggregate(rules, c("warnings"), lambda ws, r: F.when(r["hit"] & ~said(ws, r["needle"]), F.array_append(ws, r["text"])).otherwise(ws)))
    # a rule's cap and its lift are one term each, so the level is written once
    cap = lambda hit, most=MEDIUM: F.when(hit, most).otherwise(HIGH)
    complete = ~f("no_source") & ~f("no_catalog")
    level = F.coalesce(confidence_rank(c("confidence")), F.lit(LOW))
    level = F.least(level, cap(f("no_catalog")), cap(f("no_source"), LOW), *[cap(f(k)) for k in ("wiki", "non_cd", "reissue", "remaster")])
    level = F.least(F.greatest(level, F.when(complete, MEDIUM).otherwise(LOW)), cap(f("incomplete")))
    level = F.greatest(level, F.when(complete & f("dated") & f("cd") & ~yes(c("isReissue")) & ~yes(c("isRemaster")) & ~f("risky") & ~f("wiki"), HIGH).otherwise(LOW))
    lowest = (f("unknown") & ~f("dated")) | (f("no_catalog") & ~f("dated")) | f("risky") | f("no_source")
    level = F.least(level, cap(lowest, LOW), cap(f("no_catalog") | f("wiki")))
    excluded = c("isExcludedByDefault") | f("non_cd") | f("reissue") | f("remaster")
    pending = f("no_catalog") | f("wiki") | f("non_cd") | lowest
    rows = rows.withColumn("confidence", confidence_name(level)).withColumn("isExcludedByDefault", excluded)
    safe = (c("confidence") == "HIGH") & ~c("isExcludedByDefault") & ~f("no_source") & ~f("no_catalog")
    quality = F.struct(f("no_catalog").alias("missingCatalogNumber"), f("no_source").alias("missingSources"), f("wiki").alias("wikiOnlySources"), f("non_cd").alias("nonCdPhysicalUnderOriginalCd"), pending.alias("pendingReview"), safe.alias("safeToImportByDefault"))
    return rows.withColumn("quality", quality).drop("__f")


def is_safe() -> Column:
    c = F.col
    return (c("confidence") == "HIGH") & ~c("isExcludedByDefault") & (F.size("sources") > 0) & ~is_blank(c("catalogNumber"))


def is_pending(warnings: Column) -> Column:
    """Case-sensitive, unlike the library's review mention."""
    return F.exists(warnings, lambda w: w.contains("PENDING_REVIEW"))


def needs_review() -> Column:
    c = F.col
    return ~yes(c("confidence") == "HIGH") | is_blank(c("catalogNumber")) | (F.size("sources") == 0) | is_pending(c("warnings"))


def summary_columns() -> list[Column]:
    c = F.col
    return [
        F.count("*").alias("total"),
        count_where(is_safe()).alias("safe_to_import"),
        count_where(is_pending(c("warnings"))).alias("pending_review"),
        count_where(is_blank(c("catalogNumber"))).alias("missing_catalog"),
        count_where(F.size("sources") == 0).alias("missing_sources"),
        count_where(c("isExcludedByDefault")).alias("default_excluded"),
    ]


def histogram(rows: DataFrame, *by: str) -> DataFrame:
    """Counts of each confidence, zeros included."""
    return rows.groupBy(*by).agg(*[count_where(F.col("confidence") == k).alias(k.lower()) for k in ("HIGH", "MEDIUM", "LOW")])


def audit_columns() -> list[Column]:
    """Counts of candidates by what their warnings mention."""
    has = lambda needle: count_where(any_warning(F.col("warnings"), needle))
    return [has("missing catalogNumber").alias("missing_catalog"), has("no source URL").alias("missing_source"), has("only wiki source").alias("wiki_only"), has("non-CD").alias("non_cd"), has("reissue excluded").alias("reissue")]
