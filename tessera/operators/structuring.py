"""Candidates from pasted source text: a model's document is typed, and only what the text itself names counts as a source."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import json_text as J
from ..functions.text import is_blank
from ..functions.urls import explicit_urls, is_http, without_dots
from . import provenance as P
from .quality import gate


def _given(text, url):
    """URLs in a text, then the one given apart, once each."""
    one = F.filter(F.array(without_dots(url)), lambda u: ~is_blank(u))
    return F.array_distinct(F.concat(explicit_urls(text), one))


def structure(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gated candidates, errors) of requests (taskId, text: the model's answer, sourceText, artistName, country, target, excludeReissues,
    sourceUrl, defaultCoverSourceUrl). A header field that is missing comes from the request; a release without a title fails its document."""
    d, v = F.col("doc"), F.col("v")
    rows = requests.withColumn("json", J.first_object(F.col("text"))).withColumn("doc", F.try_parse_json("json"))
    scope, flag = J.text_of(d, "$.collectionScope.target"), J.flag_of(d, "$.collectionScope.excludeReissues")
    rows = rows.withColumn("target", F.when(scope.isin(*J.TARGETS), scope).otherwise(F.col("target"))).withColumn("excludeReissues", F.coalesce(flag, F.col("excludeReissues")))
    rows = rows.withColumn("explicit", _given(F.col("sourceText"), F.col("sourceUrl"))).withColumn("covers", _given(F.col("defaultCoverSourceUrl"), F.col("defaultCoverSourceUrl")))
    rows = rows.withColumn("items", F.coalesce(J.items_of(d, "$.releases"), F.expr("cast(array() as array<variant>)")))
    untitled = F.exists("items", lambda x: is_blank(J.text_of(x, "$.title")) | F.coalesce(J.text_of(x, "$.artistCredit") == "", F.lit(False)))
    rows = rows.withColumn("error", F.coalesce(J.object_error(F.col("text"), F.col("json")), F.when(d.isNull(), "Invalid JSON."), F.when(untitled, "Document does not match the schema.")))
    rows = J.once(rows, ["taskId"], **{n: F.col(n) for n in ("error", "sourceText", "target", "excludeReissues", "explicit", "covers", "artistName", "items")})
    each = rows.where("error is null").select("taskId", "sourceText", "target", "excludeReissues", "explicit", "covers", "artistName", F.posexplode("items").alias("position", "v"))
    raw = F.struct(*[J.text_of(v, f"$.{n}").alias(n) for n in P.ROW_FIELDS])
    each = each.withColumn("raw", raw).withColumn("c", J.candidate(v)).withColumn("credit", J.text_of(v, "$.artistCredit"))
    kept = [f.name for f in each.schema["c"].dataType.fields if f.name not in ("category", "artistCredit", "isReissue", "sources", "warnings", "coverImageUrl", "coverImageSourceUrl")]
    category = P.pasted_category(F.col("raw.category"), F.col("sourceText"), "raw.")
    urls = P.allowed_urls(F.transform("c.sources", lambda s: s["url"]), F.col("explicit"))
    out = each.select(
        "taskId", "target", "excludeReissues", F.concat(F.lit("candidate-"), F.col("position") + 1).alias("id"), "position", *[f"c.{n}" for n in kept],
        J.one_of(category, J.CANDIDATE_CATEGORIES, "OTHER").alias("category"),
        F.coalesce("credit", "artistName").alias("artistCredit"),
        P.pasted_reissue(F.col("c.isReissue"), "raw.").alias("isReissue"),
        P.explicit_cover(F.col("c.coverImageUrl"), F.col("covers")).alias("coverImageUrl"),
        P.explicit_cover_source(F.col("c.coverImageSourceUrl"), F.col("covers")).alias("coverImageSourceUrl"),
        P.url_warnings(F.col("c.warnings"), urls).alias("warnings"),
        F.when(F.forall(urls, is_http), P.as_sources(urls)).otherwise(F.expr(f"cast(array() as array<{J.SOURCE}>)")).alias("sources"),
    )
    return gate(out, F.col("target"), F.col("excludeReissues")), rows.where("error is not null").select("taskId", "error")
