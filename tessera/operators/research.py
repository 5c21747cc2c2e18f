"""Candidates: typed from model text, gated, edited, selected and imported."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import json_text as J
from ..functions.text import is_blank
from ..functions.values import candidate_format, confidence_priority, leading_date, release_status
from ..sources.folders import written
from .library import count_where
from .provenance import release_sources
from .quality import gate, is_pending, needs_review

EDITED = ("title", "category", "artistCredit", "originalReleaseDate", "format", "catalogNumber", "label", "coverImageUrl", "isReissue", "isRemaster", "notes")


def parse_documents(texts: DataFrame, gated: bool = True) -> tuple[DataFrame, DataFrame]:
    """(candidates, errors) of (taskId, text). A document whose required fields are unusable fails as a whole."""
    d = F.col("doc")
    rows = texts.withColumn("json", J.first_object(F.col("text"))).withColumn("doc", F.try_parse_json("json")).withColumn("items", J.items_of(d, "$.releases"))
    scope, flag = J.text_of(d, "$.collectionScope.target"), lambda n: J.flag_of(d, f"$.collectionScope.{n}")
    untitled = F.exists("items", lambda x: is_blank(J.text_of(x, "$.title")) | is_blank(J.text_of(x, "$.artistCredit")))
    bad = is_blank(J.text_of(d, "$.artist.name")) | is_blank(J.text_of(d, "$.artist.country")) | ~F.coalesce(scope.isin(*J.TARGETS), F.lit(False)) | flag("excludeReissues").isNull() | flag("includeCollaborations").isNull() | F.col("items").isNull() | untitled
    error = F.coalesce(J.object_error(F.col("text"), F.col("json")), F.when(d.isNull(), "Invalid JSON."), F.when(F.coalesce(bad, F.lit(True)), "Document does not match the schema."))
    rows = J.once(rows, ["taskId"], error=error, artistName=J.text_of(d, "$.artist.name"), target=scope, excludeReissues=flag("excludeReissues"), items=F.col("items"))
    good = rows.where("error is null").select("taskId", "artistName", "target", "excludeReissues", F.posexplode("items").alias("position", "v"))
    good = good.withColumn("c", J.candidate(F.col("v"))).select("taskId", "artistName", "target", "excludeReissues", F.concat(F.lit("candidate-"), F.col("position") + 1).alias("id"), "position", "c.*")
    return gate(good, F.col("target"), F.col("excludeReissues")) if gated else good, rows.where("error is not null").select("taskId", "error")


def edited(candidates: DataFrame, edits: DataFrame) -> DataFrame:
    """Candidates with the user's edits (keyed by taskId and id); an edit replaces all its fields, nulls too. Only edited rows pass the gate again."""
    e = edits.select("taskId", "id", F.struct(*EDITED).alias("edit"))
    rows = candidates.join(e, ["taskId", "id"], "left")
    same_cover = F.col("edit.coverImageUrl").eqNullSafe(F.col("coverImageUrl"))
    rows = rows.withColumn("coverImageSourceUrl", F.when(F.col("edit").isNull() | same_cover, F.col("coverImageSourceUrl")))
    for c in EDITED:
        rows = rows.withColumn(c, F.when(F.col("edit").isNotNull(), F.col(f"edit.{c}")).otherwise(F.col(c)))
    again = gate(rows.where("edit is not null").drop("edit", "quality"), F.col("target"), F.col("excludeReissues"))
    plain = rows.where("edit is null").drop("edit")
    return plain.unionByName(again, allowMissingColumns=True)


def unknown_ids(candidates: DataFrame, selected: DataFrame) -> DataFrame:
    """Selected ids that no candidate has."""
    return selected.join(candidates, ["taskId", "id"], "left_anti")


def check_known(candidates: DataFrame, selected: DataFrame) -> DataFrame:
    """(taskId, error) for each task with selected ids that no candidate has."""
    n = unknown_ids(candidates, selected).groupBy("taskId").agg(F.count("*").alias("n"))
    return n.select("taskId", F.concat(F.col("n"), F.lit(" selected candidates are not in the task.")).alias("error"))


def selection_counts(candidates: DataFrame, selected: DataFrame) -> DataFrame:
    """(taskId, candidates, selected, with_cover) of each task."""
    chosen = selected.select("taskId", "id").distinct().withColumn("__selected", F.lit(True))
    rows = candidates.join(chosen, ["taskId", "id"], "left")
    return rows.groupBy("taskId").agg(F.count("*").alias("candidates"), count_where(F.col("__selected")).alias("selected"), count_where(~is_blank(F.col("coverImageUrl"))).alias("with_cover"))


def visible(category: str = "ALL", confidence: str = "ALL") -> Column:
    out = F.lit(True)
    if category != "ALL":
        out &= F.col("category") == category
    return out & (F.col("confidence") == confidence) if confidence != "ALL" else out


def candidate_notes(pending: Column) -> Column:
    c = F.col
    part = lambda label, name: F.when(~is_blank(c(name)), F.concat(F.lit(label), c(name)))
    parts = F.array(part("", "notes"), part("Artist credit: ", "artistCredit"), part("Edition: ", "editionType"), part("Original price: ", "originalPrice"), part("Barcode: ", "barcode"), F.when(pending, "PENDING_REVIEW"), F.when(F.size("warnings") > 0, F.concat(F.lit("Warnings: "), F.array_join("warnings", "; "))))
    return F.array_join(F.filter(parts, lambda x: x.isNotNull()), "\n")


def first_of_each(rows: DataFrame, keys: list[str], order: list, only_if: Column) -> DataFrame:
    """Rows that only_if does not hold for, and of the others the first of each key: what a loop that looks at its own inserts keeps."""
    first = rows.where(only_if).groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("__x"))
    return rows.where(~only_if).unionByName(first.select("__x.*"))


def import_candidates(candidates: DataFrame, selected: DataFrame, releases: DataFrame, artist: object, user: object, excluded_ids: DataFrame | None = None, pending_ids: DataFrame | None = None) -> dict[str, DataFrame]:
    """New releases, statuses and sources, and the counters. A candidate with a catalogue number is left out if its artist already
    has that title and number, or an earlier selected candidate does."""
    key = ["taskId", "id"]
    rows = candidates.join(selected.select(*key).distinct(), key, "left_semi").withColumn("artistId", F.lit(artist))
    for name, ids in (("userExcluded", excluded_ids), ("userPending", pending_ids)):
        rows = rows.withColumn(name, F.lit(False)) if ids is None else rows.join(ids.select(*key).distinct().withColumn(name, F.lit(True)), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    rows = rows.withColumn("pending", F.col("userPending") | needs_review()).withColumn("excluded", F.col("userExcluded") | F.col("isExcludedByDefault"))
    # both are read for several results: written once
    rows = written(rows, "selected")
    numbered = ~is_blank(F.col("catalogNumber"))
    known = releases.where(F.col("artistId") == F.lit(artist)).select("title", F.col("catalogNo").alias("catalogNumber")).where("catalogNumber <> ''").distinct()
    fresh = rows.where(~numbered).unionByName(rows.where(numbered).join(known, ["title", "catalogNumber"], "left_anti").select(*rows.columns))
    kept = first_of_each(fresh, ["taskId", "title", "catalogNumber"], ["position"], numbered).withColumn("releaseId", F.concat_ws(":", "taskId", "id"))
    kept = written(kept, "imported")
    new = kept.select(F.col("releaseId").alias("id"), "artistId", "category", "title", leading_date(F.coalesce("originalReleaseDate", "releaseDate")).alias("releaseDate"), candidate_format(F.col("format")).alias("format"), F.col("catalogNumber").alias("catalogNo"), "label", "originalPrice", "editionType", F.coalesce("isReissue", F.lit(False)).alias("isReissue"), F.coalesce("isRemaster", F.lit(False)).alias("isRemaster"), "isExcludedByDefault", "confidence", "warnings", candidate_notes(F.col("pending")).alias("notes"), F.col("coverImageUrl").alias("coverUrl"))
    status = kept.select(F.lit(user).alias("userId"), "releaseId", release_status(F.col("excluded"), F.col("pending")).alias("status"), confidence_priority(F.col("confidence")).alias("priority"), F.when(F.col("pending"), "PENDING_REVIEW").alias("notes"))
    links = kept.select("releaseId", F.posexplode(release_sources(F.col("sources"), F.col("coverImageSourceUrl"))).alias("position", "s")).select("releaseId", "position", "s.*")
    left_out = rows.agg(F.count("*").alias("selected"))
    counters = kept.agg(F.count("*").alias("imported"), count_where(F.col("pending")).alias("pendingReview"), count_where(F.col("excluded")).alias("excluded")).join(F.broadcast(left_out)).select("imported", (F.col("selected") - F.col("imported")).alias("skippedDuplicates"), "pendingReview", "excluded")
    return {"releases": new, "statuses": status, "sources": links, "counters": counters}


def default_selection(candidates: DataFrame) -> DataFrame:
    """(taskId, id, selected, excluded, pending): the three id sets a user starts with."""
    from .quality import is_safe

    return candidates.select("taskId", "id", is_safe().alias("selected"), F.col("isExcludedByDefault").alias("excluded"), (needs_review() | is_pending(F.col("warnings"))).alias("pending"))
