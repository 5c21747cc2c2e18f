"""JSON inside free text, and lenient typing of candidate documents."""

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .urls import is_http
from .values import CANDIDATE_CATEGORIES, CONFIDENCES

# Fixed values of the document's schema.
TEXTS = ("titleOriginal", "releaseDate", "originalReleaseDate", "format", "catalogNumber", "barcode", "label", "originalPrice", "editionType", "notes")
SOURCE_TYPES = ("official", "retailer", "database", "news", "other")
TARGETS = ("ORIGINAL_CD", "ALL_CD", "ALL_PHYSICAL")
SOURCE = "struct<title:string,url:string,sourceType:string>"
#: Every field is read as a variant first, since a text in a number's place is not that number's text.
DOCUMENT = "struct<artist:variant,collectionScope:variant,releases:array<variant>,globalWarnings:variant>"


FENCED = re.compile("```(.*?)```", re.DOTALL)
#: A whole string (or one that never ends), or a brace: what lies between these does not matter.
TOKEN = re.compile(r'"(?:[^"\\]|\\.)*(?:"|$)|[{}]', re.DOTALL)


def _first_object(text: str | None) -> str | None:
    """The first balanced {...} of the first fenced block, or of the text; strings and escapes are honoured. None without one."""
    block = FENCED.search(text or "")
    text = block[1] if block else text or ""
    begin, depth = text.find("{"), 0
    for token in TOKEN.finditer(text, begin) if begin >= 0 else ():
        depth += {"{": 1, "}": -1}.get(token[0], 0)
        if not depth:
            return text[begin : token.end()]
    return None


@F.pandas_udf(StringType())
def first_object(texts: pd.Series) -> pd.Series:
    """Balanced braces are no regular language, so this runs in Arrow batches."""
    return texts.map(_first_object)


def object_error(text: Column, found: Column) -> Column:
    """Why there is no object: none begins, or none ends."""
    return F.when(found.isNull(), F.when(F.coalesce(text, F.lit("")).contains("{"), "Unclosed JSON object in model output.").otherwise("No JSON object found in model output."))


def once(rows: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """rows with the columns `keep` and these. They come from a generator of one row, which no filter is moved across: what a filter above asks of a
    column is computed where the column is, not a second time below with all that it is made of (texts parsed, paths looked up)."""
    return rows.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def text_of(v: Column, path: str) -> Column:
    """A field that is a JSON string, else null."""
    raw = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(raw) == "STRING", F.try_variant_get(v, path, "string"))


def flag_of(v: Column, path: str) -> Column:
    raw = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(raw) == "BOOLEAN", F.try_variant_get(v, path, "boolean"))


def items_of(v: Column, path: str) -> Column:
    """A field that is a JSON array, else null."""
    raw = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(raw).startswith("ARRAY"), F.try_variant_get(v, path, "array<variant>"))


def one_of(c: Column, names: tuple[str, ...], default: str) -> Column:
    return F.when(c.isin(*names), c).otherwise(default)


def strings_or_empty(items: Column) -> Column:
    """All items as texts if all are texts, else none."""
    kinds = F.forall(items, lambda x: F.coalesce(F.schema_of_variant(x) == "STRING", F.lit(False)))
    return F.coalesce(F.when(kinds, F.transform(items, lambda x: F.try_variant_get(x, "$", "string"))), F.expr("cast(array() as array<string>)"))


def sources_or_empty(items: Column) -> Column:
    """All sources if each has a usable URL, else none."""
    typed = F.transform(items, lambda x: F.struct(F.coalesce(text_of(x, "$.title"), F.lit("Untitled source")).alias("title"), text_of(x, "$.url").alias("url"), one_of(F.coalesce(text_of(x, "$.sourceType"), F.lit("")), SOURCE_TYPES, "other").alias("sourceType")))
    return F.coalesce(F.when(F.forall(typed, lambda s: F.coalesce(is_http(s["url"]), F.lit(False))), typed), F.expr(f"cast(array() as array<{SOURCE}>)"))


def candidate(v: Column) -> Column:
    """One element of `releases`, typed; a field of the wrong kind falls back alone. title and artistCredit stay null if unusable."""
    url = lambda name: F.when(is_http(text_of(v, f"$.{name}")), text_of(v, f"$.{name}"))
    return F.struct(
        F.nullif(text_of(v, "$.title"), F.lit("")).alias("title"),
        F.nullif(text_of(v, "$.artistCredit"), F.lit("")).alias("artistCredit"),
        one_of(F.coalesce(text_of(v, "$.category"), F.lit("")), CANDIDATE_CATEGORIES, "OTHER").alias("category"),
        *[text_of(v, f"$.{n}").alias(n) for n in TEXTS],
        *[flag_of(v, f"$.{n}").alias(n) for n in ("isReissue", "isRemaster")],
        F.coalesce(flag_of(v, "$.isExcludedByDefault"), F.lit(False)).alias("isExcludedByDefault"),
        url("coverImageUrl").alias("coverImageUrl"),
        url("coverImageSourceUrl").alias("coverImageSourceUrl"),
        one_of(F.coalesce(text_of(v, "$.confidence"), F.lit("")), CONFIDENCES, "LOW").alias("confidence"),
        strings_or_empty(items_of(v, "$.warnings")).alias("warnings"),
        sources_or_empty(items_of(v, "$.sources")).alias("sources"),
    )


def warnings_of(json: Column) -> Column:
    """A stored JSON array as texts, anything else as none."""
    v = F.try_parse_json(json)
    return F.coalesce(F.transform(items_of(v, "$"), lambda x: F.try_variant_get(x, "$", "string")), F.expr("cast(array() as array<string>)"))


def json_safe(c: Column) -> Column:
    """A column as the JSON that is stored of it and read again: absent fields go, dates and times become texts."""
    return F.to_json(F.struct(c.alias("value")))


def response_text(output_text: Column, output: Column) -> Column:
    """A model response's text: its own field, else all content texts, a line each. output: array<struct<content:array<struct<text>>>>."""
    parts = F.flatten(F.transform(output, lambda o: F.coalesce(o["content"], F.expr("cast(array() as array<struct<type:string,text:string>>)"))))
    return F.coalesce(F.nullif(output_text, F.lit("")), F.array_join(F.filter(F.transform(parts, lambda p: p["text"]), lambda t: t.isNotNull()), "\n"))
