"""Scalar facts: text, dates, enumerations, URLs and JSON."""

import datetime

import pytest
from pyspark.sql import functions as F

from tessera.functions import json_text as J
from tessera.functions import text as X
from tessera.functions import urls as U
from tessera.functions import values as V


def each(spark, f, inputs, kind="string"):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_titles(spark):
    assert each(spark, X.title_key, ["  Ｃ・Ｄ  ", "C++", "C", "Collection II", None, "　A B"]) == ["cd", "c++", "c", "collectionii", "", "ab"]


def test_countries(spark):
    names = ["Japan", "日本", "中国", "Hong Kong", "臺灣", "South Korea", "de", "nowhere", None]
    assert each(spark, X.country_code, names) == ["JP", "JP", "CN", "HK", "TW", "KR", "DE", "US", "US"]


def test_names(spark):
    assert each(spark, X.has_cjk, ["山田", "Hanako", "ｶﾅ", "한"]) == [True, False, True, True]
    assert each(spark, X.is_composite, ["A & B", "A x B", "Max", "A feat. B", "within", "A with B", "山田花子 ＆ BAND"]) == [True, True, False, True, False, True, True]


def test_space(spark):
    assert each(spark, X.collapsed, ["　原版 \t CD\n品番 ", None]) == ["原版 CD 品番", ""]
    assert each(spark, X.text_or_null, [" \t　", "a ", None]) == [None, "a", None]
    assert each(spark, X.masked, ["12345678", "123456789", None]) == ["12...78", "1234...6789", ""]


def test_written_dates(spark):
    d = datetime.date
    assert each(spark, V.written_date, ["1985-09-05", "1985/9/5", "1985年9月5日", "1985.13.1", "2025-02-30", "1985", "", None]) == [d(1985, 9, 5)] * 3 + [d(1986, 1, 1), d(2025, 3, 2), None, None, None]
    assert each(spark, V.strict_date, ["2025-02-30", "2024-02-29", "2024-2-9", None]) == [None, d(2024, 2, 29), None, None]
    assert each(spark, V.leading_date, ["1985", "1985-09", "1985-09-05T00:00", "x", None]) == [d(1985, 1, 1), d(1985, 9, 1), d(1985, 9, 5), None, None]
    assert each(spark, V.serial_date, [31295.0, None], "double") == [d(1985, 9, 5), None]
    assert each(spark, V.leading_year, ["1985-x", "0999", "3000", None]) == [1985, None, None, None]


def test_enumerations(spark):
    assert each(spark, V.priority, ["9", "-3", "", "必收", "low", " 4 stars", "x", None]) == [5, 1, 3, 1, 5, 4, 3, 3]
    assert each(spark, V.canonical_status, ["want", "Skip", "UNKNOWN", "ordered ", "OWNED", "x", None]) == ["WANTED", "NOT_OWNED", "NOT_OWNED", "WANTED", "OWNED", None, None]
    assert each(spark, V.sheet_format, ["SHM-CD", "", "sacd", "LP", "CD+DVD", None]) == ["SHM_CD", "CD", "HYBRID_SACD", "OTHER", "CD_DVD", "CD"]
    assert each(spark, V.candidate_format, [None, "", "Blu-spec"]) == ["CD", "OTHER", "BLU_SPEC_CD"]
    assert each(spark, V.boolean, ["再版", "原版", "Yes", "?", None]) == [True, False, True, False, False]
    assert each(spark, V.included, ["否", "", None, "是"]) == [False, True, True, True]
    assert each(spark, lambda c: V.status(c, F.lit(True)), ["想买", "已拥有", "", "excluded"]) == ["WANTED", "OWNED", "NOT_OWNED", "EXCLUDED"]
    assert each(spark, V.clamped_priority, [0, 9, None], "int") == [1, 5, 3]
    assert each(spark, lambda c: V.clamp_integer(c, 7, 1, 200), [0.0, 500.5, None, float("nan")], "double") == [1, 200, 7, 7]
    assert each(spark, V.progress, [-1, 120, None], "int") == [0, 100, None]


def test_urls(spark):
    urls = ["https://music.apple.com/a", "https://music.apple.com.evil.example/a", "javascript:alert(1)", "https://x.itunes.apple.com", "", None]
    assert each(spark, lambda c: U.on_hosts(c, U.STORE_HOSTS), urls) == [True, False, False, True, False, False]
    art = ["http://is1.mzstatic.com/image/100x100bb.jpg", "https://is1.mzstatic.com/600x600bb.jpg", "https://is1.mzstatic.com/cover.jpg", "https://evil.example/100x100bb.jpg", None]
    assert each(spark, U.artwork_600, art) == ["https://is1.mzstatic.com/image/600x600bb.jpg", None, None, None, None]
    assert each(spark, U.explicit_urls, ["see https://a.example/x. and (http://b.example/y) https://a.example/x.", None]) == [["https://a.example/x", "http://b.example/y"], []]
    assert each(spark, U.http_or_null, [" https://a.example ", "ftp://a", "https://" + "a" * 2050, " "]) == ["https://a.example", None, None, None]


@pytest.mark.parametrize(("text", "found"), [('x {"a":{"b":"}"}} y', '{"a":{"b":"}"}}'), ('```json\n{"a":1}\n``` {"b":2}', '{"a":1}'), ("none", None), ('{"a":"\\"}', None), (None, None)])
def test_first_object(spark, text, found):
    assert each(spark, J.first_object, [text]) == [found]


def test_stored_warnings(spark):
    assert each(spark, J.warnings_of, ['["a","b"]', '{"a":1}', "x", None]) == [["a", "b"], [], [], []]
