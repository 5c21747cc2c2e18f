import random

import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every kind of oddity, and columns whose names the operators use themselves."""
    rng = random.Random(4)
    words = "the and of stone river green apple light house wind paper".split()
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = prose(200)
    rows = [
        (1, base, "en", "b"), (2, base, "en", None), (2, base, "en", None), (3, None, None, "a"), (4, "", "en", "a"), (None, base + " end", "en", "a"), (None, None, None, None),
        (5, "x" * 70_000, "en", "a"), (6, prose(20_000), "en", "c"), (7, "\n\n \n", None, "c"), (8, "12 34 !!", "fr", "c"), (9, "Ünïcödé ßtraße 日本 \U0001f600\t\r\n end", "de", "d"), (10, "one", "en", "d"), (11, "one", "fr", "d"), (1, base, "en", "b"),
        (12, prose(30) + "\n" + prose(60), "en", "b"), (13, "le la les des une dans pour avec sur par que qui " * 8, "fr", "b"), (14, "der die das und nicht ein eine mit von auf " * 8, "de", "b"),
    ]
    names = "doc_id long, text string, lang string, source string, n_chars long, doc string, body string, size string, score string, h string, key string, k string, rep string, words string, rank string, `start` string, media string, taken string"
    return spark.createDataFrame([(*r, len(r[1] or ""), *["z"] * 13) for r in rows], names)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
