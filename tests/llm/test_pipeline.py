"""The pipeline's decisions, on its own documents, against what each stage must do, and on a small fixture against a plain version of all five."""

import hashlib
import math
import random
import zlib
from collections import Counter

import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from test_line_dedup import plain_lines
from test_mixing import targets
from test_ngram_join import exact

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tessera.llm import bpe, common, language, mixing, ngram_join, registry  # noqa: E402


def test_stages(spark, sf):
    docs = common.table(spark, sf, "documents")
    names, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = common.cut(stage(spark, docs, sf))
        seen.append(name)
        if name != "byte-level BPE":
            assert docs.columns == names
            assert docs.select("doc_id").distinct().join(before.select("doc_id").distinct(), "doc_id", "left_anti").count() == 0
        if name == "n-gram Jaccard join":
            assert ngram_join.join(docs).where("n_links > 0").count() == 0
        if name == "source mixing":
            assert docs.groupBy("doc_id").count().where("count > 2").count() == 0
    assert seen == ["language ID", "line dedup", "n-gram Jaccard join", "source mixing", "byte-level BPE"]
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"] and docs.count() > 0


def test_run_repeats_itself(spark, sf):
    rows = lambda: sorted(tuple(r[:4]) for r in corpus_pipeline.run(spark, sf).collect())
    assert rows() == rows()


def test_registry():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES if n.startswith("op")) == list(range(1, 14))


def test_components(spark):
    import random

    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)] + [(5000, i) for i in range(5001, 5060)]
    root = {x: x for e in edges for x in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.root for r in common.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: top(x) for x in linked}
    assert common.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_sweep(spark):
    """A run deletes its own tables, but for the last, and none of a run beside it, be it around it or in another thread."""
    from concurrent.futures import ThreadPoolExecutor

    with common.tables() as mine:
        kept = [common.cut(spark.range(n)) for n in (1, 2, 3)]
        with common.tables() as inner:
            own = common.cut(spark.range(4))
            assert len(inner) == 1

        def beside():
            with common.tables() as other:
                rows = common.cut(spark.range(5))
                return len(other), rows

        with ThreadPoolExecutor(1) as pool:
            n, rows = pool.submit(beside).result()
        assert n == 1 and len(mine) == 3 and common.sweep(spark, mine, keep=1) == 2 and len(mine) == 1
    assert kept[2].count() == 3 and own.count() == 4 and rows.count() == 5
    with pytest.raises(Exception, match="(?i)path|file"):
        kept[0].count()
    assert common.sweep(spark, mine) == 1 and common.sweep(spark, mine) == 0
    outside = common.cut(spark.range(6))
    assert outside.count() == 6 and mine == []


LANGUAGES = {
    "en": "the river was wide and slow in the morning light while people walked along its green banks with their dogs and children under tall trees".split(),
    "fr": "la maison était petite mais très belle avec ses fenêtres bleues et son jardin plein de fleurs rouges près du vieux moulin".split(),
    "de": "der alte wald stand dunkel und still hinter dem dorf wo die kinder im herbst bunte blätter sammelten und lange spielten".split(),
}


def fixture():
    """Documents with exact and near copies, shared passages, junk in no language, nulls and no text."""
    rng = random.Random(8)
    prose = lambda lang, n: " ".join(rng.choice(LANGUAGES[lang]) + rng.choice(["", "", "s", ","]) for _ in range(n))
    text = lambda lang: "\n".join(prose(lang, rng.choice([3, 8, 15, 30])) for _ in range(rng.randint(1, 6)))
    rows = [(lang := rng.choice(list(LANGUAGES)), text(lang)) for _ in range(70)]
    passage = [prose("en", 25), prose("en", 3), prose("en", 30)]
    rows += [("en", "\n".join([prose("en", 12), *passage, prose("en", 9)])) for _ in range(4)]
    rows += [rows[i] for i in range(0, 70, 9)] + [(None, rows[3][1]), ("en", None), ("en", ""), ("fr", "12 34 !!"), ("en", "жщ " * 30), ("de", "日本語の文章です " * 5)]
    long = [prose("fr", 120) for _ in range(4)]
    rows += [("fr", t) for t in long] + [("fr", " ".join("x" if k == 50 + j else w for k, w in enumerate(t.split()))) for j, t in enumerate(long) for _ in "ab"]
    return [(i + 1, t, lang, rng.choice(["a", "b", "b", "b", None]), len(t or "")) for i, (lang, t) in enumerate(rows)]


def letters(text):
    out = "".join(c.lower() if c.isalpha() else "\0" for c in text or "")
    while "\0\0" in out:
        out = out.replace("\0\0", "\0")
    return out.lstrip("\0")


def in_a_language(rows):
    hashed = lambda t: (xxhash.xxh64_intdigest(t.encode(), seed=42) + (1 << 63)) % (1 << 64) - (1 << 63)  # noqa: E731  as a signed number
    known = {}
    for i, t, lang, *_ in rows:
        if zlib.crc32(str(i).encode()) % 3 != 1 and t is not None and lang is not None:
            known.setdefault(lang, set()).add(t)
    known = {lang: letters(" ".join(sorted(ts, key=lambda t: (hashed(t) % (1 << 30), hashed(t))))) for lang, ts in sorted(known.items())}
    assert all(len(t) < language.SAMPLE_SYMBOLS for t in known.values())

    def phrases(seq, text):
        n = 0
        for at in range(0, len(seq), language.SEGMENT):
            part = seq[at : at + language.SEGMENT]
            while part:
                k = 1
                while k < len(part) and part[: k + 1] in text:
                    k += 1
                part, n = part[k:], n + 1
        return n

    out = []
    for r in rows:
        seq = letters(r[1])
        costs = [(phrases(seq, t) * math.log2(max(2, len(t))), lang) for lang, t in known.items()]
        if seq and phrases(seq, known[min(costs)[1]]) / len(seq) < language.ODD:
            out.append(r)
    return out


def without_repeats(rows):
    gone, out = plain_lines([(i, t or "") for i, t, *_ in rows]), []
    for i, t, lang, source, _ in rows:
        kept = "\n".join(x for p, x in enumerate(t.split("\n")) if p not in set(gone[i]))
        if kept.strip() or not gone[i]:
            out.append((i, kept, lang, source, len(kept)))
    return out


def one_of_each(rows):
    links, classes = exact([(r[0], r[1]) for r in rows])
    return [r for r, n, c in zip(rows, links, classes, strict=True) if not n or c == r[0]]


def mixed(rows, keys):
    """keys: the hash that shuffles a document within its source."""
    sizes = {i: len([w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in t).split(" ") if w]) for i, t, *_ in rows}
    order = sorted({r[3] for r in rows if r[3] is not None}) + [None] * any(r[3] is None for r in rows)
    words = {s: sum(sizes[r[0]] for r in rows if r[3] == s) for s in order}
    want = targets(words)
    blocks = {s: min(n, max(mixing.LEAST_BLOCKS, -(-n // mixing.BLOCK_WORDS))) for s, n in words.items()}
    quota = {s: int(min(math.floor(want[s] * blocks[s] / max(1, words[s]) + 0.5), 2 * blocks[s])) if words[s] else 0 for s in order}
    total, ranks, times, slot = sum(quota.values()), Counter(), Counter(), 0
    while slot < int(total * 1.02) + 1024:
        x, upto = slot * 2654435769 % (1 << 32) / (1 << 32), 0
        for s in order:
            if upto / total <= x < (upto + quota[s]) / total:
                if ranks[s] < quota[s]:
                    times[s, ranks[s] % blocks[s]] += 1
                ranks[s] += 1
            upto += quota[s]
        slot += 1
    for s in order:
        for r in range(ranks[s], quota[s]):
            times[s, r % blocks[s]] += 1
    out = []
    for s in order:
        small, longer = divmod(words[s], blocks[s]) if blocks[s] else (0, 0)
        of_word = [b for b in range(blocks[s]) for _ in range(small + (b < longer))]
        at = 0
        for r in sorted((r for r in rows if r[3] == s), key=lambda r: (keys[r[0]], r[0])):
            taken = sum(times[s, b] for b in of_word[at : at + sizes[r[0]]])
            at += sizes[r[0]]
            out += [r] * (math.floor(taken / sizes[r[0]] + 0.5) if sizes[r[0]] else 1)
    return out


def test_run_against_a_plain_version(spark, tmp_path):
    """Row by row: what five stages leave of the fixture, and the digests of the ids."""
    rows = fixture()
    names = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, names).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r[:4]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    first = in_a_language(rows)
    second = without_repeats(first)
    third = one_of_each(second)
    assert len(rows) - 5 >= len(first) > len(second) > len(third) > 30
    own = F.struct("doc_id", F.xxhash64("doc_id", "text", "lang", "source", "n_chars").alias("h"))
    keys = {r.doc_id: r.k for r in spark.createDataFrame(third, names).select("doc_id", F.xxhash64(F.lit(mixing.SEED), own).alias("k")).collect()}
    path, pattern = bpe.tokenizer()
    with open(path, "rb") as f:
        coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.ranks_of(f.read()), special_tokens={})
    want = []
    for i, t, *_ in mixed(third, keys):
        ids = coder.encode_ordinary(t)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert got == sorted(want) and path == P.path("byte_bpe_multi_50k.tiktoken")


def test_run_on_odd_tables(spark, odd, empty, tmp_path):
    """Null ids, empty texts, repeated rows and columns of clashing names pass; an empty table gives none."""
    for name, df in (("odd", odd), ("empty", empty)):
        df.write.parquet(str(tmp_path / name / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path / "odd"))
    assert 0 < out.count() <= 2 * odd.count() and corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0


def test_no_folder_of_our_own_on_a_cluster():
    class Conf:
        get = staticmethod(lambda *_: None)

    class Context:
        master, getConf = "spark://host:7077", staticmethod(lambda: Conf)

    class Session:
        sparkContext = Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)
