"""Operator 9: targets by repeated resharing, and what the schedule takes."""

import random
from collections import defaultdict

import pytest

from tessera.llm import mixing as M


def targets(sizes):
    """Sizes by source (in order), shared again and again until no target is above its bound."""
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sizes)}
    total, full, out = 1.5 * sum(sizes.values()), set(), {}
    while True:
        left, free = total - sum(2 * sizes[s] for s in full), [s for s in sizes if s not in full]
        out = {s: 2.0 * sizes[s] for s in full} | {s: left * weights[s] / sum(weights[f] for f in free) for s in free}
        over = {s for s in free if out[s] > 2 * sizes[s] + 1e-9}
        if not over:
            return out
        full |= over


def check(rows, got):
    words = defaultdict(int)
    for _, s, t in rows:
        words[s] += len(t.split(" ")) if t else 0
    order = sorted((s for s in words if s is not None), key=lambda s: s.encode("utf-32-be")) + [None] * (None in words)
    want = targets({s: words[s] for s in order})
    taken = defaultdict(int)
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == words[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * r.size
    for s in words:
        assert abs(taken[s] - want[s]) <= max(2, 0.02 * words[s]), s


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_targets_and_takes(spark, seed):
    rng = random.Random(seed)
    names = ["b", "a", None, "é", "\U0001f600", "￿", "Z", ""]
    rows = [(i, "a" if rng.random() < 0.4 else rng.choice(names), " ".join(["w"] * rng.randint(0, 300))) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    one, two = M.mix(df).collect(), M.mix(df.repartition(5)).collect()
    check(rows, one)
    assert sorted(map(tuple, one), key=str) == sorted(map(tuple, two), key=str) and len(one) == len(rows)


def test_slices(spark, monkeypatch):
    monkeypatch.setattr(M, "SLICE", 16)  # many slices of each source and of the schedule
    rows = [(i, "ab"[i % 2], " ".join(["w"] * (i % 50))) for i in range(400)]
    check(rows, M.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect())


def test_schedule_is_even(spark):
    rows = [(i, "abc"[i % 3], " ".join(["w"] * 100)) for i in range(900)]
    src = M.sources_of(spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("source", "100L as size")).cache()
    slots = M.schedule(src).orderBy("slot").collect()
    quota = {r.source_no: r.quota for r in src.collect()}
    assert {n: sum(s.source_no == n for s in slots) for n in quota} == quota
    for s in quota:  # any stretch holds its share, give or take a few
        n = sum(x.source_no == s for x in slots[:200])
        assert abs(n - 200 * quota[s] / sum(quota.values())) <= 6
    assert all(sum(x.source_no == s and x.block == 0 for x in slots) <= 2 for s in quota)


def test_words(spark):
    texts = [None, "", " a\tb\x0bc　d \x0d", "\x1ca b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.n for r in df.select("i", M.size_of(M.F.col("t")).alias("n")).orderBy("i").collect()] == [0, 0, 3, 2]


def test_odd_rows(spark, odd, empty):
    got = M.mix(odd)
    assert got.count() == odd.count() and not got.where("taken > 2 * size or (size = 0 and taken > 0)").count()
    assert M.mix(empty).count() == 0
    out = M.stage(spark, odd, "")
    assert out.columns == odd.columns and out.groupBy("doc_id", "text").count().where("count > 4").count() == 0


def test_many_sources_reach_their_quotas(spark):
    """A source per few documents: numbers follow code points, and every source gets exactly its quota of blocks."""
    rng = random.Random(6)
    rows = [(f"s{i}", rng.choice([1, 2, 7, 40])) for i in range(2000)] + [("big", 300_000), (None, 1000)]
    src = M.sources_of(spark.createDataFrame(rows, "source string, size long").repartition(5)).cache()
    held = {r.source: r for r in src.collect()}
    order = sorted((s for s, _ in rows if s is not None)) + [None]
    assert [held[s].source_no for s in order] == list(range(len(rows)))
    want = targets({s: dict(rows)[s] for s in order})
    assert all(held[s].target == pytest.approx(want[s]) for s in order)
    slots = M.schedule(src)
    assert slots.count() == slots.select("slot").distinct().count() == sum(r.quota for r in held.values())
    got = {r.source_no: r["count"] for r in slots.groupBy("source_no").count().collect()}
    assert got == {r.source_no: r.quota for r in held.values() if r.quota}
