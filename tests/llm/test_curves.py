"""Operator 6: the curve itself, recall against brute force, ties and odd vectors."""

import numpy as np
import pytest

from tessera.llm import curves as C


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_hilbert_steps(dims, bits):
    """Cells that follow one another on the curve are neighbours, and each is met once."""
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    key = C.hilbert(cells, bits)
    assert sorted(key.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1) == 1).all()


def brute(ids, x, q, k=10):
    out = {}
    for i in q:
        at = np.flatnonzero(ids == i)[0]
        d = np.sqrt(((x - x[at]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
        out[i] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def run(df, **more):
    out = {}
    for r in C.search(df, lambda i: i % 20 == 0, **more).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.id, r.score))
    return out


@pytest.mark.parametrize("clustered", [True, False])
def test_recall(spark, clustered):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    if clustered:
        x = (x / 4 + rng.normal(size=(30, 24))[rng.integers(0, 30, 3000)]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got, want = run(df), brute(np.arange(3000), x.astype(np.float64), range(0, 3000, 20))
    hits = sum(len({a for a, _ in got[i]} & {a for a, _ in want[i]}) for i in want)
    assert hits >= 0.9 * 10 * len(want)
    every = {(i, j): d for i, rows in want.items() for j, d in rows}
    assert all(abs(every[i, j] - d) < 1e-9 for i, rows in got.items() for j, d in rows if (i, j) in every)


def test_ties_copies_and_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(i, [1.0, 0.0]) for i in range(40)] + [(100 + i, [1.0, 1.0 + (i % 3)]) for i in range(9)]
    odd = [(200, None), (220, [0.0, 0.0]), (240, [1.0, None]), (260, [nan, 1.0]), (280, [inf, 1.0]), (300, [1.0, 2.0, 3.0]), (None, [1.0, 0.5]), (20, [1.0, 0.0]), (60, [-0.0, 0.5]), (61, [0.0, 0.5])]
    df = spark.createDataFrame([(*r, "z", "z") for r in rows + odd], "vec_id long, embedding array<double>, rep string, v string")
    got = run(df)
    assert sorted(got) == [0, 20, 60, 100]
    assert [a for a, _ in got[20]] == list(range(10)) and [a for a, _ in got[0]] == list(range(1, 11))
    assert [a for a, _ in got[100]][:3] == [103, 106, 0] and got[60][0] == (61, 0.0)
    assert run(df.where("false")) == {}
    few = run(df.where("vec_id in (0, 100, 101)"))
    assert [a for a, _ in few[0]] == [100, 101] and [a for a, _ in few[100]] == [0, 101]


def test_windows_cross_partitions(spark):
    x = np.random.default_rng(3).normal(size=(500, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(7)
    assert run(df, window=1.0) == {i: rows for i, rows in brute(np.arange(500), x, range(0, 500, 20)).items()}


def test_ties_of_different_vectors(spark):
    """All other one-hot vectors are equally far: the smallest ids win, whatever block they are met in."""
    df = spark.createDataFrame([(i, [float(i == j) for j in range(1, 201)]) for i in range(1, 201)], "vec_id long, embedding array<float>").repartition(3)
    for i, rows in run(df).items():
        assert [a for a, _ in rows] == [j for j in range(1, 12) if j != i][:10]


def test_fixed_window(spark):
    """A window above 1 is a number of positions; clustered vectors need few."""
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(3000, 16)) / 10 + rng.normal(size=(150, 16))[rng.integers(0, 150, 3000)]).astype(np.float64)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got, want = run(df, window=40), brute(np.arange(3000), x, range(0, 3000, 20))
    assert sum(len({a for a, _ in got[i]} & {a for a, _ in want[i]}) for i in want) >= 0.9 * 10 * len(want)
