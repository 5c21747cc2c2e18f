"""Operator 1 against all pairs."""

import random
import re
from itertools import combinations

from tessera.llm import ngram_join as N


def exact(rows):
    """(links, class) of each row, by word tuples and all pairs."""
    sets = []
    for _, t in rows:
        w = re.findall(r"\w+", (t or "").lower())
        k = min(5, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    links, group = [0] * len(rows), list(range(len(rows)))
    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and both * 10 >= len(sets[a] | sets[b]) * 8:
            links[a] += 1
            links[b] += 1
            old, new = max(group[a], group[b]), min(group[a], group[b])
            group = [new if g == old else g for g in group]
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in group}
    return links, [least[g] for g in group]


def near_copies(n=160, seed=2):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randint(8, 220))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8, 30])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i, " ".join(w) + rng.choice(["", ".", " !"])))
    return rows


def test_all_links(spark):
    rows = near_copies()
    got = {r.doc_id: (r.n_links, r.class_id) for r in N.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    links, classes = exact(rows)
    assert [got[i] for i, _ in rows] == list(zip(links, classes, strict=True)) and sum(links) > 500


def test_blocks_of_a_cluster(spark, monkeypatch):
    monkeypatch.setattr(N, "MOST_SHINGLES", 300)  # every cluster is cut into pairs of blocks
    rows = near_copies(80, 5)
    got = {r.doc_id: (r.n_links, r.class_id) for r in N.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i, _ in rows] == list(zip(*exact(rows), strict=True))


def templates(n, seed=7):
    """Texts of one template, of which more than half is alike in all, so that bands chain them into one large cluster of few links; each twentieth text is a near copy of the one before."""
    rng = random.Random(seed)
    head, rows, body = [f"a{j}" for j in range(54)], [], []
    for i in range(n):
        if i % 20 == 19:
            body[rng.randrange(100)] = f"v{i}"
        else:
            body = head + [f"w{rng.randrange(10**6)}" for _ in range(46)]
        rows.append((i, " ".join(body)))
    return rows


def test_a_chained_cluster_is_dealt_by_band(spark, monkeypatch):
    """The same links by either way of dealing; by band far fewer texts are copied and pairs compared than the cluster has."""
    monkeypatch.setattr(N, "LEAST_TEXTS", 4)
    rows = templates(1000)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    dealt = N.dealt

    def told(reps, shared, clusters):
        groups, members = dealt(reps, shared, clusters)
        seen.append((members.where("banded").count(), members.where("not banded").selectExpr("coalesce(sum(blocks), 0)").first()[0], members.where("banded").selectExpr("coalesce(sum(blocks), 0)").first()[0]))
        return groups, members

    monkeypatch.setattr(N, "dealt", told)
    got = {r.doc_id: (r.n_links, r.class_id) for r in N.join(docs).collect()}
    links, classes = exact(rows)
    assert [got[i] for i, _ in rows] == list(zip(links, classes, strict=True)) and sum(links) >= 100
    assert seen[0][0] > 300 and seen[0][2] < 1000 * 1000 ** 0.5 / 2


def test_pairs_of_one_unit(monkeypatch):
    """A cluster of little in common compares far below all pairs; in the units of its bands each link is found once."""
    import numpy as np

    rows = templates(1000)
    sets = [N.shingles(t) for _, t in rows]
    copies, seen = np.ones(len(sets), np.int64), []
    links, _ = N.linked(sets, copies, None, seen=seen)
    assert links.tolist() == exact(rows)[0] and sum(seen) < 1000 * 999 / 2 / 5
    keys = N.band_keys(N.minhashes(sets))
    total = np.zeros(len(sets), np.int64)
    for b in range(N.BANDS):
        for key in np.unique(keys[:, b]):
            at = np.flatnonzero(keys[:, b] == key)
            if len(at) > 1:
                total[at] += N.linked([sets[i] for i in at], copies[at], None, key=int(key))[0]
    assert total.tolist() == links.tolist()
    assert N.partners(np.zeros((50, N.BANDS), np.int64)) is None


def test_odd_rows(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    links, classes = exact(rows)
    got = sorted(((r.doc_id or -1, r.n_links, r.class_id or -1) for r in N.join(odd).collect()))
    wordless = [not re.search(r"\w", t or "") for _, t in rows]
    want = sorted((i or -1, n, (i if none else c) or -1) for (i, _), n, c, none in zip(rows, links, classes, wordless, strict=True))
    assert got == want
    assert N.join(empty).count() == 0


def test_pruning_table():
    from math import comb

    for n, m in N.least_matches():
        beyond = sum(comb(n + 1, k) * 0.8**k * 0.2 ** (n + 1 - k) for k in range(m))
        assert beyond < N.TOLERANCE


def test_stage(spark, odd):
    kept = N.stage(spark, odd, "")
    assert kept.columns == odd.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == [1, 3, 4, 5, 6, 7, 8, 9, 10, 12, 13, 14]
