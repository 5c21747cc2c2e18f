"""Operator 2: what alignments delete, on cases that can be told by hand and against a plain version."""

import random

import pytest

from tessera.llm import line_dedup as L


def line(i, n=12):
    return " ".join(f"w{i}x{j}" for j in range(n))


def run(spark, rows):
    return {r.doc_id: r for r in L.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def aligned(a, b):
    """Patience diff by its definition, on lists of (position, line)."""
    if not a or not b:
        return set()
    if a[0][1] == b[0][1]:
        return {a[0][0]} | aligned(a[1:], b[1:])
    if a[-1][1] == b[-1][1]:
        return {a[-1][0]} | aligned(a[:-1], b[:-1])
    place = lambda seq, x: [i for i, (_, y) in enumerate(seq) if y == x]
    once = [(i, place(b, x)[0]) for i, (_, x) in enumerate(a) if len(place(a, x)) == len(place(b, x)) == 1]
    each = once or sorted(pair for x in {x for _, x in a} for pair in zip(place(a, x), place(b, x), strict=False))
    kept = [each[k] for k in L.increasing([j for _, j in each])]
    out = {a[i][0] for i, _ in kept}
    for (i, j), (i2, j2) in zip([(-1, -1), *kept], [*kept, (len(a), len(b))], strict=True) if once else ():
        out |= aligned(a[i + 1 : i2], b[j + 1 : j2])
    return out


def plain(rows):
    """How many lines each document loses."""
    return {i: len(gone) for i, gone in plain_lines(rows).items()}


def plain_lines(rows):
    """The lines each document loses, by dictionaries of all lines and runs; ids do not repeat."""
    split = {i: t.split("\n") for i, t in rows}
    count = lambda x: len(x.split())
    keys = {i: [(x, ">" if count(x) >= L.LINE_WORDS else "<" + (xs[p - 1] if p else "")) for p, x in enumerate(xs)] for i, xs in split.items()}
    at = {}
    for i in sorted(keys):
        for p, x in enumerate(keys[i]):
            at.setdefault((x,), {}).setdefault(i, []).append(p)
    for i in sorted(keys):
        n = 2
        while n <= len(keys[i]):
            for p in range(len(keys[i]) - n + 1):
                run = tuple(keys[i][p : p + n])
                if all(len(at[(x,)]) > 1 for x in run):
                    at.setdefault(run, {}).setdefault(i, []).append(p)
            n *= 2
    out = {}
    for i, xs in split.items():
        mine, theirs = {}, {}
        for run, places in at.items():
            owner = min(places)
            if i in places and owner < i:
                for k, p in enumerate(places[i]):
                    for q in places[owner] if len(run) == 1 else [places[owner][min(k, len(places[owner]) - 1)]]:
                        for d in range(len(run)):
                            mine.setdefault(owner, {})[p + d] = theirs.setdefault(owner, {})[q + d] = run[d]
        gone = set().union(*(aligned(sorted(mine[o].items()), sorted(theirs[o].items())) for o in mine))
        lost, block = [], []
        for p in range(len(xs) + 1):
            if p in gone:
                block.append(p)
                continue
            common = any(count(xs[q]) >= L.LINE_WORDS and len(at[(keys[i][q],)]) >= L.COMMON_DOCS for q in block)
            lost += block if common or sum(count(xs[q]) for q in block) >= L.MIN_WORDS else []
            block = []
        out[i] = lost
    return out


def test_passages(spark):
    a = "\n".join([line(1), line(2), line(3)])
    b = "\n".join([line(9), line(2), line(3), line(8)])
    got = run(spark, [(5, b), (1, a), (7, line(2))])
    assert (got[1].text, got[5].text, got[7].text) == (a, f"{line(9)}\n{line(8)}", "")
    assert (got[5].removed_lines, got[5].removed_words, got[5].n_lines) == (2, 24, 4)


def test_short_lines(spark):
    """Short lines alone are no repeat; beside an aligned line they go with it."""
    got = run(spark, [(1, f"Yes.\n{line(1)}\nNo.\nEnd of it"), (2, f"{line(1)}\nNo.\nmore"), (3, "Yes.\nwords of its own here too")])
    assert got[2].text == "more" and got[3].removed_lines == 0


def test_crossed_lines(spark):
    """Only one of two blocks that changed places can be aligned with one document."""
    a, b = "\n".join(map(line, range(6))), "\n".join(map(line, (3, 4, 5, 0, 1)))
    assert run(spark, [(1, a), (2, b)])[2].removed_lines == 3


def test_between_anchors():
    """Lines that are unique only between two anchors are aligned there."""
    pairs = lambda x: list(enumerate(x.split()))
    assert L.patience(pairs("u r v r w"), pairs("u x r y v z r t w")) == {0, 1, 2, 3, 4}
    assert L.patience(pairs("a a a b"), pairs("a a c a")) == {0, 1, 2} and L.patience(pairs("a b"), pairs("")) == set()


@pytest.mark.parametrize("seed", range(40))
def test_patience_against_its_definition(seed):
    rng = random.Random(seed)
    a, b = ([(i, rng.randrange(seed % 9 + 1)) for i in range(rng.randrange(25))] for _ in "ab")
    assert L.patience(a, b) == aligned(a, b)


@pytest.mark.parametrize(("lines", "sizes"), [(40, (12,)), (12, (12, 6)), (9, (3, 7, 12)), (4, (1, 5))])
def test_against_plain(spark, lines, sizes):
    """Lines that repeat within and across documents, of several lengths."""
    rng = random.Random(lines)
    text = [line(k, sizes[k % len(sizes)]) for k in range(lines)]
    pick = (lambda n: rng.sample(range(lines), min(n, 9))) if lines == 40 else (lambda n: [rng.randrange(lines) for _ in range(n)])
    rows = [(i, "\n".join(text[k] for k in pick(rng.randint(1, 14)))) for i in range(60)]
    rows += [(100 + i, rows[i][1] + "\n" + rows[i + 1][1]) for i in range(0, 60, 3)]
    got, want = run(spark, rows), plain(rows)
    assert {i: got[i].removed_lines for i, _ in rows} == want


def test_equal_lines(spark):
    """Texts of one line many times: an alignment reads both documents' places once."""
    texts = ["\n".join([line(0)] * 20_000), "\n".join([line(1), *[line(0)] * 30_000])]
    got = run(spark, list(enumerate(texts)))
    assert got[0].removed_lines == 0 and got[1].removed_lines == 20_000


def test_common_line_and_many_copies(spark):
    rows = [(i, f"{line(0)}\n{line(100 + i)}") for i in range(200)] + [(1000 + i, line(1)) for i in range(50)]
    got = run(spark, rows)
    assert sum(r.removed_lines for r in got.values()) == 199 + 49 and got[0].removed_lines == 0


def test_increasing():
    assert [[3, 1, 2, 5, 4][i] for i in L.increasing([3, 1, 2, 5, 4])] in ([1, 2, 4], [1, 2, 5]) and L.increasing([]) == []


def test_odd_rows(spark, odd, empty):
    got = L.dedup(odd)
    assert set(odd.columns) < set(got.columns) and got.count() == odd.count()
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append(r)
    assert [r.removed_lines for r in by[1]] == [0, 0] and [r.text for r in by[2]] == ["", ""]
    assert by[3][0].text is None and by[4][0].text == "" and {r.removed_lines for r in by[None]} == {0}
    assert L.dedup(empty).count() == 0
    assert L.stage(spark, odd, "").columns == odd.columns


def test_passage_whose_lines_have_other_owners(spark):
    """Document 3 has the passage first, but documents 1 and 2 own some of its lines, and fragments are under ten words."""
    passage = [line(i, 4) for i in range(7)]
    rows = [(1, f"{passage[2]}\n{passage[3]}\nown words"), (2, f"{passage[0]}\n{passage[1]}\nother"), (3, "\n".join(passage)), (4, "\n".join(passage)), (5, "\n".join([*passage[:4], "more of it"]))]
    got = run(spark, rows)
    assert got[4].text == "" and got[5].text == "more of it" and got[3].removed_lines == 0


def test_passage_in_another_order_than_its_lines_owner(spark):
    """Document 1 owns every line in the opposite order, document 2 has the passage as it is copied."""
    order = [line(i, 6) for i in range(5)]
    got = run(spark, [(1, "\n".join(order[::-1])), (2, "\n".join(order)), (3, "\n".join(order))])
    assert got[3].text == ""


def test_runs_go_over_batches(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        docs = spark.createDataFrame([(d, 0, p, 10 * p, 7 * p) for d in range(4) for p in range(5)] + [(9, 0, p, p, p) for p in (1, 3)], "doc long, text_hash long, pos int, h1 long, h2 long").coalesce(1)
        rows = [(r.doc, r.scale, r.pos) for r in L.runs_of(docs).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert sorted(rows) == sorted((d, s, p) for d in range(4) for s, n in ((1, 4), (2, 2)) for p in range(n))


def test_common_short_line(spark):
    """A line of 5 words in three documents goes from the later two; one in two documents, and a line of 4 words, stay."""
    rows = [(i, f"{line(0, 5)}\n{line(100 + i)}\n{line(1, 4)}\n{line(200 + i)}\n{line(2 + (i == 3), 5)}") for i in (1, 2, 3)]
    got = run(spark, [*rows, (4, line(3, 5))])
    assert {i: r.text.split("\n") for i, r in got.items()} == {1: rows[0][1].split("\n"), 2: rows[1][1].split("\n")[1:], 3: rows[2][1].split("\n")[1:], 4: [line(3, 5)]}


def test_columns_of_any_name_stay(spark):
    """Names that the operator uses itself are the caller's."""
    text = line(1) + "\n" + line(2)
    rows = [(1, text, "mine", "a", "b", "c", "d"), (2, text + "\nmore", "yours", "a", "b", "c", "d"), (3, "x", "x", "a", "b", "c", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines string, removed_lines string, __gone string, __dropped_not string, `odd name.x` string")
    out = L.stage(spark, docs, "").orderBy("doc_id").collect()
    assert out[0].asDict() == docs.where("doc_id = 1").first().asDict() and [r.n_lines for r in out] == ["mine", "yours", "x"] and out[1].text == "more"
    got = L.dedup(docs).orderBy("doc_id").collect()
    assert [(r.n_lines, r.removed_lines, r["__gone"], r.removed_words) for r in got] == [("mine", "a", "b", 0), ("yours", "a", "b", 24), ("x", "a", "b", 0)]


def test_a_line_that_an_owner_has_very_often(spark):
    """What pairs and slices hold grows with the sum of the documents' lines: the owner's 60,000 places are not copied to its 200 holders."""
    rows = [(0, "\n".join([line(0), line(1)] * 30_000)), *((i, f"{line(10 + i)}\n{line(i % 2)}") for i in range(1, 201))]
    sizes = []
    grouped = L.grouped

    def told(rows, by, names, *args, **kwargs):
        if by == ("owner", "slice"):
            sizes.append(rows.selectExpr("sum(size(at)) as n").first().n)
        return grouped(rows, by, names, *args, **kwargs)

    L.grouped = told
    try:
        got = run(spark, rows)
    finally:
        L.grouped = grouped
    assert [got[i].text for i in (1, 2, 200)] == [line(10 + i) for i in (1, 2, 200)] and got[0].removed_lines == 0
    assert sizes == [60_000 + 200]


def test_owner_in_many_slices(spark, monkeypatch):
    """Pairs of one owner that are dealt to slices give what one task gives."""
    monkeypatch.setattr(L, "SLICE_LINES", 3)
    rng = random.Random(4)
    text = [line(k, 6) for k in range(12)]
    rows = [(i, "\n".join(rng.choice(text) for _ in range(rng.randint(1, 9)))) for i in range(80)]
    got, want = run(spark, rows), plain(rows)
    assert {i: got[i].removed_lines for i, _ in rows} == want
