import random

import pytest

import corpus_pipeline
from codeloom.llm import simhash
from tests.llm.test_pipeline import jaccard


def kept(spark, rows, **k):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id for r in simhash.one_of_each(docs, **k).collect()}


def alike(rows, similarity=0.8):
    """Brute force: the smallest ids of the components of all pairs of that similarity."""
    of = {d: d for d, _ in rows}

    def top(d):
        while of[d] != d:
            d = of[d]
        return d

    for d, x in rows:
        for e, y in rows:
            if d < e and jaccard(x, y) >= similarity and top(d) != top(e):
                a, b = sorted((top(d), top(e)))
                of[b] = a
    return {d for d in of if top(d) == d}


def lines(r, n, own=40):
    """Documents of one repeated line, which fixes their fingerprint, and words of their own."""
    line = " ".join(f"l{i}" for i in range(9))
    return [(i, " ".join([line] * 60 + [str(r.random()) for _ in range(own)])) for i in range(n)]


def test_equal_fingerprints_are_checked(spark):
    rows = lines(random.Random(5), 12)
    w = rows[3][1].split()
    rows += [(20, rows[2][1].upper()), (21, " ".join([*w[:-1], "other"]))]
    fp = simhash.fingerprints([t for _, t in rows], 5)
    assert len(set(fp)) == 1
    assert kept(spark, rows) == set(range(12)) == alike(rows)


def chains(r, n):
    """Groups in which the smallest id is alike to none or few, and others are alike to each other, all of nearly equal fingerprints."""
    rows = lines(r, n, 120)
    for d in range(n, 4 * n):
        w = rows[r.randrange(len(rows))][1].split()
        at = r.randrange(540, len(w) - 9)
        w[at : at + 8] = [str(r.random()) for _ in range(8)]
        rows.append((d, " ".join(w)))
    return rows


def test_crowded_buckets_are_checked_whole(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET_PAIRS", 2)
    rows = chains(random.Random(6), 12)
    assert 12 <= len(alike(rows)) < 40
    assert kept(spark, rows) == alike(rows)


def test_bands_find_what_fingerprints_miss(spark):
    r = random.Random(7)
    rows = []
    for i in range(60):
        w = [str(r.random()) for _ in range(300)]
        rows.append((2 * i, " ".join(w)))
        for at in range(20, 300, 50):
            w[at] = str(r.random())
        rows.append((2 * i + 1, " ".join(w)))
    assert alike(rows) == set(range(0, 120, 2))  # each pair at J = 0.82
    assert corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").count() == 60
    assert len(kept(spark, rows)) > 100  # of fingerprints alone


@pytest.mark.parametrize("hot", [0, 20, 100_000])
def test_across_lists_every_alike_pair(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    rows = [(d, t) for d, t in chains(random.Random(8), 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (24, 4):  # components: each text its own, or mixed
        shortest = min(len(simhash.shingle_hashes(t, 5)) for _, t in rows)
        members = spark.createDataFrame([(d, d % parts, shortest) for d, _ in rows], "rep long, component long, shortest long")
        got = {tuple(x) for x in simhash.across(docs, members, 0.8, 5, "text", "doc_id").collect()}
        want = {(d, e) for d, x in rows for e, y in rows if d < e and d % parts != e % parts and jaccard(x, y) >= 0.8}
        assert want and want <= got


def test_across_leaves_out_what_has_too_much_of_its_own(spark):
    r = random.Random(9)
    base = [f"b{i}" for i in range(130)]
    rows = []
    for d in range(120):
        w = list(base)
        for _ in range(r.choice([1, 2, 4, 6, 9])):
            w[r.randrange(len(w))] = f"u{r.randrange(10**6)}"
        rows.append((d, " ".join(w[: r.choice([110, 125, 130])])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = [len(simhash.shingle_hashes(t, 5)) for _, t in rows]
    members = spark.createDataFrame([(d, d, min(sizes)) for d, _ in rows], "rep long, component long, shortest long")
    got = {tuple(x) for x in simhash.across(docs, members, 0.8, 5, "text", "doc_id").collect()}
    want = {(d, e) for d, x in rows for e, y in rows if d < e and jaccard(x, y) >= 0.8}
    assert len(want) > 100 and want <= got and len(got) < 3 * len(want)
