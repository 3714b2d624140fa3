import hashlib
import random

from codeloom.llm import substrings


def brute(rows):
    least = {}
    docs = [(d, t.encode().split() if t else []) for d, t in rows]
    for d, w in docs:
        if d is not None:
            for i in range(len(w) - 12):
                s = tuple(w[i : i + 13])
                least[s] = min(d, least.get(s, d))
    out = []
    for d, w in docs:
        gone = set()
        for i in range(len(w) - 12) if d is not None else ():
            if least[tuple(w[i : i + 13])] < d:
                gone |= set(range(i, i + 13))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(out, key=str)


def run(spark, rows):
    docs = spark.createDataFrame([(*r, b"x") for r in rows], "doc_id long, text string, found binary")
    return sorted((tuple(r) for r in substrings.dedup(docs).collect()), key=str)


def rows_of(seed, n=150):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passages = [[r.choice(vocab) for _ in range(r.choice([12, 13, 14, 20, 60]))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(r.randrange(4)):
            w += [r.choice(vocab) for _ in range(r.randrange(15))]
            w += r.choice(passages)
        rows.append((i * 3 - 50, " ".join(w)))
    rows += [(i + 5000, "common passage of exactly thirteen words stands here in every one of them " + str(i)) for i in range(80)]
    rows += [(9000, None), (9001, ""), (9002, " \n\t "), (None, rows[3][1]), (9003, "a " * 40), (9004, "b a " + "a " * 40), rows[5], (9005, "\x1c é\x85w " * 15)]
    return rows


def test_against_brute_force(spark):
    rows = rows_of(1)
    assert run(spark, rows) == brute(rows)


def test_small_flushes(spark, monkeypatch):
    monkeypatch.setattr(substrings, "FLUSH", 50)
    rows = rows_of(2, 60)
    assert run(spark, rows) == brute(rows)


def test_the_cover_has_all_differences():
    assert {(a - b) % substrings.PERIOD for a in substrings.COVER for b in substrings.COVER} == set(range(substrings.PERIOD))


def test_empty_and_nothing_shared(spark):
    assert run(spark, []) == []
    rows = [(1, "short"), (2, "short"), (3, None)]
    assert run(spark, rows) == brute(rows)
