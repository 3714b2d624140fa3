import random

import xxhash

from codeloom.llm import simhash


def brute(rows, shingle=3, radius=2):
    fp = []
    for _, text in rows:
        w = simhash.words(text)
        sh = [b" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        fp.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    of = list(range(len(rows)))

    def top(i):
        while of[i] != i:
            i = of[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= radius:
                of[top(i)] = top(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[top(i)] = min(d, ids.get(top(i), d))
    return sorted(((d, f, ids.get(top(i))) for i, ((d, _), f) in enumerate(zip(rows, fp))), key=str)


def run(spark, rows, **k):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string")
    return sorted(((r[0], r[1] % 2**64, r[2]) for r in simhash.near_duplicates(docs, **k).collect()), key=str)


def test_masks_cover_all_pairs_in_the_radius():
    for radius in (1, 2, 3):
        masks = simhash.covering_masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        r = random.Random(radius)
        for _ in range(500):
            flip = sum(1 << b for b in r.sample(range(64), radius))
            assert any(m & flip == 0 for m in masks)


def test_against_brute_force(spark):
    r = random.Random(1)
    vocab = [f"w{i}" for i in range(60)]
    base = [[r.choice(vocab) for _ in range(r.choice([0, 1, 2, 3, 40, 200]))] for _ in range(40)]
    rows = []
    for i in range(300):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2])):
            if w:
                w[r.randrange(len(w))] = r.choice(vocab)
        rows.append((i, r.choice([" ", "\n", "\t "]).join(w)))
    rows += [(300, None), (301, ""), (302, " \n"), (7, rows[8][1]), (None, rows[9][1]), (None, "alone here now"), (303, "É A b"), (304, "É a B")]
    assert run(spark, rows) == brute(rows)


def test_crowded_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET_PAIRS", 2)
    r = random.Random(2)
    base = [str(r.random()) for _ in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        w[r.randrange(len(w))] = str(r.random())
        rows.append((i, " ".join(w)))
    for radius in (2, 3):
        assert run(spark, rows, radius=radius) == brute(rows, radius=radius)


def test_empty_table(spark):
    assert run(spark, []) == []
