import math

import numpy as np

from codeloom.llm import ann


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")


def brute(rows, every, k):
    good = {i: v for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v) and len(v) == 9}
    ids = np.array(sorted(good))
    m = np.array([good[i] for i in ids], np.float32).astype(float)
    out = {}
    for i in ids[ids % every == 0]:
        s = m @ np.array(good[i], np.float32).astype(float)
        out[int(i)] = sorted((-x, int(j)) for x, j in zip(s, ids) if j != i)[:k]
    return out


def test_against_brute_force(spark):
    r = np.random.default_rng(1)
    rows = [(i, (r.normal(size=9) * r.uniform(0.2, 3)).tolist()) for i in range(3000)]
    for i in range(400, 1200):
        rows[i] = (i, rows[400][1])  # one very common vector
    rows += [(5001, None), (5002, [0.0] * 9), (5003, [1.0] * 8 + [float("nan")]), (5020, [1.0] * 8 + [float("inf")]), (5004, [1.0] * 8 + [None]), (5040, [1.0, 2.0]), (None, rows[1][1]), rows[20], rows[33]]
    want = brute(rows, 20, 20)
    got = {}
    for q, rank, i, s in ann.nearest(frame(spark, rows), rerank=64).collect():
        got.setdefault(q, []).append((rank, i, s))
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [x[0] for x in found] == list(range(1, 21))
        assert all(-a[2] < -b[2] or (a[2] == b[2] and a[1] < b[1]) for a, b in zip(found, found[1:]))
        exact = {j: -s for s, j in want[q]}
        hits += len({x[1] for x in found} & set(exact))
        assert all(abs(exact[i] - s) < 1e-9 for _, i, s in found if i in exact)
    assert hits / (20 * len(want)) > 0.97
    common = [q for q in got if 400 <= q < 1200]
    assert all({x[1] for x in got[q]} == {j for _, j in want[q]} for q in common)


def test_few_and_none(spark):
    got = ann.nearest(frame(spark, [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 5.0])])).collect()
    assert [tuple(r) for r in sorted(got)] == [(0, 1, 1, 2.0), (0, 2, 2, 0.0)]
    assert ann.nearest(frame(spark, [])).count() == 0
    assert ann.nearest(frame(spark, [(1, [1.0, 2.0])])).count() == 0


def test_parallel_error_is_penalised():
    r = np.random.default_rng(2)
    x = r.normal(size=(2000, 16))

    def along(threshold):
        q = ann.Quantiser(x, threshold)
        codes = q.encode(x)
        c = np.stack([codes & 15, codes >> 4], 2).reshape(len(x), -1)
        rest = q._parts(x) - q.books[np.arange(8), c]
        unit = q._parts(x) / np.linalg.norm(x, axis=1)[:, None, None]
        return ((rest * unit).sum((1, 2)) ** 2).mean()

    assert along(0.6) < 0.5 * along(0.0)


def test_each_length_is_searched_and_blocks_change_nothing(spark):
    r = np.random.default_rng(8)
    rows = [(i, r.normal(size=4 if i % 3 else 6).tolist()) for i in range(200)] + [(1000, [1.0]), (1020, [2.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = []
    for q, v in rows:
        if q % 20 == 0:
            near = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q and len(w) == len(v))[:5]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(near)]
    for block in (3, 8192):
        got = sorted(tuple(x) for x in ann.nearest(frame, every=20, k=5, block=block).collect())
        assert [g[:3] for g in got] == [w[:3] for w in sorted(want)]
        assert max(abs(g[3] - w[3]) for g, w in zip(got, sorted(want))) < 1e-12
