import math

import numpy as np
import pytest

from codeloom.llm import common, vector_dedup
from codeloom.llm.vector_dedup import Windows, cosines, forest


def good(i, v, label):
    return i is not None and label is not None and v is not None and any(v) and all(x is not None and math.isfinite(x) for x in v)


def brute(rows, similarity=0.98):
    at = [n for n, r in enumerate(rows) if good(*r)]
    n_links, edges = [0] * len(rows), []
    for a in at:
        for b in at:
            (i, v, k), (j, w, m) = rows[a], rows[b]
            if a != b and k == m and len(v) == len(w) and sum(x * y for x, y in zip(v, w)) / math.sqrt(sum(x * x for x in v) * sum(x * x for x in w)) >= similarity:
                n_links[a] += 1
                edges.append((i, j))
    of = {r[0]: r[0] for r in rows if r[0] is not None}
    for _ in range(len(of)):
        for i, j in edges:
            of[i] = of[j] = min(of[i], of[j])
    return sorted(((r[0], n, of.get(r[0]), r[0] is None or of[r[0]] == r[0]) for r, n in zip(rows, n_links)), key=repr)


def found(spark, rows, kind="double", **k):
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], f"vec_id long, embedding array<{kind}>, label int, row int, same string, often int")
    return sorted((tuple(r) for r in vector_dedup.near_vectors(frame, **k).collect()), key=repr)


def some(r, n, d=16):
    """Random vectors, chains of near ones, a dense group and copies of one vector (a third of all rows)."""
    v = r.normal(size=(n, d))
    for i in range(n // 4, n // 2):
        v[i] = v[i - n // 4] + r.normal(size=d) * r.uniform(0, 0.15)
    for i in range(n // 2, n // 2 + n // 8):
        v[i] = v[1] * 3 + r.normal(size=d) * 0.3
    rows = [(int(i), x.tolist(), int(i) % 2 if i < n // 4 else int(i - n // 4) % 2 if i < n // 2 else 1) for i, x in enumerate(v)]
    return rows + [(1000 + i, rows[5][1], 1) for i in range(n // 2)]


ODD = [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, [None] + [1.0] * 15, 1), (2004, [float("inf")] + [1.0] * 15, 1), (2005, [1.0] * 16, None), (None, [1.0] * 16, 1), (2006, [1.0] * 16, 1), (2007, [1e200] * 16, 1), (2008, [1e-200] * 16, 1), (2009, [1.0, 2.0], 1), (2010, [2.0, 4.0], 1), (2011, [], 1), (2006, [-1.0] * 16, 1), (2012, [-1.0] * 16, 1), (2012, [-1.0] * 16, 1)]


@pytest.mark.parametrize("cell, share, hot", [(4096, 4096, 1e-4), (40, 4096, 0.2), (4096, 17, 0.2), (30, 13, 1e-4)])
def test_against_brute_force(spark, monkeypatch, cell, share, hot):
    monkeypatch.setattr(vector_dedup, "CELL", cell)
    monkeypatch.setattr(vector_dedup, "SHARE", share)
    monkeypatch.setattr(common, "HOT_KEYS", hot)
    rows = some(np.random.default_rng(4), 160)
    assert found(spark, rows + ODD) == brute_odd(rows + ODD)


def brute_odd(rows):
    """1e200 overflows when squared: for the brute force, the same directions."""
    return brute([(i, v if v is None else [x / 1e200 if x and abs(x) > 1e100 else x * 1e200 if x and abs(x) < 1e-100 else x for x in v], k) for i, v, k in rows])


def test_float_vectors_and_few_rows(spark):
    rows = [(i, np.float32(x).tolist(), 0) for i, x in enumerate(([1.0, 0.0], [1.0, 0.1], [0.0, 1.0], [2.0, 0.2]))]
    assert found(spark, rows, "float") == brute(rows)
    assert found(spark, []) == []
    assert found(spark, [(1, None, 1)]) == [(1, 0, 1, True)]


@pytest.mark.parametrize("d", [8, 64, 300])
def test_recall_at_the_least_similarity(d):
    """Pairs just over the threshold are candidates, and share a table, but for a share within what is calibrated."""
    r = np.random.default_rng(d)
    x = r.normal(size=(2000, d))
    x /= np.linalg.norm(x, axis=1)[:, None]
    side = r.normal(size=x.shape)
    side -= (side * x).sum(1)[:, None] * x
    y = 0.98001 * x + math.sqrt(1 - 0.98001**2) * side / np.linalg.norm(side, axis=1)[:, None]
    assert (cosines(x, y) >= 0.98).all()
    w = Windows(d, 0.98, 1_000_000)
    assert (w.cells(x) == w.cells(y)).any(1).sum() >= 1998
    hit = 0
    for i in range(0, 2000, 500):
        both = np.concatenate([x[i : i + 500], y[i : i + 500]])
        got = {(min(p, q), max(p, q)) for a, b in w.candidates(both, None) for p, q in zip(a.tolist(), b.tolist())}
        hit += sum((k, k + 500) in got for k in range(500))
    assert hit >= 1996


def test_far_pairs_are_no_candidates():
    x = np.random.default_rng(5).normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    assert sum(len(a) for a, _ in Windows(64, 0.98, 10).candidates(x, None)) < 10


def test_forest():
    assert forest(7, np.array([5, 3, 1]), np.array([3, 2, 6])).tolist() == [0, 1, 2, 2, 4, 2, 1]
