import hashlib
import math

import numpy as np

from codeloom.llm import common, vector_codes


def brute(rows, scale=4096, parts=8, entries=16, rounds=6):
    kept = [(i, l, v) for i, v, l in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for *_, v in kept), default=0) // parts)
    q = [[max(-(2**26), min(2**26, math.floor(scale * x))) for x in v] + [0] * (width * parts - len(v)) for *_, v in kept]
    ids = sorted({i for i, *_ in kept}, key=lambda i: (i is None, i or 0))[:entries]
    raw = lambda v: b"".join(x.to_bytes(4, "big", signed=True) for x in v)
    seeds = [min((q[n] for n, k in enumerate(kept) if k[0] == i), key=raw) for i in ids]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for v in seeds] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            of = [near(cut(v, p), books[p])[1] for v in q]
            for k in range(len(seeds)):
                mine = [cut(v, p) for v, o in zip(q, of) if o == k]
                if mine:
                    books[p][k] = [sum(x) // len(mine) for x in zip(*mine)]
    sign = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = []
    for (i, label, _), v in zip(kept, q):
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    total = {label: sum(o[3] for o in out if o[1] == label) for label in {o[1] for o in out}}
    return sorted(((i, c, e, total[label], sign) for i, label, c, e in out), key=repr)


def coded(spark, rows, kind="float"):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], f"vec_id long, embedding array<{kind}>, label int, row int, q string")
    return sorted((tuple(r) for r in vector_codes.compress(frame).drop("label").collect()), key=repr)


def some(r, n, d=16):
    rows = [(i, np.round(r.normal(size=d), 2).astype(np.float32).tolist(), int(i % 3) if i % 7 else None) for i in range(n)]
    for i in range(n // 3, n // 3 * 2):
        rows[i] = (i, rows[n // 3][1], 1)  # a very common vector
    return rows


def test_against_brute_force(spark, monkeypatch):
    rows = some(np.random.default_rng(3), 240)
    rows += [(900, None, 1), (901, [float("nan")] * 16, 1), (902, [float("inf")] + [0.0] * 15, 2), (903, [None] + [0.0] * 15, 2), (904, [0.0] * 16, 5), (5, rows[7][1], 2), (6, rows[6][1], rows[6][2]), (None, rows[9][1], 1), (906, [1e30, -1e30] * 8, 9)]
    assert coded(spark, rows) == brute(rows)
    monkeypatch.setattr(common, "HOT_KEYS", 0.3)  # most parts meet the vectors in the join
    assert coded(spark, rows) == brute(rows)


def test_lengths_that_differ_and_few_rows(spark):
    for rows in ([(i, [float(i), -0.5][: 1 + i % 2] * 5, 0) for i in range(9)], [(3, [1.0] * 8, None)], [(None, [1.0] * 8, 1)], [(1, [], 1), (2, [], 1)]):
        assert coded(spark, rows, "double") == brute(rows)


def test_empty(spark):
    assert coded(spark, []) == []
    assert coded(spark, [(1, None, 1)]) == []


def test_sums_beyond_64_bits(spark):
    books = np.zeros((1, 1, 2), np.int64)
    distinct = spark.createDataFrame([(0, bytearray(np.array([1 << 26, -7], ">i4").tobytes()), 1 << 40), (0, bytearray(np.array([1, -8], ">i4").tobytes()), 1 << 40)], "pos int, part binary, often long")
    assert vector_codes.improved(distinct, books).tolist() == [[[((1 << 26) + 1) // 2, -8]]]
