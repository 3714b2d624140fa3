import hashlib
import math
import random
import re
import zlib
from collections import Counter

from codeloom.llm import importance

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def found(text, longest):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return w, [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, longest, buckets, least, percent, seed):
    """Rows without their order: (doc_id, n_features, weight, score, rank)."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for text in texts for f in found(text, longest)[1]) for texts in ([x[1] for x in docs], target))
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1) * (s.total() + buckets)) / ((s[b] + 1) * (t.total() + buckets))))
    rows = []
    for i, (d, text) in enumerate(docs):
        w, f = found(text, longest)
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(x)) for x in f)
        rows.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(w)])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def drawn(spark, docs, target, **k):
    docs = spark.createDataFrame([(*r, 1, "x", "y") for r in docs], "doc_id long, text string, row int, weight string, features string")
    out = importance.resample(docs, spark.createDataFrame([(x,) for x in target], "text string"), **k)
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def some(r, n):
    names = [f"w{i}" for i in range(400)] + ["É", "naïve", "straße", "x" * 50, "日本", "A-b", "it's"]
    docs = [(i, " ".join(r.choices(names, k=r.randrange(60)))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, "?!.. \n"), (None, "a b c " * 10), (3, docs[3][1]), (3, docs[3][1]), (n + 3, "the " * 30_000 + " ".join(f"own{i}" for i in range(9000)))]
    docs += [(n + 10 + i, "same words in all of these rows " * 3) for i in range(n)]  # a third of all rows
    return docs, [" ".join(r.choices(names[:60], k=20)) for _ in range(30)] + [None, ""]


def test_against_brute_force(spark, monkeypatch):
    docs, target = some(random.Random(1), 150)
    for share, wide, longest in ((1e-5, 4096, 1), (0.02, 100, 1), (0.02, 100, 3)):
        monkeypatch.setattr(importance, "HOT_SHARE", share)
        monkeypatch.setattr(importance, "WIDE", wide)
        k = {"longest": longest, "buckets": 97 if longest == 1 else 10_000, "least": 20, "percent": 10, "seed": 2024}
        assert drawn(spark, docs, target, **k) == brute(docs, target, **k)


def test_everything_and_nothing_drawn(spark):
    docs, target = some(random.Random(2), 20)
    for percent in (0, 100):
        k = {"longest": 1, "buckets": 10_000, "least": 1, "percent": percent, "seed": 1}
        assert drawn(spark, docs, target, **k) == brute(docs, target, **k)


def test_empty_tables(spark):
    assert drawn(spark, [], ["a b"]) == []
    k = {"longest": 1, "buckets": 10, "least": 1, "percent": 50, "seed": 2024}
    docs = [(1, "a b"), (2, "c"), (3, None)]
    assert drawn(spark, docs, [], **k) == brute(docs, [], **k)
