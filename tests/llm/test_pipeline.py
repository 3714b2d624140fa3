import random

import corpus_pipeline
from codeloom.llm import simhash
from tests.llm.test_simhash import brute
from tests.llm.test_toxicity import WORDS, made


def jaccard(a, b, n=5):
    def s(t):
        w = simhash.words(t)
        return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()

    x, y = s(a), s(b)
    return len(x & y) / max(1, len(x | y))


def test_one_of_each(spark):
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(500)]
    base = [[r.choice(vocab) for _ in range(r.choice([30, 120, 300]))] for _ in range(40)]
    rows = []
    for i in range(200):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2])):
            w[r.randrange(len(w))] = r.choice(vocab)
        rows.append((i, " ".join(w), "en"))
    rows += [rows[0], (None, rows[1][1], "en"), (None, None, None), (900, None, None), (901, "", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = [x.doc_id for x in simhash.one_of_each(docs).collect()]
    assert kept.count(None) == 2 and kept.count(0) == 1 and 900 in kept and 901 not in kept
    # Brute force: union of pairs with equal fingerprints, or near ones that are alike.
    named = [(d, t) for d, t, _ in dict.fromkeys(rows) if d is not None]
    fp = {d: f for d, f, _ in brute(named, shingle=5, radius=0)}
    of = {d: d for d, _ in named}

    def top(d):
        while of[d] != d:
            d = of[d]
        return d

    rep = {f: min(d for d, _ in named if fp[d] == f) for f in fp.values()}
    text = dict(named)
    for d, _ in named:
        for e in set(rep.values()):
            near = fp[d] == fp[e] or (d == rep[fp[d]] and (fp[d] ^ fp[e]).bit_count() <= 4 and jaccard(text[d], text[e]) >= 0.8)
            if near and top(d) != top(e):
                a, b = sorted((top(d), top(e)))
                of[b] = a
    assert {d for d in kept if d is not None} == {d for d, _ in named if top(d) == d}


def test_pipeline_end_to_end(spark, tmp_path):
    rows, labels = made(300)
    docs = [(d, t, "en", f"s{d % 5}", len(t)) for d, t in rows]
    item = " ".join(random.Random(9).choice(WORDS) + str(i) for i in range(20))
    docs += [(1000, "A clean text with a token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" inside", "en", "s1", 5), (1001, f"before it {item} after it", "en", "s1", 5), (1002, None, None, None, None), (1003, docs[0][1], "en", "s0", 5)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, 1, y) for d, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        now = stage(spark, now, str(tmp_path))
        assert now.columns == frame.columns
        now.write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append({r.doc_id: r.text for r in now.collect()})
    bad = {d for d, y in labels if y}
    assert len(bad & set(kept[0])) <= 1 and len(set(kept[0]) - bad) >= len(docs) - len(bad) - 2
    assert 1003 not in kept[1] and 1001 in kept[1] and 1001 not in kept[2] and set(kept[2]) == set(kept[3])
    assert kept[3][1000] == 'A clean text with a [secret]" inside'
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == set(kept[3])
    load = {}
    for r in out:
        load[r.sequence_id] = load.get(r.sequence_id, 0) + r.length
    assert max(load.values()) <= 2048 and len(load) <= sum(load.values()) / 2048 + 2


def test_pipeline_of_odd_tables(spark, tmp_path):
    """No rows at all; nulls, empty texts, repeated rows, missing ids, and extra columns named like what the stages use themselves."""
    kinds = "doc_id long, text string, lang string, source string, n_chars long, score int, found string, n int, rep string, same string, fp string, key int"
    more = (7, "x", 8, "y", "z", "w", 9)
    rows = [(1, None, None, None, None, *more), (2, "", "en", "s", 0, *more), (3, "one clean text", "en", "s", 14, *more), (3, "one clean text", "en", "s", 14, *more), (None, "no id", "en", None, 5, *more), (None, None, None, None, None, *[None] * 7)]
    for name, docs in (("none", []), ("odd", rows)):
        folder = tmp_path / name
        frame = spark.createDataFrame(docs, kinds)
        frame.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        now = spark.read.parquet(f"{folder}/documents.parquet")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
            now = stage(spark, now, str(folder))
            assert now.columns == frame.columns
            now.write.parquet(f"{folder}/{k}")
            now = spark.read.parquet(f"{folder}/{k}")
        assert all(tuple(r)[5:] in (more, (None,) * 7) for r in now.collect())
        got = sorted((r.doc_id is None, r.doc_id or 0, r.length) for r in corpus_pipeline.run(spark, str(folder)).collect())
        assert [x[:2] for x in got] == ([] if not docs else [(False, 1), (False, 3), (True, 0), (True, 0)])
        assert all(n == 1 for _, d, n in got if d == 1)
