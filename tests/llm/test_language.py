import math
import random
from collections import Counter

import regex

from codeloom.llm import language
from codeloom.llm.common import py_held_out

SYLLABLES = {"aa": ["ka", "to", "mi"], "bb": ["vel", "ünd", "og"], "cc": ["thr", "esh", "ow"]}


def text(r, lang, n):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randrange(1, 5))) for _ in range(n))


def docs(spark, rows):
    return spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")


def test_held_out_accuracy_and_edge_cases(spark):
    r = random.Random(1)
    rows = [(i, text(r, x, r.randrange(3, 60)), x) for i, x in enumerate(r.choices(sorted(SYLLABLES), k=400))]
    odd = [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 %% ½ 34", "bb"), (1003, "漢字", "cc"), (1004, text(r, "bb", 9), None), (None, text(r, "cc", 9), "cc"), (1006, text(r, "aa", 30_000), "aa"), (1, rows[1][1], rows[1][2])]
    got = language.identify(docs(spark, rows + odd)).collect()
    assert len(got) == len(rows) + len(odd)
    by = {g.doc_id: g for g in got}
    assert all(g.held_out == (d is not None and py_held_out(d)) for d, g in by.items())
    right = [by[d].lang_pred == x for d, _, x in rows if by[d].held_out]
    assert len(right) > 60 and sum(right) / len(right) > 0.98
    assert [(by[d].lang_pred, by[d].score) for d in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert by[1003].lang_pred in SYLLABLES and by[1004].lang_pred == "bb" and by[None].lang_pred == "cc" and by[1006].lang_pred == "aa"
    assert all(0 <= g.score <= 1 for g in got)


def test_labels_of_held_out_documents_are_not_used(spark):
    apart = [d for d in range(200) if py_held_out(d)]
    rows = [(d, "solo word", "zz" if d in apart else "aa") for d in range(200)]
    assert {g.lang_pred for g in language.identify(docs(spark, rows)).collect()} == {"aa"}


def test_backoff_is_word_first():
    import numpy as np

    tables = [{"ab": 0}, {}, {" x": 1}, {"abc": 2}, {}, {}]
    s = language.Scorer(language.Model(["p", "q"], np.zeros(2), tables, np.array([[0.0, -1], [-3.0, -1], [-2.0, -5]], np.float32)))
    assert s._vector("ab").tolist() == [0, -1]
    assert s._vector("zabcz").tolist() == [-2, -5]  # three letters known: the pair isn't asked
    assert s._vector("xq").tolist() == [-3, -1]


def brute(rows):
    """The whole query in plain Python: counts over learned documents, shares, backoff, posterior."""
    find = regex.compile(r"\p{L}[\p{L}\p{M}]*").findall
    known = [(t, x) for d, t, x in rows if t is not None and x and not (d is not None and py_held_out(d))]
    langs = sorted({x for _, x in known})
    count, total = Counter(), Counter()
    for t, x in known:
        for w in find(t.lower()):
            for size, gs in [(0, [w]), *((k, [f" {w} "[i : i + k] for i in range(len(w) + 3 - k)]) for k in range(1, 6))]:
                for g in gs:
                    count[size, g, x] += 1
                    total[size, x] += 1
    shares = {}
    for (size, g, x), n in count.items():
        shares[size, g] = max(shares.get((size, g), 0), n / total[size, x])
    model = {k for k, share in shares.items() if share >= (language.WORD_SHARE if k[0] == 0 else language.GRAM_SHARE)}

    def row(size, g):
        return [math.log((count[size, g, x] + language.SMOOTH) / (total[size, x] + 1)) for x in langs]

    def vector(w):
        if (0, w) in model:
            return row(0, w)
        for k in range(5, 0, -1):
            hits = [row(k, g) for i in range(len(w) + 3 - k) if (k, g := f" {w} "[i : i + k]) in model]
            if hits:
                return [sum(c) / len(hits) for c in zip(*hits)]
        return [0.0] * len(langs)

    out = []
    for d, t, _ in rows:
        found = find((t or "").lower())
        if not found or not langs:
            out.append((d, "und", 0.0))
            continue
        sums = [math.log(sum(x == y for _, y in known) / len(known)) + sum(v) for x, v in zip(langs, zip(*map(vector, found)))]
        top = max(sums)
        out.append((d, langs[sums.index(top)], 1 / sum(math.exp(s - top) for s in sums)))
    return out


def test_whole_query_against_plain_python(spark, monkeypatch):
    monkeypatch.setattr(language, "WORD_SHARE", 2e-3)
    monkeypatch.setattr(language, "GRAM_SHARE", 1e-3)
    r = random.Random(5)
    rows = [(i, text(r, x, r.randrange(1, 30)), x) for i, x in enumerate(r.choices(["aa", "bb", "cc"], [5, 2, 1], k=250))]
    rows += [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 -- 9", "cc"), (1003, "漢字 жук", "cc"), (1004, "THR,esh-ow(kato)", ""), (1005, "ΑΣ. ka" + "to" * 60, "bb"), (None, "vel og", "bb"), (1, rows[1][1], rows[1][2]), (1007, "x" * 90, None)]
    got = sorted((str(g.doc_id), g.lang_pred, round(g.score, 4)) for g in language.identify(docs(spark, rows).repartition(3)).collect())
    assert got == sorted((str(d), x, round(p, 4)) for d, x, p in brute(rows))


def test_equal_languages_go_to_the_first_by_name(spark):
    rows = [(d, "solo word", x) for d, x in ((0, "bb"), (1, "aa")) if not py_held_out(d)] + [(5, "solo", None)]
    assert len(rows) == 3
    assert {(g.lang_pred, round(g.score, 6)) for g in language.identify(docs(spark, rows)).collect()} == {("aa", 0.5)}


def test_long_words_are_known_too(spark):
    rows = [(d, "z" * 50 if d % 2 else "y" * 60, "aa" if d % 2 else "bb") for d in range(40)]
    model = language.learn(docs(spark, rows))
    assert {"z" * 50, "y" * 60} <= set(model.tables[0])


def test_sums_in_parts_are_the_same(monkeypatch):
    r = random.Random(6)
    import numpy as np

    model = language.Model(["p", "q"], np.zeros(2), [{"ka": 0, "to": 1}, {}, {}, {}, {}, {}], np.array([[-1.0, -2], [-3.0, -1]], np.float32))
    texts = [" ".join(r.choice(["ka", "to", "9", "ka,to"]) for _ in range(n)) for n in (0, 1, 50, 700, 3)]
    whole = language.Scorer(model).score(texts)
    monkeypatch.setattr(language, "SUM_ENTRIES", 7)
    monkeypatch.setattr(language, "CACHE_ENTRIES", 1)
    part = language.Scorer(model).score(texts)
    assert [x for x, _ in part] == [x for x, _ in whole] and max(abs(a - b) for (_, a), (_, b) in zip(part, whole)) < 1e-9


def test_nothing_to_learn_from(spark):
    assert [(g.lang_pred, g.score) for g in language.identify(docs(spark, [(1, "some text", None)])).collect()] == [("und", 0.0)]
    assert language.identify(docs(spark, [])).count() == 0
