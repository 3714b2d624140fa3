import math
import random
import re

from codeloom.llm import toxicity
from codeloom.llm.common import py_held_out

WORDS = ["calm", "river", "stone", "green", "walk", "table", "music", "seven", "light", "paper", "winter", "garden"]
BAD = ["grumbish", "grumbosh", "grumbler", "vexling", "vexlord"]


def made(n=500, seed=1):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        bad = r.random() < 0.2
        sents = [[r.choice(WORDS) for _ in range(r.randrange(3, 9))] for _ in range(r.randrange(1, 12))]
        if bad:
            r.choice(sents).insert(0, r.choice(BAD))
        rows.append((i, ". ".join(" ".join(s) for s in sents) + "."))
        labels.append((i, int(bad)))
    return rows, labels


def frames(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int")
    return docs, spark.createDataFrame([(d, 1, y) for d, y in labels], "doc_id long, quality int, toxic int")


def test_held_out_and_location(spark):
    rows, labels = made()
    odd = [(9000, None), (9001, ""), (None, "calm river."), (9002, "Calm River. " * 20_000), (9003, "Winter light. You grumbash vexlings! Paper."), (3, rows[3][1])]
    got = toxicity.toxicity(*frames(spark, rows + odd, labels + [(9000, None), (None, 1)])).collect()
    assert len(got) == len(rows) + len(odd)
    by = {g.doc_id: g for g in got}
    assert all(g.held_out == (d is not None and py_held_out(d)) and 0 <= g.score <= 1 and g.predicted == (g.score >= 0.3) for d, g in by.items())
    held = [(by[d].predicted, y) for d, y in labels if by[d].held_out]
    assert len(held) > 80 and sum(p == y for p, y in held) / len(held) > 0.97
    assert [by[d].predicted for d in (9000, 9001, None, 9002)] == [0] * 4  # length alone is not toxic
    (where,) = by[9003].offending
    assert rows and "Winter light. You grumbash vexlings! Paper."[where.start : where.end] == " You grumbash vexlings"


def test_scores_are_the_noisy_or_of_sentences():
    rows, labels = made(200)
    model = toxicity.fit([t for _, t in rows], [y for _, y in labels], [1.0] * len(rows))
    texts = [t for _, t in rows] + ["", None, "Vexling. Grumbish vexlord!\ncalm"]
    for text, (score, where) in zip(texts, toxicity.Scorer(model).score(texts, 0.3)):
        leak, clean, offending, at = 1 / (1 + math.exp(-model.base)), 1.0, [], 0
        for s in re.split(r"([.!?\n])", text or ""):
            words = set(toxicity._letters.findall(s.lower()))
            if words:
                p = 1 / (1 + math.exp(-model.base - sum(float(model.weights[toxicity.features(w)].sum()) for w in words)))
                clean *= min(1.0, (1 - p) / (1 - leak))
                offending += [(at, at + len(s))] if p >= 0.3 else []
            at += len(s)
        assert abs(score - (1 - (1 - leak) * clean)) < 1e-4
        assert [(a, b) for a, b, _ in where] == offending


def test_long_texts_and_repeated_ids_are_learned_from(spark):
    rows, labels = made(300)
    long = [(d, t + " calm river" * 4000) for d, t in rows]  # over 40,000 characters each
    got = [toxicity.learn(*frames(spark, x, labels)) for x in (long + long[:5], (long + long[:5])[::-1])]
    assert got[0] is not None and got[0].base == got[1].base and (got[0].weights == got[1].weights).all()
    assert toxicity.Scorer(got[0]).score(["grumbish vexlord"])[0][0] > 0.3 > toxicity.Scorer(got[0]).score(["calm river"])[0][0]


def test_nothing_to_learn_from(spark):
    got = toxicity.toxicity(*frames(spark, [(1, "grumbish"), (2, None)], [(1, 0)])).collect()
    assert [(g.score, g.predicted) for g in got] == [(0.0, 0)] * 2
    assert toxicity.toxicity(*frames(spark, [], [])).count() == 0


def test_no_part_of_a_long_word_is_left_out():
    import numpy as np

    from codeloom.llm import toxicity

    for n in (1, 7, 39, 40, 41, 48, 500):
        word = "".join(chr(97 + (i * i + n) % 26) for i in range(n))
        padded = f"<{word}>"
        grams = {padded[i : i + k] for k in (4, 5) for i in range(1, len(padded) - k)}
        assert all(any(g in p for p in toxicity.pieces(word)) for g in grams)
    theta = np.zeros(toxicity.FEATURES)
    theta[toxicity.features("grumbish")] = 1
    plain, bad = (toxicity.weight_of("harmless" * 5 + w, theta) for w in ("daisy", "grumbish"))
    assert bad > plain + 5
    assert toxicity.weight_of("harmless" * 10_000, theta) <= plain + 1
