import random

import pyarrow as pa

from codeloom.llm import decontamination as dec


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def within(item, text):
    """Least distance of item to any run of text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item):
        new = [i + 1]
        for j, y in enumerate(text):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def made(seed, n_items=40, n_docs=400):
    r = random.Random(seed)
    vocab = [f"v{i}" for i in range(300)]
    word = lambda: vocab[min(299, int(r.expovariate(0.02)))]
    items = [(i, [word() for _ in range(r.choice([3, 6, 9, 12, 15, 25, 40, 70]))]) for i in range(n_items)]
    docs = []
    for d in range(n_docs):
        w = [word() for _ in range(r.randrange(200))]
        if r.random() < 0.6:
            _, item = r.choice(items)
            part = list(item)
            for _ in range(r.randrange(0, int(0.25 * len(item)) + 1)):
                k = r.randrange(len(part)) if part else 0
                op = r.random()
                if op < 0.4 and part:
                    part[k] = word()
                elif op < 0.7:
                    part.insert(k, word())
                elif part:
                    part.pop(k)
            at = r.randrange(len(w) + 1)
            w[at:at] = part
        docs.append((d, w))
    return items, docs


def frames(spark, items, docs):
    b = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    return spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, item_id int"), b


def test_against_brute_force(spark):
    items, docs = made(1)
    items += [(100 + k, w) for k, w in enumerate((["v9"], ["v250"], ["v3", "v1"], ["zz", "v2"], ["v5", "v5"]))]
    odd_docs = [(1000, None), (1001, ""), (1002, " ,;. "), (None, ", ".join(items[7][1]).upper())]
    docs_t = [(d, " ".join(w[:5]) + "\n" + "; ".join(w[5:])) for d, w in docs] + odd_docs + [(3, " ".join(docs[3][1]))]
    items_t = [(i, " ".join(w).title()) for i, w in items] + [(900, None), (901, ""), (902, "--")]
    frame, bench = frames(spark, items_t, docs_t)
    got = {(r[0], r[1]): r[2] for r in dec.contaminated(frame, bench).collect()}
    want = {(d, i): e for d, w in docs for i, item in items if (e := within(item, w)) <= dec.allowed(len(item))}
    found = {k: e for k, e in got.items() if k[0] is not None}
    assert set(found) <= set(want)  # nothing that isn't there
    assert all(e >= want[k] for k, e in found.items())
    missed = set(want) - set(found)
    assert len(want) > 150 and len(missed) / len(want) < 0.02
    assert not [k for k in missed if want[k] == 0]
    assert (None, 7) in got
    kept = {r[0] for r in dec.without_contaminated(frame, bench).collect()}
    assert kept - {None} == {d for d, _ in docs_t} - {d for d, _ in got} - {None}


def test_recall_by_edits_over_seeds():
    by: dict[float, list[bool]] = {}
    for seed in range(2, 7):
        items, docs = made(seed)
        finder = dec.Finder(dec.Items([(i, " ".join(w)) for i, w in items]))
        got = {(d, i) for d, i, *_ in finder.find(pa.array([" ".join(w) for _, w in docs]))}
        for d, w in docs:
            for i, item in items:
                k = dec.allowed(len(item))
                if (e := within(item, w)) <= k:
                    by.setdefault(e / k if k else 0.0, []).append((d, i) in got)
    assert all(by[0.0]) and len(by[0.0]) > 300
    edited = [x for share, xs in by.items() if share for x in xs]
    assert len(edited) > 400 and sum(edited) / len(edited) > 0.97 and sum(by[1.0]) / len(by[1.0]) > 0.95


def test_items_of_one_text_and_keys_of_one_name(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([("a", f"x {item} y"), ("b", "nothing"), ("a", f"x {item} y")], "id string, text string")
    bench = spark.createDataFrame([("k2", item), ("k1", item), ("k1", item), (None, item), ("k3", "other things entirely"), (None, "never found at all here")], "id string, text string")
    got = sorted((r.id, str(r.item_id), r.edits) for r in dec.contaminated(docs, bench, key="id", item_key="id").collect())
    assert got == [("a", i, 0) for i in ("None", "None", "k1", "k1", "k2", "k2")]


def test_scripts_without_spaces_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(dec, "BLOCK_BYTES", 60)
    texts = ["百科事典の項目はここから始まりとても長い文になる", "ภาษาไทยไม่มีช่องว่างระหว่างคำในประโยคยาว", "an item of plain words that is long enough to be one"]
    docs = spark.createDataFrame([(0, f"前置き{texts[0]}後書き"), (1, f"ก่อน {texts[1]}"), (2, f"so {texts[2]}!"), (3, "百科 の 別 の文"), (4, "an item")], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(texts)), "item_id int, text string")
    assert sorted((r.doc_id, r.item_id, r.edits) for r in dec.contaminated(docs, bench).collect()) == [(0, 0, 0), (1, 1, 0), (2, 2, 0)]
    assert [r.doc_id for r in dec.without_contaminated(docs, bench).orderBy("doc_id").collect()] == [3, 4]


def test_no_items(spark):
    frame, bench = frames(spark, [], [(1, "some words stand here")])
    assert dec.contaminated(frame, bench).count() == 0
    assert dec.without_contaminated(frame, bench).count() == 1


def test_edits_matches_the_recurrence():
    r = random.Random(4)
    for _ in range(200):
        a = [r.randrange(4) for _ in range(r.randrange(1, 12))]
        b = [r.randrange(4) for _ in range(r.randrange(0, 30))]
        bits = {x: sum(1 << i for i, y in enumerate(a) if x == y) for x in a}
        assert dec.edits(bits, len(a), b)[0] == within(a, b)
