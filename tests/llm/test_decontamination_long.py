import random

import pyarrow as pa

from codeloom.llm import decontamination as dec
from tests.llm.test_decontamination import within


def edited(r, item, share, word):
    part = list(item)
    for _ in range(int(share * len(item))):
        k = r.randrange(len(part))
        op = r.random()
        if op < 0.6:
            part[k] = word()
        elif op < 0.8:
            part.insert(k, word())
        else:
            part.pop(k)
    return part


def recall(n, share, seed=1, times=60):
    """Found of the copies of items of n words, each copy between other words at an odd place, with a share of edits."""
    r = random.Random(seed)
    word = lambda: f"v{min(2999, int(r.expovariate(0.002)))}"
    items = [[word() for _ in range(n)] for _ in range(times)]
    docs = [[word() for _ in range(r.randrange(300))] + edited(r, item, share, word) + [word() for _ in range(50)] for item in items]
    finder = dec.Finder(dec.Items([(i, " ".join(w)) for i, w in enumerate(items)]))
    got = {d: e for d, i, e, _ in finder.find(pa.array([" ".join(w) for w in docs])) if d == i}
    for d in list(got)[:3]:
        assert got[d] == within(items[d], docs[d])
    return len(got) / times


def test_no_exact_copy_of_a_long_item_is_missed():
    for n in (200, 400, 700, 1000):
        assert recall(n, 0) == 1


def test_edited_copies_of_long_items():
    for n in (200, 400, 1000):
        assert recall(n, 0.05) == 1
        assert recall(n, 0.1) >= 0.98
