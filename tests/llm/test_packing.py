import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from codeloom.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", None, " \n", "Hello WORLD it's 42 <|endoftext|>x", "é É é́   wide space \x1c sep Σας", "a" * 5000, "one two three " * 900, "tie", "tie"]


def check(spark, rows, capacity):
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, length int")
    got = packing.pack(docs, PATH, capacity).collect()
    t = Tokenizer.from_file(PATH)
    want = []
    for d, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), capacity):
            part = np.array(ids[k : k + capacity], "<u4")
            want.append((d, k // capacity, k, len(part), zlib.crc32(part.tobytes())))
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:5]) for r in got)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(r.length for r in got)


def test_pieces_and_layout(spark):
    r = random.Random(1)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, "again"), (3, "again")]
    rows += [(100 + i, " ".join(r.choice(["the", "of", "xyzzy"]) for _ in range(r.randrange(60)))) for i in range(200)]
    n, total = check(spark, rows, 64)
    assert n <= total / 64 * 1.02 + 1


def test_ids_of_letters_that_change_under_the_normaliser(spark):
    r = random.Random(7)
    signs = list("abÉéİıKÅΣσßﬁ.,.,  \n'!?0") + ["e\u0301", "क़", "שׁ", "ড়", "\u0301", "\u0307", "Ꭰ", "ⓐ", "ǅ", "\u1e9e", "\u00a0", "\u2003", "한", "각"]
    rows = [(0, "İ. a"), (1, "क़. a"), (2, "שׁ, b"), (3, "é. b"), (4, "e\u0301. b"), (5, "K. x A. y"), (6, "it's. 'S. x")]
    rows += [(10 + i, "".join(r.choice(signs) for _ in range(r.randrange(40)))) for i in range(2500)]
    check(spark, rows, 64)


def test_every_letter_that_marks_are_cut_from():
    import pyarrow as pa

    t, encoder = Tokenizer.from_file(PATH), packing.ChunkEncoder(PATH)
    letters = [chr(c) for c in range(0x41, 0x250) if chr(c).isalpha()]
    texts = [f"x{c}{m} a {c}{m}\n{c}" for c in letters for m in ".,"]
    ids, sizes = encoder.encode(pa.array(texts))
    assert ids.tolist() == [i for x in texts for i in t.encode(x, add_special_tokens=False).ids]
    assert sizes.tolist() == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]


def test_marks_are_left_alone_in_other_vocabularies():
    assert packing._marks_apart(PATH) and not packing._marks_apart(public_tokenizers.path("byte_bpe_50k.json"))


def test_empty_table(spark):
    assert check(spark, [], 64) == (0, 0)


def test_plan_is_tight_and_whole():
    r = random.Random(2)
    for capacity in (50, 2048):
        counts = defaultdict(int)
        for _ in range(3000):
            counts[min(capacity, int(r.expovariate(3 / capacity)) + 1)] += 1
        runs = packing.plan(counts, capacity)
        seen, load = defaultdict(list), defaultdict(int)
        for length, lo, hi, base, _ in runs:
            seen[length] += range(lo, hi)
            for k in range(hi - lo):
                load[base + k] += length
        assert {x: sorted(v) for x, v in seen.items()} == {x: list(range(n)) for x, n in counts.items()}
        assert max(load.values()) <= capacity
        assert len(load) <= -(-sum(x * n for x, n in counts.items()) // capacity) + 2


def test_fullest_is_optimal():
    import itertools

    r = random.Random(3)
    for _ in range(50):
        items = [r.randrange(1, 30) for _ in range(8)]
        left = {x: items.count(x) for x in set(items)}
        room = r.randrange(1, 60)
        best = max(s for n in range(9) for c in itertools.combinations(items, n) if (s := sum(c)) <= room)
        got = packing.fullest(left, room)
        assert sum(got) == best and all(got.count(x) <= left[x] for x in got)
