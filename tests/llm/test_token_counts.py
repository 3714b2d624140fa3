import random
import string
import time

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from codeloom.llm import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", None, " ", "\n\n \t x", "it's we'll I'M", "a<|endoftext|>b <|endoftext|>", "<|endoftext|><|endoftext|>", "é é İ. a क़. a שׁ, b", "日本語のテキスト", "😀😀👩‍👩‍👧", "\x00\x1c   end", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa",
    "12345 67 ²³ Ⅷ", "tie", "tie", "x" * 30_000, "ab " * 40_000, " " * 5000 + "z",
]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return lambda text: len(t.encode(text or "", add_special_tokens=False).ids)


def test_query_equals_the_library(spark, library):
    r = random.Random(4)
    signs = [chr(r.choice([r.randrange(32, 127), r.randrange(160, 0x2FFF), r.randrange(0x1F300, 0x1F700)])) for _ in range(400)] + list(" \n'eainst")
    rows = [(i, t, 9) for i, t in enumerate(TEXTS)] + [(None, "no id", 9), (3, "again", 9), (3, "again", 9)]
    rows += [(100 + i, "".join(r.choice(signs) for _ in range(r.randrange(80))), 9) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(5)
    got = sorted(map(str, token_counts.count_tokens(docs, PATH, 512).collect()))
    want = [(d, len((t or "").encode()), n := library(t), n > 512) for d, t, _ in rows]
    assert got == sorted(f"Row(doc_id={d}, n_bytes={b}, n_tokens={n}, over_limit={o})" for d, b, n, o in want)


def test_whole_table_equals_the_library(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, PATH).collect()}
    assert got == {d: library(t) for d, t in text.items()}


def test_limit_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "one two three")], "doc_id int, text string")
    assert [r.over_limit for n in (2, 3) for r in token_counts.count_tokens(docs, PATH, n).collect()] == [True, False]
    assert token_counts.count_tokens(docs.limit(0), PATH).count() == 0


def test_cache_is_dropped_without_changing_counts(library, monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE_ENTRIES", 5)
    counter = token_counts.TokenCounter(PATH)
    texts = [f"word{i} and other things {i * 7}" for i in range(60)]
    assert [n for k in range(0, 60, 9) for n in counter.count(texts[k : k + 9])] == list(map(library, texts))


def test_long_pre_tokens_of_many_letters(library):
    r = random.Random(5)
    text = "".join(r.choices(string.ascii_letters, k=1_000_000))
    counter = token_counts.TokenCounter(PATH)
    began = time.time()
    assert counter.count([text]) == [library(text)]
    assert time.time() - began < 20  # about 4 on a free machine; passes over everything would take many minutes


def test_both_ways_of_merging_agree(library, monkeypatch):
    r = random.Random(6)
    signs = "aaaabtheing ing  e日é=="
    texts = ["".join(r.choices(signs, k=r.randrange(1, 400))) for _ in range(300)] + ["ab" * 900, "a" * 1001, "aab" * 333, "", " " * 777, "=" * 600 + "a"]
    want = list(map(library, texts))
    for most in (0, 1, 5, 40, 10_000):
        monkeypatch.setattr(token_counts, "LONG", most)
        assert token_counts.TokenCounter(PATH).count(texts) == want
