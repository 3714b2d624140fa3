"""Empty tables, clashing column names and very long texts where the operators' own tests have none."""

import public_tokenizers

from codeloom.llm import decontamination as dec
from codeloom.llm import packing, substrings, token_counts

ITEM = "what is the boiling point of water at the top of this mountain"


def tables(spark):
    docs = spark.createDataFrame([(1, f"intro {ITEM} outro", 7, "x", 1, "y"), (2, None, 7, "x", 1, "y"), (3, "", 7, "x", 1, "y")], "doc_id long, text string, n_tokens int, edits string, start int, piece string")
    bench = spark.createDataFrame([(5, ITEM, "z"), (6, None, "z")], "item_id long, text string, doc_id string")
    return docs, bench


def test_empty_tables_of_decontamination(spark):
    docs, bench = tables(spark)
    for d, b in ((docs.limit(0), bench), (docs, bench.limit(0)), (docs.limit(0), bench.limit(0)), (docs, bench.filter("item_id = 6"))):
        assert dec.contaminated(d, b).count() == 0
        assert dec.without_contaminated(d, b).count() == d.count()


def test_clashing_names(spark):
    docs, bench = tables(spark)
    assert [(r.doc_id, r.item_id, r.edits) for r in dec.contaminated(docs, bench).collect()] == [(1, 5, 0)]
    assert {r.doc_id for r in dec.without_contaminated(docs, bench).collect()} == {2, 3}
    counted = token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert {r.doc_id: r.n_tokens > 0 for r in counted} == {1: True, 2: False, 3: False}
    assert {r.doc_id for r in substrings.dedup(docs, keep_text=False).collect()} == {1, 2, 3}
    assert {r.doc_id for r in packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).collect()} == {1, 2, 3}


def test_an_item_at_the_end_of_a_very_long_text(spark):
    _, bench = tables(spark)
    filler = " ".join(f"w{i % 5003}" for i in range(200_000))
    docs = spark.createDataFrame([(1, f"{filler} {ITEM}"), (2, filler), (3, filler + "x" * 100_000)], "doc_id long, text string")
    assert [(r.doc_id, r.end_word) for r in dec.contaminated(docs, bench).collect()] == [(1, 200_000 + len(ITEM.split()))]
    assert {r.doc_id for r in dec.without_contaminated(docs, bench).collect()} == {2, 3}
    # Of two texts that are the same but for the last word, the second keeps that word alone; within a text, its own repeats stay.
    left = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.dedup(docs, keep_text=False).collect()}
    assert left[1] == (200_000 + len(ITEM.split()), 0) and left[2] == (200_000, 200_000) and left[3] == (200_000, 199_999)
