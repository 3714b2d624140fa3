"""A training-data pipeline over `documents`: each stage is one operator of codeloom.llm, written as Parquet and read again.

Every stage works on all that the one before it kept; the first four return the columns of documents.

1. toxicity: documents that score 0.3 or more go. Learned from the labels of documents that are not held out.
2. SimHash near-dedup: of each group of near duplicates (Jaccard similarity 0.8 of five-word shingles) the smallest id stays.
3. benchmark decontamination: documents that contain a benchmark item go.
4. secret scans: found secrets are replaced by a marker; every document stays.
5. best-fit packing: the token pieces of what is left, with their place in sequences of 2048.

Defined results: an empty table passes through every stage and packs into no rows. A null text is an empty one: it
scores like one, all empty texts are one group of near duplicates, and packs as the separator alone. Rows that repeat
a doc_id are one document, of which one row stays; rows without a doc_id belong to no group and stay. Of a group of
near duplicates the smallest doc_id stays, so ties can't occur. Columns besides those of documents are carried along
to the fourth stage, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import decontamination, packing, secrets, simhash, toxicity
from codeloom.llm.common import held_out, scratch, table

#: Decisions of stages can't be expressed in SQL (a trained classifier, a tokenizer); tests hold them against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.learn(docs, table(spark, sf_dir, "labels").filter(~held_out("doc_id")))
    return toxicity.without_toxic(docs, model, threshold=0.3)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs, shingle=5, radius=4, similarity=0.8, bands=20)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark),
    ("secret scans", redact_secrets),
    ("best-fit packing", pack_sequences),
]


def _remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared store."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between them is written to the shared checkpoint folder, and removed once the next stage is written."""
    folder = scratch(spark, "stages")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                _remove(spark, f"{folder}/{k - 1}")
    return docs
