"""The registered queries of this package: thin bindings of the operators to the tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import ann, importance, secrets, substrings, vector_codes, vector_dedup
from codeloom.llm.ann import nearest
from codeloom.llm.common import table
from codeloom.llm.decontamination import contaminated
from codeloom.llm.html_text import extract
from codeloom.llm.language import identify
from codeloom.llm.packing import pack
from codeloom.llm.simhash import near_duplicates
from codeloom.llm.token_counts import count_tokens
from codeloom.llm.toxicity import toxicity

#: Vocabulary files: read from the installed package on every machine, never copied.
BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents")).drop("found")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3, locate=0.3)
    places = F.transform("offending", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    return found.withColumn("offending", F.array_join(places, ","))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), 512)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(table(spark, sf_dir, "documents"), keep_text=False)


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), 2048)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), longest=1, buckets=10_000, least=20, percent=10, seed=2024)


def op12_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(table(spark, sf_dir, "embeddings"), similarity=0.98)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"), scale=4096, parts=8, entries=16, rounds=6).drop("label")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_language": op2_language,
    "op3_toxicity": op3_toxicity,
    "op4_token_counts": op4_token_counts,
    "op5_decontamination": op5_decontamination,
    "op6_substrings": op6_substrings,
    "op7_nearest": op7_nearest,
    "op8_main_text": op8_main_text,
    "op9_packing": op9_packing,
    "op10_simhash": op10_simhash,
    "op11_resampling": op11_resampling,
    "op12_near_vectors": op12_near_vectors,
    "op13_vector_codes": op13_vector_codes,
}
ORACLES: dict[str, str] = {"op1_secrets": secrets.oracle(), "op6_substrings": substrings.oracle(), "op7_nearest": ann.oracle(), "op11_resampling": importance.oracle(), "op12_near_vectors": vector_dedup.oracle(), "op13_vector_codes": vector_codes.oracle()}
