"""Shared helpers: column checks, checkpoints in the shared folder, byte-bounded batches."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are handled in slices of about so many bytes, so that a Python worker's memory doesn't depend on the row width.
SLICE_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> None:
    """See to it that checkpoint() works: the cluster's spark.checkpoint.dir; where none is set, a folder of this machine in local mode (tests) and an error on a cluster."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there; a lost executor doesn't lose it."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, for a table that is written in parts."""
    shared_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Let Spark remove shuffle files that nothing refers to any more: after a cut, all that led to it. Else they stay until the driver's JVM happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def rows_a_batch(spark: SparkSession, most: int) -> Iterator[None]:
    """Plans that run inside pass at most so many rows at a time to Python; for wide rows, of which the default number takes much memory outside the JVM's heap."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, most if int(before) <= 0 else min(most, int(before)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id"):
    """True where crc32(doc_id as text) mod 4 is 2; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def py_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


#: A key that so large a share of all rows has is hot; there are no more than 1 / HOT_KEYS such keys.
HOT_KEYS = 1e-4


def looked_up(rows: DataFrame, found: DataFrame, keys: list[str], often: str, spread: list[str]) -> DataFrame:
    """rows, left-joined to found by its keys (unique, none null). `often` of found says how many rows have a key.

    Keys of HOT_KEYS of all rows or more are broadcast, of which the bound is in their number. Rows that have met one of them take no
    part in the second join's keys but are spread by the hash of other columns, so that no task gets a hot key's rows.
    """
    found = cut(found)
    least = max(1.0, (found.agg(F.sum(often)).first()[0] or 0) * HOT_KEYS)
    values = [c for c in found.columns if c not in (*keys, often)]
    hot = found.filter(F.col(often) >= least).select(*keys, F.lit(1).alias("__hot"), *[F.col(c).alias(f"__hot_{c}") for c in values])
    cold = found.filter(F.col(often) < least).select(*keys, F.lit(0).alias("__salt"), *[F.col(c).alias(f"__cold_{c}") for c in values])
    met = rows.join(F.broadcast(hot), keys, "left").withColumn("__salt", F.when(F.col("__hot").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(*spread), F.lit(1 << 30))).cast("int"))
    met = met.join(cold, [*keys, "__salt"], "left")
    return met.select(*rows.columns, *[F.when(F.col("__hot").isNull(), F.col(f"__cold_{c}")).otherwise(F.col(f"__hot_{c}")).alias(c) for c in values])


def sampled(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """About `most` rows (all, if there are no more), those of small hashes of their keys, each key once: bounded however many rows there are or share a key, and the same on every run."""
    n = rows.count()
    if n > most:
        rows = rows.filter(F.xxhash64(*keys).bitwiseAND(F.lit((1 << 31) - 1)) < int(most / n * (1 << 31)))
    return rows.dropDuplicates(keys)


def chunks(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts cut at ASCII white space: the distinct chunks, the number of each chunk in a row, and where each text begins (one more at the end)."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = parts.flatten().dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), parts.offsets.to_numpy() - parts.offsets[0].as_py()


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that column holds about `limit` bytes in each; a longer value comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        yield batch.slice(start)
