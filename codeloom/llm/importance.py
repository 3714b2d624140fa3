"""Resampling of documents towards a target distribution, by hashed n-gram features and a dictionary of the distinct ones.

The n-grams of all texts are counted as strings, each distinct one is hashed to a bucket once, and buckets are summed.
A bucket's gain is how much likelier the target makes it than the documents do, in thousandths of a nat. Gains go back to the
strings, and from there to each document's own counts of them, whose sum is its weight. With one Gumbel number a document,
drawn from a hash of its id, the highest scores are a sample without replacement in proportion to exp(weight / 1000).

The dictionary grows with the corpus and stays distributed. Strings that make up HOT_SHARE of all n-grams (so no more than
1 / HOT_SHARE of them) go to the tasks that count a document, where they are summed at once; all others meet the
dictionary in a join, in which no key is common. A string of over LONG bytes stands there as its SHA-256. Ranks come from a
range-partitioned order and the sizes of its partitions, without sorting anything in one task.

Defined results: a null or empty text, and one without words, has no features and weight 0; a null doc_id is drawn like
an empty one and comes last among ties; each row is a document of its own, so repeated rows have equal weights and
scores, and neighbouring ranks; documents of fewer than `least` words are scored but never drawn; other columns are
ignored. Without documents there are no rows; without a target all gains follow from the documents alone.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import cut, scratch, slices

HOT_SHARE = 1e-5
LONG = 32
#: Features of a document in one row, at most.
WIDE = 4096
#: A-Z to a-z; what is neither a letter nor a digit of ASCII, nor beyond it, to a space.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_WORDS).split() if text else []


def features(found: list[bytes], longest: int) -> Iterator[bytes]:
    """All runs of 1 to `longest` words."""
    yield from found
    for n in range(2, longest + 1):
        yield from (b" ".join(found[i : i + n]) for i in range(len(found) - n + 1))


def short(feature: bytes) -> bytes:
    """A feature as a key of bounded length; no feature holds a zero byte."""
    return feature if len(feature) <= LONG else b"\0" + hashlib.sha256(feature).digest()


def counted(docs: DataFrame, longest: int, text: str = "text") -> DataFrame:
    """docs → feature, c: counts of slices of the texts, still to be added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            c = Counter()
            for t in b.column(text).to_pylist():
                c.update(features(words(t), longest))
            yield pa.RecordBatch.from_arrays([pa.array(c.keys(), pa.binary()), pa.array(c.values(), pa.int64())], ["feature", "c"])

    return docs.select(text).mapInArrow(run, "feature binary, c long")


def dictionary(docs: DataFrame, target: DataFrame, longest: int, buckets: int, text: str = "text") -> DataFrame:
    """Every distinct feature of the documents → key, often (its count there), gain (of its bucket)."""
    both = counted(docs, longest, text).select("feature", F.col("c").alias("s"), F.lit(0).cast("long").alias("t"))
    both = both.unionByName(counted(target, longest, text).select("feature", F.lit(0).cast("long").alias("s"), F.col("c").alias("t")))
    key = F.when(F.length("feature") <= LONG, F.col("feature")).otherwise(F.concat(F.unhex(F.lit("00")), F.unhex(F.sha2("feature", 256))))
    found = both.groupBy("feature").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    found = cut(found.select(key.alias("key"), (F.crc32("feature") % buckets).alias("bucket"), "s", "t"))
    summed = found.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    all_s, all_t = (x or 0 for x in found.agg(F.sum("s"), F.sum("t")).first())
    share = ((F.col("t") + 1).cast("double") * F.lit(float(all_s + buckets))) / ((F.col("s") + 1).cast("double") * F.lit(float(all_t + buckets)))
    gains = F.broadcast(summed.select("bucket", F.floor(1000 * F.log(share)).alias("gain")))  # one row a bucket
    return found.filter("s > 0").join(gains, "bucket").select("key", F.col("s").alias("often"), "gain")


def weighed(docs: DataFrame, known: DataFrame, longest: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs, dictionary → row, key, n_words, n_features, weight."""
    spark = docs.sparkSession
    known = cut(known)
    total = known.agg(F.sum("often")).first()[0] or 0
    # At most 1 / HOT_SHARE keys of bounded length.
    common = {bytes(r.key): r.gain for r in known.filter(F.col("often") >= max(1.0, total * HOT_SHARE)).select("key", "gain").collect()}
    shared = spark.sparkContext.broadcast(common)
    id_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain, row = shared.value, TaskContext.get().partitionId() << 33
        for b in slices(batches, text):
            rows, at = [], []
            for i, t in enumerate(b.column(text).to_pylist()):
                found = words(t)
                c = Counter(features(found, longest))
                weight, rest = 0, []
                for f, n in c.items():
                    k = short(f)
                    g = gain.get(k)
                    if g is None:
                        rest.append((k, n))
                    else:
                        weight += g * n
                for j in range(0, max(1, len(rest)), WIDE):
                    part = rest[j : j + WIDE]
                    rows.append((row, j == 0, len(found), sum(c.values()), weight, [k for k, _ in part], [n for _, n in part]))
                    at.append(i)
                row += 1
            kinds = pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64())
            columns = [pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(at)), *columns], [key, "row", "first", "n_words", "n_features", "weight", "features", "counts"])

    folder = scratch(spark, "features")
    docs.select(key, text).mapInArrow(run, f"{key} {id_type}, row long, first boolean, n_words long, n_features long, weight long, features array<binary>, counts array<long>").write.parquet(folder)
    parts = spark.read.parquet(folder)
    rest = parts.select("row", F.explode(F.arrays_zip("features", "counts")).alias("f")).select("row", F.col("f.features").alias("key"), F.col("f.counts").alias("c"))
    added = rest.join(known.select(F.col("key"), "gain"), "key").groupBy("row").agg(F.sum(F.col("gain") * F.col("c")).alias("rest"))
    whole = parts.filter("first").select("row", key, "n_words", "n_features", "weight").join(added, "row", "left")
    return whole.select("row", key, "n_words", "n_features", (F.col("weight") + F.coalesce("rest", F.lit(0))).alias("weight"))


def numbered(rows: DataFrame, order: list, most: int) -> DataFrame:
    """rows → rows with `rank`, their places 1 to `most` in that order, of all rows; others are left out."""
    if not most:
        return rows.withColumn("rank", F.lit(None).cast("long")).filter(F.lit(False))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    sizes = {r.part: r["count"] for r in dealt.groupBy("part").count().collect()}  # one row a partition
    before, at = [], 0
    for p in sorted(sizes):
        if at < most:
            before.append((p, at))
        at += sizes[p]
    starts = F.broadcast(rows.sparkSession.createDataFrame(before, "part int, before long"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(*order)).cast("long")
    return dealt.join(starts, "part").withColumn("rank", F.col("before") + rank).filter(F.col("rank") <= most).drop("part", "before")


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, least: int = 20, percent: int = 10, seed: int = 2024, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs → key, n_features, weight, score, rank: 1, 2, 3 ... of the `percent` per cent drawn of the documents of `least` words or more, else null."""
    known = dictionary(docs, target, longest, buckets, text)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / float(1 << 32))))
    scored = cut(weighed(docs, known, longest, text, key).withColumn("score", F.col("weight") + gumbel))
    able = scored.filter(F.col("n_words") >= least).select("row", key, "n_features", "score")
    order = [F.desc("score"), F.asc_nulls_last(key), F.asc("n_features"), F.asc("row")]
    drawn = numbered(able, order, math.floor(percent * able.count() / 100))
    return scored.join(drawn.select("row", "rank"), "row", "left").select(key, "n_features", "weight", "score", "rank")


def oracle(buckets: int = 10_000, least: int = 20, percent: int = 10, seed: int = 2024) -> str:
    """The same for single words, as SQL for DuckDB over `documents` and `benchmark`; CRC-32 byte by byte, from its polynomial."""
    found = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {found.format("coalesce(text, '')")} AS w FROM documents),
f AS (SELECT r, f, count(*) AS c FROM (SELECT r, unnest(w) AS f FROM d) GROUP BY r, f),
b AS (SELECT f, count(*) AS c FROM (SELECT unnest({found.format("coalesce(text, '')")}) AS f FROM benchmark) GROUP BY f),
u AS MATERIALIZED (SELECT f, sum(s)::BIGINT AS s, sum(t)::BIGINT AS t, hex(f) AS h FROM (SELECT f, c AS s, 0 AS t FROM f UNION ALL SELECT f, 0, c FROM b) GROUP BY f),
bit(i, c, k) AS (SELECT range, range, 0 FROM range(256) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, k + 1 FROM bit WHERE k < 8),
crc(f, h, p, c) AS (SELECT f, h, 0, 4294967295::BIGINT FROM u UNION ALL
  SELECT f, h, p + 1, xor(crc.c >> 8, bit.c) FROM crc JOIN bit ON bit.k = 8 AND bit.i = xor(crc.c & 255, 16 * (strpos('0123456789ABCDEF', substr(h, 2 * p + 1, 1)) - 1) + strpos('0123456789ABCDEF', substr(h, 2 * p + 2, 1)) - 1) WHERE 2 * p < len(h)),
v AS MATERIALIZED (SELECT u.*, xor(c, 4294967295::BIGINT) % {buckets} AS bucket FROM u JOIN crc USING (f) WHERE 2 * p = len(u.h)),
n AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM v),
g AS (SELECT bucket, floor(1000 * ln(((sum(v.t) + 1)::DOUBLE * (any_value(n.s) + {buckets})::DOUBLE) / ((sum(v.s) + 1)::DOUBLE * (any_value(n.t) + {buckets})::DOUBLE)))::BIGINT AS gain FROM v, n GROUP BY bucket),
w AS (SELECT r, sum(c)::BIGINT AS n_features, sum(c * gain)::BIGINT AS weight FROM f JOIN v USING (f) JOIN g USING (bucket) GROUP BY r),
x AS (SELECT doc_id, len(w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, list_reduce(list_transform(string_split(substr(sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 8), ''), lambda c: strpos('0123456789abcdef', c) - 1), lambda a, c: 16 * a + c)::BIGINT AS h FROM d LEFT JOIN w USING (r)),
y AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score, count(*) FILTER (words >= {least}) OVER () AS n FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY words >= {least} ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place FROM y)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN words >= {least} AND place <= floor({percent} * n / 100) THEN place END AS rank FROM z"""
