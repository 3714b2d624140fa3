"""Compression of vectors to integer product codes: equal parts once, as weighted distinct rows.

A vector's components become integers and are cut into equal consecutive parts. Equal parts of a position are one row with a
weight. Lloyd's rounds run over those rows: tasks assign them to the nearest entries and hand on counts and sums of
an entry, of which the driver gets parts × entries × width numbers a round and makes the next codebook, all in integers.
At last each distinct part's code and error are joined back to the vectors. Parts that make up HOT_SHARE of their
position's weight meet the vectors in a broadcast, so a part that a third of all vectors have is no hot key.

Defined results: rows whose vector is null or holds null or non-finite components are left out; zero vectors stay.
Scaled components beyond ±2^26 count as that bound, which keeps squared sums within 64 bits. Vectors shorter than the
longest, or than what `parts` divides, end in zeros. A codebook starts with the smallest distinct ids, null last, of rows that
repeat an id with the least vector; of fewer ids than entries it has fewer entries. Ties go to the lower entry; unused
entries stay. Repeated rows each give a row; null labels are equal; other columns are ignored. No rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import cut, looked_up

BOUND = 1 << 26
#: Parts compared with the codebook at a time.
ROWS = 4096


def integers(vectors: DataFrame, scale: int, parts: int, key: str, vector: str, label: str) -> tuple[DataFrame, int]:
    """vectors → row, key, label, q (big-endian 32-bit integers, all of one length), and the width of a part."""
    v = F.col(vector)
    fit = vectors.select(F.col(key).alias("key"), F.col(label).alias("label"), v.alias("v")).filter(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    width = -(-(fit.agg(F.max(F.size("v"))).first()[0] or 0) // parts)
    types = {f.name: f.dataType.simpleString() for f in fit.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v")
            flat, at = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64), v.offsets.to_numpy() - v.offsets[0].as_py()
            sizes = np.diff(at)
            q = np.zeros((b.num_rows, width * parts), ">i4")
            q[np.repeat(np.arange(b.num_rows), sizes), np.arange(len(flat)) - np.repeat(at[:-1], sizes)] = np.clip(np.floor(flat * scale), -BOUND, BOUND)
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("label"), pa.array([x.tobytes() for x in q], pa.binary())], ["key", "label", "q"])

    made = fit.mapInArrow(run, f"key {types['key']}, label {types['label']}, q binary")
    return cut(made.withColumn("row", F.monotonically_increasing_id())), width


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">i4").astype(np.int64).reshape(len(column), width)


def _near(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest entry, of equally near ones the first, and its squared distance, in integers."""
    d = np.stack([((x - e) ** 2).sum(1) for e in book], 1)
    code = d.argmin(1)
    return code, d[np.arange(len(x)), code]


def _runs(b: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """position, places in the batch and parts, ROWS at a time."""
    pos, x = b.column("pos").to_numpy(), _matrix(b.column("part"), width)
    for p in np.unique(pos):
        at = np.flatnonzero(pos == p)
        for i in range(0, len(at), ROWS):
            yield int(p), at[i : i + ROWS], x[at[i : i + ROWS]]


def improved(distinct: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round over the distinct parts (pos, part, often): each entry becomes the floor of its parts' mean."""
    parts, entries, width = books.shape
    shared = distinct.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, entries, width + 1), object)  # Python integers, so no sum overflows
        for b in batches:
            often = b.column("often").to_numpy()
            for p, at, x in _runs(b, width):
                code, _ = _near(x, shared.value[p])
                for k in np.unique(code):
                    mine = code == k
                    n = often[at[mine]]
                    if int(n.max()) < 1 << 24:  # ROWS of them stay within 64 bits
                        sums[p, k, :width] += (x[mine] * n[:, None]).sum(0)
                    else:
                        sums[p, k, :width] += (x[mine].astype(object) * n[:, None].astype(object)).sum(0)
                    sums[p, k, width] += int(n.sum())
        p, k, j = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(p * entries + k, pa.int64()), pa.array(j, pa.int64()), pa.array([str(int(x)) for x in sums[p, k, j]])], ["entry", "j", "x"])

    total = np.zeros((parts * entries, width + 1), object)
    found = distinct.mapInArrow(run, "entry long, j long, x string").groupBy("entry", "j").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    for r in found.collect():  # parts × entries × (width + 1) numbers at most
        total[r.entry, r.j] = int(r.x)
    out = books.copy().reshape(parts * entries, width)
    for e in range(len(out)):
        if total[e, width]:
            out[e] = [int(x) // int(total[e, width]) for x in total[e, :width]]
    return out.reshape(books.shape)


def coded(distinct: DataFrame, books: np.ndarray) -> DataFrame:
    """distinct parts → pos, part, often, code, error."""
    width, shared = books.shape[2], distinct.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, error = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows, np.int64)
            for p, at, x in _runs(b, width):
                code[at], error[at] = _near(x, shared.value[p])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(code), pa.array(error)], [*b.schema.names, "code", "error"])

    return distinct.select("pos", "part", "often").mapInArrow(run, "pos int, part binary, often long, code int, error long")


def compress(vectors: DataFrame, scale: int = 4096, parts: int = 8, entries: int = 16, rounds: int = 6, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vectors → key, label, code, error, label_error, codebooks_sha256."""
    spark = vectors.sparkSession
    whole, width = integers(vectors, scale, parts, key, vector, label)
    first = whole.select("key").distinct().orderBy(F.asc_nulls_last("key")).limit(entries)
    rows = whole.join(F.broadcast(first), whole["key"].eqNullSafe(first["key"]), "left_semi").groupBy("key").agg(F.min("q").alias("q")).orderBy(F.asc_nulls_last("key")).collect()
    books = np.frombuffer(b"".join(bytes(r.q) for r in rows), ">i4").astype(np.int64).reshape(len(rows), parts, width).transpose(1, 0, 2).copy()
    cutout = F.posexplode(F.array(*[F.substring("q", 4 * width * p + 1, 4 * width) for p in range(parts)])).alias("pos", "part")
    placed = whole.select("row", cutout)
    distinct = cut(placed.groupBy("pos", "part").agg(F.count(F.lit(1)).alias("often")))
    if rows:
        for _ in range(rounds):
            books = improved(distinct, books)
    sign = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    back = looked_up(placed, coded(distinct, books), ["pos", "part"], "often", spread=["row"])
    hexed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda x: F.lower(F.lpad(F.hex(x["code"]), 2, "0"))), "")
    codes = back.groupBy("row").agg(hexed.alias("code"), F.sum("error").alias("error"))  # `parts` rows each
    done = cut(whole.select("row", "key", "label").join(codes, "row"))
    # A null label is a key like any other.
    named = done.withColumn("__of", F.array(F.col("label")))
    sums = named.groupBy("__of").agg(F.count(F.lit(1)).alias("often"), F.sum("error").alias("label_error"))
    out = looked_up(named, sums, ["__of"], "often", spread=["row"])
    return out.select(F.col("key").alias(key), F.col("label").alias(label), "code", "error", "label_error", F.lit(sign).alias("codebooks_sha256"))


def oracle(scale: int = 4096, parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The same as SQL for DuckDB over `embeddings`, for vectors of one length that `parts` divides: every part of every vector in every round."""
    nearest = "SELECT r, pos, part, entry, dist FROM (SELECT p.*, b.entry, list_sum([(x[1] - x[2]) * (x[1] - x[2]) for x in list_zip(p.part, b.c)])::BIGINT AS dist FROM p JOIN {} b USING (pos)) QUALIFY row_number() OVER (PARTITION BY r, pos ORDER BY dist, entry) = 1"
    steps = []
    for k in range(1, rounds + 1):
        steps.append(f"a{k} AS MATERIALIZED ({nearest.format(f'b{k - 1}')})")
        mean = f"SELECT pos, entry, list(m ORDER BY j) AS c FROM (SELECT pos, entry, j, floor(sum(part[j])::DECIMAL(38,0) / count(*))::BIGINT AS m FROM a{k}, range(1, (SELECT max(len(part)) FROM p) + 1) t(j) GROUP BY pos, entry, j) GROUP BY pos, entry"
        steps.append(f"b{k} AS MATERIALIZED (SELECT o.pos, o.entry, coalesce(n.c, o.c) AS c FROM b{k - 1} o LEFT JOIN ({mean}) n USING (pos, entry))")
    return f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, [floor({scale} * x::DOUBLE)::BIGINT for x in embedding] AS q FROM embeddings WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
p AS MATERIALIZED (SELECT r, vec_id, pos, q[pos * len(q) // {parts} + 1 : (pos + 1) * len(q) // {parts}] AS part FROM k, range({parts}) t(pos)),
s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM (SELECT DISTINCT vec_id FROM k ORDER BY vec_id LIMIT {entries})),
b0 AS MATERIALIZED (SELECT pos, entry, min(part) AS c FROM p JOIN s USING (vec_id) GROUP BY pos, entry),
{", ".join(steps)},
z AS MATERIALIZED ({nearest.format(f"b{rounds}")}),
c AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY pos) AS code, sum(dist)::BIGINT AS error FROM z GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY pos, entry)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM k JOIN c USING (r), h"""
