"""Nearest neighbours by inner product: score-aware anisotropic quantisation, four-bit table scans, exact reranking.

The quantiser is a product code of 16 centres for each pair of dimensions. Both its training and the encoding of a
vector minimise ‖r‖² + (η - 1) ⟨r, x/‖x‖⟩² of the residual r: error along a vector changes the scores that matter
for maximum inner product and costs η times as much. Codebooks are fitted on the driver on a bounded sample (about
SAMPLE rows, those of small hashes of their id); every row is encoded, and the codes stand beside the vectors in the shared folder.

Queries are taken in blocks of about BLOCK, each of which goes to all index rows; per batch of rows, byte tables (two
four-bit codes each) are summed in 16-bit numbers, the RERANK best distinct vectors are scored exactly in double
precision (summed in the order of the components), and each task hands on its `k` best for each query. What a block finds is
written to the shared folder, so that neither the plan nor the driver holds more than one block.

Defined results: vectors null, zero, or with null or non-finite components take no part, as neither do null ids; a
vector is compared with those of its own length, for others there is no inner product; equal vectors are looked at once and stand for all their ids; a repeated row (id and vector)
counts once; of several vectors of one query id the first in order is the query; fewer candidates than k give fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import cut, sampled, scratch

SAMPLE, BLOCK, RERANK = 8_000, 8192, 128
CENTRES, SWEEPS, ROUNDS = 16, 2, 6
#: Inner products under this share of the norm don't matter; gives η = (d - 1) T² / (1 - T²).
THRESHOLD = 0.2
#: Rows scanned, and queries, at a time.
ROWS, WIDE = 4096, 256


class Quantiser:
    """Codebooks of shape (parts, 16, 2); an odd dimension is padded with a zero."""

    def __init__(self, sample: np.ndarray, threshold: float = THRESHOLD, seed: int = 7):
        d = sample.shape[1]
        self.eta = max(1.0, (d - 1) * threshold**2 / (1 - threshold**2))
        x = self._parts(sample)
        rng = np.random.default_rng(seed)
        n, parts = x.shape[:2]
        self.books = x[rng.integers(0, n, CENTRES)].transpose(1, 0, 2).copy() + rng.normal(0, 1e-6, (parts, CENTRES, 2))
        for _ in range(ROUNDS):
            self._fit(x)

    @staticmethod
    def _parts(v: np.ndarray) -> np.ndarray:
        v = np.asarray(v, np.float64)
        if v.shape[1] % 2:
            v = np.pad(v, ((0, 0), (0, 1)))
        return v.reshape(len(v), -1, 2)

    def _start(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest centres, unit vectors, and each residual's product with its unit vector."""
        codes = np.stack([((x[:, m, None] - self.books[m]) ** 2).sum(-1).argmin(1) for m in range(x.shape[1])], 1)
        unit = x / np.sqrt((x**2).sum((1, 2)))[:, None, None]
        along = ((x - self.books[np.arange(x.shape[1]), codes]) * unit).sum((1, 2))
        return codes, unit, along

    def _sweep(self, x, codes, unit, along, fit: bool) -> None:
        """One round over the parts: each code anew with the others held; with fit, each centre as well."""
        for m in range(x.shape[1]):
            book = self.books[m]
            rest = along + (unit[:, m] * book[codes[:, m]]).sum(1) # without this part's centre
            cost = ((x[:, m, None] - book) ** 2).sum(-1) + (self.eta - 1) * (rest[:, None] - unit[:, m] @ book.T) ** 2
            codes[:, m] = cost.argmin(1)
            if fit:
                for k in range(CENTRES):
                    at = codes[:, m] == k
                    if at.any():
                        u = unit[at, m]
                        left = at.sum() * np.eye(2) + (self.eta - 1) * u.T @ u
                        book[k] = np.linalg.solve(left, x[at, m].sum(0) + (self.eta - 1) * rest[at] @ u)
            along[:] = rest - (unit[:, m] * book[codes[:, m]]).sum(1)

    def _fit(self, x: np.ndarray) -> None:
        self._sweep(x, *self._start(x), fit=True)

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """(n, d) → bytes (n, ceil(parts / 2)): two four-bit codes in each."""
        x = self._parts(vectors)
        codes, unit, along = self._start(x)
        for _ in range(SWEEPS):
            self._sweep(x, codes, unit, along, fit=False)
        if codes.shape[1] % 2:
            codes = np.pad(codes, ((0, 0), (0, 1)))
        return (codes[:, ::2] | codes[:, 1::2] << 4).astype(np.uint8)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(bytes, 256, queries) 16-bit: the two parts' products for each byte, in steps of 1/255 of the query's widest part."""
        q = self._parts(queries)
        lut = np.einsum("qmd,mkd->mkq", q, self.books)
        lut -= lut.min(1, keepdims=True)
        lut = np.rint(lut * (255 / np.maximum(lut.max((0, 1)), 1e-300))).astype(np.uint16)
        if len(lut) % 2:
            lut = np.concatenate([lut, np.zeros_like(lut[:1])])
        return (lut[1::2, :, None] + lut[::2, None]).reshape(len(lut) // 2, CENTRES * CENTRES, -1)


def usable(vectors: DataFrame, key: str, vector: str) -> tuple[DataFrame, list[int]]:
    """Rows that take part, as (id, v), and the lengths that occur."""
    v = F.col("v")
    fit = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).filter(F.col("id").isNotNull() & v.isNotNull() & F.exists(v, lambda x: x != 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return fit, sorted(r.d for r in fit.select(F.size("v").alias("d")).distinct().collect())


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, d)


def build_index(fit: DataFrame, d: int, sample: int = SAMPLE) -> tuple[DataFrame, Quantiser]:
    rows = sorted((r.id, r.v) for r in sampled(fit, ["id"], sample).collect())
    if not rows:
        rows = [(r.id, r.v) for r in fit.limit(1).collect()]
    quantiser = Quantiser(np.array([v for _, v in rows], np.float64))
    shared = fit.sparkSession.sparkContext.broadcast(quantiser)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                codes = shared.value.encode(_matrix(b.column("v"), d))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array([c.tobytes() for c in codes], pa.binary())], ["id", "v", "code"])

    return cut(fit.mapInArrow(run, f"id long, v {fit.schema['v'].dataType.simpleString()}, code binary")), quantiser


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(q, r, d) and (q, d) → (q, r): inner products, summed one component after the other, so that they are the same everywhere."""
    total = np.zeros(a.shape[:2])
    for j in range(a.shape[2]):
        total += a[:, :, j] * b[:, None, j]
    return total


def _distinct(ids: np.ndarray, vectors: np.ndarray, keep: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """First places of the distinct vectors, by smallest id, and each one's `keep` smallest ids."""
    order = np.argsort(ids, kind="stable")
    raw = np.ascontiguousarray(vectors[order]).view(np.dtype((np.void, vectors.shape[1] * 8))).ravel()
    _, first, inverse = np.unique(raw, return_index=True, return_inverse=True)
    rank = np.argsort(np.argsort(first))
    by = np.argsort(rank[inverse], kind="stable")
    groups = np.split(ids[order][by], np.cumsum(np.bincount(rank[inverse]))[:-1])
    return order[np.sort(first)], [np.unique(g)[:keep] for g in groups]


def search_block(index: DataFrame, quantiser: Quantiser, d: int, query_ids: np.ndarray, queries: np.ndarray, k: int, rerank: int = RERANK) -> DataFrame:
    """One block of queries against all index rows → (query_id, vec_id, score), up to k of each task."""
    shared = index.sparkSession.sparkContext.broadcast((quantiser, query_ids, queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantiser, query_ids, queries = shared.value
        best: list[list[tuple[float, int]]] = [[] for _ in query_ids]
        tables = [quantiser.tables(queries[i : i + WIDE]) for i in range(0, len(queries), WIDE)]
        for whole in batches:
            for b in (whole.slice(i, ROWS) for i in range(0, whole.num_rows, ROWS)):
                vectors = _matrix(b.column("v"), d)
                places, groups = _distinct(b.column("id").to_numpy(), vectors, k + 1)
                vectors = vectors[places]
                codes = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(b.num_rows, -1)[places]
                least = min(rerank, len(places))
                for at, table in zip(range(0, len(queries), WIDE), tables):
                    total = table[0][codes[:, 0]]
                    for j in range(1, len(table)):
                        total += table[j][codes[:, j]]
                    total = total.T
                    near = np.argpartition(total, len(places) - least, axis=1)[:, len(places) - least :]
                    exact = inner(vectors[near], queries[at : at + WIDE])
                    # By score, then smallest id: the distinct vectors lie in the order of their smallest ids.
                    order = np.lexsort((near, -exact), axis=1)[:, : k + 1]
                    for q, (cols, values) in enumerate(zip(np.take_along_axis(near, order, 1), np.take_along_axis(exact, order, 1))):
                        own, found = query_ids[at + q], best[at + q]
                        if len(found) == k and values[0] < -found[-1][0]:
                            continue
                        found += [(-s, i) for c, s in zip(cols.tolist(), values.tolist()) for i in groups[c].tolist() if i != own]
                        best[at + q] = sorted(set(found))[:k]
        rows = [(q, i, -s) for q, found in zip(query_ids.tolist(), best) for s, i in found]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((), (), ()), (pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    return index.mapInArrow(run, "query_id long, vec_id long, score double")


def _blocks(index: DataFrame, quantiser: Quantiser, d: int, every: int, k: int, rerank: int, block: int) -> Iterator[DataFrame]:
    """(query_id, vec_id, score) of one block of queries after the other."""
    asked = index.filter(F.col("id") % every == 0)
    blocks = max(1, -(-asked.count() // block))
    for n in range(blocks):
        # A block is bounded: its share of the queries by a hash of their ids, of which equal ones are one query.
        share = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == n).groupBy("id").agg(F.min("v").alias("v"))
        rows = sorted((r.id, tuple(r.v)) for r in share.collect())
        if rows:
            yield search_block(index, quantiser, d, np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64), k, rerank)


def nearest(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = 20, rerank: int = RERANK, block: int = BLOCK) -> DataFrame:
    """Queries: rows whose id is divisible by `every`. → query_id, rank (from 1), vec_id, score; ties to the smaller id."""
    spark = vectors.sparkSession
    fit, lengths = usable(vectors, key, vector)
    folder, some = scratch(spark, "nearest"), False
    for d in lengths:
        for part in _blocks(*build_index(fit.filter(F.size("v") == d), d), d, every, k, rerank, block):
            part.write.mode("append").parquet(folder)
            some = True
    if not some:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = spark.read.schema("query_id long, vec_id long, score double").parquet(folder)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.distinct().withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle(every: int = 20, k: int = 20) -> str:
    """The same as SQL for DuckDB over `embeddings`: all inner products, so equal where no neighbour is missed."""
    return f"""
WITH e AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
q AS (SELECT vec_id AS query_id, min(v) AS w FROM e WHERE vec_id % {every} = 0 GROUP BY vec_id),
s AS (SELECT DISTINCT query_id, vec_id, list_inner_product(v, w) AS score FROM q JOIN e ON vec_id <> query_id AND len(v) = len(w))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s QUALIFY rank <= {k}"""
