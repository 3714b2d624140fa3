"""Near-duplicate vectors of a label by counting collisions in windows of one-dimensional projections.

Equal vectors of a label are one class first, so copies are never compared. A class is projected to COUNTED directions,
orthogonal as far as there are dimensions. Those that meet in a cell are sorted by one projection; around each of
them, a window over the sorted values and windows over all other projections are laid, and a pair that lies in each other's windows of
enough projections is a candidate, of which the cosine is computed in double precision. How many are enough is calibrated: among
random pairs of exactly the least similarity no more than MISSED fail to reach the count (the closer a pair, the fewer).

Cells: a label's classes are one cell while they are about CELL or fewer. For larger labels a cell is what also agrees in
`depth` coarse steps of further projections, in several tables, whose numbers follow from the largest label's count and
APART. Pairs that share several tables count in the first only. A cell of over SHARE classes (near copies, which no
direction tells apart) is dealt to shares by a hash, and each two shares are a group of their own, so a task holds two shares at
most. Groups hand on numbers of links by class and, of the links, only the edges that keep together what they connect: the
links of a group are never listed. The comparisons of classes that all lie within each other's windows grow with the square of their number,
as their links do.

Defined results: vectors that are null, zero, or hold null or non-finite components link with nothing, nor do rows with a null label
or a null id; each is its own component. Vectors of different lengths don't link. Each row is a vector, so a
repeated row links with its copies; rows that repeat an id share its component. A null id has no component and is kept. Values
are scaled by a power of two before squaring, which changes no cosine. Other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import cut, looked_up
from codeloom.llm.components import components

COUNTED, MISSED = 24, 1e-4
#: Of pairs of the least similarity, those that may share no table.
APART = 1e-6
CELL, SHARE = 4096, 4096
#: Half the width of a window, and of that over the sorted projection, and the coarse step, in standard deviations of a pair of the least similarity.
WINDOW, SORTED, STEP = 3.0, 4.0, 20.0
#: Rows at a time against what lies in their windows, and pairs whose cosine is computed at a time.
ROWS, PAIRS = 128, 16384


class Windows:
    """Directions, windows and the least count for vectors of d components and a least cosine; the same on every run."""

    def __init__(self, d: int, similarity: float, largest: int, seed: int = 12):
        rng = np.random.default_rng([seed, d])
        self.d, self.similarity = d, similarity
        self.directions = np.concatenate([np.linalg.qr(rng.normal(size=(d, d)))[0] for _ in range(-(-COUNTED // d))])[:COUNTED].T.copy()
        distance = math.sqrt(max(0.0, 2 - 2 * similarity))
        spread = distance / math.sqrt(d)
        self.window, self.sorted = WINDOW * spread + 1e-6, min(SORTED * spread, distance) + 1e-6
        # Differences of random pairs of that distance: a random direction of that length, against the fixed projections.
        away = rng.normal(size=(200_000, d))
        away *= distance / np.linalg.norm(away, axis=1)[:, None]
        apart = np.abs(away @ self.directions)
        misses = (apart > self.window).sum(1)
        misses[apart[:, 0] > self.sorted] = COUNTED
        self.least = COUNTED - max(int(np.quantile(misses, 1 - MISSED, method="higher")), 0)
        # Coarse steps: the chance that a pair of the least similarity agrees in one, and that a random pair does.
        step = STEP * spread + 1e-6
        agree = 1 - min(spread * math.sqrt(2 / math.pi) / step, 0.99)
        other = np.abs(rng.normal(size=100_000)) * math.sqrt(2 / d)
        chance = float(np.clip(1 - other / step, 1e-3, 1).mean())
        self.depth = max(0, math.ceil(math.log(max(1, largest) / CELL) / -math.log(min(chance, 0.999)))) if largest > CELL else 0
        self.tables = math.ceil(math.log(APART) / math.log1p(-(agree**self.depth))) if self.depth else 1
        coarse = rng.normal(size=(d, self.tables * self.depth))
        self.coarse, self.offsets, self.step = coarse / np.maximum(np.linalg.norm(coarse, axis=0), 1e-12), rng.uniform(0, 1, self.tables * self.depth), step
        self.mixers = rng.integers(1, 1 << 62, max(1, self.depth)) * 2 + 1

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """(n, tables): a number for what a vector agrees in, for each table."""
        if not self.depth:
            return np.zeros((len(unit), 1), np.int64)
        steps = np.floor(unit @ self.coarse / self.step + self.offsets).astype(np.int64).reshape(len(unit), self.tables, self.depth)
        with np.errstate(over="ignore"):
            h = np.zeros(steps.shape[:2], np.int64)
            for k in range(self.depth):
                h = (h ^ steps[:, :, k]) * self.mixers[k]
                h ^= h >> 29
        return h

    def candidates(self, unit: np.ndarray, side: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places in enough of each other's windows, each once; with sides, of different sides only."""
        p = (unit @ self.directions).astype(np.float32)
        order = np.argsort(p[:, 0], kind="stable")
        p = p[order]
        side = None if side is None else side[order]
        allowed = COUNTED - self.least
        for lo in range(0, len(p), ROWS):
            hi = min(lo + ROWS, len(p))
            end = int(np.searchsorted(p[:, 0], p[hi - 1, 0] + np.float32(self.sorted), "right"))
            misses = np.zeros((hi - lo, end - lo), np.uint8)
            for j in range(8):
                misses += np.abs(p[lo:hi, j, None] - p[None, lo:end, j]) > self.window
            ok = (misses <= allowed) & (np.arange(lo, end)[None] > np.arange(lo, hi)[:, None]) & (p[None, lo:end, 0] - p[lo:hi, 0, None] <= self.sorted)
            if side is not None:
                ok &= side[None, lo:end] != side[lo:hi, None]
            a, b = np.nonzero(ok)
            missed, a, b = misses[a, b], a + lo, b + lo
            for i in range(0, len(a), PAIRS):
                x, y = a[i : i + PAIRS], b[i : i + PAIRS]
                enough = missed[i : i + PAIRS] + (np.abs(p[x, 8:] - p[y, 8:]) > self.window).sum(1) <= allowed
                if enough.any():
                    yield order[x[enough]], order[y[enough]]


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of pairs of rows, in double precision, one component after the other."""
    xy, xx, yy = (np.zeros(len(x)) for _ in range(3))
    for j in range(x.shape[1]):
        xy += x[:, j] * y[:, j]
        xx += x[:, j] * x[:, j]
        yy += y[:, j] * y[:, j]
    return xy / np.sqrt(xx * yy)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node that it is connected with."""
    root = np.arange(n)
    while len(a):
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while (root[root] != root).any():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def classes(vectors: DataFrame, key: str, vector: str, label: str) -> tuple[DataFrame, DataFrame]:
    """vectors → rows (row, id, same: a hash of label and vector, null where it links with nothing), and one row for each same: id, label, v, often."""
    v = F.col("v")
    fit = v.isNotNull() & F.col("id").isNotNull() & F.col("label").isNotNull() & F.exists(v, lambda x: x != 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(key).alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("v")).withColumn("v", F.when(fit, v))
    id_type, kind = rows.schema["id"].dataType.simpleString(), np.float32 if rows.schema["v"].dataType.elementType.simpleString() == "float" else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, same = [], []
            for name, v in zip(b.column("label").to_pylist(), b.column("v")):
                x = v.values.to_numpy(zero_copy_only=False).astype(kind).tobytes() if v.is_valid else None
                raw.append(x)
                same.append(None if x is None else hashlib.sha256(name.encode() + b"\0" + x).digest())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(raw, pa.binary()), pa.array(same, pa.binary())], ["id", "label", "v", "same"])

    rows = cut(rows.mapInArrow(run, f"id {id_type}, label string, v binary, same binary").withColumn("row", F.monotonically_increasing_id()))
    once = rows.filter("same is not null").groupBy("same").agg(F.min("id").alias("id"), F.first("label").alias("label"), F.first("v").alias("v"), F.count(F.lit(1)).alias("often"))
    return rows, cut(once.withColumn("cid", F.monotonically_increasing_id()).withColumn("d", (F.length("v") / np.dtype(kind).itemsize).cast("int")))


def _units(raw: list[bytes], kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Vectors in double precision, scaled by a power of two each, and unit vectors."""
    x = np.frombuffer(b"".join(raw), kind).astype(np.float64).reshape(len(raw), -1)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])
    return x, x / np.sqrt((x * x).sum(1))[:, None]


def grouped(once: DataFrame, windows: dict[int, Windows], kind: type) -> DataFrame:
    """Classes → what each group of cells or shares compares: group (label, d, t, cell, i, j), side, cid, id, often, v, cells."""
    shared = once.sparkSession.sparkContext.broadcast(windows)
    id_type = once.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = b.column("d").to_numpy()
            for n in np.unique(d):
                at = np.flatnonzero(d == n)
                mine = b.take(pa.array(at))
                cells = shared.value[int(n)].cells(_units(mine.column("v").to_pylist(), kind)[1])
                listed = pa.array(cells.tolist(), pa.list_(pa.int64()))
                for t in range(cells.shape[1]):
                    yield pa.RecordBatch.from_arrays([*mine.columns, pa.array(np.full(len(at), t), pa.int32()), pa.array(cells[:, t]), listed], [*mine.schema.names, "t", "cell", "cells"])

    keyed = once.select("label", "d", "cid", "id", "often", "v").mapInArrow(run, f"label string, d int, cid long, id {id_type}, often long, v binary, t int, cell long, cells array<long>")
    cell = ["label", "d", "t", "cell"]
    sizes = keyed.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # Cells of several classes, with the number of their shares; those of one class alone have nothing to be compared with.
    dealt = looked_up(keyed, sizes.select(*cell, F.col("n").alias("often_"), F.ceil(F.col("n") / SHARE).cast("int").alias("shares")), cell, "often_", spread=["cid"]).filter("shares is not null")
    own = F.pmod(F.xxhash64("cid"), F.col("shares").cast("long")).cast("int")
    pairs = dealt.withColumn("share", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    return pairs.select(*cell, F.least("share", "other").alias("i"), F.greatest("share", "other").alias("j"), F.when(F.col("share") > F.col("other"), 1).otherwise(0).alias("side"), "cid", "id", "often", "v", "cells")


def links(groups: DataFrame, windows: dict[int, Windows], similarity: float, kind: type) -> DataFrame:
    """groups → (cid, n): links counted of a class, and (a, b): edges between ids that connect what the links connect."""
    shared = groups.sparkSession.sparkContext.broadcast(windows)
    group = ["label", "d", "t", "cell", "i", "j"]
    id_type = groups.schema["id"].dataType.simpleString()

    def compared(b: pa.Table) -> Iterator[pa.RecordBatch]:
        w, t = shared.value[b.column("d")[0].as_py()], b.column("t")[0].as_py()
        x, unit = _units(b.column("v").to_pylist(), kind)
        often, cells = b.column("often").to_numpy(), np.array(b.column("cells").to_pylist(), np.int64)
        side = b.column("side").to_numpy() if b.column("i")[0].as_py() != b.column("j")[0].as_py() else None
        found, root = np.zeros(len(x), np.int64), np.arange(len(x))
        for p, q in w.candidates(unit, side):
            near = (cosines(x[p], x[q]) >= similarity) & ((cells[p, :t] != cells[q, :t]).all(1))
            p, q = p[near], q[near]
            np.add.at(found, p, often[q])
            np.add.at(found, q, often[p])
            if len(p):
                root = forest(len(x), np.r_[p, np.arange(len(x))], np.r_[q, root])
        at = np.flatnonzero(found)
        cid, ids = b.column("cid").take(pa.array(at)), b.column("id")
        of = np.flatnonzero(root != np.arange(len(x)))
        none = pa.nulls(len(at), ids.type)
        yield pa.RecordBatch.from_arrays([cid.combine_chunks(), pa.array(found[at]), none, none], ["cid", "n", "a", "b"])
        yield pa.RecordBatch.from_arrays([pa.nulls(len(of), pa.int64()), pa.nulls(len(of), pa.int64()), ids.take(pa.array(of)).combine_chunks(), ids.take(pa.array(root[of])).combine_chunks()], ["cid", "n", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for b in batches:
            if not b.num_rows:
                continue
            keys = list(zip(*(b.column(c).to_pylist() for c in group)))
            starts = [0, *[k for k in range(1, len(keys)) if keys[k] != keys[k - 1]], len(keys)]
            for lo, hi in zip(starts, starts[1:]):
                if keys[lo] != now:
                    if held:
                        yield from compared(pa.Table.from_batches(held))
                    held, now = [], keys[lo]
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from compared(pa.Table.from_batches(held))

    sorted_ = groups.repartition(*group).sortWithinPartitions(*group)
    return cut(sorted_.mapInArrow(run, f"cid long, n long, a {id_type}, b {id_type}"))


def near_vectors(vectors: DataFrame, similarity: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vectors → key, n_links, component_id, kept."""
    rows, once = classes(vectors, key, vector, label)
    kind = np.float32 if vectors.schema[vector].dataType.elementType.simpleString() == "float" else np.float64
    # One row for each length of vectors.
    largest = once.groupBy("d", "label").count().groupBy("d").agg(F.max("count").alias("n")).collect()
    windows = {r.d: Windows(r.d, similarity, r.n) for r in largest}
    found = links(grouped(once, windows, kind), windows, similarity, kind)
    counted = found.filter("cid is not null").groupBy("cid").agg(F.sum("n").alias("n"))
    per_class = once.join(counted, "cid", "left").select("same", F.col("id").alias("first"), "often", (F.coalesce("n", F.lit(0)) + F.col("often") - 1).alias("n_links"))
    linked = cut(looked_up(rows.select("row", "id", "same"), per_class, ["same"], "often", spread=["row"]))
    edges = found.filter("a is not null").select("a", "b").unionByName(linked.filter("first != id").select(F.col("id").alias("a"), F.col("first").alias("b")))
    named = components(edges)
    out = linked.join(named, F.col("id") == F.col("node"), "left").withColumn("component_id", F.coalesce("component", "id"))
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def oracle(similarity: float = 0.98) -> str:
    """The same as SQL for DuckDB over `embeddings`: all pairs of a label."""
    return f"""
WITH RECURSIVE e AS (SELECT row_number() OVER () AS r, vec_id, label, CASE WHEN len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0 THEN embedding::DOUBLE[] END AS v FROM embeddings),
p AS MATERIALIZED (SELECT a.r, a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.r <> b.r AND a.vec_id IS NOT NULL AND b.vec_id IS NOT NULL AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= {similarity}),
n AS (SELECT r, count(*) AS n FROM p GROUP BY r),
c(x, y) AS (SELECT vec_id, vec_id FROM e WHERE vec_id IS NOT NULL UNION SELECT c.x, p.b FROM c JOIN p ON c.y = p.a),
m AS (SELECT x, min(y) AS component_id FROM c GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, coalesce(vec_id = component_id, true) AS kept FROM e LEFT JOIN n USING (r) LEFT JOIN m ON x = vec_id"""
