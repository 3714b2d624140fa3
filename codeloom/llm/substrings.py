"""Substring deduplication over difference-cover anchors.

A window is WINDOW consecutive words of a document. Its inner anchors are shorter word sequences at the positions
whose remainder modulo PERIOD is in COVER, a difference cover: any two positions have a common shift below PERIOD to
such a position. So two equal windows, wherever they lie, share an anchor at the same place within them, and
only 3 of 7 positions are hashed.

1. Anchors are hashed and meet in buckets; those of at least two documents are shared.
2. Documents with shared anchors extend them: every window around one is hashed (96 bits within its bucket), and
   windows meet in buckets, where the smallest id of each is found. A false anchor match costs a few such windows only.
3. A window covered by a smaller id gives up its words.

Tasks first merge what they have: of a common anchor or window one entry goes on for each task, however many documents
hold it, and what the task knows already passes through beside it. A bucket holds a hash share of that, as Arrow-packed arrays.
The bytes of all texts, counted first, say how many buckets (BUCKET_BYTES of text each) and tasks (PART_BYTES) there are, so that
neither grows with the corpus.

Defined results: a null or empty text has no words and the digest of the empty string; a null key neither removes nor
loses words; repeated rows are one document for removal and each give a row (with one key and different texts,
places covered in any of them are covered in all); other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import cut, release, slices

WINDOW = 13
#: {1, 2, 4} covers all differences modulo 7; anchors have as many words as leave a shift of up to 6.
PERIOD, COVER = 7, (1, 2, 4)
ANCHOR = WINDOW - PERIOD + 1
#: Entries that a task gathers before it hands them on.
FLUSH = 2_000_000
#: Text that a bucket, and a task that gathers buckets, stands for; bits of a bucket's number and of what it keeps of an anchor.
BUCKET_BYTES, PART_BYTES = 128 << 20, 1 << 30
BUCKET_BITS, KEPT_BITS = 23, 40
PACKED = "bucket int, known boolean, ids binary, counts binary, part0 binary"
_BASE_A, _BASE_B, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def word_arrays(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in a row, and the words of each text."""
    chunks = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = chunks.flatten()
    bound = chunks.offsets.to_numpy() - chunks.offsets[0].as_py()
    coded = flat.dictionary_encode()
    names = coded.dictionary.to_pylist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(w) for w in names), np.uint64, len(names))
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    kept = np.r_[0, np.cumsum(full)]
    return (hashes[coded.indices.to_numpy()] if len(names) else hashes)[full], np.diff(kept[bound])


def rolling(x: np.ndarray, length: int, base: np.uint64) -> np.ndarray:
    """Polynomial hashes of all runs of that length, finished so that all bits vary."""
    n = max(0, len(x) - length + 1)
    out = np.zeros(n, np.uint64)
    for k in range(length):
        out = out * base + x[k : k + n]
    out ^= out >> np.uint64(32)
    out *= _MIX
    return out ^ out >> np.uint64(29)


def places(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of words in a row: document and place within it."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    return doc, np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def anchors(x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, place) of the anchors that lie in some window."""
    doc, at = places(sizes)
    ok = np.isin(at % PERIOD, COVER) & (at + ANCHOR <= sizes[doc]) & (sizes[doc] >= WINDOW)
    rows = np.flatnonzero(ok)
    return rolling(x, ANCHOR, _BASE_A)[rows], doc[rows], at[rows]


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def folded(h: np.ndarray, buckets: int) -> np.ndarray:
    """What a bucket keeps of an anchor: itself and 40 bits."""
    return (bucket_of(h, buckets) << KEPT_BITS) | (h & np.uint64((1 << KEPT_BITS) - 1)).astype(np.int64)


def _packed(buckets: np.ndarray, docs: np.ndarray, parts: list[np.ndarray], known: bool) -> Iterator[tuple]:
    """Rows (bucket, known, ids, counts, *parts): entries by bucket and id; a run of one id is stored once."""
    order = np.lexsort((docs, buckets))
    buckets, docs, parts = buckets[order], docs[order], [p[order] for p in parts]
    edge = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1], True]) if len(buckets) else np.zeros(1, int)
    for lo, hi in zip(edge[:-1], edge[1:]):
        own = docs[lo:hi]
        start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        counts = np.diff(np.r_[start, hi - lo]).astype("<u4")
        yield (int(buckets[lo]), known, own[start].tobytes(), counts.tobytes(), *[p[lo:hi].tobytes() for p in parts])


def _unpacked(table: pa.Table, kinds: list[str]) -> tuple[np.ndarray, ...]:
    """→ known, ids and the parts of all rows of a bucket."""
    out = []
    for row in zip(*(table.column(c).to_pylist() for c in table.column_names[1:])):
        counts = np.frombuffer(row[2], "<u4")
        docs = np.repeat(np.frombuffer(row[1], np.int64), counts)
        out.append((np.full(len(docs), row[0]), docs, *[np.frombuffer(p, k) for p, k in zip(row[3:], kinds)]))
    return tuple(np.concatenate(c) for c in zip(*out))


_PACKED = ["bucket", "known", "ids", "counts"]
_PACKED_TYPES = [pa.int32(), pa.bool_(), pa.binary(), pa.binary()]


def _by_id(ids: np.ndarray, values: np.ndarray, buckets: int) -> pa.Table:
    """Packed rows of (id, value), one for each share of the ids that has any."""
    mixed = ids.astype(np.uint64) * _BASE_A
    rows = list(_packed(bucket_of(mixed ^ mixed >> np.uint64(29), buckets), ids, [values], False))
    cols = list(zip(*rows)) if rows else [()] * 5
    return pa.table({n: pa.array(c, t) for n, c, t in zip([*_PACKED, "part0"], cols, [*_PACKED_TYPES, pa.binary()])})


def _dealt(rows: DataFrame, parts: int) -> DataFrame:
    """rows, to be grouped by bucket, dealt to `parts` tasks where the session's number is smaller."""
    return rows.repartition(parts, "bucket") if parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def _per_id(met: DataFrame, kind: str, finish: Callable[[np.ndarray], bytes], parts: int) -> DataFrame:
    """Packed rows of a share of the ids → (id, found: what finish makes of its values)."""

    def gather(table: pa.Table) -> pa.Table:
        _, ids, values = _unpacked(table, [kind])
        order = np.argsort(ids, kind="stable")
        ids, values = ids[order], values[order]
        start = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        return pa.table({"id": pa.array(ids[start], pa.int64()), "found": pa.array([finish(v) for v in np.split(values, start[1:])], pa.binary())})

    return _dealt(met, parts).groupBy("bucket").applyInArrow(gather, "id long, found binary")


def _gathered(docs: DataFrame, collect: Callable, hand_on: Callable, parts: int) -> DataFrame:
    """A mapInArrow that gathers entries of many slices, up to FLUSH, and hands them on as packed rows."""
    names = [*_PACKED, *[f"part{i}" for i in range(parts)]]
    types = [*_PACKED_TYPES, *[pa.binary()] * parts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def rows() -> Iterator[pa.RecordBatch]:
            got = list(hand_on(*[np.concatenate(c) for c in zip(*held)])) if held else []
            held.clear()
            for k in range(0, len(got), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got[k : k + 64]), types)], names)

        for b in slices(batches, "text"):
            held.append(collect(b))
            if sum(len(h[0]) for h in held) > FLUSH:
                yield from rows()
        yield from rows()

    return docs.mapInArrow(run, "bucket int, known boolean, ids binary, counts binary" + "".join(f", {n} binary" for n in names[4:]))


def _runs(*sorted_: np.ndarray) -> np.ndarray:
    """Numbers of the runs of equal tuples."""
    new = np.zeros(len(sorted_[0]), bool)
    for x in sorted_:
        new[1:] |= x[1:] != x[:-1]
    return np.cumsum(new)


def shared_anchors(docs: DataFrame, buckets: int, parts: int) -> DataFrame:
    """(id, text) → (id, found: bytes of its folded anchors that other ids have as well)."""

    def collect(b: pa.RecordBatch) -> tuple:
        h, doc, _ = anchors(*word_arrays(b.column("text")))
        ids = b.column("id").to_numpy()[doc]
        return folded(h, buckets), ids

    def split(key: np.ndarray, ids: np.ndarray):
        """Sorted distinct pairs; of each key: its first id, and whether it has others."""
        order = np.lexsort((ids, key))
        key, ids = key[order], ids[order]
        fresh = np.r_[True, (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])] if len(key) else np.zeros(0, bool)
        key, ids = key[fresh], ids[fresh]
        run = _runs(key) if len(key) else np.zeros(0, int)
        first = np.r_[True, run[1:] != run[:-1]] if len(key) else np.zeros(0, bool)
        return key, ids, run, first, np.bincount(run) if len(key) else np.zeros(0, int)

    def hand_on(key: np.ndarray, ids: np.ndarray) -> Iterator[tuple]:
        key, ids, run, first, n = split(key, ids)
        many = n[run] > 1
        low = lambda k: np.ascontiguousarray((k & ((1 << KEPT_BITS) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, : KEPT_BITS // 8])
        yield from _packed(key[first] >> KEPT_BITS, ids[first], [low(key[first])], False)
        yield from _packed(key[many] >> KEPT_BITS, ids[many], [low(key[many])], True)

    def meet(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        known, ids, raw = _unpacked(table, [f"V{KEPT_BITS // 8}"])
        key = np.zeros((len(raw), 8), np.uint8)
        key[:, : KEPT_BITS // 8] = raw.view(np.uint8).reshape(-1, KEPT_BITS // 8)
        key = key.view("<i8").ravel() | bucket << KEPT_BITS
        k, i, run, _, n = split(key[~known], ids[~known])
        again = n[run] > 1
        return _by_id(np.r_[i[again], ids[known]], np.r_[k[again], key[known]].astype("<i8"), max(16, buckets // 2))

    met = _dealt(_gathered(docs, collect, hand_on, 1), parts).groupBy("bucket").applyInArrow(meet, PACKED)
    return _per_id(met, "<i8", lambda v: v.tobytes(), parts)


def covered_words(held: DataFrame, buckets: int, parts: int) -> DataFrame:
    """(id, text, found: its shared anchors) → (id, found: the runs of words within windows that a smaller id has, as bytes)."""

    def collect(b: pa.RecordBatch) -> tuple:
        x, sizes = word_arrays(b.column("text"))
        h, doc, at = anchors(x, sizes)
        begin = np.cumsum(sizes) - sizes
        key = folded(h, buckets)
        edge = np.searchsorted(doc, np.arange(len(sizes) + 1))
        mark = np.zeros(len(x) + 1, np.int64)
        for d, found in enumerate(b.column("found").to_pylist()):
            own = slice(edge[d], edge[d + 1])
            hit = at[own][np.isin(key[own], np.frombuffer(found, "<i8"))]
            lo, hi = np.maximum(hit - PERIOD + 1, 0), np.minimum(hit, sizes[d] - WINDOW)
            np.add.at(mark, begin[d] + lo, 1)
            np.add.at(mark, begin[d] + hi + 1, -1)
        rows = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
        word_doc, place = places(sizes)
        other = x ^ x >> np.uint64(31)
        second = rolling(other * _MIX, WINDOW, _BASE_B)[rows].astype("<u4")
        return rolling(x, WINDOW, _BASE_A)[rows], second, b.column("id").to_numpy()[word_doc[rows]], place[rows].astype("<u4")

    def least(h, g, ids, at):
        order = np.lexsort((at, ids, g, h))
        h, g, ids, at = h[order], g[order], ids[order], at[order]
        run = _runs(h, g) if len(h) else np.zeros(0, int)
        first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]]) if len(h) else np.zeros(0, int)
        return h, g, ids, at, ids > ids[first][run] if len(h) else np.zeros(0, bool)

    def hand_on(h, g, ids, at) -> Iterator[tuple]:
        h, g, ids, at, over = least(h, g, ids, at)
        bucket = bucket_of(h, buckets)
        yield from _packed(bucket[~over], ids[~over], [h[~over], g[~over], at[~over]], False)
        empty = [np.zeros(int(over.sum()), "V0")] * 2
        yield from _packed(bucket[over], ids[over], [*empty, at[over]], True)

    def meet(table: pa.Table) -> pa.Table:
        known = table.column("known")
        fresh, done = table.filter(pc.invert(known)), table.filter(known)
        ids, at = [np.zeros(0, np.int64)], [np.zeros(0, "<u4")]
        if fresh.num_rows:
            _, i, h, g, a = _unpacked(fresh, ["<u8", "<u4", "<u4"])
            _, _, i, a, over = least(h, g, i, a)
            ids.append(i[over])
            at.append(a[over])
        if done.num_rows:
            _, i, a = _unpacked(done.drop_columns(["part0", "part1"]), ["<u4"])
            ids.append(i)
            at.append(a)
        return _by_id(np.concatenate(ids), np.concatenate(at), max(16, buckets // 2))

    met = _dealt(_gathered(held, collect, hand_on, 3), parts).groupBy("bucket").applyInArrow(meet, PACKED)
    return _per_id(met, "<u4", spans, parts)


def spans(starts: np.ndarray) -> bytes:
    """Starts of windows → (first, end) of the runs of words they cover."""
    at = np.unique(starts).astype(np.int64)
    new = np.flatnonzero(np.r_[True, at[1:] > at[:-1] + WINDOW])
    return np.stack([at[new], np.r_[at[new[1:] - 1], at[-1]] + WINDOW], 1).astype("<u4").tobytes()


def remove(text: str | None, gone: np.ndarray) -> tuple[int, int, bytes]:
    """→ words, words removed (gone: first, end of each run), what is kept."""
    words = text.encode().split() if text else []
    kept, at = [], 0
    for first, end in gone.tolist():
        kept += words[at:first]
        at = min(end, len(words))
    kept += words[at:]
    return len(words), len(words) - len(kept), b" ".join(kept)


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", keep_text: bool = True) -> DataFrame:
    """docs → key, n_words, n_removed, kept_sha256[, kept]."""
    spark = docs.sparkSession
    plain = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    with_id = plain.filter("id is not null")
    size = with_id.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    buckets = min(1 << BUCKET_BITS, max(16, 2 * parts, -(-size // BUCKET_BYTES)))
    hits = cut(shared_anchors(with_id, buckets, parts))
    release(spark)
    gone = cut(covered_words(with_id.join(hits, "id"), buckets, parts))
    release(spark)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            found = b.column("found").to_pylist()
            got = [remove(t, np.frombuffer(f or b"", "<u4").reshape(-1, 2)) for t, f in zip(b.column("text").to_pylist(), found)]
            cols = [b.column("id"), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([hashlib.sha256(g[2]).hexdigest() for g in got], pa.string())]
            if keep_text:
                cols.append(pa.array([g[2].decode() for g in got], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names)

    names = ["id", "n_words", "n_removed", "kept_sha256", *(["kept"] if keep_text else [])]
    types = "id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if keep_text else "")
    return plain.join(gone, "id", "left").select("id", "text", "found").mapInArrow(finish, types).withColumnRenamed("id", key)


def oracle() -> str:
    """The same as SQL for DuckDB over `documents`."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT r, doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS s FROM d, unnest(range(1, len(w) - {WINDOW - 2})) AS t(i)),
least AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
gone AS (SELECT DISTINCT r, unnest(range(i, i + {WINDOW})) AS p FROM win JOIN least USING (s) WHERE m < doc_id),
words AS (SELECT r, p, w[p] AS x FROM d, unnest(range(1, len(w) + 1)) AS t(p)),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS k, count(*) AS n FROM words ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)"""
