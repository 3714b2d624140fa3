"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits, each set where over half of a document's shingle hashes have it. For radius r, every bit
position gets a non-zero vector of r + 1 bits, in turn; table v (non-zero too) keeps the positions whose vector has
an odd inner product with v. Any r positions leave some v that is orthogonal to all of theirs, so two fingerprints
that differ in at most r bits agree on all that table v keeps: every such pair meets in some table, with certainty.

For the fingerprints alone (near_duplicates), equal ones are merged first. In buckets of up to BUCKET_PAIRS distinct fingerprints pairs are compared
in a join condition; in larger ones, which must not be paired out, each fingerprint is listed at itself and at its
neighbours that differ in up to half the radius, and those that meet there are joined to the smallest, which gives
the same components.

One fingerprint sees few pairs of a moderate similarity (about one in twenty at a Jaccard of 0.8), so one_of_each also
takes candidates from bands of least hashes of the shingle sets; all candidates are checked exactly.

Defined results: null or empty text has fingerprint 0 and links like any other; fewer words than a shingle make one
shingle; repeated rows each give a row; a null doc_id gets a fingerprint and its component, but never names one (a
component of null ids only is null); other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import cut, rows_a_batch, slices
from codeloom.llm.components import components

BITS = 64
#: Shingle hashes spread to bits at a time.
HASHES = 50_000
#: Commonest shingles of crowded groups that are told apart by how often they occur.
HOT = 100_000
#: Text that is described at a time.
DESCRIBED_BYTES = 2 << 20
BUCKET_PAIRS = 64
#: Pairs that go to a Python worker at a time, each with two whole shingle sets.
PAIRS_A_BATCH = 500
#: Bits of the filter that leaves texts out where they are read.
MARKS = 1 << 24
#: Least hashes of a shingle set in each band: a pair of Jaccard similarity j shares one of b bands with probability 1 - (1 - j^BAND)^b.
BAND = 5
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, cut at ASCII white space."""
    return text.encode().translate(_LOWER).split() if text else []


def shingles(text: str | None, shingle: int, seed: int = 42) -> np.ndarray:
    """Hashes of the word shingles of a text, repeats included; of fewer words, of the whole sequence."""
    w = words(text)
    if not w:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(w), xxhash.xxh64_intdigest
    if len(w) <= shingle:
        return np.array([digest(joined, seed)], np.uint64)
    stop = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    start = np.r_[0, stop[:-1]][: len(w) - shingle + 1].tolist()
    return np.fromiter((digest(joined[i:j], seed) for i, j in zip(start, (stop[shingle - 1 :] - 1).tolist())), np.uint64, len(start))


def fingerprints(texts: list[str | None], shingle: int, seed: int = 42) -> list[int]:
    """Signed 64-bit fingerprints of a batch of texts."""
    return summed([shingles(t, shingle, seed) for t in texts])


def summed(hashes: list[np.ndarray]) -> list[int]:
    """Fingerprints of texts from the hashes of their shingles."""
    sizes = np.fromiter(map(len, hashes), np.int64, len(hashes))
    raw = np.concatenate([np.zeros(0, np.uint64), *hashes]).astype(">u8").view(np.uint8).reshape(-1, 8)
    of = np.repeat(np.arange(len(hashes)), sizes)
    sums = np.zeros((len(hashes), BITS), np.int64)
    for k in range(0, len(raw), HASHES):  # a bounded number of hashes is spread to bits at a time
        mine = of[k : k + HASHES]
        first = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
        sums[mine[first]] += np.add.reduceat(np.unpackbits(raw[k : k + HASHES], axis=1), first, axis=0, dtype=np.int32)
    return np.packbits(sums * 2 > sizes[:, None], axis=1).view(">u8").ravel().astype(np.uint64).view(np.int64).tolist()


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """The 2^(radius+1) - 1 masks, as signed 64-bit numbers."""
    m = 2 ** (radius + 1)
    vectors = [i % (m - 1) + 1 for i in range(bits)]
    masks = [sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() % 2) for v in range(1, m)]
    return [x - (1 << 64) if x >> 63 else x for x in masks]


def fingerprint_docs(docs: DataFrame, shingle: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs → key, fp (signed 64 bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(fingerprints(b.column(text).to_pylist(), shingle), pa.int64())], [key, "fp"])

    return docs.select(key, text).mapInArrow(run, f"{key} long, fp long")


def _flips(radius: int) -> list[int]:
    """All masks of up to radius bits, as signed numbers."""
    found = [sum(1 << i for i in c) for n in range(radius + 1) for c in itertools.combinations(range(BITS), n)]
    return [x - (1 << 64) if x >> 63 else x for x in found]


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Distinct fingerprints (fp, rep) → pairs of reps (a, b) whose components are those of 'differ in up to radius bits'."""
    tables = F.explode(F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for k, m in enumerate(covering_masks(radius))]))
    keyed = fps.select("fp", "rep", tables.alias("k")).select("fp", "rep", "k.t", "k.v")
    size = keyed.groupBy("t", "v").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = cut(keyed.join(size, ["t", "v"]))
    small = met.filter(F.col("n") <= BUCKET_PAIRS)
    x, y = small.alias("x"), small.select("t", "v", F.col("fp").alias("fp2"), F.col("rep").alias("rep2")).alias("y")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= radius
    pairs = x.join(y, ["t", "v"]).filter((F.col("fp") < F.col("fp2")) & near).select(F.col("rep").alias("a"), F.col("rep2").alias("b"))
    # Crowded buckets: two fingerprints within the radius share a point within half of it of both.
    crowd = met.filter(F.col("n") > BUCKET_PAIRS).select("fp", "rep").distinct()
    if radius % 2:
        # An odd radius: one side reaches a bit further; a star joins near points to the smallest of the far ones that are truly within reach.
        half = crowd.select("rep", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(m)) for m in _flips(radius // 2)])).alias("p"))
        wide = crowd.select("rep", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(m)) for m in _flips(radius // 2 + 1)])).alias("p"))
        star = half.join(wide.groupBy("p").agg(F.min("rep").alias("b")), "p").select(F.col("rep").alias("a"), "b")
        back = wide.join(half.groupBy("p").agg(F.min("rep").alias("b")), "p").select(F.col("rep").alias("a"), "b")
        star = star.unionByName(back)
    else:
        half = crowd.select("rep", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(m)) for m in _flips(radius // 2)])).alias("p"))
        star = half.join(half.groupBy("p").agg(F.min("rep").alias("b"), F.max("rep").alias("c")).filter("b < c"), "p").select(F.col("rep").alias("a"), "b")
    return pairs.unionByName(star.filter("a != b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs → key, fp, component_id: the smallest key reachable over links of up to `radius` differing bits."""
    own = cut(fingerprint_docs(docs, shingle, text, key))
    fps = own.groupBy("fp").agg(F.min(key).alias("rep")).filter("rep is not null")
    found = components(links(fps, radius))
    named = fps.join(found, fps.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return own.join(named, "fp", "left").select(key, "fp", "component_id")


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text."""
    return np.unique(shingles(text, shingle))


def marks(keys: DataFrame, key: str) -> np.ndarray:
    """A bit for each of MARKS remainders of the keys' hashes that occur; as many words at most come to the driver as that takes, however many keys there are."""
    place = F.pmod(F.xxhash64(key), F.lit(MARKS))
    words = keys.select((place / 64).cast("int").alias("w"), F.expr(f"shiftleft(1L, CAST(pmod(pmod(xxhash64({key}), {MARKS}), 64) AS INT))").alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(MARKS // 64, np.int64)
    for r in words.collect():
        out[r.w] = r.bits
    return out


def sets_of(docs: DataFrame, keys: DataFrame, shingle: int, text: str, key: str) -> DataFrame:
    """docs of these keys → key, shingles, one row a key. Other texts are left out where they are read, but for those whose hash shares a key's mark; what moves are the sets."""
    shared = docs.sparkSession.sparkContext.broadcast(marks(keys, key))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at = whole.column("__place").to_numpy()
            whole = whole.filter(pa.array((shared.value[at >> 6] >> (at & 63)) & 1 == 1))
            for b in slices([whole], text):
                found = [shingle_hashes(t, shingle).tobytes() for t in b.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(key), pa.array([xxhash.xxh3_64_intdigest(x) >> 1 for x in found], pa.int64()), pa.array(found, pa.binary())], [key, "order", "shingles"])

    placed = docs.filter(F.col(key).isNotNull()).select(key, text, F.pmod(F.xxhash64(key), F.lit(MARKS)).alias("__place"))
    made = placed.mapInArrow(run, f"{key} long, order long, shingles binary").join(keys.select(key).distinct(), key, "left_semi")
    return cut(made.groupBy(key).agg(F.min_by("shingles", F.struct("order", "shingles")).alias("shingles")))


def banded(sets: list[np.ndarray], bands: int, seed: int = 7) -> list[list[int]]:
    """One signed 64-bit key for each band and set: hashes of BAND minima each, under random permutations. None for an empty set."""
    out = np.zeros((len(sets), bands), np.uint64)
    full = [i for i, x in enumerate(sets) if len(x)]
    if full and bands:
        flat = np.concatenate([sets[i] for i in full])
        start = np.r_[0, np.cumsum([len(sets[i]) for i in full])[:-1]]
        turns = np.random.default_rng(seed).integers(1, 1 << 62, (bands, BAND, 2)).astype(np.uint64)
        flat ^= flat >> np.uint64(32)
        for k, band in enumerate(turns):
            h = np.zeros(len(full), np.uint64)
            for a, b in band:
                x = flat * (a * np.uint64(2) + np.uint64(1))
                x += b
                h = (h ^ np.minimum.reduceat(x, start)) * np.uint64(0xD6E8FEB86659FD93)
                h ^= h >> np.uint64(32)
            out[full, k] = h
    return [x.tolist() if len(s) else [] for s, x in zip(sets, out.view(np.int64))]


def described(docs: DataFrame, shingle: int, bands: int = 0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs → key, fp, same (128-bit hash of the shingle set), n (its size), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text, DESCRIBED_BYTES):
            all_ = [shingles(t, shingle) for t in b.column(text).to_pylist()]
            prints, sets = summed(all_), [np.unique(x) for x in all_]
            same = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
            columns = [b.column(key), pa.array(prints, pa.int64()), pa.array(same, pa.binary()), pa.array(map(len, sets), pa.int32()), pa.array(banded(sets, bands), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, [key, "fp", "same", "n", "bands"])

    return docs.select(key, text).mapInArrow(run, f"{key} long, fp long, same binary, n int, bands array<long>")


def verified(pairs: DataFrame, docs: DataFrame, similarity: float, shingle: int, text: str, key: str) -> DataFrame:
    """Those of the pairs (a, b) of keys whose texts have that Jaccard similarity of word shingles or more."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias(key)).distinct()
    sets = sets_of(docs, ends, shingle, text, key)
    both = pairs.join(sets.select(F.col(key).alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col(key).alias("b"), F.col("shingles").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                near.append(common >= similarity * (len(x) + len(y) - common))
            yield b.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    with rows_a_batch(docs.sparkSession, PAIRS_A_BATCH):
        return cut(both.mapInArrow(run, "a long, b long"))


def met(nodes: DataFrame, radius: int) -> DataFrame:
    """nodes (rep, fp, n, bands) → t, v, rep, fp, n, size, least: the members of every bucket of two or more; t is under 0 for bands."""
    tables = F.explode(F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for k, m in enumerate(covering_masks(radius))]))
    keyed = nodes.select("rep", "fp", "n", tables.alias("k")).select("k.t", "k.v", "rep", "fp", "n")
    keyed = keyed.unionByName(nodes.select("rep", "fp", "n", F.posexplode("bands").alias("t", "v")).withColumn("t", -1 - F.col("t")))
    size = keyed.groupBy("t", "v").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("least")).filter("size > 1")
    return cut(keyed.join(size, ["t", "v"]))


def alike_pairs(docs: DataFrame, nodes: DataFrame, radius: int, similarity: float, shingle: int, text: str, key: str) -> DataFrame:
    """nodes (rep, fp, n, bands), one for each distinct shingle set → verified pairs (a, b) of reps whose components are those of all alike pairs that meet in a bucket.

    In buckets of up to BUCKET_PAIRS members all pairs are checked; in crowded ones all members against the smallest. The members of crowded buckets that aren't one component after that are joined by `across`.
    """
    found = met(nodes, radius)
    lengths = F.least("n", "n2") >= similarity * F.greatest("n", "n2") - 1e-6
    small = found.filter(F.col("size") <= BUCKET_PAIRS)
    x, y = small.alias("x"), small.select("t", "v", F.col("rep").alias("b"), F.col("fp").alias("fp2"), F.col("n").alias("n2")).alias("y")
    near = (F.col("t") < 0) | (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= radius)
    pairs = x.join(y, ["t", "v"]).filter((F.col("rep") < F.col("b")) & near & lengths).select(F.col("rep").alias("a"), "b")
    star = found.filter((F.col("size") > BUCKET_PAIRS) & (F.col("rep") != F.col("least"))).select(F.col("least").alias("a"), F.col("rep").alias("b"))
    first = verified(cut(pairs.unionByName(star).distinct()), docs, similarity, shingle, text, key)
    named = nodes.select("rep").distinct().join(components(first), F.col("rep") == F.col("node"), "left").select("rep", F.coalesce("component", "rep").alias("component"))
    crowd = found.filter(F.col("size") > BUCKET_PAIRS).select("t", "v", "rep", "n").join(named, "rep")
    split = crowd.groupBy("t", "v").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.min("n").alias("shortest")).filter("x < y").select("t", "v", "shortest")
    left = cut(crowd.join(split, ["t", "v"]).groupBy("rep", "component").agg(F.min("shortest").alias("shortest")))
    if left.isEmpty():
        return first
    return first.unionByName(verified(across(docs, left, similarity, shingle, text, key), docs, similarity, shingle, text, key))


def across(docs: DataFrame, members: DataFrame, similarity: float, shingle: int, text: str, key: str) -> DataFrame:
    """members (rep, component, shortest: the least size of what it may be alike to) → pairs (a, b) of different components, every alike one among them.

    Sets of that similarity share a shingle among the first n - ceil(similarity n) + 1 of each, in any one order. The
    HOT commonest shingles come last, by how often they occur, so what many texts have in common pairs nothing. A text
    that has much of its own can't share enough with any other, and is left out beforehand, or drops out in the join
    itself. At a shingle, those of its largest component, which may be thousands of copies, are paired with the others only.
    """
    spark = docs.sparkSession
    sets = sets_of(docs, members.select(F.col("rep").alias(key)), shingle, text, key).withColumnRenamed(key, "rep")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "shingles"):
            found = [np.frombuffer(x, np.int64) for x in b.column("shingles").to_pylist()]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            of = pa.array(np.repeat(np.arange(len(found)), sizes))
            yield pa.RecordBatch.from_arrays([b.column("rep").take(of), pa.array(np.concatenate(found)), pa.array(np.repeat(sizes, sizes))], ["rep", "s", "n"])

    counted = cut(sets.mapInArrow(listed, "rep long, s long, n long").groupBy("s").agg(F.count(F.lit(1)).alias("often"), F.min("rep").alias("one"), F.min("n").alias("n")))
    # Shingles of one text only pair nothing.
    alone = counted.filter("often = 1").groupBy(F.col("one").alias("rep")).agg(F.count(F.lit(1)).alias("alone"), F.first("n").alias("n"))
    least = F.greatest(F.col("shortest"), F.ceil(similarity * F.col("n") - 1e-6))
    enough = F.col("n") - F.col("alone") >= F.ceil(similarity / (1 + similarity) * (F.col("n") + least) - 1e-6)
    able = members.join(alone, "rep", "left").filter(F.col("alone").isNull() | enough).select("rep", "component", F.coalesce("alone", F.lit(0)).alias("alone"))
    # A bounded number of shingles; without the others the order is as good for the result, only not for the work.
    hot = counted.filter("often > 2").orderBy(F.desc("often"), "s").limit(HOT).select("s", "often").collect()
    order = np.argsort(np.array([r.s for r in hot], np.int64))
    shared = spark.sparkContext.broadcast((np.array([r.s for r in hot], np.int64)[order], np.array([r.often for r in hot], np.int64)[order]))

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, often = shared.value
        for b in slices(batches, "shingles"):
            rows = []
            for raw in b.column("shingles").to_pylist():
                s = np.frombuffer(raw, np.int64)
                rank = np.zeros(len(s), np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    rank = np.where(common[at] == s, often[at], 0)
                first = np.lexsort((s, rank))[: len(s) - int(np.ceil(similarity * len(s) - 1e-6)) + 1]
                rows.append((s[first], rank[first] > 0, np.arange(1, len(first) + 1), np.full(len(first), len(s))))
            of = pa.array(np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows]))
            cols = [pa.array(np.concatenate(c)) for c in zip(*rows)]
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(of) for c in ("rep", "component", "alone")], *cols], ["rep", "component", "alone", "s", "hot", "place", "n"])

    first = cut(sets.join(able, "rep").mapInArrow(headed, "rep long, component long, alone long, s long, hot boolean, place long, n long"))
    most = first.groupBy("s", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("s").agg(F.max_by("component", F.struct("c", "component")).alias("most"), F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("s", "most")
    theirs = first.join(most, "s")
    other = theirs.filter("component != most").select("s", F.col("rep").alias("rep2"), F.col("n").alias("n2"), F.col("component").alias("component2"), F.col("place").alias("place2"), F.col("alone").alias("alone2"))
    once = (F.col("component") == F.col("most")) | (F.col("rep") < F.col("rep2"))
    # What two sets of these sizes must share; then they share one of the first n - need + 1 of both. They share nothing of what only one has, all
    # of which comes before the hot ones; from a shingle on they share no more than the shorter rest.
    need = F.ceil(similarity / (1 + similarity) * (F.col("n") + F.col("n2")) - 1e-6)
    early = (F.col("place") <= F.col("n") - need + 1) & (F.col("place2") <= F.col("n2") - need + 1)
    before = F.when(F.col("hot"), F.least(F.col("place") - F.col("alone"), F.col("place2") - F.col("alone2"))).otherwise(F.least("place", "place2"))
    enough = (before + F.least(F.col("n") - F.col("place"), F.col("n2") - F.col("place2")) >= need) & (F.least(F.col("n") - F.col("alone"), F.col("n2") - F.col("alone2")) >= need)
    pairs = theirs.join(other, (theirs.s == other.s) & (F.col("component") != F.col("component2")) & once & early & enough)
    # Which side a text is on differs by shingle; a pair's shingles are counted together.
    one, two = F.struct("rep", "n", "place"), F.struct(F.col("rep2").alias("rep"), F.col("n2").alias("n"), F.col("place2").alias("place"))
    pairs = pairs.select(F.least(one, two).alias("x"), F.greatest(one, two).alias("y"))
    pairs = pairs.groupBy(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"), F.col("x.n").alias("n"), F.col("y.n").alias("n2")).agg(F.count(F.lit(1)).alias("c"), F.max("x.place").alias("p"), F.max("y.place").alias("p2"))
    return cut(pairs.filter(F.col("c") + F.least(F.col("n") - F.col("p"), F.col("n2") - F.col("p2")) >= need).select("a", "b"))


def one_of_each(docs: DataFrame, shingle: int = 5, radius: int = 4, similarity: float = 0.8, bands: int = 0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with one document, that of the smallest key, of each group of near duplicates: equal shingle sets, or texts of that similarity that meet by fingerprints within the radius (equal ones included) or in one of the bands.

    Rows that repeat a key are one document, of which one row stays; rows without a key belong to no group and stay.
    """
    own = cut(described(docs.filter(F.col(key).isNotNull()), shingle, bands, text, key))
    nodes = own.groupBy("same").agg(F.min(key).alias("rep"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    found = components(alike_pairs(docs, nodes, radius, similarity, shingle, text, key))
    named = nodes.join(found, nodes.rep == found.node, "left").select("same", F.coalesce("component", "rep").alias("kept"))
    # One row for each key of which something is to be decided; whole documents move for this join alone.
    decided = own.join(named, "same").groupBy(key).agg(F.max(F.col(key) != F.col("kept")).alias("__gone"), (F.count(F.lit(1)) > 1).alias("__again")).filter("__gone or __again")
    decided = cut(decided)
    rest = docs.join(decided.filter("__gone").select(key), key, "left_anti")
    again = decided.filter("__again and not __gone").select(key)
    if again.isEmpty():
        return rest.select(*docs.columns)
    order = Window.partitionBy(key).orderBy(*[F.xxhash64(c) for c in (text,)], F.xxhash64(*docs.columns))
    repeated = docs.join(again, key, "left_semi").withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")
    return rest.join(again, key, "left_anti").unionByName(repeated).select(*docs.columns)
