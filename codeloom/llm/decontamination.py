"""Benchmark decontamination: CGK random walks, repeated coordinate sampling over item-sized windows, exact edit check.

Texts and items are words, lower-cased: runs of letters and digits, and each sign by itself of scripts that don't
part words by spaces. A document contains an item of n words if some run of its words is within allowed(n) word
edits of it: a share of EDITS, but no more than leave three words in a row whole.

A CGK walk reads a window, writes the current symbol at each of 3 n steps and moves on by a random bit of (step,
symbol): windows at a small edit distance agree in most steps, so edit distance becomes Hamming distance. Several
walks, and several samples of a few steps of each, give the hash tables; what meets in one is checked exactly with the
bit-parallel edit recurrence over the region around the window. More tables reach a higher recall (WALKS * SAMPLES).

Items over PIECE words are hashed as pieces of up to that many: of k edits of an item of n words, some piece of m words
has no more than k m / n, so the size of windows and the distance of their starts stay bounded however long an item is.
Where a piece is within its share of edits, the whole item is checked. Items of one or two words, which have no edits,
are looked up as they are.

Windows start on a grid of a GRIDth of their size. They are taken only where an item could be: k edits leave at least
n - 2 - 3 k of its word triples, so a stretch with fewer triples of any item at all is skipped without loss.

Distinct items go to all documents in blocks of up to BLOCK items and about BLOCK_BYTES, so what is broadcast is bounded.

Defined results: null or empty texts and items, and items without words, match nothing; repeated rows of documents each give theirs; items of
equal text are searched once and each of their distinct ids gets its rows; null ids are carried through; other columns
are ignored; where both tables call their key alike, the item's is called item_ and that; without items nothing is found.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from codeloom.llm.common import chunks, slices

EDITS = 0.2
WALKS, SAMPLES, SYMBOLS = 6, 8, 3
#: Most words hashed as one.
PIECE = 64
#: Ratio of one window size to the next.
STEP = 1.12
GRID = 12
BLOCK, BLOCK_BYTES, CACHE_ENTRIES, PATTERNS = 20_000, 32 << 20, 300_000, 20_000
#: Code points of scripts without spaces between words (Thai, Lao, Burmese, Khmer, kana, Han).
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_words = re.compile(rf"(?![_\W])[{UNSPACED}]|[^\W_{UNSPACED}]+")


def words(text: str | None) -> list[str]:
    return _words.findall(text.lower()) if text else []


def allowed(n: int) -> int:
    return max(0, min(int(EDITS * n), (n - 3) // 3))


def edits(pattern: dict[int, int], n: int, region: list[int]) -> tuple[int, int]:
    """Least edit distance of the pattern (symbol → bits of its places) to a run of the region, and where the first such ends."""
    full, last = (1 << n) - 1, 1 << (n - 1)
    vp, vn, score, best, end = full, 0, n, n, 0
    for i, c in enumerate(region):
        x = pattern.get(c, 0) | vn
        d = ((vp + (x & vp)) ^ vp) | x
        hn, hp = vp & d, (vn | ~(vp | d)) & full
        if hp & last:
            score += 1
        elif hn & last:
            score -= 1
            if score < best:
                best, end = score, i + 1
        x = hp << 1 & full
        vn, vp = x & d, (hn << 1 | ~(x | d)) & full
    return best, end


class Items:
    """A block of items, prepared: vocabulary, triples, and hash tables by window size."""

    def __init__(self, rows: list[tuple[object, str | None]], seed: int = 11):
        cut = [(i, w) for i, w in ((i, words(t)) for i, t in rows) if w]
        self.ids = [i for i, _ in cut]
        names = sorted({x for _, w in cut for x in w})
        #: 0 stands for every word that no item has.
        self.vocabulary = {x: k + 1 for k, x in enumerate(names)}
        self.coded = [np.array([self.vocabulary[x] for x in w], np.int64) for _, w in cut]
        self.base = len(names) + 1
        self.triples = np.unique(np.concatenate([np.zeros(0, np.int64), *[self._triple(c) for c in self.coded]]))
        #: Items of one or two words, by their words as one number.
        self.short = {n: dict(sorted((int(self._number(c)), k) for k, c in enumerate(self.coded) if len(c) == n)) for n in (1, 2)}
        #: Item number and first word of each piece, and its end.
        cuts = [(k, i) for k, c in enumerate(self.coded) if len(c) > 2 for i in np.linspace(0, len(c), -(-len(c) // PIECE) + 1).astype(int)[:-1].tolist()]
        self.piece_item, self.piece_at = np.array([k for k, _ in cuts], np.int64), np.array([i for _, i in cuts], np.int64)
        pieces = [self.coded[k][i : cuts[p + 1][1] if p + 1 < len(cuts) and cuts[p + 1][0] == k else None] for p, (k, i) in enumerate(cuts)]
        self.piece_size = np.array([len(c) for c in pieces], np.int64)
        by: dict[int, list[int]] = {}
        for k, c in enumerate(pieces):
            by.setdefault(math.ceil(math.log(len(c)) / math.log(STEP) - 1e-9), []).append(k)
        rng = np.random.default_rng(seed)
        #: (window size, most edits, least triples, walk numbers, sampled steps, sorted keys, their pieces)
        self.sizes = []
        for power, members in sorted(by.items()):
            size = max(len(pieces[k]) for k in members)
            most = max(allowed(len(pieces[k])) for k in members)
            need = max(1, min(len(pieces[k]) - 2 - 3 * allowed(len(pieces[k])) for k in members))
            walks = rng.integers(1, 1 << 62, (WALKS, 2, 3 * size)).astype(np.uint64) | np.uint64(1)
            # Later steps drift more, so samples come from the first two thirds of the walk: about one reading of the window.
            steps = np.array([[np.sort(rng.choice(2 * size, SYMBOLS, replace=False)) for _ in range(SAMPLES)] for _ in range(WALKS)])
            flat = np.concatenate([pieces[k] for k in members] + [np.zeros(0, np.int64)])
            ends = np.cumsum([len(pieces[k]) for k in members])
            keys = self.keys(flat, np.r_[0, ends[:-1]], ends, walks, steps)
            table = np.arange(keys.shape[1]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            flat_keys, owner = (keys ^ table).ravel(), np.repeat(members, keys.shape[1])
            order = np.argsort(flat_keys, kind="stable")
            self.sizes.append((size, most, need, walks, steps, flat_keys[order], owner[order], table))

    def pattern(self, item: int, first: int = 0, size: int | None = None) -> dict[int, int]:
        """Symbol → bits of its places in an item, or in `size` words of it."""
        out: dict[int, int] = {}
        for i, c in enumerate(self.coded[item][first : None if size is None else first + size].tolist()):
            out[c] = out.get(c, 0) | 1 << i
        return out

    def _number(self, x: np.ndarray) -> np.ndarray:
        return x[0] if len(x) == 1 else x[0] * self.base + x[1]

    def _triple(self, x: np.ndarray) -> np.ndarray:
        return (x[:-2] * self.base + x[1:-1]) * self.base + x[2:]

    def keys(self, flat: np.ndarray, start: np.ndarray, end: np.ndarray, walks: np.ndarray, steps: np.ndarray) -> np.ndarray:
        """(windows, tables): hashes of the sampled symbols of each walk; past its end a window reads 0."""
        out = []
        padded = np.append(flat, 0).astype(np.uint64)
        for (a, b), picked in zip(walks, steps):
            at = start.copy()
            last = int(picked.max()) + 1
            read = np.zeros((len(start), last), np.uint64)
            for j in range(last):
                symbol = padded[np.where(at < end, at, len(flat))]
                read[:, j] = symbol
                at += ((symbol * a[j] + b[j]) >> np.uint64(40) & np.uint64(1)).astype(np.int64)
            for p in picked:
                h = np.zeros(len(start), np.uint64)
                for j in p:
                    h = (h ^ read[:, j]) * np.uint64(0xD6E8FEB86659FD93)
                    h ^= h >> np.uint64(32)
                out.append(h)
        return np.stack(out, 1) if out else np.zeros((len(start), 0), np.uint64)


class Finder:
    def __init__(self, items: Items):
        self.items = items
        self.slot: dict[str, int] = {}
        self.lengths, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64)
        #: Patterns of what was met, by (item, first word).
        self.patterns: dict[tuple[int, int], dict[int, int]] = {}

    def _pattern(self, item: int, first: int = 0, size: int | None = None) -> dict[int, int]:
        key = (item, -1 if size is None else first)
        if key not in self.patterns:
            if len(self.patterns) > PATTERNS:
                self.patterns.clear()
            self.patterns[key] = self.items.pattern(item, first, size)
        return self.patterns[key]

    def _short(self, flat: np.ndarray, bound: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Items of one or two words that the documents hold, each where it first ends."""
        out = []
        for n, numbers in self.items.short.items():
            if not numbers or len(flat) < n:
                continue
            run = flat if n == 1 else np.where((flat[:-1] > 0) & (flat[1:] > 0), flat[:-1] * self.items.base + flat[1:], 0)
            keys, owner = np.fromiter(numbers, np.int64, len(numbers)), np.fromiter(numbers.values(), np.int64, len(numbers))
            place = np.minimum(np.searchsorted(keys, run), len(keys) - 1)
            at = np.flatnonzero(keys[place] == run)
            doc = np.searchsorted(bound, at, side="right") - 1
            inside = at + n <= bound[doc + 1]
            at, doc = at[inside], doc[inside]
            item = owner[place[at]]
            _, first = np.unique(doc * np.int64(len(self.items.coded)) + item, return_index=True)
            out += [(int(doc[i]), int(item[i]), 0, int(at[i] - bound[doc[i]] + n)) for i in first]
        return out

    def _symbols(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Words of all texts in a row, as symbols, and the words of each text; each distinct chunk is looked at once."""
        if len(self.slot) > CACHE_ENTRIES:
            self.slot, self.lengths, self.flat = {}, np.zeros(0, np.int64), np.zeros(0, np.int64)
        names, index, begins = chunks(texts)
        slot, vocabulary = self.slot, self.items.vocabulary
        new = [x for x in names if x not in slot]
        got = [[vocabulary.get(w, 0) for w in words(x)] for x in new]
        slot.update(zip(new, range(len(slot), len(slot) + len(new))))
        self.lengths = np.r_[self.lengths, np.fromiter(map(len, got), np.int64, len(got))]
        self.flat = np.r_[self.flat, np.fromiter((s for g in got for s in g), np.int64)]
        begin = np.r_[0, np.cumsum(self.lengths)]
        slots = np.fromiter(map(slot.__getitem__, names), np.int64, len(names))[index] if names else np.zeros(0, np.int64)
        n = self.lengths[slots]
        ends = np.cumsum(n)
        flat = self.flat[np.repeat(begin[slots] - (ends - n), n) + np.arange(n.sum())]
        return flat, np.r_[0, ends][begins]

    def windows(self, flat: np.ndarray, bound: np.ndarray, size: int, most: int, need: int, at: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts, and ends, of the windows of this size near `need` triples (at: their places, doc: their documents)."""
        if len(at) < need:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        last = at[need - 1 :] if need > 1 else at
        first = at[: len(last)]
        ok = np.flatnonzero((last - first < size + most) & (doc[need - 1 :][: len(last)] == doc[: len(last)]))
        grid = max(1, size // GRID)
        # Up to 3 edited triples for each edit may come before the first whole one.
        reach = -(-(3 * most + 2) // grid) + 1
        begin = bound[doc[ok]]
        cell = (first[ok] - begin) // grid
        cells = np.maximum(cell[:, None] - np.arange(reach)[None, :], 0)
        start = np.unique((begin[:, None] + cells * grid).ravel())
        ends = bound[np.searchsorted(bound, start, side="right")]
        return start, np.minimum(start + size, ends)

    def find(self, texts: pa.Array) -> list[tuple[int, int, int, int]]:
        """→ (document, item number, edits, the word after the match), the best of each document and item."""
        items = self.items
        flat, bound = self._symbols(texts)
        short = self._short(flat, bound)
        if not len(items.triples) or len(flat) < 3:
            return sorted(short)
        known = np.flatnonzero((flat[:-2] > 0) & (flat[1:-1] > 0) & (flat[2:] > 0))
        triple = (flat[known] * items.base + flat[known + 1]) * items.base + flat[known + 2]
        at = known[items.triples[np.minimum(np.searchsorted(items.triples, triple), len(items.triples) - 1)] == triple]
        doc = np.searchsorted(bound, at, side="right") - 1
        inside = at + 3 <= bound[doc + 1]
        at, doc = at[inside], doc[inside]
        #: Stretches of the words to check, by document and item.
        spans: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for size, most, need, walks, steps, keys, owner, table in items.sizes:
            starts, ends = self.windows(flat, bound, size, most, need, at, doc)
            pairs = []
            for k in range(0, len(starts), 20_000):
                s = starts[k : k + 20_000]
                mine = (items.keys(flat, s, ends[k : k + 20_000], walks, steps) ^ table).ravel()
                lo, hi = np.searchsorted(keys, mine, "left"), np.searchsorted(keys, mine, "right")
                n = hi - lo
                hit = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                pairs.append(np.unique(np.repeat(np.repeat(s, len(table)), n) * np.int64(len(items.piece_item)) + owner[hit]))
            for pair in np.concatenate(pairs).tolist() if pairs else ():
                start, piece = divmod(pair, len(items.piece_item))
                item = int(items.piece_item[piece])
                n = len(items.coded[item])
                d = int(np.searchsorted(bound, start, side="right")) - 1
                slack = size // 8 + allowed(n) + 1
                if n > PIECE:
                    first, m = int(items.piece_at[piece]), int(items.piece_size[piece])
                    bits, near = self._pattern(item, first, m), size // 8 + allowed(m) + 1
                    if edits(bits, m, flat[max(int(bound[d]), start - near) : min(int(bound[d + 1]), start + m + near)].tolist())[0] > allowed(m):
                        continue
                    slack += size // 4
                    start -= first
                spans.setdefault((d, item), []).append((max(int(bound[d]), start - slack), min(int(bound[d + 1]), start + n + slack)))
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for (d, item), found_at in spans.items():
            n = len(items.coded[item])
            merged: list[list[int]] = []
            for lo, hi in sorted(found_at):
                if merged and lo <= merged[-1][1]:
                    merged[-1][1] = max(hi, merged[-1][1])
                else:
                    merged.append([lo, hi])
            for lo, hi in merged:
                found, end = edits(self._pattern(item), n, flat[lo:hi].tolist())
                if found <= allowed(n):
                    score = (found, lo + end - int(bound[d]))
                    if (d, item) not in best or score < best[d, item]:
                        best[d, item] = score
        return sorted(short + [(d, item, *score) for (d, item), score in best.items()])


def blocks(benchmark: DataFrame, text: str, key: str, block: int = BLOCK) -> Iterator[Items]:
    """Prepared distinct items, each under the least of its ids, a bounded number at a time."""
    usable = benchmark.filter(F.col(text).isNotNull()).groupBy(F.col(text).alias("t")).agg(F.min(key).alias("i"))
    rows, size = usable.agg(F.count(F.lit(1)), F.sum(F.octet_length("t").cast("long"))).first()
    parts = max(1, -(-rows // block), -(-(size or 0) // BLOCK_BYTES))
    for n in range(parts):
        yield Items(sorted(((r.i, r.t) for r in usable.filter(F.pmod(F.xxhash64("t"), F.lit(parts)) == n).collect()), key=lambda r: (r[0] is None, 0 if r[0] is None else r[0], r[1])))


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """→ key, item key, edits, item_words, similarity (1 - edits / item_words), end_word: one row for each document and item that it contains."""
    out = None
    named = item_key if item_key != key else f"item_{item_key}"
    kinds = f"`{key}` {docs.schema[key].dataType.simpleString()}, `{named}` {benchmark.schema[item_key].dataType.simpleString()}"
    id_type = to_arrow_type(benchmark.schema[item_key].dataType)
    for items in blocks(benchmark, item_text, item_key):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            finder = Finder(items)
            for b in slices(batches, text):
                found = finder.find(b.column(text))
                n = [len(items.coded[i]) for _, i, *_ in found]
                yield pa.RecordBatch.from_arrays(
                    [b.column(key).take(pa.array([d for d, *_ in found], pa.int64())), pa.array([items.ids[i] for _, i, *_ in found], id_type), pa.array([e for *_, e, _ in found], pa.int32()), pa.array(n, pa.int32()), pa.array([1 - e / m for (*_, e, _), m in zip(found, n)], pa.float64()), pa.array([w for *_, w in found], pa.int32())],
                    [key, named, "edits", "item_words", "similarity", "end_word"],
                )

        part = docs.select(key, text).mapInArrow(run, f"{kinds}, edits int, item_words int, similarity double, end_word int")
        out = part if out is None else out.unionByName(part)
    # The other ids of texts that have several.
    known = benchmark.filter(F.col(item_text).isNotNull()).select(F.col(item_text).alias("t"), F.col(item_key).alias("i")).distinct()
    least = known.groupBy("t").agg(F.min("i").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1 and least is not null")
    more = known.join(least, "t").filter(~F.col("i").eqNullSafe(F.col("least"))).select("least", "i")
    if more.isEmpty():
        return out
    also = out.join(more, F.col(named) == F.col("least")).select(key, F.col("i").alias(named), "edits", "item_words", "similarity", "end_word")
    return out.unionByName(also)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """docs without those that contain an item; whole rows, unshuffled."""
    for items in blocks(benchmark, item_text, item_key):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            finder = Finder(shared.value)
            for b in slices(batches, text):
                keep = np.ones(b.num_rows, bool)
                keep[[d for d, *_ in finder.find(b.column(text))]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
