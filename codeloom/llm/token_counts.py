"""Token counts by rank-synchronous array merging over a byte-level BPE vocabulary.

Texts are cut into pre-tokens; the distinct new pre-tokens of a batch lie in one ragged numpy array, and in
each step every sequence applies its own lowest-rank pair, at all of its places at once. What survives is counted. In pre-tokens of over
LONG bytes only the places beside a merge are looked at anew, so that one of a million letters takes seconds.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows each give a row; a null doc_id is
carried through; other columns are ignored. Strings of special tokens inside a text are one token each, as the
library treats them by default.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from codeloom.llm.common import slices

#: Fixed value: the published split pattern of byte-level BPE pre-tokenisation.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Known counts are kept for at most so many pre-tokens of at most so many characters; others are counted anew.
CACHE_ENTRIES, CACHE_CHARS = 400_000, 64
#: Pre-tokens of more bytes are merged by a queue of places, the others in passes over all symbols; the counts are the same.
LONG = 256


def _byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 for itself, the others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class RankMerger:
    """Counts the symbols that byte-pair merging leaves of each of many pre-tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.size = max(vocab.values()) + 1
        self.first = np.zeros(256, np.int64)
        for symbol, byte in _byte_symbols().items():
            self.first[byte] = vocab[symbol]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        pairs = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.ranks, self.made = pairs[order], order.astype(np.int64), made
        self.special = [t["content"] for t in spec.get("added_tokens", [])]

    def counts(self, tokens: list[bytes]) -> np.ndarray:
        """How many symbols are left of each token."""
        long = np.fromiter((len(t) > LONG for t in tokens), bool, len(tokens))
        if not long.any():
            return self._in_passes(tokens)
        out = np.empty(len(tokens), np.int64)
        for part, way in ((long, self._by_places), (~long, self._in_passes)):
            out[part] = way([tokens[i] for i in np.flatnonzero(part)])
        return out

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where(self.pairs[at] == keys, self.ranks[at], len(self.made))

    def _by_places(self, tokens: list[bytes]) -> np.ndarray:
        """Places wait by the rank of their pair. The least rank that waits is the lowest of each sequence that has it, and is applied there at once."""
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        n, none = int(sizes.sum()), len(self.made)
        ids = self.first[np.frombuffer(b"".join(tokens), np.uint8)]
        owner = np.repeat(np.arange(len(tokens)), sizes)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        ends = np.cumsum(sizes)[sizes > 0]
        after[ends - 1] = -1
        before[np.r_[0, ends[:-1]]] = -1
        rank = np.full(n, none, np.int64)
        waiting: dict[int, list[np.ndarray]] = {}
        order: list[int] = []

        def look(places: np.ndarray) -> None:
            rank[places] = none
            places = places[after[places] >= 0]
            rank[places] = self._ranks(ids[places], ids[after[places]])
            places = places[rank[places] < none]
            places = places[np.argsort(rank[places], kind="stable")]
            found, start = np.unique(rank[places], return_index=True)
            for r, part in zip(found.tolist(), np.split(places, start[1:])):
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(order, r)
                waiting[r].append(part)

        left = sizes.copy()
        look(np.arange(n))
        while order:
            r = heapq.heappop(order)
            hit = np.unique(np.concatenate(waiting.pop(r)))
            hit = hit[rank[hit] == r]  # others were merged away or have another neighbour by now
            if not len(hit):
                continue
            # In a run of touching places (the pair of a symbol with itself) every other one counts, from the left.
            starts = np.r_[True, after[hit[:-1]] != hit[1:]]
            run = np.maximum.accumulate(np.where(starts, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            gone = after[hit]
            ids[hit], rank[gone], after[hit] = self.made[r], none, after[gone]
            linked = after[hit] >= 0
            before[after[hit[linked]]] = hit[linked]
            left -= np.bincount(owner[hit], minlength=len(left))
            look(np.unique(np.r_[hit, before[hit][before[hit] >= 0]]))
        return left

    def _in_passes(self, tokens: list[bytes]) -> np.ndarray:
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        left = sizes.copy()
        ids = self.first[np.frombuffer(b"".join(tokens), np.uint8)]
        owner = np.repeat(np.arange(len(tokens)), sizes)
        none = len(self.made)
        while len(ids) > 1:
            keys = ids[:-1] * self.size + ids[1:]
            at = np.minimum(np.searchsorted(self.pairs, keys), none - 1)
            rank = np.full(len(ids), none, np.int64)
            fits = (owner[:-1] == owner[1:]) & (self.pairs[at] == keys)
            rank[:-1][fits] = self.ranks[at[fits]]
            begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.repeat(np.minimum.reduceat(rank, begin), np.diff(np.r_[begin, len(ids)]))
            live = lowest < none
            if not live.any():
                break
            hit = np.flatnonzero((rank == lowest) & live)
            # In a run of touching places (the pair of a symbol with itself) every other one counts, from the left.
            starts = np.r_[True, np.diff(hit) != 1]
            run = np.maximum.accumulate(np.where(starts, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            ids[hit] = self.made[rank[hit]]
            live[hit + 1] = False
            left -= np.bincount(owner[hit], minlength=len(left))
            ids, owner = ids[live], owner[live]  # finished sequences and merged right halves go
        return left


@functools.lru_cache(maxsize=2)
def _merger(path: str) -> RankMerger:
    return RankMerger(path)


class TokenCounter:
    def __init__(self, path: str):
        self.merger = _merger(path)
        self.known: dict[str, int] = {}
        self.find = regex.compile(PRE_TOKEN).findall
        self.cut = re.compile("|".join(map(re.escape, self.merger.special))) if self.merger.special else None

    def _pieces(self, text: str) -> tuple[list[str], int]:
        if self.cut is None or not self.cut.search(text):
            return self.find(text), 0
        parts = self.cut.split(text)
        return [t for part in parts for t in self.find(part)], len(parts) - 1

    def count(self, texts: list[str | None]) -> list[int]:
        cut = [self._pieces(t) if t else ([], 0) for t in texts]
        known = self.known
        new = list({t for tokens, _ in cut for t in tokens}.difference(known))
        extra: dict[str, int] = {}
        for k in range(0, len(new), 50_000):
            part = new[k : k + 50_000]
            for t, n in zip(part, self.merger.counts([t.encode() for t in part]).tolist()):
                (known if len(t) <= CACHE_CHARS else extra)[t] = n
        of = known if not extra else known | extra
        out = [sum(map(of.__getitem__, tokens)) + n for tokens, n in cut]
        if len(known) > CACHE_ENTRIES:
            known.clear()
        return out


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs → key, n_bytes, n_tokens, over_limit (n_tokens > limit). `vocabulary`: path of a byte-level BPE .json, readable on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(vocabulary)
        for b in slices(batches, text):
            n = counter.count(b.column(text).to_pylist())
            size = pc.fill_null(pc.binary_length(b.column(text)), 0).cast(pa.int64())
            n = pa.array(n, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(key), size, n, pc.greater(n, limit)], [key, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, n_bytes long, n_tokens long, over_limit boolean")
