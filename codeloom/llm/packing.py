"""Packing of tokenised documents into sequences by minimum bin slack.

Each bin starts from the longest piece left and takes, by a subset-sum over bitsets, the combination of available
lengths that fills it most; the combination is then removed. Only lengths matter, so the plan is made on the
histogram of lengths (at most `capacity` entries, whatever the corpus holds), and a combination is taken as often as
its lengths last. The plan is a list of runs: ranks lo..hi of a length go to the sequences base, base + 1, ...

Pieces get their rank among those of their length in two levels (length and salt), so that one common length is
ranked by many tasks.

Defined results: a null or empty text is the separator id alone; repeated rows are packed each; a null doc_id is
carried through; other columns are ignored; an empty table gives no rows. Only documents longer than a sequence are
cut, into whole sequences and a rest.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import cut, slices

#: Fixed value: the published split of lower-case word vocabularies; letters, digits and runs of marks stand apart.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters of Latin script that NFC leaves and whose lower case is one letter: of U+0000 to U+017F all but the dotted capital I.
KEPT = "a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
#: Parts that each length is ranked in.
SALTS = 256
#: Text that is encoded at a time.
ENCODED_BYTES = 2 << 20
#: Known chunks are kept up to so many.
CACHE_ENTRIES = 400_000


def _marks_apart(path: str) -> bool:
    """Whether a vocabulary lower-cases and cuts letters from marks, so that `a.` and `A .` have the same ids."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = [s for part in ("normalizer", "pre_tokenizer") for s in _steps(spec.get(part))]
    return any(s["type"] == "Lowercase" for s in steps) and any(s["type"] == "Split" and s.get("invert") and s["behavior"] == "Removed" and s["pattern"].get("Regex") == PRE_TOKEN for s in steps)


def _steps(part: dict | None) -> list[dict]:
    return [] if part is None else part.get("normalizers", part.get("pretokenizers", [part]))


class ChunkEncoder:
    """Ids of whole texts, where the vocabulary's pre-tokeniser never joins text across ASCII white space: each distinct chunk is encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.marks_apart = _marks_apart(path)
        self._clear()

    def _clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.lengths, self.flat = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """→ all ids in a row, ids of each text."""
        if len(self.slot) > CACHE_ENTRIES:
            self._clear()
        texts = pc.fill_null(texts, "")
        if self.marks_apart and not pc.any(pc.match_substring(texts, "<|")).as_py():  # no special token, whose case would matter
            # The vocabulary has lower case only, and a mark between a letter and white space is a pre-token of its own: fewer distinct chunks.
            # Only after letters that composing and lower-casing leave one letter; others may become something else.
            texts = pc.replace_substring_regex(pc.ascii_lower(texts), rf"([{KEPT}])([.,])(\s)", r"\1 \2\3")
        chunks = pc.ascii_split_whitespace(texts)
        coded = chunks.flatten().dictionary_encode()
        names = coded.dictionary.to_pylist()
        slot = self.slot
        new = [x for x in names if x not in slot]
        got, lengths = [], []
        for k in range(0, len(new), 5_000):
            part = [e.ids for e in self.tokenizer.encode_batch_fast(new[k : k + 5_000], add_special_tokens=False)]
            lengths += map(len, part)
            got.append(np.fromiter(itertools.chain.from_iterable(part), np.uint32))
        slot.update(zip(new, range(len(slot), len(slot) + len(new))))
        self.lengths = np.r_[self.lengths, np.array(lengths, np.int64)]
        self.flat = np.concatenate([self.flat, *got])
        begin = np.r_[0, np.cumsum(self.lengths)]
        slots = np.fromiter(map(slot.__getitem__, names), np.int64, len(names))[coded.indices.to_numpy()] if names else np.zeros(0, np.int64)
        n = self.lengths[slots]
        ends = np.cumsum(n)
        ids = self.flat[np.repeat(begin[slots] - (ends - n), n) + np.arange(n.sum())]
        bound = np.r_[0, ends][chunks.offsets.to_numpy() - chunks.offsets[0].as_py()]
        return ids, np.diff(bound)


@functools.lru_cache(maxsize=1)
def _encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def pieces(docs: DataFrame, vocabulary: str, capacity: int, text: str = "text", key: str = "doc_id", separator: int = 0, keep_ids: bool = False) -> DataFrame:
    """docs → key, piece, start, length, ids_crc32, salt[, ids]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        for b in slices(batches, text, ENCODED_BYTES):
            ids, sizes = encoder.encode(b.column(text))
            rows: list[tuple] = []
            begin = 0
            for doc, n in zip(b.column(key).to_pylist(), sizes.tolist()):
                own = np.append(ids[begin : begin + n], np.uint32(separator)).astype("<u4")
                begin += n
                for k in range(0, n + 1, capacity):
                    raw = own[k : k + capacity]
                    crc = zlib.crc32(raw)
                    rows.append((doc, k // capacity, k, len(raw), crc, zlib.crc32(b"%d" % crc + str(doc).encode()) % SALTS, *([raw.tolist()] if keep_ids else [])))
            cols = list(zip(*rows))
            kinds = [b.column(key).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32())]
            names = [key, "piece", "start", "length", "ids_crc32", "salt", "ids"][: len(cols)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    kind = docs.schema[key].dataType.simpleString()
    more = ", ids array<int>" if keep_ids else ""
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, piece int, start long, length long, ids_crc32 long, salt int{more}")


def fullest(left: dict[int, int], room: int) -> list[int]:
    """Lengths whose sum fills `room` most, of the available ones: subset-sum over a bitset, long ones first, ended once it is full."""
    within = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in left if left[x] and x <= room), reverse=True):
        copies, k = min(left[length], room // length), 1
        while copies > 0:
            take = min(k, copies)
            more = (reach | reach << (take * length)) & within
            if more != reach:
                steps.append((reach, length, take))
                reach = more
            copies, k = copies - take, 2 * k
        if reach >> room & 1:
            break
    at, found = reach.bit_length() - 1, []
    for before, length, take in reversed(steps):
        if not before >> at & 1:
            found += [length] * take
            at -= take * length
    return found


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Histogram of lengths → runs (length, lo, hi, base, offset): rank r in lo..hi-1 of this length goes to sequence base + r - lo, at offset."""
    left, used, runs, base = dict(counts), dict.fromkeys(counts, 0), [], 0
    for seed in sorted(left, reverse=True):
        while left[seed]:
            left[seed] -= 1
            combination = [seed, *fullest(left, capacity - seed)]
            left[seed] += 1
            times = min(left[x] // combination.count(x) for x in set(combination))
            offset = 0
            for x in combination:
                runs.append((x, used[x], used[x] + times, base, offset))
                used[x] += times
                left[x] -= times
                offset += x
            base += times
    return runs


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, text: str = "text", key: str = "doc_id", separator: int = 0, keep_ids: bool = False) -> DataFrame:
    """docs → key, piece, start, length, ids_crc32, sequence_id, offset[, ids]: one row for each piece.

    vocabulary: path of a tokenizers .json, readable on every executor, whose pre-tokens end at white space.
    """
    own = cut(pieces(docs, vocabulary, capacity, text, key, separator, keep_ids))
    parts = own.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = parts.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    # At most `capacity` rows come to the driver.
    runs = plan({r[0]: r[1] for r in parts.groupBy("length").agg(F.sum("n")).collect()}, capacity)
    key_of = np.array([(length << 44) + lo for length, lo, *_ in runs], np.int64)
    order = np.argsort(key_of)
    key_of, base, offset, low = key_of[order], np.array([r[3] for r in runs], np.int64)[order], np.array([r[4] for r in runs], np.int64)[order], np.array([r[1] for r in runs], np.int64)[order]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank = b.column("rank").to_numpy()
            at = np.searchsorted(key_of, (b.column("length").to_numpy() << 44) + rank, side="right") - 1
            names = [n for n in b.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(base[at] + rank - low[at]), pa.array(offset[at])], [*names, "sequence_id", "offset"])

    inner = F.row_number().over(Window.partitionBy("length", "salt").orderBy(key, "piece"))
    ranked = own.withColumn("inner", inner).join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("inner") - 1)
    columns = [key, "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    ranked = ranked.select(*columns, F.col("rank").cast("long"))
    types = ", ".join(f"{c} {ranked.schema[c].dataType.simpleString()}" for c in columns)
    placed = ranked.mapInArrow(place, f"{types}, sequence_id long, offset long")
    return placed.select(*columns[:5], "sequence_id", "offset", *columns[5:])
