"""Language identification by word-first backoff.

Learned from labelled documents: how often each word, and each character n-gram of the words, occurs per language,
counted over all of them. A word is known where its share of some language's words reaches WORD_SHARE, an n-gram
where its share of those of its length reaches GRAM_SHARE. That bounds the model whatever the corpus holds: up to
1 / WORD_SHARE words and 1 / GRAM_SHARE n-grams of a length for each language, so it is broadcast.

A known word scores by its log frequency per language. An unseen one falls back to its n-grams of the longest
length of which any is known (mean log frequency). A text's language has the greatest sum of its words' scores and the
log share of documents; the score is the posterior probability. Ties go to the first language by name.

Defined results: `und` and score 0 for a null text, one without letters, or where nothing could be learned; a text of
letters of which none is known gets the most frequent language; repeated rows each give a row and count each in
learning; a null key is not held out; labels null or empty don't count; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import cut, held_out, slices

WORD_SHARE, GRAM_SHARE, GRAM_MAX = 1e-5, 5e-5, 5
#: Counts gathered in a task before they are handed on; words kept with their scores; scores summed at a time.
FLUSH_ENTRIES, CACHE_ENTRIES, SUM_ENTRIES = 400_000, 300_000, 2_000_000
#: Added to every count, so that what a language lacks is improbable, not impossible.
SMOOTH = 0.05
_letters = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def words(text: str | None) -> list[str]:
    return _letters.findall(text.lower()) if text else []


def grams(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _count(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """docs → (lang, word, n), summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[str, Counter] = {}

        def rows() -> pa.RecordBatch:
            keys = [(x, w, n) for x, c in of.items() for w, n in c.items()]
            of.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*keys) if keys else ((), (), ()), (pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"])

        for b in slices(batches, text):
            for x, t in zip(b.column(lang).to_pylist(), b.column(text).to_pylist()):
                of.setdefault(x, Counter()).update(words(t))
            if sum(map(len, of.values())) > FLUSH_ENTRIES:
                yield rows()
        yield rows()

    return docs.select(text, lang).mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _count_grams(counted: DataFrame) -> DataFrame:
    """(lang, word, n) → (lang, size, word: the n-gram, n), summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: Counter = Counter()

        def rows() -> pa.RecordBatch:
            keys = [(x, k, g, n) for (x, k, g), n in of.items()]
            of.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*keys) if keys else ((),) * 4, (pa.string(), pa.int32(), pa.string(), pa.int64()))], ["lang", "size", "word", "n"])

        for b in batches:
            for x, w, n in zip(*(b.column(c).to_pylist() for c in ("lang", "word", "n"))):
                for k in range(1, GRAM_MAX + 1):
                    for g in grams(w, k):
                        of[x, k, g] += n
                if len(of) > FLUSH_ENTRIES:
                    yield rows()
        yield rows()

    return counted.mapInArrow(run, "lang string, size int, word string, n long").groupBy("lang", "size", "word").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    langs: list[str]
    prior: np.ndarray
    #: By size, 0 for whole words: the row of each entry.
    tables: list[dict[str, int]]
    #: Log frequencies per language.
    rows: np.ndarray


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Labelled documents → model. At most the bounded numbers of words and n-grams come to the driver."""
    docs = docs.filter(F.col(lang).isNotNull() & (F.col(lang) != "") & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    shares = {r[0]: r[1] for r in docs.groupBy("lang").count().collect()}
    langs = sorted(shares)
    prior = np.log(np.array([shares[x] for x in langs], float) / max(1, sum(shares.values())))
    counted = cut(_count(docs, "text", "lang"))
    sized = cut(counted.withColumn("size", F.lit(0)).select("lang", "size", "word", "n").unionByName(_count_grams(counted)))
    totals = {(r[0], r[1]): r[2] for r in sized.groupBy("lang", "size").agg(F.sum("n")).collect()}
    total = F.create_map(*[v for (x, k), n in totals.items() for v in (F.concat_ws(" ", F.lit(x), F.lit(k)), F.lit(n))]) if totals else F.create_map().cast("map<string,long>")
    share = F.col("n") / total[F.concat_ws(" ", "lang", "size")]
    known = sized.withColumn("share", share).groupBy("size", "word").agg(F.max("share").alias("share"), F.collect_list(F.struct("lang", "n")).alias("by"))
    known = known.filter(F.col("share") >= F.when(F.col("size") == 0, WORD_SHARE).otherwise(GRAM_SHARE))
    tables: list[dict[str, int]] = [{} for _ in range(GRAM_MAX + 1)]
    at, rows = {x: i for i, x in enumerate(langs)}, []
    all_ = np.array([[totals.get((x, size), 0) for x in langs] for size in range(GRAM_MAX + 1)], float).reshape(GRAM_MAX + 1, len(langs))
    for r in known.select("size", "word", "by").toLocalIterator():
        n = np.zeros(len(langs))
        for x, k in r.by:
            n[at[x]] = k
        tables[r.size][r.word] = len(rows)
        rows.append(np.log((n + SMOOTH) / (all_[r.size] + 1)).astype(np.float32))
    return Model(langs, prior, tables, np.array(rows, np.float32).reshape(len(rows), len(langs)))


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        #: Rows of the words met so far.
        self.at: dict[str, int] = {}
        self.rows = np.zeros((1024, len(model.langs)), np.float32)

    def _vector(self, word: str) -> np.ndarray:
        tables, rows = self.model.tables, self.model.rows
        found = tables[0].get(word)
        if found is not None:
            return rows[found]
        for n in range(GRAM_MAX, 0, -1):
            table = tables[n]
            hits = [table[g] for g in grams(word, n) if g in table]
            if hits:
                return rows[hits].sum(0) / len(hits)
        return np.zeros(len(self.model.langs), np.float32)

    def score(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """→ language and its posterior probability, of each text."""
        model, at = self.model, self.at
        if len(at) > CACHE_ENTRIES:
            at.clear()
        lists = [words(t) for t in texts]
        new = {w for x in lists for w in x}.difference(at)
        while len(at) + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        for w in new:
            self.rows[len(at)] = self._vector(w)
            at[w] = len(at)
        out, step = [], max(1, SUM_ENTRIES // max(1, len(model.langs)))
        for x in lists:
            if not x or not model.langs:
                out.append(("und", 0.0))
                continue
            total = model.prior.copy()
            slots = list(map(at.__getitem__, x))
            for k in range(0, len(slots), step):  # a bounded number of a text's rows at a time
                total += self.rows[slots[k : k + step]].sum(axis=0, dtype=np.float64)
            best = int(total.argmax())
            out.append((model.langs[best], float(1 / np.exp(total - total[best]).sum())))
        return out


def predict(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs → keep..., lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in slices(batches, "__text"):
            found = scorer.score(b.column("__text").to_pylist())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array([x for x, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())], [*keep, "lang_pred", "score"])

    types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, f"{types}, lang_pred string, score double")


def identify(docs: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang", apart: Column | None = None) -> DataFrame:
    """docs → key, held_out, lang_pred, score: learned from the documents that aren't held out, predicted for all from their text alone."""
    apart = held_out(key) if apart is None else apart
    model = learn(docs.filter(~apart), text, lang)
    marked = docs.select(F.col(key), F.col(text).alias("__t"), apart.alias("held_out"))
    return predict(marked, model, "__t", (key, "held_out"))
