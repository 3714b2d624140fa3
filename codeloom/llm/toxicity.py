"""Toxicity by multiple-instance learning: sentences are the instances, documents carry the labels.

A sentence's log-odds are a base plus the weights of its words; a word's weight is the sum over its hashed features
(the word, its beginnings, its character n-grams), so that unseen forms of a known stem count. A document's score is
the noisy-or of its sentences, 1 - (1 - leak) * product of (1 - p) / (1 - leak) over the sentences whose p exceeds the leak, where the
leak is the base of one sentence, counted once for the whole document: else any text would become toxic by length
alone. Training sees document labels only; the sentence scores then say where.

The fit follows the gradient of that likelihood, with one departure: in a document of label 1 a sentence below the
leak, on which the likelihood is flat, gets the gradient that it would have above, so that it can still become the reason.

The classifier is fitted in one task on a bounded sample of labelled rows: about SAMPLE rows of each label, those
of small hashes of their id, with their whole texts. Classes are weighted back to their shares among all labels.
Of rows that repeat an id and label the first text in order is learned from. Scoring covers every whole text.

Defined results: a null or empty text has the leak as its score; without both labels to learn from every score
is 0; repeated rows each give a row; a null key is not held out; a null label doesn't count; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import held_out, sampled, slices

SAMPLE = 2500
FEATURES = 1 << 18
ROUNDS, RATE, DAMP, SPARSE = 60, 0.1, 1e-2, 2e-4
CACHE_ENTRIES = 300_000
#: Letters of a word that are looked at together, and those that two pieces of a longer one share.
PIECE, OVERLAP = 40, 8
_ends = re.compile(r"[.!?\n]+")
_letters = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def sentences(text: str | None) -> list[list[str]]:
    """Words, lower-cased, of each sentence that has any."""
    return [w for s in _ends.split(text.lower()) if (w := _letters.findall(s))] if text else []


def pieces(word: str) -> list[str]:
    """A word with marks at its ends; one of over PIECE letters as pieces that overlap, so every run of letters that is a feature lies in some piece."""
    padded = f"<{word}>"
    return [padded] if len(word) <= PIECE else [padded[i : i + PIECE + 2] for i in range(0, len(padded) - OVERLAP, PIECE + 2 - OVERLAP)]


def features(word: str) -> list[int]:
    found = [_features(p) for p in pieces(word)]
    return found[0] if len(found) == 1 else sorted({x for f in found for x in f})


def weight_of(word: str, theta: np.ndarray) -> float:
    """A word's weight: of one in several pieces the largest of theirs, so that length alone doesn't add up."""
    return max(float(theta[_features(p)].sum()) for p in pieces(word))


def _features(padded: str) -> list[int]:
    names = {padded, *(padded[:n] for n in range(4, min(8, len(padded)))), *(padded[i : i + n] for n in (4, 5) for i in range(1, len(padded) - n))}
    return [zlib.crc32(x.encode()) % FEATURES for x in names]


@dataclass
class Model:
    weights: np.ndarray
    base: float


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(x / 2))


def fit(texts: list[str], labels: list[int], weight: list[float]) -> Model | None:
    """Noisy-or maximum likelihood by proximal Adam steps, on ragged arrays."""
    y = np.array(labels)
    if len(set(labels)) < 2:
        return None
    at: dict[str, int] = {}
    occ = array("i")
    size, per_doc = [], []
    for t in texts:
        found = sentences(t)
        per_doc.append(len(found))
        for s in found:
            own = set(s)
            size.append(len(own))
            occ.extend(at.setdefault(w, len(at)) for w in own)
    flat, n_feats = array("i"), array("i")
    for w in at:
        own = features(w)
        flat.extend(own)
        n_feats.append(len(own))
    n_words = len(at)
    del at
    feat, occ_ = np.frombuffer(flat, np.int32), np.frombuffer(occ, np.int32)
    word_of = np.repeat(np.arange(n_words, dtype=np.int32), n_feats)
    sent_of = np.repeat(np.arange(len(size), dtype=np.int32), size)
    doc_of = np.repeat(np.arange(len(texts), dtype=np.int32), per_doc)
    w8 = np.array(weight) / np.sum(weight)
    # Start from how much more documents of label 1 have a feature, smoothed. Weights stay non-negative: what is harmless is 0.
    begin = np.r_[0, np.cumsum(np.bincount(word_of, minlength=n_words))]
    has = np.zeros((2, FEATURES))
    edges = np.searchsorted(doc_of[sent_of], np.arange(len(texts) + 1))
    for k, lo, hi in zip(labels, edges[:-1], edges[1:]):
        of_doc = np.unique(occ_[lo:hi])
        n = np.diff(begin)[of_doc]
        if not len(n):
            continue
        has[k, np.unique(feat[np.repeat(begin[of_doc] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())])] += 1
    theta = np.maximum(0, np.log((has[1] + 3) / (has[0] * (y == 1).sum() / (y == 0).sum() + 3)) - 1)
    base = -4.0
    m, v, mb, vb = np.zeros(FEATURES), np.zeros(FEATURES), 0.0, 0.0
    for step in range(1, ROUNDS + 1):
        u = np.bincount(word_of, theta[feat], n_words)
        z = base + np.bincount(sent_of, u[occ_], len(size))
        leak = _softplus(np.array(base))
        more = _softplus(z) - leak
        up = more > 0
        total = leak + np.bincount(doc_of, np.where(up, more, 0), len(texts))
        slope = w8 * np.where(y == 1, -1 / np.expm1(np.clip(total, 1e-9, 500)), 1.0)
        # Under the leak a sentence of a clean document is clean enough; one of a toxic document may still be the reason.
        gz = _sigmoid(z) * slope[doc_of] * (up | (y[doc_of] == 1))
        gt = np.bincount(feat, np.bincount(occ_, gz[sent_of], n_words)[word_of], FEATURES)
        gb = float((slope * _sigmoid(base)).sum() + (np.where(up, _sigmoid(z) - _sigmoid(base), 0) * slope[doc_of]).sum())
        m, v = 0.9 * m + 0.1 * gt, 0.99 * v + 0.01 * gt * gt
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c1, c2 = 1 - 0.9**step, 1 - 0.99**step
        pace = RATE / (np.sqrt(v / c2) + DAMP)
        theta = theta - pace * (m / c1)
        theta = np.maximum(theta - np.minimum(pace * SPARSE, 0.05), 0)
        base -= RATE * (mb / c1) / (np.sqrt(vb / c2) + DAMP)
    return Model(theta.astype(np.float32), float(base))


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", sample: int = SAMPLE) -> Model | None:
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1)).select(F.col(key).alias("__k"), F.col(label).cast("int").alias("__y"))
    counts = {r[0]: r[1] for r in known.groupBy("__y").count().collect()}
    picked = [sampled(known.filter(F.col("__y") == y), ["__k", "__y"], sample) for y in (0, 1)]
    # The sample is bounded, so it may be broadcast; the texts aren't shuffled.
    rows = docs.join(F.broadcast(picked[0].unionByName(picked[1])), F.col(key) == F.col("__k")).filter(F.col(text).isNotNull())

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["k", "t"])
        got = {y: max(1, int((pdf.y == y).sum())) for y in (0, 1)}
        model = fit(pdf.t.tolist(), pdf.y.tolist(), [counts[y] / got[y] for y in pdf.y])
        if model is None:
            return pd.DataFrame({"at": [], "w": []})
        used = np.flatnonzero(model.weights)
        return pd.DataFrame({"at": np.r_[-1, used], "w": np.r_[model.base, model.weights[used].astype(float)]})

    # The bounded sample goes to one task; the driver gets the weights that aren't zero.
    few = rows.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col("__y").alias("y")).groupBy("k", "y").agg(F.min("t").alias("t"))
    got = few.groupBy().applyInPandas(run, "at int, w double").collect()
    if not got:
        return None
    weights, base = np.zeros(FEATURES, np.float32), 0.0
    for r in got:
        if r.at < 0:
            base = r.w
        else:
            weights[r.at] = r.w
    return Model(weights, base)


class Scorer:
    def __init__(self, model: Model | None):
        self.model, self.known = model, {}
        self.leak = float(_softplus(np.array(model.base))) if model else 0.0

    def score(self, texts: list[str | None], locate: float | None = None) -> list[tuple[float, list]]:
        """→ score and, if locate is given, (start, end, score) of each sentence that has at least that score."""
        if self.model is None:
            return [(0.0, []) for _ in texts]
        known, base, theta = self.known, self.model.base, self.model.weights
        if len(known) > CACHE_ENTRIES:
            known.clear()
        docs = [sentences(t) for t in texts]
        for w in {w for d in docs for s in d for w in s}.difference(known):
            known[w] = weight_of(w, theta)
        of = known.__getitem__
        z = np.array([sum(map(of, set(s))) for d in docs for s in d], np.float64) + base
        more = np.maximum(0, _softplus(z) - self.leak)
        doc_of = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        total = self.leak + np.bincount(doc_of, more, len(docs))
        scores = (-np.expm1(-total)).tolist()
        # No sentence scores more than its document, leak included, so documents under `locate` have nothing to locate.
        return [(p, self._where(t, locate) if locate is not None and p >= locate - 1e-9 else []) for p, t in zip(scores, texts)]

    def _where(self, text: str | None, least: float) -> list[tuple[int, int, float]]:
        out, at = [], 0
        for m in [*_ends.finditer(text or ""), None]:
            end = m.start() if m else len(text or "")
            found = _letters.findall((text or "")[at:end].lower())
            if found:
                p = float(_sigmoid(self.model.base + sum(self.known[w] if w in self.known else weight_of(w, self.model.weights) for w in set(found))))
                if p >= least:
                    out.append((at, end, p))
            at = m.end() if m else end
        return out


def score_docs(docs: DataFrame, model: Model | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), locate: float | None = 0.3) -> DataFrame:
    """docs → keep..., score, offending: the sentences that reach `locate` (none if null), as code points start and end, and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for b in slices(batches, "__text"):
            found = scorer.score(b.column("__text").to_pylist(), locate)
            where = pa.array([[{"start": s, "end": e, "score": p} for s, e, p in w] for _, w in found], kind)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array([p for p, _ in found], pa.float64()), where], [*keep, "score", "offending"])

    types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, f"{types}, score double, offending array<struct<start:int,end:int,score:double>>")


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", threshold: float = 0.3, apart: Column | None = None, locate: float | None = 0.3) -> DataFrame:
    """docs → key, held_out, score, predicted, offending: learned from labels of keys that aren't held out."""
    apart = held_out(key) if apart is None else apart
    model = learn(docs, labels.filter(~apart), text, key, label)
    marked = docs.select(F.col(key), F.col(text).alias("__t"), apart.alias("held_out"))
    return score_docs(marked, model, "__t", (key, "held_out"), locate).select(key, "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "offending")


def without_toxic(docs: DataFrame, model: Model | None, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs without those that score `threshold` or more; whole rows, unshuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in slices(batches, text):
            yield b.filter(pa.array([p < threshold for p, _ in scorer.score(b.column(text).to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
