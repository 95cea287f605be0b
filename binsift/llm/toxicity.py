"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A logistic model scores each sentence; the noisy-or of the sentence scores is the
document's score, 1 - prod(1 - p). The sentence weights are learned from document labels alone, by gradient descent on
the document's log loss, and then point at the sentences that carry a positive document.

Defined results: null and empty texts have no sentence and score 0. Repeated rows are scored alike, each on its own.
Extra columns of the input are ignored. Without labels of both kinds every score is 0.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import arrow_map, fold, sample_of_labels, texts_of
from ._text import Remembered

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W_]+")
#: Hashed feature space; the broadcast model has this many 4-byte weights whatever the corpus.
DIMENSIONS = 1 << 20
#: Bounds of the training sample: rows of each label, and characters of a row.
ROWS_PER_LABEL, MAX_CHARS = 2500, 20_000
SCHEMA = "doc_id long, score double, sentences array<struct<start:int,end:int,score:double>>"


def features(word: str) -> list[int]:
    """The hashed word and its prefixes of 4 to 6 letters, which stand for inflected forms."""
    keys = {f"={word}", *(f"^{word[:n]}" for n in (4, 5, 6) if len(word) >= n)}
    return sorted({zlib.crc32(k.encode("utf-8", "surrogatepass")) % DIMENSIONS for k in keys})


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def fit(rows: list[tuple[str, int]], rounds: int = 100, rate: float = 2.0, decay: float = 1e-5, min_docs: int = 5, start: float = -9.0) -> Model:
    """Learn sentence weights from (text, document label)."""
    model = Model(np.zeros(DIMENSIONS, dtype=np.float32), -30.0)
    if len({y for _, y in rows}) < 2:
        return model
    known: dict[str, list[int]] = {}
    df = np.zeros(DIMENSIONS + 1, dtype=np.int32)
    index, at, docs, y = array("i"), array("i"), array("i"), []
    for text, label in rows:
        docs.append(len(at))
        begin = len(index)
        for s in SENTENCE.findall(text.lower()) or [""]:
            at.append(len(index))
            found: set[int] = set()
            for w in WORD.findall(s):
                if w not in known:
                    known[w] = features(w)
                found.update(known[w])
            index.append(DIMENSIONS)
            index.extend(sorted(found))
        df[np.unique(np.array(index[begin:]))] += 1
        y.append(label)
    known.clear()
    feats, at, docs, y = np.frombuffer(index, np.int32), np.frombuffer(at, np.int32), np.frombuffer(docs, np.int32), np.array(y)
    # Rare features go; the one without weight that begins each sentence stays, so that none is without.
    keep = (df[feats] >= min_docs) | (feats == DIMENSIONS)
    at, feats = (np.cumsum(keep, dtype=np.int32)[at] - 1).astype(np.int32), feats[keep]
    columns = np.unique(feats)
    feats = np.searchsorted(columns, feats).astype(np.int32)
    w, bias, g2, gb2 = np.zeros(len(columns), dtype=np.float32), start, np.full(len(columns), 1e-8), 1e-8
    size = np.diff(np.append(at, len(feats)))
    doc_of = np.repeat(np.arange(len(docs), dtype=np.int32), np.diff(np.append(docs, len(at))))
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.add.reduceat(w[feats], at) + bias, -30, 30)))
        none = np.exp(np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-9)), docs))
        pull = np.where(y == 1, -none / np.maximum(1 - none, 1e-9), 1.0) * weight
        slope = p * pull[doc_of]
        g = np.bincount(feats, np.repeat(slope, size), len(columns)) / len(y) + decay * w
        gb = slope.sum() / len(y)
        g2, gb2 = g2 + g * g, gb2 + gb * gb
        g[columns == DIMENSIONS] = 0
        w, bias = (w - rate * g / np.sqrt(g2)).astype(np.float32), bias - 0.1 * rate * gb / np.sqrt(gb2)
    own = columns < DIMENSIONS
    model.weights[columns[own]] = w[own]
    model.bias = float(bias)
    return model


class _Weights(Remembered):
    """Sum of the weights of a word's features, remembered."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def make(self, word: str) -> float:
        return float(self.weights[features(word)].sum())


def sentence_scores(text: str, word: _Weights, bias: float) -> list[tuple[int, int, float]]:
    """(start, end, probability) of each sentence that has a word."""
    out = []
    get = word.__getitem__
    for m in SENTENCE.finditer(text.lower()):
        if words := WORD.findall(m[0]):
            z = bias + sum(map(get, set(words)))
            out.append((m.start(), m.end(), 1 / (1 + np.exp(-min(z, 30.0))) if z > -30 else 0.0))
    return out


def score(docs: DataFrame, model: Model, offending: float = 0.5) -> DataFrame:
    """doc_id, score and the sentences (character spans of the lower-cased text) whose own score reaches `offending`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        word = _Weights(m.weights)
        for b in batches:
            scores, spans = [], []
            for text in b.column("text").to_pylist():
                found = sentence_scores(text or "", word, m.bias)
                none = 1.0
                for x in found:
                    none *= 1 - x[2]
                scores.append(float(1 - none))
                spans.append([{"start": s, "end": e, "score": float(p)} for s, e, p in found if p >= offending])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64()), pa.array(spans, kind)], ["doc_id", "score", "sentences"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, SCHEMA)


def train(docs: DataFrame, labels: DataFrame, held_out_fold: int = 1, mod: int = 3, rows_per_label: int = ROWS_PER_LABEL, max_chars: int = MAX_CHARS) -> Model:
    """Fit on labelled rows outside the held-out fold; at most rows_per_label of each label."""
    learn = labels.filter(F.col("doc_id").isNotNull() & (fold(mod=mod) != held_out_fold))
    return fit(texts_of(docs, sample_of_labels(docs, learn, "toxic", rows_per_label, max_chars), max_chars))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted, sentences for every document."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", (fold() == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "sentences")
