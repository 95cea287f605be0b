"""Quality by Bradley-Terry pairwise ranking.

Documents get a score w.x so that P(a preferred to b) = sigmoid(w.(x_a - x_b)). The preference pairs put a document
labelled good above one labelled poor; w minimises the logistic loss on the feature differences. The cut lies at the
score quantile that the labels' share of poor documents names, over the scores of all labelled documents that may be
learned from; scores are moved so that 0.3 is that cut.

Defined results: null and empty texts have all features 0 and are scored like any other. Repeated rows are scored alike.
Extra columns of the input are ignored. Without labels of both kinds every score is 0.5.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import arrow_map, fold, sample_of_labels, saved, texts_of

#: Bounds of the training sample: rows of each label, characters of a row, preference pairs drawn from them.
ROWS_PER_LABEL, MAX_CHARS, PAIRS = 3000, 20_000, 40_000
SCHEMA = "doc_id long, raw double"
_CLASS = np.zeros(256, dtype=np.int64)
for _k, _c in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n", b".,", b"!?;:'\"()-", b"#$%&*+/<=>@[\\]^_`{|}~"), 1):
    _CLASS[list(_c)] = _k
_SENTENCE = re.compile(r"[.!?]")


def _squeezed(raw: bytes, piece: int = 1 << 20) -> int:
    """Bytes of the compressed text, which is given and measured piece by piece."""
    z = zlib.compressobj(1)
    return sum(len(z.compress(raw[i : i + piece])) for i in range(0, len(raw), piece)) + len(z.flush())


def features(text: str) -> list[float]:
    """Shares of character classes, repetition, word and line shape of a whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    counts = np.bincount(_CLASS, np.bincount(np.frombuffer(raw, np.uint8), minlength=256), 9)
    upper, lower, digit, space, line, stop, mark, symbol = (float(x) for x in counts[1:])
    other = float(counts[0])
    words = text.split()
    w = max(1, len(words))
    same = sum(map(str.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:]))) if w > 1 else 1
    lines = text.split("\n")
    letters = max(1.0, upper + lower + other)
    squeezed = _squeezed(raw) / n
    distinct = len(set(words))
    longest = len(max(words, key=len, default=""))
    return [
        upper / letters, symbol / n, mark / n, stop / n, digit / n, space / n, line / n, same / w, distinct / w, pairs / max(1, w - 1), squeezed,
        min(squeezed, 0.35), float(squeezed < 0.2), sum(map(len, words)) / w, np.log1p(len(words)), np.log1p(longest), len(set(lines)) / len(lines), np.log1p(stop + mark) / np.log1p(w + 1.0),
        float(upper / letters > 0.5), float(symbol / n > 0.03), float(same / w > 0.2), float(distinct / w < 0.3), np.log1p(w / (1 + len(_SENTENCE.findall(text)))), float(len(words) < 20),
    ]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights


def fit(rows: list[tuple[str, int]], pairs: int = PAIRS, rounds: int = 600, decay: float = 1e-4) -> Model:
    """Learn from (text, label): preference pairs, logistic loss on feature differences."""
    width = len(features(""))
    y = np.array([label for _, label in rows])
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(width), np.ones(width), np.zeros(width))
    x = np.array([features(t) for t, _ in rows])
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = (x - mean) / scale
    draw = np.random.default_rng(4)
    good, poor = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    d = z[draw.choice(good, pairs)] - z[draw.choice(poor, pairs)]
    w, m, v = np.zeros(width), np.zeros(width), np.zeros(width)
    for t in range(1, rounds + 1):
        lost = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        g = -(lost @ d) / pairs + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return Model(mean, scale, w)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and raw, the Bradley-Terry score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            if b.num_rows:
                raw = m.raw(np.array([features(t or "") for t in b.column("text").to_pylist()]))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(raw)], ["doc_id", "raw"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, SCHEMA)


def learnable(labels: DataFrame, held_out_fold: int = 0, mod: int = 5) -> DataFrame:
    """Labels outside the held-out fold."""
    return labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (fold(mod=mod) != held_out_fold))


def train(docs: DataFrame, learn: DataFrame, rows_per_label: int = ROWS_PER_LABEL, max_chars: int = MAX_CHARS) -> Model:
    """Fit on a bounded sample of labelled rows that have a text."""
    return fit(texts_of(docs, sample_of_labels(docs, learn, "quality", rows_per_label, max_chars), max_chars))


def cut_at(scored: DataFrame, learn: DataFrame) -> float:
    """The score below which the share of documents lies that the labels call poor: the quantile over all documents with
    a label that may be learned from; a label that rows repeat counts once. 0 without any."""
    both = scored.join(learn.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").distinct(), "doc_id")
    poor = both.agg(F.avg((F.col("quality") == 0).cast("double")).alias("share")).first().share
    if poor is None:
        return 0.0
    return both.agg(F.percentile_approx("raw", F.lit(poor), F.lit(100_000)).alias("cut")).first().cut


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, raw for every document."""
    learn = learnable(labels)
    scored = saved(score(docs, train(docs, learn)))
    known = learn.select("quality").distinct().count() == 2
    shift = math.log(threshold / (1 - threshold)) - cut_at(scored, learn) if known else 0.0
    x = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("raw") + F.lit(shift)))
    return scored.select("doc_id", (fold(mod=5) == 0).alias("held_out"), (1 / (1 + F.exp(-x))).alias("score"), "raw").select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "raw")
