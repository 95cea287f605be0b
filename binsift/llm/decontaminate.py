"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

One pass over the texts looks up the n-grams of the test items and keeps, for each text and item, the stretches of words
around hits. Every stretch, however many texts its n-grams are in, is aligned with its item by Smith-Waterman on words
(match 2, mismatch -1, gap -1) unless it holds too few of the item's words for any alignment to reach the threshold; the
score is the best alignment's over that of the whole item against itself, so edited and paraphrased copies score by what
is left of them.

Items are broadcast in blocks of about `block_chars` characters (one item, if that is longer), as sorted arrays, and each
block takes one pass over the texts, which are never shuffled. Public benchmarks together fill a few blocks.

Defined results: null and empty texts and items give no rows. Items of fewer than n words have one n-gram, all their
words. Rows that repeat an id, of texts or of items, are compared each on its own; ids give the best of their rows' scores,
and `clean` drops only the row that holds the copy. Null ids of items are left out. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import arrow_map, saved
from ._text import batches, gram_hashes, word_hashes

#: Words of a seed, score from which a text is contaminated.
WORDS, THRESHOLD = 4, 0.5
#: Characters of test items in one block.
BLOCK_CHARS = 16 << 20
MATCH, MISMATCH, GAP = 2, -1, -1
FOUND = "doc_id long, tkey long, item_id long, score double, start_word int, end_word int"
HITS = "doc_id long, tkey long, item int, stretches array<struct<start:int,words:binary>>"


@dataclass
class Items:
    """A block of test items: ids and word hashes by number, the sorted hashes of their n-grams with the item and offset
    each stands at, and a bit table of the upper bits of those hashes, which tells most other n-grams off at once."""

    ids: list[int]
    words: list[np.ndarray]
    grams: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    present: np.ndarray
    shift: np.uint64

    @classmethod
    def of(cls, rows: list[tuple[int, str]], n: int) -> Items:
        words = [(i, word_hashes([text])[0]) for i, text in rows]
        words = [(i, w) for i, w in words if len(w)]
        grams = [gram_hashes(w, min(n, len(w))) for _, w in words]
        size = [len(g) for g in grams]
        flat = np.concatenate([*grams, np.zeros(0, np.uint64)])
        order = np.argsort(flat, kind="stable")
        item = np.repeat(np.arange(len(words), dtype=np.int32), size)
        offset = np.concatenate([*(np.arange(k, dtype=np.int32) for k in size), np.zeros(0, np.int32)])
        bits = max(16, (32 * len(flat)).bit_length())
        present = np.zeros(1 << bits, dtype=bool)
        present[flat >> np.uint64(64 - bits)] = True
        return cls([i for i, _ in words], [w for _, w in words], flat[order], item[order], offset[order], np.packbits(present), np.uint64(64 - bits))

    def known(self, grams: np.ndarray) -> np.ndarray:
        """Positions of n-grams that may be of the block."""
        at = grams >> self.shift
        return np.flatnonzero(self.present[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8) & 1)

    def lookup(self, grams: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, item, offset) of each place where one of the n-grams stands in an item."""
        lo, hi = np.searchsorted(self.grams, grams[at], "left"), np.searchsorted(self.grams, grams[at], "right")
        many = hi - lo
        place = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())
        return np.repeat(at, many), self.item[place], self.offset[place]


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """Best local alignment score and the position after its last word, row by row over the item's words."""
    ramp = -GAP * np.arange(len(words) + 1)
    row = np.zeros(len(words) + 1, dtype=np.int64)
    best, end = 0, 0
    for w in item:
        step = np.maximum(row + GAP, 0)
        step[1:] = np.maximum(step[1:], row[:-1] + np.where(words == w, MATCH, MISMATCH))
        row = np.maximum.accumulate(step + ramp) - ramp  # gaps along the row
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
    return best, end


def _stretches(begin: list[int], size: int, n_words: int) -> list[tuple[int, int]]:
    """(start, end) of the stretches of a text that may hold an item of `size` words, from the places where its hits would
    have it begin (sorted): each half an item wider on both sides, overlapping ones united."""
    slack = size // 2 + 2
    out: list[list[int]] = []
    for x in begin:
        lo, hi = max(0, x - slack), min(n_words, x + size + slack)
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


def find_hits(docs: DataFrame, items: Items, n: int = WORDS) -> DataFrame:
    """Per text and item that share an n-gram: the stretches around hits."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it = shared.value
        length = np.array([len(w) for w in it.words], dtype=np.int64)
        sizes = sorted({min(n, int(k)) for k in length})
        stretch = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.binary())]))
        for b in parts:
            texts, ids, keys = (b.column(c).to_pylist() for c in ("text", "doc_id", "tkey"))
            rows = []
            for lo, hi in batches(texts):
                hashed, at = word_hashes(texts[lo:hi])
                found = []
                for k in sizes:
                    grams = gram_hashes(hashed, k)
                    p, item, offset = it.lookup(grams, it.known(grams))
                    doc = np.searchsorted(at, p, "right") - 1
                    ok = (np.minimum(length[item], n) == k) & (p + k <= at[doc + 1])
                    found.append(np.stack((doc[ok], item[ok], (p - at[doc] - offset)[ok])))
                doc, item, begin = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
                order = np.lexsort((begin, item, doc))
                doc, item, begin = doc[order], item[order], begin[order]
                cuts = np.flatnonzero((np.diff(doc) != 0) | (np.diff(item) != 0)) + 1 if len(doc) else np.zeros(0, np.int64)
                for x, y in zip([0, *cuts], [*cuts, len(doc)] if len(doc) else []):
                    d, k = int(doc[x]), int(item[x])
                    own = hashed[at[d] : at[d + 1]]
                    spans = _stretches(begin[x:y].tolist(), int(length[k]), len(own))
                    rows.append((ids[lo + d], keys[lo + d], k, [{"start": s, "words": own[s:e].tobytes()} for s, e in spans]))
            kinds = [pa.int64(), pa.int64(), pa.int32(), stretch]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["doc_id", "tkey", "item", "stretches"])

    text = F.col("text").cast("string")
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tkey"), text.alias("text")), run, HITS)


def aligned(hits: DataFrame, items: Items, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, tkey, item_id, score, start_word, end_word) of the best alignment of each text and item that reaches threshold."""
    shared = hits.sparkSession.sparkContext.broadcast((items.ids, items.words))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words = shared.value
        for b in parts:
            rows = []
            for doc, tkey, item, stretches in zip(*(b.column(c).to_pylist() for c in ("doc_id", "tkey", "item", "stretches"))):
                best = None
                own = words[item]
                for s in stretches:
                    text = np.frombuffer(s["words"], dtype=np.uint64)
                    if np.isin(own, text).sum() < threshold * len(own):  # a word of the item matches at most once
                        continue
                    score, end = align(own, text)
                    if score >= threshold * MATCH * len(own) and (best is None or score > best[0]):
                        _, back = align(own[::-1], text[:end][::-1])
                        best = score, s["start"] + end - back, s["start"] + end
                if best:
                    rows.append((doc, tkey, ids[item], best[0] / (MATCH * len(own)), best[1], best[2]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["doc_id", "tkey", "item_id", "score", "start_word", "end_word"])

    return arrow_map(hits, run, FOUND)


def _copies(docs: DataFrame, benchmark: DataFrame, n: int, threshold: float, block_chars: int) -> DataFrame:
    """FOUND of every row of docs and row of benchmark."""
    tests = benchmark.filter(F.col("item_id").isNotNull() & (F.length("text") > 0)).select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = tests.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first().n
    blocks = -(-size // block_chars)
    out = docs.sparkSession.createDataFrame([], FOUND)
    for k in range(blocks):
        rows = tests.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).distinct().collect()
        items = Items.of(sorted((r.item_id, r.text) for r in rows), n)
        out = out.unionByName(aligned(saved(find_hits(docs, items, n)), items, threshold))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, score, start_word, end_word of every text that holds a copy of a test item, best copy first kept."""
    best = F.max_by(F.struct("score", "start_word", "end_word"), F.struct("score", -F.col("start_word"), -F.col("end_word")))
    found = _copies(docs, benchmark, n, threshold, block_chars)
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.score", "b.start_word", "b.end_word")


def clean(docs: DataFrame, benchmark: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents without a copy of a test item; of rows that repeat an id, null or not, only those with a copy go.
    Extra columns stay."""
    gone = _copies(docs, benchmark, n, threshold, block_chars).select(F.col("doc_id").alias("_id"), F.col("tkey").alias("_key")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(docs["text"].cast("string")) == F.col("_key")), "left_anti")
