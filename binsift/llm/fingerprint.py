"""Context-triggered piecewise hashing of whole texts.

A rolling hash of 7 bytes ends a chunk wherever it falls on a residue of the block size; each chunk becomes one of 64
signature characters. The block size (3 * 2**i) follows the length and is halved while the signature stays short. A
fingerprint is `size:signature:signature at twice the size`, so fingerprints of sizes up to a factor of two compare: by
the edit distance of inserts and deletes between signatures (runs cut to three), as a likeness 2 * kept / both lengths,
0 unless they share five characters in a row.

Defined results: null counts as empty; the empty text's fingerprint is `3::`, equal to itself with likeness 1. Equal
texts have equal fingerprints. Rows of equal doc_id follow each other in the order of two hashes of the text; null ids
come after all others. Extra columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import arrow_map, saved
from ._text import CHUNK, mix, prefix_hash, powers

WINDOW, SMALLEST, LENGTH, COMMON = 7, 3, 64, 5
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_LETTERS = np.frombuffer(ALPHABET.encode(), dtype=np.uint8)
_RUN = re.compile(r"(.)\1{3,}")
COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, part int, edge int, text string"


def rolled(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Trigger value and content value of each position: both from the hash of the 7 bytes that end there."""
    trigger, content = [], []
    for lo in range(0, len(raw), CHUNK):
        data = np.frombuffer(bytes(max(0, WINDOW - 1 - lo)) + raw[max(0, lo - WINDOW + 1) : lo + CHUNK], dtype=np.uint8)
        p = prefix_hash(data)
        h = mix((p[WINDOW:] - p[:-WINDOW]) * powers(len(p), True)[: len(p) - WINDOW])
        trigger.append((h >> np.uint64(32)).astype(np.uint32))
        content.append((h & np.uint64(63)).astype(np.uint8))
    return np.concatenate(trigger or [np.zeros(0, np.uint32)]), np.concatenate(content or [np.zeros(0, np.uint8)])


def signature(trigger: np.ndarray, content: np.ndarray, size: int) -> str:
    ends = np.flatnonzero(trigger % np.uint32(size) == size - 1)
    starts = np.concatenate(([0], ends + 1))
    starts = starts[starts < len(content)]
    if not len(starts):
        return ""
    return _LETTERS[np.add.reduceat(content, starts, dtype=np.uint32) & 63].tobytes().decode()


def fingerprint(text: str) -> str:
    raw = text.encode("utf-8", "surrogatepass")
    trigger, content = rolled(raw)
    size = SMALLEST
    while size * LENGTH < len(raw):
        size *= 2
    first = signature(trigger, content, size)
    second = None
    while size > SMALLEST and len(first) < LENGTH // 2:
        size //= 2
        first, second = signature(trigger, content, size), first
    return f"{size}:{first}:{signature(trigger, content, size * 2) if second is None else second}"


def kept(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel: what inserts and deletes leave of both."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def _alike(a: str, b: str) -> float:
    if a == b:
        return 1.0
    a, b = _RUN.sub(r"\1\1\1", a), _RUN.sub(r"\1\1\1", b)
    pieces = {a[i : i + COMMON] for i in range(len(a) - COMMON + 1)}
    if not any(b[i : i + COMMON] in pieces for i in range(len(b) - COMMON + 1)):
        return 0.0
    return 2 * kept(a, b) / (len(a) + len(b))


def likeness(x: str, y: str) -> float:
    """0 to 1; 0 where the block sizes don't compare, 1 for equal fingerprints."""
    if x == y:
        return 1.0
    (sx, x1, x2), (sy, y1, y2) = x.split(":"), y.split(":")
    size_x, size_y = int(sx), int(sy)
    if size_x == size_y:
        return max(_alike(x1, y1), _alike(x2, y2) if x2 and y2 else 0.0)
    if size_x == 2 * size_y:
        return _alike(x1, y2)
    if size_y == 2 * size_x:
        return _alike(x2, y1)
    return 0.0


def edited(text: str, following: str) -> str:
    """The text with its last third of code points replaced by the first as many of the following text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _row(doc_id: int | None, text: str, own: str, following: str, next_print: str) -> tuple:
    changed = edited(text, following)
    other = own if changed == text else fingerprint(changed)
    return doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), own, other, likeness(own, other), likeness(own, next_print)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], [*COLUMNS, "part", "edge", "text"])


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order: each is finished when its follower arrives; a partition's first and last row go out as edges."""
    part = TaskContext.get().partitionId()
    last = None
    for b in batches:
        out = []
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            text = text or ""
            own = fingerprint(text)
            if last is None:
                out.append((doc_id, None, None, None, None, None, None, part, 0, text))
            else:
                out.append((*_row(*last, text, own), None, None, None))
            last = doc_id, text, own
        yield _batch(out)
    if last is not None:
        yield _batch([(last[0], None, None, None, None, None, None, part, 1, last[1])])


def _joints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last row of a partition with the text of the first row of the next one."""
    for b in batches:
        rows = []
        for doc_id, text, following in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "following"))):
            rows.append((*_row(doc_id, text, fingerprint(text), following, fingerprint(following)), None, None, None))
        yield _batch(rows)


def chained(docs: DataFrame) -> DataFrame:
    """The columns COLUMNS for every document; the next document is the one with the next lower doc_id.

    The texts are dealt once, by ranges of doc_id and, where many rows have one, of the text's hash and the row's place.
    Only the rows at the ends of ranges meet in a second, small step: a join on the numbers of the ranges.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.desc("doc_id"), F.col("h1"), F.col("h2"), F.col("place")]
    keyed = own.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(7), F.col("text")), "place": F.monotonically_increasing_id()})
    found = saved(arrow_map(keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text"), _along, SCHEMA))
    edges = found.filter(F.col("edge").isNotNull())
    firsts, lasts = edges.filter("edge = 0").select("part", F.col("text").alias("following")), edges.filter("edge = 1").select("part", "doc_id", "text")
    # One number for each range: the next range that holds rows, after the last one the first.
    numbers = Window.orderBy("part")
    after = firsts.select("part").select("part", F.coalesce(F.lead("part").over(numbers), F.first("part").over(numbers)).alias("after"))
    joints = lasts.join(after, "part").select("doc_id", "text", "after").join(firsts.withColumnRenamed("part", "after"), "after").select("doc_id", "text", "following")
    return found.filter(F.col("edge").isNull()).select(*COLUMNS).unionByName(arrow_map(joints, _joints, SCHEMA).select(*COLUMNS))
