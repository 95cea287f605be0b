"""Byte-level BPE encoding and decoding by the ranks of a tiktoken file, equal to what the tiktoken library gives.

A text is cut into pre-tokens by the pattern, and each pre-token is merged by itself: of its neighbouring parts the pair
whose concatenation has the least rank goes first, the leftmost of equals. Pre-tokens met before are looked up.

Texts of up to CHUNK characters are encoded where they are read. A longer one is cut into chunks that overlap, which are
pre-tokenised in parallel, each as if the text began with it. A pre-token depends on nothing before it, so where a boundary
of one chunk is also one of the next, the two have the same boundaries from there on: the chunks are stitched at the first
such place, and only if the overlap has none (a word or number longer than it) the text is scanned on from the last sure
boundary until it meets one of a later chunk. The stitched segments are again dealt out, their pieces encoded in parallel,
and the ids of a text put together in order. Rows that repeat id and text are first counted and encoded once.

Letters, numbers and white space are those of the Unicode version that the library itself has: it is asked for them once,
on the driver. Ids are kept as little-endian unsigned 32-bit numbers in a binary value; decoding concatenates the bytes of
the ids, whatever they are, so any ids decode and those of a text give its UTF-8 bytes back.

Defined results: null and empty texts have no ids; null ids decode to no bytes, an id outside the vocabulary is an error.
Extra columns aren't read; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import heapq
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from pathlib import Path

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import arrow_map
from ._text import Remembered

DEFAULT_RANKS = "byte_bpe_multi_50k.tiktoken"
#: Characters of a chunk, and how many of the next chunk it also covers.
CHUNK, OVERLAP = 1 << 16, 1 << 9
#: Characters before the end of a cut text within which a pre-token could depend on what follows: 're, 've and 'll are
#: decided by three, and a pre-token that ends earlier has been ended by a character seen.
UNSURE = 3
#: Classes of the pattern whose characters depend on the Unicode version.
CLASSES = (r"\p{L}", r"\p{N}", r"\s")
#: A character above the basic plane.
ABOVE = re.compile("[\U00010000-\U0010ffff]")


def characters_of(cls: str) -> list[tuple[int, int]]:
    """All characters of a class, as ranges of code points, by the library's own tables."""
    single = {bytes([b]): b for b in range(256)}
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
    asked = tiktoken.Encoding("class", pat_str=cls, mergeable_ranks=single, special_tokens={})
    points = np.array([ord(c) for c in bytes(asked.encode_ordinary(everything)).decode()])
    starts = np.flatnonzero(np.diff(points, prepend=-2) != 1)
    ends = np.append(starts[1:], len(points)) - 1
    return list(zip(points[starts].tolist(), points[ends].tolist()))


def written(ranges: list[tuple[int, int]], least: int = 0, most: int = sys.maxunicode) -> str:
    """Ranges between two code points, inside a bracket expression."""
    return "".join(f"\\U{max(a, least):08x}-\\U{min(b, most):08x}" for a, b in ranges if a <= most and b >= least)


def patterns(pattern: str) -> tuple[str, str]:
    """The pattern for Python's re, for texts of the basic plane and for all texts. re tells characters of the basic plane
    by a table but tries the ranges above it one by one, so those are only tried on characters above it."""
    letters, numbers, blanks = map(characters_of, CLASSES)
    last, above = 0xFFFF, "\\U00010000-\\U0010ffff"
    out = []
    for wide in (False, True):

        def run(ranges: list[tuple[int, int]], negated: str = "", wide: bool = wide) -> str:
            low = f"[{negated}{written(ranges, 0, last)}{above if negated and wide else ''}]"
            return f"(?:{low}+|(?=[{above}])[{negated}{written(ranges, last + 1)}])+" if wide else f"{low}+"

        one = written(blanks)
        p = pattern.replace(r"[^\s\p{L}\p{N}]+", run(sorted(blanks + letters + numbers), "^")).replace(r"\S", f"[^{one}]")
        p = p.replace(r"\p{L}+", run(letters)).replace(r"\p{N}+", run(numbers)).replace(r"\s", f"[{one}]")
        if r"\p" in p:
            raise ValueError(f"a class of the pattern isn't known: {p[:200]}")
        out.append(p)
    return out[0], out[1]


@dataclass
class Ranks:
    """Ids by bytes and the patterns of pre-tokens, written out for Python's re."""

    ids: dict[bytes, int]
    narrow: str
    wide: str
    chunk: int = CHUNK
    overlap: int = OVERLAP

    def __post_init__(self) -> None:
        self._compiled = re.compile(self.narrow), re.compile(self.wide)

    def words(self, text: str) -> re.Pattern:
        """The pattern for a text."""
        return self._compiled[ABOVE.search(text) is not None]

    @classmethod
    def load(cls, path: str | None = None, pattern: str = public_tokenizers.PATTERN, chunk: int = CHUNK, overlap: int = OVERLAP) -> Ranks:
        lines = Path(path or public_tokenizers.path(DEFAULT_RANKS)).read_bytes().splitlines()
        ids = {base64.b64decode(token): int(i) for token, i in map(bytes.split, lines)}
        return cls(ids, *patterns(pattern), chunk, overlap)

    @cached_property
    def surface(self) -> list[bytes | None]:
        """Bytes of each id."""
        out: list[bytes | None] = [None] * (max(self.ids.values(), default=-1) + 1)
        for token, i in self.ids.items():
            out[i] = token
        return out


class Encoder(Remembered):
    """ids of each pre-token met so far, as little-endian bytes."""

    def __init__(self, ranks: Ranks):
        super().__init__()
        self.ids, self.words = ranks.ids, ranks.words

    def merged(self, piece: bytes) -> list[int]:
        """Merges in the order of ranks, by a heap of pairs over linked parts: n log n for a piece of n bytes."""
        whole = self.ids.get(piece)
        if whole is not None:
            return [whole]
        n, ids = len(piece), self.ids
        end = list(range(1, n + 1))  # of the part that starts here; 0 once it is merged into the one before
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ids.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, to = heapq.heappop(heap)
            middle = end[i]
            if not middle or middle >= n or end[middle] != to:  # one of the two has changed since
                continue
            end[i], end[middle] = to, 0
            if to < n:
                before[to] = i
                if (r := ids.get(piece[i : end[to]])) is not None:
                    heapq.heappush(heap, (r, i, end[to]))
            if (left := before[i]) >= 0 and (r := ids.get(piece[left:to])) is not None:
                heapq.heappush(heap, (r, left, to))
        out, at = [], 0
        while at < n:
            out.append(ids[piece[at : end[at]]])
            at = end[at]
        return out

    def make(self, key: str) -> bytes:
        return np.array(self.merged(key.encode()), dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.words(text).findall(text)))


def ends_of(words: re.Pattern, text: str) -> np.ndarray:
    return np.fromiter((m.end() for m in words.finditer(text)), dtype=np.int64)


def sure_ends(words: re.Pattern, text: str, last: bool) -> np.ndarray:
    """Ends of the pre-tokens of a chunk that don't depend on what follows it."""
    ends = ends_of(words, text)
    return ends if last else ends[ends <= len(text) - UNSURE]


def stitched(words: re.Pattern, text: str, chunk: int, ends: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(start, ends) of segments that together are the pre-tokens of the text; ends[i]: of chunk i, counted in the text.

    One segment a chunk, and one for each stretch that had to be scanned because two chunks didn't meet.
    """
    at, i, n = 0, 0, len(text)
    while at < n:
        own = ends[i]
        own = own[np.searchsorted(own, at, "right") :]
        if i + 1 < len(ends):
            meets = np.intersect1d(np.append(own, at), np.append(ends[i + 1], (i + 1) * chunk))
            if len(meets):
                own = own[: np.searchsorted(own, meets[0], "right")]
                if len(own):
                    yield at, own
                at, i = int(meets[0]), i + 1
                continue
        if len(own):
            yield at, own
            at = int(own[-1])
        start, scanned = at, []
        while at < n:  # from a sure boundary to one of a later chunk
            at = words.match(text, at).end()
            scanned.append(at)
            j = min(at // chunk, len(ends) - 1)
            if j > i and (at == j * chunk or (k := np.searchsorted(ends[j], at)) < len(ends[j]) and ends[j][k] == at):
                i = j
                break
        if scanned:
            yield start, np.array(scanned, dtype=np.int64)


def encode_long(texts: DataFrame, ranks: Ranks) -> DataFrame:
    """doc_id and ids of texts of more than a chunk; texts has doc_id, text."""
    spark, size, overlap = texts.sparkSession, ranks.chunk, ranks.overlap
    shared = spark.sparkContext.broadcast(ranks)
    kind = texts.schema["doc_id"].dataType.simpleString()
    once = texts.groupBy("doc_id", F.sha2("text", 256).alias("digest")).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("times"))
    number = F.explode(F.sequence(F.lit(0), F.ceil(F.length("text") / size).cast("int") - 1))
    cut = once.select("doc_id", "digest", "times", F.length("text").alias("n"), number.alias("chunk"), "text")
    chunks = cut.select("doc_id", "digest", "times", "chunk", ((F.col("chunk") + 1) * size >= F.col("n")).alias("last"), F.substring("text", F.col("chunk") * size + 1, F.lit(size + overlap)).alias("text"))
    dealt = chunks.repartition("doc_id", "digest", "chunk")

    def pretokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value.words
        for b in batches:
            ends = [sure_ends(words(t), t, last).astype("<i4").tobytes() for t, last in zip(b.column("text").to_pylist(), b.column("last").to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ends, pa.binary())], [*b.schema.names, "ends"])

    cut_up = arrow_map(dealt, pretokenise, f"doc_id {kind}, digest string, times long, chunk int, last boolean, text string, ends binary")

    def stitch(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk")
        text = "".join([t[:size] for t in rows["text"].iloc[:-1]]) + rows["text"].iloc[-1]
        ends = [np.frombuffer(e, dtype="<i4").astype(np.int64) + c * size for e, c in zip(rows["ends"], rows["chunk"])]
        parts = [(text[at : int(e[-1])], (e - at).astype("<i4").tobytes()) for at, e in stitched(shared.value.words(text), text, size, ends)]
        out = pd.DataFrame({"part": range(len(parts)), "text": [t for t, _ in parts], "ends": [e for _, e in parts]})
        return out.assign(doc_id=rows["doc_id"].iloc[0], digest=rows["digest"].iloc[0], times=rows["times"].iloc[0])[["doc_id", "digest", "times", "part", "text", "ends"]]

    segments = cut_up.groupBy("doc_id", "digest").applyInPandas(stitch, f"doc_id {kind}, digest string, times long, part int, text string, ends binary")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Encoder(shared.value)
        for b in batches:
            found = []
            for text, ends in zip(b.column("text").to_pylist(), b.column("ends").to_pylist()):
                cuts = np.frombuffer(ends, dtype="<i4").tolist()
                found.append(b"".join([e[text[lo:hi]] for lo, hi in zip([0, *cuts], cuts)]))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "digest", "times", "part")), pa.array(found, pa.binary())], ["doc_id", "digest", "times", "part", "ids"])

    encoded = arrow_map(segments.repartition("doc_id", "digest", "part"), pieces, f"doc_id {kind}, digest string, times long, part int, ids binary")
    ordered = F.array_sort(F.collect_list(F.struct("part", "ids")))
    whole = encoded.groupBy("doc_id", "digest").agg(F.first("times").alias("times"), ordered.alias("parts"))
    # an empty binary value first: Spark concatenates binary values as such
    joined = F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["ids"]))
    return whole.select("doc_id", joined.alias("ids"), "times").select("doc_id", "ids", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("doc_id", "ids")


def encode(docs: DataFrame, ranks: Ranks, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (binary: little-endian unsigned 32-bit numbers) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Encoder(shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(map(e.encode, b.column("text").to_pylist()), pa.binary())], ["doc_id", "ids"])

    short = arrow_map(own.filter(F.length("text") <= ranks.chunk), run, f"doc_id {kind}, ids binary")
    return short.unionByName(encode_long(own.filter(F.length("text") > ranks.chunk), ranks))


def decode(encoded: DataFrame, ranks: Ranks, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """encoded with the bytes of its ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)
    rest = encoded.drop(decoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surface = shared.value.surface
        for b in batches:
            found = [b"".join([surface[i] for i in np.frombuffer(x or b"", dtype="<u4").tolist()]) for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.binary())], [*b.schema.names, decoded])

    return arrow_map(rest, run, rest.withColumn(decoded, F.lit(b"")).schema)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, number of ids, and SHA-256 of the ids and of the bytes they decode to."""
    ranks = Ranks.load(path)
    both = decode(encode(docs, ranks), ranks)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
