"""Vectorised text primitives shared by the corpus operators.

A *word* is a maximal run of ASCII letters, digits, underscores or non-ASCII characters of the lower-cased text.
Words and n-grams are compared by 64-bit hashes that depend only on their bytes: differences of a prefix polynomial
hash modulo 2**64, brought to a common origin with the inverse power of the (odd) base, then finalised.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

WORD_RE = re.compile(r"[0-9A-Za-z_\x80-\U0010ffff]+")
#: Bytes hashed at a time; bounds the memory of the arrays below whatever a text's length.
CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_WORD = np.array([chr(b).isalnum() or b == 95 or b >= 128 for b in range(128)] + [True] * 128)
_VALUE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """At least n powers of the base (or of its inverse) modulo 2**64, from the 0th on."""
    have = _powers.get(inverse)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        base = np.full(size, _INVERSE if inverse else _BASE, dtype=np.uint64)
        base[0] = 1
        have = _powers[inverse] = np.multiply.accumulate(base)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values (splitmix64's last step), so that every bit depends on every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = sum of value(data[k]) * base**k for i <= k < j."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_VALUE[data] * powers(len(data))[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end], the same wherever those bytes stand."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix), True)[start])


def _slices(raw: bytes) -> Iterator[tuple[int, bytes]]:
    """Pieces of about CHUNK bytes that end between words."""
    at = 0
    while len(raw) - at > CHUNK:
        end = at + CHUNK
        while end < len(raw) and _WORD[raw[end]]:
            end += 1
        yield at, raw[at:end]
        at = end
    yield at, raw[at:]


def words_of(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end offsets and hashes of the words of lower-cased UTF-8 bytes."""
    parts = []
    for at, piece in _slices(raw):
        data = np.frombuffer(piece, dtype=np.uint8)
        edge = np.diff(np.concatenate(([False], _WORD[data], [False])).view(np.int8))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        parts.append((start + at, end + at, span_hash(prefix_hash(data), start, end)))
    return tuple(np.concatenate(x) for x in zip(*parts))  # type: ignore[return-value]


def batches(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Row ranges of about CHUNK characters each."""
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= CHUNK:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and offsets of each text in them (one more than texts)."""
    raws = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    start, _, hashed = words_of(b"\n".join(raws))
    ends = np.cumsum([len(r) + 1 for r in raws])
    return hashed, np.concatenate(([0], np.searchsorted(start, ends)))


def gram_hashes(hashed: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words: len(hashed) - n + 1 values (none if fewer words)."""
    if len(hashed) < n:
        return np.zeros(0, dtype=np.uint64)
    m = len(hashed) - n + 1
    out = np.zeros(m, dtype=np.uint64)
    for j in range(n):
        out = out * np.uint64(_BASE) + hashed[j : j + m]
    return mix(out)


class Remembered(dict):
    """A bounded cache in two turns: when the younger half is full it becomes the older one, from which values still in
    use come back without being made again. Keys of over `longest` characters are made anew each time: texts without
    blanks are one word, and keeping those would hold whole texts."""

    size, longest = 200_000, 48

    def __init__(self) -> None:
        super().__init__()
        self.old: dict = {}

    def make(self, key):  # noqa: ANN001, ANN201
        raise NotImplementedError

    def turn(self) -> None:
        self.old = dict(self)
        self.clear()

    def __missing__(self, key):  # noqa: ANN001, ANN204
        if len(key) > self.longest:
            return self.make(key)
        if len(self) >= self.size // 2:
            self.turn()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value
