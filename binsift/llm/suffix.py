"""Removal of repeated byte strings by a hash-compared suffix sort.

Every byte that a string of `length` bytes covers which also starts anywhere else, in any document, goes. Exact, at any
size, without sorting all suffixes of the corpus:

1. Anchors. In each window of a text the least hash of its runs of ANCHOR bytes marks an anchor; equal strings of `length`
   bytes have equal anchors at equal places, so a string can only repeat where an anchor repeats.
2. Contexts. Around each repeated anchor stands all that strings over it can hold. Equal contexts, told by 128 bits of
   hash, are counted as one; so are equal texts.
3. Suffix sort. The contexts of an anchor are sorted by the anchor with what follows it and by what precedes it (read
   backwards), in a mergesort whose comparisons find the common extension by binary search on prefix polynomial hashes,
   and are verified on the bytes. In sorted order, common extensions of at least r bytes form classes; a string over the
   anchor repeats if another context is in its class on both sides.
4. Anchors with very many contexts don't go to one task: their strings are counted one by one, each by its place over
   the anchor and its bytes.
5. The repeated strings of each context go back to the places it stands at, and the bytes are cut.

Defined results: null counts as empty. Texts shorter than `length` lose nothing. Rows that repeat an id or text, or both,
are documents of their own, so equal texts repeat each other; work grows in proportion to their number. Null ids are kept. Extra columns of the input are ignored. Empty
tables give empty tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import arrow_map, saved
from ._text import mix, powers, prefix_hash, span_hash

LENGTH, ANCHOR = 200, 100
#: Contexts that are sorted at a time, more only if one anchor has more; one with more places than HOT has its strings
#: counted instead, so no task holds more contexts of an anchor.
BATCH, HOT = 8_192, 16_384
#: Bytes of a text whose anchors are found at a time.
PIECE = 1 << 20


def _slide(x: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """op over each run of `width` values."""
    size = 1
    while size * 2 <= width:
        x = op(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return op(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(raw: bytes, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of a text, none if it is shorter than length."""
    width = length - anchor + 1
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for lo in range(0, max(0, len(raw) - length + 1), PIECE):
        # Windows that start in this piece; their anchors may be found by the next piece too.
        data = np.frombuffer(raw[lo : lo + PIECE + length - 1], dtype=np.uint8)
        p = prefix_hash(data)
        m = len(data) - anchor + 1
        g = mix((p[anchor:] - p[:-anchor]) * powers(len(p), True)[:m])
        least = _slide(g, width, np.minimum)
        pad = np.zeros(width - 1, dtype=np.uint64)
        at = np.flatnonzero(g == _slide(np.concatenate((pad, least, pad)), width, np.maximum))
        found.append((at + lo, g[at]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, first = np.unique(np.concatenate([x for x, _ in found]), return_index=True)
    return at, np.concatenate([g for _, g in found])[first]


# -- the suffix sort ---------------------------------------------------------------------------------------------------


class Suffixes:
    """Strings in one buffer, group by group, that are compared by prefix hashes."""

    def __init__(self, strings: list[bytes], group: np.ndarray):
        self.strings, self.group = strings, group
        self.size = np.fromiter(map(len, strings), np.int64, len(strings))
        self.start = np.concatenate(([0], np.cumsum(self.size)[:-1])).astype(np.int64)
        self.data = np.frombuffer(b"".join(strings) + b"\0", dtype=np.uint8)
        self.prefix = prefix_hash(self.data)
        self.inverse = powers(len(self.prefix), True)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common prefix of strings i and j: binary search on hash equality."""
        a, b = self.start[i], self.start[j]
        ia, ib = self.inverse[a], self.inverse[b]
        lo, hi = np.zeros(len(i), dtype=np.int64), np.minimum(self.size[i], self.size[j])
        while (lo < hi).any():
            mid = (lo + hi + 1) >> 1
            same = (self.prefix[a + mid] - self.prefix[a]) * ia == (self.prefix[b + mid] - self.prefix[b]) * ib
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def less(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        n = self.common(i, j)
        ends_i, ends_j = n >= self.size[i], n >= self.size[j]
        return np.where(ends_i | ends_j, ends_i & ~ends_j, self.data[self.start[i] + n] < self.data[self.start[j] + n])

    def _count(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray, order: np.ndarray, equal: bool) -> np.ndarray:
        """Of the sorted run order[lo:hi], how many are less than x, or not greater if equal."""
        base = lo.copy()
        while (active := np.flatnonzero(lo < hi)).size:
            mid = (lo[active] + hi[active]) >> 1
            y = order[mid]
            before = ~self.less(x[active], y) if equal else self.less(y, x[active])
            lo[active], hi[active] = np.where(before, mid + 1, lo[active]), np.where(before, hi[active], mid)
        return lo - base

    def sort(self) -> tuple[np.ndarray, np.ndarray]:
        """Order of the strings by group, then bytes, and common prefixes with the one before (-1 at a group's start)."""
        n = len(self.strings)
        order, width = np.arange(n), 1
        while width < n:
            place = np.arange(n)
            head = place // (2 * width) * (2 * width)
            middle, end = np.minimum(head + width, n), np.minimum(head + 2 * width, n)
            left = place < middle
            # Runs of different groups are in order already; only a group that both runs share is merged.
            shared = middle < end
            shared &= self.group[order[np.minimum(middle, n - 1)]] == self.group[order[middle - 1]]
            mine = np.flatnonzero(shared & (self.group[order] == self.group[order[middle - 1]]))
            to = place.copy()
            for side in (True, False):
                q = mine[left[mine] == side]
                if not q.size:
                    continue
                g = self.group[order[q]]
                lo, hi = (middle[q], end[q]) if side else (head[q], middle[q])
                # The shared group's part of the other run: groups are sorted, so it is found by bisection.
                ranks = self.group[order]
                lo, hi = (lo, np.minimum(hi, np.searchsorted(ranks, g, "right"))) if side else (np.maximum(lo, np.searchsorted(ranks, g, "left")), hi)
                ahead = self._count(order[q], lo.copy(), hi.copy(), order, not side)
                to[q] = q + ahead if side else q - (hi - lo) + ahead
            merged = np.empty(n, dtype=np.int64)
            merged[to] = order
            order, width = merged, 2 * width
        common = np.full(n, -1, dtype=np.int64)
        inside = np.flatnonzero(self.group[order[1:]] == self.group[order[:-1]]) + 1 if n > 1 else np.zeros(0, np.int64)
        common[inside] = self.common(order[inside - 1], order[inside])
        if not self._verified(order, common, inside):  # hashes collided: compare bytes
            order = np.array(sorted(range(n), key=lambda k: (self.group[k], self.strings[k])), dtype=np.int64)
            common[inside] = [self._bytes_common(self.strings[order[k - 1]], self.strings[order[k]]) for k in inside]
        return order, common

    @staticmethod
    def _bytes_common(a: bytes, b: bytes) -> int:
        n = min(len(a), len(b))
        return next((k for k in range(n) if a[k] != b[k]), n)

    def _verified(self, order: np.ndarray, common: np.ndarray, inside: np.ndarray) -> bool:
        """Whether neighbours really share the bytes they seem to, and differ as their order says after them."""
        if not inside.size:
            return True
        i, j, n = order[inside - 1], order[inside], common[inside]
        width = int(n.max()) if n.size else 0
        for lo in range(0, inside.size, 4096):
            k = np.arange(width)
            a, b, m = self.start[i[lo : lo + 4096], None] + k, self.start[j[lo : lo + 4096], None] + k, n[lo : lo + 4096, None]
            top = len(self.data) - 1
            if ((self.data[np.minimum(a, top)] != self.data[np.minimum(b, top)]) & (k < m)).any():
                return False
        ended = n >= self.size[i]
        return bool((ended | ((n < self.size[j]) & (self.data[np.minimum(self.start[i] + n, len(self.data) - 1)] < self.data[np.minimum(self.start[j] + n, len(self.data) - 1)]))).all())


def repeated_strings(group: np.ndarray, left: list[bytes], right: list[bytes], many: np.ndarray, around: int, anchor: int = 0) -> np.ndarray:
    """For each context (row) and each number x of bytes before the anchor (column): does that string repeat?

    left holds the bytes before the anchor read backwards, right the anchor and those after it; a string takes x of the one
    and anchor + around - x of the other. Contexts that stand at many places repeat all their strings.
    """
    n = len(left)
    size_l, size_r = np.fromiter(map(len, left), np.int64, n), np.fromiter(map(len, right), np.int64, n)
    (order_l, common_l), (order_r, common_r) = Suffixes(left, group).sort(), Suffixes(right, group).sort()
    out = np.zeros((n, around + 1), dtype=bool)
    class_l, class_r = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    for x in range(around + 1):
        rows = np.flatnonzero((size_l >= x) & (size_r >= anchor + around - x))
        if not rows.size:
            continue
        class_l[order_l] = np.cumsum(common_l < x)
        class_r[order_r] = np.cumsum(common_r < anchor + around - x)
        key = class_l[rows] * (n + 1) + class_r[rows]
        by = np.argsort(key)
        key = key[by]
        same = np.flatnonzero(key[1:] == key[:-1])
        out[rows[by[same]], x] = out[rows[by[same + 1]], x] = True
        out[rows[many[rows]], x] = True
    return out


# -- the stages on tables ----------------------------------------------------------------------------------------------


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _anchor_rows(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    """(h, t1, t2, at) of every anchor of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                found = [anchors(_raw(t), length, anchor) for t in part.column("text").to_pylist()]
                n = [len(at) for at, _ in found]
                keys = [pa.array(np.repeat(part.column(c).to_numpy(zero_copy_only=False), n)) for c in ("t1", "t2")]
                at = np.concatenate([at for at, _ in found]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([h for _, h in found]).view(np.int64)), *keys, pa.array(at)], ["h", "t1", "t2", "at"])

    return arrow_map(docs.filter(F.octet_length("text") >= length).select("t1", "t2", "text"), run, "h long, t1 long, t2 long, at int")


def _packed(docs: DataFrame) -> DataFrame:
    """(t1, t2, doc_id, packed): compressed texts, for the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("t1"), b.column("t2"), b.column("doc_id"), pa.array([pack(_raw(t)) for t in b.column("text").to_pylist()], pa.binary())], ["t1", "t2", "doc_id", "packed"])

    return arrow_map(docs.select("t1", "t2", "doc_id", "text"), run, "t1 long, t2 long, doc_id long, packed binary")


def unpack(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed, max_output_size=0) if packed else b""


_CONTEXT = "kind int, t1 long, t2 long, doc_id long, packed binary, n_bytes long, kept_sha256 string, h long, s long, at int, many int, lefts binary, rights binary"


def _contexts(joined: DataFrame, length: int, anchor: int) -> DataFrame:
    """Kinds of rows: 0 texts without a repeated anchor, finished; 1 other texts; 2 a place of a context; 3 a context
    to sort, once per task; 4 a string of a context to count, once per task. Equal texts come one after another: the
    first gives its places and contexts, the second its contexts once more, those after it repeat nothing new."""
    around = length - anchor
    names = [x.split()[0] for x in _CONTEXT.split(", ")]
    kinds = dict(zip(names, [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]))

    def table(n: int, **columns: object) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in kinds.items()], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], list] = {}
        counted: dict[tuple[int, int, int, bytes], int] = {}
        last, copies = None, 0

        def out() -> Iterator[pa.RecordBatch]:
            if seen:
                v = list(seen.values())
                yield table(len(v), kind=[3] * len(v), h=[k[0] for k in seen], s=[k[1] for k in seen], many=[x[0] for x in v], lefts=[x[1] for x in v], rights=[x[2] for x in v])
                seen.clear()
            if counted:
                k = list(counted)
                for lo in range(0, len(k), 10_000):
                    c = k[lo : lo + 10_000]
                    yield table(len(c), kind=[4] * len(c), h=[x[0] for x in c], s=[x[1] for x in c], at=[x[2] for x in c], lefts=[x[3] for x in c], many=[counted[x] for x in c])
                counted.clear()

        for b in batches:
            done, texts, owners, fresh, raws, cuts, where, spots, prints, anchored, hots = ([] for _ in range(11))
            sizes = pc.list_value_length(b.column("ats")).fill_null(0).to_numpy(zero_copy_only=False)
            flat = [b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("ats", "hs", "hots")]
            ends = np.cumsum(sizes)
            for t1, t2, doc_id, packed, n, end in zip(*(b.column(c).to_pylist() for c in ("t1", "t2", "doc_id", "packed")), sizes.tolist(), ends.tolist()):
                raw = unpack(packed)
                if not n:
                    done.append((doc_id, len(raw), hashlib.sha256(raw).hexdigest()))
                    continue
                texts.append((t1, t2, doc_id, packed, len(raw)))
                last, copies = (t1, t2), copies + 1 if last == (t1, t2) else 0
                if copies > 1:
                    continue
                at, h, hot = (x[end - n : end] for x in flat)
                at = at.astype(np.int64)
                lo, hi = np.maximum(at - around, 0), np.minimum(at + length, len(raw))
                s = np.empty(n, dtype=np.uint64)
                for k in range(0, n, 4096):  # contexts of a stretch of the text, hashed from the stretch's start
                    x, y = int(lo[k : k + 4096].min()), int(hi[k : k + 4096].max())
                    if y - x <= 2 * PIECE:
                        s[k : k + 4096] = span_hash(prefix_hash(np.frombuffer(raw[x:y], dtype=np.uint8)), lo[k : k + 4096] - x, hi[k : k + 4096] - x)
                    else:
                        for q in range(k, min(k + 4096, n)):
                            s[q] = span_hash(prefix_hash(np.frombuffer(raw[lo[q] : hi[q]], np.uint8)), np.array([0]), np.array([hi[q] - lo[q]]))[0]
                owners.append((t1, t2))
                fresh.append(np.full(n, copies == 0))
                raws.append(raw)
                cuts.append((lo, hi))
                where.append(np.full(n, len(raws) - 1))
                spots.append(at)
                prints.append(mix(s + (at - lo).astype(np.uint64)).view(np.int64))
                anchored.append(h.astype(np.int64))
                hots.append(hot.astype(bool))
            if raws:
                at, s, h, doc, hot = (np.concatenate(x) for x in (spots, prints, anchored, where, hots))
                lo, hi = (np.concatenate(x) for x in zip(*cuts))
                own, new = np.array(owners, dtype=np.int64), np.concatenate(fresh)
                yield table(int(new.sum()), kind=np.full(int(new.sum()), 2), t1=own[doc[new], 0], t2=own[doc[new], 1], h=h[new], s=s[new], at=at[new].astype(np.int32))
                cool = np.flatnonzero(~hot)
                _, first, many = np.unique(s[cool], return_index=True, return_counts=True)
                first = cool[first]
                for k, g, p, d, x, y, z, m in zip(first.tolist(), h[first].tolist(), s[first].tolist(), doc[first].tolist(), lo[first].tolist(), at[first].tolist(), hi[first].tolist(), many.tolist()):
                    got = seen.get((g, p))
                    if got is None:
                        seen[g, p] = [m, raws[d][x:y][::-1], raws[d][y:z]]
                    else:
                        got[0] += m
                warm = np.flatnonzero(hot)
                _, first, many = np.unique(s[warm], return_index=True, return_counts=True)  # equal contexts hold equal strings
                for k, m in zip(warm[first].tolist(), many.tolist()):
                    raw = raws[doc[k]]
                    for x in range(int(lo[k]), int(hi[k]) - length + 1):
                        key = (int(h[k]), int(s[k]), int(at[k]) - x, raw[x : x + length])
                        counted[key] = counted.get(key, 0) + m
                    if len(counted) > 50_000:
                        yield from out()
                if len(seen) > 40_000:
                    yield from out()
            if done:
                yield table(len(done), kind=[0] * len(done), doc_id=[x[0] for x in done], n_bytes=[x[1] for x in done], kept_sha256=[x[2] for x in done])
            if texts:
                yield table(len(texts), kind=[1] * len(texts), t1=[x[0] for x in texts], t2=[x[1] for x in texts], doc_id=[x[2] for x in texts], packed=[x[3] for x in texts], n_bytes=[x[4] for x in texts])
        yield from out()

    return arrow_map(joined, run, _CONTEXT)


def _sorted_contexts(contexts: DataFrame, length: int, anchor: int) -> DataFrame:
    """(h, s, xs): the strings of each context that repeat, as bits: bit x is 1 if the one with x bytes before does."""
    around = length - anchor

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []

        def done(rows: list[list]) -> pa.RecordBatch:
            h = np.array([r[0] for r in rows], dtype=np.int64)
            group = np.cumsum(np.concatenate(([0], h[1:] != h[:-1])))
            found = repeated_strings(group, [r[3] for r in rows], [r[4] for r in rows], np.array([r[2] for r in rows]) > 1, around, anchor)
            some = np.flatnonzero(found.any(1))
            return pa.RecordBatch.from_arrays(
                [pa.array(h[some]), pa.array(np.array([r[1] for r in rows], dtype=np.int64)[some]), pa.array([x.tobytes() for x in np.packbits(found[some], axis=1)], pa.binary())], ["h", "s", "xs"]
            )

        for b in batches:
            for h, s, many, lefts, rights in zip(*(b.column(c).to_pylist() for c in ("h", "s", "many", "lefts", "rights"))):
                if held and held[-1][:2] == [h, s]:
                    held[-1][2] += many
                    continue
                if len(held) >= BATCH and held[-1][0] != h:
                    yield done(held)
                    held = []
                held.append([h, s, many, lefts, rights])
        if held:
            yield done(held)

    dealt = contexts.repartition("h").sortWithinPartitions("h", "s")
    return arrow_map(dealt, run, "h long, s long, xs binary")


def _cut(texts: DataFrame, length: int) -> DataFrame:
    """Cut the repeated strings, whose starts come packed, out of each text."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, packed, ats, xs in zip(*(b.column(c).to_pylist() for c in ("doc_id", "packed", "ats", "xs"))):
                raw = unpack(packed)
                mark = np.zeros(len(raw) + 1, dtype=bool)
                if ats:
                    place, x = np.nonzero(np.unpackbits(np.frombuffer(b"".join(xs), dtype=np.uint8).reshape(len(xs), -1), axis=1))
                    mark[np.array(ats)[place] - x] = True
                covered = np.zeros(len(raw), dtype=bool)
                starts = np.flatnonzero(mark)
                if starts.size:
                    step = np.zeros(len(raw) + 1, dtype=np.int32)
                    step[starts] += 1
                    step[starts + length] -= 1
                    covered = np.cumsum(step[:-1]) > 0
                kept = np.frombuffer(raw, dtype=np.uint8)[~covered].tobytes()
                spans = int((np.diff(np.concatenate(([0], covered.view(np.int8)))) == 1).sum())
                rows.append((doc_id, len(raw), int(covered.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    return arrow_map(texts, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def dedup(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left; null where nothing was removed)."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Texts are told apart by 128 bits of hash, whatever their ids.
    keyed = own.withColumn("t1", F.xxhash64("text")).withColumn("t2", F.xxhash64(F.lit(7), F.col("text")))
    places = _anchor_rows(keyed, length, anchor)
    counts = places.groupBy("h").agg(F.count("*").alias("n"))
    repeated = saved(counts.filter("n > 1"))
    found = places.join(repeated.select("h", (F.col("n") > HOT).alias("hot")), "h")
    by_text = saved(found.groupBy("t1", "t2").agg(F.sort_array(F.collect_set(F.struct("at", "h", "hot"))).alias("places")))
    parts = saved(_contexts(_packed(keyed).join(by_text, ["t1", "t2"], "left").select("t1", "t2", "doc_id", "packed", F.col("places.at").alias("ats"), F.col("places.h").alias("hs"), F.col("places.hot").alias("hots")), length, anchor))
    sorted_ = _sorted_contexts(parts.filter("kind = 3").select("h", "s", "many", "lefts", "rights"), length, anchor)
    strings = parts.filter("kind = 4").select("h", "s", F.col("at").alias("x"), F.col("lefts").alias("string"), "many")
    often = saved(strings.groupBy("h", "x", "string").agg(F.sum("many").alias("n")).filter("n > 1").select("h", "x", "string"))
    by_context = strings.join(often, ["h", "x", "string"]).groupBy("h", "s").agg(F.collect_set("x").alias("x"))
    byte = "lpad(hex(aggregate(sequence(0, 7), 0, (a, j) -> a * 2 + IF(array_contains(x, i * 8 + j), 1, 0))), 2, '0')"
    bits = F.expr(f"unhex(array_join(transform(sequence(0, {(length - anchor) // 8}), i -> {byte}), ''))")
    known = saved(sorted_.unionByName(by_context.select("h", "s", bits.alias("xs"))))
    back = parts.filter("kind = 2").select("t1", "t2", "h", "s", "at").join(known, ["h", "s"]).groupBy("t1", "t2").agg(F.collect_set(F.struct("at", "xs")).alias("found")).select("t1", "t2", F.col("found.at").alias("ats"), F.col("found.xs").alias("xs"))
    texts = parts.filter("kind = 1").select("t1", "t2", "doc_id", "packed").join(back, ["t1", "t2"], "left").select("doc_id", "packed", "ats", "xs")
    whole = parts.filter("kind = 0").select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), "kept_sha256", F.lit(None).cast("binary").alias("kept"))
    return whole.unionByName(_cut(texts, length))
