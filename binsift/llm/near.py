"""N-gram Jaccard self-join by MinHash banding.

The set of word n-grams of each text gives a MinHash signature; bands of it, in number and rows chosen for a target
recall at the threshold, are shuffled on their hashes. Texts of equal n-gram sets are one class, from there on one row.
Classes that share a band bucket are compared on their full n-gram sets, in groups:

* Classes that hang together by buckets form a cluster; a cluster of at most `block` classes is one group.
* A larger cluster is compared bucket by bucket (buckets of the same classes once), each pair in the first band it shares,
  or as a whole, whichever copies fewer rows: chains of unlike texts by buckets, dense families as a whole.
* Groups of more than `block` classes, or BLOCK_GRAMS n-grams, are dealt as pairs of blocks, so no task holds more than two
  blocks (a block is one class at least).

No pair of classes that shares a bucket is left out in any of these ways, and no pair is ever written: a block gives each
class its number of links and the least member it is connected to.

Defined results: texts of fewer than n words have one n-gram, all their words; texts without words are in a class of
their own with no link. Rows are told apart by themselves, not by id: rows that repeat an id, with one text or several,
each have their class and links, and so do rows with null ids, which name no class or group unless all its rows have none.
Rows of equal text are links of each other. Extra columns of the input are ignored. Empty tables give empty tables.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import arrow_map, saved
from ._text import batches, gram_hashes, mix, word_hashes
from .graph import components

#: Words of an n-gram, least Jaccard similarity of a link, wanted chance to find a pair at exactly that similarity.
WORDS, THRESHOLD, RECALL = 5, 0.8, 0.997
#: Hash functions at most, classes of a block, and n-grams of a block.
HASHES, BLOCK, BLOCK_GRAMS = 192, 512, 1 << 20
#: N-grams of a block that are compared at a time.
PASS_GRAMS = 1 << 18
#: Cells of the 0/1 matrix that a block multiplies at a time.
CELLS = 1 << 21
SIGNED = "doc_id long, tkey long, hi long, lo long, n_grams int, bands array<long>"


def band_plan(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows whose number of bands still reaches the recall with at most `hashes` functions."""
    best = (hashes, 1)
    for rows in range(1, hashes + 1):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows))))
        if bands * rows <= hashes:
            best = (bands, rows)
    return best


def gram_set(hashed: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Sorted distinct n-gram hashes of one text's word hashes."""
    if not len(hashed):
        return np.zeros(0, dtype=np.uint64)
    return np.unique(gram_hashes(hashed, min(words, len(hashed))))


def band_hashes(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash for each band of the MinHash signature of a set."""
    k = bands * rows
    draw = np.random.default_rng(8)
    a = draw.integers(1, 1 << 31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = draw.integers(0, 1 << 32, k, dtype=np.uint32)
    x = (grams >> np.uint64(32)).astype(np.uint32)
    least = np.full(k, 0xFFFFFFFF, dtype=np.uint32)
    for lo in range(0, len(x), 4096):
        h = a[:, None] * x[None, lo : lo + 4096] + b[:, None]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(13)
        np.minimum(least, h.min(1), out=least)
    out = np.zeros(bands, dtype=np.uint64)
    for r in range(rows):
        out = mix(out * np.uint64(31) + least.reshape(bands, rows)[:, r])
    return out.view(np.int64)


def signed(docs: DataFrame, words: int = WORDS, plan: tuple[int, int] | None = None) -> DataFrame:
    """doc_id, tkey (hash of the text), hi and lo (128-bit id of the n-gram set), n_grams, bands (empty for texts without words)."""
    bands, rows = plan or band_plan()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            texts = b.column("text").to_pylist()
            hi, lo, n, sets = [], [], [], []
            for start, end in batches(texts):
                hashed, at = word_hashes(texts[start:end])
                for i in range(end - start):
                    grams = gram_set(hashed[at[i] : at[i + 1]], words)
                    ident = np.frombuffer(hashlib.blake2b(grams.tobytes(), digest_size=16).digest(), np.int64)
                    hi.append(int(ident[0]))
                    lo.append(int(ident[1]))
                    n.append(len(grams))
                    sets.append(band_hashes(grams, bands, rows) if len(grams) else np.zeros(0, np.int64))
            flat = pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))
            at = pa.array(np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tkey"), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(n, pa.int32()), pa.ListArray.from_arrays(at, flat)], ["doc_id", "tkey", "hi", "lo", "n_grams", "bands"])

    return arrow_map(docs.select("doc_id", "tkey", "text"), run, SIGNED)


def linked(n: np.ndarray, parts: list[np.ndarray], threshold: float) -> np.ndarray:
    """Symmetric matrix of the pairs of sorted sets whose Jaccard similarity reaches the threshold, without the diagonal."""
    both = np.zeros((len(parts), len(parts)), dtype=np.float32)
    # N-grams are counted by ranges of their hashes, so that arrays stay small however long the texts are.
    passes = int(n.sum()) // PASS_GRAMS + 1
    cuts = np.array([min((k << 64) // passes, (1 << 64) - 1) for k in range(1, passes)], dtype=np.uint64)
    at = np.array([[0, *np.searchsorted(p, cuts), len(p)] for p in parts])
    for k in range(passes):
        flat = np.concatenate([p[x:y] for p, x, y in zip(parts, at[:, k], at[:, k + 1])])
        owner = np.repeat(np.arange(len(parts), dtype=np.int32), at[:, k + 1] - at[:, k])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        column = np.cumsum(np.concatenate(([True], flat[1:] != flat[:-1]))[: len(flat)], dtype=np.int32) - 1
        many = np.bincount(column) > 1
        keep = many[column]
        owner, column = owner[keep], (np.cumsum(many, dtype=np.int32) - 1)[column[keep]]
        width = max(1, CELLS // len(parts))
        for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            a, z = np.searchsorted(column, [lo, lo + width])
            m = np.zeros((len(parts), width), dtype=np.float32)
            m[owner[a:z], column[a:z] - lo] = 1
            both += m @ m.T
    size = n.astype(np.float32)
    found = np.empty(both.shape, dtype=bool)
    for lo in range(0, len(parts), 256):  # counts of grams are whole numbers that float32 holds
        some = both[lo : lo + 256].astype(np.float64)
        found[lo : lo + 256] = some >= threshold * (size[lo : lo + 256, None] + size[None, :] - some) - 1e-6
    np.fill_diagonal(found, False)
    return found


def _block(node: list[tuple], copies: np.ndarray, side: np.ndarray, cross: bool, earlier: np.ndarray, n: np.ndarray, parts: list[np.ndarray], threshold: float) -> tuple[np.ndarray, list[tuple]]:
    """Links to documents of other classes, and least connected class, of each class of a block or pair of blocks.

    earlier holds each class's buckets in bands before the group's own (0 for none): a pair that shares one was met there.
    """
    found = linked(n, parts, threshold)
    if cross:
        found &= side[:, None] != side[None, :]
    for column in earlier.T:
        if column.any():
            found &= (column[:, None] != column[None, :]) | (column[:, None] == 0)
    # Least members by rank in the order of nodes.
    order = sorted(range(len(node)), key=node.__getitem__)
    root = np.empty(len(node), dtype=np.int64)
    root[order] = np.arange(len(node))
    while True:
        least = root.copy()
        for lo in range(0, len(root), 256):
            near = np.where(found[lo : lo + 256], root[None, :], np.iinfo(np.int64).max).min(1)
            least[lo : lo + 256] = np.minimum(root[lo : lo + 256], near)
        if (least == root).all():
            break
        root = least
    return found @ copies, [node[order[r]] for r in root]


_NODE = pa.struct([("hi", pa.int64()), ("lo", pa.int64())])


def verified(members: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """node, doc_links and root of each class from rows (grp, i, j, side, node, copies, band, kept, grams), one for each
    pair of blocks; kept are the class's buckets by band where the group is one (its band), else null."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def done() -> pa.RecordBatch:
            grams = [np.frombuffer(r[5], dtype=np.uint64) for r in held]
            band = held[0][3]
            earlier = np.zeros((len(held), 0), np.int64) if band is None else np.array([r[4][:band] for r in held], dtype=np.int64).reshape(len(held), band)
            links, root = _block([r[0] for r in held], np.array([r[1] for r in held]), np.array([r[2] for r in held]), key[1] != key[2], earlier, np.array([len(g) for g in grams]), grams, threshold)
            as_node = lambda x: pa.array([{"hi": hi, "lo": lo} for hi, lo in x], _NODE)
            return pa.RecordBatch.from_arrays([as_node([r[0] for r in held]), pa.array(links.astype(np.int64)), as_node(root)], ["node", "doc_links", "root"])

        for b in parts:
            for grp, i, j, side, node, copies, band, kept, grams in zip(*(b.column(c).to_pylist() for c in ("grp", "i", "j", "side", "node", "copies", "band", "kept", "grams"))):
                if key != (grp, i, j):
                    if held:
                        yield done()
                    key, held = (grp, i, j), []
                node = node["hi"], node["lo"]
                if not held or held[-1][0] != node:  # rows that repeat id and text
                    held.append((node, copies, side, band, kept, grams))
        if held:
            yield done()

    dealt = members.select("grp", "i", "j", "side", "node", "copies", "band", "kept", "grams").repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j", "node")
    return arrow_map(dealt, run, "node struct<hi:bigint,lo:bigint>, doc_links long, root struct<hi:bigint,lo:bigint>")


def with_grams(rows: DataFrame, words: int = WORDS) -> DataFrame:
    """rows with the n-gram set of their text as binary column grams in its place."""
    rest = [c for c in rows.columns if c != "text"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            texts = b.column("text").to_pylist()
            out = []
            for start, end in batches(texts):
                hashed, at = word_hashes(texts[start:end])
                out += [gram_set(hashed[at[i] : at[i + 1]], words).tobytes() for i in range(end - start)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(out, pa.binary())], [*rest, "grams"])

    kinds = dict(rows.dtypes)
    return arrow_map(rows.select(*rest, "text"), run, ", ".join([*(f"{c} {kinds[c]}" for c in rest), "grams binary"]))


def _groups(dealt: DataFrame, buckets: DataFrame, clusters: DataFrame, block: int) -> DataFrame:
    """grp, blocks, node, band, kept: every class in each group it is compared in. Ids only; no texts."""
    size = F.greatest(F.ceil(F.col("n") / F.lit(block)), F.least(F.col("n"), F.ceil(F.col("grams") / F.lit(BLOCK_GRAMS))))
    whole = clusters.groupBy("comp").agg(F.count("*").alias("n"), F.sum("n_grams").alias("grams")).withColumn("blocks", size.cast("int"))
    # Buckets of large clusters, those of the same classes once, and what comparing by them copies.
    large = clusters.join(whole.filter("blocks > 1").select("comp"), "comp").select("comp", "node")
    once = buckets.groupBy("n", "sum", "hub").agg(F.min(F.struct("band", "hash")).alias("b"), F.first("grams").alias("grams")).select("b.band", "b.hash", "n", "grams")
    inside = saved(dealt.join(once, ["band", "hash"]).join(large, "node").select("comp", "node", "band", "hash", once["n"], once["grams"]))
    cheaper = whole.join(inside.groupBy("comp").agg(F.sum(size).alias("rows")), "comp").filter("rows < n * blocks").select("comp")
    by_bucket = inside.join(cheaper, "comp")
    kept = by_bucket.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("band", "hash"))).alias("of"))
    last = dealt.agg(F.coalesce(F.max("band"), F.lit(0)).alias("n")).first().n
    listed = kept.select("node", F.expr(f"transform(sequence(0, {last}), x -> coalesce(of[x], 0))").alias("kept"))
    grp = lambda *c: F.struct(*(x.cast("long").alias(n) for n, x in zip(("a", "b", "c"), c)))
    buckets_of = by_bucket.join(listed, "node").select(grp(F.col("band"), F.col("hash"), F.lit(1)).alias("grp"), size.cast("int").alias("blocks"), "node", "band", "kept")
    clusters_of = clusters.select("comp", "node").join(whole, "comp").join(cheaper, "comp", "left_anti")
    return clusters_of.select(grp(F.col("comp.hi"), F.col("comp.lo"), F.lit(0)).alias("grp"), "blocks", "node", F.lit(None).cast("int").alias("band"), F.lit(None).cast("array<bigint>").alias("kept")).unionByName(buckets_of)


def _own(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tkey"), text.alias("text"))


def _joined(docs: DataFrame, words: int, threshold: float, recall: float, block: int) -> tuple[DataFrame, DataFrame]:
    """Signed rows that have words, and of each class of n-gram sets (hi, lo): class_id, group_id, n_links and whether it
    holds the row that stands for its group, `of` (that with the least id, a null one last, then the least text hash)."""
    own = _own(docs)
    sets = saved(signed(own, words, band_plan(threshold, recall)))
    full = sets.filter("n_grams > 0")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tkey")
    classes = saved(full.groupBy("hi", "lo").agg(F.min(row).alias("of"), F.count("*").alias("copies"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands")).select(F.struct("hi", "lo").alias("node"), "of", "copies", "n_grams", "bands"))
    dealt = classes.select("node", "n_grams", F.posexplode("bands").alias("band", "hash"))
    met = dealt.groupBy("band", "hash").agg(F.min("node").alias("hub"), F.count("*").alias("n"), F.sum("n_grams").alias("grams"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("sum"))
    buckets = saved(met.filter("n > 1"))
    edges = dealt.join(buckets, ["band", "hash"]).select(F.col("node").alias("u"), F.col("hub").alias("v")).distinct()
    clusters = components(edges).join(classes.select("node", "n_grams"), "node")
    groups = _groups(dealt, buckets, clusters, block)
    placed = groups.join(classes.select("node", "of", "copies"), "node").withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met_text = placed.join(own, placed["of.doc_id"].eqNullSafe(own["doc_id"]) & (placed["of.tkey"] == own["tkey"]))
    members = with_grams(met_text.select("grp", "blocks", "side", "node", "copies", "band", "kept", "text"), words)
    pairs = members.select("*", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other")).withColumns({"i": F.least("side", "other"), "j": F.greatest("side", "other")})
    counted = saved(verified(pairs, threshold))
    totals = counted.groupBy("node").agg(F.sum("doc_links").alias("doc_links"))
    groups = components(counted.select(F.col("node").alias("u"), F.col("root").alias("v")))
    found = classes.select("node", "of", "copies").join(totals, "node", "left").join(groups, "node", "left").select("node", "of", "copies", "doc_links", F.coalesce("comp", "node").alias("comp"))
    first = found.groupBy("comp").agg(F.min("of").alias("least"))
    by_class = found.join(first, "comp").select(
        "node.hi", "node.lo", F.col("of.doc_id").alias("class_id"), F.col("least.doc_id").alias("group_id"), (F.col("copies") - 1 + F.coalesce("doc_links", F.lit(0))).alias("n_links"), (F.col("of") == F.col("least")).alias("stands"), "of"
    )
    return sets, saved(by_class)


def join(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, class_id (least id of equal n-gram sets), group_id (least id it is linked to,
    directly or through others), n_links (other documents whose similarity reaches the threshold)."""
    sets, by_class = _joined(docs, words, threshold, recall, block)
    plain = sets.filter("n_grams = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("group_id"), F.lit(0).cast("long").alias("n_links"))
    rows = sets.filter("n_grams > 0").select("doc_id", "hi", "lo").join(by_class, ["hi", "lo"]).select("doc_id", "class_id", "group_id", "n_links")
    return rows.unionByName(plain)


def one_of_each(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row of each group of near duplicates: that of its least id (a null one last), of several of that id the one with
    the least text hash, of rows that repeat both any one. Texts without words all stay. Extra columns stay."""
    sets, by_class = _joined(docs, words, threshold, recall, block)
    rows = sets.filter("n_grams > 0").select("doc_id", "tkey", "hi", "lo").join(by_class.select("hi", "lo", "stands", "of"), ["hi", "lo"])
    stays = F.col("stands") & F.col("doc_id").eqNullSafe(F.col("of.doc_id")) & (F.col("tkey") == F.col("of.tkey"))
    told = saved(rows.groupBy(F.col("doc_id").alias("_id"), F.col("tkey").alias("_key")).agg(F.max(stays).alias("_stays"), F.count("*").alias("_n")).filter("NOT _stays OR _n > 1"))
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(docs["text"].cast("string")) == F.col("_key"))
    single = docs.join(told, same, "left_anti")
    again = told.filter("_stays")
    if again.limit(1).count() == 0:
        return single
    many = docs.join(again, same).groupBy("_id", "_key").agg(F.first(F.struct(*docs.columns)).alias("_row")).select("_row.*")
    return single.unionByName(many)
