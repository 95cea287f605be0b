"""Line deduplication by winnowing over line hashes, with DataFrame functions only.

The sequence of a document's non-blank lines (surrounding blanks off) has, from every line on, a shortest window of at
least `min_lines` lines or `min_chars` characters. The first smallest line hash of each window is a fingerprint of the
document, kept once for its position; equal runs that hold a window select fingerprints of equal hash at equal places, so
every repeated run of that size is guaranteed to share one.

Positions whose fingerprint occurs elsewhere are joined with the first position of the same fingerprint and window (lower
doc_id, then text hash, then position). Each such pair is a match of a window's length; pairs of one document and one
origin at one distance that overlap or touch are the same match, extended both ways until the lines differ. What the
matches of a document cover is deleted. The first occurrence stays.

Defined results: null text stays null with no lines; blank lines are no part of a window, but go with a run that spans
them. A line repeated over and over overlaps its own earlier windows and collapses to its first. Documents with fewer
lines or characters than a window lose nothing. Rows that repeat id and text are one document:
neither deletes from the other. Empty tables give empty tables. Extra columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import saved

#: Shortest run that counts as repeated: so many lines, or lines of so many characters together.
MIN_LINES, MIN_CHARS = 3, 200


def _text_key() -> Column:
    return F.xxhash64("text")


def fingerprints(docs: DataFrame, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per selected position: fp (line hash), doc_id, key (text hash), and the windows it is the smallest of:
    p and q (first and last of the non-blank lines), first and last (line numbers), body (hash of its lines)."""

    def once(df: DataFrame, name: str, expr: str) -> DataFrame:
        """A column computed once for each row: Spark would put its expression into every lambda that uses it."""
        return df.select("*", F.explode(F.array(F.expr(expr))).alias(name))

    texts = docs.filter(F.col("text").isNotNull()).select("doc_id", _text_key().alias("key"), "text")
    solid = "filter(transform(split(text, '\n'), (x, i) -> struct(trim(BOTH FROM x) AS s, i AS i)), x -> x.s != '')"
    lines = once(texts, "lines", solid).drop("text").filter(F.size("lines") > 0)
    arrays = once(once(lines, "hashes", "transform(lines, x -> xxhash64(x.s))"), "sizes", "transform(lines, x -> length(x.s))")
    width = "CASE"
    for k in range(1, min_lines + 1):
        total = " + ".join(f"sizes[p + {j}]" for j in range(k))
        enough = f"AND {total} >= {min_chars}" if k < min_lines else ""
        width += f" WHEN p + {k} <= size(sizes) {enough} THEN {k}"
    width += " END"
    widths = once(arrays, "widths", f"transform(sizes, (x, p) -> {width})")
    # The position that each window selects; -1 where the lines left are no window.
    least = "p + array_position(slice(hashes, p + 1, widths[p]), array_min(slice(hashes, p + 1, widths[p]))) - 1"
    chosen = once(widths, "chosen", f"transform(sequence(0, size(widths) - 1), p -> IF(widths[p] IS NULL, -1, CAST({least} AS INT)))")
    # Windows are built inside the array, so that no row carries its whole document.
    built = chosen.select(
        "doc_id",
        "key",
        F.expr(
            f"""transform(filter(array_distinct(chosen), a -> a >= 0), a -> named_struct('fp', hashes[a], 'windows',
            transform(filter(sequence(greatest(0, a - {min_lines - 1}), a), p -> chosen[p] = a), p -> named_struct('p', p, 'q', p + widths[p] - 1,
            'first', lines[p].i, 'last', lines[p + widths[p] - 1].i,
            'body', unhex(md5(IF(widths[p] = 1, lines[p].s, array_join(transform(slice(lines, p + 1, widths[p]), x -> x.s), '\n'))))))))"""
        ).alias("positions"),
    )
    return built.select("doc_id", "key", F.explode("positions").alias("at")).select("at.fp", "doc_id", "key", "at.windows")


def matches(docs: DataFrame, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS) -> DataFrame:
    """Repeated runs with where they stood before: doc_id, key, first and last (line numbers), origin (doc_id, key, p of
    the first of the same lines), each as long as its lines and the origin's agree window by window."""
    found = saved(fingerprints(docs, min_lines, min_chars))
    common = saved(found.groupBy("fp").agg(F.count("*").alias("n")).filter("n > 1").select("fp"))
    # Merge joins at every size: neither side is small where the corpus isn't, and AQE splits their hot keys.
    shared = found.join(common.hint("merge"), "fp").select("doc_id", "key", F.explode("windows").alias("w")).select("doc_id", "key", "w.*")
    place = F.struct("doc_id", "key", "p")
    # Windows that occur more than once, with the first place of each: a unique side for the join.
    firsts = saved(shared.groupBy("body").agg(F.min(place).alias("origin"), F.count("*").alias("n")).filter("n > 1").select("body", "origin"))
    pairs = shared.join(firsts.hint("merge"), "body").filter(place > F.col("origin")).select("doc_id", "key", "p", "q", "first", "last", "origin", (F.col("p") - F.col("origin.p")).alias("shift"))
    along = ["doc_id", "key", "origin.doc_id", "origin.key", "shift"]
    dealt = pairs.repartition("doc_id", "key")
    return _united(dealt, along, "p", "q", [F.min("first").alias("first"), F.max("last").alias("last"), F.min("origin").alias("origin")])


def _united(df: DataFrame, keys: list[str], lo: str, hi: str, take: list[Column]) -> DataFrame:
    """Intervals of equal keys that overlap or touch as one: the columns doc_id, key and what `take` gives."""
    one = Window.partitionBy(*keys).orderBy(lo, hi)
    before = F.max(hi).over(one.rowsBetween(Window.unboundedPreceding, -1))
    begun = df.select("*", F.when(F.col(lo) <= before + 1, 0).otherwise(1).alias("begins"))
    numbered = begun.select("*", F.sum("begins").over(one.rowsBetween(Window.unboundedPreceding, 0)).alias("island"))
    return numbered.groupBy("doc_id", "key", *(F.col(k).alias(f"k{n}") for n, k in enumerate(keys) if k not in ("doc_id", "key")), "island").agg(*take).select("doc_id", "key", "first", "last", *(["origin"] if len(take) > 2 else []))


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, key and runs: the array of (first, last) line numbers to delete, for documents that have any."""
    runs = _united(matches(docs, min_lines, min_chars), ["doc_id", "key"], "first", "last", [F.min("first").alias("first"), F.max("last").alias("last")])
    return runs.groupBy("doc_id", "key").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))


def dedup(docs: DataFrame, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with later repeated runs cut from text, and columns n_lines, n_removed (lines)."""
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    runs = repeated_runs(own, min_lines, min_chars).select(F.col("doc_id").alias("_cut_id"), F.col("key").alias("_cut_key"), F.col("runs").alias("_cuts"))
    rest = docs.drop("n_lines", "n_removed").withColumn("_key", F.xxhash64(F.col("text").cast("string")))
    joined = rest.join(runs, F.col("doc_id").eqNullSafe(F.col("_cut_id")) & (F.col("_key") == F.col("_cut_key")), "left").drop("_cut_id", "_cut_key", "_key")
    # Kept stretches lie between the end of one run and the start of the next.
    lines = joined.select("*", F.explode(F.array(F.split("text", "\n"))).alias("_lines"))
    kept = F.expr(
        "CASE WHEN _cuts IS NULL THEN text ELSE array_join(flatten(transform(sequence(0, size(_cuts)), i -> slice(_lines,"
        " IF(i = 0, 0, _cuts[i - 1].last + 1) + 1, IF(i = size(_cuts), size(_lines), get(_cuts, i).first) - IF(i = 0, 0, _cuts[i - 1].last + 1)))), '\n') END"
    )
    removed = F.expr("coalesce(aggregate(_cuts, 0, (a, x) -> a + x.last - x.first + 1), 0)")
    counted = lines.withColumn("n_lines", F.expr("IF(text IS NULL, 0, size(_lines))")).withColumn("n_removed", removed)
    return counted.withColumn("text", kept).drop("_cuts", "_lines")


#: The same result in SQL, over the tables of the directory.
ORACLE_SQL = f"""
WITH raw AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents WHERE text IS NOT NULL),
solid AS (SELECT doc_id, trim(s, ' ') AS s, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p FROM raw WHERE trim(s, ' ') <> ''),
ahead AS (
  SELECT *, lead(s, 1) OVER w AS s1, lead(s, 2) OVER w AS s2, lead(i, 1) OVER w AS i1, lead(i, 2) OVER w AS i2
  FROM solid WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
win AS (
  SELECT doc_id, p, i AS lo,
    CASE WHEN length(s) >= {MIN_CHARS} THEN i WHEN length(s) + length(s1) >= {MIN_CHARS} THEN i1 ELSE i2 END AS hi,
    CASE WHEN length(s) >= {MIN_CHARS} THEN s WHEN length(s) + length(s1) >= {MIN_CHARS} THEN s || chr(10) || s1 ELSE s || chr(10) || s1 || chr(10) || s2 END AS body
  FROM ahead),
later AS (
  SELECT doc_id, lo, hi FROM (
    SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, p) AS nth FROM win WHERE hi IS NOT NULL) t WHERE nth > 1),
cut AS (SELECT DISTINCT doc_id, unnest(range(lo, hi + 1)) AS i FROM later),
kept AS (
  SELECT r.doc_id, count(*) AS n_lines, count(c.i) AS n_removed, coalesce(string_agg(r.s, chr(10) ORDER BY r.i) FILTER (WHERE c.i IS NULL), '') AS text
  FROM raw r LEFT JOIN cut c ON c.doc_id = r.doc_id AND c.i = r.i GROUP BY r.doc_id)
SELECT d.doc_id, CAST(coalesce(k.n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(k.n_removed, 0) AS INTEGER) AS n_removed, k.text AS text
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
