"""Audit of document filters: what each of them removes, at every place of every order in which they can be applied.

The orders form a trie of permutations. Prefixes that hold the same filters leave the same survivors, so the walk goes
depth first over *sets* of filters and meets each set once: a state is the persisted DataFrame of its parent's survivors
that don't fail the next filter, and one aggregation over it counts, by part, what each filter still to come removes from
it. A state is let go when the walk leaves it: no more are held than there are filters. States hold flags, not texts, and
are made again from the written table of flags if an executor is lost.

What the states counted is appended to one table (a row for each state and part); orders, steps and Shapley sums are joins
of that table with the fixed list of orders, which has n! * n rows for n filters: meant for a handful of filters.

Defined results: a null text counts as empty, a flag that is null as not failing. Rows that repeat an id are rows of their
own; a text is a repeat if a row of a *smaller* id has the same text (the same 256-bit digest), so rows of one id don't
repeat each other, and null ids neither are nor make repeats. A label that several rows give to an id counts if any says 1.
A null part counts as the empty string. An empty table has no parts and no rows. Columns are read by name and renamed, so
extra columns can't clash.
"""

from __future__ import annotations

import uuid
from itertools import permutations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import saved, scratch

#: Characters between words.
BLANKS = r"[\x20\x09-\x0D]+"
#: Filters of the audit query in the order of their letters.
LETTERS = "ABCDE"


def text_flags(text: Column) -> dict[str, Column]:
    """Failure conditions A to D of a text."""
    words = F.array_remove(F.split(text, BLANKS), "")
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 3 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails_A to fails_E, good and toxic of every document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select("doc_id", F.coalesce(F.col("lang"), F.lit("")).alias("part"), text.alias("text"))
    own = saved(own.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *[c.alias(f"fails_{k}") for k, c in text_flags(F.col("text")).items()]))
    # the first id of each text: combined before the shuffle, and unique on its side of the join, which AQE may split
    first = own.groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    marked = own.join(first, "digest").withColumn("fails_E", F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False)))
    given = labels.groupBy(F.col("doc_id").alias("of")).agg((F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic"))
    found = marked.join(given, F.col("doc_id") == F.col("of"), "left")
    return found.select("part", *[f"fails_{k}" for k in LETTERS], *[F.coalesce(F.col(m), F.lit(False)).alias(m) for m in ("good", "toxic")])


def name_of(state: frozenset[str]) -> str:
    return "".join(sorted(state))


def walk(flags: DataFrame, letters: str, marks: tuple[str, ...]) -> DataFrame:
    """state, part, rows and, for each filter not in the state, what it removes from it (removed_X and mark_X)."""
    spark = flags.sparkSession
    path = scratch(spark, f"states-{uuid.uuid4().hex}")
    schema: list = []
    met: set[frozenset[str]] = set()

    def visit(state: frozenset[str], survivors: DataFrame) -> None:
        met.add(state)
        rest = [k for k in letters if k not in state]
        survivors = survivors.select("part", *[f"fails_{k}" for k in rest], *marks).persist(StorageLevel.MEMORY_AND_DISK)
        counts = [F.count_if(f"fails_{k}").alias(f"removed_{k}") if k in rest else F.lit(0).cast("long").alias(f"removed_{k}") for k in letters]
        for m in marks:
            counts += [F.count_if(F.col(f"fails_{k}") & F.col(m)).alias(f"{m}_{k}") if k in rest else F.lit(0).cast("long").alias(f"{m}_{k}") for k in letters]
        edges = survivors.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), *counts).withColumn("state", F.lit(name_of(state)))
        edges.write.mode("append").parquet(path)
        schema[:] = [edges.schema]
        for k in rest:
            if len(rest) > 1 and (then := state | {k}) not in met:
                visit(then, survivors.filter(f"NOT fails_{k}"))
        survivors.unpersist()

    visit(frozenset(), flags)
    return spark.read.schema(schema[0]).parquet(path)


def audit(flags: DataFrame, letters: str = LETTERS, marks: tuple[str, ...] = ("good", "toxic")) -> DataFrame:
    """part, filter_order, step and counts of every order of the filters; flags has part, fails_X and the marks."""
    spark = flags.sparkSession
    states = saved(walk(flags, letters, marks).coalesce(1) if letters else flags)
    edge = F.explode(F.array(*[F.struct(F.lit(k).alias("letter"), F.col(f"removed_{k}").alias("removed"), *[F.col(f"{m}_{k}").alias(f"{m}_lost") for m in marks]) for k in letters]))
    edges = states.select("part", "state", "rows", edge.alias("edge")).select("part", "state", "rows", "edge.*").filter("NOT contains(state, letter)")
    failing = edges.filter("state = ''").select("part", "letter", F.col("removed").alias("failing"))
    alone = edges.filter(F.length("state") == len(letters) - 1).select("part", "letter", F.col("removed").alias("unique_fails"))
    steps = [("".join(p), i + 1, p[i], name_of(frozenset(p[:i]))) for p in permutations(letters) for i in range(len(letters))]
    orders = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, letter string, state string"))
    every = failing.join(alone, ["part", "letter"], "left").join(orders, "letter").join(edges, ["part", "letter", "state"], "left")
    removed, failed = F.coalesce("removed", F.lit(0)), F.col("failing")
    counts = every.select(
        "part", "filter_order", "step", "letter",
        (F.coalesce("rows", F.lit(0)) - removed).alias("kept"), removed.alias("removed"), (failed - removed).alias("redundant"), F.coalesce("unique_fails", F.lit(0)).alias("unique_fails"),
        *[F.coalesce(f"{m}_lost", F.lit(0)).alias(f"{m}_lost") for m in marks],
    )
    shapley = counts.groupBy("part", "letter").agg(F.sum("removed").alias("shapley"))
    return counts.join(shapley, ["part", "letter"]).drop("letter")


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of filters A to E over documents, by language."""
    return audit(saved(flagged(docs, labels)))


ORACLE_SQL = r"""
WITH words AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
given AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
flags AS (SELECT part, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS bad,
    CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask
    FROM words LEFT JOIN given USING (doc_id)),
masks AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (bad) AS t FROM flags GROUP BY part, mask),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (SELECT filter_order, step, CAST(1 << (ascii(filter_order[step]) - 65) AS BIGINT) AS bit,
    (SELECT coalesce(sum(1 << (ascii(x) - 65)), 0) FROM (SELECT unnest(string_split(filter_order[1:step - 1], '')) AS x) WHERE x != '') AS before FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
counted AS (SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & before = 0 AND mask & bit != 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & before != 0 AND mask & bit != 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & before = 0 AND mask & bit != 0 THEN g ELSE 0 END) AS good_lost, sum(CASE WHEN mask & before = 0 AND mask & bit != 0 THEN t ELSE 0 END) AS toxic_lost
    FROM masks, (SELECT filter_order, step, bit, CAST(before AS BIGINT) AS before FROM steps) GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
    CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM counted
"""
