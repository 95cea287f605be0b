"""Many patterns in many texts at once: an automaton over the patterns, run once over each distinct text.

All patterns that occur in a text are found in one pass over it, whatever their number, so a catalogue may grow without
costing a scan for each of its words. Names repeat much more often than they differ: `matched` runs the automaton over
distinct texts and joins what it found back (a hot name is one row there). `matched_rows` runs it over every row instead,
for texts that differ, like documents.

Result: `found`, the numbers of the patterns that a text contains, ascending, each once; what comes first in a list of
patterns is its least number. Defined results: a null text contains nothing and gives an empty list, as does a text
without a match; an empty pattern is contained in every text that isn't null; of equal patterns each is found.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dims import NOT_SOURCES, ROLE_PATTERNS, SINK_CLASSES, SOURCE_FALLBACKS, SOURCE_ROLES
from ..functions.names import last_scope
from .shipping import ship

FOUND = "found"


def automaton(patterns: Sequence[str]) -> tuple[ahocorasick.Automaton | None, list[int]]:
    """Automaton over the patterns that aren't empty, with the numbers of each, and the numbers of the empty ones."""
    numbers: dict[str, list[int]] = {}
    for i, p in enumerate(patterns):
        numbers.setdefault(p, []).append(i)
    always = numbers.pop("", [])
    if not numbers:
        return None, always
    a = ahocorasick.Automaton()
    for p, n in numbers.items():
        a.add_word(p, n)
    a.make_automaton()
    return a, always


def matched_rows(df: DataFrame, text: str, patterns: Sequence[str], found: str = FOUND) -> DataFrame:
    """df with the patterns that each row's text contains."""
    ship(df.sparkSession)
    rest = df.drop(found)
    schema = T.StructType([*rest.schema.fields, T.StructField(found, T.ArrayType(T.IntegerType()))])
    patterns = list(patterns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, always = automaton(patterns)
        for b in batches:
            out = []
            for t in b.column(text).to_pylist():
                hits = set(always) if t is not None else set()
                if t and a is not None:
                    for _, n in a.iter(t):
                        hits.update(n)
                out.append(sorted(hits))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.int32()))], [*b.schema.names, found])

    return rest.mapInArrow(run, schema)


def matched(df: DataFrame, text: str, patterns: Sequence[str], found: str = FOUND) -> DataFrame:
    """df with the patterns that each row's text contains, each distinct text gone through once."""
    names = matched_rows(df.select(F.col(text).alias("_text")).filter("_text IS NOT NULL").distinct(), "_text", patterns, found)
    rest = df.drop(found)
    both = rest.join(names, rest[text] == F.col("_text"), "left").drop("_text")
    return both.withColumn(found, F.coalesce(found, F.array().cast("array<int>")))


def first_of(values: Sequence[object], default: object = None, found: Column | str = FOUND) -> Column:
    """Value that belongs to the first pattern found: values[i] is that of pattern i."""
    least = F.array_min(F.col(found) if isinstance(found, str) else found)
    return F.when(least.isNull(), F.lit(default)).otherwise(F.get(F.array(*map(F.lit, values)), least))


def any_of(found: Column | str = FOUND) -> Column:
    return F.size(found) > 0


# -- catalogues of names


def with_role(df: DataFrame, name: str) -> DataFrame:
    """df with role and role_conf by lower-cased names: the first of the ordered roles with a pattern that the name
    contains; 0.90 if that pattern has six letters or more, else 0.75."""
    pairs = [(role, p) for role, ps in ROLE_PATTERNS.items() for p in ps.split()]
    got = matched(df, name, [p for _, p in pairs], "_found")
    conf = [0.90 if len(p) >= 6 else 0.75 for _, p in pairs]
    return got.withColumns({"role": first_of([r for r, _ in pairs], None, "_found"), "role_conf": first_of(conf, None, "_found")}).drop("_found")


def with_source_role(df: DataFrame, name: str) -> DataFrame:
    """df with role: what a called function is as a source (null for those that never are, exact names in order, then the
    first substring found, else UNKNOWN)."""
    bare = last_scope(F.col(name), lower=False)
    got = matched(df.withColumn("_low", F.lower(bare)), "_low", [w for w, _ in SOURCE_FALLBACKS], "_found")
    role = first_of([r for _, r in SOURCE_FALLBACKS], "UNKNOWN", "_found")
    for r, exact in reversed(SOURCE_ROLES.items()):
        role = F.when(bare.isin(exact.split()), r).otherwise(role)
    return got.withColumn("role", F.when(bare.isin(NOT_SOURCES), F.lit(None).cast("string")).otherwise(role)).drop("_low", "_found")


def with_sink_class(df: DataFrame, name: str) -> DataFrame:
    """df with sink_class: the first class one of whose names contains the sink's or is contained in it, else GENERIC.

    Names inside the sink's are found by the automaton. Names that contain the sink's are those of which it is a substring,
    so substrings of all names, each with its first class, are a table that the sink's name is looked up in."""
    pairs = [(c, m.lower()) for c, ms in SINK_CLASSES.items() for m in ms]
    order = list(SINK_CLASSES)
    inside: dict[str, int] = {}
    for k, (_, m) in enumerate(pairs):
        for i in range(len(m)):
            for j in range(i + 1, len(m) + 1):
                inside.setdefault(m[i:j], k)
    parts = df.sparkSession.createDataFrame(list(inside.items()), "_part string, _k int")
    got = matched(df.withColumn("_low", last_scope(F.col(name))), "_low", [m for _, m in pairs], "_found")
    both = got.join(F.broadcast(parts), got["_low"] == F.col("_part"), "left")  # as many rows as the names have substrings
    # the empty name is a substring of every one
    first = F.when(F.col("_low") == "", F.lit(0)).otherwise(F.array_min(F.array_compact(F.array(F.array_min("_found"), F.col("_k")))))
    classes = F.array(*[F.lit(order.index(c)) for c, _ in pairs])
    named = F.get(F.array(*map(F.lit, order)), F.get(classes, first))
    return both.withColumn("sink_class", F.coalesce(named, F.lit("GENERIC"))).drop("_low", "_found", "_part", "_k")
