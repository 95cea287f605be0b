from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from binsift.functions import dims
from binsift.operators import patterns, select, sources


def contained(text, words):
    return [i for i, w in enumerate(words) if text is not None and w in text]


def test_all_patterns_in_one_pass(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abc", k=rng.randrange(0, 5))) for _ in range(40)] + ["", "ab", "ab"]
    texts = ["".join(rng.choices("abcd", k=rng.randrange(0, 30))) for _ in range(80)] + [None, "", "x", "ab", "ab"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").repartition(3).withColumn("found", F.lit("clash"))
    for got in (patterns.matched(df, "t", words), patterns.matched_rows(df, "t", words)):
        assert {r.id: r.found for r in got.collect()} == {i: contained(t, words) for i, t in enumerate(texts)}
    none = patterns.matched(df, "t", []).filter(patterns.any_of()).count()
    assert none == 0 and patterns.matched(df.limit(0), "t", words).count() == 0


def test_catalogues_equal_the_scan_of_every_pattern(spark):
    rng = random.Random(6)
    known = [w for ps in dims.ROLE_PATTERNS.values() for w in ps.split()] + [w for w, _ in dims.SOURCE_FALLBACKS] + [m for ms in dims.SINK_CLASSES.values() for m in ms] + [w for ns in dims.SOURCE_ROLES.values() for w in ns.split()] + list(dims.NOT_SOURCES)
    names = [rng.choice(known) + rng.choice(["", "_x", "::f(int)", "2"]) for _ in range(300)] + [rng.choice(known)[1:-1] for _ in range(100)] + ["", "q", None, "A::", "mem", "MEMCPY"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    low = df.select(F.lower("name").alias("name"))
    want = low.select("name", select.role_by_name(F.col("name")).alias("role"), select.role_confidence(F.col("name")).alias("role_conf"))
    assert sorted(map(repr, patterns.with_role(low, "name").collect())) == sorted(map(repr, want.collect()))
    some = df.filter("name IS NOT NULL")
    assert sorted(map(repr, patterns.with_source_role(some, "name").collect())) == sorted(map(repr, some.select("name", sources.source_role(F.col("name")).alias("role")).collect()))
    assert sorted(map(repr, patterns.with_sink_class(some, "name").collect())) == sorted(map(repr, some.select("name", sources.sink_class(F.col("name")).alias("sink_class")).collect()))


def test_time_is_level_in_the_number_of_patterns():
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefghij", k=12)) for _ in range(20_000)]
    texts = ["".join(rng.choices("abcdefghij", k=200)) for _ in range(2000)]

    def took(n):
        a, _ = patterns.automaton(words[:n])
        best = 1e9
        for _ in range(3):
            begun = time.process_time()
            for t in texts:
                for _ in a.iter(t):
                    pass
            best = min(best, time.process_time() - begun)
        return best

    assert took(20_000) < 10 * took(20)  # a thousand times as many patterns
