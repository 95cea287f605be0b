from __future__ import annotations

from itertools import permutations

import duckdb
import pytest
from comparing import connection, same_rows
from pyspark.sql import functions as F

from binsift.llm import filters
from binsift.llm.queries import ORACLE_SQL, QUERIES

NAME = "op12_filter_interaction_audit"
LABELS = "doc_id long, quality int, toxic int"
LONG = " ".join(f"w{i}" for i in range(220))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_gives_the_rows_of_its_sql(spark, sf):
    path = f"/root/testdata/{sf}"
    same_rows(QUERIES[NAME](spark, path), connection(path), ORACLE_SQL[NAME])


def test_defined_cases_against_sql(spark, clashing):
    rows = [
        (0, LONG, "en"), (1, LONG, "en"), (1, LONG, "en"), (2, LONG, "de"), (None, LONG, "en"), (3, None, "en"), (4, "", None), (5, "", ""), (5, "A" * 9, "fr"),
        (6, "x " * 300, "en"), (7, "a\x1cb c\x0bd " * 80, "en"), (8, LONG + " #", "en"), (9, "É ÀB " * 150, "de"), (10, "50% " + LONG, "en"), (11, " \t\n ", "en"), (12, "word " * 60_000, "xx"),
    ]
    docs = clashing(rows)
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 1), (1, 1, 0), (3, None, 1), (6, 1, 1), (None, 1, 1), (99, 1, 1)], LABELS)
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    c.execute("CREATE TABLE labels (doc_id BIGINT, quality INTEGER, toxic INTEGER)")
    c.executemany("INSERT INTO labels VALUES (?, ?, ?)", [tuple(r) for r in labels.collect()])
    got = filters.audit_documents(docs, labels)
    same_rows(got, c, ORACLE_SQL[NAME])
    assert got.count() == 5 * 600
    assert filters.audit_documents(docs.limit(0), labels).count() == 0
    assert filters.audit_documents(docs, labels.limit(0)).agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0


def test_orders_applied_one_by_one(spark):
    """Three filters over all combinations, each order applied to lists in Python."""
    rows = [("p" if i % 3 else "q", bool(i & 1), bool(i & 2), bool(i & 4), i % 5 == 0, i % 7 == 0) for i in range(48)]
    got = filters.audit(spark.createDataFrame(rows, "part string, fails_A boolean, fails_B boolean, fails_C boolean, good boolean, toxic boolean"), "ABC")
    want = []
    for part in "pq":
        of = [r for r in rows if r[0] == part]
        total = dict.fromkeys("ABC", 0)
        lines = []
        for order in permutations("ABC"):
            left = of
            for step, k in enumerate(order, 1):
                at = "ABC".index(k) + 1
                gone = [r for r in left if r[at]]
                earlier = sum(r[at] for r in of) - len(gone)
                left = [r for r in left if not r[at]]
                total[k] += len(gone)
                alone = sum(r[at] and sum(r[1:4]) == 1 for r in of)
                lines.append((part, "".join(order), step, len(left), len(gone), earlier, alone, sum(r[4] for r in gone), sum(r[5] for r in gone), k))
        want += [(*x[:-1], total[x[-1]]) for x in lines]
    assert sorted(map(tuple, got.collect())) == sorted(want)
