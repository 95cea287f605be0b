from __future__ import annotations

import random

from comparing import connection, same_rows

from binsift.llm import lines
from binsift.llm.queries import ORACLE_SQL, QUERIES

LONG = "alpha beta gamma " * 15


def brute(rows, min_lines=lines.MIN_LINES, min_chars=lines.MIN_CHARS):
    """Delete each window that stood earlier, document by document."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        parts = text.split("\n")
        solid = [(i, p.strip(" ")) for i, p in enumerate(parts) if p.strip(" ")]
        gone = set()
        for p in range(len(solid)):
            for k in range(1, min_lines + 1):
                window = solid[p : p + k]
                if len(window) == k and (k == min_lines or sum(len(s) for _, s in window) >= min_chars):
                    body = tuple(s for _, s in window)
                    if body in seen:
                        gone.update(range(window[0][0], window[-1][0] + 1))
                    seen.add(body)
                    break
        out[doc_id] = "\n".join(p for i, p in enumerate(parts) if i not in gone)
    return out


def test_query_gives_the_rows_of_its_sql(spark, small):
    same_rows(QUERIES["op1_line_dedup"](spark, small), connection(small), ORACLE_SQL["op1_line_dedup"])


def test_against_brute_force_on_random_documents(docs):
    draw = random.Random(1)
    stock = ["a", "bb", "ccc", LONG, LONG + "x", "", "  "]
    rows = [(i, "\n".join(draw.choice(stock) for _ in range(draw.randint(0, 14)))) for i in range(40)]
    got = {r.doc_id: r.text for r in lines.dedup(docs(rows)).collect()}
    assert got == brute(rows)


def test_hot_line_within_and_across_documents(docs):
    rows = [(i, f"{LONG}\nown {i}") for i in range(60)] + [(60, "\n".join(["same"] * 400))]
    got = {r.doc_id: r for r in lines.dedup(docs(rows)).collect()}
    assert got[0].text == rows[0][1] and got[7].text == "own 7" and got[60].text == "same"


def test_matches_are_extended_both_ways(docs):
    story = [f"line {k} of a story" for k in range(40)]
    rows = [(1, "\n".join(story)), (2, "\n".join(["own", *story[10:30], "end"])), (3, "\n".join([*story[35:], "", *story[:5]]))]
    got = sorted((r.doc_id, r.first, r.last, r.origin.doc_id, r.origin.p) for r in lines.matches(docs(rows)).collect())
    assert got == [(2, 1, 20, 1, 10), (3, 0, 4, 1, 35), (3, 6, 10, 1, 0)]


def test_fingerprints_are_guaranteed_and_fewer_than_windows(docs):
    draw = random.Random(5)
    rows = [(k, "\n".join(f"line {draw.randrange(10**6)}" for _ in range(300))) for k in range(3)]
    found = lines.fingerprints(docs(rows))
    windows = found.selectExpr("explode(windows) w").count()
    assert windows == 3 * 298 and found.count() < 0.75 * windows


def test_defined_results(docs, clashing):
    rows = [(0, None), (1, ""), (2, "x"), (2, "x"), (3, f"{LONG}\n{LONG}"), (None, f"{LONG}\ny"), (4, "word " * 40_000)]
    got = sorted(((r.doc_id, r.text, r.n_removed) for r in lines.dedup(clashing(rows)).collect()), key=repr)
    wanted = [(0, None, 0), (1, "", 0), (2, "x", 0), (2, "x", 0), (3, "", 2), (None, f"{LONG}\ny", 0), (4, "word " * 40_000, 0)]
    assert got == sorted(wanted, key=repr)  # null ids come first
    assert lines.dedup(docs([])).count() == 0
    assert "kept" in lines.dedup(clashing(rows)).columns
