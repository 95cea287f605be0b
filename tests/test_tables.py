from __future__ import annotations

import json
import random

from binsift.operators import ops
from binsift.sources import records, tables


def record(rng, name, n):
    value = lambda: {"name": rng.choice(["V1", "V2", "<free>@plt", "ram(0x10)", "const(0x8)", ""]), "space": "unique", "size": rng.choice([4, 8])}
    made = [{"seq": i, "op": rng.choice(["COPY", "CALL", "CALLIND", "CAST", "INDIRECT", "STORE", "RETURN"]), "addr": "a", "output": rng.choice([None, value()]), "inputs": [value() for _ in range(rng.randrange(4))]} for i in range(n)]
    return json.dumps({"name": name, "ops": made, "extra": 1})


def test_rows_equal_the_flat_records(spark, tmp_path):
    rng = random.Random(8)
    for file in ("a.jsonl", "b.jsonl"):
        lines = [record(rng, f"f{rng.randrange(20)}", rng.randrange(6)) for _ in range(60)]
        lines += ["", "{broken", '{"name": "f1", "ops": [', "[1]", json.dumps({"name": "g"}), json.dumps({"name": "h", "ops": []})]
        rng.shuffle(lines)
        (tmp_path / file).write_text("\n".join(lines))
    path = f"file://{tmp_path}/*.jsonl"
    got = tables.operations(tables.lines(spark, path).repartition(5)).select("file", "fn", "seq", "op", "callee", "out_var", "args", "sizes")
    want = []
    for file in ("a.jsonl", "b.jsonl"):
        flat = ops.flat(records.read_functions(spark, f"file://{tmp_path}/{file}"))
        want += [(file, *r) for r in flat.select("fn", "seq", "op", "callee", "out_var", "args", "sizes").collect()]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)) and len(want) > 50


def test_defined_cases(spark):
    op = {"op": "COPY", "output": {"name": "V1"}, "inputs": [{"name": "V0", "size": 8}, None]}
    rows = [("a", 1, json.dumps({"ops": [op]})), ("a", 2, json.dumps({"ops": [op, "x", {"op": None}]})), ("a", 3, None), ("b", 1, "7"), (None, 1, json.dumps({"name": "f", "ops": [{"op": "CALL"}]}))]
    df = spark.createDataFrame(rows, "file string, n long, line string")
    got = sorted(map(repr, map(tuple, tables.operations(df).select("file", "fn", "seq", "op", "callee", "args").collect())))
    assert got == sorted(map(repr, [("a", "func_1", 0, "COPY", None, ["V0", None]), ("a", "func_2", 0, "COPY", None, ["V0", None]), (None, "f", 0, "CALL", "unknown", [])]))
    assert tables.operations(df.limit(0)).count() == 0


def test_plain_sql(spark):
    tables.register(spark, "ops_of")
    line = json.dumps({"name": "f", "ops": [{"op": "COPY", "output": {"name": "V1"}, "inputs": []}]})
    spark.createDataFrame([("a", 1, line)], "file string, n long, line string").createOrReplaceTempView("some_lines")
    sql = "SELECT fn, count(*) AS n FROM ops_of(TABLE(SELECT file, n, get_json_object(line, '$.name') AS name, line FROM some_lines) PARTITION BY (file, name) ORDER BY n) GROUP BY fn"
    assert [tuple(r) for r in spark.sql(sql).collect()] == [("f", 1)]
