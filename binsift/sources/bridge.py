"""Bridge views: the driver's tables in the engine's data model, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
VIEWS = {
    "b_ops": """
WITH e AS (
  SELECT user_id, event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS seq
  FROM events)
SELECT concat('fn_', CAST(user_id AS STRING)) AS fn, seq, k, event_id,
  CASE k % 16 WHEN 0 THEN 'CALL' WHEN 1 THEN 'LOAD' WHEN 2 THEN 'STORE' WHEN 3 THEN 'INT_MULT'
    WHEN 4 THEN 'INT_ADD' WHEN 5 THEN 'INT_LESS' WHEN 6 THEN 'CBRANCH' WHEN 7 THEN 'PTRADD'
    WHEN 8 THEN 'INT_AND' WHEN 9 THEN 'CALL' WHEN 10 THEN 'COPY' WHEN 11 THEN 'INT_ZEXT'
    WHEN 12 THEN 'PTRSUB' WHEN 13 THEN 'CALLIND' WHEN 14 THEN 'INT_EQUAL' ELSE 'RETURN' END AS op,
  CASE WHEN k % 16 IN (2, 6, 15) THEN NULL ELSE concat('VAR_', CAST(seq AS STRING)) END AS out_var,
  CASE WHEN k % 16 IN (0, 9) THEN CASE event_id % 12 WHEN 0 THEN 'recv' WHEN 1 THEN 'fread' WHEN 2 THEN 'getenv'
    WHEN 3 THEN 'memcpy' WHEN 4 THEN 'strcpy' WHEN 5 THEN 'malloc' WHEN 6 THEN 'free' WHEN 7 THEN 'system'
    WHEN 8 THEN 'printf' WHEN 9 THEN concat('fn_', CAST(k AS STRING)) WHEN 10 THEN 'xmlStrlen' ELSE 'fgets' END END AS callee,
  CASE WHEN seq - 1 - (event_id % 4) < 0 THEN concat('VAR_p', CAST(event_id % 2 AS STRING))
       ELSE concat('VAR_', CAST(seq - 1 - (event_id % 4) AS STRING)) END AS in1,
  CASE WHEN event_id % 3 = 0 THEN concat('const(', CAST(k * 8 AS STRING), ')')
       WHEN seq - 1 - (event_id % 7) < 0 THEN 'VAR_p1'
       ELSE concat('VAR_', CAST(seq - 1 - (event_id % 7) AS STRING)) END AS in2,
  CASE WHEN event_id % 5 = 0 THEN 4 ELSE 8 END AS in_size
FROM e""",
    # Programs with every operation, rule and constant that the forward walk tells apart: in1 to in3, of which n are arguments.
    "b_prog": """
WITH e AS (
  SELECT user_id, event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS seq
  FROM events),
m AS (
  SELECT *, CASE (k * 5 + event_id) % 24 WHEN 6 THEN 'LOAD' WHEN 7 THEN 'STORE' WHEN 8 THEN 'INT_MULT' WHEN 9 THEN 'INT_ADD' WHEN 10 THEN 'INT_LESS' WHEN 11 THEN 'CBRANCH'
    WHEN 12 THEN 'PTRADD' WHEN 13 THEN 'INT_AND' WHEN 14 THEN 'COPY' WHEN 15 THEN 'INT_ZEXT' WHEN 16 THEN 'PTRSUB' WHEN 17 THEN 'CALLIND' WHEN 18 THEN 'INT_EQUAL' WHEN 19 THEN 'RETURN'
    WHEN 20 THEN 'LOAD' WHEN 21 THEN 'STORE' WHEN 22 THEN 'PTRSUB' WHEN 23 THEN CASE event_id % 3 WHEN 0 THEN 'INT_RIGHT' WHEN 1 THEN 'CAST' ELSE 'MULTIEQUAL' END ELSE 'CALL' END AS op FROM e)
SELECT CASE WHEN user_id = 5 THEN 'xmalloc' ELSE concat(CASE WHEN user_id % 11 = 3 THEN 'encode_' ELSE 'fn_' END, CAST(user_id AS STRING)) END AS fn, seq, op,
  CASE WHEN op IN ('STORE', 'CBRANCH', 'RETURN') OR (op = 'CALL' AND event_id % 7 = 0) THEN NULL WHEN event_id % 11 = 0 AND seq >= 2 THEN concat('VAR_', CAST(seq - 2 AS STRING)) ELSE concat('VAR_', CAST(seq AS STRING)) END AS out_var,
  CASE WHEN op <> 'CALL' THEN NULL ELSE CASE (event_id + k) % 27 WHEN 0 THEN 'recv' WHEN 1 THEN 'fread' WHEN 2 THEN 'getenv' WHEN 3 THEN 'memcpy' WHEN 4 THEN 'strcpy' WHEN 5 THEN 'malloc' WHEN 6 THEN 'free'
    WHEN 7 THEN 'system' WHEN 8 THEN 'printf' WHEN 9 THEN concat('fn_', CAST(k AS STRING)) WHEN 10 THEN 'xmlStrlen' WHEN 11 THEN 'fgets' WHEN 12 THEN 'free' WHEN 13 THEN 'calloc' WHEN 14 THEN 'realloc'
    WHEN 15 THEN 'scanf' WHEN 16 THEN 'recvmsg' WHEN 17 THEN 'png_free' WHEN 18 THEN 'png_safe_execute' WHEN 19 THEN 'strncpy' WHEN 20 THEN 'snprintf' WHEN 21 THEN 'xmlParserInputBufferPush' WHEN 22 THEN 'bcopy'
    WHEN 23 THEN 'png_read_row' WHEN 24 THEN 'free' WHEN 25 THEN 'my_read_buffer' ELSE 'strlen' END END AS callee,
  CASE WHEN seq - 1 - (event_id % 4) < 0 THEN concat('VAR_p', CAST(event_id % 2 AS STRING)) ELSE concat('VAR_', CAST(seq - 1 - (event_id % 4) AS STRING)) END AS in1,
  CASE WHEN op = 'PTRSUB' AND event_id % 9 < 8 THEN CASE event_id % 2 WHEN 0 THEN 'const(0x8)' ELSE 'const(0x10)' END
       WHEN event_id % 3 = 0 THEN CASE k % 8 WHEN 0 THEN 'const(0x0)' WHEN 1 THEN 'const(0xff)' WHEN 2 THEN 'const(0xffff)' WHEN 3 THEN 'const(0xffffffff)' WHEN 4 THEN 'const(0x3ff)' WHEN 5 THEN 'const(0x8)' WHEN 6 THEN 'const(0xffff)' ELSE 'const(24)' END
       WHEN seq - 1 - (event_id % 5) < 0 THEN 'VAR_p1' ELSE concat('VAR_', CAST(seq - 1 - (event_id % 5) AS STRING)) END AS in2,
  CASE WHEN k % 3 = 0 THEN 'const(0x20)' WHEN seq - 1 - (k % 6) < 0 THEN 'VAR_p2' ELSE concat('VAR_', CAST(seq - 1 - (k % 6) AS STRING)) END AS in3,
  CASE event_id % 5 WHEN 0 THEN 4 WHEN 1 THEN 1 ELSE 8 END AS size1, CASE k % 4 WHEN 0 THEN 4 ELSE 8 END AS size2, CASE event_id % 6 WHEN 0 THEN 2 WHEN 1 THEN 4 ELSE 8 END AS size3,
  CASE op WHEN 'CALL' THEN 3 WHEN 'CALLIND' THEN 2 WHEN 'LOAD' THEN CASE WHEN event_id % 3 = 2 THEN 2 ELSE 1 END WHEN 'STORE' THEN CASE WHEN event_id % 5 = 4 THEN 3 ELSE 2 END WHEN 'COPY' THEN 1 WHEN 'INT_ZEXT' THEN 1 WHEN 'CAST' THEN 1 WHEN 'CBRANCH' THEN 1 ELSE 2 END AS n
FROM m""",
    "b_edges": "SELECT DISTINCT fn AS caller, callee FROM b_ops WHERE callee IS NOT NULL",
    "b_candidates": """
SELECT concat('fn_', CAST(l_suppkey AS STRING)) AS fn, l_orderkey * 10 + l_linenumber AS cand_id,
  CASE l_partkey % 5 WHEN 0 THEN 'buffer_overflow' WHEN 1 THEN 'integer_overflow' WHEN 2 THEN 'format_string'
    WHEN 3 THEN 'use_after_free' ELSE 'write_what_where' END AS vuln_type,
  CASE l_returnflag WHEN 'A' THEN 'LIBRARY_MATCH' WHEN 'R' THEN 'STRUCTURAL_MATCH' ELSE 'NO_MATCH' END AS match_kind,
  CASE l_linenumber % 4 WHEN 0 THEN 'memcpy' WHEN 1 THEN 'malloc' WHEN 2 THEN 'STORE' ELSE 'printf' END AS sink_fn,
  CAST(round(l_quantity) AS INT) * 2 AS conf_pct
FROM lineitem""",
    "b_assess": """
SELECT concat('fn_', CAST(o_custkey AS STRING)) AS fn, o_orderkey AS assess_id,
  CASE o_orderkey % 4 WHEN 0 THEN 'Strong' WHEN 1 THEN 'Moderate' WHEN 2 THEN 'Weak' ELSE 'Unsupported' END AS support,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'High' WHEN '2' THEN 'Medium' ELSE 'Low' END AS exploitability,
  CASE o_orderstatus WHEN 'F' THEN 'Low' WHEN 'O' THEN 'Moderate' ELSE 'High' END AS uncertainty
FROM orders""",
    "b_sem": """
SELECT concat('fn_', CAST(user_id AS STRING)) AS fn, event_id AS sem_id, event_type AS analysis_type,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS conf_pct
FROM events""",
    "b_truth": """
SELECT l.doc_id, l.toxic AS label, CASE WHEN d.n_chars > 2000 THEN 1 ELSE 0 END AS predicted
FROM labels l JOIN documents d ON d.doc_id = l.doc_id""",
    "b_calls": """
SELECT role AS stage, conv_id, turn, CASE WHEN length(text) < 4 THEN 1 ELSE CAST(floor(length(text) / 4.0) AS BIGINT) END AS tokens
FROM conversations""",
    "b_graph": """
SELECT DISTINCT concat('fn_', CAST(l_suppkey AS STRING)) AS caller, concat('fn_', CAST(l_partkey % 100 + 1 AS STRING)) AS callee
FROM lineitem""",
}


def _needs(sql: str) -> list[str]:
    """Views that a statement uses, inner ones first."""
    out: list[str] = []
    for name in VIEWS:
        if re.search(rf"\b{name}\b", sql) and name not in out:
            out += [x for x in _needs(VIEWS[name]) if x not in out] + [name]
    return out


def oracle(sql: str) -> str:
    """A statement over views as one over the driver's tables."""
    body = sql.strip()
    found = _needs(body)
    if not found:
        return body
    views = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in found)
    if m := re.match(r"WITH\s+(RECURSIVE\s+)?", body):
        return f"WITH {m[1] or ''}{views},\n{body[m.end() :]}"
    return f"WITH {views}\n{body}"


def view(spark: SparkSession, sf_dir: str, name: str, placed: bool = False) -> DataFrame:
    """A bridge view as DataFrame. placed adds, to one that only selects from a table, where a row stands in the table:
    `place`, its file and its number there."""
    sql, parts = VIEWS[name], {}
    for t in (*TABLES, *VIEWS):
        if t != name and re.search(rf"\b(FROM|JOIN) {t}\b", sql):
            parts[t] = view(spark, sf_dir, t) if t in VIEWS else spark.read.parquet(f"{sf_dir}/{t}.parquet")
            if placed:
                parts[t] = parts[t].select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("place"))
                sql = re.sub(rf"\nFROM {t}$", rf", place\nFROM {t}", sql)
            sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **parts)
