"""Tables that external services fill: decompiled functions come as records; answers of language models as the typed
tables below. A service is any function from a DataFrame of questions to one of these schemas; the default gives no rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMAS = {
    "callee_names": "target string, name string",
    "summaries": "fn string, likely_role string, external_input array<int>, writes_memory_at int, return_tainted boolean, size_arg int, marks_checked_args array<int>, external_source_args array<int>, confidence double, reasoning string",
    "reviews": "cand_id long, confirmed boolean, severity string, confidence double, reasoning string",
    "assessments": "cand_id long, support string, agreement array<string>, exploitability string, impact string, evidence_quality string, model_uncertainty string",
    "semantic_assessments": "fn string, analysis_type string, vuln_type string, confidence double, reasoning string",
    "logic_findings": "fn string, found boolean, vuln_type string, confidence double, trigger string",
    "verdicts": "cand_id long, confirmed boolean, confidence double, reasoning string",
    "calls": "stage string, model string, fn string, input_tokens long, output_tokens long, latency_s double",
}
Service = Callable[[DataFrame], DataFrame]


def ask(kind: str, questions: DataFrame, service: Service | None = None) -> DataFrame:
    """Answers of a service in the schema of their kind; none without a service. Columns missing are null, others go."""
    schema = SCHEMAS[kind]
    empty = questions.sparkSession.createDataFrame([], schema)
    if service is None:
        return empty
    got = service(questions)
    have = set(got.columns)
    return got.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in empty.schema.fields])


def object_of(text: Column) -> Column:
    """The JSON object in an answer: from the first brace to the last, code fences and talk around it gone; null if none."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))


def parsed(text: Column, schema: str) -> Column:
    """Fields of the JSON object in an answer; null where it can't be read."""
    return F.from_json(object_of(text), schema, {"mode": "PERMISSIVE"})


def tokens(text: Column) -> Column:
    """Estimated tokens: a quarter of the characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4))
