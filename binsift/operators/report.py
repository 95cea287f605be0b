"""Reports of findings as lines, JSON and HTML, and tables for a console: built as columns, written by Spark's sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import saved
from .select import severity_rank

# Fixed value: version that readers of the JSON report look for.
REPORT_SCHEMA = "pcode-vuln/1.0"


def in_order(rows: DataFrame, *keys: Column) -> DataFrame:
    """rows with order (1, 2, ...) by keys, which should tell rows apart. Rows are dealt by ranges of the keys, sorted and
    numbered there as they are written; only the counts of the ranges, one number each, meet in one task."""
    at = F.monotonically_increasing_id()  # the range, then 33 bits of the place in it
    dealt = saved(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", at))
    dealt = dealt.withColumns({"_range": F.shiftright("_at", 33), "order": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1}).drop("_at")
    sizes = dealt.groupBy("_range").agg(F.max("order").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    return dealt.join(F.broadcast(starts), "_range").withColumn("order", F.col("order") + F.col("_before")).drop("_range", "_before")


def numbered(findings: DataFrame, *ties: str) -> DataFrame:
    """Findings with order (1, 2, ...) and id VULN-001, ... by severity, then ties."""
    rows = in_order(findings, severity_rank(F.col("severity")).desc(), *map(F.col, ties))
    return rows.withColumn("id", F.format_string("VULN-%03d", "order"))


def _line(findings: DataFrame) -> Column:
    return F.format_string("[%s] %s in %s at %s (%s%%)", F.upper("severity"), F.col("vuln_type"), F.col("fn"), F.col("sink_fn"), F.col("conf_pct").cast("string"))


def text_lines(findings: DataFrame, *ties: str) -> DataFrame:
    """line_no, line of the confirmed findings."""
    return numbered(findings, *ties).select(F.col("order").cast("long").alias("line_no"), _line(findings).alias("line"))


def text_report(findings: DataFrame, rejected: DataFrame, functions: DataFrame, *ties: str) -> DataFrame:
    """section, line_no, line: 1 counts, 2 confirmed findings by severity, 3 rejected ones with their reason, 4 statistics
    of each function with candidates or unknown calls, the most candidates first. Written in order of the first two.

    findings and rejected: fn, vuln_type, sink_fn, severity, conf_pct, ties; rejected also reason; functions: fn,
    candidates, unknown_calls.
    """
    good = text_lines(findings, *ties).select(F.lit(2).alias("section"), "line_no", "line")
    why = F.format_string("%s in %s at %s: %s", F.col("vuln_type"), F.col("fn"), F.col("sink_fn"), F.coalesce("reason", F.lit("no reason given")))
    bad = in_order(rejected, *map(F.col, ties)).select(F.lit(3).alias("section"), F.col("order").cast("long").alias("line_no"), why.alias("line"))
    some = functions.filter("candidates > 0 OR unknown_calls > 0")
    stat = F.format_string("%s vulns=%s unknown_calls=%s", F.col("fn"), F.col("candidates").cast("string"), F.col("unknown_calls").cast("string"))
    per_fn = in_order(some, F.desc("candidates"), F.col("fn")).select(F.lit(4).alias("section"), F.col("order").cast("long").alias("line_no"), stat.alias("line"))
    total = functions.agg(F.count("*").alias("f"), F.coalesce(F.sum("candidates"), F.lit(0)).alias("c")).join(findings.agg(F.count("*").alias("y"))).join(rejected.agg(F.count("*").alias("n")))
    heads = F.array(*[F.struct(F.lit(k).alias("line_no"), F.concat(F.lit(f"{name}: "), F.col(c).cast("string")).alias("line")) for k, (name, c) in enumerate((("Functions", "f"), ("Candidates", "c"), ("Confirmed", "y"), ("Rejected", "n")), 1)])
    head = total.select(F.explode(heads).alias("h")).select(F.lit(1).alias("section"), F.col("h.line_no").cast("long").alias("line_no"), "h.line")
    return head.unionByName(good).unionByName(bad).unionByName(per_fn)


def json_findings(findings: DataFrame, *ties: str) -> DataFrame:
    """One JSON object a finding."""
    rows = numbered(findings, *ties)
    rest = [c for c in rows.columns if c not in ("order", "id")]
    return rows.select(F.to_json(F.struct("id", *rest)).alias("finding"))


def json_report(findings: DataFrame, rejected: DataFrame, binary: str, *ties: str) -> DataFrame:
    """The whole report as one JSON document: a row of column report, as large as its findings, which a budget has cut;
    json_findings gives any number of them, one a row."""
    rows = numbered(findings, *ties)
    good = rows.agg(F.sort_array(F.collect_list(F.struct("order", *[c for c in rows.columns if c != "order"]))).alias("confirmed"))
    bad = rejected.agg(F.collect_list(F.struct("fn", "vuln_type", "reason")).alias("rejected"))
    doc = F.struct(F.lit(REPORT_SCHEMA).alias("schema_version"), F.lit(binary).alias("binary"), F.struct(F.size("confirmed").alias("confirmed"), F.size("rejected").alias("rejected")).alias("summary"), F.col("confirmed").alias("confirmed_vulnerabilities"), F.col("rejected").alias("rejected_candidates"))
    return good.join(bad).select(F.to_json(doc).alias("report"))


def escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


_STYLE = "body{font-family:sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #bbb;padding:4px 8px;text-align:left}.critical{background:#f4b6b6}.high{background:#f9d9b0}"


def html_lines(findings: DataFrame, rejected: DataFrame, binary: str, *ties: str) -> DataFrame:
    """section, line_no, html of a self-contained page: head and counts, one table row a confirmed finding with its taint
    path, a list of rejected ones, the end. Written in order of the first two."""
    optional = lambda df, c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")
    rows = numbered(findings, *ties)
    cell = lambda c: F.concat(F.lit("<td>"), escaped(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>"))
    path = F.array_join(F.col("taint_path"), " > ") if "taint_path" in rows.columns else optional(rows, "taint_source")
    row = F.concat(F.lit("<tr class='"), escaped(F.col("severity")), F.lit("'>"), *[cell(c) for c in ("id", "severity", "vuln_type", "fn", "sink_fn", "conf_pct")], F.lit("<td>"), escaped(F.coalesce(path, F.lit(""))), F.lit("</td></tr>"))
    good = rows.select(F.lit(2).alias("section"), F.col("order").cast("long").alias("line_no"), row.alias("html"))
    why = F.concat(F.lit("<li>"), escaped(F.concat_ws(" in ", "vuln_type", "fn")), F.lit(": "), escaped(optional(rejected, "reason")), F.lit("</li>"))
    bad = in_order(rejected, *map(F.col, ties)).select(F.lit(4).alias("section"), F.col("order").cast("long").alias("line_no"), why.alias("html"))
    n = findings.agg(F.count("*").alias("y")).join(rejected.agg(F.count("*").alias("n")))
    title = escaped(F.lit(binary))
    head = F.concat(
        F.lit(f"<!DOCTYPE html><html lang='en'><head><meta charset='utf-8'><title>Findings in "), title, F.lit(f"</title><style>{_STYLE}</style></head><body><h1>Findings in "), title, F.lit("</h1><p>Confirmed: "),
        F.col("y").cast("string"), F.lit(", rejected: "), F.col("n").cast("string"), F.lit("</p><table><tr><th>id</th><th>severity</th><th>type</th><th>function</th><th>sink</th><th>confidence</th><th>taint path</th></tr>"),
    )
    fixed = [(1, head), (3, F.lit("</table><details><summary>Rejected candidates</summary><ul>")), (5, F.lit("</ul></details></body></html>"))]
    frame = n.select(F.explode(F.array(*[F.struct(F.lit(k).alias("section"), F.lit(1).cast("long").alias("line_no"), h.alias("html")) for k, h in fixed])).alias("x")).select("x.*")
    return frame.unionByName(good).unionByName(bad)


def html_report(findings: DataFrame, rejected: DataFrame, binary: str, *ties: str) -> DataFrame:
    """The page as one row of column html, as large as its findings, which a budget has cut."""
    lines = html_lines(findings, rejected, binary, *ties)
    return lines.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("section", "line_no", "html"))), lambda x: x["html"]), "\n").alias("html"))


def table(rows: DataFrame, columns: list[str], *keys: Column) -> DataFrame:
    """line_no, line of a console table: names, then the rows in order of keys, each column as wide as its widest value."""
    text = rows.select("*", *[F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(f"_{c}") for c in columns])
    widest = text.agg(*[F.greatest(F.lit(len(c)), F.coalesce(F.max(F.length(f"_{c}")), F.lit(0))).alias(f"w_{c}") for c in columns])
    padded = lambda value, c: F.rpad(value, F.col(f"w_{c}"), F.lit(" "))
    line = lambda of: F.rtrim(F.concat_ws("  ", *[padded(of(c), c) for c in columns]))
    body = in_order(text, *keys).join(F.broadcast(widest)).select(F.col("order").cast("long").alias("line_no"), line(lambda c: F.col(f"_{c}")).alias("line"))
    return widest.select(F.lit(0).cast("long").alias("line_no"), line(F.lit).alias("line")).unionByName(body)
