"""Reports: the rows of a SARIF run, a JSON document, and a Markdown summary."""

from __future__ import annotations

import json
import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.severity import SEVERITIES, severity_rank
from quarry.functions.text import report_level


def report_rules(findings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rule_id, title, level): one row a rule, from its first finding by id."""
    first = F.min_by(F.struct("title", "severity"), F.col("id"))
    return findings.filter("rule_id is not null").groupBy(*keys, "rule_id").agg(first.alias("f")).select(*keys, "rule_id", F.col("f.title").alias("title"), report_level(F.col("f.severity")).alias("level"))


def _result() -> Column:
    """A finding as a SARIF result."""
    text = F.coalesce("title", F.lit(""))
    region = F.struct(F.greatest(F.coalesce("start_line", F.lit(1)), F.lit(1)).alias("startLine"), F.col("end_line").alias("endLine"))
    place = F.when(F.col("file").isNotNull(), F.array(F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))))
    step = lambda s: F.struct(F.struct(F.struct(F.struct(s["file"].alias("uri")).alias("artifactLocation"), F.struct(s["line"].alias("startLine")).alias("region")).alias("physicalLocation"), F.struct(s["message"].alias("text")).alias("message")).alias("location"))
    flow = F.when(F.size("steps") > 0, F.array(F.struct(F.array(F.struct(F.transform("steps", step).alias("locations"))).alias("threadFlows"))))
    return F.to_json(F.struct(F.col("rule_id").alias("ruleId"), report_level(F.col("severity")).alias("level"), F.struct(text.alias("text")).alias("message"), place.alias("locations"), flow.alias("codeFlows")))


def _order() -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in ("rule_id", "file", "id")]


def report_results(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Findings as SARIF results with their place in the order rule, file, id within `keys`."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*_order()))
    return findings.select(*keys, "id", n.alias("place"), _result().alias("result"))


def write_sarif(findings: DataFrame, path: str, tool: str = "quarry", version: str = "1.0.0") -> None:
    """One SARIF 2.1.0 document of all findings, written as a stream: Spark sorts, the driver holds one partition at a time."""
    rules = [{"id": r.rule_id, "shortDescription": {"text": r.title or ""}, "defaultConfiguration": {"level": r.level}} for r in report_rules(findings, []).orderBy("rule_id").toLocalIterator()]
    head = {"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": {"name": tool, "version": version, "rules": rules}}, "results": []}]}
    before, after = json.dumps(head).rsplit("[]", 1)
    with open(path, "w", encoding="utf-8") as out:
        out.write(before + "[")
        for n, r in enumerate(findings.orderBy(*_order()).select(_result().alias("result")).toLocalIterator()):
            out.write(("," if n else "") + "\n" + r.result)
        out.write("\n]" + after)


def sarif(findings: DataFrame, tool: str = "quarry", version: str = "1.0.0") -> str:
    """The document of `write_sarif` as a text, for reports that fit into memory."""
    with tempfile.NamedTemporaryFile("r", suffix=".sarif", encoding="utf-8") as f:
        write_sarif(findings, f.name, tool, version)
        return f.read()


def json_report(findings: DataFrame, path: str) -> None:
    """Findings as JSON lines, written in parallel."""
    findings.write.mode("errorifexists").json(path)


def markdown(counts: DataFrame, dominant: DataFrame, scores: DataFrame, coverage: DataFrame | None = None, statuses: DataFrame | None = None, findings: DataFrame | None = None, most: int = 25) -> str:
    """A report of small aggregates and, of each advisory rule, the first `most` findings in the reader's order.

    counts: severity, defects, measured. dominant: rule_id, n. scores: category,
    score. coverage: language, files, attempted, succeeded. statuses: status, n.
    findings: the rows of `findings.human_order`, written as a stream.
    """
    rows = counts.collect()
    rank = {s: i for i, s in enumerate([*SEVERITIES, "Unknown"])}
    rows.sort(key=lambda r: rank.get(r.severity, 9))
    defects, measured = sum(r.defects for r in rows), sum(r.measured for r in rows)
    out = ["# Scan report", "", f"{defects + measured} findings: {defects} defects, {measured} measured.", "", "| severity | defects | measured |", "|-|-:|-:|"]
    out += [f"| {r.severity} | {r.defects} | {r.measured} |" for r in rows]
    out += ["", "| rule | findings |", "|-|-:|"] + [f"| {r.rule_id} | {r.n} |" for r in dominant.collect()]
    out += ["", "| category | score |", "|-|-:|"] + [f"| {r.category} | {r.score:.1f} |" for r in scores.orderBy("category").collect()]
    if coverage is not None:
        out += ["", "| language | files | tried | read |", "|-|-:|-:|-:|"] + [f"| {r.language or 'none'} | {r.files} | {r.attempted} | {r.succeeded} |" for r in coverage.orderBy("language").collect()]
    if statuses is not None:
        out += ["", "| review | findings |", "|-|-:|"] + [f"| {r.status} | {r.n} |" for r in statuses.orderBy("status").collect()]
    if findings is not None:
        total = findings.groupBy("rule_id").agg(F.count(F.lit(1)).alias("all"), F.first("category").alias("category"))
        left = {r.rule_id: r.all - most for r in total.filter((F.col("category") == "Maintainability") & (F.col("all") > most)).collect()}
        shown = findings.filter((F.col("category") != "Maintainability") | F.col("category").isNull() | (F.col("place") <= most)).orderBy(severity_rank(F.col("severity")).desc(), "rule_id", "place")
        out += ["", "## Findings", ""] + [f"- **{r.severity or 'Unknown'}** `{r.rule_id}` {r.title or ''} ({r.file or '?'}:{r.start_line or 0})" for r in shown.select("severity", "rule_id", "title", "file", "start_line").toLocalIterator()]
        out += [f"- `{rule}`: {n} more" for rule, n in sorted(left.items())]
    return "\n".join(out) + "\n"


def write(kind: str, path: str, findings: DataFrame, summary: str = "") -> None:
    """A report by the name of its format: json (lines, in parallel), sarif, markdown or terminal (the summary); else an error."""
    if kind == "json":
        json_report(findings, path)
    elif kind == "sarif":
        write_sarif(findings, path)
    elif kind in ("markdown", "terminal"):
        with open(path, "w", encoding="utf-8") as out:
            out.write(summary)
    else:
        raise ValueError(f"unknown format {kind}")
