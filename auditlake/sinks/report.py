"""The data behind written reports: one long table (project, section, ord, key, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import text as tx
from auditlake.operators.findings import union_findings

# Section numbers, in report order.
BANNER, COUNTS, PROFILE, FINDINGS, DEPENDENCIES, EXTERNAL, ADVICE = range(1, 8)

BANNERS = {
    "BLOCKED": ("critical", "Deployment blocked, critical findings: "),
    "ACTION": ("high", "Action required, high findings: "),
    "REVIEW": ("medium", "Review needed, medium findings: "),
    "PASSED": (None, "Passed, no critical or high findings"),
}


def _lines(df: DataFrame, section: int, ord_: Column, key: Column, text: Column) -> DataFrame:
    return df.select(
        "project", F.lit(section).alias("section"), ord_.cast("int").alias("ord"), key.alias("key"), text.alias("text")
    )


def _named(df: DataFrame, section: int, entries: list[tuple[str, Column]]) -> DataFrame:
    """One line per (label, value) of each row; entries with a null value are left out."""
    pairs = F.array_compact(F.array(*[
        F.when(v.isNotNull(), F.struct(F.lit(i).alias("ord"), F.concat(F.lit(f"{label}: "), v.cast("string")).alias("text")))
        for i, (label, v) in enumerate(entries)
    ]))
    return _lines(df.select("project", F.inline(pairs)), section, F.col("ord"), F.lit(""), F.col("text"))


def _joined(column: str, empty: str) -> Column:
    return F.when(F.size(column) > 0, F.array_join(column, ", ")).otherwise(F.lit(empty))


def banner(summary: DataFrame) -> DataFrame:
    text = F.lit(None).cast("string")
    for status, (level, words) in BANNERS.items():
        line = F.concat(F.lit(words), F.col(level).cast("string")) if level else F.lit(words)
        text = F.when(F.col("status") == status, line).otherwise(text)
    return _lines(summary, BANNER, F.lit(0), F.lit(""), text)


def counts(summary: DataFrame, dependencies: DataFrame) -> DataFrame:
    deps = dependencies.groupBy("project").agg(F.count("*").alias("dependencies"))
    rows = summary.join(deps, "project", "left").withColumn("dependencies", F.coalesce("dependencies", F.lit(0)))
    return _named(rows, COUNTS, [
        *[(c.capitalize(), F.col(c)) for c in ("grade", "critical", "high", "medium", "low", "dependencies")],
        ("Suppressed by baseline", F.when(F.col("suppressed") > 0, F.col("suppressed"))),
    ])


def profile(profiles: DataFrame) -> DataFrame:
    tools = "ai_tool_indicators"
    return _named(profiles, PROFILE, [
        ("Type", F.col("project_type")),
        ("Languages", _joined("languages", "Unknown")),
        ("Frameworks", _joined("frameworks", "None")),
        ("Databases", _joined("databases", "None")),
        ("Cloud", _joined("cloud_services", "None")),
        ("Assistants", F.when(F.size(tools) > 0, F.array_join(tools, ", "))),
    ])


def finding_lines(findings: DataFrame) -> DataFrame:
    """One line per finding, most severe first; secrets masked."""
    where = F.concat(F.col("file_path"), F.lit(":"), F.col("line_number").cast("string"))
    label = F.when(F.col("cwe_id") != "", F.concat(F.lit(" | "), F.col("cwe_id"), F.lit(" "), F.col("owasp"))).otherwise(F.lit(""))
    text = F.concat(
        F.lit("["), F.col("rule_id"), F.lit("] "), F.col("severity"), F.lit(" "), F.col("description"), F.lit(" | "),
        where, label, F.lit(" | "), tx.display_snippet(F.col("category"), F.col("code_snippet")), F.lit(" | "),
        F.col("remediation"),
    )
    key = F.concat_ws(":", "file_path", "rule_id", F.format_string("%09d", F.col("line_number")))
    return _lines(findings, FINDINGS, 4 - F.col("severity_rank"), key, text)


def dependency_lines(findings: DataFrame) -> DataFrame:
    text = F.concat(
        F.lit("["), F.col("severity"), F.lit("] "), F.col("package"), F.lit(" ("), F.col("issue_type"), F.lit(") "),
        F.coalesce("version", F.lit("Unknown")), F.lit(" | "), F.col("description"), F.lit(" | "), F.col("file_path"),
        F.lit(" | "), F.col("remediation"),
    )
    return _lines(findings, DEPENDENCIES, F.lit(0), F.concat_ws(":", "file_path", "package", "issue_type", "cve_id"), text)


def external_lines(findings: DataFrame) -> DataFrame:
    """Lines for the findings of another scanner, as ``ingest_semgrep`` gives them."""
    text = F.concat(
        F.lit("["), F.col("severity"), F.lit("] "), F.col("rule_id"), F.lit(" | "),
        F.concat_ws(" ", F.array_join("cwe", ", "), F.array_join("owasp", ", ")), F.lit(" | "), F.col("file"),
        F.lit(":"), F.col("line").cast("string"), F.lit(" | "), F.col("message"),
    )
    key = F.concat_ws(":", "file", F.format_string("%09d", F.col("line")), "rule_id")
    return _lines(findings, EXTERNAL, F.lit(0), key, text)


def advice(summary: DataFrame) -> DataFrame:
    return _named(summary, ADVICE, [
        ("1", F.when(F.col("critical") > 0, F.lit("fix every critical finding before deployment"))),
        ("2", F.when(F.col("high") > 0, F.lit("schedule the high findings next"))),
    ])


def report_sections(
    findings: DataFrame, summary: DataFrame, dependencies: DataFrame, profiles: DataFrame,
    external: DataFrame | None = None,
) -> DataFrame:
    """All sections; ordering by project, section, ord and key gives the report."""
    parts = [
        banner(summary), counts(summary, dependencies), profile(profiles), finding_lines(findings),
        dependency_lines(dependencies), advice(summary),
    ]
    if external is not None:
        parts.append(external_lines(external))
    return union_findings(*parts)


def html_sections(sections: DataFrame) -> DataFrame:
    """The same sections with text escaped for HTML renderers."""
    return sections.withColumn("text", tx.html_escape(F.col("text")))


def write_report(sections: DataFrame, path: str) -> None:
    ordered = sections.repartitionByRange("project", "section", "ord", "key").sortWithinPartitions(
        "project", "section", "ord", "key"
    )
    ordered.select("project", "text").write.mode("overwrite").partitionBy("project").text(path)
