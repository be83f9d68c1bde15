"""Counts, grades and gates by project."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.catalog.taxonomy import severity_rank
from auditlake.functions.scoring import gate_status, grade_of

LEVELS = ("critical", "high", "medium", "low")


def severity_counts(findings: DataFrame) -> DataFrame:
    """(project, total, critical, high, medium, low); partial counts are merged, so a hot project is cheap."""
    return findings.groupBy("project").agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("severity") == level.upper()).alias(level) for level in LEVELS],
    )


def files_scanned(files: DataFrame) -> DataFrame:
    return files.groupBy("project").agg(F.count("*").alias("files_scanned"))


def project_summary(findings: DataFrame, files: DataFrame, suppressed: DataFrame | None = None) -> DataFrame:
    """One row per project of the corpus: file count, counts by severity, grade, gate status.

    Files and findings are counted in one aggregation over their union, so a project without
    findings keeps its row and there is one shuffle of partial counts. ``suppressed`` is
    (project, suppressed).
    """
    zero = F.lit(0).cast("long")
    rows = files.select("project", F.lit(1).cast("long").alias("files"), zero.alias("suppressed"), F.lit(None).cast("int").alias("rank"))
    rows = rows.unionByName(findings.select("project", zero.alias("files"), zero.alias("suppressed"), F.col("severity_rank").alias("rank")))
    if suppressed is not None:
        rows = rows.unionByName(
            suppressed.select("project", zero.alias("files"), F.col("suppressed").cast("long").alias("suppressed"), F.lit(None).cast("int").alias("rank"))
        )
    counted = rows.groupBy("project").agg(
        F.sum("files").alias("files_scanned"),
        F.count("rank").alias("total"),
        *[F.count_if(F.col("rank") == severity_rank(level)).alias(level) for level in LEVELS],
        F.sum("suppressed").alias("suppressed"),
        F.max("rank").alias("max_rank"),
    )
    return counted.select(
        "project", "files_scanned", "total", *LEVELS, "suppressed",
        grade_of(F.col("max_rank")).alias("grade"),
        gate_status(F.col("critical"), F.col("high"), F.col("medium")).alias("status"),
    )


def grades(findings: DataFrame, files: DataFrame) -> DataFrame:
    return project_summary(findings, files).select("project", "grade")


def quality_gate(summary: DataFrame, fail_on: str = "critical") -> DataFrame:
    """(project, failed): any finding at or above ``fail_on``; ``none`` never fails."""
    if fail_on.lower() == "none":
        failed = F.lit(False)
    else:
        rank = severity_rank(fail_on)
        failed = sum((F.col(level) for level in LEVELS if severity_rank(level) >= rank), F.lit(0)) > 0
    return summary.select("project", failed.alias("failed"))


def severity_rollup(findings: DataFrame) -> DataFrame:
    """Finding counts by project, category and severity with all subtotals."""
    return findings.rollup("project", "category", "severity").agg(F.count("*").alias("findings"))
