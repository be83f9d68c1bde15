"""Known findings: what is new since a baseline was taken."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def apply_baseline(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings whose (project, fingerprint) is not in the baseline."""
    return findings.join(baseline.select("project", "fingerprint"), ["project", "fingerprint"], "left_anti").select(
        *findings.columns
    )


def suppressed_counts(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """(project, suppressed): findings the baseline covers."""
    known = findings.join(baseline.select("project", "fingerprint"), ["project", "fingerprint"], "left_semi")
    return known.groupBy("project").agg(F.count("*").alias("suppressed"))


def split_by_baseline(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings with ``is_new``, for callers that want new and known ones from one join."""
    known = baseline.select("project", "fingerprint").distinct().withColumn("known", F.lit(True))
    joined = findings.join(known, ["project", "fingerprint"], "left")
    return joined.select(*findings.columns, F.col("known").isNull().alias("is_new"))


def baseline_snapshot(findings: DataFrame) -> DataFrame:
    """Baseline rows of a run, one per finding."""
    return findings.select(
        "project", "fingerprint", "rule_id", "severity", F.col("file_path").alias("file"),
        F.col("line_number").alias("line"), F.col("code_snippet").alias("snippet"),
    )
