"""Incremental audits over a stream of arriving file versions.

Detection needs no state and no shuffle, so the batch operators serve streams unchanged. These
functions carry the event time along and add the stateful steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.config import ScanConfig
from auditlake.operators.detect import detect
from auditlake.operators.select import select_files


def stream_scan(files: DataFrame, config: ScanConfig | None = None, time_column: str = "ts") -> DataFrame:
    """Findings of a stream of files (project, path, content, event time), with their event time."""
    config = config or ScanConfig()
    return detect(select_files(files, config.exclude_paths), config, keep=(time_column,))


def stream_new_findings(
    findings: DataFrame, baseline: DataFrame | None = None, delay: str = "1 hour", time_column: str = "ts"
) -> DataFrame:
    """Findings whose fingerprint is neither in the static baseline nor was seen within the delay.

    State holds one entry per (project, fingerprint) and is dropped as the watermark passes.
    """
    if baseline is not None:
        known = baseline.select("project", "fingerprint").distinct().withColumn("known", F.lit(True))
        joined = findings.join(known, ["project", "fingerprint"], "left")
        findings = joined.filter(F.col("known").isNull()).select(*findings.columns)
    return findings.withWatermark(time_column, delay).dropDuplicatesWithinWatermark(["project", "fingerprint"])


def stream_severity_windows(
    findings: DataFrame, width: str = "1 hour", delay: str = "1 hour", time_column: str = "ts"
) -> DataFrame:
    """(window_start, severity, findings): counts per tumbling window; rows later than the delay are dropped."""
    counted = (
        findings.withWatermark(time_column, delay)
        .groupBy(F.window(time_column, width).alias("w"), "severity")
        .agg(F.count("*").alias("findings"))
    )
    return counted.select(F.col("w.start").alias("window_start"), "severity", "findings")
