"""Severity, level and label columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditlake.catalog.taxonomy import GRADE_BY_RANK, SEVERITY_RANK


def rank_of(severity: Column) -> Column:
    out = F.lit(0)
    for name, rank in SEVERITY_RANK.items():
        out = F.when(F.upper(severity) == name, F.lit(rank)).otherwise(out)
    return out


def grade_of(max_rank: Column) -> Column:
    """A to F from the highest severity rank; null rank means no finding."""
    out = F.lit(GRADE_BY_RANK[0])
    for rank in (1, 2, 3, 4):
        out = F.when(max_rank == rank, F.lit(GRADE_BY_RANK[rank])).otherwise(out)
    return out


def gate_status(critical: Column, high: Column, medium: Column) -> Column:
    return (
        F.when(critical > 0, "BLOCKED").when(high > 0, "ACTION").when(medium > 0, "REVIEW").otherwise("PASSED")
    )


def problem_level(severity: Column) -> Column:
    return F.when(severity.isin("CRITICAL", "HIGH"), "error").otherwise("warning")


def cvss_bucket(score: Column) -> Column:
    return F.when(score >= 9.0, "CRITICAL").when(score >= 7.0, "HIGH").when(score >= 4.0, "MEDIUM").otherwise("LOW")


def advisory_severity(database_label: Column, ecosystem_labels: Column) -> Column:
    """Severity of an advisory: the first non-empty ecosystem label, else the database label.

    Vendor words are mapped to the four levels; anything unknown counts as HIGH.
    """
    override = F.get(F.filter(ecosystem_labels, lambda x: x.isNotNull() & (x != "")), 0)
    label = F.upper(F.coalesce(override, database_label, F.lit("")))
    # Vendor words and the level each stands for.
    mapped = (
        F.when(label == "MODERATE", "MEDIUM")
        .when(label == "IMPORTANT", "HIGH")
        .when(label == "NEGLIGIBLE", "LOW")
        .otherwise(label)
    )
    return F.when(mapped.isin(*SEVERITY_RANK), mapped).otherwise("HIGH")


def preferred_cve(advisory_id: Column, aliases: Column) -> Column:
    first = F.get(F.filter(aliases, lambda a: F.startswith(a, F.lit("CVE-"))), 0)
    return F.coalesce(first, advisory_id, F.lit("UNKNOWN"))


def is_unpinned(version: Column) -> Column:
    return version.isin("*", "latest", "")


def help_uri(cwe_id: Column) -> Column:
    number = F.replace(cwe_id, F.lit("CWE-"), F.lit(""))
    return F.when(cwe_id != "", F.concat(F.lit("https://cwe.mitre.org/data/definitions/"), number, F.lit(".html")))


def sarif_tags(cwe_id: Column, owasp: Column) -> Column:
    code = F.split_part(owasp, F.lit(" – "), F.lit(1))
    return F.array_compact(F.array(F.when(cwe_id != "", cwe_id), F.when(owasp != "", code)))


def full_description(cwe_id: Column, cwe_name: Column, owasp: Column) -> Column:
    return F.when(cwe_id != "", F.concat(cwe_id, F.lit(": "), cwe_name, F.lit(". "), owasp))
