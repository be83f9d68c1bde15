"""The findings table: building rows, union, enrichment, order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditlake.catalog.rules import ENTROPY_RULE, RULES, UNTRACKED_ENV_RULE, Rule
from auditlake.functions import text as tx
from auditlake.functions.dialect import to_jvm
from auditlake.operators.durable import durable
from auditlake.schema import FINDING_COLUMNS, FINDINGS, local_table

_CATALOG = (
    "rule_ord int, rule_id string, family string, check string, category string, severity string, severity_rank int,"
    "description string, remediation string, extensions array<string>, confidence string, cwe_id string,"
    "cwe_name string, owasp string, fix_hint string, check_ord int, in_history boolean, pattern string"
)


def rule_catalog(spark: SparkSession, rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """The catalog as a relation: one row per rule. Its size is fixed by the catalog and the settings."""
    chosen = RULES + (ENTROPY_RULE, UNTRACKED_ENV_RULE) if rules is None else rules
    rows = [
        (r.rule_ord, r.rule_id, r.family, r.check, r.category, r.severity, r.severity_rank, r.description,
         r.remediation, list(r.extensions) if r.extensions else None, r.confidence, *r.weakness, r.fix_hint,
         r.check_ord, r.in_history, r.pattern)
        for r in chosen
    ]
    return local_table(spark, rows, _CATALOG)


def jvm_catalog(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    """``rule_catalog`` with the patterns in JVM syntax as they are matched, and whether they have groups."""
    from dataclasses import replace

    catalog = rule_catalog(spark, tuple(replace(r, pattern=to_jvm(r.scanned[0])) for r in rules))
    grouped = [r.rule_ord for r in rules if r.scanned[1]]
    return catalog.withColumn("grouped", F.col("rule_ord").isin(grouped) if grouped else F.lit(False))


def finding_row(
    *, line: Column, raw: Column, count: Column, description: Column
) -> list[Column]:
    """Finding columns for rows that carry the catalog columns plus project and path."""
    code = tx.snippet(raw)
    values = {
        "description": description,
        "file_path": F.col("path"),
        "line_number": line,
        "code_snippet": code,
        "match_count": count,
        # the whole line, so that a baseline hides no other secret with the same beginning
        "fingerprint": tx.fingerprint(F.col("rule_id"), F.col("path"), raw),
    }
    return [values.get(name, F.col(name)).cast(FINDINGS[name].dataType).alias(name) for name in FINDING_COLUMNS]


def union_findings(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def enrich_cwe(findings: DataFrame) -> DataFrame:
    """CWE id, name and OWASP category by rule id; blanks for unknown rules."""
    return _with_dimension(findings, ["cwe_id", "cwe_name", "owasp"], "")


def enrich_confidence(findings: DataFrame) -> DataFrame:
    return _with_dimension(findings, ["confidence"], "HIGH")


def enrich_fix_hint(findings: DataFrame) -> DataFrame:
    return _with_dimension(findings, ["fix_hint"], "")


def _with_dimension(findings: DataFrame, columns: list[str], default: str) -> DataFrame:
    dim = rule_catalog(findings.sparkSession).select("rule_id", *columns)
    kept = [c for c in findings.columns if c not in columns]
    joined = findings.select(*kept).join(F.broadcast(dim), "rule_id", "left")
    return joined.select(*kept, *[F.coalesce(F.col(c), F.lit(default)).alias(c) for c in columns])


def min_severity(findings: DataFrame, threshold: str) -> DataFrame:
    from auditlake.catalog.taxonomy import severity_rank

    return findings.filter(F.col("severity_rank") >= severity_rank(threshold))


EMISSION_ORDER = ["project", "file_path", "check_ord", "rule_ord", "line_number"]


def order_by_emission(findings: DataFrame) -> DataFrame:
    """File by file, checks in run order, rules in catalog order.

    A sort reads its input twice, the first time to place its ranges: findings are written before,
    so that no file is scanned again.
    """
    return durable(findings).orderBy(*EMISSION_ORDER)


def order_by_severity(findings: DataFrame) -> DataFrame:
    """Worst first, then as ``order_by_emission``, and written before like there."""
    return durable(findings).orderBy(F.col("severity_rank").desc(), *EMISSION_ORDER)


def with_place(ordered: DataFrame, name: str = "place") -> DataFrame:
    """Adds each row's place, from 1, in the order the table is in.

    The sort's partitions are in order, so a row's place is its number in the partition plus the
    rows of the partitions before: a row per partition is summed, and no window holds all rows.
    """
    numbered = durable(ordered.withColumn("_number", F.monotonically_increasing_id()))
    part = F.shiftright("_number", 33)
    counts = numbered.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
    before = counts.select("_part", (F.sum("n").over(W.orderBy("_part")) - F.col("n")).alias("_before"))
    inside = F.col("_number").bitwiseAND((1 << 33) - 1)
    return (
        numbered.withColumn("_part", part).join(F.broadcast(before), "_part")
        .select(*ordered.columns, (F.col("_before") + inside + 1).alias(name))
    )
