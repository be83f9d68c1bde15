"""Table layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType()}


def _flat(spec: str) -> T.StructType:
    """Schema of plain columns, built without a session so that tasks can import this module."""
    fields = (field.split() for field in spec.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


FILES = _flat("project string, path string, content string")

FINDINGS = _flat(
    "project string, rule_id string, severity string, severity_rank int, category string, description string,"
    "file_path string, line_number int, code_snippet string, remediation string, cwe_id string, cwe_name string,"
    "owasp string, fix_hint string, confidence string, match_count bigint, fingerprint string,"
    "check_ord int, rule_ord int"
)
FINDING_COLUMNS = FINDINGS.fieldNames()

DEPENDENCY_FINDINGS = _flat(
    "project string, package string, version string, issue_type string, severity string, description string,"
    "file_path string, remediation string, cve_id string, cvss_score double"
)
DEPENDENCY_COLUMNS = DEPENDENCY_FINDINGS.fieldNames()

HISTORY_COLUMNS = [
    "repo", "rule_id", "description", "commit_hash", "commit_date", "commit_author", "commit_message", "file_path",
    "line_snippet", "line_text", "fingerprint", "seq", "hit_ord",
]

# Nested layouts, as DDL text for readers and from_json.
CUSTOM_PATTERNS = (
    "array<struct<rule_id string, pattern string, severity string, description string, remediation string>>"
)

CONFIG = (
    "checks array<string>, severity_threshold string, baseline string, exclude_paths array<string>,"
    f"exclude_rules string, fail_on string, custom_patterns {CUSTOM_PATTERNS}"
)

BASELINE = (
    "version int, created string, files_scanned bigint, fingerprints array<string>,"
    "findings array<struct<rule_id string, severity string, file string, line int, snippet string,"
    "fingerprint string>>"
)

ADVISORY = (
    "id string, aliases array<string>, summary string, database_specific struct<severity string>,"
    "affected array<struct<package struct<ecosystem string, name string>, versions array<string>,"
    "ranges array<struct<type string, events array<struct<introduced string, fixed string, last_affected string>>>>,"
    "ecosystem_specific struct<severity string>>>"
)

PIP_AUDIT = "array<struct<name string, version string, vulns array<struct<id string>>>>"
NPM_AUDIT = "struct<vulnerabilities map<string, struct<severity string, range string, via string>>>"
SEMGREP = (
    "struct<results array<struct<check_id string, path string, start struct<line int>,"
    "extra struct<severity string, message string, metadata struct<cwe string, owasp string>>>>>"
)


def local_table(spark: SparkSession, rows: list[tuple], spec: str | T.StructType) -> DataFrame:
    """A small fixed table as a local relation, so that the planner knows its true size."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType.fromDDL(spec) if isinstance(spec, str) else spec
    arrow = to_arrow_schema(schema)
    columns = list(zip(*rows)) if rows else [[] for _ in arrow]
    table = pa.table([pa.array(list(c), type=f.type) for c, f in zip(columns, arrow)], schema=arrow)
    return spark.createDataFrame(table, schema=schema)
