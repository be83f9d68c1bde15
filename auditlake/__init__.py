"""Code audits as Spark jobs: a corpus of files in, a table of findings out."""

from auditlake.config import ScanConfig
from auditlake.operators.baseline import apply_baseline, baseline_snapshot
from auditlake.operators.findings import enrich_confidence, enrich_cwe, enrich_fix_hint, min_severity
from auditlake.operators.profile import profile_projects
from auditlake.operators.rollup import project_summary, quality_gate, severity_counts
from auditlake.plans.audit import (
    audit_dependencies,
    audit_history,
    report_findings,
    scan,
    scan_by_project,
    summarize,
)
from auditlake.sources.settings import load_baseline, read_config
from auditlake.sources.tree import read_corpus, read_tree

__all__ = [
    "ScanConfig", "apply_baseline", "audit_dependencies", "audit_history", "baseline_snapshot", "enrich_confidence",
    "enrich_cwe", "enrich_fix_hint", "load_baseline", "min_severity", "profile_projects", "project_summary",
    "quality_gate", "read_config", "read_corpus", "read_tree", "report_findings", "scan", "scan_by_project",
    "severity_counts", "summarize",
]
