"""Whole audits: the operators put together the way users run them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.catalog.rules import UNTRACKED_ENV_RULE_ID
from auditlake.config import ScanConfig
from auditlake.functions.scoring import rank_of
from auditlake.operators import baseline as bl
from auditlake.operators import dependencies as deps
from auditlake.operators.detect import detect, detect_project_patterns
from auditlake.operators.durable import durable
from auditlake.operators.findings import min_severity, union_findings
from auditlake.operators.history import history_findings, mark_still_present
from auditlake.operators.joins import skewed_join
from auditlake.operators.rollup import project_summary
from auditlake.operators.select import exclude_paths_by_project, select_files
from auditlake.operators.untracked import detect_untracked_env
from auditlake.sources.manifests import read_packages
from auditlake.sources.settings import read_project_baselines


def scan(files: DataFrame, config: ScanConfig | None = None, changed: DataFrame | None = None) -> DataFrame:
    """Findings of a corpus (project, path, content). ``changed`` restricts to (project, path)."""
    config = config or ScanConfig()
    found = detect(select_files(files, config.exclude_paths, changed), config)
    secrets = not config.checks or "secrets" in config.checks
    if secrets and UNTRACKED_ENV_RULE_ID not in config.exclude_rules:
        found = union_findings(found, detect_untracked_env(files))
    return found


def scan_by_project(files: DataFrame, settings: DataFrame, config: ScanConfig | None = None) -> DataFrame:
    """``scan`` where each project's own settings row (see ``read_config``) narrows the run.

    Path excludes are applied before matching; checks, rule excludes and the severity threshold are
    per-project filters on the findings, so one plan serves every project. The settings, a row per
    project, are written once, so that the corpus is not searched for them at each use. Checks and
    rules that the run itself leaves out are left out of every project.
    """
    config = config or ScanConfig()
    settings = durable(settings)
    # .env findings look at every file of a project, whatever its settings exclude
    chosen = exclude_paths_by_project(select_files(files, config.exclude_paths), settings)
    found = detect(chosen, config)
    if not config.checks or "secrets" in config.checks:
        custom = detect_project_patterns(chosen, settings, config.marker, config.compat)
        found = union_findings(found, custom.filter(~F.col("rule_id").isin(*config.exclude_rules)) if config.exclude_rules else custom)
        if UNTRACKED_ENV_RULE_ID not in config.exclude_rules:
            found = union_findings(found, detect_untracked_env(files))
    checks = F.col("checks")
    all_checks = checks.isNull() | (F.size(checks) == 0)
    # the check a finding belongs to, by category
    check_of = F.create_map(*[F.lit(v) for pair in _check_by_category().items() for v in pair])
    check = F.element_at(check_of, F.col("category"))
    selected = all_checks | F.array_contains(checks, check) | (
        (check == "xss") & F.array_contains(checks, "injection")
    )
    kept = (
        F.coalesce(selected, F.lit(True))
        & ~F.coalesce(F.array_contains("exclude_rules", F.col("rule_id")), F.lit(False))
        & (F.col("severity_rank") >= F.coalesce(rank_of(F.col("severity_threshold")), F.lit(1)))
    )
    rows = settings.select("project", "checks", "exclude_rules", "severity_threshold")
    return skewed_join(found, rows, ["project"], "left").filter(kept).select(*found.columns)


def gate_by_project(files: DataFrame, settings: DataFrame, config: ScanConfig | None = None) -> DataFrame:
    """(project, findings, failed) of ``scan_by_project``, each project by its own settings.

    Findings in the baseline file that a project names do not count; ``fail_on`` is the severity from
    which on a finding fails the project, or ``none``. Projects without settings take the run's.
    """
    config = config or ScanConfig()
    settings = durable(settings)
    new = bl.apply_baseline(scan_by_project(files, settings, config), read_project_baselines(files, settings))
    ranks = new.groupBy("project").agg(F.count("*").alias("findings"), F.max("severity_rank").alias("worst"))
    projects = files.select("project").distinct()
    fail_on = F.lower(F.coalesce("fail_on", F.lit(config.fail_on)))
    failed = (fail_on != "none") & (F.col("worst") >= F.coalesce(rank_of(fail_on), rank_of(F.lit("critical"))))
    return projects.join(ranks, "project", "left").join(settings.select("project", "fail_on"), "project", "left").select(
        "project", F.coalesce("findings", F.lit(0)).cast("long").alias("findings"), F.coalesce(failed, F.lit(False)).alias("failed")
    )


def _check_by_category() -> dict[str, str]:
    from auditlake.catalog.rules import FAMILIES

    return {f.category: f.check for f in FAMILIES}


def report_findings(
    findings: DataFrame, threshold: str = "low", baseline: DataFrame | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """Findings at or above the threshold and not in the baseline, and the suppressed counts."""
    kept = min_severity(findings, threshold)
    if baseline is None:
        return kept, None
    return bl.apply_baseline(kept, baseline), bl.suppressed_counts(kept, baseline)


def summarize(
    files: DataFrame, findings: DataFrame, config: ScanConfig | None = None, suppressed: DataFrame | None = None,
    changed: DataFrame | None = None,
) -> DataFrame:
    """Summary row per project for findings of ``scan`` over the same files."""
    config = config or ScanConfig()
    return project_summary(findings, select_files(files, config.exclude_paths, changed), suppressed)


def audit_dependencies(
    files: DataFrame, advisories: DataFrame | None = None, ranges: bool = False
) -> DataFrame:
    """Dependency findings of every manifest in a corpus."""
    packages = read_packages(files)
    parts = [deps.flag_known(packages), deps.flag_unpinned(packages)]
    if advisories is not None:
        parts.append(deps.match_advisories(packages, advisories, ranges))
    return deps.union_dependencies(*parts)


def audit_history(log: DataFrame, head: DataFrame, newest: int | None = None) -> DataFrame:
    """History findings with ``still_present``; ``head`` is (repo, path, content). ``newest`` keeps that many commits of each repository."""
    return mark_still_present(history_findings(log, newest), head)
